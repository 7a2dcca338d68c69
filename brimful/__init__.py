"""Batch and streaming jobs that turn catalogs and price lists into value rankings on Spark."""
