"""From lines to rankings (AG8, SNK5): read, judge, resolve and rank every list."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brimful.operators.knowledge import profile, profile_with_catalog, resolve
from brimful.operators.layout import select_reading
from brimful.operators.lists import parse_lists
from brimful.operators.quality import infer_category, provenance_counts, quality_gate, value_spread, withdraw_outliers
from brimful.operators.value import rank_offers
from brimful.sources.sinks import materialized


@dataclass(frozen=True)
class Ranking:
    ranked: DataFrame
    resolved: DataFrame
    quality: DataFrame
    spread: DataFrame
    provenance: DataFrame


def rank_items(items: DataFrame, brands: DataFrame, styles: DataFrame, catalog: DataFrame | None = None, glyphs: bool = True) -> Ranking:
    """Withdraw implausible prices, infer categories, resolve and rank, in this order; quality is judged before exclusion."""
    judged = materialized(infer_category(withdraw_outliers(items)), "judged")
    names = judged.select("name", F.col("category").alias("section"))
    known = profile(names, brands, styles, glyphs) if catalog is None else profile_with_catalog(names, brands, styles, catalog, glyphs)
    resolved = materialized(resolve(judged, known), "resolved")
    ranked = rank_offers(resolved.where("status = 'ranked'"))
    return Ranking(ranked, resolved, quality_gate(judged), value_spread(ranked), provenance_counts(ranked))


def rank_lists(lines: DataFrame, brands: DataFrame, styles: DataFrame, catalog: DataFrame | None = None, glyphs: bool = True) -> Ranking:
    return rank_items(materialized(parse_lists(lines), "items"), brands, styles, catalog, glyphs)


def score_readings(readings: DataFrame) -> DataFrame:
    """(photo_id, candidate_no, anchored, priced, items) of readings (photo_id, candidate_no, line_no, line)."""
    keyed = readings.withColumn("list_id", F.concat_ws("#", "photo_id", "candidate_no"))
    anchored = keyed.groupBy("photo_id", "candidate_no", "list_id").agg(F.count_if(F.col("line").rlike(r"[$£€][$£€ ]*\p{N}")).alias("anchored"))
    items = withdraw_outliers(materialized(parse_lists(keyed), "items")).groupBy("list_id").agg(F.count("price_cents").alias("priced"), F.count("*").alias("items"))
    scored = anchored.join(items, "list_id", "left").na.fill(0, ["priced", "items"])
    return scored.drop("list_id")


def best_reading(readings: DataFrame) -> DataFrame:
    """The lines of each photo's best reading."""
    return readings.join(select_reading(score_readings(readings)), ["photo_id", "candidate_no"], "left_semi")
