"""Registered queries of this subpackage; each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brimful.llm.suffix_dedup import remove_repeats

    kept = remove_repeats(_documents(spark, sf_dir))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brimful.llm.pii import find

    return find(_documents(spark, sf_dir)).withColumn("base", F.sha2("base", 256)).withColumnRenamed("base", "base_sha256")


def op3_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brimful.llm.preferences import format_pairs, mismatched_pairs

    pairs = format_pairs(mismatched_pairs(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    counted = lambda side: F.aggregate(f"{side}_spans", F.lit(0), lambda n, x: n + x.end - x.start).cast("long").alias(f"{side}_counted")
    digests = [F.sha2(c, 256).alias(f"{c}_sha256") for c in ("prompt", "chosen", "rejected")]
    return pairs.select("pair_id", "n_prompt_turns", *digests, counted("chosen"), counted("rejected"))


OP3_SQL = """
WITH t AS (
  SELECT CAST(conv_id AS BIGINT) AS pair_id, coalesce(role, 'user') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'user'), coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
a AS (SELECT pair_id, max(k) AS answer FROM t WHERE role = 'assistant' GROUP BY pair_id),
own AS (SELECT a.pair_id, a.answer, t.text FROM a JOIN t ON t.pair_id = a.pair_id AND t.k = a.answer),
n AS (SELECT pair_id, answer, text, coalesce(lead(text) OVER (ORDER BY pair_id), first_value(text) OVER (ORDER BY pair_id)) AS other FROM own),
s AS (
  SELECT t.pair_id, t.k, t.role, t.text, CASE WHEN t.k = n.answer THEN n.other ELSE t.text END AS swapped,
         n.text <> n.other AND t.k >= n.answer AS after
  FROM t JOIN n USING (pair_id)),
r AS (
  SELECT pair_id, k, role, after,
         '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS shown,
         '<|' || role || '|>' || chr(10) || swapped || '<|end|>' || chr(10) AS reshown,
         length(text) + 8 AS size, length(swapped) + 8 AS resize
  FROM s)
SELECT pair_id, CAST(count(*) FILTER (NOT after) AS BIGINT) AS n_prompt_turns,
       sha256(coalesce(string_agg(shown, '' ORDER BY k) FILTER (NOT after), '')) AS prompt_sha256,
       sha256(coalesce(string_agg(shown, '' ORDER BY k) FILTER (after), '')) AS chosen_sha256,
       sha256(coalesce(string_agg(reshown, '' ORDER BY k) FILTER (after), '')) AS rejected_sha256,
       CAST(coalesce(sum(size) FILTER (after AND role = 'assistant'), 0) AS BIGINT) AS chosen_counted,
       CAST(coalesce(sum(resize) FILTER (after AND role = 'assistant'), 0) AS BIGINT) AS rejected_counted
FROM r GROUP BY pair_id
"""


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brimful.llm.packing import pieces, place, shard_count

    docs = _documents(spark, sf_dir)
    cut = pieces(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return place(cut, shard_count(docs)).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brimful.llm.quality_classifier import score, train

    docs = _documents(spark, sf_dir)
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brimful.llm.quality_rules import judge

    return judge(_documents(spark, sf_dir))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brimful.llm.fingerprints import compare_edits

    return compare_edits(_documents(spark, sf_dir))


def op8_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brimful.llm.pieces import decode_pieces, sample_pieces

    decoded = decode_pieces(sample_pieces(_documents(spark, sf_dir)))
    return decoded.select("doc_id", "n_pieces", "ids_crc32", F.sha2("text", 256).alias("decoded_sha256"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brimful.llm.common import scratch_path
    from brimful.llm.token_files import digests, read, write

    out = scratch_path(spark, "token-files")
    write(_documents(spark, sf_dir), out)
    return digests(read(spark, out))


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brimful.llm.minhash_dedup import near_duplicates

    return near_duplicates(_documents(spark, sf_dir))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brimful.llm.collocations import collocations

    return collocations(_documents(spark, sf_dir))


OP11_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
p AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
f AS (
  SELECT lang, phrase, k, count(*) AS f FROM (
    SELECT lang, 1 AS k, unnest(ws) AS phrase FROM w
    UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w
    UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) FROM w)
  GROUP BY ALL),
c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= 10),
cuts AS (
  SELECT lang, phrase, k, a, ws, unnest(range(1, k)) AS cut FROM c),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.cut, l.f AS l, r.f AS r, c.ws,
         1000000 * CAST(c.a AS HUGEINT) * c.a // (CAST(l.f AS HUGEINT) * r.f) AS score
  FROM cuts c
  JOIN f l ON l.lang = c.lang AND l.k = c.cut AND l.phrase = array_to_string(c.ws[1:c.cut], ' ')
  JOIN f r ON r.lang = c.lang AND r.k = c.k - c.cut AND r.phrase = array_to_string(c.ws[c.cut + 1:], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_parts AS (
  SELECT lang, part AS phrase, max(a) AS a FROM (
    SELECT lang, a, unnest([ws[1] || ' ' || ws[2], ws[2] || ' ' || ws[3]]) AS part FROM c WHERE k = 3) GROUP BY ALL),
kept AS (
  SELECT b.* FROM best b LEFT JOIN inner_parts i ON i.lang = b.lang AND i.phrase = b.phrase
  WHERE i.a IS NULL OR 100 * i.a < 50 * b.a),
totals AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r,
       CAST(t.n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept k JOIN totals t ON t.lang = k.lang QUALIFY rank <= 2000
"""


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brimful.llm.exact_dedup import groups

    return groups(_documents(spark, sf_dir)).withColumn("digest", F.lower(F.hex("digest"))).withColumnRenamed("digest", "text_sha256")


OP12_SQL = r"""
WITH t AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, length(coalesce(text, '')) AS n_chars,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER best = 1 AS kept, text_sha256
FROM t WINDOW best AS (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id NULLS LAST)
"""


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brimful.llm.whitening import whitened_components

    return whitened_components(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_suffix_dedup, op2_pii, op3_preferences, op4_packing, op5_quality_classifier, op6_quality_rules, op7_fingerprints, op8_sampled_pieces, op9_token_files, op10_minhash_dedup, op11_collocations, op12_exact_dedup, op13_whitening)}
ORACLE_SQL: dict[str, str] = {"op3_preferences": OP3_SQL, "op11_collocations": OP11_SQL, "op12_exact_dedup": OP12_SQL}
