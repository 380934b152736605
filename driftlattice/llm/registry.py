"""The queries over this subpackage's operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlattice.llm import langid, warc
from driftlattice.llm.licenses import license_scan
from driftlattice.llm.mixing import STEP, WEIGHTS, mix
from driftlattice.llm.neardup import near_duplicates
from driftlattice.llm.ogg import media_columns
from driftlattice.llm.pieces import encode_documents
from driftlattice.llm.quality import STOP_WORDS, quality_rules
from driftlattice.llm.suffixdedup import dedup
from driftlattice.llm.textbuf import held_out, read_table
from driftlattice.llm.toxicity import toxicity_scores


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = license_scan(read_table(spark, sf_dir, "documents"))
    return df.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    df = toxicity_scores(docs, labels, ~held_out(F.col("doc_id")))
    return df.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(read_table(spark, sf_dir, "documents"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read_table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    df = langid.identify(docs, langid.fit(docs, ~held_out(F.col("doc_id"))))
    return df.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = quality_rules(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads are decoded on reading, though they are no column of the result: that verifies their digests."""
    df = warc.read_archive(spark, warc.archive(read_table(spark, sf_dir, "pages")))
    return df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(read_table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = mix(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return df.select("doc_id", "size", "source_size", "target", "taken")


_STOP = ", ".join(f"'{w}'" for w in sorted({w for x in STOP_WORDS.values() for w in x.split()}))

OP6_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, doc_id, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
tri AS (SELECT k, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
dup AS (SELECT k, i FROM tri QUALIFY count(*) OVER (PARTITION BY k, g) > 1),
rep AS (SELECT k, count(DISTINCT i + o) AS n FROM dup, (VALUES (0), (1), (2)) AS s(o) GROUP BY k),
c AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
  coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines, len(list_filter(w, lambda x: lower(x) IN ({_STOP}))) AS n_stop FROM w LEFT JOIN rep USING (k)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, greatest(n_words, 1)::DOUBLE AS n FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n BETWEEN 2 AND 12 AND n_symbols / n <= 0.5 AND n_stop / n >= 0.02
  AND n_dup_lines / greatest(n_lines, 1)::DOUBLE <= 0.5 AND n_repeat_words / n <= 0.5 AS kept FROM b
"""


def _lague(table: str, group: str, key: str, votes: str, seats: str, out: str) -> str:
    """Highest quotients, seat by seat: each row offers its seats from a few before the rounded share to a few after."""
    return f"""
{out}_base AS (SELECT *, sum({votes}) OVER (PARTITION BY {group})::DOUBLE AS v_all, count(*) OVER (PARTITION BY {group}) AS n_rows FROM {table}),
{out}_round AS (SELECT *, CASE WHEN v_all > 0 THEN floor({votes}::DOUBLE * {seats} / v_all + 0.5)::BIGINT ELSE 0 END AS q0 FROM {out}_base),
{out}_seats AS (SELECT *, unnest(range(greatest(q0 - n_rows - 2, 0), q0 + n_rows + 2)) AS seat FROM {out}_round WHERE v_all > 0),
{out}_left AS (SELECT {group}, max({seats}) - coalesce(sum(greatest(q0 - n_rows - 2, 0)), 0) AS n_left FROM {out}_round WHERE v_all > 0 GROUP BY {group}),
{out}_won AS (SELECT {group}, {key}, count(*) AS n_won FROM (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {votes}::DOUBLE / (2 * seat + 1) DESC, {key}) AS rn FROM {out}_seats)
  JOIN {out}_left USING ({group}) WHERE rn <= n_left GROUP BY {group}, {key}),
{out}_done AS (SELECT r.*, CASE WHEN v_all > 0 THEN greatest(q0 - n_rows - 2, 0) + coalesce(n_won, 0) ELSE 0 END AS {out} FROM {out}_round r LEFT JOIN {out}_won USING ({group}, {key}))"""


OP10_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s0),
s2 AS (SELECT *, [{", ".join(map(str, WEIGHTS))}][(rank - 1) % {len(WEIGHTS)} + 1] AS weight, 2.0::DOUBLE * source_size AS cap, 1 AS one FROM s1),
s3 AS (SELECT *, cap / weight AS ratio FROM s2),
s4 AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY ratio, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM s3),
s5 AS (SELECT source, source_size, rank, one, least(cap, weight * (SELECT arg_min(lev, (ratio, rank)) FROM s4 WHERE ratio >= lev)) AS target FROM s4),
s6 AS (SELECT *, floor(sum(target) OVER () / blk + 0.5)::BIGINT AS seats, greatest(250000, ceil(sum(source_size) OVER () / 100000)) AS tokens
  FROM (SELECT *, greatest(1, least(64, min(source_size) FILTER (source_size > 0) OVER () // 16))::BIGINT AS blk FROM s5)),
{_lague("s6", "one", "rank", "target", "seats", "quota")},
s7 AS (SELECT source, source_size, rank, target, quota, blk, greatest(1, ceil(source_size / tokens::DOUBLE))::BIGINT AS n_shards FROM quota_done),
p AS (SELECT k, doc_id, size, s7.*, md5('7:' || coalesce(doc_id::VARCHAR, '')) AS digest FROM d JOIN s7 ON d.source IS NOT DISTINCT FROM s7.source),
p1 AS (SELECT *, ('0x' || digest[8:14])::BIGINT % n_shards AS shard FROM p),
p2 AS (SELECT *, (sum(size) OVER (PARTITION BY rank, shard ORDER BY digest, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start FROM p1),
h0 AS (SELECT rank, quota, blk, shard, sum(size)::BIGINT AS shard_size FROM p1 GROUP BY ALL),
{_lague("h0", "rank", "shard", "shard_size", "quota", "shard_quota")},
h1 AS (SELECT rank, shard, shard_quota, ceil(shard_size / blk::DOUBLE)::BIGINT AS n_blocks FROM shard_quota_done),
h2 AS (SELECT *, CASE WHEN n_blocks > 0 THEN shard_quota // n_blocks ELSE 0 END AS whole, CASE WHEN n_blocks > 0 THEN shard_quota % n_blocks ELSE 0 END AS extra,
  CASE WHEN n_blocks > 0 THEN ('0x' || md5('7:' || rank || ':' || shard)[1:7])::BIGINT % n_blocks ELSE 0 END AS turn FROM h1),
b AS (SELECT *, unnest(range(start // blk, (start + size - 1) // blk + 1)) AS b FROM p2 JOIN h2 USING (rank, shard) WHERE size > 0),
e AS (SELECT k, sum(least((b + 1) * blk, start + size) - greatest(b * blk, start)) AS part FROM b WHERE (b * {STEP} + turn) % n_blocks < extra GROUP BY k)
SELECT doc_id, size, source_size, target, CASE WHEN size > 0 THEN least(whole * size + coalesce(part, 0), 2 * size) ELSE 0 END::BIGINT AS taken
FROM p2 JOIN h2 USING (rank, shard) LEFT JOIN e USING (k)
"""

#: RFC 4648 base 32 of a SHA-1: its 160 bits, five at a time.
OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, h, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS top FROM p),
b AS (SELECT *, list_reduce(list_transform(range(0, 5), lambda k: (lpad(bin(('0x' || x[k * 8 + 1:k * 8 + 8])::BIGINT), 32, '0'))), lambda a, c: a || c) AS bits FROM d)
SELECT page_id, payload_bytes,
  list_reduce(list_transform(range(0, 32), lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[list_reduce(list_transform(range(1, 6), lambda i: bits[k * 5 + i]::INTEGER), lambda a, c: 2 * a + c) + 1]), lambda a, c: a || c) AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to FROM b
"""

QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_toxicity": op2_toxicity,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_sentencepiece": op5_sentencepiece,
    "op7_language_id": op7_language_id,
    "op6_quality_rules": op6_quality_rules,
    "op8_warc": op8_warc,
    "op9_media_columns": op9_media_columns,
    "op10_mixing": op10_mixing,
}
SQL = {"op8_warc": OP8_SQL, "op6_quality_rules": OP6_SQL, "op10_mixing": OP10_SQL}
