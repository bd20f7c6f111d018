"""The numbered queries over the driver's tables, and their SQL where DuckDB can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrier.llm import decontaminate, filter_audit, html_content, lines, mixing, quality, secrets, simhash, substrings, tokens, vector_codes, warc, word_windows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup(docs, lines.build(docs)).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_windows.remove_repeated(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", *quality.BASE, "base_failed", "kept", "score")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages")).drop("payload")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = F.filter("findings", lambda m: m["kind"] < 3)
    counts = [F.size(F.filter(F.transform("findings", lambda m: m["kind"]), lambda kind: kind == F.lit(k))).cast("long").alias(f"n_{secrets.KINDS[k]}") for k in range(3)]
    live = F.size(F.filter("findings", lambda m: m["live"])).cast("long").alias("n_live")
    return found.select("doc_id", *counts, F.sha2(secrets.spans(base), 256).alias("base_sha256"), secrets.spans(F.col("findings")).alias("spans"), live)


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeated(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), with_text=False)
    return hits.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_content.extract(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_substring_dedup, op3_quality_rules, op4_token_counts, op5_warc, op6_secret_scan, op7_suffix_array_dedup, op8_mixing, op9_decontamination, op10_simhash, op11_vector_codes, op12_filter_audit, op13_html_extraction)}
#: DuckDB's trim takes a set of characters; translate lower-cases A-Z alone.
_LINES = """
WITH line AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM line),
held AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key)
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE h.first < k.doc_id) AS n_dropped,
  sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.place) FILTER (WHERE h.first IS NULL OR h.first >= k.doc_id), '')) AS kept_sha256
FROM keyed k LEFT JOIN held h ON h.key = k.key AND length(k.key) >= 10
GROUP BY k.doc_id
"""

_WINDOWS = r"""
WITH doc AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM doc WHERE len(w) >= 13)),
held AS (SELECT s, min(doc_id) AS first FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM win JOIN held USING (s) WHERE first < doc_id),
word AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM doc),
kept AS (SELECT word.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS t FROM word ANTI JOIN gone USING (doc_id, k) GROUP BY word.doc_id)
SELECT doc.doc_id, len(w) AS n_words, len(w) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM doc LEFT JOIN kept USING (doc_id)
"""

_ARCHIVE = """
WITH page AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages),
best AS (SELECT h, max(page_id) AS response FROM page WHERE n >= 1000 GROUP BY h)
SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest,
  CASE WHEN page_id < response THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < response THEN response END AS refers_to
FROM page LEFT JOIN best USING (h)
"""

_MIX = r"""
WITH doc AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(doc_id || ':17') AS key FROM documents),
src AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM doc GROUP BY source),
cap AS (SELECT *, CASE place % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, source_size * 2.0::DOUBLE AS cap FROM src),
steps AS (
  SELECT 0::DOUBLE AS r, 0::DOUBLE AS fixed, 0::DOUBLE AS used
  UNION ALL SELECT cap / w, sum(cap) OVER (ORDER BY cap / w), sum(w) OVER (ORDER BY cap / w) FROM cap),
level AS (
  SELECT max(lam) AS lam FROM (
    SELECT (1.5 * (SELECT sum(source_size) FROM src)::DOUBLE - fixed) / ((SELECT sum(w) FROM cap) - used) AS lam, r FROM steps
    WHERE used < (SELECT sum(w) FROM cap)) WHERE lam >= r),
aim AS (SELECT *, least(w * lam, cap) AS target FROM cap, level),
upto AS (
  SELECT d.*, a.place, a.source_size, a.target, sum(size) OVER (PARTITION BY a.place ORDER BY key, doc_id) AS upto
  FROM doc d JOIN aim a ON d.source IS NOT DISTINCT FROM a.source),
queue AS (
  SELECT doc_id, size, sum(size) OVER (ORDER BY (upto + turn * source_size)::DOUBLE / target, place, key, doc_id, turn) AS spent
  FROM upto, (VALUES (0), (1)) t(turn) WHERE size > 0 AND target > 0),
taken AS (SELECT doc_id, sum(size) AS taken FROM queue WHERE spent <= (SELECT sum(target) FROM aim) + 0.25 GROUP BY doc_id)
SELECT doc_id, size, source_size::BIGINT AS source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM upto LEFT JOIN taken USING (doc_id)
"""



def _codes(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """One common table for each round. Whole numbers stand in doubles, where they are exact."""
    steps = []
    for k in range(rounds + 1):
        near = f"""n{k} AS MATERIALIZED (
  SELECT row, part, unnest(v) AS x, generate_subscripts(v, 1) AS d, entry, away FROM (
    SELECT p.row, p.part, any_value(p.v) AS v, arg_min(b.entry, list_inner_product(b.v, b.v) - 2 * list_inner_product(b.v, p.v) + b.entry / 1024) AS entry,
      min(list_inner_product(b.v, b.v) - 2 * list_inner_product(b.v, p.v) + list_inner_product(p.v, p.v)) AS away
    FROM piece p JOIN b{k} b USING (part) GROUP BY p.row, p.part))"""
        move = f"""b{k + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM b{k} b LEFT JOIN (
    SELECT part, entry, list(m ORDER BY d) AS v FROM (SELECT part, entry, d, floor(sum(x) / count(*)) AS m FROM n{k} GROUP BY part, entry, d) GROUP BY part, entry) m USING (part, entry))"""
        steps += [near] if k == rounds else [near, move]
    joined = ",\n".join(steps)
    return f"""
WITH vec AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, q) - 1 AS row, * FROM (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * {scale})) AS q FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
piece AS MATERIALIZED (SELECT row, part, q[part * len(q) // {parts} + 1:(part + 1) * len(q) // {parts}] AS v FROM vec, range({parts}) r(part)),
b0 AS MATERIALIZED (SELECT part, row AS entry, v FROM piece WHERE row < {entries}),
{joined},
coded AS (
  SELECT row, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(away)::BIGINT AS error
  FROM (SELECT DISTINCT row, part, entry, away FROM n{rounds}) GROUP BY row),
book AS (
  SELECT sha256(string_agg(c, ',' ORDER BY part, entry)) AS s
  FROM (SELECT part, entry, array_to_string(list_transform(v, lambda x: x::BIGINT), ',') AS c FROM b{rounds}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, s AS codebooks_sha256
FROM vec JOIN coded USING (row), book
"""


#: Every document walks through every order by itself: it goes where it first fails.
_AUDIT = r"""
WITH doc AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
mark AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
flag AS MATERIALIZED (
  SELECT doc.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, concat(
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END,
    CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END,
    CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t) THEN 'C' ELSE '' END,
    CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END,
    CASE WHEN doc.doc_id > min(doc.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS fails
  FROM doc LEFT JOIN mark USING (doc_id)),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
perm AS (
  SELECT concat(a.x, b.x, c.x, d.x, e.x) AS filter_order FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
gone AS MATERIALIZED (
  SELECT part, filter_order, fails, good, toxic, list_min(list_transform(string_split(fails, ''), lambda f: CASE WHEN f = '' THEN 6 ELSE position(f IN filter_order) END)) AS place
  FROM flag, perm),
step AS (SELECT filter_order, step, substr(filter_order, step, 1) AS f FROM perm, range(1, 6) s(step)),
one AS (
  SELECT part, filter_order, step, f, count(*) FILTER (WHERE place > step) AS kept, count(*) FILTER (WHERE place = step) AS removed,
    count(*) FILTER (WHERE place < step AND contains(fails, f)) AS redundant, count(*) FILTER (WHERE fails = f) AS unique_fails,
    count(*) FILTER (WHERE place = step AND good = 1) AS good_lost, count(*) FILTER (WHERE place = step AND toxic = 1) AS toxic_lost
  FROM gone JOIN step USING (filter_order) GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step::INTEGER AS step, f AS filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM one
"""

ORACLES: dict[str, str] = {"op1_line_dedup": _LINES, "op2_substring_dedup": _WINDOWS, "op5_warc": _ARCHIVE, "op8_mixing": _MIX, "op11_vector_codes": _codes(), "op12_filter_audit": _AUDIT}
