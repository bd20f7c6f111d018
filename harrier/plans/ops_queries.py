"""Search, ingestion, evaluation, events and report queries over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from harrier.functions import text as X
from harrier.operators import citations, evaluation, filters, fusion, ingest, ranking, relations, reports, search
from harrier.plans.registry import Registry
from harrier.sources import files
from harrier.sources.shared import shared_folder
from harrier.sources.tables import table
from harrier.streaming import events as E

Q = Registry()

NORM = r"trim(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{M}}\p{{N}}_\s-]', ' ', 'g'), '\s+', ' ', 'g'))"
LADDER = """CASE WHEN t = q THEN 100 WHEN contains(t, q) AND starts_with(t, q) THEN 94 WHEN contains(t, q) THEN 90
  WHEN length(q) >= 2 AND starts_with(array_to_string(list_transform(string_split(t, ' '), lambda w: w[1]), ''), replace(q, ' ', '')) THEN 87
  WHEN len(list_filter(string_split(q, ' '), lambda w: NOT contains(t, w))) = 0 THEN 84
  WHEN contains(b, q) THEN 74 WHEN len(list_filter(string_split(q, ' '), lambda w: NOT contains(b, w))) = 0 THEN 66 ELSE 0 END"""
KINDS = f"""k AS (
  SELECT 'part' AS kind, p_partkey AS id, p_name AS title, p_type AS body, NULL::TIMESTAMP AS updated FROM part
  UNION ALL SELECT 'customer', c_custkey, c_name, c_mktsegment, NULL FROM customer
  UNION ALL SELECT 'document', doc_id, split_part(text, chr(10), 1), text, NULL FROM documents),
n AS (SELECT kind, id, title, {NORM.format('title')} AS t, {NORM.format("coalesce(body, '')")} AS b, 'the on' AS q FROM k),
hits AS (SELECT kind, id, title, {LADDER} AS score FROM n WHERE {LADDER} > 0)"""


def _kinds(spark, sf_dir):
    none = F.lit(None).cast("timestamp").alias("updated")
    part, customer, document = (table(spark, sf_dir, t) for t in ("part", "customer", "documents"))
    return [
        part.select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("body"), none),
        customer.select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("body"), none),
        document.select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.col("text").alias("body"), none),
    ]


@Q(f"WITH {KINDS} SELECT kind, id, score FROM hits")
def search_ladder(spark, sf_dir):
    return search.ranked(_kinds(spark, sf_dir), "The  ON!").select("kind", "id", "score")


@Q(f"WITH {KINDS} SELECT kind, count(*) AS n FROM hits GROUP BY kind")
def search_federated(spark, sf_dir):
    return search.counts(search.ranked(_kinds(spark, sf_dir), "the on"))


@Q(f"WITH {KINDS} SELECT kind, id, score, CASE WHEN score >= 88 THEN 'Highly relevant' WHEN score >= 70 THEN 'Relevant' ELSE 'Related' END AS band FROM hits ORDER BY score DESC, title, id LIMIT 20 OFFSET 5")
def search_page(spark, sf_dir):
    return search.page(search.ranked(_kinds(spark, sf_dir), "the on"), 20, 5).select("kind", "id", "score", "band")


@Q(rf"WITH d AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS c FROM documents), p AS (SELECT doc_id, c, position('the on' IN lower(c)) - 1 AS pos FROM d), s AS (SELECT *, CASE WHEN pos >= 0 THEN greatest(0, pos - 80) ELSE 0 END AS st FROM p) SELECT doc_id, CASE WHEN st > 0 THEN '…' ELSE '' END || substring(c, st + 1, 320) || CASE WHEN st + 320 < length(c) THEN '…' ELSE '' END AS excerpt FROM s WHERE c <> ''")
def excerpts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.excerpt(F.col("text"), F.lit("the on")).alias("excerpt")).filter("excerpt is not null")


TOK = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{M}}\p{{N}}_]+(?:[-''][\p{{L}}\p{{M}}\p{{N}}_]+)*')"


Q.both("user_sessions_lag", "SELECT event_id, user_id FROM (SELECT event_id, user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) t WHERE before IS NULL OR ts > before + INTERVAL 12 HOUR")


@Q("SELECT CASE WHEN b.doc_id IS NULL THEN a.doc_id ELSE b.doc_id END AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'new' WHEN a.doc_id IS NULL THEN 'deleted' WHEN a.h = b.h THEN 'unchanged' ELSE 'changed' END AS change_type FROM (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 1) a FULL JOIN (SELECT doc_id, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 10 <> 2) b ON a.doc_id = b.doc_id")
def manifest_diff(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    now = docs.filter("doc_id % 10 <> 1").select("doc_id", F.sha2("text", 256).alias("h"))
    before = docs.filter("doc_id % 10 <> 2").select("doc_id", F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("h"))
    return ingest.manifest_diff(now, before, "doc_id", "h")


@Q("SELECT change_type, count(*) AS n FROM (SELECT CASE WHEN doc_id % 10 = 1 THEN 'deleted' WHEN doc_id % 10 = 2 THEN 'new' WHEN doc_id % 7 = 0 THEN 'changed' ELSE 'unchanged' END AS change_type FROM documents) GROUP BY change_type")
def sync_counters(spark, sf_dir):
    return manifest_diff(spark, sf_dir).groupBy("change_type").agg(F.count("*").alias("n"))


SNAPS = "b AS (SELECT source || '/' || doc_id AS path, sha256(text) AS h, n_chars AS size FROM documents WHERE doc_id % 3 <> 0), a AS (SELECT CASE WHEN doc_id % 5 = 0 THEN 'moved/' ELSE '' END || source || '/' || doc_id AS path, sha256(text) AS h, n_chars AS size FROM documents WHERE doc_id % 3 <> 1)"


def _snapshots(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    before = docs.filter("doc_id % 3 <> 0").select(path.alias("path"), F.sha2("text", 256).alias("h"), F.col("n_chars").alias("size"))
    now = docs.filter("doc_id % 3 <> 1").select(F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("moved/"), path)).otherwise(path).alias("path"), F.sha2("text", 256).alias("h"), F.col("n_chars").alias("size"))
    return now, before


@Q(f"WITH {SNAPS}, f AS (SELECT path, h, size, row_number() OVER (PARTITION BY h, size ORDER BY path) AS n FROM a WHERE path NOT IN (SELECT path FROM b)), g AS (SELECT path, h, size, row_number() OVER (PARTITION BY h, size ORDER BY path) AS n FROM b WHERE path NOT IN (SELECT path FROM a)) SELECT g.path AS old, f.path AS new FROM f JOIN g USING (h, size, n)")
def move_detect(spark, sf_dir):
    now, before = _snapshots(spark, sf_dir)
    return ingest.moves(now, before, "path", ["h", "size"]).select("old", "new")


@Q("""WITH b AS (SELECT source AS folder, sha256(text) AS h FROM documents), a AS (SELECT CASE WHEN source IN ('src3', 'src7') THEN 'x/' || source ELSE source END AS folder, sha256(text) AS h FROM documents),
sa AS (SELECT folder, string_agg(h, ',' ORDER BY h) AS s FROM a GROUP BY folder), sb AS (SELECT folder, string_agg(h, ',' ORDER BY h) AS s FROM b GROUP BY folder)
SELECT sb.folder AS old, sa.folder AS new FROM sa JOIN sb USING (s) WHERE sa.folder NOT IN (SELECT folder FROM sb) AND sb.folder NOT IN (SELECT folder FROM sa)""")
def folder_moves(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("folder"), F.sha2("text", 256).alias("h"))
    now = docs.withColumn("folder", F.when(F.col("folder").isin("src3", "src7"), F.concat(F.lit("x/"), "folder")).otherwise(F.col("folder")))
    return ingest.folder_moves(now, docs, "folder", "h")


#: Answers made of documents: the expected words are fixed, labels tell what should be answered.
EVAL = r"""e AS (SELECT d.doc_id, 'exp' || d.doc_id % 6 AS experiment_id, lang AS category, source AS difficulty, quality = 1 AS should_answer, n_chars / 100.0::DOUBLE AS latency,
  CASE WHEN d.doc_id % 9 = 0 THEN 'There is insufficient evidence.' ELSE text || ' [1] [2] [1]' END AS answer FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
n AS (SELECT *, lower(trim(regexp_replace(answer, '\s+', ' ', 'g'))) AS a FROM e),
m AS (SELECT *, contains(a, 'the')::INTEGER + contains(a, 'and')::INTEGER + contains(a, 'zebra')::INTEGER AS hits, contains(a, '$$$')::INTEGER AS bad, contains(a, 'insufficient evidence') AS safe, len(list_distinct(regexp_extract_all(answer, '\[(\d+)\]', 1))) AS cites FROM n),
v AS (SELECT *, round(hits / 3.0::DOUBLE, 6) AS keyword_score, CASE WHEN should_answer THEN a <> '' AND NOT safe AND hits / 3.0 >= 0.5 ELSE safe AND bad = 0 END AS passed, CASE WHEN should_answer THEN bad > 0 ELSE a <> '' AND NOT safe END AS hallucinated, CASE WHEN cites > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS citation_quality FROM m),
s AS (SELECT experiment_id, count(*) AS question_count, round(avg(passed::INTEGER), 6) AS answer_accuracy, round(coalesce(avg(CASE WHEN should_answer THEN passed::INTEGER END), 0), 6) AS supported_accuracy, round(coalesce(avg(CASE WHEN NOT should_answer THEN passed::INTEGER END), 0), 6) AS unsupported_accuracy, round(avg(hallucinated::INTEGER), 6) AS hallucination_rate, round(avg(keyword_score), 6) AS average_keyword_score, round(avg(citation_quality), 6) AS average_citation_quality, round(avg(latency), 6) AS average_latency FROM v GROUP BY experiment_id),
r AS (SELECT experiment_id, average_latency, hallucination_rate, round(0.55 * answer_accuracy + 0.15 * average_citation_quality + 0.2 * (1 - hallucination_rate) + 0.1 * (1 - (average_latency - min(average_latency) OVER ()) / (max(average_latency) OVER () - min(average_latency) OVER ())), 6) AS overall_score FROM s)"""


def _evaluated(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    answer = F.when(F.col("doc_id") % 9 == 0, "There is insufficient evidence.").otherwise(F.concat("text", F.lit(" [1] [2] [1]")))
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    made = rows.select("doc_id", F.concat(F.lit("exp"), (F.col("doc_id") % 6).cast("string")).alias("experiment_id"), F.col("lang").alias("category"), F.col("source").alias("difficulty"), (F.col("quality") == 1).alias("should_answer"), (F.col("n_chars") / 100.0).alias("latency"), answer.alias("answer"), F.lit("answered").alias("status"), words("the", "and", "zebra").alias("expected"), words("$$$").alias("forbidden"), F.array().cast("array<string>").alias("citations"))
    return evaluation.evaluate(made)


@Q(f"WITH {EVAL} SELECT doc_id, keyword_score, hits AS matched_keywords, passed, hallucinated, cites::INTEGER AS citation_count FROM v")
def eval_rows(spark, sf_dir):
    return _evaluated(spark, sf_dir).select("doc_id", "keyword_score", "matched_keywords", "passed", "hallucinated", "citation_count")


@Q(f"WITH {EVAL} SELECT * FROM s")
def eval_aggregate(spark, sf_dir):
    return evaluation.aggregate(_evaluated(spark, sf_dir))


@Q(f"WITH {EVAL} SELECT experiment_id, 'category' AS part, category AS value, round(avg(passed::INTEGER), 6) AS pass_rate FROM v GROUP BY ALL UNION ALL SELECT experiment_id, 'difficulty', difficulty, round(avg(passed::INTEGER), 6) FROM v GROUP BY ALL")
def eval_by_group(spark, sf_dir):
    return evaluation.pass_rates(_evaluated(spark, sf_dir))


@Q(f"WITH {EVAL} SELECT experiment_id, overall_score, row_number() OVER (ORDER BY overall_score DESC, average_latency, experiment_id)::INTEGER AS place FROM r")
def eval_rank(spark, sf_dir):
    return evaluation.rank(evaluation.aggregate(_evaluated(spark, sf_dir))).select("experiment_id", "overall_score", "place")


@Q(f"WITH {EVAL} SELECT (SELECT experiment_id FROM r ORDER BY overall_score DESC, average_latency, experiment_id LIMIT 1) AS best, (SELECT experiment_id FROM r ORDER BY average_latency, experiment_id LIMIT 1) AS fastest, (SELECT experiment_id FROM r ORDER BY hallucination_rate, experiment_id LIMIT 1) AS safest, (SELECT round(max(overall_score) - avg(overall_score), 6) FROM r) AS lead")
def eval_best(spark, sf_dir):
    return evaluation.best(evaluation.rank(evaluation.aggregate(_evaluated(spark, sf_dir))))


@Q("WITH x AS (SELECT doc_id, (doc_id % 17) / 17.0::DOUBLE AS cov, doc_id % 5 <> 0 AS safe, (doc_id % 11)::DOUBLE AS den, doc_id % 3 AS forb, n_chars / 10.0::DOUBLE AS lat, n_chars AS tok FROM documents) SELECT doc_id, round(0.4 * cov + 0.2 * safe::INTEGER + 0.2 * least(1.0, den / max(den) OVER ()) - (0.1 * least(1.0, forb) + 0.05 * lat / max(lat) OVER () + 0.05 * tok / max(tok) OVER ()), 6) AS score FROM x")
def tradeoff_score(spark, sf_dir):
    i = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select("doc_id", ((i % 17) / 17.0).alias("coverage"), (i % 5 != 0).alias("safe"), (i % 11).cast("double").alias("density"), (i % 3).alias("forbidden"), (F.col("n_chars") / 10.0).alias("latency"), F.col("n_chars").alias("tokens"))
    return evaluation.tradeoff(rows, {"coverage": 0.4, "safe": 0.2, "density": 0.2, "forbidden": 0.1, "latency": 0.05, "tokens": 0.05}).select("doc_id", "score")


@Q("SELECT event_type, round(list_extract(list_sort(list(value)), (round_even((count(*) - 1) * 0.5, 0) + 1)::BIGINT), 6) AS p50, round(list_extract(list_sort(list(value)), (round_even((count(*) - 1) * 0.95, 0) + 1)::BIGINT), 6) AS p95 FROM events GROUP BY event_type")
def percentile_nearest_rank(spark, sf_dir):
    found = ranking.nearest_ranks(table(spark, sf_dir, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95})
    return found.select("event_type", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


CHANGES = "c AS (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events)"


@Q(f"WITH {CHANGES} SELECT event_id, previous, event_type FROM c WHERE previous <> event_type")
def state_changes(spark, sf_dir):
    return E.state_changes(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type").select("event_id", "previous", "event_type")


LEGAL = {"signup": ("view",), "view": ("click", "error"), "click": ("purchase", "view", "error"), "error": ("view",), "purchase": ()}


@Q(f"WITH {CHANGES} SELECT previous, event_type, count(*) AS n FROM c WHERE previous <> event_type AND previous || '>' || event_type NOT IN ('signup>view', 'view>click', 'view>error', 'click>purchase', 'click>view', 'click>error', 'error>view') GROUP BY ALL")
def illegal_transitions(spark, sf_dir):
    changes = E.state_changes(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")
    return E.illegal(changes, "event_type", LEGAL).groupBy("previous", "event_type").agg(F.count("*").alias("n"))


@Q("WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n FROM s GROUP BY user_id, k")
def debounce_sessions(spark, sf_dir):
    return E.sessions(table(spark, sf_dir, "events"), "ts", "6 hours", ["user_id"])


@Q("SELECT event_type, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS window_start, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS average FROM events GROUP BY ALL")
def tumbling(spark, sf_dir):
    return E.tumbling(table(spark, sf_dir, "events"), "ts", "1 day", ["event_type"], "value")


@Q("SELECT event_type, w AS window_start, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS average FROM (SELECT event_type, value, time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 12 HOUR * o AS w FROM events, (VALUES (0), (1)) v(o)) GROUP BY ALL")
def sliding(spark, sf_dir):
    return E.tumbling(table(spark, sf_dir, "events"), "ts", "1 day", ["event_type"], "value", slide="12 hours")


@Q("SELECT event_id, json_extract_string(props, '$.k')::INTEGER AS k FROM events")
def props_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", X.json_scalar(F.col("props"), "$.k", "int").alias("k"))


@Q("SELECT user_id, event_type, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS total FROM events GROUP BY ALL")
def metrics_map(spark, sf_dir):
    counters = F.create_map("event_type", F.get_json_object("props", "$.k").cast("long"))
    return reports.summed_maps(table(spark, sf_dir, "events"), "user_id", counters).withColumnRenamed("key", "event_type")


@Q("SELECT event_type, count(*) AS row_count, round(avg(value), 6) AS mean_value, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS k, count(*) FILTER (value > 50) AS slow, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY event_type")
def run_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("k", X.json_scalar(F.col("props"), "$.k", "long"))
    return reports.run_metrics(rows, ["event_type"], ["value"], ["k"], {"slow": F.col("value") > 50, "failed": F.col("event_type") == "error"})


@Q("SELECT event_id, CASE WHEN event_id % 7 IN (4, 5) THEN -1 ELSE json_extract_string(props, '$.k')::INTEGER END AS k FROM events")
def tolerant_json(spark, sf_dir):
    """Objects within fences and known phrases; other text around one, or a cut one, leaves none."""
    p, i = F.col("props"), F.col("event_id") % 7
    fenced = F.concat(F.lit("```json\n"), p, F.lit("\n```"))
    wrapped = F.when(i == 0, p).when(i == 1, fenced).when(i == 2, F.concat(F.lit("Here is the JSON: "), p)).when(i == 3, F.concat(p, F.lit("\n End of response."))).when(i == 4, F.concat(F.lit("I think it is "), p)).when(i == 5, F.substring(p, F.lit(1), F.length(p) - 1)).otherwise(F.concat(F.lit("  ```\n"), p, F.lit("```")))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(X.json_scalar(X.embedded_json(wrapped), "$.k", "int"), F.lit(-1)).alias("k"))


@Q()
def html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", files.html_to_text("html").alias("text")).select("page_id", F.length("text").alias("chars"), F.md5("text").alias("text_md5"))


@Q(r"SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path, nullif(regexp_extract(url, '\?([^#]*)', 1), '') AS query, len(list_filter(string_split(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/'), lambda x: x <> ''))::INTEGER AS depth FROM pages")
def url_parts(spark, sf_dir):
    path = F.regexp_extract("url", r"^https?://[^/?#]+([^?#]*)", 1)
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"), path.alias("path"), F.nullif(F.regexp_extract("url", r"\?([^#]*)", 1), F.lit("")).alias("query"), F.size(F.filter(F.split(path, "/"), lambda x: x != "")).alias("depth"))


@Q("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN regexp_replace(url, '[?#].*$', '') || '.pdf#page=' || (page_id % 9) END AS link FROM pages")
def link_fragment(spark, sf_dir):
    url = F.regexp_replace("url", r"[?#].*$", "")
    url = F.when(F.col("page_id") % 2 == 0, F.concat(url, F.lit(".pdf"))).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", X.citation_link(url, F.col("page_id") % 9).alias("link"))


@Q("WITH h AS (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(source || ':' || doc_id)) AS h FROM documents) SELECT doc_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || ['8', '9', 'a', 'b'][(strpos('0123456789abcdef', h[17]) - 1) % 4 + 1] || h[18:20] || '-' || h[21:32] AS point_id FROM h")
def uuid5_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.uuid5(F.concat_ws(":", "source", F.col("doc_id").cast("string"))).alias("point_id"))


#: What stands before and after a document's number in the name of its file, what is done with it, and why it is left out.
NAMED = (("report", ".PDF", "process", None), ("a/b/notes", ".md", "process", None), ("scan", ".tiff", "ocr_then_process", None), ("~$draft", ".docx", "process", "temporary_office_file"), (".hidden", ".txt", "process", "hidden_file"), ("archive", ".tar.gz", "skip_with_warning", "unsupported_format"), ("main", ".py", "skip_with_warning", "unsupported_format"), ("README", "", "reject", "unsupported_format"), ("odd", ".xyz", "reject", "unsupported_format"), ("empty", ".csv", "process", "empty_file"), ("locked", ".json", "process", "unreadable_file"), ("main", ".TSX", "skip_with_warning", "unsupported_format"))


def _files(spark, sf_dir):
    """A file for each document, in a folder for each source."""
    i = (F.col("doc_id") % len(NAMED)).cast("int")
    part = lambda k: F.element_at(F.array(*[F.lit(n[k]) for n in NAMED]), i + 1)
    name = F.concat(F.col("source"), F.lit("/"), part(0), F.col("doc_id"), part(1))
    return ingest.with_format(table(spark, sf_dir, "documents").select(name.alias("name"), F.when(i == 9, 0).otherwise(F.col("n_chars")).alias("size"), (i != 10).alias("readable")), "name")


_ROWS = ", ".join("({}, '{}', '{}', '{}', {})".format(k, *n[:3], "NULL" if n[3] is None else f"'{n[3]}'") for k, n in enumerate(NAMED))
NAMES = f"(SELECT source || '/' || a || doc_id || b AS name, action, CASE WHEN n_chars = 0 AND k NOT IN (3, 4) THEN 'empty_file' ELSE reason END AS reason FROM documents JOIN (VALUES {_ROWS}) v(k, a, b, action, reason) ON doc_id % {len(NAMED)} = k)"


@Q(f"SELECT name, action FROM {NAMES}")
def ingest_action(spark, sf_dir):
    return _files(spark, sf_dir).select("name", ingest.action(F.col("support")).alias("action"))


@Q(f"SELECT name, reason FROM {NAMES}")
def skip_reason(spark, sf_dir):
    act = ingest.action(F.col("support"))
    return _files(spark, sf_dir).select("name", ingest.skip_reason(F.col("name"), F.col("size"), F.col("readable"), act).alias("reason"))


@Q(f"SELECT action, count(*) AS n, array_to_string(list_sort(list(name))[1:5], ',') AS samples FROM {NAMES} GROUP BY action")
def format_readiness(spark, sf_dir):
    rows = _files(spark, sf_dir).withColumn("action", ingest.action(F.col("support")))
    return ingest.readiness(rows, "action", "name").withColumn("samples", F.array_join("samples", ","))


@Q(r"SELECT conv_id, turn, b.k::INTEGER AS block, CASE WHEN b.k = 0 THEN 'Title ' || turn ELSE left(regexp_replace(trim(split_part(b.x, chr(10), 1), ' ' || chr(9) || chr(13)), '^#{1,6}\s+', ''), 160) END AS section, md5(b.x) AS block_md5 FROM (SELECT conv_id, turn, list_filter(list_transform(string_split(regexp_replace('# Title ' || turn || chr(10) || chr(10) || text, '\n\s*\n', chr(1), 'g'), chr(1)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '') AS s FROM conversations) t, LATERAL (SELECT unnest(range(0, len(s))) AS k, unnest(s) AS x) b")
def html_block_split(spark, sf_dir):
    text = F.concat(F.lit("# Title "), F.col("turn").cast("string"), F.lit("\n\n"), "text")
    blocks = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.inline(X.markdown_blocks(text, F.lit("untitled"))))
    return blocks.select("conv_id", "turn", "block", "section", F.md5("text").alias("block_md5"))


@Q(r"SELECT conv_id, turn, trim(regexp_replace('Title bold ' || text || ' link', '\s+', ' ', 'g')) AS plain FROM conversations")
def markdown_plain(spark, sf_dir):
    text = F.concat(F.lit("## Title **bold** "), "text", F.lit(" [link](http://x.y/z)"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.plain_markdown(text).alias("plain"))


@Q("SELECT doc_id, CASE WHEN length(c) <= 50 THEN c ELSE rtrim(left(c, 47)) || '...' END AS preview FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS c FROM documents)")
def previews(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.preview(F.col("text"), 50).alias("preview"))


@Q("SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 6 = 0 THEN 'chunk_id' END, CASE WHEN doc_id % 4 = 0 THEN 'relative_path' END) AS missing, concat_ws(',', CASE WHEN doc_id % 5 = 0 THEN 'document_id' END, CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN 'owner_user_id' END) AS invalid FROM documents")
def chunk_payload_contract(spark, sf_dir):
    i = F.col("doc_id")
    uuid = X.uuid5(i.cast("string"))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", F.when(i % 5 == 0, "bad").otherwise(uuid).alias("document_id"), uuid.alias("document_version_id"), F.lit("r").alias("repository_id"), F.when(i % 3 == 0, "personal").otherwise("enterprise").alias("storage_scope"), F.lit("private").alias("visibility"), F.lit("o").alias("organization_id"),
        F.when(i % 2 != 0, "u").alias("owner_user_id"), F.lit(None).cast("string").alias("department_id"), F.when(i % 4 != 0, "p").alias("relative_path"), F.lit("f").alias("file_name"), F.when(i % 6 != 0, "c").alias("chunk_id"), i.alias("chunk_index"),
    )
    return ingest.payload_contract(rows).select("doc_id", F.array_join("missing", ",").alias("missing"), F.array_join("invalid", ",").alias("invalid"))


@Q("WITH r AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source END AS meta_source, lang AS source, CASE doc_id % 4 WHEN 0 THEN (doc_id % 10 - 1)::VARCHAR WHEN 1 THEN 'iv' WHEN 2 THEN NULL ELSE '' END AS page, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id % 7 END AS page_index FROM documents) SELECT doc_id, coalesce(meta_source, source) AS source, CASE WHEN try_cast(page AS INTEGER) > 0 THEN page WHEN page IS NOT NULL AND trim(page) <> '' AND try_cast(page AS INTEGER) IS NULL THEN page ELSE (page_index + 1)::VARCHAR END AS page FROM r")
def normalize_results(spark, sf_dir):
    i = F.col("doc_id")
    page = F.when(i % 4 == 0, (i % 10 - 1).cast("string")).when(i % 4 == 1, "iv").when(i % 4 == 3, "")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(i % 2 == 0, F.col("source")).alias("metadata_source"), F.col("lang").alias("source"), page.alias("page"), F.when(i % 3 != 0, i % 7).alias("page_index"))
    return search.normalized(rows, ["metadata_source", "source"]).select("doc_id", "source", "page")


@Q("SELECT event_id, coalesce(try_cast(CASE WHEN event_id % 4 = 0 THEN 'n/a' ELSE value::VARCHAR END AS DOUBLE), 0) AS v FROM events")
def safe_numeric(spark, sf_dir):
    text = F.when(F.col("event_id") % 4 == 0, "n/a").otherwise(F.col("value").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", X.safe_number(text).alias("v"))


@Q("SELECT event_id, CASE WHEN value - 20 BETWEEN 0 AND 60 THEN round(value - 20, 6) END AS seconds FROM events")
def clean_durations(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(X.clean_duration(F.col("value") - 20, 60.0), 6).alias("seconds"))


@Q("SELECT 'absent' AS scope, count(*) AS n FROM documents UNION ALL SELECT 'empty', 0::BIGINT UNION ALL SELECT 'some', count(*) FROM documents WHERE source = 'src1'")
def scope_empty_vs_absent(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")

    def scoped(name, paths):
        rows = filters.scoped(docs, None if paths is None else spark.createDataFrame([(p,) for p in paths], "source string"), "source")
        return rows.agg(F.lit(name).alias("scope"), F.count("*").alias("n"))

    return scoped("absent", None).union(scoped("empty", [])).union(scoped("some", ["src1"]))


@Q("SELECT item_id, CASE WHEN contains(q, 'procedure') OR contains(q, 'step') OR contains(q, 'responsib') OR contains(q, 'deadline') OR contains(q, 'must') OR contains(q, 'how') THEN 'operational' WHEN contains(q, 'compare') OR contains(q, 'difference') OR contains(q, 'versus') OR contains(q, ' vs ') THEN 'comparative' WHEN contains(q, 'when') OR contains(q, 'date') OR contains(q, 'frequency') OR contains(q, 'how often') THEN 'temporal' WHEN contains(q, 'what is') OR contains(q, 'define') OR contains(q, 'meaning') THEN 'definition' ELSE 'general' END AS category FROM (SELECT item_id, lower(CASE item_id % 5 WHEN 0 THEN 'What is ' WHEN 1 THEN 'When ' WHEN 2 THEN 'Compare ' WHEN 3 THEN 'How ' ELSE '' END || text) AS q FROM benchmark)")
def category_inference(spark, sf_dir):
    i = F.col("item_id") % 5
    q = F.concat(F.when(i == 0, "What is ").when(i == 1, "When ").when(i == 2, "Compare ").when(i == 3, "How ").otherwise(""), F.col("text"))
    return table(spark, sf_dir, "benchmark").select("item_id", X.category(q).alias("category"))


@Q(f"SELECT doc_id, array_to_string(list_sort(list_distinct(list_intersect({TOK.format('text')}, ['the', 'on', 'reat', 'hable']))), ',') AS terms FROM documents")
def matched_terms(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(X.matched_terms(F.array(*[F.lit(t) for t in ("the", "on", "reat", "hable")]), F.col("text")), ",").alias("terms"))


@Q("SELECT conv_id, string_agg(role, ',' ORDER BY first) AS roles FROM (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY ALL) GROUP BY conv_id")
def ordered_union(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("r"))
    first = F.slice("r", 1, 2)
    return rows.select("conv_id", F.array_join(X.ordered_union(*[F.transform(part, lambda x: x["role"]) for part in (first, F.col("r"), F.lit(None).cast("array<struct<turn:bigint,role:string>>"))]), ",").alias("roles"))


@Q("SELECT user_id, event_type, min(event_id) AS best_rank, round(max(value), 6) AS best_score FROM events GROUP BY ALL")
def rank_map_merge(spark, sf_dir):
    """Maps of ranks and scores by retriever, merged: least rank, largest score."""
    maps = table(spark, sf_dir, "events").select("user_id", F.create_map("event_type", "event_id").alias("ranks"), F.create_map("event_type", "value").alias("scores"))
    merged = fusion.merged_maps(maps, ["user_id"], "ranks", "scores").select("user_id", F.explode("ranks").alias("event_type", "best_rank"), "scores")
    return merged.select("user_id", "event_type", "best_rank", F.round(F.element_at("scores", F.col("event_type")), 6).alias("best_score"))


@Q("WITH c AS (SELECT conv_id, list(text ORDER BY turn) AS t FROM conversations GROUP BY conv_id) SELECT conv_id, md5(array_to_string(list_transform(t[1:3], lambda x, i: i || '. ' || left(x, 500)), chr(10) || chr(10))) AS excerpt_md5 FROM c")
def extractive_excerpt(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").filter("turn >= 0").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("m"))
    return rows.select("conv_id", F.md5(citations.excerpt(F.transform("m", lambda x: x["text"]))).alias("excerpt_md5"))


@Q()
def summarize_levels(spark, sf_dir):
    from harrier.operators.summaries import summarize

    return summarize(table(spark, sf_dir, "documents"), "lang", "doc_id", "n_chars", 20_000)


@Q("SELECT user_id FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 2 GROUP BY user_id HAVING count(*) = 2 AND count(DISTINCT event_type) = 1")
def stable_file_state(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    return E.stable(rows, "user_id", "at", ["event_type"])


def _stream(spark, sf_dir):
    """The events as a stream that takes what is there."""
    kind = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(kind).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parque[t]")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@Q("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(max(value), 6) AS largest FROM events GROUP BY event_type")
def event_metrics_stream(spark, sf_dir):
    root = _folder(spark, "event-metrics")
    store = files.Generations(spark, f"{root}/table")
    E.write_progress(E.metrics(_stream(spark, sf_dir), "event_type", "value"), store, f"{root}/checkpoint").awaitTermination()
    return store.read().withColumn("largest", F.round("largest", 6))


@Q("SELECT event_id, event_type, round(value, 6) AS value FROM events")
def event_trace_stream(spark, sf_dir):
    root = _folder(spark, "event-trace")
    E.write_trace(_stream(spark, sf_dir), f"{root}/lines", f"{root}/checkpoint").awaitTermination()
    rows = spark.read.schema("event_id long, event_type string, value double").json(f"{root}/lines")
    return rows.withColumn("value", F.round("value", 6))


@Q("SELECT user_id, previous, event_type, count(*) AS n FROM (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS previous FROM events) WHERE previous <> event_type GROUP BY ALL")
def state_change_stream(spark, sf_dir):
    root = _folder(spark, "state-changes")
    changes = E.state_changes_stream(_stream(spark, sf_dir), "user_id", "ts", "event_type")
    changes.writeStream.format("parquet").option("path", f"{root}/rows").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(changes.schema).parquet(f"{root}/rows").groupBy("user_id", "previous", "event_type").agg(F.count("*").alias("n"))


SWEPT = "e AS (SELECT item_id, k, CASE WHEN (item_id * k) % 7 = 0 THEN NULL ELSE k || ':' || text END AS answer FROM benchmark, (SELECT unnest([1, 2, 5]) AS k))"


@Q(f"WITH {SWEPT} SELECT 'experiment_00' || CASE k WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS experiment_id, count(*) AS questions, count(*) FILTER (answer IS NULL) AS failed, coalesce(sum(length(answer)), 0)::BIGINT AS chars FROM e GROUP BY k")
def sweep_failures(spark, sf_dir):
    """Every experiment asks all questions; those that fail are kept with their error, and a hook adds a column."""

    def factory(setting):
        k = setting["k"]

        def answer(row):
            if row["item_id"] * k % 7 == 0:
                raise RuntimeError("no answer")
            return f"{k}:{row['text']}"

        return lambda questions: evaluation.answered(questions, answer)

    asked = table(spark, sf_dir, "benchmark").select("item_id", "text")
    rows = evaluation.sweep(relations.grid(spark, {"k": [1, 2, 5]}), asked, factory, [lambda rows: rows.withColumn("chars", F.length("answer"))])
    return rows.groupBy("experiment_id").agg(F.count("*").alias("questions"), F.count_if(F.col("error") == "RuntimeError: no answer").alias("failed"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"))


def _loaded(spark, sf_dir):
    """A file for each document, in a folder of its source and language: plain text with a byte order mark, CSV, JSON, Markdown in Latin-1 where that holds it, HTML."""
    text, i = F.coalesce("text", F.lit("")), F.col("doc_id")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("txt", "csv", "json", "md", "html")]), (i % 5).cast("int") + 1)
    held = {
        "txt": F.encode(F.concat(F.lit("﻿"), text), "UTF-8"),
        "csv": F.encode(F.concat(F.lit("id, text\n\n"), i, F.lit(',"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"\n')), "UTF-8"),
        "json": F.encode(F.to_json(F.struct("doc_id", text.alias("text"))), "UTF-8"),
        "md": F.when(F.regexp_like(text, F.lit("^[\\x00-\\x7F]*$")), F.encode(F.concat(text, F.lit("é")), "ISO-8859-1")).otherwise(F.encode(text, "UTF-8")),
        "html": F.encode(F.concat(F.lit("<p>Document "), i, F.lit("</p><div> of  "), F.coalesce("source", F.lit("none")), F.lit("</div>")), "UTF-8"),
    }
    content = F.lit(None).cast("binary")
    for name, made in held.items():
        content = F.when(kind == name, made).otherwise(content)
    path = F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.coalesce("lang", F.lit("none")), F.lit("/"), i, F.lit("."), kind)
    return files.documents(files.described(table(spark, sf_dir, "documents").select(path.alias("relative_path"), content.alias("content"))))


@Q(r"""WITH d AS (SELECT doc_id, coalesce(source, 'none') AS s, coalesce(lang, 'none') AS l, coalesce(text, '') AS t FROM documents),
c AS (SELECT *, regexp_replace(t, '[\r\n\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]', '', 'g') AS joined FROM d),
m AS (SELECT doc_id, s, l, ['txt', 'csv', 'json', 'md', 'html'][doc_id % 5 + 1] AS ext, CASE doc_id % 5 WHEN 0 THEN t
  WHEN 1 THEN CASE WHEN length(joined) > 131072 THEN 'id, text' || chr(10) || chr(10) || doc_id || ',"' || replace(t, '"', '""') || '"' ELSE 'id | text' || chr(10) || chr(10) || doc_id || ' | ' || trim(joined, ' ' || chr(9)) END
  WHEN 2 THEN '{' || chr(10) || '  "doc_id": ' || doc_id || ',' || chr(10) || '  "text": ' || to_json(t)::VARCHAR || chr(10) || '}'
  WHEN 3 THEN CASE WHEN regexp_full_match(t, '[\x00-\x7f]*', 's') THEN t || 'é' ELSE t END
  ELSE 'Document ' || doc_id || chr(10) || 'of ' || s END AS x FROM c)
SELECT s || '/' || l || '/' || doc_id || '.' || ext AS relative_path, CASE WHEN ext IN ('txt', 'md') THEN 'text' ELSE ext END AS loader, s AS category, l AS collection, md5(trim(x, ' ' || chr(9) || chr(10) || chr(13))) AS text_md5
FROM m WHERE trim(x, ' ' || chr(9) || chr(10) || chr(13)) <> ''""")
def load_documents(spark, sf_dir):
    """Files of five formats as documents, with the category and collection that their folders name."""
    return _loaded(spark, sf_dir).select("relative_path", "loader", "category", "collection", F.md5("text").alias("text_md5"))


#: Lines of documents as questions; every ninth document is numbered, so that some lines hold two numbers.
ASKED_LINES = r"""lines AS (SELECT doc_id, source, unnest(l) AS x, unnest(range(1, len(l) + 1)) AS line FROM (SELECT doc_id, source, regexp_split_to_array(CASE doc_id % 9 WHEN 0 THEN '1. what is 2) ' || coalesce(text, '') WHEN 1 THEN '# ' || coalesce(text, '') ELSE coalesce(text, '') END, '\r\n|[\n\r]') AS l FROM documents)),
q AS (SELECT doc_id, source, line, regexp_replace(x, '^\s+|\s+$', '', 'g') AS question FROM lines),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS n, lower(question) AS low, trim(regexp_replace(lower(question), '\s+', ' ', 'g')) AS normalized,
  concat_ws(', ', CASE WHEN length(question) < 8 THEN 'extremely short' END, CASE WHEN length(question) > 1000 THEN 'very long' END, CASE WHEN len(regexp_extract_all(question, '(?:^|\s)\d+[.)]\s')) > 1 THEN 'may contain multiple numbered questions' END) AS warnings
  FROM q WHERE question <> '' AND question NOT LIKE '#%')"""


def _asked(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    text = F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("1. what is 2) "), text)).when(F.col("doc_id") % 9 == 1, F.concat(F.lit("# "), text)).otherwise(text)
    return files.question_records(table(spark, sf_dir, "documents").select("doc_id", "source", text.alias("text")), ["doc_id", "source"], "text")


@Q(rf"""WITH {ASKED_LINES} SELECT doc_id, printf('Q%04d', n) AS prompt_id, line::INTEGER AS line, CASE WHEN regexp_matches(low, 'procedure|step|responsib|deadline|must|how') THEN 'operational' WHEN regexp_matches(low, 'compare|difference|versus| vs ') THEN 'comparative'
  WHEN regexp_matches(low, 'when|date|frequency') THEN 'temporal' WHEN regexp_matches(low, 'what is|define|meaning') THEN 'definition' ELSE 'general' END AS category, md5(normalized) AS normalized_md5, warnings FROM r""")
def question_records(spark, sf_dir):
    """The questions of every document, one a line: numbers, categories and warnings."""
    return _asked(spark, sf_dir).select("doc_id", "prompt_id", "line", "category", F.md5("normalized").alias("normalized_md5"), F.array_join("warnings", ", ").alias("warnings"))


@Q(rf"WITH {ASKED_LINES} SELECT source, count(*) AS count, count(*) - count(DISTINCT question) AS exact_duplicates, count(*) - count(DISTINCT normalized) AS normalized_duplicates, sum(CASE WHEN warnings = '' THEN 0 ELSE len(string_split(warnings, ', ')) END)::BIGINT AS warnings FROM r GROUP BY source")
def question_stats(spark, sf_dir):
    return files.question_stats(_asked(spark, sf_dir), ["source"])
