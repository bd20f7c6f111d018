"""Records over the driver's tables: filters, pages, links, versions, queues, runs and reports, each by its operator.

Where the reference's own records have no counterpart among the tables, a table stands in for them: events are jobs
and attempts, orders are notes and grants, line items are chunks and links, documents are uploads and answers.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from harrier.functions import text as X
from harrier.operators import access, evidence, filters, ingest, jobs, ranking, relations, reports
from harrier.plans.registry import Registry
from harrier.sources import files
from harrier.sources.tables import table

Q = Registry()

#: Events as jobs. The state, attempts and priority of a job follow from its numbers.
JOBS = """jobs AS (SELECT event_id AS job_id, user_id AS worker, event_type AS operation, user_id % 40 AS document, CASE WHEN event_id % 3 = 0 THEN user_id % 25 END AS version,
  CASE event_id % 7 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'retry_wait' WHEN 3 THEN 'failed' ELSE 'succeeded' END AS state,
  (event_id % 6 + 1)::INTEGER AS attempts, (CASE event_type WHEN 'error' THEN 120 WHEN 'purchase' THEN 80 ELSE 60 END)::INTEGER AS priority,
  ts AS created_at, ts + INTERVAL 90 SECOND AS finished_at, ts + INTERVAL 5 MINUTE AS lease_expires, value AS seconds FROM events)"""
NOW = "2024-01-20 00:00:00"
NOTES = "notes AS (SELECT o_orderkey AS note_id, o_orderdate AS updated, o_orderkey % 13 = 0 AS trashed, o_orderstatus = 'F' AS archived, o_orderpriority = '1-URGENT' AS pinned, o_orderkey % 4 AS revision, o_custkey AS owner FROM orders)"


def _jobs(spark, sf_dir):
    i, kind, ts = F.col("event_id"), F.col("event_type"), F.col("ts").cast("timestamp")
    state = F.element_at(F.array(*[F.lit(s) for s in ("queued", "running", "retry_wait", "failed", "succeeded", "succeeded", "succeeded")]), (i % 7 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(
        i.alias("job_id"), F.col("user_id").alias("worker"), kind.alias("operation"), (F.col("user_id") % 40).alias("document"), F.when(i % 3 == 0, F.col("user_id") % 25).alias("version"), state.alias("state"), (i % 6 + 1).cast("int").alias("attempts"),
        F.when(kind == "error", 120).when(kind == "purchase", 80).otherwise(60).alias("priority"), ts.alias("created_at"), (ts + F.expr("INTERVAL 90 SECONDS")).alias("finished_at"), (ts + F.expr("INTERVAL 5 MINUTES")).alias("lease_expires"), F.col("value").alias("seconds"),
    )


def _notes(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("note_id"), F.col("o_orderdate").cast("timestamp").alias("updated"), (F.col("o_orderkey") % 13 == 0).alias("trashed"), (F.col("o_orderstatus") == "F").alias("archived"), (F.col("o_orderpriority") == "1-URGENT").alias("pinned"), (F.col("o_orderkey") % 4).alias("revision"), F.col("o_custkey").alias("owner"))


def _now():
    return F.lit(NOW).cast("timestamp")


# ---------------------------------------------------------------- filters and pages


@Q("SELECT o_orderkey FROM orders WHERE NOT (o_orderkey % 7 = 0) AND (CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'deleted' ELSE 'active' END IS DISTINCT FROM 'deleted') AND (CASE WHEN o_orderpriority = '5-LOW' THEN 'deleted' WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE 'indexed' END IS DISTINCT FROM 'deleted')")
def live_rows(spark, sf_dir):
    k, priority = F.col("o_orderkey"), F.col("o_orderpriority")
    deleted = F.when(k % 7 == 0, F.col("o_orderdate"))
    lifecycle = F.when(k % 5 == 0, F.lit(None)).when(F.col("o_orderstatus") == "F", "deleted").otherwise("active")
    indexing = F.when(priority == "5-LOW", "deleted").when(priority == "1-URGENT", F.lit(None)).otherwise("indexed")
    return table(spark, sf_dir, "orders").filter(access.live(deleted, lifecycle, indexing)).select("o_orderkey")


@Q("SELECT o_custkey, count(*) AS grants FROM orders WHERE o_orderkey % 4 = 0 OR o_orderdate > TIMESTAMP '1996-06-01 00:00:00' GROUP BY o_custkey")
def unexpired_grants(spark, sf_dir):
    expires = F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderdate"))
    rows = table(spark, sf_dir, "orders").filter(access.unexpired(expires, F.lit("1996-06-01").cast("timestamp_ntz")))
    return rows.groupBy("o_custkey").agg(F.count("*").alias("grants"))


@Q("WITH p AS (SELECT doc_id, trim(replace(chr(92) || source || chr(92) || lang || CASE WHEN doc_id % 2 = 0 THEN '/' ELSE '/x' END, chr(92), '/'), '/') AS path FROM documents) SELECT doc_id, path FROM p WHERE path = 'src1/en' OR starts_with(path, 'src1/en/') OR path = 'src2' OR starts_with(path, 'src2/')")
def scope_prefix(spark, sf_dir):
    raw = F.concat(F.lit("\\"), "source", F.lit("\\"), "lang", F.when(F.col("doc_id") % 2 == 0, "/").otherwise("/x"))
    rows = table(spark, sf_dir, "documents").select("doc_id", X.normal_path(raw).alias("path"))
    return rows.filter(filters.in_folders(F.col("path"), ["src1\\en", "src2/"]))


@Q("SELECT doc_id FROM documents WHERE source IN ('src1', 'src2', 'src3') AND lower(lang) IN ('en', 'de') AND n_chars > 500")
def search_filters(spark, sf_dir):
    size = F.col("n_chars")
    test = filters.search_filter(F.col("source"), F.lit("any"), F.upper("lang"), size, kinds=["src1", "src2", "src3"], file_types=["EN", "de"], updated_after=F.lit(500))
    return table(spark, sf_dir, "documents").filter(test).select("doc_id")


@Q("SELECT p_partkey FROM part WHERE contains(lower(coalesce(p_name, '')), 'red') OR contains(lower(coalesce(p_type, '')), 'red') OR contains(lower(coalesce(p_name, '')), 'steel') OR contains(lower(coalesce(p_type, '')), 'steel') ORDER BY p_partkey LIMIT 80")
def like_any(spark, sf_dir):
    test = filters.any_token("RED steel", F.col("p_name"), F.col("p_type"))
    return filters.offset_page(table(spark, sf_dir, "part").filter(test).select("p_partkey"), [F.col("p_partkey")], 80)


@Q("SELECT p_partkey FROM part WHERE p_name ILIKE '%AL%' OR p_type ILIKE '%AL%'")
def ilike_two_columns(spark, sf_dir):
    return table(spark, sf_dir, "part").filter(filters.holds("aL", F.col("p_name"), F.col("p_type"))).select("p_partkey")


@Q(r"SELECT doc_id FROM documents WHERE list_has_all(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+(?:[-''][\p{L}\p{M}\p{N}_]+)*'), ['the', 'on', 'hable'])")
def ft_all_terms(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(filters.all_terms("The on HABLE", F.col("text"))).select("doc_id")


SHELVES = ("all", "pinned", "recent", "archived", "trash")


@Q(f"WITH {NOTES}, s AS (SELECT unnest(list_filter([CASE WHEN NOT trashed AND NOT archived THEN 'all' END, CASE WHEN NOT trashed AND NOT archived AND pinned THEN 'pinned' END, CASE WHEN NOT trashed AND NOT archived AND updated >= TIMESTAMP '2001-07-01' - INTERVAL 30 DAY THEN 'recent' END, CASE WHEN NOT trashed AND archived THEN 'archived' END, CASE WHEN trashed THEN 'trash' END], lambda x: x IS NOT NULL)) AS shelf FROM notes) SELECT shelf, count(*) AS n FROM s GROUP BY shelf")
def note_filters(spark, sf_dir):
    c, now = F.col, F.lit("2001-07-01").cast("timestamp")
    rows = _notes(spark, sf_dir)
    made = [rows.filter(filters.shelf(name, c("trashed"), c("archived"), c("pinned"), c("updated"), now)).select(F.lit(name).alias("shelf")) for name in SHELVES]
    return relations.stacked(made).groupBy("shelf").agg(F.count("*").alias("n"))


@Q(f"WITH {NOTES} SELECT note_id, updated FROM notes WHERE updated < TIMESTAMP '1997-01-01 00:00:00' OR (updated = TIMESTAMP '1997-01-01 00:00:00' AND note_id < 5000) ORDER BY updated DESC, note_id DESC LIMIT 21")
def keyset_page(spark, sf_dir):
    return filters.keyset_page(_notes(spark, sf_dir).select("note_id", "updated"), "updated", "note_id", 20, ("1997-01-01", 5000))


@Q("SELECT p_partkey, p_name FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20 OFFSET 40")
def offset_page(spark, sf_dir):
    return filters.offset_page(table(spark, sf_dir, "part"), ranking.best_first("p_retailprice", "p_partkey"), 20, 40).select("p_partkey", "p_name")


@Q("SELECT p_partkey, lower(p_name) AS name FROM part ORDER BY lower(p_name), p_partkey LIMIT 50")
def name_sort(spark, sf_dir):
    return filters.offset_page(table(spark, sf_dir, "part"), ranking.by_name("p_name", "p_partkey"), 50).select("p_partkey", F.lower("p_name").alias("name"))


@Q("SELECT event_id, v FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS v FROM events) t ORDER BY v DESC NULLS LAST, event_id LIMIT 150")
def nulls_last(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("v"))
    return filters.offset_page(rows, ranking.best_first("v", "event_id"), 150)


@Q("SELECT event_id, value FROM events ORDER BY value DESC NULLS LAST, event_id LIMIT 10")
def slowest_n(spark, sf_dir):
    return filters.offset_page(table(spark, sf_dir, "events").select("event_id", "value"), ranking.best_first("value", "event_id"), 10)


@Q(f"WITH {JOBS} SELECT job_id FROM jobs WHERE state = 'queued' ORDER BY priority DESC, lease_expires, created_at, job_id LIMIT 25")
def priority_order(spark, sf_dir):
    waiting = _jobs(spark, sf_dir).filter("state = 'queued'")
    return filters.offset_page(waiting, ranking.queue_order("priority", "lease_expires", "created_at", "job_id"), 25).select("job_id")


@Q("SELECT event_id, NULL::VARCHAR AS chunk_id, event_type AS stage, NULL::DOUBLE AS score, value::VARCHAR AS value FROM events")
def trace_columns(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumnRenamed("event_type", "stage")
    return filters.reindexed(rows, [("event_id", "long"), ("chunk_id", "string"), ("stage", "string"), ("score", "double"), ("value", "string")])


@Q("SELECT source, least(250, greatest(100, 12 * count(DISTINCT lang)))::BIGINT AS depth FROM documents GROUP BY source UNION ALL SELECT 'all', least(250, greatest(100, 12 * count(DISTINCT source)))::BIGINT FROM documents")
def scoped_depth(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    each = docs.groupBy("source").agg(filters.candidate_depth(F.count_distinct("lang")).cast("long").alias("depth"))
    return each.unionByName(docs.agg(F.lit("all").alias("source"), filters.candidate_depth(F.count_distinct("source")).cast("long").alias("depth")))


_ASKED = ("show recent notes about ", "Latest summaries: ", "documents on ", "conversation, documents and passages of ", "")


@Q("""WITH q AS (SELECT item_id, lower(['show recent notes about ', 'Latest summaries: ', 'documents on ', 'conversation, documents and passages of ', ''][item_id % 5 + 1] || text) AS q FROM benchmark),
c AS (SELECT item_id, list_filter([CASE WHEN contains(q, 'recent') OR contains(q, 'latest') THEN 'Recently updated' END,
  CASE WHEN regexp_matches(q, '\\bdocuments\\b') THEN 'Documents' END, CASE WHEN regexp_matches(q, '\\bpassages\\b') THEN 'Passages' END, CASE WHEN regexp_matches(q, '\\bnotes\\b') THEN 'Notes' END,
  CASE WHEN regexp_matches(q, '\\bconversations\\b') THEN 'Conversations' END, CASE WHEN regexp_matches(q, '\\bsummaries\\b') THEN 'Summaries' END], lambda x: x IS NOT NULL) AS c FROM q)
SELECT item_id, len(c) > 0 AS applied, CASE WHEN len(c) > 0 THEN 'Interpreted as ' || array_to_string(c, ', ') || '.' END AS explanation FROM c""")
def query_chips(spark, sf_dir):
    lead = F.element_at(F.array(*[F.lit(a) for a in _ASKED]), (F.col("item_id") % 5 + 1).cast("int"))
    asked = table(spark, sf_dir, "benchmark").select("item_id", filters.chips(F.concat(lead, "text")).alias("c"))
    return asked.select("item_id", F.inline(F.array(filters.interpretation(F.col("c")))))


ATTEMPTS = "attempts AS (SELECT event_id % 30 * 2 AS item_id, event_id AS seq, CASE WHEN event_type IN ('click', 'purchase') AND event_id % 4 = 0 THEN 'completed' ELSE 'error' END AS status FROM events)"


def _attempts(spark, sf_dir):
    done = F.col("event_type").isin("click", "purchase") & (F.col("event_id") % 4 == 0)
    return table(spark, sf_dir, "events").select((F.col("event_id") % 30 * 2).alias("item_id"), F.col("event_id").alias("seq"), F.when(done, "completed").otherwise("error").alias("status"))


@Q(f"WITH {ATTEMPTS} SELECT item_id FROM benchmark WHERE item_id NOT IN (SELECT item_id FROM attempts WHERE status = 'completed')")
def pending_questions(spark, sf_dir):
    return filters.pending(table(spark, sf_dir, "benchmark").select("item_id"), _attempts(spark, sf_dir), "item_id", F.col("status") == "completed")


@Q("SELECT 'smoke' AS mode, item_id FROM (SELECT item_id FROM benchmark ORDER BY item_id LIMIT 3) UNION ALL SELECT 'full', item_id FROM benchmark")
def run_limit(spark, sf_dir):
    asked, limits = table(spark, sf_dir, "benchmark").select("item_id"), {"smoke": 3, "full": None}
    return relations.stacked([filters.run_limit(asked, "item_id", mode, limits).select(F.lit(mode).alias("mode"), "item_id") for mode in limits])


@Q(f"WITH {ATTEMPTS}, t AS (SELECT item_id, count(*) AS n, bool_or(status = 'completed') AS done FROM attempts GROUP BY item_id) SELECT item_id, coalesce(n, 0) AS attempts, CASE WHEN done THEN 'completed' WHEN n > 0 THEN 'failed' ELSE 'pending' END AS state FROM benchmark LEFT JOIN t USING (item_id)")
def resume_state(spark, sf_dir):
    return reports.resume_state(table(spark, sf_dir, "benchmark"), _attempts(spark, sf_dir), "item_id", F.col("status") == "completed")


@Q(f"WITH {ATTEMPTS} SELECT item_id, arg_max(status, seq) AS status, max(seq) AS seq, min(seq) AS first_seen FROM attempts GROUP BY item_id")
def latest_per_key(spark, sf_dir):
    return files.latest_per_key(_attempts(spark, sf_dir), ["item_id"], "seq").select("item_id", "status", "seq", "first_seen")


# ---------------------------------------------------------------- links


@Q(f"WITH {NOTES}, states AS (SELECT o_orderkey AS note_id, CASE WHEN o_orderkey % 3 = 0 THEN 'indexed' ELSE 'queued' END AS state, o_orderkey % 8 AS revision FROM orders) SELECT n.note_id FROM notes n JOIN states s ON s.note_id = n.note_id AND s.state = 'indexed' AND s.revision = n.revision")
def indexed_notes(spark, sf_dir):
    notes = _notes(spark, sf_dir)
    states = notes.select("note_id", F.when(F.col("note_id") % 3 == 0, "indexed").otherwise("queued").alias("state"), (F.col("note_id") % 8).alias("revision"))
    return relations.indexed_notes(notes, states).select("note_id")


@Q("SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END)::INTEGER AS seq FROM conversations WHERE conv_id % 5 = 2")
def turn_order(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    sessions = turns.select("conv_id", (F.col("conv_id") % 5).alias("user_id")).distinct()
    return relations.session_messages(turns, sessions, "conv_id", "user_id", F.lit(2)).select("conv_id", "turn", "role", "seq")


@Q("SELECT n_name, count(c_custkey) AS customers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9000 GROUP BY n_name")
def tag_counts(spark, sf_dir):
    rich = table(spark, sf_dir, "customer").filter("c_acctbal > 9000")
    return relations.child_counts(table(spark, sf_dir, "nation"), rich, "n_nationkey", "c_nationkey", "customers").select("n_name", "customers")


@Q("SELECT DISTINCT p_partkey, s_suppkey FROM part JOIN lineitem ON l_partkey = p_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE p_size < 3")
def many_to_many(spark, sf_dir):
    small = table(spark, sf_dir, "part").filter("p_size < 3").select("p_partkey")
    return relations.through(small, table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier").select("s_suppkey"), "p_partkey", "l_partkey", "l_suppkey", "s_suppkey")


@Q("SELECT c_custkey, coalesce(n_name, 'No department') AS department FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) ON n_nationkey = c_nationkey")
def name_lookup(spark, sf_dir):
    known = table(spark, sf_dir, "nation").filter("n_regionkey <> 2")
    return relations.lookup(table(spark, sf_dir, "customer"), known, "c_nationkey", "n_nationkey", "n_name", "department", "No department").select("c_custkey", "department")


@Q("SELECT n.n_name AS child, r.r_name AS parent FROM nation n LEFT JOIN region r ON n.n_regionkey = r.r_regionkey AND r.r_name <> 'ASIA'")
def parent_links(spark, sf_dir):
    roots = table(spark, sf_dir, "region").filter("r_name <> 'ASIA'")
    return relations.parent_links(table(spark, sf_dir, "nation"), roots, "n_regionkey", "r_regionkey", "r_name").select(F.col("n_name").alias("child"), "parent")


@Q("SELECT doc_id FROM documents d WHERE (EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 0) OR EXISTS (SELECT 1 FROM orders WHERE o_orderkey = d.doc_id AND d.lang = CASE WHEN o_orderstatus = 'O' THEN 'en' ELSE 'de' END)) AND source IN ('src1', 'src4')")
def publication_scope(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    versions = table(spark, sf_dir, "labels").filter("toxic = 0").select("doc_id")
    notes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderstatus") == "O", "en").otherwise("de").alias("lang"))
    paths = spark.createDataFrame([("src1",), ("src4",)], "source string")
    return relations.published(docs, [(versions, ["doc_id"]), (notes, ["doc_id", "lang"])], paths, "source", "doc_id").select("doc_id")


@Q("WITH held AS (SELECT l_partkey, l_suppkey, arg_max(l_extendedprice, l_orderkey * 10 + l_linenumber) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, v AS vector FROM lineitem LEFT JOIN held USING (l_partkey, l_suppkey) WHERE l_returnflag = 'A'")
def vector_reuse(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", F.col("l_extendedprice").alias("vector"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("created"))
    found = relations.reused_vectors(items.filter("l_returnflag = 'A'").drop("vector"), items.filter("l_returnflag = 'R'"), ["l_partkey", "l_suppkey"], "created", "vector")
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "vector")


@Q("SELECT doc_id FROM documents WHERE doc_id % 2 = 1 AND sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0 AND source IN ('src0', 'src1', 'src2', 'src3'))")
def dup_hash(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("digest"))
    mine = docs.filter("doc_id % 2 = 0 AND source IN ('src0', 'src1', 'src2', 'src3')")
    return relations.upload_duplicates(docs.filter("doc_id % 2 = 1"), mine, "digest").select("doc_id")


@Q(f"WITH {JOBS} SELECT job_id FROM (SELECT job_id, row_number() OVER (PARTITION BY CASE WHEN version IS NOT NULL THEN 'v:' || version ELSE 'd:' || document || ':' || operation END ORDER BY job_id) AS n FROM jobs WHERE state IN ('queued', 'running', 'retry_wait')) WHERE n = 1")
def active_job_dedup(spark, sf_dir):
    return relations.active_jobs(_jobs(spark, sf_dir), F.col("state").isin(*reports.ACTIVE), "version", "document", "operation", "job_id").select("job_id")


@Q("SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON lower(trim(regexp_replace(b.text, '\\s+', ' ', 'g'))) = lower(trim(regexp_replace(d.text, '\\s+', ' ', 'g'))) UNION ALL SELECT item_id, -1 FROM benchmark".replace("\\\\", "\\"))
def question_join(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark")
    again = asked.select(F.lit(-1).cast("long").alias("doc_id"), F.concat(F.lit("  "), F.translate("text", "aeiou", "AEIOU")).alias("text"))
    results = table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(again)
    return relations.joined_questions(asked, results, "text").select("item_id", "doc_id")


CITED = "c AS (SELECT event_id AS citation_id, CASE WHEN event_id % 3 = 0 THEN 'c' || event_id % 500 END AS chunk_id, event_type AS source, CASE WHEN event_id % 5 = 0 THEN NULL ELSE user_id % 40 END AS page FROM events), r AS (SELECT event_id AS record_id, 'c' || event_id AS chunk_id, event_type AS source, CASE WHEN event_id % 4 = 0 THEN NULL ELSE user_id % 50 END AS page FROM events WHERE event_id % 2 = 0)"


@Q(f"WITH {CITED}, i AS (SELECT chunk_id, min(record_id) AS by_chunk FROM r GROUP BY chunk_id), p AS (SELECT source, page, min(record_id) AS by_page FROM r GROUP BY source, page) SELECT citation_id, coalesce(by_chunk, by_page) AS matched FROM c LEFT JOIN i ON i.chunk_id = c.chunk_id LEFT JOIN p ON p.source IS NOT DISTINCT FROM c.source AND p.page IS NOT DISTINCT FROM c.page")
def citation_match(spark, sf_dir):
    i, events = F.col("event_id"), table(spark, sf_dir, "events")
    chunk = lambda x: F.concat(F.lit("c"), x.cast("string"))
    cited = events.select(i.alias("citation_id"), F.when(i % 3 == 0, chunk(i % 500)).alias("chunk_id"), F.col("event_type").alias("source"), F.when(i % 5 != 0, F.col("user_id") % 40).alias("page"))
    records = events.filter("event_id % 2 = 0").select(i.alias("record_id"), chunk(i).alias("chunk_id"), F.col("event_type").alias("source"), F.when(i % 4 != 0, F.col("user_id") % 50).alias("page"))
    return relations.matched_citations(cited, records).select("citation_id", "matched")


@Q("SELECT a.o_custkey AS custkey, a.o_orderkey AS lo, b.o_orderkey AS hi, round(b.o_totalprice - a.o_totalprice, 4) AS delta FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority AND a.o_orderkey < b.o_orderkey")
def pairwise_delta(spark, sf_dir):
    return relations.pairs(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"], "o_orderkey", "o_totalprice").select(F.col("o_custkey").alias("custkey"), "lo", "hi", "delta")


@Q("SELECT o_orderkey FROM orders a WHERE NOT EXISTS (SELECT 1 FROM orders b WHERE b.o_totalprice >= a.o_totalprice AND b.o_custkey <= a.o_custkey AND b.o_orderkey % 1000 <= a.o_orderkey % 1000 AND (b.o_totalprice > a.o_totalprice OR b.o_custkey < a.o_custkey OR b.o_orderkey % 1000 < a.o_orderkey % 1000))")
def pareto(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_custkey", (F.col("o_orderkey") % 1000).alias("cost"))
    return relations.pareto(rows, ["o_totalprice"], ["o_custkey", "cost"]).select("o_orderkey")


@Q("SELECT 'experiment_' || lpad((row_number() OVER (ORDER BY k, w, s))::VARCHAR, 3, '0') AS experiment_id, left(sha256('{\"k\":' || k || ',\"s\":\"' || s || '\",\"w\":' || w || '}'), 12) AS fingerprint, k, w, s FROM (SELECT DISTINCT quality AS k FROM labels), (SELECT DISTINCT toxic AS w FROM labels), (SELECT DISTINCT lang AS s FROM documents)")
def param_grid(spark, sf_dir):
    """A run for every quality, toxicity and language that the tables know, which are few."""
    known = lambda name, column: sorted(r[0] for r in table(spark, sf_dir, name).select(column).distinct().collect())
    return relations.grid(spark, {"k": known("labels", "quality"), "w": known("labels", "toxic"), "s": known("documents", "lang")})


@Q("SELECT c_custkey, left(sha256('{\"c_mktsegment\":\"' || c_mktsegment || '\",\"c_nationkey\":' || c_nationkey || '}'), 12) AS fingerprint FROM customer")
def config_fingerprint(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", relations.row_fingerprint(["c_nationkey", "c_mktsegment"]).alias("fingerprint"))


@Q("SELECT l_orderkey, l_linenumber, p_name, s_name FROM lineitem LEFT JOIN (SELECT p_partkey AS l_partkey, p_name, p_size FROM part WHERE p_size < 25) USING (l_partkey) LEFT JOIN (SELECT s_suppkey AS l_suppkey, s_nationkey * 2 AS p_size, s_name FROM supplier) USING (l_suppkey, p_size)")
def hydrate_metadata(spark, sf_dir):
    documents = table(spark, sf_dir, "part").filter("p_size < 25").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_size")
    versions = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), (F.col("s_nationkey") * 2).alias("p_size"), "s_name")
    return relations.hydrated(table(spark, sf_dir, "lineitem"), documents, versions, "l_partkey", "l_suppkey", "p_size").select("l_orderkey", "l_linenumber", "p_name", "s_name")


@Q("SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def intersect_keys(spark, sf_dir):
    return relations.keys_of("both", *_nations(spark, sf_dir, "c_acctbal > 9000"))


@Q("SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def except_keys(spark, sf_dir):
    return relations.keys_of("left", *_nations(spark, sf_dir, "true"))


def _nations(spark, sf_dir, where):
    return table(spark, sf_dir, "customer").filter(where).select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"))


@Q("SELECT 'customer' AS kind, c_name AS name, c_acctbal AS bal, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_name, s_acctbal, NULL FROM supplier UNION ALL SELECT 'part', p_name, NULL, NULL FROM part")
def union_all(spark, sf_dir):
    customer, supplier, part = (table(spark, sf_dir, t) for t in ("customer", "supplier", "part"))
    return relations.stacked([customer.select(F.lit("customer").alias("kind"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("segment")), supplier.select(F.lit("supplier").alias("kind"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal")), part.select(F.lit("part").alias("kind"), F.col("p_name").alias("name"))])


@Q("SELECT path, count(*) AS n FROM (SELECT source || '/' || doc_id % 50 AS path FROM documents UNION ALL SELECT source || '/' || doc_id FROM documents) GROUP BY path HAVING count(*) > 1")
def root_union_check(spark, sf_dir):
    docs, path = table(spark, sf_dir, "documents"), lambda c: F.concat_ws("/", "source", c.cast("string")).alias("path")
    return relations.repeated_paths([docs.select(path(F.col("doc_id") % 50)), docs.select(path(F.col("doc_id")))], "path")


@Q("WITH r AS (SELECT doc_id, trim(CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN '  ' WHEN 2 THEN NULL ELSE source END) AS a, lang AS b FROM documents) SELECT doc_id, coalesce(nullif(a, ''), nullif(b, ''), 'none') AS name FROM r")
def header_alias(spark, sf_dir):
    i = F.col("doc_id") % 4
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(i == 0, "").when(i == 1, "  ").when(i == 3, F.col("source")).alias("Source File"), F.col("lang").alias("source"))
    return rows.select("doc_id", ingest.first_filled(rows, ["file", "Source File", "source"], "none").alias("name"))


# ---------------------------------------------------------------- places and scales


@Q("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) t WHERE n <= 10")
def keep_last_10(spark, sf_dir):
    return ranking.keep_last(table(spark, sf_dir, "orders"), "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey")


@Q("SELECT s_suppkey, round(1.0::DOUBLE - (s_acctbal - min(s_acctbal) OVER ()) / (max(s_acctbal) OVER () - min(s_acctbal) OVER ()), 6) AS score FROM supplier")
def min_max_score(spark, sf_dir):
    return ranking.min_max(table(spark, sf_dir, "supplier"), "s_acctbal", "score", larger_is_better=False).select("s_suppkey", "score")


@Q("SELECT p_partkey, CASE WHEN p_size < 40 THEN round(p_retailprice / max(CASE WHEN p_size < 40 THEN p_retailprice END) OVER (), 6) END AS score FROM part")
def max_score(spark, sf_dir):
    return ranking.max_scaled(table(spark, sf_dir, "part"), "p_retailprice", "score", F.col("p_size") < 40).select("p_partkey", "score")


@Q("SELECT s_suppkey, row_number() OVER (ORDER BY round(s_acctbal, 0) DESC, s_nationkey, s_suppkey) AS place FROM supplier")
def overall_rank(spark, sf_dir):
    return ranking.numbered(table(spark, sf_dir, "supplier"), [F.round("s_acctbal", 0).desc(), "s_nationkey", "s_suppkey"], "place").select("s_suppkey", "place")


@Q("SELECT event_id, row_number() OVER (ORDER BY n, event_type) AS place FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events)")
def round_robin(spark, sf_dir):
    return ranking.round_robin(table(spark, sf_dir, "events"), "event_type", "event_id").select("event_id", "place")


@Q("SELECT o_orderkey AS order_id, CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1 THEN 1 ELSE 0 END AS label FROM orders")
def first_source_flags(spark, sf_dir):
    return ranking.first_of_source(table(spark, sf_dir, "orders"), "o_custkey", [F.desc("o_totalprice"), F.col("o_orderkey")], "label").select(F.col("o_orderkey").alias("order_id"), "label")


# ---------------------------------------------------------------- reports


@Q("SELECT lang AS loader, count(*) AS documents, sum(n_chars)::BIGINT AS chars, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM documents GROUP BY lang")
def doc_loader_summary(spark, sf_dir):
    found = reports.document_summary(table(spark, sf_dir, "documents"), "lang", "n_chars", "source")
    return found.select(F.col("lang").alias("loader"), "documents", "chars", F.array_join("sources", ",").alias("sources"))


@Q("WITH p AS (SELECT source, CASE WHEN doc_id % 3 = 0 THEN 'No page' ELSE (doc_id % 4)::VARCHAR END AS page FROM documents) SELECT source, page, count(*) AS chunks FROM p GROUP BY source, page ORDER BY chunks DESC, source, page LIMIT 15")
def page_distribution(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("source", F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 4).alias("page"))
    return reports.page_distribution(rows, "source", "page", 15)


@Q("SELECT coalesce(CASE WHEN event_type = 'error' THEN NULL ELSE event_type END, 'unknown') AS status, count(*) AS n FROM events GROUP BY 1")
def status_distribution(spark, sf_dir):
    return reports.status_distribution(table(spark, sf_dir, "events"), F.when(F.col("event_type") != "error", F.col("event_type")))


@Q(f"WITH {JOBS} SELECT operation, count(*) AS questions, count(*) FILTER (state = 'succeeded') AS succeeded, count(*) FILTER (state = 'failed') AS failed, round(avg(CASE WHEN job_id % 9 > 0 THEN seconds END), 6) AS mean_generation, round(avg(seconds), 6) AS mean_seconds, sum(attempts)::BIGINT AS attempts FROM jobs GROUP BY operation")
def run_summary(spark, sf_dir):
    rows = _jobs(spark, sf_dir).withColumn("generation", F.when(F.col("job_id") % 9 > 0, F.col("seconds")))
    return reports.run_summary(rows, "operation", "state", ["succeeded", "failed"], ["generation", "seconds"], ["attempts"])


@Q(f"WITH {JOBS} SELECT operation, count(*) AS n, round(sum(seconds), 4) AS seconds, count(DISTINCT worker) AS sources FROM jobs GROUP BY operation")
def chart_aggregates(spark, sf_dir):
    return reports.stage_totals(_jobs(spark, sf_dir), "operation", "seconds", "worker")


@Q("SELECT source, lang, count(*) AS n, round(avg((quality = 1)::INTEGER), 6) AS success_rate, round(avg(CASE WHEN quality = 1 THEN n_chars END), 4) AS mean_n_chars, count(*) FILTER (toxic = 0 AND n_chars > 800) AS frontier FROM documents JOIN labels USING (doc_id) GROUP BY source, lang")
def matrix_aggregate(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return reports.matrix(rows, ["source", "lang"], F.col("quality") == 1, ["n_chars"], (F.col("toxic") == 0) & (F.col("n_chars") > 800))


@Q("WITH r AS (SELECT c_nationkey, c_mktsegment, max(c_acctbal) AS tokens, min(c_custkey) AS answer FROM customer GROUP BY ALL) SELECT c_nationkey, max(answer) FILTER (c_mktsegment = 'BUILDING') AS BUILDING__answer, max(tokens) FILTER (c_mktsegment = 'BUILDING') AS BUILDING__tokens, max(answer) FILTER (c_mktsegment = 'MACHINERY') AS MACHINERY__answer, max(tokens) FILTER (c_mktsegment = 'MACHINERY') AS MACHINERY__tokens FROM r GROUP BY c_nationkey")
def wide_pivot(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.max("c_acctbal").alias("tokens"), F.min("c_custkey").alias("answer"))
    return reports.wide(rows, "c_nationkey", F.col("c_mktsegment"), ["BUILDING", "MACHINERY"], {"answer": F.col("answer"), "tokens": F.col("tokens")})


@Q("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(min(value), 6) AS lo, round(max(value), 6) AS hi FROM events GROUP BY event_type")
def latency_stats(spark, sf_dir):
    return reports.latency_stats(table(spark, sf_dir, "events"), "event_type", "value")


@Q(f"WITH {JOBS}, s AS (SELECT count(*) AS total, count(*) FILTER (state = 'succeeded') AS completed, avg(CASE WHEN state = 'succeeded' THEN seconds END) AS m, (floor(epoch(max(CASE WHEN state = 'succeeded' THEN finished_at END))) - floor(epoch(min(created_at))))::BIGINT AS elapsed FROM jobs) SELECT total, completed, round(100.0::DOUBLE * completed / total, 2) AS percent, round(m, 6) AS mean_seconds, round(m * (total - completed), 4) AS eta, elapsed, round(3600.0::DOUBLE * completed / elapsed, 4) AS per_hour FROM s")
def progress(spark, sf_dir):
    return reports.progress(_jobs(spark, sf_dir), F.col("state") == "succeeded", "seconds", "created_at", "finished_at")


@Q(f"WITH {JOBS} SELECT operation, count(*) FILTER (state = 'queued') AS queued, count(*) FILTER (state = 'running') AS running, count(*) FILTER (state = 'retry_wait') AS retry_wait, count(*) FILTER (state = 'succeeded') AS succeeded, count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (state IN ('queued', 'running', 'retry_wait')) AS active, count(DISTINCT CASE WHEN state = 'running' THEN worker END) AS workers, max(CASE WHEN state = 'succeeded' THEN finished_at END) AS last_success FROM jobs GROUP BY operation")
def job_queue_status(spark, sf_dir):
    return reports.queue_status(_jobs(spark, sf_dir))


@Q(f"WITH {JOBS} SELECT * FROM (SELECT 'active' AS list, job_id FROM jobs WHERE state IN ('queued', 'running', 'retry_wait') ORDER BY created_at, job_id LIMIT 25) UNION ALL SELECT * FROM (SELECT 'error', job_id FROM jobs WHERE state = 'failed' ORDER BY finished_at DESC, job_id DESC LIMIT 10)")
def queue_lists(spark, sf_dir):
    rows = _jobs(spark, sf_dir)
    return reports.oldest_active(rows, "created_at", "job_id").select(F.lit("active").alias("list"), "job_id").unionByName(reports.last_errors(rows, "finished_at", "job_id").select(F.lit("error").alias("list"), "job_id"))


@Q("SELECT source, coalesce(sum(CASE WHEN doc_id % 5 <> 0 THEN n_chars END), 0)::BIGINT AS used, coalesce(sum(CASE WHEN doc_id % 5 <> 0 THEN n_chars END), 0) > 100000 AS over_quota FROM documents GROUP BY source")
def storage_used(spark, sf_dir):
    return reports.storage_used(table(spark, sf_dir, "documents"), "source", "n_chars", F.col("doc_id") % 5 != 0, 100_000)


@Q("SELECT c_custkey, coalesce(max(o_orderkey), 0) + 1 AS next_version FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY c_custkey")
def next_version(spark, sf_dir):
    return reports.next_version(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'"), "c_custkey", "o_custkey", "o_orderkey")


@Q("SELECT source, sum(n)::BIGINT AS n, sum(n - 1)::BIGINT AS repeated FROM (SELECT source, text, count(*) AS n FROM documents GROUP BY ALL) GROUP BY source")
def duplicate_stats(spark, sf_dir):
    return reports.repeat_counts(table(spark, sf_dir, "documents"), "source", F.col("text"))


@Q("SELECT sha256(text) AS hash, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY ALL HAVING count(*) > 1")
def duplicate_hashes(spark, sf_dir):
    return reports.repeats(table(spark, sf_dir, "documents"), [F.sha2("text", 256).alias("hash")], "doc_id")


@Q("SELECT l_orderkey, count(*) - count(DISTINCT l_linenumber) AS duplicates, coalesce((SELECT string_agg(g, ',' ORDER BY g) FROM range(min(l_linenumber), max(l_linenumber) + 1) r(g) WHERE NOT list_contains(list(DISTINCT l_linenumber), g)), '') AS missing, count(*) FILTER (l_quantity < 3) AS empty_chunks FROM lineitem GROUP BY l_orderkey".replace("coalesce((SELECT string_agg(g, ',' ORDER BY g) FROM range(min(l_linenumber), max(l_linenumber) + 1) r(g) WHERE NOT list_contains(list(DISTINCT l_linenumber), g)), '')", "array_to_string(list_filter(range(min(l_linenumber), max(l_linenumber) + 1), lambda g: NOT list_contains(list(DISTINCT l_linenumber), g)), ',')"))
def gap_audit(spark, sf_dir):
    found = reports.gap_audit(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", F.col("l_quantity") < 3)
    return found.withColumn("missing", F.array_join("missing", ","))


OCR = "o AS (SELECT page_id, page_id % 3 AS engine, page_id % 5 <> 0 AS tried, length(html) > 600 AS good, page_id % 7 + 0.5::DOUBLE AS seconds, length(html) AS chars FROM pages)"


@Q(f"WITH {OCR} SELECT engine, count(*) AS files, count(*) FILTER (tried) AS tried, count(*) FILTER (tried AND good) AS succeeded, round(count(*) FILTER (tried AND good) / nullif(count(*) FILTER (tried), 0), 6) AS success_rate, round(avg(CASE WHEN tried THEN seconds END), 6) AS mean_seconds, coalesce(sum(CASE WHEN tried AND good THEN chars END), 0)::BIGINT AS chars FROM o GROUP BY engine")
def ocr_summary(spark, sf_dir):
    i = F.col("page_id")
    rows = table(spark, sf_dir, "pages").select((i % 3).alias("engine"), (i % 5 != 0).alias("tried"), (F.length("html") > 600).alias("good"), (i % 7 + 0.5).alias("seconds"), F.length("html").alias("chars"))
    return reports.ocr_summary(rows, "engine", F.col("tried"), F.col("good"), "seconds", "chars")


@Q("SELECT source, round(sum(least(n_chars, 1000)) / sum(n_chars)::DOUBLE, 6) AS ratio FROM documents GROUP BY source")
def compression_ratio(spark, sf_dir):
    return reports.compression(table(spark, sf_dir, "documents"), "source", F.least("n_chars", F.lit(1000)), F.col("n_chars"))


EST = "greatest(1, ceil(length(text) / 4.0))"


@Q(f"WITH d AS (SELECT lang, doc_id, {EST} AS t FROM documents) SELECT lang, sum(t)::BIGINT AS candidate, coalesce(sum(CASE WHEN doc_id % 3 = 0 THEN t END), 0)::BIGINT AS selected, coalesce(sum(CASE WHEN doc_id % 6 = 0 THEN t END), 0)::BIGINT AS final, round(greatest(0.0, 100.0 * (1.0 - coalesce(sum(CASE WHEN doc_id % 6 = 0 THEN t END), 0) / sum(t)))::DOUBLE, 2) AS reduction FROM d GROUP BY lang")
def token_efficiency(spark, sf_dir):
    tokens, i = X.token_estimate(F.col("text")).cast("long"), F.col("doc_id")
    return reports.token_efficiency(table(spark, sf_dir, "documents"), "lang", tokens, i % 3 == 0, i % 6 == 0)


@Q("WITH c AS (SELECT event_type AS answer, CASE WHEN event_id % 4 = 0 THEN NULL ELSE user_id END AS page, CASE WHEN event_id % 6 = 0 THEN '  ' ELSE props END AS chunk FROM events) SELECT answer, count(*) AS citations, count(*) FILTER (page IS NULL) AS missing_page, count(*) FILTER (coalesce(trim(chunk), '') = '') AS missing_chunk, count(*) FILTER (page IS NOT NULL AND coalesce(trim(chunk), '') <> '') AS complete, round(avg((page IS NOT NULL AND coalesce(trim(chunk), '') <> '')::INTEGER), 6) AS completeness FROM c GROUP BY answer")
def citation_quality(spark, sf_dir):
    i = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("answer"), F.when(i % 4 != 0, F.col("user_id")).alias("page"), F.when(i % 6 == 0, "  ").otherwise(F.col("props")).alias("chunk"))
    return reports.citation_quality(rows, "answer", ["page", "chunk"])


@Q("SELECT conv_id, lower(trim(text)) AS item, min(turn) AS first FROM conversations WHERE turn % 3 <> 2 GROUP BY ALL")
def checklist_dedup(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("cited", F.array(F.col("turn") % 3))
    return reports.checklist(rows, "conv_id", "text", "turn", F.col("cited"), F.array(F.lit(0).cast("long"), F.lit(1).cast("long")))


# ---------------------------------------------------------------- jobs and identities


@Q("SELECT doc_id, sha256(concat_ws('|', sha256(text), 'gen-7', source, lang)) AS cache_key FROM documents")
def sha_keys(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", jobs.cache_key(F.col("text"), F.lit("gen-7"), F.col("source"), F.col("lang")).alias("cache_key"))


@Q("SELECT min(doc_id) AS doc_id, sha256(lang || '|' || text) AS provenance FROM documents GROUP BY lang, text")
def answer_dedup(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", jobs.provenance(F.col("lang"), F.col("text")).alias("provenance"))
    return rows.groupBy("provenance").agg(F.min("doc_id").alias("doc_id"))


@Q(r"SELECT item_id, item_id || ':' || sha256(lower(trim(regexp_replace('  ' || translate(text, 'aeiou', 'AEIOU'), '\s+', ' ', 'g')))) AS identity FROM benchmark")
def question_identities(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", jobs.question_identity(F.col("item_id"), F.concat(F.lit("  "), F.translate("text", "aeiou", "AEIOU"))).alias("identity"))


@Q(f"WITH {JOBS} SELECT job_id, CASE WHEN attempts < 5 THEN 'retry_wait' ELSE 'failed' END AS next_state, CASE WHEN attempts < 5 THEN TIMESTAMP '{NOW}' + to_seconds(30 * (1 << (attempts - 1))) END AS available_at FROM jobs WHERE operation = 'error'")
def retry_schedule(spark, sf_dir):
    return jobs.after_failure(_jobs(spark, sf_dir).filter("operation = 'error'"), _now()).select("job_id", "next_state", "available_at")


@Q(f"WITH {JOBS} SELECT job_id, CASE WHEN attempts < 5 THEN 'retry_wait' ELSE 'failed' END AS next_state FROM jobs WHERE state = 'running' AND lease_expires <= TIMESTAMP '{NOW}'")
def expired_leases(spark, sf_dir):
    return jobs.recovered(_jobs(spark, sf_dir), _now()).select("job_id", "next_state")


@Q(f"WITH {JOBS} SELECT job_id, greatest(0, (floor(epoch(TIMESTAMP '{NOW}')) - floor(epoch(created_at)))::BIGINT) AS age, created_at + INTERVAL 60 SECOND AS lease FROM jobs")
def lease_ages(spark, sf_dir):
    rows = _jobs(spark, sf_dir)
    return rows.select("job_id", jobs.age_seconds(F.col("created_at"), _now()).alias("age"), jobs.lease_until(F.col("created_at"), 60).alias("lease"))


@Q("SELECT doc_id, coalesce(CASE WHEN doc_id % 2 = 0 THEN n_chars / 100.0::DOUBLE END, doc_id / 10.0::DOUBLE) AS reranker_score FROM documents")
def passthrough_rerank(spark, sf_dir):
    rrf = F.when(F.col("doc_id") % 2 == 0, F.col("n_chars") / F.lit(100.0))
    return table(spark, sf_dir, "documents").select("doc_id", evidence.passthrough(rrf, F.col("doc_id") / F.lit(10.0)).alias("reranker_score"))


@Q("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 5 DAY")
def late_drop(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    last = events.agg(F.max("ts").alias("last"))
    return events.join(F.broadcast(last), how="cross").filter(F.col("ts") >= F.col("last") - F.expr("INTERVAL 5 DAYS")).select("event_id")
