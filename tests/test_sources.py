"""Files, generations and streams."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from harrier.operators import ingest
from harrier.sources import files
from harrier.streaming import events


def test_scan_and_read(spark, tmp_path):
    made = {"a/b/x.txt": "\ufeffhello ".encode(), "a/y.html": b"<p>one  two</p><script>var t=1;</script>", "z.json": b'{"b": [1]}', "t.csv": b'a,"b, c" ,d\n\n1,"2\n""2"" ",3\n', "latin.md": "caf\xe9".encode("latin-1"), "blank.txt": b"  ", ".git/config": b"no", "pic.png": b"x"}
    for name, data in made.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    found = files.scan(spark, f"file://{tmp_path}")
    got = {r.relative_path: (r.loader, r.category, r.collection, r.text) for r in files.documents(found).collect()}
    assert got == {
        "a/b/x.txt": ("text", "a", "b", "hello"),
        "a/y.html": ("html", "a", None, "one two\nvar t=1;"),
        "z.json": ("json", None, None, '{\n  "b": [\n    1\n  ]\n}'),
        "t.csv": ("csv", None, None, "a | b, c | d\n\n1 | 2\"2\" | 3"),
        "latin.md": ("text", None, None, "café"),
    }
    known = found.select("path", "size", "mtime_us", F.lit("old").alias("hash"))
    again = ingest.reuse_hashes(found, known, found.filter("file_name = 'z.json'").select("path"))
    assert {r.reused for r in again.filter("file_name = 'z.json'").collect()} == {False} and again.filter("reused").count() == found.count() - 1


def test_questions_and_benchmark(spark, tmp_path):
    (tmp_path / "q.txt").write_text(" one?\n\n two?\n")
    assert [r.question for r in files.questions_text(spark, f"file://{tmp_path}/q.txt").collect()] == ["one?", "two?"]
    (tmp_path / "b.csv").write_text("id,query,keywords,answerable,note\n1,what,a| b;c,no,n1\n2,who,,,\n")
    got = files.benchmark_csv(spark, f"file://{tmp_path}/b.csv").orderBy("question_id").collect()
    assert (got[0].question, got[0].expected, got[0].should_answer, got[0].metadata) == ("what", ["a", "b", "c"], False, {"note": "n1"})
    assert got[1].expected == [] and got[1].should_answer


def test_csv_cells(spark):
    rows = {"quoted": 'a,"b\r\nc",d', "blank": "a\n\nb", "inner": 'x "y, z" w', "open": 'a,"b\nc', "empty": "", "long": "x" * 140_000 + ",  y", "null": None}
    got = dict(spark.createDataFrame(list(rows.items()), "k string, t string").select("k", files.csv_to_text("t")).collect())
    assert got == {"quoted": "a | bc | d", "blank": "a\n\nb", "inner": 'x "y | z" w', "open": "a | bc", "empty": "", "long": rows["long"], "null": None}


def test_question_source(spark, tmp_path):
    (tmp_path / "q.txt").write_text("\ufeff# heading\n\n What is  a lease? \nwhat is a lease?\nshort\nHow often, and when?\n1. one thing 2) another thing\nWhat is  a lease?\n" + "y" * 1001)
    got = files.question_source(spark, f"file://{tmp_path}/q.txt")
    rows = got.orderBy("index").collect()
    assert [(r.prompt_id, r.line, r.category) for r in rows] == [("Q0001", 3, "definition"), ("Q0002", 4, "definition"), ("Q0003", 5, "general"), ("Q0004", 6, "operational"), ("Q0005", 7, "general"), ("Q0006", 8, "definition"), ("Q0007", 9, "general")]
    assert [r.warnings for r in rows] == [[], [], ["extremely short"], [], ["may contain multiple numbered questions"], [], ["very long"]]
    assert tuple(files.question_stats(got, ["file"]).drop("file").first()) == (7, 1, 2, 3)
    none = spark.createDataFrame([(1, None), (2, "")], "k int, t string")
    assert files.question_records(none, ["k"], "t").count() == 0


def test_csv_sink_guards_cells(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", [1, 2])], "a string, b array<int>")
    files.write_csv(df, f"file://{tmp_path}/out")
    assert tuple(spark.read.option("header", True).option("escape", "\\").csv(f"file://{tmp_path}/out").first()) == ("'=1+1", "[1,2]")


def test_generations_keep_old_readers(spark, tmp_path):
    g = files.Generations(spark, f"file://{tmp_path}/t")
    assert g.current() is None
    first = g.publish(spark.range(3))
    pinned = g.read(first)
    g.publish(spark.range(5))
    assert (pinned.count(), g.read().count()) == (3, 5)


def test_table_changes(spark):
    t = spark.createDataFrame([("d1", "v1", 1), ("d1", "v2", 2), ("d2", "v1", 3)], "doc string, v string, k int")
    new = spark.createDataFrame([("d1", "v2", 9), ("d1", "v2", 9)], "doc string, v string, k int")
    assert sorted(r.k for r in files.upsert(t, new.withColumn("k", F.lit(3)), "k").collect()) == [1, 2, 3]
    assert sorted(r.k for r in files.replace_version(t, new, "doc", "v").collect()) == [1, 3, 9, 9]
    rest, gone = files.delete_where(t, F.col("doc") == "d1")
    assert rest.count() == 1 and gone.first().removed == 2
    assert {r.k: r.first_seen for r in files.latest_per_key(t.withColumn("seq", F.col("k")), ["doc"], "seq").collect()} == {2: 1, 3: 3}
    notes = spark.createDataFrame([("n", "a\n\nb", 2, 2, True), ("m", "x", 2, 1, True)], "note_id string, body string, revision int, indexed_revision int, indexed boolean")
    chunks = spark.createDataFrame([("d", 0, "t")], "document_id string, chunk_index int, text string")
    assert [(r.document_id, r.text) for r in files.snapshot(chunks, notes).collect()] == [("d", "t"), ("n", "a"), ("n", "b")]


def moments(spark):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    return spark.createDataFrame([("u", at(0), "claimed", 1.0), ("u", at(4), "extracting", 2.0), ("u", at(30), "extracting", 3.0), ("v", at(1), "completed", 4.0), ("u", at(31), "claimed", 5.0)], "k string, ts timestamp, state string, value double")


def test_event_operators(spark):
    ev = moments(spark)
    assert sorted((r.k, r.n) for r in events.sessions(ev, "ts", "10 minutes", ["k"]).collect()) == [("u", 2), ("u", 2), ("v", 1)]
    changes = events.state_changes(ev, "k", ["ts"], "state")
    assert [(r.previous, r.state) for r in changes.orderBy("ts").collect()] == [("claimed", "extracting"), ("extracting", "claimed")]
    assert [(r.previous, r.state) for r in events.illegal(changes, "state").collect()] == [("extracting", "claimed")]
    assert events.current_revisions(spark.createDataFrame([("a", 1), ("a", 2)], "k string, r int"), "k", "r").count() == 1


def test_stream_equals_batch(spark, tmp_path):
    moments(spark).coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(moments(spark).schema).parquet(f"file://{tmp_path}/in")

    def drain(df, name, mode):
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
        return sorted(map(str, spark.table(name).collect()))

    tumble = lambda df, late=None: events.tumbling(df, "ts", "10 minutes", ["k"], "value", late=late)
    assert drain(tumble(stream, "1 hour"), "tumble", "complete") == sorted(map(str, tumble(moments(spark)).collect()))
    slide = lambda df: events.tumbling(df, "ts", "10 minutes", ["k"], "value", slide="5 minutes")
    assert drain(slide(stream), "slide", "complete") == sorted(map(str, slide(moments(spark)).collect()))
    assert len(drain(events.state_changes_stream(stream, "k", "ts", "state"), "changes", "append")) == 2
    g = files.Generations(spark, f"file://{tmp_path}/gen")
    events.publish(stream, g, f"file://{tmp_path}/cp").awaitTermination()
    assert g.read().count() == 5
