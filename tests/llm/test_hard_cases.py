"""Hard cases of every operator and every stage: clashing names, empty tables, long texts, ids of other kinds."""

from __future__ import annotations

import random

import brute
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from harrier.llm import decontaminate, lines, mixing, quality, secrets, simhash, similar, substrings, tokens, warc, word_windows

SF = "/root/testdata/sf0.001"
#: Names that operators use for themselves, or that their results have.
CLASHES = ("n_lines", "n_dropped", "kept_text", "lines", "places", "own_id", "own_version", "gone_id", "keep", "__keep", "__places", "id", "version", "node", "fp", "keys", "k", "u", "v", "root", "k1", "k2", "hit", "items", "own1", "key", "row", "rows", "size", "of", "range", "before", "place", "target", "upto", "m", "hash", "live", "salt", "groups", "chunk", "bucket", "kind", "digest", "payload", "quality", "score", "a b.c`d")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def labels(spark):
    return spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, quality int")


def items(spark):
    return spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (2, None), (3, "short item")], "item_id long, text string")


OPERATORS = {
    "lines": lambda spark, docs: lines.dedup(docs, lines.build(docs)),
    "word_windows": lambda spark, docs: word_windows.remove_repeated(docs),
    "quality": lambda spark, docs: quality.judge(docs, labels(spark)),
    "tokens": lambda spark, docs: tokens.count_tokens(docs, VOCABULARY),
    "warc": lambda spark, docs: warc.round_trip(spark, docs, "doc_id", "source", "text").withColumnRenamed("page_id", "doc_id"),
    "secrets": lambda spark, docs: secrets.scan(docs),
    "substrings": lambda spark, docs: substrings.remove_repeated(docs),
    "mixing": lambda spark, docs: mixing.mix(docs),
    "decontaminate": lambda spark, docs: decontaminate.find_hits(docs, items(spark)),
    "decontaminate in parts": lambda spark, docs: decontaminate.find_hits(docs, items(spark), max_windows=1),
    "simhash": lambda spark, docs: simhash.near_duplicates(docs),
    "similar": lambda spark, docs: similar.near_duplicates(docs),
}
KEEPERS = {
    "lines": lambda spark, docs: lines.clean(docs, lines.build(docs), length_col="n_chars"),
    "quality": lambda spark, docs: quality.keep_good(docs, labels(spark)),
    "similar": lambda spark, docs: similar.one_of_each(docs),
    "decontaminate": lambda spark, docs: decontaminate.clean_documents(docs, items(spark)),
    "decontaminate spans": lambda spark, docs: decontaminate.clean_documents(docs, items(spark), remove="spans", max_windows=1),
}
LINE = "a line that stands in two documents of this table"
ROWS = [(1, f"{LINE}\nonly in the first of them, with some more words than ten of them", "s", 5), (2, f"{LINE} \nand in the second one something else, which is long enough too", None, 5), (2, None, "s", 0), (None, "", "t", 0), (3, "one two three four five six seven eight nine ten eleven", "s", 1), (3, "one two three four five six seven eight nine ten eleven", "s", 1)]


EXPECTED = {
    "lines": [ROWS[0][1], ROWS[1][1].split("\n")[1], None, "", ROWS[4][1], ROWS[5][1]],
    "quality": [ROWS[0][1], ROWS[1][1], ROWS[4][1], ROWS[5][1]],
    "similar": [ROWS[0][1], ROWS[1][1], None, ROWS[4][1], ROWS[5][1]],
    "decontaminate": [ROWS[0][1], ROWS[1][1], None, ""],
    "decontaminate spans": [ROWS[0][1], ROWS[1][1], None, "", "", ""],
}


def plain(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").repartition(2)


def clashing(frame):
    return frame.withColumns({c: F.lit(i) for i, c in enumerate(CLASHES)})


def cells(row):
    return sorted((k, str(v)) for k, v in row.asDict().items())


@pytest.mark.parametrize("name", OPERATORS)
def test_names_empty_tables_and_null_or_repeated_rows(spark, name):
    run = OPERATORS[name]
    want = run(spark, plain(spark))
    rows = sorted(map(cells, want.collect()))
    assert len(rows) == len(ROWS)
    got = run(spark, clashing(plain(spark)))
    assert sorted(cells(r) for r in got.select(*[F.col(f"`{c}`") for c in want.columns if c not in ("source", "text", "n_chars")]).collect()) == sorted([x for x in r if x[0] not in ("source", "text", "n_chars")] for r in rows)
    empty = run(spark, plain(spark, []))
    assert empty.collect() == [] and empty.columns == want.columns


@pytest.mark.parametrize("name", KEEPERS)
def test_stages_keep_columns_of_any_name(spark, name):
    docs = clashing(plain(spark))
    got = KEEPERS[name](spark, docs)
    assert got.columns == docs.columns and got.schema.names == docs.schema.names
    kept = got.collect()
    assert kept and all([r[c] for c in CLASHES] == [*range(len(CLASHES))] for r in kept)
    texts = sorted(str(r.text) for r in kept)
    assert texts == sorted(str(t) for t in EXPECTED[name])
    assert KEEPERS[name](spark, clashing(plain(spark, []))).collect() == []


@pytest.mark.parametrize("op", [lambda d: lines.build(d), lambda d: word_windows.remove_repeated(d), lambda d: substrings.remove_repeated(d), lambda d: warc.records(d, "doc_id", "source", "text")])
def test_ids_that_are_no_whole_numbers_raise_one_error(spark, op):
    with pytest.raises(TypeError, match="doc_id must be a column of whole numbers, not string"):
        op(spark.createDataFrame([("a", "t", "s")], "doc_id string, text string, source string"))


@pytest.mark.parametrize("name", ["quality", "tokens", "secrets", "mixing", "decontaminate", "simhash", "similar"])
def test_other_operators_take_any_ids(spark, name):
    docs = plain(spark).withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    assert OPERATORS[name](spark, docs).count() == len(ROWS)


@pytest.fixture(scope="module")
def long_rows():
    """Two texts of some megabytes that share most of their lines, one word of a million letters, one word repeated."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    body = ["".join(word() + " " for _ in range(12)) for _ in range(12_000)]
    return [(1, "\n".join(body)), (2, "\n".join(body[:-5] + ["another end of it all"])), (3, "x" * 1_000_000), (4, "ab " * 200_000), (5, None)]


def test_long_texts(spark, long_rows):
    docs = spark.createDataFrame(long_rows, "doc_id long, text string").repartition(3).withColumn("source", F.lit("s"))
    got = lambda frame, *c: {r.doc_id: tuple(r[x] for x in c) for r in frame.collect()}
    assert got(lines.dedup(docs, lines.build(docs)).withColumn("sha", F.sha2("kept_text", 256)), "n_lines", "n_dropped", "sha") == brute.op1(long_rows)
    assert got(word_windows.remove_repeated(docs), "n_words", "n_removed", "kept_sha256") == brute.op2(long_rows)
    assert got(substrings.remove_repeated(docs), "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.op7(long_rows)
    library = Tokenizer.from_file(VOCABULARY)
    assert got(tokens.count_tokens(docs.filter("doc_id in (1, 4)"), VOCABULARY), "n_tokens") == {d: (len(library.encode(t, add_special_tokens=False).ids),) for d, t in long_rows if d in (1, 4)}
    sizes = {d: len((t or "").split()) for d, t in long_rows}
    assert got(quality.judge(docs, labels(spark)), "n_words") == {d: (n,) for d, n in sizes.items()} == got(mixing.mix(docs), "size")
    assert {d: n for d, (n,) in got(secrets.scan(docs), "findings").items()} == {d: [] for d in sizes}
    assert got(decontaminate.find_hits(docs, items(spark), with_text=False), "n_hit") == {d: (0,) for d in sizes}
    assert got(simhash.near_duplicates(docs), "component_id") == got(similar.near_duplicates(docs), "component_id") == {1: (1,), 2: (1,), 3: (3,), 4: (4,), 5: (5,)}
    back = warc.round_trip(spark, docs, "doc_id", "source", "text", with_payload=True)
    assert {r.page_id: r.payload.decode() for r in back.collect()} == {d: t or "" for d, t in long_rows}
