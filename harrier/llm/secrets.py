"""Secret scans with corpus-wide ownership frequency, with DataFrame functions only.

Three base kinds of match are found in every whole text, leftmost and without overlap for each kind, with their
places in code points. Candidates are their values, and long mixed tokens besides. The hash of each candidate is
counted over the corpus by distinct repositories and distinct owners. A value that several owners hold, or more than
``FEW`` repositories of one owner, is a widely copied example; one that few repositories of a single owner hold looks
live. Base matches stay whatever their counts; a mixed token is added (kind ``owned``) if it looks live and no base
match touches it. Where rows name no repository (``repo_col`` is None), each distinct text stands for one, so a value
that thousands of texts of one owner hold is not taken for live, while exact copies of a text count once.

Counts are combined before any shuffle, first by value, repository and owner, then by value; matches meet their
counts dealt by how many there are, so a value held by a third of all documents is no heavy group; texts are not
shuffled. The work on a text grows with its length and its matches in proportion.

Edge cases: a null or empty text has no matches; equal values in one document count once for its owner; a null
repository or owner is one of its own; rows of equal key are judged each by its own text, equal rows get equal results;
very long texts are read whole; an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from harrier.llm.store import col, hot_join, written

#: The patterns of the base kinds (assign, access, hex), and the least length of their values.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Letters and digits mixed, 24 characters or more.
MIXED = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{24,}"
#: What a text must contain before a pattern is tried at all.
NEEDLES = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Repositories of one owner that may hold a value that looks live.
FEW = 3
KINDS = ("assign", "access", "hex", "owned")
PIECE = "array<struct<kind:int,seq:int,gap:int,len:int,value:string>>"


def _found(text: Column, pattern: str, kind: int, group: int) -> Column:
    """Matches as (kind, seq, gap, len, value): the length of the text before each, after the match before it, and its own."""
    between = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    parts = F.arrays_zip(F.slice(between, 1, F.size(whole)).alias("b"), whole.alias("w"), values.alias("v"))
    return F.transform(parts, lambda p, i: F.struct(F.lit(kind).alias("kind"), i.alias("seq"), F.length(p["b"]).alias("gap"), F.length(p["w"]).alias("len"), p["v"].alias("value")))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str | None = None, owner_col: str = "source") -> DataFrame:
    """id, repo, owner and the pieces (see _found) of each row, all kinds in one array."""
    nothing = F.array().cast(PIECE)
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    repo = F.xxhash64(text) if repo_col is None else F.xxhash64(col(repo_col).cast("string"))
    rows = docs.select(col(id_col).alias("id"), text.alias("t"), repo.alias("repo"), F.xxhash64(col(owner_col).cast("string")).alias("owner"))
    low = F.lower("t")
    named = low.contains(NEEDLES[0])
    for needle in NEEDLES[1:]:
        named = named | low.contains(needle)
    t = F.col("t")
    assign = F.when(named, _found(t, ASSIGN, 0, 2)).otherwise(nothing)
    access = F.when(t.contains("AKIA"), _found(t, ACCESS, 1, 0)).otherwise(nothing)
    hexes = F.when(t.rlike(HEX), _found(t, HEX, 2, 0)).otherwise(nothing)
    mixed = F.when(t.rlike(r"[A-Za-z0-9+/_-]{24}"), _found(t, MIXED, 3, 0)).otherwise(nothing)
    return rows.select("id", "repo", "owner", F.concat(assign, access, hexes, mixed).alias("pieces"))


def matches(found: DataFrame) -> DataFrame:
    """row, repo, owner, kind, start, end, value and touched (a base match overlaps it) of each match that counts.

    found has a ``row`` for each text. The matches of a text lie in one task, whose work grows with them in proportion.
    """
    single = found.select("row", "repo", "owner", F.inline("pieces")).repartition("row")
    upto = W.partitionBy("row", "kind").orderBy("seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = single.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(upto).cast("int")).withColumn("start", F.col("end") - F.col("len"))
    placed = placed.filter((F.col("kind") > 0) | (F.length("value") >= 8))
    # a base match that starts no later ends beyond the start, or one that starts later starts before the end
    # (both windows look back, in either order: one that looks ahead costs with the square of a text's matches)
    upward, downward = (W.partitionBy("row").orderBy(c).rangeBetween(W.unboundedPreceding, W.currentRow) for c in (F.col("start"), F.col("start").desc()))
    before = F.max(F.when(F.col("kind") < 3, F.col("end"))).over(upward)
    after = F.min(F.when(F.col("kind") < 3, F.col("start"))).over(downward)
    touched = F.coalesce(before > F.col("start"), F.lit(False)) | F.coalesce(after < F.col("end"), F.lit(False))
    return placed.select("row", "repo", "owner", "kind", "start", "end", "value", touched.alias("touched"))


def ownership(single: DataFrame) -> DataFrame:
    """value hash -> repositories and owners that hold it, and matches."""
    held = single.select(F.sha2("value", 256).alias("hash"), "repo", "owner").groupBy("hash", "repo", "owner").agg(F.count("*").alias("n"))
    return held.groupBy("hash").agg(F.count_distinct("repo").alias("repos"), F.count_distinct("owner").alias("owners"), F.sum("n").alias("matches"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str | None = None, owner_col: str = "source", few: int = FEW) -> DataFrame:
    """Key and findings: array of (start, end, kind, hash, repos, owners, live) by start, then kind.

    live: one owner and at most ``few`` repositories. The hash of a value stands for it: values are not returned.
    """
    found = written(candidates(docs, id_col, text_col, repo_col, owner_col).withColumn("row", F.monotonically_increasing_id()), "secret-candidates")
    single = written(matches(found.filter(F.size("pieces") > 0)), "secret-matches")
    counts = ownership(single).withColumn("live", (F.col("owners") == 1) & (F.col("repos") <= few))
    single = single.select("row", "kind", "start", "end", "touched", F.sha2("value", 256).alias("hash"))
    judged = hot_join(single, counts, ["hash"], "row", "matches", "secret-counts").filter("kind < 3 or (live and not touched)")
    one = F.struct("start", "kind", "end", "hash", "repos", "owners", "live")
    by = judged.groupBy("row").agg(F.array_sort(F.collect_list(one)).alias("findings"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,hash:string,repos:bigint,owners:bigint,live:boolean>>")
    out = found.select("id", "row").join(by, "row", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("findings", none).alias("findings"))


def spans(findings: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(findings, lambda m: F.concat_ws(":", F.element_at(names, m["kind"] + 1), m["start"].cast("string"), m["end"].cast("string"))), ",")
