"""File sources and sinks: corpus scans, text of many formats, questions, checkpoints, generations."""

from __future__ import annotations

import csv
import json
import uuid
from collections.abc import Mapping
from html.parser import HTMLParser

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from harrier.functions import text as X


def scan(spark: SparkSession, root: str, ignore: tuple[str, ...] = (".git", "__pycache__", "node_modules")) -> DataFrame:
    """path, relative_path, file_name, ext, folder, size, mtime_us, content of the files below root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = F.lit(root.removeprefix("file://").rstrip("/") + "/")
    relative = F.element_at(F.split(F.col("path"), base, 2), -1)
    rows = files.withColumn("relative_path", relative)
    for name in ignore:
        rows = rows.filter(~F.concat(F.lit("/"), F.col("relative_path")).contains(f"/{name}/"))
    return described(rows.select("path", "relative_path", F.col("length").alias("size"), F.unix_micros("modificationTime").alias("mtime_us"), "content"))


def described(rows: DataFrame) -> DataFrame:
    """rows with file_name, ext and folder, as their relative_path tells them."""
    at = F.col("relative_path")
    return rows.withColumns({"file_name": F.regexp_extract(at, r"([^/]*)$", 1), "ext": X.extension(at), "folder": X.parent_path(at)})


def decoded(content: Column) -> Column:
    """UTF-8 without a byte order mark; bytes that are not UTF-8 are read as Latin-1."""
    text = F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, "^﻿", "")


class _Text(HTMLParser):
    """All runs of character data, scripts and styles too."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.runs: list[str] = []

    def handle_data(self, data: str) -> None:
        if run := " ".join(data.split()):
            self.runs.append(run)


def html_text(html: str | None) -> str:
    parser = _Text()
    parser.feed(html or "")
    parser.close()
    return "\n".join(parser.runs)


@F.pandas_udf(StringType())
def html_to_text(html: pd.Series) -> pd.Series:
    return html.map(html_text)


@F.pandas_udf(StringType())
def pretty_json(text: pd.Series) -> pd.Series:
    def one(t: str | None) -> str | None:
        try:
            return json.dumps(json.loads(t), indent=2, ensure_ascii=False)
        except (TypeError, ValueError):
            return t

    return text.map(one)


@F.pandas_udf(StringType())
def csv_to_text(raw: pd.Series) -> pd.Series:
    """Rows of trimmed cells joined by ' | ', blank rows kept; a text that is no CSV stays as it is.

    A line break within quotes goes, and what stands around it is one cell.
    """

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        table = []
        try:
            for cells in csv.reader(text.splitlines()):
                table.append(" | ".join(cell.strip() for cell in cells))
        except csv.Error:
            return text
        return "\n".join(table)

    return raw.map(one)


def documents(files: DataFrame) -> DataFrame:
    """Scanned files -> relative_path, loader, category, collection, text; blank texts are dropped.

    Formats are read by their own branch; pages, sheets and slides need converters that are not part of this library.
    """
    rows = files.withColumn("raw", decoded(F.col("content")))
    ext = F.col("ext")
    parts = [
        rows.filter(ext.isin("html", "htm")).withColumn("text", html_to_text("raw")).withColumn("loader", F.lit("html")),
        rows.filter(ext == "json").withColumn("text", pretty_json("raw")).withColumn("loader", F.lit("json")),
        rows.filter(ext == "csv").withColumn("text", csv_to_text("raw")).withColumn("loader", F.lit("csv")),
        rows.filter(ext.isin("txt", "md", "markdown", "xml", "yaml", "yml")).withColumn("text", F.col("raw")).withColumn("loader", F.lit("text")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    level = F.split("folder", "/")
    return out.withColumn("text", F.btrim("text", F.lit(" \t\r\n"))).filter("text <> ''").select("relative_path", "loader", F.nullif(F.get(level, F.lit(0)), F.lit("")).alias("category"), F.get(level, F.lit(1)).alias("collection"), "text")


def questions_text(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank trimmed lines."""
    return spark.read.text(path).select(F.trim("value").alias("question")).filter("question <> ''")


#: Words that tell what a question is about, first match first.
ABOUT = {
    "operational": ("procedure", "step", "responsib", "deadline", "must", "how"),
    "comparative": ("compare", "difference", "versus", " vs "),
    "temporal": ("when", "date", "frequency", "how often"),
    "definition": ("what is", "define", "meaning"),
}
#: Lengths below and above which a question gets a warning.
SHORT, LONG = 8, 1000
_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
_ENDS = r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$"


def question_category(question: Column) -> Column:
    low, chosen = F.lower(question), F.lit("general")
    for name in reversed(ABOUT):
        found = F.lit(False)
        for word in ABOUT[name]:
            found = found | F.contains(low, F.lit(word))
        chosen = F.when(found, name).otherwise(chosen)
    return chosen


def question_records(rows: DataFrame, by: list[str], text: str) -> DataFrame:
    """by, index, prompt_id, line, question, category, normalized, warnings (array) of the questions in a text column,
    one a line; blank lines and those that start with # are none. A null text has no question.

    A row is one file: its questions are numbered within the row, so nothing is shuffled.
    """
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), _BREAK), lambda x, i: F.struct((i + 1).alias("line"), F.regexp_replace(x, _ENDS, "").alias("question")))
    asked = F.filter(lines, lambda x: (x["question"] != "") & ~F.startswith(x["question"], F.lit("#")))
    each = rows.select(*by, F.posexplode(asked).alias("pos", "q")).select(*by, (F.col("pos") + 1).alias("index"), "q.line", "q.question")
    q = F.col("question")
    warnings = F.array_compact(F.array(F.when(F.length(q) < SHORT, "extremely short"), F.when(F.length(q) > LONG, "very long"), F.when(F.regexp_count(q, F.lit(r"(?:^|\s)\d+[.)]\s")) > 1, "may contain multiple numbered questions")))
    normalized = F.regexp_replace(F.lower(q), r"(?U)[\s\x1C-\x1F]+", " ")
    return each.select(*by, "index", F.format_string("Q%04d", "index").alias("prompt_id"), "line", "question", question_category(q).alias("category"), normalized.alias("normalized"), warnings.alias("warnings"))


def question_stats(records: DataFrame, by: list[str]) -> DataFrame:
    """by, count, exact and normalized repeats beyond the first of each question, warnings."""
    each = records.groupBy(*by, "normalized", "question").agg(F.count("*").alias("n"), F.sum(F.size("warnings")).alias("w"))
    once = each.groupBy(*by, "normalized").agg(F.sum("n").alias("n"), F.count("*").alias("kinds"), F.sum("w").alias("w"))
    total = F.sum("n")
    return once.groupBy(*by).agg(total.alias("count"), (total - F.sum("kinds")).alias("exact_duplicates"), (total - F.count("*")).alias("normalized_duplicates"), F.sum("w").alias("warnings"))


def question_source(spark: SparkSession, path: str) -> DataFrame:
    """question_records of the .txt files at a path, by their relative_path."""
    if not path.lower().endswith(".txt"):
        raise ValueError("questions are read from plain .txt files")
    rows = spark.read.format("binaryFile").load(path)
    return question_records(rows.select(F.col("path").alias("file"), decoded(F.col("content")).alias("text")), ["file"], "text")


def benchmark_csv(spark: SparkSession, path: str) -> DataFrame:
    """question_id, question, answer, expected (array), category, difficulty, should_answer, metadata (other columns)."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    known = {"question_id": ("question_id", "id"), "question": ("question", "query"), "answer": ("answer", "expected_answer"), "expected_keywords": ("expected_keywords", "keywords"), "category": ("category",), "difficulty": ("difficulty",), "should_answer": ("should_answer", "answerable")}
    pick = lambda names: F.coalesce(*[F.nullif(F.trim(F.col(n)), F.lit("")) for n in names if n in raw.columns], F.lit(None).cast("string"))
    used = {n for names in known.values() for n in names}
    rest = [c for c in raw.columns if c not in used]
    words = F.filter(F.transform(F.split(F.coalesce(pick(known["expected_keywords"]), F.lit("")), r"[|;,]"), lambda x: F.trim(x)), lambda x: x != "")
    extra = F.create_map(*[x for c in rest for x in (F.lit(c), F.col(c))]) if rest else F.create_map().cast("map<string,string>")
    yes = F.coalesce(F.lower(pick(known["should_answer"])).isin("true", "1", "yes", "y"), F.lit(True))
    return raw.select(pick(known["question_id"]).alias("question_id"), pick(known["question"]).alias("question"), pick(known["answer"]).alias("answer"), words.alias("expected"), pick(known["category"]).alias("category"), pick(known["difficulty"]).alias("difficulty"), yes.alias("should_answer"), extra.alias("metadata"))


def latest_per_key(rows: DataFrame, key: list[str], seq: str) -> DataFrame:
    """The last row of each key, with first_seen for the order."""
    w = W.partitionBy(*key)
    return rows.withColumn("first_seen", F.min(seq).over(w)).withColumn("__n", F.row_number().over(w.orderBy(F.desc(seq)))).filter("__n = 1").drop("__n")


def write_csv(rows: DataFrame, path: str) -> None:
    """Nested cells as JSON, formula cells quoted."""
    cells = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else X.safe_cell(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes]
    rows.select(*cells).write.option("header", True).mode("overwrite").csv(path)


class Generations:
    """A table kept as one folder for each generation, and a pointer table whose last row names the one in use."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def publish(self, rows: DataFrame | Mapping[str, DataFrame]) -> str:
        """Writes a new generation, a table or several by name, and then points to it; readers of older ones go on.

        Of two writers at once, the pointer of the larger number and name counts, for every reader alike.
        """
        name = f"gen-{uuid.uuid4().hex}"
        for part, table in rows.items() if isinstance(rows, Mapping) else [("", rows)]:
            table.write.parquet(f"{self.root}/{name}/{part}".rstrip("/"))
        self.point(name)
        return name

    def point(self, name: str) -> None:
        n = (self.history().agg(F.max("n")).first()[0] or 0) + 1
        self.spark.createDataFrame([(n, name)], "n long, generation string").write.mode("append").parquet(f"{self.root}/pointer")

    def history(self) -> DataFrame:
        try:
            return self.spark.read.schema("n long, generation string").parquet(f"{self.root}/pointer")
        except AnalysisException as e:  # no pointer yet
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], "n long, generation string")

    def current(self) -> str | None:
        row = self.history().agg(F.max_by("generation", F.struct("n", "generation")).alias("g")).first()
        return row.g if row else None

    def read(self, generation: str | None = None, part: str = "") -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{generation or self.current()}/{part}".rstrip("/"))


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """table with rows in place of those of equal key; of repeated keys in rows one stays."""
    fresh = rows.dropDuplicates([key])
    return table.join(fresh.select(key), key, "left_anti").select(*table.columns).unionByName(fresh)


def replace_version(table: DataFrame, rows: DataFrame, document: str, version: str) -> DataFrame:
    """table with all rows of the (document, version) pairs of rows replaced by rows."""
    return table.join(rows.select(document, version).distinct(), [document, version], "left_anti").select(*table.columns).unionByName(rows)


def delete_where(table: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, one row with the count of those that go). A null condition keeps the row."""
    gone = F.coalesce(condition, F.lit(False))
    return table.filter(~gone), table.filter(gone).agg(F.count("*").alias("removed"))


def snapshot(chunks: DataFrame, notes: DataFrame) -> DataFrame:
    """Chunks in (document, chunk_index) order and the blocks of current, indexed notes, as one table."""
    live = notes.filter("indexed AND revision = indexed_revision").select(F.col("note_id").alias("document_id"), F.posexplode(F.split("body", r"\n\s*\n")).alias("chunk_index", "text"))
    return chunks.select("document_id", "chunk_index", "text").unionByName(live).orderBy("document_id", "chunk_index")
