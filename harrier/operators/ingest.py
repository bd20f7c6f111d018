"""Ingestion: format registry, candidate checks, snapshot diff and move detection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from harrier.functions import text as X

#: Extensions by category, label and support.
FORMATS = (
    ("Core Enterprise Documents", "PDF", ("pdf",), "supported_now", False),
    ("Core Enterprise Documents", "Word", ("docx", "doc"), "supported_now", False),
    ("Core Enterprise Documents", "Excel", ("xlsx", "xls"), "supported_now", False),
    ("Core Enterprise Documents", "CSV", ("csv",), "supported_now", False),
    ("Core Enterprise Documents", "PowerPoint", ("pptx", "ppt"), "supported_now", False),
    ("Core Enterprise Documents", "Text", ("txt",), "supported_now", False),
    ("Technical Documentation", "Markdown", ("md", "markdown"), "supported_now", False),
    ("Technical Documentation", "HTML", ("html", "htm"), "supported_now", False),
    ("Technical Documentation", "JSON", ("json",), "supported_now", False),
    ("Technical Documentation", "XML", ("xml",), "supported_now", False),
    ("Technical Documentation", "YAML", ("yaml", "yml"), "supported_now", False),
    ("Images with OCR", "PNG", ("png",), "ocr_supported", True),
    ("Images with OCR", "JPG/JPEG", ("jpg", "jpeg"), "ocr_supported", True),
    ("Images with OCR", "TIFF", ("tiff", "tif"), "ocr_supported", True),
    ("Email / Communication", "Email", ("eml", "msg", "pst", "mbox"), "recognized_future_support", False),
    ("Archives", "Archives", ("zip", "rar", "7z", "tar", "gz"), "recognized_future_support", False),
    ("Source Code", "Source Code", ("py", "js", "ts", "tsx", "jsx", "java", "cpp", "c", "cs", "go", "rs", "php", "swift", "kt", "rb", "sql"), "recognized_future_support", False),
    ("Configuration / DevOps", "Configuration Files", ("toml", "ini", "env", "dockerfile"), "recognized_future_support", False),
    ("Multimedia", "Audio", ("mp3", "wav", "aac"), "recognized_future_support", False),
    ("Multimedia", "Video", ("mp4", "mov", "avi", "mkv"), "recognized_future_support", False),
    ("Engineering / CAD", "CAD / Engineering", ("dwg", "dxf", "step", "stp", "iges", "sldprt", "sldasm"), "recognized_future_support", False),
)


def registry(spark: SparkSession) -> DataFrame:
    """ext, category, label, support, needs_ocr: a fixed lookup table of some 60 rows."""
    return spark.createDataFrame([(e, c, n, s, o) for c, n, exts, s, o in FORMATS for e in exts], "ext string, category string, label string, support string, needs_ocr boolean")


def with_format(files: DataFrame, name: str) -> DataFrame:
    """files with ext, category, label, support and needs_ocr; unknown formats are unsupported."""
    rows = files.withColumn("ext", X.extension(F.col(name)))
    found = rows.join(F.broadcast(registry(files.sparkSession)), "ext", "left")
    return found.fillna({"category": "Unknown", "label": "Unknown", "support": "unsupported", "needs_ocr": False})


def action(support: Column) -> Column:
    return F.when(support == "supported_now", "process").when(support == "ocr_supported", "ocr_then_process").when(support == "recognized_future_support", "skip_with_warning").otherwise("reject")


def skip_reason(name: Column, size: Column, readable: Column, act: Column) -> Column:
    """The first reason to leave a file out, or null."""
    base = F.regexp_extract(name, r"([^/\\]*)$", 1)
    return F.when(base.startswith("~$"), "temporary_office_file").when(base.startswith("."), "hidden_file").when(size == 0, "empty_file").when(~readable, "unreadable_file").when(~act.isin("process", "ocr_then_process"), "unsupported_format")


def reuse_hashes(scan: DataFrame, known: DataFrame, forced: DataFrame | None = None) -> DataFrame:
    """scan (path, size, mtime_us, content) with hash: the known one where size and time match, unless forced."""
    old = known.select("path", F.col("size").alias("__size"), F.col("mtime_us").alias("__time"), F.col("hash").alias("__hash"))
    rows = scan.join(old, "path", "left")
    same = (F.col("size") == F.col("__size")) & (F.col("mtime_us") == F.col("__time"))
    if forced is not None:
        rows = rows.join(forced.select("path").distinct().withColumn("__forced", F.lit(True)), "path", "left")
        same = same & F.col("__forced").isNull()
    return rows.withColumn("reused", F.coalesce(same, F.lit(False))).withColumn("hash", F.when(F.col("reused"), F.col("__hash")).otherwise(F.sha2("content", 256))).select(*scan.columns, "hash", "reused")


def manifest_diff(now: DataFrame, before: DataFrame, key: str, digest: str, version: str | None = None) -> DataFrame:
    """key, change_type (new, unchanged, changed, deleted). An older version of an entry counts as changed."""
    a = now.select(key, F.col(digest).alias("__new"), *([F.col(version).alias("__v")] if version else []))
    b = before.select(key, F.col(digest).alias("__old"), *([F.col(version).alias("__w")] if version else []))
    same = F.col("__new") == F.col("__old")
    if version:
        same = same & (F.col("__v") <= F.col("__w"))
    return a.join(b, key, "full_outer").select(key, F.when(F.col("__old").isNull(), "new").when(F.col("__new").isNull(), "deleted").when(same, "unchanged").otherwise("changed").alias("change_type"))


def moves(now: DataFrame, before: DataFrame, key: str, same: list[str]) -> DataFrame:
    """old, new: keys that are gone and keys that are new, paired by equal content; the n-th goes with the n-th."""
    w = W.partitionBy(*same).orderBy(key)
    fresh = now.join(before.select(key), key, "left_anti").select(*same, F.col(key).alias("new"), F.row_number().over(w).alias("n"))
    gone = before.join(now.select(key), key, "left_anti").select(*same, F.col(key).alias("old"), F.row_number().over(w).alias("n"))
    return gone.join(fresh, [*same, "n"]).select("old", "new", *same)


def folder_moves(now: DataFrame, before: DataFrame, folder: str, digest: str) -> DataFrame:
    """old, new folders with the same hashes, paired in order; longest missing paths first.

    A folder's signature is the number of its hashes and two sums over them, so no folder is collected into one row.
    """
    total = lambda *x: F.sum(F.xxhash64(*x).cast("decimal(38,0)")).cast("string")
    sign = lambda rows: rows.groupBy(folder).agg(F.concat_ws(":", F.count("*").cast("string"), total(digest), total(F.lit("2"), digest)).alias("signature"))
    a, b = sign(now), sign(before)
    w = W.partitionBy("signature").orderBy(F.length(folder).desc(), folder)
    fresh = a.join(b.select(folder), folder, "left_anti").select("signature", F.col(folder).alias("new"), F.row_number().over(w).alias("n"))
    gone = b.join(a.select(folder), folder, "left_anti").select("signature", F.col(folder).alias("old"), F.row_number().over(w).alias("n"))
    return gone.join(fresh, ["signature", "n"]).select("old", "new")


def first_filled(rows: DataFrame, names: Sequence[str], default: str | None = None) -> Column:
    """The first of these columns, as far as the rows have them, that is neither null nor blank; else the default."""
    have = [F.nullif(F.trim(F.col(f"`{n}`").cast("string")), F.lit("")) for n in names if n in rows.columns]
    return F.coalesce(*have, F.lit(default))


def readiness(files: DataFrame, by: str, name: str, samples: int = 5) -> DataFrame:
    """by, n, samples: how many files there are of each kind, and the first names of them."""
    place = F.row_number().over(W.partitionBy(by).orderBy(name))
    first = files.withColumn("__n", place).filter(F.col("__n") <= samples).groupBy(by).agg(F.array_sort(F.collect_list(name)).alias("samples"))
    return files.groupBy(by).agg(F.count("*").alias("n")).join(first, by)


def anchor(sheet: Column, slide: Column, page: Column, chunk: Column) -> Column:
    """Where a chunk stands: its sheet, slide or page, whichever is known first, else its own id."""
    return F.coalesce(F.concat(F.lit("sheet:"), sheet), F.concat(F.lit("slide:"), slide.cast("string")), F.concat(F.lit("page:"), page.cast("string")), F.concat(F.lit("chunk:"), chunk))


def payload(chunks: DataFrame, versions: DataFrame, version: str = "document_version_id") -> DataFrame:
    """The payload of chunks (version, chunk_index, text columns) from their documents and versions.

    A document without repository gets one from its scope: that of its owner if personal, else of its department, else
    of its organization.
    """
    own = F.when(F.col("storage_scope") == "personal", F.concat(F.lit("personal:"), "owner_user_id"))
    repository = F.coalesce("repository_id", own, F.concat(F.lit("department:"), "department_id"), F.concat(F.lit("organization:"), "organization_id"))
    rows = chunks.join(versions, version).withColumn("repository_id", repository)
    return rows.withColumn("chunk_id", F.concat_ws(":", F.col(version), F.col("chunk_index").cast("string")))


#: What a chunk's payload must hold, and what of it may not be null.
REQUIRED = ("document_id", "document_version_id", "repository_id", "storage_scope", "visibility", "organization_id", "owner_user_id", "department_id", "relative_path", "file_name", "chunk_id", "chunk_index")
NULLABLE = ("owner_user_id", "department_id")


def payload_contract(rows: DataFrame) -> DataFrame:
    """rows with missing and invalid (sorted arrays of names) and valid. Absent columns count as missing."""
    have = set(rows.columns)
    missing = F.array(*[F.lit(c) for c in REQUIRED if c not in have]).cast("array<string>")
    missing = F.concat(missing, F.array_compact(F.array(*[F.when(F.col(c).isNull(), c) for c in REQUIRED if c in have and c not in NULLABLE])))
    uuid = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
    tests = [F.when(F.col(c).isNotNull() & ~F.col(c).rlike(uuid), c) for c in ("document_id", "document_version_id") if c in have]
    if "storage_scope" in have:
        tests.append(F.when(~F.col("storage_scope").isin("enterprise", "personal"), "storage_scope"))
        if "owner_user_id" in have:
            tests.append(F.when((F.col("storage_scope") == "personal") & F.col("owner_user_id").isNull(), "owner_user_id"))
    out = rows.withColumn("missing", F.array_sort(missing)).withColumn("invalid", F.array_sort(F.array_compact(F.array(*tests)).cast("array<string>")))
    return out.withColumn("valid", (F.size("missing") == 0) & (F.size("invalid") == 0))
