"""Text files in session folders: keys from the path, bad files set aside with a reason."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDER = r"/Session (\d{2}) - (\d{4})/[^/]*$"
FILE = r"/([A-Z]{2,3})_(\d{1,2})_(\d{4})\.txt$"


def read_tree(spark: SparkSession, root: str, sessions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Speeches (source_iso, session, year, speech_path, speech_raw) and rejected files (speech_path, reason).

    A file is rejected if its folder or its name has another form, the two disagree, or its bytes are not UTF-8.
    ``sessions`` is the number of session folders there must be.
    """
    judged = judge_files(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content"))
    if sessions is not None:
        n = judged.where(F.col("__fs") != "").select("__fs", "__fy").distinct().count()
        if n != sessions:
            raise ValueError(f"{n} session folders, not {sessions}")
    return accepted(judged), judged.where("reason is not null").select("speech_path", "reason")


def judge_files(files: DataFrame) -> DataFrame:
    """Files (path, content) with the parts of their paths and the reason for which they are rejected, if any."""
    path = F.replace("path", F.lit("%20"), F.lit(" "))
    found = files.select(path.alias("speech_path"), "content").select(
        "*", *[F.regexp_extract("speech_path", p, i).alias(n) for p, i, n in ((FOLDER, 1, "__fs"), (FOLDER, 2, "__fy"), (FILE, 1, "source_iso"), (FILE, 2, "__s"), (FILE, 3, "__y"))]
    )
    number = lambda c: F.expr(f"try_cast({c} as int)")
    reason = (
        F.when(F.col("__fs") == "", "folder name")
        .when(F.col("source_iso") == "", "file name")
        .when((number("__fs") != number("__s")) | (number("__fy") != number("__y")), "folder and file disagree")
        .when(~F.is_valid_utf8(F.col("content").cast("string")), "not UTF-8")
    )
    return found.withColumn("reason", reason)


def accepted(judged: DataFrame) -> DataFrame:
    number = lambda c: F.expr(f"try_cast({c} as int)")
    return judged.where("reason is null").select("source_iso", number("__s").alias("session"), number("__y").alias("year"), "speech_path", F.col("content").cast("string").alias("speech_raw"))


def read_lenient(spark: SparkSession, root: str) -> DataFrame:
    """Counts of files by what their names give: three parts with two numbers ('matched') or not ('skipped')."""
    return count_lenient(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path"))


def count_lenient(paths: DataFrame) -> DataFrame:
    """The same for a table with ``path``."""
    files = paths.select(F.element_at(F.split("path", "/"), -1).alias("name"))
    parts = F.split(F.regexp_replace("name", r"\.txt$", ""), "_")
    ok = (F.size(parts) == 3) & F.expr("try_cast(split(regexp_replace(name, '\\\\.txt$', ''), '_')[1] as int) is not null") & F.expr("try_cast(split(regexp_replace(name, '\\\\.txt$', ''), '_')[2] as int) is not null")
    return files.groupBy(F.when(ok, "matched").otherwise("skipped").alias("outcome")).agg(F.count(F.lit(1)).alias("files"))
