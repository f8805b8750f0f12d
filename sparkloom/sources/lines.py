"""Text as numbered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that a walk passes over.
SKIPPED = ["vendor", "node_modules", "venv", "env", "__pycache__", "dist", "build", "site-packages"]


def lines_of(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``file, n, line``: the lines of each text, counted from 1. A null text has none; an empty text has one."""
    parts = F.split(F.col(text_col), "\n", -1)
    return texts.select(F.col(id_col).alias("file"), F.posexplode(parts).alias("p", "line")).select("file", (F.col("p") + 1).alias("n"), "line")


def source_files(spark: SparkSession, root: str, pattern: str = "*.py") -> DataFrame:
    """``path, text`` of the files under ``root``, without hidden and skipped folders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    inside = F.regexp_replace("path", "^.*?" + "/" + root.strip("/").replace("file:", "").strip("/").rsplit("/", 1)[-1] + "/", "")
    parts = F.split(inside, "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    keep = ~F.exists(folders, lambda d: d.startswith(".") | d.isin(*SKIPPED))
    return files.where(keep).select("path", F.decode("content", "UTF-8").alias("text"))


def detect_language(files: DataFrame) -> DataFrame:
    """One row ``language, files``: the language with most files; ties go to the first by name, no file gives go."""
    ext = F.lower(F.substring_index("path", ".", -1))
    lang = F.when(ext == "py", "python").when(ext.isin("ts", "tsx") & ~F.col("path").endswith(".d.ts"), "typescript").when(ext == "go", "go")
    counts = files.select(lang.alias("language")).where("language is not null").groupBy("language").agg(F.count(F.lit(1)).alias("files"))
    best = counts.orderBy(F.desc("files"), "language").limit(1)
    return best.union(files.sparkSession.createDataFrame([("go", 0)], "language string, files long")).orderBy(F.desc("files")).limit(1)


def module_name(path, root: str = ""):
    """Dotted module of a Python file below ``root``."""
    p = F.regexp_replace(path, f"^(file:)?/*{root.strip('/')}/*", "") if root else path
    p = F.regexp_replace(F.regexp_replace(p, r"\.py\z", ""), r"/__init__\z", "")
    return F.translate(p, "/", ".")
