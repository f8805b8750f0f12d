"""Streams of text files through the stateless line rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.line_rules import LineRule, scan
from sparkloom.sources.lines import lines_of


def file_stream(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``path, text`` of each file as it appears in ``folder``, whole."""
    rows = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", pattern).load(folder)
    return rows.select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def findings_stream(files: DataFrame, rules: list[LineRule]) -> DataFrame:
    """Findings of line rules over a stream of files; no state is kept."""
    return scan(lines_of(files, "path", "text"), rules)
