"""Confidence of findings: noisy-or over the signals of their category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.scalars import confidence_label, noisy_or

#: Signals by category; categories that are not listed have 0.3.
SIGNALS: dict[str, list[float]] = {
    "error-handling/unchecked": [0.7, 0.4], "error-handling": [0.4], "naming/stutter": [0.7, 0.5], "naming/underscore": [0.7, 0.5],
    "naming/redundant-getter": [0.4, 0.5], "naming/interface": [0.3, 0.2], "naming": [0.3], "style/context-first-param": [0.6, 0.5],
    "style/error-last-return": [0.6, 0.5], "style/unnecessary-else": [0.6, 0.5], "style/naked-return": [0.5, 0.4], "style/empty-interface": [0.3, 0.2],
    "arch/concrete-return": [0.2], "complexity/cognitive": [0.6, 0.5], "complexity/cyclomatic": [0.6, 0.5], "complexity/god-type": [0.6, 0.4],
    "complexity/too-many-params": [0.6], "complexity/too-many-returns": [0.6], "complexity/bool-params": [0.6], "complexity/long-function": [0.6],
}
DEFAULT = [0.3]

#: Signals of design patterns.
PATTERNS: dict[str, list[float]] = {"middleware": [0.5, 0.4], "decorator": [0.5, 0.4, 0.3], "factory": [0.5, 0.3], "builder": [0.5, 0.4], "singleton": [0.6, 0.4]}


def signals_of(category: Column) -> Column:
    out = F.array(*[F.lit(x) for x in DEFAULT])
    for name, values in SIGNALS.items():
        out = F.when(category == name, F.array(*[F.lit(x) for x in values])).otherwise(out)
    return out


def scored(findings: DataFrame) -> DataFrame:
    """Findings with ``confidence`` (four digits) and its ``label``."""
    score = F.round(noisy_or(signals_of(F.col("category"))), 4)
    return findings.withColumn("confidence", score).withColumn("label", confidence_label(score))


def summary(findings: DataFrame) -> DataFrame:
    """``category, label, n, files`` of scored findings."""
    return scored(findings).groupBy("category", "confidence", "label").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file").alias("files"))
