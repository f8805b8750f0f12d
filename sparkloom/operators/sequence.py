"""Rules that look at several lines: windows over ``lines(file, n, line)`` within a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.line_rules import java


def _file():
    """The lines of a file in order."""
    return Window.partitionBy("file").orderBy("n")


def with_next(lines: DataFrame) -> DataFrame:
    """Lines with the following line (null at the end)."""
    return lines.withColumn("next", F.lead("line").over(_file()))


def without_pagination(lines: DataFrame) -> DataFrame:
    """``file, n``: ``.all()`` that neither this line nor the next one limits."""
    limit = "(?i)(\\[[0-9]*:|\\.first\\(|\\.last\\(|paginat)"
    rows = with_next(lines)
    return rows.where(F.col("line").rlike(java("\\.all\\(\\)")) & ~F.col("line").rlike(limit) & ~F.coalesce(F.col("next").rlike(limit), F.lit(False))).select("file", "n")


def call_in_loop(lines: DataFrame, call: str, loop: str = "^\\s*for\\s", reach: int = 9) -> DataFrame:
    """``file, n, at``: the first line within ``reach`` lines after a loop's head that matches ``call``.

    A window over the following lines, so no line is joined to another.
    """
    after = _file().rowsBetween(1, reach)
    at = F.min(F.when(F.col("line").rlike(java(call)), F.col("n"))).over(after)
    return lines.withColumn("at", at).where(F.col("line").rlike(java(loop)) & F.col("at").isNotNull()).select("file", "n", "at")


def gathered(lines: DataFrame, start: str, lacking: str, reach: int = 4) -> DataFrame:
    """``file, n``: statements that start on a line with ``start`` and lack ``lacking`` up to their first ``)``.

    Up to ``reach`` following lines belong to the statement, the first one with ``)`` included.
    """
    some = F.collect_list("line").over(_file().rowsBetween(0, reach))
    ends = F.filter(F.transform(F.col("some"), lambda x, i: F.when(x.contains(")"), i)), lambda i: i.isNotNull())
    until = F.coalesce(F.get(ends, F.lit(0)), F.lit(reach)) + 1
    rows = lines.withColumn("some", some).where(F.col("line").rlike(java(start)))
    text = F.array_join(F.slice("some", F.lit(1), until), "\n")
    return rows.where(~text.contains(lacking)).select("file", "n")


def statements_lacking(lines: DataFrame, start: str, lacking: tuple[str, ...], reach: int = 4) -> DataFrame:
    """``file, n``: lines with ``start`` that have none of ``lacking``, nor has any following line up to the first of them with ``)``."""
    some = F.collect_list("line").over(_file().rowsBetween(1, reach))
    ends = F.filter(F.transform(F.col("some"), lambda x, i: F.when(x.contains(")"), i)), lambda i: i.isNotNull())
    rows = lines.withColumn("some", some).where(F.col("line").rlike(java(start)))
    text = F.concat("line", F.array_join(F.slice("some", F.lit(1), F.coalesce(F.get(ends, F.lit(0)), F.lit(reach - 1)) + 1), ""))
    for word in lacking:
        rows = rows.where(~text.contains(word))
    return rows.select("file", "n")


def brace_depth(lines: DataFrame, opening: str = "{", closing: str = "}") -> DataFrame:
    """``file, n, depth``: open braces at the end of each line."""
    net = F.length(F.regexp_replace("line", f"[^{opening}]", "")) - F.length(F.regexp_replace("line", f"[^{closing}]", ""))
    return lines.select("file", "n", "line", net.alias("net")).withColumn("depth", F.sum("net").over(_file())).select("file", "n", "depth")


def blocks_lacking(lines: DataFrame, head: str, lacking: str) -> DataFrame:
    """``file, n``: heads whose block, up to the next line at column 0, has no line with ``lacking``."""
    top = F.col("line").rlike("^[^\\t\\n\\f\\r ]")
    rows = lines.withColumn("block", F.max(F.when(top, F.col("n"))).over(_file().rowsBetween(Window.unboundedPreceding, 0)))
    groups = rows.groupBy("file", "block").agg(F.max(F.when(F.col("n") == F.col("block"), F.col("line").rlike(java(head)))).alias("head"), F.max(F.col("line").contains(lacking)).alias("has"))
    return groups.where(F.col("head") & ~F.col("has")).select("file", F.col("block").alias("n"))


def sync_calls_in_async(lines: DataFrame) -> DataFrame:
    """``file, n``: blocking calls within an ``async def``, told by indentation."""
    indent = F.length("line") - F.length(F.ltrim("line"))
    rows = lines.where(F.trim("line") != "").withColumn("indent", indent).withColumn("def_", F.when(F.col("line").rlike(java("^\\s*(async\\s+)?def\\s")), F.struct("indent", F.col("line").rlike(java("^\\s*async\\s+def\\s")).alias("is_async"))))
    rows = rows.withColumn("in_", F.last("def_", ignorenulls=True).over(_file()))
    blocking = F.col("line").rlike(java("requests\\.(get|post|put|delete|patch|head)\\(|open\\(|time\\.sleep\\("))
    return rows.where(F.col("in_.is_async") & (F.col("indent") > F.col("in_.indent")) & blocking).select("file", "n")


def first_of_file(rows: DataFrame, value: Column) -> DataFrame:
    return rows.groupBy("file").agg(F.min(F.struct("n", value.alias("value"))).alias("f")).select("file", "f.n", "f.value")
