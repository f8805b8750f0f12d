"""Go and TypeScript rules: filters and counts over the tables of ``sources.brace_source``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def table(rows: DataFrame, name: str) -> DataFrame:
    """Exploded array of the parsed files, with ``path``, ``pkg`` and the package's name as ``package``."""
    return rows.select("path", "pkg", F.col("name").alias("package"), F.explode(name).alias("x")).select("path", "pkg", "package", "x.*")


def _found(rows: DataFrame, category: str) -> DataFrame:
    return rows.select(F.col("path").alias("file"), F.col("line").alias("n"), F.lit(category).alias("category"))


def _types(params: Column) -> Column:
    return F.transform(params, lambda p: p["type"])


def check_go(rows: DataFrame, params: int = 5, returns: int = 2, methods: int = 15, length: int = 60, cognitive: int = 15, cyclomatic: int = 10) -> DataFrame:
    """``file, n, category`` of the Go rules on signatures, names, sizes and statements."""
    f, t = table(rows, "functions"), table(rows, "types")
    kinds = _types(F.col("params"))
    is_error = F.transform("results", lambda r: r == "error")
    tests = F.col("path").endswith("_test.go")
    conditions = {
        "complexity/too-many-params": F.size("params") > params,
        "complexity/too-many-returns": F.size("results") > returns,
        "complexity/bool-params": F.col("exported") & (F.size(F.filter(kinds, lambda k: k == "bool")) >= 2),
        "complexity/long-function": F.col("end_line") - F.col("line") > length,
        "complexity/cognitive": F.col("cognitive") > cognitive,
        "complexity/cyclomatic": F.col("cyclomatic") > cyclomatic,
        "style/context-first-param": F.exists(F.slice(kinds, F.lit(2), F.greatest(F.size(kinds), F.lit(1))), lambda k: k == "context.Context"),
        "style/error-last-return": F.exists(F.slice(is_error, F.lit(1), F.greatest(F.size(is_error) - 1, F.lit(0))), lambda e: e),
        "style/empty-interface": F.exists("params", lambda p: (p["name"] != "") & p["type"].isin("any", "interface{}")),
        "naming/underscore": ~tests & F.substring("name", 2, 1000).contains("_"),
        "naming/stutter": (F.col("receiver") == "") & F.col("exported") & (F.length("name") > F.length("package")) & F.startswith(F.lower("name"), F.lower("package")),
    }
    out = [_found(f.where(c), k) for k, c in conditions.items()]
    only = F.get("methods", F.lit(0))
    out.append(_found(t.where((F.col("kind") == "interface") & (F.size("methods") == 1) & ~F.startswith("name", only)), "naming/interface"))
    out.append(_found(t.where(F.substring("name", 2, 1000).contains("_") & ~tests), "naming/underscore"))
    big = f.where("receiver <> ''").groupBy("pkg", "receiver").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("path", "line")).alias("at")).where(F.col("k") > methods)
    out.append(big.select(F.col("at.path").alias("file"), F.col("at.line").alias("n"), F.lit("complexity/god-type").alias("category")))
    fields = t.where("kind = 'struct'").select("pkg", F.col("name").alias("receiver"), F.explode("fields").alias("x")).select("pkg", "receiver", F.lower("x.name").alias("field")).distinct()
    verb = F.lower(F.regexp_replace("name", "^(Get|get)", ""))
    getters = f.where(F.col("name").rlike("^Get.") & (F.size("params") == 0) & (F.size("results") >= 1)).withColumn("field", verb)
    out.append(_found(getters.join(fields, ["pkg", "receiver", "field"], "left_semi"), "naming/redundant-getter"))
    flags = table(rows, "flags").select(F.col("path").alias("file"), F.col("line").alias("n"), "category")
    return reduce(DataFrame.union, [*out, flags])


def check_typescript(rows: DataFrame) -> DataFrame:
    """``file, n, category`` of the TypeScript rules on signatures, types and statements."""
    f, t = table(rows, "functions"), table(rows, "types")
    out = [
        _found(f.where(F.col("signature").rlike(r":\s?any\b")), "style/any-type"),
        _found(f.where(F.col("signature").rlike(r"!\.|!\)")), "style/non-null-assertion"),
        _found(f.where(F.col("exported") & (F.col("receiver") == "") & (F.size("results") == 0)), "style/missing-return-type"),
        _found(t.where((F.col("kind") == "interface") & F.col("name").rlike("^I[A-Z]")), "naming/interface-prefix"),
        _found(t.where(F.exists("fields", lambda x: x["type"].rlike(r"^any\b"))), "style/any-type"),
        table(rows, "flags").select(F.col("path").alias("file"), F.col("line").alias("n"), "category"),
    ]
    return reduce(DataFrame.union, out)
