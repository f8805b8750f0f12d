"""Python rules over the model tables: filters and joins on syntax nodes, functions, types and imports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.sources.config import Thresholds
from sparkloom.sources.python_source import Model


def _found(rows: DataFrame, category: str, line: str = "start_line") -> DataFrame:
    return rows.select(F.col("path").alias("file"), F.col(line).cast("int").alias("n"), F.lit(category).alias("category"))


def bare_except(m: Model) -> DataFrame:
    typed = m.nodes.where("field = 'type'").select("path", F.col("parent").alias("id"))
    return _found(m.nodes.where("kind = 'ExceptHandler'").join(typed, ["path", "id"], "left_anti"), "style/bare-except")


def mutable_default(m: Model) -> DataFrame:
    rows = m.nodes.where(F.col("field").isin("defaults", "kw_defaults") & F.col("kind").isin("List", "Dict", "Set"))
    return _found(rows, "style/mutable-default")


def global_statement(m: Model) -> DataFrame:
    return _found(m.nodes.where("kind = 'Global'"), "style/global-statement")


def missing_type_hint(m: Model) -> DataFrame:
    hinted = m.nodes.where("field = 'returns'").select("path", F.col("parent").alias("id"))
    rows = m.nodes.where(F.col("kind").isin("FunctionDef", "AsyncFunctionDef") & ((F.col("name") == "__init__") | ~F.col("name").startswith("_")) & (F.col("name") != "__init__"))
    return _found(rows.join(hinted, ["path", "id"], "left_anti"), "style/missing-type-hint")


def mutable_class_attribute(m: Model) -> DataFrame:
    classes = m.nodes.where("kind = 'ClassDef'").select("path", F.col("id").alias("class_"))
    assigns = m.nodes.where("kind = 'Assign' and field = 'body'").select("path", F.col("parent").alias("class_"), "id", "start_line").join(classes, ["path", "class_"])
    values = m.nodes.where(F.col("field").eqNullSafe("value") & (F.col("kind").isin("List", "Dict", "Set") | (F.col("text") == "set()"))).select("path", F.col("parent").alias("id"))
    return _found(assigns.join(values, ["path", "id"], "left_semi"), "style/mutable-class-attr")


def names(m: Model) -> DataFrame:
    camel = m.functions.where(F.col("name").rlike("^[a-z]+[A-Z]"))
    inner = m.types.where(F.col("name").rlike("^[A-Za-z0-9]+_"))
    return _found(camel, "naming/pep8-function", "line").union(_found(inner, "naming/pep8-class", "line"))


def star_imports(m: Model) -> DataFrame:
    return _found(m.imports.where("star"), "style/star-import", "line")


def complexity(m: Model, t: Thresholds = Thresholds()) -> DataFrame:
    """Too many parameters, long functions, cognitive and cyclomatic complexity above their limits."""
    f = m.functions
    own = F.size(F.filter("params", lambda p: ~p.isin("self", "cls")))
    kinds = {"complexity/too-many-params": own > t.max_params, "complexity/long-function": F.col("end_line") - F.col("line") > t.func_max_lines, "complexity/cognitive": F.col("cognitive") > t.max_cognitive_complexity, "complexity/cyclomatic": F.col("cyclomatic") > t.max_cyclomatic_complexity}
    return reduce(DataFrame.union, [_found(f.where(cond), name, "line") for name, cond in kinds.items()])


RULES = [bare_except, mutable_default, global_statement, missing_type_hint, mutable_class_attribute, names, star_imports]


def check(m: Model, t: Thresholds = Thresholds()) -> DataFrame:
    """``file, n, category`` of all rules, each node once."""
    return reduce(DataFrame.union, [*[rule(m) for rule in RULES], complexity(m, t)])


def entry_points(m: Model) -> DataFrame:
    """``fq, kind, decorator``: http, task and cli handlers by their decorators; the first kind wins."""
    rows = m.functions.select("fq", F.posexplode("uses").alias("k", "decorator"))
    kind = (
        F.when(F.col("decorator").rlike(r"\.(get|post|put|delete|patch|route|websocket|api_view)\b|^api_view"), "http")
        .when(F.col("decorator").rlike(r"(^|\.)(task|shared_task|periodic_task|job)\b"), "task")
        .when(F.col("decorator").rlike(r"(^|\.)(command|group|callback)\b"), "cli")
    )
    rows = rows.withColumn("kind", kind).where("kind is not null")
    return rows.groupBy("fq").agg(F.min(F.struct("k", "kind", "decorator")).alias("b")).select("fq", "b.kind", "b.decorator")
