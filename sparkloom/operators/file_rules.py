"""Rules that depend on what a file is: tests, Django and FastAPI sources, and rules over several lines with their categories.

All of them take ``lines(file, n, line)`` and give ``file, n, category``. A rule of a
framework counts only where the code imports it (:func:`of_framework`).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.scalars import is_test_file, last_segment
from sparkloom.operators import sequence
from sparkloom.operators.line_rules import java

#: What tells an assertion, and a test, in a file.
ASSERTIONS = ("assert", "Assert", "expect(", "require.", "t.Error", "t.Fatal", "t.Fail", "should.", "toBe(", "toEqual(", "toMatch(", "toThrow(", "toHaveBeenCalled", "toContain(")
TESTS = ("func Test", "def test_", "it(", "test(", "describe(")
#: Patterns of heads of the rules over several lines.
MODEL = "class\\s+[0-9A-Za-z_]+\\(.*models\\.Model"
FOREIGN_KEY = "(ForeignKey|OneToOneField)\\("
ORM_CALL = "\\.(filter|get|exclude)\\("
ROUTE = "@(app|router)\\.(get|post|put|delete|patch)\\("
MUTATING = "@(app|router)\\.(post|put|delete|patch)\\("
#: Routes on the application itself from which a router is asked for.
APP_ROUTES = 3


def _trimmed() -> Column:
    return F.regexp_replace("line", "^[\\t\\n\\f\\r ]+|[\\t\\n\\f\\r ]+$", "")


def _some(column: str, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(column).contains(w) for w in words])


def _named(rows: DataFrame, category: str) -> DataFrame:
    return rows.select("file", "n", F.lit(category).alias("category"))


def django_rules(lines: DataFrame) -> DataFrame:
    """Queries in loops, models without Meta or __str__, foreign keys without on_delete, unlimited ``.all()``."""
    loops = sequence.call_in_loop(lines, ORM_CALL).select("file", F.col("at").alias("n")).distinct()
    out = [_named(loops, "django/n+1-in-loop"), _named(sequence.without_pagination(lines), "django/all-without-pagination"), _named(sequence.statements_lacking(lines, FOREIGN_KEY, ("on_delete=",)), "django/fk-missing-on-delete")]
    out += [_named(sequence.blocks_lacking(lines, MODEL, word), f"django/{name}") for name, word in (("missing-meta-class", "class Meta"), ("missing-str-method", "def __str__"))]
    return reduce(DataFrame.union, out)


def fastapi_rules(lines: DataFrame) -> DataFrame:
    """Routes without response model or status code, blocking calls in coroutines, files that route on the application alone."""
    app, router = (F.count(F.when(F.col("line").rlike(f"@{x}\\.(get|post|put|delete|patch)\\("), 1)) for x in ("app", "router"))
    alone = lines.groupBy("file").agg(app.alias("a"), router.alias("r")).where((F.col("a") >= APP_ROUTES) & (F.col("r") == 0)).select("file", F.lit(1).alias("n"))
    out = [_named(alone, "fastapi/no-api-router"), _named(sequence.sync_calls_in_async(lines), "fastapi/async-calling-sync")]
    out += [_named(sequence.statements_lacking(lines, head, (f"{word}=", f"{word} =")), f"fastapi/{name}") for name, head, word in (("missing-response-model", ROUTE, "response_model"), ("missing-status-code", MUTATING, "status_code"))]
    return reduce(DataFrame.union, out)


def of_framework(findings: DataFrame, imports: DataFrame, name: str) -> DataFrame:
    """``findings`` if any of ``imports(imp)`` names the framework, else none."""
    used = imports.where(F.col("imp").contains(name)).select(F.lit(1).alias("_used")).limit(1)
    return findings.withColumn("_used", F.lit(1)).join(used, "_used", "left_semi").drop("_used")


def empty_tests(lines: DataFrame) -> DataFrame:
    """Heads of tests without a body, in test files: a colon and ``pass``, ``...`` or nothing on the next line, or braces that close within ten lines with the head as their only statement."""
    file, by = F.col("file").cast("string"), Window.partitionBy("file").orderBy("n")
    rows = lines.where(is_test_file(file)).withColumn("t", _trimmed())
    rows = rows.withColumn("next", F.lead("t").over(by)).withColumn("some", F.collect_list("t").over(by.rowsBetween(0, 9)))
    script = file.rlike("\\.(ts|tsx|js|jsx)$")
    head = (file.endswith(".go") & F.col("t").startswith("func Test") & F.col("t").contains("(t *testing.T)")) | (file.endswith(".py") & F.col("t").startswith("def test_")) | (script & (F.col("t").contains("it(") | F.col("t").contains("test(")))
    colon = F.col("t").endswith(":") & F.col("next").isin("pass", "...", "")
    # open braces, whether one was seen, statements and, once the braces close, the answer
    start = F.struct(F.lit(0).alias("open"), F.lit(False).alias("seen"), F.lit(0).alias("statements"), F.lit(None).cast("boolean").alias("empty"))

    def step(s: Column, t: Column) -> Column:
        opened = s["open"] + F.length(F.regexp_replace(t, "[^{]", "")) - F.length(F.regexp_replace(t, "[^}]", ""))
        seen = s["seen"] | t.contains("{")
        said = s["statements"] + F.when(seen & (opened > 0) & ~t.isin("", "{", "}") & ~t.startswith("//"), 1).otherwise(0)
        return F.struct(opened.alias("open"), seen.alias("seen"), said.alias("statements"), F.coalesce(s["empty"], F.when(seen & (opened == 0), said <= 1)).alias("empty"))

    braces = F.aggregate("some", start, step)["empty"]
    return _named(rows.where(head & (colon | F.coalesce(braces, F.lit(False)))), "test/empty-test")


def tests_without_assertions(lines: DataFrame) -> DataFrame:
    """Test files that have a test and no assertion; their first line."""
    rows = lines.where(is_test_file(F.col("file").cast("string"))).groupBy("file").agg(F.max(_some("line", TESTS)).alias("tests"), F.max(_some("line", ASSERTIONS)).alias("asserts"))
    return _named(rows.where(F.col("tests") & ~F.col("asserts")).select("file", F.lit(1).alias("n")), "test/no-assertions")


def packages_without_tests(files: DataFrame) -> DataFrame:
    """``pkg, category`` of packages with source files and no test file, from ``files(pkg, file)``."""
    test = is_test_file(F.col("file").cast("string"))
    rows = files.where("file is not null and file <> ''").groupBy("pkg").agg(F.max(test).alias("tested"))
    return rows.where(~F.col("tested")).select("pkg", F.lit("test/missing-tests").alias("category"))


def empty_except(lines: DataFrame) -> DataFrame:
    """An ``except`` whose ``pass`` ends the file."""
    by = Window.partitionBy("file").orderBy("n")
    rows = lines.withColumn("t", _trimmed()).where("t <> ''").withColumn("next", F.lead("t").over(by)).withColumn("then", F.lead("t", 2).over(by))
    return _named(rows.where(F.col("t").rlike(java("except.*:$")) & (F.col("next") == "pass") & F.col("then").isNull()), "quality/empty-catch")


def settings_file(file: Column) -> Column:
    return last_segment(file) == "settings.py"
