"""Line rules: regular expressions over numbered lines, in one scan for any number of rules.

Patterns are written in the common subset of regular expressions; ``java`` gives the
form in which the JVM treats white space and word boundaries as ASCII.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.scalars import entropy, is_test_file, last_segment

SPACE = "[\\t\\n\\f\\r ]"
_WORD = "[0-9A-Za-z_]"
_EDGE = f"(?:(?<!{_WORD})(?={_WORD})|(?<={_WORD})(?!{_WORD}))"


def java(pattern: str) -> str:
    return pattern.replace("\\b", _EDGE).replace("\\s", SPACE)


@dataclass(frozen=True)
class LineRule:
    """``any_of``: one must match; ``none_of``: none may. ``lower_none``: words that the lower-cased line must not hold.

    ``hints``: every match holds one of these in lower case, so other lines need no pattern.
    ``files``: "source" for files that are no tests, "settings" for settings.py.
    """

    category: str
    any_of: tuple[str, ...]
    none_of: tuple[str, ...] = ()
    lower_none: tuple[str, ...] = ()
    hints: tuple[str, ...] = ()
    files: str = ""

    def on(self, line: Column, file: Column | None = None) -> Column:
        out = F.lit(False)
        for p in self.any_of:
            out = out | line.rlike(java(p))
        if self.hints:
            out = reduce(lambda a, b: a | b, [F.lower(line).contains(h) for h in self.hints]) & out
        if file is not None and self.files == "source":
            out = ~is_test_file(file) & out
        elif file is not None and self.files == "settings":
            out = (last_segment(file) == "settings.py") & out
        for p in self.none_of:
            out = out & ~line.rlike(java(p))
        for w in self.lower_none:
            out = out & ~F.lower(line).contains(w)
        return out

    def sql(self, line: str = "line", file: str = "file") -> str:
        def quoted(p: str) -> str:
            return "'" + p.replace("\\s", SPACE).replace("'", "''") + "'"

        some = " or ".join(f"regexp_matches({line}, {quoted(p)})" for p in self.any_of)
        base = f"regexp_extract(cast({file} as varchar), '[^/]*$')"
        gate = {"source": [f"not regexp_matches({base}, '_test\\.go$|^test_|\\.test\\.|\\.spec\\.|_test\\.py')"], "settings": [f"{base} = 'settings.py'"]}.get(self.files, [])
        return " and ".join(gate + [f"({some})"] + [f"not regexp_matches({line}, {quoted(p)})" for p in self.none_of] + [f"not contains(lower({line}), '{w}')" for w in self.lower_none])


#: Words that tell a placeholder from a secret.
PLACEHOLDERS = ("your_", "xxx", "placeholder", "example", "changeme", "todo", "<your", "dummy", "test", "fake", "sample")

_COMMENT = "^\\s*(//|#|/\\*|\\*)"

#: Patterns of the security rules.
SECURITY = [
    LineRule("security/hardcoded-secret", (
        "(?i)(api[_-]?key|apikey)\\s*[:=]\\s*[\"'][^\"']{8,}", "(?i)(secret[_-]?key|secretkey)\\s*[:=]\\s*[\"'][^\"']{8,}",
        "(?i)(password|passwd|pwd)\\s*[:=]\\s*[\"'][^\"']{4,}", "(?i)(access[_-]?token|auth[_-]?token)\\s*[:=]\\s*[\"'][^\"']{8,}",
        "(?i)(private[_-]?key)\\s*[:=]\\s*[\"'][^\"']{8,}", "(?i)(client[_-]?secret)\\s*[:=]\\s*[\"'][^\"']{8,}",
        "(?i)bearer\\s+[a-zA-Z0-9._-]{20,}", "(?i)ghp_[a-zA-Z0-9]{36}", "(?i)sk-[a-zA-Z0-9]{20,}", "AKIA[0-9A-Z]{16}",
    ), lower_none=PLACEHOLDERS, hints=("key", "pass", "pwd", "token", "secret", "bearer", "ghp_", "sk-", "akia"), files="source"),
    LineRule("security/sql-injection", (
        "(?i)(execute|query|raw)\\s*\\(\\s*f[\"']", "(?i)(execute|query|raw)\\s*\\([^)]*\\+", "(?i)(execute|query|raw)\\s*\\(\\s*`[^`]*\\$\\{",
        "(?i)(execute|query|raw)\\s*\\(\\s*[\"'].*%s", "(?i)\\.format\\s*\\([^)]*\\)\\s*\\)",
    ), hints=("execute", "query", "raw", ".format")),
    LineRule("security/command-injection", (
        "(?i)exec\\s*\\(\\s*f[\"']", "(?i)exec\\s*\\(\\s*`[^`]*\\$\\{", "(?i)(subprocess\\.call|subprocess\\.Popen|os\\.system)\\s*\\(",
        "(?i)shell\\s*[:=]\\s*True", "(?i)child_process\\.(exec|execSync)\\s*\\(",
    ), hints=("exec", "subprocess", "os.system", "shell")),
    LineRule("security/xss", ("\\.innerHTML.*=|=.*\\.innerHTML",), hints=("innerhtml",)),
    LineRule("security/insecure-deserialization", ("(?i)eval\\s*\\([^\"'][^)]*\\)", "(?i)pickle\\.loads?\\s*\\(", "(?i)yaml\\.unsafe_load\\s*\\(", "(?i)marshal\\.loads?\\s*\\("), hints=("eval", "pickle", "yaml", "marshal")),
    LineRule("security/insecure-deserialization", ("(?i)yaml\\.load\\s*\\([^)]*\\)",), ("(?i)yaml\\.load\\s*\\([^)]*Loader\\s*=",), hints=("yaml",)),
    LineRule("security/cors-wildcard", ("(?i)allow.?origin.*['\"]\\*['\"]", "(?i)cors.*origin.*['\"]\\*['\"]", "(?i)allow_origins.*\\[.*['\"]\\*['\"]"), hints=("origin",)),
    LineRule("security/next-public-secret", ("(?i)process\\.env\\.NEXT_PUBLIC_[A-Z_]*(SECRET|KEY|TOKEN|PASSWORD|PRIVATE|CREDENTIAL)[A-Z_]*",), hints=("next_public_",)),
]

#: Patterns of the quality rules that look at one line.
QUALITY = [
    LineRule("quality/todo-fixme", ("^\\s*(//|#|/\\*|\\*).*(?i:\\b(TODO|FIXME|HACK|XXX)\\b)",), hints=("todo", "fixme", "hack", "xxx")),
    LineRule("quality/dead-branch", ("\\bif\\s+(true|false)\\s*[{:]", "\\bif\\s+(True|False)\\s*:"), hints=("true", "false")),
    LineRule("quality/empty-catch", ("catch\\s*\\([^)]*\\)\\s*\\{\\s*\\}",), hints=("catch",)),
]

#: Patterns of the Django rules that look at one line.
DJANGO = [
    LineRule("django/raw-sql-no-params", ("\\.raw\\(f\"", "\\.raw\\(f'", "\\.raw\\(\"[^\"]*%s", "\\.raw\\('[^']*%s", "cursor\\.execute\\(f\"", "cursor\\.execute\\(f'", "execute\\(\"[^\"]*\"\\s*\\+", "execute\\('[^']*'\\s*\\+"), hints=(".raw(", "execute(")),
    LineRule("django/hardcoded-settings", ("SECRET_KEY\\s*=\\s*[\"']", "(?i)DATABASE.*[\"']postgres", "(?i)DATABASE.*[\"']mysql", "(?i)PASSWORD\\s*[\"']:\\s*[\"'][^\"']+[\"']"), ("os\\.environ|os\\.getenv|env\\(",), hints=("secret_key", "database", "password"), files="settings"),
]

#: Patterns of the FastAPI rules that look at one line.
FASTAPI = [
    LineRule("fastapi/raw-dict-input", ("def\\s+[0-9A-Za-z_]+\\([^)]*:\\s*(dict|Dict)\\b",), hints=("dict",)),
    LineRule("fastapi/hardcoded-cors-wildcard", ("allow_origins\\s*=\\s*\\[[\"']\\*[\"']\\]",), hints=("allow_origins",)),
]

#: Patterns of the Python rules that look at one line.
PYTHON = [
    LineRule("style/type-vs-isinstance", ("type\\s*\\([^)]+\\)\\s*(==|is)\\s*",), (_COMMENT,), hints=("type",)),
    LineRule("style/missing-context-manager", ("\\bopen\\s*\\(",), ("^\\s*with\\s", "^\\s*#"), hints=("open",)),
    LineRule("style/is-for-value", ("\\bis\\b(?:\\s+not)?\\s+(?:\"[^\"]*\"|'[^']*'|[0-9]+)",), (_COMMENT, "\\bis\\s+None\\b", "\\bis\\s+not\\s+None\\b")),
    LineRule("style/assert-in-production", ("^\\s*assert\\b",), hints=("assert",), files="source"),
]

ALL = SECURITY + QUALITY + DJANGO + FASTAPI + PYTHON

#: Numbers that need no name.
ALLOWED_NUMBERS = ("100", "200", "201", "204", "400", "401", "403", "404", "500", "1000", "1024")


def scan(lines: DataFrame, rules: list[LineRule]) -> DataFrame:
    """``file, n, category`` for every line and rule that match; one finding per line and category."""
    file = F.col("file").cast("string")
    found = F.array_distinct(F.filter(F.array(*[F.when(r.on(F.col("line"), file), F.lit(r.category)) for r in rules]), lambda c: c.isNotNull()))
    return lines.select("file", "n", F.explode(found).alias("category"))


def high_entropy_strings(lines: DataFrame, least: float = 4.5) -> DataFrame:
    """``file, n, string, bits`` of quoted runs of 40 or more characters with more entropy than ``least``, test files left out."""
    lines = lines.where(~is_test_file(F.col("file").cast("string")))
    runs = F.regexp_extract_all("line", F.lit("[\"']([A-Za-z0-9+/=_-]{40,})[\"']"), F.lit(1))
    rows = lines.select("file", "n", F.explode(runs).alias("string")).withColumn("bits", entropy(F.col("string")))
    return rows.where(F.col("bits") > least)


def magic_numbers(lines: DataFrame) -> DataFrame:
    """``file, n, number``: the first telling number of three or more digits on a line, test files left out."""
    lines = lines.where(~is_test_file(F.col("file").cast("string")))
    edge = "(?<![0-9A-Za-z_])[0-9]{3,}(?![0-9A-Za-z_])"
    found = F.filter(F.regexp_extract_all("line", F.lit(edge), F.lit(0)), lambda m: ~m.isin(*ALLOWED_NUMBERS))
    skip = F.col("line").rlike(f"^{SPACE}*(const|#|//|/\\*|\\*)") | F.col("line").contains("0x")
    return lines.where(~skip).select("file", "n", F.get(found, F.lit(0)).alias("number")).where("number is not null")


def deep_nesting(lines: DataFrame, limit: int = 5) -> DataFrame:
    """``file, n, depth``: the first of the deepest lines of a file, if deeper than ``limit``. A tab or four spaces are a level."""
    indent = F.regexp_extract("line", "^[\\t ]*", 0)
    depth = F.length(F.regexp_replace(indent, " ", "")) + F.floor(F.length(F.regexp_replace(indent, "\\t", "")) / 4).cast("int")
    rows = lines.where(F.trim(F.translate("line", "\t", " ")) != "").select("file", "n", depth.alias("depth"))
    best = rows.groupBy("file").agg(F.max(F.struct("depth", (-F.col("n")).alias("m"))).alias("b"))
    return best.select("file", (-F.col("b.m")).alias("n"), F.col("b.depth").alias("depth")).where(F.col("depth") > limit)


def line_numbers_of(text: Column, pattern: str) -> Column:
    """Line of the first match of a pattern that may span lines; null without a match."""
    at = F.regexp_instr(text, F.lit(java(pattern)))
    return F.when(at > 0, F.size(F.split(F.substring(text, F.lit(1), at), "\n", -1)))
