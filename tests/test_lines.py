import pytest

from sparkloom.operators import file_rules as X
from sparkloom.operators import line_rules as L
from sparkloom.operators import sequence as Q
from sparkloom.sources.lines import lines_of


def lines(spark, *texts):
    return lines_of(spark.createDataFrame(list(enumerate(texts)), "file int, text string"), "file", "text")


def found(spark, rules, text):
    return sorted(r["category"] for r in L.scan(lines(spark, text), rules).collect())


@pytest.mark.parametrize("text, want", [
    ('apiKey = "abcdefghijkl"', 1), ('password = "hunter22"', 1), ('secret_key: "abcdefgh123"', 1), ('"Bearer abcdefghijklmnopqrstuvwxyz"', 1),
    ('t = "ghp_' + "a1B2" * 9 + '"', 1), ('key = os.getenv("API_KEY")', 0), ('password = "your_password"', 0), ('password = ""', 0),
])
def test_secrets(spark, text, want):
    assert found(spark, L.SECURITY[:1], text) == ["security/hardcoded-secret"] * want


@pytest.mark.parametrize("text, want", [
    ('db.query("select * from t where id=" + x)', 1), ('cursor.execute(f"select {x}")', 1), ("db.query(`select ${x}`)", 1), ('db.execute("select %s" % x)', 1), ('db.execute("select ?", x)', 0), ('db.prepare("select 1")', 0),
])
def test_sql_injection(spark, text, want):
    assert found(spark, L.SECURITY[1:2], text) == ["security/sql-injection"] * want


@pytest.mark.parametrize("text, want", [("subprocess.call(x)", 1), ("os.system(x)", 1), ("run(x, shell=True)", 1), ("child_process.exec(x)", 1), ('exec("ls")', 0)])
def test_command_injection(spark, text, want):
    assert found(spark, L.SECURITY[2:3], text) == ["security/command-injection"] * want


@pytest.mark.parametrize("text, want", [("if true {", ["quality/dead-branch"]), ("if False:", ["quality/dead-branch"]), ("if x {", []), ("catch (e) {}", ["quality/empty-catch"]), ("// TODO: x", ["quality/todo-fixme"]), ('s = "TODO"', [])])
def test_quality(spark, text, want):
    assert found(spark, L.QUALITY, text) == want


def test_file_gates(spark):
    rows = [("a/test_x.py", "assert x"), ("a/x_test.go", 'password = "hunter22"'), ("b/views.py", "SECRET_KEY = 'x'"), ("b/settings.py", "SECRET_KEY = 'x'"), ("b/settings.py", "SECRET_KEY = os.getenv('x')"), ("b/x.py", "assert x"), ("c.py", "yaml.load(f)")]
    frame = spark.createDataFrame([(f, i, t) for i, (f, t) in enumerate(rows)], "file string, n int, line string")
    assert sorted((r["n"], r["category"]) for r in L.scan(frame, L.ALL).collect()) == [(3, "django/hardcoded-settings"), (5, "style/assert-in-production"), (6, "security/insecure-deserialization")]
    numbers = spark.createDataFrame([("a_test.go", 1, "x = 86400"), ("a.go", 1, "x = 86400")], "file string, n int, line string")
    assert [r["file"] for r in L.magic_numbers(numbers).collect()] == ["a.go"]


def test_hints_hold_for_every_match():
    """What a pattern can match holds one of the hints: the registered sources and a few more."""
    import re

    from sparkloom.queries import _CODE

    seen = set()
    for line in [x for _, t in _CODE for x in t.split("\n")] + ["exec(f'x')", "Bearer " + "a" * 20, "cursor.execute('a' +b)", "cors(origin='*')"]:
        for r in L.ALL:
            if r.hints and any(re.search(p, line) for p in r.any_of):
                seen.add(r.category)
                assert any(h in line.lower() for h in r.hints), (r.category, line)
    assert len(seen) >= 14


def test_rules_over_several_lines(spark):
    from sparkloom import queries

    every = queries.code_lines(spark)
    got = sorted((r["category"], r["file"], r["n"]) for rule in (X.django_rules, X.fastapi_rules, X.empty_tests, X.tests_without_assertions, X.empty_except) for r in rule(every).collect())
    assert got == [
        ("django/all-without-pagination", "app/models.py", 14), ("django/fk-missing-on-delete", "app/models.py", 3), ("django/missing-meta-class", "app/models.py", 2), ("django/missing-str-method", "app/models.py", 2), ("django/n+1-in-loop", "app/models.py", 13),
        ("fastapi/async-calling-sync", "api/main.py", 4), ("fastapi/missing-response-model", "api/main.py", 2), ("fastapi/missing-response-model", "api/main.py", 8), ("fastapi/missing-status-code", "api/main.py", 8), ("fastapi/no-api-router", "api/main.py", 1),
        ("quality/empty-catch", "api/load.py", 12), ("test/empty-test", "app/test_views.py", 3), ("test/empty-test", "go/a_test.go", 1), ("test/empty-test", "web/page.test.ts", 1), ("test/no-assertions", "go/a_test.go", 1), ("test/no-assertions", "web/page.test.ts", 1),
    ]
    imports = spark.createDataFrame([("a", "django.db")], "pkg string, imp string")
    assert X.of_framework(X.django_rules(every), imports, "django").count() == 5 and X.of_framework(X.fastapi_rules(every), imports, "fastapi").count() == 0


def test_magic_numbers(spark):
    got = L.magic_numbers(lines(spark, "x = 86400\ny = 200\nconst z = 9999\nw = 42\nv = 0x1234\nu = 404 + 777"))
    assert [(r["n"], r["number"]) for r in got.orderBy("n").collect()] == [(1, "86400"), (6, "777")]


def test_deep_nesting(spark):
    got = L.deep_nesting(lines(spark, "\t" * 6 + "x\n" + "\t" * 6 + "y", "\t\tx")).collect()
    assert [tuple(r) for r in got] == [(0, 1, 6)]


def test_entropy_rule(spark):
    token = "aB3kL9mN2pQr5tUv8wXy1zAcDeFgHiJoKsMqRuTw7Z4"
    assert L.high_entropy_strings(lines(spark, f'k = "{token}"')).count() == 1
    assert L.high_entropy_strings(lines(spark, f'k = "{"a" * 46}"')).count() == 0


def test_word_edges_are_ascii(spark):
    assert L.magic_numbers(lines(spark, "é12345")).count() == 1


def test_windows(spark):
    text = "for x in y:\n  a\n  q.filter(z)\n\nclass A(models.Model):\n  f = ForeignKey(B,\n    null=True)\nclass B(models.Model):\n  class Meta:\n    pass"
    t = lines(spark, text)
    assert [tuple(r) for r in Q.call_in_loop(t, "\\.(filter|get|exclude)\\(").collect()] == [(0, 1, 3)]
    assert [tuple(r) for r in Q.gathered(t, "(ForeignKey|OneToOneField)\\(", "on_delete=").collect()] == [(0, 6)]
    assert [tuple(r) for r in Q.blocks_lacking(t, "class\\s+[A-Za-z]+\\(.*models\\.Model", "class Meta").collect()] == [(0, 5)]
    assert [r["depth"] for r in Q.brace_depth(lines(spark, "{\n{ }\n}")).orderBy("n").collect()] == [1, 1, 0]
    assert [r["n"] for r in Q.without_pagination(lines(spark, "a.all()\n\nb.all()[:5]\nc.all()\n x = paginate(c)")).collect()] == [1]
    code = "async def f():\n    time.sleep(1)\ndef g():\n    time.sleep(1)"
    assert [r["n"] for r in Q.sync_calls_in_async(lines(spark, code)).collect()] == [2]


def test_null_and_empty_texts(spark):
    assert lines(spark, None).count() == 0 and lines(spark, "").count() == 1
