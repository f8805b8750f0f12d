import json

import pytest

from sparkloom.operators import python_rules as P
from sparkloom.report import Options, analyze, to_json, to_text
from sparkloom.sources.config import Config, Thresholds, load, write_template
from sparkloom.sources.lines import detect_language, source_files
from sparkloom.sources.python_source import Model

CODE = '''import requests
from os import *
from .b import helper

LIMIT = 86400

class Bad_name(Base):
    items = []
    def __init__(self):
        self.x = {}
    def go(self):
        self.stop()
        return helper()

@app.get("/x")
def doThing(a, b=[], c={}, d=1, e=2, f=3) -> int:
    global LIMIT
    try:
        helper()
    except:
        pass
    return len([])

def plain(x):
    if x and x > 1 or x < 0:
        for i in x:
            while i:
                pass
    return x
'''


@pytest.fixture(scope="module")
def model(spark):
    rows = [("a.py", "pkg.a", CODE), ("b.py", "pkg.b", "def helper():\n    return 1\n"), ("c.py", "pkg.c", "def ("), ("d.py", "pkg.d", None)]
    return Model.of(spark.createDataFrame(rows, "path string, module string, text string"))


def test_tables(model):
    f = {r["name"]: r for r in model.functions.collect()}
    assert set(f) == {"doThing", "plain", "helper"} and f["plain"]["cyclomatic"] == 6 and f["plain"]["cognitive"] == 8
    assert f["doThing"]["uses"] == ["app.get('/x')"] and f["doThing"]["returns"] == "int"
    t = model.types.first()
    assert t["methods"] == ["__init__", "go"] and [(x["name"], x["type"]) for x in t["fields"]] == [("x", "dict")]
    assert ("pkg.a.Bad_name.go", "pkg.a.stop") in {tuple(r) for r in model.calls.collect()}
    assert model.rows.where("error is not null").count() == 1


def test_rules(model):
    got = sorted((r["category"], r["n"]) for r in P.check(model).collect())
    assert got == [
        ("complexity/too-many-params", 16), ("naming/pep8-class", 7), ("naming/pep8-function", 16), ("style/bare-except", 20), ("style/global-statement", 17),
        ("style/missing-type-hint", 1), ("style/missing-type-hint", 11), ("style/missing-type-hint", 24), ("style/mutable-class-attr", 8),
        ("style/mutable-default", 16), ("style/mutable-default", 16), ("style/star-import", 2),
    ]
    assert [(r["fq"], r["kind"]) for r in P.entry_points(model).collect()] == [("pkg.a.doThing", "http")]


def test_report(model):
    sections = analyze(model)
    assert sections["summary"].first()["functions"] == 3
    assert "findings" in json.loads(to_json({k: sections[k] for k in ("findings", "boundaries")})) and "## summary" in to_text({"summary": sections["summary"]})
    assert [r["kind"] for r in sections["boundaries"].collect()] == ["http-client"]
    with pytest.raises(ValueError):
        Options(format="xml")
    assert Thresholds().merged({"max_params": 9, "func_max_lines": 0, "other": 3}) == Thresholds(max_params=9)
    assert set(analyze(model, Options(structure_only=True, packages=["pkg.b"]))) == {"structure"}


def test_files(spark, tmp_path):
    for name in ("a.py", "b.py", "venv/x.py", ".git/y.py", "sub/c.py"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x = 1\n")
    files = source_files(spark, str(tmp_path))
    assert sorted(r["path"].rsplit("/", 1)[1] for r in files.collect()) == ["a.py", "b.py", "c.py"]
    assert detect_language(files).first()["language"] == "python"


def test_stream(spark, tmp_path):
    from sparkloom.operators.line_rules import SECURITY
    from sparkloom.streaming import file_stream, findings_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.py").write_text("os.system(x)\nok\n")
    q = findings_stream(file_stream(spark, str(tmp_path / "in")), SECURITY).writeStream.format("memory").queryName("found").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(60)
    assert [(r["n"], r["category"]) for r in spark.sql("select * from found").collect()] == [(1, "security/command-injection")]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())


def test_config(model, tmp_path):
    path = tmp_path / "c.yaml"
    write_template(str(path))
    with pytest.raises(FileExistsError):
        write_template(str(path))
    assert load(str(path)).thresholds == Thresholds() and load(str(path)).allowed == {"service": ["store"], "store": []}
    layered = Config([("a", ["pkg.a"]), ("b", ["pkg.b"])], {"a": ["b"], "b": []})
    assert analyze(model, Options(config=layered))["layer_violations"].count() == 0
