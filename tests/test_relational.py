from sparkloom.operators import relational as R
from sparkloom.operators import score as C


def calls(spark, rows):
    frame = spark.createDataFrame(rows, "src string, dst string")
    return R.with_packages(frame, spark.createDataFrame([], "fq string, pkg string"))


def test_feature_envy(spark):
    assert R.feature_envy(calls(spark, [("a.F", f"b.G{i}") for i in range(4)])).first()["envied"] == "b"
    own = [("a.F", f"a.H{i}") for i in range(3)] + [("a.F", "b.G")]
    assert R.feature_envy(calls(spark, own)).count() == 0


def test_shotgun_surgery(spark):
    assert R.shotgun_surgery(calls(spark, [(f"p{i % 3}.F{i}", "a.T") for i in range(6)])).count() == 1
    assert R.shotgun_surgery(calls(spark, [("a.F1", "a.T"), ("a.F2", "a.T")])).count() == 0


def test_middle_man(spark):
    base = [("b.X", "a.Mid"), ("c.Y", "a.Mid")]
    assert R.middle_man(calls(spark, [*base, ("a.Mid", "d.Work")])).count() == 1
    assert R.middle_man(calls(spark, [*base, ("a.Mid", "d.Work"), ("a.Mid", "d.More")])).count() == 0
    assert R.middle_man(calls(spark, [("b.X", "a.NewMid"), ("c.Y", "a.NewMid"), ("a.NewMid", "d.Work")])).count() == 0
    assert R.middle_man(calls(spark, [("a.X", "a.Mid"), ("a.Y", "a.Mid"), ("a.Mid", "a.Work")])).count() == 0


def test_god_package(spark):
    names = ["g"] + [f"p{i}" for i in range(5)]
    pk = spark.createDataFrame([(n,) for n in names], "pkg string")
    im = spark.createDataFrame([("g", f"p{i}") for i in range(5)], "pkg string, imp string")
    ty = spark.createDataFrame([("g", "struct")], "pkg string, kind string")
    assert [r["pkg"] for r in R.god_packages(calls(spark, [(f"p{i}.F", "g.T") for i in range(5)]), im, pk, ty).collect()] == ["g"]


def test_coupling(spark):
    pk = spark.createDataFrame([("a",), ("b",), ("c",)], "pkg string")
    im = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "x.y"), ("c", "b"), ("b", "b")], "pkg string, imp string")
    got = {r["pkg"]: (r["ca"], r["ce"], r["instability"]) for r in R.coupling(im, pk).collect()}
    assert got == {"a": (0, 1, 1.0), "b": (2, 0, 0.0), "c": (0, 1, 1.0)}


def test_layers_and_roles(spark):
    pk = spark.createDataFrame([("app/core",), ("app/web",), ("app/main",), ("app/leaf",)], "pkg string")
    im = spark.createDataFrame([("app/core", "app/web"), ("app/web", "app/core"), ("app/web", "github.com/x"), ("app/main", "app/web"), ("app/core", "app/main")], "pkg string, imp string")
    layered = R.package_layers(pk, [("core", ["core"]), ("web", ["web"])])
    assert [tuple(r) for r in R.layer_violations(im, layered, {"web": ["core"]}).collect()] == [("app/core", "app/web", "core", "web")]
    roles = R.package_roles(pk, im, spark.createDataFrame([("app/main",)], "pkg string"), spark.createDataFrame([("app/leaf",)], "pkg string"))
    assert {r["pkg"]: r["role"] for r in roles.collect()} == {"app/core": "orchestrator", "app/web": "bridge", "app/main": "root", "app/leaf": "leaf"}
    assert [(r["pkg"], r["imp"]) for r in R.role_violations(im, roles).collect()] == [("app/core", "app/main")]


def test_shared_items_and_clumps(spark):
    rows = [(f, t) for f in "fghi" for t in ("A", "B", "C")] + [("f", "D"), ("z", "A"), ("z", "B")]
    members = spark.createDataFrame(rows, "id string, item string")
    assert R.shared_items(members, 3).count() == 6
    clump = R.data_clumps(members).first()
    assert clump["shared"] == ["A", "B", "C"] and clump["members"] == ["f", "g", "h", "i"]
    groups = R.duplicated_sets(members)
    assert sorted(r["member"] for r in groups.collect()) == ["g", "h", "i"]


def test_dead_exports_and_boundaries(spark):
    fs = spark.createDataFrame([("a.Used",), ("a.Dead",), ("a.small",), ("a.TestX",), ("a.MyHandler",)], "fq string")
    assert [r["fq"] for r in R.dead_exports(fs, calls(spark, [("b.X", "a.Used")])).collect()] == ["a.Dead"]
    uses = spark.createDataFrame([("db/sql", "q"), ("db/sql", "p"), ("dbx", "p")], "module string, pkg string")
    assert [tuple(r) for r in R.boundaries(uses, [("db", "database")]).collect()] == [("db/sql", "database", "p")]


def test_scores(spark):
    rows = spark.createDataFrame([("style/naked-return", "f"), ("security/xss", "f")], "category string, file string")
    assert {r["category"]: (r["confidence"], r["label"]) for r in C.scored(rows).collect()} == {"style/naked-return": (0.7, "medium"), "security/xss": (0.3, "low")}
