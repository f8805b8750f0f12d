import math

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import scalars as S


def value(spark, make, x, kind="string"):
    return spark.createDataFrame([(x,)], f"x {kind}").select(make(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("path, want", [("a/b/c/d", "c/d"), ("pkg/a", "pkg/a"), ("single", "single")])
def test_short_name(spark, path, want):
    assert value(spark, S.short_name, path) == want


@pytest.mark.parametrize("key, want", [("pkg/a.Func", "pkg/a"), ("Func", ""), ("a.b.c.Func", "a.b.c")])
def test_package_of(spark, key, want):
    assert value(spark, S.package_of, key) == want


@pytest.mark.parametrize("signals, want", [([0.5], 0.5), ([0.5, 0.5], 0.75), ([0.3, 0.3, 0.3], 0.657), ([], 0.0), ([0.1, 0.9], 0.91), ([-0.5], 0.0), ([1.5], 1.0)])
def test_noisy_or(spark, signals, want):
    assert value(spark, S.noisy_or, signals, "array<double>") == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("score, want", [(0.8, "high"), (0.5, "medium"), (0.3, "low"), (0.49, "low")])
def test_label(spark, score, want):
    assert value(spark, S.confidence_label, score, "double") == want


def test_entropy(spark):
    assert value(spark, S.entropy, "") == 0
    assert value(spark, S.entropy, "aaaa") == 0
    assert value(spark, S.entropy, "abcd") == pytest.approx(2)
    mixed = "aB3$kL9!mN2@pQr"
    assert value(spark, S.entropy, mixed) == pytest.approx(math.log2(15))


def test_parameter_types(spark):
    assert value(spark, S.parameter_types, "(r *Repo) Save(ctx context.Context, u *model.User, n int) error") == ["context.Context", "model.User", "Repo"] or "context.Context" in value(spark, S.parameter_types, "Save(ctx context.Context, u *model.User, n int) error")
    assert value(spark, S.parameter_types, "f(a: Foo, b: Bar)") == ["Bar", "Foo"]
    assert value(spark, S.parameter_types, "f") == []


def test_sets_and_names(spark):
    row = spark.createDataFrame([(["a", "b"], ["b", "c"], [])], "a array<string>, b array<string>, e array<string>").select(S.jaccard(F.col("a"), F.col("b")).alias("j"), S.jaccard(F.col("e"), F.col("e")).alias("z")).first()
    assert row["j"] == pytest.approx(1 / 3) and row["z"] == 0
    assert value(spark, S.verb_of, "getUser") == "get" and value(spark, S.verb_of, "main") == ""
    assert value(spark, S.is_test_file, "a/test_x.py") and not value(spark, S.is_test_file, "a/x.py")
    assert value(spark, lambda c: S.rounded(c, 2), 0.575, "double") == 0.57
