"""Relational rules over the model: coupling, smells, duplication, layers, roles.

Inputs are generic tables: ``imports(pkg, imp)``, ``calls(src, dst)``,
``functions(fq, pkg)``, ``types(name, pkg, kind, methods, fields)``. Joins are on equal
keys; pairs are only made between members that share a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.scalars import package_of, rounded


def coupling(imports: DataFrame, packages: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """``pkg, ca, ce, instability, abstractness, distance`` of every project package.

    ``ca`` and ``ce`` count distinct project packages that import it and that it imports,
    itself left out. Ratios are computed exactly and then rounded to two digits.
    """
    inside = imports.select("pkg", "imp").where("pkg <> imp").distinct()
    inside = inside.join(packages.select(F.col("pkg").alias("imp")), "imp", "left_semi").join(packages.select("pkg"), "pkg", "left_semi")
    ca = inside.groupBy(F.col("imp").alias("pkg")).agg(F.count(F.lit(1)).alias("ca"))
    ce = inside.groupBy("pkg").agg(F.count(F.lit(1)).alias("ce"))
    rows = packages.select("pkg").distinct().join(ca, "pkg", "left").join(ce, "pkg", "left").fillna(0, ["ca", "ce"])
    if types is None:
        rows = rows.withColumn("a", F.lit(0.0))
    else:
        shares = types.groupBy("pkg").agg((F.count(F.when((F.col("kind") == "interface") & (F.size("methods") > 0), 1)) / F.count(F.lit(1))).alias("a"))
        rows = rows.join(shares, "pkg", "left").fillna(0.0, ["a"])
    i = F.when(F.col("ca") + F.col("ce") == 0, F.lit(0.0)).otherwise(F.col("ce") / (F.col("ca") + F.col("ce")))
    return rows.select("pkg", "ca", "ce", rounded(i, 2).alias("instability"), rounded(F.col("a"), 2).alias("abstractness"), rounded(F.abs(F.col("a") + i - 1), 2).alias("distance"))


def with_packages(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """``src, dst, src_pkg, dst_pkg``; an unknown function's package is what stands before its last dot."""
    known = functions.groupBy("fq").agg(F.max("pkg").alias("pkg"))
    out = calls.join(known.select(F.col("fq").alias("src"), F.col("pkg").alias("a")), "src", "left").join(known.select(F.col("fq").alias("dst"), F.col("pkg").alias("b")), "dst", "left")
    return out.select("src", "dst", F.coalesce("a", package_of(F.col("src"))).alias("src_pkg"), F.coalesce("b", package_of(F.col("dst"))).alias("dst_pkg"))


def feature_envy(calls: DataFrame, least: int = 3) -> DataFrame:
    """``src, own_pkg, envied, foreign_calls, own_calls``: more calls into one foreign package than into the own.

    ``calls`` has ``src, dst, src_pkg, dst_pkg``. Of equally called packages the smallest name is named.
    """
    counts = calls.groupBy("src", "src_pkg", "dst_pkg").agg(F.count(F.lit(1)).alias("n"))
    own = F.col("src_pkg") == F.col("dst_pkg")
    best = counts.groupBy("src", "src_pkg").agg(F.coalesce(F.max(F.when(own, F.col("n"))), F.lit(0)).alias("own_calls"), F.min(F.when(~own, F.struct((-F.col("n")).alias("m"), "dst_pkg"))).alias("b"))
    rows = best.where("b is not null").select("src", F.col("src_pkg").alias("own_pkg"), F.col("b.dst_pkg").alias("envied"), (-F.col("b.m")).alias("foreign_calls"), "own_calls")
    return rows.where((F.col("foreign_calls") >= least) & (F.col("foreign_calls") > F.col("own_calls")))


def shotgun_surgery(calls: DataFrame, callers: int = 5, packages: int = 3) -> DataFrame:
    """``dst, n_callers, n_packages``: called by more than ``callers`` from at least ``packages`` packages."""
    rows = calls.groupBy("dst").agg(F.count(F.lit(1)).alias("n_callers"), F.count_distinct("src_pkg").alias("n_packages"))
    return rows.where((F.col("n_callers") > callers) & (F.col("n_packages") >= packages))


def middle_man(calls: DataFrame) -> DataFrame:
    """``fq, callee, n_callers``: functions with one callee and two or more callers that only pass on.

    Left out: constructors (``New``), init, main; names of which one holds the other; and
    those whose callee and first caller are in the own package.
    """
    out = calls.groupBy(F.col("src").alias("fq")).agg(F.count(F.lit(1)).alias("k"), F.min("dst").alias("callee"), F.min("src_pkg").alias("pkg"), F.min("dst_pkg").alias("callee_pkg")).where("k = 1")
    into = calls.groupBy(F.col("dst").alias("fq")).agg(F.count(F.lit(1)).alias("n_callers"), F.min(F.struct("src", "src_pkg")).alias("first")).where("n_callers >= 2")
    rows = out.join(into, "fq")
    name, other = F.substring_index("fq", ".", -1), F.substring_index("callee", ".", -1)
    inner = (F.col("callee_pkg") == F.col("pkg")) & (F.col("first.src_pkg") == F.col("pkg"))
    return rows.where(~inner & ~name.contains(other) & ~other.contains(name) & ~name.startswith("New") & ~name.isin("init", "main")).select("fq", "callee", "n_callers")


def god_packages(calls: DataFrame, imports: DataFrame, packages: DataFrame, types: DataFrame, least: int = 5, abstract: float = 0.2) -> DataFrame:
    """``pkg, ca, ce, abstractness``: distinct calling packages, internal imports (not distinct) and share of interfaces."""
    ca = calls.where("src_pkg <> dst_pkg").join(packages.select(F.col("pkg").alias("src_pkg")), "src_pkg", "left_semi").groupBy(F.col("dst_pkg").alias("pkg")).agg(F.count_distinct("src_pkg").alias("ca"))
    ce = imports.join(packages.select(F.col("pkg").alias("imp")), "imp", "left_semi").groupBy("pkg").agg(F.count(F.lit(1)).alias("ce"))
    a = types.groupBy("pkg").agg((F.count(F.when(F.col("kind") == "interface", 1)) / F.count(F.lit(1))).alias("abstractness"))
    rows = packages.select("pkg").join(ca, "pkg").join(ce, "pkg").join(a, "pkg", "left").fillna(0.0, ["abstractness"])
    return rows.where((F.col("ca") >= least) & (F.col("ce") >= least) & (F.col("abstractness") < abstract))


def dead_exports(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """``fq``: exported functions that nothing calls; entries, tests and handlers are left out."""
    name = F.substring_index("fq", ".", -1)
    entry = name.rlike("^(main|init|Main)$|^(Test|Benchmark)") | F.lower(name).rlike("handler|serve")
    return functions.where(name.rlike("^[A-Z]") & ~entry).select("fq").distinct().join(calls.select(F.col("dst").alias("fq")), "fq", "left_anti")


def shared_items(members: DataFrame, least: int = 3) -> DataFrame:
    """``a, b, shared`` of pairs of sets with at least ``least`` common items. ``members``: ``id, item``, distinct.

    Prefix filter: items are ordered by how many sets have them, and only the rarest
    (size - least + 1) items of a set bring pairs together, which no qualifying pair escapes.
    """
    sizes = members.groupBy("item").agg(F.count(F.lit(1)).alias("df"))
    ranked = members.join(sizes, "item").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "item"))).alias("s"))
    ranked = ranked.where(F.size("s") >= least).select("id", F.transform("s", lambda x: x["item"]).alias("items"))
    keys = ranked.select("id", "items", F.explode(F.expr(f"slice(items, 1, size(items) - {least} + 1)")).alias("key"))
    pairs = keys.select("key", F.col("id").alias("a"), F.col("items").alias("x")).join(keys.select("key", F.col("id").alias("b"), F.col("items").alias("y")), "key").where("a < b")
    # each pair counts at its first common key
    common = F.array_intersect("x", "y")
    pairs = pairs.where((F.size(common) >= least) & (F.get(common, F.lit(0)) == F.col("key")))
    return pairs.select("a", "b", F.array_sort(common).alias("shared"))


def data_clumps(params: DataFrame, least: int = 3, functions: int = 4) -> DataFrame:
    """``shared, members``: the same set of at least ``least`` parameter types shared by pairs of at least ``functions`` functions."""
    pairs = shared_items(params, least)
    both = pairs.select("shared", F.explode(F.array("a", "b")).alias("m")).distinct()
    return both.groupBy("shared").agg(F.array_sort(F.collect_list("m")).alias("members")).where(F.size("members") >= functions)


def duplicated_sets(members: DataFrame, least: int = 3) -> DataFrame:
    """``digest, representative, member, n``: ids with exactly the same items, one row per member.

    Classes instead of pairs: copies are not expanded into all pairs.
    """
    sets = members.groupBy("id").agg(F.sort_array(F.collect_set("item")).alias("items")).where(F.size("items") >= least)
    keyed = sets.select("id", F.substring(F.sha2(F.array_join("items", ","), 256), 1, 16).alias("digest"))
    groups = keyed.groupBy("digest").agg(F.min("id").alias("representative"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return keyed.join(groups, "digest").select("digest", "representative", F.col("id").alias("member"), "n")


def package_layers(packages: DataFrame, layers: list[tuple[str, list[str]]]) -> DataFrame:
    """``pkg, layer``: the last pattern that the path contains, in the order of the configuration."""
    layer = F.lit(None).cast("string")
    for name, patterns in layers:
        for p in patterns:
            layer = F.when(F.col("pkg").contains(p), F.lit(name)).otherwise(layer)
    return packages.select("pkg", layer.alias("layer")).where("layer is not null")


def layer_violations(imports: DataFrame, layered: DataFrame, allowed: dict[str, list[str]]) -> DataFrame:
    """``pkg, imp, from_layer, to_layer``: imports into another layer that is not among the allowed ones."""
    rows = imports.join(layered.select("pkg", F.col("layer").alias("from_layer")), "pkg").join(layered.select(F.col("pkg").alias("imp"), F.col("layer").alias("to_layer")), "imp")
    ok = F.lit(False)
    for layer, deps in allowed.items():
        if deps:
            ok = ok | ((F.col("from_layer") == layer) & F.col("to_layer").isin(*deps))
    return rows.where((F.col("from_layer") != F.col("to_layer")) & ~ok).select("pkg", "imp", "from_layer", "to_layer").distinct()


def package_roles(packages: DataFrame, imports: DataFrame, roots: DataFrame, typed: DataFrame) -> DataFrame:
    """``pkg, role``: root (has a main) > bridge (imports from outside) > leaf > orchestrator > unknown.

    A leaf imports no project package and has types or is imported; an orchestrator
    imports project packages. An import is from outside if it is no project package and has a dot.
    """
    known = packages.select(F.col("pkg").alias("imp"), F.lit(True).alias("known"))
    flags = imports.join(known, "imp", "left").groupBy("pkg").agg(F.max(F.col("known").isNotNull()).alias("inner"), F.max(F.col("known").isNull() & F.col("imp").contains(".")).alias("outer"))
    used = imports.select(F.col("imp").alias("pkg")).distinct().withColumn("used", F.lit(True))
    rows = packages.select("pkg").join(flags, "pkg", "left").join(used, "pkg", "left").join(roots.select("pkg").distinct().withColumn("root", F.lit(True)), "pkg", "left")
    rows = rows.join(typed.select("pkg").distinct().withColumn("typed", F.lit(True)), "pkg", "left").fillna(False)
    role = F.when(F.col("root"), "root").when(F.col("outer"), "bridge").when(~F.col("inner") & (F.col("typed") | F.col("used")), "leaf").when(F.col("inner"), "orchestrator").otherwise("unknown")
    return rows.select("pkg", role.alias("role"))


def role_violations(imports: DataFrame, roles: DataFrame) -> DataFrame:
    """Imports that go against the roles: leaf to bridge, leaf to orchestrator, orchestrator to root."""
    rows = imports.join(roles.select("pkg", F.col("role").alias("from_role")), "pkg").join(roles.select(F.col("pkg").alias("imp"), F.col("role").alias("to_role")), "imp")
    bad = F.concat_ws(">", "from_role", "to_role").isin("leaf>bridge", "leaf>orchestrator", "orchestrator>root")
    return rows.where(bad).select("pkg", "imp", "from_role", "to_role").distinct()


def boundaries(uses: DataFrame, rules: list[tuple[str, str]], mark: str = "/") -> DataFrame:
    """``module, kind, pkg``: outside modules by the first rule whose prefix fits; the first user alone is named."""
    kind = F.lit(None).cast("string")
    for prefix, name in reversed(rules):
        kind = F.when((F.col("module") == prefix) | F.col("module").startswith(prefix + mark), F.lit(name)).otherwise(kind)
    return uses.withColumn("kind", kind).where("kind is not null").groupBy("module", "kind").agg(F.min("pkg").alias("pkg"))


def verb_consistency(names: DataFrame, least: int = 5, share: float = 0.6) -> DataFrame:
    """``role, verb, n, dominant``: verbs used at least twice where another verb dominates its role.

    ``names``: ``role, verb``. A role needs ``least`` names and a dominant verb with ``share`` of them.
    """
    counts = names.where("verb <> ''").groupBy("role", "verb").agg(F.count(F.lit(1)).alias("n"))
    tops = counts.groupBy("role").agg(F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("m"), "verb")).alias("b"))
    rows = counts.join(tops, "role").where((F.col("total") >= least) & (-F.col("b.m") / F.col("total") >= share))
    return rows.where((F.col("verb") != F.col("b.verb")) & (F.col("n") >= 2)).select("role", "verb", "n", F.col("b.verb").alias("dominant"))


def outliers(scores: DataFrame, value: str, sigmas: float = 2.0) -> DataFrame:
    """Rows whose value is above mean + sigmas * population deviation, and above zero."""
    limit = scores.agg((F.avg(value) + sigmas * F.stddev_pop(value)).alias("_limit"))
    return scores.join(F.broadcast(limit), F.col(value) > F.col("_limit")).where(F.col(value) > 0).drop("_limit")


def first_by(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key."""
    by = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")
