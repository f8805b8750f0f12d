"""Design patterns and type metrics as joins and counts over types and their members."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.components import connected_components
from sparkloom.plans.tables import materialize


def implementations(methods: DataFrame, wanted: DataFrame) -> DataFrame:
    """``type, iface``: types that have all methods of an interface. ``methods``: ``type, method``; ``wanted``: ``iface, method``.

    Relational division: matches are counted per pair that shares a method, and no
    other pair is formed. Interfaces without methods match nothing.
    """
    need = wanted.distinct()
    sizes = need.groupBy("iface").agg(F.count(F.lit(1)).alias("size"))
    hits = methods.distinct().join(need, "method").groupBy("type", "iface").agg(F.count(F.lit(1)).alias("n"))
    return hits.join(sizes, "iface").where("n = size").where("type <> iface").select("type", "iface")


def interface_boundaries(implements: DataFrame, packages: DataFrame) -> DataFrame:
    """``type, type_pkg, iface, iface_pkg``: implementations in another package than the interface. ``packages``: ``type, pkg``."""
    a = packages.select("type", F.col("pkg").alias("type_pkg"))
    b = packages.select(F.col("type").alias("iface"), F.col("pkg").alias("iface_pkg"))
    return implements.join(a, "type").join(b, "iface").where("type_pkg <> iface_pkg").select("type", "type_pkg", "iface", "iface_pkg")


def strategies(implements: DataFrame, least: int = 2) -> DataFrame:
    """``iface, n, types``: interfaces with at least ``least`` implementations."""
    return implements.groupBy("iface").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("type")).alias("types")).where(F.col("n") >= least)


def decorators(implements: DataFrame, fields: DataFrame) -> DataFrame:
    """``type, iface``: types with a field of an interface that they implement. ``fields``: ``type, field_type``."""
    return implements.join(fields.select("type", F.col("field_type").alias("iface")).distinct(), ["type", "iface"], "left_semi")


def middlewares(functions: DataFrame) -> DataFrame:
    """``fq``: functions whose only parameter and only result have one type. ``functions``: ``fq, params array, results array``."""
    return functions.where((F.size("params") == 1) & (F.size("results") == 1) & (F.get("params", F.lit(0)) == F.get("results", F.lit(0)))).select("fq")


def singletons(variables: DataFrame) -> DataFrame:
    return variables.where(F.col("type").isin("sync.Once", "*sync.Once")).select("pkg", "name")


def builders(methods: DataFrame, least: int = 3, share: float = 0.5) -> DataFrame:
    """``type, chainable, n``: types of whose methods at least ``share`` return the type. ``methods``: ``type, method, result``."""
    own = F.regexp_replace("result", r"^\*", "") == F.col("type")
    rows = methods.groupBy("type").agg(F.count(F.when(own, 1)).alias("chainable"), F.count(F.lit(1)).alias("n"))
    return rows.where((F.col("chainable") >= least) & (F.col("chainable") / F.col("n") >= share))


def factories(functions: DataFrame, interfaces: DataFrame) -> DataFrame:
    """``fq, iface``: functions that are no methods, by the first interface among their results other than error."""
    rows = functions.where("receiver is null or receiver = ''").select("fq", F.posexplode("results").alias("k", "iface"))
    rows = rows.where("iface <> 'error'").join(interfaces.select("iface").distinct(), "iface", "left_semi")
    return rows.groupBy("fq").agg(F.min(F.struct("k", "iface")).alias("b")).select("fq", "b.iface")


def lack_of_cohesion(uses: DataFrame) -> DataFrame:
    """``type, lcom4``: components of methods that share a field or a call. ``uses``: ``type, method, member``.

    Methods and members are nodes of one graph; each component with a method counts. Links are
    stars around members, so no pairs of methods are formed.
    """
    nodes = materialize(uses.select("type", "method", F.xxhash64(F.lit("m"), "type", "method").alias("m"), F.xxhash64(F.lit("f"), "type", "member").alias("f"), "member"), "lcom-uses")
    parts = connected_components(nodes.where("member is not null").select("m", "f"), "m", "f")
    rows = nodes.select("type", "method", "m").distinct().join(parts, F.col("m") == F.col("node"), "left")
    return rows.groupBy("type").agg(F.count_distinct(F.coalesce("component", "m")).alias("lcom4"))


def god_types(methods: DataFrame, limit: int = 15) -> DataFrame:
    return methods.groupBy("type").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)


def error_styles(profiles: DataFrame, least: int = 2) -> DataFrame:
    """``pkg, style, usual``: packages whose most frequent style is not the one most packages have. ``profiles``: ``pkg, style``, one row per use.

    The overall style is the one with most uses among the packages' own dominant uses; ties go to the first name.
    """
    counts = profiles.groupBy("pkg", "style").agg(F.count(F.lit(1)).alias("n"))
    tops = counts.groupBy("pkg").agg(F.min(F.struct((-F.col("n")).alias("m"), "style")).alias("b")).select("pkg", F.col("b.style").alias("style"), (-F.col("b.m")).alias("n"))
    total = tops.groupBy("style").agg(F.sum("n").alias("n"))
    usual = total.agg(F.min(F.struct((-F.col("n")).alias("m"), "style")).alias("b"), F.lit(1).alias("one")).select(F.col("b.style").alias("usual"))
    many = tops.agg(F.count(F.lit(1)).alias("k"))
    return tops.join(F.broadcast(usual), F.col("style") != F.col("usual")).join(F.broadcast(many), F.col("k") >= least).select("pkg", "style", "usual")
