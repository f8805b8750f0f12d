"""Exact deduplication by skew-safe combining, on DataFrame functions only.

Rows are combined in three stages: within each input partition (map-side partial
aggregation), within salted digest groups (the salt is the input partition, so a
hot text meets in many tasks), and over the salt winners. The grouping key of
every stage is the digest *and* the whole normalised text, so texts are compared
in full at every stage. The winners, without texts, go to a written table; a
digest that stands for two different texts would be seen there and its rows are
then joined on the texts themselves.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.skew import lookup, unused
from sparkloom.plans.tables import drop_shuffles, materialize

#: Salted groups of one digest.
SALTS = 16
_BIG = Decimal(2**64)
_TOP = Decimal(2**63 - 1)


def normalized(text: Column) -> Column:
    """The text without the characters space, tab, line feed, vertical tab, form feed and carriage return; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[ \\t-\\r]+", "")


def _order(text: Column, doc_id: Column) -> Column:
    """One number that is larger for longer texts, then for smaller ids; null ids come last."""
    key = F.length(F.coalesce(text, F.lit(""))).cast("decimal(11,0)") * F.lit(_BIG)
    return key + (F.lit(_TOP) - F.coalesce(doc_id, F.lit(2**63 - 1)).cast("decimal(20,0)"))


def _id_of(order: Column) -> Column:
    got = (F.lit(_TOP) - order % F.lit(_BIG)).cast("long")
    return F.when(got < 2**63 - 1, got)


def winners(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct text: ``sha`` (binary), ``keep_id``, ``n`` rows, ``contents`` with the same digest, and ``norm`` where that is not 1."""
    text = F.col(f"`{text_col}`")
    rows = documents.select(normalized(text).alias("norm"), _order(text, F.col(f"`{id_col}`")).alias("o"), (F.spark_partition_id() % SALTS).alias("salt"))
    rows = rows.withColumn("sha", F.unhex(F.sha2("norm", 256)))
    salted = rows.groupBy("sha", "norm", "salt").agg(F.count(F.lit(1)).alias("n"), F.max("o").alias("o"))
    whole = salted.groupBy("sha", "norm").agg(F.sum("n").alias("n"), F.max("o").alias("o"))
    return whole.select("sha", "norm", "n", _id_of(F.col("o")).alias("keep_id"))


def _groups(documents: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """Written winners without their texts, and the winners with texts of digests that stand for several texts, if there are any."""
    found = winners(documents, id_col, text_col)
    slim = materialize(found.select("sha", "keep_id", "n"), "exact-groups")
    drop_shuffles(documents.sparkSession)
    twice = slim.groupBy("sha").agg(F.count(F.lit(1)).alias("contents")).where("contents > 1").select("sha")
    if twice.isEmpty():
        return slim, None
    return slim.join(twice, "sha", "left_anti"), found.join(twice, "sha", "left_semi")


def _decided(documents: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """All columns of ``documents`` and, after a prefix of their own, ``sha256, keep, n``."""
    x = unused(documents)
    slim, collided = _groups(documents, id_col, text_col)
    total = slim.agg(F.sum("n")).first()[0] or 0
    groups = slim.select(F.col("sha").alias(f"{x}sha"), F.col("keep_id").alias(f"{x}keep"), F.col("n").alias(f"{x}size"), F.col("n").alias(f"{x}n"))
    text, kept = F.col(f"`{text_col}`"), [F.col(f"`{c}`") for c in documents.columns]
    rows = documents.select(*kept, F.sha2(normalized(text), 256).alias(f"{x}sha256"))
    rows = lookup(rows.withColumn(f"{x}sha", F.unhex(f"{x}sha256")), groups, f"{x}sha", f"{x}size", total, id_col)
    keep, n = F.col(f"{x}keep"), F.col(f"{x}n")
    if collided is not None:
        # several texts with one digest: these rows alone are joined on the whole text
        more = collided.select(F.col("sha").alias(f"{x}csha"), F.col("norm").alias(f"{x}cnorm"), F.col("keep_id").alias(f"{x}ckeep"), F.col("n").alias(f"{x}cn"))
        rows = rows.join(more, (F.col(f"{x}sha") == F.col(f"{x}csha")) & (normalized(text) == F.col(f"{x}cnorm")), "left")
        keep, n = F.coalesce(f"{x}ckeep", keep), F.coalesce(f"{x}cn", n)
    return rows.select(*kept, F.col(f"{x}sha256"), keep.alias(f"{x}keep"), n.alias(f"{x}n")), x


def exact_dedup(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``documents`` plus ``keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after :func:`normalized`. Of equal texts the row
    with the most code points in its original text, then the smallest id, stays.
    Null and empty texts are equal. A null id loses against any other id; a group
    of null ids alone keeps them all (``keep_id`` null). Repeated rows of the
    winning id all count as that document. An empty table gives an empty result. A
    column of the input named like an added one is replaced; :func:`deduplicated`
    keeps the input's columns.
    """
    added = {"keep_id", "group_size", "kept", "text_sha256"} - {id_col, text_col}
    rows, x = _decided(documents, id_col, text_col)
    own = [F.col(f"`{c}`") for c in documents.columns if c.lower() not in added]
    return rows.select(*own, F.col(f"{x}keep").alias("keep_id"), F.col(f"{x}n").alias("group_size"), F.col(f"`{id_col}`").eqNullSafe(F.col(f"{x}keep")).alias("kept"), F.col(f"{x}sha256").alias("text_sha256"))


def deduplicated(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``documents`` for each distinct text, with the input's columns and their values.

    It is the row of :func:`exact_dedup`'s ``keep_id``. Where several rows with equal
    texts have that id, or all ids are null, one of them stays.
    """
    rows, x = _decided(documents, id_col, text_col)
    rows = rows.where(F.col(f"`{id_col}`").eqNullSafe(F.col(f"{x}keep")))
    own = [F.col(f"`{c}`") for c in documents.columns]
    # a narrow pass finds what repeats; only these rows are combined, map-side first
    digest = F.sha2(normalized(F.col(f"`{text_col}`")), 256)
    again = documents.groupBy(F.col(f"`{id_col}`").alias(f"{x}id"), F.xxhash64(digest).alias(f"{x}h")).agg(F.count(F.lit(1)).alias(f"{x}m")).where(F.col(f"{x}m") > 1)
    again = materialize(again, "exact-repeats")
    if again.isEmpty():
        return rows.select(*own)
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(f"{x}id")) & (F.xxhash64(f"{x}sha256") == F.col(f"{x}h"))
    once = rows.join(again, same, "left_semi").withColumn(f"{x}norm", normalized(F.col(f"`{text_col}`"))).dropDuplicates([f"{x}norm"])
    return rows.join(again, same, "left_anti").select(*own).union(once.select(*own))
