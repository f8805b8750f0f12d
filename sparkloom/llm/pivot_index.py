"""Near-duplicate vectors by a pivot-permutation index.

A bounded set of reference vectors (pivots), whose number grows with that of the
vectors, is taken from a sample. Every vector is described by its nearest pivots in
order and posted to the inverted list of each of them. Pairs that share enough near
pivots are candidates, and links if their cosine, in double precision, reaches the
threshold. A pair counts in the list of the smallest pivot that it shares, so once.

Equal vectors are one point with a weight. A short list is verified as a whole. A long
one is divided by a second shared pivot, and what is still long after that is cut into
blocks by a hash of the point, of which each task compares two. Tasks emit the number of
links of each point and, for each, one link of a spanning forest, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.arrow import small_batches
from sparkloom.llm.skew import lookup
from sparkloom.operators.components import connected_components
from sparkloom.plans.tables import discard, drop_shuffles, materialize

#: Pivots at least and at most, and numbers in all pivots at most; the sample has two vectors for each pivot.
FEWEST, MOST, NUMBERS = 128, 8192, 1 << 22
#: Points of an average list, as long as the pivots suffice for that.
LIST = 256
#: Near pivots that describe a vector, and how many of them two candidates share.
NEAREST, SHARED = 12, 2
#: No two pivots have a larger cosine.
APART = 0.8
#: Points of a list, or part of one, that is compared at once.
BLOCK = 1024


def points(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """``vec_id, key`` for every row (key null where it links with nothing), and one row ``key, v, w, low`` per distinct vector."""
    # float components are exact as doubles too, so they stay what they are
    short = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    v, zero = F.col(vector_col).cast("array<float>" if short else "array<double>"), F.lit(0.0).cast("float" if short else "double")
    usable = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    # adding zero makes negative zeros equal to zeros
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(usable, F.transform(v, lambda x: x + zero)).alias("v"))
    rows = rows.withColumn("key", F.when(F.col("v").isNotNull(), F.unhex(F.sha2(F.to_json(F.struct("v")), 256))))
    rows = materialize(rows, "pivot-rows")
    distinct = rows.where("key is not null").groupBy("key", "v").agg(F.count(F.lit(1)).alias("w"), F.min("vec_id").alias("low"))
    return rows.select("vec_id", "key"), distinct


def number_of_pivots(n: int, size: int, nearest: int = NEAREST) -> int:
    """Enough pivots for lists of ``LIST`` points, within the bounds."""
    return max(1, min(max(FEWEST, -(-nearest * n // LIST)), MOST, NUMBERS // size))


def choose_pivots(sample: np.ndarray, pivots: int, apart: float = APART) -> np.ndarray:
    """Unit vectors of the sample, in its order, each at most ``apart`` from those before."""
    unit = _unit(sample)
    kept, n = np.empty((min(pivots, len(unit)), unit.shape[1])), 0
    for x in unit:
        if n == len(kept):
            break
        if not n or (kept[:n] @ x).max() <= apart:
            kept[n] = x
            n += 1
    return kept[:n]


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)  # no overflow in the squares
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def nearest_pivots(unit: np.ndarray, base: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the ``k`` nearest pivots of each vector, nearest first."""
    cos = unit.astype("float32") @ base.astype("float32").T
    some = np.argpartition(-cos, k - 1, axis=1)[:, :k] if k < len(base) else np.tile(np.arange(len(base)), (len(cos), 1))
    order = np.argsort(-np.take_along_axis(cos, some, 1), axis=1, kind="stable")
    return np.take_along_axis(some, order, 1)


def compare(a: pd.DataFrame, b: pd.DataFrame, same: bool, first: int, second: int, shared: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``a`` and ``b`` of the links that this list, or its part of a second pivot (-1: all of it), counts."""
    va, vb = (_unit(np.array(x["v"].to_list(), dtype="float64")) for x in (a, b))
    ok = va @ vb.T >= threshold - 1e-9
    if same:
        ok = np.triu(ok, 1)
    i, j = np.nonzero(ok)
    na, nb = (np.array(x["near"].to_list()) for x in (a, b))
    good = np.zeros(len(i), bool)
    for s in range(0, len(i), 100_000):
        x, y = i[s : s + 100_000], j[s : s + 100_000]
        both = (na[x][:, :, None] == nb[y][:, None, :]).any(2)
        common = np.sort(np.where(both, na[x], np.iinfo("int32").max), axis=1)
        keep = (both.sum(1) >= min(na.shape[1], shared)) & (common[:, 0] == first)
        if second >= 0:
            keep &= common[:, 1] == second
        good[s : s + 100_000] = keep & (np.einsum("ij,ij->i", va[x], vb[y]) >= threshold)
    return i[good], j[good]


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest position that each of ``n`` positions reaches."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, i, label[j])
        np.minimum.at(low, j, label[i])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int | None = None, nearest: int = NEAREST, shared: int = SHARED, block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` with one row for each row of ``vectors``.

    Links are pairs of other rows with cosine >= ``threshold`` that the index finds
    (never one below it). Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing: 0 links, their own component. Equal
    vectors link. The number of ``pivots`` follows that of the vectors if not given. Vectors of different lengths never link. Repeated rows with one id
    count as rows. Null ids are kept: they link, but never name a component.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows, distinct = points(vectors, id_col, vector_col)
    # numbers given once and written are distinct, as hashes of billions of points would not be
    distinct = materialize(distinct.withColumn("pid", F.monotonically_increasing_id()), "pivot-points")
    sizes = {r["size"]: r["count"] for r in distinct.groupBy(F.size("v").alias("size")).count().collect()}
    n_points, links = sum(sizes.values()), []
    for size, n in sorted(sizes.items()):
        links.append(_links(distinct.where(F.size("v") == size), n, pivots or number_of_pivots(n, size, nearest), threshold, nearest, shared, block))
    if links:
        counts, edges = links[0]
        for more, others in links[1:]:
            counts, edges = counts.union(more), edges.union(others)
        counts = counts.groupBy("pid").agg(F.sum("n").alias("n"))
        parts = connected_components(edges).select(F.col("node").alias("pid"), F.col("component").alias("root"))
        named = distinct.select("pid", "key", "w", "low").join(counts, "pid", "left").join(parts, "pid", "left")
        named = named.select("key", "w", "low", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("root", "pid").alias("root"))
        named = materialize(named, "pivot-named")
        roots = materialize(named.groupBy("root").agg(F.min("low").alias("component"), F.count(F.lit(1)).alias("m")), "pivot-roots")
        named = lookup(named, roots, "root", "m", n_points, "key").select("key", "w", (F.col("n") + F.col("w") - 1).alias("links"), "component")
    else:
        named = distinct.select("key", "w", F.lit(0).cast("long").alias("links"), F.col("low").alias("component"))
    named = materialize(named, "pivot-result")
    total = named.agg(F.sum("w")).first()[0] or 0
    drop_shuffles(spark)
    found = lookup(rows, named, "key", "w", total, "vec_id")
    own = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return found.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.col("vec_id").eqNullSafe(own).alias("kept"))


def _links(distinct: DataFrame, n_points: int, pivots: int, threshold: float, nearest: int, shared: int, block: int) -> tuple[DataFrame, DataFrame]:
    """``pid, n`` (weighted links, in parts) and spanning ``src, dst`` over points of one length."""
    h = F.pmod(F.xxhash64("key"), F.lit(1 << 30))
    sample = distinct.select("v", h.alias("h")).where(F.col("h") < float(1 << 30) * min(1.0, 4 * pivots / n_points)).orderBy("h").limit(2 * pivots)

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [np.array(batch["v"].to_list(), dtype="float64") for batch in batches if len(batch)]
        yield pd.DataFrame({"base": [choose_pivots(np.concatenate(got), pivots).tobytes()] if got else []})

    chosen = sample.select("v").repartition(1).mapInPandas(choose, "base binary").first()
    first = distinct.select("v").first()["v"]
    base = np.frombuffer(bytes(chosen["base"])).reshape(-1, len(first)) if chosen else _unit(np.array([first], dtype="float64"))
    k = min(nearest, len(base))

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            near = nearest_pivots(_unit(np.array(batch["v"].to_list(), dtype="float64")), base, k)
            yield batch.assign(near=list(near.astype("int32")))

    kind = distinct.schema["v"].dataType.simpleString()
    known = distinct.select("pid", "w", "v").mapInPandas(describe, f"pid long, w long, v {kind}, near array<int>")
    known = materialize(known, "pivot-known")
    # one row per pivot at most, hence broadcast
    sizes = known.select(F.explode("near").alias("first")).groupBy("first").agg((F.count(F.lit(1)) > block).alias("long"))
    posts = known.select("pid", "w", "v", "near", F.explode("near").alias("first")).join(F.broadcast(sizes), "first")
    second = F.filter("near", lambda x: x > F.col("first")) if k > 1 and shared > 1 else F.array(F.lit(-1))
    posts = posts.withColumn("second", F.explode(F.when(F.col("long"), second).otherwise(F.array(F.lit(-1))))).drop("long")
    # parts that are still long; the count reads no vectors
    cuts = materialize(posts.groupBy("first", "second").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block), "pivot-cuts")
    cuts = cuts.select("first", "second", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    posts = posts.join(cuts, ["first", "second"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    posts = posts.withColumn("b", F.pmod(F.xxhash64("pid"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    posts = posts.withColumn("lo", F.least("b", "other")).withColumn("hi", F.greatest("b", "other"))
    # parts of one list that need no cut share a task where they are small
    together = F.when(F.col("blocks") > 1, F.col("second")).otherwise(F.when(F.col("second") >= 0, -2 - F.pmod(F.xxhash64("second"), F.lit(8))).otherwise(-1)).cast("int")
    posts = posts.withColumn("task", together)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["second", "pid"], kind="stable").reset_index(drop=True)
        n, root = np.zeros(len(group), "int64"), np.arange(len(group))
        pid, w, at = group["pid"].to_numpy(), group["w"].to_numpy(), group["second"].to_numpy()
        lo, hi, here = int(group["lo"][0]), int(group["hi"][0]), int(group["first"][0])
        ends = np.append(np.flatnonzero(np.diff(at)) + 1, len(group))
        for start, end in zip(np.append(0, ends[:-1]), ends, strict=True):
            part = group.iloc[start:end]
            if lo == hi:
                x = y = np.arange(start, end)
            else:
                b = part["b"].to_numpy()
                x, y = start + np.flatnonzero(b == lo), start + np.flatnonzero(b == hi)
            if not len(x) or not len(y) or end - start < 2:
                continue
            i, j = compare(group.iloc[x], group.iloc[y], lo == hi, here, int(at[start]), shared, threshold)
            i, j = x[i], y[j]
            np.add.at(n, i, w[j])
            np.add.at(n, j, w[i])
            root[start:end] = start + _forest(end - start, i - start, j - start)
        keep = n > 0
        return pd.DataFrame({"pid": pid[keep], "n": n[keep], "root": pid[root[keep]]})

    out = posts.select("first", "second", "task", "lo", "hi", "b", "pid", "w", "v", "near").groupBy("first", "task", "lo", "hi").applyInPandas(run, "pid long, n long, root long")
    out = materialize(out, "pivot-links")
    discard(known, cuts)
    return out.groupBy("pid").agg(F.sum("n").alias("n")), out.select(F.col("pid").alias("src"), F.col("root").alias("dst")).distinct()
