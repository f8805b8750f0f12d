"""SimHash near-duplicates by covering locality-sensitive hashing.

With radius r, each of the 64 bit positions gets a non-zero vector of r + 1 bits,
every vector equally often but for one. Every non-zero vector v of r + 1 bits makes a
table, whose mask has the positions whose vectors have an odd product with v, about
half of them. Any r positions span less than the whole space, so some v is orthogonal
to all of them: two fingerprints that differ in at most r bits agree under that mask
and meet in that table. No pair within the radius is ever missed.

Links are not listed pair by pair. One pass over all buckets keeps the smallest and
the largest member of each; a bucket of two is settled by that. Members of larger
buckets are compared with a few members that stand for the bucket; verified links give
components. Only where a bucket holds several components, members outside its largest
one are joined with its other members on the bits of r + 1 blocks, one of which agrees
in any pair within the radius, and verified links alone come out. That covers every pair
that could still join two components.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.arrow import small_batches
from sparkloom.llm.skew import lookup, unused
from sparkloom.operators.components import connected_components
from sparkloom.plans.tables import discard, drop_shuffles, materialize, packed

SEED = 42
#: Members that stand for a bucket: the smallest under this many orders.
STANDS = 6


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprint(text: str | None, words: int) -> int:
    """Majority bits over the XXH64 hashes of word shingles, repeats included; zero for a text without words."""
    found = (text or "").encode().lower().split()  # of bytes: A-Z alone and the six ASCII spaces
    if not found:
        return 0
    line, sizes = b" ".join(found), np.fromiter(map(len, found), "int64", len(found))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    n = max(1, len(found) - words + 1)
    hash_, last = xxhash.xxh64_intdigest, min(words, len(found)) - 1
    counts, done = np.zeros(64, "int64"), 0
    starts, ends = starts[:n].tolist(), ends[last : last + n].tolist()
    while done < n:
        some = np.array([hash_(line[a:b], SEED) for a, b in zip(starts[done : done + 65536], ends[done : done + 65536], strict=True)], "<u8")
        counts += np.unpackbits(some.view("uint8").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="int64")
        done += len(some)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a long) for every row; null texts count as empty."""
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": [_signed(fingerprint(t, words)) for t in batch["text"]]}).astype({"doc_id": "Int64", "fp": "int64"})

    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, "doc_id long, fp long")


def masks(radius: int, seed: int = 7) -> list[int]:
    """The 2 ** (radius + 1) - 1 masks of the covering tables."""
    last = (1 << (radius + 1)) - 1
    vectors = [1 + i % last for i in random.Random(seed).sample(range(max(64, last)), 64)]
    return [sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() % 2) for v in range(1, last + 1)]


def blocks(radius: int) -> list[int]:
    """Disjoint masks that cover all positions; two fingerprints within the radius agree under one of them."""
    return [sum(1 << i for i in range(b, 64, radius + 1)) for b in range(radius + 1)]


def _under(masks: list[int]):
    """One key for each mask: the number of the mask and the fingerprint's bits under it, hashed."""
    return F.array(*[F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for t, m in enumerate(masks)])


def _distance(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def covering_links(points: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """Verified links that connect all of ``points`` (``fp``, distinct) that chains within the radius connect.

    Returns two tables of ``src, dst``: links to members that stand for buckets, and
    the links between what those left apart.
    """
    # keys are hashes: a clash makes a bucket larger and no link, for every link is verified
    posts = points.select("fp", F.explode(_under(masks(radius))).alias("key"))
    size = points.count() * len(masks(radius))
    # lo and hi are equal in nearly all rows of this exchange, which compresses to about one key and one fingerprint
    seen = posts.groupBy("key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi")
    seen = materialize(seen, "simhash-buckets", size)
    # every later step reads the members of buckets of three or more alone
    crowd = materialize(posts.join(seen.where("n > 2").select("key"), "key"), "simhash-crowd", size)
    size = crowd.count()
    rng = random.Random(11)
    orders = [0, -1] + [_signed(rng.getrandbits(64)) for _ in range(STANDS - 2)]
    stands = crowd.groupBy("key").agg(*[F.min(F.col("fp").bitwiseXOR(F.lit(o))).bitwiseXOR(F.lit(o)).alias(f"s{i}") for i, o in enumerate(orders)])
    stands = materialize(stands, "simhash-stands", size)
    pairs = crowd.join(stands, "key").select("fp", F.explode(F.array_distinct(F.array(*[f"s{i}" for i in range(STANDS)]))).alias("s"))
    pairs = pairs.union(seen.where("n = 2").select("lo", "hi"))
    near = pairs.where((F.col("fp") != F.col("s")) & (_distance("fp", "s") <= radius))
    first = materialize(near.select(F.greatest("fp", "s").alias("src"), F.least("fp", "s").alias("dst")).distinct(), "simhash-links", size + seen.count())
    links = first.count()
    parts = materialize(connected_components(first, rows=links), "simhash-parts", 2 * links)
    # members with their component so far; only buckets with several components matter any more
    member = crowd.join(parts.select(F.col("node").alias("fp"), F.col("component").alias("c")), "fp", "left").select("key", "fp", F.coalesce("c", "fp").alias("c"))
    member = materialize(member, "simhash-members", size)
    mixed = materialize(member.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key"), "simhash-mixed", size)
    left = materialize(member.join(mixed, "key"), "simhash-left", size)
    size = left.count()
    sizes = left.groupBy("key", "c").agg(F.count(F.lit(1)).alias("n"))
    largest = materialize(sizes.groupBy("key").agg(F.max(F.struct("n", "c")).alias("m")).select("key", F.col("m.c").alias("top")), "simhash-largest", size)
    split = left.withColumn("part", F.explode(_under(blocks(radius))))
    outside = materialize(split.join(largest, "key").where("c <> top").select("key", "part", F.col("fp").alias("fp2"), F.col("c").alias("c2")), "simhash-outside", size * (radius + 1))
    close = outside.join(split, ["key", "part"]).where((F.col("c") != F.col("c2")) & (_distance("fp", "fp2") <= radius))
    second = materialize(close.select(F.greatest("c", "c2").alias("src"), F.least("c", "c2").alias("dst")).distinct(), "simhash-more")
    discard(seen, crowd, stands, member, mixed, left, largest, outside)
    drop_shuffles(points.sparkSession)
    return parts.select(F.col("node").alias("src"), F.col("component").alias("dst")), second


def near_duplicates(documents: DataFrame, radius: int = 4, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` with one row for each row of ``documents``.

    ``component_id`` is the smallest id reachable over links of at most ``radius``
    differing bits. Null, empty and blank texts have fingerprint zero, which links
    like any other. Repeated rows are kept. Rows with a null id keep their
    fingerprint and component but never name it; a component of null ids alone has a
    null ``component_id``. An empty table gives an empty result.
    """
    rows = materialize(fingerprints(documents, words, id_col, text_col), "simhash-rows")
    size = rows.count()
    # every point becomes a post in each table, which its file's task makes
    points = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")), "simhash-points", size * len(masks(radius)))
    one, two = covering_links(points.select("fp"), radius)
    links = one.union(two)
    whole = connected_components(links, rows=links.count())
    whole = points.join(whole.select(F.col("node").alias("fp"), F.col("component").alias("root")), "fp", "left").select("fp", "low", "n", F.coalesce("root", "fp").alias("root"))
    whole = materialize(whole, "simhash-roots", size)
    roots = materialize(whole.groupBy("root").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("fps")), "simhash-names", size)
    total = roots.agg(F.sum("fps")).first()[0] or 0
    named = lookup(whole, roots, "root", "fps", total, "fp").select("fp", "n", "component_id")
    named = materialize(named, "simhash-named", size)
    total = named.agg(F.sum("n")).first()[0] or 0
    discard(points, whole, roots)
    found = packed(lookup(rows, named, "fp", "n", total, "doc_id"), size)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def without_near_duplicates(documents: DataFrame, radius: int = 4, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose id names their component, and rows with a null id, with all columns of ``documents``.

    Rows that repeat the id that stays are all kept: they are that document.
    """
    found = near_duplicates(documents, radius, words, id_col, text_col)
    x = unused(documents)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias(f"{x}gone")).distinct()
    return documents.join(gone, documents[id_col].cast("long") == F.col(f"{x}gone"), "left_anti")
