import random

import pytest

from sparkloom.operators import graph as G
from sparkloom.operators.components import connected_components


def edges(spark, text):
    return spark.createDataFrame([tuple(e.split(">")) for e in text.split()], "src string, dst string")


def as_map(df, k, v):
    return {r[k]: r[v] for r in df.collect()}


@pytest.mark.parametrize("text, sizes", [("A>B B>C C>A", [3]), ("A>B B>C", [1, 1, 1]), ("A>B B>A C>D D>C", [2, 2]), ("A>A", [1]), ("A>B A>C B>D C>D D>A", [4])])
def test_strong_components(spark, text, sizes):
    e = edges(spark, text)
    got = G.strong_components(e).groupBy("component").count().collect()
    assert sorted((r["count"] for r in got), reverse=True) == sizes
    assert G.clusters(e, G.strong_components(e)).count() == sum(s > 1 for s in sizes)


def test_betweenness(spark):
    got = as_map(G.betweenness(edges(spark, "A>B B>C C>D D>E")), "node", "score")
    assert got == {"A": 0, "B": 3, "C": 4, "D": 3, "E": 0}
    assert G.betweenness(edges(spark, "A>B B>C"), max_nodes=2).count() == 0


def test_reach_and_blast(spark):
    assert as_map(G.blast_radius(edges(spark, "A>B B>C")), "node", "blast") == {"A": 0, "B": 1, "C": 2}
    assert G.reachable(edges(spark, "A>B A>C B>D C>D"), None).where("start = 'A'").count() == 3


def test_pagerank(spark):
    text = "A>B A>C B>C C>A D>C D>C"
    n, pairs = 4, [e.split(">") for e in text.split()]
    rank = dict.fromkeys("ABCD", 1 / n)
    for _ in range(20):
        new = dict.fromkeys("ABCD", 0.15 / n)
        for a, b in pairs:
            new[b] += 0.85 * rank[a] / sum(x == a for x, _ in pairs)
        rank = new
    assert as_map(G.pagerank(edges(spark, text)), "node", "rank") == pytest.approx(rank, abs=1e-12)


def test_layers_and_skips(spark):
    e = edges(spark, "A>B B>C A>C C>D D>C")
    levels = G.layers(e, G.strong_components(e))
    assert as_map(levels, "node", "depth_from_roots") == {"A": 0, "B": 1, "C": 2, "D": 2}
    assert [tuple(r) for r in G.layer_skips(e, levels).collect()] == [("A", "C", 2)]


def test_cycles(spark):
    e = edges(spark, "A>B B>C C>A D>D A>D")
    got = sorted(tuple(r["chain"]) for r in G.import_cycles(e, G.strong_components(e)).collect())
    assert got == [("A", "B", "C", "A"), ("D", "D")]


def test_trace(spark):
    e = edges(spark, "h>a a>s h>b b>a s>t")
    got = G.trace(e, spark.createDataFrame([("h",)], "start string"), spark.createDataFrame([("s",), ("t",)], "node string"))
    assert [tuple(r) for r in got.collect()] == [("h", "s", ["h", "a", "s"])]


def test_communities_and_modularity(spark):
    e = edges(spark, "a>b b>c c>a x>y y>z z>x c>x")
    member = G.communities(e)
    got = as_map(member, "node", "community")
    assert sorted(got) == sorted("abcxyz") and set(got.values()) <= set(got) and len(set(got.values())) < 6
    assert not {got[n] for n in "abc"} & {got[n] for n in "yz"}
    whole = G.modularity(e, member.select("node", "community")).first()["q"]
    alone = G.modularity(e, G.nodes_of(e).withColumnRenamed("node", "community").selectExpr("community as node", "community")).first()["q"]
    assert whole > (alone or 0)


def test_henry_kafura_and_focus(spark):
    e = edges(spark, " ".join(f"u{i}>h" for i in range(4)) + " " + " ".join(f"h>v{i}" for i in range(4)))
    got = G.henry_kafura(e, spark.createDataFrame([("h", 0), ("u0", 5)], "node string, length int"))
    assert [tuple(r) for r in got.collect()] == [("h", 4, 4, 2560.0)]
    assert G.focus(edges(spark, "p.a>p.b p.b>p.c p.c>p.d"), "b", 1).count() == 3
    assert G.focus(edges(spark, "p.a>p.b"), "zz", 1).count() == 0


def test_connected_components(spark):
    pairs = [(i, i + 1) for i in range(20)] + [(100, 101), (101, 100), (7, 7), (300, 300), (None, 4)] + [(500, k) for k in range(501, 560)]
    got = as_map(connected_components(spark.createDataFrame(pairs, "src long, dst long")), "node", "component")
    assert got == {**{i: 0 for i in range(21)}, 100: 100, 101: 100, 300: 300, 500: 500, **{k: 500 for k in range(501, 560)}}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_empty_graph(spark):
    e = spark.createDataFrame([], "src string, dst string")
    assert G.pagerank(e).count() == 0 and G.betweenness(e).count() == 0 and G.strong_components(e).count() == 0


def test_communities_move_for_a_gain_above_zero_only(spark):
    """Two hubs of degree 10 joined by one edge: the gain is below zero, so neither joins the other."""
    text = " ".join([f"A>a{i}" for i in range(9)] + [f"B>b{i}" for i in range(9)] + ["A>B"])
    got = as_map(G.communities(edges(spark, text)), "node", "community")
    assert got["A"] != got["B"] and all(got[f"a{i}"] == got["A"] for i in range(9)) and all(got[f"b{i}"] == got["B"] for i in range(9))
    assert as_map(G.communities(edges(spark, "A>A")), "node", "community") == {"A": "A"}


def reached(near, s):
    todo, seen = [s], set()
    for v in todo:
        new = [w for w in near[v] if w not in seen]
        seen.update(new)
        todo += new
    return seen


def back_edge_chains(near, inside):
    """Chains of the back edges of a plain search in name order that stays ``inside`` a component."""
    chains, path, done = [], [], set()

    def walk(u):
        path.append(u)
        for v in sorted(near[u]):
            if inside[v] == inside[u] and v in path:
                chains.append((*path[path.index(v) :], v))
            elif inside[v] == inside[u] and v not in done:
                walk(v)
        done.add(path.pop())

    for u in sorted(near):
        if u not in done:
            walk(u)
    return sorted(chains)


@pytest.fixture(scope="module")
def knots(spark):
    """Components of 8, 5, 5 and 2 nodes in a row, a hub between 20 nodes on each side, and nodes that call themselves; edges, neighbours, components."""
    r = random.Random(5)
    pairs = [(f"k{i}", f"k{j}") for i in range(8) for j in range(8) if i != j and (j == (i + 1) % 8 or r.random() < 0.6)]
    for x in "xy":
        pairs += [(f"{x}{i}", f"{x}{(i + 1) % 5}") for i in range(5)] + [(f"{x}3", f"{x}1"), (f"{x}4", f"{x}4")]
    for i in range(2):
        pairs += [(f"p{i}a", f"p{i}b"), (f"p{i}b", f"p{i}a"), (f"p{i}b", f"p{i + 1}a")]
    pairs += [("k3", "p0a"), ("p2a", "x0"), ("x2", "y3"), ("é", "é"), ("é", "k7")] + [e for i in range(20) for e in ((f"s{i}", "h"), ("h", f"t{i}"))]
    near = {v: set() for e in pairs for v in e}
    for a, b in pairs:
        near[a].add(b)
    to = {v: reached(near, v) for v in near}
    return spark.createDataFrame(pairs + pairs[:9], "src string, dst string"), near, {v: min([w for w in to[v] if v in to[w]], default=v) for v in near}


def test_strong_components_write_no_pairs(spark, knots, monkeypatch):
    e, near, home = knots
    written, write = [], G.materialize

    def counted(df, name):
        out = write(df, name)
        written.append(out.count())
        return out

    monkeypatch.setattr(G, "materialize", counted)
    assert as_map(G.strong_components(e), "node", "component") == home
    assert max(written) <= sum(map(len, near.values()))


@pytest.mark.parametrize("piece, part", [(1, 1), (40, 100), (1_000_000, 4_000_000)])
def test_cycles_are_made_in_many_tasks(spark, knots, piece, part):
    e, near, home = knots
    df = G.import_cycles(e, spark.createDataFrame(list(home.items()), "node string, component string"), piece, part)
    want = back_edge_chains(near, home)
    assert sorted(tuple(r["chain"]) for r in df.collect()) == want
    assert df.rdd.getNumPartitions() == 1 + sum(map(len, want)) // part


def test_cycles_of_nothing(spark):
    e = spark.createDataFrame([], "src string, dst string")
    assert G.import_cycles(e, spark.createDataFrame([], "node string, component string")).count() == 0
