"""Graph queries on the whole import graph, against brute force on small tables."""

import random
from collections import Counter

import pytest

from sparkloom.queries import QUERIES


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    r = random.Random(3)
    names = ["Brand#1/1", "Brand#1/7", "Brand#25/1", "Brand#25/2"] + [f"Brand#{2 + i // 3}/{i}" for i in range(14)]
    # a chain of eight nodes to a sink, a cycle, and edges that mostly go forward; some are seen once, some often
    pairs = [(names[0], names[4])] + [(names[k], names[k + 1]) for k in range(4, 9)] + [(names[9], names[2]), (names[12], names[11]), (names[11], names[12])]
    for _ in range(14):
        a, b = sorted(r.sample(range(10, 18), 2))
        pairs.append((names[a], names[b]))
    pairs += [(names[1], names[12]), (names[17], names[3]), (names[9], names[10])]
    weighted = [p for k, p in enumerate(pairs) for _ in range(1 + 5 * (k % 3 == 0))]
    d = tmp_path_factory.mktemp("imports")
    parts = [(i + 1, n.split("/")[0], int(n.split("/")[1]), "t", "red ring", 1.0) for i, n in enumerate(names)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_size int, p_type string, p_name string, p_retailprice double").write.parquet(f"{d}/part.parquet")
    items = [(o, k + 1, names.index(x) + 1) for o, p in enumerate(weighted) for k, x in enumerate(p)]
    spark.createDataFrame(items, "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(f"{d}/lineitem.parquet")
    near = {}
    for a, b in set(pairs):
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set())
    return str(d), near


def distances(near, s):
    dist, todo = {s: 0}, [s]
    for v in todo:
        for w in near[v]:
            if w not in dist:
                dist[w] = dist[v] + 1
                todo.append(w)
    return dist


def got(spark, d, name):
    return QUERIES[f"{name}_imports"](spark, d).collect()


def test_reach(spark, graph):
    d, near = graph
    to = {s: set(distances(near, s)) for s in near}
    blast = {v: sum(v in to[s] for s in near if s != v) for v in near}
    assert {r["node"]: r["blast"] for r in got(spark, d, "blast_radius")} == blast
    home = {v: min(w for w in to[v] if v in to[w]) for v in near}
    assert {r["node"]: r["component"] for r in got(spark, d, "strong_components")} == home
    sizes = {c: n for c, n in Counter(home.values()).items() if n > 1}
    assert sizes and {r["component"]: r["size"] for r in got(spark, d, "clusters")} == sizes
    depth = dict.fromkeys(near, 0)
    for _ in near:
        for a in near:
            for b in near[a]:
                if home[a] != home[b]:
                    up = max(depth[b], depth[a] + 1)
                    depth.update({x: up for x in near if home[x] == home[b]})
    assert {r["node"]: r["depth_from_roots"] for r in got(spark, d, "layers")} == depth
    assert {(r["src"], r["dst"], r["skipped"]) for r in got(spark, d, "layer_skips")} == {(a, b, depth[b] - depth[a]) for a in near for b in near[a] if depth[b] - depth[a] > 1}
    order = sorted(near, key=lambda x: (depth[x], x))
    assert {r["node"]: r["position"] for r in got(spark, d, "matrix_order")} == {x: k for k, x in enumerate(order)}
    spots = got(spark, d, "hotspots")
    assert len(spots) == min(20, len(near)) and all(r["blast"] == blast[r["node"]] for r in spots)
    chains = [r["chain"] for r in got(spark, d, "import_cycles")]
    assert chains and all(c[0] == c[-1] and all(b in near[a] for a, b in zip(c, c[1:], strict=False)) for c in chains)


def test_paths(spark, graph):
    d, near = graph
    dist = {s: distances(near, s) for s in near}

    def paths(s, t):
        return 1 if s == t else sum(paths(s, v) for v in near if t in near[v] and dist[s].get(v, 99) + 1 == dist[s][t])

    score = dict.fromkeys(near, 0.0)
    for s in near:
        for t in dist[s]:
            for v in dist[s]:
                if v not in (s, t) and s != t and t in dist[v] and dist[s][v] + dist[v][t] == dist[s][t]:
                    score[v] += paths(s, v) * paths(v, t) / paths(s, t)
    assert {r["node"]: r["score"] for r in got(spark, d, "betweenness")} == pytest.approx(score, abs=1e-5)

    ends = {x for x in near if x.startswith("Brand#25/")}
    want = {}
    for s in ("Brand#1/1", "Brand#1/7"):
        todo = [[s]]
        for c in todo:
            if c[-1] in ends:
                want[s, c[-1]] = min(want.get((s, c[-1]), c), c, key=lambda x: (len(x), x))
            elif len(c) < 10:
                todo += [[*c, w] for w in near[c[-1]] if w not in c]
    chains = {(r["start"], r["sink"]): r["chain"] for r in got(spark, d, "trace")}
    assert chains == want and max(map(len, chains.values())) > 5

    both = {x: near[x] | {y for y in near if x in near[y]} for x in near}
    assert {r["node"]: r["depth"] for r in got(spark, d, "focus")} == {x: k for x, k in distances(both, "Brand#1/7").items() if k <= 2}


def test_groups(spark, graph):
    d, near = graph
    both = [(a, b) for a in near for b in near[a]] + [(b, a) for a in near for b in near[a]]
    k, m2 = Counter(a for a, _ in both), len(both)
    q = sum((1 - k[a] * k[b] / m2) / m2 for a, b in both if a.split("/")[0] == b.split("/")[0])
    assert got(spark, d, "modularity")[0]["q"] == pytest.approx(q, abs=1e-7)
    homes = {r["node"]: r["community"] for r in got(spark, d, "communities")}
    assert homes.keys() == near.keys() and 1 < len(set(homes.values())) < len(near)
