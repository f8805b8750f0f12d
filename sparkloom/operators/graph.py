"""Graph analytics on ``edges(src, dst)``: string nodes, directed, possibly repeated edges.

Loops advance whole tables and write them between rounds (see plans.tables). Ties and
orders are broken by node name, so results are reproducible.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.plans.tables import discard, materialize


def nodes_of(edges: DataFrame, more: DataFrame | None = None) -> DataFrame:
    out = edges.select(F.col("src").alias("node")).union(edges.select("dst"))
    if more is not None:
        out = out.union(more.select("node"))
    return out.distinct()


def pagerank(edges: DataFrame, iterations: int = 20, damping: float = 0.85, every: int = 5) -> DataFrame:
    """``node, rank``: repeated edges count, dangling nodes lose their mass."""
    links = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w"))
    degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    links = materialize(links.join(degree, "src").select("src", "dst", (F.col("w") / F.col("deg")).alias("p")), "pr-links")
    nodes = materialize(nodes_of(edges), "pr-nodes")
    n = nodes.count()
    if not n:
        return nodes.withColumn("rank", F.lit(0.0))
    rank = nodes.withColumn("rank", F.lit(1.0 / n))
    old = None
    for k in range(1, iterations + 1):
        flow = links.join(rank, links.src == rank.node).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("p")).alias("in"))
        rank = nodes.join(flow, "node", "left").select("node", (F.lit((1 - damping) / n) + F.lit(damping) * F.coalesce("in", F.lit(0.0))).alias("rank"))
        if k % every == 0 and k < iterations:
            new = materialize(rank, "pr-rank")
            if old is not None:
                discard(old)
            rank = old = new
    return rank


def reachable(edges: DataFrame, starts: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    """``start, node, depth``: nodes at a distance of 1 or more from each start (all nodes by default), shortest first.

    A start is listed for itself where it lies on a cycle.
    """
    links = materialize(edges.select("src", "dst").distinct(), "reach-links")
    starts = nodes_of(links).select(F.col("node").alias("start")) if starts is None else starts.select("start").distinct()
    front = materialize(starts.join(links, F.col("start") == F.col("src")).select("start", F.col("dst").alias("node"), F.lit(1).alias("depth")).distinct(), "reach-front")
    seen, depth = front, 1
    while not front.isEmpty() and (max_depth is None or depth < max_depth):
        depth += 1
        step = front.select("start", F.col("node").alias("src")).join(links, "src").select("start", F.col("dst").alias("node")).distinct()
        front = materialize(step.join(seen, ["start", "node"], "left_anti").withColumn("depth", F.lit(depth)), "reach-front")
        seen = seen.union(front)
    return seen


def blast_radius(edges: DataFrame) -> DataFrame:
    """``node, blast``: number of distinct transitive callers, itself left out; nodes without callers have 0."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    counts = reachable(back).where("start <> node").groupBy(F.col("start").alias("node")).agg(F.count(F.lit(1)).alias("blast"))
    return nodes_of(edges).join(counts, "node", "left").fillna(0, ["blast"])


def hotspots(edges: DataFrame, top: int = 20) -> DataFrame:
    """``node, rank, blast``: PageRank of 30 rounds to four digits with the blast radius; the top ones by rank, then name."""
    rows = pagerank(edges, 30).join(blast_radius(edges), "node").where("rank >= 0.001 or blast >= 3")
    return rows.select("node", F.round("rank", 4).alias("rank"), "blast").orderBy(F.desc("rank"), "node").limit(top)


def _trimmed(links: DataFrame) -> DataFrame:
    """Written ``links`` without those of nodes that nothing enters or leaves, again and again; deletes what it was given."""
    left = links.count()
    while left:
        entered, leaving = links.select(F.col("dst").alias("src")).distinct(), links.select(F.col("src").alias("dst")).distinct()
        new = materialize(links.join(entered, "src", "left_semi").join(leaving, "dst", "left_semi").select("src", "dst"), "scc-links")
        discard(links)
        links, before, left = new, left, new.count()
        if left == before:
            break
    return links


def strong_components(edges: DataFrame, closure: DataFrame | None = None) -> DataFrame:
    """``node, component``: the smallest node that reaches it and is reached by it, itself included.

    Without a ``closure`` no pairs of nodes are listed: each node takes the smallest label of
    those that reach it; the nodes that reach the owner of their label are its component.
    They are taken out, links between labels dropped, and the rest goes on with other labels.
    """
    if closure is not None:
        reach = closure.select("start", "node")
        back = reach.select(F.col("node").alias("start"), F.col("start").alias("node"))
        mutual = reach.join(back, ["start", "node"]).groupBy(F.col("start").alias("node")).agg(F.min("node").alias("m"))
        return nodes_of(edges).join(mutual, "node", "left").select("node", F.least("node", F.coalesce("m", "node")).alias("component"))
    named = materialize(edges.select("src", "dst").where("src <> dst").distinct(), "scc-named")
    ids = materialize(nodes_of(named).withColumn("id", F.monotonically_increasing_id()), "scc-ids")
    a, b = ids.select(F.col("node").alias("src"), F.col("id").alias("i")), ids.select(F.col("node").alias("dst"), F.col("id").alias("j"))
    links = materialize(named.join(a, "src").join(b, "dst").select(F.col("i").alias("src"), F.col("j").alias("dst")), "scc-links")
    discard(named)
    members, turn = ids.select("id", F.lit(-1).alias("turn"), F.col("id").alias("label")).limit(0), 0
    while not (links := _trimmed(links)).isEmpty():
        # xxhash64 maps numbers one to one, so labels are distinct; other ones each turn, so that no order of the nodes takes many turns
        own = F.xxhash64("id", F.lit(turn))
        labels = materialize(links.select(F.col("src").alias("id")).distinct().select("id", own.alias("label")), "scc-labels")
        while True:
            step = links.join(labels, links.src == labels.id).groupBy(F.col("dst").alias("id")).agg(F.min("label").alias("low"))
            new = materialize(labels.join(step, "id").select("id", F.least("label", "low").alias("label"), (F.col("low") < F.col("label")).alias("moved")), "scc-labels")
            discard(labels)
            labels = new.select("id", "label")
            if new.where("moved").isEmpty():
                break
        x, y = labels.select(F.col("id").alias("src"), F.col("label").alias("k")), labels.select(F.col("id").alias("dst"), F.col("label").alias("l"))
        inner = materialize(links.join(x, "src").join(y, "dst").where("k = l").select("src", "dst"), "scc-links")
        discard(links)
        front = seen = materialize(labels.where(F.col("label") == own), "scc-front")
        while not front.isEmpty():
            step = inner.join(front, inner.dst == front.id).select(F.col("src").alias("id"), "label").distinct()
            front = materialize(step.join(seen, "id", "left_anti"), "scc-front")
            seen = seen.union(front)
        members = members.union(seen.select("id", F.lit(turn), "label"))
        out = seen.select("id")
        links = materialize(inner.join(out.withColumnRenamed("id", "src"), "src", "left_anti").join(out.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst"), "scc-links")
        discard(inner, new)
        turn += 1
    rows = materialize(members.join(ids, "id").select("node", "turn", "label"), "scc-members")
    low = rows.groupBy("turn", "label").agg(F.min("node").alias("component"))
    return nodes_of(edges).join(rows.join(low, ["turn", "label"]).select("node", "component"), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def clusters(edges: DataFrame, components: DataFrame, top: int = 10) -> DataFrame:
    """``component, size, nodes, cut``: components of two or more nodes and the edge to cut.

    The cut leaves the node with most edges inside the component (the first by name of
    equals) towards the first of its neighbours.
    """
    a, b = components.select(F.col("node").alias("src"), F.col("component").alias("c")), components.select(F.col("node").alias("dst"), F.col("component").alias("d"))
    inner = edges.join(a, "src").join(b, "dst").where("c = d")
    out = inner.groupBy("c", "src").agg(F.count(F.lit(1)).alias("k"), F.min("dst").alias("to"))
    cut = out.groupBy(F.col("c").alias("component")).agg(F.min(F.struct((-F.col("k")).alias("m"), "src", "to")).alias("b"))
    sizes = components.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.array_sort(F.collect_list("node")).alias("nodes")).where("size >= 2")
    rows = sizes.join(cut, "component").select("component", "size", "nodes", F.concat("b.src", F.lit(" → "), "b.to").alias("cut"))
    return rows.orderBy(F.desc("size"), "component").limit(top)


def layers(edges: DataFrame, components: DataFrame) -> DataFrame:
    """``node, depth_from_roots``: the longest path of components from one that nothing enters."""
    a, b = components.select(F.col("node").alias("src"), F.col("component").alias("c")), components.select(F.col("node").alias("dst"), F.col("component").alias("d"))
    links = materialize(edges.join(a, "src").join(b, "dst").where("c <> d").select("c", "d").distinct(), "layer-links")
    level = materialize(components.select("component").distinct().withColumn("depth", F.lit(0)), "layer-level")
    while True:
        step = links.join(level, links.c == level.component).groupBy("d").agg((F.max("depth") + 1).alias("up"))
        new = level.join(step, level.component == step.d, "left").select("component", F.greatest("depth", F.coalesce("up", F.lit(0))).alias("depth"))
        new = materialize(new, "layer-level")
        before, after = (x.agg(F.sum("depth")).first()[0] for x in (level, new))
        discard(level)
        level = new
        if before == after:
            return components.join(level, "component").select("node", F.col("depth").alias("depth_from_roots"))


def layer_skips(edges: DataFrame, levels: DataFrame) -> DataFrame:
    """``src, dst, skipped``: edges that pass over layers."""
    a, b = levels.select(F.col("node").alias("src"), F.col("depth_from_roots").alias("x")), levels.select(F.col("node").alias("dst"), F.col("depth_from_roots").alias("y"))
    return edges.select("src", "dst").distinct().join(a, "src").join(b, "dst").where("y - x > 1").select("src", "dst", (F.col("y") - F.col("x")).alias("skipped"))


def henry_kafura(edges: DataFrame, lengths: DataFrame, least: float = 1000.0, top: int = 20) -> DataFrame:
    """``node, fan_in, fan_out, flow``: length * (fan_in * fan_out)^2 above ``least``. ``lengths``: ``node, length`` (10 where not positive)."""
    fan_in = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("fan_in"))
    fan_out = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("fan_out"))
    rows = lengths.join(fan_in, "node", "left").join(fan_out, "node", "left").fillna(0, ["fan_in", "fan_out"])
    size = F.when(F.col("length") > 0, F.col("length")).otherwise(10).cast("double")
    rows = rows.select("node", "fan_in", "fan_out", (size * F.pow(F.col("fan_in") * F.col("fan_out"), 2)).alias("flow")).where(F.col("flow") > least)
    return rows.orderBy(F.desc("flow"), "node").limit(top)


def dependency_cells(edges: DataFrame) -> DataFrame:
    """``src, dst, n``: cells of the dependency matrix with their multiplicity."""
    return edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def betweenness(edges: DataFrame, max_nodes: int = 5000, parts: int = 8) -> DataFrame:
    """``node, score``: directed, unweighted, not normalised; repeated edges multiply paths.

    The graph is sent to the tasks, which share out the sources; above ``max_nodes`` nodes,
    a documented limit of the operator, the result is empty.
    """
    nodes = nodes_of(edges)
    if nodes.limit(max_nodes + 1).count() > max_nodes:
        return nodes.limit(0).withColumn("score", F.lit(0.0))
    counted = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w")).orderBy("src", "dst").toPandas()
    near: dict[str, list[tuple[str, int]]] = {}
    for s, d, w in zip(counted["src"], counted["dst"], counted["w"], strict=True):
        near.setdefault(s, []).append((d, int(w)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, float] = {}
        for batch in batches:
            for s in batch["node"]:
                dist, paths, order, before = {s: 0}, {s: 1.0}, [s], {}
                for v in order:  # grows while it is read
                    for w, k in near.get(v, ()):
                        if w not in dist:
                            dist[w] = dist[v] + 1
                            order.append(w)
                        if dist[w] == dist[v] + 1:
                            paths[w] = paths.get(w, 0.0) + paths[v] * k
                            before.setdefault(w, []).append((v, k))
                part = dict.fromkeys(order, 0.0)
                for w in reversed(order):
                    for v, k in before.get(w, ()):
                        part[v] += k * paths[v] / paths[w] * (1 + part[w])
                    if w != s:
                        total[w] = total.get(w, 0.0) + part[w]
        if total:
            yield pd.DataFrame({"node": pd.Series(list(total), dtype=object), "score": list(total.values())})

    sums = nodes.repartition(parts, "node").mapInPandas(run, "node string, score double").groupBy("node").agg(F.sum("score").alias("score"))
    return nodes.join(sums, "node", "left").fillna(0.0, ["score"])


def communities(edges: DataFrame, passes: int = 50) -> DataFrame:
    """``component, node, community``: local moving by modularity gain in the order of node names, one level.

    A node moves to the community of a neighbour, its own among them, with the largest
    gain above zero; of equal gains its own wins, then the smallest name.
    The method is sequential; each weakly connected component is a group of its own. A
    community is named by its smallest node.
    """
    from sparkloom.operators.components import connected_components

    # numbers given once and written are distinct, as hashes need not be
    ids = materialize(nodes_of(edges).withColumn("id", F.monotonically_increasing_id()), "community-ids")
    a, b = ids.select(F.col("node").alias("src"), F.col("id").alias("i")), ids.select(F.col("node").alias("dst"), F.col("id").alias("j"))
    parts = connected_components(edges.join(a, "src").join(b, "dst"), "i", "j")
    rows = edges.join(a, "src").join(parts, F.col("i") == F.col("node")).select("component", "src", "dst")
    m = float(edges.count())

    def run(group: pd.DataFrame) -> pd.DataFrame:
        weight: dict[str, dict[str, float]] = {}
        for s, d in zip(group["src"], group["dst"], strict=True):
            for x, y in ((s, d), (d, s)):
                row = weight.setdefault(x, {})
                row[y] = row.get(y, 0.0) + 1.0
        names = sorted(weight)
        degree = {x: sum(weight[x].values()) for x in names}
        home, total = {x: x for x in names}, dict(degree)
        for _ in range(passes):
            moved = False
            for x in names:
                into: dict[str, float] = {}
                for y, w in weight[x].items():
                    into[home[y]] = into.get(home[y], 0.0) + w
                now = best = home[x]
                top = 0.0
                for c in [now] * (now in into) + sorted(set(into) - {now}):
                    gain = into[c] / m - total[c] * degree[x] / (2 * m * m)
                    if gain > top:
                        best, top = c, gain
                if best != now:
                    total[now] -= degree[x]
                    total[best] += degree[x]
                    home[x], moved = best, True
            if not moved:
                break
        low: dict[str, str] = {}
        for x in names:
            low.setdefault(home[x], x)
        return pd.DataFrame({"component": group["component"].iloc[0], "node": pd.Series(names, dtype=object), "community": pd.Series([low[home[x]] for x in names], dtype=object)})

    return rows.groupBy("component").applyInPandas(run, "component long, node string, community string")


def modularity(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """One row ``q``: sum over adjacent ordered pairs in one community of (1 - ki kj / 2m) / 2m, edges taken both ways."""
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    degree = both.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("k"))
    m2 = both.agg(F.count(F.lit(1)).alias("m2"))
    home = membership.select("node", "community").join(degree, "node")
    rows = both.join(home.select(F.col("node").alias("src"), F.col("community").alias("c"), F.col("k").alias("ki")), "src").join(home.select(F.col("node").alias("dst"), F.col("community").alias("d"), F.col("k").alias("kj")), "dst").where("c = d")
    return rows.join(F.broadcast(m2)).agg(F.sum((1 - F.col("ki") * F.col("kj") / F.col("m2")) / F.col("m2")).alias("q"))


def misplaced(membership: DataFrame, packages: DataFrame, least: int = 3) -> DataFrame:
    """``node, pkg, suggested, here, there``: functions whose community mostly lives in another package."""
    rows = membership.join(packages, "node")
    counts = rows.groupBy("community", "pkg").agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy("community").agg(F.min(F.struct((-F.col("n")).alias("m"), "pkg")).alias("b")).select("community", F.col("b.pkg").alias("suggested"), (-F.col("b.m")).alias("there"))
    out = rows.join(counts.withColumnRenamed("n", "here"), ["community", "pkg"]).join(top, "community")
    return out.where((F.col("pkg") != F.col("suggested")) & (F.col("there") > F.col("here")) & (F.col("there") >= least)).select("node", "pkg", "suggested", "here", "there")


def import_cycles(edges: DataFrame, components: DataFrame, piece: int = 1_000_000, part: int = 4_000_000) -> DataFrame:
    """``chain``: one closed chain per back edge of a depth-first search in name order, within components of the graph.

    The search is sequential, one task per component. It writes, for each node with back
    edges, its path and where on it they end, in rows whose chains have up to ``piece``
    names together (or one chain); the chains, far longer than the graph, are made from
    these rows in as many tasks as give each about ``part`` names.
    """
    a, b = components.select(F.col("node").alias("src"), F.col("component").alias("c")), components.select(F.col("node").alias("dst"), F.col("component").alias("d"))
    inner = edges.select("src", "dst").distinct().join(a, "src").join(b, "dst").where("c = d").select("c", "src", "dst")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches([x.select(["src", "dst"]) for x in batches])
        names = pa.array(sorted(pc.unique(table["src"]).to_pylist()), table.schema.field("src").type)  # in a cycle all are sources
        src, dst = (pc.index_in(table[x], value_set=names).to_numpy() for x in ("src", "dst"))
        order = np.lexsort((dst, src))
        near, stop = dst[order].tolist(), np.cumsum(np.bincount(src, minlength=len(names))).tolist()
        todo = [0, *stop[:-1]]
        place = [-1] * len(names)  # on the path; -1 before, -2 after
        paths: list[int] = []
        path_at, ends, end_at = [0], [], [0]

        def rows() -> pa.RecordBatch:
            lists = (pa.array(x, pa.int32()) for x in (path_at, paths, end_at, ends))
            p, q, e, f = lists
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(p, names.take(q)), pa.ListArray.from_arrays(e, f)], ["path", "ends"])

        for root in range(len(names)):
            if place[root] != -1:
                continue
            path, back = [root], [[]]
            place[root] = 0
            while path:
                u = path[-1]
                for k in range(todo[u], stop[u]):
                    v = near[k]
                    if place[v] >= 0:
                        back[-1].append(place[v])
                    elif place[v] == -1:
                        todo[u], place[v] = k + 1, len(path)
                        path.append(v)
                        back.append([])
                        break
                else:
                    hits, size = sorted(back.pop()), 0
                    for k, at in enumerate(hits):
                        long = len(path) - at + 1
                        if k == 0 or size + long > piece:
                            if k:
                                end_at.append(len(ends))
                            if len(paths) + len(ends) > piece:
                                yield rows()
                                paths, path_at, ends, end_at = [], [0], [], [0]
                            first, size = at, 0
                            paths += path[at:]
                            path_at.append(len(paths))
                        ends.append(at - first)
                        size += long
                    if hits:
                        end_at.append(len(ends))
                    place[path.pop()] = -2
        yield rows()

    paths = materialize(inner.groupBy("c").applyInArrow(run, "path array<string>, ends array<int>"), "cycle-paths")
    total = paths.agg(F.sum(F.aggregate("ends", F.lit(0).cast("long"), lambda n, k: n + F.size("path") - k + 1))).first()[0] or 0
    ends = paths.repartition(1 + total // part).select("path", F.explode("ends").alias("k"))
    return ends.select(F.concat(F.slice("path", F.col("k") + 1, F.size("path") - F.col("k")), F.array(F.get("path", F.col("k")))).alias("chain"))


def trace(edges: DataFrame, starts: DataFrame, sinks: DataFrame, max_nodes: int = 10) -> DataFrame:
    """``start, sink, chain``: the shortest path from each start to each sink that no other sink lies on.

    A sink is not passed through, a start is no sink for itself, and chains have up to
    ``max_nodes`` nodes; of equally short chains the first in order is taken.
    """
    links = materialize(edges.select("src", "dst").distinct(), "trace-links")
    ends = sinks.select(F.col("node").alias("sink")).distinct()
    front = starts.select("start").distinct().select("start", F.col("start").alias("node"), F.array("start").alias("chain"))
    seen, found = front.select("start", "node"), None
    for _ in range(max_nodes - 1):
        step = front.join(links, front.node == links.src).select("start", F.col("dst").alias("node"), F.concat("chain", F.array("dst")).alias("chain"))
        step = step.groupBy("start", "node").agg(F.min("chain").alias("chain")).join(seen, ["start", "node"], "left_anti")
        step = materialize(step, "trace-front")
        if step.isEmpty():
            break
        seen = seen.union(step.select("start", "node"))
        hits = step.join(ends, step.node == ends.sink).select("start", "sink", "chain")
        found = hits if found is None else found.union(hits)
        front = step.join(ends, step.node == ends.sink, "left_anti")
    return found if found is not None else edges.sparkSession.createDataFrame([], "start string, sink string, chain array<string>")


def focus(edges: DataFrame, root: str, depth: int = 3) -> DataFrame:
    """``node, depth``: nodes within ``depth`` steps of the node that equals or ends in ``.root``, along edges either way."""
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    roots = nodes_of(edges).where((F.col("node") == root) | F.col("node").endswith("." + root)).agg(F.min("node").alias("start")).where("start is not null")
    around = reachable(both, roots, depth if depth > 0 else 3).where("start <> node")
    return around.select("node", "depth").union(roots.select("start", F.lit(0)))


def matrix_order(cells: DataFrame, levels: DataFrame) -> DataFrame:
    """``node, position``: order of the dependency matrix, importers first, then by name."""
    from pyspark.sql import Window

    nodes = nodes_of(cells).join(levels, "node")
    return nodes.select("node", (F.row_number().over(Window.orderBy("depth_from_roots", "node")) - 1).alias("position"))
