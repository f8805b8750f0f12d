"""Web pages, archives and vectors."""

import base64
import gzip
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import html_text, pivot_index, warc

WEIGHTS = html_text.fit([])


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("plain  text", "plain text"), ("<p>a<p>b", "a\n\nb"), ("<p>a<br>b</p>", "a b"), ("<p>a <b>b</b>c</p>", "a bc"),
    ("<nav>x y z</nav><article><h1>T</h1><p>a &amp; b&eacute;</p><div class='ad'>buy</div><p>c</p><form>f</form></article><footer>z</footer>", "T\n\na & bé\n\nc"),
    ("<div class='notice'>n n n</div><p>Hello world</p><div id='comments'><p>c c c c c</p></div>", "Hello world"),
    ("<div class='page has-sidebar'><div class='sidebar'>s s</div><p>body text here</p></div>", "body text here"),
    ("<script>var t='</p>';</script><p>x</p><style>p{}</style >", "x"), ("<p>a<!-- <p>no</p> -->b</p>", "ab"), ("<p>a<!-- open", "a"), ("<script>never closed", ""),
    ("<a \"broken <p>hi</p>", "hi"), ("<article><header><h1>T</h1></header><p>x<aside>no</aside>y</p><ul><li>1<li>2</ul></article>", "T\n\nx\n\ny\n\n1\n\n2"),
    # no article, main, or telling name
    ("<div><ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul></div><p>First words.</p><p>Second ones.</p><p>Copyright 2024 by us</p>", "First words.\n\nSecond ones."),
    ("<div><ul><li><a href=x>Home</a></li></ul></div><div><p>First words of it.</p><p>Second.</p></div><div>(c) 2024 Example</div>", "First words of it.\n\nSecond."),
    ("<article><p>one</p></article><nav><a>x</a></nav><article><p>two words</p></article>", "one\n\ntwo words"), ("<h1>Before</h1><article><p>one two</p></article>", "Before\n\none two"),
    ("<article><p>a</p><section class=comments><p>" + "long reply " * 500 + "</p></section></article>", "a"), ("<nav><a href=x>only a menu</a></nav>", ""),
    ("<p hidden>no</p><p>yes</p><p style='display:none'>no</p>", "yes"), ("<P>UP</P>", "UP"), ("<p>1 < 2</p>", "1 < 2"),
])
def test_extract(page, want):
    assert html_text.extract(page, WEIGHTS) == want


def test_best_run():
    r = random.Random(1)
    assert html_text.best_run([2, -9, 5, -1, 4, -1, -9, 1]) == (2, 4) and html_text.best_run([-1.0]) is None and html_text.best_run([]) is None
    for _ in range(300):
        score = [r.choice([-3, -1.5, -0.5, 1, 2, 4]) for _ in range(r.randint(1, 12))]
        best = max(sum(score[i : j + 1]) for i in range(len(score)) for j in range(i, len(score)))
        got = html_text.best_run(score)
        assert best <= 0 if got is None else sum(score[got[0] : got[1] + 1]) == best


def brute_extract(page, weights):
    """Cut negative elements from the inside out on a tree, then try every run."""
    got = html_text.read(page)
    p = [weights.probability(x) for x in got.paths]
    tree, open_ = [], {}
    level = [tree]
    for i, (kind, path, ref, n, text) in enumerate(got.tokens):
        if kind == "o" and any(t[0] == "c" and t[2] == i for t in got.tokens):
            level[-1].append([])
            level.append(level[-1][-1])
            level[-1].append((-weights.price * max(0.01, 1 - p[path]), None, i))
            open_[i] = n
        elif kind == "c":
            level[-1].append((-weights.price * max(0.01, 1 - p[path]), None, n))
            level.pop()
        else:
            level[-1].append((max(1e-6, 2 * p[path] - 1) * n, (ref, text, n), i) if kind == "w" else (-weights.price * max(0.01, 1 - p[path]), None, i))

    def flat(node):
        out = [y for x in node for y in (flat(x) if isinstance(x, list) else [x])]
        plain = node is tree or node[-1][2] is True
        return [] if not plain and sum(x[0] for x in out) < 0 else out

    left = flat(tree)
    runs = [(sum(x[0] for x in left[i : j + 1]), -i, -j) for i in range(len(left)) for j in range(i, len(left))]
    if not runs or max(runs)[0] <= 0:
        return ""
    top = max(x[0] for x in runs)
    _, i, j = max(x for x in runs if x[0] > top - 1e-9)
    inside = [x[1][0] for x in left[-i : -j + 1] if x[1] and x[1][2]]
    texts = {}
    for _, word, _ in left:
        if word and inside and inside[0] <= word[0] <= inside[-1]:
            texts[word[0]] = texts.get(word[0], "") + word[1]
    return "\n\n".join(y for y in (" ".join(x.split()) for _, x in sorted(texts.items())) if y)


def test_extract_against_brute_force():
    r = random.Random(8)
    price = html_text.Weights(WEIGHTS.by, WEIGHTS.bias, 3.0)

    def element(depth):
        tag = r.choice(["div", "p", "ul", "li", "nav", "article", "section", "span", "a", "div class=ad", "div class=notice", "h1", "form"])
        inner = "".join(element(depth + 1) if depth < 4 and r.random() < 0.5 else " " + "w " * r.randint(0, 4) for _ in range(r.randint(1, 3)))
        return f"<{tag}>{inner}</{tag.split()[0]}>"

    some = 0
    for _ in range(250):
        page = "".join(element(0) for _ in range(r.randint(1, 3)))
        for weights in (WEIGHTS, price):
            want = brute_extract(page, weights)
            assert html_text.extract(page, weights) == want, page
            some += bool(want)
    assert some > 100


def test_the_scan_decides():
    page = "<div>Top line</div><div><div>in a box</div></div><article><p>Some text of the page.</p><div class=ad>buy</div></article><footer>below</footer>"
    free = html_text.Weights(WEIGHTS.by, WEIGHTS.bias, 0.0)
    assert html_text.extract(page, free) != html_text.extract(page, WEIGHTS) and "below" in html_text.extract(page, free)


def test_main_text(spark):
    page = "<html><head><title>t</title></head><body><nav><a>m</a></nav><article><h1>Head</h1><p>one two three</p></article><footer>f</footer></body></html>"
    rows = spark.createDataFrame([(1, "u", page), (2, None, None), (None, "v", ""), (3, "w", "<p>" + "long " * 20000 + "</p>"), (3, "w", page)], "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("n_chars", F.lit("z"))
    got = html_text.main_text(rows, html_text.learn(rows)).collect()
    assert sorted(((r["page_id"] or 0), r["n_chars"]) for r in got) == [(0, 0), (1, 19), (2, 0), (3, 19), (3, 99999)]
    assert html_text.main_text(rows.limit(0), html_text.learn(rows.limit(0))).count() == 0


def test_weights_from_labelled_pages(spark):
    pages = [f"<div class=zzz><p>{'x ' * 9}</p></div><article><p>{'w ' * n}</p><p>more text</p></article>" for n in range(5, 25)]
    unseen = "<div class=zzz><p>words of a box</p></div><p>main text</p>"
    assert "box" in html_text.extract(unseen, WEIGHTS)
    weights = html_text.fit([html_text.read(x) for x in pages])
    assert html_text.extract(unseen, weights) == "main text"
    # null and repeated pages do not crowd out the others
    rows = spark.createDataFrame([(x,) for x in pages + [None] * 500 + ["<article><p>same</p></article>"] * 500], "html string")
    assert html_text.extract(unseen, html_text.learn(rows, sample=30)) == "main text"
    assert vars(html_text.learn(rows.limit(0))) == vars(WEIGHTS)


def b32(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


PAGES = [(1, "http://a/x y\r\nz", "same"), (2, "http://b", "same"), (3, None, None), (4, "http://c", ""), (5, "http://d", "a\r\n\r\nWARC/1.1\r\n\r\nb\r\n\r\n"), (6, "http://e", "ü" * 3000), (7, "http://f", "same"), (7, "http://f", "same"), (None, "http://g", "same"), (None, "http://h", "alone")]


def test_archives(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("sparkloom.llm.skew.hot_limit", lambda total: 3)
    rows = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("n", F.lit(1)).withColumn("sha1", F.lit(1))
    for packed in ("gzip", "none"):
        warc.write_warc(rows, f"file://{tmp_path}/{packed}", compression=packed)
    found = warc.captures(warc.read_records(spark, f"file://{tmp_path}/none")).collect()
    unique = [p for p in PAGES if p[0] is not None and p[0] != 7]
    body = {r["metadata"]["page_id"]: bytes(r["response"]["payload"]) for r in found if r["metadata"]["page_id"] in (3, 4, 5, 6) and r["response"]["payload"] is not None}
    assert body == {i: (h or "").encode() for i, _, h in unique if i in (4, 5, 6)} and len(found) == len(PAGES)
    again = warc.archive_round_trip(rows, f"file://{tmp_path}/twice").collect()
    assert sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in again if r["payload_bytes"] == 4) == [(0, "revisit", 7), (1, "revisit", 7), (2, "revisit", 7), (7, "response", None), (7, "response", None)]
    got = warc.archive_round_trip(rows.where("page_id < 7"), f"file://{tmp_path}/again").collect()
    want = {1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None), 6: ("response", None)}
    html = {i: (h or "").encode() for i, _, h in PAGES}
    assert {r["page_id"]: (r["record_type"], r["refers_to"]) for r in got} == want
    assert all(r["payload_bytes"] == len(html[r["page_id"]]) and r["payload_digest"] == b32(html[r["page_id"]]) for r in got)
    assert warc.archive_round_trip(rows.limit(0), f"file://{tmp_path}/empty").count() == 0


def test_files_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 4000)
    monkeypatch.setattr(warc, "SIZES", (100, 1000, 4000, None))
    pages = [(i, "http://a", "p" * n + str(i)) for i, n in enumerate([*[50] * 100, *[900] * 20, 3000, 3500, 20_000, 90_000])]
    rows = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    got = warc.archive_round_trip(rows, f"file://{tmp_path}/w").collect()
    assert {x["page_id"]: x["payload_bytes"] for x in got} == {i: len(h) for i, _, h in pages}
    held = [sum(x[8] or 0 for x in warc.parse(f.read_bytes())) for f in sorted(tmp_path.glob("w/size-*/part-*"))]
    assert all(n <= 4000 or n > 20_000 for n in held) and len(held) >= 5


def test_parse_by_record_gzip():
    one = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nContent-Length: 27\r\n\r\nHTTP/1.1 200 OK\r\n\r\n\r\n\r\nbody\r\n\r\n"
    rows = list(warc.parse(gzip.compress(one) + gzip.compress(one)))
    assert len(rows) == 2 and rows[0][-1] == b"\r\n\r\nbody"
    with pytest.raises(ValueError):
        list(warc.parse(b"nonsense"))


def brute_vectors(rows, threshold):
    good = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n = {i: 0 for i, _ in rows}
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(good)):
        for b in range(a):
            (i, x), (j, y) = good[a], good[b]
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                n[i] += 1
                n[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: (n[i], find(i), find(i) == i) for i, _ in rows}


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr("sparkloom.llm.skew.hot_limit", lambda total: 4)
    r = np.random.default_rng(0)
    base = r.normal(size=(40, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(100 + i, (base[i % 5] + 0.1 * r.normal(size=16)).tolist()) for i in range(60)]
    rows += [(200 + i, base[1].tolist()) for i in range(30)] + [(300, (base[1] * 7).tolist())]
    rows += [(400, None), (401, []), (402, [0.0] * 16), (403, [1.0, None] + [0.0] * 14), (404, [float("nan")] * 16), (405, [float("inf")] * 16), (406, [1.0, 2.0]), (407, [2.0, 4.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("w", F.lit(1)).withColumn("key", F.lit(2))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in pivot_index.near_duplicate_vectors(frame, 0.9, pivots=16, nearest=8, shared=2, block=32).collect()}
    want = brute_vectors(rows, 0.9)
    assert len(got) == len(rows) and all(got[i][0] <= want[i][0] for i in got)
    assert sum(x[0] for x in got.values()) >= 0.97 * sum(x[0] for x in want.values())
    assert all(got[i] == want[i] for i in range(400, 408))
    assert pivot_index.near_duplicate_vectors(frame.limit(0)).count() == 0


def unit(r, n):
    x = r.normal(size=(n, 64))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def pairs_at(r, n, cos):
    x, z = unit(r, n), unit(r, n)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    return x, cos * x + np.sqrt(1 - cos * cos) * z


@pytest.mark.parametrize("n", [2_000, 50_000, 10**9])
def test_recall_at_the_threshold(n):
    """Shared near pivots find at least 0.97 of pairs right at the threshold, whatever the number of pivots."""
    r = np.random.default_rng(1)
    pivots = pivot_index.number_of_pivots(n, 64)
    base = pivot_index.choose_pivots(unit(r, 2 * pivots), pivots)
    assert len(base) == pivots <= pivot_index.MOST
    a, b = (pivot_index.nearest_pivots(v, base, pivot_index.NEAREST) for v in pairs_at(r, 1000, 0.9))
    assert ((a[:, :, None] == b[:, None, :]).sum((1, 2)) >= pivot_index.SHARED).mean() >= 0.97


def test_planted_links(spark):
    """Pairs and a large group with their links, among unrelated vectors, in production settings."""
    r = np.random.default_rng(3)
    x, y = pairs_at(r, 300, 0.91)
    centre = unit(r, 1)
    group = centre + 0.02 * r.normal(size=(1500, 64))
    rows = [(i, v.astype("float32").tolist()) for i, v in enumerate(np.concatenate([x, y, group, unit(r, 1500)]))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r for r in pivot_index.near_duplicate_vectors(frame, 0.9).collect()}
    v = np.array([x for _, x in rows], dtype="float64")
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    want = ((v @ v.T) >= 0.9).sum(1) - 1
    found = np.array([got[i]["n_links"] for i in range(len(rows))])
    assert (found <= want).all() and found[:600].sum() >= 0.95 * want[:600].sum() and found.sum() >= 0.98 * want.sum()
    assert all(got[i]["component_id"] == (600 if 600 <= i < 2100 else i) for i in range(600, len(rows)))
