"""The operators on documents: messy rows, and brute force."""

import hashlib
import random
import re
import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkloom.llm import exact_dedup, language_id, license_scan, mixing, piece_bpe, queries, simhash, token_rollup
from sparkloom.operators import components
from sparkloom.plans import tables

MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORDS = "the quick brown fox jumps over lazy dogs while seven grey wolves sleep under old oak trees near quiet rivers".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", ",", "."]) for _ in range(n))


LONG = prose(1, 60)
ROWS = [
    (1, LONG, "en", "a"), (2, LONG.replace(" ", "\n", 3), "en", "a"), (3, LONG + " again", "en", "b"), (4, None, None, None), (5, "", "en", "a"), (6, " \t\n", None, "b"),
    (7, "ÄÖ ü 😀 ▁x", "de", "c"), (8, "12 34", "en", "a"), (9, "All rights reserved. CC BY 4.0, cc by", "en", "a"), (9, "All rights reserved. CC BY 4.0, cc by", "en", "a"), (None, "no id here", "en", None), (10, "x" * 5000, "en", "a"),
] + [(100 + i, prose(i, 30 + i), "en", "hot") for i in range(20)]


@pytest.fixture(scope="module")
def docs(spark):
    # extra columns with names that operators use themselves
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").withColumn("keep_id", F.lit(0)).withColumn("n", F.lit("x")).withColumn("h", F.lit(1)).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_agenda_matches_library():
    c = piece_bpe.PieceCodec(MODEL)
    r = random.Random(5)
    alphabet = "ab the▁ \n\tñé😀\0" + "０"
    texts = ["", " ", "a  b ", "\n\na", "é́ ﬁ Ａ", "aaaa" * 300] + ["".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(400)] + [prose(k, 40) for k in range(20)]
    raw = c.encode_bytes(texts)
    for text, ids in zip(texts, raw, strict=True):
        assert array("I", c.lib.encode(text, add_bos=True, add_eos=True)).tobytes() == ids, repr(text)
    c.check(texts, raw)
    short = [x for x in c.memory if x and len(x) <= piece_bpe.SHORT and c.known.issuperset(x)]
    assert c.side_by_side(short) == [array("I", c.merged(x)).tobytes() for x in short]
    c.memory[" quick"] = b"\0\0\0\0"
    c.fresh.append(" quick")
    with pytest.raises(AssertionError):
        c.check([], [])


def test_memory_ages():
    c = piece_bpe.PieceCodec(MODEL, remember=50)
    for k in range(20):
        texts = [prose(k, 30), "".join(chr(97 + (k * 7 + j) % 26) for j in range(40))]
        c.check(texts, c.encode_bytes(texts))
    assert len(c.memory) <= 200


def test_encode_decode(spark, docs, empty):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = piece_bpe.encode_decode(docs, MODEL).collect()
    assert len(got) == len(ROWS)
    want = {}
    for i, t, *_ in ROWS:
        ids = lib.encode(t or "", add_bos=True, add_eos=True)
        want[i] = (len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest())
    assert all(tuple(r)[1:] == want[r["doc_id"]] for r in got)
    assert piece_bpe.encode_decode(empty, MODEL).count() == 0
    back = {r["doc_id"]: r["text"] for r in piece_bpe.decode(piece_bpe.encode(docs.where("doc_id < 9"), MODEL), MODEL).collect()}
    assert back[3] == LONG + " again" and back[4] == ""


def exact_brute():
    groups = {}
    for i, t, *_ in ROWS:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i if i is not None else float("inf")))
    return {k: (min(v)[1], len(v)) for k, v in groups.items()}


def test_exact_dedup(docs, empty, monkeypatch):
    want = exact_brute()
    monkeypatch.setattr("sparkloom.llm.skew.hot_limit", lambda total: 3)  # both ways of the lookup
    got = exact_dedup.exact_dedup(docs)
    assert set(docs.columns) < set(got.columns)
    rows = got.collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "")
        keep, n = want[norm]
        assert r["keep_id"] == (None if keep == float("inf") else keep) and r["group_size"] == n
        assert r["text_sha256"] == hashlib.sha256(norm.encode()).hexdigest() and r["kept"] == (r["doc_id"] == r["keep_id"])
    left = exact_dedup.deduplicated(docs)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.where("doc_id < 10").collect()) == [1, 3, 6, 7, 8, 9]
    assert all(r["keep_id"] == 0 and r["n"] == "x" and r["h"] == 1 for r in left.collect())
    clash = docs.withColumn("_norm", F.lit(1)).withColumn("_sha", F.lit(2)).withColumn("_x_keep", F.lit(3)).withColumn("kept", F.lit(False)).withColumn("_hot_key", F.lit(4)).withColumn("_spread", F.lit(5))
    assert {tuple(r)[-6:] for r in exact_dedup.deduplicated(clash).collect()} == {(1, 2, 3, False, 4, 5)}
    nulls = docs.where("doc_id is null").select("doc_id", "text")
    assert exact_dedup.deduplicated(nulls.union(nulls).union(docs.where("doc_id = 9").select("doc_id", F.concat("text", F.lit(" "))))).count() == 2
    assert exact_dedup.exact_dedup(empty).count() == 0 and exact_dedup.deduplicated(empty).count() == 0


def test_digest_collision(docs, monkeypatch):
    real = F.sha2
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.concat(F.lit("00" * 31), F.lpad(F.hex(F.length(c) % 2), 2, "0")))
    rows = exact_dedup.exact_dedup(docs).collect()
    monkeypatch.setattr(exact_dedup.F, "sha2", real)
    want = exact_brute()
    assert len(rows) == len(ROWS)
    assert all(r["group_size"] == want[re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "")][1] for r in rows)


def brute_fingerprint(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for t in [r[1] for r in ROWS] + ["A b C", "É é Ü", "one"]:
        assert simhash.fingerprint(t, 4) == brute_fingerprint(t)


def test_masks_cover():
    masks, r = simhash.masks(4), random.Random(3)
    assert len(masks) == 31 and all(32 <= m.bit_count() <= 34 for m in masks)
    parts = simhash.blocks(4)
    assert sum(parts) == (1 << 64) - 1 and len(parts) == 5
    assert all(2 ** (k + 1) - 1 == len(simhash.masks(k)) for k in (0, 1, 6))
    for _ in range(5000):
        diff = sum(1 << b for b in r.sample(range(64), r.randint(0, 4)))
        assert any(not diff & m for m in masks)


def union_find(n, pairs):
    p = list(range(n))

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in pairs:
        p[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def test_covering_links(spark):
    r = random.Random(9)
    centres = [r.getrandbits(64) for _ in range(6)]
    fps = sorted({c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 6))) for c in centres for _ in range(50)} | set(centres))
    points = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    one, two = simhash.covering_links(points, 4)
    at = {simhash._signed(x): i for i, x in enumerate(fps)}
    got = union_find(len(fps), [(at[a], at[b]) for a, b in one.union(two).collect()])
    want = union_find(len(fps), [(i, j) for i, x in enumerate(fps) for j in range(i) if (x ^ fps[j]).bit_count() <= 4])
    assert got == want and len(set(got)) < len(fps)


def test_near_duplicates(docs, empty):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    ids = [(i, brute_fingerprint(t)) for i, t, *_ in ROWS]
    roots = union_find(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if (ids[a][1] ^ ids[b][1]).bit_count() <= 4])
    low = {}
    for (i, _), root in zip(ids, roots, strict=True):
        low[root] = min(low.get(root, float("inf")), float("inf") if i is None else i)
    want = {i: (f"{f:016x}", None if low[root] == float("inf") else low[root]) for (i, f), root in zip(ids, roots, strict=True)}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == want
    left = simhash.without_near_duplicates(docs)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {i for i, (_, c) in want.items() if i is None or i == c}
    assert simhash.near_duplicates(empty).count() == 0


def test_small_tables_are_few_files(spark, monkeypatch):
    """Whatever the number of shuffle partitions; their first round wrote one file for each of them."""
    files = {}

    def counted(df, name, *rows):
        out = tables.materialize(df, name, *rows)
        files[name] = max(files.get(name, 0), len(out.inputFiles()))
        return out

    monkeypatch.setattr(simhash, "materialize", counted)
    monkeypatch.setattr(components, "materialize", counted)
    conf = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    r = random.Random(4)
    texts = [" ".join(r.choice(WORDS) for _ in range(60)) for _ in range(30)]
    rows = [(i, texts[i % 30] + f" w{i}" * (i // 30)) for i in range(120)]
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = {x["doc_id"]: x["component_id"] for x in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), radius=8).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    fps = [simhash.fingerprint(t, 4) for _, t in rows]
    want = union_find(120, [(i, j) for i in range(120) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 8])
    assert [got[i] for i in range(120)] == want and len(set(want)) < 120
    own = {"simhash-rows", "simhash-more"}  # as many as the input has, and an unknown number
    assert {"simhash-points", "simhash-buckets", "simhash-links", "cc-input", "cc-edges", "simhash-named"} <= files.keys()
    assert max(n for name, n in files.items() if name not in own) == 1


def test_large_tables_keep_their_partitions(spark):
    df = spark.range(0, 80, 1, 8)
    assert [tables.packed(df, n).rdd.getNumPartitions() for n in (0, 1, 100_000, 100_001, 799_999, 10**12)] == [1, 1, 1, 2, 8, 8]
    assert sorted(x[0] for x in tables.packed(df, 80).collect()) == list(range(80))


def test_language_id(spark, docs, empty):
    de = "der schnelle braune fuchs springt über den faulen hund und schläft unter der alten eiche".split()
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(de if i % 2 else WORDS) for _ in range(40)), "de" if i % 2 else "en") for i in range(200)]
    train = spark.createDataFrame([*rows, (900, "ignored", None), (901, None, "en"), (None, "some words", "en")], "doc_id long, text string, lang string")
    model = language_id.train(train)
    assert model.languages == ["de", "en"] and (model.weights == 0).mean() > 0.5
    got = {r["doc_id"]: r for r in language_id.identify(train, model).collect()}
    assert all(got[i]["lang_pred"] == lang and 0.5 <= got[i]["score"] <= 1 for i, _, lang in rows)
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, *_ in rows)
    messy = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs, model).collect()}
    assert {messy[i] for i in (4, 5, 6, 8)} == {"und"} and len(messy) == len({r[0] for r in ROWS})
    left = language_id.in_known_language(docs, model)
    assert left.columns == docs.columns and not {4, 5, 6, 8} & {r["doc_id"] for r in left.collect()}
    nothing = language_id.train(empty)
    assert language_id.identify(docs.where("doc_id = 1"), nothing).first()["lang_pred"] == "und"


def test_many_languages(spark):
    """No language is left out, and neither null ids nor repeated rows crowd out others."""
    assert language_id.places_for(200) == 16 and language_id.places_for(10**5) == 8
    words = [f"{chr(97 + a)}{chr(97 + b)}{chr(97 + a)}" for a in range(18) for b in range(14)]
    rows = [(i, " ".join([w] * 6), f"l{i:03d}") for i, w in enumerate(words)]
    rows += [(300 + i, " ".join([w] * 7), f"l{i:03d}") for i, w in enumerate(words)] + [(None, "zzz " * 4, "l000")] * 300 + [(1000, "yyy", "l001")] * 300
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4), per_language=2)
    want = {lang for i, _, lang in rows if i is None or zlib.crc32(str(i).encode()) % 4 != 2}
    assert set(model.languages) == want and len(want) > 200 and np.isfinite(model.weights).all()


def test_fit_against_coordinate_loops():
    """The vectorised update equals the textbook one, coordinate by coordinate."""
    r = np.random.default_rng(0)
    idf = 1 + r.random(1 << 8)
    rows = [("ab"[i % 2], (np.sort(r.choice(256, 5, False)) // 2 * 2 + i % 2, np.ones(5))) for i in range(40)]
    rows = [(y, (np.unique(at), np.ones(len(np.unique(at))))) for y, (at, _) in rows]
    model = language_id.fit(rows, idf, ["a", "b"])
    z, n = {}, {}

    def weight(key):
        if abs(z.get(key, 0.0)) <= language_id.L1:
            return 0.0
        return -(z[key] - np.sign(z[key]) * language_id.L1) / ((language_id.BETA + np.sqrt(n.get(key, 0.0))) / language_id.ALPHA + language_id.L2)

    data = [("ab".index(y), f) for y, f in rows]  # under 50 rows none is kept back
    for _ in range(language_id.EPOCHS):
        for y, (at, count) in data:
            x = (1 + np.log(count)) * idf[at].astype("float32")
            x = list(zip([*at, 256], [*(x / np.sqrt((x * x).sum())), 1.0], strict=True))
            w = {(j, k): weight((j, k)) for j, _ in x for k in range(2)}
            s = [sum(v * w[j, k] for j, v in x) for k in range(2)]
            p = np.exp(np.array(s) - max(s))
            p /= p.sum()
            for k in range(2):
                for j, v in x:
                    g = v * (p[k] - (k == y))
                    before = n.get((j, k), 0.0)
                    z[j, k] = z.get((j, k), 0.0) + g - (np.sqrt(before + g * g) - np.sqrt(before)) / language_id.ALPHA * w[j, k]
                    n[j, k] = before + g * g
    want = np.array([[weight((j, k)) for k in range(2)] for j in range(257)])
    assert np.allclose(model.weights, want[:256], atol=1e-4) and np.allclose(model.bias, want[256], atol=1e-4) and (want != 0).any()


def test_held_out_accuracy(spark):
    found = queries.op3_language_id(spark, "/root/testdata/sf0.001").where("held_out and lang_pred <> 'und'")
    truth = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang").where("lang is not null")
    both = found.join(truth, "doc_id").collect()
    assert len(both) > 20 and sum(r["lang_pred"] == r["lang"] for r in both) >= 0.95 * len(both)


def license_brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for phrase, label in license_scan.PHRASES.items():
        p = phrase.split()
        for k in range(len(words) - len(p) + 1):
            if words[k : k + len(p)] == p:
                places.append(k)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_license_scan(spark, docs, empty):
    more = ["all rights reserved all rights reserved", "Licensed under the very Apache License, Version 2.0!", "Licensed under many things", "ＣＣ by Kcc by cc bＹ", "the general public license cc by general public license"]
    rows = docs.select("doc_id", "text").union(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    text = {i: t for i, t in [(r[0], r[1]) for r in ROWS] + [(1000 + i, t) for i, t in enumerate(more)]}
    got = license_scan.license_scan(rows).collect()
    assert len(got) == len(ROWS) + len(more)
    for r in got:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == license_brute(text[r["doc_id"]])
    by = {r["doc_id"]: r for r in got}
    assert by[1001]["labels"] == "apache-2.0" and by[1001]["score"] >= 0.8 and by[1002]["labels"] == ""
    assert license_scan.license_scan(empty).count() == 0


def brute_labels(text):
    """Labels and score by the definition: pairs of a notice on near diagonals, merged, in a span not much longer than it."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    labels, score = set(), 0.0
    for phrase, label in license_scan.PHRASES.items():
        p = phrase.split()
        if any(words[k : k + len(p)] == p for k in range(len(words))):
            labels.add(label)
            score = 1.0
    for label, notice in license_scan.NOTICES:
        t = notice.split()
        pairs = {k: (a, b) for k, (a, b) in enumerate(zip(t, t[1:], strict=False)) if not {a, b} <= license_scan.WEAK}
        hits = sorted((i - k, k, i) for i in range(len(words) - 1) for k, g in pairs.items() if g == (words[i], words[i + 1]))
        runs = []
        for d, k, i in hits:
            if not runs or d - runs[-1][-1][0] > license_scan.NEAR:
                runs.append([])
            runs[-1].append((d, k, i))
        for run in runs:
            cover = len({k for _, k, _ in run}) / len(pairs)
            length = max(i for *_, i in run) + 2 - min(i for *_, i in run)
            if cover >= license_scan.COVER and length <= len(t) * 1.25 + license_scan.NEAR:
                labels.add(label)
                score = max(score, cover)
    return ",".join(sorted(labels)), score


def test_license_labels_against_brute_force(spark):
    r, texts = random.Random(12), []
    for _, notice in license_scan.NOTICES * 4:
        words = notice.split()
        for _ in range(r.choice([0, 0, 1, 3])):
            k = r.randrange(len(words))
            words[k : k + r.choice([0, 1])] = r.choice([["oak"], [], ["oak", "fox"]])
        texts.append(prose(r.random(), r.randint(0, 30)) + " " + " ".join(words).title() + ". " + prose(r.random(), 10))
    texts += [license_scan.NOTICES[8][1] * 2, "all rights reserved " * 40, prose(3, 200_000) + " " + license_scan.NOTICES[13][1]]
    got = license_scan.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    found = [brute_labels(texts[x["doc_id"]]) for x in got]
    assert all((x["labels"], pytest.approx(x["score"])) == want for x, want in zip(got, found, strict=True))
    assert {x for labels, _ in found for x in labels.split(",")} >= {label for label, _ in license_scan.NOTICES}


def test_mixing(spark, docs, empty):
    r = random.Random(4)
    bad = ["junk", "spam", "###", "SHOUT"]
    rows = [(i, " ".join(r.choice(bad if i % 4 == 0 else WORDS) for _ in range(50))) for i in range(200)] + [(None, "fox"), (500, None), (501, ""), (7, "fox dogs")]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tokens", F.lit(1))
    labels = spark.createDataFrame([(i, "poor" if i % 4 == 0 else "good") for i in range(0, 200, 3)] + [(3, None)], "doc_id long, domain string")
    got = mixing.mix(table, labels, {"good": 0.9, "poor": 0.1}).collect()
    assert len(got) == len(rows)
    clean = [r for r in got if r["tokens"] > 20]
    assert all((r["p_1"] > 0.5) == (r["_id"] % 4 == 0) for r in clean)
    assert all(r["copies"] == 1 and r["rate"] > 0.99 for r in clean if r["_id"] % 4)
    s = [sum(r["tokens"] * r[f"p_{k}"] * r["rate"] for r in got) for k in range(2)]
    assert s[1] / sum(s) == pytest.approx(0.1, abs=0.01)
    assert mixing.mixed(table, labels, {"good": 0.9, "poor": 0.1}).columns == table.columns
    up = mixing.mix(table, labels, {"good": 0.5, "poor": 0.5}, cap=5.0, budget=10000.0).collect()
    s = [sum(r["tokens"] * r[f"p_{k}"] * r["rate"] for r in up) for k in range(2)]
    assert s == pytest.approx([5000, 5000], rel=0.01) and max(r["copies"] for r in up) > 1
    assert mixing.mix(empty, labels.limit(0), {"good": 0.9, "poor": 0.1}).count() == 0


def test_posteriors_against_brute_force(spark):
    """Naive Bayes by its definition; these few words all have places of their own."""
    r = random.Random(7)
    rows = [(i, " ".join(r.choice(WORDS[:9] if i % 2 else WORDS[6:] + ["SPAM!"]) for _ in range(r.randint(0, 900)))) for i in range(40)]
    labels = [(i, "good" if i % 2 else "poor") for i in range(0, 40, 3)]
    domains = ("good", "poor")

    def places(text):
        runs = re.findall(r"[0-9A-Za-z\x80-\U0010FFFF]+|[!-/:-@\[-`{-~]+", text)
        return [xxhash.xxh64_intdigest(("<CAPITALS>" if len(x) > 1 and x == x.upper() != x.lower() else x.lower()).encode(), 42) for x in runs]

    counts = {d: {} for d in domains}
    text = dict(rows)
    for i, d in labels:
        at = places(text[i])
        for p in at:
            counts[d][p] = counts[d].get(p, 0) + mixing.HALF / (len(at) + mixing.HALF)
    seen = set(counts["good"]) | set(counts["poor"])
    assert len({p % mixing.PLACES for p in seen}) == len(seen)
    logs = {p: [np.log((counts[d].get(p, 0) + 1) / (sum(counts[d].values()) + len(seen) + 1)) for d in domains] for p in seen}
    prior = [np.log((sum(x == d for _, x in labels) + 1) / (len(labels) + 2)) for d in domains]
    frame, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, domain string")
    got = mixing.posteriors(frame, *mixing.classifier(frame, known, domains), domains).collect()
    assert len(got) == len(rows)
    for x in got:
        at = places(text[x["_id"]])
        z = np.array([sum(logs[p][k] - np.mean(logs[p]) for p in at if p in logs) * mixing.HALF / (len(at) + mixing.HALF) + prior[k] for k in range(2)])
        p = np.exp(z - z.max())
        assert x["tokens"] == len(at) and x["p_0"] == pytest.approx(p[0] / p.sum(), abs=1e-9)


def test_a_long_labelled_text_does_not_decide(spark):
    """One long toxic text about trees, against many short good ones, leaves trees good."""
    rows = [(i, "old oak trees near quiet rivers" if i % 2 else "vile scum of hate") for i in range(60)]
    rows += [(100, "oak trees rivers " * 20_000), (101, "quiet rivers near old trees")]
    labels = [(i, "good" if i % 2 else "toxic") for i in range(60)] + [(100, "toxic")]
    frame, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, domain string")
    got = {r["_id"]: r["p_0"] for r in mixing.posteriors(frame, *mixing.classifier(frame, known, ("good", "toxic")), ("good", "toxic")).collect()}
    assert got[101] > 0.5 and got[0] < 0.5


def test_texts_of_megabytes(spark):
    rows = [(1, "quick fox, " * 300_000, "en", "a"), (2, "quick  fox,\n" * 300_000, "en", "a"), (3, "x" * 3_000_000, "en", "a"), (4, "", None, None), (5, "der alte fuchs schläft", "de", "b")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert {r["doc_id"]: r["keep_id"] for r in exact_dedup.exact_dedup(frame).collect()} == {1: 2, 2: 2, 3: 3, 4: 4, 5: 5}
    assert {r["doc_id"]: r["fingerprint"] for r in simhash.near_duplicates(frame).collect()}[1] == f"{simhash.fingerprint(rows[0][1], 4):016x}"
    assert {r["doc_id"]: r["lang_pred"] for r in language_id.identify(frame, language_id.train(frame)).collect()}[4] == "und"
    assert {r["_id"]: r["tokens"] for r in mixing.mix(frame, spark.createDataFrame([(1, "good")], "doc_id long, domain string"), {"good": 1.0}).collect()}[1] == 900_000
    assert {r["doc_id"]: r["n_words"] for r in license_scan.license_scan(frame).collect()} == {1: 600_000, 2: 600_000, 3: 1, 4: 0, 5: 4}
    counts = token_rollup.with_piece_counts(frame, MODEL, "bpe", keep=(F.col("doc_id"),)).collect()
    lib = piece_bpe.PieceCodec(MODEL).lib
    assert {r["doc_id"]: r["n_tokens"] for r in counts} == {i: len(lib.encode(t)) for i, t, *_ in rows}


def test_registered_rollup(spark, docs, tmp_path):
    docs.drop("keep_id", "n", "h").write.parquet(f"{tmp_path}/documents.parquet")
    lib, want = piece_bpe.PieceCodec(MODEL).lib, {}
    for _, t, lang, source in ROWS:
        for name, n in (("words-1", len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))), ("piece-bpe-32k", len(lib.encode(t or "")))):
            x = want.setdefault((source, lang, name), [0, 0])
            x[0] += 1
            x[1] += n + 2
    assert {(r["source"], r["lang"], r["tokenizer"]): [r["n_docs"], r["n_tokens"]] for r in queries.op5_token_rollup(spark, str(tmp_path)).collect()} == want


def nearest_totals(members, targets, cap, budget):
    """Totals of the least squares by many small steps."""
    p, t = np.array([m[1:] for m in members]), np.array([m[0] for m in members], dtype=float)
    base, rates = t @ p, np.ones(len(t))
    for _ in range(20000):
        rates = np.clip(rates - p @ (((t * rates) @ p - budget * np.array(targets)) / base), 0, cap)
    return list((t * rates) @ p)


def test_mixing_reaches_scarce_domains(spark, tmp_path):
    r = random.Random(9)
    words = {"good": WORDS, "poor": ["junk", "spam", "click", "buy"], "toxic": ["hate", "vile", "scum"]}
    domain = ["poor" if i % 40 == 0 else "toxic" if i % 100 == 1 else "good" for i in range(400)]
    rows = [(i, " ".join(r.choice(words[d] if r.random() < 0.8 else WORDS) for _ in range(40))) for i, d in enumerate(domain)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(d == "good"), int(d == "toxic")) for i, d in enumerate(domain)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = [r.asDict() for r in queries.op4_mixing(spark, str(tmp_path)).collect()]
    names = list(queries.TARGETS)
    base, s = ([sum(r["tokens"] * r[f"p_{d}"] * k(r) for r in got) for d in names] for k in (lambda r: 1.0, lambda r: r["rate"]))
    want = [base[0] / 0.9 * w for w in queries.TARGETS.values()]
    assert base[1] < 0.5 * want[1] and s == pytest.approx(want, rel=0.003)
    assert len(got) == len(rows) and max(r["copies"] for r in got) > 1
    members = [(r["tokens"], *[r[f"p_{d}"] for d in names]) for r in got]
    assert s == pytest.approx(nearest_totals(members, list(queries.TARGETS.values()), np.inf, base[0] / 0.9), rel=0.003)


def test_mixing_with_targets_out_of_reach(spark, caplog):
    # a scarce domain stays out of reach; the third one moves slowly, because most of its rows are half good
    members = [(100, 1.0, 0.0, 0.0)] * 90 + [(100, 0.0, 1.0, 0.0)] * 2 + [(100, 0.55, 0.0, 0.45)] * 40
    table = spark.createDataFrame([(float(t), *p) for t, *p in members], "tokens double, p_0 double, p_1 double, p_2 double")
    _, reached, wanted = mixing.fit_rates(table, [0.5, 0.3, 0.2], 1.0, 6000.0)
    assert reached[1] == pytest.approx(200) and wanted[1] == pytest.approx(1800)
    assert reached == pytest.approx(nearest_totals(members, [0.5, 0.3, 0.2], 1.0, 6000.0), rel=0.003)
    texts = spark.createDataFrame([(i, "junk spam" if i == 0 else "oak tree") for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, "poor" if i == 0 else "good") for i in range(20)], "doc_id long, domain string")
    with caplog.at_level("WARNING", "sparkloom"):
        mixing.mix(texts, labels, {"good": 0.5, "poor": 0.5}, anchor="good")
    assert "mixing: poor has" in caplog.text


def test_token_rollup(spark, docs, tmp_path):
    ledger = token_rollup.TokenLedger(spark, f"file://{tmp_path}/ledger")
    assert ledger.totals().count() == 0
    counts = token_rollup.with_counts(docs, "words-1")
    assert ledger.commit("a", token_rollup.inserted(counts)) and not ledger.commit("a", token_rollup.inserted(counts))
    assert ledger.commit("b", token_rollup.revised(counts.withColumnRenamed("n_tokens", "old_tokens").withColumn("n_tokens", F.col("old_tokens") + 1)))
    assert ledger.commit("c", token_rollup.deleted(counts.where("source = 'c'").withColumn("n_tokens", F.col("n_tokens") + 1)))
    assert ledger.commit("d", token_rollup.inserted(token_rollup.with_piece_counts(docs, MODEL, "bpe")))
    want = {}
    lib = piece_bpe.PieceCodec(MODEL).lib
    for _, t, lang, source in ROWS:
        for name, n in (("words-1", len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) + 1), ("bpe", len(lib.encode(t or "")))):
            if name == "bpe" or source != "c":
                x = want.setdefault((source, lang, name), [0, 0])
                x[0] += 1
                x[1] += n
    assert {(r["source"], r["lang"], r["tokenizer"]): [r["n_docs"], r["n_tokens"]] for r in ledger.totals().collect()} == want
    import shutil

    shutil.rmtree(tmp_path / "ledger" / "batch-d")
    (tmp_path / "ledger" / "batch-d").mkdir()  # a lost driver leaves a folder without its mark
    assert ledger.batches() == ["a", "b", "c"] and ledger.commit("d", token_rollup.inserted(counts))
    with pytest.raises(ValueError):
        ledger.commit("../x", token_rollup.inserted(counts))
