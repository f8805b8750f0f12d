"""The stages of the pipeline on a small corpus, each against a brute-force version of its decision."""

import random
import re

import pytest

import corpus_pipeline as P
from sparkloom.llm import simhash
from sparkloom.plans.tables import materialize

EN = "the quick brown fox jumps over lazy dogs while seven grey wolves sleep under old oak trees near quiet rivers".split()
DE = "der schnelle braune fuchs springt über den faulen hund und schläft unter der alten eiche am stillen fluss".split()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(6)
    rows = [(i, " ".join(r.choice(DE if i % 3 == 0 else EN) for _ in range(80)), "de" if i % 3 == 0 else "en", "src0" if i % 2 else "src1") for i in range(120)]
    base = dict((x[0], x[1]) for x in rows)
    rows += [(200 + i, base[i].replace(" ", "\n", 2), "en", "src0") for i in range(10)]  # equal but for white space
    rows += [(300 + i, base[20 + i] + " oak", "en", "src0") for i in range(10)]  # near copies
    rows += [(400, None, "en", "src0"), (401, "12 34 !!", "en", "src0"), (402, "", None, None)]
    d = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 120, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d), {i: t for i, t, *_ in rows}


def test_stages(spark, folder):
    d, texts = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, left = docs.columns, []
    for k, (name, stage) in enumerate(P.STAGES):
        docs = materialize(stage(spark, docs, d), f"test-{k}")
        left.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        assert name and (docs.columns == columns or k == len(P.STAGES) - 1)
    assert left[0] == set(texts) - {400, 401, 402}
    best = {}
    for i in left[0]:
        best.setdefault(re.sub(r"[\x20\x09-\x0D]", "", texts[i]), []).append((-len(texts[i]), i))
    assert left[1] == {min(v)[1] for v in best.values()}
    fps = {i: simhash.fingerprint(texts[i], 4) for i in left[1]}
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 4:
                root[max(find(a), find(b))] = min(find(a), find(b))
    assert left[2] == {i for i in fps if find(i) == i}
    # every label is good, so nothing is thinned out
    assert left[3] == left[2] and left[4] == left[3]
    assert {"n_tokens", "ids_sha256", "decoded_sha256"} < set(docs.columns)
