"""Language identification by sparse multinomial logistic regression.

Features are TF-IDF weights of character n-grams (1 to 3 characters of the
lower-cased text, everything but letters as one space), hashed to ``2 ** BITS``
places (fewer where languages are very many, so that the state of the fit is bounded). Document frequencies come from all training documents. The weights are
fitted on a bounded sample of labelled documents, stratified by language, with the
follow-the-regularised-leader update and elastic-net penalties, which leaves most
of them zero. A part of the sample is kept back to fit the temperature by which
logits are divided, so that scores are probabilities.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.arrow import small_batches
from sparkloom.llm.skew import unused

BITS = 16
#: No letter, or no text.
UNKNOWN = "und"
#: Labelled documents of each language in the sample: expected number, and bound (twice as many).
PER_LANGUAGE = 1500
#: Labelled documents in the sample of all languages: expected number. Beyond 200 languages each has its equal part.
IN_ALL = 300_000
#: Places times languages at most: half the numbers in the state of the fit.
STATE = 1 << 24
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.5, 1.0, 0.02, 1e-4
#: One of this many sampled documents serves to fit the temperature.
CALIBRATE = 5

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _letters[0]


def places_for(languages: int) -> int:
    """Bits of a hashed n-gram for this many languages; none is left out however many there are."""
    return max(8, min(BITS, (STATE // max(1, languages)).bit_length() - 1))


def features(text: str | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray] | None:
    """Hashed n-grams and their counts; None for a null text or one without letters."""
    if not text:
        return None
    chars = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    alpha = letters()[chars]
    if not alpha.any():
        return None
    chars = np.where(alpha, chars, 32).astype("uint64")
    keep = alpha.copy()
    keep[1:] |= alpha[:-1]
    chars = np.concatenate(([32], chars[keep], [32])).astype("uint64")
    if len(chars) > 2 and chars[-2] == 32:
        chars = chars[:-1]
    mix, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - bits)
    one = chars + np.uint64(1)
    two = one[:-1] * np.uint64(0x110001) + one[1:]
    three = two[:-1] * np.uint64(0x110003) + one[2:]
    places = np.concatenate([(one * mix) >> shift, (two * mix) >> shift, (three * mix) >> shift])
    counts = np.bincount(places.astype("int64"), minlength=1 << bits)
    at = np.flatnonzero(counts)
    return at, counts[at]


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)
    idf: np.ndarray | None = None
    weights: np.ndarray | None = None
    bias: np.ndarray | None = None
    temperature: float = 1.0

    def row(self, found: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        at, n = found
        x = (1 + np.log(n)) * self.idf[at]
        return at, x / np.sqrt((x * x).sum())

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or (found := features(text, len(self.idf).bit_length() - 1)) is None:
            return UNKNOWN, 0.0
        at, x = self.row(found)
        z = (x @ self.weights[at] + self.bias) / self.temperature
        p = np.exp(z - z.max())
        k = int(p.argmax())
        return self.languages[k], float(p[k] / p.sum())


def fit(rows: list[tuple[str, tuple]], idf: np.ndarray, languages: list[str]) -> Model:
    """Fit on (language, features) rows in their order."""
    k, d = len(languages), len(idf)
    model = Model(languages, idf.astype("float32"))
    number = {x: i for i, x in enumerate(languages)}
    data = [(number[lang], *model.row(f)) for lang, f in rows if lang in number and f is not None]
    held = data[::CALIBRATE] if len(data) >= 10 * CALIBRATE else []
    train = [x for i, x in enumerate(data) if i % CALIBRATE] if held else data
    z, n = np.zeros((d + 1, k)), np.zeros((d + 1, k))

    def weights(zs: np.ndarray, ns: np.ndarray, l1: float = L1) -> np.ndarray:
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((BETA + np.sqrt(ns)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for y, at, x in train:
            at, x = np.append(at, d), np.append(x, 1.0)  # the last place is the bias
            zs, ns = z[at], n[at]
            w = weights(zs, ns)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = np.outer(x, p)
            more = ns + g * g
            z[at] = zs + g - (np.sqrt(more) - np.sqrt(ns)) / ALPHA * w
            n[at] = more
    w = weights(z, n)
    model.weights, model.bias = w[:d].astype("float32"), w[d].astype("float32")
    if held:
        logits = np.array([x @ model.weights[at] + model.bias for _, at, x in held], dtype="float64")
        ys = np.array([y for y, _, _ in held])

        def loss(log_t: float) -> float:
            s = logits / math.exp(log_t)
            s = s - s.max(1, keepdims=True)
            return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(ys)), ys]).mean())

        lo, hi, ratio = -1.5, 4.0, (math.sqrt(5) - 1) / 2
        for _ in range(60):  # golden section
            a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
            lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
        model.temperature = math.exp((lo + hi) / 2)
    return model


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Learn from the text and non-null language of documents that are not held out.

    Counts and document frequencies cover all of them; the fit uses a sample whose
    size is ``per_language`` rows of each language on average and at most twice that,
    chosen by a hash of id and text: repeated rows, ids and null ids are chosen like
    others, and a repeated row once. Without any training row the model knows no language.
    """
    small_batches(documents.sparkSession)
    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return Model()
    languages = sorted(counts)
    bits, per_language = places_for(len(languages)), max(1, min(per_language, IN_ALL // len(languages)))

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = np.zeros((1 << bits) + 1, "int64")
        for batch in batches:
            for text in batch["text"]:
                if (found := features(text, bits)) is not None:
                    df[found[0]] += 1
                    df[-1] += 1
        at = np.flatnonzero(df)
        yield pd.DataFrame({"at": at.astype("int32"), "df": df[at]})

    df = rows.select("text").mapInPandas(frequencies, "at int, df long").groupBy("at").agg(F.sum("df").alias("df")).toPandas()
    full = np.zeros((1 << bits) + 1)
    full[df["at"].to_numpy()] = df["df"].to_numpy()
    idf = np.log((1 + full[-1]) / (1 + full[:-1])) + 1

    spark = documents.sparkSession
    share = spark.createDataFrame([(lang, min(1.0, per_language / n) * float(1 << 30)) for lang, n in counts.items()], "lang string, share double")
    h = F.xxhash64(F.col("doc_id").cast("string"), "text")
    sample = rows.withColumn("h", h).join(F.broadcast(share), "lang").where(F.pmod("h", F.lit(1 << 30)) < F.col("share"))
    # repeats meet map-side; of what is left a language has twice its rows at most
    sample = sample.groupBy("lang", "h").agg(F.min("text").alias("text"))
    sample = sample.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("k") <= 2 * per_language)

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = []
        for batch in batches:
            for h, lang, text in zip(batch["h"], batch["lang"], batch["text"], strict=True):
                if (found := features(text, bits)) is not None:
                    got.append((h, lang, (found[0].astype("int32"), found[1].astype("float32"))))
        got.sort(key=lambda r: (r[0], r[1]))
        model = fit([r[1:] for r in got], idf, languages)
        out = io.BytesIO()
        np.savez_compressed(out, weights=model.weights, bias=model.bias, temperature=model.temperature)
        yield pd.DataFrame({"model": [out.getvalue()]})

    blob = sample.select("h", "lang", "text").repartition(1).mapInPandas(learn, "model binary").first()
    if blob is None:
        return Model()
    got = np.load(io.BytesIO(bytes(blob["model"])))
    return Model(languages, idf.astype("float32"), got["weights"], got["bias"], float(got["temperature"]))


def predicted(text: Column, model: Model) -> Column:
    """Struct ``lang_pred, score`` of each whole text."""

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score"])

    return run(text)


def identify(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row; only the text is an input of the prediction.

    Null texts and texts without a letter are ``und`` with score 0, and so is everything
    if the model knows no language. Null ids are kept and not held out.
    """
    small_batches(documents.sparkSession)
    rows = documents.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), predicted(F.col(text_col), model).alias("p"))
    return rows.select("doc_id", "held_out", "p.lang_pred", "p.score")


def in_known_language(documents: DataFrame, model: Model, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows whose text is in a known language with at least this score, with the columns of ``documents``."""
    small_batches(documents.sparkSession)
    x = unused(documents)
    rows = documents.withColumn(f"{x}lang", predicted(F.col(f"`{text_col}`"), model))
    return rows.where((F.col(f"{x}lang.lang_pred") != UNKNOWN) & (F.col(f"{x}lang.score") >= least)).drop(f"{x}lang")
