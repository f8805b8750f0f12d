"""Mixing sources to target weights with soft domain membership, on DataFrame functions only.

A naive Bayes classifier, fitted on a labelled table, gives each document posterior
probabilities of the domains. Document rates r start at 1 and follow projected
gradient descent on the least squares of domain token totals,

    1/2 sum_d (s_d - t_d)^2 / T_d,   s_d = sum_i tokens_i p_id r_i,   0 <= r_i <= cap,

where T_d is the domain's expected total at rate 1; the cap is infinite where scarce
domains are to be repeated until their totals match. In the metric that weighs
documents by their tokens a step of 1 is safe: the matrix of the quadratic form has
rows that sum to one. A step moves a point by sum_d p_id (s_d - t_d) / T_d. Steps start
ahead of the rates, carried on by their last move (Nesterov's momentum), and from the
rates themselves where the last step made the loss larger. An iteration is one
aggregation of a written table to one row. Rates are recomputed from the steps since
they were last written, which is after every ``WRITE`` steps.
"""

from __future__ import annotations

import logging
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.skew import unused
from sparkloom.plans.tables import drop_shuffles, materialize

#: Labelled documents of each domain that the classifier is fitted on, on average; twice as many in all at most.
PER_DOMAIN = 5000
#: Places that words are hashed to, each held by its most frequent word: the rows of the table of weights, hence a bound of what is broadcast.
#: More places let rarer words speak, which takes more good text for bad (README).
PLACES = 1 << 15
#: Words of a text do not speak independently: n of them count as n HALF / (n + HALF), at every length alike,
#: in learning as in prediction. No labelled text outweighs HALF words, however long it is.
HALF = 200
#: Rounds after which a descent that still moves is an error, and the relative error of every total at which it ends.
ROUNDS, TOLERANCE = 400, 2e-3
#: Totals that move by less than this part of the error allowed, so many rounds on end, stand still.
STILL, STILL_ROUNDS = 1e-2, 3
#: Log prior of a domain without labels.
NEVER = -1e9
#: Steps between two writings of the rates.
WRITE = 6

_log = logging.getLogger(__name__)

_RUNS = "[0-9A-Za-z\\x{80}-\\x{10FFFF}]+|[!-/:-@\\[-`{-~]+"


def label_domain(quality: Column, toxic: Column) -> Column:
    """Domains of the labelled table: toxic, good, poor; null without a label."""
    return F.when(toxic == 1, "toxic").when(quality == 1, "good").when(quality == 0, "poor")


DOMAINS = ("good", "poor", "toxic")


def _tokens(text: Column) -> Column:
    """Runs of word characters and of punctuation."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_RUNS), F.lit(0))


def _feature(run: Column) -> Column:
    """Lower-cased run; words in capitals are one feature."""
    capitals = (F.length(run) >= 2) & (run == F.upper(run)) & (run != F.lower(run))
    return F.when(capitals, F.lit("<CAPITALS>")).otherwise(F.lower(run))


def _word(run: Column) -> Column:
    """The hash of a run's feature; null for a null run."""
    return F.when(run.isNotNull(), F.xxhash64(_feature(run)))


def classifier(documents: DataFrame, labelled: DataFrame, domains: tuple[str, ...] = DOMAINS, id_col: str = "doc_id", text_col: str = "text", per_domain: int = PER_DOMAIN) -> tuple[DataFrame, list[float]]:
    """Word weights ``word, w_0, w_1, ...`` (at most ``PLACES`` rows) from ``labelled`` (id, ``domain``), and log priors.

    Weights are log-likelihood ratios against the mean over domains, with one added to
    counts, to which each word of a text of n adds HALF / (n + HALF); every domain has the same say in them, however many labels it has. Priors
    are the shares of all labels, and a domain without a label is never predicted.
    Without labelled documents there are no weights and posteriors are equal.
    """
    known = labelled.where(F.col("domain").isin(*domains)).select(F.col(id_col).alias("_id"), "domain")
    counts = {r["domain"]: r["count"] for r in known.groupBy("domain").count().collect()}
    if not counts:
        return documents.sparkSession.createDataFrame([], "word long, " + ", ".join(f"w_{k} double" for k in range(len(domains)))), [0.0] * len(domains)
    share = F.create_map(*[F.lit(x) for d, n in counts.items() for x in (d, min(1.0, per_domain / n))])[F.col("domain")]
    h = F.pmod(F.xxhash64("_id"), F.lit(1 << 30))
    # at most twice the documented number of rows, hence broadcast
    sample = known.withColumn("_h", h).where(F.col("_h") < share * float(1 << 30)).orderBy("_h", "_id", "domain").limit(2 * per_domain * len(domains)).select("_id", "domain")
    rows = documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(sample), "_id")
    runs = rows.select("domain", _tokens(F.col("_text")).alias("_runs")).withColumn("say", F.lit(float(HALF)) / (F.size("_runs") + HALF))
    words = runs.select("domain", "say", F.explode("_runs").alias("run")).select("domain", "say", _word(F.col("run")).alias("word"))
    seen = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.when(F.col("domain") == d, F.col("say")).otherwise(0.0)).alias(f"n_{k}") for k, d in enumerate(domains)])
    held = seen.groupBy(F.pmod("word", F.lit(PLACES)).alias("place")).agg(F.max(F.struct("n", "word", *[f"n_{k}" for k in range(len(domains))])).alias("m"))
    top = materialize(held.select("m.*"), "mixing-words")
    sums = top.agg(*[F.sum(f"n_{k}") for k in range(len(domains))], F.count(F.lit(1))).first()
    logs = [F.log((F.col(f"n_{k}") + 1) / F.lit(float((sums[k] or 0) + (sums[len(domains)] or 0) + 1))) for k in range(len(domains))]
    mean = sum(logs[1:], logs[0]) / len(domains)
    priors = [math.log((counts[d] + 1) / (sum(counts.values()) + len(domains))) if d in counts else NEVER for d in domains]
    return materialize(top.select("word", *[(x - mean).alias(f"w_{k}") for k, x in enumerate(logs)]), "mixing-weights"), priors


def posteriors(documents: DataFrame, weights: DataFrame, priors: list[float], domains: tuple[str, ...] = DOMAINS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id, _h, tokens, p_0, p_1, ...`` for each id and text; ``_h`` is a hash of the text.

    Rows that repeat an id and a text are one document with the tokens of all of them.
    """
    # the hash is taken before texts are exploded, not once for each token
    rows = documents.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_h"), _tokens(F.col(text_col)).alias("_runs"))
    rows = rows.select("_id", "_h", F.explode_outer("_runs").alias("run")).select("_id", "_h", "run", _word(F.col("run")).alias("word"))
    rows = rows.join(F.broadcast(weights), "word", "left")
    sums = rows.groupBy("_id", "_h").agg(F.count("run").alias("tokens"), *[F.sum(F.coalesce(f"w_{k}", F.lit(0.0))).alias(f"z_{k}") for k in range(len(domains))])
    scaled = [F.col(f"z_{k}") * (F.lit(float(HALF)) / (F.col("tokens") + HALF)) + F.lit(priors[k]) for k in range(len(domains))]
    top = F.greatest(*scaled, scaled[0])
    sums = sums.select("_id", "_h", "tokens", *[F.exp(z - top).alias(f"e_{k}") for k, z in enumerate(scaled)])
    total = sum((F.col(f"e_{k}") for k in range(1, len(domains))), F.col("e_0"))
    return sums.select("_id", "_h", "tokens", *[(F.col(f"e_{k}") / total).alias(f"p_{k}") for k in range(len(domains))])


def walk(steps: list[tuple[list[float], float, bool]], cap: float) -> Column:
    """``rate`` and the point ``ahead`` of it after these steps, from those that were written last.

    A step is a move of each domain, the momentum after it, and whether it starts from the rate.
    """
    moves = F.array(*[F.struct(*[F.lit(float(x)).alias(f"m_{k}") for k, x in enumerate(move)], F.lit(float(beta)).alias("beta"), F.lit(fresh).alias("fresh")) for move, beta, fresh in steps])

    def step(s: Column, x: Column) -> Column:
        start = F.when(x["fresh"], s["rate"]).otherwise(s["ahead"])
        to = F.least(F.lit(cap), F.greatest(F.lit(0.0), start - sum((F.col(f"p_{k}") * x[f"m_{k}"] for k in range(len(steps[0][0]))), F.lit(0.0))))
        return F.struct(to.alias("rate"), (to + x["beta"] * (to - s["rate"])).alias("ahead"))

    return F.aggregate(moves, F.struct("rate", "ahead"), step)


def fit_rates(members: DataFrame, targets: list[float], cap: float, budget: float | None = None, anchor: int | None = None, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[DataFrame, list[float], list[float]]:
    """``members`` with ``rate``, the totals that the rates reach and the totals that were asked for.

    ``targets`` are weights and ``budget`` the total number of tokens. By default it is
    the one that leaves the domain ``anchor`` its expected total at rate 1, or without
    an anchor the largest that asks no domain for more than that. The descent ends when
    every domain with tokens is within ``tolerance`` of its target or, where targets
    cannot all be reached, when no total moves any more; totals are then the nearest in
    least squares.
    """
    n, whole = len(targets), sum(targets)
    if whole <= 0 or min(targets) < 0:
        raise ValueError("target weights are not negative and not all zero")

    def totals(rows: DataFrame) -> tuple[list[float], list[float]]:
        row = rows.agg(*[F.sum(F.col("tokens") * F.col(f"p_{k}") * F.col(at)).alias(f"{at}_{k}") for at in ("rate", "ahead") for k in range(n)]).first()
        sums = [float(x or 0.0) for x in row]
        return sums[:n], sums[n:]

    share = [t / whole for t in targets]
    written = members.withColumn("rate", F.lit(1.0)).withColumn("ahead", F.lit(1.0))
    now, ahead = totals(written)
    base = now
    if budget is None and anchor is not None:
        budget = base[anchor] / share[anchor]
    elif budget is None:
        budget = min((b / w for b, w in zip(base, share, strict=True) if w > 0), default=0.0)
    wanted = [budget * w for w in share]
    scale = [tolerance * max(t, 1e-3 * budget) for t in wanted]
    rows, steps, before, loss, still, momentum = written, [], None, math.inf, 0, 1.0
    for k in range(rounds):
        gap = [s - t for s, t in zip(now, wanted, strict=True)]
        # a domain without tokens has no rate that could reach its target
        if all(b <= 0 or abs(g) <= e for g, b, e in zip(gap, base, scale, strict=True)):
            break
        still = still + 1 if before is not None and all(abs(s - x) <= STILL * e for s, x, e in zip(now, before, scale, strict=True)) else 0
        if still >= STILL_ROUNDS:
            break
        last, loss = loss, sum(g * g / b for g, b in zip(gap, base, strict=True) if b > 0)
        fresh = loss > last
        momentum, old = (1 + math.sqrt(1 + 4 * (1.0 if fresh else momentum) ** 2)) / 2, 1.0 if fresh else momentum
        start = now if fresh else ahead
        steps.append(([(s - t) / b if b > 0 else 0.0 for s, t, b in zip(start, wanted, base, strict=True)], (old - 1) / momentum, fresh))
        before = now
        rows = written.withColumn("_to", walk(steps, cap)).withColumn("rate", F.col("_to.rate")).withColumn("ahead", F.col("_to.ahead")).drop("_to")
        if len(steps) == WRITE:
            rows = written = materialize(rows, "mixing-rates")
            steps = []
        now, ahead = totals(rows)
    else:
        raise RuntimeError(f"mixing: totals {now} still move after {rounds} steps towards {wanted}")
    _log.info("mixing: totals %s after %d steps towards %s", now, k, wanted)
    return rows.drop("ahead"), now, wanted


def mix(documents: DataFrame, labelled: DataFrame, targets: dict[str, float], cap: float = 1.0, budget: float | None = None, anchor: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id, _h, tokens, p_0, ..., rate, copies`` for each id and text of ``documents``.

    ``labelled`` has the id and ``domain``, one of the keys of ``targets``. ``copies`` is
    the whole part of the rate, plus one with the probability of its fraction, drawn
    from a hash of the id. Null and empty texts have no tokens, equal posteriors and a
    rate like others. Empty tables give an empty result. Domains whose totals miss their
    targets are named in a warning.
    """
    domains = tuple(targets)
    weights, priors = classifier(documents, labelled, domains, id_col, text_col)
    members = materialize(posteriors(documents, weights, priors, domains, id_col, text_col), "mixing-members")
    drop_shuffles(documents.sparkSession)
    rows, reached, wanted = fit_rates(members, list(targets.values()), cap, budget, None if anchor is None else domains.index(anchor))
    for d, s, t in zip(domains, reached, wanted, strict=True):
        if abs(s - t) > TOLERANCE * max(t, 1e-3 * sum(wanted)):
            _log.warning("mixing: %s has %.0f expected tokens of %.0f wanted", d, s, t)
    draw = F.pmod(F.xxhash64(F.lit("mix"), "_id"), F.lit(1 << 30)) / float(1 << 30)
    return rows.withColumn("copies", F.floor(F.col("rate") + draw).cast("int"))


def mixed(documents: DataFrame, labelled: DataFrame, targets: dict[str, float], cap: float = 1.0, budget: float | None = None, anchor: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``documents``, each as often as its copies say, with its columns.

    Rows that repeat an id and a text share one rate, and each of them is copied by it.
    """
    found, x = mix(documents, labelled, targets, cap, budget, anchor, id_col, text_col).where("copies > 0"), unused(documents)
    found = found.select(F.col("_id").alias(f"{x}id"), F.col("_h").alias(f"{x}h"), F.col("copies").alias(f"{x}copies"))
    rows = documents.join(found, F.col(f"`{id_col}`").eqNullSafe(F.col(f"{x}id")) & (F.xxhash64(f"`{text_col}`") == F.col(f"{x}h")))
    rows = rows.withColumn(f"{x}n", F.explode(F.sequence(F.lit(1), F.col(f"{x}copies")))) if cap > 1 else rows
    return rows.select(*[F.col(f"`{c}`") for c in documents.columns])
