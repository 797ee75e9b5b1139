"""Mixing to target weights with soft memberships and distributed projected gradients.

1. Two logistic models, toxic or not and poor or clean among the others, give each document a posterior over domains: p_d.
   Features are words, their beginnings and endings that tell a domain from the rest in a bounded sample of the labels table,
   and the logarithm of the text's length, so that long texts aren't taken for toxic because they hold more words.
2. A document of n_d tokens at rate r_d adds n_d * p_dk * r_d expected tokens to domain k. Projected gradient descent fits
   rates 0 <= r_d (<= most, if given) so that these totals meet the targets in least squares, starting from 1. Steps
   are taken in the metric that weighs a document by its tokens, where the Hessian is one small matrix
   sum_d n_d p_d p_d^T: it gives the step length, and convergence does not depend on how long documents are.
A step moves a document by sum_k p_dk * g_k for one small vector g, so a rate is a closed expression of p_d and the g's so
far: an iteration is one aggregate that returns a number for each domain, nothing is joined, and no text is shuffled.
Built-in functions only; the models are solved in the driver, whose input is bounded by fit_rows and most_features.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free_names, long_table, stored, whole, words_of

DOMAINS = ("clean", "poor", "toxic")


def label_domain() -> Column:
    """The domain of a row of labels; null if it has neither label."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").when(F.col("quality") == 1, "clean")


#: Marks at the end of a word that its spelling doesn't need.
STOPS = ".,;:!?"


def hashes_of(words: Column) -> Column:
    """64-bit hashes: of each word and its first five characters, both without closing punctuation, and of its last two."""
    bare = F.transform(words, lambda w: F.rtrim(w, F.lit(STOPS)))
    none = F.array().cast("array<bigint>")
    # both arrays are named in lambdas that they are handed to, so each is computed once
    return F.aggregate(F.array(F.struct(words.alias("w"), bare.alias("b"))), none, lambda _, x: F.concat(
        F.transform(x["b"], lambda w: F.xxhash64(F.lit(1), w)),
        F.transform(x["b"], lambda w: F.xxhash64(F.lit(2), F.substring(w, 1, 5))),
        F.transform(x["w"], lambda w: F.xxhash64(F.lit(3), F.substring(w, -2, 2)))))


def low_words(text: str) -> Column:
    return words_of(F.lower(whole(F.col(text))))


@dataclass(frozen=True)
class DomainModel:
    """The features' hashes, and of both models (toxic; poor among the others): bias, weight of the logarithm of the length, weights
    of the features. priors are the log odds of texts without words."""

    features: list[int]
    bias: tuple[float, float]
    length: tuple[float, float]
    weights: tuple[list[float], list[float]]
    priors: tuple[float, float]


def places(features: list[int]) -> tuple[int, int]:
    """(shift, size) for which (hash >>> shift) mod size differs among the features."""
    size = 1 << 16
    while True:
        for shift in range(48):
            if len({((h % (1 << 64)) >> shift) % size for h in features}) == len(features):
                return shift, size
        size *= 2


def found_in(words: Column, features: list[int]) -> Column:
    """The distinct features that stand among the words. Compared by their whole hashes: no two features share a place."""
    shift, size = places(features)
    keys = [0] * size
    for h in features:
        keys[((h % (1 << 64)) >> shift) % size] = h
    table = F.split(F.lit(",".join(map(str, keys))), ",").cast("array<bigint>")
    return F.array_distinct(F.filter(hashes_of(F.array_distinct(words)), lambda h: F.element_at(table, place_of(h, shift, size)) == h))


def place_of(h: Column, shift: int, size: int) -> Column:
    return (F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(size - 1)) + 1).cast("int")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights by Newton steps; the first two columns (bias and length) bear next to no ridge."""
    penalty = np.r_[1e-3, 1e-3, np.full(x.shape[1] - 2, ridge)]
    w = np.zeros(x.shape[1])
    # the single-precision table becomes doubles by slices only
    slices = [slice(at, at + 2000) for at in range(0, len(x), 2000)]

    def scores(v: np.ndarray) -> np.ndarray:
        return np.concatenate([x[part].astype(float) @ v for part in slices])

    def loss(v: np.ndarray) -> float:
        s = scores(v)
        return float(np.logaddexp(0, s).sum() - y @ s + 0.5 * v @ (penalty * v))

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(scores(w), -40, 40)))
        h, slope = np.diag(penalty), penalty * w
        for at in slices:
            part = x[at].astype(float)
            h += part.T @ (part * (p[at] * (1 - p[at]))[:, None])
            slope += part.T @ (p[at] - y[at])
        step = np.linalg.solve(h, slope)
        rate, now = 1.0, loss(w)
        while rate > 1e-4 and loss(w - rate * step) > now:
            rate /= 2
        w = w - rate * step
        if np.abs(rate * step).max() < 1e-5:
            break
    return w


def fit_domains(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc: str = "doc_id", fit_rows: int = 20_000, most_features: int = 600) -> DomainModel:
    """From the fit_rows labelled ids with the smallest hashes (the documented bound; it bounds what is broadcast and what the
    driver gets). Features are those whose counts differ from a domain's share by 5 deviations or more; of toxic and of poor
    ones the most_features / 2 that differ most."""
    sample = labels.withColumn("__domain", label_domain()).where(F.col("__domain").isNotNull() & F.col(doc).isNotNull())
    sample = sample.groupBy(F.col(doc).alias("__id")).agg(F.max("__domain").alias("__domain")).orderBy(F.xxhash64("__id"), "__id").limit(fit_rows)
    rows = docs.select(F.col(doc).alias("__doc"), text).join(F.broadcast(sample), F.col("__doc") == F.col("__id"))
    rows = stored(rows.select("__id", "__domain", low_words(text).alias("__words")), "labelled")
    sizes = {r["__domain"]: r["n"] for r in rows.groupBy("__domain").agg(F.count("*").alias("n")).collect()}
    total, (clean, poor, toxic) = sum(sizes.values()), (sizes.get(d, 0) for d in DOMAINS)
    priors = math.log((toxic + 1) / (total - toxic + 2)), math.log((poor + 1) / (clean + 1))
    if not total:
        return DomainModel([], priors, (0.0, 0.0), ([], []), priors)
    exploded = rows.select("__domain", F.explode(F.array_distinct(hashes_of(F.array_distinct("__words")))).alias("h"))
    counts = exploded.groupBy("h").agg(F.count("*").alias("seen"), *[F.count(F.when(F.col("__domain") == d, 1)).alias(d) for d in DOMAINS[1:]])
    telling = lambda d: F.abs(F.col(d) - F.col("seen") * sizes.get(d, 0) / total) / F.sqrt(F.col("seen") * sizes.get(d, 0) / total + 1)
    sure = stored(counts.select("h", *[telling(d).alias(d) for d in DOMAINS[1:]]).where(" OR ".join(f"{d} >= 5" for d in DOMAINS[1:])), "features")
    features = sorted({r["h"] for d in DOMAINS[1:] for r in sure.where(F.col(d) >= 5).orderBy(F.desc(d), "h").limit(most_features // 2).collect()})
    at = {h: i + 2 for i, h in enumerate(features)}
    seen = rows.select("__id", "__domain", F.size("__words").alias("n"), found_in(F.col("__words"), features).alias("found")).collect()
    seen.sort(key=lambda r: (r["__id"], r["n"]))
    x = np.zeros((len(seen), len(features) + 2), dtype=np.float32)
    for i, r in enumerate(seen):
        x[i, 0], x[i, 1] = 1, math.log1p(r["n"])
        x[i, [at[h] for h in r["found"]]] = 1
    domain = np.array([r["__domain"] for r in seen])
    models = []
    for mine, among, prior in ((domain == "toxic", domain != "", priors[0]), (domain == "poor", domain != "toxic", priors[1])):
        both = 0 < mine[among].sum() < among.sum()
        models.append(logistic(x[among], mine[among].astype(float)) if both else np.r_[prior, np.zeros(len(features) + 1)])
    t, q = [[round(float(v), 6) for v in m] for m in models]
    return DomainModel(features, (t[0], q[0]), (t[1], q[1]), (t[2:], q[2:]), priors)


def with_posteriors(docs: DataFrame, model: DomainModel, *, text: str = "text") -> DataFrame:
    """docs with n_tokens and p_<domain>. A text without words has the priors."""
    shift, size = places(model.features)
    tables = []
    for weights in model.weights:
        table = [0.0] * size
        for h, w in zip(model.features, weights, strict=True):
            table[((h % (1 << 64)) >> shift) % size] = w
        tables.append(long_table(table))
    words, found, toxic, poor = free_names(docs.columns, "__words", "__found", "__toxic", "__poor")
    out = docs.withColumn(words, low_words(text)).withColumn("n_tokens", F.size(words).cast("long"))
    out = out.withColumn(found, F.transform(found_in(F.col(words), model.features), lambda h: place_of(h, shift, size))).drop(words)
    odds = []
    for table, bias, length, prior in zip(tables, model.bias, model.length, model.priors, strict=True):
        sum_of = F.aggregate(found, F.lit(0.0), lambda acc, b: acc + F.element_at(table, b))  # noqa: B023
        odds.append(F.when(F.col("n_tokens") > 0, F.lit(bias) + F.lit(length) * F.log1p("n_tokens") + sum_of).otherwise(F.lit(prior)))
    out = out.withColumns({name: 1 / (1 + F.exp(-o)) for name, o in zip((toxic, poor), odds, strict=True)}).drop(found)
    t, q = F.col(toxic), F.col(poor)
    return out.withColumns({"p_clean": (1 - t) * (1 - q), "p_poor": (1 - t) * q, "p_toxic": t}).drop(toxic, poor)


def rate_after(steps: list[list[float]], most: float | None) -> Column:
    """A row's rate after gradient steps, from its p_<domain> columns."""
    rate = F.lit(1.0)
    for g in steps:
        moved = rate - sum(F.col(f"p_{d}") * F.lit(x) for d, x in zip(DOMAINS, g, strict=True))
        rate = F.greatest(moved, F.lit(0.0)) if most is None else F.least(F.greatest(moved, F.lit(0.0)), F.lit(float(most)))
    return rate


def _largest_eigenvalue(m: list[list[float]]) -> float:
    v = [1.0] * len(m)
    size = 1.0
    for _ in range(200):
        v = [sum(a * b for a, b in zip(row, v, strict=True)) for row in m]
        size = math.sqrt(sum(x * x for x in v)) or 1.0
        v = [x / size for x in v]
    return size


def fit_rates(rows: DataFrame, targets: dict[str, float], *, most: float | None = None, iterations: int = 60, tolerance: float = 1e-4) -> list[list[float]]:
    """Gradient steps for rows with n_tokens and p_<domain>; targets are token totals by domain. Stops once every total is
    within tolerance of its target (relative to all targets), or once no total moves by that much any more."""
    n, p = F.col("n_tokens"), [F.col(f"p_{d}") for d in DOMAINS]
    pairs = [(i, j) for i in range(len(p)) for j in range(i, len(p))]
    first = rows.agg(*[F.coalesce(F.sum(n * p[i] * p[j]), F.lit(0.0)).alias(f"h{i}{j}") for i, j in pairs]).first()
    h = [[float(first[f"h{min(i, j)}{max(i, j)}"]) for j in range(len(p))] for i in range(len(p))]
    # a domain that is next to absent gets no more weight than one with a hundredth of the largest: its total can't move all rates
    floor = 0.01 * max(h[i][i] for i in range(len(p)))
    scale = [math.sqrt(max(h[i][i], floor)) or 1.0 for i in range(len(p))]
    step = 1 / max(_largest_eigenvalue([[h[i][j] / scale[i] / scale[j] for j in range(len(p))] for i in range(len(p))]), 1e-12)
    goal, steps, before = [float(targets.get(d, 0.0)) for d in DOMAINS], [], None
    small = tolerance * max(sum(goal), 1.0)
    for _ in range(iterations):
        rate = rate_after(steps, most)
        now = rows.agg(*[F.coalesce(F.sum(n * rate * x), F.lit(0.0)).alias(d) for d, x in zip(DOMAINS, p, strict=True)]).first()
        totals = [float(now[d]) for d in DOMAINS]
        if all(abs(t - g) <= small for t, g in zip(totals, goal, strict=True)):
            break
        if before and all(abs(t - b) <= small / 10 for t, b in zip(totals, before, strict=True)):
            break
        before = totals
        steps.append([step * (t - g) / s / s for t, g, s in zip(totals, goal, scale, strict=True)])
    return steps


def copies(rate: Column, doc: Column, seed: int) -> Column:
    """A whole number whose expectation is the rate: its floor, or one more for a share of ids that their hashes choose."""
    u = F.pmod(F.xxhash64(F.lit(seed), doc), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return F.floor(rate + u).cast("long")


def mix_sources(docs: DataFrame, labels: DataFrame, weights: dict[str, float], *, tokens: float = 1.0, text: str = "text", doc: str = "doc_id", most: float | None = None, fit_rows: int = 20_000, seed: int = 7, keep_text: bool = True) -> DataFrame:
    """All rows and columns of docs (the text only if keep_text) with n_tokens, p_<domain>, rate and copies.

    weights are the target shares of the domains, tokens the target total as a multiple of the input's tokens. A null
    or empty text has no tokens: it moves no total and its rate follows its domain's. A domain without documents stays at 0,
    and the others still meet their targets. Without usable labels all documents have equal posteriors. Repeated rows
    share a rate; null ids share the choice of copies. An empty table gives an empty one. Input columns with the
    name of an output are replaced.
    """
    share = sum(weights.values()) or 1.0
    return _mixed(docs, labels, lambda totals: {d: sum(totals.values()) * tokens * weights.get(d, 0.0) / share for d in DOMAINS}, text=text, doc=doc, most=most, fit_rows=fit_rows, seed=seed, keep_text=keep_text)


def cap_sources(docs: DataFrame, labels: DataFrame, ceilings: dict[str, float], *, text: str = "text", doc: str = "doc_id", fit_rows: int = 20_000, seed: int = 7) -> DataFrame:
    """As mix_sources, at rates of 1 at most: domains of ceilings that have more than their share of the outcome are scaled down
    to it; all others have their own measured totals as targets, whatever the domains' shares of the input are."""
    return _mixed(docs, labels, lambda totals: capped(totals, ceilings), text=text, doc=doc, most=1.0, fit_rows=fit_rows, seed=seed, keep_text=True)


def capped(totals: dict[str, float], ceilings: dict[str, float]) -> dict[str, float]:
    """Totals with those above their ceilings (shares of the outcome) scaled down to them; the others stay."""
    if sum(ceilings.values()) >= 1:
        raise ValueError("ceilings must leave a share to the other domains")
    down: set[str] = set()
    while True:
        size = sum(n for d, n in totals.items() if d not in down) / (1 - sum(ceilings[d] for d in down))
        more = {d for d in ceilings.keys() - down if totals.get(d, 0.0) > ceilings[d] * size}
        if not more:
            return {d: ceilings[d] * size if d in down else n for d, n in totals.items()}
        down |= more


def _mixed(docs: DataFrame, labels: DataFrame, targets: Callable[[dict[str, float]], dict[str, float]], *, text: str, doc: str, most: float | None, fit_rows: int, seed: int, keep_text: bool) -> DataFrame:
    """targets makes the domains' target totals from their measured ones."""
    outputs = {"n_tokens", "rate", "copies", *[f"p_{d}" for d in DOMAINS]}
    docs = docs.drop(*[c for c in docs.columns if c.lower() in outputs])
    model = fit_domains(docs, labels, text=text, doc=doc, fit_rows=fit_rows)
    scored = with_posteriors(docs, model, text=text)
    # scored once: the aggregates read the narrow columns of this table, and the rates are an expression of them
    scored = stored(scored if keep_text else scored.drop(text), "posteriors")
    measured = scored.agg(*[F.coalesce(F.sum(F.col("n_tokens") * F.col(f"p_{d}")), F.lit(0.0)).alias(d) for d in DOMAINS]).first()
    steps = fit_rates(scored, targets({d: float(measured[d]) for d in DOMAINS}), most=most)
    return scored.withColumn("rate", rate_after(steps, most)).withColumn("copies", copies(F.col("rate"), F.col(doc), seed))
