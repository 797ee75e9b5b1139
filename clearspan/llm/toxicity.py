"""Toxicity: a word classifier whose fit penalises score changes under swapped identity terms.

Features are the distinct words of a text and their beginnings of 4 to 7 letters. The fit takes a bounded, hash-chosen
sample of labelled rows (fit_rows), keeps the features that tell the classes apart most surely (most_features), and
minimises the logistic loss + a ridge + fairness * mean over counterfactual pairs of (change of score)^2 by Newton steps.
A pair is a labelled sentence and the same sentence with an identity term swapped for another of its kind; sentences
without such a term give pairs by a neutral mention put in front of them, against another mention and against none.
Scoring reads each text once, whole, without a shuffle; the model that tasks get has most_features entries at most.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import whole

#: Identity terms by kind; a term is swapped for others of its kind. Fixed values.
IDENTITY_TERMS = {
    "gender": ["women", "men", "girls", "boys", "nonbinary", "transgender", "mujeres", "hombres", "femmes", "hommes", "frauen", "männer"],
    "faith": ["christians", "muslims", "jews", "hindus", "buddhists", "sikhs", "atheists", "catholics", "cristianos", "musulmanes", "judíos", "chrétiens", "musulmans", "juifs", "christen", "muslime", "juden"],
    "origin": ["africans", "americans", "arabs", "asians", "europeans", "latinos", "mexicans", "immigrants", "refugees", "inmigrantes", "immigrés", "einwanderer"],
    "orientation": ["gay", "lesbian", "bisexual", "straight", "queer", "heterosexual", "homosexual"],
    "age": ["elderly", "teenagers", "children", "ancianos", "jeunes", "senioren"],
    "ability": ["blind", "deaf", "disabled", "autistic"],
}
_KIND = {t: kind for kind, terms in IDENTITY_TERMS.items() for t in terms}
_ALL = sorted(_KIND)
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?\n]+")


def features(word: str) -> list[str]:
    """The features of one word: itself and its beginnings; '=' marks whole words, so the two can't meet."""
    return ["=" + word, *{word[:n] for n in (4, 5, 6, 7) if len(word) > n}]


def swapped(term: str, seed: int) -> str:
    """Another term of the same kind."""
    others = [t for t in IDENTITY_TERMS[_KIND[term]] if t != term]
    return others[seed % len(others)]


def counterfactuals(text: str) -> list[tuple[str, str]]:
    """(term, other) pairs of the sentences of a text: swaps of the terms that stand in it; for sentences that hold none,
    a mention in front against another one and against none (an empty other)."""
    pairs = []
    for sentence in _SENTENCE.split(text.lower()):
        words = set(_WORD.findall(sentence))
        if not words:
            continue
        seed = zlib.crc32(sentence.encode())
        held = sorted(words & _KIND.keys())
        for term in held:
            pairs.append((term, swapped(term, seed)))
        if not held:
            term = _ALL[seed % len(_ALL)]
            pairs += [(term, swapped(term, seed >> 8)), (term, "")]
    return pairs


@dataclass(frozen=True)
class ToxicityModel:
    """Weights of features; a text's score is the logistic of bias + the weights of its distinct words' features."""

    bias: float
    weights: dict[str, float]

    def word(self, word: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in features(word))


def fit(rows: pd.DataFrame, *, most_features: int = 600, ridge: float = 0.05, fairness: float = 10.0) -> ToxicityModel:
    """rows: words (distinct, joined by spaces), toxic (0 or 1), pairs ('term other' strings joined by newlines)."""
    if not len(rows) or rows["toxic"].nunique() < 2:
        rate = (rows["toxic"].sum() + 0.5) / (len(rows) + 1.0) if len(rows) else 0.1
        return ToxicityModel(float(np.log(rate / (1 - rate))), {})
    y = rows["toxic"].to_numpy(float)
    seen = [Counter(), Counter()]
    for words, label in zip(rows["words"], y, strict=True):
        seen[int(label)].update({f for w in words.split() for f in features(w)})
    n1, n0 = y.sum(), len(y) - y.sum()

    def surely(f: str) -> float:
        p1, p0 = (seen[1][f] + 0.5) / (n1 + 1), (seen[0][f] + 0.5) / (n0 + 1)
        return (np.log(p1) - np.log(p0)) / np.sqrt(1 / (seen[1][f] + 0.5) + 1 / (seen[0][f] + 0.5))

    common = [f for f in seen[1].keys() | seen[0].keys() if seen[1][f] + seen[0][f] >= 3]
    ranked = sorted(((abs(surely(f)), f) for f in common), key=lambda x: (-x[0], x[1]))
    chosen = [f for z, f in ranked[:most_features] if z > 3.3]
    swaps = Counter(p for pairs in rows["pairs"] for p in pairs.split("\n") if p)
    # terms of the pairs are features too, so that the penalty has something to hold
    chosen += [f for f in sorted({"=" + t for p in swaps for t in p.split(" ") if t}) if f not in set(chosen) and seen[1][f] + seen[0][f] > 0]
    place = {f: i + 1 for i, f in enumerate(chosen)}
    x = np.zeros((len(y), len(chosen) + 1))
    x[:, 0] = 1
    for i, words in enumerate(rows["words"]):
        for f, n in Counter(f for w in words.split() for f in features(w) if f in place).items():
            x[i, place[f]] = n
    penalty = np.diag(np.r_[1e-6, np.full(len(chosen), ridge)])
    total = sum(swaps.values())
    for pair, n in swaps.items():
        change = np.zeros(len(chosen) + 1)
        for term, sign in zip(pair.split(" "), (1, -1), strict=True):
            for f in features(term) if term else []:
                if f in place:
                    change[place[f]] += sign
        if change.any():
            penalty += fairness * len(y) * n / total * np.outer(change, change)
    w = np.zeros(len(chosen) + 1)
    w[0] = np.log(n1 / n0)
    loss = lambda v: np.logaddexp(0, x @ v).sum() - y @ (x @ v) + 0.5 * v @ penalty @ v
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
        rate, now = 1.0, loss(w)
        while rate > 1e-4 and loss(w - rate * step) > now:
            rate /= 2
        w = w - rate * step
        if np.abs(rate * step).max() < 1e-4:
            break
    return ToxicityModel(float(w[0]), {f: float(w[i]) for f, i in place.items() if w[i]})


def training_rows(docs: DataFrame, labels: DataFrame, where: Column, *, text: str, doc: str, fit_rows: int) -> pd.DataFrame:
    """The bounded sample that the fit sees: the fit_rows labelled ids with the smallest hashes, and their texts."""
    chosen = labels.where(F.col("toxic").isin(0, 1) & F.col(doc).isNotNull() & where).select(F.col(doc).alias("__id"), F.col("toxic").cast("int").alias("toxic"))
    chosen = chosen.groupBy("__id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("__id"), "__id").limit(fit_rows)
    rows = docs.select(F.col(doc).alias("__doc"), whole(F.col(text)).alias("text")).join(F.broadcast(chosen), F.col("__doc") == F.col("__id")).select("text", "toxic", "__id")

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({
                "words": [" ".join(sorted(set(_WORD.findall(t.lower())))) for t in b["text"]],
                "toxic": b["toxic"],
                "pairs": ["\n".join(f"{a} {c}" for a, c in sorted(set(counterfactuals(t)))) for t in b["text"]],
                "id": b["__id"],
            })

    return rows.mapInPandas(reduce, "words string, toxic int, pairs string, id long").toPandas().sort_values("id", kind="stable")


def score(docs: DataFrame, model: ToxicityModel, *, text: str = "text", doc: str = "doc_id", threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) of every row. A text without words (null, empty) has the score of the bias."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, float] = {}
        for b in batches:
            out = []
            for t in b["text"]:
                words = set(_WORD.findall(t.lower()))
                total = 0.0
                for w in words:
                    s = known.get(w)
                    if s is None:
                        if len(known) > 300_000:
                            known.clear()
                        s = known[w] = model.word(w)
                    if s:
                        total += s
                out.append(1 / (1 + np.exp(-min(40.0, max(-40.0, model.bias + total)))))
            yield pd.DataFrame({"doc_id": b["doc"].astype("Int64"), "score": np.round(out, 12), "predicted": (np.round(out, 12) >= threshold).astype("int32") if out else []})

    return docs.select(F.col(doc).cast("long").alias("doc"), whole(F.col(text)).alias("text")).mapInPandas(run, "doc_id long, score double, predicted int")


def held_out(doc: Column) -> Column:
    """crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(doc.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc: str = "doc_id", fit_rows: int = 8000, most_features: int = 600, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs; the fit sees labels of rows that aren't held out only.

    Labels other than 0 and 1 and null ids don't enter the fit; an id labelled twice counts as its larger label. With
    no labelled row of either class the score is the same for all texts. Repeated rows get equal scores; a null id
    counts as not held out; an empty table gives an empty one. Other columns of docs take no part.
    """
    rows = training_rows(docs, labels, ~held_out(F.col(doc)), text=text, doc=doc, fit_rows=fit_rows)
    out = score(docs, fit(rows, most_features=most_features), text=text, doc=doc, threshold=threshold)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
