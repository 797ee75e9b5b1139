"""Quality rules: counted rules, then a hashed n-gram log-likelihood ratio between trusted and raw text.

N-grams are words, neighbouring pairs of words and the last two characters of words, hashed into BUCKETS buckets. One multinomial comes from every document of the table (raw), one from every
trusted row (labels.quality = 1). A document's score is the mean over its n-grams of log(trusted / raw), so its
length cancels out; documents under a fixed threshold go. Every rule works inside one row on arrays: scoring has no
shuffle, and fitting shuffles at most one row for each bucket and map task. Built-in functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BLANKS, free_names, long_table, whole, words_of

#: Characters counted by n_symbols.
SYMBOLS = "#*$%&|<>"
OUTPUTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept"]


def repeated_words(words: Column, span: int = 8) -> Column:
    """How many words stand in a window of span words that the array holds twice or more, the first one included.

    Windows are compared by 64-bit hashes, doubled from one word to span words (a power of two). Arrays whose window
    hashes all differ end there; only the others sort (hash, place) and measure the union of the repeated windows.
    """
    hashes, step = F.transform(words, lambda w: F.xxhash64(w)), 1
    while step < span:
        hashes = _pairs(hashes, step)
        step *= 2
    return F.aggregate(F.array(hashes), F.lit(0).cast("long"), lambda _, h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_covered(h, span)))


def _pairs(h: Column, step: int) -> Column:
    """Hashes of windows twice as long: each with the one that starts step places later."""
    return F.aggregate(F.array(h), F.array().cast("array<bigint>"), lambda _, x: F.when(F.size(x) <= step, F.array().cast("array<bigint>")).otherwise(
        F.zip_with(F.slice(x, 1, F.greatest(F.size(x) - step, F.lit(0))), F.slice(x, step + 1, F.greatest(F.size(x) - step, F.lit(0))), lambda a, b: F.xxhash64(a, b))))


def _covered(h: Column, span: int) -> Column:
    ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    twins = F.aggregate(F.array(ordered), F.array().cast("array<int>"), lambda _, s: F.sort_array(F.array_distinct(F.flatten(F.zip_with(
        F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))))))
    return F.aggregate(twins, F.struct(F.lit(-span).alias("last"), F.lit(0).cast("long").alias("n")), lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(i - acc["last"], F.lit(span))).alias("n")), lambda acc: acc["n"])


def base_counts(docs: DataFrame, words: str, *, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, and a column words that holds them."""
    (lined,) = free_names([*docs.columns, words], "__lines")
    body = whole(F.col(text))
    lines = F.filter(F.split(body, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)
    counted = docs.withColumns({
        words: words_of(F.col(text)),
        lined: lines,
    }).withColumns({
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.regexp_count(body, F.lit(f"[{SYMBOLS}]")).cast("long"),
        "n_dup_lines": (F.size(lined) - F.size(F.array_distinct(lined))).cast("long"),
        "n_repeat_words": F.when(F.size(words) < 9, F.lit(0).cast("long")).otherwise(repeated_words(F.col(words))),
    })
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return counted.withColumn("base_failed", failed).drop(lined)


def hashed(words: Column) -> tuple[Column, Column]:
    """Arrays of each word's hash and of the hash of its last two characters."""
    return F.transform(words, lambda w: F.xxhash64(w)), F.transform(words, lambda w: F.xxhash64(F.lit(2), F.substring(w, -2, 2)))


def bucket_of(h: Column, buckets: int) -> Column:
    """From 0; buckets is a power of two."""
    return h.bitwiseAND(F.lit(buckets - 1)).cast("int")


#: What stands for the word after the last one.
END = 0


#: Buckets, whatever the corpus's size: a table of 65,536 doubles in each task.
BUCKETS = 1 << 16
#: Trusted ids up to this number (16 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 500_000


def fit_ratio(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc: str = "doc_id", buckets: int) -> list[float]:
    """log(trusted / raw) by bucket: raw counts cover all of docs, trusted ones every row whose id has quality = 1. Both get one
    added count a bucket. The driver gets a row for each bucket."""
    good = labels.where((F.col("quality") == 1) & F.col(doc).isNotNull()).select(F.col(doc).alias("__id")).distinct().withColumn("__trusted", F.lit(1))
    few = good.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    marked = docs.select(F.col(doc).alias("__doc"), F.col(text).alias("__text")).join(good.hint("broadcast" if few else "shuffle_hash"), F.col("__doc") == F.col("__id"), "left")
    words = marked.withColumn("__words", words_of(F.col("__text"))).where(F.size("__words") > 0)
    own, tails = hashed(F.col("__words"))
    words = words.select("__trusted", own.alias("w"), tails.alias("t"))
    following = F.concat(F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), F.array(F.lit(END).cast("long")))
    pairs = words.select(F.explode(F.arrays_zip("w", following.alias("next"), "t")).alias("p"), "__trusted").select("p.w", "p.next", "p.t", "__trusted")
    grams = F.array(*[bucket_of(h, buckets) for h in (F.col("w"), F.xxhash64("w", "next"), F.col("t"))])
    counts = pairs.select(F.explode(grams).alias("bucket"), "__trusted").groupBy("bucket").agg(F.count("*").alias("raw"), F.count("__trusted").alias("trusted")).collect()
    raw, own = [1.0] * buckets, [1.0] * buckets
    for r in counts:
        raw[r["bucket"]] += r["raw"]
        own[r["bucket"]] += r["trusted"]
    shift = math.log(sum(raw)) - math.log(sum(own))
    return [round(math.log(own[i] / raw[i]) + shift, 9) for i in range(buckets)]


def with_quality(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc: str = "doc_id", buckets: int = BUCKETS, threshold: float = -0.4) -> DataFrame:
    """All rows and columns of docs with the counts, base_failed, llr and kept. buckets is a power of two.

    A null text counts as an empty one: no words, base_failed, llr 0. A text without words has llr 0. If no row is
    trusted the ratio is flat and only the counted rules decide. Repeated rows are judged each for itself; null ids are
    never trusted; an empty table gives an empty one. Input columns with an output's name are replaced, all others carried.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in OUTPUTS])
    weights = fit_ratio(docs, labels, text=text, doc=doc, buckets=buckets)
    (words,) = free_names(docs.columns, "__words")
    counted = base_counts(docs, words, text=text)
    table = long_table(weights)
    weight = lambda h: F.get(table, bucket_of(h, buckets))
    own, tails = hashed(F.col(words))
    # one look over the hashes: the sum so far and the word before, whose pair becomes known with its follower
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("long").alias("before"))
    step = lambda acc, h: F.struct((acc["sum"] + weight(h) + F.when(acc["before"].isNull(), 0.0).otherwise(weight(F.xxhash64(acc["before"], h)))).alias("sum"), h.alias("before"))
    pairs = F.aggregate(own, start, step, lambda acc: acc["sum"] + weight(F.xxhash64(acc["before"], F.lit(END).cast("long"))))
    total = pairs + F.aggregate(tails, F.lit(0.0), lambda acc, h: acc + weight(h))
    scored = counted.withColumn("llr", F.when(F.size(words) == 0, 0.0).otherwise(total / (3 * F.size(words))))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold)).drop(words)
