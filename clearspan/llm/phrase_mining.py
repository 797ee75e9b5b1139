"""Phrase collocations by dynamic itemset counting.

Texts are coded once, as packs of PACK words with a dictionary of their own, and the packs are dealt into shards. The shards are scanned in a
cycle, and phrases of all lengths are counted in the same scan:
 - a word is counted from the first scan on;
 - a pair is active from the scan after both its words have reached the threshold, a triple from the one after both its pairs have;
 - each is counted for one full cycle from its first active scan, whatever shard that is, so its count is whole.
A phrase that ends its cycle below the threshold is forgotten: the state holds what may still become frequent.

A scan sends a pack what it needs to know, and no more: which of its own words, and of its own pairs, are active or have reached the threshold. That
is a join of the pack's dictionary with the words' state, and of the pack's pairs with the pairs' state; nothing is broadcast or
collected. A pack counts with numpy and sends one row for each of its active phrases. Frequent words get numbers, so pairs and triples are
keys of one and two longs; their words come back at the end, for the frequent ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import forget, new_path, stored

#: Words of a pack; bytes of a text that are coded at once.
PACK, SLICE = 3_000_000, 4_000_000
#: Rows of a pack's results that leave a task at once.
BATCH = 250_000
#: Shards of the cycle.
SHARDS = 2
#: Buckets in which frequent words are numbered.
BUCKETS = 1024
#: Numbers of words stay below this, so that two of them make a long.
MOST_WORDS = 2**31
BREAK = -1
_SPACES = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
CODED = "pack long, code int, lang string, word string, n long, codes binary, tail int, shard int"
CODED_ARROW = pa.schema({"pack": pa.int64(), "code": pa.int32(), "lang": pa.string(), "word": pa.string(), "n": pa.int64(), "codes": pa.binary(), "tail": pa.int32(), "shard": pa.int32()})


def shaped(rows: int, **columns) -> pa.RecordBatch:
    """A batch of CODED: arrays as they are, numbers repeated, other columns null."""
    given = {f.name: columns.get(f.name) for f in CODED_ARROW}
    return pa.record_batch([v if isinstance(v, pa.Array) else pa.repeat(pa.scalar(v, CODED_ARROW.field(c).type), rows) for c, v in given.items()], CODED_ARROW)


class Packer:
    """Codes of words, with BREAK between pieces, until they make a pack."""

    def __init__(self):
        self.names: list[tuple[str, bytes]] = []
        self.of: dict[str, dict[bytes, int]] = {}
        self.held: list[np.ndarray] = []
        self.n = 0

    def add(self, lang: str, words: list[bytes]) -> None:
        of = self.of.setdefault(lang, {b"": BREAK - 1, b"\n": BREAK})
        for w in set(words).difference(of):
            of[w] = len(self.names)
            self.names.append((lang, w))
        codes = np.fromiter(map(of.__getitem__, words), dtype=np.int32, count=len(words))
        codes = codes[codes >= BREAK]
        self.held.append(codes)
        self.n += len(codes)

    def taken(self, tail: int) -> tuple[np.ndarray, pa.Table]:
        """(codes, dictionary with the counts of all words but the last tail ones)."""
        codes = np.concatenate(self.held) if self.held else np.zeros(0, np.int32)
        own = codes[: len(codes) - tail]
        counts = np.bincount(own[own >= 0], minlength=len(self.names))
        tongues = {k: n for n, k in enumerate(self.of)}
        lang = pa.DictionaryArray.from_arrays(np.fromiter((tongues[k] for k, _ in self.names), np.int32, len(self.names)), pa.array(list(tongues), pa.string()))
        word = pa.array([w for _, w in self.names], pa.binary()).cast(pa.string())
        words = pa.table({"code": np.arange(len(self.names), dtype=np.int32), "lang": lang.cast(pa.string()), "word": word, "n": counts.astype(np.int64)})
        return codes, words


def slices(raw: bytes) -> Iterator[bytes]:
    """raw in slices of SLICE bytes at most that end after a blank or a break; a word longer than that stays whole."""
    at = 0
    while len(raw) - at > SLICE:
        cut = max(raw.rfind(b" ", at, at + SLICE), raw.rfind(b"\n", at, at + SLICE)) + 1
        if cut <= at:
            later = [k for k in (raw.find(b" ", at), raw.find(b"\n", at)) if k >= 0]
            cut = min(later) + 1 if later else len(raw)
        yield raw[at:cut]
        at = cut
    if at < len(raw):
        yield raw[at:]


def coded(docs: DataFrame, lang: str, text: str, shards: int, pack: int) -> tuple[DataFrame, DataFrame]:
    """(packs, words), stored: (shard, pack, codes, tail) and (shard, pack, code, lang, word, n). The last tail words of a pack begin the next one."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, packs, p = TaskContext.get().partitionId(), 0, Packer()

        def close(tail: int) -> Iterator[pa.RecordBatch]:
            nonlocal packs, p
            codes, words = p.taken(tail)
            pack_, shard = (part << 24) + packs, (part + packs) % shards
            names, p, packs = p.names, Packer(), packs + 1
            for c in codes[len(codes) - tail :]:
                p.add(names[c][0], [names[c][1]])
            for some in words.to_batches(max_chunksize=100_000):
                yield shaped(some.num_rows, pack=pack_, shard=shard, **dict(zip(some.schema.names, some.columns, strict=True)))
            yield shaped(1, pack=pack_, shard=shard, codes=pa.array([codes.tobytes()], pa.binary()), tail=tail)

        for b in batches:
            for tongue, body in zip(b["lang"].to_pylist(), b["text"].to_pylist(), strict=True):
                for raw in slices(body.encode().translate(_SPACES)):
                    p.add(tongue, raw.replace(b"\n", b" \n ").split(b" "))
                    if p.n >= pack:  # within a text: up to two words go with both packs, so that no phrase is cut
                        last = np.concatenate(p.held)[-2:]
                        yield from close(0 if last[-1] == BREAK else 1 if last[0] == BREAK else len(last))
                p.add(tongue, [b"\n"])
                if p.n >= pack:
                    yield from close(0)
        if p.n:
            yield from close(0)

    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(code, CODED)
    path = new_path(docs.sparkSession, "packs")
    rows.write.partitionBy("shard").option("compression", "zstd").parquet(path)
    every = docs.sparkSession.read.schema(CODED).parquet(path)
    return every.where("codes IS NOT NULL").select("shard", "pack", "codes", "tail"), every.where("code IS NOT NULL").select("shard", "pack", "code", "lang", "word", "n")


def counted(keys: np.ndarray, since: np.ndarray, keep: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(scan, keys, their counts) for each scan in since, of what keep marks; of all equal keys since is the same."""
    for scan in np.unique(since[keep]).tolist():
        own = keys[keep & (since == scan)]
        own.sort()
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        yield scan, own[first], np.diff(first, append=len(own))


def batched(schema: pa.Schema, parts: list[dict[str, np.ndarray]]) -> pa.Table:
    """The parts' columns as a table in batches of BATCH rows, for no reader to hold it twice."""
    tables = [pa.table({name: pa.array(p[name], kind) for name, kind in zip(schema.names, schema.types, strict=True)}, schema) for p in parts]
    return pa.Table.from_batches([b for t in tables for b in t.to_batches(max_chunksize=BATCH)], schema)


class Scanned:
    """A pack's words as numbers, with the scan from which each is active; and which of its pairs have reached the threshold, from which scan on."""

    def __init__(self, packs: pa.Table, known: pa.Table):
        codes, tail = np.frombuffer(packs["codes"][0].as_buffer(), dtype=np.int32), packs["tail"][0].as_py()
        code, number_of, at, pair = (known[c].to_numpy() for c in ("code", "id", "at", "pair"))
        words = pair < 0
        size = int(max(codes.max(initial=-1), BREAK)) + 2
        number, active = np.full(size, -1, dtype=np.int32), np.zeros(size, dtype=np.int8)
        number[code[words]] = number_of[words]
        active[code[words]] = at[words]
        self.word, active = number[codes], active[codes]  # BREAK is the last entry, which is no word
        self.starts = len(codes) - tail
        self.pair = self.word[:-1].astype(np.int64)
        self.pair <<= 32
        self.pair |= self.word[1:]
        self.pair[(self.word[:-1] < 0) | (self.word[1:] < 0)] = -1
        self.since = np.maximum(active[:-1], active[1:])
        order = np.argsort(pair, kind="stable")[np.count_nonzero(words) :]
        self.reached, self.reached_at = pair[order], at[order].astype(np.int8)

    def pairs(self, after: int, every: bool) -> Iterator[dict[str, np.ndarray]]:
        """(pair, n, since) of the pairs active since a scan later than after; every: and the others, with no count."""
        pair, since = self.pair[: self.starts], self.since[: self.starts]
        keep = pair >= 0 if every else (pair >= 0) & (since > after)
        for scan, key, n in counted(pair, since, keep):
            yield {"pair": key, "n": n if scan > after else 0 * n, "since": np.full(len(key), scan, dtype=np.int32)}

    def places(self) -> np.ndarray:
        """Of each pair the place among those that have reached the threshold, -1 for the others."""
        out = np.full(len(self.pair), -1, dtype=np.int32)
        for at in range(0, len(out), BATCH):
            own = self.pair[at : at + BATCH]
            place = np.minimum(np.searchsorted(self.reached, own), len(self.reached) - 1)
            hit = (self.reached[place] == own) & (own >= 0)
            out[at : at + BATCH][hit] = place[hit]
        return out

    def triples(self, after: int) -> Iterator[dict[str, np.ndarray]]:
        """(pair, third, n, since) of the triples active since a scan later than after."""
        if len(self.reached) and len(self.pair) > 1:
            at = self.places()
            since = np.maximum(self.reached_at[at[:-1]], self.reached_at[at[1:]])
            keep = (at[:-1] >= 0) & (at[1:] >= 0) & (since > after)
            keep[self.starts :] = False
            keys = at[:-1][keep].astype(np.int64)
            keys <<= 32
            keys |= self.word[2:][keep]
            for scan, key, n in counted(keys, since[keep], np.ones(len(keys), dtype=bool)):
                yield {"pair": self.reached[key >> 32], "third": key & (2**32 - 1), "n": n, "since": np.full(len(key), scan, dtype=np.int32)}


PAIRS = pa.schema({"pack": pa.int64(), "pair": pa.int64(), "n": pa.int64(), "since": pa.int32()})
TRIPLES = pa.schema({"pair": pa.int64(), "third": pa.int64(), "n": pa.int64(), "since": pa.int32()})


def pairs_of(after: int, every: bool):
    """Scanned.pairs of a pack, as a grouped map."""

    def of(packs: pa.Table, known: pa.Table) -> pa.Table:
        if not packs.num_rows:
            return batched(PAIRS, [])
        pack = packs["pack"][0].as_py()
        return batched(PAIRS, [p | {"pack": np.full(len(p["pair"]), pack)} for p in Scanned(packs, known).pairs(after, every)])

    return of


def triples_of(after: int):
    """Scanned.triples of a pack, as a grouped map."""

    def of(packs: pa.Table, known: pa.Table) -> pa.Table:
        return batched(TRIPLES, list(Scanned(packs, known).triples(after)) if packs.num_rows else [])

    return of


def _numbered(state: DataFrame, base: int, scan: int, threshold: int) -> DataFrame:
    """state with numbers from base on for the words that have reached the threshold and have none; they are active from the next scan on."""
    fresh = state.where((F.col("n") >= threshold) & F.col("id").isNull()).withColumn("bucket", F.pmod(F.xxhash64("lang", "word"), F.lit(BUCKETS)))
    place = F.row_number().over(W.partitionBy("bucket").orderBy("lang", "word")) - 1
    fresh = fresh.select("lang", "word", "n", (F.lit(base) + place * BUCKETS + F.col("bucket")).alias("id"), F.lit(scan + 1).alias("at"))
    return state.where((F.col("n") < threshold) | F.col("id").isNotNull()).unionByName(fresh)


def _merged(state: DataFrame | None, found: DataFrame, keys: list[str], scan: int, shards: int, threshold: int, name: str) -> DataFrame:
    """The state (keys, n, since, at) with a scan's counts added, without what has ended its cycle below the threshold."""
    every = found.select(*keys, F.col("n").cast("long").alias("n"), F.col("since").cast("int").alias("since"), F.lit(None).cast("int").alias("at"))
    every = state.unionByName(every) if state is not None else every
    summed = every.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("since").alias("since"), F.min("at").alias("at"))
    reached = F.coalesce("at", F.when(F.col("n") >= threshold, F.lit(scan + 1)))
    return stored(summed.withColumn("at", reached).where(F.col("at").isNotNull() | (F.col("since") + shards - 1 > scan)), name)


def frequent(docs: DataFrame, *, lang: str = "lang", text: str = "text", threshold: int = 10, shards: int = SHARDS, pack: int = PACK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, pairs, triples): (lang, word, n, id) of all words, those under the threshold without id; (pair, n) and (pair, third, n) of the
    frequent phrases, where pair is the first word's id times 2^32 and the second's, and third an id."""
    spark = docs.sparkSession
    packs, words = coded(docs, lang, text, shards, pack)
    state = spark.createDataFrame([], "lang string, word string, n long, id long, at int")
    pairs, triples, base, known = None, None, 0, None
    latest_words, latest_pairs = 0, 0  # the last scan from which a word, a pair became active

    for scan in range(3 * shards):
        shard = scan % shards
        own, after = packs.where(F.col("shard") == shard), scan - shards
        if scan < shards:
            mine = words.where(F.col("shard") == shard)
            active = state.where(F.col("at") <= scan)
            sent = stored(mine.select("pack", "code", "lang", "word").join(active.hint("shuffle_hash"), ["lang", "word"]).select("pack", "code", "id", "at"), "known") if scan else None
            added = mine.select("lang", "word", "n", F.lit(None).cast("long").alias("id"), F.lit(None).cast("int").alias("at"))
            summed = state.unionByName(added).groupBy("lang", "word").agg(F.sum("n").alias("n"), F.max("id").alias("id"), F.max("at").alias("at"))
            counts, old = stored(summed, "counts"), state
            state = stored(_numbered(counts, base, scan, threshold), "words")
            forget(counts)
            forget(old)
            top = state.agg(F.max("id").alias("id"), F.max("at").alias("at")).first()
            base, latest_words = BUCKETS * ((top["id"] or 0) // BUCKETS + 1), top["at"] or 0
            if base > MOST_WORDS:
                raise ValueError("more frequent words than a number of 31 bits can tell")
        else:
            if known is None:  # every word has been counted
                found = words.select("shard", "pack", "code", "lang", "word").join(state.where("id IS NOT NULL").hint("shuffle_hash"), ["lang", "word"])
                known = stored(found.select("shard", "pack", "code", "id", "at"), "known")
            sent = known.where(F.col("shard") == shard).select("pack", "code", "id", "at")
        if not scan:
            continue
        count_pairs, count_triples = latest_words > after, pairs is not None and latest_pairs > after
        if not count_pairs and not count_triples:
            continue
        # no nulls, which would turn longs into doubles in numpy
        sent = sent.withColumn("pair", F.lit(-1).cast("long"))
        before = pairs
        found = own.groupBy("pack").cogroup(sent.groupBy("pack")).applyInArrow(pairs_of(after, count_triples), "pack long, pair long, n long, since int")
        if count_pairs:
            found = stored(found, "pairs_of_packs") if count_triples else found
            pairs = _merged(before, found.where("n > 0"), ["pair"], scan, shards, threshold, "pairs")
            latest_pairs = pairs.agg(F.max("at")).first()[0] or 0
        if count_triples:
            reached = before.where(F.col("at") <= scan).select("pair", "at")
            answers = found.select("pack", "pair").join(reached.hint("shuffle_hash"), "pair").select("pack", F.lit(-1).alias("code"), F.lit(-1).cast("long").alias("id"), "at", "pair")
            counted = own.groupBy("pack").cogroup(sent.unionByName(answers).groupBy("pack")).applyInArrow(triples_of(after), "pair long, third long, n long, since int")
            old, triples = triples, _merged(triples, counted, ["pair", "third"], scan, shards, threshold, "triples")
            if old is not None:
                forget(old)
        if count_pairs:  # what this scan has merged is not read again
            if count_triples:
                forget(found)
            if before is not None:
                forget(before)
    none = spark.createDataFrame([], "pair long, third long, n long")
    return state.select("lang", "word", "n", "id"), (pairs.where(F.col("n") >= threshold) if pairs is not None else none).select("pair", "n"), (triples.where(F.col("n") >= threshold) if triples is not None else none).select("pair", "third", "n")


def cut_score(a: str, left: str, right: str) -> Column:
    """floor(1000000 * a * a / (left * right)) of columns with counts up to 10^14, exact."""
    d = "DECIMAL(14,0)"
    return F.expr(f"CAST(1000000 AS DECIMAL(7,0)) * CAST({a} AS {d}) * CAST({a} AS {d}) div (CAST({left} AS {d}) * CAST({right} AS {d}))")


def collocations(docs: DataFrame, *, lang: str = "lang", text: str = "text", threshold: int = 10, cover: int = 50, top: int = 2000, shards: int = SHARDS, pack: int = PACK) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's top phrases of two or three words that stand threshold times or more within pieces.

    Pieces end at . , ; : ! ? and line ends; words are parted by spaces and tabs, with A-Z in lower case. a counts the phrase, l and r the parts of its
    lowest-scoring cut, n all words of the language. Phrases inside a longer one with cover percent of their count are left out.
    A null lang is und, a null text has no words, an empty table gives no rows. Repeated rows count each; other columns take no part.
    top is the length of the report.
    """
    words, pairs, triples = frequent(docs, lang=lang, text=text, threshold=threshold, shards=shards, pack=pack)
    total = words.groupBy("lang").agg(F.sum("n").alias("total"))
    names = words.where("id IS NOT NULL")
    first, second, third = (names.select(F.col("id").alias(f"i{k}"), F.col("word").alias(f"w{k}"), F.col("n").alias(f"n{k}"), *(["lang"] if k == 1 else [])).hint("merge") for k in (1, 2, 3))
    low = 2**32 - 1
    named = pairs.select("pair", F.col("n").alias("a"), F.shiftright("pair", 32).alias("i1"), F.col("pair").bitwiseAND(low).alias("i2")).join(first, "i1").join(second, "i2")
    named = stored(named, "pairs")
    later = F.shiftleft(F.col("pair").bitwiseAND(low), 32).bitwiseOR(F.col("third"))
    ends = triples.select("pair", F.col("third").alias("i3"), F.col("n").alias("a"), later.alias("then"))
    joined = ends.join(named.select("pair", F.col("a").alias("n12"), "lang", "w1", "n1", "w2").hint("merge"), "pair").join(pairs.select(F.col("pair").alias("then"), F.col("n").alias("n23")).hint("merge"), "then").join(third, "i3")
    joined = stored(joined, "triples")
    over = joined.select(F.explode(F.array("pair", "then")).alias("pair"), "a").groupBy("pair").agg(F.max("a").alias("over"))
    open_ = named.join(stored(over, "over").hint("merge"), "pair", "left").where(F.col("over").isNull() | (100 * F.col("over") < cover * F.col("a")))
    of_pairs = open_.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("n1").alias("l"), F.col("n2").alias("r")).withColumn("score", cut_score("a", "l", "r"))
    cuts = joined.withColumn("s1", cut_score("a", "n1", "n23")).withColumn("s2", cut_score("a", "n12", "n3"))
    early = F.col("s1") <= F.col("s2")
    of_triples = cuts.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.when(early, F.col("n1")).otherwise(F.col("n12")).alias("l"), F.when(early, F.col("n23")).otherwise(F.col("n3")).alias("r"), F.least("s1", "s2").alias("score"))
    ranked = of_pairs.unionByName(of_triples)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    for parts in (512, 16):  # lists merged as a tree: no task orders all phrases of a language
        part = F.pmod(F.xxhash64("phrase"), F.lit(parts))
        ranked = ranked.withColumn("part", part).withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top).drop("part", "rank")
    ranked = ranked.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(stored(total, "total").hint("merge"), "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
