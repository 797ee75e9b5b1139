"""Substring dedup: word windows that occurred earlier are removed, found by prefix-partitioned suffix trees.

Every suffix of every text belongs to the subtree of its prefix. The shortest prefix is an anchor of 8 words: the least hash
among the 8-word pieces of the suffix's first window. Equal windows have equal anchors at equal places, so a node as deep as
a window lies in one subtree, and the suffixes around an anchor (7 on average) travel as one row with their words: 13 before the
anchor and a window from it on (more for `maximal_repeats`, which tells deeper nodes apart). Subtrees are dealt into groups that fit a task's memory. In a group the suffixes are sorted
word by word, neighbours give the lengths of their common prefixes, and the runs of neighbours that share a window or more
are the tree's deep internal nodes: all leaves of such a node but the least (smallest document, then place) are marked.
Runs of marked windows are given as spans; `maximal_repeats` lists the nodes themselves.

Few suffixes can repeat, and the others never leave their task:
 1. anchors are counted over all documents, with a sum before the shuffle;
 2. a document's repeated anchors come back to it, and only suffixes with such an anchor are sent. Of rows with equal words
    in one batch only the first is sent and the others are marked at once.
An anchor with more places than a group may hold gets a longer prefix, the whole window. A node at that depth needs its least leaf
only, so its subtree isn't built: an aggregate carries the least leaf up, and a sort-merge join (which AQE splits) marks the rest.
Words are compared as 64-bit hashes, one for each word, inside one anchor (64 bits more over 8 words): two windows that
differ are taken for equal with a chance of 2^-64 for a pair that differs in one word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import mix, word_hashes, word_places
from .shared import stored, whole

#: Words of an anchor.
PREFIX = 8
#: Words beyond a window that a row of maximal_repeats carries: nodes are told apart to window + BEYOND words at least.
BEYOND = 16
#: Rows that a group may hold before a prefix is made longer.
GROUP = 20_000
#: Hot anchors up to this number are broadcast.
BROADCAST_HOT = 100_000
#: Longer words travel as a digest of so many characters.
LONGEST = 64
FIRST = np.iinfo(np.int64).min


def _pieces(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of size words."""
    n = len(words) - size + 1
    made = np.full(max(n, 0), size, dtype=np.uint64)
    for k in range(size):
        made = mix(made * np.uint64(0xD6E8FEB86659FD93) + words[k : n + k]) if n > 0 else made
    return made


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[: len(x) - step], x[step:])
        have += step
    return x


def _sliding_place(x: np.ndarray, width: int) -> np.ndarray:
    """The place of the first least value in each run of width values."""
    have, at = 1, np.arange(len(x))
    while have < width:
        step = min(have, width - have)
        n = len(x) - step
        right = x[step:] < x[:n]
        x, at = np.where(right, x[step:], x[:n]), np.where(right, at[step:], at[:n])
        have += step
    return at


def anchors(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor of each window, values of all pieces) of a text's word hashes."""
    pieces = _pieces(words, PREFIX)
    return _sliding_min(pieces, window - PREFIX + 1), pieces


def count_anchors(docs: DataFrame, window: int) -> DataFrame:
    """(anchor, n): anchors with two places or more. docs: (doc, sub, text)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole_batch in batches:
            for at in range(0, len(whole_batch), 500):
                found = []
                for words in word_hashes([t.encode() for t in whole_batch["text"].iloc[at : at + 500]]):
                    if len(words) >= window:
                        own, pieces = anchors(words, window)
                        values, counts = np.unique(pieces, return_counts=True)
                        used = np.isin(values, np.unique(own), assume_unique=True)
                        found.append((values[used], counts[used]))
                if found:
                    values, place = np.unique(np.concatenate([v for v, _ in found]), return_inverse=True)
                    yield pd.DataFrame({"anchor": values.view(np.int64), "n": np.bincount(place, weights=np.concatenate([c for _, c in found])).astype(np.int64)})

    counted = docs.select("text").mapInPandas(count, "anchor long, n long")
    return counted.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1")


def document_anchors(docs: DataFrame, window: int) -> DataFrame:
    """(doc, sub, anchor): the different anchors of each row."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole_batch in batches:
            for at in range(0, len(whole_batch), 500):
                b = whole_batch.iloc[at : at + 500]
                own = [np.unique(anchors(w, window)[0]) if len(w) >= window else w[:0] for w in word_hashes([t.encode() for t in b["text"]])]
                sizes = [len(a) for a in own]
                if any(sizes):
                    yield pd.DataFrame({"doc": np.repeat(b["doc"].to_numpy(np.int64), sizes), "sub": np.repeat(b["sub"].to_numpy(np.int64), sizes), "anchor": np.concatenate(own).view(np.int64)})

    return docs.mapInPandas(find, "doc long, sub long, anchor long")


def _covered(n: int, ranges: np.ndarray, window: int) -> np.ndarray:
    """Which of n words stand in a window whose start lies in one of the ranges (rows: first start, last start)."""
    edges = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edges, ranges[:, 0], 1)
    np.add.at(edges, ranges[:, 1] + window, -1)
    return np.cumsum(edges)[:n] > 0


def _digest(text: str, ranges: np.ndarray, window: int) -> tuple[int, int, str, list[int]]:
    """(words, removed words, sha256 of the kept words, spans) of a text."""
    words = text.encode().split()
    if not len(ranges):
        return len(words), 0, hashlib.sha256(b" ".join(words)).hexdigest(), []
    gone = _covered(len(words), ranges, window)
    edges = np.flatnonzero(np.diff(np.r_[0, gone.astype(np.int8), 0])).tolist()
    kept, at = [], 0
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        kept += words[at:a]
        at = b
    kept += words[at:]
    return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), edges


def _short(word: bytes) -> bytes:
    return word if len(word) <= LONGEST else b"\0" + hashlib.blake2b(word, digest_size=16).hexdigest().encode()


def _cut(raw: bytes, starts: np.ndarray, ends: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[bytes]:
    """The words low..high - 1 of a text for each pair of places; white space and long words are shortened."""
    sizes = ends - starts
    odd = np.r_[0, np.cumsum((np.r_[starts[1:] - ends[:-1] > 1, False]) | (sizes > LONGEST))]
    strange = (odd[high] - odd[low]).tolist()
    cut = [raw[a:b] for a, b in zip(starts[low].tolist(), ends[high - 1].tolist(), strict=True)]
    return [b" ".join(map(_short, c.split())) if s else c for c, s in zip(cut, strange, strict=True)]


RESULT = "doc long, sub long, n_words long, n_removed long, kept_sha256 string, spans array<int>"
#: Of each row sent: its anchor and the anchor's place, the first and last of the starts it stands for (places before the anchor), words before the anchor, words.
PACKED = "anchor array<long>, place array<int>, near array<int>, far array<int>, before array<int>, words array<binary>"
ROW = ["anchor", "place", "near", "far", "before", "words"]


def suffixes(docs: DataFrame, wanted: DataFrame, window: int, beyond: int, fold: bool) -> DataFrame:
    """A row for each row of docs: its result if it has no suffix to compare; else its text, the ranges of starts that are marked
    already (first, last, first, ...), and its suffixes, packed by anchor. fold: of equal rows in a batch send only the first."""
    left, right = window - PREFIX + 1, window + beyond

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole_batch in batches:
            for at in range(0, len(whole_batch), 1000):
                b = whole_batch.iloc[at : at + 1000].sort_values(["doc", "sub"], kind="stable")
                raws, seen, out = [t.encode() for t in b["text"]], {}, []
                for raw, text, doc, sub, own, (words, starts, ends) in zip(raws, b["text"], b["doc"].tolist(), b["sub"].tolist(), b["anchors"], word_places(raws), strict=True):
                    packs = []
                    if own is not None and len(words) >= window:
                        pieces = _pieces(words, PREFIX)
                        place = _sliding_place(pieces, left)
                        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
                        last = np.r_[first[1:], len(place)] - 1
                        place = place[first]
                        used = np.isin(pieces[place], np.asarray(own, dtype=np.int64).view(np.uint64))
                        place, first, last = place[used], first[used], last[used]
                        low, high = np.maximum(place - left, 0), np.minimum(place + right, len(words))
                        packs = list(zip(pieces[place].view(np.int64).tolist(), place.tolist(), (place - last).tolist(), (place - first).tolist(), (place - low).tolist(), _cut(raw, starts, ends, low, high), strict=True))
                    if not packs:
                        out.append((doc, sub, *_digest(text, np.zeros((0, 2), np.int64), window), None, None, *[None] * 6))
                        continue
                    gone, sent = [], []
                    for p in packs:
                        if not fold or seen.setdefault(p[2:], (doc, sub, p[1])) == (doc, sub, p[1]):
                            sent.append(p)
                        else:
                            gone += [p[1] - p[3], p[1] - p[2]]
                    out.append((doc, sub, None, None, None, None, text, gone, *([list(x) for x in zip(*sent, strict=True)] if sent else [[]] * 6)))
                frame = pd.DataFrame(out, columns=["doc", "sub", "n_words", "n_removed", "kept_sha256", "spans", "text", "gone", *ROW])
                yield frame.astype({"n_words": "Int64", "n_removed": "Int64"})

    joined = docs.join(wanted.hint("shuffle_hash"), (docs["doc"] == wanted["of"]) & (docs["sub"] == wanted["of_sub"]), "left").select("doc", "sub", "text", "anchors")
    return joined.mapInPandas(find, f"{RESULT}, text string, gone array<int>, {PACKED}")


class Subtree:
    """The part of the suffix tree that a group's rows hold: for each distance from an anchor the suffixes in order."""

    def __init__(self, rows: pd.DataFrame, window: int, beyond: int = 0):
        rows = rows.sort_values(["doc", "sub", "place"], kind="stable")
        self.left, self.right, self.window = window - PREFIX + 1, window + beyond, window
        self.doc, self.sub, self.place, self.near, self.far = (rows[c].to_numpy(np.int64) for c in ("doc", "sub", "place", "near", "far"))
        hashed = word_hashes(rows["words"].tolist())
        sizes = np.array([len(h) for h in hashed], dtype=np.int64)
        # a row's words around its anchor; 0 where there are none, which is no word
        self.words = np.zeros((len(rows), self.left + self.right), dtype=np.uint64)
        line = np.repeat(np.arange(len(rows)), sizes)
        column = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(self.left - rows["before"].to_numpy(np.int64), sizes)
        if len(rows):
            self.words[line, column] = np.concatenate(hashed)

    def levels(self) -> Iterator[tuple[int, np.ndarray]]:
        """(words before the anchor, suffixes that start there in order of their words): each order follows from the one before, by the new first word."""
        order = np.lexsort(self.words[:, self.left :].T[::-1])
        for k in range(self.left):
            if k:
                order = order[np.argsort(self.words[order, self.left - k], kind="stable")]
            yield k, order[(self.near[order] <= k) & (self.far[order] >= k)]

    def shared(self, k: int, order: np.ndarray, most: int) -> np.ndarray:
        """Length of the common prefix of each suffix and the one before it, up to most words."""
        w = self.words[order, self.left - k : self.left - k + most]
        same = (w[1:] == w[:-1]) & (w[1:] != 0)
        return np.r_[0, np.where(same.all(axis=1), w.shape[1], same.argmin(axis=1))]

    def later(self) -> np.ndarray:
        """Rows (doc, sub, first start, last start) of the leaves that aren't the least below a node as deep as a window."""
        late = np.zeros((len(self.doc), self.left + 2), dtype=np.int8)
        for k, order in self.levels():
            if len(order) > 1:
                tops = np.flatnonzero(self.shared(k, order, self.window) < self.window)
                least = np.repeat(np.minimum.reduceat(order, tops), np.diff(np.r_[tops, len(order)]))  # rows are in order of document and place
                late[order, k + 1] = (self.doc[order] != self.doc[least]) | (self.sub[order] != self.sub[least]) | (self.place[order] != self.place[least])
        row, edge = np.nonzero(np.diff(late, axis=1))
        row, near, far = row[::2], edge[::2], edge[1::2] - 1
        return np.stack([self.doc[row], self.sub[row], self.place[row] - far, self.place[row] - near], axis=1)

    def nodes(self) -> Iterator[tuple[int, int, int, int, int]]:
        """(depth, leaves, doc, sub, start of the least leaf) of the internal nodes as deep as a window whose leaves don't all follow the same word."""
        for k, order in self.levels():
            most = self.right + k
            depth, before = self.shared(k, order, most).tolist() + [0], self.words[order, self.left - k - 1].tolist() if len(order) else []
            open_: list[list] = []  # [depth, first leaf]
            for i in range(1, len(depth)):
                first = i - 1
                while open_ and open_[-1][0] > depth[i]:
                    d, first = open_.pop()
                    if len(set(before[first:i])) > 1 or 0 in before[first:i]:
                        r = int(order[first:i].min())
                        yield d, i - first, int(self.doc[r]), int(self.sub[r]), int(self.place[r]) - k
                if depth[i] >= self.window and (not open_ or open_[-1][0] < depth[i]):
                    open_.append([depth[i], first])


def packed_rows(found: DataFrame) -> DataFrame:
    """(doc, sub, anchor, place, near, far, before, words): the rows sent."""
    return found.where("text IS NOT NULL").select("doc", "sub", F.explode(F.arrays_zip(*ROW)).alias("s")).select("doc", "sub", "s.*")


def groups_of(rows: DataFrame, total: int, group: int) -> DataFrame:
    return rows.withColumn("part", F.pmod(F.xxhash64("anchor"), F.lit(max(1, 2 * total // group + 1)))).groupBy("part")


def hot_anchors(repeated: DataFrame, group: int) -> DataFrame | None:
    """(anchor) of those with more than group places, or None. Each has that many places, so they are few: broadcast up to a counted bound
    (8 bytes each), else merged."""
    hot = stored(repeated.where(F.col("n") > group).select("anchor"), "hot")
    n = hot.limit(BROADCAST_HOT + 1).count()
    return hot.hint("broadcast" if n <= BROADCAST_HOT else "merge") if n else None


def later_starts(rows: DataFrame, hot: DataFrame | None, total: int, window: int, group: int) -> DataFrame:
    """(doc, sub, low, high): ranges of starts whose window starts earlier elsewhere. hot: (anchor) of those with longer prefixes."""

    def tree(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(Subtree(part, window).later(), columns=["doc", "sub", "low", "high"]).astype({"low": "int32", "high": "int32"})

    schema = "doc long, sub long, low int, high int"
    if hot is None:
        return groups_of(rows, total, group).applyInPandas(tree, schema)
    long = stored(hot_starts(rows.join(hot, "anchor", "left_semi"), window), "starts")
    # a table of its own, so that the join reads it through an exchange and AQE can split the leaves of a hot window
    least = stored(long.groupBy("a", "b").agg(F.min(F.struct("doc", "sub", "start")).alias("least")), "least")
    others = long.join(least.hint("merge"), ["a", "b"]).where(F.struct("doc", "sub", "start") != F.col("least"))
    cool = rows.join(hot, "anchor", "left_anti")
    return groups_of(cool, total, group).applyInPandas(tree, schema).unionByName(others.select("doc", "sub", F.col("start").alias("low"), F.col("start").alias("high")))


def hot_starts(rows: DataFrame, window: int) -> DataFrame:
    """(a, b, doc, sub, start): the suffixes of packed rows with 128 bits of their window as prefix."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole_batch in batches:
            for at in range(0, len(whole_batch), 2000):
                t = Subtree(whole_batch.iloc[at : at + 2000], window)
                for k in range(t.left):
                    r = np.flatnonzero((t.near <= k) & (t.far >= k))
                    a, b = np.full(len(r), 1, dtype=np.uint64), np.full(len(r), 2, dtype=np.uint64)
                    for j in range(window):
                        w = t.words[r, t.left - k + j]
                        a, b = mix(a * np.uint64(0xD6E8FEB86659FD93) + w), mix(b * np.uint64(0x9E3779B97F4A7C55) + w)
                    yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64), "doc": t.doc[r], "sub": t.sub[r], "start": (t.place[r] - k).astype(np.int32)})

    return rows.mapInPandas(spread, "a long, b long, doc long, sub long, start int")


def _rows(docs: DataFrame, text: str, doc: str) -> DataFrame:
    """(doc, sub, text): a row without an id is a document of its own, told apart by its text."""
    key, body = F.col(doc).cast("long"), whole(F.col(text))
    return docs.select(F.coalesce(key, F.lit(int(FIRST))).alias("doc"), F.when(key.isNull(), F.xxhash64(body)).otherwise(F.lit(0)).alias("sub"), body.alias("text"))


def _found(rows: DataFrame, window: int, beyond: int = 0, fold: bool = True) -> tuple[DataFrame, DataFrame]:
    """(repeated anchors, suffixes), both stored."""
    if window < 2 * PREFIX:
        raise ValueError(f"a window has {2 * PREFIX} words at least")
    repeated = stored(count_anchors(rows, window), "anchors")
    own = document_anchors(rows, window).join(repeated.select("anchor").hint("merge"), "anchor", "left_semi")
    wanted = own.groupBy(F.col("doc").alias("of"), F.col("sub").alias("of_sub")).agg(F.collect_set("anchor").alias("anchors"))
    return repeated, stored(suffixes(rows, wanted, window, beyond, fold), "suffixes")


def _total(found: DataFrame) -> int:
    return int(found.agg(F.coalesce(F.sum(F.size("place")), F.lit(0)).alias("n")).first()["n"])


def remove_repeats(docs: DataFrame, *, text: str = "text", doc: str = "doc_id", window: int = 20, group: int = GROUP) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, spans) of each row; spans has the starts and ends (not included) of the removed
    runs of words, in words from 0, one after the other.

    A word goes if a window of the input that covers it starts earlier too: in a smaller doc_id, or earlier in the same one.
    Rows without an id come before all others, in the order of their texts' hashes. Rows that share an id share its places:
    equal windows at an equal place are no earlier than each other. Ids that are no whole numbers count as null. A null text has
    no words; texts of fewer words than a window lose nothing. An empty table gives an empty one. Other columns of docs take
    no part. group is the number of rows a task sorts at once; anchors with more places get longer prefixes.
    """
    rows = _rows(docs, text, doc)
    repeated, found = _found(rows, window)
    later = later_starts(packed_rows(found), hot_anchors(repeated, group), _total(found), window, group)
    marks = later.groupBy(F.col("doc").alias("of"), F.col("sub").alias("of_sub")).agg(F.flatten(F.collect_list(F.array("low", "high"))).alias("later"))

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for d, s, t, gone, late in zip(b["doc"], b["sub"], b["text"], b["gone"], b["later"], strict=True):
                both = np.r_[np.asarray(gone, np.int64), np.asarray(late if late is not None else [], np.int64)]
                out.append((d, s, *_digest(t, both.reshape(-1, 2), window)))
            yield pd.DataFrame(out, columns=["doc", "sub", "n_words", "n_removed", "kept_sha256", "spans"])

    open_ = found.where("text IS NOT NULL").select("doc", "sub", "text", "gone")
    ended = open_.join(marks.hint("shuffle_hash"), (open_["doc"] == marks["of"]) & (open_["sub"] == marks["of_sub"]), "left").select("doc", "sub", "text", "gone", "later").mapInPandas(finish, RESULT)
    every = found.where("text IS NULL").select("doc", "sub", "n_words", "n_removed", "kept_sha256", "spans").unionByName(ended)
    return every.select(F.when(F.col("doc") != int(FIRST), F.col("doc")).alias("doc_id"), "n_words", "n_removed", "kept_sha256", "spans")


def maximal_repeats(docs: DataFrame, *, text: str = "text", doc: str = "doc_id", window: int = 20, group: int = GROUP) -> DataFrame:
    """(depth, n_leaves, doc_id, start): the deep internal nodes that are maximal repeats: runs of depth words that stand at several places
    and are followed, and preceded, by different words there. doc_id and start name the first place.

    depth is exact up to window + BEYOND words at least; a longer repeat is cut there, and found again by a later node only
    where it branches. Anchors with more than group places have no subtree here: their repeats are in the spans of
    remove_repeats. Nulls and empty tables as there.
    """
    repeated, found = _found(_rows(docs, text, doc), window, BEYOND, fold=False)
    hot = hot_anchors(repeated, group)

    def tree(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(list(Subtree(part, window, BEYOND).nodes()), columns=["depth", "n_leaves", "doc", "sub", "start"], dtype="int64")

    rows = packed_rows(found)
    rows = rows.join(hot, "anchor", "left_anti") if hot else rows
    nodes = groups_of(rows, _total(found), group).applyInPandas(tree, "depth int, n_leaves long, doc long, sub long, start int")
    return nodes.select("depth", "n_leaves", F.when(F.col("doc") != int(FIRST), F.col("doc")).alias("doc_id"), "start")
