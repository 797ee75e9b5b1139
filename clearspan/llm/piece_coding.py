"""SentencePiece encoding and decoding, giant documents in parallel by a max-plus scan.

A text becomes U+2581 + text with spaces as U+2581, and its pieces are those of the vocabulary's merges, as the sentencepiece library
finds them. Merges don't look like a sum of scores, but their result is the only cut of a text in which every two
neighbours stand the test of a pair: merging the two together gives just the two again. So a cut is a path through the
pieces that stand in a text, a forbidden pair weighs minus infinity, and the best path is linear over (max, +).

Cut at any place into chunks, a text's state at a boundary is the piece that reaches or crosses it, and a chunk is a matrix from
the states of its entry to those of its exit. Products of these matrices are associative: blocks of FAN chunks are multiplied
side by side, then the blocks of each document, then every chunk learns the best scores of its entry states. From these and its matrix each
chunk maps exit to entry states by itself; the maps are composed the same way from the end, and each chunk is cut
between its two states by itself. The result is the one of the whole text. FAN * FAN chunks are more than the largest string
that Spark holds.

No piece goes over two characters that are neighbours in no piece. Between the first and the last such place of a chunk its
cut doesn't depend on the states and comes from the library in one call, as do whole documents of one chunk or less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored, whole

MARK = "▁"
FAN = 512
#: A character before which the library puts its mark, so that the text after it stays as it is.
GUARD = "\n"
LOW = -np.inf
_CODERS: dict = {}

#: A piece by the places where it starts and ends in a text. None: a place that no piece crosses, so that it doesn't matter which one ends there.
Span = tuple[int, int] | None
#: Where paths go on: the piece before ('' at an open place), where it ends, its scores from each entry.
Head = tuple[str, int, np.ndarray]


class Coder:
    """A vocabulary: its pieces, which neighbours are allowed, and the library's coder."""

    def __init__(self, path: str, most: int = 500_000):
        import sentencepiece

        self.library = model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces: dict[str, tuple[int, float]] = {}
        self.bytes, self.written = [0] * 256, [b""] * model.get_piece_size()
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = i
                self.written[i] = bytes([int(piece[1:-1], 16)])
            elif not (model.is_control(i) or model.is_unknown(i)):
                self.pieces[piece] = (i, float(model.get_score(i)))
                self.written[i] = piece.replace(MARK, " ").encode()
        self.begins = {p[:k] for p in self.pieces for k in range(1, len(p) + 1)}
        self.bonds = {p[k : k + 2] for p in self.pieces for k in range(len(p) - 1)}
        self.longest = max(map(len, self.pieces))
        self.scores = np.array([model.get_score(i) if not model.is_byte(i) else 0.0 for i in range(model.get_piece_size())])
        self.guard = len(model.encode(GUARD))
        self.known: dict[tuple[str, str], bool] = {}
        self.most = most

    def between(self, marked_text: str) -> list[int]:
        """Ids of a text between places that no piece crosses."""
        return self.library.encode(GUARD + marked_text.replace(MARK, " "))[self.guard :] if marked_text else []

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)

    def score(self, ids: list[int] | np.ndarray) -> float:
        """The sum of the pieces' scores; bytes have none."""
        return float(self.scores[np.asarray(ids, dtype=np.int64)].sum())

    def decode(self, ids: np.ndarray) -> str:
        table = self.written
        return b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace")[1:]

    def weight(self, token: str) -> float:
        hit = self.pieces.get(token)
        return hit[1] if hit else 0.0

    def ids(self, token: str) -> list[int]:
        hit = self.pieces.get(token)
        return [hit[0]] if hit else [self.bytes[b] for b in token.encode()]

    def allowed(self, a: str, b: str) -> bool:
        """Whether a and b stand side by side where merges end."""
        if a[-1] + b[0] not in self.bonds:
            return True
        found = self.known.get((a, b))
        if found is None:
            if len(self.known) >= self.most:
                self.known.clear()
            found = self.known[a, b] = self.between(a + b) == self.ids(a) + self.ids(b)
        return found

    # a chunk: its text from longest characters before it to longest after it, as far as there are some; a, z: where it begins and ends in that

    def is_open(self, text: str, place: int) -> bool:
        """Whether no piece crosses a place. A text is cut off at chunks' surroundings only, so place 0 and its end are the document's."""
        return place == 0 or place == len(text) or text[place - 1 : place + 1] not in self.bonds

    def inside(self, text: str, a: int, z: int) -> tuple[int, int] | None:
        """The first and the last open place of a chunk."""
        first = next((p for p in range(a, z + 1) if self.is_open(text, p)), None)
        return None if first is None else (first, next(p for p in range(z, a - 1, -1) if self.is_open(text, p)))

    def states(self, text: str, at: int) -> list[Span]:
        """The pieces that start before a place and reach or cross it, in order."""
        if self.is_open(text, at):
            return [None]
        spans = ((s, e) for s in range(max(0, at - self.longest), at) for e in range(at, min(s + self.longest, len(text)) + 1))
        return [(s, e) for s, e in spans if e == s + 1 or text[s:e] in self.pieces]

    def heads(self, text: str, a: int) -> list[Head]:
        entry = self.states(text, a)
        unit = np.where(np.eye(len(entry)) > 0, 0.0, LOW)
        return [(text[s[0] : s[1]] if s else "", s[1] if s else a, unit[i]) for i, s in enumerate(entry)]

    def paths(self, text: str, heads: list[Head], stop: int) -> dict[int, list[tuple[int, np.ndarray]]]:
        """By the place where they end, the pieces that start before stop and continue the heads: (start, best scores from each entry)."""
        ending: dict[int, list[tuple[str, np.ndarray]]] = {}
        for token, end, scores in heads:
            ending.setdefault(end, []).append((token, scores))
        out: dict[int, list[tuple[int, np.ndarray]]] = {}
        for p in range(min(ending), min(stop, len(text))):
            for q in range(p + 1, min(p + self.longest, len(text)) + 1) if p in ending else ():
                token = text[p:q]
                if q == p + 1 or token in self.pieces:
                    come = [v for before, v in ending[p] if not before or self.allowed(before, token)]
                    if come:
                        scores = np.maximum.reduce(come) + self.weight(token)
                        ending.setdefault(q, []).append((token, scores))
                        out.setdefault(q, []).append((p, scores))
                if token not in self.begins:
                    break
        return out

    def matrix(self, text: str, a: int, z: int) -> np.ndarray:
        """Scores from entry to exit states."""
        heads, out, open_ = self.heads(text, a), self.states(text, z), self.inside(text, a, z)
        nothing = np.full(len(heads), LOW)
        if open_ is None:
            ends = {(e - len(t), e): v for t, e, v in heads} | {(s, e): v for e, row in self.paths(text, heads, z).items() for s, v in row}
            return np.stack([ends.get(s, nothing) for s in out], axis=1)
        first, last = open_
        come = [v for _, e, v in heads if e == first] + [v for _, v in self.paths(text, heads, first).get(first, [])]
        entry = np.maximum.reduce([nothing, *come]) + self.score(self.between(text[first:last]))
        ends = {(s, e): v[0] for e, row in self.paths(text, [("", last, np.zeros(1))], z).items() for s, v in row}
        return entry[:, None] + np.array([0.0 if s is None else ends.get(s, LOW) for s in out])[None, :]

    def trace(self, text: str, head: Head, stop: int, target: Span) -> list[int]:
        """Ids of the best path from a head to a piece (included), or to any piece that ends at an open place stop."""
        token, end, _ = head
        found = self.paths(text, [head], stop)
        span = target or ((max(found[stop], key=lambda f: f[1][0])[0], stop) if stop > end else None)
        parts: list[list[int]] = []
        while span and span[1] > end:
            piece = text[span[0] : span[1]]
            parts.append(self.ids(piece))
            before = [(v[0], s) for s, v in found.get(span[0], []) if self.allowed(text[s : span[0]], piece)]
            span = (max(before)[1], span[0]) if before else None
        return [i for p in reversed(parts) for i in p]

    def cut_chunk(self, text: str, a: int, z: int, enter: int, leave: int) -> list[int]:
        """The ids after an entry state up to an exit state, that one's piece included."""
        token, end, _ = self.heads(text, a)[enter]
        head, target, open_ = (token, end, np.zeros(1)), self.states(text, z)[leave], self.inside(text, a, z)
        if open_ is None:
            return self.trace(text, head, z, target)
        first, last = open_
        tail = self.trace(text, ("", last, np.zeros(1)), z, target) if last < z else []
        return self.trace(text, head, first, None) + self.between(text[first:last]) + tail


def coder(path: str) -> Coder:
    """One for each Python worker and model file."""
    if path not in _CODERS:
        _CODERS[path] = Coder(path)
    return _CODERS[path]


def marked(text: str) -> str:
    return MARK + text.replace(" ", MARK)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product of two matrices, or of a row and a matrix."""
    return (a[..., :, None] + b).max(axis=-2)


def _matrix(raw: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.float64).reshape(rows, -1)


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<i4").tobytes()


def chunks(docs: DataFrame, model: str, text: str, doc: str, chunk_chars: int) -> DataFrame:
    """(row, doc, no, body, a, z): the chunks of the texts longer than chunk_chars."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        around, row = coder(model).longest, TaskContext.get().partitionId() << 32
        if chunk_chars < around:
            raise ValueError(f"a chunk has {around} characters at least")
        for b in batches:
            for d, t in zip(b["doc"].astype("Int64"), b["text"], strict=True):
                body, out = marked(t), []
                for no, at in enumerate(range(0, len(body), chunk_chars)):
                    begin, end = max(0, at - around), min(at + chunk_chars, len(body))
                    out.append((row, d, no, body[begin : end + around], at - begin, end - begin))
                for at in range(0, len(out), 64):
                    yield pd.DataFrame(out[at : at + 64], columns=["row", "doc", "no", "body", "a", "z"]).astype({"doc": "Int64"})
                row += 1

    long = docs.where(F.length(text) > chunk_chars).select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text"))
    return stored(long.mapInPandas(split, "row long, doc long, no int, body string, a int, z int"), "chunks")


def scan_chunks(parts: DataFrame, model: str) -> DataFrame:
    """(row, doc, no, ids): the cut of each chunk."""

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = coder(model)
        for b in batches:
            made = [c.matrix(t, a, z) for t, a, z in zip(b["body"], b["a"], b["z"], strict=True)]
            yield b[["row", "no"]].assign(n=[len(m) for m in made], m=[m.tobytes() for m in made])

    def block_product(b: pd.DataFrame) -> pd.DataFrame:
        b, m = b.sort_values("no"), None
        for raw, n in zip(b["m"], b["n"], strict=True):
            m = _matrix(raw, n) if m is None else times(m, _matrix(raw, n))
        return pd.DataFrame({"row": [b["row"].iloc[0]], "block": [b["no"].iloc[0] // FAN], "n": [len(m)], "m": [m.tobytes()]})

    def block_entries(b: pd.DataFrame) -> pd.DataFrame:
        b, entry, out = b.sort_values("block"), np.zeros(1), []
        for raw, n in zip(b["m"], b["n"], strict=True):
            out.append(entry.tobytes())
            entry = times(entry, _matrix(raw, n))
        return pd.DataFrame({"row": b["row"], "block": b["block"], "entry": out})

    def chunk_maps(key, b: pd.DataFrame, top: pd.DataFrame) -> pd.DataFrame:
        """For each exit state of a chunk the entry state of its best cut."""
        b, out = b.sort_values("no"), []
        entry = np.frombuffer(top["entry"].iloc[0], dtype=np.float64)
        for raw, n in zip(b["m"], b["n"], strict=True):
            reached = entry[:, None] + _matrix(raw, n)
            out.append(reached.argmax(axis=0).tolist())
            entry = reached.max(axis=0)
        return b[["row", "no"]].assign(back=out)

    def compose(b: pd.DataFrame) -> pd.DataFrame:
        """Exit states of a block's last chunk to entry states of its first."""
        b, made = b.sort_values("no", ascending=False), None
        for back in b["back"]:
            made = list(back) if made is None else [int(back[s]) for s in made]
        return pd.DataFrame({"row": [b["row"].iloc[0]], "block": [b["no"].iloc[-1] // FAN], "back": [made]})

    def block_exits(b: pd.DataFrame) -> pd.DataFrame:
        b, state, out = b.sort_values("block", ascending=False), 0, []
        for back in b["back"]:
            out.append(state)
            state = int(back[state])
        return pd.DataFrame({"row": b["row"], "block": b["block"], "leave": out})

    def chunk_exits(key, b: pd.DataFrame, top: pd.DataFrame) -> pd.DataFrame:
        b, state, out = b.sort_values("no", ascending=False), int(top["leave"].iloc[0]), []
        for back in b["back"]:
            out.append((int(back[state]), state))
            state = out[-1][0]
        return b[["row", "no"]].assign(enter=[e for e, _ in out], leave=[x for _, x in out])

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = coder(model)
        for b in batches:
            ids = [_packed(c.cut_chunk(*chunk)) for chunk in zip(b["body"], b["a"], b["z"], b["enter"], b["leave"], strict=True)]
            yield b[["row", "doc", "no"]].assign(doc=b["doc"].astype("Int64"), ids=ids)

    block = F.floor(F.col("no") / FAN).cast("int").alias("block")
    m = stored(parts.select("row", "no", "body", "a", "z").mapInPandas(matrices, "row long, no int, n int, m binary"), "matrices")
    tops = m.groupBy("row", block).applyInPandas(block_product, "row long, block int, n int, m binary").groupBy("row").applyInPandas(block_entries, "row long, block int, entry binary")
    back = stored(m.groupBy("row", block).cogroup(tops.groupBy("row", "block")).applyInPandas(chunk_maps, "row long, no int, back array<int>"), "maps")
    leaves = back.groupBy("row", block).applyInPandas(compose, "row long, block int, back array<int>").groupBy("row").applyInPandas(block_exits, "row long, block int, leave int")
    states = back.groupBy("row", block).cogroup(leaves.groupBy("row", "block")).applyInPandas(chunk_exits, "row long, no int, enter int, leave int")
    return parts.join(stored(states, "states").hint("shuffle_hash"), ["row", "no"]).select("row", "doc", "no", "body", "a", "z", "enter", "leave").mapInPandas(finish, "row long, doc long, no int, ids binary")


def encode(docs: DataFrame, model: str, *, text: str = "text", doc: str = "doc_id", chunk_chars: int = 32_768) -> DataFrame:
    """(doc_id, ids, score) of each row: ids as little-endian 32-bit integers, equal to the library's; score is the sum of the pieces' scores.

    A null or empty text has no ids and score 0. Repeated rows and null ids give a row each (ids that are no whole numbers
    count as null); an empty table gives an empty one. Other columns of docs take no part. A U+2581 in a text is a space after decoding.
    """
    short = docs.where(F.length(whole(F.col(text))) <= chunk_chars).select(F.col(doc).cast("long").alias("doc"), whole(F.col(text)).alias("text"))

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = coder(model)
        for b in batches:
            for at in range(0, len(b), 500):
                some = b.iloc[at : at + 500]
                cuts = [np.array(i, dtype="<i4") for i in c.encode(some["text"].tolist())]
                yield pd.DataFrame({"doc_id": some["doc"].astype("Int64"), "ids": [i.tobytes() for i in cuts], "score": [c.score(i) for i in cuts]})

    schema = "doc_id long, ids binary, score double"
    cut = scan_chunks(chunks(docs, model, text, doc, chunk_chars), model)

    def join(b: pd.DataFrame) -> pd.DataFrame:
        ids = b"".join(b.sort_values("no")["ids"])
        return pd.DataFrame({"doc_id": b["doc"].astype("Int64").iloc[:1], "ids": [ids], "score": [coder(model).score(np.frombuffer(ids, dtype="<i4"))]})

    return short.mapInPandas(one, schema).unionByName(cut.groupBy("row").applyInPandas(join, schema))


def decode(coded: DataFrame, model: str) -> DataFrame:
    """The rows of coded with the column text, made from ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = coder(model)
        for b in batches:
            for at in range(0, len(b), 500):
                some = b.iloc[at : at + 500]
                yield some.assign(doc_id=some["doc_id"].astype("Int64"), text=[c.decode(np.frombuffer(x, dtype="<i4")) for x in some["ids"]])

    return coded.select("doc_id", "ids", "score").mapInPandas(run, "doc_id long, ids binary, score double, text string")
