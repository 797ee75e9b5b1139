"""Token-ID output: bit-plane files with a chunk index, written and read back by Spark tasks.

Documents are dealt by ranges of doc_id, so each task owns a run of the order and writes one file: its ids, in chunks of
a fixed number of ids, each chunk transposed into bit planes (or byte planes), each plane compressed with
zstandard. A footer holds the chunk index (ids and plane lengths of each chunk) and the documents of the file. Memory
is one chunk and one document. A task that runs again writes a new file under a new name; only the files named by the
manifest count, and the manifest is a table that Spark commits once.

File: b"BPLANES1", the planes of chunk 0, 1, ..., the footer (zstandard over JSON), 8 bytes little-endian footer
length, b"BPLANES1".
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import new_path, stored, whole

MAGIC = b"BPLANES1"
_CACHES: dict[str, tuple] = {}


#: A word of Latin letters and the ASCII punctuation after it: two pieces of text that no token joins.
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-/:-@\\[-`{-~]*)")

#: Marks that may join a capital and a small letter to different characters.
_COMBINING = re.compile("[\u0300-\u036f]")


class Encoder:
    """Encodes texts with a tokenizers file whose vocabulary has word ends, lower-cases, and drops white space.

    No token crosses ASCII white space, so words keep their ids in a table of bounded size. A new word of Latin letters,
    with or without punctuation after it, is put together from the ids of its letters in lower case and of its
    punctuation, which have a table too; the letters of a batch that are new go to the library in one call and
    come apart at the tokens that end a word. Any other word goes to the library by itself.
    """

    def __init__(self, path: str, most: int = 400_000):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer, self.letters, self.most = Tokenizer.from_file(path), Tokenizer.from_file(path), most
        # composed small letters alone: its own steps leave them as they are and part them at blanks
        self.letters.normalizer = None
        self.letters.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.known: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {"": b""}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def ids(self, text: str, tokenizer) -> np.ndarray:
        """A tokenizer's ids of a text, without the offsets that its plain call makes too."""
        return np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def alone(self, text: str) -> bytes:
        return self.ids(text, self.tokenizer).tobytes()

    def learn(self, words: list[bytes]) -> None:
        known, parts = self.known, self.parts
        if len(known) + len(words) > self.most:
            known.clear()
        if len(parts) + len(words) > self.most:
            parts.clear()
            parts[""] = b""
        split, fresh, plain = [], {}, _PLAIN.fullmatch
        for w, text in zip(words, b"\n".join(words).decode().split("\n"), strict=True):
            if w.isalpha():  # A-Z and a-z alone
                letters, rest = text.lower(), ""
            elif m := plain(text):
                letters, rest = m[1].lower(), m[2]
            else:
                known[w] = self.alone(text)
                continue
            split.append((w, letters, rest))
            if letters not in parts:
                fresh[letters] = None
            if rest not in parts:
                parts[rest] = self.alone(rest)
        if fresh:
            ids = self.ids(" ".join(fresh), self.letters)
            data, begin = ids.tobytes(), 0
            for letters, end in zip(fresh, (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist(), strict=True):
                parts[letters] = data[begin:end]
                begin = end
        for w, letters, rest in split:
            known[w] = parts[letters] + parts[rest]

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        data = text.encode()
        if b"<|" not in data and (text.isascii() or not _COMBINING.search(text)):
            data = data.lower()  # A-Z alone: what the vocabulary's own steps make of them anyway, in fewer different words
        words, known = data.split(), self.known
        done = []
        for at in range(0, len(words), 50_000):  # a giant text may hold more new words than the table keeps
            some = words[at : at + 50_000]
            new = set(some).difference(known)
            if len(known) + len(new) > self.most:
                new = set(some)
            if new:
                self.learn(list(new))
            done.append(b"".join(map(known.__getitem__, some)))
        return b"".join(done)


def encoder(path: str) -> Encoder:
    """One for each Python worker and file."""
    if path not in _CACHES:
        _CACHES[path] = Encoder(path)
    return _CACHES[path]


def to_planes(ids: np.ndarray, planes: str = "bit") -> list[bytes]:
    """Compressed planes, lowest first; planes above the highest one in use are left out."""
    wide = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)
    pack = zstandard.ZstdCompressor(level=3).compress
    if planes == "byte":
        used = max(1, (int(ids.max(initial=0)).bit_length() + 7) // 8)
        return [pack(np.ascontiguousarray(wide[:, k]).tobytes()) for k in range(used)]
    used = max(1, int(ids.max(initial=0)).bit_length())
    return [pack(np.packbits((wide[:, k // 8] >> (k % 8)) & 1, bitorder="little").tobytes()) for k in range(used)]


def from_planes(planes: list[bytes], n: int, kind: str = "bit") -> np.ndarray:
    """The n ids that to_planes was given."""
    out, unpack = np.zeros(n, dtype=np.uint32), zstandard.ZstdDecompressor().decompress
    for k, data in enumerate(planes):
        raw = np.frombuffer(unpack(data), dtype=np.uint8)
        plane = raw if kind == "byte" else np.unpackbits(raw, count=n, bitorder="little")
        out |= plane.astype(np.uint32) << np.uint32(8 * k if kind == "byte" else k)
    return out


def write_file(uri: str, docs: Iterable[tuple[int | None, bytes]], chunk_ids: int, planes: str) -> tuple[int, int]:
    """Writes documents (id, ids as little-endian 32-bit bytes) in order. Returns how many documents and ids."""
    where, path = pafs.FileSystem.from_uri(uri)
    where.create_dir(path.rpartition("/")[0], recursive=True)
    index, names, lengths, waiting, total = [], [], [], bytearray(), 0

    def flush(out, n: int) -> None:
        parts = to_planes(np.frombuffer(bytes(waiting[: 4 * n]), dtype="<u4"), planes)
        del waiting[: 4 * n]
        index.append([n, [len(p) for p in parts]])
        for p in parts:
            out.write(p)

    with where.open_output_stream(path) as out:
        out.write(MAGIC)
        for name, data in docs:
            names.append(name)
            lengths.append(len(data) // 4)
            total += lengths[-1]
            for at in range(0, len(data), 4 * chunk_ids):
                waiting += data[at : at + 4 * chunk_ids]
                while len(waiting) >= 4 * chunk_ids:
                    flush(out, chunk_ids)
        if waiting:
            flush(out, len(waiting) // 4)
        footer = zstandard.ZstdCompressor(level=3).compress(json.dumps({"planes": planes, "chunks": index, "docs": names, "lengths": lengths}).encode())
        out.write(footer)
        out.write(len(footer).to_bytes(8, "little"))
        out.write(MAGIC)
    return len(names), total


def read_file(uri: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """Yields (id, ids) of each document of a file, holding one chunk and one document."""
    where, path = pafs.FileSystem.from_uri(uri)
    with where.open_input_file(path) as source:
        size = source.size()
        source.seek(size - 16)
        tail = source.read(16)
        if tail[8:] != MAGIC:
            raise ValueError(f"{uri} is not a bit-plane file")
        length = int.from_bytes(tail[:8], "little")
        source.seek(size - 16 - length)
        footer = json.loads(zstandard.ZstdDecompressor().decompress(source.read(length)))
        source.seek(len(MAGIC))
        have, chunks = np.zeros(0, dtype=np.uint32), iter(footer["chunks"])
        for name, n in zip(footer["docs"], footer["lengths"], strict=True):
            parts, missing = [], n
            while missing:
                if not len(have):
                    count, sizes = next(chunks)
                    have = from_planes([source.read(s) for s in sizes], count, footer["planes"])
                parts.append(have[:missing])
                have = have[len(parts[-1]) :]
                missing -= len(parts[-1])
            yield name, np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32)


def write_tokens(docs: DataFrame, tokenizer: str, *, text: str = "text", doc: str = "doc_id", end_id: int = 2, chunk_ids: int = 65_536, planes: str = "bit", path: str | None = None) -> DataFrame:
    """Encodes every text, appends end_id, writes files in ascending doc order; returns the manifest (file, n_docs,
    n_ids, part) as a stored table, part giving the order of the files.

    A null text counts as an empty one and has end_id alone. Null ids come first; rows that share an id follow each
    other, ordered by text. An empty table has an empty manifest. Other columns of docs take no part.
    """
    folder = path or new_path(docs.sparkSession, "tokens")
    ordered = docs.select(F.col(doc).cast("long").alias("doc"), whole(F.col(text)).alias("text")).repartitionByRange("doc").sortWithinPartitions("doc", "text")
    end = int(end_id).to_bytes(4, "little")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encode, part = encoder(tokenizer).encode, TaskContext.get().partitionId()
        rows = ((None if pd.isna(d) else int(d), encode(t) + end) for b in batches for d, t in zip(b["doc"], b["text"], strict=True))
        first = next(rows, None)
        if first is not None:
            uri = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.bpl"
            n, ids = write_file(uri, _chain(first, rows), chunk_ids, planes)
            yield pd.DataFrame({"part": [part], "file": [uri], "n_docs": [n], "n_ids": [ids]})

    return stored(ordered.mapInPandas(write, "part long, file string, n_docs long, n_ids long"), "manifest")


def _chain(first, rest):
    yield first
    yield from rest


def read_tokens(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files. start counts the ids of all
    documents before it; the files' own starts are summed on the driver, one number for each file."""
    files, at, spark = [], 0, manifest.sparkSession
    for r in sorted(manifest.collect(), key=lambda r: r["part"]):
        files.append((r["file"], at))
        at += r["n_ids"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for uri, start in zip(b["file"], b["start"], strict=True):
                rows = []
                for name, ids in read_file(uri):
                    rows.append((name, int(start), len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(rows) == 10_000:
                        yield _table(rows)
                        rows = []
                if rows:
                    yield _table(rows)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    named = spark.createDataFrame(files or [("", 0)], "file string, start long").where("file != ''")
    return named.repartition(max(1, len(files))).mapInPandas(read, schema)


def _table(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
    frame["doc_id"] = frame["doc_id"].astype("Int64")
    return frame
