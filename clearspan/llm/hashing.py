"""Hashes of words, made for many words at once with numpy."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C55 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_POWERS: dict[str, np.ndarray] = {}
#: Bytes hashed at once: bounds the memory of a call, however long a text is.
PIECE = 2_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers under which every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def mix32(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit numbers, made in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, PIECE + 1)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            _POWERS[name] = np.multiply.accumulate(table)
    return _POWERS["up"], _POWERS["down"]


def _piece(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word of bytes that begin and end between words."""
    blank = np.ones(len(raw) + 2, dtype=bool)
    blank[1:-1] = _BLANK[raw]
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts, ends


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """The 64-bit hashes of each text's words (runs of anything but ASCII white space), in order."""
    return [h for h, _, _ in word_places(texts)]


def word_places(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """As word_hashes, with the byte places where each word starts and ends (not included)."""
    out, group, size = [], [], 0
    for t in texts:
        if size and size + len(t) > PIECE:
            out += _together(group)
            group, size = [], 0
        if len(t) > PIECE:
            out += _together(group)
            group, size = [], 0
            out.append(_long(t))
        else:
            group.append(t)
            size += len(t) + 1
    return out + _together(group)


def _together(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    if not texts:
        return []
    hashes, starts, ends = _piece(np.frombuffer(b"\n".join(texts), dtype=np.uint8))
    at = np.cumsum([0] + [len(t) + 1 for t in texts])
    cuts = np.searchsorted(starts, at)
    return [(hashes[a:b], starts[a:b] - o, ends[a:b] - o) for a, b, o in zip(cuts[:-1].tolist(), cuts[1:].tolist(), at.tolist(), strict=False)]


def _long(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw, parts, at = np.frombuffer(text, dtype=np.uint8), [], 0
    while at < len(raw):
        end = min(at + PIECE, len(raw))
        if end < len(raw):
            gaps = np.flatnonzero(_BLANK[raw[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:  # one word of more than a piece
                more = np.flatnonzero(_BLANK[raw[end:]])
                end = end + int(more[0]) if len(more) else len(raw)
        h, s, e = _piece(raw[at:end])
        parts.append((h, s + at, e + at))
        at = end
    none = np.zeros(0, dtype=np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (none.astype(np.uint64), none, none)
