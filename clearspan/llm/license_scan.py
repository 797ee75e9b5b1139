"""License scans: templates with optional and replaceable regions, compiled into automata over words.

Markup: plain words are mandatory; [[...]] is optional; {{name:a-b}} stands for a to b words of any kind. A template is
compiled into a word automaton (states, word edges, free edges, empty edges) once on the driver, and each text is
scanned in one pass: wherever a template's first mandatory word stands, the automaton runs over the words that follow,
and accepts only if all mandatory wording matches exactly. Documents are independent, so there is no shuffle and
a task's memory is one batch of texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import whole

#: Phrases and labels of the base scan. Fixed values.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Templates and labels of the automata: short forms, and the whole wording of three licences (those that end in -text). Fixed values; the first word of each is mandatory.
TEMPLATES = {
    "apache-2.0": "apache license [[version]] 2 [[0]]",
    "bsd-2-clause-text": """redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        [[1.]] redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        [[2.]] redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
        [[3. neither the name of {{holder:1-10}} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.]]
        this software is provided by {{provider:1-8}} as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed.
        in no event shall {{owner:1-8}} be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption)
        however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage.""",
    "isc-text": """permission to use, copy, modify, and[[/or]] distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
        the software is provided as is and {{author:1-6}} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. in no event shall {{holder:1-6}} be liable for any special, direct, indirect, or consequential damages
        or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software.""",
    "mit-text": """permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files [[(the software)]], to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
        copies of the software, and to permit persons to whom the software is furnished to do so, subject to the following conditions: the above copyright notice and this permission notice [[(including the next paragraph)]] shall be included in all copies or substantial portions of the software.
        the software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. in no event shall {{holder:1-6}} be liable for any claim, damages or other liability,
        whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.""",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by-4.0": "cc by 4 0",
    "cc-by-nc-4.0": "cc by nc 4 0",
    "cc-by-sa-4.0": "cc by sa 4 0",
    "copyright-notice": "copyright [[c]] {{years:1-3}} {{holder:0-6}} all rights reserved",
    "gpl-2.0": "gnu general public license [[as published by the free software foundation]] [[either]] version 2",
    "gpl-3.0": "gnu general public license [[as published by the free software foundation]] [[either]] version 3",
    "mit": "under the [[terms of the]] mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this {{work:1-3}} and associated documentation files",
    "public-domain": "dedicated to the public domain",
}

#: Bytes of a word as they are, A-Z in lower case, all else to a space: words are then the pieces between spaces.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass
class Automaton:
    """States from 0; words[s] maps a word to states, free[s] has states reached by any word, empty[s] by none."""

    label: str
    words: list[dict[bytes, list[int]]] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)
    empty: list[list[int]] = field(default_factory=list)
    final: int = 0

    def state(self) -> int:
        self.words.append({})
        self.free.append([])
        self.empty.append([])
        return len(self.words) - 1

    def closure(self, states: set[int]) -> set[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return seen

    def match(self, words: list[bytes], at: int) -> int:
        """The largest end of a match that starts at a word, or -1."""
        now, end, i = self.closure({0}), -1, at
        while now:
            if self.final in now:
                end = i
            if i == len(words):
                break
            word = words[i]
            now = self.closure({t for s in now for t in (*self.words[s].get(word, ()), *self.free[s])})
            i += 1
        return end


def compile_template(label: str, markup: str) -> Automaton:
    """The automaton of a template. The first region must be mandatory words; optional regions may nest."""
    made, opened = Automaton(label), []
    here = made.state()
    parts = re.findall(r"\[\[|\]\]|\{\{[^}]*\}\}|[^\s\[\]{}]+", markup)
    if not parts or parts[0].startswith(("[[", "{{", "]]")):
        raise ValueError(f"template {label} must begin with a mandatory word")
    for part in parts:
        if part == "[[":
            opened.append(here)
        elif part == "]]":
            made.empty[opened.pop()].append(here)
        elif part.startswith("{{"):
            low, high = map(int, part[2:-2].rpartition(":")[2].split("-"))
            begin = [here]
            for _ in range(high):
                there = made.state()
                made.free[here].append(there)
                here = there
                begin.append(here)
            end = made.state()
            for s in begin[low:]:
                made.empty[s].append(end)
            here = end
        else:
            for word in part.encode().translate(_WORD_BYTES).split():
                there = made.state()
                made.words[here].setdefault(word, []).append(there)
                here = there
    if opened:
        raise ValueError(f"template {label} has an optional region without an end")
    made.final = here
    return made


def scan_words(words: list[bytes], automata: dict[bytes, list[Automaton]], phrases: dict[bytes, list[tuple[list[bytes], str]]]) -> tuple:
    """(n_base, first, last, base labels, all labels, score, spans) of a text's words; spans are (label, start, end)."""
    n, first, last, base, spans = 0, None, None, set(), []
    for i, w in enumerate(words):
        for phrase, label in phrases.get(w, ()):
            if words[i : i + len(phrase)] == phrase:
                n, first, last = n + 1, i if first is None else first, i
                base.add(label)
                spans.append((label, i, i + len(phrase)))
        for a in automata.get(w, ()):
            if (end := a.match(words, i)) >= 0:
                spans.append((a.label, i, end))
    covered, reached = 0, 0
    for _, start, end in sorted(spans, key=lambda s: s[1:]):
        covered += max(0, end - max(start, reached))
        reached = max(reached, end)
    return n, first, last, base, base | {s[0] for s in spans}, covered / len(words) if words else 0.0, spans


def scan_licenses(docs: DataFrame, *, text: str = "text", doc: str = "doc_id", templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """One row a document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the share of words
    inside a match), spans (label, start, end; in words from 0, end not included).

    A null or empty text has no words: zeros, null places, empty labels, score 0. Repeated rows and null ids give a
    row each; an empty table an empty one. Other columns of docs take no part, whatever their names.
    """
    automata: dict[bytes, list[Automaton]] = {}
    for label, markup in (TEMPLATES if templates is None else templates).items():
        made = compile_template(label, markup)
        for word in made.words[0]:
            automata.setdefault(word, []).append(made)
    base: dict[bytes, list[tuple[list[bytes], str]]] = {}
    for phrase, label in (PHRASES if phrases is None else phrases).items():
        words = phrase.encode().split()
        base.setdefault(words[0], []).append((words, label))
    anchors = frozenset(automata) | frozenset(base)
    kinds = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))])
    none = (0, None, None, (), (), 0.0, [])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for body in batch.column(1).cast(pa.binary()).to_pylist():
                words = body.translate(_WORD_BYTES).split()
                n, first, last, labels, every, score, spans = none if anchors.isdisjoint(words) else scan_words(words, automata, base)
                rows.append((len(words), n, first, last, ",".join(sorted(labels)), ",".join(sorted(every)), score, [{"label": a, "start": b, "end": c} for a, b, c in spans]))
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in range(8)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, type=kinds.field(k + 1).type) for k, c in enumerate(columns))], schema=kinds)

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,end:long>>"
    return docs.select(F.col(doc).cast("long"), whole(F.col(text))).mapInArrow(scan, schema)
