"""Licence scan with a generalised suffix automaton of licence words.

The templates' words build one automaton. A text streams through it and yields matching statistics: at each
word, the longest run ending there that occurs in any template. Runs that can't be extended are placed in the
templates that hold them, and runs in the same order and near each other chain into spans; a span's fraction
is the part of the template it covers. Pairs of words that no template holds end every match, so only runs of
template pairs are streamed at all.

Texts are independent: nothing is shuffled, and a task holds one slice of texts. The automaton has a fixed
size, given by the templates.

Defined results: a null or empty text has 0 words, no labels and score 0; texts of any length are read whole;
repeated rows give repeated results; other columns are dropped unless kept by name; an empty table gives no
rows; among equal fractions every label counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wardline.llm.common import Texts, hashed_words, slices, words_of

#: phrases whose exact places are counted (fixed values)
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: label and text of common notices
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    (
        "apache-2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
    ),
    (
        "apache-2.0",
        "distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY "
        "KIND, either express or implied",
    ),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files, to deal in the Software without restriction",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met",
    ),
    ("gpl", "licensed under the GNU General Public License, version"),
    (
        "gpl",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation",
    ),
    ("lgpl", "GNU Lesser General Public License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc0", "dedicated to the public domain under CC0 1.0 Universal"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)
LONG = 3  # words of a match that counts, or the whole template if that is shorter
GAP = 8  # words of text between matches of one span
COVERED = 0.75  # of a template, for its label


class Automaton:
    """Suffix automaton of several word sequences, with the places of every state."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[set[tuple[int, int]]] = [set()]
        for t, sequence in enumerate(sequences):
            last = 0
            for i, c in enumerate(sequence):
                last = self._extend(last, c, ends)
                ends[last].add((t, i))
        for v in sorted(range(1, len(self.link)), key=lambda v: -self.length[v]):
            ends[self.link[v]] |= ends[v]
        self.ends = [sorted(e) for e in ends]
        self.ends[0] = []

    def _state(self, length: int, ends: list, like: int | None = None) -> int:
        self.next.append({} if like is None else dict(self.next[like]))
        self.link.append(-1 if like is None else self.link[like])
        self.length.append(length)
        ends.append(set())
        return len(self.link) - 1

    def _split(self, p: int, q: int, c: int, ends: list) -> int:
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, ends, q)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int, ends: list) -> int:
        if c in self.next[last]:
            return self._split(last, self.next[last][c], c, ends)
        new, p = self._state(self.length[last] + 1, ends), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        self.link[new] = 0 if p < 0 else self._split(p, self.next[p][c], c, ends)
        return new

    def statistics(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """State and length of the longest match that ends at each word."""
        v = n = 0
        for c in words:
            while v and c not in self.next[v]:
                v = self.link[v]
                n = self.length[v]
            if c in self.next[v]:
                v, n = self.next[v][c], n + 1
            yield v, n


class Span(NamedTuple):
    label: str
    first: int
    last: int
    fraction: float


class Scanner:
    def __init__(self, templates=TEMPLATES, phrases=PHRASES):
        self.labels = [*phrases.values(), *(label for label, _ in templates)]
        texts = [words_of(t) for t in [*phrases, *(t for _, t in templates)]]
        self.n_phrases = len(phrases)
        self.ids = {w: i for i, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
        sequences = [[self.ids[w] for w in t] for t in texts]
        self.sizes = [len(s) for s in sequences]
        self.automaton = Automaton(sequences)
        vocabulary = " ".join(self.ids).encode()
        found = hashed_words(Texts(0, 1, np.frombuffer(vocabulary, np.uint8), np.array([0, len(vocabulary)]))).hash
        self.order = np.argsort(found)
        self.hashes = found[self.order]
        self.pairs = np.zeros((len(self.ids),) * 2, bool)
        for s in sequences:
            self.pairs[s[:-1], s[1:]] = True
        # the phrases that end in a state, by its suffixes
        ends = {self._walk(s): t for t, s in enumerate(sequences[: self.n_phrases])}
        self.phrases: list[list[int]] = []
        for v in range(len(self.automaton.link)):
            held, u = [], v
            while u > 0:
                held += [ends[u]] if u in ends else []
                u = self.automaton.link[u]
            self.phrases.append(held)

    def _walk(self, words: list[int]) -> int:
        v = 0
        for c in words:
            v = self.automaton.next[v][c]
        return v

    def runs(self, t: Texts) -> tuple[np.ndarray, list[tuple[int, int, list[int]]]]:
        """Words of each row, and (row, first word, word ids) of each run of template pairs."""
        w = hashed_words(t)
        n = len(w.hash)
        counts = np.diff(w.first)
        if n < 2:
            return counts, []
        at = np.minimum(np.searchsorted(self.hashes, w.hash), len(self.hashes) - 1)
        known = self.hashes[at] == w.hash
        ids = np.where(known, self.order[at], 0)
        linked = known[:-1] & known[1:] & self.pairs[ids[:-1], ids[1:]]
        edges = w.first[1:-1]
        linked[edges[(edges > 0) & (edges < n)] - 1] = False
        step = np.diff(linked.astype(np.int8), prepend=0, append=0)
        begins, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        rows = np.searchsorted(w.first, begins, side="right") - 1
        out = []
        for a, b, r in zip(begins.tolist(), ends.tolist(), rows.tolist()):
            text = t.data[w.start[a] : w.end[b]].tobytes().decode()
            found = [self.ids.get(x, -1) for x in words_of(text)]  # equal hashes are checked here
            out.append((r, a - int(w.first[r]), found))
        return counts, out

    def scan(self, runs: list[tuple[int, list[int]]]) -> tuple[list[tuple[int, int]], list[Span]]:
        """Places (word, phrase) of the phrases and spans of the templates in one text."""
        places, matches = [], []
        for begin, words in runs:
            stats = list(self.automaton.statistics(words))
            for i, (v, n) in enumerate(stats):
                for p in self.phrases[v]:
                    if n >= self.sizes[p]:
                        places.append((begin + i - self.sizes[p] + 1, p))
                if i + 1 < len(stats) and stats[i + 1][1] == n + 1:
                    continue  # extended by the next word
                for t, e in self.automaton.ends[v]:
                    if n >= min(LONG, self.sizes[t]):
                        matches.append((begin + i - n + 1, begin + i, t, e - n + 1, e))
        return places, self._chain(matches)

    def _chain(self, matches: list[tuple[int, int, int, int, int]]) -> list[Span]:
        """Matches of a template that follow each other in text and template, within ``GAP`` words."""
        spans: list[Span] = []
        open_: dict[int, list[int]] = {}  # template: first and last word in the text, last in the template, covered

        def close(t: int) -> None:
            first, last, _, covered = open_.pop(t)
            spans.append(Span(self.labels[t], first, last, covered / self.sizes[t]))

        for a, b, t, c, d in sorted(matches):
            if t in open_:
                now = open_[t]
                if a - now[1] <= GAP and d > now[2] and b > now[1]:
                    now[3] += d - max(now[2], c - 1)
                    now[1], now[2] = b, d
                    continue
                if b <= now[1] and d <= now[2]:
                    continue
                close(t)
            open_[t] = [a, b, d, d - c + 1]
        for t in list(open_):
            close(t)
        return spans


FIELDS = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label: string, first: long, last: long, fraction: double>>"
)
_SPAN = pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("fraction", pa.float64())])
_TYPES = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(_SPAN)]
_NAMES = "n_words n_base first_word last_word base_labels labels score spans".split()


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, counts, places and labels of each document, and the spans of templates in it."""
    scanner = Scanner()
    rows = docs.select(*keep, "text")

    def result(n: int, runs: list[tuple[int, list[int]]]) -> tuple:
        places, spans = scanner.scan(runs) if runs else ([], [])
        base = {scanner.labels[p] for _, p in places}
        more = {s.label for s in spans if s.fraction >= COVERED}
        starts = [i for i, _ in places]
        score = max([s.fraction for s in spans] + [1.0] * bool(places), default=0.0)
        first, last = (min(starts), max(starts)) if starts else (None, None)
        named = [s._asdict() for s in spans if s.fraction >= COVERED]
        return n, len(starts), first, last, ",".join(sorted(base)), ",".join(sorted(base | more)), score, named

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in slices(batch.column(len(keep))):
                counts, runs = scanner.runs(t)
                by_row: dict[int, list] = {}
                for r, begin, words in runs:
                    by_row.setdefault(r, []).append((begin, words))
                results = [result(int(n), by_row.get(i, [])) for i, n in enumerate(counts)]
                columns = [pa.array(c, kind) for c, kind in zip(zip(*results), _TYPES)]
                kept = [batch.column(i).slice(t.lo, t.hi - t.lo) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, *columns], [*keep, *_NAMES])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
    return rows.mapInArrow(run, f"{kept}, {FIELDS}")
