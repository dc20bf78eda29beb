"""Licence scans with a suffix automaton of all licence templates together.

The automaton accepts every run of words of every template. A text is streamed through it once:
after each word the state gives the longest run of words that ends there and stands in some
template (the matching statistics). Runs that cannot grow any more are placed in the
templates they come from, and runs that follow each other in the same order in the text and in a
template, with small gaps, are chained into one span. A span says how much of its template it
covers. Phrases are read off the same states.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
NO_WORD = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
CHUNK_BYTES = 1 << 20

# Phrases that name a licence, with its label.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Notices of usual licences, as their authors publish them.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the terms of the MIT license."),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.",
    ),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    (
        "apache",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in "
        "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
)


@dataclass(frozen=True)
class Licences:
    """`least` words in a row make a match; gaps in a chain are of `gap` words at most, in the text and in
    the template. A span counts if it covers `share` of its template, or `many` words of it."""

    templates: tuple[tuple[str, str], ...] = TEMPLATES
    phrases: tuple[tuple[str, str], ...] = PHRASES
    least: int = 4
    gap: int = 8
    share: float = 0.8
    many: int = 25


def words(text: str) -> list[bytes]:
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower())


class Automaton:
    """The generalised suffix automaton of token sequences; states are numbers, 0 accepts nothing but ''."""

    def __init__(self, texts: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for k, tokens in enumerate(texts):
            last = 0
            for at, token in enumerate(tokens):
                last = self._extend(last, token)
                self.ends[last].add((k, at))
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            self.ends[self.link[state]] |= self.ends[state]

    def _state(self, length: int, follow: dict[int, int], link: int) -> int:
        self.next.append(follow)
        self.length.append(length)
        self.link.append(link)
        self.ends.append(set())
        return len(self.next) - 1

    def _split(self, before: int, token: int) -> int:
        """The state after `before` and the token that holds nothing longer than these."""
        there = self.next[before][token]
        if self.length[there] == self.length[before] + 1:
            return there
        copy = self._state(self.length[before] + 1, dict(self.next[there]), self.link[there])
        self.link[there] = copy
        while before >= 0 and self.next[before].get(token) == there:
            self.next[before][token] = copy
            before = self.link[before]
        return copy

    def _extend(self, last: int, token: int) -> int:
        if token in self.next[last]:
            return self._split(last, token)
        new = self._state(self.length[last] + 1, {}, 0)
        at = last
        while at >= 0 and token not in self.next[at]:
            self.next[at][token] = new
            at = self.link[at]
        if at >= 0:
            self.link[new] = self._split(at, token)
        return new

    def read(self, tokens: list[int]) -> int:
        state = 0
        for token in tokens:
            state = self.next[state][token]
        return state


@dataclass
class Chain:
    """Matches in order: words of the text from `first` to `last`, `at` the last place in the template."""

    first: int
    last: int
    at: int
    covered: int
    extended: bool = False


@dataclass
class Found:
    n_words: int = 0
    base: list[tuple[int, str]] = field(default_factory=list)
    spans: list[tuple[str, int, int, int, int, float]] = field(default_factory=list)  # label, template, first, last, covered, share


class Scanner:
    """Streams texts through the automaton of the templates and phrases."""

    def __init__(self, licences: Licences):
        self.licences = licences
        texts = [words(text) for _, text in licences.templates] + [words(text) for text, _ in licences.phrases]
        self.vocabulary = {word: i for i, word in enumerate(dict.fromkeys(w for text in texts for w in text))}
        coded = [[self.vocabulary[w] for w in text] for text in texts]
        self.automaton = Automaton(coded)
        n = len(licences.templates)
        self.sizes = [len(text) for text in coded[:n]]
        # Places in templates; phrases are told by their states instead.
        self.places = [sorted(e for e in ends if e[0] < n) for ends in self.automaton.ends]
        self.shortest = min([licences.least, *map(len, coded[n:])])
        own: dict[int, list[tuple[int, str]]] = {}
        for text, (_, label) in zip(coded[n:], licences.phrases, strict=True):
            own.setdefault(self.automaton.read(text), []).append((len(text), label))
        self.phrases: list[list[tuple[int, str]]] = [[] for _ in self.places]
        for state in sorted(range(1, len(self.places)), key=self.automaton.length.__getitem__):
            self.phrases[state] = self.phrases[self.automaton.link[state]] + own.get(state, [])

    def scan(self, text: str | None) -> Found:
        found = Found()
        matches: list[tuple[int, int, int]] = []  # last word, words, state
        state = length = 0
        data = (text or "").encode("utf-8", "surrogatepass").lower()
        at = 0
        while at < len(data):
            cut = NO_WORD.search(data, at + CHUNK_BYTES) if at + CHUNK_BYTES < len(data) else None
            end = cut.start() if cut else len(data)
            tokens = np.fromiter(map(self.vocabulary.get, WORD.findall(data, at, end), repeat(-1)), np.int32)
            state, length = self._stream(tokens, found, matches, state, length)
            at = end
        if length >= self.licences.least:
            matches.append((found.n_words - 1, length, state))
        if matches:
            self._chain(matches, found)
        return found

    def _stream(self, tokens: np.ndarray, found: Found, matches: list, state: int, length: int) -> tuple[int, int]:
        """Matching statistics of a chunk, after what the chunks before it left."""
        follow, link, longest, least = self.automaton.next, self.automaton.link, self.automaton.length, self.licences.least
        offset = found.n_words
        found.n_words += len(tokens)
        edges = np.flatnonzero(np.diff((tokens >= 0).astype(np.int8), prepend=0, append=0))
        begins, ends = edges[::2], edges[1::2]
        if length and (not len(begins) or begins[0] > 0) and len(tokens):
            if length >= least:
                matches.append((offset - 1, length, state))
            state = length = 0
        # A run shorter than all that is sought matches nothing, but at the ends of a chunk.
        wanted = (ends - begins >= self.shortest) | (begins == 0) | (ends == len(tokens))
        for a, b in zip(begins[wanted].tolist(), ends[wanted].tolist(), strict=True):
            if a:
                state = length = 0
            for at, token in enumerate(tokens[a:b].tolist(), offset + a):
                if token not in follow[state]:
                    if length >= least:
                        matches.append((at - 1, length, state))
                    while state and token not in follow[state]:
                        state = link[state]
                    length = longest[state]
                    if token not in follow[state]:  # pragma: no cover - every word of the vocabulary follows the root
                        continue
                state = follow[state][token]
                length += 1
                for size, label in self.phrases[state]:
                    if size <= length:
                        found.base.append((at - size + 1, label))
            if b < len(tokens):
                if length >= least:
                    matches.append((offset + b - 1, length, state))
                state = length = 0
        return state, length

    def _chain(self, matches: list[tuple[int, int, int]], found: Found) -> None:
        gap = self.licences.gap
        open_: dict[int, list[Chain]] = {}
        done: list[tuple[int, Chain]] = []
        for last, size, state in matches:
            for template, at in self.places[state]:
                chains = open_.setdefault(template, [])
                done += [(template, c) for c in chains if c.last + gap < last - size and not c.extended]
                chains[:] = [c for c in chains if c.last + gap >= last - size]
                best, gained = None, 0
                for chain in chains:
                    cut = max(0, chain.last - (last - size), chain.at - (at - size))
                    far = max(last - size + cut - chain.last, at - size + cut - chain.at)
                    if cut < size and far <= gap and chain.covered + size - cut > gained:
                        best, gained = chain, chain.covered + size - cut
                if best is None:
                    chains.append(Chain(last - size + 1, last, at, size))
                else:
                    best.extended = True
                    chains.append(Chain(best.first, last, at, gained))
        done += [(template, c) for template, chains in open_.items() for c in chains if not c.extended]
        spans = []
        for template, chain in done:
            share = chain.covered / self.sizes[template]
            if share >= self.licences.share or chain.covered >= self.licences.many:
                label = self.licences.templates[template][0]
                spans.append((label, template, chain.first, chain.last, chain.covered, share))
        found.spans = sorted(_apart(spans), key=lambda s: (s[2], s[0]))


def _apart(spans: list[tuple]) -> list[tuple]:
    """Of spans that overlap, those that cover the most words, then the largest share."""
    kept: list[tuple] = []
    ends: list[int] = []
    # Groups of spans that overlap one another are small: each span is as long as a template, about.
    group: list[tuple] = []

    def settle() -> None:
        taken: list[tuple] = []
        for span in sorted(group, key=lambda s: (-s[4], -s[5], s[2], s[1])):
            if all(span[3] < other[2] or span[2] > other[3] for other in taken):
                taken.append(span)
        kept.extend(taken)

    for span in sorted(spans, key=lambda s: (s[2], s[3])):
        if group and span[2] > max(ends):
            settle()
            group, ends = [], []
        group.append(span)
        ends = [max([span[3], *ends])]
    settle()
    return kept


SPAN = pa.struct(
    [("label", pa.string()), ("template", pa.int32()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("covered", pa.int64()), ("share", pa.float64())]
)
SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
        ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(SPAN)),
    ]
)
STORED = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label:string, template:int, first_word:long, last_word:long, covered:long, share:double>>"
)
ROWS = 1000


def _row(doc_id: int | None, found: Found) -> dict:
    starts = [at for at, _ in found.base]
    base = {label for _, label in found.base}
    every = base | {span[0] for span in found.spans}
    score = max([0.5 if base else 0.0, *[min(1.0, span[5]) for span in found.spans]])
    return {
        "doc_id": doc_id, "n_words": found.n_words, "n_base": len(starts), "first_word": min(starts, default=None),
        "last_word": max(starts, default=None), "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(every)), "score": score,
        "spans": [dict(zip((f.name for f in SPAN), span, strict=True)) for span in found.spans],
    }


def _scan(licences: Licences) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(licences)
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for at in range(0, len(batch), ROWS):
                part = range(at, min(at + ROWS, len(batch)))
                yield pa.RecordBatch.from_pylist([_row(ids[i].as_py(), scanner.scan(texts[i].as_py())) for i in part], SCHEMA)

    return run


def scan(documents: DataFrame, licences: Licences = Licences()) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    n_base counts the places of phrases; first_word and last_word are the smallest and the largest
    word that one starts at, from 0, or null. labels are those of phrases and of spans. score is the
    largest share of a template that a span covers, and 0.5 at least where a phrase stands.

    A null text counts as empty and holds nothing. Long texts are read in chunks, and runs of
    words go on from one to the next. Repeated rows and null ids stay as they are. Other columns are
    ignored. An empty table gives no rows. Nothing is shuffled; a task holds the automaton, which is as
    large as the templates.
    """
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(_scan(licences), STORED)
