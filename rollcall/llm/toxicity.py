"""Toxicity from a learnt lexicon, matched with Levenshtein automata over its trie.

The lexicon holds words and word beginnings that mark toxic documents. All its terms form one
trie; a state of the automaton is the set of trie nodes that a word can have reached with their
edit counts. States are made as words need them and then remembered, so a known beginning
costs one lookup a letter. Each match counts by its term, its edits and its context window: a
match in quotation marks counts less, as far as the labels bear that out.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import CACHED_WORDS, WordHashes, mix64, window_hashes
from rollcall.plans.scratch import materialize

WORD = re.compile(r"[^\W_]+")
# Marks that open a quotation, and the ones that close it.
OPENING = "\"“„«‹"
CLOSING = "\"”“»›"
CACHED_STATES = 200_000


@dataclass(frozen=True)
class Settings:
    """`sample` bounds the labelled rows of each label that are learnt from. A term needs `support` independent toxic documents and `odds` times the share among them.
    Terms of `one_edit` letters may be misspelt by one edit, of `two_edits` by two. Quotation
    marks are looked for in `window` characters on both sides."""

    sample: int = 6000
    support: int = 6
    odds: float = 8.0
    beginning: tuple[int, int] = (4, 8)
    one_edit: int = 6
    two_edits: int = 10
    window: int = 80


@dataclass
class Automaton:
    """Levenshtein automata of all terms at once, determinised as words come.

    `terms` are (text, whole): a whole term must match the whole word, another its beginning.
    """

    terms: list[tuple[str, bool]]
    edits: list[int]
    children: list[dict[str, int]] = field(default_factory=lambda: [{}])
    ends: list[list[int]] = field(default_factory=lambda: [[]])
    room: list[int] = field(default_factory=lambda: [0])

    def __post_init__(self) -> None:
        for number, (text, _) in enumerate(self.terms):
            node = 0
            self.room[0] = max(self.room[0], self.edits[number])
            for letter in text:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.room.append(0)
                node = self.children[node][letter]
                self.room[node] = max(self.room[node], self.edits[number])
            self.ends[node].append(number)
        self._reset()

    def _reset(self) -> None:
        self.numbers: dict[frozenset[tuple[int, int]], int] = {}
        self.states: list[dict[int, int]] = []
        self.steps: list[dict[str, int]] = []
        self.found: list[tuple[list[tuple[int, int]], list[tuple[int, int]]]] = []
        self.first = self._number(self._closed({0: 0}))

    def _closed(self, state: dict[int, int]) -> dict[int, int]:
        """Adds what is reached by leaving out letters of a term."""
        waiting = list(state.items())
        while waiting:
            node, edits = waiting.pop()
            for child in self.children[node].values():
                if edits < self.room[child] and state.get(child, 99) > edits + 1:
                    state[child] = edits + 1
                    waiting.append((child, edits + 1))
        return state

    def _number(self, state: dict[int, int]) -> int:
        key = frozenset(state.items())
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(state)
            self.steps.append({})
            hits = [(t, e) for node, e in state.items() for t in self.ends[node] if e <= self.edits[t]]
            self.found.append(([h for h in hits if not self.terms[h[0]][1]], [h for h in hits if self.terms[h[0]][1]]))
        return self.numbers[key]

    def _step(self, number: int, letter: str) -> int:
        after: dict[int, int] = {}

        def reach(node: int, edits: int) -> None:
            if edits <= self.room[node] and after.get(node, 99) > edits:
                after[node] = edits

        for node, edits in self.states[number].items():
            reach(node, edits + 1)  # a letter too many
            for own, child in self.children[node].items():
                reach(child, edits + (own != letter))
        return self._number(self._closed(after))

    def match(self, word: str) -> tuple[tuple[int, int], ...]:
        """(term, fewest edits) of every term that the word matches."""
        if len(self.states) > CACHED_STATES:
            self._reset()
        best: dict[int, int] = {}
        state = self.first
        for letter in word:
            following = self.steps[state].get(letter)
            if following is None:
                following = self.steps[state][letter] = self._step(state, letter)
            state = following
            if not self.states[state]:
                return tuple(best.items())
            for term, edits in self.found[state][0]:
                best[term] = min(edits, best.get(term, 99))
        for term, edits in self.found[state][1]:
            best[term] = min(edits, best.get(term, 99))
        return tuple(best.items())


def quoted(text: str, start: int, end: int, window: int, before: int | None = None) -> bool:
    """Whether a quotation opens before the span and closes after it, within the window.

    `before` is the number of straight quotation marks before the span, if it is known.
    """
    left = text[max(0, start - window) : start]
    right = text[end : end + window]
    opened = max(left.rfind(mark) for mark in OPENING)
    if opened < 0:
        return False
    if left[opened] == '"' and (text.count('"', 0, start) if before is None else before) % 2 == 0:
        return False
    return not any(mark in left[opened + 1 :] for mark in CLOSING) and any(mark in right for mark in CLOSING)


class Matcher:
    def __init__(self, automaton: Automaton, window: int):
        self.automaton, self.window = automaton, window
        self.known: dict[str, tuple[int, int] | None] = {}

    def best(self, word: str) -> tuple[int, int] | None:
        """The closest term of a word: fewest edits, then a whole one, then the longest."""
        terms = self.automaton.terms
        return min(
            self.automaton.match(word),
            key=lambda hit: (hit[1], not terms[hit[0]][1], -len(terms[hit[0]][0]), hit[0]),
            default=None,
        )

    def evidence(self, text: str | None) -> tuple[list[tuple[int, int, bool]], float]:
        """(term, edits, quoted) of each distinct word that matches, quoted if it always is, and
        the matches outside quotations per 1000 words."""
        lowered = (text or "").lower()
        known = self.known
        if len(known) > CACHED_WORDS:
            known.clear()
        words = WORD.findall(lowered)
        hit = set()
        for word in set(words):
            if word not in known:
                known[word] = self.best(word)
            if known[word]:
                hit.add(word)
        if not hit:
            return [], 0.0
        found: dict[str, bool] = {}
        outside = marks = counted = 0
        for m in WORD.finditer(lowered):
            if m[0] in hit:
                marks += lowered.count('"', counted, m.start())
                counted = m.start()
                inside = quoted(lowered, m.start(), m.end(), self.window, marks)
                found[m[0]] = found.get(m[0], True) and inside
                outside += not inside
        return [(*known[word], inside) for word, inside in sorted(found.items())], 1000 * outside / len(words)


@dataclass(frozen=True)
class Model:
    automaton: Automaton
    weights: dict[tuple[int, int], float]  # per term and number of edits
    usual: tuple[float, ...]  # where that was never seen, by edits
    quotation: float
    line: tuple[float, ...]

    def features(self, evidence: list[tuple[int, int, bool]], rate: float) -> tuple[float, float, float]:
        values = [
            self.weights.get((t, e), self.usual[e]) * (self.quotation if inside else 1.0) for t, e, inside in evidence
        ]
        positive = [v for v in values if v > 0]
        if not positive:
            return 0.0, 0.0, 0.0
        return max(positive), float(np.log1p(sum(positive))), float(np.log1p(rate))

    def score(self, evidence: list[tuple[int, int, bool]], rate: float) -> float:
        sum_ = self.line[0] + float(np.dot(self.line[1:], self.features(evidence, rate)))
        return float(1 / (1 + np.exp(-sum_)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(documents: DataFrame, labels: DataFrame, s: Settings) -> DataFrame:
    """(text, toxic) of at most `s.sample` labelled rows of each label, chosen by a hash of id."""
    usable = labels.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(
        F.col("doc_id").alias("_id"), "toxic", F.xxhash64(F.lit("toxic"), "doc_id").alias("_at")
    )
    chosen = [usable.where(F.col("toxic") == t).orderBy("_at", "_id").limit(s.sample) for t in (0, 1)]
    few = materialize(chosen[0].union(chosen[1]), "labelled")
    texts = documents.select("doc_id", "text").join(F.broadcast(few), F.col("doc_id") == F.col("_id"))
    return materialize(texts.where("text is not null").select("text", "toxic"), "labelled-texts")


def _terms(s: Settings) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Words and beginnings of each text, with a mark that near copies of a text share."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = WordHashes()
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                words = set(WORD.findall(text.lower()))
                low, high = s.beginning
                starts = {w[:n] for w in words for n in range(low, min(high, len(w)) + 1)}
                hashes, _ = cache.of([text.encode("utf-8", "surrogatepass")])
                shingles = window_hashes(hashes, min(5, max(1, len(hashes))))
                mark = int(mix64(shingles).min() >> np.uint64(1)) if len(shingles) else 0
                terms = [(w, True) for w in words] + [(p, False) for p in starts]
                yield pd.DataFrame(terms, columns=["term", "whole"]).assign(toxic=toxic, mark=mark)

    return run


def lexicon(rows: DataFrame, s: Settings) -> list[tuple[str, bool]]:
    """Terms that mark toxic texts, every one that passes. Near copies of one text count once. A
    beginning is taken where no shorter one passes; whole words are taken beside them. What is
    collected is bounded by the sample: it has no more terms than `sample` texts hold `support` times."""
    counts = rows.groupBy("toxic").agg(F.count("*")).collect()
    total = {r[0]: r[1] for r in counts}
    if len(total) < 2:
        return []
    seen = rows.mapInPandas(_terms(s), "term string, whole boolean, toxic int, mark long").distinct()
    toxic = F.sum("toxic")
    other = F.sum(1 - F.col("toxic"))
    ratio = (toxic + 0.5) / (total[1] + 1) / ((other + 0.5) / (total[0] + 1))
    good = (
        seen.groupBy("term", "whole")
        .agg(toxic.alias("toxic"), ratio.alias("ratio"))
        .where((F.col("toxic") >= s.support) & (F.col("ratio") >= s.odds))
        .collect()
    )
    starts = {r["term"] for r in good if not r["whole"]}
    shortest = [t for t in starts if not any(t[:n] in starts for n in range(s.beginning[0], len(t)))]
    return sorted([(t, False) for t in shortest] + [(r["term"], True) for r in good if r["whole"]])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Intercept and coefficients by Newton steps, the coefficients held towards 0."""
    design = np.column_stack([np.ones(len(x)), x])
    line = np.zeros(design.shape[1])
    keep = np.diag([1e-3] + [ridge] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ line, -30, 30)))
        gradient = design.T @ (weight * (p - y)) + keep @ line
        curve = design.T @ (design * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]) + keep
        move = np.linalg.solve(curve, gradient)
        line -= np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-8:
            break
    return line


def fit(documents: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    rows = training_rows(documents, labels, s)
    terms = lexicon(rows, s)
    edits = [(len(t) >= s.one_edit - whole) + (whole and len(t) >= s.two_edits) for t, whole in terms]
    automaton = Automaton(terms, edits)

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(automaton, s.window)
        for batch in batches:
            found = [matcher.evidence(t) for t in batch["text"]]
            numbers = [[v for t, e, q in f for v in (t, e, int(q))] for f, _ in found]
            yield pd.DataFrame({"toxic": batch["toxic"], "found": numbers, "rate": [r for _, r in found]})

    told = rows.mapInPandas(gather, "toxic int, found array<int>, rate double").collect()
    y = np.array([r["toxic"] for r in told], float)
    evidence = [[(f[i], f[i + 1], bool(f[i + 2])) for i in range(0, len(f), 3)] for f in (r["found"] for r in told)]
    n = [max(1, int((y == label).sum())) for label in (0, 1)]
    hits: dict[tuple[int, int], Counter] = defaultdict(Counter)
    marks: Counter = Counter()
    for toxic, found in zip(y, evidence, strict=True):
        for term, edit, inside in found:
            hits[term, edit][int(toxic)] += 1
            marks[inside, int(toxic)] += 1

    def odds(c: Counter, prior: float) -> float:
        return float(np.log((c[1] + prior) / (n[1] + 1) * (n[0] + 1) / (c[0] + prior)))

    weights = {key: odds(c, 0.5) for key, c in hits.items()}
    pooled = [sum((c for (_, e), c in hits.items() if e == edit), Counter()) for edit in range(3)]
    usual = tuple(max(0.0, odds(c, 2.0) / 2) for c in pooled)
    # How often a match in quotation marks is toxic after all, held towards a quarter.
    quotation = (marks[True, 1] + 1) / (marks[True, 1] + marks[True, 0] + 4)
    model = Model(automaton, weights, usual, float(quotation), (-5.0, 0.0, 0.0, 0.0))
    if len(set(y)) < 2:
        return model
    x = np.array([model.features(f, r["rate"]) for f, r in zip(evidence, told, strict=True)])
    line = logistic(x, y, np.ones(len(y)))
    return Model(automaton, weights, usual, float(quotation), tuple(map(float, line)))


def scored(text: Column, model: Model, s: Settings) -> Column:
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(model.automaton, s.window)
        for series in texts:
            yield pd.Series([model.score(*matcher.evidence(t)) for t in series], dtype=float)

    run.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "double")(text)


def detect(documents: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score and predicted per input row.

    Learns from labelled rows that are not held out; scores use the whole text alone. A null or
    empty text has no match and gets the score of such texts, as does every text if one of
    the labels is missing. Rows that repeat a text score alike; a null doc_id is not held
    out. Other columns are ignored. An empty table gives no rows.
    """
    model = fit(documents, labels, s)
    told = documents.select(F.col("doc_id").cast("long").alias("doc_id"), scored(F.col("text"), model, s).alias("score"))
    return told.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )
