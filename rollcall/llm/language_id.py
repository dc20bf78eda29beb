"""Language identification with error-correcting output codes.

Each language has a codeword of +1 and -1. One binary classifier per bit, linear in hashed
byte n-gram frequencies, predicts that bit from a text; the nearest codeword under a
weighted loss of all margins is the language. Close seconds are flagged as ambiguous.
"""

from __future__ import annotations

import itertools
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import letters
from rollcall.plans.scratch import materialize

UNDETERMINED = "und"
# Bytes that are no part of a letter become blanks.
PLAIN = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
CHUNK = 256


@dataclass(frozen=True)
class Settings:
    """`sample` bounds the rows that the classifiers learn from, `features` the hashed
    n-grams of 1 to `longest` bytes, and `ambiguous` the relative lead over the second."""

    sample: int = 2000
    features: int = 1 << 12
    longest: int = 3
    ridge: float = 0.01
    sharpness: float = 2.0
    ambiguous: float = 0.1


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    codes: np.ndarray  # language x bit
    weights: np.ndarray  # feature x bit
    offset: np.ndarray
    trust: np.ndarray  # per bit


def codewords(count: int) -> np.ndarray:
    """All splits of up to 7 languages, for more the best of seeded random codes.

    Every two rows differ in at least half of the bits for all splits.
    """
    if count < 2:
        return np.ones((count, 1))
    if count <= 7:
        columns = [c for c in itertools.product((1, -1), repeat=count) if c[0] == 1 and -1 in c]
        return np.array(columns, float).T
    bits = 15 * int(np.ceil(np.log2(count)))
    rng = np.random.default_rng(count)
    drawn = [np.where(rng.random((count, bits)) < 0.5, 1.0, -1.0) for _ in range(50)]

    def nearest(code: np.ndarray) -> float:
        products = code @ code.T
        np.fill_diagonal(products, -np.inf)
        return -float(products.max())

    return max(drawn, key=nearest)


def frequencies(texts: list[str], s: Settings) -> np.ndarray:
    """Square roots of the shares of hashed byte n-grams, one row per text."""
    rows = np.zeros((len(texts), s.features), np.float32)
    mask = np.uint32(s.features - 1)
    for i, text in enumerate(texts):
        plain = text.lower().encode("utf-8", "surrogatepass").translate(PLAIN)
        data = np.frombuffer(b" " + b" ".join(plain.split()) + b" ", np.uint8).astype(np.uint32)
        gram, counts = np.zeros(len(data), np.uint32), np.zeros(s.features, np.int64)
        for n in range(1, min(s.longest, len(data)) + 1):
            gram = gram[: len(data) - n + 1] * np.uint32(257) + data[n - 1 :] + np.uint32(1)
            mixed = (gram * np.uint32(2654435761)) ^ (gram >> np.uint32(7))
            counts += np.bincount((mixed ^ (mixed >> np.uint32(15))) & mask, minlength=s.features)
        rows[i] = np.sqrt(counts / max(1, counts.sum()))
    return rows


def _featurise(s: Settings) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), CHUNK):
                part = batch.iloc[at : at + CHUNK]
                rows = frequencies(part["text"].tolist(), s)
                yield pd.DataFrame({"lang": part["lang"], "at": part["at"], "row": [r.tobytes() for r in rows]})

    return run


def fit(labelled: DataFrame, s: Settings = Settings()) -> Model:
    """Learn from rows (doc_id, text, lang), at most `s.sample` of them.

    Every language gets the same expected number of rows, chosen by a hash of doc_id. Rows
    without a language or a letter teach nothing.
    """
    usable = labelled.where(F.col("lang").isNotNull() & letters(F.col("text"))).select("doc_id", "text", "lang")
    # Stored, so that Spark knows its size before it plans the join with the texts.
    counts = materialize(usable.groupBy("lang").agg(F.count("*").alias("_n")), "language-counts")
    languages = max(1, counts.count())
    at = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.lit(max(1, s.sample // languages)) / F.col("_n")
    counts = counts.withColumnRenamed("lang", "_lang")
    joined = usable.join(counts, F.col("lang") == F.col("_lang"))
    chosen = joined.select("text", "lang", (at / share).alias("at")).where("at < 1")
    bounded = chosen.mapInPandas(_featurise(s), "lang string, at double, row binary")
    # The classifiers are solved for in a task, as the sample's features would fill the driver.
    solved = bounded.orderBy("at", "lang", "row").limit(s.sample).mapInPandas(_solve(s), "model binary").first()
    return Model(*pickle.loads(solved["model"])) if solved else solve([], np.empty((0, s.features), np.float32), s)


def _solve(s: Settings) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        langs, parts = [], [np.empty((0, s.features), np.float32)]
        for batch in batches:
            langs += batch["lang"].tolist()
            parts.append(np.frombuffer(b"".join(batch["row"]), np.float32).reshape(-1, s.features))
        model = solve(langs, np.concatenate(parts), s)
        yield pd.DataFrame({"model": [pickle.dumps((model.languages, model.codes, model.weights, model.offset, model.trust))]})

    return run


def solve(langs: list[str], x: np.ndarray, s: Settings) -> Model:
    """One regularised least-squares classifier per bit, balanced over languages."""
    names = sorted(set(langs))
    codes = codewords(len(names))
    if not names:
        return Model((), codes, np.zeros((s.features, 1), np.float32), np.zeros(1), np.ones(1))
    label = np.array([names.index(lang) for lang in langs])
    y = codes[label]
    weight = (len(label) / len(names) / np.bincount(label, minlength=len(names)))[label]
    offset = (weight[:, None] * x).sum(0) / weight.sum()
    middle = (weight[:, None] * y).sum(0) / weight.sum()
    x = x - offset.astype(np.float32)
    gram = (x @ x.T).astype(np.float64) + s.ridge * np.diag(1 / weight)
    inverse = np.linalg.inv(gram)
    alpha = inverse @ (y - middle)
    weights = x.T @ alpha.astype(np.float32)
    left_out = y - alpha / np.diag(inverse)[:, None]  # margins by models without the row
    trust = np.maximum(((left_out * y > 0) * weight[:, None]).sum(0) / weight.sum() - 0.5, 1e-3)
    return Model(
        tuple(names), codes, weights.astype(np.float32), middle - offset @ weights, trust / trust.sum()
    )


def decode(margins: np.ndarray, model: Model, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the language with the least weighted squared hinge loss, its share among all
    languages (0 to 1), and whether the second is close."""
    loss = np.maximum(0, 1 - margins[:, None, :] * model.codes[None]) ** 2 @ model.trust
    best = loss.argmin(axis=1)
    share = np.exp(-s.sharpness * (loss - loss.min(axis=1, keepdims=True)))
    score = 1 / share.sum(axis=1)
    if loss.shape[1] < 2:
        return best, score, np.zeros(len(loss), bool)
    first, second = np.partition(loss, 1, axis=1)[:, :2].T
    return best, score, second - first < s.ambiguous * (second + first)


def predicted(text: Column, model: Model, s: Settings = Settings()) -> Column:
    """struct(lang_pred, score, ambiguous) of a text; `und` with 0 where it has no letter."""

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in texts:
            found = []
            for at in range(0, len(series), CHUNK):
                part = series.iloc[at : at + CHUNK].tolist()
                frame = pd.DataFrame({"lang_pred": UNDETERMINED, "score": np.zeros(len(part)), "ambiguous": True})
                known = np.flatnonzero([t is not None for t in part])
                if len(known) and model.languages:
                    x = frequencies([part[i] for i in known], s)
                    best, score, close = decode(x @ model.weights + model.offset, model, s)
                    frame.loc[known, "lang_pred"] = [model.languages[i] for i in best]
                    frame.loc[known, "score"] = score
                    frame.loc[known, "ambiguous"] = close
                found.append(frame)
            yield pd.concat(found, ignore_index=True) if found else pd.DataFrame({"lang_pred": [], "score": [], "ambiguous": []})

    # Typed as an iterator so that the model is unpacked once a task.
    run.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    lettered = F.when(letters(text), text)
    return F.pandas_udf(run, "lang_pred string, score double, ambiguous boolean")(lettered)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(documents: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, lang_pred, score and ambiguous per input row.

    Learns from the rows that are not held out, and predicts every whole text from the text
    alone. `und` with score 0 and ambiguous where the text is null or has no letter, or where
    nothing could be learnt. Repeated rows are predicted alike; a null doc_id is not held out.
    Other columns are ignored. An empty table gives no rows.
    """
    model = fit(documents.where(~held_out(F.col("doc_id"))), s)
    told = documents.select(F.col("doc_id").cast("long").alias("doc_id"), predicted(F.col("text"), model, s).alias("p"))
    return told.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "p.*")


def keep_identified(documents: DataFrame, s: Settings = Settings(), least: float = 0.3) -> DataFrame:
    """The rows, with all their columns, whose language could be told.

    Rejected: texts that are `und`, and ambiguous ones with a score below `least`.
    """
    model = fit(documents.where(~held_out(F.col("doc_id"))), s)
    rows = documents.select(
        F.struct(*[documents[f"`{c}`"] for c in documents.columns]).alias("row"), predicted(F.col("text"), model, s).alias("told")
    )
    sure = (F.col("told.lang_pred") != UNDETERMINED) & (~F.col("told.ambiguous") | (F.col("told.score") >= least))
    return rows.where(sure).select([F.col("row").getField(c).alias(c) for c in documents.columns])
