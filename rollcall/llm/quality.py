"""Quality by robust multivariate outliers: minimum covariance determinants by group.

Statistics of every text are transformed to a vector. For each language and source the mean
and covariance are those of the `share` of its texts that lie closest to them, found by
concentration steps from coordinate-wise medians; every step is a pair of aggregations over
the whole table. Small groups lean on their language's estimate, and small languages on that of all
rows, the more the smaller they are. A text far from its group by Mahalanobis distance is rejected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import WordHashes, blocks, inside, window_hashes
from rollcall.plans.scratch import materialize

SYMBOLS = "#*$%&|<>"
BLANK = " \t\n\x0b\x0c\r"
NAMES = ["x0", "x1", "x2", "x3", "x4"]
# The least spread of each statistic that is taken to mean something.
FLOORS = (0.5, 0.3, 0.04, 0.1, 0.1)


@dataclass(frozen=True)
class Settings:
    """A group of n rows counts n / (n + `prior`) in its estimate, its language's rows the rest; a
    language shrinks towards all rows likewise. `normal` is the cut-off in standard deviations that the
    chi-square quantile is taken for."""

    share: float = 0.75
    steps: int = 3
    prior: float = 50.0
    normal: float = 6.0
    window: int = 5
    accuracy: int = 10_000


def statistics(text: Column, s: Settings) -> Column:
    """struct of counts of a text; all 0 for a null text."""

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        cache = WordHashes()
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
        for series in texts:
            rows, at = [], 0
            for block in blocks(series):
                hashes, starts = cache.of(block)
                repeats = repeated_words(hashes, starts, s.window)
                for i in range(len(block)):
                    whole = series.iloc[at + i] or ""
                    chars = len(whole) - sum(map(whole.count, BLANK))
                    symbols = sum(map(whole.count, SYMBOLS))
                    lines = [line for line in whole.split("\n") if line.strip(BLANK)]
                    rows.append((starts[i + 1] - starts[i], chars, symbols, len(lines) - len(set(lines)), repeats[i]))
                at += len(block)
            yield pd.DataFrame(rows, columns=names).astype(np.int64)

    run.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    kind = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    return F.pandas_udf(run, kind)(text)


def repeated_words(hashes: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Per text: words inside a window of `width` words that the text holds twice or more."""
    at = inside(starts, width)
    if not len(at):
        return np.zeros(len(starts) - 1, np.int64)
    values = window_hashes(hashes, width)[at]
    text = np.searchsorted(starts, at, side="right") - 1
    order = np.lexsort((values, text))
    same = (values[order][1:] == values[order][:-1]) & (text[order][1:] == text[order][:-1])
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edges, at[twice], 1)
    np.add.at(edges, at[twice] + width, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(edges)[:-1] > 0)])
    return covered[starts[1:]] - covered[starts[:-1]]


def vector() -> list[Column]:
    """The statistics on scales on which ordinary texts spread evenly."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return [
        F.log1p("n_words"),
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words),
        F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        F.sqrt(F.col("n_dup_lines") / words),
        F.sqrt(F.col("n_repeat_words") / words),
    ]


def chi_square(freedom: int, z: float) -> float:
    """The quantile that a normal variable's z has, by the cube-root approximation."""
    return freedom * (1 - 2 / (9 * freedom) + z * (2 / (9 * freedom)) ** 0.5) ** 3


def _invert(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Mean and inverse covariance of each group from its sums."""
    p = len(NAMES)
    floor = np.diag(np.square(FLOORS))
    for frame in frames:
        rows = []
        for row in frame.itertuples(index=False):
            values = np.array(row[2:], float)
            mean = values[:p] / row[1]
            second = np.zeros((p, p))
            second[np.triu_indices(p)] = values[p:]
            second = second + np.triu(second, 1).T
            covariance = second / row[1] - np.outer(mean, mean)
            # Constant statistics keep the least spread; others are hardly changed by it.
            spread, axes = np.linalg.eigh(np.linalg.solve(np.sqrt(floor), np.linalg.solve(np.sqrt(floor), covariance).T))
            scaled = axes @ np.diag(1 / np.maximum(spread, 1.0)) @ axes.T
            inverse = np.linalg.solve(np.sqrt(floor), np.linalg.solve(np.sqrt(floor), scaled).T)
            rows.append((row[0], mean.tolist(), inverse.reshape(-1).tolist()))
        yield pd.DataFrame(rows, columns=["_group", "_mean", "_inverse"])


def blended(weight: float, own: tuple[np.ndarray, np.ndarray], wider: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of a mixture of two distributions."""
    off = own[0] - wider[0]
    mean = weight * own[0] + (1 - weight) * wider[0]
    return mean, weight * own[1] + (1 - weight) * wider[1] + weight * (1 - weight) * np.outer(off, off)


def _shrink(prior: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = len(NAMES)
        for frame in frames:
            rows = []
            for row in frame.itertuples(index=False):
                now = None
                for level in range(3):  # all rows, a language, a source in it
                    n, scale = getattr(row, f"n{level}"), getattr(row, f"scale{level}")
                    inverse = np.array(getattr(row, f"inverse{level}")).reshape(p, p)
                    own = np.array(getattr(row, f"mean{level}")), scale * np.linalg.inv(inverse)
                    now = own if now is None else blended(n / (n + prior), own, now)
                rows.append((row.lang, row.source, now[0].tolist(), np.linalg.inv(now[1]).reshape(-1).tolist()))
            yield pd.DataFrame(rows, columns=["_lang", "_source", "_mean", "_inverse"])

    return run


def _distance() -> Column:
    p = len(NAMES)
    off = [F.col(n) - F.get("_mean", F.lit(i)) for i, n in enumerate(NAMES)]
    total = F.lit(0.0)
    for i in range(p):
        for j in range(p):
            total = total + off[i] * off[j] * F.get("_inverse", F.lit(i * p + j))
    return total


def group_names() -> list[Column]:
    """Names of the groups a row is in: all rows, its language's, and its source's in that language."""
    told = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))
    return [F.lit("all"), told("lang"), F.concat_ws("\x00", told("lang"), told("source"))]


def shrunk(rows: DataFrame, s: Settings) -> DataFrame:
    """(_lang, _source, _mean, _inverse) per language and source of rows with the vector."""
    keyed = rows.select(F.explode(F.array(*group_names())).alias("_group"), *NAMES)
    found = estimates(keyed, s)
    each = rows.select("lang", "source").distinct().select("lang", "source", *[g.alias(f"_g{i}") for i, g in enumerate(group_names())])
    for i in range(3):
        own = found.select(F.col("_group").alias(f"_g{i}"), F.col("_n").alias(f"n{i}"), F.col("_mean").alias(f"mean{i}"), F.col("_inverse").alias(f"inverse{i}"), F.col("_scale").alias(f"scale{i}"))
        each = each.join(own, f"_g{i}")
    each = each.drop("_g0", "_g1", "_g2")
    return materialize(each.mapInPandas(_shrink(s.prior), "_lang string, _source string, _mean array<double>, _inverse array<double>"), "groups")


def estimates(rows: DataFrame, s: Settings) -> DataFrame:
    """(_group, _n, _mean, _inverse, _scale): minimum covariance determinant of each group of _n rows.

    `rows` holds _group and the vector, and is read several times. Each group's rows are
    combined where they are read; one row a group and step is what moves.
    """
    p = len(NAMES)
    middle = rows.groupBy("_group").agg(*[F.percentile_approx(n, 0.5, s.accuracy).alias(f"m_{n}") for n in NAMES])
    middle = materialize(middle, "medians")
    gaps = [F.percentile_approx(F.abs(F.col(n) - F.col(f"m_{n}")), 0.5, s.accuracy).alias(f"g_{n}") for n in NAMES]
    spread = rows.join(middle, "_group").groupBy("_group").agg(*gaps)
    wide = [F.greatest(1.4826 * F.col(f"g_{n}"), F.lit(f)) for n, f in zip(NAMES, FLOORS, strict=True)]
    diagonal = [1 / (wide[i] * wide[i]) if i == j else F.lit(0.0) for i in range(p) for j in range(p)]
    now = middle.join(spread, "_group").select(
        "_group", F.array(*[F.col(f"m_{n}").cast("double") for n in NAMES]).alias("_mean"), F.array(*diagonal).alias("_inverse")
    )
    now = materialize(now, "estimates")
    products = [F.sum(F.col(NAMES[i]) * F.col(NAMES[j])) for i in range(p) for j in range(i, p)]
    sums = [F.sum(n) for n in NAMES] + products
    for _ in range(s.steps):
        far = rows.join(now, "_group").select("_group", *NAMES, _distance().alias("_d"))
        cut = materialize(far.groupBy("_group").agg(F.percentile_approx("_d", s.share, s.accuracy).alias("_cut")), "cuts")
        near = far.join(cut, "_group").where("_d <= _cut")
        held = near.groupBy("_group").agg(F.count("*").alias("_n"), *[c.alias(f"s{i}") for i, c in enumerate(sums)])
        now = held.mapInPandas(_invert, "_group string, _mean array<double>, _inverse array<double>")
        now = materialize(now, "estimates")
    far = rows.join(now, "_group").select("_group", _distance().alias("_d"))
    half = far.groupBy("_group").agg(F.count("*").alias("_n"), F.percentile_approx("_d", 0.5, s.accuracy).alias("_half"))
    # The closest rows spread less than all do: scaled so that the median is that of chi-square.
    scale = F.greatest(F.col("_half") / chi_square(p, 0.0), F.lit(1.0))
    return materialize(now.join(half.select("_group", "_n", scale.alias("_scale")), "_group"), "estimates")


def judge(documents: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept
    and distance per input row.

    Estimates come from the rows that pass the base rules; the others are not kept and have no
    distance. A null text has no words. Null languages and sources are groups of their own.
    Repeated rows count each. Other columns are ignored. An empty table gives no rows.
    """
    told = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
        statistics(F.col("text"), s).alias("t"),
    ).select("doc_id", "lang", "source", "t.*")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = materialize(
        told.withColumn("base_failed", failed).withColumns(dict(zip(NAMES, vector(), strict=True))), "statistics"
    )
    found = shrunk(rows.where(~F.col("base_failed")), s)
    match = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    cut = chi_square(len(NAMES), s.normal)
    distance = F.when(~F.col("base_failed"), F.sqrt(F.greatest(_distance(), F.lit(0.0))))
    whole = rows.join(found, match, "left").withColumn("distance", distance)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    near = F.coalesce(F.col("distance") <= cut**0.5, F.lit(False))
    return whole.select(*names, (~F.col("base_failed") & near).alias("kept"), "distance")
