"""Secret scans with corpus-wide ownership frequencies.

Candidates are spans of three fixed kinds and of high-entropy tokens. Their hashes are counted
by distinct documents (repositories) and sources (owners): a value that many owners hold, or that
its owners hold in many documents each, is a copied example; others look live. The fixed kinds are always
reported, with that class; a high-entropy token only if it looks live.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.plans.scratch import materialize

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs are maximal, so this is the run without shorter ones
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}")  # maximal runs, of any length
KINDS = ("assign", "access", "hex", "entropy")


@dataclass(frozen=True)
class Ownership:
    """A value is an example from `owners` distinct owners on, or from `copies` distinct documents
    for each of its owners. `bits` is the least entropy per character of a token without a fixed form."""

    owners: int = 3
    copies: int = 20
    bits: float = 4.0


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def candidates(text: str, bits: float) -> list[tuple[int, int, int, int]]:
    """(kind, start, end, hash of the value), by start and then kind."""
    found = []
    lowered = text.lower()
    if any(word in lowered for word in ASSIGN_WORDS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 12:
                found.append((0, m.start(), m.end(), m[2]))
    if "AKIA" in text:
        found += [(1, m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [(2, m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    taken = [(start, end) for _, start, end, _ in sorted(found, key=lambda f: f[1])]
    passed, reach = 0, 0  # spans that begin before the token ends, and where the last of them ends
    for m in TOKEN.finditer(text):
        while passed < len(taken) and taken[passed][0] < m.end():
            reach = max(reach, taken[passed][1])
            passed += 1
        value = m[0]
        mixed = any(c.islower() for c in value) and any(c.isupper() for c in value) and any(c.isdigit() for c in value)
        if mixed and reach <= m.start() and entropy(value) >= bits:
            found.append((3, m.start(), m.end(), value))
    found.sort(key=lambda f: (f[1], f[0]))
    return [(k, a, b, xxhash.xxh3_64_intdigest(v.encode()) - (1 << 63)) for k, a, b, v in found]


def spans(text: Column, bits: float) -> Column:
    """array<struct(kind, start, end, value)> of a text; a null text has none."""

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            rows = [
                [{"kind": k, "start": a, "end": b, "value": v} for k, a, b, v in candidates(t, bits)] if t else []
                for t in series
            ]
            yield pd.Series(rows, dtype=object)

    run.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<struct<kind int, start int, end int, value long>>")(text)


def ownership(found: DataFrame, setting: Ownership) -> DataFrame:
    """(value, n_documents, n_owners, example) per distinct value of (doc_id, source, spans).

    Distinct pairs are combined before they move, so a value that a third of all rows hold
    costs one row for each task and owner.
    """
    each = found.select("doc_id", "source", F.explode("spans").alias("s")).select("doc_id", "source", F.col("s.value"))
    by_owner = each.groupBy("value", "source").agg(F.count("*").alias("n"))
    documents = each.select("value", "doc_id").distinct().groupBy("value").agg(F.count("*").alias("n_documents"))
    holders = by_owner.groupBy("value").agg(F.count("*").alias("n_owners"))
    owners, copies = F.col("n_owners"), F.col("n_documents")
    example = (owners >= setting.owners) | (copies >= setting.copies * owners)
    return documents.join(holders, "value").withColumn("example", example)


def joined(array: Column) -> Column:
    """The spans as kind:start:end, joined by commas; empty for none."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(array, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ","
    )


def scan(documents: DataFrame, setting: Ownership = Ownership()) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, and how
    many of the values look live or are examples, with the most owners and documents of any.

    Offsets are code points, ends exclusive. A null or empty text has no span. A null source is
    an owner of its own, and rows without a doc_id count as one document; rows that repeat an
    id are scanned each on its own and count once. Other columns are ignored. An empty table
    gives no rows.
    """
    read = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", spans(F.col("text"), setting.bits).alias("spans"))
    found = materialize(read.withColumn("row", F.monotonically_increasing_id()), "secrets")
    held = found.where(F.size("spans") > 0)
    owned = materialize(ownership(held, setting), "ownership")
    each = held.select("row", F.explode("spans").alias("s")).withColumn("value", F.col("s.value"))
    told = each.join(owned, "value").groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("s.start", "s.kind", "s.end", "example", "n_owners", "n_documents"))).alias("told")
    )
    base = F.filter("spans", lambda s: s["kind"] < 3)
    kept = F.filter("told", lambda s: (s["kind"] < 3) | ~s["example"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    judged = lambda example: F.size(F.filter("told", lambda s: s["example"] == F.lit(example))).cast("long")
    whole = found.join(told, "row", "left").withColumn("told", F.coalesce("told", F.expr("cast(array() as array<struct<start int, kind int, end int, example boolean, n_owners bigint, n_documents bigint>>)")))
    return whole.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(kept).alias("spans"),
        judged(False).alias("n_live"),
        judged(True).alias("n_example"),
        F.coalesce(F.array_max(F.transform("told", lambda s: s["n_owners"])), F.lit(0)).alias("most_owners"),
        F.coalesce(F.array_max(F.transform("told", lambda s: s["n_documents"])), F.lit(0)).alias("most_documents"),
    )
