"""SentencePiece encoding by suffix-array matching, and decoding.

For each block of texts the distinct segments (a run of spaces and the letters after it) are
concatenated, their suffixes sorted, and every piece of the vocabulary is searched in them by
binary search, all pieces at once. The occurrences are edges over positions; sorted by where
they end, they are relaxed in that order: the one edge that may follow the best token before
it becomes the last token of the prefix. A token may follow another if merging the two
pieces' characters gives back just these two, which is remembered per pair.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.llm.common import kept_by_worker

SPACE = "▁"
BLOCK_CHARS = 2 << 20
LEARNT_CHARS = 1 << 20
CACHED_SEGMENTS = 300_000
CACHED_PAIRS = 500_000


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by id: the text of each (None for control ids), scores, and ids of the bytes."""

    pieces: tuple[str | None, ...]
    scores: tuple[float, ...]
    byte_ids: tuple[int, ...]
    prefix: bool

    @staticmethod
    def load(path: str) -> Vocabulary:
        """Read a model that merges pairs, falls back to bytes and does not change its text."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.vocab_size())
        plain = [not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in ids]
        pieces = tuple(model.id_to_piece(i) if plain[i] else None for i in ids)
        by_byte = {int(model.id_to_piece(i)[3:5], 16): i for i in ids if model.is_byte(i)}
        if len(by_byte) != 256:
            raise ValueError("the model has no piece for some bytes")
        if any(re.search(f"[^{SPACE}]{SPACE}", piece) for piece in pieces if piece):
            raise ValueError("the model has pieces that run on over a space")
        known = model.encode("a")
        prefix = (pieces[known[0]] or "").startswith(SPACE)
        return Vocabulary(pieces, tuple(model.get_score(i) for i in ids), tuple(by_byte[b] for b in range(256)), prefix)

    def segments(self) -> re.Pattern[str]:
        """Pieces never reach over the ends of these matches."""
        joined = {c for piece in self.pieces if piece and len(piece) > 1 for c in piece} - {SPACE}
        letters = "".join(map(re.escape, sorted(joined)))
        return re.compile(f"{SPACE}*[{letters}]+|{SPACE}+|.", re.DOTALL)


def suffix_array(codes: np.ndarray, length: int) -> np.ndarray:
    """Positions in the order of the `length` or more characters that begin there."""
    rank, width, n = np.unique(codes, return_inverse=True)[1].astype(np.int64) + 1, 1, len(codes)
    while width < length:
        after = np.zeros(n, np.int64)
        after[: max(0, n - width)] = rank[width:]
        rank = np.unique(rank * (n + 2) + after, return_inverse=True)[1] + 1
        width *= 2
    return np.argsort(rank, kind="stable")


def occurrences(codes: np.ndarray, order: np.ndarray, table: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Range in the suffix array per piece; `table` has a row of code points for each."""
    low, high = np.zeros(len(table), np.int64), np.full(len(table), len(codes), np.int64)
    padded = np.concatenate([codes, np.full(table.shape[1], -1, codes.dtype)])

    def bound(active: np.ndarray, k: int, strict: bool) -> np.ndarray:
        left, right = low[active].copy(), high[active].copy()
        wanted = table[active, k]
        while (open_ := left < right).any():
            middle = (left + right) >> 1
            there = padded[order[np.minimum(middle, len(order) - 1)] + k]
            before = open_ & ((there <= wanted) if strict else (there < wanted))
            left = np.where(before, middle + 1, left)
            right = np.where(open_ & ~before, middle, right)
        return left

    for k in range(table.shape[1]):
        active = np.flatnonzero((sizes > k) & (low < high))
        if not len(active):
            break
        first, last = bound(active, k, strict=False), bound(active, k, strict=True)
        low[active], high[active] = first, last
    return low, high


class Encoder:
    """Encodes segments and remembers them, up to the bounds above."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.pattern = vocabulary.segments()
        self.size = len(vocabulary.pieces)
        self.ids = np.array([i for i, p in enumerate(vocabulary.pieces) if p], np.int64)
        texts = [vocabulary.pieces[i] for i in self.ids]
        self.sizes = np.array([len(p) for p in texts], np.int64)
        self.table = np.full((len(texts), int(self.sizes.max())), -2, np.int64)
        for row, text in enumerate(texts):
            self.table[row, : len(text)] = [ord(c) for c in text]
        self.by_text = {p: i for i, p in enumerate(vocabulary.pieces) if p}
        self.known: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.none = self.size + 0x110000  # stands before a segment; from `size` on, characters

    def merged(self, text: str) -> list[str]:
        """Join the best-scored adjacent pair, the leftmost of equals, until none is a piece."""
        parts = list(text)
        while len(parts) > 1:
            joined = [self.by_text.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
            scored = [(self.v.scores[i], -at) for at, i in enumerate(joined) if i is not None]
            if not scored:
                break
            at = -max(scored)[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def allowed(self, pairs: list[int]) -> np.ndarray:
        """Whether the second token of a pair (numbered as by `learn`) may follow the first."""
        found = list(map(self.pairs.get, pairs))
        for at, known in enumerate(found):
            if known is None:
                before, after = (self.text_of(t) for t in divmod(pairs[at], self.none + 1))
                parts = [before, after] if before else [after]
                found[at] = self.pairs[pairs[at]] = self.merged(before + after) == parts
        if len(self.pairs) > CACHED_PAIRS:
            self.pairs.clear()
        return np.array(found, bool)

    def learn(self, segments: list[str]) -> None:
        """Encode new segments together and remember them."""
        codes = np.frombuffer("\0".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
        lengths = np.array([len(s) for s in segments], np.int32)
        begins = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]).astype(np.int32)
        owner = np.repeat(np.arange(len(segments), dtype=np.int32), lengths + 1)[: len(codes)]
        order = suffix_array(codes, self.table.shape[1]).astype(np.int32)
        low, high = occurrences(codes, order, self.table, self.sizes)

        counts = high - low
        row = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        start = order[np.arange(len(row)) + np.repeat(low - (np.cumsum(counts) - counts), counts)]
        token, size = self.ids[row].astype(np.int32), self.sizes[row].astype(np.int32)
        covered = np.zeros(len(codes), bool)
        covered[start[size == 1]] = True
        covered[begins[1:] - 1] = True  # separators
        lone = np.flatnonzero(~covered).astype(np.int32)  # characters without a piece become bytes
        start = np.concatenate([start, lone])
        token = np.concatenate([token, self.size + codes[lone]])
        end = start + np.concatenate([size, np.ones(len(lone), np.int32)])
        layer = end - begins[owner[start]]
        if layer.max() < 1 << 16:
            layer = layer.astype(np.uint16)  # sorted by digits
        by_end = np.argsort(layer, kind="stable")
        start, token, end, layer = start[by_end], token[by_end], end[by_end], layer[by_end]
        is_first = start == begins[owner[start]]
        last = np.full(len(codes) + 1, -1, np.int32)
        came = np.zeros(len(codes) + 1, np.int32)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(layer)) + 1, [len(layer)]]).tolist()
        for a, b in zip(cuts, cuts[1:], strict=False):
            before = np.where(is_first[a:b], self.none, last[start[a:b]])
            edges = np.flatnonzero(before >= 0) + a
            numbers = before[edges - a].astype(np.int64) * (self.none + 1) + token[edges]
            pairs, back = np.unique(numbers, return_inverse=True)
            edges = edges[self.allowed(pairs.tolist())[back]]
            last[end[edges]], came[end[edges]] = token[edges], start[edges]

        chosen = np.zeros(len(codes) + 1, bool)
        at, first = begins + lengths, begins
        while len(at):
            chosen[at] = True
            at = came[at]
            at, first = at[at > first], first[at > first]
        path = np.flatnonzero(chosen)
        ids = last[path]
        cut = np.searchsorted(path, np.append(begins, len(codes) + 1) + 1)
        if (ids >= self.size).any():
            parts = [[t] if t < self.size else [self.v.byte_ids[b] for b in chr(t - self.size).encode("utf-8", "surrogatepass")] for t in ids.tolist()]
            cut = np.concatenate([[0], np.cumsum([len(p) for p in parts])])[cut]
            ids = np.array([i for p in parts for i in p], np.int32)
        raw, cut = ids.tobytes(), (4 * cut).tolist()
        for segment, a, b in zip(segments, cut, cut[1:], strict=False):
            self.known[segment] = raw[a:b]

    def text_of(self, token: int) -> str:
        if token < self.size:
            return self.v.pieces[token]
        return "" if token == self.none else chr(token - self.size)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids per text."""
        cut = []
        for text in texts:
            spaced = text.replace(" ", SPACE)
            cut.append(self.pattern.findall(SPACE + spaced if self.v.prefix and spaced else spaced))
        needed = set().union(*cut)
        new = needed - self.known.keys()
        if len(self.known) + len(new) > CACHED_SEGMENTS:
            self.known.clear()
            new = needed
        if new:
            whole = {s for s in new if "\0" in s}  # the separator, alone in its segment
            for s in whole:
                ids = [self.by_text[c] if c in self.by_text else self.v.byte_ids[0] for c in s]
                self.known[s] = np.array(ids, np.int32).tobytes()
            for rest in _char_blocks(sorted(new - whole), LEARNT_CHARS):
                self.learn(rest)
        get = self.known.__getitem__
        return [b"".join(map(get, segments)) for segments in cut]


class Decoder:
    """Turns ids into bytes by one gather over the bytes of all pieces."""

    def __init__(self, vocabulary: Vocabulary):
        self.prefix = vocabulary.prefix
        pieces = [b"" if p is None else p.replace(SPACE, " ").encode() for p in vocabulary.pieces]
        for byte, i in enumerate(vocabulary.byte_ids):
            pieces[i] = bytes([byte])
        self.sizes = np.array([len(p) for p in pieces], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """UTF-8 of each text; its ids are those between two offsets."""
        sizes = self.sizes[ids]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        data = self.bytes[np.arange(ends[-1]) + np.repeat(self.starts[ids] - ends[:-1], sizes)].tobytes()
        cuts = ends[offsets].tolist()
        texts = [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        return [t[1:] if self.prefix and t[:1] == b" " else t for t in texts]


def _tools(shared) -> tuple[Encoder, Decoder]:
    key, vocabulary = shared.value
    return kept_by_worker("sentencepiece", key, lambda: (Encoder(vocabulary), Decoder(vocabulary)))


def _char_blocks(texts: list[str], limit: int = BLOCK_CHARS) -> Iterator[list[str]]:
    held: list[str] = []
    size = 0
    for text in texts:
        if held and size + len(text) > limit:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def _encode(broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _tools(broadcast)
        for batch in batches:
            at = 0
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for block in _char_blocks(texts):
                tokens = encoder.encode(block)
                sizes = np.array([len(t) // 4 for t in tokens], np.int64)
                values = np.frombuffer(b"".join(tokens), np.int32)
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                decoded = decoder.decode(values, offsets)
                same = [data == text.encode("utf-8", "surrogatepass") for data, text in zip(decoded, block, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(at, len(block)),
                        pa.array(sizes),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values)),
                        pa.array(same),
                    ],
                    ["doc_id", "n_tokens", "token_ids", "round_trip"],
                )
                at += len(block)

    return run


def _decode(broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _tools(broadcast)[1]
        for batch in batches:
            held = batch.column("token_ids")
            ids = [np.asarray(i.values, np.int64) if i.is_valid else np.empty(0, np.int64) for i in held]
            offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int64)
            decoded = decoder.decode(np.concatenate([np.empty(0, np.int64), *ids]), offsets)
            texts = [data.decode("utf-8", "replace") if i.is_valid else None for data, i in zip(decoded, held, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def _shared(spark: SparkSession, path: str):
    """The vocabulary and a name for it, as large as the model, whatever the table."""
    vocabulary = Vocabulary.load(path)
    return spark.sparkContext.broadcast((hashlib.sha256(repr(vocabulary).encode()).hexdigest(), vocabulary))


def encode(documents: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, token_ids, round_trip (whether decoding gives back the text) per row.

    The ids are those of SentencePiece for the model, without control ids. A null text counts
    as empty and has no ids. A text that holds the space mark U+2581 itself decodes to a space
    there, so its round_trip is false. Repeated rows and null ids stay as they are. Other
    columns are ignored. An empty table gives no rows. The model is read on the driver.
    """
    shared = _shared(documents.sparkSession, model_path)
    schema = "doc_id long, n_tokens long, token_ids array<int>, round_trip boolean"
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encode(shared), schema)


def decode(tokens: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text of (doc_id, token_ids); null ids give a null text."""
    shared = _shared(tokens.sparkSession, model_path)
    return tokens.select("doc_id", "token_ids").mapInArrow(_decode(shared), "doc_id long, text string")
