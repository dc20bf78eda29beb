"""WARC archives of pages, with revisit records, segments and chunked transfer framing.

Archives are text files of records, one folder for each run, written and read by Spark. A
payload larger than a segment is split into continuation records; reading groups these by the
record they continue, orders them by number, verifies the total length and undoes the chunks.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.plans.scratch import materialize

END = "\r\n"
FED_BYTES = 1 << 16
PIECE_BYTES = 1 << 20


@dataclass(frozen=True)
class Layout:
    """Payloads of `revisit_bytes` or more are stored once. A record's block has at most about
    `segment_chars` characters, a chunk `chunk_chars`, and a file as many records as `file_bytes` holds of such blocks."""

    revisit_bytes: int = 1000
    segment_chars: int = 1 << 15
    chunk_chars: int = 1 << 12
    file_bytes: int = 32 << 20


def with_roles(pages: DataFrame, layout: Layout) -> DataFrame:
    """Adds payload, digest, n_bytes, refers_to (null for those that store their payload) and
    whether others refer to it."""
    payload = F.coalesce("html", F.lit(""))
    raw = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload")
    ).withColumn("digest", F.sha1(F.col("payload").cast("binary"))).withColumn("n_bytes", F.octet_length("payload").cast("long"))
    large = raw.where(F.col("n_bytes") >= layout.revisit_bytes)
    groups = large.groupBy("digest", "n_bytes").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("_n"))
    # Stored first, so that Spark knows its size before it plans the join with the payloads.
    groups = materialize(groups.where("_n > 1 and refers_to is not null").drop("_n"), "payload-groups")
    both = raw.join(groups, ["digest", "n_bytes"], "left")
    own = F.col("page_id").eqNullSafe(F.col("refers_to"))
    return both.withColumn("referred", own & F.col("refers_to").isNotNull()).withColumn(
        "refers_to", F.when(~own, F.col("refers_to"))
    )


def _record(kind: str, headers: list[tuple[str, object]], block: str) -> str:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *[f"{k}: {v}" for k, v in headers]]
    size = len(block.encode("utf-8", "surrogatepass"))
    return END.join([*lines, f"Content-Length: {size}", "", block])


def _page_uri(number: int, page_id: object) -> str:
    return f"<urn:page:{'none' if page_id is None else int(page_id)}:{number}>"


def records(number: int, page: dict, layout: Layout) -> Iterator[str]:
    """The records of one page; `number` tells apart rows that repeat a page_id."""
    uri = _page_uri(number, page["page_id"])
    target = " ".join(str(page["url"]).split()) or "about:blank"
    common = [("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{page['digest']}")]
    date = ("WARC-Date", "1970-01-01T00:00:00Z")
    if page["refers_to"] is not None:
        refers = ("WARC-Refers-To", _page_uri(0, page["refers_to"]))
        yield _record("revisit", [("WARC-Record-ID", uri), date, *common, refers], "")
        return
    body = page["payload"]
    pieces = [body[i : i + layout.chunk_chars] for i in range(0, len(body), layout.chunk_chars)]
    framed = [f"{len(p.encode('utf-8', 'surrogatepass')):x}{END}{p}{END}" for p in pieces]
    head = END.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", "Transfer-Encoding: chunked", "", ""])
    block = head + "".join(framed) + f"0{END}{END}"
    parts = [block[i : i + layout.segment_chars] for i in range(0, len(block), layout.segment_chars)]
    if len(parts) == 1:
        yield _record("response", [("WARC-Record-ID", uri), date, *common], block)
        return
    total = len(block.encode("utf-8", "surrogatepass"))
    for i, part in enumerate(parts, 1):
        own = [("WARC-Record-ID", uri if i == 1 else f"<{uri[1:-1]}:{i}>"), date, ("WARC-Segment-Number", i)]
        if i == 1:
            yield _record("response", [*own, *common], part)
        else:
            last = [("WARC-Segment-Total-Length", total)] if i == len(parts) else []
            yield _record("continuation", [*own, ("WARC-Segment-Origin-ID", uri), *last], part)


def write(pages: DataFrame, path: str, layout: Layout = Layout()) -> None:
    """Write (page_id, url, html) as gzip-compressed WARC files under `path`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["number", "page_id", "url", "payload", "digest", "refers_to"]
        for batch in batches:
            held, size = [], 0
            columns = [batch[n].astype(object).where(batch[n].notna(), None).tolist() for n in names]
            for row in zip(*columns, strict=True):
                own = list(records(row[0], dict(zip(names, row, strict=True)), layout))
                held += own
                size += sum(map(len, own))
                if size > 4 << 20:
                    yield pd.DataFrame({"value": held})
                    held, size = [], 0
            yield pd.DataFrame({"value": held})

    number = F.when(F.col("referred"), F.lit(0)).otherwise(F.monotonically_increasing_id() + 1)
    marked = with_roles(pages, layout).withColumn("number", number)
    # A record ends with two line ends, which is what the text writer puts after each row.
    written = marked.mapInPandas(run, "value string").write.option("lineSep", END + END).option("compression", "gzip")
    written.option("maxRecordsPerFile", max(1, layout.file_bytes // layout.segment_chars)).text(path)


def unpacked(content: bytes) -> Iterator[bytes]:
    """What all gzip members of a file hold, in pieces of bounded size."""
    view, at = memoryview(content), 0
    while at < len(view):
        member = zlib.decompressobj(wbits=31)
        while not member.eof:
            fed = view[at : at + FED_BYTES]
            piece = member.decompress(fed, PIECE_BYTES)
            if not fed and not piece and not member.eof:
                raise ValueError("the last gzip member is cut off")
            at += len(fed) - len(member.unconsumed_tail) - len(member.unused_data)
            yield piece
        while at < len(view) and view[at] == 0:  # padding
            at += 1


def opened(content: bytes) -> Iterator[bytes]:
    """The bytes of an archive, compressed or not, in pieces of bounded size."""
    if content[:2] == b"\x1f\x8b":
        yield from unpacked(content)
    else:
        view = memoryview(content)
        yield from (bytes(view[i : i + PIECE_BYTES]) for i in range(0, len(view), PIECE_BYTES))


def _headers(lines: bytes) -> dict[bytes, bytes]:
    parts = (line.partition(b":") for line in lines.split(b"\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in parts}


def parse(pieces: Iterable[bytes], tolerant: bool = False) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """Headers and block of each record; the length of a block is the one its header states.

    A record that cannot be read raises ValueError. If `tolerant`, it is reported by a header b"error"
    instead, and reading goes on at the next place that looks like the beginning of a record.
    """
    held, passed, begin, size, headers, lost = bytearray(), 0, 0, 0, None, False
    source, ended, failure = iter(pieces), False, None

    def failed(message: str) -> tuple[dict[bytes, bytes], bytes]:
        if not tolerant:
            raise ValueError(message)
        return {b"error": message.encode()}, b""

    while not ended:
        try:
            held += next(source)
        except StopIteration:
            ended = True
        except (ValueError, zlib.error) as broken:
            ended, failure = True, str(broken)
        at = 0
        while at < len(held):
            if lost:
                following = held.find(b"\r\nWARC/", at)
                if following < 0:
                    at = max(at, len(held) - 7)
                    break
                at, lost = following + 2, False
            if headers is None:
                while held[at : at + 2] == b"\r\n":  # more line ends than two
                    at += 2
                if not held.startswith(b"WARC/"[: len(held) - at], at):
                    yield failed(f"no WARC record at byte {passed + at}")
                    lost = True
                    continue
                split = held.find(b"\r\n\r\n", at)
                if split < 0:
                    break
                headers = _headers(bytes(held[at:split]))
                length = headers.get(b"content-length", b"")
                if not length.isdigit():
                    yield failed(f"no length of the record at byte {passed + at}")
                    headers, lost, at = None, True, split
                    continue
                begin, size = split + 4 - at, int(length)
            if at + begin + size > len(held):
                break
            tail = bytes(held[at + begin + size : at + begin + size + 4])
            if len(tail) < 4 and not ended:
                break
            if tail[:2] not in (b"", b"\r", b"\r\n"):
                yield failed(f"the record at byte {passed + at} is not as long as it says")
                headers, lost, at = None, True, at + begin
                continue
            yield headers, bytes(held[at + begin : at + begin + size])
            at += begin + size + (4 if tail == b"\r\n\r\n" else len(tail.removesuffix(tail.lstrip(b"\r\n"))))
            headers = None
        del held[:at]
        passed += at
    if failure:
        yield failed(failure)
    elif headers is not None or (held.strip() and not lost):
        yield failed("the last record is cut off" if headers is not None else f"no WARC record at byte {passed}")


CHUNKED = re.compile(rb"^transfer-encoding[ \t]*:(?:.*,)?[ \t]*chunked[ \t]*\r?$", re.IGNORECASE | re.MULTILINE)


def unchunked(block: bytes) -> bytes:
    """The payload of an HTTP response block, without chunked transfer framing."""
    head, _, body = block.partition(b"\r\n\r\n")
    if not CHUNKED.search(head):
        return body
    parts, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            raise ValueError("a chunk lacks its length")
        size = int(body[at:line].split(b";")[0], 16)
        if size == 0:
            return b"".join(parts)
        parts.append(body[line + 2 : line + 2 + size])
        if len(parts[-1]) != size or body[line + 2 + size : line + 4 + size] != b"\r\n":
            raise ValueError("a chunk is not as long as it says")
        at = line + 4 + size


def payload_of(kind: str, block: bytes) -> bytes:
    """What a record is about: the body of a response, nothing for a revisit, else the whole block."""
    if kind == "response":
        return unchunked(block) if block.startswith(b"HTTP/") else block
    return b"" if kind == "revisit" else block


def stated_digest(value: str | None) -> tuple[str, bytes] | None:
    """Algorithm and bytes of a digest in hexadecimal or base 32; None for none or one of another kind."""
    name, _, text = (value or "").partition(":")
    name, text = name.strip().lower().replace("-", ""), text.strip()
    if name not in ("md5", "sha1", "sha256", "sha512"):
        return None
    size = hashlib.new(name).digest_size
    try:
        if len(text) == 2 * size:
            return name, bytes.fromhex(text)
        raw = base64.b32decode(text.upper() + "=" * (-len(text) % 8))
    except (ValueError, binascii.Error):
        return None
    return (name, raw) if len(raw) == size else None


READ = ["uri", "origin", "type", "segment", "total", "refers_to", "digest", "block", "error"]


def _number(value: str) -> int | None:
    return int(value) if value.isdigit() else None


def _read_files(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in files:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            held, size = [], 0
            for headers, block in parse(opened(content), tolerant=True):
                get = lambda k: headers.get(k, b"").decode("utf-8", "replace")  # noqa: B023, E731
                uri, error = get(b"warc-record-id"), get(b"error")
                held.append(
                    (uri or None, get(b"warc-segment-origin-id") or uri, get(b"warc-type"), _number(get(b"warc-segment-number")) or 0,
                     _number(get(b"warc-segment-total-length")), get(b"warc-refers-to") or None, get(b"warc-payload-digest") or None, block,
                     f"{path}: {error}" if error else None)
                )
                size += len(block)
                if size > 4 << 20:
                    yield pd.DataFrame(held, columns=READ)
                    held, size = [], 0
            yield pd.DataFrame(held, columns=READ)


def _joined(kind: str, digest: str | None, segments: list) -> tuple[bytes, str | None, str | None]:
    """(payload, digest, error) of a record from its segments, in order and each once."""
    block = b"".join(bytes(s["block"]) for s in segments)
    if segments[0]["segment"] > 0:
        if [s["segment"] for s in segments] != list(range(1, len(segments) + 1)):
            return b"", None, "lacks a segment"
        if segments[-1]["total"] is None:
            return b"", None, "lacks its last segment"
        if segments[-1]["total"] != len(block):
            return b"", None, "is not as long as its last segment says"
    stated = stated_digest(digest)
    shown = None if stated is None else stated[1].hex()
    try:
        payload = payload_of(kind, block)
    except ValueError as broken:
        return b"", shown, str(broken)
    if stated and kind != "revisit":
        # Some archives state the digest of the body as it was sent.
        sent = block.partition(b"\r\n\r\n")[2]
        if stated[1] not in (hashlib.new(stated[0], data).digest() for data in (payload, sent)):
            return b"", shown, "does not have the digest it states"
    return payload, shown, None


def _whole(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Payload of each row whose segments are all there."""
    for batch in rows:
        found = []
        for uri, kind, refers, digest, error, segments in batch[["uri", "type", "refers_to", "digest", "error", "segments"]].itertuples(index=False):
            if error is not None:
                found.append((uri, None, None, None, None, None, error))
                continue
            parts = sorted(segments, key=lambda s: s["segment"])
            times = sum(s["segment"] == parts[0]["segment"] for s in parts)  # of a repeated row
            payload, shown, problem = _joined(kind, digest, parts[::times])
            size = None if problem else len(payload)
            told = f"{uri} {problem}" if problem else None
            found += [(uri, kind, refers, shown, size, None if problem else payload, told)] * times
        yield pd.DataFrame(found, columns=["uri", "type", "refers_to", "digest", "n_bytes", "payload", "error"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """(uri, type, refers_to, digest, n_bytes, payload, error) per record, its segments joined.

    Reads compressed files of any number of gzip members and plain ones. Digests may be hexadecimal or
    base 32 and are given in hexadecimal; null where there is none or its kind is unknown. Whatever
    cannot be read gives a row with an `error` and no payload: a record without a length, one that is
    cut off or not as long as it says, a missing segment, bad chunks, a digest that differs. Reading
    goes on at the next record; after damaged compression, at the next file.

    Records in one piece stay where they are read; only segments are shuffled, by the record
    they continue, whose size bounds the group.
    """
    schema = "uri string, origin string, type string, segment int, total long, refers_to string, digest string, block binary, error string"
    found = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_read_files, schema)
    segment = F.struct("segment", "total", "block")
    single = found.where("segment = 0").select("uri", "type", "refers_to", "digest", "error", F.array(segment).alias("segments"))
    parts = found.where("segment > 0").groupBy("origin").agg(
        F.max(F.when(F.col("segment") == 1, F.col("type"))).alias("type"),
        F.max("refers_to").alias("refers_to"),
        F.max("digest").alias("digest"),
        F.lit(None).cast("string").alias("error"),
        F.collect_list(segment).alias("segments"),
    )
    out = "uri string, type string, refers_to string, digest string, n_bytes long, payload binary, error string"
    whole = parts.withColumnRenamed("origin", "uri").select(single.columns)
    return single.mapInPandas(_whole, out).union(whole.mapInPandas(_whole, out))


def archive(pages: DataFrame, path: str, layout: Layout = Layout()) -> DataFrame:
    """Write the pages, read them back, and report on each record: page_id, payload_bytes,
    payload_digest, record_type, refers_to.

    Of equal payloads of `revisit_bytes` or more the largest page_id stores it, and the others
    refer to it. A null html is empty, a null url about:blank; rows without a page_id store
    their payload unless a page with an id has it. A repeated row is a record of its own. Other
    columns are ignored. An empty table gives no rows.
    """
    write(pages, path, layout)
    spark = pages.sparkSession
    number = F.regexp_extract("uri", r"^<urn:page:(-?\d+):", 1)
    told = materialize(
        read(spark, path).select(
            F.when(number != "", number.cast("long")).alias("page_id"),
            F.when(F.col("error").isNotNull(), F.raise_error(F.col("error"))).otherwise(F.col("type")).alias("type"),
            F.regexp_extract("refers_to", r"^<urn:page:(-?\d+):", 1).cast("long").alias("refers_to"),
            "digest",
            "n_bytes",
        ),
        "records",
    )
    stored = told.where("type = 'response' and page_id is not null").select(
        F.col("page_id").alias("refers_to"), "digest", F.col("n_bytes").alias("_full")
    ).distinct()
    known = told.where("type = 'revisit'").join(stored, ["refers_to", "digest"], "left")
    revisits = known.select(
        "page_id", F.col("_full").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"), "refers_to",
    )
    responses = told.where("type = 'response'").select(
        "page_id", F.col("n_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"), "refers_to",
    )
    return responses.union(revisits)
