"""Zip archives of any size, read by byte ranges.

Only paths travel. The directory of an archive is read from its end; members that pass the limits
are dealt by archive and position, and each is read at its own offset. So no row holds an archive, and
a task holds one member at a time.
"""

from __future__ import annotations

import struct
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.functions import files
from rollcall.operators.archives import Limits, accepted_members
from rollcall.plans.scratch import materialize
from rollcall.schemas import ARCHIVE_MEMBER
from rollcall.sources.paths import located

PLACED = T.StructType(
    [
        *ARCHIVE_MEMBER.fields,
        T.StructField("header", T.LongType()),
        T.StructField("method", T.IntegerType()),
        T.StructField("crc", T.LongType()),
        T.StructField("encrypted", T.BooleanType()),
    ]
)
UNPACKED = "archive string, batch_id string, idx long, member string, spool_name string, content binary, error string"
LOCAL_HEADER = 30
PIECE = 1 << 20


def archive_paths(spark: SparkSession, folder: str) -> DataFrame:
    """(archive, modified, length) of the zip files in a folder; contents are not read."""
    found = spark.read.format("binaryFile").load(folder).where(F.lower("path").endswith(".zip"))
    return found.select(F.col("path").alias("archive"), F.col("modificationTime").alias("modified"), "length")


class Seekable:
    """A file whose seeks fail as those of Python's files do, which is what zipfile expects."""

    def __init__(self, file):
        self.file, self.size = file, file.size()

    def seek(self, offset: int, whence: int = 0) -> int:
        place = offset + (0, self.file.tell(), self.size)[whence]
        if place < 0:
            raise OSError("a place before the file")
        self.file.seek(place)
        return place

    def __getattr__(self, name: str):
        return getattr(self.file, name)


def directories(archives: DataFrame) -> DataFrame:
    """Entries of each archive with their places, read from the end of the file.

    An archive that cannot be read gives one null entry, an empty one a null entry at position -1.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for archive in frame["archive"]:
                try:
                    system, path = located(archive)
                    with system.open_input_file(path) as file, zipfile.ZipFile(Seekable(file)) as whole:
                        entries = whole.infolist()
                except Exception:  # whatever is wrong with one archive, the others go on
                    yield pd.DataFrame([(archive, *[None] * 8)], columns=PLACED.names)
                    continue
                rows = [
                    (archive, i, e.filename, e.file_size, e.compress_size, e.header_offset, e.compress_type, e.CRC, bool(e.flag_bits & 1))
                    for i, e in enumerate(entries)
                ] or [(archive, -1, *[None] * 7)]
                yield pd.DataFrame(rows, columns=PLACED.names)

    return archives.select("archive").mapInPandas(run, PLACED)


def read_member(file, header: int, method: int, compress_size: int, file_size: int, crc: int) -> bytes:
    """One member at its offset; raises ValueError or zlib.error if it is not what the directory says."""
    file.seek(header)
    head = file.read(LOCAL_HEADER)
    if len(head) < LOCAL_HEADER or head[:4] != b"PK\x03\x04":
        raise ValueError("no member at its offset")
    name, extra = struct.unpack("<HH", head[26:30])
    file.seek(header + LOCAL_HEADER + name + extra)
    if method == zipfile.ZIP_STORED:
        content = file.read(compress_size)
    elif method == zipfile.ZIP_DEFLATED:
        # Never more than one byte beyond what the directory says is expanded.
        unpacker, parts, left, size = zlib.decompressobj(-15), [], compress_size, 0
        while left > 0 and size <= file_size:
            piece = file.read(min(PIECE, left))
            if not piece:
                raise ValueError("the archive is cut off")
            left -= len(piece)
            parts.append(unpacker.decompress(piece, file_size + 1 - size))
            size += len(parts[-1])
        content = b"".join(parts)
    else:
        raise ValueError(f"compression method {method}")
    if len(content) != file_size or zlib.crc32(content) != crc:
        raise ValueError("the member is not as its directory says")
    return content


def read_members(wanted: DataFrame) -> DataFrame:
    """Contents of members, or an `error` for those that cannot be read.

    `wanted` holds archive, batch_id, idx, member, spool_name and the place of each member. Tasks get
    ranges of archive and offset, so that each reads its archives from front to back.
    """
    arrow = pa.schema([("archive", pa.string()), ("batch_id", pa.string()), ("idx", pa.int64()), ("member", pa.string()),
                       ("spool_name", pa.string()), ("content", pa.binary()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, file = None, None
        for batch in batches:
            for row in batch.to_pylist():
                content = error = None
                try:
                    if opened != row["archive"]:
                        system, path = located(row["archive"])
                        opened, file = None, system.open_input_file(path)
                        opened = row["archive"]
                    if row["encrypted"]:
                        raise ValueError("the member is encrypted")
                    content = read_member(file, *[row[c] for c in ("header", "method", "compress_size", "file_size", "crc")])
                except Exception as failure:  # whatever is wrong with one member, the others go on
                    error = f"unreadable member: {failure}"
                values = [row[c] for c in ("archive", "batch_id", "idx", "member", "spool_name")]
                yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, [*values, content, error], strict=True))], schema=arrow)

    dealt = wanted.repartitionByRange("archive", "header").sortWithinPartitions("archive", "header")
    return dealt.mapInArrow(run, UNPACKED)


def unpack_by_range(spark: SparkSession, folder: str, limits: Limits = Limits()) -> DataFrame:
    """Contents of the usable members of the archives of a folder that keep the limits.

    The same columns as `files.unpack_archives`. The limits are checked on the directories alone.
    """
    archives = archive_paths(spark, folder)
    members = materialize(directories(archives), "directories").where("member is not null")
    accepted = accepted_members(members.select(*ARCHIVE_MEMBER.names), limits)
    chosen = accepted.select("archive", "pos", "idx", "member", "spool_name").join(members.drop("member"), ["archive", "pos"])
    batch = files.batch_key(F.col("archive"), F.col("modified"))
    named = archives.select("archive", batch.alias("batch_id"))
    return read_members(materialize(chosen.join(named, "archive"), "members-to-read"))
