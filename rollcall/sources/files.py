"""Folders of resumes, zip archives and JSON results."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from rollcall.functions import files
from rollcall.operators.archives import Limits, accepted_members, check_limits
from rollcall.plans.scratch import exists, materialize
from rollcall.schemas import ARCHIVE_MEMBER, CANDIDATE

# Names of members to unpack that may be broadcast.
BROADCAST_CHARS = 32 << 20


def list_resumes(spark: SparkSession, folder: str) -> DataFrame:
    """Supported files directly in a folder, as (path, source_file, length, modified).

    Sorted by name. Spark skips names that begin with a dot or an underscore. The
    contents are not read.
    """
    found = spark.read.format("binaryFile").load(folder)
    return found.select(
        "path",
        files.leaf_name(F.col("path")).alias("source_file"),
        "length",
        F.col("modificationTime").alias("modified"),
    ).where(files.is_supported(F.col("source_file"))).orderBy("source_file")


def read_resumes(spark: SparkSession, folder: str, streaming: bool = False, **options) -> DataFrame:
    """(source_file, content) of the supported files; as a stream for arriving files."""
    if streaming:
        reader = spark.readStream.format("binaryFile").schema(
            "path string, modificationTime timestamp, length long, content binary"
        )
    else:
        reader = spark.read.format("binaryFile")
    found = reader.options(**options).load(folder)
    return found.select(files.leaf_name(F.col("path")).alias("source_file"), "content").where(
        files.is_supported(F.col("source_file"))
    )


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(archive, modified, content) of the zip files in a folder."""
    found = spark.read.format("binaryFile").load(folder)
    return found.where(F.lower("path").endswith(".zip")).select(
        F.col("path").alias("archive"), F.col("modificationTime").alias("modified"), "content"
    )


def list_members(archives: DataFrame) -> DataFrame:
    """Entries of each archive from its directory alone.

    A zip that cannot be read gives one null entry, an empty one a null entry at position -1.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for archive, content in zip(frame["archive"], frame["content"]):
                try:
                    entries = zipfile.ZipFile(io.BytesIO(content)).infolist()
                except Exception:  # whatever is wrong with one archive, the others go on
                    yield pd.DataFrame(
                        [(archive, None, None, None, None)], columns=ARCHIVE_MEMBER.names
                    )
                    continue
                rows = [
                    (archive, i, e.filename, e.file_size, e.compress_size)
                    for i, e in enumerate(entries)
                ] or [(archive, -1, None, None, None)]
                yield pd.DataFrame(rows, columns=ARCHIVE_MEMBER.names)

    return archives.select("archive", "content").mapInPandas(run, ARCHIVE_MEMBER)


def invalid_archives(members: DataFrame) -> DataFrame:
    reason = F.when(F.col("pos") == -1, "no supported files").otherwise("not a zip file")
    return members.where("member is null").select("archive", reason.alias("rejection"))


def rejected_archives(members: DataFrame, limits: Limits = Limits()) -> DataFrame:
    broken = check_limits(members.where("member is not null"), limits).where("rejection is not null")
    return broken.select("archive", "rejection").unionByName(invalid_archives(members))


def unpack_archives(archives: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Contents of the usable members of the archives that keep the limits.

    The limits are checked on the directories first, so a rejected archive is never
    expanded. Columns: archive, batch_id, idx, member, spool_name, content, and for a member
    that cannot be read an `error` and no content. Directories are parsed once; the names to
    unpack go to the archives, not the contents to the names, while they fit into a broadcast.
    """
    members = materialize(list_members(archives), "members").where("member is not null")
    wanted = accepted_members(members, limits)
    entry = F.struct("idx", "pos", "member", "spool_name")
    # As many entries as the limit on the count lets through.
    plan = wanted.groupBy("archive").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    plan = materialize(plan, "unpack-plan")
    size = plan.agg(F.sum(F.length("archive") + F.length(F.to_json("entries")))).first()[0] or 0
    plan = F.broadcast(plan) if size <= BROADCAST_CHARS else plan.hint("merge")
    batch = files.batch_key(F.col("archive"), F.col("modified"))
    joined = archives.withColumn("batch_id", batch).join(plan, "archive")
    schema = T.StructType(
        [
            T.StructField("archive", T.StringType()),
            T.StructField("batch_id", T.StringType()),
            T.StructField("idx", T.LongType()),
            T.StructField("member", T.StringType()),
            T.StructField("spool_name", T.StringType()),
            T.StructField("content", T.BinaryType()),
            T.StructField("error", T.StringType()),
        ]
    )
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema.fields])

    def read(archive: zipfile.ZipFile, entry: zipfile.ZipInfo) -> tuple[bytes | None, str | None]:
        try:
            return archive.read(entry), None
        except Exception as failure:  # whatever is wrong with one member, the others go on
            return None, f"unreadable member: {failure}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with zipfile.ZipFile(io.BytesIO(row["content"])) as archive:
                    entries = archive.infolist()
                    # One member at a time: only one is expanded in memory.
                    for e in row["entries"]:
                        values = [
                            row["archive"], row["batch_id"], e["idx"], e["member"],
                            e["spool_name"], *read(archive, entries[e["pos"]]),
                        ]
                        yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, values))], schema=arrow)

    return joined.select("archive", "batch_id", "content", "entries").mapInArrow(run, schema)


RESULT = T.StructType([f for f in CANDIDATE.fields if f.name not in ("id", "created_at")])


def read_results(spark: SparkSession, path: str, schema: T.StructType = RESULT) -> DataFrame:
    """Records of a JSON array; a missing, empty, broken or other file gives no rows.

    A resumable run can so always start. Whole files are parsed one per row; `json_arrays.read_array`
    reads large ones by blocks.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    whole = spark.read.text(path, wholetext=True).where(F.ltrim("value").startswith("["))
    # As the one element of a list: a parser would not look at what follows the array otherwise.
    wrapped = F.concat(F.lit("["), F.col("value"), F.lit("]"))
    parsed = whole.select(
        F.get(F.from_json(wrapped, T.ArrayType(T.ArrayType(schema))), F.lit(0)).alias("records"),
        F.try_parse_json(wrapped).alias("valid"),
    )
    rows = parsed.where("records is not null and valid is not null").select(F.explode("records").alias("r"))
    return rows.where("r is not null").select("r.*")


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType = RESULT) -> DataFrame:
    """Records written as JSON lines; none where nothing was written yet."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)
