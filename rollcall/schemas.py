"""Schemas of the tables the package reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

EMBEDDING_DIMENSIONS = 384

# What one document yields, before it is given an identity.
RECORD = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("raw_title", T.StringType()),
        T.StructField("experience_years", T.IntegerType()),
        T.StructField("phone", T.StringType()),
        T.StructField("email", T.StringType()),
        T.StructField("skills", T.ArrayType(T.StringType())),
    ]
)

# The columns an accepted write replaces. `id` and `created_at` outlive updates.
WRITTEN_COLUMNS = [
    "name",
    "raw_title",
    "experience_years",
    "skills",
    "phone",
    "phone_normalized",
    "email",
    "embedding",
    "source_file",
    "batch_id",
]

CANDIDATE = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("raw_title", T.StringType()),
        T.StructField("experience_years", T.IntegerType()),
        T.StructField("skills", T.ArrayType(T.StringType())),
        T.StructField("phone", T.StringType()),
        T.StructField("phone_normalized", T.StringType()),
        T.StructField("email", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("source_file", T.StringType()),
        T.StructField("batch_id", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

ARCHIVE_MEMBER = T.StructType(
    [
        T.StructField("archive", T.StringType()),
        T.StructField("pos", T.LongType()),
        T.StructField("member", T.StringType()),
        T.StructField("file_size", T.LongType()),
        T.StructField("compress_size", T.LongType()),
    ]
)

MANIFEST = T.StructType(
    [
        T.StructField("batch_id", T.StringType()),
        T.StructField(
            "files",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("task_id", T.StringType()),
                        T.StructField("file", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)
