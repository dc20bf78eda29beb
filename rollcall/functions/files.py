"""File names, formats and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats passed on as bytes with their MIME type, and as text.
MIME_TYPES = {
    ".pdf": "application/pdf",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".png": "image/png",
}
DOCX_TYPE = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
TEXT_EXTENSIONS = [".docx", ".txt"]
SUPPORTED_EXTENSIONS = [*MIME_TYPES, *TEXT_EXTENSIONS]

CACHE_PREFIX = "search:v1:"


def leaf_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """Lower-cased suffix with its dot; empty for none and for a bare `.pdf`."""
    return F.lower(F.regexp_extract(leaf_name(path), r"(?s)^.+(\.[^.]+)$", 1))


def is_supported(path: Column) -> Column:
    return suffix(path).isin(SUPPORTED_EXTENSIONS)


def is_candidate_entry(name: Column) -> Column:
    """Archive entries worth reading: no directories, hidden files or other formats."""
    leaf = leaf_name(name)
    known = F.lit(False)
    for extension in SUPPORTED_EXTENSIONS:
        known = known | F.endswith(F.lower(leaf), F.lit(extension))
    return (
        ~F.startswith(name, F.lit("__MACOSX"))
        & ~F.endswith(name, F.lit("/"))
        & (leaf != "")
        & ~F.startswith(leaf, F.lit("."))
        & known
    )


def mime_type(path: Column) -> Column:
    pairs = [F.lit(part) for pair in MIME_TYPES.items() for part in pair]
    return F.element_at(F.create_map(*pairs), suffix(path))


def route(path: Column) -> Column:
    """`text`, `binary` or `unsupported`."""
    extension = suffix(path)
    return (
        F.when(extension.isin(TEXT_EXTENSIONS), "text")
        .when(extension.isin(list(MIME_TYPES)), "binary")
        .otherwise("unsupported")
    )


def decode_text(content: Column) -> Column:
    """Bytes as UTF-8 with invalid sequences replaced."""
    return F.make_valid_utf8(content.cast("string"))


def spool_name(position: Column, name: Column) -> Column:
    """Generated name, so an entry's own path is never used. Longer numbers are never cut."""
    return F.when(position.isNotNull(), F.format_string("%05d%s", position.cast("long"), suffix(name)))


def compression_ratio(file_size: Column, compress_size: Column) -> Column:
    """Null for a stored empty entry, which no ratio rule applies to."""
    return F.try_divide(file_size.cast("double"), compress_size.cast("double"))


def cache_key(query: Column, limit: Column) -> Column:
    text = F.concat(query, F.lit("\x00"), limit.cast("string"))
    return F.concat(F.lit(CACHE_PREFIX), F.sha2(text, 256))


def batch_key(path: Column, modified: Column) -> Column:
    """The same upload always gets the same batch id, so a re-run repeats no work."""
    return F.sha2(F.concat_ws("\x00", path, modified.cast("string")), 256)


def vector_to_text(vector: Column) -> Column:
    return F.to_json(vector)


def text_to_vector(text: Column) -> Column:
    return F.from_json(text, "array<float>")


def email_local_part(first: Column, last: Column) -> Column:
    return F.concat(F.lower(first), F.lit("."), F.replace(F.lower(last), F.lit("'"), F.lit("")))
