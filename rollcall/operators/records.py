"""From files to validated records: extractor replies, their checks and the failures."""

from __future__ import annotations

import json
import multiprocessing
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions import files
from rollcall.functions.outcomes import error_kind
from rollcall.functions.phones import normalize_phone
from rollcall.functions.skills import normalize_skills

REPLY_KEYS = ["name", "raw_title", "experience_years", "phone", "email", "skills"]
TEXT_KEYS = ["name", "raw_title", "phone", "email"]

PERMANENT = "PermanentExtractionError"
TRANSIENT = "TransientExtractionError"

# Patterns of the built-in extractor.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
PHONE = r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-]?)[0-9]{3}[ .-]?[0-9]{4}"
YEARS = r"([0-9]{1,2})\+? years"


class TransientError(Exception):
    """Raised by an extractor for a failure that may pass."""


class PermanentError(Exception):
    """Raised by an extractor for a failure that will not pass."""


class ServiceError(Exception):
    """Raised by an extractor for an answer of the service it calls.

    Its code and status decide whether it may pass; `server` marks the service's own faults.
    """

    def __init__(self, message: str, code: int | None = None, status: str | None = None, server: bool = False):
        super().__init__(message)
        self.code, self.status, self.server = code, status, server


# (file name, MIME type or None for text, text or bytes) -> JSON reply
Extractor = Callable[[str, str | None, str | bytes], str]

CALL_SECONDS = 120.0


class Caller:
    """Runs an extractor in a child process, which is ended if a call takes too long.

    One child serves the calls of a task until one of them is late; then the next call starts another.
    """

    def __init__(self, extractor: Extractor, seconds: float):
        self.extractor, self.seconds = extractor, seconds
        self.child, self.pipe = None, None

    def _serve(self, pipe) -> None:
        while True:
            try:
                arguments = pipe.recv()
            except EOFError:
                return
            try:
                pipe.send((self.extractor(*arguments), None))
            except Exception as failure:
                pipe.send((None, (*cause(failure), str(failure))))

    def __call__(self, *arguments) -> tuple:
        """(reply, kind, code, status, message), as `cause` tells failures apart."""
        if self.child is None:
            forked = multiprocessing.get_context("fork")
            self.pipe, other = forked.Pipe()
            self.child = forked.Process(target=self._serve, args=(other,), daemon=True)
            self.child.start()
            other.close()
        try:
            self.pipe.send(arguments)
            if not self.pipe.poll(self.seconds):
                self.end()
                return None, "network", None, None, f"no answer within {self.seconds:g} seconds"
            reply, failure = self.pipe.recv()
        except (EOFError, BrokenPipeError) as broken:
            self.end()
            return None, "other", None, None, f"the extractor ended: {broken!r}"
        return (None, *failure) if failure else (reply, None, None, None, None)

    def end(self) -> None:
        if self.child is not None:
            self.child.kill()
            self.child.join()
            self.pipe.close()
            self.child = None


def cause(failure: BaseException) -> tuple[str, int | None, str | None]:
    """(kind, code, status) of a failure, as `error_kind` takes them."""
    if isinstance(failure, ServiceError):
        return "server" if failure.server else "api", failure.code, failure.status
    if isinstance(failure, (TransientError, TimeoutError, ConnectionError)):
        return "network", None, None
    return "other", None, None


def call_extractor(
    documents: DataFrame,
    extractor: Extractor,
    keep_content: bool = False,
    seconds: float = CALL_SECONDS,
) -> DataFrame:
    """Run the extractor on `source_file, content`, one attempt per file.

    Adds `reply`, or `error_class` and `message` where it failed. Unsupported formats
    fail without a call. Word documents are passed on as bytes with their type, not decoded.
    A call that takes longer than `seconds` is a time-out. Time-outs and connection failures are
    transient like TransientError, answers of a service by code and status, anything else is
    permanent.
    """
    routed = documents.select(
        "*",
        files.route(F.col("source_file")).alias("_route"),
        F.when(files.suffix(F.col("source_file")) == ".docx", files.DOCX_TYPE)
        .otherwise(files.mime_type(F.col("source_file")))
        .alias("_mime"),
        F.when(
            files.suffix(F.col("source_file")) == ".txt", files.decode_text(F.col("content"))
        ).alias("_text"),
    )
    passed = [c for c in documents.columns if keep_content or c != "content"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema if f.name in passed)

    def attempt(call, name, route, mime, text, content):
        if route == "unsupported":
            return None, "other", None, None, "unsupported file type"
        body = text if mime is None else content
        if body is None:
            return None, "other", None, None, "no content"
        return call(name, mime, body if mime is None else bytes(body))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = Caller(extractor, seconds)
        try:
            for frame in frames:
                results = [
                    attempt(call, *row)
                    for row in zip(
                        frame["source_file"], frame["_route"], frame["_mime"], frame["_text"], frame["content"]
                    )
                ]
                told = pd.DataFrame(
                    results, columns=["reply", "_kind", "_code", "_status", "message"], index=frame.index, dtype=object
                )
                yield pd.concat([frame[passed], told], axis=1)
        finally:
            call.end()

    tried = routed.mapInPandas(
        run, f"{fields}, reply string, _kind string, _code int, _status string, message string"
    )
    transient = error_kind(F.col("_kind"), F.col("_code"), F.col("_status")) == "transient"
    error_class = F.when(F.col("_kind").isNotNull(), F.when(transient, TRANSIENT).otherwise(PERMANENT))
    return tried.select(*passed, "reply", error_class.alias("error_class"), "message")


REPLY_TYPE = f"array<struct<{', '.join(f'{key}: variant' for key in REPLY_KEYS)}>>"


def parse_replies(df: DataFrame, reply: str = "reply", record: str = "record") -> DataFrame:
    """Add the record of a valid reply, or null.

    All six keys are required. The four texts are a string or null, the years a whole
    number, such a number as text, a flag, or null, and the skills a list of strings.

    A reply is read once, as the one element of a list, since a parser stops at the end
    of an object but not of a list that something else follows in. A key with a JSON null
    has the type VOID, a missing one none.
    """
    wrapped = F.concat(F.lit("["), F.col(reply), F.lit("]"))
    kinds = F.struct(*[F.schema_of_variant(f"_parsed.{key}").alias(key) for key in REPLY_KEYS])
    prepared = (
        df.withColumn("_list", F.from_json(wrapped, REPLY_TYPE))
        .withColumn("_parsed", F.when(F.size("_list") == 1, F.get("_list", F.lit(0))))
        .withColumn("_kinds", kinds)
        .withColumn("_written", F.try_variant_get("_parsed.experience_years", "$", "string"))
        .withColumn("_skills", F.try_variant_get("_parsed.skills", "$", "array<string>"))
    )
    number = F.regexp_extract(F.trim("_written"), r"^([+-]?[0-9]+)(\.0*)?$", 1)
    flag = F.when(F.col("_written") == "true", 1).otherwise(0)
    years = F.when(F.col("_kinds.experience_years") == "BOOLEAN", flag).otherwise(
        F.nullif(number, F.lit("")).try_cast("int")
    )
    valid = (
        ((F.col("_kinds.experience_years") == "VOID") | F.col("_years").isNotNull())
        & F.col("_kinds.skills").isin("ARRAY<STRING>", "ARRAY<VOID>")
        & F.forall("_skills", lambda s: s.isNotNull())
    )
    for key in TEXT_KEYS:
        valid = valid & F.col(f"_kinds.{key}").isin("STRING", "VOID")

    def text(key: str) -> Column:
        return F.try_variant_get(f"_parsed.{key}", "$", "string").alias(key)

    found = F.struct(
        text("name"),
        text("raw_title"),
        F.col("_years").alias("experience_years"),
        text("phone"),
        text("email"),
        normalize_skills(F.col("_skills")).alias("skills"),
    )
    return prepared.withColumn("_years", years).select(
        *df.columns, F.when(F.coalesce(valid, F.lit(False)), found).alias(record)
    )


def validate_replies(replies: DataFrame) -> DataFrame:
    """Add `record`; a reply that does not parse becomes a permanent error."""
    parsed = parse_replies(replies)
    bad = F.col("error_class").isNull() & F.col("record").isNull()
    return (
        parsed.withColumn("message", F.when(bad, "unparseable reply").otherwise(F.col("message")))
        .withColumn("error_class", F.when(bad, PERMANENT).otherwise(F.col("error_class")))
        .drop("reply")
    )


def records(validated: DataFrame) -> DataFrame:
    """Only complete records; a failed file never gives an empty one."""
    rest = [c for c in validated.columns if c not in ("record", "error_class", "message")]
    return validated.where(F.col("record").isNotNull()).select(*rest, "record.*")


def failures(validated: DataFrame) -> DataFrame:
    """Failed files with their message, for a table of restricted access."""
    return validated.where(F.col("record").isNull()).drop("record")


def public_failures(dead: DataFrame) -> DataFrame:
    """Failures as they may be shown: the class of the error, not its message."""
    return dead.drop("message")


def contact_extractor(name: str, mime: str | None, content: str | bytes) -> str:
    """The patterns of `extract_contacts` as an Extractor: the first email, phone and years."""
    if isinstance(content, bytes):
        raise PermanentError("only plain text can be read without a service")
    email, number, years = (re.search(p, content) for p in (EMAIL, PHONE, YEARS))
    return json.dumps(
        {
            "name": None,
            "raw_title": None,
            "experience_years": int(years[1]) if years else None,
            "phone": number[0] if number else None,
            "email": email[0] if email else None,
            "skills": [],
        }
    )


def extract_contacts(documents: DataFrame, text: str = "text") -> DataFrame:
    """Built-in extractor: contacts and years found by patterns in the whole text."""
    body = F.col(text)
    # Few texts have an @ at all, and looking for one is much cheaper than the pattern.
    emails = F.when(
        F.contains(body, F.lit("@")), F.regexp_extract_all(body, F.lit(EMAIL), F.lit(0))
    ).otherwise(F.array().cast("array<string>"))
    numbers = F.regexp_extract_all(body, F.lit(PHONE), F.lit(0))
    found = documents.withColumn("_emails", emails).withColumn("_numbers", numbers)
    keys = F.filter(F.transform(F.col("_numbers"), normalize_phone), lambda key: key.isNotNull())
    return found.select(
        *[c for c in documents.columns if c != text],
        F.get("_emails", F.lit(0)).alias("email"),
        F.size("_emails").alias("n_emails"),
        F.get("_numbers", F.lit(0)).alias("phone"),
        F.get(keys, F.lit(0)).alias("phone_normalized"),
        F.size("_numbers").alias("n_phones"),
        F.nullif(F.regexp_extract(body, YEARS, 1), F.lit("")).try_cast("int").alias("experience_years"),
    )
