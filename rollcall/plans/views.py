"""Inputs of the registered queries, derived from whole tables by plain arithmetic.

The given tables hold no person with a name, phone and email, so `candidates` gives each
customer a place in a block of twenty with a fixed story: repeats, shared phones, lost
emails, conflicts. `stored_candidates` gives suppliers the part of rows stored earlier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.functions.skills import TRADES

# Whose phone and email each row of a block of twenty carries.
PHONE_SLOTS = [0, 0, 0, None, None, 5, 6, 5, 8, 5, None, None, None, None, 14, 15, 16, 17, 18, 19]
EMAIL_SLOTS = [0, 0, None, 3, 3, 5, 6, 6, 5, None, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _slot(slots: list, r: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s).cast("int") for s in slots]), (r + 1).cast("int"))


def _digits(block: Column, slot: Column) -> Column:
    return ((block * 20 + slot) * 7919 + F.lit(2000000000)).cast("string")


def _formatted(digits: Column, style: Column) -> Column:
    layout = (
        F.when(style == 0, "($1) $2-$3")
        .when(style == 1, "$1-$2-$3")
        .when(style == 2, "$1$2$3")
        .otherwise("+1 $1 $2 $3")
    )
    return F.regexp_replace(digits, F.lit("^(...)(...)(....)$"), layout)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates_from(table(spark, sf_dir, "customer"))


def candidates_from(customer: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    q, r = F.expr("c_custkey div 20"), k % 20
    phone_slot, email_slot = _slot(PHONE_SLOTS, r), _slot(EMAIL_SLOTS, r)
    fictional = F.concat(F.lit("(918) 555-01"), F.lpad((q % 100).cast("string"), 2, "0"))
    phone = (
        F.when(r.isin(10, 11), "(555) 555-5555")
        .when(r == 12, fictional)
        .otherwise(_formatted(_digits(q, phone_slot), k % 4))
    )
    email = F.concat(F.lit("user"), (q * 20 + email_slot).cast("string"), F.lit("@example.com"))
    trades = F.array(*[F.lit(t) for t in TRADES])
    title = F.element_at(trades, (k % len(TRADES) + 1).cast("int"))
    neighbour = F.element_at(trades, ((k + 1) % len(TRADES) + 1).cast("int"))
    unknown = F.when(k % 5 == 0, F.array(F.lit("Unknown Trade"))).otherwise(F.array().cast("array<string>"))
    file_slot = F.when(r == 4, k - 1).otherwise(k)
    return customer.select(
        k.alias("id"),
        k.alias("seq"),
        F.when(r != 14, F.col("c_name")).alias("name"),
        title.alias("raw_title"),
        (k % 26).cast("int").alias("experience_years"),
        F.concat(F.array(F.upper(title), neighbour, F.lower(title)), unknown).alias("skills"),
        phone.alias("phone"),
        email.alias("email"),
        F.concat(F.lit("r"), file_slot.cast("string"), F.lit(".pdf")).alias("source_file"),
        F.concat(F.lit("b"), (q % 7).cast("string")).alias("batch_id"),
    )


def stored_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier j is a row stored for block j, in one of four relations to its writes."""
    j = F.col("s_suppkey")
    kind = j % 4
    slot = F.when(kind == 0, 0).when(kind == 1, 8).when(kind == 3, 14)
    digits = F.when(slot.isNotNull(), _digits(j, slot))
    email_slot = F.when(kind == 0, 0).when(kind == 1, 6).when(kind == 3, 15)
    return table(spark, sf_dir, "supplier").select(
        j.alias("id"),
        F.col("s_name").alias("name"),
        F.lit("Welder").alias("raw_title"),
        F.lit(1).alias("experience_years"),
        F.array(F.lit("Welder")).alias("skills"),
        digits.alias("phone"),
        digits.alias("phone_normalized"),
        F.concat(F.lit("user"), (j * 20 + email_slot).cast("string"), F.lit("@example.com")).alias("email"),
        F.when(kind == 2, F.concat(F.lit("r"), (j * 20 + 3).cast("string"), F.lit(".pdf")))
        .otherwise(F.concat(F.lit("s"), j.cast("string"), F.lit(".pdf")))
        .alias("source_file"),
        F.when(kind == 2, F.concat(F.lit("b"), (j % 7).cast("string"))).otherwise("seed").alias("batch_id"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("created_at"),
    )


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the entries of one archive per source."""
    d = F.col("doc_id")
    n = d.cast("string")
    shapes = [
        F.concat(F.lit("cv/"), n, F.lit(".pdf")),
        F.concat(n, F.lit(".PDF")),
        F.concat(F.lit("cv/"), n, F.lit(".docx")),
        F.concat(n, F.lit(".txt")),
        F.concat(n, F.lit(".png")),
        F.concat(F.lit("__MACOSX/"), n, F.lit(".pdf")),
        F.concat(F.lit("cv/."), n, F.lit(".txt")),
        F.concat(n, F.lit(".exe")),
        F.concat(F.lit("cv/"), n, F.lit("/")),
    ]
    packed = F.expr("n_chars div (1 + doc_id % 120)")
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("archive"),
        d.alias("pos"),
        F.element_at(F.array(*shapes), (d % 9 + 1).cast("int")).alias("member"),
        F.col("n_chars").alias("file_size"),
        F.when(d % 50 == 0, 0).otherwise(packed).cast("long").alias("compress_size"),
    )


# What each kind of event says of a task.
EVENT_STATES = {"purchase": "SUCCESS", "error": "FAILURE", "view": "RETRY", "click": "CLICKED"}


def task_events(events: DataFrame) -> DataFrame:
    """Events as task reports: a user is a batch, `props.k` names one of its files."""
    states = [F.lit(part) for pair in EVENT_STATES.items() for part in pair]
    return events.select(
        F.concat(F.lit("b"), F.col("user_id").cast("string")).alias("batch_id"),
        F.col("event_id").alias("pos"),
        F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("task_id"),
        F.concat(F.lit("f"), F.get_json_object("props", "$.k")).alias("file"),
        F.element_at(F.create_map(*states), F.col("event_type")).alias("state"),
        F.when(F.col("event_type") == "error", "PermanentExtractionError").alias("error_class"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def manifest_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as manifests of two files each, some cut off and some without a batch."""
    e, batch = F.col("event_id"), F.col("user_id").cast("string")
    first = F.concat(F.lit('{"task_id": "t'), e.cast("string"), F.lit('", "file": "f'), F.get_json_object("props", "$.k"))
    listed = F.concat(F.lit('"files": ['), first, F.lit('"}, {"task_id": "u'), e.cast("string"), F.lit('", "file": null}]'))
    payload = (
        F.when(e % 5 == 0, F.concat(F.lit('{"batch_id": "b'), batch, F.lit('", "files": [')))
        .when(e % 5 == 1, F.concat(F.lit("{"), listed, F.lit("}")))
        .otherwise(F.concat(F.lit('{"batch_id": "b'), batch, F.lit('", '), listed, F.lit("}")))
    )
    return table(spark, sf_dir, "events").select(payload.alias("payload"))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as extractor replies, valid and broken in seven ways."""
    e = F.col("event_id")
    k = F.get_json_object("props", "$.k")
    years = (
        F.when(e % 9 == 1, F.concat(F.lit('"'), k, F.lit('"')))
        .when(e % 9 == 2, F.concat(k, F.lit(".5")))
        .when(e % 9 == 3, F.lit("null"))
        .when(e % 9 == 4, F.lit('"many"'))
        .otherwise(k)
    )
    skills = (
        F.when(e % 9 == 5, F.lit("[1]"))
        .when(e % 9 == 6, F.lit("[]"))
        .otherwise(F.lit('["welder ", "Juggler", "PLUMBER", "Welder"]'))
    )
    body = F.concat(
        F.lit('{"name": "User '), F.col("user_id").cast("string"),
        F.lit('", "raw_title": "'), F.col("event_type"),
        F.lit('", "experience_years": '), years,
        F.lit(', "phone": null, "email": null'),
        F.when(e % 9 == 7, F.lit("")).otherwise(F.concat(F.lit(', "skills": '), skills)),
        F.when(e % 9 == 8, F.lit("")).otherwise(F.lit("}")),
    )
    return table(spark, sf_dir, "events").select(
        e.alias("event_id"),
        body.alias("reply"),
        F.lit(None).cast("string").alias("error_class"),
        F.lit(None).cast("string").alias("message"),
    )
