"""Data-quality jobs: per-row validators of the shop re-aimed at whole tables
(Q1-Q5, F8 rating report).

Every job returns rows that name what is wrong; summaries are plain
aggregates over those rows.  Duplicate detection aggregates per e-mail
first and joins the counts back (a hot e-mail shared by a third of a batch
is collapsed map-side instead of being gathered into one window task).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelake.functions.parse import complaint_rating, complaint_text
from storelake.schema import FOREIGN_KEYS, NOT_NULL, ROLES
from storelake.sources.model import Tables

# Validation patterns of the registration form.
EMAIL_PATTERN = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
PHONE_STRIP = r"[\s\-+()]"
PHONE_DIGITS = r"^\d{7,15}$"

RULES = ("name_required", "email_required", "email_invalid", "phone_required", "phone_invalid")


def broken_rules() -> "F.Column":
    """Array of the registration rules that a row (name, email, phone) breaks."""
    name = F.trim(F.coalesce("name", F.lit("")))
    email = F.trim(F.coalesce("email", F.lit("")))
    phone = F.trim(F.coalesce("phone", F.lit("")))
    digits = F.regexp_replace(phone, PHONE_STRIP, "")
    checks = F.array(
        F.when(name == "", F.lit("name_required")),
        F.when(email == "", F.lit("email_required")),
        F.when((email != "") & ~email.rlike(EMAIL_PATTERN), F.lit("email_invalid")),
        F.when(phone == "", F.lit("phone_required")),
        F.when((phone != "") & ~digits.rlike(PHONE_DIGITS), F.lit("phone_invalid")),
    )
    return F.filter(checks, lambda c: c.isNotNull())


def registration_audit(batch: DataFrame) -> DataFrame:
    """Q1: for each registration row the broken rules, '; '-joined, and their count."""
    broken = broken_rules()
    return batch.select("request_id", F.array_join(broken, "; ").alias("errors"),
                        F.size(broken).alias("n_errors"))


def registration_audit_summary(batch: DataFrame) -> DataFrame:
    """Q1 summary: rows breaking each rule."""
    audit = registration_audit(batch)
    rules = audit.select(F.explode(F.split("errors", "; ")).alias("rule")).where(F.col("rule") != "")
    return rules.groupBy("rule").agg(F.count(F.lit(1)).alias("n_rows"))


def duplicate_emails(t: Tables, batch: DataFrame) -> DataFrame:
    """Q2: per registration row whether its (trimmed) e-mail is taken already and
    how often it occurs in the batch."""
    batch = batch.withColumn("email", F.trim("email"))
    per_email = batch.groupBy("email").agg(F.count(F.lit(1)).alias("batch_count"))
    taken = t.users.select(F.trim("email").alias("email")).distinct().withColumn("already_taken", F.lit(True))
    flagged = (batch.select("request_id", "email")
               .join(per_email, "email", "left")
               .join(taken, "email", "left"))
    return flagged.select(
        "request_id", "email",
        F.coalesce("already_taken", F.lit(False)).alias("already_taken"),
        F.col("batch_count").cast("bigint").alias("batch_count"),
        (F.coalesce("already_taken", F.lit(False)) | (F.col("batch_count") > 1)).alias("duplicate"))


def image_format(image) -> "F.Column":
    """Q3: MIME type from the magic bytes; unknown bytes are served as JPEG."""
    head = F.hex(F.substring(image, 1, 12))
    return (F.when(image.isNull() | (F.length(image) == 0), F.lit("none"))
             .when(head.startswith("89504E470D0A1A0A"), F.lit("png"))
             .when(head.startswith("FFD8FF"), F.lit("jpeg"))
             .when(head.startswith("474946383761") | head.startswith("474946383961"), F.lit("gif"))
             .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"),
                   F.lit("webp"))
             .otherwise(F.lit("jpeg")))


def image_formats(t: Tables) -> DataFrame:
    """Q3: count and bytes of stored images per detected format."""
    typed = t.items.select(image_format(F.col("image")).alias("format"),
                           F.coalesce(F.length("image"), F.lit(0)).alias("n_bytes"))
    return typed.groupBy("format").agg(F.count(F.lit(1)).alias("n_items"),
                                       F.sum("n_bytes").cast("bigint").alias("total_bytes"))


def fk_audit(t: Tables) -> DataFrame:
    """Q4: violations per declared foreign key, NOT NULL column and the unique
    e-mail.

    The references of all foreign keys pointing at the same parent are
    unioned (tagged by foreign key) and checked with one ``left_anti`` join
    per parent, then counted per tag: one shuffle of each parent table
    instead of one per foreign key.  NULL references are allowed (as in SQL)
    and are filtered out before the shuffle.
    """
    tables = t.as_dict()
    by_parent: dict[tuple[str, str], list[DataFrame]] = {}
    for child, col, parent, pcol in FOREIGN_KEYS:
        tag = f"{child}.{col}"
        # counted per key first: a hot variant is one row per task from here on
        refs = (tables[child].where(F.col(col).isNotNull()).groupBy(F.col(col).alias("_k"))
                .agg(F.count(F.lit(1)).alias("_n")).withColumn("_fk", F.lit(tag)))
        by_parent.setdefault((parent, pcol), []).append(refs)
    orphans = []
    for (parent, pcol), refs in by_parent.items():
        keys = tables[parent].select(F.col(pcol).alias("_k"))
        orphans.append(reduce(DataFrame.unionByName, refs).join(keys, "_k", "left_anti"))
    counts = reduce(DataFrame.unionByName, orphans).groupBy("_fk").agg(
        F.sum("_n").alias("_n"))
    declared = t.users.sparkSession.createDataFrame(
        [(f"{c}.{col}", c, col, f"{p}.{pc}") for c, col, p, pc in FOREIGN_KEYS],
        "_fk string, table_name string, column_name string, reference string")
    parts = [declared.join(counts, "_fk", "left").select(
        F.lit("foreign_key").alias("check"), "table_name", "column_name", "reference",
        F.coalesce("_n", F.lit(0)).cast("bigint").alias("violations"))]
    # NOT NULL: one pass per table counts the NULLs of all its checked columns
    by_table: dict[str, list[str]] = {}
    for table, col in NOT_NULL:
        by_table.setdefault(table, []).append(col)
    for table, cols in by_table.items():
        counts_row = tables[table].agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c)
                                         for c in cols])
        per_col = counts_row.unpivot([], cols, "column_name", "violations")
        parts.append(per_col.select(
            F.lit("not_null").alias("check"), F.lit(table).alias("table_name"), "column_name",
            F.lit("").alias("reference"), F.col("violations").cast("bigint").alias("violations")))
    dup = (t.users.groupBy("email").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
           .agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations")))
    parts.append(dup.select(F.lit("unique").alias("check"), F.lit("users").alias("table_name"),
                            F.lit("email").alias("column_name"), F.lit("").alias("reference"),
                            F.col("violations").cast("bigint").alias("violations")))
    return reduce(DataFrame.unionByName, parts)


def normalized_role() -> "F.Column":
    r = F.lower(F.trim("role"))
    return F.when(r.isin(*ROLES), r).otherwise(F.lit("customer"))


def normalize_roles(batch: DataFrame) -> DataFrame:
    """Q5: role lower-cased and trimmed; anything unknown becomes 'customer'."""
    return batch.select("request_id", "role", normalized_role().alias("normalized_role"))


def complaint_ratings(t: Tables) -> DataFrame:
    """F8: complaints per (status, rating) with the average text length."""
    parsed = t.complaint.select("status", complaint_rating(F.col("message")).alias("rating"),
                                F.length(complaint_text(F.col("message"))).alias("text_len"))
    return parsed.groupBy("status", "rating").agg(F.count(F.lit(1)).alias("n_complaints"),
                                                  F.avg("text_len").alias("avg_text_len"))
