"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package's modules to the Python workers, once per application:
    they need not have it installed or on their path."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="storelake-")     # the driver serves the file from here to every executor
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "storelake.zip")
    with zipfile.ZipFile(path, "w") as z:
        for top, _, names in os.walk(root):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(top, name)
                z.write(full, os.path.join("storelake", os.path.relpath(full, root)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, modulus: int) -> Column:
    """crc32 of the id's text modulo ``modulus`` (a null id counts as remainder 0)."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string")), F.lit(modulus)), F.lit(0))


def labels_of(labels: DataFrame, kind: str) -> DataFrame:
    """One 0/1 label per doc_id: rows without id or label are left out, and
    where rows of one id disagree the higher label holds."""
    return (labels.select("doc_id", F.col(kind).cast("int").alias("label"))
            .where("doc_id IS NOT NULL AND label IN (0, 1)")
            .groupBy("doc_id").agg(F.max("label").alias("label")))


def label_sample(labels: DataFrame, kind: str, per_class: int) -> DataFrame:
    """At most ``per_class`` labelled training ids of each class.

    Only ids whose crc32 modulo 5 is not 0 take part; which of them is decided
    by a hash of the id, so the choice does not depend on partitioning.  The
    result has at most 2 * per_class rows of 12 bytes: small enough to broadcast.
    """
    known = labels_of(labels, kind).where(fold("doc_id", 5) != 0)
    parts = [known.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id")
             .limit(per_class) for c in (0, 1)]
    return parts[0].unionByName(parts[1])


def sampled_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """(doc_id, label, text): one text for each sampled id that ``docs`` has, whatever number of rows the id has
    there (the text of the least hash; a null text only if there is no other).

    ``sample`` comes from ``label_sample``, so the result has at most as many rows.
    """
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    by_hash = F.struct(F.col("text").isNull().alias("none"), F.xxhash64("text").alias("h"), "text")
    return (rows.groupBy("doc_id", "label").agg(F.min(by_hash).alias("first"))
            .select("doc_id", "label", F.col("first.text").alias("text")))


def with_fields(df: DataFrame, *fields: tuple[str, T.DataType]) -> T.StructType:
    """Schema of ``df`` with more fields behind."""
    return T.StructType(list(df.schema.fields) + [T.StructField(n, t) for n, t in fields])
