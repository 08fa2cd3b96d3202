"""Sources and sinks beyond the model scan.

* ``param_sql``: ad-hoc parameterised SELECT over the shop tables.
* ``export_sales_csv``: the back-office order export as CSV with a header.
* ``load_images``: image bytes from ``data:image`` URIs and from files.
* ``write_user_profiles``: one JSON document per user (profile, order
  statistics and order history).

Writers always target a folder under the shared checkpoint folder (or a
path the caller passes) and never a machine-local temporary folder.
"""

from __future__ import annotations

import errno
import os
import re
import stat
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storelake.operators.joins import NULL_SALTS
from storelake.operators.orders import all_orders
from storelake.operators.reports import user_order_stats
from storelake.session import local_folder, materialize, scratch_dir, settings
from storelake.sources.model import Tables

# Header of the order export.
EXPORT_HEADER = ("Order ID", "Date", "Customer ID", "Total Price", "Status", "Payment Method")
EXPORT_SCHEMA = T.StructType([
    T.StructField("Order ID", T.LongType()), T.StructField("Date", T.StringType()),
    T.StructField("Customer ID", T.LongType()), T.StructField("Total Price", T.DoubleType()),
    T.StructField("Status", T.StringType()), T.StructField("Payment Method", T.StringType()),
])


FILE_SCHEMA = "path string, content binary"


def param_sql(spark: SparkSession, t: Tables, query: str, params: list | None = None) -> DataFrame:
    """Run a SELECT with ``?`` markers bound to ``params`` over the model views."""
    t.register_views()
    return spark.sql(query, args=list(params or []))


def export_sales_csv(t: Tables, path: str) -> None:
    """S3: all orders, newest first, as CSV with the six export columns.

    The export reads a ``paymentMethod`` column the schema does not have, so
    that column is always empty (K20).
    """
    rows = all_orders(t).select(
        F.col("order_id").alias(EXPORT_HEADER[0]),
        F.date_format("order_date", "yyyy-MM-dd HH:mm:ss").alias(EXPORT_HEADER[1]),
        F.col("user_id").alias(EXPORT_HEADER[2]),
        F.col("totalPrice").alias(EXPORT_HEADER[3]),
        F.col("order_status").alias(EXPORT_HEADER[4]),
        F.lit(None).cast("string").alias(EXPORT_HEADER[5]))
    rows.write.mode("errorifexists").option("header", True).csv(path)


def read_sales_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EXPORT_SCHEMA).option("header", True).csv(path)


FILES_PER_FOLDER = 2048


def _writer(root: str):
    def run(batches):
        """One file per key of rows sorted by (lot, key), made in a hidden folder that becomes the lot's when it is whole;
        a repeated task makes the same files again and replaces them one by one."""
        lot = draft = name = None
        lines, made = [], 0

        def close():
            if name is not None:
                with open(f"{draft}/{name}", "wb") as out:
                    out.write(b"".join(lines))

        def place():
            if lot is None:
                return
            folder = f"{root}/lot={lot}"
            try:
                os.rename(draft, folder)
            except OSError:
                if not os.path.isdir(folder):
                    raise
                for file in os.listdir(draft):
                    os.replace(f"{draft}/{file}", f"{folder}/{file}")
                os.rmdir(draft)

        for batch in batches:
            for row in batch.to_pylist():
                at = f"image_of={row['image_of']}.txt"
                if (row["lot"], at) != (lot, name):
                    close()
                    if row["lot"] != lot:
                        place()
                        lot = row["lot"]
                        draft = f"{root}/.lot={lot}-{uuid.uuid4().hex}"
                        os.mkdir(draft)
                    name, lines, made = at, [], made + 1
                lines.append((row["line"] or "").encode() + b"\n")
        close()
        place()
        yield pa.RecordBatch.from_arrays([pa.array([made], pa.int64())], names=["files"])

    return run


def write_files(rows: DataFrame, root: str, files_per_folder: int = FILES_PER_FOLDER) -> None:
    """One file per ``image_of`` under ``root`` with its ``line`` (repeated keys: a line each); a file's path
    holds ``image_of=<key>``.

    Files are spread over the tasks and over folders of some ``files_per_folder``.  On a mounted file system the tasks
    create the files themselves, a folder by one task: Spark's writer takes a folder per key there, and some 25 ms for each.
    """
    spark = rows.sparkSession
    count = rows.count()
    folders = max(1, -(-count // files_per_folder))
    tasks = max(folders, int(spark.conf.get("spark.sql.shuffle.partitions")))
    folder = local_folder(spark, root)
    spread = (rows.select(F.pmod(F.xxhash64("image_of"), F.lit(folders)).alias("lot"), "image_of", "line")
              .repartition(tasks, "image_of" if folder is None else "lot").sortWithinPartitions("lot", "image_of"))
    if folder is None:
        (spread.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
         .partitionBy("lot", "image_of").text(root))
        return
    os.makedirs(folder, exist_ok=True)
    spread.mapInArrow(_writer(folder), "files long").agg(F.sum("files")).collect()


# Names of files and folders that Spark's own listing leaves out.
_HIDDEN_FILE = re.compile(r"_[^=]*|\..*|.*\._COPYING_", re.DOTALL)
_HIDDEN_FOLDER = re.compile(r"(?!_metadata|_common_metadata)(_[^=]*|\..*|.*\._COPYING_)", re.DOTALL)
PATHS_PER_BATCH = 8192


def _lister():
    def run(batches):
        """Paths of the files in each folder, and where it is ``deep`` also below it."""
        def stop(error):
            raise error

        def holds(path):
            try:
                return os.stat(path).st_size > 0
            except FileNotFoundError:             # a link to nothing
                return False

        for batch in batches:
            for row in batch.to_pylist():
                for top, folders, names in os.walk(row["folder"], onerror=stop, followlinks=True):
                    folders[:] = [n for n in folders if row["deep"] and not _HIDDEN_FOLDER.fullmatch(n)]
                    for k in range(0, len(names), PATHS_PER_BATCH):
                        paths = [os.path.join(top, n) for n in names[k:k + PATHS_PER_BATCH] if not _HIDDEN_FILE.fullmatch(n)]
                        yield pa.RecordBatch.from_arrays([pa.array(["file:" + p for p in paths if holds(p)], pa.string())], names=["path"])

    return run


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path) of the files below ``root`` that hold something, as Spark's listing names them.

    On a mounted file system tasks list the folders.  Spark's listing keeps every file on the driver, and a scan of it
    deals some 30 small files to a task.
    """
    folder = local_folder(spark, root)
    if folder is None or not os.path.isdir(folder):
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    with os.scandir(folder) as entries:
        below = [e.path for e in entries if e.is_dir() and not _HIDDEN_FOLDER.fullmatch(e.name)]
    tasks = min(len(below) + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return (spark.createDataFrame([(folder, False)] + [(path, True) for path in below], "folder string, deep boolean")
            .repartition(tasks).mapInArrow(_lister(), "path string"))


PATHS_PER_READ = 4096          # files that one read names: a task's, or one of Spark's, where the driver holds the paths
READ_BYTES = 8 << 20           # contents that a task hands on at a time

OPEN_COST = 4 << 20            # bytes that could be read while a file is opened (Spark's own default)
LISTING_TASKS = 64             # tasks that look up the named paths of one read


def _plain_path(path):
    """A file's path without the scheme of the local file system."""
    return F.regexp_replace(path, "^file:(//)?(?=/)", "")


def _reader(root: str, limit: int):
    def run(batches):
        """(path, content) of those paths that Spark's listing of ``root`` would hold; links to nothing and names too long are no files."""
        def content(path):
            *folders, name = path[len(root) + 1:].split("/")
            if not name or _HIDDEN_FILE.fullmatch(name) or any(not f or _HIDDEN_FOLDER.fullmatch(f) for f in folders):
                return None
            try:
                is_file, size = stat.S_ISREG((found := os.stat(path)).st_mode), found.st_size
                if not is_file or not size:
                    return None
                if size > limit:
                    raise RuntimeError(f"{path} holds {size} bytes, more than spark.sql.sources.binaryFile.maxLength ({limit})")
                with open(path, "rb") as source:
                    return source.read()
            except (FileNotFoundError, NotADirectoryError, ValueError):
                return None
            except OSError as error:
                if error.errno in (errno.ENAMETOOLONG, errno.ELOOP):
                    return None
                raise

        def batch_of(rows):
            paths, contents = zip(*rows) if rows else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])

        rows, held = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                data = content(path)
                if data is None:
                    continue
                if rows and (held + len(data) > READ_BYTES or len(rows) == PATHS_PER_BATCH):
                    yield batch_of(rows)
                    rows, held = [], 0
                rows.append((path, data))
                held += len(data)
        yield batch_of(rows)

    return run


def read_files(spark: SparkSession, wanted: DataFrame, root: str, paths_per_read: int = PATHS_PER_READ) -> DataFrame:
    """(path, content) of the files under ``root`` whose path is one of ``wanted`` (column path).

    On a mounted file system tasks open the wanted files themselves, so that the work follows their number and not
    that of the files in the folder, and nothing is listed.  Elsewhere ``_scan_files`` reads them with Spark's reader.
    """
    wanted = wanted.select("path").where(F.col("path").isNotNull())
    folder = local_folder(spark, root)
    if folder is None or not os.path.isdir(folder):
        return _scan_files(spark, wanted.distinct(), root, paths_per_read)
    folder = folder.rstrip("/")
    found = materialize(wanted.where(F.col("path").startswith(folder + "/")).distinct(), "wanted-files")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-found.count() // paths_per_read))
    limit = int(spark.conf.get("spark.sql.sources.binaryFile.maxLength"))
    return found.repartition(tasks, "path").mapInArrow(_reader(folder, limit), FILE_SCHEMA)


def _scan_files(spark: SparkSession, wanted: DataFrame, root: str, paths_per_read: int) -> DataFrame:
    """``read_files`` by Spark's reader, ``wanted`` being distinct.

    The files are listed without their content first.  If those wanted hold half of all bytes, or two fifths
    where opening a file counts like ``OPEN_COST`` bytes (a named file is looked up once more), one scan reads the
    folder; else only the wanted ones are opened, a bounded number of paths at a time, and written to the shared folder.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    files = listed.select(F.col("path").alias("uri"), _plain_path(F.col("path")).alias("path"), "length")
    found = materialize(files.join(wanted, "path", "left_semi").withColumn("lot", F.xxhash64("path")), "wanted-files")
    held = (F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0)))
    (count, size), (every, whole) = found.agg(*held).first(), files.agg(*held).first()
    if 2 * size >= whole or 5 * (size + count * OPEN_COST) >= 2 * (whole + every * OPEN_COST):
        return (listed.select(_plain_path(F.col("path")).alias("path"), "content").join(found.select("path"), "path", "left_semi"))
    reads = -(-count // paths_per_read)
    folder = scratch_dir(spark, "files")
    with settings(spark, spark__sql__sources__parallelPartitionDiscovery__parallelism=LISTING_TASKS):
        for k in range(reads):
            uris = [r.uri for r in found.where(F.pmod("lot", F.lit(reads)) == k).select("uri").collect()]
            if uris:
                (spark.read.format("binaryFile").load(uris).select(_plain_path(F.col("path")).alias("path"), "content")
                 .write.mode("append").parquet(folder))
    if not reads:
        return spark.createDataFrame([], FILE_SCHEMA)
    return spark.read.schema(FILE_SCHEMA).parquet(folder)


def load_images(spark: SparkSession, refs: DataFrame, file_root: str | None = None) -> DataFrame:
    """(item_id, image) from (item_id, image_url).

    ``data:image/...;base64,<data>`` URIs are decoded in the JVM
    (``try_to_binary``: bad data gives NULL); ``file://`` and bare paths are
    looked up among the files under ``file_root`` (``read_files``: only files that a row
    names are read) and joined back by path; anything else, or a
    missing file, gives NULL.  Remote URLs are not fetched.
    """
    url = F.trim("image_url")
    is_data = url.startswith("data:image")
    is_http = url.startswith("http://") | url.startswith("https://")
    decoded = F.try_to_binary(F.substring_index(url, ",", -1), F.lit("base64"))
    typed = refs.select("item_id", "image_url",
                        F.when(is_data & F.col("image_url").contains(","), decoded).alias("_inline"),
                        F.when(~is_data & ~is_http & (url != ""), _plain_path(url)).alias("_path"))
    if file_root is not None:
        files = read_files(spark, typed.select(F.col("_path").alias("path")), file_root)
        # rows without a path match nothing: a second key, 0 for all others, spreads them over the tasks
        salt = F.when(F.col("_path").isNull(), F.pmod(F.xxhash64("item_id", "image_url"), F.lit(NULL_SALTS))).otherwise(0)
        files = files.select(F.col("path").alias("_path"), F.pmod(F.length("path"), F.lit(1)).cast("long").alias("_salt"),
                             F.col("content").alias("_file"))
        typed = typed.withColumn("_salt", salt.cast("long")).join(files, ["_path", "_salt"], "left")
    else:
        typed = typed.withColumn("_file", F.lit(None).cast("binary"))
    return typed.select("item_id", F.coalesce("_inline", "_file").alias("image"))


PROFILE_SCHEMA = T.StructType([
    T.StructField("user_id", T.LongType()), T.StructField("name", T.StringType()),
    T.StructField("email", T.StringType()), T.StructField("phone", T.StringType()),
    T.StructField("role", T.StringType()), T.StructField("notes", T.StringType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("order_stats", T.StructType([
        T.StructField("total_orders", T.LongType()), T.StructField("pending_orders", T.LongType()),
        T.StructField("total_revenue", T.DoubleType())])),
    T.StructField("orders", T.ArrayType(T.StructType([
        T.StructField("order_id", T.LongType()), T.StructField("order_date", T.StringType()),
        T.StructField("order_status", T.StringType()), T.StructField("totalPrice", T.DoubleType())]))),
])


def write_user_profiles(t: Tables, path: str) -> None:
    """``{path}/profiles``: one JSON document per user (no password is
    stored) with the order statistics of A12 and the user's orders, newest first:
    the document is the feature, so its list is as long as the user's history
    (orders of deleted users belong to no document)."""
    stats = user_order_stats(t)
    history = (t.orders.where(F.col("user_id").isNotNull()).groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct(
        F.date_format("order_date", "yyyy-MM-dd HH:mm:ss").alias("order_date"), "order_id", "order_status", "totalPrice")),
        asc=False).alias("_orders")))
    profiles = t.users.join(stats, "user_id", "left").join(history, "user_id", "left").select(
        "user_id", "name", "email", "phone", "role", "notes",
        F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
        F.struct("total_orders", "pending_orders", "total_revenue").alias("order_stats"),
        F.transform(F.coalesce("_orders", F.array()), lambda o: F.struct(
            o["order_id"].alias("order_id"), o["order_date"].alias("order_date"),
            o["order_status"].alias("order_status"), o["totalPrice"].alias("totalPrice"))).alias("orders"))
    profiles.write.mode("errorifexists").json(f"{path}/profiles")


def read_user_profiles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROFILE_SCHEMA).json(f"{path}/profiles")
