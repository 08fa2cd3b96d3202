"""Stored tables with atomic commits.

A ``Store`` is a folder with one subfolder per write (``<table>/<version>-<token>``) and a
``_manifest`` folder with one small JSON file per version.  A version names the folders
of each table, so a reader sees all tables of one commit or none of it:

* ``commit`` writes new folders first and then renames the finished manifest to
  its version's name, without overwriting: a job that dies before that leaves the last
  version as it was, and of two writers of one version the second one fails.
* A table is a ``base`` folder and deltas after it: appended rows, or upserts (rows that
  replace those of equal key).  ``merge_deltas`` keeps their number small, ``compact`` writes
  a new base from them.
* ``vacuum`` deletes folders that no kept version names, which includes those of dead jobs.

A ``Layout`` says how a base is written: partitioned by the order month, bucketed by a
key (two tables of equal buckets are joined on it without a shuffle), or sorted by a
key over files with Parquet bloom filters (a lookup of few keys skips row groups).
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storelake.session import delete_folder

MANIFEST = "_manifest"
ORDER_MONTH = "order_month"


class ConcurrentCommit(RuntimeError):
    """Another writer has committed the version that this commit was to become."""


@dataclass(frozen=True)
class Layout:
    """How a table's base is written."""
    month_of: str | None = None            # timestamp column whose 'YYYY-MM' partitions the rows
    bucket: str | None = None              # key column of the buckets
    buckets: int = 0
    sort: str | None = None                # files hold ranges of this column
    files: int = 0
    bloom: tuple[str, ...] = ()            # columns with a bloom filter per row group


@dataclass
class Version:
    """One committed state: per table its folders, oldest first, and the writer's note."""
    number: int
    tables: dict[str, list[dict]]
    note: dict = field(default_factory=dict)


class Files:
    """The few file system calls the store needs, through Hadoop (any file system Spark can write)."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        sc = spark.sparkContext
        self._jvm = sc._jvm
        self._conf = sc._jsc.hadoopConfiguration()
        self._fs = self._path(path).getFileSystem(self._conf)
        self._context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        stream = self._fs.create(self._path(path), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def rename(self, old: str, new: str) -> bool:
        """Rename without overwriting; False if ``new`` is there already."""
        how = self._jvm.java.lang.reflect.Array.newInstance(
            self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            self._context.rename(self._path(old), self._path(new), how)
        except Exception as e:  # noqa: BLE001 - py4j wraps the Java exception
            if "FileAlreadyExistsException" in str(e):
                return False
            raise
        return True


class Store:
    """Tables below ``path`` with the given schemas; ``keys`` names the key of tables with upserts."""

    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, T.StructType],
                 layouts: dict[str, Layout] | None = None, keys: dict[str, list[str]] | None = None) -> None:
        self.spark, self.path, self.schemas = spark, path.rstrip("/"), schemas
        self.layouts, self.keys = layouts or {}, keys or {}
        self._files = Files(spark, self.path)

    # ---------------------------------------------------------------- versions

    def _manifest(self, number: int) -> str:
        return f"{self.path}/{MANIFEST}/{number:012d}.json"

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self._files.names(f"{self.path}/{MANIFEST}") if n.endswith(".json") and n[:-5].isdigit()]

    def version(self, number: int | None = None) -> Version | None:
        """A committed version, by default the last; None before the first commit."""
        if number is None:
            number = max(self.versions(), default=None)
            if number is None:
                return None
        return Version(**json.loads(self._files.read(self._manifest(number))))

    # ----------------------------------------------------------------- writing

    def prepare(self, replace: dict[str, DataFrame] | None = None, append: dict[str, DataFrame] | None = None,
                upsert: dict[str, DataFrame] | None = None) -> Version:
        """Write the folders of the next version (tables replaced, appended to and upserted; all
        others stay) without committing it."""
        last = self.version()
        number = 1 if last is None else last.number + 1
        tables = {} if last is None else {n: list(f) for n, f in last.tables.items()}
        for kind, writes in (("base", replace), ("append", append), ("upsert", upsert)):
            for name, df in (writes or {}).items():
                folder = self._write(name, df, kind, number)
                tables[name] = [folder] if kind == "base" else tables.get(name, []) + [folder]
        return Version(number, tables, {} if last is None else last.note)

    def commit(self, replace: dict[str, DataFrame] | None = None, append: dict[str, DataFrame] | None = None,
               upsert: dict[str, DataFrame] | None = None, note: dict | None = None) -> Version:
        """Write and publish the next version; its note is the last one's unless given."""
        return self.publish(self.prepare(replace, append, upsert), note)

    def publish(self, version: Version, note: dict | None = None) -> Version:
        """Make a prepared version the current one."""
        if note is not None:
            version.note = dict(note)
        return self._publish(version)

    def _publish(self, version: Version) -> Version:
        draft = f"{self.path}/{MANIFEST}/draft-{uuid.uuid4().hex}"
        self._files.write(draft, json.dumps(asdict(version)))
        if not self._files.rename(draft, self._manifest(version.number)):
            delete_folder(self.spark, draft)
            raise ConcurrentCommit(f"version {version.number} of {self.path} is taken")
        return version

    def _write(self, name: str, df: DataFrame, kind: str, number: int, tier: int = 0) -> dict:
        """Write one folder; deltas are plain files."""
        layout = self.layouts.get(name, Layout()) if kind == "base" else Layout()
        folder = f"{name}/{number:012d}-{uuid.uuid4().hex[:8]}"
        out = df.select(*self.schemas[name].fieldNames())
        if layout.month_of:
            out = out.withColumn(ORDER_MONTH, F.date_format(layout.month_of, "yyyy-MM"))
        if layout.bucket:
            out = out.repartition(layout.buckets, layout.bucket)
        elif layout.sort:
            out = out.repartitionByRange(max(1, layout.files), layout.sort).sortWithinPartitions(layout.sort)
        writer = out.write.mode("errorifexists")
        for column in layout.bloom:
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        if layout.month_of:
            writer = writer.partitionBy(ORDER_MONTH)
        if layout.bucket:
            table = self._catalog_name(folder)
            (writer.format("parquet").bucketBy(layout.buckets, layout.bucket).sortBy(layout.bucket)
             .option("path", f"{self.path}/{folder}").saveAsTable(table))
        else:
            writer.parquet(f"{self.path}/{folder}")
        return {"folder": folder, "kind": kind, "tier": tier, "month": bool(layout.month_of), "bucket": layout.bucket, "buckets": layout.buckets}

    # ----------------------------------------------------------------- reading

    def _catalog_name(self, folder: str) -> str:
        return "stored_" + hashlib.sha256(f"{self.path}/{folder}".encode()).hexdigest()[:24]

    def _folder(self, name: str, entry: dict) -> DataFrame:
        path, schema = f"{self.path}/{entry['folder']}", self.schemas[name]
        if entry["bucket"]:
            # the buckets are known to the session's catalog only: name the folder there once more
            table = self._catalog_name(entry["folder"])
            if not self.spark.catalog.tableExists(table):
                columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
                key, count = entry["bucket"], entry["buckets"]
                self.spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet "
                               f"CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {count} BUCKETS LOCATION '{path}'")
            return self.spark.table(table)
        if entry["month"]:
            schema = T.StructType(schema.fields + [T.StructField(ORDER_MONTH, T.StringType())])
        return self.spark.read.schema(schema).parquet(path)

    def read_part(self, version: Version, name: str) -> DataFrame:
        """The rows of the last folder of a table, of a version that may not be committed yet."""
        return self._folder(name, version.tables[name][-1]).select(*self.schemas[name].fieldNames())

    def read(self, name: str, number: int | None = None, months: bool = False) -> DataFrame:
        """A table of a version.  ``months``: with the ``order_month`` that its base is partitioned by."""
        version = self.version(number)
        return self._merged(name, [] if version is None else version.tables.get(name, []), months)

    def _merged(self, name: str, entries: list[dict], months: bool = False) -> DataFrame:
        columns = self.schemas[name].fieldNames()
        whole, changes = None, None
        for at, entry in enumerate(entries):
            rows = self._folder(name, entry)
            if entry["kind"] == "upsert":
                rows = rows.select(*columns).withColumn("_at", F.lit(at))
                changes = rows if changes is None else changes.unionByName(rows)
                continue
            if not months:
                rows = rows.select(*columns)
            elif ORDER_MONTH not in rows.columns:
                raise ValueError(f"{name} has parts without {ORDER_MONTH}: compact it first")
            whole = rows if whole is None else whole.unionByName(rows)
        if changes is not None:
            key = self.keys[name]
            rest = [c for c in columns if c not in key]
            newest = (changes.groupBy(*key).agg(F.max_by(F.struct(*rest), "_at").alias("_row"))
                      .select(*key, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*columns))
            whole = newest if whole is None else (
                whole.join(newest.select(*key), key, "left_anti").select(*columns).unionByName(newest))
        return self.spark.createDataFrame([], self.schemas[name]) if whole is None else whole

    # ------------------------------------------------------------- maintenance

    def compact(self, names: list[str] | None = None, note: dict | None = None) -> Version | None:
        """Write a new base for each table (of ``names``) that has deltas, in one commit."""
        last = self.version()
        if last is None:
            return None
        due = [n for n in (names or last.tables) if len(last.tables.get(n, [])) > 1]
        if not due:
            return last
        return self.commit(replace={n: self.read(n, last.number) for n in due}, note=note)

    def merge_deltas(self, fan: int = 8) -> Version | None:
        """Merge every ``fan`` deltas of one tier into one of the next tier, in one commit.

        After n commits a table has fewer than fan * log(n) deltas, and a row has been rewritten
        log(n) times at most: the base is left alone.
        """
        last = self.version()
        if last is None:
            return None
        tables, number, merged = {n: list(e) for n, e in last.tables.items()}, last.number + 1, False
        for name, entries in tables.items():
            while True:
                kind, tier = entries[-1]["kind"], entries[-1].get("tier", 0)
                run = 0
                while run < len(entries) and entries[-1 - run]["kind"] == kind and entries[-1 - run].get("tier", 0) == tier:
                    run += 1
                if kind == "base" or run < fan:
                    break
                entry = self._write(name, self._merged(name, entries[-run:]), kind, number, tier + 1)
                entries[-run:] = [entry]
                merged = True
        return self._publish(Version(number, tables, last.note)) if merged else last

    def vacuum(self, keep: int = 1) -> None:
        """Forget all but the last ``keep`` versions and delete what only they, or dead jobs, wrote.

        Not while a commit is under way: its folders aren't named yet.
        """
        versions = self.versions()
        kept, gone = versions[-keep:], versions[:-keep]
        named = {e["folder"] for v in kept for es in self.version(v).tables.values() for e in es}
        for number in gone:
            delete_folder(self.spark, self._manifest(number))
        for draft in (n for n in self._files.names(f"{self.path}/{MANIFEST}") if n.startswith("draft-")):
            delete_folder(self.spark, f"{self.path}/{MANIFEST}/{draft}")
        for name in self.schemas:
            for part in self._files.names(f"{self.path}/{name}"):
                if f"{name}/{part}" not in named:
                    self.spark.sql(f"DROP TABLE IF EXISTS {self._catalog_name(f'{name}/{part}')}")
                    delete_folder(self.spark, f"{self.path}/{name}/{part}")
