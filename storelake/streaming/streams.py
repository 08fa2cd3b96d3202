"""Structured Streaming versions of order intake, cart totals and running
revenue (X1-X3).  Each reuses the batch operator on every micro-batch or
expresses the running figure as a streaming aggregate.

* X1 ``run_order_stream``: checkout requests arrive as files; every
  micro-batch runs W8 admission + W7 placement against the state the
  previous micro-batch committed.
* X2 ``cart_totals_stream``: running added quantity per (user, item),
  a streaming ``groupBy().agg(sum)`` whose state is one row per pair.
* X3 ``revenue_stream``: running order count, revenue and open orders per
  day; the state is one row per calendar day.

Results go into a ``snapshots.Store``: a micro-batch is one commit whose note names the stream and the
batch, so a batch that Spark repeats after a crash is either not committed yet or skipped.  Batches
write deltas (new rows, changed rows); every ``fan`` deltas are merged, and what no
version names any more is deleted, so neither files nor reads grow with the number of batches.

Every query runs with ``trigger(availableNow=True)``: it drains what is
there and stops; run again over the same checkpoint it takes what is new.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storelake.functions.money import cents_long, from_cents
from storelake.operators.stock import place_orders
from storelake.schema import SCHEMAS
from storelake.sources.model import Tables
from storelake.sources.snapshots import Files, Store

REQUEST_SCHEMA = T.StructType([
    T.StructField("request_id", T.LongType()), T.StructField("user_id", T.LongType()),
    T.StructField("item_id", T.LongType()), T.StructField("quantity", T.IntegerType()),
])
REJECT_SCHEMA = T.StructType([T.StructField("request_id", T.LongType()), T.StructField("item_id", T.LongType()),
                              T.StructField("reason", T.StringType())])
TOTALS_SCHEMA = T.StructType([T.StructField(n, T.LongType()) for n in ("user_id", "item_id", "added_quantity")])
REVENUE_SCHEMA = T.StructType([T.StructField("day", T.DateType()), T.StructField("order_count", T.LongType()),
                               T.StructField("total_revenue", T.DoubleType()), T.StructField("open_orders", T.LongType())])
FAN = 8                   # deltas of one size that are merged
KEPT_VERSIONS = 3         # a reader that opened a version of the batch before may finish


def order_state(spark: SparkSession, state_dir: str) -> Store:
    """X1's tables: new orders and lines, the whole stock, rejects."""
    schemas = {n: SCHEMAS[n] for n in ("orders", "order_items", "items_quant")} | {"rejects": REJECT_SCHEMA}
    return Store(spark, state_dir, schemas, keys={"items_quant": ["itemQuant_id"]})


def snapshot_after(base: Tables, spark: SparkSession, state_dir: str) -> Tables:
    """The model after every completed X1 batch: base orders and lines plus those
    the stream added, and its stock."""
    store = order_state(spark, state_dir)
    last = store.version()
    if last is None:
        return base
    return base.with_(
        orders=base.orders.select(*SCHEMAS["orders"].fieldNames()).unionByName(store.read("orders", last.number)),
        order_items=base.order_items.unionByName(store.read("order_items", last.number)),
        items_quant=store.read("items_quant", last.number))


def _stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark gave the stream of this checkpoint: a new checkpoint numbers its batches anew."""
    return json.loads(Files(spark, checkpoint).read(f"{checkpoint}/metadata"))["id"]


def _drain(stream, store: Store, checkpoint: str, fan: int, step) -> None:
    """Run a stream over what is there; ``step(batch, note)`` prepares a version and returns it
    with the note to commit."""
    def process(batch: DataFrame, batch_id: int) -> None:
        last = store.version()
        note = dict(last.note) if last else {}
        stream_id = _stream_id(batch.sparkSession, checkpoint)
        done = dict(note.get("done", {}))
        if done.get(stream_id, -1) >= batch_id:
            return                             # committed before the crash that made Spark repeat it
        version, note = step(batch, note)
        store.publish(version, note | {"done": done | {stream_id: batch_id}})
        store.merge_deltas(fan)
        store.vacuum(KEPT_VERSIONS)

    q = stream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def run_order_stream(spark: SparkSession, base: Tables, source_dir: str, state_dir: str,
                     checkpoint: str, order_date: str | None = None, fan: int = FAN) -> Tables:
    """Place every checkout request file as it arrives; returns the final snapshot.

    A micro-batch writes its own rows only: new orders and lines, the variants whose stock
    moved (the first one: the whole stock) and rejects.  The commit's note carries the
    largest ids, so the next batch does not look for them.
    """
    store = order_state(spark, state_dir)

    def step(batch: DataFrame, note: dict):
        started = store.version() is not None
        current = base.with_(items_quant=store.read("items_quant")) if started else base
        bases = {k: F.lit(note[n]) if started else None for k, n in (("order_id_base", "max_order_id"), ("line_id_base", "max_line_id"))}
        out = place_orders(current, batch, order_date=order_date, **bases)
        new = {"orders": out["new_orders"], "order_items": out["new_order_items"], "rejects": out["rejects"]}
        version = (store.prepare(append=new, upsert={"items_quant": out["changed_stock"]}) if started
                   else store.prepare(append=new, replace={"items_quant": out["items_quant"]}))

        def largest(table: str, column: str, noted: str) -> int:
            found = store.read_part(version, table).agg(F.max(column)).first()[0]
            if found is not None:
                return found
            return note[noted] if started else getattr(base, table).agg(F.max(column)).first()[0] or 0

        return version, {"max_order_id": largest("orders", "order_id", "max_order_id"),
                         "max_line_id": largest("order_items", "orderItem_id", "max_line_id")}

    _drain(spark.readStream.schema(REQUEST_SCHEMA).parquet(source_dir).writeStream, store, checkpoint, fan, step)
    return snapshot_after(base, spark, state_dir)


def _totals(spark: SparkSession, out_dir: str) -> Store:
    return Store(spark, out_dir, {"totals": TOTALS_SCHEMA}, keys={"totals": ["user_id", "item_id"]})


def cart_totals_stream(spark: SparkSession, source_dir: str, schema: T.StructType,
                       out_dir: str, checkpoint: str, fan: int = FAN) -> str:
    """Running added quantity per (user_id, item_id) (adds raise q to 1,
    no stock refusal).

    The aggregate runs in ``update`` mode: each micro-batch upserts only the
    pairs whose total changed.  The state store holds one row
    per pair; nothing is rewritten for pairs a batch did not touch.
    ``read_cart_totals`` gives the current total per pair.
    """
    store = _totals(spark, out_dir)
    events = spark.readStream.schema(schema).parquet(source_dir)
    totals = (events.where(F.col("item_id").isNotNull() & F.col("user_id").isNotNull())
              .groupBy("user_id", "item_id")
              .agg(F.sum(F.greatest(F.coalesce("quantity", F.lit(1)), F.lit(1))).cast("bigint")
                   .alias("added_quantity")))
    _drain(totals.writeStream.outputMode("update"), store, checkpoint, fan,
           lambda batch, note: (store.prepare(upsert={"totals": batch}), note))
    return out_dir


def read_cart_totals(spark: SparkSession, out_dir: str) -> DataFrame:
    """Current total per (user, item): the newest value in the few merged deltas."""
    return _totals(spark, out_dir).read("totals")


def revenue_stream(spark: SparkSession, source_dir: str, schema: T.StructType, out_dir: str,
                   checkpoint: str) -> str:
    """Per day the order count and revenue of non-cancelled orders and the
    number of orders still 'Processing' (live A8 / A2).  Each micro-batch commits the whole result (one
    row per day)."""
    store = Store(spark, out_dir, {"revenue": REVENUE_SCHEMA})
    orders = spark.readStream.schema(schema).parquet(source_dir)
    live = F.col("order_status") != "Cancelled"
    per_day = orders.groupBy(F.to_date("order_date").alias("day")).agg(
        F.sum(F.when(live, 1).otherwise(0)).cast("bigint").alias("order_count"),
        F.sum(F.when(live, cents_long(F.col("totalPrice")))).alias("_rev"),
        F.sum(F.when(F.col("order_status") == "Processing", 1).otherwise(0)).cast("bigint")
         .alias("open_orders"))
    per_day = per_day.select("day", "order_count",
                             F.coalesce(from_cents(F.col("_rev")), F.lit(0.0)).alias("total_revenue"),
                             "open_orders")
    _drain(per_day.writeStream.outputMode("complete"), store, checkpoint, FAN,
           lambda batch, note: (store.prepare(replace={"revenue": batch}), note))
    return out_dir


def read_revenue(spark: SparkSession, out_dir: str) -> DataFrame:
    """The running figures after the newest batch."""
    return Store(spark, out_dir, {"revenue": REVENUE_SCHEMA}).read("revenue")


def feed_in_chunks(df: DataFrame, source_dir: str, chunk_col: str, n_chunks: int, drain) -> None:
    """Write ``df`` into ``source_dir`` as ``n_chunks`` successive appends of
    ascending ``chunk_col`` ranges, each as many files as it has partitions, and call
    ``drain()`` (run the stream on what is new) after each: every chunk is one micro-batch."""
    bounds = df.agg(F.min(chunk_col).alias("lo"), F.max(chunk_col).alias("hi")).first()
    if bounds is None or bounds["lo"] is None:
        return
    lo, hi = int(bounds["lo"]), int(bounds["hi"])
    step = max(1, (hi - lo) // n_chunks + 1)
    for k in range(n_chunks):
        part = df.where((F.col(chunk_col) >= lo + k * step) & (F.col(chunk_col) < lo + (k + 1) * step))
        part.write.mode("append").parquet(source_dir)
        drain()
