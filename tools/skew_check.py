"""Stress check for the order-dependent building blocks under key skew
(synthetic input, not a registered query): 2M checkout lines where one item
holds a third of them, and dense numbering of a sparse sequence."""

import sys, time
import os
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from pyspark.sql import functions as F
from storelake.session import get_session, checkpoint_dir
from storelake.operators.sequence import greedy_admission, new_ids
spark = get_session("local[8]", 16)
checkpoint_dir(spark)
N = 2_000_000
# one item holds a third of all request lines, capacity lets ~half of them through
lines = (spark.range(N).select(F.col("id").alias("request_id"),
         F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id") % 5000 + 2).alias("item_id"),
         (F.col("id") % 3 + 1).alias("quantity"))
         .withColumn("cap", F.when(F.col("item_id") == 1, F.lit(N // 3)).otherwise(F.lit(1000))))
t0 = time.time()
adm = greedy_admission(lines, "request_id", ["item_id"], "quantity", "cap")
n = adm.count()
print("admitted", n, "sec", round(time.time() - t0, 1))
t0 = time.time()
ids = new_ids(spark.range(0, 50_000_000, 997).toDF("seq"), "seq", F.lit(0), "new_id")
print("ids", ids.agg(F.max("new_id"), F.count(F.lit(1))).first(), "sec", round(time.time() - t0, 1))
