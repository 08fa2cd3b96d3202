"""Registered queries: name -> (Spark builder, DuckDB oracle SQL or None).

Each Spark builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over
the whole model derived from the driver tables.  The oracle SQL runs in DuckDB
on the same parquet files (model views are added as CTEs by ``with_model``).
"""

from __future__ import annotations

import weakref
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from storelake.plans.model_sql import with_model
from storelake.session import ADVISORY_SIZE, SHUFFLE_TASKS, size_shuffles
from storelake.sources.driver import read_driver
from storelake.sources.model import Tables, model_from_driver


@dataclass
class Ctx:
    """What a registered query may read: the session, the driver tables and
    the shop model derived from them."""
    spark: SparkSession
    sf_dir: str
    raw: dict
    t: Tables
    rows: int | None = None           # of the largest table, counted on first use


@dataclass(frozen=True)
class Registered:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    fn: Callable[[Tables, Ctx], DataFrame] | None = None
    body: str | None = None           # the SQL without the model views


REGISTRY: dict[str, Registered] = {}

# Model plans per (session, folder).  DataFrames are immutable plans, so the
# views are analysed once per session instead of once per query; the
# parquet file listing is taken when a table is first used.
# The session's own shuffle settings, and those we set in their place.
_USUAL: "weakref.WeakKeyDictionary[SparkSession, tuple[dict, dict]]" = weakref.WeakKeyDictionary()
_CONTEXTS: "weakref.WeakKeyDictionary[SparkSession, dict[str, Ctx]]" = weakref.WeakKeyDictionary()


def context(spark: SparkSession, sf_dir: str, refresh: bool = False) -> Ctx:
    per_session = _CONTEXTS.setdefault(spark, {})
    if refresh or sf_dir not in per_session:
        raw = read_driver(spark, sf_dir)
        per_session[sf_dir] = Ctx(spark, sf_dir, raw, model_from_driver(raw))
    return per_session[sf_dir]


def _size_shuffles(ctx: Ctx) -> None:
    """Shuffle tasks for the rows of this folder.  The order lines are the largest table of the model, and the
    requests derived from it have as many rows."""
    spark = ctx.spark
    now = {k: spark.conf.get(k) for k in (SHUFFLE_TASKS, ADVISORY_SIZE)}
    usual, ours = _USUAL.get(spark, (now, now))
    usual = {k: usual[k] if now[k] == ours[k] else now[k] for k in now}      # the caller may have set them since
    if ctx.rows is None:
        ctx.rows = max(ctx.raw[name].count() for name in ("lineitem", "events"))
    size_shuffles(spark, ctx.rows, usual)
    _USUAL[spark] = (usual, {k: spark.conf.get(k) for k in now})


def query(name: str, sql: str | None = None):
    """Register ``fn(t: Tables, ctx: Ctx) -> DataFrame`` under ``name``."""

    def deco(fn: Callable[[Tables, Ctx], DataFrame]):
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            ctx = context(spark, sf_dir)
            _size_shuffles(ctx)
            return fn(ctx.t, ctx)

        build.__name__ = f"q_{name}"
        build.__doc__ = fn.__doc__
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Registered(name, build, with_model(sql) if sql else None, fn, sql)
        return fn

    return deco


def load_all() -> dict[str, Registered]:
    # importing the plan modules fills REGISTRY
    from storelake.plans import (catalog_plans, customer_plans, order_plans,  # noqa: F401
                                 quality_plans, report_plans, change_plans, source_plans,
                                 stored_plans, stream_plans)
    return REGISTRY
