"""Order-dependent building blocks that stay distributed under key skew.

``running_sum`` is a blocked prefix sum: the rows of each group are cut into
blocks at quantiles of the sequence column (so a block holds a share of the
rows whatever the id values look like), each block is summed locally (a window
over one block only), the block totals are prefix-summed (one row per block),
and the two are added.  A group holding a third of all rows is therefore
spread over many tasks instead of one.  The number of blocks follows the rows of the largest
group alone.

``new_ids`` numbers new rows ``base + 1, base + 2, ...`` in sequence order
with the same blocked scheme -- no single-partition ``row_number()`` over
the whole batch -- so inserts get deterministic, dense, SQL-equal ids.

``greedy_admission`` decides requests that are served one after another.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storelake.operators.graph import components
from storelake.session import discard, materialize

ROWS_PER_BLOCK = 1 << 16
REPLAY_LINES = 1 << 19        # lines that one task replays (some 150 MB there)


def _cuts(seq: str, blocks: int) -> Column:
    return F.percentile_approx(seq, [k / blocks for k in range(1, blocks)], 4 * blocks)


def largest_group(df: DataFrame, group: list[str]) -> int:
    """The rows of the largest group (one action)."""
    if not group:
        return df.count()
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def with_blocks(df: DataFrame, group: list[str], seq: str,
                rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Add ``_blk``: the block of each row, ascending in ``seq`` inside its group.

    A group of n rows gets about n / ``rows_per_block`` blocks; the cuts are approximate quantiles, which
    only decides how evenly the rows are spread.  Rows are counted first (one action); where no group
    is larger than a block there is nothing to cut.
    """
    blocks = -(-largest_group(df, group) // rows_per_block)
    if blocks <= 1:
        return df.withColumn("_blk", F.lit(0))
    spread = F.struct(_cuts(seq, blocks).alias("cuts"), F.count(F.lit(1)).alias("n"))
    if group:
        keyed = df.join(df.groupBy(*group).agg(spread.alias("_spread")), group)
    else:
        keyed = df.withColumn("_spread", df.agg(spread).scalar())
    # two steps of about sqrt(blocks) comparisons each: every ``stride``-th cut, then the cuts behind it
    stride = max(1, round(blocks ** 0.5))
    coarse = F.size(F.filter(F.transform(F.sequence(F.lit(stride), F.lit(max(stride, blocks - 1)), F.lit(stride)),
                                         lambda k: F.get("_spread.cuts", k - 1)), lambda c: c < F.col(seq)))
    fine = F.size(F.filter(F.slice("_spread.cuts", F.col("_coarse") * stride + 1, stride), lambda c: c < F.col(seq)))
    wanted = F.least(F.lit(blocks), F.ceil(F.col("_spread.n") / F.lit(rows_per_block)))
    place = F.col("_coarse") * stride + fine
    return (keyed.withColumn("_coarse", coarse)
            .withColumn("_blk", F.floor(place * wanted / F.lit(blocks)).cast("int")).drop("_spread", "_coarse"))


def blocked_sum(df: DataFrame, group: list[str], seq: str, value: Column, out: str) -> DataFrame:
    """Add ``out`` = SUM(value) over rows of the same ``group`` with seq <= own
    seq, for rows that have their block (``with_blocks``)."""
    local_w = (Window.partitionBy(*group, "_blk").orderBy(seq)
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = df.withColumn("_v", value).withColumn("_local", F.sum("_v").over(local_w))
    totals = local.groupBy(*group, "_blk").agg(F.sum("_v").alias("_bt"))
    prefix_w = (Window.partitionBy(*group).orderBy("_blk")
                .rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select(*group, "_blk",
                            F.coalesce(F.sum("_bt").over(prefix_w), F.lit(0)).alias("_off"))
    return (local.join(offsets, [*group, "_blk"])
            .withColumn(out, F.col("_off") + F.col("_local"))
            .drop("_v", "_local", "_off"))


def running_sum(df: DataFrame, group: list[str], seq: str, value: Column, out: str,
                rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Add ``out`` = SUM(value) over rows of the same ``group`` with seq <= own seq.

    ``seq`` must be an integer column, unique inside a group.
    """
    return blocked_sum(with_blocks(df, group, seq, rows_per_block), group, seq, value, out).drop("_blk")


def new_ids(df: DataFrame, seq: str, base: Column, out: str,
            group: list[str] | None = None, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Add ``out`` = base + rank of the row by ``seq`` (within ``group``).

    ``base`` is usually a scalar subquery such as ``max(id)`` of the table
    the rows go into (0 when it is empty).
    """
    ranked = running_sum(df, group or [], seq, F.lit(1).cast("bigint"), "_rank", rows_per_block)
    return ranked.withColumn(out, (base + F.col("_rank")).cast("bigint")).drop("_rank")


def max_id(df: DataFrame, col: str) -> Column:
    """Scalar subquery: the largest id of a table, 0 when the table is empty."""
    return df.agg(F.coalesce(F.max(col), F.lit(0)).cast("bigint")).scalar()


def _contended(lines: DataFrame, req: str, group: list[str]) -> tuple[DataFrame, DataFrame]:
    """Lines of groups that may run out, and the requests without any such line (all admitted)."""
    demand = lines.groupBy(*group).agg(F.sum("_q").alias("_need"), F.min("_room").alias("_least"))
    tight = materialize(lines.join(demand.where(F.col("_need") > F.col("_least")).select(*group), group, "left_semi"), "contended")
    free = materialize(lines.select(req).distinct().join(tight.select(req), req, "left_anti"), "admitted")
    return tight, free


def _decide_sure(lines: DataFrame, req: str, group: list[str], rows_per_block: int) -> tuple[DataFrame, DataFrame]:
    """(requests that fit even if all earlier ones are served, lines of the requests still open).

    A request with a line that does not fit after those admitted here alone is refused; the
    lines that stay have the room these left before them.  The lines are shuffled four times (by group,
    by request, and both again) and only what stays is written.
    """
    whole = largest_group(lines, group) <= rows_per_block      # nothing to cut: a plain window each
    blocked = lines if whole else materialize(with_blocks(lines, group, req, rows_per_block), "blocks")
    by_request = Window.partitionBy(req)

    def summed(df: DataFrame, value: Column) -> DataFrame:
        if not whole:
            return blocked_sum(df, group, req, value, "_used")
        upto = Window.partitionBy(*group).orderBy(req).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumn("_used", F.sum(value).over(upto))

    most = summed(blocked, F.col("_q"))
    marked = most.withColumn("_in", F.min(F.col("_used") <= F.col("_room")).over(by_request)).drop("_used")
    if not whole:
        marked = materialize(marked, "blocks")
        discard(blocked)
    counted = summed(marked, F.when(F.col("_in"), F.col("_q")).otherwise(F.lit(0)).cast("bigint"))
    room = F.col("_room") - F.col("_used")
    kept = (counted.withColumn("_ok", F.min(F.col("_in") | (F.col("_q") <= room)).over(by_request)).where("_ok")
            .select(req, *group, "_q", room.alias("_room"), "_in"))
    kept = materialize(kept, "undecided")
    if not whole:
        discard(marked)
    sure = materialize(kept.where("_in").select(req).distinct(), "admitted")
    left = kept.where("NOT _in").drop("_in")
    left._scratch_path = vars(kept).pop("_scratch_path")       # discarded with the lines that stay
    return sure, left


def _replay(req: str, group: list[str]):
    """Serve the requests of some lines one after another."""
    def run(lines: pd.DataFrame) -> pd.DataFrame:
        lines = lines.sort_values(req, kind="stable")
        place = lines.groupby(group, sort=False, dropna=False).ngroup().tolist()
        used = [0] * (max(place, default=-1) + 1)
        asked, room, reqs = lines["_q"].tolist(), lines["_room"].tolist(), lines[req].tolist()
        served, at = [], 0
        while at < len(reqs):
            end = at + 1
            while end < len(reqs) and reqs[end] == reqs[at]:
                end += 1
            if all(asked[k] + used[place[k]] <= room[k] for k in range(at, end)):
                served.append(reqs[at])
                for k in range(at, end):
                    used[place[k]] += asked[k]
            at = end
        return pd.DataFrame({req: pd.Series(served, dtype=lines[req].dtype)})

    return run


def _served(lines: DataFrame, by: str, req: str, group: list[str]) -> DataFrame:
    """Requests admitted by replaying each ``by`` group of lines in one task."""
    kind = lines.schema[req].dataType.simpleString()
    return materialize(lines.groupBy(by).applyInPandas(_replay(req, group), f"{req} {kind}"), "admitted")


def replay_bins(rows: DataFrame, left: int, seq: str, replay_rows: int = REPLAY_LINES,
                rows_per_block: int = ROWS_PER_BLOCK) -> tuple[DataFrame, DataFrame]:
    """Cut rows with ``_comp``, the component they belong to, into what tasks can replay now
    (with ``_bin``, the group that one task takes) and the rest.

    ``rows`` must be written already; ``left`` is their number.  A component of up to ``replay_rows``
    rows is taken whole, and small ones share a bin.  Of a larger one the first rows
    in ``seq`` order are taken, up to that many (rows of equal ``seq`` stay together, the first of
    them always goes): nothing later can change them.
    """
    sized = rows.join(rows.groupBy("_comp").agg(F.count(F.lit(1)).alias("_size")), "_comp")
    bins = max(1, -(-4 * left // replay_rows))
    whole = (sized.where(F.col("_size") <= replay_rows)
             .withColumn("_bin", F.pmod(F.xxhash64("_comp"), F.lit(bins))).drop("_size"))
    large = sized.where(F.col("_size") > replay_rows).drop("_size")
    per_seq = large.groupBy("_comp", seq).agg(F.count(F.lit(1)).alias("_n"))
    upto = running_sum(per_seq, ["_comp"], seq, F.col("_n"), "_upto", rows_per_block)
    first = materialize(upto.where((F.col("_upto") <= replay_rows) | (F.col("_upto") == F.col("_n")))
                        .select("_comp", seq), "first")
    prefix = large.join(first, ["_comp", seq], "left_semi").withColumn("_bin", -1 - F.pmod("_comp", F.lit(1 << 62)))
    return whole.unionByName(prefix), large.join(first, ["_comp", seq], "left_anti")


def _replay_components(lines: DataFrame, left: int, req: str, group: list[str], replay_lines: int,
                       rows_per_block: int) -> tuple[DataFrame, DataFrame]:
    """Decide the components of the request-group graph: (requests admitted, lines still open).

    Requests that share no group, directly or over others, don't touch each other.
    """
    of_request, of_group = F.xxhash64(F.lit("r"), F.col(req)), F.xxhash64(F.lit("g"), *group)
    comp = components(lines.select(of_request.alias("a"), of_group.alias("b")))
    lines = materialize(lines.withColumn("_node", of_request)
                        .join(comp.select(F.col("node").alias("_node"), F.col("comp").alias("_comp")), "_node").drop("_node"), "undecided")
    now, later = replay_bins(lines, left, req, replay_lines, rows_per_block)
    served = _served(now, "_bin", req, group)
    taken = (now.where("_bin < 0").join(served, req, "left_semi").groupBy(*group).agg(F.sum("_q").alias("_taken")))
    rest = materialize(later.join(taken, group, "left")
                       .select(req, *group, "_q", (F.col("_room") - F.coalesce("_taken", F.lit(0))).alias("_room")), "undecided")
    discard(lines)
    return served, rest


def greedy_admission(lines: DataFrame, req: str, group: list[str], qty: str, cap: str,
                     rows_per_block: int = ROWS_PER_BLOCK, replay_lines: int = REPLAY_LINES,
                     rounds: list[int] | None = None) -> DataFrame:
    """Requests admitted when they are served one after another in ``req`` order.

    ``lines`` has one row per (request, group) with the quantity it takes
    and the group's capacity; a request is admitted iff each of its lines
    fits in what the earlier *admitted* requests left of the capacity.

    * A request with a line beyond the whole capacity is refused at once, so that it
      does not count as demand.  Lines of groups whose whole demand fits never refuse anything: they go next.
    * What is left is replayed by one task if it has at most ``replay_lines`` lines.
    * Otherwise two running sums decide the requests that fit even if all
      earlier ones are served, and those that do not fit after these alone.  Where that leaves less
      than half of the lines it is done again, so all these rounds cost no more than twice the first one.
    * Where it leaves more, the rest falls into
      components of the request-group graph, each replayed by one task
      (``_replay_components``).  Only components beyond ``replay_lines`` need another
      round, and each round takes that many lines off them: the depth of a chain of
      conflicts does not count, a batch of n lines takes at most 1 + n / ``replay_lines`` rounds.

    Null requests are never served.  A task never gets more than some ``replay_lines`` lines; all steps are written to the shared folder.
    ``rounds`` receives the number of contended lines at the start of each round.
    """
    asked = lines.select(req, *group, F.coalesce(F.col(qty), F.lit(0)).cast("bigint").alias("_q"),
                         F.coalesce(F.col(cap), F.lit(0)).cast("bigint").alias("_room")).where(F.col(req).isNotNull())
    # lines without a group take nothing
    fits = reduce(Column.__or__, [F.col(c).isNull() for c in group], F.col("_q") <= F.col("_room"))
    undecided = materialize(asked.withColumn("_ok", F.min(fits).over(Window.partitionBy(req))).where("_ok").drop("_ok"), "undecided")
    tight, free = _contended(undecided, req, group)
    discard(undecided)
    admitted = [free]
    left = tight.count()
    while left:
        if rounds is not None:
            rounds.append(left)
        if left <= replay_lines:
            admitted.append(_served(tight.withColumn("_bin", F.lit(0)), "_bin", req, group))
            break
        sure, undecided = _decide_sure(tight, req, group, rows_per_block)
        admitted.append(sure)
        discard(tight)
        before, left = left, undecided.count()
        if left > replay_lines and 2 * left > before:
            served, rest = _replay_components(undecided, left, req, group, replay_lines, rows_per_block)
            admitted.append(served)
            discard(undecided)
            undecided, left = rest, rest.count()
        tight = undecided
    discard(tight)
    return reduce(DataFrame.unionByName, admitted)


def new_ids_nested(df: DataFrame, outer: str, inner: str, base: Column, out: str) -> DataFrame:
    """Like ``new_ids`` but in (outer, inner) order, e.g. lines of new orders:
    id = base + (rows of all earlier outer keys) + rank of ``inner`` inside
    its outer key (an order, small by nature)."""
    # the running sum reads the counts several times
    counts = materialize(df.groupBy(outer).agg(F.count(F.lit(1)).alias("_n")), "counts")
    before = (running_sum(counts, [], outer, F.col("_n"), "_upto")
              .select(outer, (F.col("_upto") - F.col("_n")).alias("_before")))
    inside = Window.partitionBy(outer).orderBy(inner)
    return (df.withColumn("_rank", F.row_number().over(inside)).join(before, outer)
            .withColumn(out, (base + F.col("_before") + F.col("_rank")).cast("bigint"))
            .drop("_before", "_rank"))
