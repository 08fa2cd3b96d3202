"""E-mail changes served one after another.

A user who changes to an e-mail holds it until the user's next accepted change; a change to
an e-mail that another user holds at that moment is refused.  ``refused_changes`` gives
the result of that sequence:

* Most changes are decided by aggregates alone: an e-mail is refused until its holder's first
  change, and for good if the first to take it never changes again; the first change
  to a free e-mail, and one that nobody else asks for, is accepted.
* The rest, with all changes of the users concerned, falls into components of the graph of
  users and e-mails, each replayed by one task (``sequence.replay_bins``): components beyond
  ``replay_rows`` take another round for every so many rows.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelake.operators.graph import components
from storelake.operators.sequence import REPLAY_LINES, replay_bins
from storelake.session import discard, materialize

_NEVER = (1 << 63) - 1


def _judged(asks: DataFrame, held: DataFrame) -> DataFrame:
    """Asks with ``ok``: true, false, or null where only a replay can tell."""
    moves = F.when(~F.col("email").eqNullSafe(F.col("cur")), F.col("seq"))
    by_user = asks.groupBy("user_id").agg(F.min(moves).alias("leaves"), F.max("seq").alias("last"))
    owned = (held.join(by_user, "user_id", "left")
             .select(F.col("cur").alias("email"), "user_id", F.coalesce("leaves", F.lit(_NEVER)).alias("leaves")))
    owners = owned.groupBy("email").agg(F.max("leaves").alias("until"), F.count(F.lit(1)).alias("owners"),
                                        F.max_by("user_id", F.struct("leaves", "user_id")).alias("owner"))
    # an e-mail should have one holder; where the table has more, what counts is the last other one to leave
    others = (owned.join(owners.where("owners > 1").select("email", "owner"), "email").where("user_id <> owner")
              .groupBy("email").agg(F.max("leaves").alias("until_other")))
    by_email = (asks.groupBy("email").agg(F.min("seq").alias("first_seq"), F.min_by("user_id", "seq").alias("first_user"),
                                          (F.min("user_id") == F.max("user_id")).alias("alone"))
                .join(by_user.select(F.col("user_id").alias("first_user"), F.col("last").alias("first_last")), "first_user")
                .drop("first_user"))
    holds_last = F.col("owner") == F.col("user_id")
    until = F.when(holds_last, F.col("until_other")).otherwise(F.col("until"))
    ok = (F.when(F.col("owner").isNull(),
                 F.when(F.col("alone") | (F.col("seq") == F.col("first_seq")), True)
                  .when(F.col("first_last") == F.col("first_seq"), False))
          .when(F.col("seq") < until, False)
          .when(holds_last & (F.col("owners") == 1) & (F.col("alone") | (F.col("seq") < F.col("until"))), True))
    return (asks.join(owners.join(others, "email", "left"), "email", "left").join(by_email, "email")
            .select("seq", "user_id", "email", "cur", ok.alias("ok")))


def _replay(rows: pd.DataFrame) -> pd.DataFrame:
    """Serve one bin's changes in order; ``ok`` is given for those that are accepted anyway, and
    ``fixed`` marks e-mails whose holder makes no change in any bin."""
    rows = rows.sort_values("seq")
    holds = dict(zip(rows["user_id"].tolist(), rows["cur"].tolist()))
    holders: dict = {}
    for user, email in holds.items():
        holders.setdefault(email, set()).add(user)
    accepted = []
    for user, email, sure, fixed in zip(rows["user_id"].tolist(), rows["email"].tolist(), rows["ok"].tolist(), rows["fixed"].tolist()):
        fits = bool(sure) or not (fixed or holders.get(email, set()) - {user})
        accepted.append(fits)
        if fits:
            holders.get(holds[user], set()).discard(user)
            holders.setdefault(email, set()).add(user)
            holds[user] = email
    return pd.DataFrame({"seq": rows["seq"], "user_id": rows["user_id"], "email": rows["email"], "fits": accepted})


def refused_changes(users: DataFrame, asks: DataFrame, replay_rows: int = REPLAY_LINES) -> DataFrame:
    """(seq): the e-mail changes that are refused.

    ``users``: user_id and email.  ``asks``: seq (unique), user_id and email, not null; those of unknown
    users do nothing.  E-mails are compared as they are.
    """
    wanted = asks.select("email").distinct()
    held = materialize(users.select("user_id", F.col("email").alias("cur"))
                       .join(asks.select("user_id").distinct().withColumn("asks", F.lit(True)), "user_id", "left")
                       .join(wanted.select(F.col("email").alias("cur")).withColumn("asked", F.lit(True)), "cur", "left")
                       .where("asks OR asked").select("user_id", "cur"), "held-emails")
    open_ = materialize(asks.select("seq", "user_id", "email").join(held, "user_id"), "asks")
    refused = []
    while True:
        judged = materialize(_judged(open_, held.where("cur IS NOT NULL")), "judged")
        refused.append(judged.where("NOT ok").select("seq"))
        unknown = judged.where("ok IS NULL").select("email").distinct()
        links = (judged.where("ok IS NULL OR ok").join(unknown, "email", "left_semi").select("user_id", "email")
                 .unionByName(held.select("user_id", F.col("cur").alias("email")).join(unknown, "email", "left_semi")).distinct())
        links = materialize(links, "links")
        rows = judged.where("ok IS NULL OR ok").join(links.select("user_id").distinct(), "user_id", "left_semi")
        rows = materialize(rows.withColumn("ok", F.coalesce("ok", F.lit(False))), "rows")
        left = rows.count()
        if not left:
            break
        if left <= replay_rows:
            now, later = rows.withColumn("_bin", F.lit(0)), None
        else:
            node = F.xxhash64(F.lit("u"), F.col("user_id"))
            comp = components(links.select(node.alias("a"), F.xxhash64(F.lit("e"), F.col("email")).alias("b")))
            rows = materialize(rows.withColumn("node", node).join(comp.withColumnRenamed("comp", "_comp"), "node").drop("node"), "rows")
            now, later = replay_bins(rows, left, "seq", replay_rows)
        fixed = (held.join(now.select("user_id"), "user_id", "left_anti").select(F.col("cur").alias("email")).distinct()
                 .withColumn("fixed", F.lit(True)))
        now = now.join(fixed, "email", "left").withColumn("fixed", F.coalesce("fixed", F.lit(False)))
        done = materialize(now.groupBy("_bin").applyInPandas(_replay, "seq long, user_id long, email string, fits boolean"), "replayed")
        refused.append(done.where("NOT fits").select("seq"))
        if later is None:
            break
        # what the replayed changes leave behind is where the others begin
        moved = done.where("fits").groupBy("user_id").agg(F.max_by("email", "seq").alias("now"))
        new_held = materialize(held.join(moved, "user_id", "left").select("user_id", F.coalesce("now", "cur").alias("cur")), "held-emails")
        new_open = materialize(later.select("seq", "user_id", "email").join(new_held, "user_id"), "asks")
        discard(held, open_)
        held, open_ = new_held, new_open
        if open_.isEmpty():
            break
    return reduce(DataFrame.unionByName, refused)
