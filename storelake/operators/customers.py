"""Customer operators: user listings and lookups, complaints, addresses
(P1, P2, P7, L1, L2, J5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelake.functions.text import address_label, contains_term
from storelake.operators.joins import left_join_dim
from storelake.sources.model import Tables

USER_COLS = ["user_id", "name", "email", "role", "phone", "notes", "created_at"]


def _user_rows(users: DataFrame) -> DataFrame:
    return users.select("user_id", "name", "email", "role", "phone",
                        F.coalesce("notes", F.lit("")).alias("notes"), "created_at")


def list_users(t: Tables) -> DataFrame:
    """Users with notes '' for NULL, newest first (user_id breaks ties)."""
    return _user_rows(t.users).orderBy(F.desc("created_at"), F.desc("user_id"))


def search_users(t: Tables, q: str) -> DataFrame:
    """Users whose name, e-mail or role contains ``q`` (K7 search)."""
    cond = contains_term("name", q) | contains_term("email", q) | contains_term("role", q)
    return _user_rows(t.users.where(cond)).orderBy(F.desc("created_at"), F.desc("user_id"))


def users_by_email(t: Tables, emails: DataFrame) -> DataFrame:
    """L1: users whose e-mail is in the key set (exact, case-sensitive)."""
    return t.users.join(emails.select("email"), "email", "left_semi").select(*USER_COLS)


def users_by_id(t: Tables, ids: DataFrame) -> DataFrame:
    """L2: users whose id is in the key set."""
    return t.users.join(ids.select("user_id"), "user_id", "left_semi").select(*USER_COLS)


def complaints(t: Tables, status: str | None = None) -> DataFrame:
    """Complaints (optionally one status) with the user's name and e-mail
    (NULL for deleted users), newest first."""
    c = t.complaint
    if status:
        c = c.where(F.col("status") == status)
    users = t.users.select("user_id", F.col("name").alias("user_name"),
                           F.col("email").alias("user_email"))
    return left_join_dim(c, users, "user_id").orderBy(F.desc("created_at"), F.desc("complaint_id"))


def user_addresses(t: Tables, user_ids: DataFrame | None = None) -> DataFrame:
    """(user_id, address) for the requested users (all when None), by addr_id,
    with the checkout label of F10."""
    links = t.user_address.select("user_id", "addr_id")
    if user_ids is not None:
        links = links.join(user_ids.select("user_id"), "user_id", "left_semi")
    return (links.join(t.address, "addr_id")
            .select("user_id", "addr_id", "province", "city", "area", "houseNumber",
                    address_label(F.col("houseNumber"), F.col("area"), F.col("city"),
                                  F.col("province")).alias("label"))
            .orderBy("user_id", "addr_id"))
