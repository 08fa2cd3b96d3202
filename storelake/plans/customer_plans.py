"""Registered customer queries."""

from storelake.functions.text import sql_contains_term
from storelake.operators import customers as U
from storelake.plans.registry import query
from storelake.sources.requests import new_users

_USER_ROWS = "SELECT user_id, name, email, role, phone, COALESCE(notes, '') AS notes, created_at FROM users"


@query("list_users", _USER_ROWS + " ORDER BY created_at DESC, user_id DESC")
def list_users(t, ctx):
    return U.list_users(t)


USER_TERM = "Staff"


@query("search_users", _USER_ROWS + f"""
    WHERE {sql_contains_term('name', USER_TERM)} OR {sql_contains_term('email', USER_TERM)}
       OR {sql_contains_term('role', USER_TERM)}
    ORDER BY created_at DESC, user_id DESC""")
def search_users(t, ctx):
    return U.search_users(t, USER_TERM)


USER_TERM_WILD = "R#_0%1"


@query("search_users_wildcards", _USER_ROWS + f"""
    WHERE {sql_contains_term('name', USER_TERM_WILD)} OR {sql_contains_term('email', USER_TERM_WILD)}
       OR {sql_contains_term('role', USER_TERM_WILD)}
    ORDER BY created_at DESC, user_id DESC""")
def search_users_wildcards(t, ctx):
    return U.search_users(t, USER_TERM_WILD)


@query("users_by_email", """
    SELECT user_id, name, email, role, phone, notes, created_at FROM users
    WHERE email IN (SELECT email FROM new_users)""")
def users_by_email(t, ctx):
    return U.users_by_email(t, new_users(ctx))


@query("users_by_id", """
    SELECT user_id, name, email, role, phone, notes, created_at FROM users
    WHERE user_id IN (SELECT user_id FROM complaint)""")
def users_by_id(t, ctx):
    return U.users_by_id(t, t.complaint.select("user_id"))


@query("complaints", """
    SELECT c.complaint_id, c.user_id, c.message, c.status, c.created_at,
           u.name AS user_name, u.email AS user_email
    FROM complaint c LEFT JOIN users u ON c.user_id = u.user_id
    ORDER BY c.created_at DESC, c.complaint_id DESC""")
def complaints(t, ctx):
    return U.complaints(t)


@query("complaints_open", """
    SELECT c.complaint_id, c.user_id, c.message, c.status, c.created_at,
           u.name AS user_name, u.email AS user_email
    FROM complaint c LEFT JOIN users u ON c.user_id = u.user_id
    WHERE c.status = 'open' ORDER BY c.created_at DESC, c.complaint_id DESC""")
def complaints_open(t, ctx):
    return U.complaints(t, "open")


@query("user_addresses", """
    SELECT ua.user_id, a.addr_id, a.province, a.city, a.area, a.houseNumber,
           concat_ws(', ', a.houseNumber, a.area, a.city, a.province) AS label
    FROM address a JOIN user_address ua ON a.addr_id = ua.addr_id
    ORDER BY ua.user_id, a.addr_id""")
def user_addresses(t, ctx):
    return U.user_addresses(t)
