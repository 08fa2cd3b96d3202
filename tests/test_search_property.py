"""K7 search semantics against a direct implementation of the shop's LIKE:
'%' and '_' are wildcards, no escape character, only A-Z fold case."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

ALPHABET = "aAbBzZ%_\\éÉ .#"


def shop_like_contains(text: str, term: str) -> bool:
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    pattern = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c)
                      for c in term.translate(fold))
    return re.fullmatch(".*" + pattern + ".*", text.translate(fold), re.S) is not None


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(ALPHABET, max_size=8), min_size=1, max_size=12),
       st.text(ALPHABET, max_size=4))
def test_contains_term_matches_shop_like(spark, texts, term):
    from storelake.functions.text import contains_term
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i for r in df.where(contains_term(F.col("t"), term)).collect()}
    want = {i for i, t in enumerate(texts) if shop_like_contains(t, term)}
    assert got == want
