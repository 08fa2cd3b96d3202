"""Fixture folders and small tables for the tests of this folder."""

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


def make_tables(spark, **rows):
    """Tables from small row lists; tables not given are empty."""
    from storelake.schema import SCHEMAS
    from storelake.sources.model import Tables
    return Tables(**{name: spark.createDataFrame(rows.get(name, []), SCHEMAS[name])
                     for name in SCHEMAS})
