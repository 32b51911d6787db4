"""Helpers of these tests."""

import datetime as dt

SF = "/root/testdata/sf0.001"
DAY = dt.datetime(2025, 1, 1)


def at(day):
    return DAY + dt.timedelta(days=day)


def clashing(df):
    """The table with further columns of names that operators use inside."""
    from pyspark.sql import functions as F

    for name in ("n", "a", "b", "h", "tf", "score", "_salt", "place", "class", "part", "host", "key", "kind", "form", "raw", "segment", "rank", "count", "tokens", "words"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit("x"))
    return df


def twice(df):
    """All rows two times, in another partitioning."""
    return df.unionByName(df).repartition(3)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)
