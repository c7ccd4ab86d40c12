from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from fathomline.functions.times import bucket, normalized, parse_time


@pytest.mark.parametrize(
    "value,seconds",
    [
        (1700000000, 1700000000), (1700000000123, 1700000000), (1700000000123456, 1700000000), (1700000000123456789, 1700000000), (-5, -5), (-1700000000123, -1700000000), (10**20, None),
        (12.9, 12), (-12.1, -13), ("2024-02-15", 1707955200), ("2024-02-15T00:00:00Z", 1707955200), ("2024-02-15T01:00:00.5+01:00", 1707955200), ("1700000000123", 1700000000), ("soon", None), ("2024-13-01", None), (True, None), (None, None),
    ],
)
def test_literals(value, seconds):
    assert parse_time(value) == seconds


def test_columns_as_literals(spark):
    texts = ["1700000000", "1700000000123", "-1700000000123", "1700000000123456", "1700000000123456789", "100000000000000000000", "2024-02-15", "2024-02-15T01:00:00+01:00", "soon", None, "12.9", "-12.1", "2024-13-01"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("s", normalized(F.col("t"))).orderBy("i").collect()
    assert [r["s"] for r in got] == [parse_time(float(t)) if t and "." in t else parse_time(t) for t in texts]


def at(text):
    return int(datetime.fromisoformat(text).replace(tzinfo=timezone.utc).timestamp())


@pytest.mark.parametrize(
    "when,unit,options,start",
    [
        ("2024-02-15T10:20:30", "month", {}, "2024-02-01"), ("2024-01-03T10:00:00", "week", {}, "2024-01-01"), ("2024-01-03T10:00:00", "week", {"week_start": "sun"}, "2023-12-31"), ("2024-01-07T00:00:00", "week", {"week_start": "sun"}, "2024-01-07"),
        ("2024-07-01T12:34:56", "hour", {}, "2024-07-01T12:00:00"), ("2024-12-31T23:59:59", "year", {}, "2024-01-01"), ("2024-01-03T02:00:00", "day", {"zone": "US/Eastern"}, "2024-01-02T05:00:00"), ("1970-01-08T01:00:00", "week", {"naive": True}, "1970-01-08"), ("1969-12-31T23:00:00", "day", {"naive": True}, "1969-12-31"),
    ],
)
def test_buckets(spark, when, unit, options, start):
    got = spark.range(1).select(bucket(F.lit(at(when)).cast("long"), unit, **options).alias("b")).first()["b"]
    assert got == at(start)
