from pyspark.sql import functions as F

from playstat.functions import flags as FL
from tests.conftest import rows


def test_listen_and_rewind_flags(spark):
    df = spark.createDataFrame([(49.9,), (50.0,), (100.0,), (100.1,), (150.0,), (None,)], "played_ratio_pct double")
    got = rows(df.select(FL.listen_plus().alias("lp"), FL.rewind_flag().alias("rw")))
    assert got == [(0, 0), (1, 0), (1, 0), (1, 1), (1, 1), (0, 0)]


def test_length_buckets(spark):
    df = spark.createDataFrame([(119.9,), (120.0,), (240.0,), (420.0,), (None,), (-5.0,)],
                               "track_length_seconds double")
    assert [r[0] for r in rows(df.select(FL.length_bucket4()))] == \
        ["0-2min", "2-4min", "4-7min", "7+min", "7+min", "0-2min"]
    df6 = spark.createDataFrame([(x,) for x in (89.0, 90.0, 150.0, 210.0, 270.0, 360.0)],
                                "track_length_seconds double")
    assert [r[0] for r in rows(df6.select(FL.length_bucket6()))] == \
        ["<1.5m", "1.5-2.5m", "2.5-3.5m", "3.5-4.5m", "4.5-6m", "6m+"]


def test_position_third_len6(spark):
    df = spark.range(6).select(F.col("id").alias("pos_in_session"), F.lit(6).alias("session_len"))
    got = [r[0] for r in rows(df.orderBy("pos_in_session").select(FL.position_third()))]
    assert got == ["beginning"] * 2 + ["middle"] * 2 + ["end"] * 2


def test_quartile_from_cuts(spark):
    df = spark.createDataFrame([(v, 2, 4, 6) for v in (1, 2, 3, 5, 6, 7)], "x long, a long, b long, c long")
    assert [r[0] for r in rows(df.select(FL.quartile_from_cuts("x", "a", "b", "c")))] == [1, 1, 2, 3, 3, 4]
