"""Times and tags as columns."""

import datetime as dt

from pyspark.sql import functions as F

from trackplace.functions import tags, times


def test_tags(spark):
    rows = [(48.1372, 11.5756, 519.4), (-33.8688, -5.2093, -430.5), (0.0, 0.0, None)]
    df = spark.createDataFrame(rows, "lat double, lon double, ele double")
    got = df.select(
        tags.iso6709(F.col("lat"), F.col("lon"), F.col("ele")).alias("iso"), tags.dms_rational(F.col("lat")).alias("dms"),
        tags.lat_ref(F.col("lat")).alias("ns"), tags.lon_ref(F.col("lon")).alias("ew"),
        tags.alt_rational(F.col("ele")).alias("alt"), tags.alt_ref(F.col("ele")).alias("ref"),
        tags.xmp_coord(F.col("lat"), "N", "S").alias("xmp"),
    ).collect()
    assert tuple(got[0]) == ("+48.1372+011.5756+519.400/", "48/1,8/1,139200/10000", "N", "E", "519400/1000", "0", "48,8.232000N")
    assert tuple(got[1])[:6] == ("-33.8688-005.2093-430.500/", "33/1,52/1,76800/10000", "S", "W", "430500/1000", "1")
    assert tuple(got[2]) == ("+00.0000+000.0000/", "0/1,0/1,0/10000", "N", "E", None, None, "0,0.000000N")


def test_position_text_is_rounded_by_twelve_decimals(spark):
    rows = [(-46.96784999999999, -482.97, 161.83749999999998), (0.00004, -0.00004, -0.0004), (1.0, 2.0, float("nan"))]
    df = spark.createDataFrame(rows, "lat double, lon double, ele double")
    got = [r.iso for r in df.select(tags.iso6709(F.col("lat"), F.col("lon"), F.col("ele")).alias("iso")).collect()]
    assert got[:2] == ["-46.9679-482.9700+161.838/", "+00.0000+000.0000+000.000/"]
    assert got[2].startswith("+01.0000+002.0000") and "NaN" in got[2]


def test_track_times(spark):
    texts = ["2026-07-17T10:00:00Z", " 2026-07-17T12:00:00.5+02:00 ", "2026-07-17T12:00", "2026-07-17", "10:00:00Z", "", "x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.u for r in df.select(F.unix_millis(times.parse_track_time(F.col("t"), "Europe/Berlin")).alias("u")).collect()]
    base = 1_784_282_400_000
    assert got == [base, base + 500, base, None, None, None, None]


def test_offsets(spark):
    texts = ["+02:00", "-0530", "+5", "Z", "+19:00", "2:00", "+02:0", "", None, "-03"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.o for r in df.select(times.offset_seconds(F.col("t")).alias("o")).collect()]
    assert got == [7200, -19800, 18000, 0, None, None, None, None, None, -10800]
    assert times.clock_offset_ms(-0.00001) == 0 and times.clock_offset_ms(1.5) == 90_000


def test_capture_times(spark):
    local = dt.datetime(2026, 7, 17, 12, 0)
    rows = [(local, 32400, 0, 0), (local, None, 0, 0), (None, None, 5_000_999, 9_000_000)]
    df = spark.createDataFrame(rows, "l timestamp_ntz, o int, c long, m long")
    cols = [F.col(c) for c in "locm"]
    noon = 1_784_289_600_000_000
    got = df.select(times.capture_us(*cols, "Europe/Berlin", 500).alias("i"),
                    times.capture_local_us(F.col("l"), F.col("c"), F.col("m"), "Europe/Berlin").alias("n")).collect()
    assert [r.i for r in got] == [noon - 9 * 3_600_000_000 + 500_000, noon - 2 * 3_600_000_000 + 500_000, 5_500_000]
    assert [r.n for r in got] == [noon, noon, 3_605_000_000]
