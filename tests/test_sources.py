import datetime as dt

import pytest
from pyspark.sql import functions as F

from tarnis.functions.columns import MONTHS
from tarnis.operators.reshape import to_long
from tarnis.plans.flows import FLOW_SCHEMA, daily_flow
from tarnis.sources import files
from tarnis.sources.phases import phase_table


def test_na_reads_as_null(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b\n1.5,"x,y"\nNA,NA\nbad,z\n')
    df = files.read_table(spark, str(tmp_path / "t.csv"), "a double, b string")
    assert [tuple(r) for r in df.collect()] == [(1.5, "x,y"), (None, None), (None, "z")]


def test_month_matrix(spark, tmp_path):
    rows = ["Year " + " ".join(MONTHS), "2000 " + " ".join(str(i / 10) for i in range(12)), "  2001   99.99 " + " ".join(["1"] * 10)]
    (tmp_path / "m.txt").write_text("\n".join(rows) + "\n\n")
    df = files.read_month_matrix(spark, str(tmp_path / "m.txt"), sentinels=[99.99])
    got = {r.Year: r for r in df.collect()}
    assert set(got) == {2000, 2001}
    assert got[2000].Dec == 1.1
    assert got[2001].Jan is None and got[2001].Feb == 1.0 and got[2001].Dec is None


def test_block(spark, tmp_path):
    lines = ["note, with comma"] * 7 + ["Parameters,Units,,,36892,36893", "Nitrate,mg/L,,,0.5,<0.1", '"Temperature, surface",C,,,,4', "last,x,,,1,1"]
    (tmp_path / "b.csv").write_text("\n".join(lines))
    path = str(tmp_path / "b.csv")
    names = files.block_header(spark, path)
    assert names == ["Parameters", "Units", "...3", "...4", "36892", "36893"]
    df = files.read_block(spark, path, names, last_row=10, drop=["...3", "...4"])
    assert [r.Parameters for r in df.orderBy("line").collect()] == ["Nitrate", "Temperature, surface"]
    from tarnis.plans.lab import block_long

    got = [tuple(r) for r in block_long(df).orderBy("date_ymd").collect()]
    assert got == [("Nitrate", dt.date(2001, 1, 1), 2001, 0.5), ("Nitrate", dt.date(2001, 1, 2), 2001, None)]


def test_parse_problems(spark):
    df = spark.createDataFrame([("1", "2000-01-01"), ("x", "never"), ("x", None)], "n string, d string")
    got = {tuple(r) for r in files.parse_problems(df, {"n": "double", "d": "date"}).collect()}
    assert got == {("n", "x", 2), ("d", "never", 1)}


def test_partitioned_write_and_slice_overwrite(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([("s", 2000, 1.0), ("s", 2001, 2.0), ("t", 2001, 3.0)], "site string, year int, x double")
    files.write_table(df, path, "parquet", ["site", "year"])
    new = spark.createDataFrame([("s", 2001, 9.0)], "site string, year int, x double")
    files.overwrite_partitions(new, path, ["site", "year"])
    got = sorted(tuple(r) for r in spark.read.parquet(path).select("site", "year", "x").collect())
    assert got == [("s", 2000, 1.0), ("s", 2001, 9.0), ("t", 2001, 3.0)]


def test_phase_needs_a_length(spark):
    with pytest.raises(ValueError, match="not after"):
        phase_table(spark, [("x", 2000, 2000)])


def test_daily_flow_edges(spark, tmp_path):
    rows = [
        "date," + ",".join(f.name for f in FLOW_SCHEMA[1:]),
        "12/31/1983,1,1,4,1,1",
        "1/1/1984,1,2,4,1,1",
        "12/31/2004,1,2,0,oops,1",
        "6/1/2010,NA,2,4,1,1",
        "1/1/2023,1,1,4,1,1",
    ]
    (tmp_path / "f.csv").write_text("\n".join(rows))
    raw = files.read_table(spark, str(tmp_path / "f.csv"), FLOW_SCHEMA)
    out = daily_flow(raw).orderBy("date").collect()
    assert [str(r.date) for r in out] == ["1984-01-01", "2004-12-31", "2010-06-01"]
    assert (out[0].RC_IC_cms, out[0].RC_IC_percent, out[0].RC_IC_U_percent) == (3.0, 75.0, 100.0)
    assert out[1].DOY == 366 and out[1].RC_IC_percent is None and out[1]["SK05JG006.cms"] is None
    assert out[2].RC_IC_cms is None


def test_streaming_frames_take_row_operators(spark, tmp_path):
    """Row-wise operators are plain expressions, so they run on a stream as they are."""
    from tarnis.operators import filters, frame

    src = str(tmp_path / "in")
    spark.createDataFrame([("1/1/1984", "1", "2", "4", "1", "1"), ("1/1/1999", "1", "x", "4", "1", "1")], FLOW_SCHEMA).write.csv(src, header=True)
    stream = spark.readStream.schema(FLOW_SCHEMA).csv(src, header=True)
    out = frame.rename(daily_flow(stream), {"RC_IC_cms": "QWS"})
    kept = filters.complete_cases(out, ["QWS"])
    q = kept.writeStream.format("memory").queryName("flow_stream").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [r.QWS for r in spark.table("flow_stream").collect()] == [3.0]


def test_long_months_to_daily(spark):
    from tarnis.plans.climate import climate_annual, climate_daily

    def matrix(name, first):
        vals = [(2000, *[first + m for m in range(12)]), (2001, *[first + 12 + m if m != 5 else None for m in range(12)])]
        return spark.createDataFrame(vals, "Year int, " + ", ".join(f"{m} double" for m in MONTHS))

    daily = climate_daily(matrix("PDO", -30.0), matrix("SOI", 1.0))
    assert daily.count() == 366 + 365
    by_month = {(r.y, r.m): r.x for r in daily.groupBy(F.year("date").alias("y"), F.month("date").alias("m")).agg(F.max("PDO_3MON_AVG").alias("x")).collect()}
    assert by_month[(2000, 1)] is None and by_month[(2001, 12)] is None  # ends
    assert [by_month[(2001, m)] for m in (5, 6, 7)] == [None] * 3  # around the gap
    assert by_month[(2000, 12)] == -19.0
    annual = {r.Year: r for r in climate_annual(daily).collect()}
    assert annual[2000].PDO is None and annual[2000].PDO_desc is None and annual[2000].Desc == "Other"
    assert to_long(matrix("PDO", 0.0), ["Year"], list(MONTHS), "m", "v").count() == 24
