from __future__ import annotations

from tidewright.config import THIRTY_SECONDS, BuildConfig
from tidewright.sources import tables
from tidewright.streaming.lows import low_windows


def test_track_values_from_csv(spark, tmp_path):
    (tmp_path / "track-0007.csv").write_text("Time,HR\n0.4,80\n1.6,-nan(ind)\n2.5,NaN\n")
    got = [tuple(x) for x in tables.read_track_values(spark, str(tmp_path), "hr").orderBy("t").collect()]
    assert got == [(7, 0.4, 80.0), (7, 1.6, None), (7, 2.5, None)]


def test_write_and_point_read(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0)], "caseid int, v double")
    tables.write_by_case(df, f"{tmp_path}/out")
    assert [x["v"] for x in tables.one_case(spark, f"{tmp_path}/out", 2).collect()] == [2.0]
    tables.write_by_case(df, f"{tmp_path}/bucketed", buckets=2)
    assert spark.read.parquet(f"{tmp_path}/bucketed").count() == 2


def test_build_marker(tmp_path):
    folder = str(tmp_path / "set")
    assert not tables.built(folder, THIRTY_SECONDS)
    tables.mark_built(folder, THIRTY_SECONDS)
    assert tables.built(folder, THIRTY_SECONDS) and not tables.built(folder, BuildConfig())


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"), 1), (2.0, 2)], "v double, k int")
    assert [x["v"] for x in tables.no_nan(df).orderBy("k").collect()] == [None, 2.0]


def test_low_windows_stream(spark, tmp_path):
    rows = [(1, "2024-01-01 00:10:00", 40.0), (1, "2024-01-01 01:00:00", 41.0), (2, "2024-01-01 00:30:00", 90.0), (1, "2024-01-02 00:00:00", 99.0)]
    spark.createDataFrame(rows, "caseid int, ts string, value double").selectExpr("caseid", "timestamp(ts) as ts", "value").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("caseid int, ts timestamp, value double").parquet(f"{tmp_path}/in")
    q = low_windows(stream, 65.0).writeStream.outputMode("append").format("memory").queryName("lows").start()
    q.processAllAvailable()
    q.stop()
    assert [(x["caseid"], x["n"]) for x in spark.table("lows").collect()] == [(1, 2)]


def test_case_and_track_tables(spark, tmp_path):
    (tmp_path / "cases.csv").write_text("caseid,bmi,age,extra\n7,21.5,40,x\n8,,,y\n")
    (tmp_path / "tracks.csv").write_text("caseid,tname,tid\n7,Solar8000/ART_MBP,abc\n")
    cases = tables.read_cases(spark, str(tmp_path / "cases.csv"))
    assert cases.columns == tables.CASES.names
    assert [(x["caseid"], x["age"], x["bmi"], x["opname"]) for x in cases.orderBy("caseid").collect()] == [(7, 40, 21.5, None), (8, None, None, None)]
    assert [tuple(x) for x in tables.read_tracks(spark, str(tmp_path / "tracks.csv")).collect()] == [(7, "Solar8000/ART_MBP", "abc")]


def test_results_and_csv_can_be_read_again(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5), (2, None)], "caseid int, score double")
    for _ in range(2):
        tables.write_results(df, str(tmp_path / "results"))
    assert sorted(map(tuple, tables.read_results(spark, str(tmp_path / "results")).collect())) == [(1, 0.5), (2, None)]
    tables.write_csv(df, str(tmp_path / "csv"))
    again = spark.read.csv(str(tmp_path / "csv"), header=True, schema="caseid int, score double")
    assert sorted(map(tuple, again.collect())) == [(1, 0.5), (2, None)]


def test_folders_of_cases_by_pattern(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (12, 3.0)], "caseid int, v double")
    tables.write_by_case(df, f"{tmp_path}/out")
    every = tables.cases_matching(spark, f"{tmp_path}/out").select("caseid", "v")
    assert sorted(map(tuple, every.collect())) == [(1, 1.0), (2, 2.0), (12, 3.0)]
    assert sorted(x["caseid"] for x in tables.cases_matching(spark, f"{tmp_path}/out", "caseid=1*").collect()) == [1, 12]
