"""Running values over pieces of time give what one window over whole groups gives."""

import datetime

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from evidentia.operators import evidence, ordered, runs


def versions(spark):
    """A record with a third of all rows, short records, null keys and dates, gaps over empty months, equal dates."""
    day = lambda k: datetime.date(2020, 1, 30) + datetime.timedelta(days=k)
    rows = [("hot", v, day(v * 7 % 400)) for v in range(300)]
    rows += [(f"r{v % 97}", v, day(v * 31 % 900)) for v in range(500)]
    rows += [(None, 1, day(3)), (None, 2, day(80)), ("n", 1, None), ("n", 2, None), ("n", 3, day(5)), ("one", 1, day(0))]
    return spark.createDataFrame(rows, "record string, version long, date date")


@pytest.mark.parametrize("piece, crowd", [("day", 0), ("month", 50), ("month", 2), ("year", 0), ("month", ordered.CROWD)])
def test_version_history_equals_whole_windows(spark, piece, crowd):
    df = versions(spark)
    w = Window.partitionBy("record").orderBy("date", "version")
    want = df.select("*", F.row_number().over(w).cast("long").alias("number"), F.first("date").over(w).alias("first_date"), F.datediff("date", F.lag("date").over(w)).alias("gap_days"))
    got = evidence.version_history(df, piece, crowd)
    assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert evidence.version_history(df.limit(0), piece, crowd).count() == 0


def test_no_task_holds_a_hot_group(spark):
    """The hot record is cut into pieces of a tenth of its rows, and is numbered through."""
    df = versions(spark).withColumn("extra", F.lit(1))
    out = ordered.with_previous(df, "record", ("date", "version"), "month", ("version",), 50)
    assert {"extra", "_number", "_first", "_before"} <= set(out.columns)
    hot = df.where("record = 'hot'").groupBy(F.date_trunc("month", "date")).count()
    assert hot.count() > 10 and hot.agg(F.max("count")).first()[0] < 40
    numbers = [r["_number"] for r in out.where("record = 'hot'").orderBy("_number").collect()]
    assert numbers == list(range(1, 301))


@pytest.mark.parametrize("crowd", [0, 3, ordered.CROWD])
def test_audit_over_pieces(spark, crowd):
    at = lambda h: datetime.datetime(2024, 5, 1) + datetime.timedelta(hours=h)
    states = ["draft", "queued", "running", "running", "completed", "queued"]
    rows = [("a", at(10 * k), k, s) for k, s in enumerate(states)] + [("b", None, 0, "queued"), ("b", at(0), 1, "running"), (None, at(1), 0, "draft")]
    df = spark.createDataFrame(rows, "run_id string, at timestamp, seq long, state string")
    got = {(r["run_id"], r["seq"]): (r["previous"], r["allowed"]) for r in runs.run_event_audit(df, crowd=crowd).collect()}
    assert [got["a", k] for k in range(6)] == [(None, True), ("draft", True), ("queued", True), ("running", True), ("running", True), ("completed", False)]
    assert got["b", 0] == (None, False) and got["b", 1] == ("queued", True) and got[None, 0] == (None, True)


def test_the_best_of_all_need_no_window_over_all(spark):
    df = spark.createDataFrame([(i, i * 37 % 101 / 10) for i in range(200)], "candidate long, mean double")
    got = evidence.rank_candidates(df, 7, "mean", "candidate").orderBy("rank").collect()
    want = sorted(df.collect(), key=lambda r: (-r["mean"], r["candidate"]))[:7]
    assert [(r["candidate"], r["rank"]) for r in got] == [(r["candidate"], k + 1) for k, r in enumerate(want)]
