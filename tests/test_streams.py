"""Streams over small literal inputs: state, timers, restarts, snapshots and arriving files."""

import datetime
import hashlib
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from evidentia.operators import runs
from evidentia.plans import runs as plan_runs
from evidentia.plans import streams
from evidentia.sources import files
from evidentia.streaming import arrivals
from evidentia.streaming import run_streams as st
from evidentia.streaming.snapshot import Snapshot

EVENTS = "run_id long, at timestamp, seq long, state string"
STATUS = "run_id long, at timestamp, seq long, state string, events long"


def at(hour, minute, second=0):
    return datetime.datetime(2024, 5, 1, hour, minute, second)


def put(spark, folder, name, rows, schema=EVENTS):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}")


def stored(spark, checkpoint, name):
    """Rows of an operator's state."""
    before = spark.conf.get(st.STORE)
    spark.conf.set(st.STORE, st.ROCKS)
    try:
        return spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load().collect()
    finally:
        spark.conf.set(st.STORE, before)


def test_overdue_sessions_are_told_once_and_state_ends(spark, tmp_path):
    batches = [
        [(1, at(10, 0), 1, "running"), (2, at(10, 0), 2, "running"), (2, at(10, 5), 3, "completed"), (3, at(10, 1), 4, "running")],
        [(3, at(10, 45), 5, "completed"), (4, at(12, 0), 6, "running")],
        [(1, at(13, 0), 7, "completed"), (4, at(12, 10), 8, "failed"), (5, at(14, 0), 9, "running")],
    ]
    events = st.read_stream(spark, f"{tmp_path}/in/*", EVENTS)
    for i, rows in enumerate(batches):
        put(spark, f"{tmp_path}/in", i, rows)
        if i == 1:
            st.drained(st.stream_overdue_runs(events, ["completed", "failed"]), str(tmp_path / "run"))
            assert {r["key"]["run_id"] for r in stored(spark, f"{tmp_path}/run/checkpoint", "sessions")} == {4}
    # a restart from the checkpoint reads on
    out = st.drained(st.stream_overdue_runs(events, ["completed", "failed"]), str(tmp_path / "run"))
    got = sorted((r["run_id"], r["started_us"]) for r in spark.read.parquet(out).collect())
    everything = spark.createDataFrame([r for b in batches for r in b], EVENTS)
    want = runs.overdue_sessions(everything, ["completed", "failed"]).select("run_id", F.unix_micros("started").alias("us"))
    assert got == sorted(map(tuple, want.collect())) and [g[0] for g in got] == [1, 3]
    # run 5 is open; run 1 went on after its gap and has ended, all others are over
    assert {r["key"]["run_id"] for r in stored(spark, f"{tmp_path}/run/checkpoint", "sessions")} == {5}


def test_overdue_stream_equals_its_twin_on_random_events(spark, tmp_path):
    rng = random.Random(3)
    rows = sorted(((rng.randrange(6), at(1, 0) + datetime.timedelta(seconds=rng.randrange(20 * 3600)), k, rng.choice(["running", "running", "completed"])) for k in range(250)), key=lambda r: r[1])
    rows += [(1, rows[-1][1] + datetime.timedelta(minutes=5), 999, "running")]
    for i in range(0, len(rows), 50):
        part = rows[i : i + 50]
        rng.shuffle(part)
        put(spark, f"{tmp_path}/in", f"{i:05d}", part)
    events = st.read_stream(spark, f"{tmp_path}/in/*", EVENTS)
    out = st.drained(st.stream_overdue_runs(events, ["completed"], 20, 45, "0 seconds"), str(tmp_path / "run"))
    got = sorted((r["run_id"], r["started_us"]) for r in spark.read.parquet(out).collect())
    want = runs.overdue_sessions(spark.createDataFrame(rows, EVENTS), ["completed"], 20, 45).select("run_id", F.unix_micros("started").alias("us"))
    assert got == sorted(map(tuple, want.collect())) and len(got) > 20


class Calls:
    """Stands in for the handle and the value of a processor: keeps the value and the calls."""

    def __init__(self):
        self.value, self.timers, self.calls = None, [], 0

    def getValueState(self, *_):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def clear(self):
        self.update(None)

    def registerTimer(self, t):
        self.calls += 1
        self.timers.append(t)

    def getCurrentWatermarkInMs(self):
        return self.watermark


def test_a_run_has_one_timer_however_many_sessions(spark):
    handle, processor, hour = Calls(), st.Sessions(["completed"], 30 * 60_000_000, 30 * 60_000_000), 3_600_000_000
    processor.init(handle)
    handle.watermark = 0
    rows = pd.DataFrame({"at_us": [k * hour for k in range(300)], "state": "running"})
    assert list(processor.handleInputRows((7,), iter([rows]), handle)) == []
    assert handle.timers == [30 * 60_000 + 1] and handle.calls <= 4 and len(handle.value[0]) == 300
    handle.watermark = 200 * hour // 1000
    told = pd.concat(processor.handleExpiredTimer((7,), handle, None))
    assert told["started_us"].tolist() == [k * hour for k in range(200)] and set(told["run_id"]) == {7}
    assert handle.timers[1:] == [handle.watermark + 30 * 60_000 + 1] and handle.calls <= 8 and len(handle.value[0]) == 100
    handle.watermark = 400 * hour // 1000
    assert len(pd.concat(processor.handleExpiredTimer((7,), handle, None))) == 100 and handle.value is None


def test_the_overdue_query_reads_files_in_any_order_of_time(spark, tmp_path):
    for i, hours in enumerate([(9, 1, 5), (2, 8), (3, 1)]):
        rows = [(10 * i + k, at(h, k), h % 2, "view") for k, h in enumerate(hours)]
        put(spark, f"{tmp_path}/events.parquet", i, rows, "event_id long, ts timestamp_ntz, user_id long, event_type string")
    os.makedirs(tmp_path / "flat")
    parts = sorted(p for p in (tmp_path / "events.parquet").rglob("*.parquet") if p.is_file())
    (tmp_path / "flat/events.parquet").mkdir()
    for i, p in enumerate(parts):
        p.rename(tmp_path / f"flat/events.parquet/part-{i}.parquet")
    got = sorted(map(tuple, streams.overdue(spark, f"{tmp_path}/flat").collect()))
    want = plan_runs.QUERIES["st3_overdue_sessions_batch"](spark, f"{tmp_path}/flat")
    assert got == sorted(map(tuple, want.collect())) and len(got) >= 5


def test_a_run_that_goes_on_after_a_gap_is_two_sessions(spark):
    rows = [(1, at(10, 0), 1, "a"), (1, at(10, 30), 2, "a"), (1, at(11, 0, 1), 3, "a"), (1, at(11, 10), 4, "done"), (2, at(15, 0), 5, "a")]
    got = runs.overdue_sessions(spark.createDataFrame(rows, EVENTS), ["done"]).select("run_id", F.date_format("started", "HH:mm:ss").alias("s"))
    assert [r["s"][3:] for r in got.collect()] == ["00:00"]
    with pytest.raises(ValueError, match="close before"):
        st.stream_overdue_runs(spark.createDataFrame(rows, EVENTS), ["done"], 30, 10)


def test_audit_goes_on_after_a_restart(spark, tmp_path):
    events = st.read_stream(spark, f"{tmp_path}/in/*", EVENTS)
    put(spark, f"{tmp_path}/in", 0, [(1, at(10, 1), 2, "queued"), (1, at(10, 0), 1, "draft"), (2, at(10, 0), 3, "running")])
    st.drained(st.stream_run_audit(events), str(tmp_path / "run"), idle_batches=False)
    put(spark, f"{tmp_path}/in", 1, [(1, at(10, 2), 4, "running"), (1, at(10, 3), 5, "draft"), (2, at(10, 9), 6, "completed")])
    out = st.drained(st.stream_run_audit(events), str(tmp_path / "run"), idle_batches=False)
    got = {r["seq"]: (r["previous"], r["allowed"]) for r in spark.read.parquet(out).collect()}
    assert got == {1: (None, True), 2: ("draft", True), 3: (None, False), 4: ("queued", True), 5: ("running", False), 6: ("running", True)}
    assert {(r["key"]["run_id"], r["value"]["value"]["state"] if "value" in r["value"].asDict() else r["value"]["state"]) for r in stored(spark, f"{tmp_path}/run/checkpoint", "last")} == {(1, "draft"), (2, "completed")}


def test_audit_state_has_a_time_to_live(spark, tmp_path):
    events = st.read_stream(spark, f"{tmp_path}/in/*", EVENTS)
    put(spark, f"{tmp_path}/in", 0, [(1, at(10, 0), 1, "draft")])
    st.drained(st.stream_run_audit(events, keep_days=1 / 86_400_000), str(tmp_path / "run"), idle_batches=False)
    put(spark, f"{tmp_path}/in", 1, [(1, at(10, 1), 2, "queued")])
    out = st.drained(st.stream_run_audit(events, keep_days=1 / 86_400_000), str(tmp_path / "run"), idle_batches=False)
    assert {r["seq"]: r["previous"] for r in spark.read.parquet(out).collect()} == {1: None, 2: None}


def rows_of(df):
    return sorted((r["run_id"], r["seq"], r["state"], r["events"]) for r in df.collect())


def test_snapshot_holds_one_row_per_run(spark, tmp_path):
    rng = random.Random(1)
    batches = [[(rng.randrange(30), at(10, rng.randrange(60)), 100 * b + k, rng.choice("xyz")) for k in range(40)] for b in range(4)]
    table = Snapshot(spark, f"{tmp_path}/t", STATUS, "run_id", 4)
    assert table.read().count() == 0
    for n, rows in enumerate(batches):
        assert table.merge(st.status_of(spark.createDataFrame(rows, EVENTS)), n, st.newer_status)
        so_far = spark.createDataFrame([r for b in batches[: n + 1] for r in b], EVENTS)
        assert rows_of(table.read()) == rows_of(runs.latest_run_state(so_far))
    before, version = rows_of(table.read()), table.state()[0]
    # a batch that is played again changes nothing
    assert not table.merge(st.status_of(spark.createDataFrame(batches[2], EVENTS)), 2, st.newer_status)
    assert rows_of(table.read()) == before and table.state()[0] == version
    # one run's batch rewrites its bucket alone
    table.merge(st.status_of(spark.createDataFrame([(3, at(23, 0), 9999, "last")], EVENTS)), 4, st.newer_status)
    assert sorted(os.listdir(f"{tmp_path}/t/data/version={version + 1}")) == sorted(["_SUCCESS", "._SUCCESS.crc", next(x for x in os.listdir(f"{tmp_path}/t/data/version={version + 1}") if x.startswith("bucket="))])
    assert (3, 9999, "last") in [r[:3] for r in rows_of(table.read())]
    # data without a manifest are not read, and the next merge writes over them
    spark.createDataFrame([(0,)], "x int").write.parquet(f"{tmp_path}/t/data/version={version + 2}/bucket=0")
    whole = rows_of(table.read())
    older = rows_of(table.read(version))
    table.compacted(keep=2)
    assert rows_of(table.read()) == whole and table.versions() == [version + 1, version + 2]
    assert all(len([f for f in files if f.endswith(".parquet")]) == 1 for d, _, files in os.walk(f"{tmp_path}/t/data/version={version + 2}") if "bucket=" in d)
    assert older != whole and table.merge(st.status_of(spark.createDataFrame(batches[0], EVENTS)), 5, st.newer_status)


def test_status_stream_is_merged_once(spark, tmp_path):
    for b in range(3):
        put(spark, f"{tmp_path}/in", b, [(k % 4, at(10 + b, k), 10 * b + k, "s") for k in range(6)])
    events = st.read_stream(spark, f"{tmp_path}/in/*", EVENTS)
    table = Snapshot(spark, f"{tmp_path}/t", STATUS, "run_id", 3)
    for checkpoint in ("a", "a", "b"):  # "b": all batches come again
        st.stream_run_status(events, table, f"{tmp_path}/{checkpoint}").awaitTermination()
        assert rows_of(table.read()) == rows_of(runs.latest_run_state(spark.read.schema(EVENTS).parquet(f"{tmp_path}/in/*")))
    assert table.state()[:2] == (2, 2)


def test_arriving_files_are_checked(spark, tmp_path):
    os.mkdir(tmp_path / "in")
    (tmp_path / "in" / "good.json").write_text('{"a": 1}')
    (tmp_path / "in" / "bad.json").write_text("{nope")
    (tmp_path / "in" / "stray.json").write_text("{}")
    (tmp_path / "in" / "crlf.md").write_bytes(b"a\r\nb\r\n")
    schema = "case_id string, artifact_id string, path string, bytes long, at timestamp"
    old, now = datetime.datetime(2001, 1, 1), datetime.datetime.now()
    put(spark, tmp_path / "declared", 0, [("c", "g", "good.json", 8, old), ("c", "b", "bad.json", 99, old), ("c", "x", "crlf.md", 4, old), ("c", "u", "crlf.md", None, now), ("d", "m", "gone.md", 5, old), ("d", "l", "late.md", None, now)], schema)

    def run():
        declared = spark.readStream.schema(schema).parquet(f"{tmp_path}/declared/*")
        checked = arrivals.stream_validate_files(arrivals.arriving_files(spark, str(tmp_path / "in")), declared, "1 hour")
        rows = spark.read.parquet(st.drained(checked, str(tmp_path / "run"))).collect()
        found = {r["name"]: (r["ok"], r["actual"], r["expected"]) for r in rows}
        assert len(found) == len(rows)
        return found

    found = run()
    md, js = "text/markdown", "application/json"
    assert found == {
        "size:g": (True, "8", "8"),
        "content:g": (True, js, js),
        "size:b": (False, "5", "99"),
        "content:b": (False, "invalid", js),
        "size:x": (True, "6 bytes (LF-equivalent 4; CRLF-equivalent 6)", "4"),
        "content:x": (True, md, md),
        "size:u": (True, "6", "6"),
        "content:u": (True, md, md),
        "size:m": (False, "missing", "present"),
        "content:m": (False, "missing", md),
    }
    # what is still awaited comes in time, after a restart
    (tmp_path / "in" / "late.md").write_text("late")
    assert run() == found | {"size:l": (True, "4", "4"), "content:l": (True, md, md)}


def test_listed_files_are_those_in_the_folder_and_come_once(spark, tmp_path):
    top = tmp_path / "in"
    (top / "a b/c").mkdir(parents=True)
    (top / "_temporary").mkdir()
    put = {"x y%20#.md": b"hi", "a b/c/\u00e9.json": b"{}", "a b/empty.md": b"", "z.md.gz": b"\x1f\x8bzz", "a b/big.csv": b"a,b\r\n" * 1_000_000}
    for name, content in (put | {"_temporary/part.md": b"x", ".hidden.md": b"x"}).items():
        (top / name).write_bytes(content)

    def came(folder, log):
        files = arrivals.read_listed(spark, folder, f"{tmp_path}/{log}")
        return sorted(map(tuple, spark.read.parquet(st.drained(files, f"{tmp_path}/{log}-run")).select("path", "length", F.md5("content"), F.unix_micros("modificationTime")).collect()))

    def there(names, prefix):
        return sorted((f"{prefix}{top}/{n}", len(c), hashlib.md5(c).hexdigest(), os.stat(top / n).st_mtime_ns // 1000) for n, c in names.items())

    arrivals.list_files(spark, f"file://{top}/", f"{tmp_path}/uri")
    assert came(f"file://{top}/", "uri") == there(put, "file://")
    arrivals.list_files(spark, str(top), f"{tmp_path}/log")
    assert came(str(top), "log") == there(put, "")
    # what came later is added, at any depth, also with an older time; what was there is not
    (top / "new").mkdir()
    later = {"new/late.md": b"late", "a b/old.md": b"old"}
    for name, content in later.items():
        (top / name).write_bytes(content)
    os.utime(top / "a b/old.md", (1e9, 1e9))
    for _ in range(2):
        arrivals.list_files(spark, str(top), f"{tmp_path}/log")
    assert came(str(top), "log") == there(put | later, "")
    os.mkdir(tmp_path / "none")
    arrivals.list_files(spark, f"{tmp_path}/none", f"{tmp_path}/empty")
    assert came(f"{tmp_path}/none", "empty") == []


def test_the_driver_names_no_arriving_file(spark, tmp_path, monkeypatch):
    spark.range(400).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.lit("<p>").alias("html")).write.parquet(f"{tmp_path}/pages.parquet")
    monkeypatch.setattr(streams, "folder", lambda _: f"{tmp_path}/run")
    assert streams.validated(spark, str(tmp_path)).count() == 2 * (400 + 31)
    logs = [p for p in (tmp_path / "run/run/checkpoint/sources").glob("*/[0-9]*")]
    # a file's source keeps each of its files in the driver, and logs them
    assert 0 < sum(p.read_text().count('"path"') for p in logs) < 100


def test_a_path_has_one_timer_and_few_calls(spark):
    file, declared, processor = Calls(), Calls(), arrivals.Arrivals(1000)
    processor.handle, processor.file, processor.declared = file, file, declared
    file.watermark = 0
    one = dict.fromkeys(["case_id", "artifact_id", "bytes", "file_bytes", "lf_bytes", "crlf_bytes", "content_ok"]) | {"is_file": False, "case_id": "c"}
    rows = pd.DataFrame([one | {"artifact_id": f"a{k}", "bytes": k or None, "at_ms": 10 * k} for k in range(100)])
    assert list(processor.handleInputRows(("p",), iter([rows]), file)) == [] and file.timers == [1000]
    file.watermark = 1495
    told = pd.concat(processor.handleExpiredTimer(("p",), file, None))
    assert told["artifact_id"].tolist() == [f"a{k}" for k in range(50)] and told["bytes"].tolist() == [None, *range(1, 50)] and told["file_bytes"].isna().all()
    assert file.timers == [1000, 1500] and file.calls + declared.calls <= 8
    come = pd.DataFrame([one | {"is_file": True, "file_bytes": 3, "lf_bytes": 3, "crlf_bytes": 4, "content_ok": True, "at_ms": 2000}])
    told = pd.concat(processor.handleInputRows(("p",), iter([come]), file))
    assert len(told) == 50 and set(told["file_bytes"]) == {3} and declared.value is None and file.timers[2:] == [3000]
    file.watermark = 3000
    assert list(processor.handleExpiredTimer(("p",), file, None)) == [] and file.value is None


def test_texts_are_written_by_tasks_one_file_each(spark, tmp_path):
    rows = spark.createDataFrame([(f"{k}.md", f"é{k}\r\n") for k in range(300)], "file string, text string").repartition(3)
    assert files.write_texts(rows, str(tmp_path / "out")) == 300
    got = {p.name: p.read_bytes() for p in (tmp_path / "out").rglob("*.md")}
    assert got == {f"{k}.md": f"é{k}\r\n".encode() for k in range(300)}
    assert len(list((tmp_path / "out").iterdir())) < 300  # a folder for each task, none for each file
