"""Streaming queries: each runs over the whole `events` table as a stream until it is drained."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from evidentia.plans import runs as plan
from evidentia.sources import files
from evidentia.streaming import arrivals
from evidentia.streaming import run_streams as st
from evidentia.streaming.snapshot import Snapshot


def folder(spark) -> str:
    """A new folder under the shared one (spark.checkpoint.dir). Where that is unset, a temporary one on this machine, but only
    if all tasks run here too."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not (spark.sparkContext.master or "").startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="spark-")
    return f"{shared.rstrip('/')}/stream-{uuid.uuid4().hex}"


def events(spark, d):
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    # files of a table are in no order of time, so they come in one batch: in several, events behind the watermark would be lost
    rows = st.read_stream(spark, f"{d}/events.parquet*", schema, 1_000_000_000)
    return plan.as_events(rows)


def audit(s, d):
    return s.read.parquet(st.drained(st.stream_run_audit(events(s, d)), folder(s), idle_batches=False))


def status(s, d):
    at = folder(s)
    snapshot = Snapshot(s, f"{at}/status", "run_id long, at timestamp, seq long, state string, events long", "run_id")
    st.stream_run_status(events(s, d), snapshot, f"{at}/checkpoint").awaitTermination()
    return snapshot.read().select("run_id", "seq", "state", "events")


def overdue(s, d):
    return s.read.parquet(st.drained(st.stream_overdue_runs(events(s, d), ["completed"], 30, 30, "0 seconds"), folder(s)))


def validated(s, d):
    """Pages as files, named by the page, that tasks write. Every seventh has CRLF line ends,
    every fourth is JSON, every ninth of these broken. Sizes are declared with LF line ends, some wrong, some left out; every
    thirteenth page is declared again under a name that never comes."""
    pages, at, n = s.read.parquet(f"{d}/pages.parquet"), folder(s), F.col("page_id")
    html = F.concat(F.lit("# page\n"), F.coalesce("html", F.lit("")))
    text = F.when(n % 4 == 1, F.concat(F.when(n % 9 == 0, "{").otherwise(""), F.to_json(F.struct("url")))).otherwise(html)
    name = F.concat(n.cast("string"), F.when(n % 4 == 1, ".json").otherwise(".md"))
    rows = pages.select(name.alias("file"), n, text.alias("text"))
    content = F.when(n % 7 == 0, F.replace("text", F.lit("\n"), F.lit("\r\n"))).otherwise(F.col("text"))
    files.write_texts(rows.select("file", F.concat(content, F.lit("\n")).alias("text")), f"{at}/files")
    size = F.when(n % 11 != 0, F.octet_length("text") + F.when(n % 5 == 0, 7).otherwise(1)).cast("long")
    paths = F.explode(F.filter(F.array("file", F.when(n % 13 == 0, F.concat(F.lit("gone-"), "file"))), lambda p: p.isNotNull()))
    declared = rows.select((n % 50).cast("string").alias("case_id"), size.alias("bytes"), paths.alias("path"), F.lit("2000-01-01").cast("timestamp").alias("at"))
    declared.withColumn("artifact_id", F.col("path")).write.parquet(f"{at}/declared")
    schema = "case_id string, bytes long, path string, at timestamp, artifact_id string"
    arrived = arrivals.arriving_files(s, f"{at}/files", log=f"{at}/arrived")
    checks = arrivals.stream_validate_files(arrived, s.readStream.schema(schema).parquet(f"{at}/declared"))
    return s.read.parquet(st.drained(checks, f"{at}/run"))


def deduped(s, d):
    twice = events(s, d).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy")
    out = s.read.parquet(st.drained(st.stream_dedupe(twice, ["run_id", "seq"], "1 hour"), folder(s)))
    return out.select("run_id", "seq", "state")


def counts(s, d):
    # a window is written once it is over; the last ones stay in the state
    out = s.read.parquet(st.drained(st.stream_state_counts(events(s, d), "1 hour", "0 seconds"), folder(s)))
    return out.select(F.unix_seconds("start").alias("start_s"), "state", "events")


QUERIES = {
    "st1_stream_run_audit": audit,
    "st2_stream_run_status": status,
    "st3_stream_overdue_runs": overdue,
    "st4_stream_dedupe": deduped,
    "st5_stream_validate_files": validated,
    "st6_stream_state_counts": counts,
}

VALIDATED = """WITH p AS (SELECT page_id, page_id || CASE WHEN page_id % 4 = 1 THEN '.json' ELSE '.md' END AS file,
  CASE WHEN page_id % 4 = 1 THEN CASE WHEN page_id % 9 = 0 THEN '{' ELSE '' END || CASE WHEN url IS NULL THEN '{}' ELSE json_object('url', url)::VARCHAR END ELSE '# page' || chr(10) || coalesce(html, '') END AS text FROM pages),
f AS (SELECT *, CASE WHEN page_id % 7 = 0 THEN replace(text, chr(10), chr(13) || chr(10)) ELSE text END || chr(10) AS content,
  CASE WHEN page_id % 11 <> 0 THEN strlen(text) + CASE WHEN page_id % 5 = 0 THEN 7 ELSE 1 END END AS recorded FROM p),
z AS (SELECT *, strlen(content) AS bytes, strlen(replace(content, chr(13) || chr(10), chr(10))) AS lf, strlen(content) - strlen(replace(content, chr(10), '')) AS ends FROM f),
s AS (SELECT *, lf + ends AS crlf, coalesce(recorded, bytes) AS want FROM z),
d AS (SELECT page_id % 50 AS case_id, file AS path, true AS there, s.* EXCLUDE (file) FROM s UNION ALL SELECT page_id % 50, 'gone-' || file, false, s.* EXCLUDE (file) FROM s WHERE page_id % 13 = 0)
SELECT case_id::VARCHAR AS case_id, 'size:' || path AS name, there AND (bytes = want OR want IN (lf, crlf)) AS ok,
  CASE WHEN NOT there THEN 'missing' WHEN bytes <> want AND want IN (lf, crlf) THEN bytes || ' bytes (LF-equivalent ' || lf || '; CRLF-equivalent ' || crlf || ')' ELSE bytes::VARCHAR END AS actual,
  CASE WHEN there THEN want::VARCHAR ELSE 'present' END AS expected FROM d
UNION ALL SELECT case_id::VARCHAR, 'content:' || path, there AND (page_id % 4 <> 1 OR page_id % 9 <> 0),
  CASE WHEN NOT there THEN 'missing' WHEN page_id % 4 = 1 AND page_id % 9 = 0 THEN 'invalid' WHEN page_id % 4 = 1 THEN 'application/json' ELSE 'text/markdown' END,
  CASE WHEN page_id % 4 = 1 THEN 'application/json' ELSE 'text/markdown' END FROM d"""

SQL = {
    "st1_stream_run_audit": plan.AUDIT,
    "st2_stream_run_status": plan.LATEST,
    "st3_stream_overdue_runs": plan.SQL["st3_overdue_sessions_batch"],
    "st4_stream_dedupe": f"SELECT user_id AS run_id, event_id AS seq, {plan.STATE} AS state FROM events",
    "st5_stream_validate_files": VALIDATED,
    "st6_stream_state_counts": f"WITH c AS ({plan.COUNTS}) SELECT * FROM c WHERE start_s + 3600 <= (SELECT epoch(max(ts)) FROM events)",
}
