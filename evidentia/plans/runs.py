"""Run-event queries on `events` (a user is a run, an event type a state) and provider queries on `supplier`."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.operators import runs

# The event types that stand for states of a run.
STAND_IN = {"signup": "draft", "view": "queued", "click": "running", "purchase": "completed", "error": "failed"}


def t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def as_events(rows):
    """Rows of `events` as run events."""
    state = F.element_at(F.create_map(*(F.lit(x) for pair in STAND_IN.items() for x in pair)), F.col("event_type"))
    return rows.select(F.col("user_id").alias("run_id"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), state.alias("state"))


def events(s, d):
    return as_events(t(s, d, "events"))


def audit(s, d):
    return runs.run_event_audit(events(s, d)).select("run_id", "seq", "previous", "state", "allowed")


def plans(s, d):
    e = events(s, d)
    p = e.groupBy("run_id").agg(F.collect_set("state").alias("given")).withColumn("required", F.array(*map(F.lit, ("running", "failed", "refund"))))
    return runs.missing_acknowledgements(p).withColumn("missing", F.array_join("missing", ","))


def providers(s, d):
    n, key = F.col("s_nationkey"), F.col("s_suppkey")
    kind = F.element_at(F.array(*map(F.lit, ("local", "public-api", "paid-api", "gpu"))), (n % 4 + 1).cast("int"))
    return t(s, d, "supplier").select(
        key.cast("string").alias("provider_id"),
        kind.alias("kind"),
        F.when(key % 3 == 0, F.lit("tool")).alias("command"),
        F.when(key % 2 == 0, F.col("s_acctbal") > 0).alias("command_found"),
        F.when(n % 4 == 1, F.lit("ENABLE")).alias("enable_name"),
        F.when(key % 5 != 0, F.lit("1")).alias("enable_value"),
        F.when(n % 4 >= 2, F.lit("TOKEN")).alias("credential_name"),
        F.when(key % 7 == 0, F.lit("  ")).otherwise(F.col("s_name")).alias("credential_value"),
        F.when(n % 4 == 3, F.lit("TARGET")).alias("target_name"),
        F.when(key % 11 != 0, F.lit("host")).alias("target_value"),
        F.lit(0.5).alias("cost_min"),
        F.when(n % 4 == 2, F.lit(2.0)).alias("cost_max"),
        "s_nationkey",
    )


def readiness(s, d):
    out = runs.provider_readiness(providers(s, d))
    return out.select(
        "provider_id",
        "installed",
        "credential_required",
        "credential_configured",
        "runnable",
        F.col("estimated_cost.max").alias("cost_max"),
        F.array_join("diagnostics", " ").alias("diagnostics"),
        runs.confirmation_reason(F.col("kind")).alias("reason"),
    )


def statuses(s, d):
    """Of ids of which some are registered."""
    ids = t(s, d, "orders").select(F.col("o_custkey").cast("string").alias("provider_id"))
    out = runs.provider_status(ids, runs.provider_readiness(providers(s, d)))
    return out.select("provider_id", "kind", "installed", "credential_required", "runnable", F.array_join("diagnostics", " ").alias("diagnostics"))


def report(s, d):
    cases = t(s, d, "nation").select(
        F.col("n_nationkey").alias("case_id"),
        F.when(F.col("n_nationkey") % 4 != 0, F.array(F.col("n_nationkey").cast("string"))).alias("provider_ids"),
    )
    return runs.provider_report(cases, providers(s, d)).select("case_id", "provider_id", "s_nationkey")


QUERIES = {
    "w9_run_event_audit": audit,
    "w10_latest_run_state": lambda s, d: runs.latest_run_state(events(s, d)).select("run_id", "seq", "state", "events"),
    "u3_missing_acknowledgements": plans,
    "f7_provider_readiness": readiness,
    "f7_provider_status": statuses,
    "j6_provider_report": report,
    "st3_overdue_runs_batch": lambda s, d: runs.overdue_runs(events(s, d), ["completed"], 30).select("run_id", F.unix_micros("started").alias("started_us")),
    "st3_overdue_sessions_batch": lambda s, d: runs.overdue_sessions(events(s, d), ["completed"], 30, 30).select("run_id", F.unix_micros("started").alias("started_us")),
    "st6_state_counts_batch": lambda s, d: runs.state_counts(events(s, d), "1 hour").select(F.unix_seconds("start").alias("start_s"), "state", "events"),
}

STATE = "CASE event_type WHEN 'signup' THEN 'draft' WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END"
# The legal steps, written out: a run that has ended never goes on, and `running` may be noted again.
AUDIT = f"""WITH e AS (SELECT user_id AS run_id, event_id AS seq, {STATE} AS state, ts FROM events), l AS (SELECT run_id, seq, lag(state) OVER (PARTITION BY run_id ORDER BY ts, seq) AS previous, state FROM e)
SELECT *, CASE WHEN previous IS NULL THEN state = 'draft' WHEN previous = 'draft' THEN state IN ('awaiting_confirmation', 'queued', 'cancelled') WHEN previous = 'awaiting_confirmation' THEN state IN ('queued', 'cancelled')
  WHEN previous = 'queued' THEN state IN ('running', 'cancelled', 'failed') WHEN previous = 'running' THEN state IN ('running', 'completed', 'failed', 'cancelled') ELSE false END AS allowed FROM l"""
LATEST = f"SELECT user_id AS run_id, arg_max(event_id, (ts, event_id)) AS seq, arg_max({STATE}, (ts, event_id)) AS state, count(*) AS events FROM events GROUP BY 1"
COUNTS = f"SELECT epoch(date_trunc('hour', ts))::BIGINT AS start_s, {STATE} AS state, count(*) AS events FROM events GROUP BY ALL"

SQL = {
    "w9_run_event_audit": AUDIT,
    "w10_latest_run_state": LATEST,
    "u3_missing_acknowledgements": f"""WITH g AS (SELECT user_id AS run_id, list(DISTINCT {STATE}) AS given
FROM events
GROUP BY 1) SELECT run_id, array_to_string(list_filter(['failed', 'refund', 'running'], lambda r: NOT list_contains(given, r)), ',') AS missing
FROM g""",
    "f7_provider_readiness": """WITH p AS (SELECT s_suppkey::VARCHAR AS provider_id, s_nationkey % 4 AS k, s_suppkey % 3 <> 0 OR (s_suppkey % 2 = 0 AND s_acctbal > 0) AS c,
  s_nationkey % 4 <> 1 OR s_suppkey % 5 <> 0 AS e, s_nationkey % 4 < 2 OR s_suppkey % 7 <> 0 AS a, s_nationkey % 4 <> 3 OR s_suppkey % 11 <> 0 AS g FROM supplier)
SELECT provider_id, c AND e AS installed, k >= 2 AS credential_required, a AS credential_configured, c AND e AND a AND g AS runnable, CASE WHEN k = 2 THEN 2.0::DOUBLE END AS cost_max,
  array_to_string(list_filter([CASE WHEN NOT c THEN 'Required command is unavailable: tool.' END, CASE WHEN NOT e THEN 'Live source is not authorized; configure ENABLE to enable it.' END, CASE WHEN NOT a THEN 'Credential is not configured: TOKEN.' END,
    CASE WHEN NOT g THEN 'Remote target is not configured: TARGET.' END, CASE WHEN c AND e AND a AND g THEN 'Provider prerequisites are available.' END], lambda n: n IS NOT NULL), ' ') AS diagnostics,
  CASE k WHEN 2 THEN 'This provider may create billable API usage.' WHEN 3 THEN 'This provider may start a GPU workload.' END AS reason FROM p""",
    "j6_provider_report": """SELECT n_nationkey AS case_id, s_suppkey::VARCHAR AS provider_id, s_nationkey
FROM nation JOIN supplier ON n_nationkey % 4 = 0 OR s_suppkey = n_nationkey""",
    "st3_overdue_runs_batch": """WITH r AS (SELECT user_id AS run_id, min(ts) AS started, min(ts) FILTER (WHERE event_type = 'purchase') AS ended FROM events GROUP BY 1)
SELECT run_id, epoch_us(started) AS started_us FROM r, (SELECT max(ts) AS now FROM events) WHERE started + INTERVAL 30 MINUTE < now AND (ended IS NULL OR ended > started + INTERVAL 30 MINUTE)""",
    # gaps and islands: an event over half an hour after the one before opens a session
    "st3_overdue_sessions_batch": """WITH g AS (SELECT user_id AS run_id, ts, event_type, coalesce(ts - lag(ts) OVER w > INTERVAL 30 MINUTE, true) AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
i AS (SELECT *, sum(opens::INTEGER) OVER (PARTITION BY run_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g),
s AS (SELECT run_id, min(ts) AS started, min(ts) FILTER (WHERE event_type = 'purchase') AS ended FROM i GROUP BY run_id, session)
SELECT run_id, epoch_us(started) AS started_us FROM s, (SELECT max(ts) AS now FROM events) WHERE started + INTERVAL 30 MINUTE < now AND (ended IS NULL OR ended > started + INTERVAL 30 MINUTE)""",
    "st6_state_counts_batch": COUNTS,
}

SQL["f7_provider_status"] = f"""WITH f AS ({SQL["f7_provider_readiness"]}), k AS (SELECT f.*, ['local', 'public-api', 'paid-api', 'gpu'][(s_nationkey % 4 + 1)::INTEGER] AS kind FROM f JOIN supplier ON s_suppkey::VARCHAR = provider_id),
i AS (SELECT DISTINCT o_custkey::VARCHAR AS provider_id FROM orders)
SELECT provider_id, coalesce(kind, 'local') AS kind, coalesce(installed, false) AS installed, coalesce(credential_required, false) AS credential_required, coalesce(runnable, false) AS runnable,
  coalesce(diagnostics, 'Provider ' || provider_id || ' is not registered.') AS diagnostics FROM i LEFT JOIN k USING (provider_id)"""
