"""Jobs over run events (run_id, at, seq, state, message), providers and plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.operators.ordered import CROWD, with_previous

# The states of a run and what may follow each.
TRANSITIONS = {
    "draft": ("awaiting_confirmation", "queued", "cancelled"),
    "awaiting_confirmation": ("queued", "cancelled"),
    "queued": ("running", "cancelled", "failed"),
    "running": ("completed", "failed", "cancelled"),
    "completed": (),
    "failed": (),
    "cancelled": (),
}
#: A state that may be logged again as a note (a cancellation request), without a transition.
NOTED = ("running",)
TERMINAL = tuple(state for state, after in TRANSITIONS.items() if not after)
# What a paid or remote provider needs to be told before it runs.
CONFIRMATIONS = {
    "paid-api": "This provider may create billable API usage.",
    "gpu": "This provider may start a GPU workload.",
    "ssh": "This provider may submit work to a configured SSH or HPC target.",
}


def legal_steps(transitions: dict = TRANSITIONS, noted: tuple = NOTED) -> list[tuple[str, str]]:
    """(state before, state) of all steps that a log may hold."""
    return [(a, b) for a, after in transitions.items() for b in after] + [(s, s) for s in noted]


def run_event_audit(events: DataFrame, transitions: dict = TRANSITIONS, start: str = "draft", noted: tuple = NOTED, piece: str = "hour", crowd: int = CROWD) -> DataFrame:
    """Every event with its run's state before it, and whether the step is allowed; only `start` may open a run. A run of more than
    `crowd` events is cut into pieces of time, so one run may have most of all rows."""
    steps = F.array(*(F.lit(f"{a}>{b}") for a, b in legal_steps(transitions, noted)))
    rows = with_previous(events, "run_id", ("at", "seq"), piece, ("state",), crowd)
    rows = rows.select(*events.columns, F.col("_before")["state"].alias("previous"))
    known = F.array_contains(steps, F.concat_ws(">", "previous", "state"))
    return rows.withColumn("allowed", F.coalesce(F.when(F.col("previous").isNull(), F.col("state") == start).otherwise(known), F.lit(False)))


def latest_run_state(events: DataFrame) -> DataFrame:
    """The newest event of each run."""
    newest = events.groupBy("run_id").agg(F.max(F.struct("at", "seq", "state")).alias("e"), F.count("*").alias("events"))
    return newest.select("run_id", F.col("e.at").alias("at"), F.col("e.seq").alias("seq"), F.col("e.state").alias("state"), "events")


def overdue_runs(events: DataFrame, terminal: list[str], minutes: int = 30) -> DataFrame:
    """Runs without a terminal event within `minutes` of their first event; the newest event of all tells the time."""
    ended = F.min(F.when(F.col("state").isin(*terminal), F.col("at")))
    runs = events.groupBy("run_id").agg(F.min("at").alias("started"), ended.alias("ended"))
    now = events.agg(F.max("at").alias("now"))
    limit = F.col("started") + F.make_interval(mins=F.lit(minutes))
    late = (limit < F.col("now")) & (F.col("ended").isNull() | (F.col("ended") > limit))
    return runs.join(F.broadcast(now)).where(late).drop("now")  # now: one row


def overdue_sessions(events: DataFrame, terminal: list[str], minutes: int = 30, gap_minutes: int = 30) -> DataFrame:
    """Sessions of runs (events at most gap_minutes apart) without a terminal event within `minutes` of their first event; the newest
    event of all tells the time. A run that goes on after a gap is a new session. The twin of the stream of the same rule."""
    ended = F.min(F.when(F.col("state").isin(*terminal), F.col("at")))
    sessions = events.groupBy("run_id", F.session_window("at", f"{gap_minutes} minutes")).agg(F.min("at").alias("started"), ended.alias("ended"))
    now = events.agg(F.max("at").alias("now"))
    limit = F.col("started") + F.make_interval(mins=F.lit(minutes))
    late = (limit < F.col("now")) & (F.col("ended").isNull() | (F.col("ended") > limit))
    return sessions.join(F.broadcast(now)).where(late).select("run_id", "started", "ended")  # now: one row


def state_counts(events: DataFrame, window: str, slide: str | None = None) -> DataFrame:
    """Events per window and state; a plain aggregation, for tables and streams."""
    w = F.window("at", window, slide) if slide else F.window("at", window)
    return events.groupBy(w.alias("w"), "state").agg(F.count("*").alias("events")).select(
        F.col("w.start").alias("start"),
        F.col("w.end").alias("end"),
        "state",
        "events",
    )


def missing_acknowledgements(plans: DataFrame) -> DataFrame:
    """plans (run_id, required, given): reasons required but not given, in order; runs that lack some."""
    return plans.select("run_id", F.sort_array(F.array_except("required", "given")).alias("missing")).where(F.size("missing") > 0)


def confirmation_reason(kind: Column) -> Column:
    """What a provider of this kind must be confirmed for; null for the others."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in CONFIRMATIONS.items() for x in pair)), kind)


def provider_readiness(providers: DataFrame) -> DataFrame:
    """providers (provider_id, kind, command, command_found, enable_name, enable_value, credential_name, credential_value,
    target_name, target_value, cost_min, cost_max): a null name means that nothing of the sort is needed, a blank value that it
    is not set. Gives installed, credential_required, credential_configured, runnable, estimated_cost, diagnostics in order."""
    given = lambda part: F.col(f"{part}_name").isNull() | (F.trim(F.coalesce(f"{part}_value", F.lit(""))) != "")
    command = F.col("command").isNull() | F.coalesce("command_found", F.lit(False))
    rows = providers.withColumns({"_command": command, "_enabled": given("enable"), "_credential": given("credential"), "_target": given("target")})
    rows = rows.withColumn("installed", F.col("_command") & ((F.col("kind") != "public-api") | F.col("_enabled")))
    rows = rows.withColumn("runnable", F.col("installed") & F.col("_credential") & F.col("_target"))
    told = lambda start, name, end: F.concat(F.lit(start), name, F.lit(end))
    notes = F.array(
        F.when(~F.col("_command"), told("Required command is unavailable: ", "command", ".")),
        F.when(~F.col("_enabled"), told("Live source is not authorized; configure ", "enable_name", " to enable it.")),
        F.when(~F.col("_credential"), told("Credential is not configured: ", "credential_name", ".")),
        F.when(~F.col("_target"), told("Remote target is not configured: ", "target_name", ".")),
        F.when(F.col("runnable"), F.lit("Provider prerequisites are available.")),
    )
    cost = F.when(F.col("cost_max").isNotNull(), F.struct(F.col("cost_min").alias("min"), F.col("cost_max").alias("max")))
    return rows.select(
        "provider_id",
        "kind",
        "installed",
        F.col("credential_name").isNotNull().alias("credential_required"),
        F.col("_credential").alias("credential_configured"),
        "runnable",
        cost.alias("estimated_cost"),
        F.filter(notes, lambda n: n.isNotNull()).alias("diagnostics"),
    )


def provider_status(ids: DataFrame, readiness: DataFrame) -> DataFrame:
    """The rows of provider_readiness() for each id of ids (provider_id); an id that is not registered has a status that says so."""
    unknown = F.col("installed").isNull()
    note = F.array(F.concat(F.lit("Provider "), "provider_id", F.lit(" is not registered.")))
    flags = {c: F.coalesce(c, F.lit(False)) for c in ("installed", "credential_required", "credential_configured", "runnable")}
    rows = ids.select("provider_id").distinct().join(readiness, "provider_id", "left")
    return rows.withColumns({"diagnostics": F.when(unknown, note).otherwise(F.col("diagnostics")), "kind": F.coalesce("kind", F.lit("local")), **flags})


def provider_report(cases: DataFrame, providers: DataFrame, ids: list[str] | None = None, salts: int = 16) -> DataFrame:
    """Providers of each case: the explicit ids, else the case's own, else all of them. The last is a report of every case
    with every provider; it is dealt out by a salt, so neither side is broadcast or gathered."""
    declared = F.coalesce("provider_ids", F.array().cast("array<string>"))
    own = F.array(*map(F.lit, ids)) if ids else declared
    rows = cases.select("case_id", own.alias("own"))
    named = rows.select("case_id", F.explode(F.array_distinct("own")).alias("provider_id")).join(providers, "provider_id")
    if ids:
        return named
    salt = F.pmod(F.xxhash64("provider_id"), F.lit(salts)).cast("int")
    open_cases = rows.where(F.size("own") == 0).select("case_id", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    every = open_cases.join(providers.withColumn("_salt", salt), "_salt").drop("_salt")
    return named.unionByName(every)
