"""Checks: every job yields rows (case_id, name, ok, actual, expected) or reports of what is missing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions import text as tx


def check(case_id: Column, name: Column, ok: Column, actual: Column, expected: Column) -> list[Column]:
    return [
        case_id.alias("case_id"),
        name.alias("name"),
        F.coalesce(ok, F.lit(False)).alias("ok"),
        actual.cast("string").alias("actual"),
        expected.cast("string").alias("expected"),
    ]


def file_stats(files: DataFrame, *carry: str) -> DataFrame:
    """files (path, media_type, content as text or binary), with the columns named in carry: bytes; bytes with LF and with CRLF line ends, counted byte by
    byte; canonical_bytes and sha256 of the content as it is compared: with LF line ends for texts, unchanged for others."""
    raw = F.col("content").cast("binary")
    text = raw.cast("string")  # the same bytes, valid or not
    lf = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    size = lambda c: F.octet_length(c).cast("long")
    endings = size(text) - size(F.replace(text, F.lit("\n"), F.lit("")))
    canonical = F.when(tx.is_text(F.col("media_type")), F.replace(F.make_valid_utf8(text), F.lit("\r\n"), F.lit("\n")).cast("binary")).otherwise(raw)
    return files.select(
        "path",
        *carry,
        size(raw).alias("bytes"),
        size(lf).alias("lf_bytes"),
        (size(lf) + endings).alias("crlf_bytes"),
        size(canonical).alias("canonical_bytes"),
        F.sha2(canonical, 256).alias("sha256"),
    )


def unresolved_claim_refs(refs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """References (case_id, artifact_id) to artifacts that their case does not have."""
    return refs.join(artifacts, ["case_id", "artifact_id"], "left_anti")


def missing_recipe_files(declared: DataFrame, listing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Declared paths that are absent from the listing, and those that are present."""
    return declared.join(listing, "path", "left_anti"), declared.join(listing, "path", "left_semi")


#: Modes that a case declares, and the kinds of statements that it records.
MODES = ("lesson", "replay", "reproduce")
RECORDED = {"observation": "source observations", "computed": "computed results", "interpretation": "scientific interpretation", "limitation": "limitations"}


def record_checks(cases: DataFrame, claims: DataFrame, artifacts: DataFrame, files: DataFrame) -> DataFrame:
    """The ten checks of a case's record: ready, three modes, four kinds of statements, claim references, recipe files; with their ordinal.

    cases: case_id, status, modes, the arrays of case_statements() and required_inputs, expected_outputs (arrays; null counts as
    empty); claims: case_id, artifact_ids; artifacts: case_id, artifact_id; files: path. A case without claims or recipe files has
    none that fail."""
    refs = claims.select("case_id", F.explode("artifact_ids").alias("artifact_id")).where("artifact_id IS NOT NULL")
    open_refs = unresolved_claim_refs(refs, artifacts).groupBy("case_id").agg(F.count("*").alias("open_refs"))
    none = F.array().cast("array<string>")
    paths = F.concat(*(F.coalesce(c, none) for c in ("required_inputs", "expected_outputs")))
    gone = missing_recipe_files(cases.select("case_id", F.explode(paths).alias("path")), files.select("path"))[0]
    rows = cases.join(open_refs, "case_id", "left").join(gone.groupBy("case_id").agg(F.count("*").alias("gone")), "case_id", "left")
    told = [("showcase is ready", F.col("status"), F.lit("ready"))]
    told += [(f"{mode} mode declared", F.coalesce(F.array_contains("modes", mode), F.lit(False)), F.lit(True)) for mode in MODES]
    told += [(f"{name} recorded", F.size(F.coalesce(kind, none)) > 0, F.lit(True)) for kind, name in RECORDED.items()]
    told += [("claim artifact references resolve", F.col("open_refs").isNull(), F.lit(True)), ("recipe files are present", F.col("gone").isNull(), F.lit(True))]
    each = [F.struct(F.lit(n).alias("ordinal"), *check(F.col("case_id"), F.lit(name), actual == expected, actual, expected)) for n, (name, actual, expected) in enumerate(told)]
    return rows.select(F.inline(F.array(*each)))


def size_rule(recorded: str, actual: str) -> tuple[Column, Column, Column]:
    """ok, actual and expected of rows with a recorded size (or null), and path, actual size, lf_bytes and crlf_bytes of the file. A
    record without a path is a resource and passes; without a file it is missing; without a size it passes; else the size must be
    that of the file, or of its LF or CRLF form."""
    size = F.col(actual)
    expected = F.coalesce(recorded, actual)
    alike = (expected == F.col("lf_bytes")) | (expected == F.col("crlf_bytes"))
    text = lambda c: F.col(c).cast("string")
    note = F.concat(text(actual), F.lit(" bytes (LF-equivalent "), text("lf_bytes"), F.lit("; CRLF-equivalent "), text("crlf_bytes"), F.lit(")"))
    resource, missing, equal = F.col("path").isNull(), size.isNull(), size == expected
    told = F.when(resource, "resource").when(missing, "missing").when(~equal & alike, note).otherwise(text(actual))
    wanted = F.when(resource, "resource").when(missing, "present").otherwise(expected.cast("string"))
    return resource | (~missing & (equal | alike)), told, wanted


def artifact_size_check(artifacts: DataFrame, stats: DataFrame) -> DataFrame:
    """Recorded against actual sizes, by size_rule()."""
    rows = artifacts.join(stats.select("path", F.col("bytes").alias("actual"), "lf_bytes", "crlf_bytes"), "path", "left")
    return rows.select(*check(F.col("case_id"), F.col("artifact_id").cast("string"), *size_rule("bytes", "actual")))


def stale_metadata(declared: DataFrame, stats: DataFrame) -> DataFrame:
    """Records whose size or hash, where recorded, is not that of the canonical content: the actual values replace them, a hash
    only where one was recorded."""
    rows = declared.join(stats.select("path", "canonical_bytes", F.col("sha256").alias("actual_sha")), "path")
    differs = lambda a, b: F.coalesce(F.col(a) != F.col(b), F.lit(False))
    rows = rows.where(differs("bytes", "canonical_bytes") | differs("sha256", "actual_sha"))
    return rows.select("path", F.col("canonical_bytes").alias("bytes"), F.when(F.col("sha256").isNotNull(), F.col("actual_sha")).alias("sha256"))


def all_checks(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def validation_rollup(checks: DataFrame, order: str = "ordinal", code: str = "REPLAY_VALIDATION_FAILED") -> DataFrame:
    """Per case: whether all checks are ok, their number, the error code, and the failed names in the order of the checks."""
    failed = F.array_sort(F.collect_list(F.when(~F.col("ok"), F.struct(F.col(order).alias("o"), "name"))))
    out = checks.groupBy("case_id").agg(
        F.bool_and("ok").alias("ok"),
        F.count("*").alias("checks"),
        F.array_join(F.transform(failed, lambda x: x["name"]), ", ").alias("failed"),
    )
    return out.select("case_id", "ok", "checks", F.when(~F.col("ok"), code).alias("error_code"), F.when(~F.col("ok"), F.col("failed")).alias("error_message"))


def release_checks(cases: DataFrame, expected: int, name: str = "cases") -> DataFrame:
    """One row each: the expected count, all ready, ids unique. cases: case_id, ready."""
    a = cases.agg(F.count("*").alias("n"), F.countDistinct("case_id").alias("d"), F.bool_and("ready").alias("r"))
    rows = F.array(*(F.struct(*check(F.lit("release"), F.lit(n), ok, actual, exp)) for n, ok, actual, exp in ((f"{name} count", F.col("n") == expected, F.col("n"), F.lit(expected)), ("all ready", F.col("r"), F.col("r"), F.lit(True)), ("unique ids", F.col("n") == F.col("d"), F.col("d"), F.col("n")))))
    return a.select(F.inline(rows))


#: Kinds of statements of a review, and the columns that keep them apart.
REVIEW = {"observation": "source_observations", "computed": "computed_results", "interpretation": "scientific_interpretation", "limitation": "limitations"}


def review_report(statements: DataFrame, sources: DataFrame, artifacts: DataFrame, checks: DataFrame) -> DataFrame:
    """Per case that has any: the statements of each kind in order, citation_checks (is the source a web address), and
    artifact_checks (present and note, by the check of the artifact's name, of several a failed one first; without a check it counts
    as present).

    statements: case_id, kind, ordinal, statement; sources: case_id, ordinal, source; artifacts: case_id, ordinal,
    artifact_id; checks: case_id, name, ok, actual."""
    in_order = lambda rows: F.transform(F.array_sort(rows), lambda x: x["v"])
    texts = statements.groupBy("case_id").agg(*(in_order(F.collect_list(F.when(F.col("kind") == kind, F.struct("ordinal", F.col("statement").alias("v"))))).alias(name) for kind, name in REVIEW.items()))
    cited = sources.groupBy("case_id").agg(in_order(F.collect_list(F.struct(
        "ordinal",
        F.struct("source", F.col("source").rlike("^https?://").alias("valid")).alias("v"),
    ))).alias("citation_checks"))
    first = checks.groupBy("case_id", F.col("name").alias("artifact_id")).agg(F.min(F.struct("ok", "actual")).alias("c"))
    seen = F.struct("artifact_id", F.coalesce("c.ok", F.lit(True)).alias("present"), F.coalesce("c.actual", F.lit("resource reference")).alias("note"))
    held = artifacts.join(
        first,
        ["case_id", "artifact_id"],
        "left",
    ).groupBy("case_id").agg(in_order(F.collect_list(F.struct("ordinal", seen.alias("v")))).alias("artifact_checks"))
    out = texts.join(cited, "case_id", "full_outer").join(held, "case_id", "full_outer")
    empty = {name: F.coalesce(name, F.array().cast("array<string>")) for name in REVIEW.values()}
    empty["citation_checks"] = F.coalesce("citation_checks", F.array().cast("array<struct<source:string,valid:boolean>>"))
    empty["artifact_checks"] = F.coalesce("artifact_checks", F.array().cast("array<struct<artifact_id:string,present:boolean,note:string>>"))
    return out.select("case_id", *(c.alias(n) for n, c in empty.items()))
