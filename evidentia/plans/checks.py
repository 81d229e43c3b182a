"""Check queries on `documents`, `labels`, `orders`, `lineitem` and `part`."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.operators import checks as ck


def t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def stats(s, d):
    """Documents as files: some with CRLF line ends, every fourth a binary that holds its own CRLF."""
    n = F.col("doc_id")
    content = F.when(n % 7 == 0, F.replace("text", F.lit("\n"), F.lit("\r\n"))).otherwise(F.col("text"))
    content = F.when(n % 4 == 0, F.concat(F.unhex(F.lit("89504E470D0A1A0A")), content.cast("binary"))).otherwise(content.cast("binary"))
    media = F.when(n % 4 == 0, "image/png").when(n % 4 == 1, "chemical/x-pdb").otherwise("text/markdown")
    return ck.file_stats(t(s, d, "documents").select(n.alias("path"), media.alias("media_type"), content.alias("content")))


def artifacts(s, d):
    n = F.col("doc_id")
    size = F.when(n % 11 == 0, None).when(n % 5 == 0, F.col("n_chars")).otherwise(F.octet_length("text") + F.when(n % 4 == 0, 8).otherwise(0))
    path = F.when(n % 13 != 0, n + F.when(n % 17 == 0, 10000000).otherwise(0))
    return t(s, d, "documents").select((n % 50).alias("case_id"), n.alias("artifact_id"), path.alias("path"), size.cast("long").alias("bytes"))


def sizes(s, d):
    return ck.artifact_size_check(artifacts(s, d), stats(s, d))


def label_checks(s, d):
    return t(s, d, "labels").select(*ck.check(F.col("doc_id") % 50, F.concat(F.lit("quality:"), "doc_id"), F.col("quality") == 1, F.col("quality"), F.lit(1)))


def every_check(s, d):
    return ck.all_checks(sizes(s, d), label_checks(s, d))


def rollup(s, d):
    return ck.validation_rollup(every_check(s, d).withColumn("ordinal", F.reverse("name")))


def stale(s, d):
    sha = F.when(F.col("doc_id") % 3 == 0, F.sha2("text", 256)).when(F.col("doc_id") % 3 == 1, F.lit("0"))
    return ck.stale_metadata(
        t(s, d, "documents").select(F.col("doc_id").alias("path"), F.when(F.col("doc_id") % 6 != 5, F.col("n_chars")).alias("bytes"), sha.alias("sha256")),
        stats(s, d),
    )


def review(s, d):
    c = t(s, d, "conversations")
    kind = F.when(F.col("role") == "user", "observation").when(
        F.col("role") == "assistant",
        "computed",
    ).when(F.col("turn") == 0, "interpretation").otherwise("limitation")
    statements = c.select(
        (F.col("conv_id") % 50).alias("case_id"),
        kind.alias("kind"),
        F.struct("conv_id", "turn", "text").alias("ordinal"),
        F.col("text").alias("statement"),
    )
    sources = t(s, d, "pages").select(
        (F.col("page_id") % 60).alias("case_id"),
        F.col("page_id").alias("ordinal"),
        F.when(F.col("page_id") % 3 == 0, "DOI").otherwise(F.col("url")).alias("source"),
    )
    held = artifacts(s, d).select("case_id", F.col("artifact_id").alias("ordinal"), F.col("artifact_id").cast("string").alias("artifact_id"))
    held = held.unionByName(held.where("ordinal % 9 = 0").withColumn("artifact_id", F.concat(F.lit("x"), "artifact_id")))
    out = ck.review_report(statements, sources, held, sizes(s, d))
    joined = lambda rows, text: F.sha2(F.array_join(F.transform(rows, text), "|"), 256)
    texts = [joined(c, lambda x: x).alias(c) for c in ck.REVIEW.values()]
    cited = joined("citation_checks", lambda x: F.concat(x["source"], x["valid"].cast("string"))).alias("citation_checks")
    return out.select(
        "case_id",
        *texts,
        cited,
        joined("artifact_checks", lambda x: F.concat(x["artifact_id"], x["present"].cast("string"), x["note"])).alias("artifact_checks"),
    )


def record(s, d):
    """Conversations as cases: roles stand for modes and kinds of statements, turns for artifacts and files. A claim names its own turn and the
    next one; every seventh case needs a file that is not there."""
    c = t(s, d, "conversations")
    case = F.col("conv_id").alias("case_id")
    file = lambda n: F.concat_ws(":", "conv_id", n.cast("string"))
    of = lambda condition: F.array_sort(F.collect_list(F.when(condition, F.coalesce("text", F.lit("")))))
    mode = F.when(F.col("role") == "user", "lesson").when(F.col("role") == "assistant", "replay").otherwise("reproduce")
    cases = c.groupBy("conv_id").agg(
        F.collect_set(mode).alias("modes"),
        of(F.col("role") == "user").alias("observation"),
        of(F.col("role") == "assistant").alias("computed"),
        of(F.col("turn") > 2).alias("interpretation"),
        of(F.col("role") == "system").alias("limitation"),
        F.collect_list(file(F.col("turn"))).alias("required_inputs"),
    )
    gone = F.when(F.col("conv_id") % 7 == 0, F.array(file(F.lit(99))))
    status = F.when(F.col("conv_id") % 5 == 0, "draft").otherwise("ready")
    claims = c.where("conv_id % 3 <> 0").select(case, F.array(F.col("turn").cast("string"), F.when(F.col("conv_id") % 2 == 0, (F.col("turn") + 1).cast("string"))).alias("artifact_ids"))
    held = c.select(case, F.col("turn").cast("string").alias("artifact_id"))
    cases = cases.select("*", case, status.alias("status"), gone.alias("expected_outputs")).drop("conv_id")
    return ck.record_checks(cases, claims, held, c.select(file(F.col("turn")).alias("path")))


QUERIES = {
    "s3_scan_files": lambda s, d: stats(s, d),
    "j1_unresolved_refs": lambda s, d: ck.unresolved_claim_refs(
        t(s, d, "documents").select((F.col("doc_id") % 3).alias("case_id"), F.col("doc_id").alias("artifact_id")),
        t(s, d, "labels").select((F.col("doc_id") % 3).alias("case_id"), F.col("doc_id").alias("artifact_id")),
    ),
    "j2_missing_files": lambda s, d: ck.missing_recipe_files(
        t(s, d, "orders").select(F.col("o_orderkey").alias("path")),
        t(s, d, "lineitem").select(F.col("l_orderkey").alias("path")),
    )[0],
    "j3_artifact_size_check": sizes,
    "j4_stale_metadata": stale,
    "u4_all_checks": every_check,
    "a14_validation_rollup": rollup,
    "a2_release_checks": lambda s, d: ck.release_checks(
        t(s, d, "part").select((F.col("p_partkey") % 1500).alias("case_id"), (F.col("p_size") > 0).alias("ready")),
        2000,
    ),
    "a15_review_report": review,
    "u4_record_checks": record,
}

CRLF = "chr(13) || chr(10)"
# Eight bytes stand before every fourth content; one pair of them is a CRLF, one more a bare LF.
STATS = f"""st AS (SELECT doc_id AS path, CASE WHEN doc_id % 7 = 0 THEN replace(text, chr(10), {CRLF}) ELSE text END AS c, doc_id % 4 = 0 AS bin FROM documents),
n AS (SELECT path, bin, c, strlen(c) AS b, strlen(replace(c, {CRLF}, chr(10))) AS lf, strlen(c) - strlen(replace(c, chr(10), '')) AS ends FROM st),
s AS (SELECT path, b + CASE WHEN bin THEN 8 ELSE 0 END AS bytes, lf + CASE WHEN bin THEN 7 ELSE 0 END AS lf_bytes, lf + ends + CASE WHEN bin THEN 9 ELSE 0 END AS crlf_bytes,
  CASE WHEN bin THEN b + 8 ELSE lf END AS canonical_bytes, CASE WHEN bin THEN sha256('\\x89PNG\\x0D\\x0A\\x1A\\x0A'::BLOB || encode(c)) ELSE sha256(replace(c, {CRLF}, chr(10))) END AS sha256 FROM n)"""
SIZES = f"""{STATS}, a AS (SELECT doc_id % 50 AS case_id, doc_id AS artifact_id, CASE WHEN doc_id % 13 <> 0 THEN doc_id + CASE WHEN doc_id % 17 = 0 THEN 10000000 ELSE 0 END END AS path,
  CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN n_chars ELSE strlen(text) + CASE WHEN doc_id % 4 = 0 THEN 8 ELSE 0 END END AS recorded FROM documents),
z AS (SELECT a.*, s.bytes, coalesce(recorded, bytes) AS want, coalesce(recorded, bytes) IN (lf_bytes, crlf_bytes) AS alike, lf_bytes, crlf_bytes FROM a LEFT JOIN s ON s.path = a.path),
zc AS (SELECT case_id, artifact_id::VARCHAR AS name, path IS NULL OR (bytes IS NOT NULL AND (bytes = want OR alike)) AS ok,
  CASE WHEN path IS NULL THEN 'resource' WHEN bytes IS NULL THEN 'missing' WHEN bytes <> want AND alike THEN bytes || ' bytes (LF-equivalent ' || lf_bytes || '; CRLF-equivalent ' || crlf_bytes || ')' ELSE bytes::VARCHAR END AS actual,
  CASE WHEN path IS NULL THEN 'resource' WHEN bytes IS NULL THEN 'present' ELSE want::VARCHAR END AS expected FROM z),
lc AS (SELECT doc_id % 50 AS case_id, 'quality:' || doc_id AS name, coalesce(quality = 1, false) AS ok, quality::VARCHAR AS actual, '1' AS expected FROM labels)"""
KIND = "CASE WHEN role = 'user' THEN 'observation' WHEN role = 'assistant' THEN 'computed' WHEN turn = 0 THEN 'interpretation' ELSE 'limitation' END"
TEXTS = ", ".join(f"sha256(coalesce(string_agg(text, '|' ORDER BY conv_id, turn, text) FILTER (WHERE kind = '{kind}'), '')) AS {name}" for kind, name in ck.REVIEW.items())

SQL = {
    "s3_scan_files": f"WITH {STATS} SELECT * FROM s",
    "j1_unresolved_refs": "SELECT doc_id % 3 AS case_id, doc_id AS artifact_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "j2_missing_files": "SELECT o_orderkey AS path FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
    "j3_artifact_size_check": f"WITH {SIZES} SELECT * FROM zc",
    "j4_stale_metadata": f"""WITH {STATS} SELECT path, canonical_bytes AS bytes, CASE WHEN doc_id % 3 < 2 THEN sha256 END AS sha256 FROM s JOIN documents ON doc_id = path
WHERE (doc_id % 6 <> 5 AND n_chars <> canonical_bytes) OR doc_id % 3 = 1 OR (doc_id % 3 = 0 AND sha256 <> sha256(text))""",
    "u4_all_checks": f"WITH {SIZES} SELECT * FROM zc UNION ALL SELECT * FROM lc",
    "a14_validation_rollup": f"""WITH {SIZES}, u AS (SELECT * FROM zc UNION ALL SELECT * FROM lc), g AS (SELECT case_id, bool_and(ok) AS ok, count(*) AS checks, string_agg(name, ', ' ORDER BY reverse(name), name) FILTER (WHERE NOT ok) AS failed FROM u GROUP BY case_id)
SELECT case_id, ok, checks, CASE WHEN NOT ok THEN 'REPLAY_VALIDATION_FAILED' END AS error_code, failed AS error_message FROM g""",
    "a2_release_checks": """WITH a AS (SELECT count(*) AS n, count(DISTINCT p_partkey % 1500) AS d, bool_and(p_size > 0) AS r FROM part)
SELECT 'release' AS case_id, 'cases count' AS name, n = 2000 AS ok, n::VARCHAR AS actual, '2000' AS expected FROM a UNION ALL SELECT 'release', 'all ready', r, r::VARCHAR, 'true' FROM a UNION ALL SELECT 'release', 'unique ids', n = d, d::VARCHAR, n::VARCHAR FROM a""",
    "a15_review_report": f"""WITH {SIZES}, c AS (SELECT conv_id % 50 AS case_id, conv_id, turn, {KIND} AS kind, text FROM conversations), x AS (SELECT case_id, {TEXTS} FROM c GROUP BY 1),
p AS (SELECT page_id % 60 AS case_id, sha256(string_agg(CASE WHEN page_id % 3 = 0 THEN 'DOIfalse' ELSE url || regexp_matches(url, '^https?://') END, '|' ORDER BY page_id)) AS citation_checks FROM pages GROUP BY 1),
y AS (SELECT case_id, name, artifact_id, ok, actual FROM zc JOIN (SELECT case_id AS ci, artifact_id FROM a) ON ci = case_id AND artifact_id::VARCHAR = name
  UNION ALL SELECT case_id, 'x' || artifact_id, artifact_id, true, 'resource reference' FROM a WHERE artifact_id % 9 = 0),
q AS (SELECT case_id, sha256(string_agg(name || ok || actual, '|' ORDER BY artifact_id, name)) AS artifact_checks FROM y GROUP BY 1), none AS (SELECT sha256('') AS z)
SELECT case_id, {", ".join(f"coalesce({n}, z) AS {n}" for n in (*ck.REVIEW.values(), "citation_checks", "artifact_checks"))} FROM x FULL JOIN p USING (case_id) FULL JOIN q USING (case_id), none""",
}

#: Name, actual value and expected value of the ten checks, in their order, over one row per case.
RECORD = (
    ("showcase is ready", "status", "ready"),
    ("lesson mode declared", "users > 0", "true"),
    ("replay mode declared", "assistants > 0", "true"),
    ("reproduce mode declared", "others > 0", "true"),
    ("source observations recorded", "users > 0", "true"),
    ("computed results recorded", "assistants > 0", "true"),
    ("scientific interpretation recorded", "late > 0", "true"),
    ("limitations recorded", "systems > 0", "true"),
    ("claim artifact references resolve", "case_id % 3 = 0 OR case_id % 2 <> 0 OR open = 0", "true"),
    ("recipe files are present", "case_id % 7 <> 0", "true"),
)
SQL["u4_record_checks"] = """WITH n AS (SELECT *, turn + 1 NOT IN (SELECT turn FROM conversations o WHERE o.conv_id = c.conv_id) AS last FROM conversations c),
x AS (SELECT conv_id AS case_id, CASE WHEN conv_id % 5 = 0 THEN 'draft' ELSE 'ready' END AS status, count(*) FILTER (WHERE role = 'user') AS users, count(*) FILTER (WHERE role = 'assistant') AS assistants,
  count(*) FILTER (WHERE role = 'system') AS systems, count(*) FILTER (WHERE role IS NULL OR role NOT IN ('user', 'assistant')) AS others, count(*) FILTER (WHERE turn > 2) AS late, count(*) FILTER (WHERE last) AS open FROM n GROUP BY 1)
""" + " UNION ALL ".join(f"SELECT {k}::INTEGER AS ordinal, case_id, '{name}' AS name, ({actual})::VARCHAR = '{expected}' AS ok, ({actual})::VARCHAR AS actual, '{expected}' AS expected FROM x" for k, (name, actual, expected) in enumerate(RECORD))
