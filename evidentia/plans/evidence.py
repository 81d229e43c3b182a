"""Evidence and expression queries on the order tables, events and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.operators import evidence as ev


def t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def day(c):
    return F.col(c).cast("date")


def alleles(s, d):
    li = t(s, d, "lineitem").select(
        F.col("l_orderkey").alias("chrom"),
        F.lit(1).alias("pos"),
        F.lit("R").alias("ref"),
        F.col("l_returnflag").alias("alt"),
        "l_quantity",
    ).groupBy("chrom", "pos", "ref", "alt").agg(F.sum("l_quantity").alias("quantity"))
    o = t(s, d, "orders").select(
        F.col("o_orderkey").alias("chrom"),
        F.lit(1).alias("pos"),
        F.lit("R").alias("ref"),
        F.when(F.col("o_orderstatus") == "F", "A").otherwise("N").alias("alt"),
        F.col("o_custkey").alias("cust"),
    )
    j = ev.allele_join({"lines": li, "heads": o}, {"heads": "ok", "lines": "ok"})
    return j.select("chrom", "alt", F.col("lines.quantity").alias("quantity"), F.col("heads.cust").alias("cust"), "lines_used", "heads_used")


def rsids(s, d):
    li = t(s, d, "lineitem").select(
        F.col("l_partkey").alias("rsid"),
        F.lit(1).alias("chrom"),
        F.col("l_partkey").alias("pos"),
        F.lit("R").alias("ref"),
        F.col("l_returnflag").alias("alt"),
    )
    return ev.ambiguous_rsids(li)


def preprints(s, d):
    o = t(s, d, "orders")
    v = o.select(F.col("o_custkey").alias("preprint"), day("o_orderdate").alias("version_date"), F.col("o_orderpriority").alias("title"))
    c = t(s, d, "customer")
    links = c.select(
        F.col("c_custkey").alias("preprint"),
        F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey")).otherwise(-F.col("c_custkey")).alias("pub_id"),
    )
    pubs = t(s, d, "lineitem").groupBy(F.col("l_partkey").alias("pub_id")).agg(
        F.min(day("l_shipdate")).alias("pub_date"),
        F.min("l_returnflag").alias("pub_title"),
    )
    return ev.preprint_publication(v, links, pubs).select(
        "preprint",
        "versions",
        F.col("pub_id"),
        F.col("elapsed_days").cast("long").alias("elapsed_days"),
        "title_changed",
    )


def availability(s, d):
    c = t(s, d, "customer").select(F.col("c_custkey").alias("article"), (F.col("c_acctbal") > 0).alias("open_access"), "c_nationkey")
    n = t(s, d, "customer").join(t(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("article"),
        F.col("n_name").alias("pmid"),
    )
    f = t(s, d, "orders").select(F.col("o_custkey").alias("article"), F.col("o_orderpriority").alias("file_type"))
    return ev.article_availability(c.drop("c_nationkey"), n, f).withColumn("types", F.array_join("types", ","))


def edges(s, d):
    li, su, na = t(s, d, "lineitem"), t(s, d, "supplier"), t(s, d, "nation")
    return ev.evidence_edges(
        (li, "part", "l_partkey", "supplied_by", "supplier", "l_suppkey"),
        (su, "supplier", "s_suppkey", "located_in", "nation", "s_nationkey"),
        (na, "nation", "n_nationkey", "part_of", "region", "n_regionkey"),
    )


def expression(s, d):
    return t(s, d, "events").groupBy(F.col("user_id").alias("cell"), F.col("event_type").alias("gene")).agg(F.round(F.sum("value"), 6).alias("value"))


def genes(s, d):
    x = expression(s, d)
    return ev.gene_summary(x, t(s, d, "events").select("user_id").distinct()).withColumn("mean", F.round("mean", 6))


def qc(s, d):
    return ev.expression_qc(expression(s, d), F.col("gene") == "error").withColumn("mt_share", F.round("mt_share", 6))


def themes(s, d):
    r = t(s, d, "documents").select(
        F.concat_ws(" ", "source", F.when(F.col("lang") == "en", "review")).alias("theme"),
        (F.col("lang") == "es").alias("is_preprint"),
    )
    return ev.theme_counts(r)


def eqtl(s, d):
    return ev.eqtl_summary(t(s, d, "lineitem").select(
        F.col("l_partkey").alias("variant"),
        F.col("l_suppkey").alias("gene"),
        F.col("l_returnflag").alias("tissue"),
        F.col("l_extendedprice").alias("effect"),
        F.col("l_discount").alias("p"),
    ))


def mechanisms(s, d):
    return ev.mechanism_slice(t(s, d, "lineitem").select(
        F.col("l_suppkey").alias("target"),
        F.col("l_returnflag").alias("action"),
        F.col("l_linenumber").alias("phase"),
    ))


def scores(s, d):
    m = t(s, d, "lineitem").select(
        F.col("l_suppkey").alias("candidate"),
        F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey").alias("model"),
        F.col("l_extendedprice").alias("score"),
        (F.col("l_discount") > 0.08).alias("severe_clash"),
    )
    return ev.ensemble_scores(m).withColumns({"mean": F.round("mean", 4), "sd": F.round("sd", 4)})


def ranked(s, d):
    x = t(s, d, "lineitem").groupBy(
        F.col("l_returnflag").alias("target"),
        F.col("l_partkey").alias("candidate"),
    ).agg(F.round(F.avg("l_extendedprice"), 4).alias("mean"))
    return ev.rank_candidates(x, 5, "mean", "candidate", within="target")


QUERIES = {
    "j11_allele_join": alleles,
    "j11_ambiguous_rsids": rsids,
    "j12_preprint_publication": preprints,
    "j13_article_availability": availability,
    "j14_evidence_edges": edges,
    "a8_gene_summary": genes,
    "a10_theme_counts": themes,
    "a11_eqtl_summary": eqtl,
    "a12_mechanism_slice": mechanisms,
    "a13_ensemble_scores": scores,
    "a16_expression_qc": qc,
    "w2_rank_candidates": ranked,
    "w3_recent_records": lambda s, d: ev.recent_records(
        t(s, d, "orders").select("o_orderkey", day("o_orderdate").cast("string").alias("day")),
        25,
        "day",
        "o_orderkey",
    ),
    "w4_version_history": lambda s, d: ev.version_history(t(s, d, "orders").select(F.col("o_custkey").alias("record"), F.col("o_orderkey").alias("version"), day("o_orderdate").alias("date"))).select(
        "record",
        "version",
        F.col("number").cast("long").alias("number"),
        F.col("first_date").cast("string").alias("first_date"),
        F.col("gap_days").cast("long").alias("gap_days"),
    ),
}

EXPRESSION = "x AS (SELECT user_id AS cell, event_type AS gene, round(sum(value), 6) AS value FROM events GROUP BY ALL)"

SQL = {
    "j11_allele_join": """WITH l AS (SELECT l_orderkey AS chrom, l_returnflag AS alt, sum(l_quantity) AS quantity FROM lineitem GROUP BY ALL), o AS (SELECT o_orderkey AS chrom, CASE WHEN o_orderstatus = 'F' THEN 'A' ELSE 'N' END AS alt, o_custkey AS cust FROM orders)
SELECT coalesce(l.chrom, o.chrom) AS chrom, coalesce(l.alt, o.alt) AS alt, quantity, cust, l.chrom IS NOT NULL AS lines_used, o.chrom IS NOT NULL AS heads_used FROM l FULL JOIN o ON l.chrom = o.chrom AND l.alt = o.alt""",
    "j11_ambiguous_rsids": "SELECT l_partkey AS rsid, count(DISTINCT l_returnflag) AS alleles FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1",
    "j12_preprint_publication": """WITH v AS (SELECT o_custkey AS preprint, o_orderdate::DATE AS dt, o_orderpriority AS title FROM orders), f AS (SELECT preprint, min(dt) AS first_date, count(*) AS versions, arg_min(title, (dt, title)) AS title FROM v GROUP BY 1),
k AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey ELSE -c_custkey END AS pub_id FROM customer), p AS (SELECT l_partkey AS id, min(l_shipdate::DATE) AS pub_date, min(l_returnflag) AS pub_title FROM lineitem GROUP BY 1)
SELECT preprint, versions, pub_id, (pub_date - first_date)::BIGINT AS elapsed_days, CASE WHEN pub_id IS NOT NULL THEN pub_title IS DISTINCT FROM title END AS title_changed FROM f LEFT JOIN k ON k.id = preprint LEFT JOIN p ON p.id = pub_id""",
    "j13_article_availability": """WITH f AS (SELECT o_custkey AS a, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS types, count(*) AS files FROM orders GROUP BY 1)
SELECT c_custkey AS article, c_acctbal > 0 AS open_access, n_name AS pmid, coalesce(types, '') AS types, coalesce(files, 0) AS files FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN f ON a = c_custkey""",
    "j14_evidence_edges": """SELECT DISTINCT 'part' AS src_type, l_partkey::VARCHAR AS src_id, 'supplied_by' AS relation, 'supplier' AS dst_type, l_suppkey::VARCHAR AS dst_id FROM lineitem
UNION SELECT 'supplier', s_suppkey::VARCHAR, 'located_in', 'nation', s_nationkey::VARCHAR FROM supplier UNION SELECT 'nation', n_nationkey::VARCHAR, 'part_of', 'region', n_regionkey::VARCHAR FROM nation""",
    "a8_gene_summary": f"""WITH {EXPRESSION}, n AS (SELECT count(DISTINCT user_id) AS n
FROM events) SELECT gene, n, count(*) FILTER (WHERE value <> 0) AS nonzero, CASE WHEN count(*) < n THEN least(min(value), 0.0) ELSE min(value) END AS min, CASE WHEN count(*) < n THEN greatest(max(value), 0.0) ELSE max(value) END AS max, round(sum(value) / n, 6) AS mean
FROM x, n
GROUP BY gene, n""",
    "a10_theme_counts": """SELECT CASE WHEN lang = 'es' THEN 'preprint' WHEN lang = 'en' OR contains(source, 'review') THEN 'review' ELSE 'primary' END AS kind, count(*) AS records
FROM documents
GROUP BY 1""",
    "a11_eqtl_summary": """SELECT l_partkey AS variant, l_suppkey AS gene, count(*) AS rows, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS tissues, min(l_extendedprice) AS effect_min, max(l_extendedprice) AS effect_max, min(l_discount) AS p_min, max(l_discount) AS p_max
FROM lineitem
GROUP BY 1, 2""",
    "a12_mechanism_slice": """SELECT l_suppkey AS target, l_returnflag AS action, count(*) AS rows, count(*) FILTER (WHERE l_linenumber = 4) AS at_phase_4, bool_and(l_linenumber = 4) AS all_phase_4
FROM lineitem
GROUP BY 1, 2""",
    "a13_ensemble_scores": """SELECT l_suppkey AS candidate, count(*) AS models, round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS sd, count(*) FILTER (WHERE l_discount > 0.08) AS severe_clashes, arg_min(l_orderkey || ':' || l_linenumber || ':' || l_partkey, (-l_extendedprice, l_orderkey || ':' || l_linenumber || ':' || l_partkey)) AS best_model
FROM lineitem
GROUP BY 1""",
    "a16_expression_qc": f"""WITH {EXPRESSION}, c AS (SELECT cell, round(sum(value), 6) AS library, count(DISTINCT gene) FILTER (WHERE value > 0) AS genes, round(sum(CASE WHEN gene = 'error' THEN value ELSE 0 END) / sum(value), 6) AS mt_share
FROM x
GROUP BY cell) SELECT *, rank() OVER (ORDER BY library DESC)::INTEGER AS rank
FROM c""",
    "w2_rank_candidates": """WITH x AS (SELECT l_returnflag AS target, l_partkey AS candidate, round(avg(l_extendedprice), 4) AS mean
FROM lineitem
GROUP BY ALL) SELECT *, (row_number() OVER (PARTITION BY target ORDER BY mean DESC, candidate))::INTEGER AS rank
FROM x
QUALIFY rank <= 5""",
    "w3_recent_records": "SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS day FROM orders ORDER BY day DESC, o_orderkey LIMIT 25",
    "w4_version_history": """SELECT o_custkey AS record, o_orderkey AS version, row_number() OVER w AS number, (first_value(o_orderdate::DATE) OVER w)::VARCHAR AS first_date, (o_orderdate::DATE - lag(o_orderdate::DATE) OVER w)::BIGINT AS gap_days
FROM orders
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate::DATE, o_orderkey)""",
}
