"""Joins and summaries of evidence tables: variants, literature, databases, expression, candidates. Identifiers are kept; tables
of different sources are joined on keys, never merged beforehand."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.operators.ordered import CROWD, with_previous

ALLELE = ("chrom", "pos", "ref", "alt")


def allele_join(sources: dict[str, DataFrame], statuses: dict[str, str]) -> DataFrame:
    """Full outer join of sources on the allele, never on an rsID. Each source gives a struct column of its name and
    <name>_used, whether it is evidence: its rows are there and its status is ok."""
    out = None
    for name, df in sources.items():
        one = df.select(*ALLELE, F.struct(*(c for c in df.columns if c not in ALLELE)).alias(name))
        out = one if out is None else out.join(one, list(ALLELE), "full_outer")
    return out.withColumns({f"{n}_used": F.col(n).isNotNull() & F.lit(statuses.get(n, "ok") == "ok") for n in sources})


def ambiguous_rsids(variants: DataFrame) -> DataFrame:
    """rsIDs that name several alternate alleles."""
    return variants.groupBy("rsid").agg(F.countDistinct(*ALLELE).alias("alleles")).where("alleles > 1")


def preprint_publication(versions: DataFrame, links: DataFrame, publications: DataFrame) -> DataFrame:
    """First version of each preprint with its publication, days between them, and whether the title changed; preprints
    without a link are kept."""
    first = versions.groupBy("preprint").agg(
        F.min("version_date").alias("first_date"),
        F.count("*").alias("versions"),
        F.min_by("title", F.struct("version_date", "title")).alias("preprint_title"),
    )
    out = first.join(links, "preprint", "left").join(publications, "pub_id", "left")
    return out.select(
        "preprint",
        "versions",
        "first_date",
        "pub_id",
        "pub_date",
        F.datediff("pub_date", "first_date").alias("elapsed_days"),
        F.when(F.col("pub_id").isNotNull(), ~F.col("pub_title").eqNullSafe(F.col("preprint_title"))).alias("title_changed"),
    )


def article_availability(articles: DataFrame, crosswalk: DataFrame, files: DataFrame) -> DataFrame:
    """Articles with their other identifiers and the sorted set of their file types."""
    types = files.groupBy("article").agg(F.sort_array(F.collect_set("file_type")).alias("types"), F.count("*").alias("files"))
    out = articles.join(crosswalk, "article", "left").join(types, "article", "left")
    return out.withColumns({"types": F.coalesce("types", F.array().cast("array<string>")), "files": F.coalesce("files", F.lit(0))})


def evidence_edges(*parts: tuple[DataFrame, str, str, str, str, str]) -> DataFrame:
    """Distinct edges (src_type, src_id, relation, dst_type, dst_id) of (rows, source type, source column, relation, target
    type, target column)."""
    edges = [df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.lit(s).alias("src_type"), F.col(a).cast("string").alias("src_id"), F.lit(r).alias("relation"), F.lit(t).alias("dst_type"), F.col(b).cast("string").alias("dst_id")) for df, s, a, r, t, b in parts]
    return reduce(DataFrame.unionByName, edges).distinct()


def gene_summary(expression: DataFrame, observations: DataFrame) -> DataFrame:
    """Per gene over all observations: n, nonzero, min, max, mean; entries that are absent are zeros and are never made."""
    n = observations.agg(F.count("*").alias("n"))
    per = expression.groupBy("gene").agg(
        F.count_if(F.col("value") != 0).alias("nonzero"),
        F.min("value").alias("lo"),
        F.max("value").alias("hi"),
        F.sum("value").alias("total"),
        F.count("*").alias("stored"),
    )
    per = per.join(F.broadcast(n))  # one row
    sparse = F.col("stored") < F.col("n")
    return per.select(
        "gene",
        "n",
        "nonzero",
        F.when(sparse, F.least("lo", F.lit(0.0))).otherwise(F.col("lo")).alias("min"),
        F.when(sparse, F.greatest("hi", F.lit(0.0))).otherwise(F.col("hi")).alias("max"),
        (F.col("total") / F.col("n")).alias("mean"),
    )


def expression_qc(counts: DataFrame, mitochondrial: Column, parts: int = 256) -> DataFrame:
    """Per cell: library size, detected genes, mitochondrial share, and rank by library size (equal sizes share a rank).

    Ranks come from the distinct sizes: these are dealt into `parts` ranges by approximate quantiles, summed up range by range,
    and each range gets the number of cells in the ranges above it; no task sees all cells."""
    cells = counts.groupBy("cell").agg(
        F.sum("value").alias("library"),
        F.countDistinct(F.when(F.col("value") > 0, F.col("gene"))).alias("genes"),
        F.sum(F.when(mitochondrial, F.col("value")).otherwise(0.0)).alias("mt"),
    )
    cells = cells.select("cell", F.round("library", 6).alias("library"), "genes", F.try_divide("mt", "library").alias("mt_share"))
    edges = sorted(set(cells.approxQuantile("library", [k / parts for k in range(1, parts)], 1 / (4 * parts))))  # fewer than `parts` numbers
    part = F.size(F.filter(F.array(*map(F.lit, edges)).cast("array<double>"), lambda e: e < F.col("library")))
    sizes = cells.groupBy("library").agg(F.count("*").alias("n")).withColumn("part", part)
    above = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.groupBy("part").agg(F.sum("n").alias("total")).withColumn("offset", F.coalesce(F.sum("total").over(above), F.lit(0))).drop("total")  # at most `parts` rows
    before = Window.partitionBy("part").orderBy(F.desc("library")).rowsBetween(Window.unboundedPreceding, -1)
    ranks = sizes.join(F.broadcast(offsets), "part").select(
        "library",
        (1 + F.col("offset") + F.coalesce(F.sum("n").over(before), F.lit(0))).cast("int").alias("rank"),
    )
    return cells.join(ranks, "library").select("cell", "library", "genes", "mt_share", "rank")


def theme_counts(records: DataFrame) -> DataFrame:
    """Records per kind: review (by theme), primary, and preprints apart."""
    kind = F.when(F.col("is_preprint"), "preprint").when(F.contains("theme", F.lit("review")), "review").otherwise("primary")
    return records.groupBy(kind.alias("kind")).agg(F.count("*").alias("records"))


def eqtl_summary(rows: DataFrame) -> DataFrame:
    """Per variant and gene: rows, sorted tissues, effect and p-value ranges."""
    return rows.groupBy("variant", "gene").agg(
        F.count("*").alias("rows"),
        F.array_join(F.sort_array(F.collect_set("tissue")), ",").alias("tissues"),
        F.min("effect").alias("effect_min"),
        F.max("effect").alias("effect_max"),
        F.min("p").alias("p_min"),
        F.max("p").alias("p_max"),
    )


def mechanism_slice(mechanisms: DataFrame) -> DataFrame:
    """Per target and action type: rows, rows at phase 4, and whether all are."""
    return mechanisms.groupBy("target", "action").agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("phase") == 4).alias("at_phase_4"),
        F.every(F.col("phase") == 4).alias("all_phase_4"),
    )


def ensemble_scores(models: DataFrame) -> DataFrame:
    """Per candidate: models, mean and sample sd of the score, severe clashes, and the best model (least id on ties)."""
    return models.groupBy("candidate").agg(
        F.count("*").alias("models"),
        F.avg("score").alias("mean"),
        F.stddev_samp("score").alias("sd"),
        F.count_if("severe_clash").alias("severe_clashes"),
        F.min_by("model", F.struct((-F.col("score")).alias("s"), "model")).alias("best_model"),
    )


def rank_candidates(scores: DataFrame, k: int, by: str, *ties: str, within: str | None = None) -> DataFrame:
    """The k best by score, ranked; per group if `within` is named."""
    if within is None:  # k rows meet in the window, not all
        scores = scores.orderBy(F.desc(by), *ties).limit(k)
    order = Window.partitionBy(*([within] if within else [])).orderBy(F.desc(by), *ties)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def recent_records(records: DataFrame, n: int, date: str, *ties: str) -> DataFrame:
    """The n most recent records."""
    return records.orderBy(F.desc(date), *ties).limit(n)


def version_history(versions: DataFrame, piece: str = "month", crowd: int = CROWD) -> DataFrame:
    """Versions of each record in order: number, first date, days since the version before. A record of more than `crowd` versions is cut
    into pieces of time, so one record may have most of all rows."""
    rows = with_previous(versions, "record", ("date", "version"), piece, ("date",), crowd)
    return rows.select(
        *versions.columns,
        F.col("_number").alias("number"),
        F.col("_first").alias("first_date"),
        F.datediff("date", F.col("_before")["date"]).alias("gap_days"),
    )
