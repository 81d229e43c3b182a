"""Catalogue jobs: search, lookup, bounded opening, sections and statements, first-of-kind rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import text as tx

DEFAULT_BYTES, MOST_BYTES = 131072, 524288


def catalogue_search(cases: DataFrame, query: str = "", category: str | None = None, runnable_only: bool = False) -> DataFrame:
    """Ready cases of a category whose search text holds the query literally (trimmed, lower-cased); an empty query and no
    category do not filter."""
    out = cases.where("status = 'ready'")
    if category is not None:
        out = out.where(F.col("category") == category)
    if query.strip():
        out = out.where(F.contains("search_text", F.lit(query.strip().lower())))
    return out.where("runnable") if runnable_only else out


def catalogue_get(cases: DataFrame, ids: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """The cases of the requested ids, and the requested ids that are unknown."""
    return cases.join(ids, key, "left_semi"), ids.join(cases, key, "left_anti")


def artifacts_by_role(artifacts: DataFrame, role: str | None = None) -> DataFrame:
    """Artifacts per role, of one role if it is named."""
    rows = artifacts if role is None else artifacts.where(F.col("role") == role)
    return rows.groupBy("role").agg(F.count("*").alias("artifacts"))


# Media types and extensions whose content is shown as text.
TEXT_MEDIA = (
    "application/json",
    "application/geo+json",
    "chemical/x-mmcif",
    "chemical/x-pdb",
    "image/svg+xml",
    "text/csv",
    "text/markdown",
    "text/plain",
    "text/x-fasta",
    "text/x-genbank",
    "text/x-newick",
)
TEXT_ENDS = (".md", ".json", ".csv", ".svg", ".pdb", ".cif", ".fasta", ".gb", ".nwk")


def open_bounded(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """files (path, media_type, content): the content only where it is text-like and within the limit; truncated tells by
    size alone. A row without a path is a reference to a resource."""
    limit = max(1, min(MOST_BYTES, DEFAULT_BYTES if max_bytes is None else max_bytes))
    size = F.octet_length("content")
    like_text = F.col("media_type").isin(*TEXT_MEDIA) | F.lower("path").rlike(r"[^/](" + "|".join(TEXT_ENDS).replace(".", r"\.") + ")$")
    note = F.when(F.col("path").isNull(), "This artifact is represented by a resource reference.")
    note = note.when(
        ~like_text,
        "Binary artifact; use the scientific viewer or package file.",
    ).when(size > limit, f"Text exceeds the {limit}-byte display limit.")
    shown = F.col("path").isNotNull() & like_text & (size <= limit)
    here = F.col("path").isNotNull()
    return files.select(
        "path",
        "media_type",
        F.when(here, size.cast("long")).alias("bytes"),
        F.when(shown, F.col("content")).alias("content"),
        F.when(here, size > limit).alias("truncated"),
        note.alias("note"),
    )


def with_category(cases: DataFrame, categories: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Cases with their category (a small dimension), and the cases without one."""
    return cases.join(categories, key), cases.join(categories, key, "left_anti")


def dedupe_keep_first(artifacts: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first artifact of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return artifacts.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def number_claims(statements: DataFrame) -> DataFrame:
    """1-based number per case and kind; it forms the claim id."""
    n = F.row_number().over(Window.partitionBy("case_id", "kind").orderBy("ordinal"))
    return statements.withColumn("number", n).withColumn("claim_id", F.concat_ws(":", "case_id", "kind", "number"))


def unique_statements(statements: DataFrame) -> DataFrame:
    """Trimmed, non-empty statements once per case and kind, with their first ordinal."""
    rows = statements.withColumn("statement", F.trim("statement")).where("statement <> ''")
    return rows.groupBy("case_id", "kind", "statement").agg(F.min("ordinal").alias("ordinal"))


def statements_not_in_section(statements: DataFrame, sections: DataFrame) -> DataFrame:
    """Statements whose cleaned text is not in the section of their case; only cases that have the section."""
    rows = statements.join(sections.select("case_id", "section_text"), "case_id")
    return rows.where(~F.contains("section_text", tx.clean_markdown(F.col("statement")))).drop("section_text")


def markdown_sections(docs: DataFrame) -> DataFrame:
    """One row per `## heading` section, heading trimmed and lower-cased, body cleaned; of equal headings the last wins.
    docs: doc_id, text."""
    parts = docs.select("doc_id", F.posexplode(F.split("text", rf"(?m)^##{tx.BLANK}+")).alias("pos", "part")).where("pos > 0")
    heading = F.lower(tx.trimmed(F.regexp_extract("part", r"^[^\r\n\x{2028}\x{2029}]*", 0)))
    body = tx.clean_markdown(F.regexp_replace("part", r"^[^\r\n\x{2028}\x{2029}]*", ""))
    parts = parts.select("doc_id", "pos", heading.alias("heading"), body.alias("body")).where("heading <> ''")
    return parts.groupBy("doc_id", "heading").agg(F.max_by("body", "pos").alias("body"))


def first_section(sections: DataFrame, headings: list[str]) -> DataFrame:
    """The first section that is not empty among headings in order of priority."""
    order = F.array_position(F.array(*map(F.lit, headings)), F.col("heading"))
    return sections.where(F.col("heading").isin(*headings) & (F.col("body") != "")).groupBy("doc_id").agg(
        F.min_by("heading", order).alias("heading"),
        F.min_by("body", order).alias("body"),
    )


# Headings of the sections that statements of each kind come from, in order of priority.
HEADINGS = {
    "source": ("source observations", "verified observations", "source and method", "observed interface state"),
    "computed": (
        "computed results",
        "computed result",
        "viewer analysis",
        "result",
        "computed summary",
        "starter-contract metric",
        "alignment result carried by the starter contract",
    ),
    "interpretation": ("interpretation", "scientific interpretation"),
    "limitations": ("limitations", "limitation"),
    "question": ("scientific question", "scientific objective", "proposed analysis"),
}
#: Roles of the artifacts that stand as evidence for each kind of claim.
INPUT_ROLES, OUTPUT_ROLES = ("input", "provenance"), ("output", "preview", "provenance")
EVIDENCE = {"observation": INPUT_ROLES, "computed": OUTPUT_ROLES, "interpretation": OUTPUT_ROLES}


def unique_texts(texts: Column) -> Column:
    """Trimmed, not empty, each once, in order of first appearance."""
    return F.array_distinct(F.filter(F.transform(texts, tx.trimmed), lambda s: s != ""))


def case_statements(cases: DataFrame, sections: DataFrame, headings: dict = HEADINGS) -> DataFrame:
    """Per case: observation, computed, interpretation and limitation as arrays of statements, and question.

    cases: case_id, summary, and the manifest's observations, interpretation, limitations (arrays or null). Sections give the
    statements; observations stand in where a case has neither a source nor a computed section, and those that its source
    section does not hold count as computed. Interpretation and limitations of the manifest go before the sections'."""
    none = F.array().cast("array<string>")
    wanted = sections.where(F.col("heading").isin(*(h for names in headings.values() for h in names)))
    held = wanted.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("heading", "body"))).alias("held"))
    rows = cases.join(held.withColumnRenamed("doc_id", "case_id"), "case_id", "left")

    def section(kind: str) -> Column:
        texts = F.transform(
            F.array(*map(F.lit, headings[kind])),
            lambda h: F.coalesce(F.element_at(F.coalesce("held", F.create_map().cast("map<string,string>")), h), F.lit("")),
        )
        return F.coalesce(F.get(F.filter(texts, lambda t: t != ""), F.lit(0)), F.lit(""))

    rows = rows.withColumns({f"_{kind}": section(kind) for kind in headings})
    own, source, computed = F.coalesce("observations", none), F.col("_source"), F.col("_computed")
    left_over = F.filter(own, lambda o: ~source.contains(tx.clean_markdown(o)))
    return rows.select(
        "case_id",
        unique_texts(F.when((source == "") & (computed == ""), own).otherwise(tx.split_statements(source))).alias("observation"),
        unique_texts(F.concat(tx.split_statements(computed), F.when(source != "", left_over).otherwise(none))).alias("computed"),
        unique_texts(F.coalesce("interpretation", tx.split_statements(F.col("_interpretation")))).alias("interpretation"),
        unique_texts(F.coalesce("limitations", tx.split_statements(F.col("_limitations")))).alias("limitation"),
        F.when(F.col("_question") != "", F.col("_question")).otherwise(F.col("summary")).alias("question"),
    )


def build_claims(statements: DataFrame, artifacts: DataFrame) -> DataFrame:
    """case_id, claim_id, kind, statement, artifact_ids: the claims of case_statements(), numbered from 1 by kind, with the
    artifacts (case_id, ordinal, artifact_id, role) of their case that stand as evidence, in order."""
    by_role = lambda roles: F.transform(F.array_sort(F.collect_list(F.when(F.col("role").isin(*roles), F.struct("ordinal", "artifact_id")))), lambda x: x["artifact_id"])
    evidence = artifacts.groupBy("case_id").agg(*(by_role(roles).alias(f"_{kind}") for kind, roles in EVIDENCE.items()))
    rows = statements.join(evidence, "case_id", "left")
    one = lambda kind: F.transform(kind, lambda s, i: F.struct(F.lit(kind).alias("kind"), (i + 1).alias("number"), s.alias("statement"), F.coalesce(f"_{kind}", F.array().cast("array<string>")).alias("artifact_ids")))
    claims = rows.select("case_id", F.inline(F.concat(*map(one, EVIDENCE))))
    return claims.select("case_id", F.concat_ws(":", "case_id", "kind", "number").alias("claim_id"), "kind", "statement", "artifact_ids")


def search_text(cases: DataFrame) -> DataFrame:
    """cases with search_text: title, summary, question, category, plugin_name and sources, each once, joined and lower-cased."""
    parts = F.concat(
        F.array(*(F.coalesce(c, F.lit("")) for c in ("title", "summary", "question", "category", "plugin_name"))),
        F.coalesce("sources", F.array().cast("array<string>")),
    )
    return cases.withColumn("search_text", F.lower(F.array_join(unique_texts(parts), " ")))


# Where the cases of a category are run; those of any other need the network.
STRATEGIES = {"sequence": "local", "structure": "local", "workbench": "local", "ngs": "conditional", "slide": "conditional"}
OTHER_STRATEGY = "network"
#: Roles of the artifacts that a case's recipe expects as its results.
RESULT_ROLES = ("output", "preview", "provenance")


def recipes(cases: DataFrame, artifacts: DataFrame, rules: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """case_id, adapter, provider_ids, strategy, required_inputs, expected_outputs.

    cases: case_id, category; artifacts: case_id, ordinal, role (the final one), path; rules: category, adapter, provider_ids; own: case_id
    with adapter, provider_ids and strategy of cases that differ from their category (null: they do not). Paths come in the order of the
    artifacts; those without a path are left out. rules and own are small dimensions; Spark broadcasts them by their size."""
    of_role = lambda *roles: F.transform(F.array_sort(F.collect_list(F.when(F.col("role").isin(*roles) & F.col("path").isNotNull(), F.struct("ordinal", "path")))), lambda x: x["path"])
    paths = artifacts.groupBy("case_id").agg(of_role("input").alias("required_inputs"), of_role(*RESULT_ROLES).alias("expected_outputs"))
    known = F.create_map(*(F.lit(x) for pair in STRATEGIES.items() for x in pair))
    rows = cases.select("case_id", "category").join(rules, "category", "left").withColumn("strategy", F.coalesce(F.try_element_at(known, F.col("category")), F.lit(OTHER_STRATEGY)))
    fields = ("adapter", "provider_ids", "strategy")
    if own is not None:
        rows = rows.join(own.select("case_id", *(F.col(c).alias(f"_{c}") for c in fields)), "case_id", "left")
        rows = rows.withColumns({c: F.coalesce(f"_{c}", c) for c in fields})
    none = F.array().cast("array<string>")
    rows = rows.join(paths, "case_id", "left")
    return rows.select("case_id", *fields, *(F.coalesce(c, none).alias(c) for c in ("required_inputs", "expected_outputs")))


#: Order of a case's declared files.
ROLE_ORDER = ("input", "preview", "output")


def artifact_rows(cases: DataFrame, declared: DataFrame, files: DataFrame, scheme: str) -> DataFrame:
    """The artifacts of each case in order: its README and prompt, then what it declares, each path once: inputs, previews, outputs.

    cases: case_id, case_path (its folder), prompt (a file in it), run_date; declared: case_id, role, ordinal, path (in the folder), bytes,
    sha256 (recorded or null); files: path, canonical_bytes, sha256 (of file_stats()) and content. Gives case_id, ordinal (from 0), artifact_id, role
    (provenance where the path says so), media_type, source (a note where the record is stale), generated_at (the run date of results),
    path, resource_uri (an SVG as a data URI, another preview by `scheme`), bytes, sha256 (where one was recorded). A declared file that
    is not there is left out, as missing_recipe_files() tells it."""
    order = F.array_position(F.array(*map(F.lit, ROLE_ORDER)), F.col("role"))
    listed = dedupe_keep_first(declared, ["case_id", "path"], order, F.col("ordinal")).withColumn("at", F.struct(order.cast("int").alias("role"), F.col("ordinal").cast("int").alias("n")))
    first = F.array(*(F.struct(f.alias("path"), F.struct(F.lit(0).alias("role"), F.lit(n).alias("n")).alias("at")) for n, f in enumerate((F.lit("README.md"), F.col("prompt")))))
    heads = cases.select("case_id", F.inline(first)).select("case_id", F.lit("input").alias("role"), "path", F.lit(None).cast("long").alias("bytes"), F.lit(None).cast("string").alias("sha256"), "at", F.lit(True).alias("head"))
    rows = heads.unionByName(listed.select("case_id", "role", "path", "bytes", "sha256", "at", F.lit(False).alias("head"))).join(cases.select("case_id", "case_path", "run_date"), "case_id")
    full = F.concat_ws("/", "case_path", "path")
    rows = rows.withColumns({"short": F.col("path"), "path": full}).join(files.select("path", "content", "canonical_bytes", F.col("sha256").alias("actual_sha")), "path")
    media, final = tx.media_type(F.col("path")), F.when(F.col("head"), F.col("role")).otherwise(tx.final_role(F.col("short"), F.col("role")))
    differs = F.coalesce(F.col("bytes") != F.col("canonical_bytes"), F.lit(False)) | F.coalesce(F.col("sha256") != F.col("actual_sha"), F.lit(False))
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unspecified"))
    note = F.concat(F.lit("Pinned file identity supersedes stale source-manifest metadata (recorded bytes="), said("bytes"), F.lit(", sha256="), said("sha256"), F.lit(")."))
    text = F.replace(F.make_valid_utf8(F.col("content").cast("binary").cast("string")), F.lit("\r\n"), F.lit("\n"))
    uri = F.when(media == "image/svg+xml", F.concat(F.lit("data:image/svg+xml;base64,"), F.translate(F.base64(text.cast("binary")), "\r\n", ""))).when(F.col("role") == "preview", F.concat(F.lit(scheme), "path"))
    number = F.row_number().over(Window.partitionBy("case_id").orderBy("at")) - 1
    return rows.select(
        "case_id",
        number.alias("ordinal"),
        F.concat_ws(":", F.when(F.col("head"), F.col("case_id").cast("string")).otherwise(F.substring_index("case_path", "/", -1)), "short").alias("artifact_id"),
        final.alias("role"),
        media.alias("media_type"),
        F.when(differs, note).alias("source"),
        F.when(final.isin(*RESULT_ROLES), F.col("run_date")).alias("generated_at"),
        "path",
        F.when(~F.col("head"), uri).alias("resource_uri"),
        F.col("canonical_bytes").alias("bytes"),
        F.when(F.col("sha256").isNotNull(), F.col("actual_sha")).alias("sha256"),
    )


def case_index(cases: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Per case its readme, prompt and the paths of its artifacts, in order."""
    fixed = cases.select(
        "case_id",
        F.explode(F.array(
            F.struct(F.lit(0).alias("n"), F.col("readme").alias("path")),
            F.struct(F.lit(1).alias("n"), F.col("prompt").alias("path")),
        )).alias("x"),
    )
    own = artifacts.where("path IS NOT NULL").select("case_id", F.struct((F.col("ordinal") + 2).cast("int").alias("n"), "path").alias("x"))
    return fixed.unionByName(own).where("x.path IS NOT NULL").groupBy("case_id").agg(F.transform(
        F.array_sort(F.collect_list("x")),
        lambda x: x["path"],
    ).alias("paths"))


#: How much wider the bins of a level are than those of the level before.
WIDER = 8


def features_in_region(features: DataFrame, regions: DataFrame, bin_size: int) -> DataFrame:
    """Features (accession, start, end) that overlap regions (accession, region_start, region_end), ends included.

    An interval's level is the first whose bins are as long as it is, so it lies in two bins there, and in two of each level
    above. A pair meets at the higher of its two levels, in the first bin that both share; however long an interval is, it is
    copied at most twice per level that occurs. The levels that occur, some 20 at most, are sent to all tasks."""

    def leveled(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
        length = (F.col(b) - F.col(a) + 1) / bin_size
        return df.where(F.col(b) >= F.col(a)).withColumn(name, F.greatest(F.lit(0), F.ceil(F.log(float(WIDER), length) - 1e-9)).cast("int"))

    f, r = leveled(features, "start", "end", "_own"), leveled(regions, "region_start", "region_end", "_other")
    levels = F.broadcast(f.select(F.col("_own").alias("_level")).union(r.select("_other")).distinct())
    size = lambda level: F.lit(float(bin_size)) * F.pow(F.lit(float(WIDER)), level)

    def dealt(df: DataFrame, a: str, b: str, own: str) -> DataFrame:
        rows = df.join(levels, F.col("_level") >= F.col(own))
        bins = F.sequence(F.floor(F.col(a) / size(F.col("_level"))), F.floor(F.col(b) / size(F.col("_level"))))
        return rows.withColumn("_bin", F.explode(bins))

    both = dealt(f, "start", "end", "_own").join(dealt(r, "region_start", "region_end", "_other"), ["accession", "_level", "_bin"])
    meet = (F.col("_level") == F.greatest("_own", "_other")) & (F.col("_bin") == F.floor(F.greatest("start", "region_start") / size(F.col("_level"))))
    return both.where(meet & (F.col("start") <= F.col("region_end")) & (F.col("end") >= F.col("region_start"))).drop("_own", "_other", "_level", "_bin")
