"""Catalogue and text queries on `documents`, `pages`, `conversations`, `part`, `nation` and `orders`."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.functions import text as tx
from evidentia.operators import catalogue as ca
from evidentia.operators import checks as ck


def t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def search(s, d):
    c = t(s, d, "documents").select(
        "doc_id",
        F.col("lang").alias("category"),
        F.lower("text").alias("search_text"),
        F.lit("ready").alias("status"),
        (F.col("n_chars") > 100).alias("runnable"),
    )
    return ca.catalogue_search(c, "  The TH", "en", True).select("doc_id")


def get(s, d):
    p = t(s, d, "part").select(F.col("p_partkey").alias("id"), "p_name")
    ids = t(s, d, "lineitem").select((F.col("l_partkey") * 2).alias("id")).distinct()
    found, unknown = ca.catalogue_get(p, ids)
    return found.select("id", F.lit("found").alias("state")).unionByName(unknown.select("id", F.lit("unknown").alias("state")))


def opened(s, d):
    n = F.col("doc_id")
    path = F.when(
        n % 13 != 0,
        F.concat(F.lit("dir.md/"), n.cast("string"), F.element_at(F.array(*map(F.lit, (".md", ".bin", ".PDB", "", ".png"))), (n % 5 + 1).cast("int"))),
    )
    media = F.element_at(F.array(*map(F.lit, ("text/plain", "image/png", "chemical/x-mmcif", "application/octet-stream"))), (n % 4 + 1).cast("int"))
    f = t(s, d, "documents").select("doc_id", path.alias("path"), media.alias("media_type"), F.col("text").alias("content"))
    return ca.open_bounded(f.drop("doc_id"), 4096).select("path", "bytes", F.octet_length("content").cast("long").alias("opened"), "truncated", "note")


def path_column():
    return F.regexp_extract("url", r"^\w+://[^/]*(.*)$", 1)


def escapes(s, d):
    p = t(s, d, "pages").select(
        "page_id",
        F.when(
            F.col("page_id") % 3 == 0,
            F.concat(F.lit("a/../.."), path_column()),
        ).when(F.col("page_id") % 3 == 1, path_column()).otherwise(F.substring(path_column(), F.lit(2), F.length("url"))).alias("path"),
    )
    return p.select("page_id", tx.path_problem(F.col("path")).alias("problem"))


def regions(s, d):
    o = t(s, d, "orders").select(
        (F.col("o_custkey") % 10).alias("accession"),
        "o_orderkey",
        F.datediff("o_orderdate", F.lit("1990-01-01").cast("date")).alias("start"),
    )
    f = o.withColumn("end", F.col("start") + F.col("o_orderkey") % 7)
    r = s.range(10).select(F.col("id").alias("accession"), F.explode(F.array(*(F.lit(x) for x in (1500, 2500, 3500)))).alias("region_start"))
    r = r.withColumn("region_end", F.col("region_start") + 30)
    return ca.features_in_region(f, r, 64).select("accession", "region_start", "o_orderkey")


def claims_input(s, d):
    return t(s, d, "documents").select(
        F.col("doc_id").alias("case_id"),
        F.lit("observation").alias("kind"),
        F.posexplode(F.split("text", "\n")).alias("ordinal", "statement"),
    )


def sections(s, d):
    lines = F.split("text", "\n")
    return t(s, d, "documents").select(
        "doc_id",
        F.array_join(F.transform(lines, lambda x, i: F.concat(F.lit("##  H"), (i % 3).cast("string"), F.lit(" \n"), x)), "\n").alias("text"),
    )


def sectioned(s, d):
    return ca.markdown_sections(sections(s, d))


MARKED = "- **x** `y` [z](u) ![a](b)\n  - indented\n![only](image) \n* star\n"


def case_rows(s, d):
    """Documents as cases: lines are sections in turn; a third of the cases has other headings, half have observations."""
    docs, n = t(s, d, "documents"), F.col("doc_id")
    heads = F.array(*(F.when(n % 3 == 0, F.lit(o)).otherwise(F.lit(h)) for o, h in (("Other", "Source observations"), ("Else", "Computed results"), ("Interpretation", "Interpretation"), ("Limitation", "Limitations"))))
    text = F.array_join(
        F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.lit("## "), F.element_at(heads, (i % 4 + 1).cast("int")), F.lit("\n"), x)),
        "\n",
    )
    own = F.when(n % 2 == 0, F.array(F.concat(F.lit(" "), F.substring_index("text", "\n", 1)), F.lit("Fixed. "), F.lit("")))
    limits = F.when(n % 5 == 0, F.array(F.lit("One."), F.lit("Two."), F.lit(" One.")))
    none = F.lit(None).cast("array<string>")
    cases = docs.select(
        n.alias("case_id"),
        F.col("source").alias("summary"),
        own.alias("observations"),
        none.alias("interpretation"),
        limits.alias("limitations"),
    )
    return ca.case_statements(cases, ca.markdown_sections(docs.select("doc_id", text.alias("text"))))


def claims(s, d):
    roles = F.array(*map(F.lit, ("preview", "input", "output", "provenance", "log")))
    n = F.col("doc_id")
    artifacts = t(s, d, "documents").select(n.alias("case_id"), F.posexplode(F.slice(roles, F.lit(1), (n % 6).cast("int"))).alias("ordinal", "role"))
    artifacts = artifacts.withColumn("artifact_id", F.concat_ws(":", "case_id", "role"))
    out = ca.build_claims(case_rows(s, d), artifacts)
    return out.select("case_id", "claim_id", "kind", F.sha2("statement", 256).alias("statement"), F.array_join("artifact_ids", ",").alias("artifact_ids"))


def search_texts(s, d):
    docs = t(s, d, "documents")
    cases = docs.select(
        "doc_id",
        F.col("source").alias("title"),
        F.col("text").alias("summary"),
        F.concat(F.lit(" "), "source").alias("question"),
        F.col("lang").alias("category"),
        F.lit("Plugin").alias("plugin_name"),
        F.array("source", F.lit("HTTP://x"), F.lit("")).alias("sources"),
    )
    return ca.search_text(cases).select("doc_id", F.sha2("search_text", 256).alias("search_text"))


ENDINGS = (".html", ".JSON", ".aln-fasta", ".tar.csv", ".gb", "", ".Png", ".geojson", "/.md", ".cif", ".html.nwk")


def paths():
    """The urls of pages with other endings."""
    end = F.element_at(F.array(*map(F.lit, ENDINGS)), (F.col("page_id") % len(ENDINGS) + 1).cast("int"))
    return F.concat(F.regexp_replace("url", r"(\.html)?/?([?#].*)?$", ""), F.lit("/f"), end)


def validated(s, d):
    """Pages as files of each type, right and wrong in turn."""
    n = F.col("page_id")
    kinds = {
        "image/svg+xml": (F.concat(F.lit("<svg w>"), "html", F.lit("</svg>")), F.concat(F.lit("<svgx>"), "html", F.lit("</svg>"))),
        "chemical/x-mmcif": (F.concat(F.lit("data_x\n_atom_site.id\n"), "html"), F.concat(F.lit(" data_x\n_atom_site.id\n"), "html")),
        "text/x-genbank": (
            F.concat(F.lit("LOCUS x\n"), "html", F.lit("\nORIGIN \n1 acg\n//\n")),
            F.concat(F.lit("LOCUS x\n"), "html", F.lit("\nORIGIN\n1 acg\n")),
        ),
        "text/x-newick": (F.lit(" ((a,b),c); "), F.lit("(a))(;")),
        "text/x-fasta": (F.lit(">a b\nAC-*\n\nGT\n>c\nA?.\n"), F.lit(">a\n>b\nAC\n")),
        "text/csv": (F.lit('a,b\n1,"x,""\ny"\n'), F.lit("a,b\n1\n")),
        "text/markdown": (F.col("html"), F.lit(" \n")),
        "chemical/x-pdb": (F.concat("html", F.lit("\nHETATM")), F.concat("html", F.lit("\nATOM x"))),
    }
    media = F.element_at(F.array(*map(F.lit, kinds)), (n % len(kinds) + 1).cast("int"))
    content = F.lit(None).cast("string")
    for kind, (right, wrong) in kinds.items():
        content = F.when(media == kind, F.when(F.floor(n / len(kinds)) % 2 == 0, right).otherwise(wrong)).otherwise(content)
    return t(s, d, "pages").select("page_id", tx.content_ok(media, content).alias("ok"))


def hashed(df, *columns):
    return df.withColumns({c: F.sha2(c, 256) for c in columns})


def recipe_rows(s, d):
    """Conversations as cases of a category by their number, with turns as artifacts; rules by region; every tenth case has its own."""
    c, n = t(s, d, "conversations"), F.col("conv_id")
    category = F.element_at(F.array(*map(F.lit, ("sequence", "ngs", "literature", "workbench", "slide"))), F.col("k"))
    cases = c.select(n.alias("case_id"), (n % 5 + 1).cast("int").alias("k")).distinct().select("case_id", category.alias("category"))
    role = F.when(F.col("role") == "user", "input").when(F.col("role") == "assistant", "output").otherwise("provenance")
    artifacts = c.select(n.alias("case_id"), F.col("turn").alias("ordinal"), role.alias("role"), F.when(F.col("turn") != 3, F.concat_ws("/", n, "turn")).alias("path"))
    rules = t(s, d, "region").where("r_regionkey < 4").select((F.col("r_regionkey") + 1).cast("int").alias("k"), F.col("r_name").alias("adapter"), F.array("r_name", F.lit("local")).alias("provider_ids"))
    own = cases.where("case_id % 10 = 0").select("case_id", F.lit(None).cast("string").alias("adapter"), F.array(F.lit("own")).alias("provider_ids"), F.lit("conditional").alias("strategy"))
    out = ca.recipes(cases, artifacts, rules.select(category.alias("category"), "adapter", "provider_ids"), own)
    return out.withColumns({x: F.array_join(x, ",") for x in ("provider_ids", "required_inputs", "expected_outputs")})


def artifact_table(s, d):
    """Documents as the files of fifty cases; sizes are recorded in characters, so many are stale. The document of a case's own number is
    its prompt, and declared as well."""
    n = F.col("doc_id")
    name = F.concat(n.cast("string"), F.when(n % 4 == 1, ".svg").when(n % 4 == 2, ".provenance.json").otherwise(".md"))
    docs = t(s, d, "documents").where("text IS NOT NULL").select("*", (n % 50).alias("case_id"), name.alias("name"))
    cases = docs.where("doc_id < 50").select("case_id", F.concat(F.lit("cases/c"), "case_id").alias("case_path"), F.col("name").alias("prompt"), F.lit("2024-05-01").alias("run_date"))
    path = lambda file: F.concat(F.lit("cases/c"), "case_id", F.lit("/"), file)
    files = docs.select(path(F.col("name")).alias("path"), F.col("text").alias("content")).unionByName(cases.select(path(F.lit("README.md")).alias("path"), F.concat(F.lit("# case "), "case_id").alias("content")))
    stats = ck.file_stats(files.withColumn("media_type", tx.media_type(F.col("path"))), "content")
    role = F.element_at(F.array(*map(F.lit, ca.ROLE_ORDER)), (n % 3 + 1).cast("int"))
    declared = docs.select("case_id", role.alias("role"), n.alias("ordinal"), F.col("name").alias("path"), F.when(n % 6 != 5, F.col("n_chars")).alias("bytes"), F.when(n % 5 == 0, "old").when(n % 5 == 1, F.sha2("text", 256)).alias("sha256"))
    out = ca.artifact_rows(cases, declared, stats, "store://")
    return out.withColumns({"resource_uri": F.sha2("resource_uri", 256), "ordinal": F.col("ordinal").cast("long")})


QUERIES = {
    "e1_recipes": recipe_rows,
    "e1_artifact_rows": artifact_table,
    "f1_catalogue_search": search,
    "f2_catalogue_get": get,
    "f3_artifacts_by_role": lambda s, d: ca.artifacts_by_role(t(s, d, "conversations")),
    "f4_open_bounded": opened,
    "f5_path_escape": escapes,
    "f6_features_in_region": regions,
    "f9_citation_check": lambda s, d: t(s, d, "pages").select("page_id", F.col("url").rlike("^https?://").alias("is_citation")),
    "f10_validate_contents": validated,
    "f10_validate_html": lambda s, d: t(s, d, "pages").select("page_id", tx.content_ok(F.lit("text/html"), F.col("html")).alias("ok")),
    "f10_validate_json": lambda s, d: t(s, d, "events").select(
        "event_id",
        tx.content_ok(F.lit("application/json"), F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("{"), "props")).otherwise(F.col("props"))).alias("ok"),
    ),
    "j5_with_category": lambda s, d: ca.with_category(
        t(s, d, "nation"),
        t(s, d, "region").where("r_regionkey <> 2").withColumnRenamed("r_regionkey", "n_regionkey"),
        "n_regionkey",
    )[0].select("n_nationkey", "r_name"),
    "j15_case_index": lambda s, d: ca.case_index(
        t(s, d, "conversations").select(F.col("conv_id").alias("case_id")).distinct().select(
            "case_id",
            F.concat(F.lit("README-"), "case_id").alias("readme"),
            F.lit("prompt").alias("prompt"),
        ),
        t(s, d, "conversations").select(F.col("conv_id").alias("case_id"), F.col("turn").alias("ordinal"), F.col("role").alias("path")),
    ).withColumn("paths", F.array_join("paths", ",")),
    "w5_dedupe_keep_first": lambda s, d: ca.dedupe_keep_first(
        t(s, d, "documents"),
        ["text"],
        F.when(F.col("lang") == "en", 0).otherwise(1),
        F.col("doc_id"),
    ).select("doc_id"),
    "w6_number_claims": lambda s, d: ca.number_claims(t(s, d, "conversations").select(F.col("conv_id").alias("case_id"), F.col("role").alias("kind"), F.col("turn").alias("ordinal"))).select(
        "case_id",
        "ordinal",
        "claim_id",
    ),
    "u1_unique_statements": lambda s, d: hashed(
        ca.unique_statements(claims_input(s, d)).select("case_id", "statement", F.col("ordinal").cast("long").alias("ordinal")),
        "statement",
    ),
    "u2_statements_not_in_section": lambda s, d: ca.statements_not_in_section(
        t(s, d, "benchmark").select((F.col("item_id") % 20).alias("case_id"), "item_id", F.col("text").alias("statement")),
        t(s, d, "documents").select((F.col("doc_id") % 20).alias("case_id"), "doc_id", F.col("text").alias("section_text")),
    ).groupBy("item_id").agg(F.count("*").alias("missing")),
    "t1_markdown_sections": lambda s, d: hashed(sectioned(s, d), "body"),
    "t2_clean_markdown": lambda s, d: t(s, d, "documents").select("doc_id", F.sha2(tx.clean_markdown(F.concat(F.lit(MARKED), "text")), 256).alias("cleaned")),
    "t3_split_statements": lambda s, d: t(s, d, "documents").select(
        "doc_id",
        F.sha2(F.array_join(tx.split_statements(F.concat(F.lit("One * two. 3 is\n- four -five"), "text")), "|"), 256).alias("statements"),
    ),
    "t4_first_section": lambda s, d: hashed(ca.first_section(sectioned(s, d), ["h2", "h0"]), "body"),
    "t5_build_claims": claims,
    "t5_search_text": search_texts,
    "t10_numbers_from_text": lambda s, d: t(s, d, "documents").select(
        "doc_id",
        tx.number_in(F.concat("text", F.when(F.col("doc_id") % 2 == 0, "12345678901234").otherwise("")), r"([0-9]+)").alias("number"),
    ),
    "t11_media_type": lambda s, d: t(s, d, "pages").select(
        "page_id",
        tx.media_type(paths()).alias("media_type"),
        tx.final_role(F.concat(paths(), F.when(F.col("page_id") % 3 == 0, ".Provenance.json").otherwise("")), F.lit("output")).alias("role"),
    ),
    "a1_count_by_media_type": lambda s, d: t(s, d, "pages").groupBy(tx.media_type(paths()).alias("media_type")).agg(F.count("*").alias("files")),
}

# The SQL below states the rules anew, in the patterns of RE2.
MEDIA = """CASE page_id % 11 WHEN 1 THEN 'application/json' WHEN 2 THEN 'text/x-fasta' WHEN 3 THEN 'text/csv' WHEN 4 THEN 'text/x-genbank' WHEN 6 THEN 'image/png'
  WHEN 7 THEN 'application/geo+json' WHEN 9 THEN 'chemical/x-mmcif' WHEN 10 THEN 'text/x-newick' ELSE 'application/octet-stream' END"""
PATH = "regexp_extract(url, '^\\w+://[^/]*(.*)$', 1)"


def cleaned(x: str) -> str:
    for pattern, to in (
        ("(?m)^!\\[[^\\]]*\\]\\([^)]*\\)\\s*$", ""),
        ("(?m)^[-*]\\s+", ""),
        ("`([^`]+)`", "\\1"),
        ("\\[([^\\]]+)\\]\\([^)]+\\)", "\\1"),
        ("\\*\\*([^*]+)\\*\\*", "\\1"),
        ("\\s+", " "),
    ):
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return f"trim({x})"


def statements(x: str) -> str:
    cut = f"regexp_replace(regexp_replace({x}, '(\\.)\\s+([A-Z0-9`])', '\\1' || chr(1) || '\\2', 'g'), '\\s+[-*]\\s+', chr(1), 'g')"
    return f"list_filter(list_transform(string_split({cut}, chr(1)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"


def once(x: str) -> str:
    """Each entry of a list once, in order of first appearance, trimmed and not empty."""
    trimmed = f"list_filter(list_transform({x}, lambda x: trim(x)), lambda x: x <> '')"
    return f"list_filter({trimmed}, lambda x, i: list_position({trimmed}, x) = i)"


SECTIONS = f"""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS x FROM documents),
m AS (SELECT doc_id, 'h' || ((i - 1) % 3) AS heading, {cleaned("arg_max(x, i)")} AS body FROM l GROUP BY ALL)"""
MARKED_SQL = "'- **x** `y` [z](u) ![a](b)' || chr(10) || '  - indented' || chr(10) || '![only](image) ' || chr(10) || '* star' || chr(10) || text"
CLAIMS = f"""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS x FROM documents),
b AS (SELECT doc_id, (i - 1) % 4 AS k, {cleaned("arg_max(x, i)")} AS body FROM l GROUP BY ALL),
c AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE coalesce(max(body) FILTER (WHERE k = 0), '') END AS src, CASE WHEN doc_id % 3 = 0 THEN '' ELSE coalesce(max(body) FILTER (WHERE k = 1), '') END AS com,
  coalesce(max(body) FILTER (WHERE k = 2), '') AS inter FROM b GROUP BY doc_id),
d AS (SELECT c.*, CASE WHEN doc_id % 2 = 0 THEN [' ' || string_split(text, chr(10))[1], 'Fixed. ', ''] ELSE [] END AS own FROM c JOIN documents USING (doc_id)),
e AS (SELECT doc_id, CASE WHEN src = '' AND com = '' THEN own ELSE {statements("src")} END AS observation,
  list_concat({statements("com")}, CASE WHEN src = '' THEN [] ELSE list_filter(own, lambda o: NOT contains(src, {cleaned("o")})) END) AS computed, {statements("inter")} AS interpretation FROM d),
f AS (SELECT doc_id, 'observation' AS kind, {once("observation")} AS s FROM e UNION ALL SELECT doc_id, 'computed', {once("computed")} FROM e UNION ALL SELECT doc_id, 'interpretation', {once("interpretation")} FROM e),
g AS (SELECT doc_id, kind, generate_subscripts(s, 1) AS number, unnest(s) AS statement FROM f)
SELECT doc_id AS case_id, doc_id || ':' || kind || ':' || number AS claim_id, kind, sha256(statement) AS statement,
  array_to_string(list_transform(list_filter((['preview', 'input', 'output', 'provenance', 'log'])[1:doc_id % 6], lambda r: list_contains(CASE WHEN kind = 'observation' THEN ['input', 'provenance'] ELSE ['output', 'preview', 'provenance'] END, r)), lambda r: doc_id || ':' || r), ',') AS artifact_ids FROM g"""

SQL = {
    "f1_catalogue_search": "SELECT doc_id FROM documents WHERE lang = 'en' AND n_chars > 100 AND contains(lower(text), 'the th')",
    "f2_catalogue_get": """WITH i AS (SELECT DISTINCT l_partkey * 2 AS id
FROM lineitem) SELECT id, CASE WHEN p_partkey IS NULL THEN 'unknown' ELSE 'found' END AS state
FROM i
LEFT JOIN part ON p_partkey = id""",
    "f3_artifacts_by_role": "SELECT role, count(*) AS artifacts FROM conversations GROUP BY role",
    "f4_open_bounded": """WITH f AS (SELECT CASE WHEN doc_id % 13 <> 0 THEN 'dir.md/' || doc_id || (['.md', '.bin', '.PDB', '', '.png'])[doc_id % 5 + 1] END AS path, strlen(text) AS n, doc_id % 4 IN (0, 2) OR doc_id % 5 IN (0, 2) AS plain FROM documents)
SELECT path, CASE WHEN path IS NOT NULL THEN n END AS bytes, CASE WHEN path IS NOT NULL AND plain AND n <= 4096 THEN n END AS opened, CASE WHEN path IS NOT NULL THEN n > 4096 END AS truncated,
CASE WHEN path IS NULL THEN 'This artifact is represented by a resource reference.' WHEN NOT plain THEN 'Binary artifact; use the scientific viewer or package file.' WHEN n > 4096 THEN 'Text exceeds the 4096-byte display limit.' END AS note FROM f""",
    "f5_path_escape": f"""SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'escaping' WHEN 1 THEN CASE WHEN trim({PATH}) = '' THEN 'blank' ELSE 'absolute' END ELSE CASE WHEN length(trim({PATH})) < 2 THEN 'blank' END END AS problem
FROM pages""",
    "f6_features_in_region": """WITH f AS (SELECT o_custkey % 10 AS accession, o_orderkey, (o_orderdate::DATE - DATE '1990-01-01')::BIGINT AS s FROM orders), r AS (SELECT unnest([1500, 2500, 3500])::INTEGER AS region_start)
SELECT accession, region_start, o_orderkey FROM f, r WHERE s <= region_start + 30 AND s + o_orderkey % 7 >= region_start""",
    "f9_citation_check": "SELECT page_id, regexp_matches(url, '^https?://') AS is_citation FROM pages",
    "f10_validate_contents": """SELECT page_id, CASE WHEN (page_id // 8) % 2 = 1 THEN false WHEN page_id % 8 = 6 THEN html IS NOT NULL AND trim(html) <> '' ELSE page_id % 8 IN (3, 4, 5) OR html IS NOT NULL END AS ok FROM pages""",
    "f10_validate_html": "SELECT page_id, coalesce(regexp_matches(html, '(?i)^<!doctype html') AND contains(html, '</html>'), false) AS ok FROM pages",
    "f10_validate_json": "SELECT event_id, coalesce(json_valid(CASE WHEN event_id % 5 = 0 THEN '{' || props ELSE props END), false) AS ok FROM events",
    "j5_with_category": "SELECT n_nationkey, r_name FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_regionkey <> 2",
    "j15_case_index": "SELECT conv_id AS case_id, 'README-' || conv_id || ',prompt,' || string_agg(role, ',' ORDER BY turn, role) AS paths FROM conversations GROUP BY conv_id",
    "w5_dedupe_keep_first": "SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY CASE WHEN lang = 'en' THEN 0 ELSE 1 END, doc_id) = 1",
    "w6_number_claims": """SELECT conv_id AS case_id, turn AS ordinal, conv_id || ':' || role || ':' || row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS claim_id
FROM conversations""",
    "u1_unique_statements": """WITH l AS (SELECT doc_id AS case_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ordinal, trim(unnest(string_split(text, chr(10)))) AS s
FROM documents) SELECT case_id, sha256(s) AS statement, min(ordinal) AS ordinal
FROM l
WHERE s <> ''
GROUP BY case_id, s""",
    "u2_statements_not_in_section": """SELECT item_id, count(*) AS missing
FROM benchmark b JOIN documents d ON item_id % 20 = doc_id % 20 AND NOT contains(d.text, trim(regexp_replace(b.text, '[ \\t\\r\\n]+', ' ', 'g')))
GROUP BY item_id""",
    "t1_markdown_sections": f"{SECTIONS} SELECT doc_id, heading, sha256(body) AS body FROM m",
    "t2_clean_markdown": f"SELECT doc_id, sha256({cleaned(MARKED_SQL)}) AS cleaned FROM documents",
    "t3_split_statements": f"""SELECT doc_id, sha256(array_to_string({statements("'One * two. 3 is' || chr(10) || '- four -five' || text")}, '|')) AS statements FROM documents""",
    "t5_build_claims": CLAIMS,
    "t5_search_text": f"""SELECT doc_id, sha256(lower(array_to_string({once("[coalesce(source, ''), coalesce(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), ''), coalesce(' ' || source, ''), coalesce(lang, ''), 'Plugin', coalesce(source, ''), 'HTTP://x']")}, ' '))) AS search_text FROM documents""",
    "t4_first_section": f"""{SECTIONS} SELECT doc_id, arg_min(heading, CASE heading WHEN 'h2' THEN 0 ELSE 1 END) AS heading, sha256(arg_min(body, CASE heading WHEN 'h2' THEN 0 ELSE 1 END)) AS body
FROM m
WHERE heading IN ('h2', 'h0') AND body <> ''
GROUP BY doc_id""",
    "t10_numbers_from_text": """SELECT doc_id, try_cast(nullif(regexp_extract(text || CASE WHEN doc_id % 2 = 0 THEN '12345678901234' ELSE '' END, '([0-9]+)', 1), '') AS DOUBLE) AS number
FROM documents""",
    "t11_media_type": f"SELECT page_id, {MEDIA} AS media_type, CASE WHEN page_id % 3 = 0 THEN 'provenance' ELSE 'output' END AS role FROM pages",
    "a1_count_by_media_type": f"SELECT {MEDIA} AS media_type, count(*) AS files FROM pages GROUP BY 1",
}

SQL["e1_recipes"] = """WITH c AS (SELECT DISTINCT conv_id AS case_id, ['sequence', 'ngs', 'literature', 'workbench', 'slide'][(conv_id % 5 + 1)::INTEGER] AS category FROM conversations),
a AS (SELECT conv_id AS case_id, string_agg(conv_id || '/' || turn, ',' ORDER BY turn, conv_id || '/' || turn) FILTER (WHERE role = 'user' AND turn <> 3) AS i,
  string_agg(conv_id || '/' || turn, ',' ORDER BY turn, conv_id || '/' || turn) FILTER (WHERE (role IS NULL OR role <> 'user') AND turn <> 3) AS o FROM conversations GROUP BY 1)
SELECT case_id, r_name AS adapter, CASE WHEN case_id % 10 = 0 THEN 'own' ELSE r_name || ',local' END AS provider_ids,
  CASE WHEN case_id % 10 = 0 THEN 'conditional' ELSE ['local', 'conditional', 'network', 'local', 'conditional'][(case_id % 5 + 1)::INTEGER] END AS strategy,
  coalesce(i, '') AS required_inputs, coalesce(o, '') AS expected_outputs FROM c JOIN a USING (case_id) LEFT JOIN region ON r_regionkey = case_id % 5 AND r_regionkey < 4"""
SQL["e1_artifact_rows"] = """WITH f AS (SELECT *, doc_id % 50 AS case_id, doc_id || CASE doc_id % 4 WHEN 1 THEN '.svg' WHEN 2 THEN '.provenance.json' ELSE '.md' END AS name FROM documents WHERE text IS NOT NULL),
c AS (SELECT case_id, name AS prompt, text FROM f WHERE doc_id < 50),
u AS (SELECT case_id, -2 AS k, 0 AS doc_id, 'README.md' AS name, '# case ' || case_id AS text, 'input' AS role, NULL AS bytes, NULL AS sha FROM c
  UNION ALL SELECT case_id, -1, 0, prompt, text, 'input', NULL, NULL FROM c
  UNION ALL SELECT f.case_id, doc_id % 3, doc_id, name, f.text, ['input', 'preview', 'output'][(doc_id % 3 + 1)::INTEGER], CASE WHEN doc_id % 6 <> 5 THEN n_chars END, CASE doc_id % 5 WHEN 0 THEN 'old' WHEN 1 THEN sha256(f.text) END FROM f JOIN c USING (case_id)),
w AS (SELECT *, CASE WHEN k >= 0 AND name LIKE '%provenance%' THEN 'provenance' ELSE role END AS final FROM u)
SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY k, doc_id) - 1 AS ordinal, CASE WHEN k < 0 THEN '' ELSE 'c' END || case_id || ':' || name AS artifact_id, final AS role,
  CASE WHEN name LIKE '%.svg' THEN 'image/svg+xml' WHEN name LIKE '%.json' THEN 'application/json' ELSE 'text/markdown' END AS media_type,
  CASE WHEN bytes <> strlen(text) OR sha <> sha256(text) THEN 'Pinned file identity supersedes stale source-manifest metadata (recorded bytes=' || coalesce(bytes::VARCHAR, 'unspecified') || ', sha256=' || coalesce(sha, 'unspecified') || ').' END AS source,
  CASE WHEN final <> 'input' THEN '2024-05-01' END AS generated_at, 'cases/c' || case_id || '/' || name AS path,
  CASE WHEN k < 0 THEN NULL WHEN name LIKE '%.svg' THEN sha256('data:image/svg+xml;base64,' || base64(encode(text))) WHEN role = 'preview' THEN sha256('store://cases/c' || case_id || '/' || name) END AS resource_uri,
  strlen(text) AS bytes, CASE WHEN sha IS NOT NULL THEN sha256(text) END AS sha256 FROM w"""
