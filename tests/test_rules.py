"""The rules of the catalogue, checks and runs on literal cases, right and wrong."""

import datetime
import time

import pytest
from pyspark.sql import functions as F

from evidentia.functions import text as tx
from evidentia.operators import catalogue as ca
from evidentia.operators import checks as ck
from evidentia.operators import evidence as ev
from evidentia.operators import packed
from evidentia.operators import runs
from evidentia.operators import sequence as sq
from evidentia.plans import runs as plan
from evidentia.plans import sequence as sequence_plans
from evidentia.streaming import run_streams as st
from evidentia.streaming.snapshot import Snapshot


def mapped(spark, values, f, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}").select("i", f(F.col("v")).alias("out"))
    return [r["out"] for r in rows.orderBy("i").collect()]


STATES = list(runs.TRANSITIONS)
LEGAL = {
    ("draft", "awaiting_confirmation"), ("draft", "queued"), ("draft", "cancelled"), ("awaiting_confirmation", "queued"), (
        "awaiting_confirmation",
        "cancelled",
    ),
    ("queued", "running"), ("queued", "cancelled"), ("queued", "failed"), (
        "running",
        "completed",
    ), ("running", "failed"), ("running", "cancelled"), ("running", "running"),
}


def pair_events(spark):
    """One run per pair of states: draft stands before the pair unless the pair opens with it."""
    rows = []
    for k, (a, b) in enumerate((a, b) for a in STATES for b in STATES):
        rows += [(k, datetime.datetime(2024, 1, 1, 0, n), n, s) for n, s in enumerate((a, b))]
    return spark.createDataFrame(rows, "run_id long, at timestamp, seq long, state string")


def test_every_legal_and_illegal_step(spark):
    got = {(r["previous"], r["state"]): r["allowed"] for r in runs.run_event_audit(pair_events(spark)).collect()}
    assert {p for p, ok in got.items() if ok and p[0]} == LEGAL
    assert {p[1] for p, ok in got.items() if p[0] is None and ok} == {"draft"} and len(got) == 7 * 7 + 7
    assert set(runs.TERMINAL) == {"completed", "failed", "cancelled"}


def test_stream_audit_over_several_batches(spark, tmp_path):
    """The state before the first event of a batch comes from the batch before, however late it comes within the time to live."""
    at = lambda d, h: datetime.datetime(2024, 5, d, h)
    batches = [
        [(1, at(1, 10), 1, "draft"), (1, at(1, 11), 2, "queued"), (2, at(1, 10), 3, "draft")],
        [(1, at(1, 12), 4, "running"), (2, at(1, 13), 5, "completed"), (3, at(1, 12), 6, "queued")],
        [(1, at(1, 14), 7, "completed"), (1, at(1, 15), 8, "running"), (2, at(1, 14), 9, "failed")],
        [(9, at(20, 0), 10, "draft")],
        [(9, at(20, 1), 11, "queued")],
        [(1, at(20, 2), 12, "draft")],
    ]
    schema = "run_id long, at timestamp, seq long, state string"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    out = st.drained(st.stream_run_audit(st.read_stream(spark, f"{tmp_path}/in/*", schema)), str(tmp_path / "audit"), idle_batches=False)
    got = {r["seq"]: (r["previous"], r["allowed"]) for r in spark.read.parquet(out).collect()}
    assert got == {
        1: (None, True),
        2: ("draft", True),
        3: (None, True),
        4: ("queued", True),
        5: ("draft", False),
        6: (None, False),
        7: ("running", True),
        8: ("completed", False),
        9: ("completed", False),
        10: (None, True),
        11: ("draft", True),
        12: ("running", False),
    }
    table = Snapshot(spark, f"{tmp_path}/table", "run_id long, at timestamp, seq long, state string, events long", "run_id")
    st.stream_run_status(st.read_stream(spark, f"{tmp_path}/in/*", schema), table, f"{tmp_path}/status").awaitTermination()
    assert {(r["run_id"], r["seq"]) for r in table.read().collect()} == {(1, 12), (2, 9), (3, 6), (9, 11)}
    assert table.versions() == [0, 1, 2, 3, 4, 5]


def test_markdown(spark):
    texts = ["see ![a](b) here\n  - indented", "![only](x)  \n- one\n* two", "`a` [b](c) **d** `` []() ****", "a\u00a0\u00a0b\n\n c "]
    assert mapped(spark, texts, tx.clean_markdown) == ["see !a here - indented", "one two", "a b d `` []() ****", "a b c"]
    assert mapped(
        spark,
        ["One. Two. three - four * five -six. 7 is. `x`", "", None],
        tx.split_statements,
    ) == [["One.", "Two. three", "four", "five -six.", "7 is.", "`x`"], [], None]
    docs = spark.createDataFrame(
        [(1, "# T\n## A b \nx `y`\n\n### sub\n##no\n##  A B\n- z\n## empty\n"), (2, None), (3, "no heading")],
        "doc_id int, text string",
    )
    assert {(r["doc_id"], r["heading"], r["body"]) for r in ca.markdown_sections(docs).collect()} == {(1, "a b", "z"), (1, "empty", "")}


def test_media_types_and_roles(spark):
    paths = ["a/b.JSON", "x.aln-fasta", ".aln-fasta", "x.tar.gb", "dir.md/file", ".json", "a.html", "b.", None, "c.geojson"]
    assert mapped(spark, paths, tx.media_type) == [
        "application/json",
        "text/x-fasta",
        "text/x-fasta",
        "text/x-genbank",
        *["application/octet-stream"] * 5,
        "application/geo+json",
    ]
    assert mapped(spark, ["a/Provenance.json", "b.json"], lambda p: tx.final_role(p, F.lit("output"))) == ["provenance", "output"]


GOOD = {
    "application/json": '{"a": [1]}', "text/csv": 'a,b\n1,"x, ""y""\n"', "image/svg+xml": "<svg x></svg>", "chemical/x-pdb": "REMARK\nHETATM", "chemical/x-mmcif": "data_a\n_atom_site.id",
    "text/x-fasta": "\n>a\nAC-*?.\n\nGT\n>b c\nA", "text/x-genbank": "LOCUS x\nORIGIN  \n1 a\n//\n", "text/x-newick": " ((a,b),c); ", "text/markdown": "x", "application/octet-stream": "x",
}
BAD = {
    "application/json": ['{"a": [1]', "{} x", ""], "text/csv": ["a,b\n1\n", 'a,"b\n', "a\n\nb,c"], "image/svg+xml": ["<svgx></svg>", "<svg>"], "chemical/x-pdb": ["ATOM x\n HETATM"], "chemical/x-mmcif": [
        " data_a\n_atom_site.id",
        "data_a",
    ],
    "text/x-fasta": [
        "AC\n>a\nAC",
        ">\nAC",
        ">a\n>b\nAC",
        ">a\nAC1",
        ">a",
    ], "text/x-genbank": ["LOCUS x\nORIGIN\n1 a\n", "LOCUS x\nORIGIN 1\n//"], "text/x-newick": ["(a", "(a))(;", "(a)"], "text/markdown": [" \n"],
}


def test_contents(spark):
    rows = [(k, v, True) for k, v in GOOD.items()] + [(k, v, False) for k, own in BAD.items() for v in own]
    df = spark.createDataFrame(rows, "m string, c string, want boolean").withColumn("got", tx.content_ok(F.col("m"), F.col("c")))
    assert [tuple(r) for r in df.where("got <> want").collect()] == []
    png = b"\x89PNG\r\n\x1a\n"
    assert mapped(
        spark,
        [png + b"\xff", b"not a png", png[:7], b"", None],
        lambda c: tx.content_ok(F.lit("image/png"), c),
        "binary",
    ) == [True, False, False, False, False]
    long = ">a\n" + "ACGT" * 20 + "\n" + ("ACGT" * 20 + "\n") * 20000
    assert mapped(
        spark,
        [long, "a,b\n" + '1,"x ""y"" z"\n' * 50000],
        lambda c: F.when(c.startswith(">"), tx.content_ok(F.lit("text/x-fasta"), c)).otherwise(tx.content_ok(F.lit("text/csv"), c)),
    ) == [True, True]


def test_opening_is_bounded_by_size_and_kind(spark):
    rows = [
        ("a.txt", "text/plain", "abc"),
        ("a.txt", "text/plain", "abcdef"),
        ("a.PDB", "application/octet-stream", "abc"),
        ("a.png", "image/png", "abcdef"),
        ("x.cif", "chemical/x-mmcif", "abc"),
        (None, None, None),
    ]
    got = [(r["content"], r["truncated"], (r["note"] or "")[:6]) for r in ca.open_bounded(
        spark.createDataFrame(rows, "path string, media_type string, content string").coalesce(1),
        4,
    ).collect()]
    assert got == [("abc", False, ""), (None, True, "Text e"), ("abc", False, ""), (None, True, "Binary"), ("abc", False, ""), (None, None, "This a")]


def test_sizes_and_stale_metadata(spark):
    content = [
        ("lf", "text/markdown", b"alpha\nbeta\n"),
        ("crlf", "text/markdown", b"alpha\r\nbeta\r\n"),
        ("png", "image/png", b"\x89PNG\r\n\x1a\n" + b"x" * 15),
    ]
    stats = ck.file_stats(spark.createDataFrame(content, "path string, media_type string, content binary"))
    declared = [("lf", 11), ("lf", 13), ("lf", 12), ("crlf", 11), ("png", 23), ("png", 22), ("png", 21), ("gone", 1), (None, 5), ("lf", None)]
    artifacts = spark.createDataFrame(
        [("c", f"a{k}", p, n) for k, (p, n) in enumerate(declared)],
        "case_id string, artifact_id string, path string, bytes long",
    )
    got = {r["name"]: (r["ok"], r["actual"]) for r in ck.artifact_size_check(artifacts, stats).collect()}
    assert [got[f"a{k}"][0] for k in range(10)] == [True, True, False, True, True, True, False, False, True, True]
    assert got["a1"][1] == "11 bytes (LF-equivalent 11; CRLF-equivalent 13)" and got["a7"][1] == "missing" and got["a8"][1] == "resource"
    stale = ck.stale_metadata(
        spark.createDataFrame(
            [("lf", 11, None), ("crlf", 11, None), ("crlf", 13, "x"), ("png", 23, None), ("png", 19, None)],
            "path string, bytes long, sha256 string",
        ),
        stats,
    )
    assert {(
        r["path"],
        r["bytes"],
        (r["sha256"] or "")[:1],
    ) for r in stale.collect()} >= {("png", 23, "")} and stale.where("path = 'crlf'").first()["bytes"] == 11 and stale.count() == 2


def test_rollup_and_review(spark):
    checks = spark.createDataFrame(
        [("c", "z", False, "1", "2", 1), ("c", "a", False, None, "2", 2), ("c", "m", True, "", "", 3), ("d", "x", True, "", "", 1)],
        "case_id string, name string, ok boolean, actual string, expected string, ordinal int",
    )
    assert {tuple(r) for r in ck.validation_rollup(checks).collect()} == {("c", False, 3, "REPLAY_VALIDATION_FAILED", "z, a"), ("d", True, 1, None, None)}
    statements = spark.createDataFrame(
        [("c", "observation", 2, "B"), ("c", "observation", 1, "A"), ("c", "limitation", 1, "L"), ("e", "computed", 1, "R")],
        "case_id string, kind string, ordinal int, statement string",
    )
    sources = spark.createDataFrame([("c", 1, "https://x"), ("c", 2, "PMID 1")], "case_id string, ordinal int, source string")
    artifacts = spark.createDataFrame([("c", 1, "z"), ("c", 2, "q"), ("f", 1, "g")], "case_id string, ordinal int, artifact_id string")
    got = {r["case_id"]: r for r in ck.review_report(statements, sources, artifacts, checks).collect()}
    assert got["c"]["source_observations"] == [
        "A",
        "B",
    ] and got["c"]["computed_results"] == [] and got["c"]["limitations"] == ["L"] and got["e"]["computed_results"] == ["R"]
    assert [tuple(x) for x in got["c"]["citation_checks"]] == [("https://x", True), ("PMID 1", False)]
    assert [tuple(x) for x in got["c"]["artifact_checks"]] == [("z", False, "1"), ("q", True, "resource reference")] and len(got["f"]["artifact_checks"]) == 1


def test_claims_and_search_text(spark):
    sections = spark.createDataFrame(
        [("c", "verified observations", "Seen. Told - Seen."), ("c", "result", "Ten."), ("c", "limitation", "Few."), ("d", "other", "x")],
        "doc_id string, heading string, body string",
    )
    cases = spark.createDataFrame(
        [("c", "S", ["Seen.", " New `one` "], None, None), ("d", "S", ["Only.", "Only. ", ""], ["I"], ["L"]), ("e", "S", None, None, None)],
        "case_id string, summary string, observations array<string>, interpretation array<string>, limitations array<string>",
    )
    st_ = ca.case_statements(cases, sections)
    got = {r["case_id"]: tuple(r)[1:] for r in st_.collect()}
    assert got["c"] == (
        ["Seen.", "Told"],
        ["Ten.", "New `one`"],
        [],
        ["Few."],
        "S",
    ) and got["d"] == (["Only."], [], ["I"], ["L"], "S") and got["e"] == ([], [], [], [], "S")
    artifacts = spark.createDataFrame(
        [("c", 2, "out", "output"), ("c", 1, "in", "input"), ("c", 3, "prov", "provenance"), ("c", 4, "log", "log")],
        "case_id string, ordinal int, artifact_id string, role string",
    )
    claims = {r["claim_id"]: (r["statement"], r["artifact_ids"]) for r in ca.build_claims(st_, artifacts).collect()}
    assert claims == {
        "c:observation:1": ("Seen.", ["in", "prov"]),
        "c:observation:2": ("Told", ["in", "prov"]),
        "c:computed:1": ("Ten.", ["out", "prov"]),
        "c:computed:2": ("New `one`", ["out", "prov"]),
        "d:observation:1": ("Only.", []),
        "d:interpretation:1": ("I", []),
    }
    one = spark.createDataFrame(
        [("Title", "sum", "Title", "cat", "Plug", ["HTTP://s", "sum"])],
        "title string, summary string, question string, category string, plugin_name string, sources array<string>",
    )
    assert ca.search_text(one).first()["search_text"] == "title sum cat plug http://s"


def test_numbers_of_any_length(spark):
    assert mapped(spark, ["n 1234567890123 m", "none", None, "a 7 8"], lambda t: tx.number_in(t, r"(\d+)")) == [1234567890123.0, None, None, 7.0]


def test_provider_readiness(spark):
    columns = "provider_id string, kind string, command string, command_found boolean, enable_name string, enable_value string, credential_name string, credential_value string, target_name string, target_value string, cost_min double, cost_max double"
    rows = [
        ("plain", "local", None, None, None, None, None, None, None, None, None, None),
        ("api", "public-api", None, None, "ON", " ", None, None, None, None, None, None),
        ("gpu", "gpu", "run", True, None, None, "KEY", "k", "HOST", None, 0.1, 2.0),
        ("paid", "paid-api", "run", False, None, None, "KEY", None, None, None, None, None),
    ]
    got = {r["provider_id"]: r for r in runs.provider_readiness(spark.createDataFrame(rows, columns)).collect()}
    assert [(got[k]["installed"], got[k]["runnable"]) for k in ("plain", "api", "gpu", "paid")] == [(True, True), (False, False), (True, False), (False, False)]
    assert got["plain"]["diagnostics"] == ["Provider prerequisites are available."] and got["gpu"]["diagnostics"] == ["Remote target is not configured: HOST."] and len(got["paid"]["diagnostics"]) == 2
    assert got["gpu"]["estimated_cost"]["max"] == 2.0 and got["paid"]["estimated_cost"] is None and got["paid"]["credential_required"] and not got["paid"]["credential_configured"]
    assert got["api"]["diagnostics"] == ["Live source is not authorized; configure ON to enable it."]


def test_provider_report(spark):
    cases = spark.createDataFrame([("a", ["p"]), ("b", []), ("c", None)], "case_id string, provider_ids array<string>")
    providers = spark.createDataFrame([("p", 1), ("q", 2)], "provider_id string, n int")
    assert {(r["case_id"], r["provider_id"]) for r in runs.provider_report(cases, providers).collect()} == {
        ("a", "p"),
        ("b", "p"),
        ("b", "q"),
        ("c", "p"),
        ("c", "q"),
    }
    assert {(r["case_id"], r["provider_id"]) for r in runs.provider_report(cases, providers, ["q"]).collect()} == {("a", "q"), ("b", "q"), ("c", "q")}


def test_ranks_with_ties(spark):
    cells = [(f"c{k}", "g", float(v)) for k, v in enumerate([5, 3, 3, 9, 1, 3, 9, 2] * 20)]
    got = {r["cell"]: r["rank"] for r in ev.expression_qc(spark.createDataFrame(cells, "cell string, gene string, value double"), F.lit(False), 7).collect()}
    assert got == {c: 1 + sum(v < w for _, _, w in cells) for c, _, v in cells}




def test_stretches_of_long_rows(spark):
    r = __import__("random").Random(3)
    rows = ["".join(r.choice("AC-") for _ in range(n)) for n in (130, 129, 64)] + [""]
    al = spark.createDataFrame([(1, k, f"s{k}", s) for k, s in enumerate(rows)], "alignment_id int, row_no int, seq_id string, sequence string")
    got = {x["col"]: (x["top"], x["residues"]) for x in sq.column_identity(al).collect()}
    want = {}
    for c in range(130):
        own = [s[c] for s in rows if len(s) > c and s[c] != "-"]
        if own:
            want[c + 1] = (max(own.count(x) for x in own), len(own))
    assert got == want
    position = {x["col"]: x["position"] for x in sq.ungapped_positions(al).collect()}
    assert position == {c + 1: (len(rows[0][: c + 1].replace("-", "")) if rows[0][c] != "-" else None) for c in range(130)}
    conserved = [c for c in sorted(want) if want[c][0] == want[c][1]]
    got = {(x["first_col"], x["last_col"], x["columns"], x["ref_start"], x["ref_end"]) for x in sq.conserved_runs(al, 1).collect()}
    spans = [(
        a,
        b,
    ) for a in conserved if a - 1 not in conserved for b in conserved if b >= a and b + 1 not in conserved and all(c in conserved for c in range(a, b + 1))]
    assert got == {(a, b, b - a + 1, position[a], position[b]) for a, b in spans}


def test_translation_and_mutations_that_fail(spark):
    genomes = spark.createDataFrame([("g", "ccATGAAACTTTAAgg")], "accession string, sequence string")
    rows = [("g", 1, 3, 14, False, "MKL"), ("g", 2, 3, 14, False, "MKV"), ("g", 3, 3, 14, True, None), ("g", 4, 3, 13, False, "MKL")]
    got = {r["feature_no"]: (r["bases"], r["residues"], r["ok"]) for r in sq.cds_translation_check(
        spark.createDataFrame(rows, "accession string, feature_no int, start int, end int, complement boolean, translation string"),
        genomes,
    ).collect()}
    assert got == {1: (12, 3, True), 2: (12, 3, False), 3: (12, 4, None), 4: (11, 3, True)}
    parents = spark.createDataFrame([("p", "MKCL")], "parent string, parent_sequence string")
    rows = [("a", "p", "K2A;L4C", "MACC"), ("b", "p", "K3A", "MKAL"), ("c", "p", "K2A", "MKCL"), ("d", "p", "WT", "MKCL"), ("e", "p", "K9A", "MKCL")]
    got = {r["candidate"]: tuple(r)[1:] for r in sq.mutation_check(
        spark.createDataFrame(rows, "candidate string, parent string, mutations string, sequence string"),
        parents,
    ).collect()}
    assert {k: v[1:3] for k, v in got.items()} == {
        "a": (True, True),
        "b": (False, True),
        "c": (True, False),
        "d": (True, True),
        "e": (False, False),
    } and got["a"][3:] == (4, 2)


@pytest.mark.parametrize("name", ["signup", "view", "click", "purchase", "error"])
def test_stand_in_states_are_states(name):
    assert plan.STAND_IN[name] in runs.TRANSITIONS


def test_overlaps_of_short_and_long_intervals(spark):
    r = __import__("random").Random(4)
    interval = lambda: (a := r.randrange(0, 3000), a + int(2 ** r.uniform(0, 13)))
    features = [(k % 2, k, *interval()) for k in range(120)] + [(0, 900, 0, 10**9)]
    regions = [(k % 2, k, *interval()) for k in range(30)] + [(1, 900, 5, 5), (0, 901, 10**6, 10**8)]
    f = spark.createDataFrame(features, "accession int, id int, start long, end long")
    g = spark.createDataFrame(regions, "accession int, rid int, region_start long, region_end long")
    got = sorted((x["id"], x["rid"]) for x in ca.features_in_region(f, g, 8).collect())
    assert got == sorted((i, j) for a, i, s, e in features for b, j, t, u in regions if a == b and s <= u and e >= t)
    assert ca.features_in_region(f.limit(0), g, 8).count() == 0


GOOD_JSON = ('{"a":1}', "[1, [2, {}], \"x]}\"]", "  12.5e3\n", '"a\\"b"', "null", "true", '[{"end":1}]', '{"end":"end"}', "[]")
BAD_JSON = ('{"a":1}\n{"b":2}', "[1] x", "1,2", '1,"x":2', '1,"end":"end"} x', '1,"end"] x', "1],[2", "1}, {", "[1,]", "{a:1}", "'a'", "[1", "01", "tru", " ", '"a', "{}}", "[]]", "1 2", '"a" "b"')


def test_a_json_file_is_one_value(spark):
    import json

    rows = spark.createDataFrame([(t,) for t in GOOD_JSON + BAD_JSON], "t string")
    got = {r["t"]: r["ok"] for r in rows.select("t", tx.one_json_value(F.col("t")).alias("ok")).collect()}
    assert got == {t: t in GOOD_JSON for t in got} and len(got) == len(GOOD_JSON + BAD_JSON)
    for t in GOOD_JSON:
        json.loads(t)
    assert rows.select(tx.one_json_value(F.lit(None).cast("string"))).first()[0] is False


def test_long_runs_of_blanks_take_little_time(spark):
    text = "One." + " " * 200_000 + "Two" + " " * 200_000 + "x -" + "\t" * 100_000 + "end" + " " * 100_000
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(tx.split_statements(F.col("t")).alias("s")).first()["s"] == ["One.", "Two" + " " * 200_000 + "x", "end"]


def test_translation_of_a_long_text_takes_time_in_proportion(spark, tmp_path):
    rows = [(k, "acgtgctaggt" * 180_000) for k in (0, 1)]  # two million letters: their square would take over half an hour
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    began = time.time()
    got = {r["accession"]: (r["bases"], r["ok"]) for r in sequence_plans.cds(spark, str(tmp_path)).collect()}
    assert got == {0: (1_979_988, True), 1: (1_979_988, False)} and time.time() - began < 120


def test_codons_with_other_letters_are_unknown(spark):
    rows = spark.createDataFrame([("ATGNNNTAA",), ("AT",), ("",), (None,), ("é\U0001f600TATG",)], "x string")
    assert [r[0] for r in rows.select(sq.translated("x")).collect()] == ["MX*", "", "", None, "XM"]


def test_runs_across_stretches_are_one_and_columns_are_no_rows(spark):
    w = packed.WIDE
    a = "a" * w + "c" + "a" * (w - 3) + "gc" + "a" * (w + 2) + "t"
    b = "a" * w + "c" + "a" * (w - 3) + "ct" + "a" * (w + 2) + "t"
    rows = spark.createDataFrame([(1, 0, 1, a), (1, 1, 2, b), (2, 0, 3, "-ac"), (2, 1, 4, "ga-")], "alignment_id long, row_no int, seq_id long, sequence string")
    got = sorted(tuple(r) for r in sq.conserved_runs(rows, 2).select("alignment_id", "first_col", "last_col", "columns", "ref_start", "ref_end").collect())
    assert got == [(1, 1, 2 * w - 2, 2 * w - 2, 1, 2 * w - 2), (1, 2 * w + 1, 3 * w + 3, w + 3, 2 * w + 1, 3 * w + 3), (2, 1, 3, 3, None, 2)]
    assert packed.full_runs(rows, 2).count() == 5  # not some 12,000 columns
