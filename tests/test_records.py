"""Record checks, recipes, artifact rows and provider status on literal cases."""

import base64
import hashlib

from pyspark.sql import functions as F

from evidentia.operators import catalogue as ca
from evidentia.operators import checks as ck
from evidentia.operators import runs

CASES = "case_id string, status string, modes array<string>, observation array<string>, computed array<string>, interpretation array<string>, limitation array<string>, required_inputs array<string>, expected_outputs array<string>"


def test_ten_checks_of_a_record(spark):
    every = ["lesson", "replay", "reproduce"]
    cases = spark.createDataFrame(
        [
            ("good", "ready", every, ["o"], ["c"], ["i"], ["l"], ["a"], ["b", "c"]),
            ("bare", "draft", None, None, [], None, [], None, None),
            ("part", "ready", ["replay"], ["o"], ["c"], ["i"], ["l"], ["a", "gone"], ["b"]),
        ],
        CASES,
    )
    claims = spark.createDataFrame([("good", ["x", "y"]), ("good", []), ("part", ["x", "z"]), ("part", None)], "case_id string, artifact_ids array<string>")
    held = spark.createDataFrame([("good", "x"), ("good", "y"), ("part", "x"), ("good", "z")], "case_id string, artifact_id string")
    files = spark.createDataFrame([("a",), ("b",), ("c",)], "path string")
    got = {}
    for r in ck.record_checks(cases, claims, held, files).orderBy("ordinal").collect():
        got.setdefault(r["case_id"], []).append((r["name"], r["ok"], r["actual"], r["expected"]))
    names = ["showcase is ready", "lesson mode declared", "replay mode declared", "reproduce mode declared", "source observations recorded", "computed results recorded", "scientific interpretation recorded", "limitations recorded", "claim artifact references resolve", "recipe files are present"]
    assert all([x[0] for x in rows] == names for rows in got.values())
    oks = {case: [x[1] for x in rows] for case, rows in got.items()}
    assert oks == {"good": [True] * 10, "bare": [False] * 8 + [True] * 2, "part": [True, False, True, False, True, True, True, True, False, False]}
    assert got["bare"][0][2:] == ("draft", "ready") and got["part"][9][2:] == ("false", "true")
    rolled = {r["case_id"]: r["error_message"] for r in ck.validation_rollup(ck.record_checks(cases, claims, held, files)).collect()}
    assert rolled["good"] is None and rolled["part"].startswith("lesson mode declared, reproduce")


def test_recipes(spark):
    cases = spark.createDataFrame([("s", "sequence"), ("n", "ngs"), ("l", "literature"), ("w", "workbench"), ("d", "workbench"), ("u", None)], "case_id string, category string")
    rules = spark.createDataFrame([("sequence", "seq", ["p1"]), ("ngs", "reads", ["p2", "p3"]), ("workbench", "wb", ["p9"])], "category string, adapter string, provider_ids array<string>")
    own = spark.createDataFrame([("d", "design", ["local", "gpu"], "conditional"), ("w", None, ["wb-local"], None)], "case_id string, adapter string, provider_ids array<string>, strategy string")
    artifacts = spark.createDataFrame([("s", 2, "output", "o"), ("s", 0, "input", "readme"), ("s", 1, "input", "i"), ("s", 3, "provenance", "p"), ("s", 4, "preview", None), ("n", 0, "other", "x")], "case_id string, ordinal int, role string, path string")
    got = {r["case_id"]: tuple(r)[1:] for r in ca.recipes(cases, artifacts, rules, own).collect()}
    assert got["s"] == ("seq", ["p1"], "local", ["readme", "i"], ["o", "p"]) and got["n"] == ("reads", ["p2", "p3"], "conditional", [], [])
    assert got["d"][:3] == ("design", ["local", "gpu"], "conditional") and got["w"][:3] == ("wb", ["wb-local"], "local")
    assert got["l"] == (None, None, "network", [], []) and got["u"][2] == "network"


def test_artifact_rows(spark):
    cases = spark.createDataFrame([("c1", "plug/cases/one", "prompt.md", "2024-02-03")], "case_id string, case_path string, prompt string, run_date string")
    texts = {"README.md": b"# r\r\n", "prompt.md": b"p", "in.csv": b"a,b\r\n", "out.json": b"{}", "view.svg": b"<svg>\r\n</svg>", "shot.png": b"\x89PNG\r\n", "x.provenance.json": b"[]", "both.md": b"b"}
    canonical = {k: v if k.endswith(".png") else v.replace(b"\r\n", b"\n") for k, v in texts.items()}
    sha = {k: hashlib.sha256(v).hexdigest() for k, v in canonical.items()}
    declared = spark.createDataFrame(
        [
            ("c1", "output", 0, "out.json", 2, sha["out.json"]),
            ("c1", "output", 1, "both.md", None, None),
            ("c1", "preview", 0, "both.md", 1, None),
            ("c1", "preview", 1, "view.svg", 99, None),
            ("c1", "preview", 2, "shot.png", 6, "stale"),
            ("c1", "input", 0, "in.csv", 4, None),
            ("c1", "input", 1, "x.provenance.json", None, None),
            ("c1", "output", 2, "gone.json", 1, None),
        ],
        "case_id string, role string, ordinal int, path string, bytes long, sha256 string",
    )
    files = spark.createDataFrame([(f"plug/cases/one/{k}", bytearray(v)) for k, v in texts.items()], "path string, content binary")
    from evidentia.functions import text as tx

    stats = ck.file_stats(files.withColumn("media_type", tx.media_type(F.col("path"))), "content")
    rows = ca.artifact_rows(cases, declared, stats, "store://").orderBy("ordinal").collect()
    assert [r["artifact_id"] for r in rows] == ["c1:README.md", "c1:prompt.md", "one:in.csv", "one:x.provenance.json", "one:both.md", "one:view.svg", "one:shot.png", "one:out.json"]
    assert [r["role"] for r in rows] == ["input", "input", "input", "provenance", "preview", "preview", "preview", "output"]
    assert [r["bytes"] for r in rows] == [len(canonical[r["path"].rsplit("/", 1)[1]]) for r in rows]
    assert [r["generated_at"] for r in rows] == [None] * 3 + ["2024-02-03"] * 5
    by = {r["path"].rsplit("/", 1)[1]: r for r in rows}
    assert by["view.svg"]["resource_uri"] == "data:image/svg+xml;base64," + base64.b64encode(canonical["view.svg"]).decode()
    assert by["shot.png"]["resource_uri"] == "store://plug/cases/one/shot.png" and by["out.json"]["resource_uri"] is None
    assert by["view.svg"]["source"].endswith("(recorded bytes=99, sha256=unspecified).") and by["shot.png"]["source"].endswith("(recorded bytes=6, sha256=stale).")
    assert by["shot.png"]["sha256"] == sha["shot.png"] and by["in.csv"]["sha256"] is None and by["in.csv"]["source"] is None


def test_status_of_an_unregistered_provider(spark):
    known = spark.createDataFrame([("p", "gpu", True, True, False, False, ["note"])], "provider_id string, kind string, installed boolean, credential_required boolean, credential_configured boolean, runnable boolean, diagnostics array<string>")
    ids = spark.createDataFrame([("p",), ("q",), ("q",)], "provider_id string")
    got = {r["provider_id"]: tuple(r)[1:] for r in runs.provider_status(ids, known).collect()}
    assert got == {"p": ("gpu", True, True, False, False, ["note"]), "q": ("local", False, False, False, False, ["Provider q is not registered."])}
