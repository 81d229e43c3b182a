"""Values that published records give, recomputed from their inputs."""

import datetime

import pytest
from golden_values import CANDIDATES, CI, INTERFACE, LAMBDA, RAS
from pyspark.sql import functions as F

from evidentia.functions import text as tx
from evidentia.operators import evidence as ev
from evidentia.operators import sequence as sq
from evidentia.operators import structure as st


@pytest.fixture(scope="module")
def ras(spark):
    return spark.createDataFrame([(1, k, k, s) for k, s in enumerate(RAS)], "alignment_id int, row_no int, seq_id int, sequence string")


def test_ras_distances_and_tree(ras):
    got = {(r["row_i"], r["row_j"]): (r["mismatches"], r["compared"], r["distance"]) for r in sq.p_distance(ras).collect()}
    assert got == {(0, 1): (25, 190, 0.13157894736842105), (0, 2): (26, 190, 0.1368421052631579), (1, 2): (30, 190, 0.15789473684210525)}
    branch = sq.triplet_branch_lengths(sq.p_distance(ras)).first()
    assert [round(branch[f"branch_{x}"], 6) for x in "ijk"] == [0.055263, 0.076316, 0.081579]


def test_ras_identity(ras):
    columns = sq.column_identity(ras)
    assert columns.count() == 191 and sq.mean_identity(columns).first()["mean_identity"] == pytest.approx(0.9284467713787081, abs=1e-13)


def test_lambda_repressor(spark):
    genomes = spark.createDataFrame([("L", LAMBDA)], "accession string, sequence string")
    features = spark.createDataFrame(
        [("L", 1, 7, 720, True, CI)],
        "accession string, feature_no int, start int, end int, complement boolean, translation string",
    )
    r = sq.cds_translation_check(features, genomes).first()
    assert (
        r["bases"],
        r["residues"],
        r["ok"],
    ) == (714, 237, True) and r["protein_sha256"] == "ec5d954fd10be8c19c920e78badc5d9e9cc281f6801e2c5fde3803c9f133f580"


def test_interface_contacts(spark):
    rows = [(1, k, a, f"{res}:{a}", *map(float, xyz)) for k, (a, res, *xyz) in enumerate(line.split() for line in INTERFACE.strip().split("\n"))]
    atoms = spark.createDataFrame(rows, "structure int, atom_id int, chain string, residue string, x double, y double, z double")
    pairs = st.contacts(atoms, F.col("chain") == "A", F.col("chain") == "B", 4.0)
    r = st.contact_summary(pairs, "structure").first()
    assert (r["contacts"], r["residue_pairs"]) == (105, 34)


def test_candidates(spark):
    rows = [line.split() for line in CANDIDATES.strip().split("\n")]
    wild = next(r[4] for r in rows if r[1] == "WT")
    c = spark.createDataFrame([(r[0], "p", r[1], r[4]) for r in rows], "candidate string, parent string, mutations string, sequence string")
    got = {r["candidate"]: tuple(r)[2:] for r in sq.mutation_check(c, spark.createDataFrame([("p", wild)], "parent string, parent_sequence string")).collect()}
    assert len(got) == 20 and got == {r[0]: (True, True, int(r[2]), int(r[3])) for r in rows}


def test_preprint_interval(spark):
    day = datetime.date
    versions = spark.createDataFrame([("p", day(2020, 9, 10), "T")], "preprint string, version_date date, title string")
    links = spark.createDataFrame([("p", "33608522")], "preprint string, pub_id string")
    pubs = spark.createDataFrame(
        [("33608522", day(2021, 2, 19), "Evolution of immune responses to SARS-CoV-2 in mild-moderate COVID-19.")],
        "pub_id string, pub_date date, pub_title string",
    )
    r = ev.preprint_publication(versions, links, pubs).first()
    assert (r["elapsed_days"], r["title_changed"]) == (162, True)


# Themes of ten records, statements about a figure, and the first corners of a ring.
THEMES = (
    "injury response",
    "variant and disease model",
    "review",
    "immunometabolism review",
    "glioma review",
    "intervention and injury",
    "simulation review",
    "therapeutic review",
    "variant and systemic metabolism",
    "innate immune memory review",
)
FIGURE = (
    "The displayed model contained 225 protein residues, 1866 atoms, and CRO at chain A author residue 66.",
    "The viewer returned 18 polymer residues within 4.0 angstrom of CRO using closest heavy-atom Euclidean distance.",
)
RING = [[1630.0, 98.0], [1625.813, 119.048], [1613.891, 136.891], [1596.048, 148.813]]


def test_theme_split(spark):
    rows = spark.createDataFrame([(t, False) for t in THEMES] + [("preprint review", True)], "theme string, is_preprint boolean")
    assert {r["kind"]: r["records"] for r in ev.theme_counts(rows).collect()} == {"review": 6, "primary": 4, "preprint": 1}


def test_numbers_of_a_figure(spark):
    text = spark.createDataFrame([(" ".join(FIGURE),)], "t string")
    patterns = (r"(\d+) protein residues", r"(\d+) atoms", r"(\d+) polymer residues within 4\.0", r"(\d+) ligands")
    assert text.select(*(tx.number_in(F.col("t"), p).alias(f"n{k}") for k, p in enumerate(patterns))).first() == (225.0, 1866.0, 18.0, None)


def test_ring_around_an_observation(spark):
    ring = st.circle_polygons(spark.createDataFrame([(1575.0, 98.0)], "x double, y double"), 55.0, 16).first()["ring"]
    assert ring[:4] == RING and len(ring) == 17 and ring[0] == ring[-1]
