"""Distance joins over dense cells against all pairs; what counts as an atom of which kind."""

import random

import pytest
from pyspark.sql import functions as F

from evidentia.operators import structure as st

ATOMS = "structure int, atom_id int, residue string, x double, y double, z double"


def cloud(seed, n, structures=2):
    """Points in a few cells: spread out, in a dense spot, on cell borders and on one another."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        kind = rng.randrange(4)
        p = [rng.uniform(-3, 3) for _ in "xyz"]
        if kind == 1:
            p = [rng.uniform(0.1, 0.6) for _ in "xyz"]
        elif kind == 2:
            p = [rng.choice([-1.0, 0.0, 1.0, 2.0]) for _ in "xyz"]
        elif kind == 3:
            p = [0.25, 0.25, rng.choice([0.25, 1.25])]
        rows.append((rng.randrange(structures), k, f"r{k % 7}", *p))
    return [*rows, (0, n, "r", None, 0.0, 0.0)]


def all_pairs(left, right, cutoff):
    d2 = lambda a, b: sum((p - q) * (p - q) for p, q in zip(a[3:], b[3:], strict=True))
    return sorted((a[1], b[1]) for a in left for b in right if a[0] == b[0] and None not in a[3:] + b[3:] and d2(a, b) <= cutoff * cutoff)


@pytest.mark.parametrize(("seed", "dense"), [(1, 4), (2, 20), (3, 10_000)])
def test_distance_join_equals_all_pairs(spark, seed, dense):
    left, right = cloud(seed, 220), cloud(seed + 50, 260)
    for cutoff in (1.0, 0.3):
        got = st.distance_join(spark.createDataFrame(left, ATOMS), spark.createDataFrame(right, ATOMS), cutoff, dense).select("latom_id", "ratom_id")
        assert sorted(map(tuple, got.collect())) == all_pairs(left, right, cutoff)


@pytest.mark.parametrize("sides", [(3000, 3000), (20, 3000), (3000, 20)])
def test_a_crowded_cell_is_split(spark, sides):
    rng = random.Random(9)
    rows = [[(0, k, "r", *(rng.uniform(0.0, 0.999) for _ in "xyz")) for k in range(n)] for n in sides]
    a, b = st.dealt_pairs(*(spark.createDataFrame(r, ATOMS) for r in rows), 1.0, 100)
    for df, n in ((a, sides[0]), (b, sides[1])):
        largest = df.groupBy("structure", "_left", "_right").count().agg(F.max("count")).first()[0]
        assert largest <= 100 or n < 100


def test_octree_leaves_hold_few_rows_or_one_point(spark):
    rows = [r for r in cloud(4, 400, 1) if None not in r]
    side = st._with_cells(spark.createDataFrame(rows, ATOMS), "l", 1.0)
    of, leaves = st.dense_cells(side, 30)
    sizes = side.join(of, ["structure", "_f"]).groupBy("_cell").agg(F.count("*").alias("n"), F.countDistinct("_f").alias("cells"))
    assert sizes.where("n > 30 AND cells > 1").count() == 0 and sizes.where("_cell.level < 5").count() > 0
    assert leaves.count() == sizes.count()


def test_calcium_is_no_alpha_carbon_and_hydrogens_are_not_near(spark):
    rows = [(0, 1, "A", "GLY:1", "CA", "ATOM", 0.0), (0, 2, "A", "CA:2", "CA", "HETATM", 1.0), (0, 3, "A", "GLY:1", "1HB", "ATOM", 4.0), (0, 4, "A", "GLY:1", "HA", "ATOM", 4.5), (0, 5, "L", "LIG", "C1", "HETATM", 5.0), (0, 6, "L", "LIG", "H1", "HETATM", 0.5)]
    atoms = spark.createDataFrame(rows, "structure int, atom_id int, chain string, residue string, atom_name string, record string, x double").withColumns({"y": F.lit(0.0), "z": F.lit(0.0)})
    assert [tuple(r) for r in st.atom_counts(atoms.where("chain = 'A'"), "chain").collect()] == [("A", 4, 1)]
    got = {r["residue"]: r["distance"] for r in st.residues_near(atoms, F.col("chain") == "L", 4.2).collect()}
    assert got == {"CA:2": 4.0}


def test_coverage_of_an_export(spark):
    seen = spark.createDataFrame([(1.0, 2.0, True), (3.0, 0.5, False)], "x double, y double, in_tissue boolean")
    row = st.spatial_coverage(seen, spark.range(8)).first()
    assert (row["min_x"], row["max_y"], row["observations"], row["in_tissue"], row["total"], row["exported_share"]) == (1.0, 2.0, 2, 1, 8, 0.25)
    assert st.spatial_coverage(seen.limit(0), spark.range(0)).first()["exported_share"] is None
