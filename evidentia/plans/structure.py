"""Structure queries on `embeddings`: x, y, z are the first three values, the label is the chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.operators import structure as st

CUTOFF = 0.06


def atoms(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    v = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return e.select(
        F.lit(0).alias("structure"),
        F.col("vec_id").alias("atom_id"),
        F.col("label").alias("chain"),
        F.concat_ws(":", "label", F.col("vec_id") % 50).alias("residue"),
        F.when(F.col("vec_id") % 4 == 0, "CA").when(F.col("vec_id") % 7 == 0, "1HB").otherwise("CB").alias("atom_name"),
        F.when(F.col("vec_id") % 6 == 0, "HETATM").otherwise("ATOM").alias("record"),
        v(0).alias("x"),
        v(1).alias("y"),
        v(2).alias("z"),
    )


def pairs(spark, d):
    return st.contacts(atoms(spark, d), F.col("chain") % 2 == 0, F.col("chain") % 2 == 1, CUTOFF)


QUERIES = {
    "j7_distance_join": lambda s, d: pairs(s, d).select(F.col("latom_id").alias("left_id"), F.col("ratom_id").alias("right_id"), F.round("d2", 9).alias("d2")),
    "a7_contact_summary": lambda s, d: st.contact_summary(pairs(s, d), "lchain", "rchain"),
    "j8_residues_near": lambda s, d: st.residues_near(atoms(s, d), F.col("chain") == 0, 0.1).select("residue", F.round("distance", 9).alias("distance")),
    "a6_atom_counts": lambda s, d: st.atom_counts(atoms(s, d), "chain"),
    "a9_spatial_coverage": lambda s, d: st.spatial_coverage(atoms(s, d).withColumn("in_tissue", F.col("chain") < 5).where("chain <> 7"), atoms(s, d)).withColumn("exported_share", F.round("exported_share", 9)),
    "t9_circle_polygons": lambda s, d: st.circle_polygons(atoms(s, d), 8.0, 16).select("atom_id", F.posexplode("ring").alias("corner", "p")).select(
        "atom_id",
        F.col("corner").cast("long").alias("corner"),
        F.col("p")[0].alias("px"),
        F.col("p")[1].alias("py"),
    ),
}

ATOMS = """WITH a AS (SELECT vec_id AS atom_id, label AS chain, label || ':' || (vec_id % 50) AS residue, CASE WHEN vec_id % 4 = 0 THEN 'CA' WHEN vec_id % 7 = 0 THEN '1HB' ELSE 'CB' END AS atom_name,
  CASE WHEN vec_id % 6 = 0 THEN 'HETATM' ELSE 'ATOM' END AS record,
  embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"""
D2 = "((l.x - r.x) * (l.x - r.x) + (l.y - r.y) * (l.y - r.y) + (l.z - r.z) * (l.z - r.z))"
PAIRS = f"{ATOMS}, p AS (SELECT l.atom_id AS left_id, r.atom_id AS right_id, l.chain AS lchain, r.chain AS rchain, l.residue AS lr, r.residue AS rr, {D2} AS d2 FROM a l JOIN a r ON l.chain % 2 = 0 AND r.chain % 2 = 1 AND {D2} <= 0.06 * 0.06)"

SQL = {
    "j7_distance_join": f"{PAIRS} SELECT left_id, right_id, round(d2, 9) AS d2 FROM p",
    "a7_contact_summary": f"{PAIRS} SELECT lchain, rchain, count(*) AS contacts, count(DISTINCT (lr, rr)) AS residue_pairs FROM p GROUP BY lchain, rchain",
    "j8_residues_near": f"""{ATOMS} SELECT l.residue, round(sqrt(min({D2})), 9) AS distance
FROM a l JOIN a r ON l.chain <> 0 AND r.chain = 0 AND l.atom_name <> '1HB' AND r.atom_name <> '1HB' AND {D2} <= 0.1 * 0.1
GROUP BY l.residue""",
    "a6_atom_counts": f"{ATOMS} SELECT chain, count(*) AS atoms, count(*) FILTER (WHERE atom_name = 'CA' AND record = 'ATOM') AS ca_atoms FROM a GROUP BY chain",
    "a9_spatial_coverage": f"""{ATOMS} SELECT min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, count(*) AS observations, count(*) FILTER (WHERE chain < 5) AS in_tissue,
  (SELECT count(*) FROM a) AS total, round(count(*) / (SELECT count(*) FROM a), 9) AS exported_share FROM a WHERE chain <> 7""",
    "t9_circle_polygons": f"""{ATOMS} SELECT atom_id, k AS corner, round(x + 8 * cos((k % 16) * (2 * 3.141592653589793 / 16)), 3) AS px, round(y + 8 * sin((k % 16) * (2 * 3.141592653589793 / 16)), 3) AS py
FROM a, range(17) t(k)""",
}
