"""Jobs over atoms and points: distance joins, contacts, counts, coverage, outlines.

Atoms: structure, atom_id, chain, residue, x, y, z. Rows with a null coordinate take part in no distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def squared_distance() -> Column:
    """Of a joined row with coordinates lx, ly, lz and rx, ry, rz."""
    d = [F.col(f"l{c}") - F.col(f"r{c}") for c in "xyz"]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


#: Atoms of a cell that are taken as they are; a denser cell is split. Splits in two along each axis, at most.
DENSE, DEPTH = 512, 5


def _with_cells(df: DataFrame, mark: str, edge: float) -> DataFrame:
    """Columns named by mark, with `_f`, the cell of the finest level, and `_p`, that of the coarsest. A cell's place at a level follows
    from the finest by shifts, so cells nest exactly."""
    df = df.where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")
    own = df.select("structure", *(F.col(c).alias(mark + c) for c in df.columns if c != "structure"))
    fine = F.struct(*(F.floor(F.col(mark + c) / (edge / (1 << DEPTH))).alias(c) for c in "xyz"))
    return own.withColumn("_f", fine).withColumn("_p", _prefix(F.col("_f"), F.lit(0)))


def _prefix(fine: Column, level: Column) -> Column:
    """The cell of a level that holds a finest cell."""
    return F.struct(level.cast("int").alias("level"), *(F.floor(fine[c] / F.pow(F.lit(2.0), DEPTH - level)).cast("long").alias(c) for c in "xyz"))


def dense_cells(side: DataFrame, dense: int = DENSE) -> tuple[DataFrame, DataFrame]:
    """The octree below cells with more than `dense` rows: (structure, _f, _cell) for every occupied finest cell, and (structure,
    _p, _cell) for every leaf. A leaf is the first cell on the way down with no more than `dense` rows, or one of the last level.
    It is built of counts; a cell's counts are at most 8 ** DEPTH rows."""
    crowded = side.groupBy("structure", "_p").agg(F.count("*").alias("n")).where(F.col("n") > dense).select("structure", "_p")
    fine = side.join(crowded, ["structure", "_p"], "left_semi").groupBy("structure", "_p", "_f").agg(F.count("*").alias("n"))
    levels = fine.withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(DEPTH)))).withColumn("_cell", _prefix(F.col("_f"), F.col("level")))
    inside = F.sum("n").over(Window.partitionBy("structure", "_p", "_cell"))
    fits = F.when((F.col("inside") <= dense) | (F.col("level") == DEPTH), F.struct("level", "_cell"))
    leaves = levels.withColumn("inside", inside).groupBy("structure", "_p", "_f").agg(F.min(fits).alias("leaf")).select("structure", "_p", "_f", "leaf._cell")
    return leaves.select("structure", "_f", "_cell"), leaves.select("structure", "_p", "_cell").distinct()


def _in_reach(mark: str, cell: Column, edge: float, cutoff: float) -> Column:
    """Whether a point lies within the cutoff of a cell, or just beyond."""
    step = edge / F.pow(F.lit(2.0), cell["level"])
    gaps = [F.greatest(F.lit(0.0), cell[c] * step - F.col(mark + c), F.col(mark + c) - (cell[c] + 1) * step) for c in "xyz"]
    return sum((g * g for g in gaps[1:]), gaps[0] * gaps[0]) <= (cutoff * (1 + 1e-6)) ** 2


def _around(df: DataFrame) -> DataFrame:
    """Each row in the 27 coarsest cells around its own, as `_t`."""
    steps = F.array(F.lit(-1), F.lit(0), F.lit(1))
    for c in "xyz":
        df = df.withColumn(f"_{c}", F.explode(steps))
    to = F.struct(F.lit(0).alias("level"), *((F.col("_p")[c] + F.col(f"_{c}")).alias(c) for c in "xyz"))
    return df.withColumn("_t", to).drop("_x", "_y", "_z")


def dealt_pairs(left: DataFrame, right: DataFrame, cutoff: float, dense: int = DENSE) -> tuple[DataFrame, DataFrame]:
    """Both sides of distance_join() with `_left` and `_right`, a pair of cells in which they meet."""
    edge = cutoff * (1 + 1e-9)
    a, b = _with_cells(left, "l", edge), _with_cells(right, "r", edge)
    (a_of, a_leaves), (b_of, b_leaves) = dense_cells(a, dense), dense_cells(b, dense)
    none = F.lit(None).cast("struct<level:int,x:bigint,y:bigint,z:bigint>")
    key = lambda c: F.coalesce(F.concat_ws(":", *(c[x].cast("string") for x in ("level", "x", "y", "z"))), F.lit(""))
    # a right row goes to the left cells around it: the leaves in reach of a crowded one, else the cell; its own leaf goes along
    b = b.join(b_of.withColumnRenamed("_cell", "_own"), ["structure", "_f"], "left")
    b = _around(b).join(a_leaves.withColumnRenamed("_p", "_t"), ["structure", "_t"], "left")
    b = b.where(F.col("_cell").isNull() | _in_reach("r", F.col("_cell"), edge, cutoff))
    b = b.withColumns({"_left": key(F.coalesce("_cell", "_t")), "_right": F.when(F.col("_own").isNull(), "").otherwise(key(F.col("_own")))})
    # a left row meets the right rows of cells that are not crowded, and each right leaf in its reach apart
    a = a.join(a_of, ["structure", "_f"], "left").withColumn("_left", key(F.coalesce("_cell", "_p"))).drop("_cell")
    near = _around(a).join(b_leaves.withColumnRenamed("_p", "_t"), ["structure", "_t"])
    near = near.where(_in_reach("l", F.col("_cell"), edge, cutoff)).withColumn("_right", key(F.col("_cell"))).drop("_t", "_cell")
    a = a.withColumn("_right", F.lit("")).unionByName(near)
    return a.drop("_f", "_p"), b.drop("_f", "_p", "_t", "_own", "_cell")


def distance_join(left: DataFrame, right: DataFrame, cutoff: float, dense: int = DENSE) -> DataFrame:
    """All pairs of one structure with squared distance <= cutoff squared (inclusive), as an equi-join on cells of an adaptive grid.

    The coarsest cells have an edge slightly above the cutoff, so a pair lies in neighbouring ones. A cell with more than `dense` rows of
    a side is split by an octree of that side's counts, and its rows meet the other side leaf by leaf: a key has at most `dense` rows of a
    crowded side, however many a cell has. Each pair meets once: in the left row's leaf and, where the right row's cell is crowded, in
    that row's leaf. Rows at one point share a leaf; only AQE splits these. Left columns are named l<name>, right ones r<name>."""
    a, b = dealt_pairs(left, right, cutoff, dense)
    pairs = a.join(b, ["structure", "_left", "_right"]).withColumn("d2", squared_distance())
    return pairs.where(F.col("d2") <= cutoff * cutoff).drop("_left", "_right")


def contacts(atoms: DataFrame, left: Column, right: Column, cutoff: float) -> DataFrame:
    """Atom contacts between two selections of one table."""
    return distance_join(atoms.where(left), atoms.where(right), cutoff)


def contact_summary(pairs: DataFrame, *keys: str) -> DataFrame:
    """Per keys: atom contacts and distinct residue pairs."""
    return pairs.groupBy(*keys).agg(F.count("*").alias("contacts"), F.countDistinct("lresidue", "rresidue").alias("residue_pairs"))


def residues_near(atoms: DataFrame, ligand: Column, cutoff: float) -> DataFrame:
    """Residues with a heavy atom within cutoff of a heavy atom of the ligand: closest distance. Hydrogens are told by is_hydrogen()
    where the atoms have an atom_name."""
    heavy = atoms.where(~is_hydrogen()) if "atom_name" in atoms.columns else atoms
    near = distance_join(heavy.where(~ligand), heavy.where(ligand), cutoff)
    return near.groupBy("structure", F.col("lresidue").alias("residue")).agg(F.sqrt(F.min("d2")).alias("distance"))


def is_hydrogen() -> Column:
    """Whether atom_name is that of a hydrogen or deuterium: H or D after digits at most. Metals whose symbols begin with H (HG, HF, HO)
    are named like hydrogens HG, HF and HO of residues, and count as these."""
    return F.upper(F.coalesce("atom_name", F.lit(""))).rlike(r"^[0-9]*[HD]")


def atom_counts(atoms: DataFrame, *keys: str) -> DataFrame:
    """Atoms and alpha carbons per keys. An alpha carbon is a CA of an ATOM record; the CA of a HETATM is calcium. Alternate locations and
    models count as they stand."""
    alpha = (F.col("record") == "ATOM") & (F.col("atom_name") == "CA")
    return atoms.groupBy(*keys).agg(F.count("*").alias("atoms"), F.count_if(alpha).alias("ca_atoms"))


def spatial_coverage(observations: DataFrame, total: DataFrame | None = None) -> DataFrame:
    """One row: coordinate bounds, observations, how many lie in tissue, and, with the table `total` that they were exported from, its
    rows and the share that was exported (null for an empty one)."""
    out = observations.agg(
        *(f(c).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("min", F.min), ("max", F.max))),
        F.count("*").alias("observations"),
        F.count_if("in_tissue").alias("in_tissue"),
    )
    if total is None:
        return out
    out = out.join(F.broadcast(total.agg(F.count("*").alias("total"))))  # one row
    return out.withColumn("exported_share", F.try_divide("observations", "total"))


def circle_polygons(points: DataFrame, radius: float, segments: int) -> DataFrame:
    """A closed ring of `segments` sides around each point, corners rounded to 3 decimals."""
    angle = lambda k: k * (2 * 3.141592653589793 / segments)
    ring = F.transform(
        F.sequence(F.lit(0), F.lit(segments)),
        lambda k: F.array(F.round(F.col("x") + radius * F.cos(angle(k % segments)), 3), F.round(F.col("y") + radius * F.sin(angle(k % segments)), 3)),
    )
    return points.withColumn("ring", ring)
