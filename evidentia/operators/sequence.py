"""Jobs over aligned sequences, reads, coding features and mutations.

Alignment rows: alignment_id, row_no, seq_id, sequence; `-` is a gap.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from evidentia.operators.packed import bit_planes, column_counts, compared_pairs, full_runs, position_sums

# The standard genetic code, codons in the order of bases TCAG.
BASES = "TCAG"
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


#: Columns of an alignment that travel together.
STRETCH = 64


def stretches(alignment: DataFrame) -> DataFrame:
    """Rows cut into pieces of STRETCH columns: alignment_id, row_no, seq_id, stretch (from 0), piece, before (residues of the
    row before the piece). A text is shuffled once, as pieces, and never letter by letter."""
    last = F.floor((F.length("sequence") - 1) / STRETCH)
    piece = lambda k: F.substring(F.col("sequence"), (k * STRETCH + 1).cast("int"), F.lit(STRETCH))
    pieces = F.transform(F.sequence(F.lit(0).cast("long"), last), lambda k: F.struct(k.alias("stretch"), piece(k).alias("piece")))
    rows = alignment.where(F.length("sequence") > 0).select("alignment_id", "row_no", "seq_id", F.inline(pieces))
    own = F.length(F.replace("piece", F.lit("-"), F.lit(""))).cast("long")
    so_far = Window.partitionBy("alignment_id", "row_no", "seq_id").orderBy("stretch")
    return rows.withColumn("before", F.sum(own).over(so_far) - own)


def p_distance(alignment: DataFrame) -> DataFrame:
    """Uncorrected distance of every pair of rows of an alignment: columns where both have a gap are skipped, a gap against
    a residue is a mismatch, the longer row's rest is left out; null where no column is compared. Rows are packed as bit planes, a long
    for 64 columns; a pair's stretches are compared by exclusive or and counts of bits. A null sequence counts as empty."""
    kinds = dict(alignment.dtypes)
    planes = bit_planes(alignment, ", ".join(f"{k} {kinds[k]}" for k in ("alignment_id", "row_no", "seq_id")))
    a, b = (planes.withColumnsRenamed({"row_no": f"row_{x}", "seq_id": f"seq_{x}", "longs": f"longs_{x}", "planes": f"planes_{x}"}) for x in "ij")
    pairs = a.join(b, ["alignment_id", "stretch"]).where("row_i < row_j")
    keys = {"alignment_id": "alignment_id", "row_i": "row_no", "row_j": "row_no", "seq_i": "seq_id", "seq_j": "seq_id"}
    found = compared_pairs(pairs, ", ".join(f"{name} {kinds[of]}" for name, of in keys.items()))
    sums = found.groupBy(*keys).agg(F.sum("compared").alias("compared"), F.sum("mismatches").alias("mismatches"))
    return sums.withColumn("distance", F.try_divide("mismatches", "compared"))


def triplet_branch_lengths(distances: DataFrame) -> DataFrame:
    """Branch lengths of the three-leaf tree of every triplet: of leaf i, (dij + dik - djk) / 2, and so on."""
    d = distances.select("alignment_id", "row_i", "row_j", "distance")
    ij = d.toDF("alignment_id", "i", "j", "dij")
    ik = d.toDF("alignment_id", "i", "k", "dik")
    jk = d.toDF("alignment_id", "j", "k", "djk")
    t = ij.join(ik, ["alignment_id", "i"]).join(jk, ["alignment_id", "j", "k"])
    return t.select(
        "alignment_id",
        "i",
        "j",
        "k",
        ((F.col("dij") + F.col("dik") - F.col("djk")) / 2).alias("branch_i"),
        ((F.col("dij") + F.col("djk") - F.col("dik")) / 2).alias("branch_j"),
        ((F.col("dik") + F.col("djk") - F.col("dij")) / 2).alias("branch_k"),
    )


def column_identity(alignment: DataFrame) -> DataFrame:
    """Per column: share of its most common residue among its residues; columns of gaps alone are left out."""
    return column_counts(alignment).withColumn("identity", F.col("top") / F.col("residues"))


def mean_identity(columns: DataFrame) -> DataFrame:
    return columns.groupBy("alignment_id").agg(F.avg("identity").alias("mean_identity"), F.count("*").alias("columns"))


def ungapped_positions(alignment: DataFrame, reference_row: int = 0) -> DataFrame:
    """Residue number of the reference row at each alignment column; null at its gaps."""
    rows = stretches(alignment.where(F.col("row_no") == reference_row))
    rows = rows.select("alignment_id", "stretch", "before", "piece", F.explode(F.sequence(F.lit(1), F.length("piece"))).alias("at"))
    residue = F.substring(F.col("piece"), F.col("at"), F.lit(1))
    number = F.col("before") + F.length(F.replace(F.substring(F.col("piece"), F.lit(1), F.col("at")), F.lit("-"), F.lit("")))
    rows = rows.select("alignment_id", (F.col("stretch") * STRETCH + F.col("at")).cast("int").alias("col"), residue.alias("residue"), number.alias("number"))
    return rows.select("alignment_id", "col", "residue", F.when(F.col("residue") != "-", F.col("number")).alias("position"))


def conserved_runs(alignment: DataFrame, min_length: int, reference_row: int = 0) -> DataFrame:
    """Maximal runs of columns with identity 1.0: first and last column, and the reference's residue numbers there."""
    # runs inside stretches of columns, those that meet at a border of two made one; columns themselves are never rows
    order = Window.partitionBy("alignment_id").orderBy("first_col")
    opens = F.coalesce(F.lag("last_col").over(order) + 1 != F.col("first_col"), F.lit(True))
    parts = full_runs(alignment, min_length).withColumn("opens", opens.cast("long")).withColumn("island", F.sum("opens").over(order))
    runs = parts.groupBy("alignment_id", "island").agg(F.min("first_col").alias("first_col"), F.max("last_col").alias("last_col"))
    runs = runs.withColumn("columns", F.col("last_col") - F.col("first_col") + 1).where(F.col("columns") >= min_length).drop("island")
    # the reference's residue number at a column, from the piece that holds it
    reference = stretches(alignment.where(F.col("row_no") == reference_row)).select("alignment_id", "stretch", "piece", "before")

    def numbered(rows: DataFrame, col: str, name: str) -> DataFrame:
        rows = rows.withColumn("stretch", F.floor((F.col(col) - 1) / STRETCH)).join(reference, ["alignment_id", "stretch"], "left")
        at = F.col(col) - F.col("stretch") * STRETCH
        here = F.substring(F.col("piece"), F.lit(1), at.cast("int"))
        number = F.col("before") + F.length(F.replace(here, F.lit("-"), F.lit("")))
        return rows.withColumn(name, F.when((F.length(here) == at) & ~here.endswith("-"), number)).drop("stretch", "piece", "before")

    return numbered(numbered(runs, "first_col", "ref_start"), "last_col", "ref_end")


def quality_at_least(quality: Column, q: int) -> Column:
    """Characters of a Phred+33 string that stand for q or more."""
    return F.regexp_count(quality, F.lit(f"[{chr(33 + q)}-~]"))


def read_quality(reads: DataFrame, *keys: str) -> DataFrame:
    """Records, bases, read lengths, GC and Q30 percent, weighted by bases."""
    n = F.length("seq").cast("long")
    gc = F.regexp_count("seq", F.lit("[GCgc]")).cast("long")
    q30 = quality_at_least(F.col("qual"), 30).cast("long")
    return reads.groupBy(*keys).agg(
        F.count("*").alias("records"),
        F.sum(n).alias("bases"),
        F.min(n).alias("read_length_min"),
        F.max(n).alias("read_length_max"),
        F.try_divide(100 * F.sum(gc), F.sum(n)).alias("gc_percent"),
        F.try_divide(100 * F.sum(q30), F.sum(n)).alias("q30_percent"),
    )


def per_base_quality(reads: DataFrame) -> DataFrame:
    """Per position (from 1): reads that reach it, mean quality (Phred+33), share of G and C, share of Q30."""
    sums = position_sums(reads).groupBy("position").agg(*(F.sum(c).alias(c) for c in ("reads", "bases", "gc", "qualities", "quality", "q30")))
    means = (F.try_divide(x, n).alias(name) for x, n, name in (("quality", "qualities", "mean_quality"), ("gc", "bases", "gc"), ("q30", "qualities", "q30")))
    return sums.select("position", "reads", *means)


def length_histogram(reads: DataFrame, bin_size: int = 1) -> DataFrame:
    """Reads per length, in bins that begin at multiples of bin_size."""
    return reads.groupBy((F.floor(F.length("seq") / bin_size) * bin_size).cast("long").alias("length")).agg(F.count("*").alias("reads"))


def duplicate_rate(reads: DataFrame) -> DataFrame:
    """One row: reads, distinct sequences, share of reads that repeat another one."""
    kinds = reads.groupBy("seq").count()
    return kinds.agg(F.sum("count").alias("reads"), F.count("*").alias("distinct_reads")).withColumn(
        "duplicate_rate",
        F.try_divide(F.col("reads") - F.col("distinct_reads"), F.col("reads")),
    )


def first_n(records: DataFrame, n: int, key: str, *order: str) -> DataFrame:
    """The first n records of each file by their ordinal."""
    return records.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")


@F.pandas_udf(StringType())
def translated(coding: pd.Series) -> pd.Series:
    """Amino acids of the whole codons of a text, one after the other; X for a codon with another letter. Each letter is looked at once."""
    code = np.full(256, 64, np.int16)
    code[[ord(b) for b in BASES]] = np.arange(4)
    acids = np.frombuffer((AMINO_ACIDS + "X").encode(), np.uint8)

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        x = code[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)][: len(text) // 3 * 3].reshape(-1, 3)
        return acids[np.minimum(x @ np.array([16, 4, 1], np.int16), 64)].tobytes().decode()

    return pd.Series([one(t) for t in coding], dtype=object)


#: Letters of bases, with those that stand for several, and their complements.
LETTERS, COMPLEMENTS = "ACGTURYKMBDHVSWN", "TGCAAYRMKVHDBSWN"


def spliced(sequence: Column, exons: Column) -> Column:
    """The bases of exons (start, end, complement) one after the other, each turned round and over where it lies on the other strand."""
    cut = lambda e: F.substring(sequence, e["start"], e["end"] - e["start"] + 1)
    return F.array_join(F.transform(exons, lambda e: F.when(e["complement"], F.reverse(F.translate(cut(e), LETTERS, COMPLEMENTS))).otherwise(cut(e))), "")


def cds_translation_check(features: DataFrame, genomes: DataFrame) -> DataFrame:
    """features (accession, feature_no, exons, translation; or start, end and complement for one exon; codon_start, 1 if absent or
    null) against genomes (accession, sequence): splice, start at codon_start, translate, drop a terminal stop, compare. A null
    translation gives a null ok."""
    one = F.array(F.struct("start", "end", "complement")) if "exons" not in features.columns else F.col("exons")
    first = F.coalesce("codon_start", F.lit(1)) if "codon_start" in features.columns else F.lit(1)
    rows = features.withColumns({"_exons": one, "_first": first}).join(genomes.select("accession", F.upper("sequence").alias("sequence")), "accession")
    rows = rows.withColumn("dna", spliced(F.col("sequence"), F.col("_exons")))
    coding = F.substring(F.col("dna"), F.col("_first").cast("int"), F.length("dna"))
    rows = rows.withColumn("protein", F.regexp_replace(translated(coding), r"\*$", ""))
    return rows.select(
        "accession",
        "feature_no",
        F.length("dna").cast("long").alias("bases"),
        F.length("protein").cast("long").alias("residues"),
        F.sha2("protein", 256).alias("protein_sha256"),
        (F.col("protein") == F.col("translation")).alias("ok"),
    )


def mutation_check(candidates: DataFrame, parents: DataFrame) -> DataFrame:
    """candidates (candidate, parent, mutations as A1B;C2D or WT, sequence) against parents (parent, parent_sequence): the
    wild-type residue of each mutation, the mutated sequence, length and cysteines."""
    rows = candidates.join(parents, "parent")
    edits = F.filter(F.split(F.coalesce("mutations", F.lit("WT")), ";"), lambda m: (m != "WT") & (m != ""))
    place = lambda m: F.regexp_extract(m, r"^.(\d+).$", 1).try_cast("int")
    rows = rows.withColumn("edits", edits)
    fits = F.forall("edits", lambda m: F.coalesce(F.substring(F.col("parent_sequence"), place(m), F.lit(1)) == m.substr(1, 1), F.lit(False)))
    applied = F.aggregate(
        "edits",
        F.col("parent_sequence"),
        lambda s,
        m: F.concat(F.substring(s, F.lit(1), place(m) - 1), F.right(m, F.lit(1)), F.substring(s, place(m) + 1, F.length(s))),
    )
    return rows.select(
        "candidate",
        F.size("edits").cast("long").alias("n_mutations"),
        fits.alias("wild_type_ok"),
        (applied == F.col("sequence")).alias("sequence_ok"),
        F.length("sequence").cast("long").alias("length"),
        F.regexp_count("sequence", F.lit("C")).cast("long").alias("cysteines"),
    )
