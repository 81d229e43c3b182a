"""Sequence queries. Alignments are groups of four `documents`, whole
texts filled up with gaps to the longest of the group; reads are `conversations`; mutations are
written against `part` names."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evidentia.operators import sequence as sq
from evidentia.plans.streams import folder
from evidentia.sources import fastq


def alignment(spark, d):
    t = spark.read.parquet(f"{d}/documents.parquet")
    text = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]", "-")
    rows = t.select(
        F.floor(F.col("doc_id") / 4).alias("alignment_id"),
        (F.col("doc_id") % 4).alias("row_no"),
        F.col("doc_id").alias("seq_id"),
        text.alias("sequence"),
    )
    longest = F.max(F.length("sequence")).over(Window.partitionBy("alignment_id"))
    return rows.withColumn("sequence", F.rpad("sequence", longest, F.lit("-")))


def reads(spark, d):
    return spark.read.parquet(f"{d}/conversations.parquet").select(
        (F.col("conv_id") % 10).alias("file"),
        "conv_id",
        "turn",
        F.col("text").alias("seq"),
        F.col("text").alias("qual"),
    )


LETTERS = "abcdefghijklmnopqrstuvwxyz"
AS_BASES = ("ACGT" * 7)[:26]


def cds(spark, d):
    """A spliced feature of each document: two exons, on the other strand for odd ones, read from the first to third base by codon_start. Every
    third translation is right, every third is one residue too long, the others are missing."""
    t = spark.read.parquet(f"{d}/documents.parquet").select(
        F.col("doc_id").alias("accession"),
        F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), LETTERS, AS_BASES).alias("sequence"),
    )
    n, odd = F.length("sequence"), F.col("accession") % 2 == 1
    exon = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), odd.alias("complement"))
    one, two = exon(F.lit(4), F.floor(n / 2)), exon(F.floor(n / 2) + 10, n)
    t = t.where("sequence IS NOT NULL")
    # the features' translations come from a table that other tools would have written: here from SQL text functions,
    # codon by codon, so that no place is looked for from the start of a long text again
    dna = F.concat(F.substring("sequence", F.lit(4), F.floor(n / 2).cast("int") - 3), F.substring("sequence", (F.floor(n / 2) + 10).cast("int"), n))
    first = (F.col("accession") % 3 + 1).cast("int")
    rows = t.where(n >= 40).withColumn("dna", F.when(odd, F.reverse(F.translate(dna, "ACGT", "TGCA"))).otherwise(dna))
    rows = rows.withColumn("dna", F.substring("dna", first, F.length("dna")))
    acid = F.expr("transform(regexp_extract_all(dna, '...', 0), c -> substring('" + sq.AMINO_ACIDS + "', 1 + 16 * (locate(substring(c, 1, 1), 'TCAG') - 1) + 4 * (locate(substring(c, 2, 1), 'TCAG') - 1) + locate(substring(c, 3, 1), 'TCAG') - 1, 1))")
    protein = F.regexp_replace(F.array_join(acid, ""), r"\*$", "")
    said = F.when(F.col("accession") % 3 == 0, protein).when(F.col("accession") % 3 == 1, F.concat(protein, F.lit("M")))
    f = rows.select("accession", F.lit(1).alias("feature_no"), F.when(odd, F.array(two, one)).otherwise(F.array(one, two)).alias("exons"), said.alias("translation"), first.alias("codon_start"))
    return sq.cds_translation_check(f, t)


def fastq_records(s, d):
    """Conversations as FASTQ files that Spark writes and the FASTQ source reads back, in ranges: letters A, C, G and T of a turn, with the
    first ones' quality by their number."""
    at = folder(s)
    n = F.length("seq")
    rows = s.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", F.regexp_replace(F.upper(F.coalesce("text", F.lit(""))), "[^ACGT]", "").alias("seq"))
    qual = F.rpad(F.repeat(F.lit("@"), (n % 5).cast("int")), n, F.lit("I"))
    record = F.concat_ws("\n", F.concat(F.lit("@"), F.concat_ws(":", "conv_id", "turn")), "seq", F.lit("+"), F.when(n > 0, qual).otherwise(""))
    rows.select(record.alias("value")).write.text(f"{at}/reads")
    return fastq.load_fastq(s, f"{at}/reads/part-*", 16 << 10)


def fastq_reads(s, d):
    """Reads of each name, and whether the numbers of each file run from 1 on."""
    reads = fastq_records(s, d)
    whole = F.max("record_no") == F.count("*")
    files = reads.groupBy("path").agg(whole.alias("numbered"), F.count("*").alias("n")).agg(F.bool_and("numbered").alias("numbered"))
    return reads.select("name", "seq", F.col("qual").alias("quality")).join(F.broadcast(files))  # files: one row


def mutations(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.upper("p_name").alias("n"), "p_size")
    wrong = F.when(F.col("p_size") % 3 == 0, F.lit("#")).otherwise(F.substring("n", 3, 1))
    m = F.when(F.col("p_size") % 5 == 0, F.lit("WT")).otherwise(F.concat(F.substring("n", 1, 1), F.lit("1C;"), wrong, F.lit("3W")))
    got = F.when(F.col("p_size") % 5 == 0, F.col("n")).otherwise(F.concat(
        F.lit("C"),
        F.substring("n", 2, 1),
        F.lit("W"),
        F.substring(F.col("n"), F.lit(4), F.length("n")),
    ))
    got = F.when(F.col("p_size") % 7 == 0, F.concat(got, F.lit("C"))).otherwise(got)
    c = p.select(F.col("p_partkey").alias("candidate"), F.col("p_partkey").alias("parent"), m.alias("mutations"), got.alias("sequence"))
    return sq.mutation_check(c, p.select(F.col("p_partkey").alias("parent"), F.col("n").alias("parent_sequence")))


QUERIES = {
    "s5_load_fastq": fastq_reads,
    "j9_p_distance": lambda s, d: sq.p_distance(alignment(s, d)).select(
        "alignment_id",
        "seq_i",
        "seq_j",
        "compared",
        "mismatches",
        F.round("distance", 6).alias("distance"),
    ),
    "j10_triplet_branches": lambda s, d: sq.triplet_branch_lengths(sq.p_distance(alignment(s, d))).select(
        "alignment_id",
        "i",
        "j",
        "k",
        *(F.round(f"branch_{x}", 6).alias(f"branch_{x}") for x in "ijk"),
    ),
    "a5_column_identity": lambda s, d: sq.mean_identity(sq.column_identity(alignment(s, d))).select(
        "alignment_id",
        "columns",
        F.round("mean_identity", 6).alias("mean_identity"),
    ),
    "w7_ungapped_positions": lambda s, d: sq.ungapped_positions(alignment(s, d)).groupBy("alignment_id").agg(
        F.count("*").alias("columns"),
        F.max("position").alias("residues"),
        F.sum(F.col("col") * F.col("position")).alias("weighted"),
    ),
    "w8_conserved_runs": lambda s, d: sq.conserved_runs(alignment(s, d), 2).select(
        "alignment_id",
        *(F.col(c).cast("long").alias(c) for c in ("first_col", "last_col", "columns", "ref_start", "ref_end")),
    ),
    "a3_read_quality": lambda s, d: sq.read_quality(reads(s, d), "file").withColumns({c: F.round(c, 6) for c in ("gc_percent", "q30_percent")}),
    "a4_per_base_quality": lambda s, d: sq.per_base_quality(reads(s, d)).withColumns({c: F.round(c, 6) for c in ("mean_quality", "gc", "q30")}),
    "a4_length_histogram": lambda s, d: sq.length_histogram(reads(s, d), 50),
    "a4_duplicate_rate": lambda s, d: sq.duplicate_rate(reads(s, d)).withColumn("duplicate_rate", F.round("duplicate_rate", 6)),
    "w1_first_n": lambda s, d: sq.first_n(reads(s, d).select("conv_id", "turn"), 2, "conv_id", "turn"),
    "t7_cds_translation": cds,
    "t8_mutation_check": mutations,
}

# Alignments have four rows, so SQL puts them side by side and splits each text once.
AL = """WITH a AS (SELECT doc_id // 4 AS alignment_id, doc_id % 4 AS row_no, doc_id AS seq_id, regexp_replace(lower(coalesce(text, '')), '[^a-z]', '-', 'g') AS s FROM documents),
f AS (SELECT alignment_id, row_no, seq_id, rpad(s, (max(length(s)) OVER (PARTITION BY alignment_id))::INTEGER, '-') AS s FROM a)"""
SIDE = f"""{AL}, g AS (SELECT alignment_id, max(s) FILTER (WHERE row_no = 0) AS s0, max(s) FILTER (WHERE row_no = 1) AS s1, max(s) FILTER (WHERE row_no = 2) AS s2, max(s) FILTER (WHERE row_no = 3) AS s3 FROM f GROUP BY alignment_id),
c AS (SELECT alignment_id, unnest(range(1, greatest(length(s0), length(s1), length(s2), length(s3)) + 1)) AS col, unnest(string_split(s0, '')) AS r0, unnest(string_split(s1, '')) AS r1, unnest(string_split(s2, '')) AS r2, unnest(string_split(s3, '')) AS r3 FROM g)"""
PAIRS = ", ".join(f"({x}, {y})" for x in range(4) for y in range(x + 1, 4))
DIST = f"""{SIDE}, d AS (SELECT alignment_id, i, j, count(*) AS compared, count(*) FILTER (WHERE x <> y) AS mismatches FROM (
  {" UNION ALL ".join(f"SELECT alignment_id, {x} AS i, {y} AS j, r{x} AS x, r{y} AS y FROM c WHERE r{x} IS NOT NULL AND r{y} IS NOT NULL AND NOT (r{x} = '-' AND r{y} = '-')" for x in range(4) for y in range(x + 1, 4))}) GROUP BY ALL)"""
IDENT = """n AS (SELECT alignment_id, col, list_filter([r0, r1, r2, r3], lambda r: r IS NOT NULL AND r <> '-') AS r FROM c),
i AS (SELECT alignment_id, col, list_max(list_transform(r, lambda x: len(list_filter(r, lambda y: y = x)))) AS top, len(r) AS residues FROM n WHERE len(r) > 0)"""
POS = """u AS (SELECT alignment_id, col, CASE WHEN r0 <> '-' THEN (sum(CASE WHEN r0 <> '-' THEN 1 ELSE 0 END) OVER (PARTITION BY alignment_id ORDER BY col))::BIGINT END AS position FROM c WHERE r0 IS NOT NULL)"""

SQL = {
    "j9_p_distance": f"""{DIST} SELECT alignment_id, 4 * alignment_id + i AS seq_i, 4 * alignment_id + j AS seq_j, compared, mismatches, round(mismatches / compared, 6) AS distance
FROM d""",
    "j10_triplet_branches": f"""{DIST}, e AS (SELECT *, mismatches / compared AS q FROM d)
SELECT x.alignment_id, x.i, x.j, z.j AS k, round((x.q + y.q - z.q) / 2, 6) AS branch_i, round((x.q + z.q - y.q) / 2, 6) AS branch_j, round((y.q + z.q - x.q) / 2, 6) AS branch_k
FROM e x JOIN e y ON x.alignment_id = y.alignment_id AND x.i = y.i JOIN e z ON z.alignment_id = x.alignment_id AND z.i = x.j AND z.j = y.j""",
    "a5_column_identity": f"{SIDE}, {IDENT} SELECT alignment_id, count(*) AS columns, round(avg(top / residues), 6) AS mean_identity FROM i GROUP BY alignment_id",
    "w7_ungapped_positions": f"""{SIDE}, {POS} SELECT alignment_id, count(*) AS columns, max(position) AS residues, sum(col * position)::BIGINT AS weighted
FROM u
GROUP BY alignment_id""",
    "w8_conserved_runs": f"""{SIDE}, {IDENT}, {POS}, h AS (SELECT alignment_id, col, col - row_number() OVER (PARTITION BY alignment_id ORDER BY col) AS island FROM i WHERE top = residues),
r AS (SELECT alignment_id, min(col) AS first_col, max(col) AS last_col, count(*) AS columns FROM h GROUP BY alignment_id, island HAVING count(*) >= 2)
SELECT r.*, x.position AS ref_start, y.position AS ref_end FROM r LEFT JOIN u x ON x.alignment_id = r.alignment_id AND x.col = first_col LEFT JOIN u y ON y.alignment_id = r.alignment_id AND y.col = last_col""",
    "a3_read_quality": """SELECT conv_id % 10 AS file, count(*) AS records, sum(length(text))::BIGINT AS bases, min(length(text)) AS read_length_min, max(length(text)) AS read_length_max,
round(100 * sum(len(regexp_extract_all(text, '[GCgc]'))) / sum(length(text)), 6) AS gc_percent, round(100 * sum(len(regexp_extract_all(text, '[?-~]'))) / sum(length(text)), 6) AS q30_percent FROM conversations GROUP BY 1""",
    "a4_per_base_quality": """WITH x AS (SELECT generate_subscripts(string_split(text, ''), 1) AS position, unnest(string_split(text, '')) AS b FROM conversations WHERE text <> '')
SELECT position, count(*) AS reads, round(avg(unicode(b) - 33), 6) AS mean_quality, round(avg(CASE WHEN regexp_matches(b, '[GCgc]') THEN 1 ELSE 0 END), 6) AS gc, round(avg(CASE WHEN unicode(b) >= 63 THEN 1 ELSE 0 END), 6) AS q30 FROM x GROUP BY 1""",
    "a4_length_histogram": "SELECT length(text) // 50 * 50 AS length, count(*) AS reads FROM conversations GROUP BY 1",
    "a4_duplicate_rate": """SELECT count(*) AS reads, count(DISTINCT text) AS distinct_reads, round((count(*) - count(DISTINCT text)) / count(*), 6) AS duplicate_rate
FROM conversations""",
    "w1_first_n": "SELECT conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 2",
    "t7_cds_translation": f"""WITH s AS (SELECT doc_id AS accession, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '{LETTERS}', '{AS_BASES}') AS x FROM documents),
j AS (SELECT accession, substr(x, 4, length(x) // 2 - 3) || substr(x, length(x) // 2 + 10) AS x FROM s WHERE length(x) >= 40),
r AS (SELECT accession, length(x) AS bases, substr(CASE WHEN accession % 2 = 1 THEN reverse(translate(x, 'ACGT', 'TGCA')) ELSE x END, (accession % 3 + 1)::INTEGER) AS dna FROM j),
p AS (SELECT accession, bases, regexp_replace(array_to_string(list_transform(regexp_extract_all(dna, '...'), lambda c: substr('{sq.AMINO_ACIDS}', (16 * (strpos('TCAG', c[1:1]) - 1) + 4 * (strpos('TCAG', c[2:2]) - 1) + strpos('TCAG', c[3:3]))::INTEGER, 1)), ''), '\\*$', '') AS protein FROM r)
SELECT accession, 1 AS feature_no, bases, length(protein) AS residues, sha256(protein) AS protein_sha256, CASE accession % 3 WHEN 0 THEN true WHEN 1 THEN false END AS ok FROM p""",
    "s5_load_fastq": """WITH r AS (SELECT conv_id || ':' || turn AS name, regexp_replace(upper(coalesce(text, '')), '[^ACGT]', '', 'g') AS seq FROM conversations)
SELECT name, seq, CASE WHEN length(seq) > 0 THEN rpad(repeat('@', length(seq) % 5), length(seq)::INTEGER, 'I') ELSE '' END AS quality, true AS numbered FROM r""",
    "t8_mutation_check": """WITH p AS (SELECT p_partkey, upper(p_name) AS n, p_size, CASE WHEN p_size % 5 = 0 THEN upper(p_name) ELSE 'C' || upper(p_name)[2:2] || 'W' || substr(upper(p_name), 4) END || CASE WHEN p_size % 7 = 0 THEN 'C' ELSE '' END AS got FROM part)
SELECT p_partkey AS candidate, CASE WHEN p_size % 5 = 0 THEN 0 ELSE 2 END::BIGINT AS n_mutations, p_size % 5 = 0 OR (p_size % 3 <> 0 AND length(n) >= 3) AS wild_type_ok, p_size % 7 <> 0 AS sequence_ok,
length(got) AS length, length(regexp_replace(got, '[^C]', '', 'g')) AS cysteines FROM p""",
}
