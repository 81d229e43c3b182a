"""File readers on small literal files."""

import hashlib
import json

import pytest

from evidentia.operators import checks as ck
from evidentia.operators import sequence as sq
from evidentia.operators import structure as st
from evidentia.sources import fastq, files


def test_fasta_and_p_distance(spark, tmp_path):
    (tmp_path / "a.aln-fasta").write_text(">s1 first\nAC-T\nAA\n>s2\nACGT\nA-\n")
    rows = {r["id"]: r for r in files.load_fasta(spark, str(tmp_path / "a.aln-fasta")).collect()}
    assert rows["s1"]["sequence"] == "AC-TAA" and rows["s1"]["header"] == "s1 first" and rows["s2"]["sequence"] == "ACGTA-"
    al = spark.createDataFrame(
        [(1, 0, "s1", "AC-TAA-"), (1, 1, "s2", "ACGTA--"), (1, 2, "s3", "-------")],
        "alignment_id int, row_no int, seq_id string, sequence string",
    )
    got = {(r["row_i"], r["row_j"]): (r["compared"], r["mismatches"]) for r in sq.p_distance(al).collect()}
    assert got == {(0, 1): (6, 2), (0, 2): (5, 5), (1, 2): (5, 5)}


def test_fastq(spark, tmp_path):
    (tmp_path / "r.fastq").write_text("@a\nACGT\n+\nII?>\n@b\nGG\n+\n!!\n")
    reads = fastq.load_fastq(spark, str(tmp_path / "r.fastq"))
    q = sq.read_quality(reads).first()
    assert (
        q["records"],
        q["bases"],
        q["read_length_min"],
        q["read_length_max"],
    ) == (2, 6, 2, 4) and round(q["q30_percent"], 3) == 50.0 and round(q["gc_percent"], 3) == 66.667
    (tmp_path / "bad.fastq").write_text("@a\nACGT\n+\nII\n")
    with pytest.raises(Exception, match="damaged FASTQ"):
        fastq.load_fastq(spark, str(tmp_path / "bad.fastq")).collect()


def test_pdb_mmcif_and_contacts(spark, tmp_path):
    line = "{:<6}{:>5} {:<4}{:1}{:>3} {:1}{:>4}{:1}   {:>8}{:>8}{:>8}\n"
    (tmp_path / "x.pdb").write_text(line.format("ATOM", 1, "CA", "", "GLY", "A", 1, "", "1.000", "2.000", "3.000") + line.format(
        "HETATM",
        2,
        "O",
        "",
        "HOH",
        "B",
        2,
        "A",
        "1.000",
        "2.000",
        "7.000",
    ) + line.format("ATOM", 3, "N", "", "GLY", "B", 3, "", "", "", "") + "END\n")
    rows = files.load_pdb_atoms(spark, str(tmp_path / "x.pdb")).collect()
    assert [(r["chain"], r["res_seq"], r["x"]) for r in rows] == [("A", "1", 1.0), ("B", "2A", 1.0), ("B", "3", None)]
    atoms = spark.createDataFrame(
        [(0, i, r["chain"], f"{r['res_name']}:{r['res_seq']}", r["x"], r["y"], r["z"]) for i, r in enumerate(rows)],
        "structure int, atom_id int, chain string, residue string, x double, y double, z double",
    )
    from pyspark.sql import functions as F

    pairs = st.contacts(atoms, F.col("chain") == "A", F.col("chain") == "B", 4.0)
    assert [r["d2"] for r in pairs.collect()] == [16.0]
    (tmp_path / "m.cif").write_text("loop_\n_atom_site.group_PDB\n_atom_site.id\n_atom_site.label_atom_id\n_atom_site.label_comp_id\n_atom_site.auth_asym_id\n_atom_site.auth_seq_id\n_atom_site.Cartn_x\n_atom_site.Cartn_y\n_atom_site.Cartn_z\nATOM 1 CA GLY A 5 1.5 2.5 -3\n#\n")
    m = files.load_mmcif_atoms(spark, str(tmp_path / "m.cif")).first()
    assert (m["atom_name"], m["res_name"], m["chain"], m["res_seq"], m["z"], m["alt_loc"]) == ("CA", "GLY", "A", "5", -3.0, None)


def test_genbank(spark, tmp_path):
    text = "LOCUS       X 12 bp\nACCESSION   X1\nFEATURES             Location/Qualifiers\n     CDS             complement(4..9)\n                     /gene=\"cI\"\n                     /translation=\"MK\n                     L\"\nORIGIN\n        1 acgtacgtac gt\n//\n"
    (tmp_path / "x.gb").write_text(text)
    r = files.load_genbank_features(spark, str(tmp_path / "x.gb")).first()
    assert (
        r["accession"],
        r["type"],
        r["complement"],
        r["start"],
        r["end"],
    ) == ("X1", "CDS", True, 4, 9) and r["qualifiers"] == {"gene": ["cI"], "translation": ["MKL"]}
    assert [tuple(x) for x in files.load_genbank_records(spark, str(tmp_path / "x.gb")).collect()] == [("X1", "acgtacgtacgt")]


def test_mmcif_values_with_blanks(spark, tmp_path):
    (tmp_path / "q.cif").write_text("loop_\n_atom_site.group_PDB\n_atom_site.label_comp_id\n_atom_site.label_atom_id\n_atom_site.Cartn_x\nATOM 'A B' \"C5'\" 1.5\nHETATM 'it's' . ?\n#\n")
    rows = files.load_mmcif_atoms(spark, str(tmp_path / "q.cif")).collect()
    assert {(r["res_name"], r["atom_name"], r["x"]) for r in rows} == {("A B", "C5'", 1.5), ("it's", None, None)}


def test_fastq_in_pieces_and_gzip(spark, tmp_path):
    import gzip

    text = "".join(f"@r{k}\n{'ACGT' * (k % 3)}\n+\n{'IIII' * (k % 3)}\n" for k in range(25))
    (tmp_path / "r.fastq.gz").write_bytes(gzip.compress(text.encode()))
    rows = fastq.load_fastq(spark, str(tmp_path / "r.fastq.gz"), 100).collect()
    assert [(r["record_no"], r["name"], len(r["seq"])) for r in rows] == [(k + 1, f"r{k}", 4 * (k % 3)) for k in range(25)]


def test_scan_files_and_stats(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.md").write_bytes(b"alpha\r\nbeta\r\n")
    (tmp_path / "b.json").write_bytes(b"alpha\nbeta\n")
    (tmp_path / "c.png").write_bytes(b"\x89PNG\r\n\x1a\nx\xff\r\n")
    got = {r["path"].rsplit("/", 1)[1]: tuple(r)[1:] for r in ck.file_stats(files.scan_files(spark, str(tmp_path))).collect()}
    lf = hashlib.sha256(b"alpha\nbeta\n").hexdigest()
    assert got["a.md"] == (13, 11, 13, 11, lf) and got["b.json"] == (11, 11, 13, 11, lf)
    assert got["c.png"] == (12, 10, 13, 12, hashlib.sha256(b"\x89PNG\r\n\x1a\nx\xff\r\n").hexdigest())


def test_json_export(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "x"), ("b", 2, None), ("a", 3, "y")], "case_id string, n int, s string")
    files.write_json_export(df, str(tmp_path / "out"), "case_id")
    back = spark.read.json(str(tmp_path / "out"))
    assert {(r["case_id"], r["n"], r["s"]) for r in back.collect()} == {("a", 1, "x"), ("b", 2, None), ("a", 3, "y")}
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        files.write_json_export(df, str(tmp_path / "out"), "case_id")


def test_catalogue_manifests_csv_geojson(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"plugins": [{
        "id": "p",
        "name": "P",
        "version": "1",
        "kind": "k",
        "readme": "r",
        "showcases": [{"id": "a", "title": "A", "status": "ready", "summary": "s", "next_step": "n", "case_path": "c", "preview": "v"}],
    }]}))
    r = files.load_catalogue(spark, str(tmp_path / "c.json")).first()
    assert (r["plugin_id"], r["id"], r["status"]) == ("p", "a", "ready")
    (tmp_path / "m.json").write_text(json.dumps({"id": "a", "inputs": [{"path": "i"}], "outputs": [{"path": "o", "bytes": 3, "sha256": "x"}]}))
    assert {(m["role"], m["path"], m["bytes"]) for m in files.load_manifests(spark, str(tmp_path / "m.json")).collect()} == {
        ("input", "i", None),
        ("output", "o", 3),
    }
    (tmp_path / "t.csv").write_text('a,b\n1,"x, ""y"""\n')
    assert files.load_csv_strict(spark, str(tmp_path / "t.csv"), "a int, b string").first()["b"] == 'x, "y"'
    (tmp_path / "g.geojson").write_text(json.dumps({"features": [{
        "type": "Feature",
        "geometry": {"type": "Polygon", "coordinates": [[[0, 1], [2, 3]]]},
        "properties": {"n": "1"},
    }]}))
    g = files.load_geojson(spark, str(tmp_path / "g.geojson")).first()
    assert g["geometry"] == "Polygon" and g["rings"] == [[[0.0, 1.0], [2.0, 3.0]]]


def test_csv_with_provenance(spark, tmp_path):
    side = files.write_csv_with_provenance(spark.range(5).coalesce(1), str(tmp_path / "out"), ["id"]).first()
    assert (side["rows"], side["min_id"], side["max_id"]) == (5, 0, 4) and side["bytes"] > 0 and len(side["sha256"]) == 64


@pytest.mark.parametrize("text", ["junk\nACGT\n>a\nAC\n", ">a\nAC\n>\nGT\n", ">a\nAC\n>b\n>c\nGT\n", "\n>a\nAC\n>\n>b\nGT\n", ">a\nAC!\n", "ACGT\n"])
def test_damaged_fasta_is_an_error(spark, tmp_path, text):
    (tmp_path / "x.fasta").write_text(text)
    with pytest.raises(Exception, match="bad FASTA record"):
        files.load_fasta(spark, str(tmp_path / "x.fasta")).collect()


def test_fasta_alphabet_and_blank_lines(spark, tmp_path):
    (tmp_path / "x.fasta").write_text("\n\n>a one\nAC?*\n.-gt\n\n>b\nN\n")
    (tmp_path / "y.fasta").write_text(">c\nM\n")
    got = {r["id"]: (r["header"], r["sequence"]) for r in files.load_fasta(spark, str(tmp_path / "*.fasta")).collect()}
    assert got == {"a": ("a one", "AC?*.-gt"), "b": ("b", "N"), "c": ("c", "M")}


def exons(text):
    return [(e["start"], e["end"], e["complement"]) for e in files.location_of(text)["exons"]]


def test_locations():
    assert exons("7") == [(7, 7, False)] and exons("complement(4..9)") == [(4, 9, True)]
    assert exons("join(1..5,9..12,20)") == [(1, 5, False), (9, 12, False), (20, 20, False)]
    assert exons("complement(join(1..5,9..12))") == [(9, 12, True), (1, 5, True)] == exons("join(complement(9..12),complement(1..5))")
    assert exons("complement(join(1..2,complement(5..6),order(8..9,11)))") == [(11, 11, True), (8, 9, True), (5, 6, False), (1, 2, True)]
    assert exons("12^13") == [] and exons("join(1..3,5^6)") == [(1, 3, False)]
    whole = files.location_of("join(<3..8,12..>20)")
    assert (whole["start"], whole["end"], whole["open_start"], whole["open_end"], whole["parts"], whole["complement"]) == (3, 20, True, True, "join", False)
    assert files.location_of("order(complement(2..4),complement(9))")["parts"] == "order" and files.location_of("complement(<1..9)")["open_start"]
    for bad in ("", "join(1..5", "join(1..5,)", "9..4", "J00194.1:100..202", "complement(1..2,4..5)", "1..5)", "one"):
        with pytest.raises(files.BadLocation):
            files.location_of(bad)


def test_spliced_features_of_a_record(spark, tmp_path):
    head = "LOCUS       X 60 bp\nACCESSION   X1\nFEATURES             Location/Qualifiers\n"
    feature = lambda kind, *lines: f"     {kind:<16}" + ("\n" + " " * 21).join(lines) + "\n"
    dna = "ccatgaaatttgtaagtttttttagggccctaacc" + "ggttagggccctaaaaacattt"
    text = head + feature("CDS", "join(3..11,", "26..33)", '/gene="a ""b"""', "/pseudo", '/translation="MKFG', 'P"', "/codon_start=1")
    text += feature("CDS", f"complement({36 + 2}..{36 + 19})", "/codon_start=2") + feature("gene", "5") + f"ORIGIN\n        1 {dna}\n//\n"
    (tmp_path / "x.gb").write_text(text)
    rows = files.load_genbank_features(spark, str(tmp_path / "x.gb"))
    got = rows.orderBy("feature_no").collect()
    assert [(r["location"], r["start"], r["end"], len(r["exons"])) for r in got] == [("join(3..11,26..33)", 3, 33, 2), ("complement(38..55)", 38, 55, 1), ("5", 5, 5, 1)]
    assert got[0]["qualifiers"] == {"gene": ['a "b"'], "pseudo": [""], "translation": ["MKFGP"], "codon_start": ["1"]}
    from pyspark.sql import functions as F

    first = lambda name: F.get(F.try_element_at("qualifiers", F.lit(name)), F.lit(0))
    cds = rows.where("type = 'CDS'").select("accession", "feature_no", "exons", first("translation").alias("translation"), first("codon_start").cast("int").alias("codon_start"))
    check = {r["feature_no"]: r for r in sq.cds_translation_check(cds, files.load_genbank_records(spark, str(tmp_path / "x.gb"))).collect()}
    turned = dna[37:55].translate(str.maketrans("acgt", "tgca"))[::-1].upper()
    codon = {a + b + c: sq.AMINO_ACIDS[16 * i + 4 * j + k] for i, a in enumerate("TCAG") for j, b in enumerate("TCAG") for k, c in enumerate("TCAG")}
    protein = "".join(codon[turned[k : k + 3]] for k in range(1, len(turned) - 3, 3))
    spliced = (dna[2:11] + dna[25:33]).upper()
    assert check[1]["bases"] == 17 and check[1]["residues"] == len("".join(codon[spliced[k : k + 3]] for k in range(0, 15, 3)).rstrip("*"))
    assert check[1]["ok"] == ("".join(codon[spliced[k : k + 3]] for k in range(0, 15, 3)) == "MKFGP")
    assert check[2]["ok"] is None and check[2]["protein_sha256"] == hashlib.sha256(protein.removesuffix("*").encode()).hexdigest()


def test_export_works_its_rows_out_once(spark, tmp_path):
    """Bounds come from the write itself: rows that differ each time they are worked out still agree with the file."""
    from pyspark.sql import functions as F

    df = spark.range(1000).select("id", F.expr("cast(rand() * 1000000000 as long)").alias("v"), F.lit("2024-02-03").cast("date").alias("d"))
    side = files.write_csv_with_provenance(df, str(tmp_path / "out"), ["v", "d"]).collect()
    back = spark.read.option("header", True).schema("id long, v long, d date").csv(str(tmp_path / "out"))
    low, high = back.agg(F.min("v"), F.max("v")).first()
    assert {(r["rows"], r["min_v"], r["max_v"], str(r["min_d"])) for r in side} == {(1000, low, high, "2024-02-03")} and len(side) > 1
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        files.write_csv_with_provenance(df, str(tmp_path / "out"), ["v"])
    empty = files.write_csv_with_provenance(df.limit(0).coalesce(1), str(tmp_path / "none"), ["v"]).first()
    assert (empty["rows"], empty["min_v"]) == (0, None)
