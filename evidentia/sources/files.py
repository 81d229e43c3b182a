"""Readers and writers of catalogue, sequence, structure and table files. Schemas are fixed; damaged input is an error."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import text as tx
from evidentia.sources.fastq import opened

CASE = "struct<id: string, title: string, status: string, summary: string, next_step: string, case_path: string, preview: string>"
CATALOGUE = f"plugins array<struct<id: string, name: string, version: string, kind: string, readme: string, showcases: array<{CASE}>>>"
FILE_ENTRY = "array<struct<path: string, bytes: bigint, sha256: string>>"
MANIFEST = f"id string, plugin_id string, inputs {FILE_ENTRY}, outputs {FILE_ENTRY}, previews {FILE_ENTRY}"
GEOJSON = "features array<struct<type: string, geometry: struct<type: string, coordinates: array<array<array<double>>>>, properties: map<string, string>>>"
ATOMS = "path string, record string, serial string, atom_name string, alt_loc string, res_name string, chain string, res_seq string, x double, y double, z double"
EXONS = "array<struct<start: int, end: int, complement: boolean>>"
FEATURES = f"accession string, feature_no int, type string, location string, complement boolean, start int, end int, open_start boolean, open_end boolean, parts string, exons {EXONS}, qualifiers map<string, array<string>>"
#: A value of an mmCIF row: quoted, where a quote ends it only before a blank, or without blanks.
MMCIF_VALUE = r"""'(?:[^']|'(?=\S))*'|"(?:[^"]|"(?=\S))*"|\S+"""
MMCIF_QUOTES = r"""^(['"])(.*)\1$"""


def load_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """One row per case of the nested catalogue, with its plugin."""
    raw = spark.read.schema(CATALOGUE).option("multiLine", True).option("mode", "FAILFAST").json(path)
    plugins = raw.select(F.inline("plugins")).withColumnsRenamed({"id": "plugin_id", "name": "plugin_name"})
    return plugins.select("plugin_id", "plugin_name", "version", "kind", F.inline("showcases"))


def load_manifests(spark: SparkSession, glob: str) -> DataFrame:
    """One row per declared input, preview and output: recorded path, bytes, sha256; ordinal within its role."""
    raw = spark.read.text(glob, wholetext=True).select(F.from_json("value", MANIFEST, {"mode": "FAILFAST"}).alias("m")).select("m.*")

    def entries(role: str, column: str):
        files = F.coalesce(column, F.array().cast(FILE_ENTRY))
        return F.transform(
            files,
            lambda x,
            i: F.struct(F.lit(role).alias("role"), i.alias("ordinal"), x["path"].alias("path"), x["bytes"].alias("bytes"), x["sha256"].alias("sha256")),
        )

    roles = F.concat(entries("input", "inputs"), entries("preview", "previews"), entries("output", "outputs"))
    return raw.select(F.col("id").alias("case_id"), F.inline(roles))


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """Recursive listing: path, media_type, length, content (binary, as checks.file_stats takes it)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select("path", tx.media_type(F.col("path")).alias("media_type"), "length", "content")


def load_fasta(spark: SparkSession, glob: str) -> DataFrame:
    """path, header, id (its first word), sequence. An empty id or sequence, a letter outside the alphabet, and text before a file's
    first header are errors; blank lines there are not."""
    place = (F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"))
    text = spark.read.option("lineSep", "\n>").text(glob).select(*place, "value")
    # how each file begins, and its blank pieces: one row a file
    blank = F.trim(F.regexp_replace("value", r"\s", "")) == ""
    begins = F.min_by(F.when(blank, "").otherwise(F.left("value", F.lit(1))), F.when(F.col("at") == 0, F.col("n")))
    files = text.groupBy("path").agg(begins.alias("begins"), F.count_if(blank).alias("blanks"))
    rows = text.where(~blank).join(files, "path")
    v = F.regexp_replace("value", "^>", "")
    rows = rows.select(
        "path",
        F.trim(F.substring_index(v, "\n", 1)).alias("header"),
        F.regexp_replace(F.regexp_replace(v, r"^[^\n]*\n?", ""), r"\s", "").alias("sequence"),
        (F.col("begins").isin("", ">") & (F.col("blanks") <= (F.col("begins") == "").cast("int"))).alias("whole"),
    )
    rows = rows.withColumn("id", F.split("header", r"\s+")[0])
    good = F.col("whole") & (F.col("id") != "") & F.col("sequence").rlike(r"^[A-Za-z*?.\-]+$")
    return rows.select(
        "path",
        "header",
        "id",
        F.when(good, F.col("sequence")).otherwise(F.raise_error(F.concat(F.lit("bad FASTA record "), "header"))).alias("sequence"),
    )


def load_pdb_atoms(spark: SparkSession, glob: str) -> DataFrame:
    """ATOM and HETATM records by their fixed columns; a blank coordinate is null."""
    lines = spark.read.text(glob).select(
        F.col("_metadata.file_path").alias("path"),
        "value",
    ).where(F.col("value").startswith("ATOM  ") | F.col("value").startswith("HETATM"))
    cut = lambda a, b: F.trim(F.substring("value", a, b - a + 1))
    fields = {"record": (1, 6), "serial": (7, 11), "atom_name": (13, 16), "alt_loc": (17, 17), "res_name": (18, 20), "chain": (22, 22), "res_seq": (23, 27)}
    return lines.select(
        "path",
        *(cut(*ab).alias(n) for n, ab in fields.items()),
        *(cut(*ab).try_cast("double").alias(n) for n, ab in {"x": (31, 38), "y": (39, 46), "z": (47, 54)}.items()),
    )


def load_mmcif_atoms(spark: SparkSession, glob: str) -> DataFrame:
    """Atom rows of mmCIF files in the schema of load_pdb_atoms; columns by the order of the header lines of each file."""
    lines = spark.read.text(glob).select(F.col("_metadata.file_path").alias("path"), "value", F.monotonically_increasing_id().alias("n"))
    heads = lines.where(F.col("value").startswith("_atom_site.")).groupBy("path").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("n", F.trim("value").alias("v")))),
        lambda x: x["v"],
    ).alias("names"))
    rows = lines.where(F.col("value").startswith("ATOM ") | F.col("value").startswith("HETATM ")).join(heads, "path").withColumn(
        "f",
        F.transform(F.regexp_extract_all("value", F.lit(MMCIF_VALUE), F.lit(0)), lambda v: F.regexp_replace(v, MMCIF_QUOTES, "$2")),
    )
    at = lambda name: F.get("f", F.array_position("names", "_atom_site." + name).cast("int") - 1)
    plain = lambda c: F.when(~c.isin(".", "?"), c)
    names = {
        "record": "group_PDB",
        "serial": "id",
        "atom_name": "label_atom_id",
        "alt_loc": "label_alt_id",
        "res_name": "label_comp_id",
        "chain": "auth_asym_id",
        "res_seq": "auth_seq_id",
    }
    return rows.select("path", *(plain(at(v)).alias(k) for k, v in names.items()), *(at(f"Cartn_{c}").try_cast("double").alias(c) for c in "xyz"))


def genbank_texts(spark: SparkSession, glob: str) -> DataFrame:
    """accession and text of each record of GenBank files."""
    texts = spark.read.option("lineSep", "\n//\n").text(glob).where(F.trim("value") != "")
    return texts.select(F.nullif(F.regexp_extract("value", r"(?m)^ACCESSION\s+(\S+)", 1), F.lit("")).alias("accession"), "value")


def load_genbank_records(spark: SparkSession, glob: str) -> DataFrame:
    """accession and sequence (lower case) of each record."""
    origin = F.regexp_replace(F.substring_index("value", "\nORIGIN", -1), r"^[^\n]*", "")
    return genbank_texts(spark, glob).select("accession", F.regexp_replace(origin, "[^a-z]", "").alias("sequence"))


class BadLocation(ValueError):
    pass


def location_of(text: str) -> dict:
    """A feature's location as exons in the order in which they are spliced.

    join and order list their parts; complement turns the order of its parts round and each part over, at any depth. A single base is
    an exon of one; a site between two bases (n^m) and one base of a range (n.m) have no exon; `<` and `>` mark open ends. parts: join,
    order or null. A part on another record, or text that is no location, is an error."""
    tokens = re.findall(r"[A-Za-z_][\w.]*:|complement|join|order|[(),]|[<>]?\d+(?:(?:\.\.|\^|\.)[<>]?\d+)?|\S", re.sub(r"\s", "", text))
    place, kinds, marks = 0, [], [False, False]

    def one() -> list[tuple[int, int, bool]]:
        nonlocal place
        token = tokens[place] if place < len(tokens) else ""
        place += 1
        if token in ("complement", "join", "order"):
            if place >= len(tokens) or tokens[place] != "(":
                raise BadLocation(text)
            found = []
            while tokens[place] in ("(", ","):
                place += 1
                found += [one()]
                if place >= len(tokens):
                    raise BadLocation(text)
            if tokens[place] != ")" or (token == "complement" and len(found) != 1):
                raise BadLocation(text)
            place += 1
            flat = [x for part in found for x in part]
            if token == "complement":
                return [(a, b, not turned) for a, b, turned in reversed(flat)]
            kinds.append(token)
            return flat
        if not (m := re.fullmatch(r"([<>]?)(\d+)(?:(\.\.|\^|\.)([<>]?)(\d+))?", token)):
            raise BadLocation(text)
        a, b = int(m[2]), int(m[5] or m[2])
        bounds.append((a, b))
        marks[0] |= "<" in (m[1], m[4] or "")
        marks[1] |= ">" in (m[1], m[4] or "")
        if b < a and m[3] != "^":
            raise BadLocation(text)
        return [] if m[3] in ("^", ".") else [(a, b, False)]

    bounds: list[tuple[int, int]] = []
    exons = one()
    if place != len(tokens):
        raise BadLocation(text)
    return {
        "complement": bool(exons) and all(x[2] for x in exons) or (not exons and "complement" in tokens),
        "start": min(a for a, _ in bounds),
        "end": max(b for _, b in bounds),
        "open_start": marks[0],
        "open_end": marks[1],
        "parts": kinds[0] if kinds else None,
        "exons": [{"start": a, "end": b, "complement": turned} for a, b, turned in exons],
    }


#: A feature: its type and location, which goes on until a qualifier, and the lines of its qualifiers.
FEATURE = re.compile(r"^ {5}(\S+) +(\S.*(?:\n {21}(?!/).*)*)\n((?: {21}.*(?:\n|$))*)", re.M)
QUALIFIER = re.compile(r'/(\w+)(?:=(?:"((?:[^"]|"")*)"|(\S+)))?')


def load_genbank_features(spark: SparkSession, glob: str) -> DataFrame:
    """One row per feature of each record: accession, feature_no, type, location, complement (all exons), start and end (the outermost
    bases), open_start, open_end, parts, exons in the order of splicing, qualifiers (a value for each time; empty for a flag)."""
    block = F.substring_index(F.substring_index("value", "\nORIGIN", 1), "\nFEATURES", -1)
    records = genbank_texts(spark, glob).where(F.contains("value", F.lit("\nFEATURES"))).select("accession", block.alias("block"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for accession, text in zip(batch["accession"], batch["block"], strict=True):
                rows = []
                for n, m in enumerate(FEATURE.finditer(text + "\n"), 1):
                    location = re.sub(r"\s", "", m[2])
                    found: dict[str, list[str]] = {}
                    for q in QUALIFIER.finditer(re.sub(r"\n {21}(?!/)", " ", m[3])):
                        value = q[2].replace('""', '"') if q[2] is not None else q[3] or ""
                        found.setdefault(q[1], []).append(value.replace(" ", "") if q[1] == "translation" else value)
                    rows.append({"accession": accession, "feature_no": n, "type": m[1], "location": location, **location_of(location), "qualifiers": found})
                if rows:
                    yield pd.DataFrame(rows)

    return records.mapInPandas(parse, FEATURES)


def load_csv_strict(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """Quoted CSV with a header; rows of another width and open quotes are errors."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("multiLine", True).option("escape", '"').option(
        "enforceSchema",
        False,
    ).option("sep", sep).csv(path)


def load_geojson(spark: SparkSession, glob: str) -> DataFrame:
    """One row per feature: geometry type, rings, properties."""
    raw = spark.read.schema(GEOJSON).option("multiLine", True).option("mode", "FAILFAST").json(glob)
    return raw.select(F.inline("features")).select(F.col("geometry.type").alias("geometry"), F.col("geometry.coordinates").alias("rings"), "properties")


def write_json_export(df: DataFrame, path: str, *partition_by: str) -> None:
    """A review or import bundle as JSON lines, one folder per case."""
    df.write.partitionBy(*partition_by).mode("errorifexists").json(path)


def write_texts(rows: DataFrame, folder: str) -> int:
    """Writes each row (file, text) as a UTF-8 file of its own, into a folder for each task; their number. A task that is tried again
    writes its files over. folder: a local path or a URI that pyarrow.fs knows."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = opened(f"{folder}/{TaskContext.get().partitionId():05d}")
        store.create_dir(path, recursive=True)
        for batch in batches:
            for name, text in zip(batch["file"], batch["text"], strict=True):
                with store.open_output_stream(f"{path}/{name}") as f:
                    f.write((text or "").encode())
            yield pd.DataFrame({"files": [len(batch)]})

    return rows.repartition("file").mapInPandas(write, "files long").agg(F.coalesce(F.sum("files"), F.lit(0))).first()[0]


def write_csv_with_provenance(df: DataFrame, path: str, bounds: list[str]) -> DataFrame:
    """Writes CSV; returns the sidecar: one row per file with bytes and sha256, the rows written and the columns' bounds. Rows and
    bounds are observed while the rows are written, so df is worked out once; only the files' bytes are read again."""
    seen = Observation("written")
    metrics = [F.count(F.lit(1)).alias("rows"), *(f(c).alias(f"{n}_{c}") for c in bounds for n, f in (("min", F.min), ("max", F.max)))]
    df.observe(seen, *metrics).write.option("header", True).mode("errorifexists").csv(path)
    kinds = dict(df.dtypes)
    found = [F.lit(seen.get["rows"]).cast("long").alias("rows")]
    found += [F.lit(seen.get[f"{n}_{c}"]).cast(kinds[c]).alias(f"{n}_{c}") for c in bounds for n in ("min", "max")]
    files = df.sparkSession.read.format("binaryFile").load(f"{path}/*.csv")
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), *found)
