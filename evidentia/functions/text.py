"""Column functions over text, paths and file contents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extension and media type.
MEDIA_TYPES = {
    ".json": "application/json",
    ".geojson": "application/geo+json",
    ".csv": "text/csv",
    ".svg": "image/svg+xml",
    ".png": "image/png",
    ".pdb": "chemical/x-pdb",
    ".cif": "chemical/x-mmcif",
    ".fasta": "text/x-fasta",
    ".aln-fasta": "text/x-fasta",
    ".gb": "text/x-genbank",
    ".nwk": "text/x-newick",
    ".md": "text/markdown",
}
OCTETS = "application/octet-stream"
PNG_SIGNATURE = "89504E470D0A1A0A"
#: White space as ECMAScript's \s has it, and as its trim() cuts it off.
BLANK = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def media_type(path: Column) -> Column:
    """Media type by the extension (what follows the last dot of the file's name, lower-cased); octets for any other."""
    name = F.lower(F.substring_index(path, "/", -1))
    dot = F.length(name) - F.instr(F.reverse(name), ".")
    extension = F.when(name.endswith(".aln-fasta"), ".aln-fasta").when((F.instr(name, ".") > 0) & (dot > 0), F.substring(name, dot + 1, F.length(name)))
    known = F.create_map(*(F.lit(x) for pair in MEDIA_TYPES.items() for x in pair))
    return F.coalesce(F.element_at(known, extension), F.lit(OCTETS))


def is_text(media: Column) -> Column:
    """Types whose line ends do not count: texts, JSON, SVG and chemical tables."""
    return media.startswith("text/") | media.startswith("chemical/") | media.isin("application/json", "application/geo+json", "image/svg+xml")


def final_role(path: Column, role: Column) -> Column:
    """A path that names provenance has that role, whatever was declared."""
    return F.when(F.lower(path).contains("provenance"), F.lit("provenance")).otherwise(role)


#: The same characters, one by one.
BLANKS = "\t\n\x0b\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def clean_markdown(text: Column) -> Column:
    """Without lines of one image, bullets at line starts, code ticks, link targets and bold marks, white space collapsed; in
    this order."""
    # Pattern and replacement of each step.
    steps = (
        (rf"(?m)^!\[[^\]]*\]\([^)]*\){BLANK}*$", ""),
        (rf"(?m)^[-*]{BLANK}+", ""),
        (r"`([^`]+)`", "$1"),
        (r"\[([^\]]+)\]\([^)]+\)", "$1"),
        (r"\*\*([^*]+)\*\*", "$1"),
        (rf"(?=[^!-~]){BLANK}+", " "),
    )
    for pattern, to in steps:
        text = F.regexp_replace(text, pattern, to)
    return F.trim(text)


def split_statements(text: Column) -> Column:
    """Statements: cut after a full stop before a capital, digit or backtick, or at a dash or star between blanks; trimmed,
    none empty."""
    # most characters fail at the first look; a run of blanks is tried once, from its first one, and never given back
    parts = F.split(text, rf"(?=[^!-~])(?:(?<=\.){BLANK}++(?=[A-Z0-9`])|(?={BLANK})(?<!{BLANK}){BLANK}++[-*]{BLANK}++)")
    return F.filter(F.transform(parts, trimmed), lambda s: s != "")


def path_problem(path: Column) -> Column:
    """blank, absolute or escaping; null for a path that stays inside its root."""
    depth = F.aggregate(
        F.split(path, "/"),
        F.struct(F.lit(0).alias("d"), F.lit(0).alias("least")),
        lambda s, part: F.struct((s["d"] + step(part)).alias("d"), F.least(s["least"], s["d"] + step(part)).alias("least")),
        lambda s: s["least"],
    )
    blank = F.coalesce(F.trim(path), F.lit("")) == ""
    return F.when(blank, "blank").when(path.startswith("/"), "absolute").when(depth < 0, "escaping")


def step(part: Column) -> Column:
    return F.when(part == "..", -1).when(part.isin("", "."), 0).otherwise(1)


def newick_balanced(text: Column) -> Column:
    """Parentheses never close before they open, all are closed, and the trimmed text ends with a semicolon."""
    marks = F.split(F.regexp_replace(text, r"[^()]", ""), "")
    turn = lambda c: F.when(c == "(", 1).when(c == ")", -1).otherwise(0)
    depth = F.aggregate(
        marks,
        F.struct(F.lit(0).alias("d"), F.lit(0).alias("least")),
        lambda s, c: F.struct((s["d"] + turn(c)).alias("d"), F.least(s["least"], s["d"] + turn(c)).alias("least")),
    )
    return (depth["d"] == 0) & (depth["least"] == 0) & trimmed(text).endswith(";")


def fasta_ok(text: Column) -> Column:
    """Records of a header with a name and a sequence of letters, `*`, `?`, `-` and `.`; nothing but blank lines before them."""
    lines = F.filter(F.transform(F.split(text, "\r?\n"), trimmed), lambda x: x != "")
    kinds = F.array_join(F.transform(lines, lambda x: F.when(x.rlike("^>."), "h").when(x.rlike(r"^[A-Za-z*?\-.]+$"), "s").otherwise("x")), "")
    return kinds.startswith("h") & kinds.endswith("s") & ~kinds.contains("hh") & ~kinds.contains("x")


def csv_ok(text: Column) -> Column:
    """Quotes are closed, and all rows have as many fields as the first. Quoted fields are blanked out before rows are cut."""
    bare = F.regexp_replace(text, r'"[^"]*+(?:""[^"]*+)*+"', "q")
    rows = F.split(F.regexp_replace(bare, r"\n\z", ""), "\n")
    widths = F.array_distinct(F.transform(rows, lambda r: F.regexp_count(r, F.lit(","))))
    return ~bare.contains('"') & (F.size(widths) == 1)


def one_json_value(text: Column) -> Column:
    """Whether a text is one JSON value and nothing else. The parser takes the first value and lets anything follow, so the text is parsed as
    a member of a list and of an object, with a last member after it that must be there: a text that closes or leaves the one is no member
    of the other. An object that repeats a key is refused."""
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"end"]')))
    named = F.try_parse_json(F.concat(F.lit('{"value":'), text, F.lit(',"end":"end"}')))
    last = lambda x, path: F.try_variant_get(x, path, "string") == "end"
    return F.coalesce(last(listed, "$[1]") & F.try_variant_get(listed, "$[2]", "string").isNull() & last(named, "$.end"), F.lit(False))


def content_ok(media: Column, content: Column) -> Column:
    """Whether a file (binary or text) is what its media type says; any file that is not empty passes for other types."""
    text = content.cast("string")
    kinds = F.when(media.isin("application/json", "application/geo+json"), one_json_value(text))
    kinds = kinds.when(media == "text/csv", csv_ok(text))
    kinds = kinds.when(media == "image/svg+xml", text.rlike(r"<svg\b") & F.contains(text, F.lit("</svg>")))
    kinds = kinds.when(media == "image/png", F.hex(F.substring(content.cast("binary"), 1, 8)) == PNG_SIGNATURE)
    kinds = kinds.when(media == "text/html", text.rlike(r"(?i)^<!doctype html") & F.contains(text, F.lit("</html>")))
    kinds = kinds.when(media == "chemical/x-pdb", text.rlike(r"(?m)^(ATOM  |HETATM)"))
    kinds = kinds.when(media == "chemical/x-mmcif", text.rlike(r"(?m)^data_") & F.contains(text, F.lit("_atom_site.")))
    kinds = kinds.when(media == "text/x-genbank", text.rlike(r"(?m)^LOCUS\s") & text.rlike(r"(?m)^ORIGIN\s*$") & text.rlike(r"(?m)^//$"))
    kinds = kinds.when(media == "text/x-fasta", fasta_ok(text)).when(media == "text/x-newick", newick_balanced(text))
    kinds = kinds.when(media == "text/markdown", trimmed(text) != "")
    return F.coalesce(F.octet_length(content) > 0, F.lit(False)) & F.coalesce(kinds, F.lit(True))


def number_in(text: Column, pattern: str) -> Column:
    """The first group of a pattern as a number of any length; null without a match."""
    return F.regexp_extract(text, pattern, 1).try_cast("double")
