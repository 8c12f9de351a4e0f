"""Readers of structure, sequence and annotation files as DataFrames. Gzipped files are read as they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.checks import checked, refusing
from .cif import read_star

#: Three-letter and one-letter codes.
RESIDUES = {"ALA": "A", "CYS": "C", "ASP": "D", "GLU": "E", "PHE": "F", "GLY": "G", "HIS": "H", "ILE": "I", "LYS": "K", "LEU": "L", "MET": "M", "ASN": "N", "PRO": "P", "GLN": "Q", "ARG": "R", "SER": "S", "THR": "T", "VAL": "V", "TRP": "W", "TYR": "Y"}
STRUCTURE_SUFFIXES = {".pdb": "pdb", ".ent": "pdb", ".cif": "cif", ".mmcif": "cif"}


def structure_format(path: str) -> str:
    """pdb or cif, by the suffix without .gz; other suffixes are an error."""
    name = path.lower().removesuffix(".gz")
    for suffix, kind in STRUCTURE_SUFFIXES.items():
        if name.endswith(suffix):
            return kind
    raise ValueError(f"{path}: structure files end in {', '.join(STRUCTURE_SUFFIXES)}, with or without .gz")


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[A-Za-z]+)(\.gz)?$", 1)


def one_letter(rname: Column) -> Column:
    out = F.lit(None).cast("string")
    for three, one in RESIDUES.items():
        out = F.when(rname == three, F.lit(one)).otherwise(out)
    return out


def read_pdb(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Atom records: model, serial, aname, altloc, rname, aa, chain, rnum, icode, x, y, z, occ, bfac, element, hetero."""
    line = F.col("value")
    part = lambda a, n: F.trim(F.substring(line, a, n))
    rows = spark.read.text(path).where(line.startswith("ATOM  ") | line.startswith("HETATM")).withColumn("model", file_stem(F.col("_metadata.file_path")))
    number = lambda a, n, kind: F.expr(f"try_cast(trim(substring(value, {a}, {n})) as {kind})")
    return rows.select("model", number(7, 5, "int").alias("serial"), part(13, 4).alias("aname"), part(17, 1).alias("altloc"), part(18, 3).alias("rname"), one_letter(part(18, 3)).alias("aa"), part(22, 1).alias("chain"), number(23, 4, "int").alias("rnum"), part(27, 1).alias("icode"), *[number(31 + 8 * i, 8, "double").alias(v) for i, v in enumerate("xyz")], number(55, 6, "double").alias("occ"), number(61, 6, "double").alias("bfac"), F.coalesce(F.nullif(part(77, 2), F.lit("")), F.substring(part(13, 4), 1, 1)).alias("element"), line.startswith("HETATM").alias("hetero"))


def read_cif(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Atom records of mmCIF files, in the columns of read_pdb; the author's names and numbers, where there are any. A file without atoms is an error."""
    rows = read_star(spark, path, "_atom_site", ["id", "group_PDB", "label_atom_id", "label_alt_id", "label_comp_id", "auth_asym_id", "label_asym_id", "auth_seq_id", "label_seq_id", "pdbx_PDB_ins_code", "Cartn_x", "Cartn_y", "Cartn_z", "occupancy", "B_iso_or_equiv", "type_symbol"], required=True)
    number = lambda c, kind: F.col(c).try_cast(kind)
    blank = lambda c: F.coalesce(c, F.lit(""))
    return rows.select(file_stem(F.col("path")).alias("model"), number("id", "int").alias("serial"), F.col("label_atom_id").alias("aname"), blank("label_alt_id").alias("altloc"), F.col("label_comp_id").alias("rname"), one_letter(F.col("label_comp_id")).alias("aa"), F.coalesce("auth_asym_id", "label_asym_id").alias("chain"), F.coalesce("auth_seq_id", "label_seq_id").try_cast("int").alias("rnum"), blank("pdbx_PDB_ins_code").alias("icode"), *[number(f"Cartn_{v}", "double").alias(v) for v in "xyz"], number("occupancy", "double").alias("occ"), number("B_iso_or_equiv", "double").alias("bfac"), F.col("type_symbol").alias("element"), (F.col("group_PDB") == "HETATM").alias("hetero"))


def read_structures(spark: SparkSession, path: str) -> DataFrame:
    """Atoms of PDB or mmCIF files, by the suffix of path. A file without atoms is an error, whichever columns are used."""
    if structure_format(path) == "cif":
        return read_cif(spark, path)
    lines = spark.read.text(path)
    plain = lambda c: F.regexp_replace(c, r"^(\w+):/+", "$1:/").alias("path")  # noqa: E731  # listings and rows differ in the slashes of local paths
    full = lines.where(F.col("value").startswith("ATOM  ") | F.col("value").startswith("HETATM")).select(plain("_metadata.file_path")).distinct()
    files = spark.createDataFrame([(f,) for f in lines.inputFiles()], "path string").select(plain("path"))  # readers pass over files of no length
    return refusing(read_pdb(spark, path), files.join(full, "path", "left_anti"), F.concat(F.lit("no atoms in "), "path"))


def _prepared(atoms: DataFrame, mapping: dict[str, str] | None, membrane: bool) -> tuple[DataFrame, dict[str, Column]]:
    """atoms with modified residues renamed, and the reasons to leave one out, first reason first."""
    rname = F.col("rname")
    for modified, plain in (mapping or {"MSE": "MET"}).items():
        rname = F.when(F.col("rname") == modified, F.lit(plain)).otherwise(rname)
    rows = atoms.withColumn("was_", F.col("rname")).withColumn("rname", rname).withColumn("aa", one_letter(F.col("rname")))
    reasons = {
        "hydrogens": F.col("element").isin("H", "D"),
        "without_occupancy": F.coalesce("occ", F.lit(1.0)) <= 0,
        "other_residues": F.col("aa").isNull() & ~(F.lit(membrane) & F.coalesce(F.col("rname") == "MEM", F.lit(False))),
        "other_locations": ~F.coalesce("altloc", F.lit("")).isin("", "A"),
    }
    return rows, {k: F.coalesce(v, F.lit(False)) for k, v in reasons.items()}


def preprocessed(atoms: DataFrame, mapping: dict[str, str] | None = None, membrane: bool = False) -> DataFrame:
    """Modified residues renamed, then hydrogens, atoms without occupancy and non-standard residues left out.

    With membrane, points of residue MEM stay, as neighbours for the packing terms.
    """
    rows, reasons = _prepared(atoms, mapping, membrane)
    kept = F.lit(True)
    for reason in reasons.values():
        kept &= ~reason
    return rows.where(kept).drop("was_")


def preprocessing_report(atoms: DataFrame, mapping: dict[str, str] | None = None, membrane: bool = False) -> DataFrame:
    """(model, preprocessing): what preprocessed leaves out of each model, in one pass and one grouping.

    preprocessing has atoms, renamed, an atom count for each reason (an atom counts for its first one), and how many residues and
    chains are lost as a whole.
    """
    rows, reasons = _prepared(atoms, mapping, membrane)
    why = F.lit(None).cast("string")
    for name, reason in reversed(reasons.items()):
        why = F.when(reason, name).otherwise(why)
    rows = rows.withColumn("why_", why)
    counts = [F.count("*").alias("atoms"), F.count_if(~F.col("was_").eqNullSafe(F.col("rname")) & F.col("why_").isNull()).alias("renamed"), *[F.count_if(F.col("why_") == n).alias(n) for n in reasons]]
    residues = rows.groupBy("model", "chain", "rnum", "icode").agg(*counts, F.bool_or(F.col("why_").isNull()).alias("kept_"))
    names = ["atoms", "renamed", *reasons]
    chains = residues.groupBy("model", "chain").agg(*[F.sum(n).alias(n) for n in names], F.count_if(~F.col("kept_")).alias("residues_removed"), F.bool_or("kept_").alias("kept_"))
    out = chains.groupBy("model").agg(*[F.sum(n).alias(n) for n in names], F.sum("residues_removed").alias("residues_removed"), F.count_if(~F.col("kept_")).alias("chains_removed"))
    return out.select("model", F.struct(*names, "residues_removed", "chains_removed").alias("preprocessing"))


def backbone(atoms: DataFrame) -> DataFrame:
    """One row a residue with the positions of its n, ca, c, o and cb."""
    names = ["N", "CA", "C", "O", "CB"]
    at = [F.first(F.when(F.col("aname") == n, F.col(v)), ignorenulls=True).alias(f"{n.lower()}{v}") for n in names for v in "xyz"]
    return atoms.where("aa is not null").groupBy("model", "chain", "rnum", "rname", "aa").agg(*at)


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, name, sequence) of every record."""
    rows = spark.read.option("lineSep", ">").text(path).where(F.length(F.trim("value")) > 0)
    name = F.trim(F.substring_index("value", "\n", 1))
    sequence = F.regexp_replace(F.expr("substring(value, length(substring_index(value, '\n', 1)) + 1)"), r"\s", "")
    return rows.select(file_stem(F.col("_metadata.file_path")).alias("file"), name.alias("name"), sequence.alias("sequence"))


def alignment_columns(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, col, t, s): the letters of two aligned sequences, position by position."""
    a = first.select(*keys, F.posexplode(F.split("sequence", "")).alias("col", "t"))
    b = second.select(*keys, F.posexplode(F.split("sequence", "")).alias("col", "s"))
    return a.join(b, [*keys, "col"])


def read_a3m(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, sequence, role): predicted states and confidences by their headers, the other rows without insertions."""
    role = F.when(F.col("name").startswith("ss_pred"), "states").when(F.col("name").startswith("ss_conf"), "confidence").otherwise("row")
    rows = read_fasta(spark, path).withColumn("role", role)
    return rows.withColumn("sequence", F.when(F.col("role") == "row", F.regexp_replace("sequence", "[a-z]", "")).otherwise(F.col("sequence")))


def read_psipred(spark: SparkSession, path: str) -> DataFrame:
    """(file, sequence, states, confidence) of horizontal secondary structure files; the header line is required."""
    text = spark.read.text(path, wholetext=True)
    field = lambda tag: F.array_join(F.regexp_extract_all("value", F.lit(rf"(?m)^\s*{tag}:[ \t]+(\S+)[ \t]*$"), F.lit(1)), "")
    good = F.substring_index("value", "\n", 1).contains("# PSIPRED HFORMAT")
    checked = F.when(good, field("AA")).otherwise(F.raise_error(F.lit("not in horizontal format")).cast("string"))
    return text.select(file_stem(F.col("_metadata.file_path")).alias("file"), checked.alias("sequence"), field("Pred").alias("states"), field("Conf").alias("confidence"))


def read_accpro(spark: SparkSession, path: str) -> DataFrame:
    """(file, sequence, states, accessibility) from the lines after the name; - means buried."""
    lines = F.split("value", r"\r?\n")
    text = spark.read.text(path, wholetext=True)
    return text.select(file_stem(F.col("_metadata.file_path")).alias("file"), F.get(lines, F.lit(1)).alias("sequence"), F.get(lines, F.lit(2)).alias("states"), F.regexp_replace(F.get(lines, F.lit(3)), "-", "b").alias("accessibility"))


def read_accpro_output(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, sequence, accessibility) of the tool's three-line output."""
    lines = F.split(F.rtrim("value", F.lit(" \r\n")), r"\r?\n")
    text = spark.read.text(path, wholetext=True)
    third = F.when(F.size(lines) == 3, F.regexp_replace(F.get(lines, F.lit(2)), "-", "b")).otherwise(F.raise_error(F.lit("three lines are needed")).cast("string"))
    return text.select(file_stem(F.col("_metadata.file_path")).alias("file"), F.get(lines, F.lit(0)).alias("name"), F.get(lines, F.lit(1)).alias("sequence"), third.alias("accessibility"))


def sequence_features(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows, whose columns must be of equal length in each."""
    same = F.size(F.array_distinct(F.array(*[F.coalesce(F.length(c), F.lit(-1)) for c in columns]))) == 1
    return checked(rows, same, "sequence features differ in length")


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """(hash, clusters): lines of a hash and clusters of comma-separated chains."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where("length(trim(value)) > 0").select(F.get(parts, F.lit(0)).alias("hash"), F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda c: F.split(c, ",")).alias("clusters"))


def read_release_dates(spark: SparkSession, path: str) -> DataFrame:
    """(pdb_id, release_date) of a CSV file with these columns."""
    rows = spark.read.csv(path, header=True)
    if not {"pdb_id", "release_date"} <= set(rows.columns):
        raise ValueError("the file needs the columns pdb_id and release_date")
    return rows.select("pdb_id", F.to_date("release_date", "yyyy-MM-dd").alias("release_date"))


def first_released(entries: DataFrame, dates: DataFrame, before: str | None) -> DataFrame:
    """(hash, chain): of every cluster the first chain whose entry was released before the day, clusters without one left out."""
    rows = entries.select("hash", F.posexplode("clusters").alias("k", "chains")).select("hash", "k", F.posexplode("chains").alias("at", "chain"))
    if before is not None:
        rows = rows.join(dates, F.lower(F.substring_index("chain", ".", 1)) == F.lower("pdb_id")).where(F.col("release_date") < F.to_date(F.lit(before)))
    return rows.groupBy("hash", "k").agg(F.min_by("chain", "at").alias("chain")).select("hash", "chain")
