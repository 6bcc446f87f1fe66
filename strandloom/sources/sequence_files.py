"""FASTA and GenBank files, and texts of them, as DataFrames of records."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# File suffixes by format, and the shape of a record.
FASTA = (".fa", ".fasta")
GENBANK = (".gb", ".gbk", ".genbank")
FEATURES = (
    "array<struct<type: string, start: bigint, end: bigint, strand: int, start_fuzzy: boolean, end_fuzzy: boolean, "
    "qualifiers: map<string, array<string>>>>"
)
RECORDS = (
    "seq_id string, ord bigint, name string, description string, seq string, length bigint, topology string, "
    f"molecule_type string, source_path string, features {FEATURES}"
)


def format_of(path: str, default: str | None = None) -> str:
    """'fasta' or 'genbank' by suffix, whatever its case; other suffixes are refused unless a default is given."""
    lower = path.lower()
    if lower.endswith(FASTA):
        return "fasta"
    if lower.endswith(GENBANK):
        return "genbank"
    if default is None:
        raise ValueError(f"unsupported file type: {path}")
    return default


def _files(spark: SparkSession, path: str) -> list[str]:
    """The files a given path or pattern names, in order."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place)
    if not found:
        raise FileNotFoundError(path)
    return [f.getPath().toUri().getPath() for f in found]


def read_sequences(spark: SparkSession, paths: str | list[str], fasta_case: str = "preserve") -> DataFrame:
    """Records of one file or several, with ``file_no`` (place among the given files, from 0) and ``ord`` (place in its file, from 0).

    Suffixes are checked before anything is opened, then that the files are
    there. GenBank sequences are upper-cased; FASTA ones are kept unless
    ``fasta_case='upper'``. A file without records gives no row; one given
    twice is read once, at its first place.

    A file is read by as many tasks as it has splits. Records are numbered
    from the counts of the splits before theirs, so no letters are moved.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    kinds = [format_of(p) for p in paths]
    named = [(f, n) for n, f in enumerate(dict.fromkeys(f for p in paths for f in _files(spark, p)))]
    order = spark.createDataFrame(named, "_file string, file_no int")
    out = spark.createDataFrame([], f"{RECORDS}, file_no int")
    for kind in ("fasta", "genbank"):
        own = list(dict.fromkeys(p for p, k in zip(paths, kinds) if k == kind))
        if own:
            blocks = spark.read.option("lineSep", "\n>" if kind == "fasta" else "\n//").text(own)
            blocks = blocks.select(F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_block_start").alias("_at"), F.col("value").alias("block"))
            out = out.unionByName(parse(_numbered(blocks.where(F.trim(F.regexp_replace("block", r"\s", "")) != "")), kind, fasta_case).join(order, F.expr("url_decode(regexp_replace(replace(source_path, '+', '%2B'), '^[a-z0-9]+:(//[^/]*)?', '')) = _file")).drop("_file"))
    return out


def _numbered(blocks: DataFrame) -> DataFrame:
    """Blocks with ``ord``: their place in their file, from the number of blocks in the splits before and the place in the split.

    The ids of a task's rows rise by one; a split is read by one task in order.
    """
    rows = blocks.withColumn("_n", F.monotonically_increasing_id())
    splits = rows.groupBy("source_path", "_at").agg(F.min("_n").alias("_first"), F.count("*").alias("_rows"))
    before = Window.partitionBy("source_path").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select(F.col("source_path").alias("_path"), F.col("_at").alias("_split"), (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_base"))
    rows = rows.join(splits, (F.col("source_path") == F.col("_path")) & (F.col("_at") == F.col("_split")))
    return rows.select("source_path", (F.col("_base") + F.col("_n")).cast("long").alias("ord"), "block")


def read_one(spark: SparkSession, path: str) -> DataFrame:
    """The record of a GenBank file that holds exactly one."""
    if format_of(path) != "genbank":
        raise ValueError("a GenBank file is needed")
    out = read_sequences(spark, path)
    if (n := out.limit(2).count()) != 1:
        raise ValueError("no record found" if n == 0 else "more than one record found")
    return out


def from_texts(texts: DataFrame, default: str = "fasta", fasta_case: str = "preserve") -> DataFrame:
    """Records of whole file texts (``source_path``, ``text``), such as uploads; the format by suffix, else ``default``.

    Null and empty texts have no records.
    """
    lower = F.lower("source_path")
    kind = F.when(lower.rlike(r"\.(fa|fasta)$"), "fasta").when(lower.rlike(r"\.(gb|gbk|genbank)$"), "genbank").otherwise(default)
    rows = texts.select("source_path", "text", kind.alias("kind"))
    out = None
    for k, cut in (("fasta", "\n>"), ("genbank", r"\n//(?=\s|$)")):
        blocks = rows.where(F.col("kind") == k).select("source_path", F.posexplode(F.split("text", cut)).alias("ord", "block"))
        blocks = blocks.where(F.regexp_replace("block", r"\s", "") != "").withColumn("ord", F.col("ord").cast("long"))
        part = parse(blocks, k, fasta_case)
        out = part if out is None else out.unionByName(part)
    return out


def pasted(spark: SparkSession, text: str) -> DataFrame:
    """A pasted sequence as the only record of a FASTA text; an empty one is refused."""
    if not text.strip():
        raise ValueError("a sequence is needed")
    if not re.fullmatch(r"[ATCGatcg\s]*", text):
        raise ValueError("only the letters A, T, C and G are allowed")
    return from_texts(spark.createDataFrame([("pasted.fa", ">User_Sequence\n" + text)], "source_path string, text string"))


def parse(blocks: DataFrame, kind: str, fasta_case: str = "preserve") -> DataFrame:
    """Blocks of text (``source_path``, ``ord``, ``block``), one per record, as records."""
    return _fasta(blocks, fasta_case) if kind == "fasta" else _genbank(blocks)


def _fasta(blocks: DataFrame, fasta_case: str) -> DataFrame:
    text = F.regexp_replace("block", r"^\s*>", "")
    header = F.trim(F.regexp_extract(text, r"^([^\r\n]*)", 1))
    seq = F.regexp_replace(F.regexp_replace(text, r"^[^\r\n]*", ""), r"\s", "")
    ident = F.regexp_extract(header, r"^(\S*)", 1)
    seq = F.upper(seq) if fasta_case == "upper" else seq
    return blocks.select(
        ident.alias("seq_id"), "ord", ident.alias("name"), header.alias("description"), seq.alias("seq"), F.length(seq).cast("long").alias("length"),
        F.lit(None).cast("string").alias("topology"), F.lit(None).cast("string").alias("molecule_type"), "source_path", F.array().cast(FEATURES).alias("features"),
    )


def _entry(text: Column, key: str) -> Column:
    """A header entry with its continuation lines, null if it is missing or '.'."""
    found = F.regexp_extract(text, rf"(?:^|\n){key} +([^\n]*(?:\n {{12}}[^\n]*)*)", 1)
    found = F.trim(F.regexp_replace(found, r"\s*\n\s+", " "))
    return F.when((found == "") | (found == "."), None).otherwise(found)


def _genbank(blocks: DataFrame) -> DataFrame:
    # the first character of a block may be what is left of the line that ended the one before
    rows = blocks.select("source_path", "ord", F.ltrim(F.regexp_replace("block", "\r", "")).alias("t"))
    rows = rows.withColumn("t", F.regexp_replace("t", r"^\s*", "")).where("t <> ''")
    locus = F.regexp_extract("t", r"^LOCUS +([^\n]*)", 1)
    origin = F.regexp_extract("t", r"(?s)\nORIGIN[^\n]*\n(.*)$", 1)
    table = F.regexp_extract("t", r"(?s)\nFEATURES[^\n]*(.*?)(?=\n\S|$)", 1)
    rows = rows.withColumns({"locus": locus, "seq": F.upper(F.regexp_replace(origin, "[^A-Za-z]", "")), "table": table})
    version, accession = _entry(F.col("t"), "VERSION"), _entry(F.col("t"), "ACCESSION")
    name = F.regexp_extract("locus", r"^(\S+)", 1)
    kind = F.regexp_extract("locus", r"^\S+ +\d+ +bp +(\S+)", 1)
    topology = F.nullif(F.lower(F.regexp_extract("locus", r"(?i)\b(circular|linear)\b", 1)), F.lit(""))
    entries = F.filter(F.split("table", r"\n(?= {5}\S)"), lambda x: F.trim(x) != "")
    # one column a step, so that each is worked out once
    rows = rows.withColumn("entries", F.transform(entries, _split_entry)).withColumn("entries", F.transform("entries", _named))
    return rows.select(
        F.regexp_extract(F.coalesce(version, accession, name), r"^(\S+)", 1).alias("seq_id"), "ord", name.alias("name"), F.coalesce(_entry(F.col("t"), "DEFINITION"), F.lit("")).alias("description"),
        "seq", F.length("seq").cast("long").alias("length"), topology.alias("topology"), F.nullif(kind, F.lit("")).alias("molecule_type"), "source_path",
        F.transform("entries", _feature).cast(FEATURES).alias("features"),
    )


def _split_entry(entry: Column) -> Column:
    parts = F.split(entry, r"\n {10,}/(?=[A-Za-z_])")
    return F.struct(F.trim(F.element_at(parts, 1)).alias("head"), F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))).alias("marks"))


def _named(entry: Column) -> Column:
    location = F.regexp_replace(F.regexp_replace(entry["head"], r"^\S+", ""), r"\s", "")
    here = F.regexp_replace(location, r"[A-Za-z_][\w.]*:[^,)]*", "")  # parts on other records are not counted
    numbers = F.transform(F.regexp_extract_all(here, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("long"))
    return F.struct(F.regexp_extract(entry["head"], r"^(\S+)", 1).alias("type"), location.alias("location"), numbers.alias("numbers"), F.transform(entry["marks"], _qualifier).alias("marks"))


def _feature(entry: Column) -> Column:
    location, numbers, marks = entry["location"], entry["numbers"], entry["marks"]
    joined = location.rlike("join|order|bond")  # else the range as written, even in reverse
    names = F.array_distinct(marks["name"])
    grouped = F.map_from_arrays(names, F.transform(names, lambda n: F.transform(F.filter(marks, lambda q: q["name"] == n), lambda q: q["value"])))
    return F.struct(
        entry["type"].alias("type"), (F.when(joined, F.array_min(numbers)).otherwise(F.try_element_at(numbers, F.lit(1))) - 1).alias("start"),
        F.when(joined, F.array_max(numbers)).otherwise(F.try_element_at(numbers, F.lit(-1))).alias("end"),
        F.when(location.startswith("complement("), -1).otherwise(1).alias("strand"), location.contains("<").alias("start_fuzzy"), location.contains(">").alias("end_fuzzy"), grouped.alias("qualifiers"),
    )


def _qualifier(text: Column) -> Column:
    name = F.regexp_extract(text, r"^([^=\s]+)", 1)
    raw = F.trim(F.regexp_replace(text, r"^[^=\n]*=?", ""))
    value = F.regexp_replace(raw, r"\s*\n\s*", F.when(name == "translation", "").otherwise(" "))
    quoted = value.startswith('"')
    inner = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, '^"', ""), '"$', ""), '""', '"')
    return F.struct(name.alias("name"), F.when(quoted, inner).otherwise(value).alias("value"))


def check_total_size(spark: SparkSession, paths: list[str], most: int = 3 * 1024 * 1024) -> int:
    """Total bytes of the files; more than ``most`` are refused. Only the file listing is read."""
    size = spark.read.format("binaryFile").load(paths).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    if size > most:
        raise ValueError(f"the files have {size / 2**20:.2f} MB, at most {most / 2**20:.2f} MB are allowed")
    return size


def first_records(records: DataFrame) -> DataFrame:
    """The first record of each file."""
    least = records.groupBy("source_path").agg(F.min("ord").alias("ord"))
    return records.join(least, ["source_path", "ord"], "left_semi")
