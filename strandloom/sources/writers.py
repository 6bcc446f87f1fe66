"""Records and fragments as FASTA and GenBank text."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INDENT = " " * 21


def _one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def fasta_text(ident: Column, description: Column, seq: Column) -> Column:
    """``>id description`` and the sequence in lines of 60 letters."""
    about = _one_line(description)
    title = F.when((about == "") | (about == ident), ident).when(about.startswith(F.concat(ident, F.lit(" "))), about).otherwise(F.concat(ident, F.lit(" "), about))
    return F.concat(F.lit(">"), title, F.lit("\n"), F.regexp_replace(F.coalesce(seq, F.lit("")), "(.{60})(?=.)", "$1\n"))


def _location(f: Column) -> Column:
    low = F.concat(F.when(f["start_fuzzy"], "<").otherwise(""), (f["start"] + 1).cast("string"))
    high = F.concat(F.when(f["end_fuzzy"], ">").otherwise(""), f["end"].cast("string"))
    span = F.concat(low, F.lit(".."), high)
    return F.when(f["strand"] == -1, F.concat(F.lit("complement("), span, F.lit(")"))).otherwise(span)


def _qualifiers(f: Column) -> Column:
    def line(name: Column, value: Column) -> Column:
        text = F.concat(F.lit("/"), name, F.lit('="'), F.regexp_replace(_one_line(value), '"', '""'), F.lit('"'))
        return F.concat(F.lit("\n" + INDENT), F.regexp_replace(text, "(.{1,58}) (?=.)", "$1\n" + INDENT))

    names = F.map_keys(f["qualifiers"])
    lines = F.flatten(F.transform(names, lambda n: F.transform(f["qualifiers"][n], lambda v: line(n, v))))
    return F.coalesce(F.concat_ws("", lines), F.lit(""))


def genbank_text(records: DataFrame) -> Column:
    """One record as GenBank text without its end line; features without a range are left out."""
    seq = F.lower(F.coalesce("seq", F.lit("")))
    size = F.length(seq)
    topology = F.when(F.lower("topology") == "circular", "circular").otherwise("linear")
    name = F.coalesce(F.nullif(F.regexp_replace("name", r"\s", "_"), F.lit("")), F.regexp_replace("seq_id", r"\s", "_"))
    locus = F.format_string("LOCUS       %-16s %11d bp    %-6s  %-8s UNK 01-JAN-1980", name, size, F.coalesce("molecule_type", F.lit("DNA")), topology)
    usable = F.filter(F.coalesce("features", F.array().cast(records.schema["features"].dataType)), lambda f: f["start"].isNotNull() & f["end"].isNotNull())
    features = F.transform(usable, lambda f: F.concat(F.lit("\n     "), F.rpad(F.coalesce(f["type"], F.lit("misc_feature")), 16, " "), _location(f), _qualifiers(f)))
    starts = F.when(size > 0, F.sequence(F.lit(0), size - 1, F.lit(60))).otherwise(F.array().cast("array<int>"))
    lines = F.transform(starts, lambda i: F.concat(F.lit("\n"), F.lpad((i + 1).cast("string"), 9, " "), F.lit(" "), F.regexp_replace(F.substring(seq, i + 1, F.lit(60)), "(.{10})(?=.)", "$1 ")))
    return F.concat(
        locus, F.lit("\nDEFINITION  "), _one_line(F.col("description")), F.lit("\nACCESSION   "), F.col("seq_id"), F.lit("\nVERSION     "), F.col("seq_id"),
        F.lit("\nKEYWORDS    .\nSOURCE      .\n  ORGANISM  .\n            .\nFEATURES             Location/Qualifiers"), F.concat_ws("", features), F.lit("\nORIGIN"), F.concat_ws("", lines), F.lit("\n//"),
    )


def write_text(df: DataFrame, text: Column, path: str, order: list[str], one_file: bool = False) -> None:
    """Write one text per row, in order: as a folder of files whose names sort in the same order, or joined to one file.

    The one file is put together by copying the sorted parts one after another,
    as a stream; no task or process holds more than a copy's buffer.
    """
    rows = df.select(text.alias("value"), *order)
    folder = f"{path}.parts-{uuid.uuid4().hex}" if one_file else path
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.mode("overwrite").text(folder)
    if one_file:
        _join_parts(df.sparkSession, folder, path)


def check_target(spark: SparkSession, path: str) -> None:
    """A file can be written there: its folder is there, and it is no folder itself."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    target = files.makeQualified(target)
    if not files.exists(target.getParent()):
        raise FileNotFoundError(str(target.getParent()))
    if files.exists(target) and files.getFileStatus(target).isDirectory():
        raise IsADirectoryError(path)


def _join_parts(spark: SparkSession, folder: str, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    source, target = jvm.org.apache.hadoop.fs.Path(folder), jvm.org.apache.hadoop.fs.Path(path)
    files = source.getFileSystem(conf)
    parts = sorted((f.getPath() for f in files.listStatus(source) if f.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    out = target.getFileSystem(conf).create(target, True)
    try:
        for part in parts:
            stream = files.open(part)
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 20, False)
            stream.close()
    finally:
        out.close()
    files.delete(source, True)


def write_records(records: DataFrame, path: str, order: list[str] | None = None, one_file: bool = False) -> None:
    """GenBank if the path ends in a GenBank suffix, else FASTA, where features are lost."""
    if path.lower().endswith((".gb", ".gbk", ".genbank")):
        text = genbank_text(records)
    else:
        text = fasta_text(F.col("seq_id"), F.col("description"), F.col("seq"))
    known = ["file_no", "ord"] if "file_no" in records.columns else ["source_path", "ord"]
    write_text(records, text, path, order or known, one_file)


def write_fragments(frags: DataFrame, path: str, one_file: bool = False) -> None:
    write_text(frags, fasta_text(F.col("fragment_id"), F.col("description"), F.col("sequence")), path, ["rec_id", "config_id", "idx"], one_file)
