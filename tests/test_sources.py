import base64

import pytest
from pyspark.sql import functions as F

from strandloom import cli
from strandloom.operators import kmers
from strandloom.operators.overlaps import FragmentConfig
from strandloom.operators.regions import feature_regions
from strandloom.plans import pipeline
from strandloom.sources import manifest as mf
from strandloom.sources import sequence_files as sf
from strandloom.sources import writers

GB = """LOCUS       one                       16 bp    DNA     circular UNK 01-JAN-1980
DEFINITION  First record
            goes on.
ACCESSION   ACC1
VERSION     ACC1.2
FEATURES             Location/Qualifiers
     source          1..16
                     /organism="synthetic ""quoted"" thing"
                     /mol_type="genomic
                     DNA"
     misc_feature    6..10
                     /label="homology_free"
                     /note="a"
                     /note="b"
     misc_feature    complement(<3..>8)
                     /label="other"
     CDS             join(2..4,8..12)
                     /translation=MAE
                     TAV
                     /pseudo
     misc_feature    2..4
                     /label="homology_free"
ORIGIN
        1 atgcatgcaa ggcctt
//
LOCUS       two                        5 bp    DNA              UNK 01-JAN-1980
FEATURES             Location/Qualifiers
ORIGIN
        1 ATCGA
//
"""


@pytest.fixture
def files(tmp_path):
    (tmp_path / "a.GBK").write_text(GB)
    (tmp_path / "crlf.gb").write_bytes(GB.replace("\n", "\r\n").encode())
    (tmp_path / "b.fa").write_text(">s1 about > it\nATCG\nATcg\r\n\nAT\n>s2\n>s3 x\nAC\n")
    (tmp_path / "c.fasta").write_text("")
    (tmp_path / "d.csv").write_text("a,b\n1,2\n")
    return tmp_path


def test_genbank(spark, files):
    for name in ("a.GBK", "crlf.gb"):
        one, two = sf.read_sequences(spark, str(files / name)).orderBy("ord").collect()
        assert (one["seq_id"], one["name"], one["description"], one["seq"], one["length"], one["topology"], one["molecule_type"]) == ("ACC1.2", "one", "First record goes on.", "ATGCATGCAAGGCCTT", 16, "circular", "DNA")
        assert (two["seq_id"], two["seq"], two["topology"], two["features"]) == ("two", "ATCGA", None, [])
        f = one["features"]
        assert [(x["type"], x["start"], x["end"], x["strand"], x["start_fuzzy"], x["end_fuzzy"]) for x in f] == [
            ("source", 0, 16, 1, False, False), ("misc_feature", 5, 10, 1, False, False), ("misc_feature", 2, 8, -1, True, True), ("CDS", 1, 12, 1, False, False), ("misc_feature", 1, 4, 1, False, False),
        ]
        assert f[0]["qualifiers"] == {"organism": ['synthetic "quoted" thing'], "mol_type": ["genomic DNA"]}
        assert f[1]["qualifiers"]["note"] == ["a", "b"] and f[3]["qualifiers"] == {"translation": ["MAETAV"], "pseudo": [""]}
    regions = feature_regions(sf.read_sequences(spark, str(files / "a.GBK")), "seq_id").collect()
    assert {r["seq_id"]: [tuple(x) for x in r["regions"]] for r in regions} == {"ACC1.2": [(1, 4), (5, 10)], "two": []}


def test_fasta_and_lists_of_files(spark, files):
    rows = sf.read_sequences(spark, [str(files / "b.fa"), str(files / "a.GBK"), str(files / "c.fasta")]).collect()
    fasta = sorted((r["ord"], r["seq_id"], r["description"], r["seq"]) for r in rows if r["source_path"].endswith("b.fa"))
    assert fasta == [(0, "s1", "s1 about > it", "ATCGATcgAT"), (1, "s2", "s2", ""), (2, "s3", "s3 x", "AC")]
    assert len(rows) == 5
    assert sf.read_sequences(spark, str(files / "b.fa"), fasta_case="upper").where("ord = 0").first()["seq"] == "ATCGATCGAT"


def test_refused_files(spark, files):
    with pytest.raises(ValueError):
        sf.read_sequences(spark, str(files / "d.csv"))
    with pytest.raises(FileNotFoundError):
        sf.read_sequences(spark, str(files / "none.fa"))
    with pytest.raises(ValueError):
        sf.read_one(spark, str(files / "a.GBK"))
    with pytest.raises(ValueError):
        sf.pasted(spark, "ACGX")
    assert sf.pasted(spark, "AC\nGT").first()["seq"] == "ACGT"


def test_size_guard_and_first_records(spark, files):
    paths = [str(files / "b.fa"), str(files / "a.GBK")]
    assert sf.check_total_size(spark, paths) == sum((files / p).stat().st_size for p in ("b.fa", "a.GBK"))
    with pytest.raises(ValueError):
        sf.check_total_size(spark, paths, most=10)
    assert sorted(r["seq_id"] for r in sf.first_records(sf.read_sequences(spark, paths)).collect()) == ["ACC1.2", "s1"]


def test_uploads_by_suffix_or_default(spark):
    df = spark.createDataFrame([("q.txt", ">x\nACGT"), ("y.gb", GB), ("z.fa", None), ("e", "")], "source_path string, text string")
    assert sorted(r["seq_id"] for r in sf.from_texts(df).collect()) == ["ACC1.2", "two", "x"]
    df = spark.createDataFrame([("q.txt", GB), ("z.fasta", ">x\nACGT")], "source_path string, text string")
    assert sorted(r["seq_id"] for r in sf.from_texts(df, default="genbank").collect()) == ["ACC1.2", "two", "x"]


def test_round_trip_through_files(spark, files):
    rows = sf.read_sequences(spark, str(files / "a.GBK"))
    writers.write_records(rows, str(files / "out.gb"), one_file=True)
    back = sf.parse(
        spark.read.option("lineSep", "\n//").text(str(files / "out.gb")).select(F.lit("x").alias("source_path"), F.monotonically_increasing_id().alias("ord"), F.col("value").alias("block")), "genbank"
    )
    keep = ["seq_id", "name", "description", "seq", "features"]
    want = [r.asDict(True) for r in rows.select(*keep).orderBy("seq_id").collect()]
    assert [r.asDict(True) for r in back.select(*keep).orderBy("seq_id").collect()] == want
    writers.write_records(rows, str(files / "out.fa"), one_file=True)
    text = (files / "out.fa").read_text()
    assert text == ">ACC1.2 First record goes on.\nATGCATGCAAGGCCTT\n>two\nATCGA\n"


def test_manifest(spark, tmp_path):
    (tmp_path / "m.csv").write_text("species,assembly,file_name,kmer_size,id\nA. b,X,f1,15,one\nC. d,Y,f2,20,two\nA. b,X,f1,15,one\n")
    table = mf.read_manifest(spark, str(tmp_path / "m.csv"))
    assert mf.kmer_size(mf.chosen(table, "one, nobody")) == 15
    assert mf.kmer_size(mf.chosen(table, "")) == 15 and mf.chosen(table, "one,one").count() == 1
    with pytest.raises(ValueError):
        mf.kmer_size(mf.chosen(table, "one,two"))
    assert mf.display(table).count() == 2
    kmers.save_index(spark.createDataFrame([(5,)], "kmer long"), str(tmp_path / "index"), "two", 20)
    assert [r["id"] for r in mf.available(table, str(tmp_path / "index")).collect()] == ["two"]


def test_command_line(spark, tmp_path):
    import random

    rng = random.Random(1)
    seq = "".join(rng.choice("ACGT") for _ in range(900))
    (tmp_path / "q.fa").write_text(">q\n" + seq + "\n")
    (tmp_path / "b.fa").write_text(">b\n" + seq[300:420] + "\n")
    out = str(tmp_path / "ann.gb")
    assert cli.main(["annotate-homology", str(tmp_path / "q.fa"), "-b", str(tmp_path / "b.fa"), "-k", "15", "-t", "40", "-o", out], spark) == 0
    one = tmp_path / "one.gb"
    one.write_text((tmp_path / "ann.gb").read_text())
    row = sf.read_one(spark, str(one)).first()
    assert row["seq_id"] == "q_annotated" and [(f["start"], f["end"]) for f in row["features"]] == [(0, 314), (406, 900)]
    args = ["fragment", str(one), "--min-size", "200", "--max-size", "400", "--min-overlap", "30", "--max-overlap", "60", "-o", str(tmp_path / "f.gb"), "-f", str(tmp_path / "f.fa")]
    assert cli.main(args, spark) == 0
    fasta = (tmp_path / "f.fa").read_text()
    pieces = ["".join(x.split("\n")[1:]) for x in fasta.split(">")[1:]]
    assert len(pieces) >= 3 and all(200 <= len(p) <= 400 for p in pieces)
    whole = pieces[0]
    for p in pieces[1:]:
        assert whole[-30:] == p[:30].upper() or whole[-30:] == p[:30]
        whole += p[30:]
    assert whole == seq
    assert cli.main(["store-index", str(tmp_path / "b.fa"), "-k", "15", "-i", "b", "-o", str(tmp_path / "index")], spark) == 0
    with pytest.raises(ValueError):
        cli.main([*args[:3], "500", *args[4:]], spark)


def test_process_and_fragment(spark):
    import random

    rng = random.Random(2)
    rows = [("q.fa", i, f"s{i}", "".join(rng.choice("ACGT") for _ in range(500 + 100 * i)), "circular") for i in range(3)] + [("q.fa", 9, "none", None, None)]
    base = spark.createDataFrame(rows, "source_path string, ord long, seq_id string, seq string, topology string")
    records = base.select("*", F.col("seq_id").alias("name"), F.lit("").alias("description"), F.lit("DNA").alias("molecule_type"), F.array().cast(sf.FEATURES).alias("features"))
    out = {r["seq_id"]: r for r in pipeline.process_and_fragment(records, records.limit(0), FragmentConfig(150, 300, 30, 60), k=15).collect()}
    assert len(out) == 4
    row = out["s1_annotated"]
    assert row["status"] == "ok" and row["fragments"] >= 2 and row["regions"] == 1
    assert base64.b64decode(row["fasta"]).decode().count(">") == row["fragments"]
    assert base64.b64decode(row["genbank"]).decode().count("     fragment ") == row["fragments"]
    assert out["none_annotated"]["status"] == "no sequence"


def test_files_keep_the_given_order_and_their_splits_are_numbered_without_moving_them(spark, tmp_path):
    for name, n in (("z", 30_000), ("a b+c", 20)):
        (tmp_path / f"{name}.fa").write_text("".join(f">{name[0]}{i}\n{'ACGT' * 5}\n" for i in range(n)))
    (tmp_path / "m.gb").write_text(GB)
    paths = [str(tmp_path / f) for f in ("z.fa", "m.gb", "a b+c.fa")]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        for given in (paths, paths[::-1]):
            df = sf.read_sequences(spark, given)
            rows = df.select("file_no", "ord", "seq_id").collect()
            assert len({(r["file_no"], r["ord"]) for r in rows}) == len(rows) == 30_022
            want = {"z": given.index(paths[0]), "A": given.index(paths[1]), "t": given.index(paths[1]), "a": given.index(paths[2])}
            assert all(r["file_no"] == want[r["seq_id"][0]] for r in rows)
            assert all(r["seq_id"] == f"z{r['ord']}" for r in rows if r["seq_id"][0] == "z")
        writers.write_records(sf.read_sequences(spark, paths), str(tmp_path / "all.fa"), one_file=True)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    ids = [line[1:].split()[0] for line in (tmp_path / "all.fa").read_text().split("\n") if line.startswith(">")]
    assert ids == [*(f"z{i}" for i in range(30_000)), "ACC1.2", "two", *(f"a{i}" for i in range(20))]


def test_an_entry_with_many_qualifiers_keeps_them_all(spark):
    marks = "\n".join(f'                     /note="n{i}"' for i in range(1000))
    text = GB.replace('                     /label="other"', marks)
    rows = sf.from_texts(spark.createDataFrame([("x.gb", text)], "source_path string, text string")).where("ord = 0").first()
    assert rows["features"][2]["qualifiers"] == {"note": [f"n{i}" for i in range(1000)]}


def test_an_empty_paste_is_refused(spark):
    with pytest.raises(ValueError):
        sf.pasted(spark, " \n")


def test_a_cluster_without_a_common_folder_is_refused():
    from types import SimpleNamespace

    from strandloom.session import common_folder

    def session(master, folder):
        context = SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda k: folder))
        return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d: d))

    assert common_folder(session("spark://host:7077", "hdfs:///x")) == "hdfs:///x"
    with pytest.raises(ValueError):
        common_folder(session("local-cluster[2,1,1024]", None))


def test_targets_and_motifs_are_checked_first(spark, files):
    with pytest.raises(FileNotFoundError):
        cli.main(["annotate-homology", str(files / "a.GBK"), "-o", str(files / "nowhere" / "x.gb")], spark)
    with pytest.raises(IsADirectoryError):
        writers.check_target(spark, str(files))
    with pytest.raises(ValueError):
        pipeline.process_and_fragment(sf.read_sequences(spark, str(files / "a.GBK")), None, FragmentConfig(5, 10, 2, 4, "GNC"))
