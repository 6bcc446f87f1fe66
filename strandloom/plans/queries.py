"""Core queries over the given tables, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.letters import IUPAC, IUPAC_COMPLEMENT, is_circular, letters, reverse_complement
from strandloom.operators import fragments as fr
from strandloom.operators import graph, intervals, kmers, overlaps, regions
from strandloom.operators.overlaps import FragmentConfig
from strandloom.plans import pipeline
from strandloom.session import cut_lineage, read_table, shared_folder
from strandloom.sources import manifest as mf
from strandloom.sources import sequence_files as sf
from strandloom.sources import writers

K, THRESHOLD, EVEN_K, LONG_K, OVERLAP = 15, 60, 12, 40, 30


def _sequences(spark: SparkSession, sf_dir: str, role: str | None = None) -> DataFrame:
    rows = read_table(spark, sf_dir, "sequences")
    return rows if role is None else rows.where(F.col("role") == role)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.periods(intervals.homology_free_ranges(_sequences(spark, sf_dir)), ["rec_id"], "start", "end")


def seq_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = letters(F.col("seq"))
    return _sequences(spark, sf_dir).select(
        "rec_id", F.coalesce(F.length(text), F.lit(0)).cast("long").alias("n_letters"), is_circular(F.col("topology")).alias("circular"),
        F.coalesce(F.col("seq").rlike(r"^[ATCGatcg\s]*$"), F.lit(False)).alias("plain_dna"), F.coalesce(F.size("features"), F.lit(0)).alias("n_features"),
    )


def revcomp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sequences(spark, sf_dir).where("seq is not null").select("rec_id", F.md5(reverse_complement(letters(F.col("seq")))).alias("digest"))


def kmer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct k-mers of each record on both strands, and those repeated within it."""
    rows = kmers.record_kmers(_sequences(spark, sf_dir), EVEN_K)
    return rows.groupBy("rec_id").agg(F.count("*").alias("kmers"), F.sum("times").alias("occurrences"), F.count_if(F.col("times") >= 2).alias("repeated"))


def circular_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sequences(spark, sf_dir).where(is_circular(F.col("topology")))
    return kmers.kmer_windows(rows, K).groupBy("rec_id").agg(F.count("*").alias("windows"), F.max("pos").alias("last_pos"))


def background_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct strand-neutral k-mers of the background, those with ambiguous letters too."""
    rows = kmers.background_set(_sequences(spark, sf_dir, "background"), K, spelled=True)
    return rows.select(kmers.kmer_text(F.col("kmer"), K, F.col("word")).alias("kmer"))


def repeated_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k-mers that a record holds more than once, those with ambiguous letters too."""
    rows = kmers.record_kmers(_sequences(spark, sf_dir), EVEN_K, spelled=True).where("times >= 2")
    return rows.select("rec_id", kmers.kmer_text(F.col("kmer"), EVEN_K, F.col("word")).alias("kmer"), "times")


def _free(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = kmers.background_set(_sequences(spark, sf_dir, "background"), K)
    return kmers.free_in_record(_sequences(spark, sf_dir, "query"), K).join(known.hint("merge"), "kmer", "left_anti")  # without the hint a set taken for small is gathered by the driver


def anti_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of each query record that are in no background record and occur once, counted by the runs they form."""
    known = kmers.window_set(_sequences(spark, sf_dir, "background"), K)
    found = regions.homology_free_regions(_sequences(spark, sf_dir, "query"), known, K, K)
    return found.groupBy("rec_id").agg(F.coalesce(F.sum(F.col("end") - F.col("start") - (K - 1)), F.lit(0).cast("long")).alias("free_positions"))


def region_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All runs of windows that ``anti_background`` counts, the long enough ones chosen from them afterwards."""
    known = kmers.window_set(_sequences(spark, sf_dir, "background"), K)
    found = regions.homology_free_regions(_sequences(spark, sf_dir, "query"), known, K, K)
    return found.where(F.col("end") - F.col("start") >= THRESHOLD)


def homology_free_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: regions of the query records free of the background records and of repeats."""
    known = kmers.window_set(_sequences(spark, sf_dir, "background"), K)
    return regions.homology_free_regions(_sequences(spark, sf_dir, "query"), known, K, THRESHOLD)


def indexed_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through a stored index."""
    path = shared_folder(spark, "index")
    kmers.save_index(kmers.background_set(_sequences(spark, sf_dir, "background"), K), path, "all", K)
    known, k = kmers.load_index(spark, path, ["all", "unknown"])
    return regions.homology_free_regions(_sequences(spark, sf_dir, "query"), known, k, THRESHOLD)


def numbered_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.numbered(homology_free_regions(spark, sf_dir)).withColumn("region_no", F.col("region_no").cast("long"))


def annotated_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = homology_free_regions(spark, sf_dir)
    out = fr.annotate_regions(_sequences(spark, sf_dir, "query"), found)
    last = F.try_element_at("features", F.lit(-1))
    return out.select("rec_id", "seq_id", F.size("features").cast("long").alias("n_features"), last["type"].alias("last_type"), last["end"].alias("last_end"))


def feature_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = regions.feature_regions(_sequences(spark, sf_dir))
    return rows.select("rec_id", F.posexplode("regions").alias("n", "r")).select("rec_id", F.col("n").cast("long").alias("n"), F.col("r.start").alias("start"), F.col("r.end").alias("end"))


def probes_by_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probes of known backgrounds, with the k-mer size each background asks for."""
    known = mf.first_of_each(read_table(spark, sf_dir, "manifest"))
    rows = read_table(spark, sf_dir, "probes").join(known, F.col("background_id") == F.col("id"))
    return rows.groupBy("background_id").agg(F.count("*").alias("probes"), F.max("kmer_size").alias("k"))


def _work(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    work = overlaps.jobs(read_table(spark, sf_dir, "requests"), read_table(spark, sf_dir, "config"))
    texts = _sequences(spark, sf_dir).where("seq is not null").select("rec_id", letters(F.col("seq")).alias("text"))
    return work, read_table(spark, sf_dir, "regions"), texts


def free_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    work, found, _ = _work(spark, sf_dir)
    return overlaps.free_overlaps(work, found)


def motif_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps.motif_overlaps(overlaps.motif_hits(*_work(spark, sf_dir)))


def candidate_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps.candidates(*_work(spark, sf_dir)).withColumn("ord", F.col("ord").cast("long"))


def overlap_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    work, found, texts = _work(spark, sf_dir)
    return graph.overlap_edges(overlaps.candidates(work, found, texts), work)


def _components(spark: SparkSession, sf_dir: str):
    work, found, texts = _work(spark, sf_dir)
    nodes = cut_lineage(overlaps.candidates(work, found, texts))
    return work, found, texts, nodes, graph.components(nodes, work)


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _components(spark, sf_dir)[-1]
    return parts.groupBy("rec_id", "config_id").agg(F.countDistinct("component").alias("components"), F.count("*").alias("nodes"))


def gap_region_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    work, found, texts, nodes, parts = _components(spark, sf_dir)
    gaps = graph.component_gaps(parts, nodes, work, texts.select("rec_id", F.length("text").cast("long").alias("L")))
    return graph.gap_regions(gaps, found)


def tilings(spark: SparkSession, sf_dir: str) -> DataFrame:
    work, found, texts = _work(spark, sf_dir)
    return graph.tilings(overlaps.candidates(work, found, texts), found, work)


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.fragments(tilings(spark, sf_dir))


def fragment_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _sequences(spark, sf_dir).where("seq is not null").select("rec_id", "seq_id", letters(F.col("seq")).alias("text"))
    return fr.fragment_records(fragments(spark, sf_dir), texts)


def _connected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tilings(spark, sf_dir).where("status = 'ok' and components = 1")


def connected_tilings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost and number of fragments of the jobs whose overlap graph needs no repair."""
    return _connected(spark, sf_dir).select("rec_id", "config_id", "cost", F.size("steps").cast("long").alias("n_fragments"))


def connected_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _sequences(spark, sf_dir).where("seq is not null").select("rec_id", "seq_id", letters(F.col("seq")).alias("text"))
    out = fr.fragment_records(fr.fragments(_connected(spark, sf_dir)), texts)
    return out.withColumn("digest", F.md5("sequence")).withColumn("idx", F.col("idx").cast("long")).drop("sequence")


def fragment_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with the fragments of all their jobs without repair as features."""
    out = fr.annotate_fragments(_sequences(spark, sf_dir), fr.fragments(_connected(spark, sf_dir)))
    last = F.try_element_at("features", F.lit(-1))
    return out.select("rec_id", F.size("features").cast("long").alias("n_features"), last["type"].alias("last_type"), last["end"].alias("last_end"))


def jobs_by_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct jobs of every usable configuration."""
    rows = overlaps.jobs(read_table(spark, sf_dir, "requests"), read_table(spark, sf_dir, "config"))
    return rows.groupBy("config_id").agg(F.count("*").alias("jobs"), F.count("motif").alias("with_motif"))


def stored_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries written to one FASTA file and all else to one GenBank file, both read again in the given order."""
    folder = shared_folder(spark, "files")
    rows = _sequences(spark, sf_dir).where("seq is not null").withColumn("seq", letters(F.col("seq"))).withColumn("seq_id", F.concat(F.lit("r"), F.col("rec_id").cast("string")))
    paths = [f"{folder}/records.gb", f"{folder}/queries.fa"]
    writers.write_records(rows.where("role <=> 'query'"), paths[1], ["rec_id"], one_file=True)
    writers.write_records(rows.where("not role <=> 'query'"), paths[0], ["rec_id"], one_file=True)
    back = sf.read_sequences(spark, paths)
    return back.select(F.col("file_no").cast("long").alias("file_no"), "ord", F.expr("cast(substring(seq_id, 2) as bigint)").alias("rec_id"), "length", F.md5("seq").alias("digest"))


def uploaded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record as an upload of its own: FASTA, GenBank by suffix, and FASTA without one."""
    rows = _sequences(spark, sf_dir).where("seq is not null").withColumn("seq", letters(F.col("seq"))).withColumn("seq_id", F.concat(F.lit("r"), F.col("rec_id").cast("string")))
    fasta = writers.fasta_text(F.col("seq_id"), F.col("description"), F.col("seq"))
    kind = F.col("rec_id") % 3
    name = F.concat("seq_id", F.when(kind == 0, ".fa").when(kind == 1, ".GB").otherwise(""))
    back = sf.from_texts(rows.select(name.alias("source_path"), F.when(kind == 1, writers.genbank_text(rows)).otherwise(fasta).alias("text")))
    return back.select("source_path", "ord", "seq_id", "length", F.md5("seq").alias("digest"))


def first_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sf.first_records(_sequences(spark, sf_dir)).select("source_path", "ord", "rec_id")


def known_backgrounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest as a CSV file, its named backgrounds chosen and shown."""
    path = shared_folder(spark, "manifest")
    table = read_table(spark, sf_dir, "manifest").select(*(f.split()[0] for f in mf.MANIFEST.split(", ")))
    table.write.csv(path, header=True)
    ids = table.where("id is not null").groupBy().agg(F.array_join(F.sort_array(F.collect_set("id")), ",")).first()[0]  # as a user would type them; the list of backgrounds is short
    return mf.display(mf.chosen(mf.read_manifest(spark, path), f"{ids},unknown"))


def background_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k-mer sets stored by role, and those of the manifest's shape that are there."""
    path = shared_folder(spark, "indexes")
    for role in ("query", "background"):
        kmers.save_index(kmers.background_set(_sequences(spark, sf_dir, role), K), path, role, K)
    listed = spark.createDataFrame([("a", "x", "f", K, i) for i in ("query", "background", "missing")], mf.MANIFEST)
    there = mf.available(listed, path).select("id", "kmer_size")
    stored = spark.read.schema("kmer long, background_id string, k int").parquet(path).groupBy("background_id").agg(F.count("*").alias("kmers"))
    return there.join(stored, there["id"] == stored["background_id"]).select("background_id", "kmer_size", "kmers")


def merged_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k-mers on both strands of two sets merged."""
    sets = [kmers.background_set(_sequences(spark, sf_dir, role), EVEN_K) for role in ("query", "background")]
    return kmers.both_strands(kmers.merge_sets(sets), EVEN_K)


def long_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct k-mers of each record for a k beyond 31."""
    rows = kmers.record_kmers(_sequences(spark, sf_dir), LONG_K)
    return rows.groupBy("rec_id").agg(F.count("*").alias("kmers"), F.sum("times").alias("occurrences"), F.count_if(F.col("times") >= 2).alias("repeated"))


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotate and fragment every query record in one go, and read the answer's texts again."""
    rows = _sequences(spark, sf_dir).withColumn("seq", letters(F.col("seq")))
    out = pipeline.process_and_fragment(rows.where("role = 'query'"), rows.where("role = 'background'"), FragmentConfig(200, 3000, OVERLAP, 60), K)
    answer = F.from_json(pipeline.as_json(), "status string, annotated_file string, fragments_file string")
    text = lambda name: F.decode(F.unbase64(F.col(f"a.{name}")), "UTF-8")
    out = out.select("rec_id", F.col("regions").cast("long").alias("regions"), "fragments", answer.alias("a"))
    marked = F.regexp_count(text("annotated_file"), F.lit('/label="homology_free"'))
    return out.select("rec_id", "regions", (marked >= F.col("regions")).alias("marked"), (F.regexp_count(text("fragments_file"), F.lit("(?m)^>")) == F.col("fragments")).alias("complete"))


def fasta_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as FASTA text and read again."""
    rows = _sequences(spark, sf_dir).where("seq is not null")
    text = writers.fasta_text(F.concat(F.lit("r"), F.col("rec_id").cast("string")), F.col("description"), letters(F.col("seq")))
    back = sf.parse(rows.select("source_path", F.col("rec_id").alias("ord"), text.alias("block")), "fasta")
    return back.select(F.expr("cast(substring(seq_id, 2) as bigint)").alias("rec_id"), "length", F.md5("seq").alias("digest"))


def genbank_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as GenBank text and read again; features without a range are lost."""
    rows = _sequences(spark, sf_dir).where("seq is not null").withColumn("seq", letters(F.col("seq"))).withColumn("seq_id", F.concat(F.lit("r"), F.col("rec_id").cast("string")))
    back = sf.parse(rows.select("source_path", F.col("rec_id").alias("ord"), writers.genbank_text(rows).alias("block")), "genbank")
    marked = F.filter("features", lambda f: F.coalesce(F.try_element_at(f["qualifiers"], F.lit("label")) == F.array(F.lit("homology_free")), F.lit(False)))
    return back.select(
        F.expr("cast(substring(seq_id, 2) as bigint)").alias("rec_id"), "length", F.md5("seq").alias("digest"), (F.col("topology") == "circular").alias("circular"),
        F.size("features").cast("long").alias("n_features"), F.coalesce(F.aggregate("features", F.lit(0).cast("long"), lambda a, f: a + f["start"] * 3 + f["end"]), F.lit(0)).alias("places"), F.size(marked).cast("long").alias("labelled"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        p2_found, seq_catalog, revcomp, kmer_counts, circular_kmers, background_kmers, repeated_kmers, anti_background, region_runs, homology_free_regions, indexed_regions,
        numbered_regions, annotated_records, feature_regions, probes_by_background, free_overlaps, motif_overlaps, candidate_list, overlap_edges, components, gap_region_clip,
        tilings, fragments, fragment_records, connected_tilings, connected_fragments, fragment_features, jobs_by_config, stored_files, uploaded_texts, first_of_files,
        known_backgrounds, background_indexes, merged_sets, long_kmers, payloads, fasta_round_trip, genbank_round_trip,
    )
}

_LETTERS = "replace(regexp_replace(upper(seq), '[^A-Z]', '', 'g'), 'U', 'T')"
_CIRCULAR = "coalesce(lower(trim(topology)) = 'circular', false)"
_RC = f"translate(reverse({{}}), '{IUPAC}', '{IUPAC_COMPLEMENT}')"


def _windows(k: int) -> str:
    """Every window with its strand-neutral form and weight."""
    return f"""
with s as (select rec_id, role, {_CIRCULAR} circular, case when {_CIRCULAR} then {_LETTERS} || left({_LETTERS}, {k - 1}) else {_LETTERS} end t from sequences where seq is not null),
x as (select rec_id, role, circular, cast(i as bigint) pos, substr(t, cast(i as bigint) + 1, {k}) w from s, unnest(range(0, greatest(length(t) - {k - 1}, 0))) u(i)),
y as (select *, {_RC.format('w')} r from x),
z as (select rec_id, role, circular, pos, least(w, r) c, case when w = r then 2 else 1 end n from y)
"""


_FREE = _windows(K) + """,
o as (select *, sum(n) over (partition by rec_id, c) times from z where role = 'query'),
f as (select rec_id, pos from o where times = 1 and c not in (select c from z where role = 'background'))
"""


def _regions(threshold: int) -> str:
    return _FREE + f""",
g as (select *, pos - row_number() over (partition by rec_id order by pos) grp from f),
h as (select rec_id, min(pos) "start", max(pos) + {K} "end" from g group by rec_id, grp having max(pos) + {K} - min(pos) >= {threshold})
"""


_REGIONS = _regions(THRESHOLD)
_WORK = f"""
with recursive w as (select distinct r.rec_id, r.config_id, min_size, max_size, min_overlap, max_overlap, nullif(upper(motif), '') motif, min_step
           from requests r join config c using (config_id)
           where r.rec_id is not null and min_size <= max_size and min_overlap <= max_overlap and min_overlap >= 0 and min_step >= 1 and max_size >= 1),
g as (select distinct rec_id, "start" s, "end" e from regions where rec_id is not null and "start" >= 0 and "end" > "start"),
t as (select rec_id, {_LETTERS} t from sequences where seq is not null),
fo as (select distinct rec_id, config_id, cast(p as bigint) "start", cast(p + min_overlap as bigint) "end"
       from w join g using (rec_id), unnest(range(s, e - min_overlap + 1, min_step)) u(p) where motif is null and e - s >= min_overlap),
sp as (select rec_id, config_id, s, e, min_overlap, max_overlap, length(motif) m, string_split(substr(t, s + 1, e - s), motif) parts
       from w join g using (rec_id) join t using (rec_id) where motif is not null),
hi as (select rec_id, config_id, s, e, min_overlap, max_overlap, m, s + (i - 1) * m + list_sum(list_transform(parts[1:i], lambda x: length(x))) pos
       from sp, unnest(range(1, len(parts))) u(i)),
mo as (select distinct a.rec_id, a.config_id, cast(a.pos as bigint) "start", cast(min(b.pos) + any_value(a.m) as bigint) "end"
       from hi a join hi b on a.rec_id = b.rec_id and a.config_id = b.config_id and a.s = b.s and a.e = b.e
            and b.pos - a.pos + a.m between a.min_overlap and a.max_overlap group by a.rec_id, a.config_id, a.s, a.e, a.pos),
l as (select w.rec_id, w.config_id, length(t) n from w join t using (rec_id)),
al as (select rec_id, config_id, 0 kind, cast(0 as bigint) "start", cast(0 as bigint) "end" from l union all select rec_id, config_id, 2, n, n from l
       union all select rec_id, config_id, 1, "start", "end" from (select * from fo union all select * from mo) semi join l using (rec_id, config_id)),
ca as (select rec_id, config_id, "start", "end", row_number() over (partition by rec_id, config_id order by kind, "start", "end") - 1 ord from al)
"""

# the overlap graph of each job: edges, nodes that have one or are sentinels, and their components
_GRAPH = _WORK + """,
ed as (select rec_id, config_id, u.ord a, v.ord b from ca u join ca v using (rec_id, config_id) join w using (rec_id, config_id)
       where v.ord > u.ord and v."end" - u."start" between min_size and max_size),
ls as (select rec_id, config_id, max(ord) z from ca group by all),
nd as (select rec_id, config_id, a ord from ed union select rec_id, config_id, b from ed union select rec_id, config_id, 0 from ls union select rec_id, config_id, z from ls),
bi as (select rec_id, config_id, a, b from ed union all select rec_id, config_id, b, a from ed),
re as (select rec_id, config_id, ord, ord root from nd union select r.rec_id, r.config_id, b, root from re r join bi on r.rec_id = bi.rec_id and r.config_id = bi.config_id and r.ord = a where root < b),
co as (select rec_id, config_id, ord, min(root) component from re group by all)
"""
# the cheapest way through the graphs of one component: steps from the start, and of those that come in as few, the first
_PATHS = _GRAPH + """,
one as (select rec_id, config_id from co group by all having count(distinct component) = 1),
fw as (select * from ed semi join one using (rec_id, config_id)),
st as (select rec_id, config_id, cast(0 as bigint) ord, 0 d from one union select s.rec_id, s.config_id, b, d + 1 from st s join fw on s.rec_id = fw.rec_id and s.config_id = fw.config_id and s.ord = a),
di as (select rec_id, config_id, ord, min(d) d from st group by all),
pr as (select fw.rec_id, fw.config_id, a, b, dv.d from fw join di du on fw.rec_id = du.rec_id and fw.config_id = du.config_id and fw.a = du.ord
       join di dv on fw.rec_id = dv.rec_id and fw.config_id = dv.config_id and fw.b = dv.ord join ca c on fw.rec_id = c.rec_id and fw.config_id = c.config_id and fw.a = c.ord
       where du.d = dv.d - 1 qualify row_number() over (partition by fw.rec_id, fw.config_id, b order by c."start", a) = 1),
wy as (select rec_id, config_id, a, b, pr.d from pr join ls using (rec_id, config_id) where b = z
       union select pr.rec_id, pr.config_id, pr.a, pr.b, pr.d from wy join pr on wy.rec_id = pr.rec_id and wy.config_id = pr.config_id and wy.a = pr.b),
fg as (select rec_id, config_id, cast(d as bigint) idx, u."start" frag_start, v."end" frag_end, v."start" overlap_start, v."end" overlap_end, 'all' constraints
       from wy join ca u using (rec_id, config_id) join ca v using (rec_id, config_id) where u.ord = a and v.ord = b)
"""

ORACLES = {
    "p2_found": """
with e as (select rec_id, unnest(features) f from sequences),
g as (select rec_id, f."start" s, f."end" t from e where f.type = 'misc_feature' and element_at(f.qualifiers, 'label')[1] = ['homology_free'] and f."end" > f."start"),
m as (select *, max(t) over (partition by rec_id order by s, t rows between unbounded preceding and 1 preceding) reach from g),
n as (select *, sum(case when reach is null or s > reach then 1 else 0 end) over (partition by rec_id order by s, t rows unbounded preceding) grp from m),
p as (select rec_id, grp, min(s) s, max(t) t from n group by rec_id, grp),
q as (select *, lead(s) over (partition by rec_id order by grp) nx from p)
select rec_id, 'covered' kind, s seg_start, t seg_end from q
union all select rec_id, 'gap', t, nx from q where nx is not null
""",
    "seq_catalog": f"select rec_id, coalesce(length({_LETTERS}), 0) n_letters, {_CIRCULAR} circular, coalesce(regexp_full_match(seq, '[ATCGatcg\\s]*'), false) plain_dna, cast(coalesce(len(features), 0) as int) n_features from sequences",
    "revcomp": f"select rec_id, md5({_RC.format(_LETTERS)}) digest from sequences where seq is not null",
    "kmer_counts": _windows(EVEN_K) + ", d as (select rec_id, c, sum(n) times from z group by rec_id, c) select rec_id, count(*) kmers, cast(sum(times) as bigint) occurrences, count(*) filter (times >= 2) repeated from d group by rec_id",
    "circular_kmers": _windows(K) + "select rec_id, count(*) windows, max(pos) last_pos from z where circular group by rec_id",
    "background_kmers": _windows(K) + "select distinct c kmer from z where role = 'background'",
    "repeated_kmers": _windows(EVEN_K) + "select rec_id, c kmer, cast(sum(n) as bigint) times from z group by rec_id, c having sum(n) >= 2",
    "anti_background": _FREE + "select rec_id, count(*) free_positions from f group by rec_id",
    "region_runs": _REGIONS + 'select rec_id, "start", "end" from h',
    "homology_free_regions": _REGIONS + 'select rec_id, "start", "end" from h',
    "indexed_regions": _REGIONS + 'select rec_id, "start", "end" from h',
    "numbered_regions": _REGIONS + """select rec_id, "start", "end", row_number() over w region_no, 'Non-homologous region ' || (row_number() over w) note from h window w as (partition by rec_id order by "start", "end")""",
    "annotated_records": _REGIONS + """, c as (select rec_id, count(*) n, max_by("end", "start") e from h group by rec_id)
select rec_id, seq_id || '_annotated' seq_id, coalesce(len(features), 0) + coalesce(n, 0) n_features, case when n > 0 then 'misc_feature' else features[-1].type end last_type,
       case when n > 0 then e else features[-1]."end" end last_end from sequences left join c using (rec_id) where role = 'query'""",
    "feature_regions": """
with e as (select rec_id, unnest(features) f from sequences)
select rec_id, row_number() over (partition by rec_id order by f."start" nulls first, f."end" nulls first) - 1 n, f."start" as "start", f."end" as "end"
from e where f.type = 'misc_feature' and element_at(f.qualifiers, 'label')[1] = ['homology_free']
""",
    "probes_by_background": "select background_id, count(*) probes, max(kmer_size) k from probes join (select id, kmer_size, row_number() over (partition by id order by species nulls first, assembly nulls first, file_name nulls first, kmer_size nulls first) no from manifest where id is not null qualify no = 1) m on background_id = m.id group by background_id",
    "free_overlaps": _WORK + "select * from fo",
    "motif_overlaps": _WORK + "select * from mo",
    "candidate_list": _WORK + "select * from ca",
    "overlap_edges": _WORK + """select rec_id, config_id, u."start" u_start, u."end" u_end, v."start" v_start, v."end" v_end, cast(1 as bigint) weight, 'all' constraints
from ca u join ca v using (rec_id, config_id) join w using (rec_id, config_id) where v.ord > u.ord and v."end" - u."start" between min_size and max_size""",
    "components": _GRAPH + "select rec_id, config_id, count(distinct component) components, count(*) nodes from co group by all",
    "gap_region_clip": _GRAPH + """,
la as (select *, row_number() over (partition by rec_id, config_id, component order by "end" desc, ord) x, row_number() over (partition by rec_id, config_id, component order by "start", ord) y
       from co join ca using (rec_id, config_id, ord)),
gr as (select rec_id, config_id, component, max("start") filter (x = 1) ls, max("start") filter (y = 1) fs, max(ord) filter (y = 1) fo, max("end") filter (y = 1) fe from la group by all),
gp as (select *, lead(fe) over q ne, row_number() over q gap_no from gr window q as (partition by rec_id, config_id order by fs, fo)),
gs as (select rec_id, config_id, gap_no, greatest(ls - min_size, 0) a, least(ne + min_size, n) b from gp join w using (rec_id, config_id) join l using (rec_id, config_id) where ne is not null)
select rec_id, config_id, cast(gap_no as int) gap_no, greatest(s, a) clip_start, least(e, b) clip_end from gs join g using (rec_id) where s < b and e > a""",
    "connected_tilings": _PATHS + """select rec_id, config_id, cast(count(*) as bigint) "cost", count(*) n_fragments from fg group by all
union all select rec_id, config_id, 0, 0 from l where n = 0""",
    "connected_fragments": _PATHS + f"""select fg.*, coalesce(seq_id, 'null') || '_fragment_' || idx fragment_id,
'Fragment ' || idx || ': ' || frag_start || '-' || frag_end || ', overlap: ' || overlap_start || '-' || overlap_end || ', constraints: ' || constraints description,
md5(substr({_LETTERS}, cast(frag_start as bigint) + 1, cast(frag_end - frag_start as bigint))) digest from fg join sequences using (rec_id)""",
    "fragment_features": _PATHS + """, q as (select rec_id, count(*) k, arg_max(frag_end, (idx, frag_start, frag_end, overlap_start)) e from fg group by rec_id)
select rec_id, coalesce(len(features), 0) + coalesce(k, 0) n_features, case when k > 0 then 'fragment' else features[-1].type end last_type,
       case when k > 0 then e else features[-1]."end" end last_end from sequences left join q using (rec_id)""",
    "jobs_by_config": _WORK + "select config_id, count(*) jobs, count(motif) with_motif from w group by config_id",
    "stored_files": f"""select cast(coalesce(role = 'query', false) as bigint) file_no, row_number() over (partition by coalesce(role = 'query', false) order by rec_id) - 1 ord,
rec_id, length({_LETTERS}) length, md5({_LETTERS}) digest from sequences where seq is not null""",
    "uploaded_texts": f"""select 'r' || rec_id || case rec_id % 3 when 0 then '.fa' when 1 then '.GB' else '' end source_path, cast(0 as bigint) ord, 'r' || rec_id seq_id,
length({_LETTERS}) length, md5({_LETTERS}) digest from sequences where seq is not null""",
    "first_of_files": "select source_path, ord, rec_id from sequences where (source_path, ord) in (select (source_path, min(ord)) from sequences group by source_path)",
    "known_backgrounds": """select id, concat_ws(' ', species, assembly) label, kmer_size from manifest where id is not null
qualify row_number() over (partition by id order by species nulls first, assembly nulls first, file_name nulls first, kmer_size nulls first) = 1""",
    "background_indexes": _windows(K) + f"select role background_id, cast({K} as int) kmer_size, count(distinct c) kmers from z where role in ('query', 'background') group by role",
    "merged_sets": _windows(EVEN_K) + ", b as (select w k from y where role in ('query', 'background') union select r from y where role in ('query', 'background')) select count(*) kmers from b",
    "long_kmers": _windows(LONG_K) + ", d as (select rec_id, c, sum(n) times from z group by rec_id, c) select rec_id, count(*) kmers, cast(sum(times) as bigint) occurrences, count(*) filter (times >= 2) repeated from d group by rec_id",
    "payloads": _regions(OVERLAP) + "select s.rec_id, count(h.rec_id) regions, true marked, true complete from sequences s left join h using (rec_id) where role = 'query' group by s.rec_id",
    "fasta_round_trip": f"select rec_id, length({_LETTERS}) length, md5({_LETTERS}) digest from sequences where seq is not null",
    "genbank_round_trip": f"""
with e as (select rec_id, unnest(features) f from sequences), c as (select rec_id, count(*) n, sum(f."start" * 3 + f."end") p,
  count(*) filter (element_at(f.qualifiers, 'label')[1] = ['homology_free']) q from e where f."start" is not null and f."end" is not null group by rec_id)
select rec_id, length({_LETTERS}) length, md5({_LETTERS}) digest, {_CIRCULAR} circular, coalesce(n, 0) n_features, cast(coalesce(p, 0) as bigint) places, coalesce(q, 0) labelled
from sequences left join c using (rec_id) where seq is not null""",
}
