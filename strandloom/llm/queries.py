"""Queries of the llm operators over the given tables, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.letters import letters
from strandloom.llm import garble, leaks, packing, seen, spans, split, terms
from strandloom.session import cut_lineage, read_table


def p1_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.term_frequencies(read_table(spark, sf_dir, "sequences"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_terms(spark, sf_dir).where("mark is not null").select("term", "mark")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_spans(read_table(spark, sf_dir, "sequences"))


def p3_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is to be removed so that every run of 50 letters is left in the first record that holds it only."""
    return spans.shared_spans(read_table(spark, sf_dir, "sequences"), repeats=True).select("rec_id", F.col("span_start").alias("cut_start"), F.col("span_end").alias("cut_end"))


def p3_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each record that has letters is found elsewhere; 0 where nothing is."""
    found = p3_found(spark, sf_dir).groupBy("rec_id").agg(F.count("*").alias("stretches"), F.sum(F.col("span_end") - F.col("span_start")).alias("shared_letters"))
    rows = read_table(spark, sf_dir, "sequences").select("rec_id", F.length(letters(F.col("seq"))).cast("long").alias("n_letters"))
    out = rows.where("rec_id is not null and n_letters > 0").join(found, "rec_id", "left")
    count = lambda name: F.coalesce(name, F.lit(0).cast("long")).alias(name)
    return out.select("rec_id", count("stretches"), count("shared_letters"), "n_letters", (F.coalesce("shared_letters", F.lit(0)) / F.col("n_letters")).alias("share"))


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_oversized(read_table(spark, sf_dir, "sequences"), read_table(spark, sf_dir, "requests"), read_table(spark, sf_dir, "config"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = F.when(F.size("boundaries") > 0, F.col("boundaries")).otherwise(F.array(F.lit(-1).cast("long")))
    return _pieces(spark, sf_dir).select("rec_id", "config_id", F.explode(cuts).alias("cut_pos"))


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _pieces(spark, sf_dir).select("rec_id", "config_id", F.posexplode("pieces").alias("piece_no", "p"))
    return out.select("rec_id", "config_id", (F.col("piece_no") + 1).alias("piece_no"), F.col("p.start").alias("piece_start"), F.col("p.end").alias("piece_end"), F.col("p.natural").alias("natural"))


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = seen.probe_keys(read_table(spark, sf_dir, "probes"), read_table(spark, sf_dir, "manifest"))
    return seen.seen_before(keys, [F.col("background_id"), F.col("key")], "probe_id", "arrival_no")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir).where("seen").select(F.col("id").alias("probe_id"))


def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate of wrong answers, expected and found, by how the answer was come by and by number of filters probed."""
    rows = seen.checked(cut_lineage(_decided(spark, sf_dir)))
    return rows.groupBy("how", "filters").agg(
        F.count("*").alias("keys"),
        F.count_if("seen").alias("seen"),
        F.count_if(F.col("claimed") & ~F.col("seen")).alias("wrong"),
        F.sum(F.when(~F.col("seen"), 1 - F.pow(F.lit(1 - 2.0**-32), F.col("filters"))).otherwise(0.0)).alias("expected_wrong"),
    )


def p5_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and repeats over all rows, from the rows of ``p5_rates``."""
    rows = p5_rates(spark, sf_dir)
    return rows.agg(F.sum("keys").alias("keys"), F.sum("seen").alias("seen"), F.sum("wrong").alias("wrong"))


def _capacity(spark: SparkSession, sf_dir: str, pack_id: int) -> int:
    return read_table(spark, sf_dir, "packs").where(F.col("pack_id") == pack_id).first()["capacity"]


def p6_packing(spark: SparkSession, sf_dir: str, pack_id: int = 4) -> DataFrame:
    """Every mail's container; pack 4 holds 2,048 tokens."""
    sizes = packing.counted(read_table(spark, sf_dir, "documents"))
    out = packing.pack(sizes, _capacity(spark, sf_dir, pack_id))
    return out.select(F.col("id").alias("doc_id"), "piece", F.col("size").alias("n_tokens"), F.col("container").alias("container_id"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used, and room left over, for each capacity of packs."""
    sizes, out = packing.counted(read_table(spark, sf_dir, "documents")), None
    for r in read_table(spark, sf_dir, "packs").select("pack_id", "capacity").collect():
        used = packing.pack(sizes, r["capacity"]).where("size > 0")
        one = used.groupBy("container").agg(F.sum("size").alias("held")).agg(
            F.count("*").alias("containers"), F.sum("held").alias("tokens"), F.max("held").alias("fullest")
        )
        one = one.select(F.lit(r["pack_id"]).alias("pack_id"), F.lit(r["capacity"]).alias("capacity"), "*", (F.col("tokens") / (F.col("containers") * r["capacity"])).alias("fill"))
        out = one if out is None else out.unionByName(one)
    return out


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items"), errors=0)
    return found.select("doc_id", "item_id")


def p8_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garble.garbled_parts(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_repaired(spark, sf_dir).select("doc_id").distinct()


QUERIES = {f.__name__: f for f in (p1_found, p1_terms, p3_found, p3_removed, p3_share, p4_found, p4_pieces, p5_found, p5_rates, p5_totals, p6_packing, p6_fill, p7_found, p7_leaks, p8_found, p8_repaired)}

_LETTERS = "replace(regexp_replace(upper(seq), '[^A-Z]', '', 'g'), 'U', 'T')"

_TERMS = f"""
with w as (select rec_id, substr(s, cast(i as bigint) + 1, 10) term
           from (select rec_id, {_LETTERS} s from sequences) t, unnest(range(0, greatest(length(s) - 9, 0))) u(i)),
f as (select term, cast(count(*) as bigint) occurrences, cast(count(distinct rec_id) as bigint) records from w
      where not regexp_matches(term, '[^ACGT]') group by term),
m as (select *, case when records = 1 then 'rare' when records * 20 >= (select count(*) from sequences) then 'common' end mark from f)
"""

def _spans(which: str) -> str:
    """Maximal stretches of the windows picked by a condition on their record and the first and last one that hold them."""
    return f"""
with t as (select rec_id, {_LETTERS} s from sequences),
w as (select rec_id, cast(i as bigint) p, hash(substr(s, cast(i as bigint) + 1, 50)) h from t, unnest(range(0, greatest(length(s) - 49, 0))) u(i)),
g as (select h, min(rec_id) first, max(rec_id) last from w group by h),
c as (select rec_id, p from w join g using (h) where {which}),
l as (select *, case when p <= lag(p) over (partition by rec_id order by p) + 50 then 0 else 1 end fresh from c),
n as (select *, sum(fresh) over (partition by rec_id order by p) grp from l),
r as (select rec_id, min(p) span_start, max(p) + 50 span_end from n group by rec_id, grp)
"""


_SHARED = _spans("first < last")

_CUTS = f"""
with recursive t as (select distinct r.rec_id, r.config_id, s.s, c.max_size, coalesce(c.min_overlap, 0) o, upper(c.motif) motif
           from requests r join config c using (config_id) join (select rec_id, {_LETTERS} s from sequences) s using (rec_id)
           where length(s.s) > c.max_size),
h as (select rec_id, config_id, cast(i as bigint) p from t, unnest(range(1, length(s) - length(motif) + 1)) u(i)
      where motif <> '' and substr(s, cast(i as bigint) + 1, length(motif)) = motif)
"""

_KEYS = """
with k as (select id background_id, max(kmer_size) k from manifest where id is not null group by id),
h as (select probe_id, arrival_no, background_id, left(s, k) x from
      (select p.*, k.k, replace(regexp_replace(upper(seq), '[^A-Z]', '', 'g'), 'U', 'T') s from probes p join k using (background_id)) q
      where length(s) >= k and k > 0 and not regexp_matches(left(s, k), '[^ACGT]')),
c as (select *, least(x, translate(reverse(x), 'ACGT', 'TGCA')) key from h)
"""

ORACLES = {
    "p1_found": _TERMS + "select term, mark from m where mark is not null",
    "p1_terms": _TERMS + "select term, occurrences, records, mark from m",
    "p3_found": _SHARED + "select rec_id, span_start, span_end from r",
    "p3_removed": _spans("rec_id > first") + "select rec_id, span_start cut_start, span_end cut_end from r",
    "p3_share": _SHARED + """, q as (select rec_id, count(*) stretches, sum(span_end - span_start) letters from r group by rec_id)
select rec_id, coalesce(stretches, 0) stretches, cast(coalesce(letters, 0) as bigint) shared_letters, length(s) n_letters, coalesce(letters, 0) / length(s) share
from t left join q using (rec_id) where length(s) > 0 and rec_id is not null""",
    "p4_found": _CUTS + "select rec_id, config_id, p cut_pos from h union all select rec_id, config_id, cast(-1 as bigint) from t where (rec_id, config_id) not in (select (rec_id, config_id) from h)",
    "p4_pieces": _CUTS + """,
k as (select t.rec_id, t.config_id, length(s) n, max_size m, o, coalesce(list(p order by p) filter (p is not null), []) bounds
      from t left join h using (rec_id, config_id) where o >= 0 and o < max_size group by all),
x as (select *, cast(0 as bigint) a, false nat from k union all
      select rec_id, config_id, n, m, o, bounds, coalesce(list_filter(bounds, lambda p: p > a and p <= a + m - o)[-1], a + m - o), list_filter(bounds, lambda p: p > a and p <= a + m - o)[-1] is not null from x where n - a > m)
select rec_id, config_id, cast(row_number() over q as int) piece_no, a piece_start, cast(coalesce(lead(a) over q + o, n) as bigint) piece_end, nat "natural" from x window q as (partition by rec_id, config_id order by a)""",
    "p5_found": _KEYS + "select probe_id from (select probe_id, arrival_no, min(arrival_no) over (partition by background_id, key) f from c) where f < arrival_no",
    "p5_totals": _KEYS + "select count(*) keys, count(*) filter (f < arrival_no) seen, cast(0 as bigint) wrong from (select arrival_no, min(arrival_no) over (partition by background_id, key) f from c)",
}
