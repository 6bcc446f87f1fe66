import random

from strandloom.llm import garble, leaks, packing, spans, split

rng = random.Random(11)


def dna(n):
    return "".join(rng.choices("ACGT", k=n))


def test_spans_of_long_and_of_low_complexity_records(spark):
    a, b = dna(150_000), dna(150_000)
    rows = [(1, a + b), (2, b + "N" + dna(1000)), (3, "A" * 5000), (4, "C" + "A" * 4000)]
    got = {tuple(r) for r in spans.shared_spans(spark.createDataFrame(rows, "rec_id long, seq string")).collect()}
    assert got == {(1, 150_000, 300_000), (2, 0, 150_000), (3, 0, 5000), (4, 1, 4001)}


def test_splitting_a_long_record(spark):
    text = dna(500_000)
    out = split.split_oversized(
        spark.createDataFrame([(1, text)], "rec_id long, seq string"), spark.createDataFrame([(1, 1)], "rec_id long, config_id int"),
        spark.createDataFrame([(1, 300, 30, "GC")], "config_id int, max_size int, min_overlap int, motif string"),
    ).first()
    pieces = [(p["start"], p["end"]) for p in out["pieces"]]
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(b - c == 30 for (_, b), (c, _) in zip(pieces, pieces[1:])) and max(b - a for a, b in pieces) <= 300
    assert all(text[a : a + 2] == "GC" for a, _ in pieces[1:])


def test_long_mails(spark):
    item = [f"item{i}" for i in range(30)]
    filler = " ".join(f"word{rng.randrange(1000)}" for _ in range(150_000))
    mail = f"Subject: x\n\n{filler} {' '.join(item[5:25])} {filler}\n\ncafÃ© {'é ' * 100_000}"
    docs = spark.createDataFrame([(1, mail)], "doc_id long, text string")
    found = leaks.find_leaks(docs, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert [tuple(r) for r in found] == [(1, 7, 20, 0)]
    row = garble.garbled_parts(docs).first()
    assert row["restored"] == mail.partition("\n\n")[2].replace("cafÃ©", "café")
    sizes = packing.token_counts(docs).cache()
    out = packing.pack(sizes, 1000).collect()
    assert sum(r["size"] for r in out) == sizes.first()["tokens"] and len({r["container"] for r in out}) == len(out)
