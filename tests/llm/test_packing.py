import random
from collections import Counter, defaultdict

import pytest

from strandloom.llm.packing import VOCABULARY, pack, pack_histogram, token_counts, tokenizer


def test_histogram_keeps_every_item():
    rng = random.Random(2)
    for capacity in (1, 7, 64, 512):
        h = Counter(rng.randrange(1, capacity + 1) for _ in range(500))
        patterns = pack_histogram(dict(h), capacity)
        back = Counter()
        for lengths, count in patterns:
            assert count > 0 and sum(lengths) <= capacity
            for x in lengths:
                back[x] += count
        assert back == h
        used = sum(c for _, c in patterns)
        # first-fit decreasing and its kin stay within 11/9 of the optimum
        assert used <= -(-sum(k * v for k, v in h.items()) // capacity) * 11 / 9 + 1


def test_histogram_takes_the_emptiest_pack():
    assert sorted(x for x, n in pack_histogram({7: 1, 6: 1, 3: 1}, 10) for _ in range(n)) == [(6, 3), (7,)]
    rng = random.Random(4)
    for capacity in (1, 7, 64, 512):
        items = sorted((rng.randrange(1, capacity + 1) for _ in range(300)), reverse=True)
        rooms = []
        for x in items:  # one by one
            if rooms and max(rooms) >= x:
                rooms[rooms.index(max(rooms))] -= x
            else:
                rooms.append(capacity - x)
        patterns = pack_histogram(dict(Counter(items)), capacity)
        assert sorted(rooms) == sorted(capacity - sum(p) for p, n in patterns for _ in range(n))


@pytest.mark.parametrize("cell", [20, 1000])
def test_pack_against_its_rules(spark, cell):
    rng = random.Random(cell)
    rows = [(i, rng.choice([None, 0, -3, 5, 5, 5, rng.randrange(1, 200)])) for i in range(900)] + [(900, 1000), (901, 128), (902, 129)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id long, tokens long, size int")
    out = pack(df, 128, cell).collect()
    held, per = defaultdict(int), defaultdict(list)
    for r in out:
        per[r["id"]].append((r["piece"], r["size"]))
        if r["container"] is None:
            assert r["size"] == 0
        else:
            held[r["container"]] += r["size"]
    assert max(held.values()) <= 128 and sorted(held) == list(range(len(held)))
    for i, n in rows:
        n = max(0, n or 0)
        pieces = [s for _, s in sorted(per[i])]
        assert sum(pieces) == n and len(pieces) == max(1, -(-n // 128)) and all(s == 128 for s in pieces[:-1])
    assert len(held) <= sum(held.values()) / 128 * 1.1 + 1


def test_empty_and_bad_capacity(spark):
    df = spark.createDataFrame([], "id long, tokens long")
    assert pack(df, 10).collect() == []
    with pytest.raises(ValueError):
        pack(df, 0)


def test_token_counts(spark):
    texts = [None, "", "Hello world", "x" * 50_000, "日本語 <|endoftext|>"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, id int")
    got = {r["id"]: r["tokens"] for r in token_counts(df).collect()}
    enc = tokenizer(VOCABULARY)
    assert got == {i: len(enc.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}
    assert got[2] == 2


def test_one_length_shared_by_all_is_ranked_by_many_tasks(spark):
    df = spark.range(5000).selectExpr("id", "cast(128 as bigint) tokens")
    out = pack(df, 128, cell=100)
    assert out.select("container").distinct().count() == 5000
    cells = {r["salt"] for r in df.selectExpr("pmod(xxhash64(id, cast(0 as bigint)), 51) salt").distinct().collect()}
    assert len(cells) == 51  # a cell for every hundred pieces


def test_vocabulary_of_the_session(spark):
    df = spark.createDataFrame([(1, "Hello world")], "doc_id long, text string")
    spark.conf.set("spark.strandloom.vocabulary", VOCABULARY)
    try:
        assert token_counts(df).first()["tokens"] == 2
    finally:
        spark.conf.unset("spark.strandloom.vocabulary")
