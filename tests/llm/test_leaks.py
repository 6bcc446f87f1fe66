import random

from strandloom.llm import leaks
from strandloom.llm.leaks import edit_distance, find_leaks, words


def levenshtein_within(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def test_edit_distance_against_dynamic_programming():
    rng = random.Random(5)
    for _ in range(500):
        a = [rng.choice("abcd") for _ in range(rng.randrange(0, 90))]
        b = [rng.choice("abcd") for _ in range(rng.randrange(0, 60))]
        assert edit_distance(a, b) == levenshtein_within(a, b)


def brute(mails, items, n):
    out = set()
    for i, text in items:
        w = words(text or "")
        grams = {tuple(w[a : a + n]) for a in range(len(w) - n + 1)}
        for d, mail in mails:
            v = words((mail or "").partition("\n\n")[2])
            if any(tuple(v[a : a + n]) in grams for a in range(len(v) - n + 1)):
                out.add((d, i))
    return out


def case(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(5, 50)))) for i in range(30)]
    mails = []
    for d in range(120):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 60))]
        if rng.random() < 0.7:
            src = rng.choice(items)[1].split()
            a = rng.randrange(len(src))
            piece = src[a : a + rng.randrange(6, 30)]
            if rng.random() < 0.4 and len(piece) > 7:
                piece[rng.randrange(len(piece))] = "zzz"
            at = rng.randrange(len(w) + 1)
            w[at:at] = piece
        mails.append((d, "Subject: x\n\n" + rng.choice([" ", "\n> ", ", "]).join(x.upper() if rng.random() < 0.3 else x for x in w)))
    return mails + [(500, None), (501, ""), (None, mails[0][1])], items + [(600, None), (601, ""), (None, items[0][1])]


def test_exact_cases_against_brute_force(spark):
    mails, items = case()
    docs = spark.createDataFrame([(d, t, 1) for d, t in mails], "doc_id long, text string, item_id int")
    tests = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    want = brute([m for m in mails if m[0] is not None], [i for i in items if i[0] is not None], 12)
    for errors, block in ((0, 10**9), (1, 10**9), (1, 500)):
        got = find_leaks(docs, tests, 12, errors, block).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got if r["edits"] == 0} == want
        assert len(got) == len({(r["doc_id"], r["item_id"]) for r in got})
        if errors:
            near = [r for r in got if r["edits"] == 1]
            assert near and all(r["exact_words"] == 0 for r in near)


def test_one_edit_is_found(spark):
    item = [f"q{i}" for i in range(12)]
    docs = []
    for k in range(12):
        docs.append((k, "\n\n" + " ".join(item[:k] + ["zzz"] + item[k + 1 :])))
        docs.append((100 + k, "\n\n" + " ".join(item[:k] + item[k + 1 :])))
    got = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"))
    assert {(r["doc_id"], r["edits"]) for r in got.collect()} == {(d, 1) for d, _ in docs}


def test_empty(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert find_leaks(docs, items).collect() == []


def test_one_edit_against_dynamic_programming(spark):
    mails, items = case(7)
    mails, items = [m for m in mails if m[1]][:90], items[:30]
    want = {}
    for d, mail in mails:
        v = words(mail.partition("\n\n")[2])
        for i, text in items:
            w = words(text or "")
            best = min((levenshtein_within(w[a : a + 12], v) for a in range(len(w) - 11)), default=9)
            if best <= 1 and d is not None:
                want[d, i] = best
    got = find_leaks(spark.createDataFrame(mails, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]): r["edits"] for r in got} == want and 1 in want.values()


def test_every_passage_holds_a_piece_more_than_the_budget():
    for n in (12, 13, 20):
        for errors in (0, 1, 2, 3):
            size = leaks.Items([], n, errors).size
            for a in range(size):  # wherever the passage begins
                assert (a + n) // size - -(-a // size) >= errors + 1 or size == 1


def test_blocks_are_bounded(spark):
    items = [(7, "x" * 90)] * 5 + [(i, "y" * 40) for i in range(20)]
    seen = []
    original = leaks.Items.__init__
    leaks.Items.__init__ = lambda self, rows, *a: (seen.append(sum(len(t) for _, t in rows)), original(self, rows, *a))[1]
    try:
        find_leaks(spark.createDataFrame([(1, "\n\nz")], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block=100).collect()
    finally:
        leaks.Items.__init__ = original
    assert sum(seen) == 5 * 90 + 20 * 40 and max(seen) <= 100 + 90
