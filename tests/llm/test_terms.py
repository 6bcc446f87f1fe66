import random
from collections import Counter

import pytest

from strandloom.llm.terms import term_frequencies


def clean(s):
    return "".join(c for c in (s or "").upper() if "A" <= c <= "Z").replace("U", "T")


def brute(texts, k):
    occ, rec = Counter(), Counter()
    for s in map(clean, texts):
        w = [s[i : i + k] for i in range(len(s) - k + 1)]
        w = [x for x in w if set(x) <= set("ACGT")]
        occ.update(w)
        rec.update(set(w))
    n = len(texts)
    return {(t, occ[t], rec[t], "rare" if rec[t] == 1 else "common" if rec[t] * 20 >= n else None) for t in occ}


def got(spark, texts, k):
    df = spark.createDataFrame([(s, "x") for s in texts], "seq string, term string")
    return {tuple(r) for r in term_frequencies(df, width=k).collect()}


@pytest.mark.parametrize("k", [1, 3, 10, 13, 17])
def test_against_brute_force(spark, k):
    rng = random.Random(k)
    texts = ["".join(rng.choice("ACGTacgtuNR \n-1") for _ in range(rng.randrange(60))) for _ in range(60)]
    texts += [None, "", "AC", "acgu" * 200, "ACGT" * 200, texts[0], texts[0]]
    assert got(spark, texts, k) == brute(texts, k)


def test_empty_table_and_bad_width(spark):
    assert got(spark, [], 10) == set()
    with pytest.raises(ValueError):
        got(spark, ["A"], 0)


def test_very_long_text(spark):
    texts = ["ACGTTGCA" * 400_000, "ACGTTGCAAC"]
    assert got(spark, texts, 10) == brute(texts, 10)
