"""Evaluation texts leaking into training text (problem 7).

Pigeonhole matching: a passage of ``min_words`` words of a test item that
stands in a mail with at most ``errors`` word edits keeps one of its
``errors`` + 1 pieces whole. Items are cut into pieces so short that every
passage of theirs, wherever it begins, holds ``errors`` + 1 whole ones; an
automaton finds the exact pieces in one pass over the mail, and the bit-parallel
edit distance of the passages that hold the piece decides each hit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.mail import read_mail

WORDS = re.compile(r"[^\W_]+")
BLOCK = 1_000_000  # letters of items handled in one pass over the mails; their automaton takes about 60 bytes a letter


def words(text: str) -> list[str]:
    """Maximal runs of letters or digits, in lower case."""
    return [w.lower() for w in WORDS.findall(text)]


def edit_distance(pattern: list[str], text: list[str]) -> int:
    """Least number of word edits between the pattern and any stretch of the text (bit-parallel, one step a word)."""
    m = len(pattern)
    if not m:
        return 0
    places: dict[str, int] = {}
    for i, w in enumerate(pattern):
        places[w] = places.get(w, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, m
    for w in text:
        eq = places.get(w, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = (down | ~(xh | up)) & full
        mh = up & xh
        score += 1 if ph & high else -1 if mh & high else 0
        ph, mh = (ph << 1) & full, (mh << 1) & full
        up, down = (mh | ~(xv | ph)) & full, ph & xv
        best = min(best, score)
    return best


class Items:
    """The pieces of a block of items, ready to be sent to the tasks."""

    def __init__(self, rows: list[tuple[int, str]], min_words: int, errors: int):
        self.min_words, self.errors = min_words, errors
        # of a passage cut anywhere, size - 1 words at each end may belong to pieces it does not hold whole
        self.size = max(1, (min_words + 1) // (errors + 2))
        self.items = [(ident, w) for ident, text in rows if len(w := words(text or "")) >= min_words]
        self._automaton = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None}

    @property
    def automaton(self):
        if self._automaton is None:
            pieces: dict[str, list[tuple[int, int]]] = {}
            for i, (_, w) in enumerate(self.items):
                for a in range(0, len(w) - self.size + 1, self.size):
                    pieces.setdefault(" " + " ".join(w[a : a + self.size]) + " ", []).append((i, a))
            self._automaton = ahocorasick.Automaton()
            for piece, where in pieces.items():
                self._automaton.add_word(piece, where)
            self._automaton.make_automaton()
        return self._automaton

    def search(self, part: str) -> dict[int, tuple[int, int]]:
        """item number -> (longest exact run, least edit distance of a passage) for the items with a passage within the budget."""
        text = words(part)
        if len(text) < self.size or not self.items:
            return {}
        line = " " + " ".join(text) + " "
        diagonals: dict[tuple[int, int], list[int]] = {}
        at, counted = 0, 0
        for end, where in self.automaton.iter(line):
            counted += line.count(" ", at, end)
            at = end
            first = counted - self.size  # blanks before the piece's last one, less its own
            for i, a in where:
                diagonals.setdefault((i, first - a), []).append(first)
        out: dict[int, tuple[int, int]] = {}
        for (i, shift), firsts in diagonals.items():
            item, done = self.items[i][1], -1
            for t in sorted(firsts):
                if t < done:
                    continue
                run, best = out.get(i, (0, self.errors + 1))
                if best:
                    best = min(best, self._nearest(text, item, t, t - shift))
                if best == 0:  # the exact stretch around the hit, for the report
                    a, b = t, t + self.size
                    while a > 0 and a - shift > 0 and text[a - 1] == item[a - 1 - shift]:
                        a -= 1
                    while b < len(text) and b - shift < len(item) and text[b] == item[b - shift]:
                        b += 1
                    done, run = b, max(run, b - a)
                if best <= self.errors:
                    out[i] = run, best
        return {i: (run if run >= self.min_words else 0, best) for i, (run, best) in out.items()}

    def _nearest(self, text: list[str], item: list[str], t: int, a: int) -> int:
        """Least distance of the item's passages that hold its piece at ``a`` from the text around ``t``."""
        best, n = self.errors + 1, self.min_words
        for s in range(max(0, a + self.size - n), min(a, len(item) - n) + 1):
            low = max(0, t - (a - s) - self.errors)
            best = min(best, edit_distance(item[s : s + n], text[low : t - (a - s) + n + self.errors]))
            if best == 0:
                break
        return best


def _search(items) -> object:
    schema = pa.schema([("doc", pa.int64()), ("item", pa.int64()), ("run", pa.int32()), ("edits", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Items = items.value
        for batch in batches:
            rows: list[list[int]] = [[], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                best: dict[int, tuple[int, int]] = {}
                for part in read_mail(text)[1]:
                    for i, (length, edits) in block.search(part).items():
                        old = best.get(i, (0, block.errors + 1))
                        best[i] = max(old[0], length), min(old[1], edits)
                for i, (length, edits) in best.items():
                    for column, value in zip(rows, (doc, block.items[i][0], length, edits)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(r, type=f.type) for r, f in zip(rows, schema)], schema=schema)

    return run


def find_leaks(docs: DataFrame, items: DataFrame, min_words: int = 12, errors: int = 1, block: int = BLOCK) -> DataFrame:
    """Mails that carry a passage of ``min_words`` consecutive words of an item, with at most ``errors`` word edits.

    Result: ``doc_id``, ``item_id``, ``exact_words`` (longest exact run of at
    least ``min_words`` words, else 0) and ``edits`` (fewest edits of a
    passage; 0 if it is exact). Words do not run on from one text part of a
    mail to the next.

    Null ids or texts, empty texts and items of fewer than ``min_words`` words
    have no case. Repeated rows give repeated results; an item id listed twice
    counts each row. Very long mails are read whole. Other columns are
    ignored, whatever their names. Empty tables give an empty result.

    The items are sent to the tasks in blocks of at most ``block`` letters and
    the item that fills the block up; every block is one pass over all mails,
    and nothing else is shuffled or collected.
    """
    spark = docs.sparkSession
    test = items.select(F.col("item_id").cast("long").alias("i"), F.col("text").cast("string").alias("t")).where("i is not null and t is not null")
    test = test.withColumn("n", F.length("t").cast("long"))
    total = test.agg(F.sum("n")).first()[0] or 0
    buckets = 1 + int(total) // block  # few items share a bucket, and a bucket is cut by the running sum of its letters
    test = test.withColumn("bucket", F.pmod(F.xxhash64("i"), F.lit(buckets)))
    before = F.sum("n").over(Window.partitionBy("bucket").orderBy("i", "t").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    test = test.withColumn("part", F.floor(before / block))
    mails = docs.select(F.col("doc_id").cast("long").alias("d"), F.col("text").cast("string").alias("t")).where("d is not null and t is not null")
    parts = [(r["bucket"], r["part"]) for r in test.select("bucket", "part").distinct().sort("bucket", "part").collect()] or [(0, 0)]
    found = None
    for bucket, part in parts:
        rows = test.where((F.col("bucket") == bucket) & (F.col("part") == part)).select("i", "t").sort("i", "t").collect()
        held = spark.sparkContext.broadcast(Items([tuple(r) for r in rows], min_words, errors))
        hits = mails.mapInArrow(_search(held), "doc long, item long, run int, edits int")
        found = hits if found is None else found.unionByName(hits)
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), F.col("run").alias("exact_words"), "edits")
