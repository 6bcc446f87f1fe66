"""How often each character stands between which neighbours, over a whole collection (used by problem 8).

A character garbled by one legacy encoding read as another lands where the
collection hardly ever has it, while the character it came from is common
there. The counts behind that judgement are taken over all mails.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.mail import read_mail

RATIO = 30  # a character is suspicious where another reading of its byte is so many times as frequent
TOP = 0x3000  # characters from here on (CJK) are no single bytes; as neighbours they are one class
CLASSES = 59


def _classes() -> np.ndarray:
    """0 blank, 1 digit, 2 other ASCII, 3-28 A-Z, 29-54 a-z, then lower-case, upper-case and other characters, and CJK."""
    out = np.full(TOP + 1, 57, dtype=np.int64)
    for code in range(TOP):
        c = chr(code)
        if c.isspace():
            out[code] = 0
        elif code < 128:
            out[code] = 1 if c.isdigit() else 3 + code - ord("A") if c.isupper() else 29 + code - ord("a") if c.islower() else 2
        elif c.isalpha():
            out[code] = 56 if c.isupper() else 55
    out[TOP] = 58
    return out


_CLASS = _classes()


def decoded(encoding: str) -> list[str | None]:
    """The characters of a single-byte encoding's upper half; C1 controls stand for bytes it leaves out."""
    chars = [bytes([b]).decode(encoding, "ignore") or (chr(b) if b < 160 else "") for b in range(128, 256)]
    return [c if c and ord(c) < TOP else None for c in chars]


class Surroundings:
    """Counts of (character, class before, class after), and what each place costs."""

    def __init__(self, read_as: tuple[str, ...], written_in: tuple[str, ...]):
        tables = {e: decoded(e) for e in {*read_as, *written_in}}
        self.characters = sorted({c for t in tables.values() for c in t if c})
        self.number = np.full(TOP + 1, -1, dtype=np.int64)
        for i, c in enumerate(self.characters):
            self.number[ord(c)] = i
        self.readings = []
        for wrong in read_as:
            for right in written_in:
                if wrong != right:
                    other = np.full(len(self.characters), -1)
                    for a, b in zip(tables[wrong], tables[right]):
                        if a and b and a != b and not ("\x80" <= b <= "\x9f"):
                            other[self.number[ord(a)]] = self.number[ord(b)]
                    self.readings.append(other)
        self.cost_of: np.ndarray | None = None
        self.mails: np.ndarray | None = None
        self.known: dict[str, float] = {}  # costs of words met before
        self.readings_of: dict[str, tuple] = {}  # what problem 8 found words may be

    @property
    def size(self) -> int:
        """Number of cells: the bound of what is collected and broadcast."""
        return len(self.characters) * CLASSES * CLASSES

    def cells(self, text: str) -> np.ndarray:
        """The cell of every character that a single byte can stand for."""
        codes = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4"), TOP)
        own = self.number[codes]
        at = np.flatnonzero(own >= 0)
        kind = np.concatenate(([0], _CLASS[codes], [0]))
        return (own[at] * CLASSES + kind[at]) * CLASSES + kind[at + 2]

    def fit(self, counts: np.ndarray) -> Surroundings:
        """Set the costs: the log of how many times as frequent the best other reading is, from ``RATIO`` on.

        Only places beside an ASCII letter cost all of it, those between
        blanks, digits and marks three quarters, and those within words of another
        script nothing, as there a byte's readings are words of their own.
        """
        there = counts.reshape(len(self.characters), CLASSES, CLASSES)
        best = np.zeros_like(there)
        for other in self.readings:
            at = np.flatnonzero(other >= 0)
            best[at] = np.maximum(best[at], there[other[at]])
        ratio = (best + 1) / np.maximum(there, 1)
        kind = np.arange(CLASSES)
        letter, mark = (kind >= 3) & (kind < 55), kind < 3
        self.weight = np.where(letter[:, None] | letter[None, :], 1.0, np.where(mark[:, None] & mark[None, :], 0.75, 0.0)) / np.log(RATIO)
        cost = np.where(ratio >= RATIO, np.log(ratio) * self.weight, 0)
        cost[self.number[0xA0]] = 0  # the blank that does not break may stand anywhere
        self.cost_of, self.mails, self.readings = cost.astype(np.float32).reshape(-1), counts.astype(np.float32), []
        return self

    def cost(self, word: str) -> float:
        known = self.known.get(word)
        if known is None:
            if len(self.known) >= 200_000:
                self.known.clear()
            known = self.known[word] = float(self.cost_of[self.cells(word)].sum())
        return known

    def gain(self, text: str, other: str) -> float:
        """How much more usual the costly places of ``text`` are in another single-byte reading of it; negative if less."""
        if not self.cost(text):
            return 0.0
        a, b = self.cells(text), self.cells(other)
        if len(a) != len(b):
            return 0.0
        odd = self.cost_of[a] > 0
        a, b = a[odd], b[odd]
        weight = self.weight.reshape(-1)[a % (CLASSES * CLASSES)]
        return float((np.log((self.mails[b] + 1) / np.maximum(self.mails[a], 1)) * weight).sum())


def _counts(places: Surroundings):
    schema = pa.schema([("cell", pa.int32()), ("mails", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(places.size, dtype=np.int64)
        for batch in batches:
            held = []
            for text in batch.column(0).to_pylist():
                subject, parts = read_mail(text)
                own = [places.cells(p) for p in (subject, *parts) if not p.isascii()]
                if own:
                    held.append(np.unique(np.concatenate(own)))
            if held:
                total += np.bincount(np.concatenate(held), minlength=places.size)
        cells = np.flatnonzero(total)
        for a in range(0, len(cells), 50_000):
            part = cells[a : a + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(total[part], pa.int64())], schema=schema)

    return run


def surroundings(df: DataFrame, read_as: tuple[str, ...], written_in: tuple[str, ...], text: str = "text") -> Surroundings:
    """The costs fitted on all mails of ``df``.

    Each task counts mails per cell in an array; the arrays' filled cells are
    summed in one shuffle. The driver collects at most ``size`` rows (about
    650 characters times 59 times 59), whatever the input.
    """
    places = Surroundings(read_as, written_in)
    rows = df.select(F.col(f"`{text}`").cast("string").alias("t")).where("t is not null").mapInArrow(_counts(places), "cell int, mails long")
    found = rows.groupBy("cell").agg(F.sum("mails").alias("mails")).toPandas()
    counts = np.zeros(places.size, dtype=np.int64)
    counts[found["cell"].to_numpy(dtype=np.int64)] = found["mails"].to_numpy(dtype=np.int64)
    return places.fit(counts)
