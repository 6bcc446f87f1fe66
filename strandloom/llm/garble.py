"""Garbled text from wrong character encoding (problem 8)."""

from __future__ import annotations

import binascii
import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.mail import read_mail
from strandloom.llm.surroundings import Surroundings, surroundings

# Encodings a text may have been read in by mistake, and those it may have been written in.
READ_AS = ("cp1252", "cp1250", "cp1251", "cp1253", "cp1254", "iso8859-2", "iso8859-5", "iso8859-7", "koi8-r", "cp866", "cp437", "cp850", "cp852", "mac-roman", "mac-cyrillic")
WRITTEN_IN = ("cp1252", "cp1251", "koi8-r", "cp866", "iso8859-5", "mac-cyrillic", "cp1253", "iso8859-7", "cp1250", "iso8859-2", "cp852", "cp850", "cp437", "mac-roman", "shift_jis", "euc_jp")
SINGLE_BYTE = WRITTEN_IN[:-2]


class _Bytes(dict):
    """str.translate table from an encoding's characters to its byte values; C1 controls stand for bytes it leaves out."""

    def __init__(self, encoding: str):
        for b in range(128, 256):
            try:
                self[ord(bytes([b]).decode(encoding))] = b
            except UnicodeDecodeError:
                pass
        for b in range(128, 160):
            self.setdefault(b, b)

    def __missing__(self, code: int) -> int:
        return code if code < 128 else 0xFFFF  # which latin-1 refuses


_TABLES = {e: _Bytes(e) for e in READ_AS}


def _encode(text: str, encoding: str) -> bytes | None:
    try:
        return text.translate(_TABLES[encoding]).encode("latin-1")
    except UnicodeEncodeError:
        return None


_LETTER = r"[^\W\d_]"
_SYMBOL = "[¡-©«¬\xad®-´¶¸¹»-¿×÷№†‡•‰‹›€™‚„“”ˆ˜˘˙˛ˇ−∂∆∏∑√∞∫≈≠≤≥◊⌐ⁿ⌠⌡─-▟]"
_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
#: What garbled text has and ordinary text hardly ever, with its weight.
_COST = [
    (re.compile("[\x80-\x9f�]"), 2.0),
    (re.compile(rf"(?<={_LETTER}){_SYMBOL}+(?={_LETTER})"), 2.0),
    (re.compile(rf"(?<={_LETTER})[\xad¸¹³±¿¯¡£¥¦¬√├┬│┤─-▟†‡]+"), 0.7),
    (re.compile(rf"(?<![^\s(>\"'“„])[\xad¸¹³¯¬¶‡†├┬Γ]+(?={_LETTER})"), 0.7),
    (re.compile("[a-zß-öø-ÿąćęłńśźż][À-ÖØ-ÞĀĂĄĆĈĊČĎĐĒĔĖĘĚĹĽĻĿŁŃŇŌŎŐŒŔŘŚŜŞŠŢŤŪŬŮŰŸŹŻŽ]"), 1.5),
    (re.compile(rf"[{_LATIN}][Ͱ-ϿЀ-ӿ]|[Ͱ-ϿЀ-ӿ][{_LATIN}]|[Ͱ-Ͽ][Ѐ-ӿ]|[Ѐ-ӿ][Ͱ-Ͽ]"), 2.0),
    (re.compile("(?<![^\\W\\d_])[À-ÖØ-öø-ÿ]{4,}(?![^\\W\\d_])"), 3.0),
    (re.compile("[а-яё][А-ЯЁЂ-Џ]"), 1.5),
    (re.compile("[α-ωά-ώ][Α-ΩΆ-Ώ]"), 1.5),
    (re.compile("[А-Яа-яёЁ][ЂЃЉЊЌЋЏђѓљњќћџЈјҐґЄєЅѕІіЇї]|[ЂЃЉЊЌЋЏђѓљњќћџҐґЄєЅѕІіЇї][А-Яа-яёЁ]"), 0.2),
    (re.compile(f"[{_LATIN}][⺀-ヿ一-鿿！-￮]|[⺀-ヿ一-鿿！-￮][{_LATIN}]"), 2.0),
    (re.compile("(?<![^\\W\\d_])[A-Z][À-ÖØ-Þ](?=[a-z]{2})"), 1.0),
    (re.compile("[À-ÖØ-öø-ɏ](?=\\d)"), 0.5),
    (re.compile("[─-▟](?=[─-▟]*[^\\W\\d_])|(?<=[^\\W\\d_])[─-▟]"), 0.5),
    # these only decide between readings that are equally good otherwise
    (re.compile("(?<![^\\W\\d_])[А-ЯЁ]{3,}(?![^\\W\\d_])|(?<![^\\W\\d_])[Α-ΩΆ-Ώ]{3,}(?![^\\W\\d_])"), 0.01),
    (re.compile("[бвгджзклмнпрстфхцчшщБВГДЖЗКЛМНПРСТФХЦЧШЩ]{5,}|[ъыьЪЬ]{2}|(?<![^\\W\\d_])[ъыьЪЬ]|[ЪЫЬ][а-я]"), 0.02),
    (re.compile("[άέήίόύώ][α-ωά-ώ]*[άέήίόύώ]"), 0.02),
    (re.compile("ё"), 0.005),
    (re.compile("[^\x00-\x7fäöüÄÖÜßéèàùâêîôûçñáíóúãõąćęłńśźżœА-яёЁΑ-ώ぀-ヿ一-鿿’“”–€°\xa0]"), 0.01),
]
_PLAIN = re.compile("[\x00-\x7f¡-ſˆ˜΄-ώЀ-ёђ-џҐґẞ‐-•…‰-›‾€№™←-⇿∀-⋿①-⑳─-◿☀-➿、-ヿ一-鿿！-￮]*")
_RUN = re.compile("[^\x00-\x7f]+")
_UTF8 = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
_REFERENCES = re.compile(r"(?:&#(?:x[0-9a-fA-F]{2,4}|\d{2,4});)+")
_UTF7 = re.compile(r"\+([A-Za-z0-9+/]{2,})(-|(?![A-Za-z0-9+/-]))")


_ASIAN = re.compile("[⺀-鿿가-힣豈-﫿！-￮]")


@lru_cache(maxsize=200_000)
def _shape_cost(word: str) -> float:
    return sum(weight * len(pattern.findall(word)) for pattern, weight in _COST)


def garbling_cost(text: str, places: Surroundings | None = None) -> float:
    """What is odd about a text: sequences that only garbled text has and, given ``places``, characters where the collection has others."""
    cost = 0.0
    for word in text.split(" "):
        if not word.isascii():
            cost += _shape_cost(word) + (places.cost(word) if places else 0.0)
    return cost


@lru_cache(maxsize=200_000)
def _run_as_utf8(run: str) -> str | None:
    """A run of non-ASCII characters, re-encoded and strictly decoded as UTF-8, or with its outer quotes left out."""
    for encoding in READ_AS:
        raw = _encode(run, encoding)
        if raw is None or not _UTF8.search(raw):
            continue
        for a, b in ((0, len(raw)), (0, len(raw) - 1), (1, len(raw)), (1, len(raw) - 1), (0, len(raw) - 2), (2, len(raw))):
            if b - a < 2:
                continue
            try:
                out = run[:a] + raw[a:b].decode("utf-8") + run[b:]
            except UnicodeDecodeError:
                continue
            if (asian := _ASIAN.findall(out)) and (b - a < len(raw) or len(asian) < 2):
                continue  # three single-byte letters in a row can be one such character by chance
            if all(c in run or ord(c) in _TABLES["cp1252"] or _PLAIN.fullmatch(c) for c in out):
                return out
    return None


def _utf7(m: re.Match) -> str:
    code = m[1]
    if len(code) % 4 == 1:
        return m[0]
    raw = binascii.a2b_base64(code + "=" * (-len(code) % 4))
    unused = {2: 0x0F, 3: 0x03}.get(len(code) % 4, 0)
    last = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/".index(code[-1])
    if len(raw) % 2 or last & unused:
        return m[0]
    try:
        out = raw.decode("utf-16-be")
    except UnicodeDecodeError:
        return m[0]
    # without its end mark only what Latin text has is taken for UTF-7
    letters = "[¡-ſ΄-ώЀ-ё‐-…€−№。-ヿ一-鿿！-￮]+" if m[2] else "[¡-ſ‐-…€−]+"
    return out if re.fullmatch(letters, out) else m[0]


def _undisguised(text: str) -> tuple[str, int]:
    """(the text with its disguised UTF-8, byte references and UTF-7 read, number of places that changed)."""
    places = 0

    def utf8(m: re.Match) -> str:
        nonlocal places
        out = _run_as_utf8(m[0])
        places += out is not None
        return m[0] if out is None else out

    def references(m: re.Match) -> str:
        # those that name bytes, not characters, are resolved; others stay
        plain = html.unescape(m[0])
        fixed = _RUN.sub(utf8, plain)
        return fixed if fixed != plain else m[0]

    def utf7(m: re.Match) -> str:
        nonlocal places
        out = _utf7(m)
        places += out != m[0]
        return out

    text = _RUN.sub(utf8, text)
    return _UTF7.sub(utf7, _REFERENCES.sub(references, text)), places


def _best(text: str, places: Surroundings | None) -> tuple[str, float]:
    """The cheapest reading of one line by one more layer: each place that hides other characters costs 1 beside what shows."""
    now = garbling_cost(text, places)
    step, hidden = _undisguised(text)
    if hidden and (cost := garbling_cost(step, places)) < now + hidden:
        return step, cost
    if now < 0.99:
        return text, now
    other = _other_encoding(text, now, places)
    return other, garbling_cost(other, places)


def _other_encoding(text: str, now: float, places: Surroundings | None) -> str:
    """One legacy encoding read as another: the pair that makes the words cheapest.

    Words are judged one by one, as ordinary text may stand beside garbled
    text; between the first and the last word that gains, all that do not lose
    are read anew. The line as a whole must become cheaper.
    """
    words = text.split(" ")
    costs = {w: garbling_cost(w, places) for w in set(words) if not w.isascii() and "\ufffd" not in w}
    readings = {w: _readings(w, places) for w in costs}
    odd = {wrong for w, (encodable, _, _) in readings.items() if costs[w] for wrong in encodable}
    best, most = text, 0.0
    # only pairs under which a word gains can win
    for pair in sorted({pair for _, _, better in readings.values() for pair in better if pair[0] in odd}):
        gains = {w: pairs[pair] for w, (_, pairs, _) in readings.items() if pair in pairs}
        dearer = [i for i, w in enumerate(words) if w in gains and gains[w][1] > 0]
        span = range(dearer[0], dearer[-1] + 1)
        new = [gains[w][0] if i in span and w in gains and gains[w][1] >= 0 else w for i, w in enumerate(words)]
        gain = sum(gains[w][1] for i, w in enumerate(words) if i in span and w in gains and gains[w][1] >= 0)
        before = sum(costs[words[i]] for i in dearer)
        if gain > most + 1e-9 and gain >= 0.99 and gain >= before / 2 and garbling_cost(line := " ".join(new), places) < now:
            best, most = line, gain
    return best


KEPT = 2_000  # words whose readings a task keeps, of about 20 kB each
_bare: dict[str, tuple] = {}  # readings without a collection's surroundings


def _readings(word: str, places: Surroundings | None) -> tuple[list[int], dict[tuple[int, int], tuple[str, float]], list[tuple[int, int]]]:
    """What a word may be: the encodings it can have been read in, its plain readings with their gains by the numbers of the pair, and the pairs that gain."""
    known = _bare if places is None else places.readings_of
    if word in known:
        return known[word]
    encodable, pairs, met = [], {}, {}
    own = garbling_cost(word)
    for i, wrong in enumerate(READ_AS):
        raw = _encode(word, wrong)
        if raw is None:
            continue
        encodable.append(i)
        for j, right in enumerate(WRITTEN_IN):
            if right == wrong:
                continue
            try:
                other = raw.decode(right)
            except UnicodeDecodeError:
                continue
            single = right in SINGLE_BYTE
            if (other, single) not in met:
                met[other, single] = None
                if _PLAIN.fullmatch(other):
                    better = places.gain(word, other) if places and single else 0.0
                    met[other, single] = other, own - garbling_cost(other) + better
            if met[other, single]:
                pairs[i, j] = met[other, single]
    if len(known) >= KEPT:
        known.clear()
    known[word] = encodable, pairs, [pair for pair, (_, gain) in pairs.items() if gain > 0]
    return known[word]


@lru_cache(maxsize=200_000)
def _hides(word: str) -> bool:
    return _undisguised(word)[1] > 0


def _is_plain(line: str, places: Surroundings | None) -> bool:
    """Whether nothing would be tried on the line; asked word by word, as words recur."""
    if line.isascii() and "&#" not in line and "+" not in line:
        return True
    cost = 0.0
    for word in line.split(" "):
        if word.isascii() and "&#" not in word and "+" not in word:
            continue
        if _hides(word):
            return False
        cost += _shape_cost(word) + (places.cost(word) if places else 0.0)
    return cost < 0.99


def repair(text: str, places: Surroundings | None = None) -> tuple[str, int, bool]:
    """(the text with garbled lines restored where that is possible, layers undone, whether letters are lost).

    Layers are undone until no reading is cheaper. Each makes the line shorter,
    or cheaper and no longer, so this ends.
    """
    if not text or text.isascii() and "&#" not in text and "+" not in text:
        return text, 0, False
    out, layers = [], 0
    for line in text.split("\n"):
        n = 0
        while not _is_plain(line, places):
            fixed, _ = _best(line, places)
            if fixed == line:
                break
            line, n = fixed, n + 1
        layers = max(layers, n)
        out.append(line)
    whole = "\n".join(out)
    return whole, layers, "�" in whole


def _repair_mails(places):
    schema = pa.schema([("id", pa.int64()), ("part", pa.int32()), ("layers", pa.int32()), ("lost", pa.bool_()), ("restored", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs = places.value
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                subject, parts = read_mail(text)
                for n, part in enumerate([subject, *parts]):
                    fixed, layers, lost = repair(part, costs)
                    if layers or lost:
                        for column, value in zip(rows, (ident, n, layers, lost, fixed)):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(r, type=f.type) for r, f in zip(rows, schema)], schema=schema)

    return run


def garbled_parts(df: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Subjects and text parts that hold wrongly decoded characters, restored where possible.

    Result: ``id``, ``part`` (0: subject, then the text parts in order),
    ``layers`` (wrong decodings undone), ``lost`` (letters are gone for good)
    and ``restored`` (the whole part). Parts without such characters have no
    row.

    Each line is re-encoded under candidate legacy encodings and strictly
    decoded as the intended one, layer by layer until nothing is gained; a
    reading is accepted where the garbling cost drops. The cost counts
    sequences that only garbled text has, places that hide other characters
    (UTF-8, byte references, UTF-7), and characters that stand where the
    collection has another reading of the same byte ``RATIO`` times as often.
    For the last, one pass over all mails counts characters by their
    neighbours; its result has a fixed bound (see ``surroundings``) and is
    broadcast.

    A null, empty or plain ASCII text has no row unless it holds disguised
    references or UTF-7; very long texts are read whole; repeated rows are
    read each; other columns are ignored, whatever their names; an empty
    input gives an empty result. No mail is shuffled.
    """
    places = df.sparkSession.sparkContext.broadcast(surroundings(df, READ_AS, SINGLE_BYTE, text))
    columns = df.select(F.col(f"`{ident}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("t"))
    return columns.mapInArrow(_repair_mails(places), "id long, part int, layers int, lost boolean, restored string")
