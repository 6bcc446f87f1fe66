import random

import numpy as np
import pytest

from strandloom.llm import garble
from strandloom.llm.garble import garbled_parts, repair
from strandloom.llm.surroundings import Surroundings

TEXTS = {
    "de": "Die Prüfung gehört für größere Behälter natürlich nicht außerhalb.",
    "fr": "L’équipe a gêné la pâte thermique après l’été, dès réception.",
    "pl": "Próbka źle wpływa na większą chłodnię i żądaną ilość.",
    "ru": "Ночная смена ещё не дошла до общего журнала.",
    "el": "Η παραλαβή ταιριάζει με την παλιά σύμβαση χωρίς εξήγηση.",
    "ja": "荷物はまだ届いていない次の便と月末まで保管します。",
}
UNUSUAL = [
    "Résumé™ form ®, 12 € • “Âge” ‚einfach‘ „doppelt“ ‰",
    "CARTÃO: SÃO TRÊS, NÃO DOIS. ÂMBAR © 2024",
    "√9 ≠ 4, ± 0.5 Å, ½ rack – see © notice ™ on the box ♻ ┌──┬──┐ │ ok │",
    "│ rack ├─ row 4 ┤ √(2·µ) ≈ 1½ │",
    "Ѓорѓи, Љиља и Џемо – „три кутије“ № 5.",
    "Guðný & Þórvi: Ð-Block, Tür ¾ offen.",
    "Ő, Ű, č, ř, ż, ŕ – glyph test for the labels…",
    r"C:\data\µ\+Aufnahme-9, 5+3-2=6 &amp; so on.",
    "¡Ñandú! ¿Ü o Û? «À côté», 30 °C ± 2.",
    "ВНИМАНИЕ: СКЛАД ЗАКРЫТ, Ё-КОД СМЕНЁН.",
    "ΠΡΟΣΟΧΗ: Η ΑΠΟΘΗΚΗ ΕΙΝΑΙ ΚΛΕΙΣΤΗ – µ, Ω.",
    "plain words, 3 < 4",
    "",
]


def sloppy(raw, encoding):
    return "".join(bytes([b]).decode(encoding) if b < 128 or bytes([b]).decode(encoding, "ignore") else chr(b) for b in raw)


@pytest.mark.parametrize("lang", TEXTS)
@pytest.mark.parametrize("wrong", ["latin-1", "cp1252", "cp437", "mac-roman", "cp1250", "cp1251"])
def test_round_trip_of_utf8(lang, wrong):
    text = TEXTS[lang]
    once = sloppy(text.encode(), wrong)
    assert repair(once) == (text, 1, False)
    if wrong in ("latin-1", "cp1252"):
        assert repair(sloppy(once.encode(), wrong)) == (text, 2, False)


@pytest.mark.parametrize(
    "lang, right, wrong",
    [("de", "cp1252", "cp437"), ("fr", "cp1252", "mac-roman"), ("ru", "cp1251", "latin-1"), ("ru", "koi8-r", "latin-1"), ("ru", "cp866", "cp1251"), ("ru", "koi8-r", "cp1251"), ("el", "cp1253", "latin-1"), ("ja", "shift_jis", "cp1252"), ("ja", "euc_jp", "latin-1")],
)
def test_round_trip_between_legacy_encodings(lang, right, wrong):
    text = TEXTS[lang]
    assert repair(sloppy(text.encode(right), wrong))[0] == text


@pytest.mark.parametrize("text", [*UNUSUAL, *TEXTS.values()])
def test_correct_text_is_left_alone(text):
    assert repair(text) == (text, 0, False)


def test_references_utf7_and_lost_letters():
    assert repair("m&#195;&#161;s r&#195;&#161;pida") == ("más rápida", 1, False)
    assert repair("the +IBw-blue+IB0 folder") == ("the “blue” folder", 1, False)
    assert repair("Sent 10:03 +0530, +49 30 A+B+CD")[1] == 0
    assert repair("ÐáñáëáâÞ 1869") == ("Παραλαβή 1869", 1, False)
    assert repair("Pr+APw-fung") == ("Prüfung", 1, False)
    assert repair("Pr��fung") == ("Pr��fung", 0, True)


def test_mails(spark):
    rows = [
        (1, "Subject: Pr\u00c3\u00bcfung\n\nbody"),
        (2, "Subject: =?utf-8?q?Pr=C3=BCfung?=\n\nbody"),
        (3, "Subject: =?utf-8?q?Pr=C3=83=C2=BCfung?=\n\nbody"),
        (4, "Subject: x\nContent-Transfer-Encoding: quoted-printable\n\ncaf=C3=A9 caf=C3=83=C2=A9"),
        (5, None),
        (6, ""),
        (1, "Subject: Pr\u00c3\u00bcfung\n\nbody"),
    ]
    df = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, id int")
    got = sorted((r["id"], r["part"], r["restored"]) for r in garbled_parts(df).collect())
    assert got == [(1, 0, "Prüfung"), (1, 0, "Prüfung"), (3, 0, "Prüfung"), (4, 1, "café café")]
    assert garbled_parts(df.limit(0)).collect() == []


def test_the_collection_decides_where_no_sequence_is_odd(spark):
    plain = ["La señal del año pasado no llegó", "It doesn’t match the key", "A estação não abre, 5 °C – “ok”"]
    rows = [(i, f"Subject: {i}\n\n{plain[i % 3]}") for i in range(300)]
    odd = {1000: plain[0].encode("cp1252").decode("cp1250"), 1001: plain[1].encode("cp1252").decode("mac-roman"), 1002: plain[2].encode("cp1252").decode("iso8859-2"), 1003: plain[2].encode("cp1252").decode("mac-roman")}
    rows += [(i, f"Subject: x\n\n{t}") for i, t in odd.items()] + [(1004, "Subject: x\n\nŁódź, dzień dobry"), (1005, "Subject: x\n\nla letra ñ o û?")]
    got = {r["id"]: r["restored"] for r in garbled_parts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1000: plain[0], 1001: plain[1], 1002: plain[2], 1003: plain[2]}


def test_planted_passages_are_found(spark):
    """Recall and precision on own labels: clean mails, a tenth of which is garbled by a known pair."""
    pairs = [("cp1252", "cp1250"), ("cp1252", "mac-roman"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1250", "cp1252"), ("cp1251", "cp1252"), ("koi8-r", "cp1251"), ("cp1253", "cp1252"), ("utf-8", "cp1252"), ("utf-8", "cp1250")]
    rows, planted = [], set()
    for i in range(2000):
        lang = list(TEXTS)[i % 5]
        text = TEXTS[lang]
        if i % 10 == 0:
            right, wrong = pairs[i // 10 % len(pairs)]
            try:
                bad = sloppy(text.encode(right), wrong)
            except UnicodeEncodeError:
                bad = sloppy(text.encode(), wrong)
            if bad != text:
                planted.add(i)
                text = bad
        rows.append((i, f"Subject: {i}\n\n{text}"))
    found = {r["id"] for r in garbled_parts(spark.createDataFrame(rows, "doc_id long, text string")).select("id").collect()}
    assert found <= planted
    assert len(found) >= 0.97 * len(planted)


def test_deeply_nested_parts():
    from strandloom.llm.mail import read_mail

    mail = "café"
    for n in range(60):
        mail = f"Content-Type: multipart/mixed; boundary=b{n}x\n\n--b{n}x\n" + (mail if n else f"Content-Type: text/plain\n\n{mail}") + f"\n--b{n}x--\n"
    assert [p.strip() for p in read_mail("Subject: s\n" + mail)[1]] == ["café"]


def _tried_pair_by_pair(text, now, places):
    """The plain way to the cheapest pair of encodings."""
    words = text.split(" ")
    costs = {w: garble.garbling_cost(w, places) for w in set(words) if not w.isascii() and "�" not in w}
    best, most = text, 0.0
    for wrong in garble.READ_AS:
        raws = {w: raw for w in costs if (raw := garble._encode(w, wrong)) is not None}
        if not any(costs[w] for w in raws):
            continue
        for right in garble.WRITTEN_IN:
            gains = {}
            for w, raw in raws.items():
                try:
                    other = raw.decode(right)
                except UnicodeDecodeError:
                    continue
                if right != wrong and garble._PLAIN.fullmatch(other):
                    better = places.gain(w, other) if places and right in garble.SINGLE_BYTE else 0.0
                    gains[w] = other, garble.garbling_cost(w) - garble.garbling_cost(other) + better
            dearer = [i for i, w in enumerate(words) if w in gains and gains[w][1] > 0]
            if not dearer:
                continue
            inside = [dearer[0] <= i <= dearer[-1] and w in gains and gains[w][1] >= 0 for i, w in enumerate(words)]
            line = " ".join(gains[w][0] if take else w for w, take in zip(words, inside))
            gain = sum(gains[w][1] for w, take in zip(words, inside) if take)
            if gain > most + 1e-9 and gain >= 0.99 and gain >= sum(costs[words[i]] for i in dearer) / 2 and garble.garbling_cost(line, places) < now:
                best, most = line, gain
    return best


def test_readings_kept_by_word_decide_as_pair_by_pair(monkeypatch):
    rng = random.Random(4)
    lines = []
    for right, wrong in [("cp1252", "cp437"), ("cp1252", "mac-roman"), ("cp1251", "cp1252"), ("koi8-r", "cp1251"), ("cp866", "cp1252"), ("cp1253", "cp1252"), ("cp1250", "cp1252"), ("shift_jis", "cp1252")]:
        for text in TEXTS.values():
            raw = text.encode(right, "ignore")
            words = (sloppy(raw, wrong) + " " + rng.choice(UNUSUAL)).split()
            lines.append(" ".join(rng.sample(words, k=min(5, len(words)))))
    places = Surroundings(garble.READ_AS, garble.SINGLE_BYTE)
    counts = np.zeros(places.size, dtype=np.int64)
    for text in TEXTS.values():
        counts += 300 * np.bincount(places.cells(text), minlength=places.size)
    places.fit(counts)
    changed = 0
    for line in lines:
        for known in (None, places):
            now = garble.garbling_cost(line, known)
            got = garble._other_encoding(line, now, known)
            assert got == _tried_pair_by_pair(line, now, known)
            changed += got != line
    assert changed > 20
    tried = []
    encode = garble._encode
    monkeypatch.setattr(garble, "_encode", lambda w, e: tried.append(w) or encode(w, e))
    for line in lines[-20:]:
        garble._other_encoding(line, garble.garbling_cost(line, places), places)
    assert not tried  # words met before are not read again
