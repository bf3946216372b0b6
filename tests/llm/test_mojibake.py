"""Garbled text: planted cases must be found and undone, and clean ones left alone."""

import random

import pyarrow as pa
import pytest

from weftline.llm.mojibake import GarbledText, _table, undo

LINES = [
    "Prüfe die Größe des Puffers und die Schlüssel", "Vérifié à l’étape précédente, déjà répétée", "Añade la función después del diseño pequeño", "Não usa a função até não haver posições",
    "Проверено на больших файлах и больших узлах", "Przyspiesz źródło etykiet gdy brak błędów ścieżki", "Değişiklik sıralamayı bozmadı, büyük dosya", "The “naïve” façade stays — as it’s ½ done",
    "順序は変わらない。 大きな入力でも確認済み。", "plain ascii only", "ATENÇÃO: NÃO USAR A FUNÇÃO", "┌──┬──┐ table", "90 µs ± 5 °C·h… → 3 ≤ 4", "α < β holds", "É» and Ü– here",
]


def garble(text, written, read):
    return "".join(_table(read)[0][b] for b in text.encode(written))


def frame(spark, rows):
    kinds = pa.schema([("id", pa.int64()), ("text", pa.string()), ("word", pa.string()), ("key", pa.string()), ("restored", pa.string())])
    return spark.createDataFrame(pa.Table.from_pylist([{"id": k, "text": t} for k, t in rows], schema=kinds)).repartition(3)


def corpus(rng, n):
    return [(k, "\n".join(f"{rng.choice(['', '+ ', '# '])}{rng.choice(LINES)}" for _ in range(6))) for k in range(n)]


CASES = [("utf_8", r) for r in ("cp1252", "latin_1", "cp437", "cp850", "mac_roman", "cp1250", "cp1251", "cp1254")]
CASES += [("cp1251", "cp1252", LINES[4]), ("koi8_r", "cp1251", LINES[4]), ("cp1252", "mac_roman", LINES[1]), ("cp1254", "cp1252", LINES[6]), ("iso8859_2", "latin_1", LINES[5]), ("euc_jp", "latin_1", LINES[8])]


def test_planted_cases(spark):
    rng = random.Random(1)
    rows, planted = corpus(rng, 400), {}
    for n, case in enumerate(CASES * 4):
        written, read, line = case if len(case) == 3 else (*case, LINES[n % 8])
        text = f"Some plain words first\n{line}\nand some after, number {n}"
        planted[1000 + n] = text
        rows.append((1000 + n, garble(text, written, read)))
    for n in range(6):
        planted[2000 + n] = LINES[n]
        rows.append((2000 + n, garble(garble(LINES[n], "utf_8", "cp1252"), "utf_8", "cp1252")))
    rows.append((3000, "lost: M�ller"))
    rows += [(4000 + k, t) for k, t in enumerate(LINES)] + [(5000, None), (5001, ""), (None, "plain"), (5002, "x" * 200_000)]
    found = GarbledText(frame(spark, rows), key="id", text="text")
    ids = {r["id"] for r in found.found().collect()}
    assert ids == {*planted, 3000}
    restored = {r["id"]: r for r in found.restored().collect()}
    assert restored.keys() == ids
    exact = [k for k, t in planted.items() if restored[k]["restored_text"] == t]
    assert len(exact) >= 0.9 * len(planted), [(restored[k]["restored_text"], planted[k]) for k in planted if k not in exact]
    assert restored[3000]["n_lost"] == 1 and restored[3000]["restored_text"] == "lost: M�ller"


def test_transformation_is_learned_from_a_twin(spark):
    """One clean twin line teaches an encoding pair that the vocabulary alone does not."""
    line = "Kürze die geprüften Schlüssel für Knoten"
    g = GarbledText(frame(spark, [(1, line), (2, line), (3, garble(line, "cp1252", "mac_roman"))]), key="id", text="text")
    assert "cp1252>mac_roman" in g.learned


def test_nothing_to_find(spark):
    for rows in ([], [(1, None)], [(1, "ascii"), (2, "")], [(1, "naïve"), (1, "naïve")]):
        g = GarbledText(frame(spark, rows), key="id", text="text")
        assert g.found().count() == 0 == g.restored().count()


def test_repeated_and_null_identifiers(spark):
    bad = garble("naïve façade", "utf_8", "cp1252")
    g = GarbledText(frame(spark, [(1, bad), (1, bad), (None, bad), (2, "naïve façade")]), key="id", text="text")
    assert sorted((r["id"] for r in g.found().collect()), key=str) == [1, None]


@pytest.mark.parametrize("written,read", [("utf_8", "cp1252"), ("utf_8", "cp437"), ("cp1251", "latin_1"), ("euc_jp", "latin_1")])
def test_undo_is_exact(written, read):
    for line in LINES:
        try:
            assert undo(garble(line, written, read), written, read) in (line, None if line.isascii() else line)
        except UnicodeEncodeError:
            pass


def test_copies_of_a_garbled_text_outnumber_its_twin(spark):
    """Copies don't count against a word, and a clean twin settles it, however frequent either is."""
    line = "Kürze die geprüften Schlüssel für Knoten"
    words = [(10 + n, f"Zeile {n}: größere Blöcke") for n in range(4)]
    rows = [(k, garble(line, "cp1252", "mac_roman")) for k in range(6)] + [(6, line)]
    rows += [(20 + k, "ganz anderswo: " + garble("größere Blöcke", "cp1252", "mac_roman")) for k in range(6)] + words
    g = GarbledText(frame(spark, rows), key="id", text="text")
    assert {r["id"] for r in g.found().collect()} == {*range(6), *range(20, 26)}
    assert {r["restored_text"] for r in g.restored().collect()} == {line, "ganz anderswo: größere Blöcke"}


def test_garbled_parts_beside_clean_characters(spark):
    """What adjoins a garbled run without a blank (quotes, dashes, East Asian text) doesn't hide it."""
    word = garble("naïve", "utf_8", "cp1252")
    rows = [(1, f"the “{word}” way"), (2, f"順序は{word}変わらない。"), (3, f"a—{word}—b"), (4, "the “naïve” way"), (5, "順序はnaïve変わらない。")]
    g = GarbledText(frame(spark, rows), key="id", text="text")
    assert sorted(r["id"] for r in g.found().collect()) == [1, 2, 3]
    assert {r["restored_text"] for r in g.restored().collect()} == {"the “naïve” way", "順序はnaïve変わらない。", "a—naïve—b"}


OTHER = {
    "polish": "Zażółć gęślą jaźń", "arabic": "تحقق من الملفات الكبيرة", "thai": "ตรวจสอบไฟล์ขนาดใหญ่", "hindi": "बड़ी फ़ाइलों की जाँच करें", "armenian": "Ստուգեք մեծ ֆայլերը",
    "hebrew": "בדוק קבצים גדולים", "ukrainian": "Ґанок і ґудзик перевірено її", "russian": "Проверено на больших файлах", "emoji": "all done 😀🎉 here", "nfd": "café résumé",
}


@pytest.mark.parametrize("read", ["cp1252", "cp1251", "mac_roman"])
def test_utf8_misread_shows_by_its_form(spark, read):
    """Any script through any reader, once in the corpus; whatever other transformations are learned."""
    line = "Kürze die geprüften Schlüssel für Knoten"
    taught = [(100, line), (101, line), (102, garble(line, "cp1252", "mac_roman"))]
    bad = [(k, garble(t, "utf_8", read)) for k, t in enumerate(OTHER.values())]
    g = GarbledText(frame(spark, [*bad, *taught]), key="id", text="text")
    assert "cp1252>mac_roman" in g.learned
    assert {r["id"]: r["restored_text"] for r in g.restored().collect()} == dict(enumerate(OTHER.values())) | {102: line}


@pytest.mark.parametrize("name", ["polish", "arabic", "russian"])
def test_utf8_misread_alone(spark, name):
    for read in ("cp1252", "cp1251", "mac_roman"):
        g = GarbledText(frame(spark, [(1, garble(OTHER[name], "utf_8", read))]), key="id", text="text")
        assert [r["restored_text"] for r in g.restored().collect()] == [OTHER[name]]


def test_misread_many_times(spark):
    """However often UTF-8 was misread, and with its other stages about as well, the first text comes back."""
    rows, bad = [], "the naïve façade"
    for k in range(6):
        bad = garble(bad, "utf_8", "cp1252")
        rows.append((k, bad))
    for some in (rows, rows[:2], rows[-1:]):
        g = GarbledText(frame(spark, some), key="id", text="text")
        assert {r["id"]: r["restored_text"] for r in g.restored().collect()} == {k: "the naïve façade" for k, _ in some}


RUSSIAN = "Упростить поиск соседей потому что старый план медленный"


def test_without_twins_other_encodings_are_not_told(spark, monkeypatch):
    """The twin join decides on all but UTF-8: without what it shows, these cases are lost."""
    rows = [(1, "* " + garble(RUSSIAN, "koi8_r", "cp1251")), (2, garble("Ускорить поиск соседей", "koi8_r", "cp1251"))]
    rows += [(k, f"# {RUSSIAN}, {k}\nУскорить поиск") for k in range(10, 20)]
    g = GarbledText(frame(spark, rows), key="id", text="text")
    assert "koi8_r>cp1251" in g.learned and {r["id"] for r in g.found().collect()} == {1, 2}
    assert {r["id"]: r["restored_text"] for r in g.restored().collect()}[2] == "Ускорить поиск соседей"
    monkeypatch.setattr(GarbledText, "_learned", lambda self: {})
    monkeypatch.setattr(GarbledText, "_twins", lambda self: self.spark.createDataFrame([], "how string, n long, able long, word string, restored string, sure boolean"))
    assert GarbledText(frame(spark, rows), key="id", text="text").found().count() == 0


def test_support_is_a_share(spark):
    """A pair that explains few of the twins that it could have explained is chance and not learned."""
    line = "Kürze die geprüften Schlüssel für Knoten {}"
    other = [(100 + k, line.format(k).replace("ü", "ö")) for k in range(60)] + [(200 + k, line.format(k).replace("ü", "é")) for k in range(60)]
    g = GarbledText(frame(spark, other + [(1, line.format("x")), (2, garble(line.format("x"), "cp1252", "cp437"))]), key="id", text="text")
    n, able = g.shown["cp1252>cp437"]
    assert n < 0.05 * able or "cp1252>cp437" in g.learned


def test_genuine_words_that_are_valid_utf8_by_chance(spark):
    """Such words are common in some readers' languages, and are no case by themselves."""
    rows = [(1, "Только так, уже там: чем её, Её и тем"), (2, "reprend\xa0à la\xa0étape «\xa0été\xa0»"), (3, "É» and Ü– here, x² and 5 °C"), (4, "联通 数据 变更"), (5, "Її рік і Рік")]
    g = GarbledText(frame(spark, rows), key="id", text="text")
    assert g.found().count() == 0


def test_round_trip(spark):
    """Clean documents, garbled in pairs of encodings that occur, come back: nine tenths at least of each."""
    rng = random.Random(7)
    clean = corpus(rng, 300)
    pairs = [("utf_8", "cp1252"), ("utf_8", "cp437"), ("utf_8", "cp1251"), ("cp1252", "mac_roman"), ("cp1251", "cp1252"), ("koi8_r", "cp1251"), ("euc_jp", "latin_1")]
    rows, want = list(clean), {}
    for n in range(140):
        written, read = pairs[n % 7]
        lines = [x for x in LINES[: None if written == "utf_8" else 11] if _fits(x, written)]
        text = "\n".join(rng.choice(lines) for _ in range(3))
        want[1000 + n] = (text, (written, read))
        rows.append((1000 + n, garble(text, written, read)))
    g = GarbledText(frame(spark, rows), key="id", text="text")
    got = {r["id"]: r["restored_text"] for r in g.restored().collect()}
    assert got.keys() <= want.keys()
    for pair in pairs:
        mine = [k for k, (_, p) in want.items() if p == pair]
        good = sum(got.get(k) == want[k][0] for k in mine)
        assert good >= 0.9 * len(mine), (pair, good, [(got.get(k), want[k][0]) for k in mine if got.get(k) != want[k][0]][:3])


def _fits(line, written):
    try:
        return len([c for c in line if c > "\x7f"]) > 3 and line.encode(written) is not None
    except UnicodeEncodeError:
        return False
