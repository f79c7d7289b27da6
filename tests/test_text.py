"""Value vectors of the text and label functions."""

import re

import pytest
from pyspark.sql import functions as F

from glossa.functions import labels, scores, text


def one(spark, expr, **values):
    """Value of an expression over one row; ``values`` maps columns to (type, value)."""
    if any(t.startswith("array") for t, _ in values.values()):
        schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items())
        row = spark.createDataFrame([tuple(v for _, v in values.values())], schema)
    else:
        row = spark.range(1).select(*[F.lit(v).cast(t).alias(k) for k, (t, v) in values.items()])
    return row.select(expr.alias("r")).first()["r"]


def s(value):
    return ("string", value)


# whitespace rules of the JVM and of Unicode-aware string methods differ most here
ODD = ["a b", " a   b\u0085c", "a\x1cb\x1d\x1e c\x1f", "x\x0b\x0cy", "\r\n a\r b \n\n c\t", "　z ",
       "no change", "é combining", "﻿bom stays", "᠎ kept", "  \n  "]


def cleaned(value):
    lines = [re.sub(r"\s+", " ", line.strip()) for line in value.splitlines()]
    return "\n".join(lines).strip()


@pytest.mark.parametrize("value", ODD)
def test_clean_text_matches_unicode_rules(spark, value):
    assert one(spark, text.clean_text(F.col("t")), t=s(value)) == cleaned(value)
    assert one(spark, text.strip(F.col("t")), t=s(value)) == value.strip()
    assert one(spark, text.flatten_text(F.col("t")), t=s(value)) == " ".join(value.split())


def test_clean_text_vectors(spark):
    poem = "   Jesús  dijo:    \t ¡Hola!  \n\n  En verdad   te digo.\t "
    assert one(spark, text.clean_text(F.col("t")), t=s(poem)) == "Jesús dijo: ¡Hola!\n\nEn verdad te digo."
    for empty in ("", "  \t\n ", None):
        assert one(spark, text.clean_text(F.col("t")), t=s(empty)) == ""
    assert one(spark, text.ascii_punctuation(F.col("t")), t=s("—“Hello”—said ‘Juan’—")) == "-\"Hello\"-said 'Juan'-"
    assert one(spark, text.ascii_punctuation(F.col("t")), t=s(None)) == ""


@pytest.mark.parametrize("book,chapter,verse,expected", [
    ("  song of solomon  ", "3", "4", "Song_Of_Solomon_3_4"), ("Genesis", "1", "1", "Genesis_1_1"),
    ("3-juan", "1", "1.9", "3-Juan_1_1"), ("John", "0", "3", "INVALID_ID"), ("John", "1", "-2", "INVALID_ID"),
    ("John", "abc", "2", "INVALID_ID"), (None, None, None, "INVALID_ID"), ("John", "inf", "2", "INVALID_ID"),
    ("ÉXODO", "2", "5", "Éxodo_2_5")])
def test_verse_key(spark, book, chapter, verse, expected):
    got = one(spark, text.verse_key(F.col("b"), F.col("c"), F.col("v")), b=s(book), c=s(chapter), v=s(verse))
    assert got == expected


@pytest.mark.parametrize("value", ["don't stop", "3-juan", "song_of solomon", "ÁRBOL éxodo", "1 samuel x2y", ""])
def test_title(spark, value):
    assert one(spark, text.title(F.col("t")), t=s(value)) == value.title()
    assert one(spark, text.capitalize(F.col("t")), t=s(value)) == value.capitalize()


@pytest.mark.parametrize("value,expected", [
    (" Jesús ", "jesus"), ("Éxodo", "exodo"), ("FAITH", "faith"), ("SeÑor", "senor"), ("éx", "ex"),
    ("Straße Ærø Œuvre", "strasse aero oeuvre"), ("Łódź ǅ ṩ", "lodz ǆ s")])
def test_normalize(spark, value, expected):
    assert one(spark, text.normalize(F.col("t")), t=s(value)) == expected


def test_clean_verse_keeps_inner_double_blank(spark):
    assert one(spark, text.clean_verse(F.col("t")), t=s(" In \n the [1] end [23]")) == "In the  end"


@pytest.mark.parametrize("value,expected", [
    ("  Love ;  Faith  ", "amor;fe"), ("love;peace", "amor;peace"), (None, ""), ("Other ; Hope", "Other;esperanza")])
def test_translate_themes(spark, value, expected):
    assert one(spark, labels.translate_themes(F.col("t")), t=s(value)) == expected


@pytest.mark.parametrize("value,expected", [("   sadness ", "Tristeza"), ("ecstasy", "ecstasy"), (None, ""), ("JOY", "Alegría")])
def test_translate_emotion(spark, value, expected):
    assert one(spark, labels.translate_emotion(F.col("t")), t=s(value)) == expected


def test_file_names(spark):
    for name, number, slug in [("64_3-juan_emotion_theme.csv", 64, "3-juan"), ("1_genesis_cleaned.csv", 1, "genesis"),
                               ("22_song_of_solomon_emotion.csv", 22, "song_of_solomon"), ("notes.csv", None, None)]:
        assert one(spark, text.file_prefix(F.col("n")), n=s(name)) == number
        assert one(spark, text.file_slug(F.col("n")), n=s(name)) == slug


def test_numbers_and_ids(spark):
    for value, expected in [("12", 12), (" 7 ", 7), ("A", None), ("1.5", None), ("", None), ("+3", 3)]:
        assert one(spark, text.verse_number(F.col("n")), n=s(value)) == expected
    assert one(spark, text.id_parts(F.col("n")), n=s("Gen.1.1")) == ["Gen", "1", "1"]
    assert one(spark, text.id_parts(F.col("n")), n=s("Gen.1")) is None
    assert one(spark, labels.book_of_code(F.col("n")), n=s("Song")) == "song_of_solomon"
    assert one(spark, labels.book_of_code(F.col("n")), n=s("FakeBook")) is None


def test_display(spark):
    for book, lang, shown in [("3_juan", "es", "3 Juan"), ("3-juan", "es", "3 Juan"), ("song_of_solomon", "en", "Song Of Solomon"),
                              ("libro-nuevo", "es", "Libro-Nuevo")]:
        assert one(spark, labels.display_book(F.col("b"), F.col("l")), b=s(book), l=s(lang)) == shown
    for score, lang, shown in [(0.98765, "en", "98.77"), (12.345678, "es", "1.234,57"), (12.345678, "en", "1234.57")]:
        assert one(spark, labels.percent_text(F.col("x"), F.col("l")), x=("double", score), l=s(lang)) == shown
    assert one(spark, labels.display_theme(F.col("b"), F.col("l")), b=s(" Perdón "), l=s("en")) == "Forgiveness"
    assert one(spark, labels.display_theme(F.col("b"), F.col("l")), b=s("faith"), l=s("es")) == "Fe"
    assert one(spark, labels.display_emotion(F.col("b"), F.col("l")), b=s("wonder"), l=s("es")) == "Wonder"
    made = one(spark, labels.citation(F.col("b"), F.col("c"), F.col("v"), F.col("t")),
               b=s("john"), c=("int", 3), v=("int", 16), t=s(" For God "))
    assert made == "John 3:16 - For God"


def test_theme_set(spark):
    from glossa.domains import THEMES_ES
    assert one(spark, labels.theme_set(F.col("t"), THEMES_ES), t=s("Amor; fe ;amor;x")) == ["love", "faith", "x"]
    assert one(spark, labels.theme_set(F.col("t")), t=s(None)) == []


PREDS = "array<struct<label:string,score:double>>"


def preds(*pairs):
    return (PREDS, list(pairs))


def test_top_and_threshold(spark):
    top = scores.top_label(F.col("p"))
    assert one(spark, top, p=preds(("joy", .9), ("sadness", .1))) == "joy"
    assert one(spark, top, p=preds(("a", .5), ("b", .5))) == "a"
    assert one(spark, top, p=preds()) is None
    above = labels.join_labels(scores.labels_above(F.col("p"), 0.7))
    assert one(spark, above, p=preds(("love", .8), ("faith", .75), ("hope", .1), ("forgiveness", .2), ("fear", .9))) == "love;faith;fear"
    assert one(spark, above, p=preds(("love", .7), ("faith", .69), ("hope", .7))) == "love;hope"


def test_neutral_override(spark):
    from glossa.domains import FINE_TO_COARSE
    def run(has_neutral, *pairs):
        got = one(spark, scores.override_neutral(F.col("p"), FINE_TO_COARSE, 0.35, has_neutral), p=preds(*pairs))
        return tuple(got)
    assert run(True, ("neutral", .3), ("grief", .2), ("love", .25)) == ("love", "joy", .25)
    assert run(True, ("neutral", .35), ("love", .25)) == ("neutral", "neutral", .35)
    assert run(False, ("neutral", .3), ("love", .25)) == ("neutral", "neutral", .3)
    assert run(True, ("neutral", .3), ("odd", .25)) == ("neutral", "neutral", .3)
    assert run(True, ("odd", .3), ("love", .25)) == ("love", "joy", .25)


def test_softmax(spark):
    got = one(spark, scores.softmax(F.col("x")), x=("array<double>", [1000.0, 1000.0]))
    assert got == [0.5, 0.5]


def test_random_texts_follow_the_same_rules(spark):
    """Many random texts at once against string methods."""
    import random
    import unicodedata
    rng = random.Random(7)
    spaces = list(text.WHITESPACE) * 2
    letters = list("abcXYZéÑüçÅøœ'’-_0129.;[]«») ") + ["e\u0301", "\u200b", "\ufeff", "漢"]
    values = ["".join(rng.choice(spaces if rng.random() < .35 else letters) for _ in range(rng.randint(0, 30)))
              for _ in range(3000)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    c = F.col("t")
    rows = df.select("i", text.clean_text(c).alias("clean"), text.flatten_text(c).alias("flat"), text.strip(c).alias("strip"),
                     text.title(c).alias("title"), text.clean_verse(c).alias("verse"), text.normalize(c).alias("norm")).collect()

    def plain(v):
        parts = (unicodedata.normalize("NFD", x) if x.isalpha() else x for x in v.strip().lower())
        marks = "".join(x for x in "".join(parts) if not unicodedata.combining(x))
        return marks.replace("ø", "o").replace("œ", "oe").replace("’", "'")

    for r in rows:
        v = values[r["i"]]
        assert (r["clean"], r["flat"], r["strip"], r["title"]) == (cleaned(v), " ".join(v.split()), v.strip(), v.title())
        assert r["verse"] == re.sub(r"\[\d+\]", "", re.sub(r"\s+", " ", v)).strip()
        assert r["norm"] == plain(v)


@pytest.mark.parametrize("value,number", [("1e2", 100.0), ("1d", None), ("2F", None), ("7.", 7.0), ("", None), ("1_0", None),
                                          ("-3.5 ", -3.5), ("0x1", None), ("abc", None)])
def test_to_number(spark, value, number):
    assert one(spark, text.to_number(F.col("t")), t=s(value)) == number


@pytest.mark.parametrize("value, expected", [
    ("Ἀγάπη", "agape"), (" ΘΕΟΣ ", "theos"), ("ψυχή", "psukhe"), ("Χριστός", "khristos"), ("φῶς ϑ", "phos th"),
    ("Любовь", "liubov'"), ("Вера, Надежда", "vera, nadezhda"), ("щи Ёж й", "shchi iozh i"), ("їжак", "izhak"), ("ѓ Ћ љ", "g ћ lj"),
    ("사랑", "sarang"), ("한국 말", "hangug mal"), ("각", "gag"), ("ＦＵＬＬ ｗｉｄｔｈ", "full width"), ("𝐁𝐨𝐥𝐝", "bold"), ("ª º ²", "a o 2"),
    ("Ǻngström ḗ", "angstrom e"), ("שָׁלוֹם", "שלום"), ("愛 日本 が", "愛 日本 が"), ("Straße Œuvre þorn", "strasse oeuvre thorn"), ("e\u0301", "e")])
def test_normalize_scripts(spark, value, expected):
    assert one(spark, text.normalize(F.col("t")), t=s(value)) == expected


def test_every_korean_syllable_is_spelled(spark):
    rows = spark.range(0xAC00, 0xD7A4).select(F.decode(F.unhex(F.hex("id")), "UTF-16BE").alias("c"))
    got = rows.select("c", text.normalize(F.col("c")).alias("n")).collect()
    assert len(got) == 11172 and all(r["n"].isascii() and r["n"] for r in got)
    for r in got[::97]:
        n = ord(r["c"]) - 0xAC00
        assert r["n"] == text._FIRST[n // 588] + text._MIDDLE[n % 588 // 28] + text._LAST[n % 28]
