"""Text clean-up as native column expressions (no Python per row).

Whitespace means what a Unicode-aware string library calls whitespace, which is
more than the JVM's ``\\s`` and Spark's default ``trim`` cover.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossa.domains import INVALID_ID

# Every code point that counts as whitespace.
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())

_LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_BLANKS = r"[\t \x1f\p{Zs}]+"
_ANY_SPACE = r"[\s\x1c-\x1f\x{85}\p{Z}]+"


def strip(c: Column) -> Column:
    """Remove leading and trailing Unicode whitespace."""
    return F.btrim(c, F.lit(WHITESPACE))


def collapse(c: Column) -> Column:
    """Every run of whitespace becomes one blank."""
    return F.regexp_replace(c, _ANY_SPACE, " ")


def clean_text(c: Column) -> Column:
    """strip and collapse each line, keep line breaks, null -> ''."""
    lines = F.regexp_replace(c, _LINE_BREAK, "\n")
    blanks = F.regexp_replace(lines, _BLANKS, " ")
    return F.coalesce(F.btrim(F.regexp_replace(blanks, r" ?\n ?", "\n"), F.lit(" \n")), F.lit(""))


def ascii_punctuation(c: Column) -> Column:
    """curly quotes and dashes to ASCII, null -> ''."""
    return F.coalesce(F.translate(c, "“”‘’–—", "\"\"''--"), F.lit(""))


def flatten_text(c: Column) -> Column:
    """all whitespace to single blanks, null -> ''."""
    return F.coalesce(F.btrim(collapse(c)), F.lit(""))


def title(c: Column) -> Column:
    """Upper-case the first cased letter of every run of letters, lower the rest."""
    runs = F.regexp_extract_all(c, F.lit(r"([\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def capitalize(c: Column) -> Column:
    """First letter upper case, rest lower case."""
    return F.concat(F.upper(F.substr(c, F.lit(1), F.lit(1))), F.lower(F.substr(c, F.lit(2))))


def to_number(c: Column) -> Column:
    """numeric coercion, anything unreadable -> null."""
    text = strip(c.cast("string"))
    # the JVM would read type suffixes such as 1d or 2f as numbers
    return F.when(~text.rlike("(?i)[0-9.][df]$"), text).try_cast("double")


def whole_number(c: Column) -> Column:
    """Truncated number; null when unreadable, infinite or not a number."""
    number = to_number(c)
    usable = ~F.isnan(number) & (F.abs(number) < 9.0e18)
    return F.when(usable, number).try_cast("bigint")


def verse_key(book: Column, chapter: Column, verse: Column) -> Column:
    """``Book_chapter_verse`` with a title-cased book, else INVALID_ID."""
    slug = title(F.replace(strip(book), F.lit(" "), F.lit("_")))
    ch, vs = whole_number(chapter), whole_number(verse)
    ok = (slug != "") & (ch > 0) & (vs > 0)
    return F.when(ok, F.concat_ws("_", slug, ch, vs)).otherwise(F.lit(INVALID_ID))


def _plain_letters() -> tuple[str, str]:
    """Letters with marks or in special forms -> the plain letter, by Unicode's decompositions; lone marks last (deleted).

    Covers every script; syllables and ideographs, which are no letter with a mark, are left out.
    """
    special, plain, marks = [], [], []
    for code in [*range(0xA0, 0x3400), *range(0xA640, 0xAC00), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800)]:
        if 0x3040 <= code < 0x3100:  # a mark in kana makes another syllable
            continue
        if unicodedata.combining(chr(code)):
            marks.append(chr(code))
            continue
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)).lower() if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(code) and not base.isspace():
            special.append(chr(code))
            plain.append(base)
    return "".join(special + marks), "".join(plain)


_ACCENTED, _PLAIN = _plain_letters()
# Letters without a decomposition, and typographic quotes and dashes.
_SINGLES = ("øđðłıħ’‘“”–—", "oddlih''\"\"--")
_LIGATURES = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th"}
# Latin letters for Greek and Cyrillic ones.
_GREEK = ("αβγδεζηικλμνξοπρςστυω", "abgdezeiklmnxoprsstuo")
_CYRILLIC = ("абвгдезийклмнопрстуфыэіј", "abvgdeziiklmnoprstufyeij")
_PAIRS = {"θ": "th", "φ": "ph", "χ": "kh", "ψ": "ps", "ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": '"',
          "ь": "'", "ю": "iu", "я": "ia", "ђ": "dj", "є": "ie", "љ": "lj", "њ": "nj", "џ": "dzh", **_LIGATURES}
# Latin spellings of the first, middle and last sound of a Korean syllable, in Unicode's order.
_FIRST = "g gg n d dd r m b bb s ss  j jj c k t p h".split(" ")
_MIDDLE = "a ae ya yae eo e yeo ye o wa wae oe yo u weo we wi yu eu yi i".split(" ")
_LAST = " g gg gs n nj nh d l lg lm lb ls lt lp lh m b bs s ss ng j c k t p h".split(" ")


def _syllables(c: Column) -> Column:
    """Korean syllables spelled out: each is numbered by its sounds."""
    def sound(names: list[str], place: Column) -> Column:
        return F.element_at(F.array(*[F.lit(n) for n in names]), place.cast("int") + 1)

    def spelled(x: Column) -> Column:
        n = F.conv(F.hex(F.encode(x, "UTF-16BE")), 16, 10).cast("bigint") - 0xAC00
        return F.when(x.between("\uac00", "\ud7a3"), F.concat(
            sound(_FIRST, F.floor(n / 588)), sound(_MIDDLE, F.floor(F.pmod(n, F.lit(588)) / 28)),
            sound(_LAST, F.pmod(n, F.lit(28))))).otherwise(x)

    return F.array_join(F.transform(F.split(c, ""), spelled), "")


def normalize(c: Column) -> Column:
    """comparison form: stripped, lower case, accents removed, letters of other scripts in Latin ones.

    Marks and special forms go by Unicode's decompositions, in any script; Greek, Cyrillic and Korean are written in
    Latin letters. Characters of other scripts stay as they are. Texts of Latin letters pass one search for the others.
    """
    old = _SINGLES[0] + _GREEK[0] + _CYRILLIC[0]
    lowered = F.replace(F.lower(strip(c)), F.lit("ё"), F.lit("ио"))  # not the letter е with a mark
    out = F.translate(lowered, old + _ACCENTED, _SINGLES[1] + _GREEK[1] + _CYRILLIC[1] + _roman(_PLAIN))
    wide = out
    for letter, pair in _PAIRS.items():
        wide = F.replace(wide, F.lit(letter), F.lit(pair))
    out = F.when(out.rlike("[" + "".join(_PAIRS) + "]"), wide).otherwise(out)
    return F.when(out.rlike("[\uac00-\ud7a3]"), _syllables(out)).otherwise(out)


def _roman(letters: str) -> str:
    """Greek and Cyrillic letters that come out of a decomposition, in Latin ones."""
    return letters.translate(str.maketrans(_GREEK[0] + _CYRILLIC[0], _GREEK[1] + _CYRILLIC[1]))


def clean_verse(c: Column) -> Column:
    """collapse whitespace, drop ``[n]`` marks, strip (inner blanks may stay doubled)."""
    return strip(F.regexp_replace(collapse(c), r"\[\p{Nd}+\]", ""))


def canonical_label(c: Column) -> Column:
    """stripped lower-case label."""
    return F.lower(strip(c))


def text_length(c: Column) -> Column:
    """length in characters."""
    return F.length(c)


def stringify_missing(c: Column) -> Column:
    """compatibility form in which a missing text is scored as the word ``nan``."""
    return F.coalesce(c, F.lit("nan"))


def iso_seconds(c: Column) -> Column:
    """ISO-8601 text at second resolution."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")


# Fixed pattern: ``<number>_<slug>[_cleaned|_emotion[_theme]].csv``.
_FILE_NAME = r"^(\d+)_(.+?)(_cleaned|_emotion(?:_theme)?)?\.csv$"


def file_prefix(name: Column) -> Column:
    """numeric prefix of a file name; null for malformed names."""
    return F.regexp_extract(name, _FILE_NAME, 1).try_cast("int")


def file_slug(name: Column) -> Column:
    """book slug of a file name; null for malformed names."""
    return F.nullif(F.regexp_extract(name, _FILE_NAME, 2), F.lit(""))


def id_parts(c: Column) -> Column:
    """dotted id as [book, chapter, verse]; null unless it has exactly three parts."""
    parts = F.split(c, r"\.", -1)
    return F.when(F.size(parts) == 3, parts)


def verse_number(c: Column) -> Column:
    """integer text -> int, anything else null."""
    text = strip(c)
    return F.when(text.rlike(r"^[+-]?\d+$"), text).try_cast("int")
