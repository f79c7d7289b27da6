"""Fixed label domains, dictionaries and the canonical book table.

Everything in this module is a fixed value: results are only right when these
words equal the ones used by the corpora and annotations that users bring.
"""

from __future__ import annotations

# Emotion domain, order defines the label id; English -> Spanish.
EMOTIONS_ES = {
    "joy": "Alegría",
    "sadness": "Tristeza",
    "anger": "Ira",
    "fear": "Miedo",
    "surprise": "Sorpresa",
    "disgust": "Asco",
    "neutral": "Neutral",
}
EMOTIONS = list(EMOTIONS_ES)

# Theme domain, English -> Spanish.
THEMES_ES = {
    "love": "amor",
    "faith": "fe",
    "hope": "esperanza",
    "forgiveness": "perdón",
    "fear": "miedo",
}
THEMES = list(THEMES_ES)

# Fine-grained emotion -> coarse emotion.
FINE_TO_COARSE = {
    "admiration": "joy", "amusement": "joy", "anger": "anger", "annoyance": "anger",
    "approval": "joy", "caring": "joy", "confusion": "surprise", "curiosity": "surprise",
    "desire": "joy", "disappointment": "sadness", "disapproval": "disgust", "disgust": "disgust",
    "embarrassment": "sadness", "excitement": "joy", "fear": "fear", "gratitude": "joy",
    "grief": "sadness", "joy": "joy", "love": "joy", "nervousness": "fear", "optimism": "joy",
    "pride": "joy", "realization": "surprise", "relief": "joy", "remorse": "sadness",
    "sadness": "sadness", "surprise": "surprise", "neutral": "neutral",
}

# Stray annotation label -> domain label.
LABEL_CORRECTIONS = {
    "hope": "joy", "trust": "neutral", "shame": "sadness", "confidence": "joy",
    "compassion": "joy", "courage": "joy", "peace": "neutral", "respect": "neutral",
    "guilt": "sadness", "gratitude": "joy", "confusion": "neutral", "anticipation": "joy",
}

# Canonical books in order, as (code, English slug, Spanish slug, Spanish name).
BOOKS = [
    ("Gen", "genesis", "genesis", "Génesis"),
    ("Exod", "exodus", "exodo", "Éxodo"),
    ("Lev", "leviticus", "levitico", "Levítico"),
    ("Num", "numbers", "numeros", "Números"),
    ("Deut", "deuteronomy", "deuteronomio", "Deuteronomio"),
    ("Josh", "joshua", "josue", "Josué"),
    ("Judg", "judges", "jueces", "Jueces"),
    ("Ruth", "ruth", "rut", "Rut"),
    ("1Sam", "1_samuel", "1-samuel", "1 Samuel"),
    ("2Sam", "2_samuel", "2-samuel", "2 Samuel"),
    ("1Kgs", "1_kings", "1-reyes", "1 Reyes"),
    ("2Kgs", "2_kings", "2-reyes", "2 Reyes"),
    ("1Chr", "1_chronicles", "1-cronicas", "1 Crónicas"),
    ("2Chr", "2_chronicles", "2-cronicas", "2 Crónicas"),
    ("Ezra", "ezra", "esdras", "Esdras"),
    ("Neh", "nehemiah", "nehemias", "Nehemías"),
    ("Esth", "esther", "ester", "Ester"),
    ("Job", "job", "job", "Job"),
    ("Ps", "psalms", "salmos", "Salmos"),
    ("Prov", "proverbs", "proverbios", "Proverbios"),
    ("Eccl", "ecclesiastes", "eclesiastes", "Eclesiastés"),
    ("Song", "song_of_solomon", "cantares", "Cantares"),
    ("Isa", "isaiah", "isaias", "Isaías"),
    ("Jer", "jeremiah", "jeremias", "Jeremías"),
    ("Lam", "lamentations", "lamentaciones", "Lamentaciones"),
    ("Ezek", "ezekiel", "ezequiel", "Ezequiel"),
    ("Dan", "daniel", "daniel", "Daniel"),
    ("Hos", "hosea", "oseas", "Oseas"),
    ("Joel", "joel", "joel", "Joel"),
    ("Amos", "amos", "amos", "Amós"),
    ("Obad", "obadiah", "abdias", "Abdías"),
    ("Jonah", "jonah", "jonas", "Jonás"),
    ("Mic", "micah", "miqueas", "Miqueas"),
    ("Nah", "nahum", "nahum", "Nahúm"),
    ("Hab", "habakkuk", "habacuc", "Habacuc"),
    ("Zeph", "zephaniah", "sofonias", "Sofonías"),
    ("Hag", "haggai", "hageo", "Hageo"),
    ("Zech", "zechariah", "zacarias", "Zacarías"),
    ("Mal", "malachi", "malaquias", "Malaquías"),
    ("Matt", "matthew", "mateo", "Mateo"),
    ("Mark", "mark", "marcos", "Marcos"),
    ("Luke", "luke", "lucas", "Lucas"),
    ("John", "john", "juan", "Juan"),
    ("Acts", "acts", "hechos", "Hechos"),
    ("Rom", "romans", "romanos", "Romanos"),
    ("1Cor", "1_corinthians", "1-corintios", "1 Corintios"),
    ("2Cor", "2_corinthians", "2-corintios", "2 Corintios"),
    ("Gal", "galatians", "galatas", "Gálatas"),
    ("Eph", "ephesians", "efesios", "Efesios"),
    ("Phil", "philippians", "filipenses", "Filipenses"),
    ("Col", "colossians", "colosenses", "Colosenses"),
    ("1Thess", "1_thessalonians", "1-tesalonicenses", "1 Tesalonicenses"),
    ("2Thess", "2_thessalonians", "2-tesalonicenses", "2 Tesalonicenses"),
    ("1Tim", "1_timothy", "1-timoteo", "1 Timoteo"),
    ("2Tim", "2_timothy", "2-timoteo", "2 Timoteo"),
    ("Titus", "titus", "tito", "Tito"),
    ("Phlm", "philemon", "filemon", "Filemón"),
    ("Heb", "hebrews", "hebreos", "Hebreos"),
    ("Jas", "james", "santiago", "Santiago"),
    ("1Pet", "1_peter", "1-pedro", "1 Pedro"),
    ("2Pet", "2_peter", "2-pedro", "2 Pedro"),
    ("1John", "1_john", "1-juan", "1 Juan"),
    ("2John", "2_john", "2-juan", "2 Juan"),
    ("3John", "3_john", "3-juan", "3 Juan"),
    ("Jude", "jude", "judas", "Judas"),
    ("Rev", "revelation", "apocalipsis", "Apocalipsis"),
]

# Sections as ranges of the canonical book number; the rest is OT.
GOSPELS = range(40, 44)
NT_REST = range(44, 67)
SECTIONS = ["gospels", "nt_rest", "ot"]

# Sentinels.
ERROR_LABEL = "error"
INVALID_ID = "INVALID_ID"

CODE_TO_BOOK = {code: en for code, en, _, _ in BOOKS}
BOOK_DISPLAY_ES = {es: shown for _, _, es, shown in BOOKS}
BOOK_ORDER = [en for _, en, _, _ in BOOKS]


def section_of(book_no: int) -> str:
    if book_no in GOSPELS:
        return "gospels"
    return "nt_rest" if book_no in NT_REST else "ot"


def sections(lang: str) -> dict[str, str]:
    """New-testament book slug (underscored) -> section, for one language."""
    slug = 1 if lang == "en" else 2
    return {
        book[slug].replace("-", "_"): section_of(no)
        for no, book in enumerate(BOOKS, start=1)
        if section_of(no) != "ot"
    }


def invert(mapping: dict[str, str]) -> dict[str, str]:
    """Inverse lookup: lower-cased value -> key."""
    return {value.lower(): key for key, value in mapping.items()}
