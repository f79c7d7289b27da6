"""Chat formatting in budgeted windows. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.plans.guard import once
from glossa.plans.ranking import sequential_id

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
CHUNK_TURNS = 256  # turns whose windows have one chunk number


def escape(text: Column) -> Column:
    r"""Backslashes doubled and ``<|`` written ``<\|``: no control string is left, and ``unescape`` undoes it."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def escape_role(role: Column) -> Column:
    """A role ends at the line break, so its own line breaks are written ``\\n`` as well."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    marked = F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n")
    return unescape(marked)


def turn_tokens(text: Column) -> Column:
    """Size of a turn: its runs of letters, of digits, and other signs, plus four for its marks."""
    return F.regexp_count(text, F.lit(r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]")) + 4


def format_windows(turns: DataFrame, budget: int = 512, history: int = 2) -> DataFrame:
    """Cut conversations into formatted training windows.

    ``turns`` has conv_id, turn, role and text. Null text and role count as
    empty; turns are ordered by (turn, role, text), null turns first, and equal
    rows are all kept; a null conv_id is a conversation of its own. A turn is
    formatted as ``<|im_start|>role\\ntext<|im_end|>\\n`` with escaped role and text.

    Running sums of turn tokens choose the spans: a window takes the next turns as
    long as they, the system turn (the conversation's first turn, if its role is
    ``system``) and the up to ``history`` turns before them fit ``budget``; a
    single turn that is larger alone is a window of its own and stays whole. Each
    later window repeats the system turn and that history. Returned per window:
    conv_id, chunk, window, text, repeated (number of leading turns that were in an
    earlier window) and loss, an array of (start, length) spans of ``text`` that
    hold the texts of assistant turns that are new in it.

    Turns are taken by their place in the conversation, whatever their numbers
    are. Of a conversation only the turn sizes are gathered in one row, a number
    each; texts meet window by window. ``window`` counts through the conversation
    and ``chunk`` is the place of the window's first new turn, divided by 256.
    """
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"),
                    F.coalesce("text", F.lit("")).alias("text"))
    placed = sequential_id(turns.select("conv_id", turn.alias("t")), ["t"], ["conv_id"], "at", start=0)
    size = F.struct(F.col("at"), turn_tokens(F.col("t.text")).cast("long").alias("tokens"))
    sizes = placed.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(size)).alias("sizes"),
        F.max((F.col("at") == 0) & (F.col("t.role") == "system")).cast("int").alias("lead")).select(
        "conv_id", "lead", once(F.col("sizes.tokens")).alias("tokens"))
    room = F.lit(budget).cast("long") - F.when(F.col("lead") == 1, F.element_at("tokens", 1)).otherwise(0)

    def before(i: Column) -> Column:
        """First turn that a window from turn ``i`` on repeats (0-based; the system turn is repeated anyhow)."""
        return F.when(i == 0, 0).otherwise(F.greatest(i - history, F.least("lead", i)))

    def added(acc: Column, i: Column) -> Column:
        """Starts of windows so far and tokens of the open one, after turn ``i``, which opens one if it does not fit."""
        own = F.when(F.element_at(acc["starts"], -1) == 0, F.lit(budget).cast("long")).otherwise(room)
        own = F.when(F.col("lead") == 1, own).otherwise(F.lit(budget).cast("long"))
        grown = acc["held"] + F.element_at("tokens", i + 1)
        repeated = F.slice("tokens", before(i) + 1, i - before(i) + 1)
        return F.when((i == 0) | (grown <= own), F.struct(acc["starts"].alias("starts"), grown.alias("held"))).otherwise(F.struct(
            F.concat(acc["starts"], F.array(i)).alias("starts"),
            F.aggregate(repeated, F.lit(0).cast("long"), lambda a, x: a + x).alias("held")))

    none = F.struct(F.array(F.lit(0)).alias("starts"), F.lit(0).cast("long").alias("held"))
    starts = F.aggregate(F.sequence(F.lit(0), F.size("tokens") - 1), none, added, lambda acc: acc["starts"])
    cut = sizes.select("conv_id", "lead", F.size("tokens").alias("n"), once(starts).alias("starts"))
    spans = F.transform("starts", lambda b, w: F.struct(
        w.alias("window"), b.alias("begin"), before(b).alias("since"), F.coalesce(F.get("starts", w + 1), F.col("n")).alias("until")))
    windows = cut.select("conv_id", "lead", F.explode(once(spans)).alias("w")).select("conv_id", "lead", "w.*")
    again = (F.col("lead") == 1) & (F.col("begin") > 0)
    places = F.concat(F.when(again, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")),
                      F.sequence(F.col("since"), F.col("until") - 1))
    asked = windows.select(F.col("conv_id").alias("_conv"), "window", "begin", F.explode(places).alias("_at"))

    formed = placed.select("conv_id", "at", F.struct(
        F.concat(F.lit(OPEN), escape_role(F.col("t.role")), F.lit("\n")).alias("head"), escape(F.col("t.text")).alias("body"),
        (F.col("t.role") == "assistant").alias("target")).alias("f"))
    met = formed.join(asked, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("at") == F.col("_at")))
    part = F.struct("at", "f.head", "f.body", (F.col("f.target") & (F.col("at") >= F.col("begin"))).alias("target"))
    shaped = met.groupBy("conv_id", "window", "begin").agg(
        F.array_sort(F.collect_list(part)).alias("p"), F.sum((F.col("at") < F.col("begin")).cast("int")).cast("int").alias("repeated"))
    text = F.array_join(F.transform("p", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE + "\n"))), "")
    tail = len(CLOSE) + 1
    loss = F.aggregate(
        F.transform("p", lambda t: F.struct(F.length(t["head"]).alias("head"), F.length(t["body"]).alias("body"), t["target"].alias("target"))),
        F.struct(F.lit(0).alias("at"), F.lit([]).cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + t["head"] + t["body"] + tail).alias("at"),
            F.when(t["target"], F.concat(acc["spans"], F.array(F.struct(
                (acc["at"] + t["head"]).alias("start"), t["body"].alias("length"))))).otherwise(acc["spans"]).alias("spans")),
        lambda acc: acc["spans"])
    return shaped.select("conv_id", F.floor(F.col("begin") / CHUNK_TURNS).alias("chunk"), "window", once(text).alias("text"),
                         "repeated", once(loss).alias("loss"))


def read_turns(window_text: Column) -> Column:
    """Turns of a formatted window as an array of (role, text)."""
    blocks = F.slice(F.split(window_text, r"<\|im_start\|>"), 2, 1 << 30)
    return F.transform(blocks, lambda b: F.struct(
        unescape_role(F.substring_index(b, "\n", 1)).alias("role"),
        unescape(F.substring(b, F.instr(b, "\n") + 1, F.length(b) - F.instr(b, "\n") - len(CLOSE) - 1)).alias("text")))


def conversation_digests(windows: DataFrame) -> DataFrame:
    """Turns and loss texts of each conversation, read back from its windows, as counts and digests."""
    new = F.slice(read_turns(F.col("text")), F.col("repeated") + 1, 1 << 30)
    lost = F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("text"), s["start"] + 1, s["length"]))), "")
    read = windows.select("conv_id", "chunk", "window", F.length("text").cast("long").alias("chars"),
                          once(new).alias("new"), once(lost).alias("lost")).select(
        "conv_id", "chunk", "window", "chars", F.size("new").cast("long").alias("turns"),
        once(F.array_join(F.transform("new", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")).alias("said"),
        "lost")
    ordered = F.array_sort(F.collect_list(F.struct("chunk", "window", "said", "lost")))
    whole = read.groupBy("conv_id").agg(F.sum("turns").alias("n_turns"), F.sum("chars").alias("formatted_chars"),
                                        ordered.alias("w"))
    return whole.select(
        "conv_id", "n_turns", F.sha2(F.encode(F.array_join("w.said", ""), "UTF-8"), 256).alias("turns_sha256"),
        F.aggregate("w.lost", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("loss_chars"),
        F.sha2(F.encode(F.array_join("w.lost", ""), "UTF-8"), 256).alias("loss_sha256"), "formatted_chars")
