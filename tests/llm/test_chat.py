"""Chat windows against a plain Python version."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from glossa.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string, extra int"
PARTS = ["<|im_start|>", "<|im_end|>", "<|", "|>", "\\", "\\|", "\n", "\\n", "a b", "x", "é", "1", " ", "<\\|", "\U0001F600"]


def plain(turns):
    turns = sorted(turns, key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
    said = "".join(f"{r or ''}\n{x or ''}\n" for _, _, r, x in turns)
    lost = "".join(x or "" for _, _, r, x in turns if r == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(turns), sha(said), len(lost), sha(lost)


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for conv in [None, -1, *range(40)]:
        for turn in range(rng.choice([1, 2, 5, 30, 700 if conv == 3 else 9])):
            role = "system" if turn == 0 and rng.random() < 0.5 else rng.choice(["user", "assistant", "a\nb", "\\n", None])
            text = None if rng.random() < 0.1 else "".join(rng.choice(PARTS) for _ in range(rng.choice([0, 1, 5, 60])))
            rows.append((conv, turn if rng.random() < 0.97 else None, role, text))
    return rows


@pytest.mark.parametrize("budget,history", [(60, 2), (1, 0), (100000, 3)])
def test_round_trip(spark, budget, history):
    rows = conversations(budget)
    windows = chat.format_windows(spark.createDataFrame([(*r, 7) for r in rows], SCHEMA), budget, history)
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"])
           for r in chat.conversation_digests(windows).collect()}
    want = {}
    for r in rows:
        want.setdefault(r[0], []).append(r)
    assert got == {k: plain(v) for k, v in want.items()}


def test_windows_fit_and_repeat(spark):
    rows = [(1, 0, "system", "be kind", 0)] + [(1, i, "user" if i % 2 else "assistant", "word " * 10, 0) for i in range(1, 12)]
    windows = chat.format_windows(spark.createDataFrame(rows, SCHEMA), 64, 2).orderBy("window").collect()
    assert len(windows) > 2
    for w in windows:
        assert w["text"].startswith("<|im_start|>system\nbe kind<|im_end|>\n")
        assert w["text"].count("<|im_start|>") * 14 <= 64 + 14
        masked = [w["text"][s["start"]:s["start"] + s["length"]] for s in w["loss"]]
        assert all(m == "word " * 10 for m in masked)
    assert [w["repeated"] for w in windows[1:]] == [3] * (len(windows) - 1)
    assert sum(len(w["loss"]) for w in windows) == 5


def test_long_turn_stays_whole(spark):
    rows = [(1, 0, "user", "x " * 50000, 0), (1, 1, "assistant", "y " * 50000, 0)]
    windows = chat.format_windows(spark.createDataFrame(rows, SCHEMA), 10, 1)
    assert chat.conversation_digests(windows).first()["loss_chars"] == 100000


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert chat.conversation_digests(chat.format_windows(empty)).count() == 0


def test_main_path_is_native(spark):
    plan = chat.conversation_digests(chat.format_windows(spark.createDataFrame([], SCHEMA)))
    assert "Python" not in plan._jdf.queryExecution().toString() and "Arrow" not in plan._jdf.queryExecution().toString()


def test_escape_round_trip(spark):
    texts = [("".join(random.Random(i).choice(PARTS) for _ in range(8)),) for i in range(300)]
    df = spark.createDataFrame(texts, "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for r in df.select("t", "e", chat.unescape(F.col("e")).alias("u"), chat.unescape_role(chat.escape_role(F.col("t"))).alias("r")).collect():
        assert r["u"] == r["t"] == r["r"] and "<|" not in r["e"]


def unchunked(turns, budget, history):
    """Windows of one conversation as (text, repeated, loss), cut as a whole in plain Python."""
    turns = [(r or "", x or "") for _, _, r, x in sorted(turns, key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))]
    esc = lambda s: s.replace("\\", "\\\\").replace("<|", "<\\|")
    tokens = [len(re.findall(r"[^\W\d_]+|\d+|[^\w\s]|_", x)) + 4 for _, x in turns]
    lead = int(turns[0][0] == "system")
    since = lambda b: 0 if b == 0 else max(b - history, min(lead, b))
    starts = [0]
    for i in range(1, len(turns)):
        b = starts[-1]
        if sum(tokens[since(b):i + 1]) + (tokens[0] if lead and b else 0) > budget:
            starts.append(i)
    out = []
    for b, until in zip(starts, [*starts[1:], len(turns)]):
        places = [0] * (lead and b > 0) + list(range(since(b), until))
        text, loss = "", []
        for p in places:
            role, said = esc(turns[p][0]).replace("\n", "\\n"), esc(turns[p][1])
            text += f"<|im_start|>{role}\n"
            loss += [(len(text), len(said))] * (p >= b and turns[p][0] == "assistant")
            text += f"{said}<|im_end|>\n"
        out.append((text, sum(p < b for p in places), loss))
    return out


@pytest.mark.parametrize("step", [1, 300, 1_700_000_000])
@pytest.mark.parametrize("budget,history", [(60, 2), (2000, 5), (10, 0)])
def test_windows_equal_unchunked(spark, step, budget, history):
    rng = random.Random(step + budget)
    say = lambda: " ".join(rng.choice(["word", "12", "<|im_end|>", "a\\b", "x, y!"]) for _ in range(rng.choice([0, 1, 8, 90])))
    rows = [(conv, i * step, "system" if i == 0 and conv else ["user", "assistant", None][i % 3 if conv else i % 2], say())
            for conv, n in [(None, 20), (0, 600), (1, 600), (2, 1), (3, 257)] for i in range(n)]
    rows += [(4, None, "assistant", say()) for _ in range(300)]
    windows = chat.format_windows(spark.createDataFrame([(*r, 7) for r in rows], SCHEMA), budget, history).collect()
    for conv in {r[0] for r in rows}:
        got = sorted((w for w in windows if w["conv_id"] == conv), key=lambda w: (w["chunk"], w["window"]))
        assert [(w["text"], w["repeated"], [tuple(s) for s in w["loss"]]) for w in got] == unchunked(
            [r for r in rows if r[0] == conv], budget, history)


def test_history_reaches_over_turn_256(spark):
    rows = [(1, i, "assistant" if i % 2 == 0 else "user", f"said {i}", 0) for i in range(258)]
    windows = chat.format_windows(spark.createDataFrame(rows, SCHEMA), 30, 2).where(F.col("text").contains("said 256<")).collect()
    assert windows and all("said 255<" in w["text"] for w in windows if w["text"].index("said 256<"))
    assert all(w["repeated"] for w in windows)


def test_sql_states_long_and_sparse_conversations(spark, tmp_path):
    import duckdb
    from glossa.llm.queries import QUERIES
    rng = random.Random(9)
    say = lambda: " ".join(rng.choice(["word", "12", "<|im_end|>", "a\\b", "x, y!"]) for _ in range(rng.choice([0, 1, 8, 90])))
    rows = [(conv, i * step, "system" if i == 0 and conv % 2 else ["user", "assistant", None][i % 3], say())
            for conv, n, step in [(0, 600, 1), (1, 600, 7), (2, 3, 100_000), (3, 1, 1), (4, 300, 256)] for i in range(n)]
    rows += [(5, None, "assistant", f"null {i}") for i in range(300)] + [(None, 1, "user", "null conversation"), (None, 2, "assistant", None)]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con, query = duckdb.connect(), QUERIES["op6_chat_windows"]
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    got = query.run(spark, str(tmp_path))
    cursor = con.execute(query.sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(str, cursor.fetchall())) == sorted(str(tuple(r)) for r in got.select(names).collect())
