"""Transducers against sorted lists, and the source audit against whole-number arithmetic in plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from glossa.llm import divergence
from glossa.llm.transducer import Builder, Transducer, Vocabulary

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n int, term string, place int"


def spans(terms):
    data = np.frombuffer(b"".join(terms), dtype=np.uint8)
    ends = np.cumsum([len(t) for t in terms])
    return data, ends - [len(t) for t in terms], ends


def test_transducer_gives_sorted_places():
    rng = random.Random(1)
    terms = sorted({"".join(rng.choice("abéz") for _ in range(rng.randint(1, 7))).encode() for _ in range(2000)} | {b"a" * 3000})
    builder = Builder()
    for t in terms:
        builder.add(t)
    made = Transducer(builder.done())
    others = [t + b"b" for t in terms] + [b"q", b"a" * 2999, terms[5][:-1] or b"z", b"\xff"]
    asked = terms + others
    place = {t: i for i, t in enumerate(terms)}
    assert made.ordinals(*spans(asked)).tolist() == [place.get(t, -1) for t in asked]
    assert [made.term(i) for i in range(len(terms))] == terms


def test_transducer_is_minimal():
    terms = sorted(f"{a}{b}ing".encode() for a in "abcdef" for b in "uvwxyz")
    builder = Builder()
    for t in terms:
        builder.add(t)
    made = Transducer(builder.done())
    futures = {}
    for t in terms:
        for i in range(len(t) + 1):
            futures.setdefault(t[:i], set()).add(t[i:])
    assert len(made.final) == len({frozenset(f) for f in futures.values()})
    with pytest.raises(ValueError):
        Builder().add(b"b") or builder.add(b"a")


def test_many_shards(tmp_path):
    from glossa.llm.transducer import write_file
    rng = random.Random(2)
    terms = sorted({("prefixprefix" * (i % 2) + "".join(rng.choice("ab") for _ in range(rng.randint(1, 9)))).encode() for i in range(600)})
    shards = []
    for i in range(0, len(terms), 7):
        builder = Builder()
        for t in terms[i:i + 7]:
            builder.add(t)
        path = f"file://{tmp_path}/{i}.npz"
        write_file(path, builder.done())
        shards.append(("x", terms[i], i, path))
    words = Vocabulary(shards)
    asked = terms + [t + b"a" for t in terms] + [b"0", b"zz"]
    place = {t: i for i, t in enumerate(terms)}
    assert words.ordinals("x", *spans(asked)).tolist() == [place.get(t, -1) for t in asked]
    assert words.ordinals("y", *spans(asked)).tolist() == [-1] * len(asked)
    assert [words.term("x", i) for i in range(len(terms))] == terms


def plain(rows, min_docs, top):
    rows = [(x or "", s or "", [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in TERM.findall(t or "")]) for t, x, s in rows]
    out = []
    for lang in {r[0] for r in rows}:
        docs = Counter(w for x, _, ws in rows if x == lang for w in set(ws))
        kept = sorted((w for w, n in docs.items() if n >= min_docs), key=str.encode)
        counts = {s: Counter() for x, s, _ in rows if x == lang}
        for x, s, ws in rows:
            if x == lang:
                counts[s].update(w for w in ws if docs[w] >= min_docs)
        total = sum(counts.values(), Counter())

        def shares(c):
            n = sum(c.values())
            return {w: 1 + 1_000_000_000 * (c[w] + 2) // (n + 2 * len(kept)) for w in kept}

        p, q = {s: shares(c) for s, c in counts.items()}, shares(total)
        f = lambda a, b: (a - b) * (a - b) // (a + b)
        for s in counts:
            pairs = sorted(((-sum(f(p[s][w], p[o][w]) for w in kept), o.encode(), o) for o in counts if o != s))
            out += [(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(pairs)]
            best = sorted((-f(p[s][w], q[w]), w.encode(), w) for w in kept if counts[s][w] and p[s][w] > q[w])[:top]
            out += [(lang, s, "term", w, -v, i + 1) for i, (v, _, w) in enumerate(best)]
    return sorted(out)


def made_rows(seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4))) for _ in range(80)] + ["日本語", "Straße", "x" * 4000, "ÀB", "\u0080"]
    rows = []
    for i in range(400):
        lang, source = rng.choice(["de", "en", "en", "en", "", None]), rng.choice([None, "", "a", "b", "日", "c"])
        bias = rng.randrange(40)
        rows.append((rng.choice([" ", "\n", "-", "1"]).join(rng.choice(words[bias:bias + 45]).title() for _ in range(rng.randint(0, 30))), lang, source))
    rows += [(None, "en", "silent"), ("", "no terms", "a"), ("12 !", "no terms", "b"), (None, "alone", None)]
    return rows + rows[:50]


@pytest.mark.parametrize("cells, block, tile", [(None, None, None), (400, 7, 2)])
def test_audit_equals_plain_arithmetic(spark, monkeypatch, cells, block, tile):
    if cells:
        monkeypatch.setattr(divergence, "BLOCK_TERMS", block)
        monkeypatch.setattr(divergence, "TILE_SOURCES", tile)
        monkeypatch.setattr(divergence, "build_vocabulary", lambda kept, f=divergence.build_vocabulary: f(kept, cells))
        monkeypatch.setattr(divergence, "SHARD_TERMS", 20)
    rows = made_rows()
    docs = spark.createDataFrame([(i, *r, 0, "clash", 1) for i, r in enumerate(rows)], SCHEMA).repartition(4)
    got = sorted(tuple(r) for r in divergence.audit_sources(docs, 10, 10).collect())
    assert got == plain(rows, 10, 10)


def test_large_counts_do_not_overflow(spark):
    from pyspark.sql import functions as F
    n, total = 10 ** 15 + 7, 4 * 10 ** 15 + 1
    row = spark.range(1).select(divergence.share(F.lit(n).cast("bigint"), F.lit(total).cast("bigint"), F.lit(10 ** 9).cast("bigint")).alias("p"),
                                divergence.apart(F.lit(10 ** 9 + 1).cast("bigint"), F.lit(1).cast("bigint")).alias("f")).first()
    assert row["p"] == 1 + 10 ** 9 * (n + 2) // (total + 2 * 10 ** 9) and row["f"] == 10 ** 18 // (10 ** 9 + 2)


def test_empty_table(spark):
    assert divergence.audit_sources(spark.createDataFrame([], SCHEMA)).count() == 0
