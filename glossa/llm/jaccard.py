"""N-gram Jaccard join by the size-aware heavy-light method."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm.common import stored
from glossa.llm.components import components
from glossa.llm.shingles import shingle_sets
from glossa.llm.words import lean, lean_group, mix
from glossa.plans.guard import once

PROBE = 4             # one in so many shingles, by hash, takes part in the first test of a set
BUCKET_TOKENS = 1 << 21   # shingles that one exchange bucket is meant for
PROBE_TOKENS = 1 << 20    # shingles that a scan task compares with each other at once
SMALL_LIST = 1 << 24  # bytes of document ids up to which a list is broadcast
LEADERS = 32          # sets of a key that all its other sets meet, before the pairs that are still open
BLOCK = 2048          # members of one key that meet each other in one block
_MARK = np.uint32(0xFFFFFFFF)


@dataclass(frozen=True)
class Rule:
    """Sets link when percent * union <= 100 * intersection, over shingles of ``size`` words."""

    size: int = 5
    percent: int = 80

    def overlap(self, n):
        """Shingles that a set of n shares at least with any set it links to."""
        return -(-self.percent * n // 100)


# Sets

def _signature(flat: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """16 bytes that equal sets share: two sums of mixed hashes."""
    bounds = np.concatenate([[0], np.cumsum(counts)])
    out = []
    for salt in (np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(flat ^ salt), dtype=np.uint64)])
        out.append(mix(sums[bounds[1:]] - sums[bounds[:-1]] + salt))
    return [r.tobytes() for r in np.stack(out, axis=1)]


def set_rows(docs: DataFrame, rule: Rule, text: str = "text") -> DataFrame:
    """doc_id, n (distinct shingles) and node, a signature of the set; null node for the empty set."""
    def run(batches):
        for batch in batches:
            n, node = [], []
            for _, flat, counts in shingle_sets(batch.column(text), rule.size, short=True):
                n += counts.tolist()
                node += [s if c else None for s, c in zip(_signature(flat, counts), counts.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(node, pa.binary())],
                                             names=["doc_id", "n", "node"])

    return docs.select("doc_id", text).mapInArrow(lean(run), f"doc_id {dict(docs.dtypes)['doc_id']}, n bigint, node binary")


def _set_blobs(docs: DataFrame, rule: Rule, text: str = "text") -> DataFrame:
    """node, n and the whole set as bytes."""
    def run(batches):
        for batch in batches:
            for _, flat, counts in shingle_sets(batch.column(text), rule.size, short=True):
                sets = [p.tobytes() for p in np.split(flat, np.cumsum(counts)[:-1])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_signature(flat, counts), pa.binary()), pa.array(counts, pa.int64()), pa.array(sets, pa.binary())],
                    names=["node", "n", "tokens"])

    return docs.select(text).mapInArrow(lean(run), "node binary, n bigint, tokens binary").where(F.col("n") > 0)


# First test: most of a set that links to another is shared with it

def _probe(docs: DataFrame, rule: Rule, buckets: int, text: str) -> DataFrame:
    """Probe shingles of distinct sets, dealt to buckets by each scan task, some sets at a time.

    Every row has such a portion (task), a bucket, shingles (32 bits) and the sets
    they are of, as numbers that bucket -1 explains. A shingle of several sets of the
    portion is sent once, with a mark, and counted for them at once, so a common
    shingle is sent once for each million shingles of text.
    """
    def pieces(batches):
        """Some sets at a time, so that a worker's memory does not follow the batch."""
        for batch in batches:
            flats, sizes, nodes, held = [], [], [], 0
            for _, flat, counts in shingle_sets(batch.column(text), rule.size, short=True):
                flats.append(flat)
                sizes.append(counts)
                nodes += _signature(flat, counts)
                held += len(flat)
                if held >= PROBE_TOKENS:
                    yield np.concatenate(flats), np.concatenate(sizes), nodes
                    flats, sizes, nodes, held = [], [], [], 0
            if flats:
                yield np.concatenate(flats), np.concatenate(sizes), nodes

    def run(batches):
        for flat, counts, nodes in pieces(batches):
            task = np.random.default_rng().integers(0, 1 << 62)
            _, first = np.unique(np.array(nodes, dtype="S16"), return_index=True)  # one of equal sets
            alone = np.zeros(len(counts), dtype=bool)
            alone[first] = True
            alone &= counts > 0
            owner = np.repeat(np.arange(len(counts)), counts)
            keep = alone[owner] & (flat % np.uint64(PROBE) == 0)
            flat, owner = flat[keep] >> np.uint64(32), owner[keep]
            _, back, times = np.unique(flat, return_inverse=True, return_counts=True)
            common = times[back] > 1
            found = np.bincount(owner[common], minlength=len(counts))
            probes = np.bincount(owner, minlength=len(counts))
            marked = np.unique(flat[common])
            tokens = np.concatenate([flat[~common], marked]).astype(np.uint32)
            owners = np.concatenate([owner[~common].astype(np.uint32), np.full(len(marked), _MARK)])
            dealt = mix(tokens.astype(np.uint64)) % np.uint64(buckets)
            order = np.argsort(dealt, kind="stable")
            tokens, owners, dealt = tokens[order], owners[order], dealt[order]
            cuts = np.searchsorted(dealt, np.arange(buckets + 1))
            rows = [(int(task), b, tokens[cuts[b] : cuts[b + 1]].tobytes(), owners[cuts[b] : cuts[b + 1]].tobytes())
                    for b in range(buckets) if cuts[b] < cuts[b + 1]]
            # Bucket -1 keeps what the task itself knows of its sets.
            kept = np.flatnonzero(alone)
            facts = np.stack([kept, counts[kept], probes[kept], found[kept]], axis=1).astype(np.int64)
            rows.append((int(task), -1, b"".join(nodes[i] for i in kept), facts.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], schema=_PROBES)

    return docs.select(text).mapInArrow(lean(run), "task bigint, bucket int, tokens binary, owners binary")


_PROBES = pa.schema([("task", pa.int64()), ("bucket", pa.int32()), ("tokens", pa.binary()), ("owners", pa.binary())])


def _shared_counts(key, table):
    """Of one bucket: how many shingles of each set occur in another set too."""
    tokens = [np.frombuffer(t, dtype=np.uint32) for t in table.column("tokens").to_pylist()]
    owners = [np.frombuffer(t, dtype=np.uint32) for t in table.column("owners").to_pylist()]
    task = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
    token, owner = np.concatenate(tokens), np.concatenate(owners)
    _, back, times = np.unique(token, return_inverse=True, return_counts=True)
    hit = (times[back] > 1) & (owner != _MARK)
    pair, number = np.unique((task[hit] << 32) + owner[hit], return_counts=True)
    of_task, owned = pair >> 32, pair & 0xFFFFFFFF
    tasks = np.array(table.column("task").to_pylist(), dtype=np.int64)
    rows = []
    for t in np.unique(of_task):
        own = of_task == t
        rows.append((int(tasks[t]), np.stack([owned[own], number[own]], axis=1).astype(np.int64).tobytes()))
    return pa.table({"task": pa.array([r[0] for r in rows], pa.int64()), "counts": pa.array([r[1] for r in rows], pa.binary())})


def suspects(docs: DataFrame, rule: Rule, total: int, text: str = "text") -> DataFrame:
    """Nodes of sets that may link to another set.

    A set of n that links shares all but n - overlap(n) of its shingles, hence all
    but that many of its probe shingles. Shingles are compared by 32 bits here:
    false matches let a set through, never keep one out.
    """
    buckets = max(1, -(-total // PROBE // BUCKET_TOKENS))
    probes = stored(_probe(docs, rule, buckets, text), "probes")
    counts = probes.where("bucket >= 0").groupBy("bucket").applyInArrow(lean_group(_shared_counts), "task bigint, counts binary")
    percent = rule.percent

    def judge(left, right):
        out = []
        for nodes, facts in zip(left.column("tokens").to_pylist(), left.column("owners").to_pylist()):
            facts = np.frombuffer(facts, dtype=np.int64).reshape(-1, 4)
            shared = facts[:, 3].copy()
            place = np.zeros(int(facts[:, 0].max()) + 1 if len(facts) else 0, dtype=np.int64)
            place[facts[:, 0]] = np.arange(len(facts))
            for blob in right.column("counts").to_pylist():
                own = np.frombuffer(blob, dtype=np.int64).reshape(-1, 2)
                np.add.at(shared, place[own[:, 0]], own[:, 1])
            spare = facts[:, 1] - -(-percent * facts[:, 1] // 100)
            for i in np.flatnonzero(facts[:, 2] - shared <= spare):
                out.append(nodes[16 * i : 16 * i + 16])
        return pa.table({"node": pa.array(out, pa.binary())})

    facts = probes.where("bucket = -1").select("task", "tokens", "owners")
    return facts.groupBy("task").cogroup(counts.groupBy("task")).applyInArrow(lean_group(judge), "node binary").distinct()


# Exact frequencies among the suspects, rarest shingles first

def _frequencies(sets: DataFrame, total: int) -> DataFrame:
    """part and, as bytes, its shingles that at least two sets hold, with the number of sets."""
    buckets = max(1, -(-total // BUCKET_TOKENS))

    def send(batches):
        for batch in batches:
            for part in np.unique(batch.column("part").to_numpy()):
                own = batch.filter(pc.equal(batch.column("part"), int(part)))
                blobs = own.column("tokens").to_pylist()
                token, times = np.unique(np.frombuffer(b"".join(blobs), dtype=np.uint64), return_counts=True)
                dealt = mix(token) % np.uint64(buckets)
                order = np.argsort(dealt, kind="stable")
                token, times, dealt = token[order], times[order].astype(np.uint32), dealt[order]
                cuts = np.searchsorted(dealt, np.arange(buckets + 1))
                rows = [(int(part), b, token[cuts[b] : cuts[b + 1]].tobytes(), times[cuts[b] : cuts[b + 1]].tobytes())
                        for b in range(buckets) if cuts[b] < cuts[b + 1]]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], schema=_SENT)

    def add(key, table):
        tokens = [np.frombuffer(t, dtype=np.uint64) for t in table.column("tokens").to_pylist()]
        times = np.concatenate([np.frombuffer(t, dtype=np.uint32) for t in table.column("times").to_pylist()])
        row = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
        token, back = np.unique(np.concatenate(tokens), return_inverse=True)
        sums = np.bincount(back, weights=times).astype(np.int64)
        keep = sums[back] > 1
        part = table.column("part").to_numpy()
        rows = []
        cuts = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
        for r in range(len(tokens)):
            own = slice(cuts[r], cuts[r + 1])
            k = keep[own]
            rows.append((int(part[r]), token[back[own]][k].tobytes(), sums[back[own]][k].astype(np.uint32).tobytes()))
        return pa.Table.from_arrays([pa.array(c) for c in zip(*rows)], schema=_KNOWN)

    sent = sets.select("part", "tokens").mapInArrow(lean(send), "part bigint, bucket int, tokens binary, times binary")
    return sent.groupBy("bucket").applyInArrow(lean_group(add), "part bigint, tokens binary, times binary")


_SENT = pa.schema([("part", pa.int64()), ("bucket", pa.int32()), ("tokens", pa.binary()), ("times", pa.binary())])
_KNOWN = pa.schema([("part", pa.int64()), ("tokens", pa.binary()), ("times", pa.binary())])


def _ordered(sets: DataFrame, known: DataFrame, rule: Rule) -> DataFrame:
    """Each set's prefix: its shared shingles, rarest first, as far as a linked set must meet one or two of them.

    Columns node, n, shared (shingles that another set holds too), lead (how many
    of the set's shingles come before the first shared one) and prefix, the
    shingles at places lead, lead + 1, ... up to n - overlap(n) + 1. Sets whose
    prefix is empty link to nothing and are left out.
    """
    percent = rule.percent

    def run(left, right):
        tokens = np.concatenate([np.frombuffer(t, dtype=np.uint64) for t in right.column("tokens").to_pylist()] or [np.zeros(0, np.uint64)])
        times = np.concatenate([np.frombuffer(t, dtype=np.uint32) for t in right.column("times").to_pylist()] or [np.zeros(0, np.uint32)])
        order = np.argsort(tokens)
        tokens, times = tokens[order], times[order]
        rows = []
        for node, n, blob in zip(left.column("node").to_pylist(), left.column("n").to_pylist(), left.column("tokens").to_pylist()):
            own = np.frombuffer(blob, dtype=np.uint64)
            at = np.searchsorted(tokens, own)
            at[at == len(tokens)] = 0
            held = tokens[at] == own if len(tokens) else np.zeros(len(own), dtype=bool)
            many = times[at[held]] if len(tokens) else np.zeros(0, np.uint32)
            lead = n - int(held.sum())
            needed = -(-percent * n // 100)
            reach = n - needed + 2 - lead  # one place more than a single common shingle needs
            if reach - 1 > 0 and n - lead >= needed:
                first = np.lexsort((own[held], many))[:reach]
                rows.append((node, n, n - lead, lead, own[held][first].astype(np.int64).tolist(),
                             many[first].astype(np.int64).tolist()))
        return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(list(zip(*rows)) or [[]] * 6, _PREFIX)], schema=_PREFIX)

    return (sets.select("part", "node", "n", "tokens").groupBy("part").cogroup(known.groupBy("part"))
            .applyInArrow(lean_group(run), "node binary, n bigint, shared bigint, lead bigint, prefix array<bigint>, times array<bigint>"))


_PREFIX = pa.schema([("node", pa.binary()), ("n", pa.int64()), ("shared", pa.int64()), ("lead", pa.int64()),
                     ("prefix", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])


# Heavy and light

def boundary(ordered: DataFrame, rule: Rule) -> int:
    """Size up to which sets count as light: where subset keys and list scans together cost least.

    Costs are rows that are written, sorted and exchanged. A light set has one for
    each subset of two prefix shingles. A heavy one has one for each prefix shingle, and
    one for each block of that shingle's inverted list, which it meets there. Summed by
    powers of two of the size; at most 64 rows come to the driver.
    """
    reach = F.size("prefix")
    step = F.floor(F.log2(F.col("n").cast("double"))).cast("int")
    subsets = reach * (reach - 1) / 2
    scans = F.aggregate("times", F.lit(0).cast("bigint"), lambda a, x: a + 1 + F.ceil(x / BLOCK))
    rows = sorted(ordered.groupBy(step.alias("step")).agg(F.sum(subsets).alias("light"), F.sum(scans).alias("heavy")).collect(),
                  key=lambda r: r["step"])
    costs = [(sum(r["light"] for r in rows[:i]) + sum(r["heavy"] for r in rows[i:]), -i) for i in range(len(rows) + 1)]
    best = -min(costs)[1] if costs else 0
    return (2 << rows[best - 1]["step"]) - 1 if best else 0


def postings(ordered: DataFrame, limit: int, rule: Rule) -> DataFrame:
    """Keys under which sets meet: node, n, key, most (the shingles that sets may share that meet here first), i and j.

    i and j are the prefix places of the key's shingles; i is -1 for a single one.

    Light sets are filed under each subset of two prefix shingles: sets that share
    at least two shingles share two of the longer prefix. Heavy sets are in the
    inverted lists of single shingles of the prefix without its last place. Light sets
    that a heavy one may link to, and those that may share a single shingle, are in the lists too.
    """
    prefix, reach = F.col("prefix"), F.size("prefix")
    needed = -F.floor(-rule.percent * F.col("n") / 100)
    # Places of the prefix are lead, lead + 1, ...; one common shingle is met in the first n - needed + 1 places.
    single_reach = F.least(reach, (F.col("n") - needed + 1 - F.col("lead")).cast("int"))
    light = F.col("n") <= limit
    lists = ~light | (100 * F.col("n") >= rule.percent * limit) | (needed < 2)
    single = F.when(lists & (single_reach > 0), F.transform(
        F.sequence(F.lit(0), F.greatest(single_reach - 1, F.lit(0))),
        lambda i: F.struct(F.xxhash64(F.get(prefix, i)).alias("key"), (F.col("shared") - i).alias("most"),
                           F.lit(-1).alias("i"), i.alias("j"))))
    pairs = F.when(light & (reach > 1), F.flatten(F.transform(
        F.sequence(F.lit(1), F.greatest(reach - 1, F.lit(1))),
        lambda j: F.transform(F.sequence(F.lit(0), j - 1),
                              lambda i: F.struct(F.xxhash64(F.get(prefix, i), F.get(prefix, j)).alias("key"),
                                                  (F.col("shared") - j + 1).alias("most"), i.alias("i"), j.alias("j"))))))
    keys = F.concat(F.coalesce(single, _none()), F.coalesce(pairs, _none()))
    return ordered.select("node", "n", F.explode(once(keys)).alias("k")).select("node", "n", "k.*")


def _none() -> Column:
    return F.lit([]).cast("array<struct<key:bigint,most:bigint,i:int,j:int>>")


# Pairs, and which of them link

def _may(rule: Rule) -> Column:
    """Whether two sets, a and b, can link if the key they meet under holds the first shingles they share.

    A linked pair also meets under such a key, so nothing is lost elsewhere. Different
    sets of one size share at most all but one of their shingles.
    """
    n, m = F.col("a.n"), F.col("b.n")
    most = F.least("a.most", "b.most", F.when(n == m, n - 1).otherwise(F.least(n, m)))
    return 100 * most >= rule.percent * (n + m - most)


def _ordered_pair() -> list[Column]:
    return [F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")]


def star_pairs(posted: DataFrame, rule: Rule) -> DataFrame:
    """Each key's sets with one of them, drawn by a hash: as many pairs as postings, however long a list is."""
    member = F.struct("node", "n", "most")
    leaders = (posted.groupBy("key").agg(F.min_by(member, F.xxhash64("key", "node")).alias("b"), F.count(F.lit(1)).alias("size"))
               .where(F.col("size") > 1).select("key", "b"))
    met = posted.select("key", member.alias("a")).join(leaders, "key")
    return met.where((F.col("a.node") != F.col("b.node")) & _may(rule)).select(*_ordered_pair()).distinct()


def _unsettled(posted: DataFrame, known: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Postings with their set's component, and the keys that more than one component has, with their number of blocks."""
    component = F.col("node") if known is None else F.coalesce("component", "node")
    placed = (posted if known is None else posted.join(known, "node", "left")).withColumn("component", component)
    lists = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"),
                                      F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    return placed, lists.where(F.col("lo") != F.col("hi")).select("key", "blocks")


def spread_pairs(posted: DataFrame, known: DataFrame, rule: Rule) -> DataFrame:
    """Under each key with several components: its sets with ``LEADERS`` of them, drawn by a hash, of other components.

    As many rows as postings times leaders at most. In a large group of variants, each linked to some of the others,
    nearly all find one they link to among these, so that few pairs stay open.
    """
    placed, lists = _unsettled(posted, known)
    rest = placed.join(lists, "key")
    member = F.struct("node", "n", "most", "component")
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("node", "key"), "node"))
    leaders = rest.withColumn("_rank", rank).where(F.col("_rank") <= LEADERS).select("key", member.alias("b"))
    met = rest.select("key", member.alias("a")).join(leaders, "key")
    return met.where((F.col("a.component") != F.col("b.component")) & _may(rule)).select(*_ordered_pair()).distinct()


def open_pairs(posted: DataFrame, ordered: DataFrame, known: DataFrame | None, rule: Rule) -> DataFrame:
    """Pairs under a common key whose sets are not yet in one component; without ``known`` components, all pairs.

    Lists within one component are done. A longer list is cut into blocks that
    meet each other block by block, so no list is one task's. A pair comes up only
    under the key of the first shingles it shares, not under each common key.
    """
    placed, lists = _unsettled(posted, known)
    i, j = F.col("i"), F.col("j")
    before = F.when(i < 0, F.slice("prefix", F.lit(1), j)).otherwise(F.concat(
        F.slice("prefix", F.lit(1), F.greatest(i, F.lit(0))), F.slice("prefix", i + 2, F.greatest(j - i - 1, F.lit(0)))))
    rest = (placed.join(lists, "key")
            .join(ordered.select("node", "prefix"), "node").withColumn("before", before))
    member = F.struct("node", "n", "most", "component", "before")
    left = rest.select("key", F.pmod(F.hash("node"), F.col("blocks")).alias("block"), member.alias("a"))
    right = rest.select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), member.alias("b"))
    met = left.join(right, (left["key"] == right["key"]) & (left["block"] == right["block"])
                    & (F.col("a.node") < F.col("b.node")) & (F.col("a.component") != F.col("b.component")) & _may(rule)
                    & ~F.arrays_overlap("a.before", "b.before"))
    return met.select(*_ordered_pair()).distinct()


def verified(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) that link, by exact intersection of the whole sets."""
    percent = rule.percent

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                p, q = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                p, q = (p, q) if len(p) <= len(q) else (q, p)
                at = np.searchsorted(q, p)
                at[at == len(q)] = 0
                shared = int((q[at] == p).sum())
                keep.append(100 * shared >= percent * (len(p) + len(q) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = (pairs.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("x")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("y")), "b").select("a", "b", "x", "y"))
    return both.mapInArrow(lean(run), "a binary, b binary")


def _filed(docs: DataFrame, rows: DataFrame, rule: Rule, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Whole sets that may link, their prefixes and the keys under which they meet."""
    total, count = rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    chosen = stored(rows.join(suspects(docs, rule, total, text), "node").groupBy("node").agg(F.min("doc_id").alias("_id"))
                    .select("_id").distinct(), "suspects", rows=count)
    small = (chosen.agg(F.sum(16 + F.octet_length(F.col("_id").cast("string")))).first()[0] or 0) <= SMALL_LIST
    picked = docs.join(F.broadcast(chosen) if small else chosen, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    sets = stored(_set_blobs(picked, rule, text).dropDuplicates(["node"])
                  .withColumn("part", F.spark_partition_id().cast("bigint")), "sets")
    mass = sets.agg(F.sum("n")).first()[0] or 0
    ordered = stored(_ordered(sets, _frequencies(sets, mass), rule), "ordered")
    return sets, ordered, stored(postings(ordered, boundary(ordered, rule), rule), "postings")


def set_links(docs: DataFrame, rows: DataFrame, rule: Rule, text: str = "text") -> DataFrame:
    """All links between different sets, each once: a and b (nodes). Every pair under a common key is verified."""
    sets, ordered, posted = _filed(docs, rows, rule, text)
    return verified(open_pairs(posted, ordered, None, rule), sets, rule)


def connecting_links(docs: DataFrame, rows: DataFrame, rule: Rule, text: str = "text") -> DataFrame:
    """Pairs of sets (a, b: nodes) that connect all sets that links connect; not the links themselves.

    Any two sets under a common key are either verified or already connected by
    verified links. Components found so far stand as stars of their least node.
    """
    sets, ordered, posted = _filed(docs, rows, rule, text)
    first = stored(verified(star_pairs(posted, rule), sets, rule), "links")
    known = components(first)
    more = stored(verified(spread_pairs(posted, known, rule), sets, rule), "links")
    known = components(_stars(known).unionByName(more))
    more = stored(verified(open_pairs(posted, ordered, known, rule), sets, rule), "links")
    return _stars(known).unionByName(more)


def _stars(known: DataFrame) -> DataFrame:
    """Components as edges from their least node."""
    return known.where(F.col("node") != F.col("component")).select(F.col("component").alias("a"), F.col("node").alias("b"))


def link_counts(docs: DataFrame, rule: Rule = Rule(), text: str = "text") -> DataFrame:
    """One row per document row: doc_id, n_shingles and n_links, the other rows that it links to.

    Links are those of ``near_duplicates``, every one counted: half the sum of
    n_links is their number. Copies are counted by the size of their node and
    never meet in pairs; different sets do, as many pairs as there are links to find.
    """
    docs = docs.select("doc_id", text)
    rows = stored(set_rows(docs, rule, text), "set-rows")
    links = stored(set_links(docs, rows, rule, text), "links")
    copies = rows.where(F.col("node").isNotNull()).groupBy("node").agg(F.count(F.lit(1)).alias("copies"))
    ways = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
        links.select(F.col("b").alias("node"), F.col("a").alias("other")))
    linked = ways.join(copies.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.sum("copies").alias("linked"))
    counted = copies.join(linked, "node", "left").select(
        "node", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    return rows.join(counted, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def near_duplicates(docs: DataFrame, rule: Rule = Rule(), text: str = "text") -> DataFrame:
    """One row per document row: doc_id, n_shingles and component_id.

    Two documents link when their sets of word shingles have at least the rule's
    Jaccard similarity; component_id is the least doc_id that links reach, itself
    included. A text of fewer words than a shingle has its whole sequence as one;
    null and wordless texts have no shingle and are their own component. Documents
    with equal sets are one node from the start, so copies never meet in pairs.
    Rows with a null doc_id take part, but a component is named by an id. Extra
    columns are ignored; an empty table gives no rows.
    """
    docs = docs.select("doc_id", text)
    rows = stored(set_rows(docs, rule, text), "set-rows")
    joined = components(connecting_links(docs, rows, rule, text))
    least = rows.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("least"))
    named = least.join(joined, "node").groupBy("component").agg(F.min("least").alias("component_id"))
    reached = joined.join(named, "component").select("node", "component_id")
    names = least.join(reached, "node", "left").select("node", F.coalesce("component_id", "least").alias("component_id"))
    return rows.join(names, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, rule: Rule = Rule(), text: str = "text") -> DataFrame:
    """One row of each component, that of the least doc_id; columns stay as they are.

    Rows are told apart by a number that is written with them, so repeated and null
    ids do no harm; null ids come last. Rows without a shingle all stay.
    """
    rows = stored(docs.withColumn("__row", F.monotonically_increasing_id()), "rows", "zstd")
    found = near_duplicates(rows.select(F.col("__row").alias("doc_id"), text), rule, text).where(F.col("n_shingles") > 0)
    placed = found.join(rows.select(F.col("__row").alias("_row"), F.col("doc_id").alias("_id")), F.col("doc_id") == F.col("_row"))
    order = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_row").alias("row"))
    best = placed.groupBy("component_id").agg(F.min(order).alias("best")).select(F.col("best.row").alias("_best"))
    dropped = found.join(best, F.col("doc_id") == F.col("_best"), "left_anti").select(F.col("doc_id").alias("_dropped"))
    return rows.join(dropped, F.col("__row") == F.col("_dropped"), "left_anti").drop("__row")
