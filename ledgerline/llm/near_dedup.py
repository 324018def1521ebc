"""Near-duplicate documents by SetSketch registers, banding, joint likelihood and exact verification.

A document's set holds its distinct shingles of some words. Its registers are exponentially spaced truncated
minima of as many hash functions; those of a union are the maxima of the registers, and two sets agree in a
register about as often as their similarity says.

1. Documents with equal sets form a class (they are linked, at similarity 1); only one of a class goes on.
2. Registers are banded. Each band's bucket names its least class as centre, and every other class of the bucket
   is a member of that centre's star. Two classes that share a bucket are thus in one star. A star has a row for
   each member, not for each pair.
3. Stars are cut into chunks of CHUNK members or so (fewer if their sets are large), each with the centre. First only
   registers are dealt: a member that has no other in its chunk to which the similarity asked for is less likely by
   no more than REJECT nats, jointly with both sets' sizes, goes no further. The texts of the others meet, once a
   chunk, and there a document outside the largest component so far is compared with all others of other components,
   and in the end so are documents that were in the largest of their time with each other, where they are not joined:
   pairs that the likelihood leaves are verified on full sets. Links leave as a forest, at most one for each member.
4. Links are joined into components by alternating large and small stars.
5. Where a star was cut, the registers of its members outside the centre's component are dealt with those of all its
   members in cells of a block and a chunk, so no pair is left out; again only texts with a likely partner in the cell
   meet there; then 4 again.

Documents without words or text are linked with nothing, and kept. A null id is never a component's id unless the
component has no other; rows of one id are judged by their texts. Repeated rows share class and result; of documents that tie
for a group's least id, as repeated rows do, all are marked as kept, and deduplicated() keeps one. Texts may be of any length;
their sets are made one by one. An empty table gives an empty result. Only the id and the text are read, so other columns may
have any name.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keeps, mixed, sifted, sliced, stored, worker

#: Registers, rows in a band, bands. Two sets of similarity 0.85 share no band 7 times in 10**9.
REGISTERS, ROWS = 160, 5
BANDS = REGISTERS // ROWS
#: SetSketch parameters: base of the exponential spacing, rate, largest register.
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 2
#: Members of a star that meet in one group, or nearly so, first and in a cell of the later step; shingles of all of them; nats of
#: likelihood that rule a pair out.
CHUNK, CROSS, SHINGLES, REJECT = 250, 1000, 4_000_000, 18.0
#: Links that a task joins into components.
TASK = 500_000


class Rule(NamedTuple):
    """Words of a shingle; documents are linked at a similarity of num / den or more."""

    words: int = 5
    num: int = 80
    den: int = 100

    def near(self, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray:
        """Whether sets of these sizes can be similar enough."""
        return self.den * np.minimum(a, b) >= self.num * np.maximum(a, b)


#: What the query of this operator is asked for, and what everything else takes.
CONTRACT, FIVE = Rule(3, 85, 100), Rule()
LOWER_TABLE = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_RNG = np.random.default_rng(20240229)
_MUL = (_RNG.integers(1, 1 << 32, REGISTERS, dtype=np.uint64) | 1).astype(np.uint32)[:, None]
_ADD = _RNG.integers(0, 1 << 32, REGISTERS, dtype=np.uint64).astype(np.uint32)[:, None]
_PLACE = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
_PLACE += [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in range(2, 30)]


class _Numbers(dict):
    """64-bit numbers of words, each hashed once; emptied when large, which changes no number."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = x = xxhash.xxh3_64_intdigest(word)
        return x


_numbers = _Numbers()
keeps("near", _numbers.clear)


def shingles(text: str | None, w: int = CONTRACT.words) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit numbers."""
    words = text.encode().translate(LOWER_TABLE).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    x = np.fromiter(map(_numbers.__getitem__, words), np.uint64, len(words))
    if len(x) < w:
        return mixed((x * np.array(_PLACE[: len(x)], np.uint64)).sum(keepdims=True), len(x))
    return np.unique(mixed(sum(x[k : len(x) - w + 1 + k] * _PLACE[k] for k in range(w)), w))


def registers(x: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set of shingles: truncated exponentially spaced minima. Those of a union are the maxima."""
    low, least = (x >> np.uint64(32)).astype(np.uint32), np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 8192):
        np.minimum(least, (low[i : i + 8192] * _MUL + _ADD).min(axis=1), out=least)
    value = -np.log1p(-(least + 0.5) / 4294967296.0) / RATE
    return np.clip(np.floor(1 - np.log(value) / math.log(BASE)), 0, TOP + 1).astype(np.uint16)


_GRID = np.linspace(0, 1, 41)


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)


def unlikely(own: np.ndarray, others: np.ndarray, size: int, sizes: np.ndarray, rule: Rule = CONTRACT) -> np.ndarray:
    """Which of `others` (rows of registers) are so dissimilar to `own` that the rule's similarity is REJECT nats less likely than the best fit."""
    more, less = (own > others).sum(axis=1)[:, None], (own < others).sum(axis=1)[:, None]
    u = (size / (size + sizes))[:, None]
    v = 1 - u
    top = np.minimum(u / v, v / u)

    def fit(j: np.ndarray) -> np.ndarray:
        a, b = _p(u - v * j), _p(v - u * j)
        return more * np.log(a + 1e-12) + less * np.log(b + 1e-12) + (REGISTERS - more - less) * np.log(np.maximum(1 - a - b, 1e-12))

    wanted = rule.num / rule.den
    return fit(_GRID[_GRID < wanted][None, :]).max(axis=1) - fit(np.minimum(wanted, top))[:, 0] > REJECT


class _Forest:
    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: int, b: int) -> bool:
        x, y = int(self.label[a]), int(self.label[b])
        if x == y:
            return False
        self.label[self.label == max(x, y)] = min(x, y)
        return True


def linked(sets: list[np.ndarray], labels: np.ndarray | None = None, left: np.ndarray | None = None, rule: Rule = CONTRACT) -> list[tuple[int, int]]:
    """Links that join all pairs of sets that the rule links, as a forest. Sets of equal `labels` are joined
    already. With `left`, only pairs with one set in it and one outside are compared."""
    n, out = len(sets), []
    forest = _Forest(n)
    if labels is not None:
        forest.label = np.unique(labels, return_index=True)[1][np.unique(labels, return_inverse=True)[1]]
    sizes = np.array([len(x) for x in sets], np.int64)
    sketches = np.stack([registers(x) for x in sets])

    def compare(i: int, among: np.ndarray | bool) -> None:
        label = forest.label
        at = np.flatnonzero((label != label[i]) & rule.near(sizes, sizes[i]) & among)
        at = at[~unlikely(sketches[i], sketches[at], int(sizes[i]), sizes[at], rule)] if len(at) else at
        for k in range(0, len(at), 256):
            part = at[k : k + 256]
            bounds = np.cumsum([0, *sizes[part]])
            members = np.concatenate([sets[j] for j in part])
            common = np.add.reduceat(sets[i][np.minimum(np.searchsorted(sets[i], members), sizes[i] - 1)] == members, bounds[:-1])
            good = rule.den * common >= rule.num * (sizes[i] + sizes[part] - common)
            for j in part[good]:
                if forest.join(int(i), int(j)):
                    out.append((int(i), int(j)))

    if left is not None:
        for i in np.flatnonzero(left):
            compare(i, ~left)
        return out
    skipped = np.zeros(n, bool)
    for i in range(n):
        if i and forest.label[i] == np.bincount(forest.label).argmax():
            skipped[i] = True
        else:
            compare(i, True)
    # the largest component changes meanwhile, so two skipped sets may be in different ones; now one is chosen in advance
    if skipped.any():
        again = np.flatnonzero(skipped)
        home = again[forest.label[again] == np.bincount(forest.label[again]).argmax()][0]
        for i in again:
            if forest.label[i] != forest.label[home]:
                compare(i, skipped)
    return out


def _printed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, print and text; key and print find a text again."""
    return docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(text).alias("print"), F.col(text).alias("text"))


def _sketched(docs: DataFrame, rule: Rule) -> DataFrame:
    """rid (a number of the row), key, print, n, class (of equal sets) and registers of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 36
        for batch in (x for b in batches for x in sliced(b, 2)):
            sets = [shingles(t, rule.words) for t in batch.column(2).to_pylist()]
            rows = [pa.array(range(rid, rid + len(sets)), pa.int64()), batch.column(0), batch.column(1), pa.array([len(x) for x in sets], pa.int64())]
            rows += [pa.array([_class(x) for x in sets], pa.binary()), pa.array([registers(x).tobytes() if len(x) else None for x in sets], pa.binary())]
            rid += len(sets)
            yield pa.RecordBatch.from_arrays(rows, ["rid", "key", "print", "n", "class", "registers"])

    return docs.mapInArrow(worker(run, "near"), "rid bigint, key bigint, print bigint, n bigint, class binary, registers binary")


def _class(x: np.ndarray) -> bytes:
    return hashlib.blake2b(x.tobytes(), digest_size=16).digest()


def _buckets(classes: DataFrame) -> DataFrame:
    """bucket, cid: a row for each band of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, BANDS, ROWS).astype(np.uint64)
            h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), regs.shape[:2])
            for k in range(ROWS):
                h = mixed(h * np.uint64(65536) + regs[:, :, k], k)
            yield pa.RecordBatch.from_arrays([pa.array(h.reshape(-1).view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], ["bucket", "cid"])

    return classes.select("cid", "registers").mapInArrow(worker(run, "near"), "bucket bigint, cid bigint")


def components(links: DataFrame) -> DataFrame:
    """u, v: each linked node and the least node of its component, from links (u, v); by alternating large and small stars. Both
    sides of every join are tables, so that a hub's links can be split between tasks."""
    edges = stored(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "edges")
    # no step has more rows than twice the links there are at first; a task for each TASK of them is enough
    tasks = max(1, -(-2 * edges.count() // TASK))
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).coalesce(tasks), "least")
        large = both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = stored(large.coalesce(tasks), "large")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks), "least")
        small = large.join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = stored(small.where("u != v").distinct().coalesce(tasks), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges
        before = now


_LINK = "u bigint, v bigint"


def _grouped(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple]:
    """The rows of each run of equal first `n` columns, as lists."""
    at, group = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:n] != at:
                if group:
                    yield at, group
                at, group = row[:n], []
            group.append(row[n:])
    if group:
        yield at, group


def likely(side: np.ndarray | None, sizes: np.ndarray, sketches: np.ndarray, labels: np.ndarray, rule: Rule = CONTRACT) -> np.ndarray:
    """Which sets have a partner, of another label and on the other side where there are sides, that the likelihood does not rule out.
    Without sides, the first set is the centre: who has it as partner needs no other."""
    hit = np.zeros(len(sizes), bool)

    def compare(i: int, among: np.ndarray) -> None:
        at = np.flatnonzero(among & (labels != labels[i]) & rule.near(sizes, sizes[i]))
        if len(at) and len(at := at[~unlikely(sketches[i], sketches[at], int(sizes[i]), sizes[at], rule)]):
            hit[i] = hit[at] = True

    everyone = np.ones(len(sizes), bool) if side is None else side == 1
    if side is None:
        compare(0, everyone)
    for i in np.flatnonzero(~hit) if side is None else np.flatnonzero(side == 0):
        compare(i, everyone)
    return hit


def _likely_in_cells(rows: DataFrame, key: list[str], rule: Rule) -> DataFrame:
    """The rows (key columns, side, cid, label) whose registers leave a partner in their cell, of rows with n and registers besides."""
    kinds = dict(rows.dtypes)
    rows = rows.select(*key, "side", "cid", "label", "n", "registers").repartition(*key).sortWithinPartitions(*key, "side", "cid")
    names = [*key, "side", "cid", "label"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, group in _grouped(batches, len(key)):
            group = list({(r[0], r[1]): r for r in group}.values())
            # a star's centre is its first key column
            group.sort(key=lambda r: (r[0] is None and r[1] != cell[0], r[0] or 0, r[1]))
            side = None if group[0][0] is None else np.array([r[0] for r in group])
            hit = likely(side, np.array([r[3] for r in group]), np.stack([np.frombuffer(r[4], np.uint16) for r in group]), np.array([r[2] for r in group]), rule)
            kept = [(*cell, *r[:3]) for r, h in zip(group, hit, strict=True) if h]
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in kept], pa.int32() if kinds[c] == "int" else pa.int64()) for i, c in enumerate(names)], names)

    return rows.mapInArrow(worker(run, "near"), ", ".join(f"{c} {kinds[c]}" for c in names))


def _linked_in_cells(rows: DataFrame, key: list[str], rule: Rule) -> DataFrame:
    """Links within each cell of rows (key columns, side, cid, label, text): for side null all pairs, else pairs of side 0 with side 1."""
    rows = rows.select(*key, "side", "cid", "label", "text").repartition(*key).sortWithinPartitions(*key, "side", "cid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a text becomes its set as soon as it is read
        batches = (x for b in batches for x in sliced(b, b.num_columns - 1))
        for _, group in _grouped((_with_sets(b, rule) for b in batches), len(key)):
            unique = list({(r[0], r[1]): r for r in group}.values())
            if len(unique) > 1:
                side = np.array([r[0] == 0 for r in unique])
                cids, labels = np.array([r[1] for r in unique], np.int64), np.array([r[2] for r in unique], np.int64)
                found = linked([np.frombuffer(r[3], np.uint64) for r in unique], labels, None if unique[0][0] is None else side, rule)
                yield pa.RecordBatch.from_arrays([pa.array([int(cids[x[k]]) for x in found], pa.int64()) for k in (0, 1)], ["u", "v"])

    return rows.mapInArrow(worker(run, "near"), _LINK)


def _with_sets(batch: pa.RecordBatch, rule: Rule) -> pa.RecordBatch:
    sets = pa.array([shingles(t, rule.words).tobytes() for t in batch.column(batch.num_columns - 1).to_pylist()], pa.large_binary())
    return pa.RecordBatch.from_arrays([*batch.columns[:-1], sets], names=batch.schema.names)


def _place() -> list[Column]:
    """A key in two columns that are never null, so that they can be joined and grouped by."""
    return [F.coalesce("key", F.lit(0)).alias("k"), F.col("key").isNull().alias("none")]


class _Corpus:
    """The classes of equal sets, and where their texts are."""

    def __init__(self, docs: DataFrame, key: str, text: str, rule: Rule):
        self.rule = rule
        self.texts = _printed(docs, key, text)
        self.rows = stored(_sketched(self.texts, rule), "sketches")
        first, low = F.min(F.struct("rid", "n", "registers")).alias("f"), F.min(F.struct("key", "print")).alias("p")
        found = self.rows.where("n > 0").groupBy("class").agg(first, low, F.min("key").alias("low"))
        self.classes = stored(found.select("class", F.col("f.rid").alias("cid"), "f.n", "f.registers", "p.key", "p.print", "low"), "classes")

    def with_registers(self, members: DataFrame) -> DataFrame:
        return members.join(self.classes.select("cid", "n", "registers").hint("merge"), "cid")

    def with_text(self, members: DataFrame) -> DataFrame:
        """`members` with the text that stands for their class: each text is fetched once, then goes to each of its cells."""
        place = ["k", "none", "print"]
        need = members.select("cid").distinct().join(self.classes.select("cid", *_place(), "print").hint("merge"), "cid")
        need = stored(need, "need")
        # by sorting at every size: what needs texts grows with the documents, and small inputs then foretell large ones
        texts = sifted(self.texts.where("text is not null").select(*_place(), "print", "text"), need, place)
        once = texts.join(need.hint("merge"), place).groupBy(*place, "cid").agg(F.first("text").alias("text"))  # repeated rows have one text
        return members.join(once.select("cid", "text").hint("merge"), "cid")

    def links(self, members: DataFrame, key: list[str]) -> DataFrame:
        return _linked_in_cells(self.with_text(stored(_likely_in_cells(self.with_registers(members), key, self.rule), "likely")), key, self.rule)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", rule: Rule = FIVE) -> DataFrame:
    """key, n_shingles, component_id (least key of the component) and kept of every document."""
    corpus = _Corpus(docs, key, text, rule)
    rows, classes = corpus.rows, corpus.classes
    buckets = _buckets(classes)
    centres = stored(buckets.groupBy("bucket").agg(F.min("cid").alias("c"), F.count(F.lit(1)).alias("m")).where("m > 1").select("bucket", "c"), "centres")
    stars = stored(buckets.join(centres.hint("merge"), "bucket").where("cid != c").select("c", "cid").distinct(), "stars")
    sizes = stars.join(classes.select("cid", "n").hint("merge"), "cid").groupBy("c").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("s"))
    sized = stored(sizes.select("c", _parts("m", "s", CHUNK).alias("chunks"), _parts("m", "s", CROSS).alias("crosses")), "sized")
    member = stars.join(sized.hint("merge"), "c").select("c", F.pmod(F.xxhash64("cid"), F.col("chunks")).cast("int").alias("chunk"), "cid")
    centre = sized.select("c", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.col("c").alias("cid"))
    all_pairs = {"side": F.lit(None).cast("int"), "label": F.col("cid")}
    joined = components(corpus.links(member.unionByName(centre).withColumns(all_pairs), ["c", "chunk"]))
    cut = sized.where("chunks > 1")
    if not cut.isEmpty():
        joined = _across(corpus, joined, stars.join(cut.hint("merge"), "c").select("c", "cid", F.col("crosses").alias("chunks")))
    label = classes.select("cid", "class", "low").join(joined.select(F.col("u").alias("cid"), F.col("v").alias("root")).hint("merge"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    label = stored(label, "labels")
    # tables on both sides of each join, so that a component or class with a third of the rows is split between tasks
    lows = stored(label.groupBy("root").agg(F.min("low").alias("component")), "lows")
    by_class = stored(label.join(lows.hint("merge"), "root").select("class", "component"), "components")
    out = rows.where("n > 0").select("key", "n", "class").join(by_class.hint("merge"), "class").select("key", "n", "component")
    out = out.unionByName(rows.where("n = 0").select("key", "n", F.col("key").alias("component")))
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("key").eqNullSafe(F.col("component")).alias("kept"))


def _parts(count: str, shingles: str, most: int) -> Column:
    return F.ceil(F.greatest(F.col(count) / most, F.col(shingles) / SHINGLES)).cast("int")


def _across(corpus: _Corpus, joined: DataFrame, cut: DataFrame) -> DataFrame:
    """Components with the links between different chunks of the stars in `cut` (c, cid, chunks) as well."""
    of = joined.select(F.col("u").alias("cid"), F.col("v").alias("label"))
    at = cut.select("c", "cid", "chunks").join(of.hint("merge"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    home = of.withColumnsRenamed({"cid": "c", "label": "home"})
    at = stored(at.join(home.hint("merge"), "c", "left").withColumn("home", F.coalesce("home", "c")).withColumn("chunk", F.pmod(F.xxhash64("cid"), F.col("chunks")).cast("int")), "across")
    outside = at.where("label != home")
    if outside.isEmpty():
        return joined
    counts = outside.join(corpus.classes.select("cid", "n").hint("merge"), "cid").groupBy("c").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("s"))
    blocks = stored(counts.select("c", _parts("m", "s", CROSS).alias("blocks")), "blocks")
    # side 0: the members outside the centre's component, in blocks, sent to every chunk; side 1: all members of a chunk, sent to every block
    zero = outside.join(blocks.hint("merge"), "c").select("c", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.pmod(F.xxhash64("cid", F.lit(1)), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("side"), "cid", "label")
    one = at.join(blocks.hint("merge"), "c").select("c", "chunk", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("side"), "cid", "label")
    more = stored(corpus.links(zero.unionByName(one), ["c", "chunk", "block"]), "more")
    return joined if more.isEmpty() else components(joined.unionByName(more))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", rule: Rule = FIVE) -> DataFrame:
    """The rows of `docs` of which one document of each group stays, unchanged; of repeated rows one stays."""
    found = stored(near_duplicates(docs, key, text, rule), "verdicts")
    name = "_kept"
    while name in docs.columns:
        name += "_"
    kept = found.where("kept").select(F.col(key).alias(name))
    out = docs.join(kept.hint("merge"), docs[key].eqNullSafe(kept[name]), "left_semi")
    return out if found.groupBy(key).count().where("count > 1").isEmpty() else out.dropDuplicates([key, text])


ORACLE = r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT rid, hash(array_to_string(w[i : i + least(len(w), 3) - 1], ' ')) AS g FROM (SELECT rid, w, unnest(range(1, len(w) - least(len(w), 3) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT rid, count(*) AS n FROM s GROUP BY rid),
c AS (SELECT a.rid AS x, b.rid AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.rid < b.rid GROUP BY a.rid, b.rid),
e AS MATERIALIZED (SELECT x, y FROM c JOIN n p ON p.rid = x JOIN n q ON q.rid = y WHERE 100 * k >= 85 * (p.n + q.n - k)),
b AS MATERIALIZED (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT rid AS start, rid AS at FROM d UNION SELECT r.start, b.y FROM r JOIN b ON b.x = r.at),
m AS (SELECT start, min(d.doc_id) AS component_id FROM r JOIN d ON d.rid = r.at GROUP BY start)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM d LEFT JOIN n USING (rid) JOIN m ON m.start = d.rid
"""
