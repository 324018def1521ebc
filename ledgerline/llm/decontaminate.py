"""Benchmark decontamination by Wu-Manber search over words.

The patterns are the benchmark's windows of consecutive words; all windows of one length form a class with its
own tables. Symbols are the benchmark's word numbers (0 for any other word) and a block is two symbols (one, for
windows of one word). SHIFT, indexed by a block's hash, says how far the search may advance from a position that
ends in that block without passing over the end of any window. Where it is 0, the windows that end there are those of the
suffix block's HASH bucket whose PREFIX, the hash of their first block, is that of the text; each of them is compared word by
word. The batch's words are cut into many lanes that advance together, each by its own shifts, so the loop runs in numpy.

The tables are as large as one block of items, ITEMS_MB of text at most, and are made once. A larger benchmark has several
blocks, and documents are read once all the same: a task takes BATCH_MB of text at a time and searches it block by block,
holding the tables of one. Nothing is dropped at any size.

Null and empty texts have no words, no hits and no items. Items without words, and items whose id is null, are
no patterns; items that share an id are one item, and a window of several items counts for each. Repeated documents are
searched alike; very long ones are searched alone. An empty benchmark hits nothing, and an empty document table gives an
empty result. Other columns stay; those that have the name of a result column are renamed by an underscore at the end.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE_BYTES, apart, mixed, sliced, worker

#: Bytes that are no part of a word are spaces here, and A-Z are lower case.
WORD_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WINDOW = 8
ITEMS_MB, BATCH_MB = 8, 32
#: Lanes of a search; candidates compared at a time.
LANES, CANDIDATES = 2048, 500_000
FOUND = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(WORD_TABLE).split() if text else []


class Searcher:
    """Tables of the windows of one length: `windows` has a row of symbols for each distinct window."""

    def __init__(self, windows: np.ndarray):
        self.m = m = windows.shape[1]
        self.b = b = min(2, m)
        self.bits = min(22, max(12, math.ceil(math.log2(len(windows) * m + 1)) + 3))
        keys = self._bucketed(windows)
        self.order = np.argsort(keys, kind="stable")
        self.windows, self.keys = windows[self.order], keys[self.order]
        self.shift = np.full(1 << self.bits, m - b + 1, np.int32)
        for end in range(b - 1, m):  # the nearest end wins
            np.minimum.at(self.shift, self._block(windows[:, end - 1] if b == 2 else None, windows[:, end]), m - 1 - end)

    def _block(self, a: np.ndarray | None, b: np.ndarray) -> np.ndarray:
        x = b.astype(np.uint64) if a is None else (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        return ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _bucketed(self, rows: np.ndarray) -> np.ndarray:
        """Of each row its suffix block's bucket, then its PREFIX: windows of one bucket lie together, by prefix."""
        suffix = self._block(rows[:, -2] if self.b == 2 else None, rows[:, -1])
        first = rows[:, 0].astype(np.uint64) << np.uint64(32) | rows[:, min(1, self.m - 1)].astype(np.uint64)
        return (suffix.astype(np.uint64) << np.uint64(40)) | (mixed(first) >> np.uint64(24))

    def ends(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of last symbols of windows in `text`, in order, and which window each is (number in the constructor's order)."""
        m, n = self.m, len(text)
        none = np.zeros(0, np.int64)
        if n < m:
            return none, none
        step = -(-(n - m + 1) // LANES)
        at = np.arange(m - 1, n, step)
        last = np.minimum(at + step, n)  # a lane covers the window ends from its start to here
        stops = []
        while len(at):
            shift = self.shift[self._block(text[at - 1] if self.b == 2 else None, text[at])]
            if (zero := shift == 0).any():
                stops.append(at[zero])
            at = at + np.maximum(shift, 1)
            if not (on := at < last).all():
                at, last = at[on], last[on]
        if not stops:
            return none, none
        stops = np.sort(np.concatenate(stops))
        stops = stops[(text[stops] > 0) & (text[stops - m + 1] > 0)]
        hits, which = [none], [none]
        for k in range(0, len(stops), CANDIDATES // 8):
            part = stops[k : k + CANDIDATES // 8]
            rows = text[part[:, None] + np.arange(1 - m, 1)]
            key = self._bucketed(rows)
            first = np.searchsorted(self.keys, key, "left")
            n = np.searchsorted(self.keys, key, "right") - first
            # every candidate of every stop, so many at a time
            upto = np.concatenate([[0], np.cumsum(n)])
            low = 0
            while low < len(part):
                high = max(low + 1, int(np.searchsorted(upto, upto[low] + CANDIDATES, "right")) - 1)
                at = np.repeat(np.arange(low, high), n[low:high])
                candidate = first[at] + np.arange(len(at)) - (upto[at] - upto[low])
                same = (self.windows[candidate] == rows[at]).all(axis=1)
                hits.append(part[at[same]])
                which.append(self.order[candidate[same]])
                low = high
        return np.concatenate(hits), np.concatenate(which)


class Benchmark:
    """The patterns of a block of items: (item id, text) pairs."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.names = sorted({i for i, t in items if i is not None})
        number = {x: k for k, x in enumerate(self.names)}
        self.vocabulary: dict[bytes, int] = {}
        told, lengths, owner = [], [], []
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            if item is not None and ids:
                told.append(np.array(ids, np.int32))
                lengths.append(len(ids))
                owner.append(number[item])
        text, lengths, owner = np.concatenate([*told, np.zeros(0, np.int32)]), np.array(lengths, np.int64), np.array(owner, np.int64)
        starts = np.cumsum(lengths) - lengths
        self.classes = []
        for m in np.unique(np.minimum(lengths, window)):
            some = np.minimum(lengths, window) == m
            n = lengths[some] - m + 1
            at = np.repeat(starts[some] - np.cumsum(n) + n, n) + np.arange(n.sum())
            windows, which = np.unique(text[at[:, None] + np.arange(m)], axis=0, return_inverse=True)
            # the owners of each window, one after another
            pairs = np.unique(which.reshape(-1) * len(self.names) + np.repeat(owner[some], n))
            bounds = np.searchsorted(pairs, np.arange(len(windows) + 1) * len(self.names))
            self.classes.append((Searcher(windows), bounds, pairs % len(self.names)))

    def search(self, texts: list[str | None]) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
        """For each text: its words, the maximal runs of hit words (start, end), the items with occurring windows."""
        get, ids, counts = self.vocabulary.get, [], []
        for text in texts:
            words = words_of(text)
            counts.append(len(words))
            ids.append(np.fromiter(map(get, words, repeat(0)), np.int32, len(words)))
            ids.append(np.zeros(1, np.int32))  # no window crosses it, as 0 is in none
        text = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        first = np.cumsum([0, *(c + 1 for c in counts)])
        edge, pairs = np.zeros(len(text) + 1, np.int64), []
        for searcher, starts, owners in self.classes:
            ends, which = searcher.ends(text)
            if not len(ends):
                continue
            np.add.at(edge, ends - searcher.m + 1, 1)
            np.add.at(edge, ends + 1, -1)
            doc = np.searchsorted(first, ends, "right") - 1
            seen = np.unique(doc * len(starts) + which)
            doc, which = seen // len(starts), seen % len(starts)
            n = starts[which + 1] - starts[which]
            at = np.repeat(starts[which] - np.cumsum(n) + n, n) + np.arange(n.sum())
            pairs.append(np.unique(np.repeat(doc, n) * len(self.names) + owners[at]))
        hit = np.diff(np.concatenate([[0], (np.cumsum(edge)[:-1] > 0).astype(np.int8), [0]]))
        runs = np.stack([np.flatnonzero(hit == 1), np.flatnonzero(hit == -1)], axis=1)
        out = [(c, [], []) for c in counts]
        for k, (a, b) in zip(np.searchsorted(first, runs[:, 0], "right") - 1, runs.tolist(), strict=True):
            out[k][1].append((a - int(first[k]), b - int(first[k])))
        for x in np.unique(np.concatenate(pairs)).tolist() if pairs else []:
            out[x // len(self.names)][2].append(self.names[x % len(self.names)])
        return out


def _joined(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of two lists of runs, as maximal runs."""
    out: list[list[int]] = []
    for s, e in sorted([*a, *b]):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def item_blocks(benchmark: DataFrame, item: str, text: str, limit_mb: float) -> list[DataFrame]:
    """The benchmark in blocks of about `limit_mb` of text, dealt by the items' hash."""
    rows = benchmark.where(F.col(item).isNotNull()).select(F.col(item).cast("string").alias("item"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / (limit_mb * 1e6)))
    return [rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) for k in range(n)]


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, limit_mb: float = ITEMS_MB, prefix: str = "") -> DataFrame:
    """`docs` with n_words, hits (maximal runs of hit words) and items (ids of items with occurring windows, sorted as strings)."""
    names = [prefix + c for c in ("n_words", "hits", "items")]
    docs = apart(docs, names)
    at = docs.columns.index(text)
    out = T.StructType([*docs.schema.fields, T.StructField(names[0], T.LongType()), T.StructField(names[1], FOUND), T.StructField(names[2], T.ArrayType(T.StringType()))])
    kinds = [pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.string())]
    share = docs.sparkSession.sparkContext.broadcast
    # ITEMS_MB of text at most come to the driver at a time
    tables = [share(Benchmark([tuple(r) for r in block.collect()], window)) for block in item_blocks(benchmark, item, item_text, limit_mb)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in sliced(b, at, BATCH_MB * 1_000_000 if len(tables) > 1 else SLICE_BYTES)):
            texts, found = batch.column(at).to_pylist(), []
            for shared in tables:
                more = shared.value.search(texts)
                if len(tables) > 1:
                    shared.__dict__.pop("_value", None)  # a worker holds one block's tables
                found = [(n, _joined(h, bh), sorted({*i, *bi})) for (n, h, i), (_, bh, bi) in zip(more, found, strict=True)] if found else more
            hits = pa.array([[{"start": a, "end": b} for a, b in h] for _, h, _ in found], kinds[0])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([n for n, _, _ in found], pa.int64()), hits, pa.array([i for _, _, i in found], kinds[1])], names=out.names)

    return docs.mapInArrow(worker(run), out)


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The contract's columns from the operator's."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, h: a + h["end"] - h["start"])
    n_items = F.size("items").cast("long")
    return found.select(key, "n_words", n_hit.alias("n_hit"), n_items.alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_items >= 2).alias("contaminated"))


WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def without_passages(text: str, hits: list[tuple[int, int]]) -> str:
    """`text` without the runs of words in `hits`; white space around a cut becomes one space."""
    raw, out, upto = text.encode(), [], 0
    places = [m.span() for m in WORD.finditer(raw)]
    for a, b in hits:
        out.append(raw[upto : places[a][0]].decode().rstrip(" "))
        upto = places[b - 1][1]
    out.append(raw[upto:].decode())
    return "".join(out)


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """`docs` without the rows in which windows of two or more items occur; in rows with windows of one item the hit
    passages are cut out of the text, and the length column, where there is one, is that of the new text."""
    prefix = "_leak_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix += "_"
    found = contamination(docs, benchmark, text, prefix=prefix).where(F.size(f"{prefix}items") < 2)
    found = found.select(*docs.columns, f"{prefix}hits")
    at, size = docs.columns.index(text), docs.columns.index(length) if length in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in sliced(b, at)):
            columns, hits = list(batch.columns[:-1]), batch.column(batch.num_columns - 1).to_pylist()
            if any(hits):
                old = columns[at].to_pylist()
                new = [without_passages(t, [(x["start"], x["end"]) for x in h]) if h else t for t, h in zip(old, hits, strict=True)]
                columns[at] = pa.array(new, columns[at].type)
                if size is not None:
                    columns[size] = pa.array([len(t) if h else n for t, h, n in zip(new, hits, columns[size].to_pylist(), strict=True)], columns[size].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return found.mapInArrow(worker(run), docs.schema)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS TEXT) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
p AS (SELECT DISTINCT item, least(len(w), 8) AS m, array_to_string(w[i : i + least(len(w), 8) - 1], ' ') AS g FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 8) + 2)) AS i FROM b WHERE len(w) > 0)),
g AS (SELECT rid, m, i, array_to_string(w[i : i + m - 1], ' ') AS g FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM p) WHERE len(w) >= m)),
f AS (SELECT rid, g.m, i, item FROM g JOIN p ON p.m = g.m AND p.g = g.g),
h AS (SELECT rid, count(DISTINCT x) AS n FROM (SELECT rid, unnest(range(i, i + m)) AS x FROM (SELECT DISTINCT rid, m, i FROM f)) GROUP BY rid),
t AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM f) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(t.n, 0) >= 2 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)
"""
