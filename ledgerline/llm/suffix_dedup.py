"""Removal of every byte covered by a string of LENGTH bytes that starts anywhere else, by sorting sampled suffixes.

Suffixes are sampled by content: a position is an anchor if the hash of its leading K bytes is the least of W
consecutive ones, W = LENGTH - K + 1. Every string of LENGTH bytes holds an anchor that follows from the string
alone, so two equal strings hold equal anchors at equal offsets, and comparing anchors loses nothing.

1. A suffix goes out as its leading HEAD bytes in words of eight, the fingerprint of its leading K bytes, the fingerprint of
   the whole context of W - 1 bytes before and LENGTH after, and its place. Splitters sampled from the suffixes
   range-partition them by these leading words; a bucket is sorted by multikey quicksort, word by word, and neighbours in
   it are compared. Suffixes whose context occurs twice lie inside a repeat: all their windows are covered. One whose
   leading K bytes occur once is in none. Groups at a bucket's ends, which may go on in the next bucket, are compared across
   boundaries by aggregation and join, however large they are. There are as many buckets as keep each at BUCKET suffixes.
2. The other suffixes, at the edges of repeats, fetch their contexts, one for each distinct text and place. Those of equal
   leading bytes meet once more and compare the fingerprints of every window of LENGTH bytes around them, offset by
   offset, without pairs. A group of more than GROUP contexts does not meet: its contexts send out, for each RANGE of
   offsets, the fingerprint of what all windows of the range share and of all that they span. If the span occurs twice all
   its windows do, if the shared part occurs once none does; only the windows of the ranges between, and of one context for
   each repeated span, are counted one by one.
3. The covered intervals come together by document, and the text gives them up.

Fingerprints have 64 bits. Documents are identified by a 64-bit fingerprint and their length, so equal documents share
their result. Null text is empty text. Texts of fewer than LENGTH bytes lose nothing, and matches never cross
documents. Very long texts are cut into overlapping blocks for sampling. Null ids and tied ids are kept as they are. Repeated
rows are repeats of each other. An empty table gives an empty result. Only the id and the text are read, so other columns may
have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, sifted, sliced, stored, worker

LENGTH, K, HEAD = 200, 64, 16
W = LENGTH - K + 1
#: Suffixes of a bucket, about; a part of it that is small enough is sorted at once.
BUCKET, SMALL = 1_000_000, 4096
#: Contexts of equal leading bytes that meet in one task at most; offsets that those of a larger group compare together.
GROUP, RANGE = 500, 17
#: Contexts that are worked on together, and windows fingerprinted at a time.
TOGETHER, CELLS = 2000, 300_000
#: Bytes of text that are worked on at a time; longer texts are cut with enough overlap for anchors and contexts.
BLOCK, OVERLAP = 1 << 19, 512
_P = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, 2 * BLOCK)
        _powers[:] = [np.concatenate([np.ones(1, np.uint64), np.full(n, p, np.uint64)]).cumprod() for p in (np.uint64(_P), np.uint64(pow(_P, -1, 1 << 64)))]
    return _powers[0], _powers[1]


class _Hashes:
    """Fingerprints of any range of a byte array, from prefix sums."""

    def __init__(self, raw: np.ndarray):
        power, self.inverse = _tables(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))

    def every(self, n: int) -> np.ndarray:
        return (self.sums[n:] - self.sums[:-n]) * self.inverse[: len(self.sums) - n]


def _slide(x: np.ndarray, n: int, op) -> np.ndarray:
    """op over every n consecutive values."""
    w = 1
    while 2 * w <= n:
        x = op(x[:-w], x[w:])
        w *= 2
    return op(x[: len(x) - n + w], x[n - w :]) if w < n else x


def anchors(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Place, text number, leading and context fingerprint of the anchors of texts that lie one after another in `raw`."""
    empty = np.zeros(0, np.int64)
    if len(raw) < LENGTH:
        return empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    hashes = _Hashes(raw)
    lead = ((hashes.every(K) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)).astype(np.uint32)
    lead ^= lead >> np.uint32(15)
    lead *= np.uint32(0x2C1B3C6D)
    lead ^= lead >> np.uint32(12)
    least = _slide(lead, W, np.minimum)
    # only windows of LENGTH bytes inside one text count; 0 is below every other value
    inside = np.zeros(len(raw) + 1, np.int32)
    starts, ends = bounds[:-1], bounds[1:]
    long = ends - starts >= LENGTH
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - LENGTH + 1, -1)
    least = np.where(np.cumsum(inside)[: len(least)] > 0, np.maximum(least, np.uint32(1)), np.uint32(0))
    side = np.zeros(W - 1, np.uint32)
    most = _slide(np.concatenate([side, least, side]), W, np.maximum)
    at = np.flatnonzero((np.maximum(lead, np.uint32(1)) == most[: len(lead)]) & (most[: len(lead)] > 0))
    text = np.searchsorted(bounds, at, "right") - 1
    # an anchor of a window in its own text only
    good = at + K <= ends[text]
    at, text = at[good], text[good]
    left, right = np.maximum(at - W + 1, starts[text]), np.minimum(at + LENGTH, ends[text])
    context = mixed(hashes.of(left, right) + (at - left).astype(np.uint64), 7)
    return at, text, hashes.of(at, at + K), context


def heads(raw: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The leading HEAD bytes at each place, in words whose order as integers is that of the bytes."""
    words = raw[at[:, None] + np.arange(HEAD)].reshape(-1, 8).view(">u8").reshape(len(at), HEAD // 8)
    return [(words[:, k].astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64) for k in range(HEAD // 8)]


def multikey_order(columns: list[np.ndarray]) -> np.ndarray:
    """The order of rows by their columns in turn, by multikey quicksort: a part is split in three by a pivot of one column, and only
    the middle one, equal in it, goes on to the next column."""
    order = np.arange(len(columns[0]))
    parts = [(0, len(order), 0)]
    while parts:
        low, high, depth = parts.pop()
        if high - low < 2 or depth == len(columns):
            continue
        rows = order[low:high]
        if high - low <= SMALL:
            order[low:high] = rows[np.lexsort([c[rows] for c in reversed(columns[depth:])])]
            continue
        x = columns[depth][rows]
        pivot = np.partition(x[:: max(1, len(x) // 31)], len(x[:: max(1, len(x) // 31)]) // 2)[len(x[:: max(1, len(x) // 31)]) // 2]
        less, more = rows[x < pivot], rows[x > pivot]
        order[low:high] = np.concatenate([less, rows[x == pivot], more])
        first, last = low + len(less), high - len(more)
        parts += [(low, first, depth), (first, last, depth + 1), (last, high, depth)]
    return order


def _identified(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, text, who, length: who and length, in bytes, stand for the text."""
    text_ = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).cast("long").alias("key"), text_.alias("text"), F.xxhash64(text_).alias("who"), F.octet_length(text_).cast("long").alias("length"))


def _pieces(rows: list[tuple[str, int, int]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of whole texts, or of parts of one: bytes, bounds; by text: identity, length, place in the whole, start and end of what counts."""
    parts, told, size = [], [], 0

    def block():
        bounds = np.cumsum([0, *map(len, parts)])
        return np.frombuffer(b"".join(parts), np.uint8), bounds, *(np.array([r[k] for r in told], np.int64) for k in range(5))

    for text, who, length in rows:
        if length < LENGTH:
            continue
        raw = text.encode()
        for start in range(0, len(raw), BLOCK):
            end = min(start + BLOCK, len(raw))
            low, high = max(0, start - OVERLAP), min(len(raw), end + OVERLAP)
            if size and size + high - low > BLOCK:
                yield block()
                parts, told, size = [], [], 0
            parts.append(raw[low:high])
            told.append((who, length, low, start - low, end - low))
            size += high - low
    if parts:
        yield block()


_SUFFIX = [*(f"w{k}" for k in range(HEAD // 8)), "lead", "context", "who", "at"]


def _anchors(docs: DataFrame) -> DataFrame:
    """A row for each sampled suffix; `at` holds the text's length and the place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in sliced(b, 0)):
            for raw, bounds, who, length, place, first, last in _pieces(list(zip(*(c.to_pylist() for c in batch.columns), strict=True))):
                at, text, lead, context = anchors(raw, bounds)
                own = at - bounds[text]
                keep = (own >= first[text]) & (own < last[text])
                at, text, lead, context = at[keep], text[keep], lead[keep], context[keep]
                rows = [*heads(raw, at), lead.view(np.int64), context.view(np.int64), who[text], (length[text] << 32) | (at - bounds[text] + place[text])]
                yield pa.RecordBatch.from_arrays([pa.array(r) for r in rows], _SUFFIX)

    return docs.select("text", "who", "length").mapInArrow(worker(run), ", ".join(f"{c} bigint" for c in _SUFFIX))


#: What becomes of an anchor: inside a repeat; to be compared by its context; both (the one that stands for equal contexts). At a
#: bucket's ends: undecided alone; the one that stands for several of equal context, which are inside a repeat already.
INSIDE, COMPARE, BOTH, ALONE, MANY = 1, 2, 3, 0, 4
_MARKED = "lead bigint, context bigint, who bigint, at bigint, mark int"


def _marks(lead: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Marks of whole groups, sorted by lead and context; -1 for anchors in no repeat."""
    n = len(lead)
    new = np.ones(n, bool)
    new[1:] = lead[1:] != lead[:-1]
    run = new.copy()
    run[1:] |= context[1:] != context[:-1]
    group, runs = np.cumsum(new) - 1, np.cumsum(run) - 1
    twice = np.bincount(runs)[runs] > 1
    several = np.bincount(group[run])[group] > 1
    return np.where(several & run, np.where(twice, BOTH, COMPARE), np.where(twice, INSIDE, -1)).astype(np.int32)


def _bucketed(suffixes: DataFrame, n: int) -> DataFrame:
    """The suffixes of repeats with their marks, from `n` buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [np.stack([c.to_numpy() for c in b.columns]) for b in batches]
        if not sum(x.shape[1] for x in found):
            return
        columns = np.concatenate(found, axis=1)
        del found
        columns = columns[:, multikey_order(list(columns))]
        lead = columns[-4]
        new = np.flatnonzero((columns[: HEAD // 8 + 1, 1:] != columns[: HEAD // 8 + 1, :-1]).any(axis=0)) + 1
        rows = columns[-4:].T
        # the first and the last group may go on in the next bucket
        first, last = (int(new[0]), int(new[-1])) if len(new) else (len(lead), len(lead))
        yield _edge(rows[:first])
        for low in range(first, last, 200_000):  # whole groups, some at a time
            low, high = (new[min(np.searchsorted(new, x), len(new) - 1)] for x in (low, min(low + 200_000, last)))
            if low < high:
                yield _marked(rows[low:high], _marks(rows[low:high, 0], rows[low:high, 1]))
        if last < len(lead):
            yield _edge(rows[last:])

    return suffixes.repartitionByRange(n, *_SUFFIX).mapInArrow(worker(run), _MARKED)


def _edge(rows: np.ndarray) -> pa.RecordBatch:
    """Rows of one group at a bucket's end: equal contexts seen here are decided, and one of them stands for them at the boundary."""
    run = np.ones(len(rows), bool)
    run[1:] = rows[1:, 1] != rows[:-1, 1]
    twice = np.bincount(np.cumsum(run) - 1)[np.cumsum(run) - 1] > 1
    first = run & twice
    return _marked(np.concatenate([rows, rows[first]]), np.concatenate([np.where(twice, INSIDE, ALONE), np.full(first.sum(), MANY)]).astype(np.int32))


def _marked(rows: np.ndarray, mark: np.ndarray) -> pa.RecordBatch:
    keep = mark >= 0
    return pa.RecordBatch.from_arrays([*(pa.array(rows[keep, k]) for k in range(4)), pa.array(mark[keep])], ["lead", "context", "who", "at", "mark"])


def _across(rows: DataFrame) -> DataFrame:
    """Marks of the groups at the buckets' ends, a row for each context and bucket: the same rule, by aggregation and joins."""
    runs = stored(rows.groupBy("lead", "context").agg(F.sum(F.when(F.col("mark") == MANY, 2).otherwise(1)).alias("n"), F.min(F.struct("who", "at")).alias("one")), "runs")
    groups = stored(runs.groupBy("lead").agg(F.count(F.lit(1)).alias("several")), "groups")
    runs = stored(runs.join(groups.hint("merge"), "lead").where("n > 1 OR several > 1"), "runs")
    x = rows.drop("mark").join(runs.hint("merge"), ["lead", "context"])
    one = (F.col("several") > 1) & (F.col("one.who") == F.col("who")) & (F.col("one.at") == F.col("at"))
    mark = F.when(one, F.when(F.col("n") > 1, BOTH).otherwise(COMPARE)).when(F.col("n") > 1, INSIDE)
    return x.select("lead", "context", "who", "at", mark.cast("int").alias("mark")).where("mark IS NOT NULL")


def _contexts(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """lead, who, at, before, bytes, large: the contexts to compare, and whether they are of a group of more than GROUP."""
    wanted = marked.where(F.col("mark") >= COMPARE).select("lead", "who", "at").distinct()
    large = stored(wanted.groupBy("lead").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP).select("lead", F.lit(True).alias("large")), "large")
    wanted = wanted.join(large.hint("merge"), "lead", "left").withColumn("large", F.coalesce("large", F.lit(False)))
    wanted = wanted.select("who", F.shiftright("at", 32).alias("length"), F.struct(F.col("at").bitwiseAND(0xFFFFFFFF).alias("at"), "lead", "large").alias("a"))
    wanted = wanted.groupBy("who", "length").agg(F.collect_set("a").alias("a"))  # as many as the text has anchors at most
    # of equal texts one document gives the contexts
    place = [F.coalesce("key", F.lit(0)).alias("k"), F.col("key").isNull().alias("none"), "who", "length"]
    one = docs.where(F.col("length") >= LENGTH).groupBy("who", "length").agg(F.min("key").alias("key"))
    wanted = stored(wanted.join(one, ["who", "length"]).select(*place, "a"), "wanted")
    rows = sifted(docs.select(*place, "text"), wanted, ["k", "none", "who", "length"]).join(wanted.hint("merge"), ["k", "none", "who", "length"])
    rows = rows.select("text", "who", "length", F.col("a.at").alias("ats"), F.col("a.lead").alias("leads"), F.col("a.large").alias("larges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in sliced(b, 0)):
            for text, who, length, ats, leads, larges in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw, low = text.encode(), [max(0, a - W + 1) for a in ats]
                rows = [pa.array(leads, pa.int64()), pa.array([who] * len(ats), pa.int64()), pa.array([length << 32 | a for a in ats], pa.int64()), pa.array([a - s for a, s in zip(ats, low, strict=True)], pa.int32())]
                yield pa.RecordBatch.from_arrays([*rows, pa.array([raw[s : a + LENGTH] for a, s in zip(ats, low, strict=True)], pa.binary()), pa.array(larges, pa.bool_())], ["lead", "who", "at", "before", "bytes", "large"])

    return rows.mapInArrow(worker(run), "lead bigint, who bigint, at bigint, before int, bytes binary, large boolean")


def _windows(group: list[tuple], low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows at offsets low..high - 1 around each context's anchor that lie inside it: context, offset, fingerprint."""
    before, size = np.array([g[2] for g in group]), np.array([len(g[3]) for g in group])
    first = np.cumsum(size) - size
    o = np.arange(low, high)
    which, k = np.nonzero((before[:, None] >= o) & (size[:, None] - before[:, None] + o >= LENGTH))
    start = first[which] + before[which] - o[k]
    hashes = _Hashes(np.frombuffer(b"".join(g[3] for g in group), np.uint8))
    # equal windows have their anchor at the same offset; the offset keeps one place seen from two anchors apart
    return which, o[k], mixed(hashes.of(start, start + LENGTH) + o[k].astype(np.uint64), 3)


def covered(group: list[tuple]) -> list[tuple[int, int, int, int]]:
    """(who, length, start, end) of what repeats among contexts (who, at, before, bytes); those of equal leading bytes are all there."""
    group = list({(g[0], g[1]): g for g in group}.values())
    hit = np.zeros((len(group), W + 2), np.int8)
    step = max(1, CELLS // len(group))
    for low in range(0, W, step):
        which, o, prints = _windows(group, low, min(W, low + step))
        order = np.argsort(prints)
        same = prints[order[1:]] == prints[order[:-1]]
        for at in (order[1:][same], order[:-1][same]):
            hit[which[at], o[at] + 1] = 1
    out = []
    change = np.diff(hit, axis=1)
    for i, low, high in zip(*np.nonzero(change == 1), np.nonzero(change == -1)[1], strict=True):
        who, at = group[i][0], group[i][1] & 0xFFFFFFFF
        out.append((who, group[i][1] >> 32, int(at - high + 1), int(at - low + LENGTH)))
    return out


_INTERVAL = "who bigint, length bigint, start bigint, end bigint"


def _intervals(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(4)], ["who", "length", "start", "end"])


def _compared(contexts: DataFrame) -> DataFrame:
    """Covered intervals of groups that meet in a task."""
    rows = contexts.repartition("lead").sortWithinPartitions("lead")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # `done` holds whole groups, `group` the one that is being read
        at, done, group = None, [], []
        for batch in batches:
            for lead, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if lead != at:
                    done += group if len(group) > 1 else []
                    if len(done) >= TOGETHER:
                        yield _intervals(covered(done))
                        done = []
                    at, group = lead, []
                group.append(tuple(rest))
        done += group if len(group) > 1 else []
        if done:
            yield _intervals(covered(done))

    return rows.mapInArrow(worker(run), _INTERVAL)


#: Of a range of offsets: what its windows share, or what they span.
CORE, SPAN = 0, 1


def _ranges(contexts: DataFrame) -> DataFrame:
    """who, at, range, part, print: fingerprints of each range's parts, as far as the context holds a window of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(k, TOGETHER)
                who, at, before = (batch.column(i).to_numpy() for i in range(3))
                raw = batch.column(3).to_pylist()
                size = np.array([len(r) for r in raw])
                first, hashes = np.cumsum(size) - size + before, _Hashes(np.frombuffer(b"".join(raw), np.uint8))
                for low in range(0, W, RANGE):
                    high = min(low + RANGE, W) - 1  # offsets low to high
                    some = np.maximum(low, LENGTH - size + before) <= np.minimum(high, before)
                    full = (before >= high) & (size - before >= LENGTH - low)
                    for part, rows, left, right in ((CORE, some, low, LENGTH - high), (SPAN, full, high, LENGTH - low)):
                        i = np.flatnonzero(rows)
                        if len(i):
                            prints = mixed(hashes.of(first[i] - left, first[i] + right) + np.uint64(2 * low + part), 5)
                            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (who[i], at[i], np.full(len(i), low, np.int32), np.full(len(i), part, np.int32), prints.view(np.int64))], ["who", "at", "range", "part", "print"])

    return contexts.select("who", "at", "before", "bytes").mapInArrow(worker(run), "who bigint, at bigint, range int, part int, print bigint")


def _spread(contexts: DataFrame) -> DataFrame:
    """Covered intervals of groups too large to meet."""
    parts = stored(_ranges(contexts), "ranges")
    often = stored(parts.groupBy("print").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("who", "at")).alias("one")).where("n > 1").drop("n"), "often")
    shared = parts.join(often.hint("merge"), "print")
    # of those that share a span, one stands for all where windows are counted
    stands = (F.col("part") == SPAN) & (F.col("one.who") == F.col("who")) & (F.col("one.at") == F.col("at"))
    shared = stored(shared.groupBy("who", "at", "range").agg(F.max("part").alias("part"), F.max(stands).alias("stands")), "shared")
    at, length = F.col("at").bitwiseAND(0xFFFFFFFF), F.shiftright("at", 32)
    high = F.least(F.col("range") + RANGE, F.lit(W)) - 1
    whole = shared.where(F.col("part") == SPAN).select("who", length.alias("length"), (at - high).alias("start"), (at - F.col("range") + LENGTH).alias("end"))
    between = shared.where((F.col("part") == CORE) | F.col("stands")).groupBy("who", "at").agg(F.collect_list("range").alias("ranges"))  # W / RANGE at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(k, TOGETHER)
                group = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
                for low in range(0, W, RANGE):
                    part = [g for g in group if low in g[4]]
                    if part:
                        which, o, prints = _windows(part, low, min(low + RANGE, W))
                        who, place = (np.array([g[i] for g in part], np.int64)[which] for i in (0, 1))
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (who, place, o.astype(np.int32), prints.view(np.int64))], ["who", "at", "o", "print"])

    rows = contexts.select("who", "at", "before", "bytes").join(between.hint("merge"), ["who", "at"]).select("who", "at", "before", "bytes", "ranges")
    windows = stored(rows.mapInArrow(worker(run), "who bigint, at bigint, o int, print bigint"), "windows")
    twice = stored(windows.groupBy("print").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("print"), "twice")
    single = windows.join(twice.hint("merge"), "print").select("who", length.alias("length"), (at - F.col("o")).alias("start"), (at - F.col("o") + LENGTH).alias("end"))
    return whole.unionByName(single)


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, raw (the text's bytes) and spans (maximal covered runs of bytes) of every document."""
    docs = _identified(docs, key, text)
    size = docs.agg(F.sum("length")).first()[0] or 0
    # one of W positions or so is the least, twice that as neighbouring windows choose apart
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-2 * size // (W * BUCKET)))
    marked = stored(_bucketed(_anchors(docs), n), "marked")
    ends = F.col("mark").isin(ALONE, MANY)
    marked = marked.where(~ends).unionByName(stored(_across(marked.where(ends)), "marked"))
    contexts = stored(_contexts(docs, marked), "contexts")
    small = _compared(contexts.where(~F.col("large")).drop("large"))
    large = contexts.where("large")
    at = F.col("at").bitwiseAND(0xFFFFFFFF)
    inside = marked.where(F.col("mark").isin(INSIDE, BOTH)).select("who", F.shiftright("at", 32).alias("length"), F.greatest(at - (W - 1), F.lit(0)).alias("start"), F.least(at + LENGTH, F.shiftright("at", 32)).alias("end")).where(f"end - start >= {LENGTH}")
    spans = inside.unionByName(small) if large.isEmpty() else inside.unionByName(small).unionByName(_spread(large))
    # as many as the text has anchors, or windows, at most; a table, so that a text with a third of the rows can be split in the join
    spans = stored(spans.groupBy("who", "length").agg(F.collect_set(F.struct("start", "end")).alias("s")), "spans")
    rows = docs.join(spans.hint("merge"), ["who", "length"], "left").select("key", F.col("text").cast("binary").alias("raw"), F.col("s.start").alias("starts"), F.col("s.end").alias("ends"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in sliced(b, 1)):
            spans = [_merged(a, b) if a else [] for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], kind)], names=[key, "raw", "spans"])

    return rows.mapInArrow(worker(run), f"`{key}` bigint, raw binary, spans array<struct<start: bigint, end: bigint>>")


def _merged(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(zip(starts, ends, strict=True)):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The contract's columns from the operator's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in sliced(b, 1)):
            n, removed, runs, sums = [], [], [], []
            for raw, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                ends = [0, *(x for s in spans for x in (s["start"], s["end"])), len(raw)]
                n.append(len(raw))
                removed.append(sum(s["end"] - s["start"] for s in spans))
                runs.append(len(spans))
                sums.append(hashlib.sha256(b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n, removed, runs)), pa.array(sums, pa.string())], [key, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return found.select(key, "raw", "spans").mapInArrow(worker(run), f"`{key}` bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def brute_force(texts: list[str | None], length: int = LENGTH) -> list[tuple[int, int, int, str]]:
    """The contract's columns by a dictionary of all strings, for tests."""
    raws = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for r in raws:
        for i in range(len(r) - length + 1):
            seen[r[i : i + length]] = seen.get(r[i : i + length], 0) + 1
    out = []
    for r in raws:
        hit = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                hit[i : i + length] = b"\1" * length
        kept = bytes(c for c, h in zip(r, hit, strict=True) if not h)
        out.append((len(r), sum(hit), sum(1 for i, h in enumerate(hit) if h and (i == 0 or not hit[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


ORACLE = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT rid, k, substr(h, 1600 * k + 1, 1998) AS p FROM (SELECT rid, h, unnest(range(0, length(h) // 1600 + 1)) AS k FROM d WHERE length(h) >= 400)),
w AS (SELECT rid, 800 * k + j AS i, hash(substr(p, 2 * j + 1, 400)) AS g FROM (SELECT rid, k, p, unnest(range(0, least(800, length(p) // 2 - 199))) AS j FROM b WHERE length(p) >= 400)),
o AS (SELECT rid, i FROM w JOIN (SELECT g FROM w GROUP BY g HAVING count(*) > 1) USING (g)),
e AS (SELECT rid, i, CASE WHEN i > lag(i) OVER (PARTITION BY rid ORDER BY i) + 200 THEN 1 ELSE 0 END AS new FROM o),
n AS (SELECT rid, i, sum(new) OVER (PARTITION BY rid ORDER BY i) AS run FROM e),
r AS MATERIALIZED (SELECT rid, min(i) AS s, max(i) + 200 AS e FROM n GROUP BY rid, run),
t AS (SELECT rid, sum(e - s)::BIGINT AS removed, count(*)::BIGINT AS spans, max(e) AS last FROM r GROUP BY rid),
k AS (SELECT rid, s, substr(h, 2 * coalesce(lag(e) OVER (PARTITION BY rid ORDER BY s), 0) + 1, 2 * (s - coalesce(lag(e) OVER (PARTITION BY rid ORDER BY s), 0))) AS part FROM r JOIN d USING (rid)),
c AS (SELECT rid, string_agg(part, '' ORDER BY s) AS before FROM k GROUP BY rid)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(before, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN t USING (rid) LEFT JOIN c USING (rid)
"""
