"""Token ids as raw binary shards with a minimal perfect hash index.

A store is a folder of shards in ascending key order. Shard k has three files:

* ``k.ids``   the ids of its documents one after another, little-endian unsigned, 2 bytes each where the
              vocabulary has at most 65,536 ids and 4 bytes otherwise;
* ``k.keys``  the documents' keys in the same order, little-endian signed 64-bit;
* ``k.mph``   the index: a minimal perfect hash over (key, number of the document among those of its key), as levels
              of bit arrays, each 64 bits beside the bits set before them; a document's slot is the rank of its bit.
              By slot, a record of a 32-bit fingerprint, the first id's offset, the number of ids and, for a key's
              first document, how many documents carry the key.

Every document, those of repeated and of null keys included, has a slot, and offsets and lengths stand nowhere else:
what is read back, in order or by key, goes through the slots. A lookup hashes the key once for each level (1.6 on
average), reads one word a level and one record by ranged reads, compares the fingerprint and reads the ids: constant
time whatever the shard's size. A foreign key passes the fingerprint once in 2**32. Which shard may hold a key is a
binary search in the manifest, a row for each shard.

Shards come from one range partitioning by key, so they can be written side by side; names are fixed by the
partition, and a file appears under its name only when complete, so tasks may be retried anywhere. Rows with a
null key come first in the store and have slots, though no key to ask for. Null text is empty text, which has the end
id alone. Repeated keys and rows, ties included, are all kept, in ascending order of their text's hash; a lookup gives
the first. Texts may be of any length: TOGETHER bytes are encoded at a time, or one text. An empty table gives an empty
store and an empty result. Only the key and the text are read, so other columns may have any name. A special token's
string in a text becomes that token, as the library has it by default; `specials=False` makes it ordinary text.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keeps, mixed, scratch, sliced, worker

MAGIC = b"LLMPH2\n\0"
#: Bits in a level for each key that is left, and the most levels before keys are listed outright.
GAMMA, LEVELS = 2.0, 40
#: Entries in the younger of a worker's two tables of encoded words; when it is full it becomes the older one, and the
#: older goes. What a text's ids are does not depend on it.
CACHE = 500_000
#: Words that the library encodes at a time; bytes of text whose distinct words are numbered together, or one text.
WORDS, TOGETHER = 512, 16_000_000
#: A level's 64 bits beside the number of bits before them; what stands by slot.
LEVEL = np.dtype([("bits", "<u8"), ("before", "<u4")])
RECORD = np.dtype([("print", "<u4"), ("offset", "<u8"), ("length", "<u4"), ("copies", "<u4")])


class PerfectHash:
    """Maps n distinct unsigned 64-bit keys to 0..n-1, each number once."""

    def __init__(self, sizes: list[int], words: np.ndarray, ranks: np.ndarray, rest: np.ndarray):
        self.sizes, self.words, self.ranks, self.rest = sizes, words, ranks, rest
        self.bases = np.concatenate([[0], np.cumsum([-(-s // 64) * 64 for s in sizes])]).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, sizes, levels = np.unique(keys.astype(np.uint64)), [], []
        while len(left) and len(sizes) < LEVELS:
            size = max(64, int(len(left) * GAMMA))
            at = (mixed(left, len(sizes) + 1) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            bits = np.zeros(-(-size // 64) * 64, bool)
            bits[:size] = alone
            levels.append(np.packbits(bits, bitorder="little").view("<u8"))
            sizes.append(size)
            left = left[~alone[at]]
        words = np.concatenate(levels) if levels else np.zeros(0, "<u8")
        counts = np.bitwise_count(words).astype(np.int64)
        return cls(sizes, words, (np.cumsum(counts) - counts).astype("<u4"), left)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for one that surely is foreign."""
        keys = keys.astype(np.uint64)
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for k, size in enumerate(self.sizes):
            if not len(open_):
                break
            at = (mixed(keys[open_], k + 1) % np.uint64(size)).astype(np.int64) + self.bases[k]
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = word & ((np.uint64(1) << bit) - np.uint64(1))
            out[open_[hit]] = (self.ranks[at >> 6].astype(np.int64) + np.bitwise_count(below))[hit]
            open_ = open_[~hit]
        if len(open_) and len(self.rest):
            at = np.searchsorted(self.rest, keys[open_])
            hit = self.rest[np.minimum(at, len(self.rest) - 1)] == keys[open_]
            total = int(self.ranks[-1]) + int(np.bitwise_count(self.words[-1])) if len(self.words) else 0
            out[open_[hit]] = total + at[hit]
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys, 0x5EED) >> np.uint64(32)).astype("<u4")


def occurrences(keys: np.ndarray) -> np.ndarray:
    """Of each key its number among its equals, which lie together."""
    if not len(keys):
        return np.zeros(0, np.int64)
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.arange(len(keys))
    return at - at[new][np.cumsum(new) - 1]


def entries(keys: np.ndarray, nulls: int, seed: int) -> np.ndarray:
    """The number that the index knows each document by, in file order: the key itself for its first document."""
    out = keys.view(np.uint64).copy()
    number = occurrences(keys[nulls:])
    again = np.flatnonzero(number) + nulls
    out[again] = mixed(mixed(out[again], seed) + number[again - nulls].astype(np.uint64), seed + 1)
    out[:nulls] = mixed(np.arange(nulls, dtype=np.uint64), seed + 2)
    return out


def pack_index(keys: np.ndarray, nulls: int, lengths: np.ndarray, width: int) -> bytes:
    """The .mph file of documents in file order, the first `nulls` of them without a key."""
    seed = 1
    while len(np.unique(known := entries(keys, nulls, seed))) < len(known):  # two documents under one number: another seed
        seed += 3
    mph = PerfectHash.build(known)
    records = np.zeros(len(known), RECORD)
    slot = mph.slots(known)
    records["print"][slot], records["offset"][slot], records["length"][slot] = fingerprints(known), np.cumsum(lengths) - lengths, lengths
    number = occurrences(keys[nulls:])
    firsts = np.flatnonzero(number == 0)
    records["copies"][slot[firsts + nulls]] = np.diff(np.append(firsts, len(number)))
    levels = np.zeros(len(mph.words), LEVEL)
    levels["bits"], levels["before"] = mph.words, mph.ranks
    head = json.dumps({"width": width, "documents": len(keys), "nulls": nulls, "seed": seed, "ids": int(lengths.sum()), "sizes": mph.sizes, "words": len(mph.words), "rest": len(mph.rest)}).encode()
    return b"".join([MAGIC, len(head).to_bytes(4, "little"), head, levels.tobytes(), mph.rest.astype("<u8").tobytes(), records.tobytes()])


class Shard:
    """One shard, opened for keyed access by ranged reads, and for reading in order."""

    def __init__(self, root: str, name: str):
        self.fs, path = pafs.FileSystem.from_uri(root)
        self.base = f"{path}/{name}"
        self.index = self.fs.open_input_file(self.base + ".mph")
        start = self.index.read_at(12, 0)
        if start[:8] != MAGIC:
            raise ValueError(f"{self.base}.mph is no index")
        n = int.from_bytes(start[8:12], "little")
        self.meta = m = json.loads(self.index.read_at(n, 12))
        self.levels = 12 + n
        self.rest = self.levels + m["words"] * LEVEL.itemsize
        self.records = self.rest + 8 * m["rest"]
        self.kind = f"<u{m['width']}"

    def _array(self, kind: np.dtype | str, count: int, at: int) -> np.ndarray:
        return np.frombuffer(self.index.read_at(count * np.dtype(kind).itemsize, at), kind)

    def keys(self) -> np.ndarray:
        with self.fs.open_input_file(self.base + ".keys") as f:
            return np.frombuffer(f.read(), "<i8")

    def slot(self, key: int) -> int:
        """The slot of a key, by a ranged read a level; -1 for a key that surely is foreign."""
        x, base = np.array([key], np.int64).view(np.uint64), 0
        for k, size in enumerate(self.meta["sizes"]):
            at = int(mixed(x, k + 1)[0] % np.uint64(size))
            word = self._array(LEVEL, 1, self.levels + (base + at // 64) * LEVEL.itemsize)[0]
            bits = int(word["bits"])
            if bits >> at % 64 & 1:
                return int(word["before"]) + (bits & ((1 << at % 64) - 1)).bit_count()
            base += -(-size // 64)
        rest = self._array("<u8", self.meta["rest"], self.rest)
        at = int(np.searchsorted(rest, x[0]))
        return self.meta["documents"] - len(rest) + at if at < len(rest) and rest[at] == x[0] else -1

    def get(self, key: int) -> np.ndarray | None:
        """The ids of a key's first document."""
        slot = self.slot(key)
        if slot < 0:
            return None
        record = self._array(RECORD, 1, self.records + slot * RECORD.itemsize)[0]
        if record["print"] != fingerprints(np.array([key], np.int64).view(np.uint64))[0] or not record["copies"]:
            return None
        width = self.meta["width"]
        with self.fs.open_input_file(self.base + ".ids") as f:
            return np.frombuffer(f.read_at(int(record["length"]) * width, int(record["offset"]) * width), self.kind)

    def found(self, known: np.ndarray) -> np.ndarray:
        """The records of many documents by their numbers in the index; one that it lacks is an error."""
        m = self.meta
        levels = self._array(LEVEL, m["words"], self.levels)
        mph = PerfectHash(m["sizes"], levels["bits"].copy(), levels["before"].copy(), self._array("<u8", m["rest"], self.rest))
        slot = mph.slots(known)
        if (slot < 0).any():
            raise ValueError(f"{self.base}: the index lacks a document")
        out = self._array(RECORD, m["documents"], self.records)[slot]
        if not np.array_equal(out["print"], fingerprints(known)):
            raise ValueError(f"{self.base}: index and keys disagree")
        return out

    def documents(self, block: int = 1 << 22) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(key, offset in the shard, ids) in file order, each by its slot; reads a block at a time."""
        keys, nulls, width = self.keys(), self.meta["nulls"], self.meta["width"]
        records = self.found(entries(keys, nulls, self.meta["seed"]))
        starts, lengths = records["offset"].astype(np.int64), records["length"].astype(np.int64)
        if not np.array_equal(starts, np.cumsum(lengths) - lengths) or int(lengths.sum()) != self.meta["ids"]:
            raise ValueError(f"{self.base}: the index does not cover the ids")
        with self.fs.open_input_file(self.base + ".ids") as f:
            i = 0
            while i < len(keys):
                j = max(i + 1, int(np.searchsorted(starts, starts[i] + block, "left")))
                ids = np.frombuffer(f.read_at(int(lengths[i:j].sum()) * width, int(starts[i]) * width), self.kind)
                for k in range(i, j):
                    yield None if k < nulls else int(keys[k]), int(starts[k]), ids[starts[k] - starts[i] : starts[k] - starts[i] + lengths[k]]
                i = j


_encoders: dict[tuple[str, bool], _Encoder] = {}
#: White space on both sides of a space, or two spaces; what more than the library's this counts as white space does no harm.
_WHITE = "[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_CROSSING = f"{_WHITE} {_WHITE}|  "
_MARKS = ",.!?;:"
#: Letters below are one piece to the pre-tokenizer in every version of Unicode.
_PLAIN_BELOW = "\u0250"


class _Encoder:
    """Encodes whole texts with the tokenizers library, each distinct space-led word once for a batch and worker.

    The byte-level pre-tokenizer ties a single space to what follows it, so a text is the concatenation of its
    space-led words wherever no other white space touches a space; other texts, and those with a special token's string,
    go to the library whole. Arrow splits a batch's texts and numbers their distinct words. Words of letters, which are one
    piece to the pre-tokenizer, go to the library's model, all others through the whole library.
    """

    def __init__(self, path: str, specials: bool = True):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not specials
        self.model = self.tokenizer.model
        config = json.loads(self.tokenizer.to_str())
        cut = config["pre_tokenizer"] or {}
        #: whether a text may be cut at spaces at all
        self.cuts = not config["normalizer"] and cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space") and config["model"]["type"] == "BPE" and not config["model"].get("dropout")
        self.specials = [t["content"] for t in config["added_tokens"] if specials or not t["special"]]
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = "<u2" if size <= 1 << 16 else "<u4"
        self.bytes = [k.to_bytes(int(self.kind[2]), "little") for k in range(size)]
        # how the pre-tokenizer spells characters of two bytes
        spell = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.spelled = {c: spell(chr(c))[0][0] for c in range(0x80, ord(_PLAIN_BELOW))}
        self.space = spell(" ")[0][0]
        self.table: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        #: the same for words without a space before them
        self.heads: dict[str, bytes] = {}
        self.old_heads: dict[str, bytes] = {}
        self.feed, *marks = self._ids(["\n", *_MARKS])
        self.marks = dict(zip(_MARKS, marks, strict=True))

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: str, head: bool) -> bytes | None:
        """The ids of a word by its parts, or None for one that the whole library has to see."""
        table, old, space = (self.heads, self.old_heads, "") if head else (self.table, self.old, self.space)
        if (found := old.get(word)) is None:
            if word.isalpha() and ((plain := word.isascii()) or max(word) < _PLAIN_BELOW):
                b = self.bytes
                found = b"".join([b[t.id] for t in self.model.tokenize(space + (word if plain else word.translate(self.spelled)))])
            elif word[-1:] in self.marks and (body := word[:-1]).isalpha() and (body.isascii() or max(body) < _PLAIN_BELOW):
                # letters and a mark are separate to the pre-tokenizer
                found = (table.get(body) or self._word(body, head)) + self.marks[word[-1]]
            elif "\n" in word:
                # so is a line feed between two lines that have no white space beside it
                parts = word.split("\n")
                if not all(x and not x[0].isspace() and not x[-1].isspace() for x in (parts if parts[-1] else parts[:-1])):
                    return None
                lines = [table.get(parts[0]) or self._word(parts[0], head), *((self.heads.get(x) or self._word(x, True)) if x else b"" for x in parts[1:])]
                if None in lines:
                    return None
                found = self.feed.join(lines)
            else:
                return None
        table[word] = found
        return found

    def _all(self, words: list[str], head: bool) -> list[bytes]:
        """The ids of every word, by the tables and then by what they lack."""
        table = self.heads if head else self.table
        out = list(map(table.get, words))
        hard = []
        for k in [k for k, ids in enumerate(out) if ids is None]:
            out[k] = self._word(words[k], head)
            if out[k] is None:
                hard.append(k)
        for i in range(0, len(hard), WORDS):
            part = hard[i : i + WORDS]
            for k, ids in zip(part, self._ids([("" if head else " ") + words[k] for k in part]), strict=True):
                out[k] = table[words[k]] = ids
        return out

    def encode(self, texts: pa.Array) -> list[bytes | memoryview]:
        """The ids of each text (none of them null), as little-endian bytes."""
        if not len(texts):
            return []
        if len(self.table) + len(self.heads) > CACHE:
            self.table, self.old, self.heads, self.old_heads = {}, self.table, {}, self.heads
        aside = pc.match_substring_regex(texts, _CROSSING) if self.cuts else pa.array(np.ones(len(texts), bool))
        for s in self.specials:
            aside = pc.or_(aside, pc.match_substring(texts, s))
        whole = np.flatnonzero(aside.to_numpy(zero_copy_only=False)).tolist()
        wholes = dict(zip(whole, self._ids([texts[k].as_py() for k in whole]), strict=True)) if whole else {}
        lists = pc.split_pattern(pc.if_else(aside, "", texts) if whole else texts, " ")
        flat, bounds = lists.flatten().dictionary_encode(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        words, codes = flat.dictionary.to_pylist(), flat.indices.to_numpy().copy()
        firsts = bounds[:-1]
        values = self._all(words, False) + self._all([words[c] for c in codes[firsts].tolist()], True)
        codes[firsts] = len(words) + np.arange(len(firsts))  # a text's first word has no space before it
        ids = pa.array(values, pa.large_binary()).take(pa.array(codes))
        ends = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1][bounds].tolist()
        raw = memoryview(ids.buffers()[2] or b"")
        return [wholes[k] if k in wholes else raw[ends[k] : ends[k + 1]] for k in range(len(texts))]


def _empty() -> None:
    for e in _encoders.values():
        e.table, e.old, e.heads, e.old_heads = {}, {}, {}, {}


keeps("ids", _empty)


def encoder(path: str, specials: bool = True) -> _Encoder:
    if (path, specials) not in _encoders:
        _encoders[path, specials] = _Encoder(path, specials)
    return _encoders[path, specials]


_SHARDS = "name string, documents long, ids long, first_key long, last_key long"


def write_store(docs: DataFrame, root: str, tokenizer: str, end_id: int | None = 2, key: str = "doc_id", text: str = "text", shards: int | None = None, specials: bool = True) -> list[dict]:
    """Encodes every whole text and writes the store under `root`; returns the manifest, a row for each shard."""
    spark = docs.sparkSession
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    rows = rows.repartitionByRange(n, "k", "h").sortWithinPartitions("k", "h").select("k", "t")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, fs, out, name = encoder(tokenizer, specials), None, None, f"{TaskContext.get().partitionId():06d}"
        tail = b"" if end_id is None else np.array([end_id], enc.kind).tobytes()
        width, keys, valid, lens = int(enc.kind[2]), [], [], []
        temp = f".{name}.{TaskContext.get().taskAttemptId()}"
        for part in (x for b in batches for x in sliced(b, 1, TOGETHER)):
            if out is None:
                fs, path = pafs.FileSystem.from_uri(root)
                fs.create_dir(path, recursive=True)
                out = fs.open_output_stream(f"{path}/{temp}.ids")
            column = part.column(0)
            keys.append(column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            valid.append(column.is_valid().to_numpy(zero_copy_only=False))
            ids = enc.encode(part.column(1))
            lens.append(np.array([len(x) // width + bool(tail) for x in ids], np.int64))
            out.write(tail.join([*ids, b""]))
        if out is None:
            return
        out.close()
        keys, valid, lens = (np.concatenate(x) for x in (keys, valid, lens))
        nulls = int((~valid).sum())  # they come first
        for suffix, raw in ((".keys", keys.astype("<i8").tobytes()), (".mph", pack_index(keys, nulls, lens, width))):
            with fs.open_output_stream(f"{path}/{temp}{suffix}") as f:
                f.write(raw)
        for suffix in (".ids", ".keys", ".mph"):
            fs.move(f"{path}/{temp}{suffix}", f"{path}/{name}{suffix}")
        ends = keys[valid][[0, -1]].tolist() if valid.any() else [None, None]
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(keys)]), pa.array([int(lens.sum())]), pa.array(ends[:1], pa.int64()), pa.array(ends[1:], pa.int64())], ["name", "documents", "ids", "first_key", "last_key"])

    # One row for each shard comes to the driver, never one for each document.
    return sorted((r.asDict() for r in rows.mapInArrow(worker(write, "ids"), _SHARDS).collect()), key=lambda r: r["name"])


def read_store(spark: SparkSession, root: str, manifest: list[dict]) -> DataFrame:
    """key, start (ids of all documents before), n_tokens and ids_crc32 of each document, from the files."""
    start, rows = 0, []
    for m in manifest:
        rows.append((m["name"], start))
        start += m["ids"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys, starts, counts, sums = [], [], [], []
                for k, offset, ids in Shard(root, name).documents():
                    keys.append(k)
                    starts.append(base + offset)
                    counts.append(len(ids))
                    sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (keys, starts, counts, sums)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    shards = spark.createDataFrame(rows, "name string, base long")
    return shards.repartition(max(1, len(rows))).mapInArrow(worker(read, "ids"), "doc_id long, start long, n_tokens long, ids_crc32 long")


def get(root: str, manifest: list[dict], key: int) -> np.ndarray | None:
    """Keyed access: the manifest's key ranges, which ascend, name the shard, its index the place."""
    keyed = [m for m in manifest if m["first_key"] is not None]
    k = bisect_left(keyed, key, key=lambda m: m["last_key"])
    return Shard(root, keyed[k]["name"]).get(key) if k < len(keyed) and keyed[k]["first_key"] <= key else None


def token_index(docs: DataFrame, tokenizer: str, end_id: int | None = 2, specials: bool = True) -> DataFrame:
    """Writes the store of `docs` in the shared folder and reads it back."""
    root = scratch(docs.sparkSession, "ids")
    return read_store(docs.sparkSession, root, write_store(docs, root, tokenizer, end_id, specials=specials))
