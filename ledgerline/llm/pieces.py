"""SentencePiece encoding and decoding by batched Viterbi.

A text's words are its runs of spaces with what follows, after the dummy space in front; no piece of the vocabulary
crosses them (checked on loading). Words that a worker has not met are encoded together: words of equal length are
rows of one matrix of code points; at each end position the substrings of every piece length are hashed from prefix
sums, the hashes probe the sorted keys of the pieces, and the vectorised maximum of score so far plus piece score
stores the length as backpointer. Following these back gives every word's best segmentation at once.

A unigram model's scores are its log probabilities. A BPE model's file holds merge ranks instead; their place is
taken by Zipf-Mandelbrot log probabilities of the ranks, so the result is the best segmentation into the model's
pieces under that law, not the merge order's (the README says how often they agree). Characters outside the
vocabulary are spelled in byte pieces, and so is U+2581, which otherwise would come back as a space: decoding gives
every text back exactly.

Null and empty texts have no ids, and decode to empty text. Repeated rows give equal ids. Of segmentations that tie, the one
whose last piece is the shortest is taken, at every position. Texts are encoded whole, some megabytes or one text at a time, so
a batch never has more ids than its lists can count. Words may be of any length; very long ones are segmented alone, in memory
linear in their length. An empty table gives an empty result. Other columns stay; those that have the name of a result column
are renamed by an underscore at the end.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import apart, keeps, sliced, worker

SPACE = "▁"
#: Zipf-Mandelbrot offset and what each piece costs besides, for models that hold ranks.
OFFSET, EACH = 100.0, 8.0
#: Entries in the younger of a worker's two tables of encoded words; words of a matrix.
CACHE, ROWS = 150_000, 4096
WORDS = re.compile(" +[^ ]*")
_P = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """A vocabulary and a worker's tables."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bytes = np.full(256, sp.unk_id(), np.int64)
        self.out = [b""] * n
        normal = []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.out[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                normal.append((piece.replace(SPACE, " "), i, sp.get_score(i)))
                self.out[i] = normal[-1][0].encode()
        if any(" " in p.lstrip(" ") for p, _, _ in normal):
            raise ValueError("a piece of this vocabulary crosses words")
        if (self.bytes == sp.unk_id()).any():
            raise ValueError("this vocabulary has no byte pieces, so decoding would lose characters")
        scores = np.array([s for _, _, s in normal])
        ranks = -scores
        if np.array_equal(ranks, np.round(ranks)):  # whole numbers are merge ranks, not log probabilities
            scores = -np.log(ranks - ranks.min() + OFFSET) - EACH
        self.longest = max(len(p) for p, _, _ in normal)
        keys = np.array([self._key(p) for p, _, _ in normal], np.uint64)
        order = np.argsort(keys)
        self.keys, self.scores, self.ids = keys[order], scores[order], np.array([i for _, i, _ in normal], np.int64)[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a key")
        #: whether any key has these leading bits: most substrings are no pieces, and are told without a search
        self.leading = np.zeros(1 << 18, bool)
        self.leading[(self.keys >> np.uint64(46)).astype(np.int64)] = True
        self.powers = np.array([pow(int(_P), k, 1 << 64) for k in range(self.longest + 1)], np.uint64)
        #: a character in byte pieces costs more than any piece
        self.spelled = scores.min() * 2 - 10
        self.kind = "<u2" if n <= 1 << 16 else "<u4"
        self.table: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @staticmethod
    def _key(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_P) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def segment(self, words: list[str]) -> list[bytes]:
        """The best segmentation's ids of each word, as little-endian bytes."""
        out: list[bytes] = [b""] * len(words)
        sizes = np.array([len(w) for w in words])
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            step = max(1, ROWS * 16 // max(16, int(size)))
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                codes = np.frombuffer("".join(words[i] for i in part).encode("utf-32-le"), "<u4").reshape(len(part), size)
                for i, ids in zip(part, self._best(codes), strict=True):
                    out[i] = ids
        return out

    def _best(self, codes: np.ndarray) -> list[bytes]:
        n, size = codes.shape
        # h[e] is the hash of the first e characters; that of [s, e) is h[e] - h[s] p**(e - s)
        h = np.zeros((size + 1, n), np.uint64)
        for e in range(size):
            h[e + 1] = h[e] * _P + codes[:, e] + np.uint64(1)
        best = np.full((size + 1, n), -np.inf)
        best[0] = 0
        back, which = np.zeros((size + 1, n), np.int32), np.full((size + 1, n), -1, np.int64)
        literal, last = codes == ord(SPACE), len(self.keys) - 1
        for e in range(1, size + 1):
            best[e], back[e] = best[e - 1] + self.spelled, 1
            for k in range(1, min(self.longest, e) + 1):
                power = self.powers[k]
                key = h[e] - h[e - k] * power
                rows = np.flatnonzero(self.leading[(key >> np.uint64(46)).astype(np.int64)])
                key = key[rows]
                at = np.minimum(np.searchsorted(self.keys, key), last)
                good = self.keys[at] == key
                if k == 1:
                    good &= ~literal[rows, e - 1]
                rows, at = rows[good], at[good]
                score = best[e - k, rows] + self.scores[at]
                better = score > best[e, rows]
                rows = rows[better]
                best[e, rows], back[e, rows], which[e, rows] = score[better], k, self.ids[at[better]]
        # one path for all words: each still at position e takes its piece
        at, parts = np.full(n, size), []
        while (on := np.flatnonzero(at > 0)).size:
            e = at[on]
            parts.append((on, which[e, on], codes[on, e - 1]))
            at[on] = e - back[e, on]
        found: list[list[int]] = [[] for _ in range(n)]
        for on, ids, chars in parts:
            for i, x, c in zip(on.tolist(), ids.tolist(), chars.tolist(), strict=True):
                if x >= 0:
                    found[i].append(x)
                else:
                    found[i] += self.bytes[list(reversed(chr(c).encode()))].tolist()
        return [np.array(f[::-1], self.kind).tobytes() for f in found]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as little-endian bytes."""
        if len(self.table) > CACHE:
            self.table, self.old = {}, self.table
        table, words = self.table, []
        for t in texts:
            if not t:
                words.append([])
            elif "  " in t or t[0] == " " or t[-1] == " ":
                words.append([w[1:] for w in WORDS.findall(" " + t)])
            else:
                words.append(t.split(" "))
        new = set().union(*words) - table.keys()
        table.update((w, self.old[w]) for w in new if w in self.old)
        if new := [w for w in new if w not in table]:
            table.update(zip(new, self.segment([" " + w for w in new]), strict=True))
        return [b"".join(map(table.__getitem__, w)) for w in words]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.out.__getitem__, ids.tolist())).decode(errors="replace")[1:]


_loaded: dict[str, Pieces] = {}


def _empty() -> None:
    for p in _loaded.values():
        p.table, p.old = {}, {}


keeps("pieces", _empty)


def pieces(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def encoded(docs: DataFrame, model: str, text: str = "text", ids: str = "ids", verify: bool = False) -> DataFrame:
    """`docs` with its texts' ids, an array of int; with `verify` also n_pieces, ids_crc32 (of little-endian unsigned 32-bit ids) and round_trip, whether decoding gave the text."""
    docs = apart(docs, [ids, *(["n_pieces", "ids_crc32", "round_trip"] if verify else [])])
    at, fields = docs.columns.index(text), docs.schema.fields
    more = [T.StructField(ids, T.ArrayType(T.IntegerType()))]
    if verify:
        more += [T.StructField("n_pieces", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("round_trip", T.BooleanType())]
    out = T.StructType([*fields, *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for batch in (x for b in batches for x in sliced(b, at)):
            texts = batch.column(at).to_pylist()
            found = [np.frombuffer(x, p.kind) for x in p.encode(texts)]
            offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
            rows = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *found]).astype(np.int32)))]
            if verify:
                rows += [pa.array(np.diff(offsets).astype(np.int64)), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in found], pa.int64())]
                rows.append(pa.array([p.decode(x) == (t or "") for x, t in zip(found, texts, strict=True)]))
            yield pa.RecordBatch.from_arrays([*batch.columns, *rows], names=out.names)

    return docs.mapInArrow(worker(run, "pieces"), out)


def decoded(rows: DataFrame, model: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """`rows` with the text of their ids; null ids are null text."""
    rows = apart(rows, [text])
    at, fields = rows.columns.index(ids), rows.schema.fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for batch in batches:
            texts = [None if x is None else p.decode(np.array(x, np.int64)) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*(f.name for f in fields), text])

    return rows.mapInArrow(worker(run, "pieces"), T.StructType([*fields, T.StructField(text, T.StringType())]))


def brute_force(p: Pieces, word: str) -> float:
    """The best score of a word (with its spaces) by plain dynamic programming, for tests."""
    score = {bytes(p.out[i]).decode(): s for i, s in zip(p.ids.tolist(), p.scores.tolist(), strict=True)}
    best = [0.0]
    for e in range(1, len(word) + 1):
        options = [best[e - 1] + p.spelled]
        options += [best[s] + score[word[s:e]] for s in range(max(0, e - p.longest), e) if word[s:e] in score and word[s:e] != SPACE]
        best.append(max(options))
    return best[-1]
