"""Secret scan: fixed patterns, and strings that zstandard finds novel in a sensitive context.

Base kinds, leftmost and non-overlapping for each kind: ``assign``, ``access`` and ``hex``; a match that is too
short is dropped and not retried. The method adds kind ``novel``: a run of 16 or more token characters with both
letters and digits, after a sensitive word at most REACH code points before it, that overlaps no base span and
whose marginal compressed size is at least NOVELTY bytes for each character. Runs joined by single dots, as the parts
of a web token, share what stands before the first. A run that isn't reported whole is split at its equals signs, and
the name that a part is assigned to counts as standing before it. That size is the growth of a zstandard
frame when the candidate is appended to the text around it, with a compressor primed by a dictionary of
identifiers: whatever the dictionary or the surroundings hold already costs a few bytes, a random key its full
length.

The surroundings are AROUND code points on either side, a window like REACH and part of the definition: what lies further
off does not make a string less novel. Compressed sizes are whole bytes, so equal candidates in equal surroundings tie, and
all are reported.

Null text and empty text have no spans. A null id is kept as it is. Repeated rows give equal spans. Spans are in code points,
end exclusive. Whole texts are scanned, very long ones one by one, in time linear in their length. An empty table gives an
empty result. Other columns stay; one that is named spans is renamed by an underscore at the end.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import apart, sliced, worker

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_WORDS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: Bytes of a class become x; a run of them is then a substring.
_HEX_BYTES = bytes(120 if c in b"0123456789abcdef" else 32 for c in range(256))
_TOKEN_BYTES = bytes(120 if chr(c) in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=~-" else 32 for c in range(256))
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=~-]{16,}")
#: A part of a candidate between equals signs; those at the end are padding.
PART = re.compile(r"[A-Za-z0-9+/_~-]{16,}(?:=+\Z)?")
#: Runs of token characters joined by dots, onward and in reverse order.
ONWARD = re.compile(r"(?:\.[A-Za-z0-9+/_=~-]++)*+")
JOINED = re.compile(r"(?:\.[A-Za-z0-9+/_=~-]++)*+\.?")
SENSITIVE = re.compile(r"(?ai)pass|pwd|secret|token|api|key|credential|auth|bearer|private|signature|session|cookie|salt")
REACH, AROUND, NOVELTY = 40, 512, 0.8
IDENTIFIERS = (
    "password passwd secret token api_key apikey access_key private_key public_key client_secret client_id authorization bearer session cookie username"
    " credential signature encryption certificate connection configuration application environment production development repository implementation"
    " description parameters arguments attributes collection component container controller database dependency directory exception extension factory"
    " function generator handler identifier initialize interface iterator javascript library listener manager message metadata middleware namespace"
    " operation organization package permission position previous process property protocol provider reference register request resource response result"
    " schedule selector sequence serialize server service settings statement strategy structure template timestamp transaction transform undefined"
    " validation variable version visibility workspace abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 https://www.example.com/index.html"
    " xxxxxxxxxxxxxxxx 0000000000000000 ---------------- ================ ________________ self.return import class public static void const let var def"
).encode()
_primed: list[zstandard.ZstdCompressor] = []


def novelty(candidate: str, before: str, after: str) -> float:
    """Marginal compressed bytes for each byte of `candidate`, given the text on both sides and the identifiers."""
    if not _primed:
        _primed.append(zstandard.ZstdCompressor(level=19, dict_data=zstandard.ZstdCompressionDict(IDENTIFIERS, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False))
    around, raw = (after + "\n" + before).encode(), candidate.encode()
    return (len(_primed[0].compress(around + raw)) - len(_primed[0].compress(around))) / len(raw)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the fixed patterns."""
    out, low = [], text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"x" * 24 in text.encode().translate(_HEX_BYTES):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(out)


def novel_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if b"x" * 16 not in text.encode().translate(_TOKEN_BYTES):
        return []
    starts, ends = [x[0] for x in base], list(accumulate((x[2] for x in base), max))

    def secret(start: int, end: int, first: int) -> bool:
        word, k = text[start:end], bisect_left(starts, end)  # of the base spans that start before it, the furthest end decides
        if k and ends[k - 1] > start or word.isalpha() or not (any(c.isdigit() for c in word) and any(c.isalpha() for c in word)):
            return False
        # the parts of one token are no surroundings of each other
        after = text[end : end + AROUND]
        return novelty(word, text[max(0, first - AROUND) : first], after[ONWARD.match(after).end() :]) >= NOVELTY

    out, last, origin, near = [], 0, 0, False
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        first = start
        if text.startswith(".", start - 1, start):
            first -= JOINED.match(text[last:start][::-1]).end()
        if last and first == last < start:  # joined to the candidate before
            first = origin
        else:
            near = False
        origin = first
        near = near or any(SENSITIVE.search(text, max(0, at - REACH), at) for at in {first, start})
        last = end
        if near and secret(start, end, first):
            out.append((start, 3, end))
        elif "=" in m[0].rstrip("="):
            for part in PART.finditer(m[0]):
                s, e = start + part.start(), start + part.end()
                name = text.rfind("=", start, max(start, s - 1)) + 1 or start
                named = bool(s > start and SENSITIVE.search(text, min(name, max(0, s - REACH)), s))
                if (near or named) and secret(s, e, s if s > start else first):
                    out.append((s, 3, e))
                if e == end:
                    near = near or named
    return out


def joined(spans: list[tuple[int, int, int]], kinds: tuple[str, ...] = KINDS) -> str:
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in spans)


def redacted(text: str, spans: list[tuple[int, int, int]], names: tuple[str, ...] = ("SECRET",) * 4) -> str:
    """`text` with every span replaced by its kind's name in brackets; spans that overlap are replaced together."""
    out, upto = [], 0
    merged: list[list[int]] = []
    for s, k, e in sorted(spans):
        if merged and s < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], e)
        else:
            merged.append([s, k, e])
    for s, k, e in merged:
        out += [text[upto:s], f"[{names[k]}]"]
        upto = e
    return "".join([*out, text[upto:]])


def secret_spans(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """`docs` with spans, an array of (start, end, kind) by start, then kind as listed; kind is one of KINDS."""
    name = prefix + "spans"
    docs = apart(docs, [name])
    at = docs.columns.index(text)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
    spans = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in sliced(b, at)):
            found = [_all(t) if t else [] for t in batch.column(at).to_pylist()]
            column = pa.array([[{"start": s, "end": e, "kind": KINDS[k]} for s, k, e in x] for x in found], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, name])

    return docs.mapInArrow(worker(run), T.StructType([*docs.schema.fields, T.StructField(name, spans)]))


def _all(text: str) -> list[tuple[int, int, int]]:
    base = base_spans(text)
    return sorted([*base, *novel_spans(text, base)])


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The contract's columns from the operator's spans."""
    word = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    return found.select(key, *(count(k) for k in KINDS), F.size("spans").cast("long").alias("n_spans"), F.sha2(F.array_join(F.transform(base, word), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", word), ",").alias("spans"))


def without_secrets(docs: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """`docs` with every secret replaced in its text, and the length column, where there is one, of the new text."""
    at, size = docs.columns.index(text), docs.columns.index(length) if length in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in sliced(b, at)):
            old = batch.column(at).to_pylist()
            spans = [_all(t) if t else [] for t in old]
            if any(spans):
                columns = list(batch.columns)
                new = [redacted(t, s) if s else t for t, s in zip(old, spans, strict=True)]
                columns[at] = pa.array(new, columns[at].type)
                if size is not None:
                    columns[size] = pa.array([len(t) if s else n for t, s, n in zip(new, spans, columns[size].to_pylist(), strict=True)], columns[size].type)
                batch = pa.RecordBatch.from_arrays(columns, names=batch.schema.names)
            yield batch

    return docs.mapInArrow(worker(run), docs.schema)


def brute_force(text: str | None) -> tuple[int, int, int, str]:
    """The base columns by the plain patterns, for tests."""
    text, found = text or "", []
    plain = (r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"AKIA[A-Z0-9]+", r"[0-9a-f]+")
    for k, p in enumerate(plain):
        for m in re.finditer(p, text):
            n = len(m[2]) if k == 0 else len(m[0])
            if n >= (6, 20, 24)[k]:
                found.append((m.start(), k, m.end()))
    found.sort()
    return (*(sum(f[1] == k for f in found) for k in range(3)), hashlib.sha256(joined(found).encode()).hexdigest())
