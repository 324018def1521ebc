"""Quality rules whose thresholds follow the corpus.

Each document is measured; the measures of those that pass the base rules go into a quantile sketch for each
language and source. A sketch is a table of counts over log-linear buckets (six significant bits, so an edge is
within 1/32 of the value); counts add up, so sketches merge in any order and always to the same result, and a
sketch has a few hundred rows at most whatever it has seen. A group with too few documents borrows the merged
sketch of its language, and a language with too few that of the whole corpus. A fence lies FENCE spreads beyond
the upper quartile (for word length, also below the lower one); a document beyond any fence of its group is
rejected.

Null text has no words and fails the base rules, as does empty text. Null language or source is a group of its
own. Repeated rows are judged alike, and count in the sketches as often as they occur. Ties are no matter: a value on a fence
passes, and equal values lie in one bucket. Texts are measured whole, very long ones one by one. An empty table gives an
empty result. Only the named columns are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import sliced, stored, worker

SPACES, SYMBOLS = " \t\n\r\x0b\x0c", "#*$%&|<>"
#: Groups with fewer documents borrow a wider sketch.
SUPPORT = 100
#: Fences are so many spreads beyond the quartile; a spread is the distance of the quartiles, or LEAST if that is more.
FENCE = 4
#: Each measure: least spread, whether too small a value counts as well.
MEASURES = {"symbols": (40, False), "lines": (100, False), "repeats": (60, False), "length": (40, True)}
#: Up to so many groups, the fences are broadcast (some 100 bytes each); beyond, they are joined by a shuffle.
BROADCAST_GROUPS = 100_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three found twice or more."""
    if len(words) < 4:
        return 0
    table: dict[bytes, int] = {}
    ids = np.fromiter((table.setdefault(w, len(table)) for w in words), np.int64, len(words))
    if len(table) < 1 << 20:
        key = (ids[:-2] * len(table) + ids[1:-1]) * len(table) + ids[2:]
    else:  # the product of three would not fit
        key = np.unique(ids[:-2] * len(table) + ids[1:-1], return_inverse=True)[1] * len(table) + ids[2:]
    order = np.sort(key)
    if not (same := order[1:] == order[:-1]).any():
        return 0
    often = np.isin(key, order[1:][same])
    hit = np.zeros(len(words), bool)
    for k in range(3):
        hit[k : len(words) - 2 + k] |= often
    return int(hit.sum())


def counts_of(text: str | None) -> tuple[int, ...]:
    """COUNTS of one text."""
    if not text:
        return (0,) * len(COUNTS)
    words = text.encode().split()  # of bytes, this splits at the six ASCII spaces and nothing else
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeated_words(words)


def measured(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """`docs` with COUNTS as further columns, named with `prefix`."""
    names = [prefix + c for c in COUNTS]
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in sliced(b, at)):
            rows = np.array([counts_of(t) for t in batch.column(at).to_pylist()], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(rows[:, k]) for k in range(len(COUNTS)))], names=[*batch.schema.names, *names])

    return docs.mapInArrow(worker(run), T.StructType([*docs.schema.fields, *(T.StructField(n, T.LongType()) for n in names)]))


def base_failed(prefix: str = "") -> Column:
    n, r = F.col(prefix + "n_words"), F.col(prefix + "n_repeat_words")
    return (n < 50) | (100 * r > 50 * n)


def _ratios(prefix: str) -> dict[str, Column]:
    c = {k: f"`{prefix}{k}`" for k in COUNTS}
    per = lambda top, scale, below: F.expr(f"({scale} * {top}) div greatest({below}, 1)")
    return {"symbols": per(c["n_symbols"], 1000, c["n_words"]), "lines": per(c["n_dup_lines"], 1000, c["n_lines"]), "repeats": per(c["n_repeat_words"], 1000, c["n_words"]), "length": per(c["word_chars"], 100, c["n_words"])}


def bucket(v: str) -> Column:
    """The lower edge of a value's bucket: its six leading bits."""
    return F.expr(f"CASE WHEN {v} < 64 THEN {v} ELSE shiftleft(shiftright({v}, length(bin({v})) - 6), length(bin({v})) - 6) END")


def sketches(counts: DataFrame, lang: str, source: str, prefix: str = "") -> DataFrame:
    """lang, source, measure, bucket, n: the sketch of each group, a few hundred rows each."""
    ratios = _ratios(prefix)
    pairs = F.array(*(F.struct(F.lit(k).alias("measure"), v.cast("long").alias("v")) for k, v in ratios.items()))
    rows = counts.where(~base_failed(prefix)).select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.explode(pairs).alias("p"))
    return rows.select("lang", "source", "p.measure", bucket("p.v").alias("bucket")).groupBy("lang", "source", "measure", "bucket").count().withColumnRenamed("count", "n")


def fences(sketch: DataFrame) -> DataFrame:
    """A row for each language and source: the least and largest value of each measure that pass."""
    levels = []
    for level, keys in enumerate((["lang", "source"], ["lang"], [])):
        merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
        by = Window.partitionBy(*keys, "measure")
        ranked = merged.select(*keys, "measure", "bucket", F.sum("n").over(by.orderBy("bucket")).alias("upto"), F.sum("n").over(by).alias("total"))
        quartile = lambda q: F.min(F.when(4 * F.col("upto") >= q * F.col("total"), F.col("bucket")))
        levels.append(ranked.groupBy(*keys, "measure").agg(F.first("total").alias(f"n{level}"), quartile(1).alias(f"a{level}"), quartile(3).alias(f"b{level}")))
    own, wide, whole = levels
    wide, whole = wide.withColumnsRenamed({"lang": "l", "measure": "m"}), whole.withColumnRenamed("measure", "w")
    x = own.join(wide, own.lang.eqNullSafe(wide.l) & (own.measure == wide.m)).join(whole, own.measure == whole.w)
    pick = lambda k: F.when(F.col("n0") >= SUPPORT, F.col(f"{k}0")).when(F.col("n1") >= SUPPORT, F.col(f"{k}1")).otherwise(F.col(f"{k}2"))
    x = x.select("lang", "source", "measure", pick("a").alias("a"), pick("b").alias("b"))
    least = F.create_map(*(F.lit(y) for k, v in MEASURES.items() for y in (k, v[0])))[F.col("measure")]
    reach = FENCE * F.greatest(F.col("b") - F.col("a"), least)
    x = x.select("lang", "source", "measure", (F.col("a") - reach).alias("low"), (F.col("b") + reach).alias("high"))
    one = lambda k, c: F.max(F.when(F.col("measure") == k, F.col(c)))
    return x.groupBy("lang", "source").agg(*(one(k, "high").alias(f"high_{k}") for k in MEASURES), *(one(k, "low").alias(f"low_{k}") for k, v in MEASURES.items() if v[1]))


def judged(counts: DataFrame, limits: DataFrame, lang: str, source: str, prefix: str = "") -> DataFrame:
    """`counts` with base_failed and kept, named with `prefix`; the group's fences are joined to each row."""
    names = {c: f"{prefix}_{c}" for c in limits.columns}
    limits = limits.withColumnsRenamed(names)
    # The fences are a table in the shared folder by now: counting it reads no document.
    limits = F.broadcast(limits) if limits.count() <= BROADCAST_GROUPS else limits
    x = counts.join(limits, counts[lang].eqNullSafe(limits[names["lang"]]) & counts[source].eqNullSafe(limits[names["source"]]), "left")
    good = ~base_failed(prefix)
    for k, ratio in _ratios(prefix).items():
        good &= ratio <= F.col(names[f"high_{k}"])
        if MEASURES[k][1]:
            good &= ratio >= F.col(names[f"low_{k}"])
    return x.withColumn(f"{prefix}base_failed", base_failed(prefix)).withColumn(f"{prefix}kept", F.coalesce(good, F.lit(False))).drop(*names.values())


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """key, language, source, COUNTS, base_failed and kept of every document."""
    counts = stored(measured(docs.select(key, lang, source, text), text).drop(text), "counts")
    return judged(counts, stored(fences(sketches(counts, lang, source)), "fences"), lang, source)


def accepted(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of `docs` that are kept, unchanged. Texts are measured twice instead of being written once more."""
    prefix = "_quality_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix += "_"
    limits = stored(fences(sketches(measured(docs.select(lang, source, text), text).drop(text), lang, source)), "fences")
    return judged(measured(docs, text, prefix), limits, lang, source, prefix).where(F.col(f"{prefix}kept")).select(*docs.columns)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
g AS (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) > 2)),
often AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g) WHERE n >= 2),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM often, (VALUES (0), (1), (2)) v(k) GROUP BY rid),
ln AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (SELECT d.rid, doc_id, lang, source, len(words)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM d JOIN w USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN ln USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 1000 * n_symbols // greatest(n_words, 1) AS symbols, 1000 * n_dup_lines // greatest(n_lines, 1) AS lines,
  1000 * n_repeat_words // greatest(n_words, 1) AS repeats, 100 * word_chars // greatest(n_words, 1) AS length FROM m),
p AS (SELECT lang, source, measure, CASE WHEN v < 64 THEN v ELSE (v >> (length(bin(v)) - 6)) << (length(bin(v)) - 6) END AS bucket FROM b, LATERAL (VALUES ('symbols', symbols), ('lines', lines), ('repeats', repeats), ('length', length)) x(measure, v) WHERE NOT base_failed),
s AS (SELECT 0 AS level, lang, source, measure, bucket, count(*) AS n FROM p GROUP BY ALL UNION ALL SELECT 1, lang, NULL, measure, bucket, count(*) FROM p GROUP BY lang, measure, bucket UNION ALL SELECT 2, NULL, NULL, measure, bucket, count(*) FROM p GROUP BY measure, bucket),
r AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY level, lang, source, measure) AS total FROM s),
q AS (SELECT level, lang, source, measure, any_value(total) AS n, min(bucket) FILTER (4 * upto >= total) AS a, min(bucket) FILTER (4 * upto >= 3 * total) AS b FROM r GROUP BY ALL),
f AS (SELECT o.lang, o.source, o.measure, CASE WHEN o.n >= 100 THEN o.a WHEN l.n >= 100 THEN l.a ELSE e.a END AS a, CASE WHEN o.n >= 100 THEN o.b WHEN l.n >= 100 THEN l.b ELSE e.b END AS b
  FROM q o JOIN q l ON l.level = 1 AND l.lang IS NOT DISTINCT FROM o.lang AND l.measure = o.measure JOIN q e ON e.level = 2 AND e.measure = o.measure WHERE o.level = 0),
h AS (SELECT lang, source, measure, a - 4 * greatest(b - a, CASE measure WHEN 'lines' THEN 100 WHEN 'repeats' THEN 60 ELSE 40 END) AS low, b + 4 * greatest(b - a, CASE measure WHEN 'lines' THEN 100 WHEN 'repeats' THEN 60 ELSE 40 END) AS high FROM f),
k AS (SELECT lang, source, max(high) FILTER (measure = 'symbols') AS hs, max(high) FILTER (measure = 'lines') AS hl, max(high) FILTER (measure = 'repeats') AS hr, max(high) FILTER (measure = 'length') AS hn, max(low) FILTER (measure = 'length') AS ln FROM h GROUP BY lang, source)
SELECT doc_id, b.lang, b.source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed,
  coalesce(NOT base_failed AND symbols <= hs AND lines <= hl AND repeats <= hr AND length <= hn AND length >= ln, false) AS kept
FROM b LEFT JOIN k ON b.lang IS NOT DISTINCT FROM k.lang AND b.source IS NOT DISTINCT FROM k.source
"""
