"""Small documents with every kind of trouble: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("aeioulnrstdmé") for _ in range(r.randint(2, 8))) for _ in range(n))


def rows() -> list[tuple]:
    base = prose(1, 300)
    near = base.split()
    near[100] = "changed"
    texts = [base, base, " ".join(near), prose(2, 300), prose(3, 2), "", None, "word", "\n\n  \t", prose(4, 20_000), prose(5, 120) + "\n" + prose(5, 120), "日本語 ß İ ſ K 😀", "a" * 5000]
    out = [(i, t, "en", "s0", 0 if t is None else len(t)) for i, t in enumerate(texts)]
    out += [(100, prose(7, 80), None, "s1", None), (101, prose(8, 80), "fr", None, 1), (None, prose(9, 80), "en", "s1", 2), (0, base, "en", "s0", len(base))]
    return out


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(spark, data=None):
    """The same rows with further columns named as operators name theirs."""
    from pyspark.sql import functions as F

    names = ("kept", "n_words", "key", "rid", "spans", "ids", "hits", "items", "component_id", "class", "who", "raw", "_kept", "path", "licence", "label", "cid")
    return frame(spark, data).withColumns({n: F.lit(n) for n in names})


def collected(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
