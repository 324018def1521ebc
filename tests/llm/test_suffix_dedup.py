import random

import duckdb
import pyarrow as pa
import pytest

from ledgerline.llm import suffix_dedup as S

from .data import clashing, collected, empty, frame, prose, rows


def compare(spark, data):
    got = S.digest(S.repeated(clashing(spark, data))).collect()
    want = S.brute_force([r[1] for r in data])
    c = duckdb.connect()
    c.register("documents", pa.table({"doc_id": pa.array([r[0] for r in data], pa.int64()), "text": pa.array([r[1] for r in data], pa.string())}))
    assert sorted(c.sql(S.ORACLE).fetchall(), key=repr) == sorted(((r[0], *w) for r, w in zip(data, want, strict=True)), key=repr)
    assert collected(spark.createDataFrame(got)) == sorted(((r[0], *w) for r, w in zip(data, want, strict=True)), key=repr)


def repeats():
    r, data = random.Random(5), []
    shared = [prose(40 + i, 60) for i in range(6)]
    for i in range(60):
        parts = [prose(1000 + 10 * i + k, r.randint(1, 40)) for k in range(3)]
        for _ in range(r.randint(0, 2)):
            s = r.choice(shared)
            a = r.randrange(len(s) - 250)
            parts.insert(r.randint(0, 3), s[a : a + r.randint(190, 260)])
        data.append((i, " ".join(parts), "en", "s", 0))
    return data


def test_trouble(spark):
    compare(spark, rows())


def test_overlapping_repeats(spark):
    compare(spark, repeats())


@pytest.mark.parametrize(("group", "together"), [(3, 2), (1, 50), (500, 5)])
def test_large_groups_are_spread(spark, monkeypatch, group, together):
    monkeypatch.setattr(S, "GROUP", group)
    monkeypatch.setattr(S, "TOGETHER", together)
    compare(spark, repeats())


def test_runs_and_long_texts(spark, monkeypatch):
    compare(spark, [(1, "a" * 1000, "en", "s", 0), (2, "ab" * 500, "en", "s", 0), (3, "x" + "é" * 150, "en", "s", 0), (4, "y" + "é" * 150, "en", "s", 0), (5, "z" * 200, "en", "s", 0), (6, "q" * 199, "en", "s", 0)])
    monkeypatch.setattr(S, "BLOCK", 700)
    data = [(i, prose(60, 700) if i < 2 else prose(60 + i, 300) + prose(60, 700)[500:900], "en", "s", 0) for i in range(4)]
    compare(spark, data)


def test_one_hot_passage(spark):
    passage = prose(99, 60)
    compare(spark, [(i, f"{prose(2000 + i, 20)} {passage} {prose(3000 + i, 20)}", "en", "s", 0) for i in range(80)])


def test_empty(spark):
    assert S.digest(S.repeated(empty(spark))).collect() == []
    assert S.repeated(frame(spark)).columns == ["doc_id", "raw", "spans"]


@pytest.mark.parametrize("n", [0, 1, 7, 30_000])
def test_multikey_quicksort(n):
    import numpy as np

    r = np.random.default_rng(n)
    columns = [r.integers(-3, 3, n), r.integers(0, 40, n), r.integers(0, 1 << 60, n)]
    order = S.multikey_order(columns)
    assert np.array_equal(order, np.lexsort(columns[::-1])) or [tuple(c[order]) for c in columns] == [tuple(c[np.lexsort(columns[::-1])]) for c in columns]


def test_heads_keep_the_order_of_bytes():
    import numpy as np

    raw = np.random.default_rng(1).integers(0, 256, 400).astype(np.uint8)
    at = np.arange(300)
    words = S.heads(raw, at)
    assert sorted(at.tolist(), key=lambda i: raw[i : i + S.HEAD].tobytes()) == np.lexsort(words[::-1]).tolist()


def test_copies_give_their_contexts_once(spark, monkeypatch):
    seen = []
    whole = S._compared
    monkeypatch.setattr(S, "_compared", lambda rows: whole(seen.append(rows.count()) or rows))
    text = prose(7, 120)
    compare(spark, [(i, text, "en", "s", 0) for i in range(60)] + [(100, text[:500] + " other " + text[500:], "en", "s", 0)])
    assert seen[0] < 20
