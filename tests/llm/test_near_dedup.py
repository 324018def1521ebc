import random

import duckdb
import numpy as np
import pytest

from ledgerline.llm import near_dedup as N

from .data import clashing, collected, empty, frame, prose, rows


def compare(spark, data, tmp_path, rule=N.CONTRACT):
    df = frame(spark, data)
    df.coalesce(1).write.parquet(str(tmp_path / "d"))
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    got = N.near_duplicates(df, rule=rule)
    want = c.sql(N.ORACLE.replace("len(w), 3)", f"len(w), {rule.words})").replace(">= 85 *", f">= {rule.num} *"))
    at = [want.columns.index(x) for x in got.columns]
    assert collected(got) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)


def edited(words, seed, edits):
    r = random.Random(seed)
    words = list(words)
    for _ in range(edits):
        words[r.randrange(len(words))] = f"w{r.randrange(10**6)}"
    return " ".join(words)


def test_trouble(spark, tmp_path):
    compare(spark, rows(), tmp_path)


@pytest.mark.parametrize(("chunk", "rule"), [(1000, N.FIVE), (6, N.CONTRACT)])
def test_groups_near_the_threshold(spark, tmp_path, monkeypatch, chunk, rule):
    """Copies at all distances, so stars hold many components; small chunks make them be cut."""
    monkeypatch.setattr(N, "CHUNK", chunk)
    monkeypatch.setattr(N, "CROSS", chunk + 3)
    data = []
    for g in range(3):
        base = prose(g + 50, 150).split()
        data += [(100 * g + i, edited(base, 1000 * g + i, i % 9), "en", "s", 0) for i in range(40)]
    compare(spark, data, tmp_path, rule)


def test_hot_group_of_equal_copies(spark, tmp_path):
    text = prose(77, 60)
    compare(spark, [(i, text if i % 3 else prose(i, 30), "en", "s", 0) for i in range(120)], tmp_path)


def test_registers_merge_by_maximum():
    a, b = N.shingles(prose(1, 200)), N.shingles(prose(2, 300))
    assert np.array_equal(np.maximum(N.registers(a), N.registers(b)), N.registers(np.union1d(a, b)))


def test_likelihood_keeps_similar_sets():
    base = prose(3, 400).split()
    a = N.shingles(" ".join(base))
    for seed in range(30):
        b = N.shingles(edited(base, seed, 12))
        common = len(np.intersect1d(a, b))
        if 100 * common >= 85 * (len(a) + len(b) - common):
            assert not N.unlikely(N.registers(a), N.registers(b)[None, :], len(a), np.array([len(b)]))[0]
    far = N.shingles(prose(4, 400))
    assert N.unlikely(N.registers(a), N.registers(far)[None, :], len(a), np.array([len(far)]))[0]


def test_sets_skipped_while_different_components_led():
    """Links 0-1, 1-3, 2-3 and 2-4: 1 is skipped while {0, 1} leads, 3 while {2, 3, 4} does."""
    numbers = N.mixed(np.arange(1200, dtype=np.uint64))
    sets = [np.sort(numbers[50 * k : 50 * k + 1000]) for k in (0, 1, 3, 2, 4)]
    links = N.linked(sets)
    assert len(links) == 4 and set(links) <= {(0, 1), (1, 3), (3, 1), (2, 3), (2, 4)}


def test_one_of_each_group_stays(spark):
    df = clashing(spark)
    out = N.deduplicated(df)
    assert out.columns == df.columns
    ids = [r.doc_id for r in out.collect()]
    assert ids.count(0) == 1 and 1 not in ids and 2 not in ids and {3, 4, 5, 6, 7, 8, 9} <= set(ids)


def test_components_of_long_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 200), (200, 150)], "u bigint, v bigint")
    found = {r.u: r.v for r in N.components(links).collect()}
    assert found == {i: 0 for i in range(1, 61)} | {200: 100, 150: 100}


def test_empty(spark):
    assert N.near_duplicates(empty(spark)).collect() == [] and N.deduplicated(empty(spark)).collect() == []


def test_texts_move_only_where_registers_leave_a_partner(spark, monkeypatch):
    """Of a family of similarity 0.6 no pair links; its members share buckets, but hardly a text is dealt."""
    dealt = []
    whole = N._linked_in_cells
    monkeypatch.setattr(N, "_linked_in_cells", lambda rows, key, rule: whole(dealt.append(rows.count()) or rows, key, rule))
    monkeypatch.setattr(N, "CHUNK", 50)
    monkeypatch.setattr(N, "CROSS", 100)
    frame_words = prose(5, 240).split()
    data = []
    for i in range(300):
        w = list(frame_words)
        for k in range(0, 240, 8):
            w[k : k + 2] = [f"x{i}", f"y{i}"]
        data.append((i, " ".join(w), "en", "s", 0))
    found = N.near_duplicates(frame(spark, data)).collect()
    assert all(r.kept and r.component_id == r.doc_id for r in found) and len(found) == 300
    assert sum(dealt) < 60, dealt
