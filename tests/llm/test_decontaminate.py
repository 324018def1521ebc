import random

import duckdb
import pytest

from ledgerline.llm import decontaminate as D

from .data import clashing, collected, empty, frame, prose, rows

ITEMS = [(1, prose(2, 300).split(" ", 40)[-1][:400]), (2, prose(900, 30)), (3, "Only Three Words"), (4, None), (5, ""), (None, prose(901, 20)), (6, "word"), (2, prose(902, 30)), (10, "日本語 ß")]


def bench(spark, items=ITEMS):
    return spark.createDataFrame(items, "item_id bigint, text string")


def data():
    leak = f"{prose(910, 40)}. {prose(900, 30).upper()}! {prose(911, 40)} only-three,words {prose(902, 30)}"
    return [*rows(), (500, leak, "en", "s", 0), (501, prose(900, 30) + " " + prose(900, 30), "en", "s", 0), (502, "only three", "en", "s", 0)]


@pytest.mark.parametrize("limit", [16, 0.0001])
def test_equals_sql(spark, tmp_path, limit):
    """Also with the benchmark cut in blocks."""
    df, b = frame(spark, data()), bench(spark)
    df.write.parquet(str(tmp_path / "d"))
    b.write.parquet(str(tmp_path / "b"))
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/d/*.parquet'; create view benchmark as select * from '{tmp_path}/b/*.parquet'")
    got = D.digest(D.contamination(df.select("doc_id", "text"), b, limit_mb=limit))
    want = c.sql(D.ORACLE)
    at = [want.columns.index(x) for x in got.columns]
    assert collected(got) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)


def test_lanes_do_not_matter(monkeypatch):
    items = [(str(i), t) for i, t in ITEMS if i is not None]
    texts = [t for _, t, *_ in data()]
    found = D.Benchmark(items).search(texts)
    for lanes in (1, 7, 100_000):
        monkeypatch.setattr(D, "LANES", lanes)
        assert D.Benchmark(items).search(texts) == found
    monkeypatch.setattr(D, "CANDIDATES", 8)
    assert D.Benchmark(items).search(texts) == found


def test_all_candidates_of_a_bucket_are_compared():
    """Windows with the same first and last words meet in one bucket under one prefix."""
    r = random.Random(2)
    middle = [" ".join(r.choice("pqrs") for _ in range(4)) for _ in range(200)]
    items = [(str(k), f"a b {x} y z") for k, x in enumerate(dict.fromkeys(middle))]
    found = D.Benchmark(items).search([f"{t} and no more" for _, t in items])
    assert [x[2] for x in found] == [[i] for i, _ in items] and all(x[1] == [(0, 8)] for x in found)


def test_passages_are_cut(spark):
    df = clashing(spark, data())
    out = D.decontaminated(df, bench(spark, ITEMS[:2]))
    assert out.columns == df.columns
    found = {r.doc_id: r for r in out.collect()}
    assert prose(900, 30).upper() not in found[500].text and prose(910, 40) in found[500].text and found[500].n_chars == len(found[500].text)
    assert found[4].text == prose(3, 2) and found[6].text is None
    gone = {r.doc_id for r in D.decontaminated(df, bench(spark, [(1, prose(900, 30)), (2, prose(902, 30))])).collect()}
    assert 500 not in gone and 501 in gone


def test_empty(spark):
    assert D.digest(D.contamination(empty(spark), bench(spark))).collect() == []
    out = D.contamination(clashing(spark), bench(spark))
    assert {"n_words", "n_words_", "hits", "hits_", "items", "items_"} <= set(out.columns)
    assert collected(D.digest(out)) == collected(D.digest(D.contamination(frame(spark), bench(spark))))
    assert {r.n_items for r in D.digest(D.contamination(frame(spark), bench(spark).limit(0))).collect()} == {0}
