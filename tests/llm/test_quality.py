import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm.quality import ORACLE, accepted, counts_of, quality_rules

from .data import SCHEMA, clashing, collected, empty, frame, prose, rows


def brute(text):
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(hit)


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.none(), st.text(alphabet=st.sampled_from(list("ab \n\t\x0b\x0c\r#|é\xa0\x1c")), max_size=60)))
def test_counts(text):
    assert counts_of(text) == brute(text)


def compare(spark, data, tmp_path):
    df = frame(spark, data)
    df.write.parquet(str(tmp_path / "d"))
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    got = quality_rules(df)
    want = c.sql(ORACLE)
    at = [want.columns.index(x) for x in got.columns]
    assert collected(got) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("many", [False, True])
def test_equals_sql(spark, tmp_path, many):
    data = rows()
    if many:  # enough documents for fences of their own, and junk
        data += [(1000 + i, prose(i, 60 + i % 40), "en", "big", 0) for i in range(150)]
        data += [(2000 + i, " ".join(f"{w}$$$ ***" for w in prose(i, 60).split()), "en", "big", 0) for i in range(20)]
        data += [(3000 + i, prose(i, 60), "en", "small", 0) for i in range(3)]
    compare(spark, data, tmp_path)


def test_junk_goes_and_clean_stays(spark):
    clean = [(i, prose(i, 60 + i % 40), "en", "big", 0) for i in range(150)]
    junk = [(2000 + i, " ".join(f"{w}$$$ ***" for w in prose(i, 60).split()), "en", "big", 0) for i in range(20)]
    kept = {r.doc_id for r in accepted(frame(spark, clean + junk)).collect()}
    assert kept == {r[0] for r in clean}


def test_accepted_returns_the_same_rows(spark):
    df = clashing(spark)
    out = accepted(df)
    assert out.columns == df.columns
    verdicts = collected(quality_rules(frame(spark)).where("kept").select("doc_id"))
    assert collected(out.select("doc_id")) == verdicts


def test_empty(spark):
    assert quality_rules(empty(spark)).collect() == [] and accepted(empty(spark)).collect() == []
    assert SCHEMA
