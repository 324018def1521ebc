import duckdb
import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

import corpus_pipeline
from ledgerline.llm import near_dedup, quality
from ledgerline.llm.decontaminate import contamination
from ledgerline.llm.near_dedup import near_duplicates
from ledgerline.llm.pieces import pieces
from ledgerline.llm.quality import quality_rules
from ledgerline.llm.queries import ORACLES, QUERIES, tokenizer_file
from ledgerline.llm.secrets import _all, redacted

from .data import clashing, prose

ITEMS = [(1, prose(800, 30)), (2, prose(801, 30))]


def documents():
    secret = "password=0123456789abcdef"
    data = [(i, prose(i, 60), "en", "s", 0) for i in range(20)]
    data += [(100, prose(5, 60) + " end", "en", "s", 0), (101, f"{prose(101, 40)} {secret} {prose(102, 40)}", "en", "s", 0), (102, f"{prose(103, 40)} {prose(800, 30)} {prose(104, 40)}", "en", "s", 0)]
    data += [(103, f"{prose(105, 40)} {prose(800, 30)} {prose(801, 30)}", "en", "s", 0), (104, "too short", "en", "s", 0), (105, None, None, None, None), (106, "", "en", "s", 0), (107, prose(107, 20_000), "en", "s", 0)]
    return data


def test_stages(spark, tmp_path):
    """Each stage against its operator's verdicts, and the whole run against the expected rows."""
    spark.createDataFrame(ITEMS, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = clashing(spark, documents())
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns, name
        before, after = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r for r in out.collect()}
        if name == "quality_rules":
            assert set(after) == {r.doc_id for r in quality_rules(docs).where("kept").collect()} and not {104, 105, 106} & set(after)
        elif name == "near_dedup":
            assert set(after) == {r.doc_id for r in near_duplicates(docs).where("kept").collect()} and 100 not in after and 5 in after
        elif name == "benchmark_decontamination":
            items = {r.doc_id: len(r["items"]) for r in contamination(docs.drop("items", "hits", "n_words"), spark.read.parquet(str(tmp_path / "benchmark.parquet"))).collect()}
            assert set(after) == {k for k, n in items.items() if n < 2} and 103 not in after and prose(800, 30) not in after[102].text
        elif name == "secret_scan":
            assert {k: r.text for k, r in after.items()} == {k: redacted(t, _all(t)) for k, t in before.items()} and "0123456789abcdef" not in after[101].text
        else:
            p = pieces(tokenizer_file("piece_bpe_32k.model"))
            assert {k: p.decode(np.array(r.ids)) for k, r in after.items()} == before and all(r.round_trip for r in after.values())
        docs = out
    whole = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert whole == {r.doc_id: r.ids for r in docs.collect()}
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    assert {k: sp.decode(list(ids)) for k, ids in whole.items()} == plain_run(documents(), ITEMS)


def plain_run(rows, items):
    """What the pipeline leaves, by SQL, loops and plain patterns: id and text."""
    import re

    def keep(rows, sql):
        c = duckdb.connect()
        kinds = zip(("doc_id", "text", "lang", "source", "n_chars"), (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()), zip(*rows, strict=True), strict=True)
        c.register("documents", pa.table({n: pa.array(list(v), k) for n, k, v in kinds}))
        found = c.sql(sql)
        kept = {r[found.columns.index("doc_id")] for r in found.fetchall() if r[found.columns.index("kept")]}
        return [r for r in rows if r[0] in kept]

    rows = keep(rows, quality.ORACLE)
    rows = keep(rows, near_dedup.ORACLE.replace("len(w), 3)", "len(w), 5)").replace(">= 85 *", ">= 80 *"))
    word = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")
    words = lambda t: [m[0].lower() for m in word.finditer(t)]
    out = {}
    for key, text, *_ in rows:
        w, hit, of = words(text), set(), set()
        for item, t in items:
            x = words(t)
            for i in range(len(x) - 7):
                for j in range(len(w) - 7):
                    if w[j : j + 8] == x[i : i + 8]:
                        hit.update(range(j, j + 8))
                        of.add(item)
        if len(of) > 1:
            continue
        spans = [m.span() for m in word.finditer(text)]
        for k in sorted(hit, reverse=True):  # from the end, so that places stay
            text = text[: spans[k][0]].rstrip(" ") + text[spans[k][1] :]
        out[key] = re.sub(r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}""", "[SECRET]", text)
    return out


def test_empty(spark, tmp_path):
    clashing(spark, documents()).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(ITEMS, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 11)) and set(ORACLES) <= set(QUERIES)
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    with pytest.raises(KeyError):
        QUERIES["op11"]
