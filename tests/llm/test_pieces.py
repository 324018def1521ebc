import zlib

import numpy as np
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm.pieces import decoded, encoded, pieces, brute_force
from ledgerline.llm.queries import tokenizer_file

from .data import clashing, collected, empty, frame

PATH = tokenizer_file("piece_bpe_32k.model")


def ids_of(p, text):
    return np.frombuffer(p.encode([text])[0], p.kind)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("the  and▁\n\té")), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_round_trip(text):
    p = pieces(PATH)
    assert p.decode(ids_of(p, text)) == text


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("theandiougr▁éß日")), min_size=1, max_size=20))
def test_best_score(word):
    p = pieces(PATH)
    score = dict(zip(p.ids.tolist(), p.scores.tolist(), strict=True))
    ids = np.frombuffer(p.segment([" " + word])[0], p.kind).tolist()
    total, k = 0.0, 0
    while k < len(ids):
        if ids[k] in score:
            total, k = total + score[ids[k]], k + 1
        else:  # the bytes of one character
            first = p.out[ids[k]][0]
            total, k = total + p.spelled, k + (1 if first < 128 else 2 if first < 224 else 3 if first < 240 else 4)
    assert abs(total - brute_force(p, " " + word)) < 1e-6


def test_words_of_one_length_advance_together():
    p = pieces(PATH)
    words = [f" w{i}word" for i in range(500)] + [" a", " b" * 1, " " + "long" * 500]
    alone = [p.segment([w])[0] for w in words]
    assert p.segment(words) == alone


def test_agrees_with_the_library_on_plain_english():
    sp, p = sentencepiece.SentencePieceProcessor(model_file=PATH), pieces(PATH)
    text = "The quick brown fox jumps over the lazy dog, and then returns to its comfortable resting place near the river."
    assert ids_of(p, text).tolist() == sp.encode(text)
    assert sp.decode(ids_of(p, text).tolist()) == text


def test_tables(spark):
    df = clashing(spark)
    out = encoded(df, PATH, verify=True)
    assert all(r.round_trip for r in out.select("round_trip").collect())
    back = {(r.doc_id, r.text) for r in decoded(out.drop("text"), PATH).select("doc_id", "text").collect()}
    assert back == {(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()}
    for r in out.select("ids", "n_pieces", "ids_crc32").collect():
        assert (len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes())) == (r.n_pieces, r.ids_crc32)
    assert encoded(empty(spark), PATH).collect() == []
    assert collected(encoded(frame(spark), PATH).select("doc_id", "ids")) == collected(out.select("doc_id", "ids"))
