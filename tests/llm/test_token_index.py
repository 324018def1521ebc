import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm.common import scratch
from ledgerline.llm.queries import tokenizer_file
from ledgerline.llm.token_index import RECORD, PerfectHash, Shard, encoder, get, read_store, token_index, write_store

from .data import clashing, collected, empty, frame, prose, rows

PATH = tokenizer_file("byte_bpe_50k.json")


def plain(texts, specials=True):
    """What the library gives, with its defaults unless special tokens are to be ordinary text."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    if not specials:
        t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


PARTS = [*"ab é.,'!\n\t\r\0\x0b\xa0\x1c 日1<|", "ab", "é.", "\nb", "a\n", "'s", "<|endoftext|>", "Ünï", "ǆ", "２", "½", "़"]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=25).map("".join), max_size=6), st.booleans())
def test_encoder_equals_the_library(texts, specials):
    texts = [*texts, "", "hello <|endoftext|> x", "it's  a\n\nb \n c", "x.\nY z,", "é\nà, b\n"]
    e = encoder(PATH, specials)
    assert [list(np.frombuffer(x, e.kind)) for x in e.encode(pa.array(texts))] == plain(texts, specials)


def test_special_tokens_are_those_of_the_library():
    e = encoder(PATH)
    assert list(np.frombuffer(e.encode(pa.array(["hello <|endoftext|> x"]))[0], e.kind)) == [31373, 220, 50256, 2124]


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 30_000])
def test_perfect_hash_is_minimal(n):
    keys = np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64)
    keys = np.unique(keys)
    slots = PerfectHash.build(keys).slots(keys)
    assert sorted(slots.tolist()) == list(range(len(keys)))


def test_store_round_trip(spark):
    data = rows()
    root = scratch(spark, "t")
    manifest = write_store(frame(spark), root, PATH, 2, shards=3)
    found = read_store(spark, root, manifest).collect()
    assert len(found) == len(data) and sum(m["documents"] for m in manifest) == len(data)
    texts = {}
    for k, t, *_ in data:
        texts.setdefault(k, []).append(t or "")
    start = 0
    for r in sorted(found, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
        ids = [np.array([*x, 2], "<u4") for x in plain(texts[r.doc_id])]
        assert (r.n_tokens, r.ids_crc32) in [(len(x), zlib.crc32(x.tobytes())) for x in ids]
    keys = [r.doc_id for r in sorted(found, key=lambda r: r.start) if r.doc_id is not None]
    assert keys == sorted(keys)
    # keyed access
    for k in (3, 9, 100):
        assert get(root, manifest, k).tolist() == [*plain(texts[k])[0], 2]
    assert get(root, manifest, 55) is None


def test_repeated_keys_have_slots_of_their_own(spark):
    data = [(k, f"{prose(k, 5)} {n}", "en", "s", 0) for k in range(40) for n in range(1 + 5 * (k == 7))] + [(None, prose(90 + k, 4), "en", "s", 0) for k in range(6)]
    root = scratch(spark, "t")
    manifest = write_store(frame(spark, data), root, PATH, 2, shards=2)
    found = [d for m in manifest for d in Shard(root, m["name"]).documents()]
    want = {}
    for k, t, *_ in data:
        want.setdefault(k, []).append([*plain([t])[0], 2])
    got = {}
    for k, _, ids in found:
        got.setdefault(k, []).append(ids.tolist())
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert all(get(root, manifest, k).tolist() == got[k][0] for k in range(40))
    foreign = [get(root, manifest, k) for k in [*range(40, 400), -1, 1 << 62]]
    assert foreign == [None] * len(foreign)


def test_index_disagreement_is_found(spark, tmp_path):
    root = f"file://{tmp_path}"
    manifest = write_store(frame(spark), root, PATH, 2, shards=1)
    name = manifest[0]["name"]
    path = tmp_path / f"{name}.mph"
    (tmp_path / f".{name}.mph.crc").unlink(missing_ok=True)
    raw = bytearray(path.read_bytes())
    raw[-RECORD.itemsize + 12] ^= 1  # the last record's length
    path.write_bytes(raw)
    with pytest.raises(ValueError, match="index"):
        list(Shard(root, name).documents())
    raw[-RECORD.itemsize] ^= 1  # and its fingerprint
    path.write_bytes(raw)
    with pytest.raises(ValueError, match="disagree"):
        list(Shard(root, name).documents())


def test_empty_and_clashing(spark):
    assert token_index(empty(spark), PATH).collect() == []
    assert collected(token_index(clashing(spark), PATH)) == collected(token_index(frame(spark), PATH))
