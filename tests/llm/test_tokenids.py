import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from campuslens.llm import rangecoder as R
from campuslens.llm import tokenids as T

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 65535), max_size=300), st.integers(1, 40))
def test_records_come_back(ids, times):
    x = np.array(ids * times, np.int64)
    assert (R.read(R.write(x)) == x).all()


def test_blocks_are_independent_and_checked():
    x = np.random.default_rng(1).zipf(1.3, 3 * R.BLOCK + 17) % 5000
    record = R.write(x)
    assert (R.read(record) == x).all() and len(record) < 2 * len(x)
    order0 = R.Order0.of(x)
    blocks = [x[i:i + R.BLOCK] for i in range(0, len(x), R.BLOCK)]
    payloads = R.encode_blocks(blocks, order0)
    assert (R.decode_blocks(payloads[1:2], [R.BLOCK], order0)[0] == blocks[1]).all()
    damaged = bytearray(record)
    damaged[-100] ^= 4
    with pytest.raises(ValueError, match="damaged"):
        R.read(bytes(damaged))
    with pytest.raises(ValueError):
        R.write(np.array([70000]))


def test_documents_come_back_in_order(spark, scratch, awkward, docs, monkeypatch):
    monkeypatch.setattr(T, "PART_BYTES", 200)  # several partitions
    T.write_ids(awkward, f"{scratch}/ids", PATH, 2, cut_at_blanks=True)
    rows = T.read_ids(spark, f"{scratch}/ids").orderBy("start").collect()
    own = Tokenizer.from_file(PATH)
    order = sorted(awkward.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    at = 0
    for r, (doc_id, text) in zip(rows, order, strict=True):
        want = own.encode(text or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.ids) == (doc_id, at, want)
        at += len(want)
    crc = T.with_crc32(T.read_ids(spark, f"{scratch}/ids")).orderBy("start").collect()
    assert [c.ids_crc32 for c in crc] == [zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in rows]
    T.write_ids(docs([]), f"{scratch}/none", PATH, 2)
    assert T.read_ids(spark, f"{scratch}/none").collect() == []


def test_cutting_at_blanks_changes_no_id():
    import random
    r = random.Random(3)
    alphabet = " \n\t  a'séÉ1٣中國　\x1c\x85​_.-!ZßİΣς🙂ⅷ²<|endoftext|>"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 80))) for _ in range(2000)] + ["<|endoftext|> a", None]
    with open(PATH, encoding="utf-8") as f:
        definition = f.read()
    assert T.encode_texts(definition, texts, True) == T.encode_texts(definition, texts, False)


def test_special_strings_get_the_librarys_ids(spark, scratch, docs):
    texts = ["<|endoftext|> z", "a<|endoftext|>b <|startoftext|>", "<|endoftext|><|endoftext|>", "<|endof text|>", "x " * 60_000 + "<|endoftext|>"]
    T.write_ids(docs(list(enumerate(texts))), f"{scratch}/special", PATH, 2, cut_at_blanks=True)
    own = Tokenizer.from_file(PATH)
    got = {r.doc_id: r.ids for r in T.read_ids(spark, f"{scratch}/special").collect()}
    assert got == {i: own.encode(t, add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}
    assert got[0] == [49407, 345, 2]
