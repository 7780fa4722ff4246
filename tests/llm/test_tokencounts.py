"""Token counts against the tokenizer library."""

import itertools
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from campuslens.llm import tokencounts
from campuslens.llm.common import read_table
from campuslens.llm.queries import QUERIES

from .conftest import words

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def library():
    own = Tokenizer.from_file(PATH)
    return lambda text: len(own.encode(text or "", add_special_tokens=False).ids)


def counted(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query_gives_the_librarys_counts(spark, library):
    docs = read_table(spark, SF, "documents").collect()
    want = sorted(((r["doc_id"], len((r["text"] or "").encode()), n := library(r["text"]), n > 1024) for r in docs), key=repr)
    assert counted(QUERIES["op13_token_counts"](spark, SF)) == want


def test_awkward_rows_and_clashing_columns(spark, awkward, library):
    want = sorted(((r["doc_id"], len((r["text"] or "").encode()), library(r["text"])) for r in awkward.collect()), key=repr)
    assert counted(tokencounts.count_tokens(awkward.withColumns({c: F.lit("x") for c in ("token", "n", "n_bytes", "n_tokens")}), PATH)) == want
    assert tokencounts.count_tokens(awkward.limit(0), PATH).collect() == []


def test_both_tiers_and_small_caches(docs, library, monkeypatch):
    for name, value in {"FREQUENT": 5, "COUNTED": 10, "CACHE": 20, "TOGETHER": 7}.items():
        monkeypatch.setattr(tokencounts, name, value)
    tokencounts.counting.cache_clear()
    rows = [(i, words(i, 300, 100)) for i in range(20)]
    assert counted(tokencounts.count_tokens(docs(rows), PATH)) == sorted(((i, len(t), library(t)) for i, t in rows), key=repr)
    tokencounts.counting.cache_clear()


def test_special_strings_white_space_and_contractions(docs, library):
    texts = ["<|endoftext|>", "a <|endoftext|> b", "<|endoftext|><|endoftext|>", " <|endoftext|>  x", "<|endoftext", "it's  we'll\n\n x",
             "''s 's't", "\x1c\x1d \x85 \xa0 x", "  \t ", "a b　c", "é ١٢ ²½", "_x__ y_1", "x\r\n\r\ny"]
    rows = list(enumerate(texts))
    assert counted(tokencounts.count_tokens(docs(rows), PATH)) == sorted(((i, len(t.encode()), library(t)) for i, t in rows), key=repr)


def test_every_plain_character_beside_others(library):
    own = tokencounts.Counting(open(PATH, encoding="utf-8").read())
    plain = [chr(c) for c in range(tokencounts._LIMIT) if tokencounts._PLAIN.fullmatch(chr(c))]
    for c, (a, b) in itertools.product(plain, itertools.product("a1 .'", repeat=2)):
        text = a + c + b + c + c
        assert tokencounts._pattern().findall(text) == [text[i:j] for _, (i, j) in own.own.pre_tokenizer.pre_tokenize_str(text)]


def test_long_texts_are_cut_where_a_pretoken_starts(docs, library, monkeypatch):
    r = random.Random(5)
    text = "".join(r.choice([" ", "  ", "a", "é", "12", ".", "'s", "\n", "<|endoftext|>", " word", "中"]) for _ in range(60_000))
    monkeypatch.setattr(tokencounts, "STRETCH", 50)
    rows = [(1, text), (2, "x" * 200_000), (3, " " * 100_000), (4, words(1, 50_000))]
    assert counted(tokencounts.count_tokens(docs(rows), PATH)) == sorted(((i, len(t.encode()), library(t)) for i, t in rows), key=repr)


def test_other_tokenizers_are_refused(docs):
    with pytest.raises(ValueError):
        tokencounts.count_tokens(docs([(1, "x")]), public_tokenizers.path("word_bpe_49k.json"))
