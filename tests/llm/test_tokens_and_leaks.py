"""Token ids against two libraries; leaks against brute force."""

from __future__ import annotations

import base64
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenframe.llm import eval_leaks, tokenize_corpus

VOCABULARY = Path(tokenize_corpus.TOKENIZER_DIR)
needs_files = pytest.mark.skipif(not VOCABULARY.exists(), reason="no tokenizer files here")


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(str(VOCABULARY / "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@needs_files
def test_ids_equal_the_library(spark, library):
    texts = [None, "", " ", "\n\n  x", "Hello world, it's 2024!", "<|endoftext|>", "aaaaaaaaab" * 9, "héllo wörld 阀门", "a b‍c 👍🏽", "x" * 30_000, "don't WE'LL 's", "same", "same"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "text", "'z' as ids", "1 as value")
    got = {r["doc_id"]: list(r["ids"]) for r in tokenize_corpus.encode_corpus(df).collect()}
    assert got == {i: library(t) if t else [] for i, t in enumerate(texts)}
    assert tokenize_corpus.encode_corpus(df.where("false")).count() == 0


@needs_files
@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=60))
def test_replay_equals_rank_by_rank_merging(text):
    tiktoken = pytest.importorskip("tiktoken")
    import regex

    with open(VOCABULARY / "byte_bpe_50k.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = _cached("tiktoken", lambda: tiktoken.Encoding("own", pat_str=tokenize_corpus.WORD_PATTERN, mergeable_ranks=ranks, special_tokens={}))
    replay = _cached("replay", lambda: tokenize_corpus.MergeReplay(tokenize_corpus.load_merges(str(VOCABULARY / "byte_bpe_50k.json"))))
    words = regex.findall(tokenize_corpus.WORD_PATTERN, text)
    known = replay.encode(set(words))
    assert [i for w in words for i in known[w]] == encoding.encode_ordinary(text)


_held: dict = {}


def _cached(name, make):
    if name not in _held:
        _held[name] = make()
    return _held[name]


@needs_files
def test_memory_of_words_is_bounded(spark, library, monkeypatch):
    monkeypatch.setattr(tokenize_corpus, "REMEMBERED_WORDS", 3)
    monkeypatch.setattr(tokenize_corpus, "BLOCK_DOCUMENTS", 2)
    rows = [(i, f"word{i} again {i * 7}") for i in range(9)]
    got = {r["doc_id"]: list(r["ids"]) for r in tokenize_corpus.encode_corpus(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert got == {i: library(t) for i, t in rows}


def leaks(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as item_id", "2 as words")
    e = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'y' as doc_id")
    return {(r["doc_id"], r["item_id"]): r["words"] for r in eval_leaks.leaked_passages(d, e, **more).collect()}


LONG = " ".join(f"w{i}" for i in range(30))


def test_leaks_of_runs_whole_items_and_none(spark):
    docs = [
        (1, "start " + " ".join(f"w{i}" for i in range(5, 20)) + " end"),  # 15 words in a row
        (2, " ".join(f"w{i}" for i in range(5, 16))),  # 11 only
        (3, "Here: A short​ ITEM, whole!"),
        (4, None),
        (5, ""),
        (6, "a short x item"),
        (7, (LONG + " . ") * 300),
    ]
    items = [(1, LONG), (2, "a short item"), (3, None), (4, "..."), (5, "a short item")]
    assert leaks(spark, docs, items) == {(1, 1): 15, (3, 2): 3, (3, 5): 3, (7, 1): 30}
    assert leaks(spark, docs, [(1, None)]) == {} and leaks(spark, [], items) == {}


def test_leaks_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(eval_leaks, "TEST_BLOCK_CHARS", 100)
    items = [(i, " ".join(f"q{i}x{k}" for k in range(14))) for i in range(6)]
    docs = [(i, "pre " + items[i][1] + " post") for i in range(6)]
    assert leaks(spark, docs, items) == {(i, i): 14 for i in range(6)}


def test_an_item_of_more_words_than_16_bits_number(spark):
    words = [f"n{i}" for i in range(70_000)]
    docs = [(1, "before " + " ".join(words[69_980:69_999]) + " after"), (2, " ".join(words[65_530:65_541]) + " n1")]
    assert leaks(spark, docs, [(9, " ".join(words)), (8, "a b c")]) == {(1, 9): 19}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=0, max_size=40), st.lists(st.sampled_from("abc"), min_size=1, max_size=9))
def test_binary_search_finds_every_place(text, wanted):
    import numpy as np

    vocab = {"a": 1, "b": 2, "c": 3}
    shard = np.array([vocab[c] for c in text] + [0], np.uint16)
    starts, columns = eval_leaks.suffix_array(shard, 12, len(wanted))
    low = np.array([[vocab[c] for c in wanted] + [0] * (12 - len(wanted))], np.uint16)
    high = low.copy()
    high[0, len(wanted) :] = 65535
    first, last = eval_leaks.search(columns, eval_leaks.packed(low), False), eval_leaks.search(columns, eval_leaks.packed(high), True)
    truth = {i for i in range(len(text) - len(wanted) + 1) if text[i : i + len(wanted)] == wanted}
    assert set(starts[first[0] : last[0]].tolist()) == truth
