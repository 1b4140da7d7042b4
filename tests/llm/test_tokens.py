import hashlib
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spindrift.llm import bpe, token_counts

tokenizers = pytest.importorskip("tokenizers")
PATH = bpe.default_vocabulary()
HARD = [
    None, "", " \n\t", "Hello, it's 2024!", "<|endoftext|>", "a<|startoftext|>b <|ENDOFTEXT|>x<|endoftext|><|", "ΟΔΥΣΣΕΥΣ Σ", "İstanbul ſ ß",
    "é é Å", "a\x1cb\x85c d\xa0e", "日本語 텍스트 ไทย", "👩‍👩‍👧 🇫🇷", "\x00\x07﻿", "''s 've'll I'M", "½²Ⅷ٣", ":\U0003d000x \U00013460:\U00010d50 a", "a" * 5000, "ab " * 30_000,
]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def known():
    return bpe.load_vocabulary(PATH)


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", HARD)
def test_encoding_is_the_library_s(known, library, text):
    ids = known.encode(text or "")
    assert (np.frombuffer(ids, "<u4").tolist(), known.decode(ids)) == expected(library, text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_encoding_of_any_text(known, library, text):
    ids = known.encode(text)
    assert (np.frombuffer(ids, "<u4").tolist(), known.decode(ids)) == expected(library, text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aehilnorstt", min_size=1, max_size=24))
def test_automaton_on_words_of_frequent_letters(known, library, word):
    assert known.automaton.encode(word.encode()) == library.encode(word, add_special_tokens=False).ids


def test_automaton_accepts_only_the_right_tokenization():
    """Of all ways to cut a word into labels, the automaton's arcs allow exactly one."""
    bytes_ = bpe.byte_characters()
    merges = [("a", "a"), ("a", "b"), ("aa", "b</w>"), ("b", "b"), ("aa", "aa"), ("ab", "ab</w>"), ("a", "b</w>"), ("b", "a"), ("bb", "b")]
    vocab = {s: i for i, s in enumerate([*bytes_, *(b + "</w>" for b in bytes_)])}
    merges = [m for m in merges if all(x in vocab or any(x == a + b for a, b in merges) for x in m)]
    for a, b in merges:
        if a in vocab and b in vocab:
            vocab.setdefault(a + b, len(vocab))
    merges = [m for m in merges if m[0] in vocab and m[1] in vocab and m[0] + m[1] in vocab]
    machine = bpe.Automaton(vocab, merges, "</w>")

    def greedy(word):
        parts = [*word[:-1], word[-1] + "</w>"]
        while True:
            ranks = [(merges.index(p), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in merges]
            if not ranks:
                return [vocab[p] for p in parts]
            i = min(ranks)[1]
            parts[i : i + 2] = ["".join(parts[i : i + 2])]

    def paths(word, at=0, state=bpe.START):
        if at == len(word):
            return [[]]
        out = []
        for end in range(at + 1, len(word) + 1):
            label = vocab.get(word[at:end] + ("</w>" if end == len(word) else ""))
            if label is not None and machine.has_arc(state, label):
                out += [[label, *rest] for rest in paths(word, end, machine.target[label])]
        return out

    for n in range(1, 9):
        for code in range(2**n):
            word = "".join("ab"[code >> i & 1] for i in range(n))
            assert machine.encode(word.encode()) == greedy(word), word
            assert paths(word) == [greedy(word)], word


def test_caches_may_turn_over(monkeypatch, known):
    monkeypatch.setattr(bpe, "CACHE", 5)
    monkeypatch.setattr(bpe, "WORDS", 3)
    text = " ".join(f"word{i % 13}" for i in range(200))
    fresh = bpe.Vocabulary.__new__(bpe.Vocabulary)
    fresh.__setstate__(known.__getstate__())
    assert fresh.encode(text) == known.encode(text)


def test_bpe_documents(spark, docs, library):
    rows = [(i, t) for i, t in enumerate(HARD)] + [(None, "x"), (4, HARD[4])]
    out = bpe.bpe_documents(docs(*rows), keep=("ids", "decoded")).collect()
    assert len(out) == len(rows)
    texts = dict(rows)
    for r in out:
        ids, decoded = expected(library, texts[r.doc_id])
        assert (r.n_tokens, r.ids, r.decoded) == (len(ids), ids, decoded)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    again = {r.doc_id: r.decoded for r in bpe.decode_ids(spark, spark.createDataFrame([(r.doc_id, r.ids) for r in out if r.doc_id is not None], "doc_id long, ids array<int>")).collect()}
    assert all(again[r.doc_id] == r.decoded for r in out if r.doc_id is not None)
    assert bpe.bpe_documents(docs()).collect() == []


@pytest.mark.parametrize("cache", [2, token_counts.CACHE])
def test_token_counts(docs, library, monkeypatch, cache):
    rows = [(i, t) for i, t in enumerate(HARD)] + [(None, "x"), (4, HARD[4])]
    out = token_counts.token_counts(docs(*rows), limit=100).collect()
    assert len(out) == len(rows)
    texts = dict(rows)
    for r in out:
        n = len(expected(library, texts[r.doc_id])[0])
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((texts[r.doc_id] or "").encode()), n > 100)
    assert token_counts.token_counts(docs()).collect() == []


def test_table_only_saves_work(library):
    texts = [t or "" for t in HARD]
    counted = token_counts.Lengths({"hello,": 2, "a": 1}, open(PATH, encoding="utf-8").read())
    assert counted.count(texts) == [len(expected(library, t)[0]) for t in texts]


@pytest.fixture(scope="module")
def lengths():
    return token_counts.Lengths({}, open(PATH, encoding="utf-8").read())


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_count_of_any_text(lengths, library, text):
    assert lengths.count([text]) == [len(expected(library, text)[0])]


def test_count_of_dotted_capital_with_every_mark(lengths, library):
    texts = [f"\u0130{chr(c)} x{chr(c)}\u0130\u0323" for c in range(0x300, 0x110000) if unicodedata.combining(chr(c))]
    assert len(texts) > 800
    assert lengths.count(texts) == [len(expected(library, t)[0]) for t in texts]


def test_frequent_pieces_come_from_all_documents(docs):
    rows = [(i, f"common own{i} " + "often " * (i % 3)) for i in range(2000)] + [(None, "unnamed")]
    found = token_counts.frequent_pieces(docs(*rows), ["<|x|>"], 4096, 4096)
    assert sorted(found) == sorted(["common", "often", "unnamed"] + [f"own{i}" for i in range(2000)])
    assert set(token_counts.frequent_pieces(docs(*rows), ["<|x|>"], 20, 20)) == {"common", "often"}
    plan = token_counts.token_counts(docs(*rows))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "rangepartitioning" not in plan
