"""The numpy words of a column against regular expressions."""

import random
import tracemalloc

import brute
import numpy as np
import pyarrow as pa
import pytest

from poslake.llm import repetition, textnp, tokens


def _texts():
    pick = random.Random(1)
    out = [t for (t,) in brute.rows("documents", "text")]
    out += ["", None, "a", "é b\né b\n\n é", "\x0b\x0c x \t y", "a b c d e a b c d e", "x\ny\nx\r\nx", "   ", "日本 x 日本"]
    out += [" ".join(pick.choices("ab c\n", k=pick.randint(0, 60))) for _ in range(200)]
    return out + ["".join(pick.choices("ab# \n\té", k=pick.randint(0, 90))) for _ in range(300)]


@pytest.mark.parametrize("size", [64, 5000, 1 << 20])
def test_repetition_counts(monkeypatch, size):
    monkeypatch.setattr(textnp, "BLOCK", size)
    texts, got = _texts(), []
    for block in textnp.blocks(pa.array(texts), textnp.Words.SPACED):
        found = repetition.measure(block)
        got += zip(*(found[k].tolist() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), strict=True)
    assert got == [brute.repetition(t) for t in texts]


def test_alphanumeric_words_are_equal_when_their_hashes_are():
    texts = _texts()
    words, hashes = [], []
    for block in textnp.blocks(pa.array(texts), textnp.Words.ALNUM):
        hashes += block.hashes.tolist()
        words += [bytes(block.data[a:b]).decode() for a, b in zip(block.starts, block.ends, strict=True)]
    assert words == [w for t in texts for w in brute.alnum(t)]
    assert len(set(zip(words, hashes, strict=True))) == len(set(words)) == len(set(hashes))


def test_coverage_and_verdict():
    text = " ".join(f"w{i}" for i in range(60))
    block = next(textnp.blocks(pa.array([text, "a b c d e f g h i j " * 6, "same line of words here\n" * 9, ""]), textnp.Words.SPACED))
    found = repetition.measure(block)
    failed, kept = repetition.judge(found)
    assert failed.tolist() == [False, True, True, True] and kept.tolist() == [True, False, False, False]
    assert found["cover_10"].tolist()[:2] == [0, 1] and found["cover_lines"][2] == pytest.approx(8 / 9)


def test_texts_that_pass_the_base_rule_and_fail_the_method():
    fresh = lambda n: " ".join(f"w{i:03}" for i in range(n))
    gram = lambda n: " ".join(f"r{i:03}" for i in range(n))
    texts = [f"{gram(10)} {fresh(100)} {gram(10)}", f"{gram(7)} {fresh(76)} {gram(7)}", f"{gram(5)} {fresh(54)} {gram(5)}",
             "\n".join(f"{gram(4)}\n" + " ".join(f"u{i:02}{j}" for j in range(12)) for i in range(10)), f"{gram(5)} {fresh(80)} {gram(5)}"]
    block = next(textnp.blocks(pa.array(texts), textnp.Words.SPACED))
    found = repetition.measure(block)
    failed, kept = repetition.judge(found)
    assert not failed.any() and kept.tolist() == [False] * 4 + [True]
    assert found["cover_10"][0] > 0.1 and found["cover_7"][1] > 0.13 and found["cover_5"][2] > 0.15 and found["cover_lines"][3] > 0.2


def test_repetition_query_of_odd_tables(spark):
    schema = "doc_id long, n_words string, text string, kept int"
    docs = spark.createDataFrame([(1, "x", None, 0), (1, "x", "a", 1), (None, None, " ".join(f"w{i}" for i in range(12)), 2)], schema)
    got = repetition.repetition(docs, ["doc_id"]).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.kept) for r in got) == [(0, 12, True), (1, 0, False), (1, 1, False)]
    assert repetition.repetition(docs.limit(0), ["doc_id"]).count() == 0


def test_tokens_equal_the_tokenizer():
    from tokenizers import Tokenizer
    pick, plain = random.Random(2), Tokenizer.from_file(tokens.default_path())
    encoder = tokens.Encoder(tokens.default_path())
    parts = ["a", "B", "é", "1", " ", "\n", "\t", "  ", "'s", "<|endoftext|>", ".", "\r", "word", "\x1c", "\x85", "日本", "😀"]
    texts = ["".join(pick.choices(parts, k=pick.randint(0, 9))) for _ in range(3000)] + [t for t in _texts()[:60] if t]
    for text in texts:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_token_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_PARTS", 50)
    encoder = tokens.Encoder(tokens.default_path())
    text = " ".join(f"w{i % 170}" for i in range(2000))
    assert encoder.encode(text) == tokens.Encoder(tokens.default_path()).encode(text)
    assert len(encoder._parts) <= 50


def test_working_memory_is_a_small_multiple_of_a_block(monkeypatch):
    monkeypatch.setattr(textnp, "_POWERS", {})
    column = pa.array(["some words of a text, and more of them " * 50] * 4000)
    tracemalloc.start()
    n = sum(int(block.bounds[-1]) for block in textnp.blocks(column, textnp.Words.ALNUM))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 9 * 50 * 4000 and peak < 24 << 20
