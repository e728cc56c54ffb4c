import collections
import hashlib
import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from poslake.llm import align, tokens

ODD = [None, "", " ", "  a  b \n c\tx   ", "<|endoftext|> <s> </s> <unk> <0x41>", "▁x y", "naïve café ☃ 😀 ‍", "\x00\x01", "a" * 3000, "foo \nbar  baz\r\n",
       "été " * 400, "x", "\n", "日本語のテキスト", "don't we'll 12345 3.14", "one two", "A" + " " * 50 + "B"]


def brute_rows(docs):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(tokens.default_path())
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=align.piece_path())
    byte = tokens._byte_of_character()
    found = []
    for doc, text in docs:
        ia, ib = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        ta = [bytes(byte[c] for c in a.id_to_token(i)) for i in ia]
        tb = [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        if text and not b"".join(ta) == b"".join(tb) == (" " + text).encode():
            ia, ib, ta, tb = [], [], [], []
        ends_a, ends_b = np.cumsum([len(t) for t in ta]).tolist(), np.cumsum([len(t) for t in tb]).tolist()
        both = sorted(set(ends_a) & set(ends_b))
        groups, links, start = [], [], 0
        for end in both:
            groups.append(",".join(str(i) for i, e in zip(ia, ends_a, strict=True) if start < e <= end) + "|" + ",".join(str(i) for i, e in zip(ib, ends_b, strict=True) if start < e <= end))
            start = end
        at_a, at_b = dict(zip(ends_a, ia, strict=True)), dict(zip(ends_b, ib, strict=True))
        links = [(at_a[e], at_b[e]) for e in both]
        found.append((doc, len(ia), len(ib), len(both), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    count = collections.Counter(x for f in found for x in f[4])
    best = collections.defaultdict(int)
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    return sorted((d, na, nb, g, len(ls), sum(count[x] == best[x[1]] for x in ls), sum(count[x] for x in ls), s) for d, na, nb, g, ls, s in found)


def test_documents_against_brute_force(spark):
    docs = [r for r in brute.rows("documents", "doc_id", "text") if len(r[1] or "") < 8000] + list(enumerate(ODD, 10 ** 6)) + [(10 ** 6, "repeated id")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("links", F.lit(1)).withColumn("n_a", F.lit("x")).repartition(5)
    got = align.alignment_table(df).collect()
    assert sorted(map(tuple, got)) == brute_rows(docs)
    assert align.alignment_table(df.limit(0)).collect() == []


def test_all_overlaps_and_groups_of_random_tilings():
    pick = random.Random(5)
    for _ in range(200):
        n = pick.randint(1, 30)
        cuts = [sorted({*pick.sample(range(1, n), pick.randint(0, n - 1)), n}) if n > 1 else [1] for _ in range(2)]
        (a_ends, b_ends) = (np.array(c) for c in cuts)
        a_starts, b_starts = (np.concatenate(([0], e[:-1])) for e in (a_ends, b_ends))
        got = set(zip(*map(np.ndarray.tolist, align.overlaps(a_starts, a_ends, b_starts, b_ends)), strict=True))
        assert got == {(i, j) for i in range(len(a_ends)) for j in range(len(b_ends)) if a_starts[i] < b_ends[j] and b_starts[j] < a_ends[i]}
        side = np.repeat([0, 1], (len(a_ends), len(b_ends)))
        order, group = align.coalesce(np.concatenate((a_starts, b_starts)), np.concatenate((a_ends, b_ends)), side)
        both = sorted(set(a_ends.tolist()) & set(b_ends.tolist()))
        ends = np.concatenate((a_ends, b_ends))[order]
        assert group.tolist() == [sum(x < e for x in both) for e in ends.tolist()]


def test_pairs_that_can_be_linked_are_suffixes():
    a, b = {0: b"xab", 1: b"b", 2: b"c"}, {0: b"ab", 1: b"b", 5: b"zzc"}
    assert {(k >> 32, k & 0xFFFFFFFF) for k in align.linkable(a, b).tolist()} == {(0, 0), (0, 1), (1, 0), (1, 1), (2, 5)}


@pytest.mark.parametrize("sizes", [[5], [3, 0, 9, 0, 0, 2]])
def test_blocks_hold_all_texts(monkeypatch, sizes):
    import pyarrow as pa
    monkeypatch.setattr(align, "BLOCK_BYTES", 4)
    texts = ["x" * n if n else None for n in sizes]
    found = list(align._blocks(pa.array(texts, pa.string())))
    assert [t for _, block in found for t in block] == texts
    assert [first for first, _ in found] == np.cumsum([0] + [len(b) for _, b in found[:-1]]).tolist()
