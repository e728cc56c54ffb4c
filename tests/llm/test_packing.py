import collections
import random
import zlib

import brute
import numpy as np
import pytest

from poslake.llm import packing, tokens


def _best(items, capacity):
    """The fewest bins, by dynamic programming over subsets."""
    best = [(99, 0)] * (1 << len(items))
    best[0] = (0, capacity + 1)
    for mask in range(1 << len(items)):
        bins, level = best[mask]
        for i, w in enumerate(items):
            if not mask >> i & 1:
                to = (bins, level + w) if bins and level + w <= capacity else (bins + 1, w)
                best[mask | 1 << i] = min(best[mask | 1 << i], to)
    return best[-1][0]


def test_reduction_keeps_an_optimum_and_patterns_hold_all_items():
    pick = random.Random(3)
    for _ in range(250):
        capacity = pick.choice([10, 20, 30])
        items = [pick.randint(1, capacity) for _ in range(pick.randint(1, 9))]
        counts = dict(collections.Counter(items))
        got = collections.Counter()
        for p in packing.solve(counts, capacity):
            assert p.bins > 0 and sum(w * n for w, n in p.lengths.items()) <= capacity
            got.update({w: n * p.bins for w, n in p.lengths.items()})
        assert got == collections.Counter(items)
        left = packing.Counts(counts, capacity)
        fixed = packing.reduce_by_dominance(left)
        rest = [w for w in range(capacity + 1) for _ in range(int(left.n[w]))]
        assert sum(p.bins for p in fixed) + _best(rest, capacity) == _best(items, capacity)


def test_reduction_fixes_sets_of_one_two_and_three():
    fixed = packing.reduce_by_dominance(packing.Counts({10: 2, 7: 1, 3: 1, 6: 1, 2: 2}, 10))
    assert [(p.bins, p.lengths) for p in fixed] == [(2, {10: 1}), (1, {7: 1, 3: 1}), (1, {6: 1, 2: 2})]


def test_work_does_not_grow_with_the_counts():
    counts = {w: 10 ** 12 + w for w in range(1, 1025)}
    patterns = packing.solve(counts)
    assert len(patterns) < 4 * 1024
    total = sum(w * n for w, n in counts.items())
    assert sum(p.bins for p in patterns) * 1024 < 1.03 * total


def test_pieces_and_places(spark, sf_dir):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(tokens.default_path())
    docs = brute.rows("documents", "doc_id", "text") + [(10 ** 6, None), (10 ** 6 + 1, "")]
    out = packing.pack_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in out:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == {d for d, _ in docs}
    total = 0
    for d, text in docs:
        ids, at = tokenizer.encode(text or "", add_special_tokens=False).ids + [2], 0
        own = sorted(pieces[d], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(-(-len(ids) // 1024)))
        for r in own:
            assert r.start == at and (r.length == 1024 or r.piece == 0)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
        total += at
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= 1.05 * total / 1024 + 1


def test_repeated_rows_null_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (None, None)], "doc_id long, text string")
    out = packing.pack_documents(docs).collect()
    assert len(out) == 4 and len({(r.sequence_id, r.offset) for r in out}) == 4
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_lengths_over_the_capacity_are_refused(spark):
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 2000)], "doc_id long, length long"))
