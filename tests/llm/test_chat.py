import pytest

from poslake.llm import chat

LINES = "conv_id long, turn long, role string, text string, extra int"


@pytest.fixture(scope="module")
def logs(spark):
    return chat.transcript(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")).cache()


def test_roles_are_recovered_from_other_conversations(spark, logs):
    model = chat.fit(logs.filter("conv_id % 3 > 0"))
    held = logs.filter("conv_id % 3 = 0")
    found = chat.recover_roles(held.withColumnRenamed("role", "truth"), model)
    assert found.count() == held.count() > 100
    assert found.filter("truth = __role").count() >= 0.97 * held.count()


def test_short_segments_give_the_same_path(spark, logs, monkeypatch):
    model = chat.fit(logs)
    whole = {tuple(r) for r in chat.recover_roles(logs, model).collect()}
    monkeypatch.setattr(chat, "SEGMENT", 2)
    assert {tuple(r) for r in chat.recover_roles(logs, model).collect()} == whole


def test_path_is_the_best_of_all(spark, monkeypatch):
    import itertools

    import numpy as np
    model = chat.fit(spark.createDataFrame([(1, 0, "user", "User: hi?", 0), (1, 1, "assistant", "AI: yes, sure", 0), (1, 2, "user", "fine", 0)], LINES))
    pick = np.random.default_rng(4)
    seen = [pick.integers(0, t.shape[1], 6) for t in model.shows]
    shown = model.emissions(seen)

    def value(path):
        return model.start[path[0]] + sum(shown[k, r] for k, r in enumerate(path)) + sum(model.follows[a, b] for a, b in itertools.pairwise(path))

    best = max(value(p) for p in itertools.product(range(3), repeat=6))
    assert value(chat._decode(model, shown, model.start, -1)) == pytest.approx(best)


def test_canonical_turns_and_odd_rows(spark):
    model = chat.fit(spark.createDataFrame([(c, t, ("user", "assistant")[t % 2], ("Human: ", "AI: ")[t % 2] + "x", 0) for c in range(9) for t in range(4)], LINES))
    rows = [(1, 0, "?", "Human: what?", 7), (1, 1, "?", "AI: that", 8), (None, None, None, None, 9), (2, 5, "?", "", 1), (2, 5, "?", "", 1)]
    got = chat.recover_roles(spark.createDataFrame(rows, LINES), model).collect()
    assert len(got) == 5
    by = {(r.conv_id, r.turn): r for r in got}
    assert by[1, 0]["__rendered"] == "<|im_start|>user\nwhat?<|im_end|>\n" and by[1, 0]["__starts"] and by[1, 0].extra == 7
    assert by[1, 1]["__role"] == "assistant"
    empty = spark.createDataFrame([], LINES)
    assert chat.recover_roles(empty, chat.fit(empty)).count() == 0
