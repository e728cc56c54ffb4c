import collections
import math
import random

import brute

from poslake.llm import licenses


def test_base_columns_and_labels(spark):
    pick = random.Random(1)
    docs = brute.rows("documents", "doc_id", "text")
    docs += [(10 ** 5 + i, " ".join(pick.choices(["MIT", "License", "apache", "general", "public", "é", "-"], k=pick.randint(0, 25)))) for i in range(200)]
    docs += [(20, None), (21, ""), (None, "mit license"), (5, "mit license"), (5, "mit license")]
    got = licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    want = collections.Counter((d, *brute.phrases(t, licenses.BASE)) for d, t in docs)
    assert collections.Counter(tuple(r)[:6] for r in got) == want
    assert all(set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)


def test_the_method_finds_notices_without_a_base_phrase(spark):
    plain = [(i, "Nothing of note stands here, and the rest is quiet.") for i in range(60)]
    odd = [(100, "Some words first. Licensed under CC BY-NC 4.0."), (101, "Redistribution and use in source and binary forms, with or without "
           "modification, are permitted provided that the following conditions are met:"), (102, "binary source or forms use and redistribution"),
           (103, "This is free and unencumbered software released into the public domain.")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(plain + odd, "doc_id long, text string")).collect()}
    assert [got[i].labels for i in (0, 100, 101, 102, 103)] == ["", "cc-by-nc", "bsd", "", "unlicense"]
    assert got[101].score > 0.9 and got[101].base_labels == "" and got[102].score == 0


def test_a_notice_on_half_of_the_documents_is_found(spark):
    for label in ("cc-by-nc", "bsd", "cc-by", "unlicense"):
        notice = next(t.text for t in licenses.TEMPLATES if t.label == label)
        docs = [(i, f"Page {i} has other words. " + (notice if i % 2 else "And no notice.")) for i in range(40)]
        got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
        assert all(got[i].labels == (label if i % 2 else "") for i in range(40))
        assert all((got[i].score > 0.9) == (i % 2 == 1) for i in range(40))


def test_every_notice_of_a_file_with_many_is_found(spark):
    notices = {t.name: t.text for t in licenses.TEMPLATES}
    plain = [(i, "Nothing of note stands here, and the rest is quiet.") for i in range(60)]
    every = [(100, "\n".join(notices.values())), (101, "\n".join(notices[x] for x in ("bsd", "mit", "cc-by", "mpl"))),
             (102, " filler of the text and the source ".join(notices.values()))]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(plain + every, "doc_id long, text string")).collect()}
    labels = sorted({t.label for t in licenses.TEMPLATES})
    assert got[100].labels.split(",") == labels and got[102].labels.split(",") == labels
    assert got[101].labels == "bsd,cc-by,mit,mpl" and got[101].score > 0.9 and got[5].labels == ""


def _brute(docs):
    """(labels, score) of each text, place by place."""
    words = [brute.alnum(t) for _, t in docs]
    weight = {}
    for w in {w for t in licenses.TEMPLATES for w in t.text.split()}:
        weight[w] = max(licenses.FLOOR, math.log((1 + len(docs)) / (1 + sum(w in set(ws) for ws in words))))
    out = []
    for ws in words:
        line, labels, score = f" {' '.join(ws)} ", {b for p, b in licenses.BASE.items() if f" {p} " in f" {' '.join(ws)} "}, 0.0
        for t in licenses.TEMPLATES:
            of = t.text.split()
            rare = sorted(set(of), key=lambda w: (-weight[w], w))[:licenses.RARE]
            if not all(f" {p} " in line for p in t.mandatory):
                continue
            for at in range(-len(of) - 2, len(ws) + 3):
                there = {w for w in rare for q in range(len(of)) if of[q] == w and w in ws[max(0, at + q - 2):max(0, at + q + 3)]}
                if 4 * len(there) >= 3 * len(rare):
                    labels.add(t.label)
                    score = max(score, sum(weight[w] for w in there) / sum(weight[w] for w in rare))
        out.append((",".join(sorted(labels)), round(score, 9)))
    return out


def test_labels_and_scores_against_brute_force(spark):
    pick = random.Random(4)
    docs = [(i, t) for i, (_, t) in enumerate(brute.rows("documents", "doc_id", "text")[:150])]
    for _ in range(200):
        body = []
        for t in pick.choices(licenses.TEMPLATES, k=pick.randint(1, 3)):
            body += pick.choices(["alpha", "the", "software", "license", "of"], k=pick.randint(0, 6))
            for w in t.text.split():
                body += pick.choices([[w], [], ["odd"], [w, "odd"]], [50, 1, 1, 2])[0]
        docs.append((len(docs), " ".join(body)))
    docs += [(len(docs), None), (len(docs) + 1, "")]
    got = {r.doc_id: (r.labels, round(r.score, 9)) for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [got[i] for i, _ in docs] == _brute(docs)
    assert any(0 < s < 1 for _, s in got.values()) and any(s == 1 for _, s in got.values())


def test_a_quoted_phrase_is_no_notice_and_a_changed_notice_is(spark):
    plain = [(i, "Nothing of note stands here, and the rest is quiet.") for i in range(60)]
    for t in licenses.TEMPLATES:
        extra = len(set(t.text.split())) - len({w for p in t.mandatory for w in p.split()})
        if t.name == "mit" or 4 * extra > len(set(t.text.split())):  # the phrase is not nearly the whole notice
            plain.append((1000 + len(plain), f"Our lawyers rejected {t.mandatory[0]} last year."))
    changed = "This source code module is subject to all terms of the Mozilla Public License, v. 2.0"
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(plain + [(100, changed)], "doc_id long, text string")).collect()}
    assert all(r.labels == r.base_labels and r.score == 0 for i, r in got.items() if i >= 1000)
    assert got[100].labels == "mpl" and 0.5 < got[100].score < 1


def test_empty_and_clashing(spark):
    docs = spark.createDataFrame([(1, "mit license", "z")], "doc_id long, text string, labels string")
    assert licenses.scan(docs).collect()[0].labels == "mit"
    assert licenses.scan(docs.limit(0)).count() == 0


def test_no_python_runs(spark, sf_dir):
    plan = licenses.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
