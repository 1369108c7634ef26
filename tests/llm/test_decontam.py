import hashlib
import random

import pytest

from stackmeter.llm import decontam

from .fixtures import NORMAL, awkward, frame, lower, plain, prose


def brute(text, items, n=decontam.WINDOW):
    w, hit, found = NORMAL.findall(lower(text or "")), set(), set()
    for key, item in items:
        v = NORMAL.findall(lower(item or ""))
        k = min(n, len(v))
        windows = {tuple(v[j : j + k]) for j in range(len(v) - k + 1)} if k else set()
        for j in range(len(w) - k + 1) if k else ():
            if tuple(w[j : j + k]) in windows:
                hit |= set(range(j, j + k))
                if key is not None:
                    found.add(str(key))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def cases():
    rng = random.Random(2)
    items = [(i, prose(rng.randrange(8, 30), 40 + i, 60)) for i in range(25)] + [(100, "Alpha beta"), (101, "beta"), (102, None), (103, "!!"), (100, "gamma delta"), (None, "nul id item"), (104, prose(15, 41, 60))]
    docs = [(i, " ".join([prose(30, i, 60), items[i % 25][1][: rng.randrange(200)].upper(), prose(10, i, 60)])) for i in range(40)]
    docs += [(50, "x ALPHA, Beta y"), (51, "beta"), (52, "nul id item"), (53, items[0][1]), (54, "gamma  delta\n")] + [(r[0], r[1]) for r in awkward()]
    return items, docs


@pytest.mark.parametrize("block", [decontam.BLOCK_WORDS, 40])
def test_against_brute_force(spark, block):
    items, docs = cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.report(plain(spark, docs), bench, block_words=block).collect()), key=str)
    assert got == sorted(((i, *brute(t, items)) for i, t in docs), key=str)


def test_automaton_knows_every_substring():
    import numpy as np

    words = [np.array([1, 2, 1, 2, 3], dtype=np.uint64), np.array([2, 3, 1], dtype=np.uint64)]
    a = decontam.Automaton.of([("p", words[0]), ("q", words[1])], window=2)
    back = {v: k for k, v in enumerate(a.vocabulary.tolist())}
    for text in ([1, 2], [2, 1], [2, 3], [3, 1], [3, 2], [1, 2, 3], [2, 3, 1]):
        found = set()
        for _, _, items in a.matches([back[w] for w in text]):
            found |= items
        want = {n for n, w in enumerate(words) if any(w.tolist()[j : j + 2] == text[k : k + 2] for j in range(len(w) - 1) for k in range(len(text) - 1))}
        assert found == want, text


def test_stage_cuts_spans_and_drops_copies(spark):
    item = prose(30, 77, 100_000)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    head, tail = prose(60, 78, 100_000), prose(60, 79, 100_000)
    rows = decontam.clean(plain(spark, [(1, head + " (" + item + ") " + tail), (2, item), (3, None), (4, head)]), bench)
    assert {r.doc_id: r.text for r in rows.collect()} == {1: head + " () " + tail, 3: None, 4: head}
    out = decontam.clean(frame(spark), bench)
    assert out.columns == frame(spark).columns and out.count() == len(awkward())
    assert decontam.clean(frame(spark, []), bench).count() == 0
    assert decontam.report(frame(spark), bench.where("false")).count() == len(awkward())


def test_many_blocks_in_one_pass(spark, monkeypatch):
    items, docs = cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontam.report(plain(spark, docs), bench, block_words=20)
    assert out._jdf.queryExecution().toString().count("MapInArrow") <= 4  # one operator, in each of four forms of the plan
    named = spark.createDataFrame([("a", items[0][1]), (None, None)], "doc_id string, text string")
    assert {(r.doc_id, r.contaminated) for r in decontam.report(named, bench).collect()} == {("a", True), (None, False)}
