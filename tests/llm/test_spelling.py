import random
import re
import zlib
from collections import Counter

import pytest

from stackmeter.llm import spelling

from .fixtures import awkward, frame, plain


def brute(rows, every=31):
    """(word, form, root, n, n_near, form_n) by comparing each pair of words."""
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    around = {w: [x for x in n if near(w, x)] for w in n}
    form = {}
    for w, others in around.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(around[w]), n.get(form[w])) for w in n}


def found(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_awkward_rows(spark):
    rows = [(r[0], r[1]) for r in awkward()]
    assert found(spelling.group(frame(spark))) == brute(rows)


def test_ties_chains_and_repeated_letters(spark):
    words = {"organoid": 2, "organoide": 30, "organoidé": 30, "organoids": 3, "organooids": 400, "aaaaaaa": 5, "aaaaaaaa": 60, "aaaaaaaaa": 700, "aaaaaab": 5, "baaaaaa": 5}
    rows = [(i, " ".join([w] * k)) for i, (w, k) in enumerate(words.items())]
    got = {r[0]: r for r in found(spelling.group(plain(spark, rows), cut_every=10**10))}
    assert got["organoid"] == ("organoid", "organoide", "organoide", 2, 3, 30)
    assert got["aaaaaaa"][:3] == ("aaaaaaa", "aaaaaaaa", "aaaaaaaaa")
    assert got["aaaaaab"][4] == 1 and got["aaaaaaa"][4] == 3  # one letter left out of aaaaaaaa at any place is one neighbour
    assert set(got.values()) == brute(rows, 10**10)


@pytest.mark.parametrize("seed", range(3))
def test_random_words(spark, seed):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("aé") for _ in range(rng.randint(6, 9))) for _ in range(150)]
    rows = [(rng.choice([None, 1, 2, 10**12]), " ".join(rng.choices(pool, [1 / (k + 1) for k in range(150)], k=rng.randint(0, 300))).title()) for _ in range(30)]
    want = brute(rows)
    assert found(spelling.group(plain(spark, rows).repartition(7))) == want
    assert any(r[1] for r in want) and any(r[4] > 3 for r in want)


def test_no_words(spark):
    assert found(spelling.group(plain(spark, []))) == set()
    assert found(spelling.group(plain(spark, [(1, None), (2, ""), (3, "12 ## short")]))) == set()


def test_cut_runs(spark):
    """Some runs lose a letter: a word that only comes about this way is there."""
    rows = [(i, "measurement") for i in range(400)]
    want = brute(rows)
    assert len(want) > 1 and found(spelling.group(plain(spark, rows))) == want
