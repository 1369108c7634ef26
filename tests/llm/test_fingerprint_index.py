import hashlib
import random

import pytest

from stackmeter.llm import fingerprint_index as fi

from .fixtures import WORD, awkward, frame, plain, prose


def brute(pairs, n=fi.WINDOW):
    first = {}
    for i, t in pairs:
        w = WORD.findall(t or "")
        for k in range(len(w) - n + 1) if i is not None else ():
            key = tuple(w[k : k + n])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, t in pairs:
        w = WORD.findall(t or "")
        gone = set()
        for k in range(len(w) - n + 1) if i is not None else ():
            if first[tuple(w[k : k + n])] < i:
                gone |= set(range(k, k + n))
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("n_batches", [1, 3])
def test_against_brute_force(spark, n_batches):
    rng = random.Random(3)
    passages = [prose(k, 50 + k, 3000) for k in (12, 13, 14, 60)]
    pairs = [(i, " ".join([prose(rng.randrange(40), i, 3000)] + [p for p in passages if rng.random() < 0.5] + [prose(20, 500 + i, 3000)])) for i in range(60)]
    pairs += [(r[0], r[1]) for r in awkward()] + [(200, "a b " * 300), (201, "a b " * 20)]
    pairs = [(None if i is None else i + (1000 if n >= 60 else 0), t) for n, (i, t) in enumerate(pairs)]
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in fi.report(plain(spark, pairs), n_batches).collect()), key=str)
    assert got == brute(pairs)


def test_runs_are_compacted(spark):
    index = fi.FingerprintIndex(spark, fan_out=2)
    docs = [plain(spark, [(10 * b + i, prose(40, b * 7 + i % 2)) for i in range(4)]).select("doc_id", "text") for b in range(5)]
    for d in docs:
        index.ingest(d)
    assert sorted(level for level, _ in index.runs) == [0, 2]
    held = index._read(index.runs[0][1]).count() + index._read(index.runs[1][1]).count()
    assert held > 0


def test_stage_and_edges(spark):
    out = fi.dedup(frame(spark))
    assert out.columns == frame(spark).columns and out.count() == len(awkward())
    assert fi.report(frame(spark, [])).count() == 0
