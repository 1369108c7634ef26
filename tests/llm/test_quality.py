import collections
import re

from stackmeter.llm import quality

from .fixtures import WORD, awkward, frame, prose


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    count = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    hit = set()
    for k in range(len(w) - 2):
        if count[tuple(w[k : k + 3])] > 1:
            hit |= {k, k + 1, k + 2}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def test_measures(spark):
    rows = quality.measures(frame(spark)).collect()
    assert len(rows) == len(awkward())
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(r.text)
        assert not (r.base_failed and r.kept)


def test_rolling_hashes_over_chunk_borders():
    import pyarrow as pa

    from stackmeter.llm import textkernel as tk

    texts = [prose(50, k) for k in range(40)] + [None, "", "a"]
    whole = [c for c in tk.chunks(pa.array(texts))]
    cut = [c for c in tk.chunks(pa.array(texts), size=300)]
    assert len(whole) == 1 and len(cut) > 10
    assert [h for c in whole for h in c.hashes.tolist()] == [h for c in cut for h in c.hashes.tolist()]


def test_stage(spark):
    kept = quality.keep_good(frame(spark))
    assert kept.columns == frame(spark).columns
    ids = {r.doc_id for r in kept.collect()}
    assert {0, 1, 6, 7, 8, None} <= ids and not ids & {3, 4, 5, 9, 11, 12, 16}
    assert quality.keep_good(frame(spark, [])).count() == 0
