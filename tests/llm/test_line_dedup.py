import random

import pytest

from stackmeter.llm import line_dedup

from .fixtures import WORD, awkward, frame, plain


def runs_of(text, min_words):
    """(start, end) of all runs of lines with a word and enough words."""
    words = [len(WORD.findall(x)) for x in text.split("\n")]
    for a in range(len(words)):
        total = 0
        for b in range(a, len(words)):
            if not words[b]:
                break
            total += words[b]
            if total >= min_words:
                yield a, b + 1


def brute(pairs, min_words=line_dedup.MIN_WORDS):
    """What is left of each (id, text), in any order, by all runs of lines: of equal rows one comes first."""
    keyed = sorted(((i, t or "") for i, t in pairs), key=lambda x: (x[0] is not None, x[0] or 0))
    runs = {}
    for n, (_, text) in enumerate(keyed):
        lines = text.split("\n")
        for a, b in runs_of(text, min_words):
            runs.setdefault(tuple(lines[a:b]), []).append((n, a, b))
    gone = [set() for _ in keyed]
    for places in runs.values():
        for n, a, b in sorted(places)[1:]:
            gone[n] |= set(range(a, b))
    return sorted(((k[0], "\n".join(x for j, x in enumerate(k[1].split("\n")) if j not in g)) for k, g in zip(keyed, gone, strict=True)), key=str)


def check(spark, pairs):
    got = sorted(((r.doc_id, r.text or "") for r in line_dedup.report(plain(spark, pairs)).collect()), key=str)
    assert got == brute(pairs)


def test_against_brute_force(spark):
    rng = random.Random(5)
    lines = ["a b c", "d e", "f", "g h i j k", "", "l m n o p q r", "s"]
    check(spark, [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(12)))) for i in range(60)])


def test_long_runs_and_repeats_in_one_document(spark):
    block = "\n".join(f"only {i}" for i in range(40))
    check(spark, [(1, block + "\nx\n" + block), (2, "y\n" + block), (3, "only 3\nonly 4\nonly 5"), (4, None)])


def test_awkward_rows(spark):
    out = line_dedup.report(frame(spark)).collect()
    assert len(out) == len(awkward())
    kept = line_dedup.dedup(frame(spark))
    assert kept.columns == frame(spark).columns
    ids = [r.doc_id for r in kept.collect()]
    assert 6 in ids and 17 not in ids and None in ids and 1 not in ids
    assert line_dedup.dedup(frame(spark, [])).count() == 0


def test_equal_rows(spark):
    text = "one two three four five\n\nsix\nseven"
    check(spark, [(1, text), (1, text), (1, text), (2, "six\nseven"), (None, text), (None, text)])
    named = spark.createDataFrame([("b", "a b c d e\nf"), ("a", "a b c d e\ng")], "doc_id string, text string")
    assert {r.doc_id: r.text for r in line_dedup.report(named).collect()} == {"a": "a b c d e\ng", "b": "f"}


@pytest.mark.parametrize("seed", range(3))
def test_copies_with_edits(spark, seed):
    """Long runs, many copies, repeats within and ends of islands; the array runs over several ranges."""
    rng = random.Random(seed)
    base = [rng.choice(["x", "y z", f"u{rng.randrange(9)} v"]) for _ in range(45)]
    pairs = []
    for i in range(40):
        lines = list(base)
        for _ in range(rng.randrange(4)):
            lines[rng.randrange(len(lines))] = rng.choice(["", "new", f"own {i}", "x"])
        at = rng.randrange(len(lines))
        pairs.append((i, "\n".join(lines[at:] + lines[: rng.randrange(20)])))
    check(spark, pairs)


def array_of(spark, texts):
    tables = line_dedup.Tables(plain(spark, []))
    docs = plain(spark, list(enumerate(texts))).withColumn("__row", line_dedup._key())
    rows, _ = line_dedup.suffixes(tables, docs)
    rows, rounds = line_dedup.suffix_array(tables, rows)
    rows = tables.put(rows, "rows")
    got = line_dedup.with_prefixes(tables, rows, rounds).collect()
    return rounds, sorted(got, key=lambda r: (r.part, r.row)), rows.collect()


def test_suffix_array_and_prefixes(spark):
    """Every suffix is fully ranked: the array is in the order of the whole sequences, and so are the prefixes."""
    rng = random.Random(8)
    texts = ["\n".join(rng.choice("ppqrs") for _ in range(rng.randrange(1, 40))) for _ in range(25)] + ["p\nq\n" * 20] * 3
    rounds, array, rows = array_of(spark, texts)
    ids = {(r.doc, r["at"]): r.r0 for r in rows}
    whole = lambda r: tuple(ids[r.doc, r["at"] + j] for j in range(next(x.left for x in rows if (x.doc, x["at"]) == (r.doc, r["at"]))))
    seqs = [whole(r) for r in array]
    assert rounds >= 5 and seqs == sorted(seqs) and len(array) == len(rows) > 300
    for a, b, r in zip(seqs, seqs[1:], array[1:], strict=False):
        n = next((j for j, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert r.lcp == n
    assert array[0].lcp == 0


def test_depths_are_of_the_first_copy_elsewhere():
    """Ablation: the depth of an interval decides, not a fixed number of lines."""
    places, lcps = [10, 5, 30, 20], [0, 7, 3, 6]
    assert line_dedup.scan(places, lcps)[0] == [0, 0, 3, 3]
    back, _ = line_dedup.scan(places[::-1], [0, *lcps[:0:-1]])
    assert back[::-1] == [7, 0, 6, 0]


@pytest.mark.parametrize("seed", range(5))
def test_ranges_are_scanned_apart(seed):
    """Cut anywhere, ranges and what they pass on give the depths of the whole."""
    rng = random.Random(seed)
    places = rng.sample(range(1000), 60)
    lcps = [0] + [rng.choice([0, 1, 2, 5, 9]) for _ in range(59)]
    whole, _ = line_dedup.scan(places, lcps)
    cuts = [0, *sorted(rng.sample(range(1, 60), 5)), 60]
    way = line_dedup.Scan()
    got = []
    for a, z in zip(cuts, cuts[1:], strict=False):
        own, end = line_dedup.scan(places[a:z], [0, *lcps[a + 1 : z]])
        reach = 1 << 40
        for place, lcp, d in zip(places[a:z], lcps[a:z], own, strict=True):
            reach = min(reach, lcp)
            got.append(max([d] + [min(x, reach) for p, x in way.entries if p < place]))
        end.reach = min(lcps[a:z])
        way = line_dedup.Scan(end.onto(way))
    assert got == whole
