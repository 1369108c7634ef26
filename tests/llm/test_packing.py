import collections
import random
import zlib

import numpy as np
import pytest

from stackmeter.llm import packing
from stackmeter.llm.queries import vocabulary_path

from .fixtures import awkward, frame


VOCABULARY = vocabulary_path()


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def test_ids_are_those_of_tokenizers(tokenizer):
    rng = random.Random(4)
    letters = "ab 1\n\t'sé中\U0001f600<|>.#"
    made = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(300)]
    special = [x[:20] + "<|endoftext|>" + x[20:] + " <|endoftext|>" for x in made[:50]]
    for t in ["", "a", "Ünï cödé \U0001f600 \n\n x", "<|endoftext|> it's", "a" * 500, "   \t1234567", " " * 400_000, *made, *special]:
        assert packing.token_ids(t, VOCABULARY).tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 0]


def test_classes_are_reciprocal():
    for n in range(1, 1025):
        k = packing.harmonic_class(n)
        assert 1024 / (k + 1) < n <= 1024 / k


def packed(lengths, capacity=64, **bounds):
    packer = packing.Packer(capacity, **bounds)
    done = []
    for doc, n in enumerate(lengths):
        done += packer.add(doc, np.arange(n, dtype="<u4"))
        assert len(packer.gaps) <= packer.waiting and len(packer.of_class) <= packer.dense
    return done, list(packer.finish())


def test_bins_hold_their_class_s_count_and_are_full():
    # 40 tokens are of class 1, 25 of class 2, 3 are small: they fill what the others leave.
    done, last = packed([40, 25, 25, 40, *[3] * 40])
    assert sorted(sum(p.start == 0 and len(p.ids) == p.doc_tokens > 3 for p in s) for s in done)[-1] == 2
    assert {len(p.ids) for s in done for p in s if p.doc_tokens > 3} == {40, 25}
    assert all(sum(len(p.ids) for p in s) == 64 for s in done)
    sizes = [sum(len(p.ids) for p in s) for s in last]
    assert all(x & (x - 1) == 0 for x in sizes) and sum(sizes) < 4 * 64


@pytest.mark.parametrize("seed", range(8))
def test_every_token_once_and_no_padding(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([1, 64, 33, rng.randrange(1, 400), rng.randrange(1, 12)]) for _ in range(rng.randrange(300))]
    done, last = packed(lengths, waiting=rng.choice([1, 8]))
    held = collections.defaultdict(list)
    for s in done + last:
        size = sum(len(p.ids) for p in s)
        assert size == 64 or size & (size - 1) == 0
        for p in s:
            assert p.ids.tolist() == list(range(p.start, p.start + len(p.ids))) and p.doc_tokens == lengths[p.doc]
            held[p.doc].append((p.start, len(p.ids)))
    for doc, n in enumerate(lengths):
        at = 0
        for start, length in sorted(held[doc]):
            assert start == at
            at += length
        assert at == n
    # One bin of each class and the waiting ones are all that is laid out anew.
    assert len(done) >= sum(lengths) // 64 - 8 - 7


def test_pieces_are_whole_and_sequences_gapless(spark, tokenizer):
    rows = packing.pack(frame(spark).repartition(3), VOCABULARY).collect()
    ids = collections.defaultdict(list)
    for row in awkward():
        ids[row[0]].append(np.array([*tokenizer.encode(row[1] or "", add_special_tokens=False).ids, 0], dtype="<u4"))
    for r in rows:
        assert any(zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 and len(x) == r.doc_tokens for x in ids[r.doc_id])
    tokens = collections.Counter()
    for r in rows:
        tokens[r.doc_id] += r.length
    assert tokens == {k: sum(map(len, x)) for k, x in ids.items()}
    held = collections.defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY and (at == packing.CAPACITY or at & (at - 1) == 0)


def test_ids_of_any_type_and_empty_table(spark):
    named = spark.createDataFrame([("x", "one two"), (None, None)], "doc_id string, text string")
    assert {(r.doc_id, r.doc_tokens) for r in packing.pack(named, VOCABULARY).collect()} == {("x", 3), (None, 1)}
    assert packing.pack(frame(spark, []), VOCABULARY).count() == 0
