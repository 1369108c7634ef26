"""Small tables with every awkward case, and the word rules in plain Python."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
NORMAL = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def prose(n, seed, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}{'é' if rng.random() < 0.05 else ''}" for _ in range(n))


def awkward():
    """(doc_id, text, lang, source, n_chars, start, size): nulls, empty and long texts, copies, repeated rows, clashing names."""
    base, long = prose(120, 1), prose(30_000, 2, 5000)
    shared = prose(60, 3)
    texts = [
        (0, base), (1, base), (2, base.replace("w1 ", "w2 ", 1)), (3, None), (4, ""), (5, "  \n\t "), (6, long), (7, prose(80, 4) + "\n" + shared + "\n" + prose(70, 5)),
        (8, prose(90, 6) + "\n" + shared + "\n" + prose(75, 7)), (9, "one"), (9, "one"), (10, "two words"), (11, "x " * 400), (12, "line of some words here\n" * 30),
        (None, base), (13, "Ünï cödé \U0001f600 " + prose(60, 8)), (14, prose(13, 9)), (15, prose(13, 9)), (16, "### $$$ " * 60), (17, long), (18, None),
    ]
    return [(i, t, None if i == 3 else "en", None if i == 4 else "s", None if t is None else len(t), 7, 8) for i, t in texts]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, start int, size int"


def frame(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)


def plain(spark, pairs):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 1, 2) for i, t in pairs], SCHEMA)
