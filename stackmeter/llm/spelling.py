"""Grouping of spelling variants: words that differ by one code point, without comparing words in pairs.

Words are counted over all texts.  Two words of one length are near if they agree under a wildcard: each word stands in
one group for each of its places, named by (place, prefix, suffix), and a group needs to know only its size and its two
most frequent words, for a word's best neighbour in it is the first of the two, or the second for the first itself.  A
group holds no more words than the alphabet has letters, whatever the input.  Words of lengths that differ by one are
near if the longer with a code point left out is the shorter: these deletions are joined with the vocabulary.  Both
kinds give (word, number of near words, best one), which add up by word.

Defined results.  A null or empty text, and a text without a run of letters, has no word; an empty table gives no row.
A null id counts as the empty string.  Repeated rows count each time; a run is as long as its text has it, however long
the text.  Of near words with equal counts the smallest in code-point order is taken.  Only ``doc_id`` and ``text`` are
read, so other columns may have any name.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import storage

#: Letters of a run; the shortest word; the least count of a word; one run in so many loses a code point.
LETTERS, LEAST_LENGTH, LEAST_COUNT, CUT_EVERY = "A-Za-zÀ-ÿ", 7, 2, 31
#: A word's form is at least so many times as frequent.
RATIO = 10
#: Stands for the free place in a group's name; no letter of a run.
WILD = "*"


def _lower(run: Column) -> Column:
    """A-Z in lower case only; ``lower`` would change accented letters too."""
    return F.when(F.octet_length(run) == F.char_length(run), F.lower(run)).otherwise(F.translate(run, string.ascii_uppercase, string.ascii_lowercase))


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, cut_every: int = CUT_EVERY) -> DataFrame:
    """(word, n): the words of all texts.  A run whose key ``crc32("<doc_id>:<run>")`` is a multiple of ``cut_every`` first loses one code point."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))).alias("run"))
    keyed = runs.select("id", _lower(F.col("run")).alias("run")).select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = F.when(F.col("h") % cut_every == 0, cut).otherwise(F.col("run"))
    counted = keyed.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where((F.length("word") >= least_length) & (F.col("n") >= least_count))


def _places(word: Column) -> Column:
    return F.sequence(F.lit(1), F.length(word))


def _without(word: Column, place: Column, filler: str) -> Column:
    return F.concat(F.substring(word, F.lit(1), place - 1), F.lit(filler), F.substring(word, place + 1, F.length(word)))


def _rank(n: str, word: str) -> Column:
    """Least for the most frequent, then the smallest word."""
    return F.struct((-F.col(n)).alias("rank"), F.col(word).alias("word"))


def by_replacement(words: DataFrame) -> DataFrame:
    """(word, near, best) for each place of a word at which another word differs: from the group's size and first two words."""
    place = F.explode(_places(F.col("word")))
    named = words.select("word", "n", place.alias("place")).select("word", "n", _without(F.col("word"), F.col("place"), WILD).alias("group"))
    group = Window.partitionBy("group").orderBy(F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    summed = named.select("word", F.count(F.lit(1)).over(group).alias("size"), F.first(_rank("n", "word")).over(group).alias("top"), F.nth_value(_rank("n", "word"), 2).over(group).alias("second"))
    best = F.when(F.col("word") == F.col("top.word"), F.col("second")).otherwise(F.col("top"))
    return summed.where("size > 1").select("word", (F.col("size") - 1).alias("near"), best.alias("best"))


def by_deletion(words: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(word, near, best) for both ends of each hit of a word's deletions in the vocabulary."""
    shorter = F.array_distinct(F.transform(_places(F.col("word")), lambda p: _without(F.col("word"), p, "")))
    cut = words.where(F.length("word") > least_length).select(F.col("word").alias("long"), F.col("n").alias("long_n"), F.explode(shorter).alias("short"))
    hits = cut.join(words.select(F.col("word").alias("short"), F.col("n").alias("short_n")), "short")
    ends = F.array(
        F.struct(F.col("long").alias("word"), _rank("short_n", "short").alias("best")),
        F.struct(F.col("short").alias("word"), _rank("long_n", "long").alias("best")),
    )
    return hits.select(F.explode(ends).alias("e")).select("e.word", F.lit(1).cast("long").alias("near"), "e.best")


def neighbours(words: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(word, n, n_near, form, form_n)."""
    found = by_replacement(words).unionByName(by_deletion(words, least_length)).groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    taken = -F.col("best.rank") >= RATIO * F.col("n")
    return words.join(found, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(taken, F.col("best.word")).alias("form"), F.when(taken, -F.col("best.rank")).alias("form_n"),
    )


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words with a form.  Counts grow tenfold from word to form, so no chain closes or exceeds 18 steps; each round doubles the step."""
    at = storage.materialise(forms.where("form is not null").select("word", F.col("form").alias("root")), "spelling-forms")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = at.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        new = storage.materialise(new, "spelling-roots")
        if new.where("moved").isEmpty():
            return new.select("word", "root")
        at = new.select("word", "root")


def group(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, cut_every: int = CUT_EVERY) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``docs``."""

    def make() -> DataFrame:
        words = storage.materialise(vocabulary(docs, least_length, least_count, cut_every), "spelling-words")
        forms = storage.materialise(neighbours(words, least_length), "spelling-near")
        return forms.join(roots(forms), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

    return storage.alone(docs.sparkSession, "spelling", make)
