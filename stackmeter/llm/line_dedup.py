"""Line deduplication by a suffix array over line-ID sequences (operator 3).

Lines with a word get IDs; a line that occurs once ends every repeated run, and so does
a line without a word, which keeps its place (as in the query's SQL).  So the suffixes
are those of islands, stretches of neighbouring lines that all occur twice or more.

1. Prefix doubling.  Round k ranks each suffix by its first 2**k lines (or to its island's
   end): the pair (own rank, rank 2**k lines on) is ranked among the distinct pairs, which are
   counted first, so a pair shared by a third of all lines is one row of the sort.  An
   island leaves when each of its suffixes has a rank of its own or ends within 2**k
   lines; rounds go on until none is left.
2. The suffix array is the order of the ranks of all rounds, equal sequences by place.
3. Longest common prefixes of neighbours: the round that parts two neighbours bounds it to
   a power of two.  Only irreducible neighbours (preceded by different lines) compare the
   lines beyond that bound, which all in all is ``O(n log n)`` lines; every other value is
   the one of the line before less one.
4. LCP intervals: a stack over the array, from both sides, finds for each suffix the deepest
   interval in which it is not the first of the corpus (by document id, then line).  Each
   range of the array is scanned by itself and passes on what its neighbours need, which
   is no more than one entry for each depth that reaches across.
5. From each place, the lines of that depth are a maximal repeated run whose first copy is
   elsewhere.  If it has ``min_words`` words it is deleted.

Defined results: a null text has no lines; lines without a word are never deleted; of
rows equal in id and text one keeps its lines, and no other columns decide which; rows
with one id are ordered by a hash of the text; ids may be of any type, a null id
comes first; a text of any length is one sequence, its lines pass through one
task; a document that loses every line with a word is dropped by ``dedup`` and has an empty
text in ``report``; an empty table stays empty; other columns pass through, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import storage
from . import textkernel as tk

MIN_WORDS = 5


class Tables:
    """Tables between the steps, deleted when they are no longer read."""

    def __init__(self, docs: DataFrame):
        self.spark, self.paths = docs.sparkSession, []

    def put(self, df: DataFrame, name: str) -> DataFrame:
        self.paths.append(storage.new_path(self.spark, name))
        return storage.materialise(df, name, self.paths[-1])

    def drop(self, keep: int = 0) -> None:
        """Delete all but the last ``keep`` tables."""
        gone = self.paths[: len(self.paths) - keep]
        self.paths = self.paths[len(gone) :]
        for p in gone:
            storage.drop(self.spark, p)


def _ranked(tables: Tables, rows: DataFrame, columns: list[str], *more) -> DataFrame:
    """Distinct ``columns`` with a dense ``rank`` in their order and ``more`` aggregates: sorted by range, numbered in
    each partition, and moved on by the partitions before (one row for each partition)."""
    distinct = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"), *more)
    ranged = tables.put(
        distinct.repartitionByRange(*columns)
        .sortWithinPartitions(*columns)
        .withColumn("part", F.spark_partition_id())
        .withColumn("row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))),
        "ranks",
    )
    before = ranged.groupBy("part").count().select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))
    return ranged.join(F.broadcast(before), "part").withColumn("rank", F.col("before") + F.col("row") + 1).drop("part", "row", "before")


def lines(docs: DataFrame, key: str = "__row", text: str = "text") -> DataFrame:
    """(doc, at, two hashes of the line, words) of every line with a word."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in tk.chunks(b.column(1)):
                ends = np.flatnonzero(c.data == 10)
                starts = np.unique(np.concatenate([c.bounds[:-1], ends + 1]))
                doc = np.searchsorted(c.bounds, starts, side="right") - 1
                inside = doc < len(c.rows)
                starts, doc = starts[inside], doc[inside]
                nth = np.searchsorted(ends, starts)
                stops = np.minimum(np.append(ends, len(c.data))[nth], c.bounds[doc + 1])
                at = nth - np.searchsorted(ends, c.bounds[doc])
                words = np.searchsorted(c.starts, stops) - np.searchsorted(c.starts, starts)
                some = words > 0
                starts, stops, doc, at, words = starts[some], stops[some], doc[some], at[some], words[some]
                one = tk.span_hash(c.prefix, starts, stops, tk._P)
                two = tk.span_hash(tk.prefix_sum(tk._BYTE[c.data], tk._Q), starts, stops, tk._Q)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(c.rows[doc])), pa.array(at, pa.int32()), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(words, pa.int32())],
                    ["doc", "at", "h1", "h2", "words"],
                )

    return storage.text_batches(docs).select(key, text).mapInArrow(storage.lean(run), f"doc {kind}, at int, h1 long, h2 long, words int")


def suffixes(tables: Tables, docs: DataFrame, key: str = "__row", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc, at, s0, left, prev, words, r0) of the lines of islands, and (key, doc): documents by number in the keys' order.

    ``s0`` is the island's first line, ``left`` the lines up to its end, ``prev`` the line's ID before (0: none).
    """
    every = tables.put(lines(docs, key, text), "lines")
    ids = every.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    r0 = _ranked(tables, ids.drop("n"), ["h1", "h2"]).select("h1", "h2", F.col("rank").alias("r0"))
    held = tables.put(every.join(r0, ["h1", "h2"]).select("doc", "at", "words", "r0").dropDuplicates(["doc", "at"]), "repeated")
    numbers = tables.put(_ranked(tables, held.select("doc"), ["doc"]).select(F.col("doc").alias("key"), F.col("rank").alias("doc")), "numbers")
    rows = held.withColumnRenamed("doc", "key").join(numbers, "key").drop("key")
    # In an island, line number minus row number is constant.
    rows = rows.withColumn("s0", F.col("at") - F.row_number().over(Window.partitionBy("doc").orderBy("at")))
    island = Window.partitionBy("doc", "s0")
    first, last = F.min("at").over(island), F.max("at").over(island)
    rows = rows.withColumn("left", last - F.col("at") + 1).withColumn("prev", F.coalesce(F.lag("r0").over(island.orderBy("at")), F.lit(0))).withColumn("s0", first)
    return rows, numbers


def suffix_array(tables: Tables, rows: DataFrame) -> tuple[DataFrame, int]:
    """``rows`` with ``r``: the ranks of all rounds (0: the suffix was settled before), and the number of rounds."""
    island = Window.partitionBy("doc", "s0")
    # ``now`` is the rank of this round, whatever is settled; ``r`` only goes on where there are more lines.
    work, done, k = rows.withColumn("r", F.array("r0")).withColumn("now", F.col("r0")).withColumn("open", F.col("left") > 1), None, 0
    columns = ["doc", "at", "s0", "left", "prev", "words", "r0", "r"]
    while True:
        ahead = F.coalesce(F.lead("now", 1 << k).over(island.orderBy("at")), F.lit(0))
        work = tables.put(work.withColumn("ahead", ahead).withColumn("open", F.max("open").over(island)), f"round{k}")
        storage.release(tables.spark)
        settled = work.where(~F.col("open")).select(*columns)
        done = settled if done is None else done.unionByName(settled)
        work = work.where("open")
        if not work.head(1):
            return done, k + 1
        pairs = _ranked(tables, work, ["now", "ahead"]).select("now", "ahead", "n", "rank")
        longer = F.array_append("r", F.when(F.col("left") > (1 << k), F.col("rank")).otherwise(F.lit(0)))
        k += 1
        work = work.join(pairs, ["now", "ahead"]).select(*columns[:-1], longer.alias("r"), F.col("rank").alias("now"), ((F.col("n") > 1) & (F.col("left") > (1 << k))).alias("open"))


def _neighbours(rows: DataFrame, rounds: int) -> DataFrame:
    """The suffix array in ranges: each suffix with its predecessor, and their common prefix where the ranks tell it.

    ``lcp`` is -1 for irreducible neighbours that were parted in round ``level + 1`` (their common prefix has
    2**level lines or more, less than twice that), and -2 for reducible ones.
    """
    order = F.transform(F.sequence(F.lit(0), F.lit(rounds - 1)), lambda i: F.coalesce(F.get("r", i), F.lit(0)))
    ranged = rows.withColumn("r", order).repartitionByRange("r", "doc", "at").sortWithinPartitions("r", "doc", "at").withColumn("part", F.spark_partition_id())
    names = ["part", "row", "doc", "at", "s0", "left", "prev", "words", "r", "before", "before_at", "before_s0", "lcp", "level"]
    schema = "part int, row long, doc long, at int, s0 int, left int, prev long, words int, r array<long>, before long, before_at int, before_s0 int, lcp int, level int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, row = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            part, doc, at, s0, left, prev = (b.column(j).to_numpy(zero_copy_only=False) for j in range(6))
            ranks = b.column(7).flatten().to_numpy().reshape(-1, rounds)
            if last is None:
                # Before the first row of a range stands another range's last one: see ``_borders``.
                last = (np.array([-1]), np.array([-1]), np.array([-1]), np.array([-1]), -np.ones((1, rounds), dtype=np.int64))
            old = [np.append(x, y[:-1], axis=0) for x, y in zip(last, (doc, at, s0, prev, ranks), strict=True)]
            lcp, level = common(ranks, old[4], left, prev, old[3])
            cols = [part, np.arange(row, row + len(doc)), doc, at, s0, left, prev, b.column(6), b.column(7), old[0], old[1], old[2], lcp, level]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), None, None, pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([c if k is None else pa.array(np.asarray(c), k) for c, k in zip(cols, kinds, strict=True)], names)
            last, row = (doc[-1:], at[-1:], s0[-1:], prev[-1:], ranks[-1:]), row + len(doc)

    return ranged.select("part", "doc", "at", "s0", "left", "prev", "words", "r").mapInArrow(storage.lean(run), schema)


def common(ranks: np.ndarray, old: np.ndarray, left: np.ndarray, prev: np.ndarray, old_prev: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``lcp`` and ``level`` of suffixes and their predecessors (see ``_neighbours``)."""
    differ = ranks != old
    parted = np.where(differ.any(axis=1), differ.argmax(axis=1), -1)
    level = parted - 1
    open_ = parted > 1
    lcp = np.where(parted < 0, left, np.where(parted < 2, parted, np.where((prev == old_prev) & (prev > 0), -2, -1)))
    return lcp.astype(np.int64), np.where(open_, level, 0)


def _borders(sa: DataFrame) -> DataFrame:
    """The first row of each range with the last row of the range before: two rows a range are looked at."""
    ends = sa.groupBy("part").agg(F.max("row").alias("row"))
    last = sa.join(F.broadcast(ends), ["part", "row"]).select("part", "doc", "at", "s0", "prev", "r").collect()
    first = sa.where("row = 0").collect()
    before = dict(zip(sorted(x["part"] for x in last)[1:], sorted(last, key=lambda x: x["part"]), strict=False))
    out = []
    for f in first:
        x = before.get(f["part"])
        if x is None:
            out.append((f["part"], 0, -1, -1, -1, 0, 0))
            continue
        lcp, level = common(np.array([f["r"]]), np.array([x["r"]]), np.array([f["left"]]), np.array([f["prev"]]), np.array([x["prev"]]))
        out.append((f["part"], 0, x["doc"], x["at"], x["s0"], int(lcp[0]), int(level[0])))
    return sa.sparkSession.createDataFrame(out, "part int, row long, b_doc long, b_at int, b_s0 int, b_lcp int, b_level int")


def _compared(sa: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc, at, more): the lines that irreducible neighbours share beyond 2**level."""
    need = sa.where("lcp = -1").select("doc", "at", "s0", "before", "before_at", "before_s0", F.expr("cast(shiftleft(1, level) as int)").alias("n"))
    ask = lambda doc, at, s0, side: need.select(F.col(doc).alias("of"), F.col(s0).alias("s0"), F.struct("doc", "at", F.lit(side).alias("side"), (F.col(at) + F.col("n") - F.col(s0)).alias("from"), "n").alias("ask"))
    asked = ask("doc", "at", "s0", 0).union(ask("before", "before_at", "before_s0", 1)).groupBy("of", "s0").agg(F.collect_list("ask").alias("asks"))
    islands = rows.groupBy(F.col("doc").alias("of"), "s0").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "r0"))), lambda x: x["r0"]).alias("lines"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for held, asks in zip(b.column(0), b.column(1), strict=True):
                held = held.values.to_numpy()
                out += [(a["doc"], a["at"], a["side"], held[a["from"] : a["from"] + a["n"]].tobytes()) for a in asks.as_py()]
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["doc", "at", "side", "lines"])

    sides = islands.join(asked, ["of", "s0"]).select("lines", "asks").mapInArrow(storage.lean(cut), "doc long, at int, side int, lines binary")
    both = sides.groupBy("doc", "at").agg(*[F.max(F.when(F.col("side") == x, F.col("lines"))).alias(f"x{x}") for x in (0, 1)])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                n = min(len(x), len(y)) // 8
                same = np.frombuffer(x, dtype=np.int64, count=n) == np.frombuffer(y, dtype=np.int64, count=n)
                out.append(n if same.all() else int(same.argmin()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.int32())], ["doc", "at", "more"])

    return both.mapInArrow(storage.lean(compare), "doc long, at int, more int")


def with_prefixes(tables: Tables, rows: DataFrame, rounds: int) -> DataFrame:
    """The suffix array with ``lcp``, the common prefix of each suffix with the one before it."""
    sa = tables.put(_neighbours(rows, rounds), "array")
    fixed = sa.join(F.broadcast(_borders(sa)), ["part", "row"], "left")  # a row for each range
    pick = lambda name, other: F.when(F.col("row") == 0, F.col(other)).otherwise(F.col(name)).alias(name)
    sa = tables.put(
        fixed.select("part", "row", "doc", "at", "s0", "words", pick("before", "b_doc"), pick("before_at", "b_at"), pick("before_s0", "b_s0"), pick("lcp", "b_lcp"), pick("level", "b_level")), "bordered"
    )
    more = tables.put(_compared(sa, rows), "compared")
    storage.release(tables.spark)
    whole = sa.join(more, ["doc", "at"], "left")
    known = F.when(F.col("lcp") >= 0, F.col("lcp")).when(F.col("lcp") == -1, F.expr("cast(shiftleft(1, level) as int)") + F.coalesce("more", F.lit(0)))
    in_island = Window.partitionBy("doc", "s0").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    lcp = F.last(known + F.col("at"), ignorenulls=True).over(in_island) - F.col("at")
    return whole.withColumn("lcp", lcp).select("part", "row", "doc", "at", "words", "lcp")


@dataclass
class Scan:
    """What a way along the array knows at a place: ``entries`` (position, depth), both ascending, is for each depth that
    reaches here the first position of the corpus; ``reach`` is the depth that the whole way shares."""

    entries: list[tuple[int, int]] = field(default_factory=list)
    reach: int = 1 << 40

    def step(self, lcp: int) -> None:
        """Go on to a neighbour with a common prefix of ``lcp``."""
        first = None
        while self.entries and self.entries[-1][1] >= lcp:
            first = self.entries.pop()[0]
        if first is not None and lcp > 0:
            self.entries.append((first, lcp))

    def depth(self, place: int) -> int:
        """The deepest interval with a position before ``place``; all later positions are shadowed by it from here on."""
        while self.entries and self.entries[-1][0] > place:
            self.entries.pop()
        return self.entries[-1][1] if self.entries else 0

    def add(self, place: int) -> None:
        self.entries.append((place, 1 << 40))

    def onto(self, other: Scan) -> list[tuple[int, int]]:
        """The entries after a way with ``other`` before it."""
        out: list[tuple[int, int]] = []
        for place, depth in sorted([(p, min(d, self.reach)) for p, d in other.entries] + self.entries, key=lambda x: (x[0], -x[1])):
            if depth > 0 and (not out or depth > out[-1][1]):
                out.append((place, depth))
        return out


def scan(places: list[int], lcps: list[int], entries: list[tuple[int, int]] = ()) -> tuple[list[int], Scan]:
    """For places in order, with ``lcps`` to the one before, the deepest interval with an earlier position; and the end of the way."""
    way, found = Scan(list(entries)), []
    for place, lcp in zip(places, lcps, strict=True):
        way.step(lcp)
        found.append(way.depth(place))
        way.add(place)
    return found, way


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Rows of ranges in order, one range after another."""
    part, held = None, []
    for b in batches:
        at = b.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)] if len(at) else []
        for a, z in zip(edges, edges[1:], strict=False):
            if part is not None and at[a] != part:
                yield part, held
                held = []
            part = int(at[a])
            held.append(b.slice(a, z - a))
    if held:
        yield part, held


_INF = 1 << 40


def depths(tables: Tables, array: DataFrame) -> DataFrame:
    """(doc, at, words, depth): the lines from each place that the corpus has earlier."""
    ordered = array.select("part", "row", "doc", "at", "words", "lcp").repartition("part").sortWithinPartitions("part", "row")
    schema = "part int, doc long, at int, words int, depth int, back long, forth long, state array<long>, first int"

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, held in _ranges(batches):
            t = pa.Table.from_batches(held)
            doc, at, words, lcp = (t.column(j).to_numpy() for j in range(2, 6))
            places = (doc.astype(np.int64) << 32 | at).tolist()
            lcps = lcp.tolist()
            one, end = scan(places, [0, *lcps[1:]])
            reach = np.minimum.accumulate(lcp)
            two, start = scan(places[::-1], [0, *lcps[:0:-1]])
            after = np.minimum.accumulate(np.append(lcp[1:].astype(np.int64), _INF)[::-1])[::-1]
            flat = lambda way: [x for e in way.entries if e[1] > 0 for x in e]
            rows = len(places)
            # One row in front has the two ends' states: lengths, then entries.
            left, right = flat(end), flat(start)
            state = [int(reach[-1]), int(lcp[0]), len(left), *left, *right]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(rows, part), pa.int32()), pa.array(doc), pa.array(at, pa.int32()), pa.array(words, pa.int32()), pa.array(np.maximum(one, two[::-1]), pa.int32()),
                    pa.array(reach.astype(np.int64)), pa.array(after.astype(np.int64)), pa.array([state] + [None] * (rows - 1), pa.list_(pa.int64())), pa.array([1] + [0] * (rows - 1), pa.int32()),
                ], [x.split(" ")[0] for x in schema.split(", ")],
            )

    found = tables.put(ordered.mapInArrow(storage.lean(local), schema), "depths")
    ends = {r["part"]: r["state"] for r in found.where("first = 1").select("part", "state").collect()}
    earlier, later = joined_states(ends)

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part, doc, at, words, depth, back, forth = (b.column(j).to_numpy(zero_copy_only=False).copy() for j in range(7))
            for i in np.flatnonzero((back > 0) | (forth > 0)).tolist():
                place = int(doc[i]) << 32 | int(at[i])
                for entries, reach in ((earlier[int(part[i])], back[i]), (later[int(part[i])], forth[i])):
                    for p, d in entries:
                        if p < place:
                            depth[i] = max(depth[i], min(d, reach))
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), b.column(3), pa.array(depth, pa.int32())], ["doc", "at", "words", "depth"])

    return found.select("part", "doc", "at", "words", "depth", "back", "forth").mapInArrow(storage.lean(reached), "doc long, at int, words int, depth int")


def joined_states(ends: dict[int, list[int]]) -> tuple[dict[int, list], dict[int, list]]:
    """For each range the entries that reach it from the ranges before, and from those behind."""
    pairs = lambda flat: list(zip(flat[::2], flat[1::2], strict=True))
    earlier, later = {}, {}
    way: list[tuple[int, int]] = []
    for part in sorted(ends):
        reach, _, n, *rest = ends[part]
        earlier[part] = way
        way = Scan(pairs(rest[:n]), reach).onto(Scan(way))
    way = []
    for part in sorted(ends, reverse=True):
        reach, lcp, n, *rest = ends[part]
        later[part] = way
        # To the range in front one goes over this one's first common prefix, which ``reach`` counts as well.
        way = Scan([(p, min(d, lcp)) for p, d in pairs(rest[n:])], reach).onto(Scan(way))
    return earlier, later


def _cover(rows: DataFrame, min_words: int) -> DataFrame:
    """(doc, drop): whether each line, up to the last such one, is in a maximal repeated run with enough words whose first
    copy is elsewhere."""
    held = rows.groupBy("doc").agg(F.max("depth").alias("most"), F.array_sort(F.collect_list(F.struct("at", "words", "depth"))).alias("rows")).where("most > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, drops = [], []
            for doc, rows in zip(b.column(0), b.column(1), strict=True):
                at, words, depth = (rows.values.field(j).to_numpy() for j in range(3))
                total = np.append(0, np.cumsum(words))
                # Lines of a run are neighbours, so a run of n lines is n rows on.
                first = np.arange(len(at))
                ok = total[first + depth] - total[first] >= min_words
                edge = np.zeros(len(at) + 1, dtype=np.int64)
                np.add.at(edge, first[ok], 1)
                np.add.at(edge, first[ok] + depth[ok], -1)
                gone = at[np.cumsum(edge[:-1]) > 0]
                if len(gone):
                    mask = np.zeros(gone[-1] + 1, dtype=bool)
                    mask[gone] = True
                    docs.append(doc.as_py())
                    drops.append(mask)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(drops, pa.list_(pa.bool_()))], ["doc", "drop"])

    return held.select("doc", "rows").mapInArrow(storage.lean(run), "doc long, drop array<boolean>")


def deleted(docs: DataFrame, min_words: int = MIN_WORDS, key: str = "__row", text: str = "text") -> DataFrame:
    """(doc, drop): for each document that loses any lines, which (up to the last of them)."""
    tables = Tables(docs)
    rows, numbers = suffixes(tables, docs, key, text)
    rows, rounds = suffix_array(tables, rows)
    rows = tables.put(rows, "suffixes")
    storage.release(tables.spark)
    array = tables.put(with_prefixes(tables, rows, rounds), "prefixes")
    gone = _cover(depths(tables, array), min_words).join(numbers, "doc").select(F.col("key").alias("doc"), "drop")
    out = storage.materialise(gone, "drops")
    tables.drop()
    storage.release(tables.spark)
    return out


def _apply(docs: DataFrame, min_words: int) -> DataFrame:
    """``docs`` plus ``__drop`` (whether a line goes, null: none does)."""
    keyed = docs.withColumn("__row", _key())
    again = keyed.groupBy("__row").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("__row")
    # Sorted and merged at every size: a broadcast that stops fitting would change how the shuffle grows.
    gone = deleted(keyed, min_words).withColumnsRenamed({"doc": "__row", "drop": "__drop"}).hint("merge")
    again = storage.materialise(again, "again")
    if not again.head(1):
        return keyed.join(gone, "__row", "left")
    # Rows equal in id and text: one keeps what any first copy keeps, the others are copies as a whole.
    same = storage.materialise(keyed.join(again, "__row", "left_semi").withColumn("__n", F.monotonically_increasing_id()), "same")
    first = storage.materialise(same.groupBy("__row").agg(F.min("__n").alias("__first")), "first")
    same = same.join(first, "__row")
    copies = same.where("__n > __first").drop("__n", "__first").withColumn("__drop", F.expr(_RUNS.format(min_words)))
    rest = keyed.join(again, "__row", "left_anti").unionByName(same.where("__n = __first").drop("__n", "__first"))
    return rest.join(gone, "__row", "left").unionByName(copies)


def _key():
    """The id and a hash of the text, ordered like the ids; a null id is a value."""
    return F.struct(F.col("doc_id").alias("id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("of"))


_KEPT = r"""if(__drop is null, text, array_join(transform(filter(transform(split(text, '\n', -1), (x, i) -> struct(x as x, i as i)),
    p -> not coalesce(get(__drop, p.i), false)), p -> p.x), '\n'))"""
_LEFT = r"rlike(__text, '[^ \\t-\\r]')"


#: Whether each line is in a run of lines with a word that has enough words.
_RUNS = r"""aggregate(concat(transform(split(coalesce(text, ''), '\\n', -1), x -> size(filter(split(x, '[ \\t-\\r]+'), w -> w <> ''))), array(0)),
    struct(cast(array() as array<boolean>) as out, 0 as lines, 0 as n),
    (a, x) -> if(x = 0, struct(concat(a.out, array_repeat(a.n >= {0}, a.lines), array(false)) as out, 0 as lines, 0 as n), struct(a.out as out, a.lines + 1 as lines, a.n + x as n)),
    a -> a.out)"""


def report(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_lines (with a word), n_removed, text: what is left of every document."""
    done = _apply(docs.select("doc_id", "text"), min_words)
    n = F.size(F.expr(r"filter(split(coalesce(text, ''), '\n', -1), x -> rlike(x, '[^ \\t-\\r]'))"))
    return done.select("doc_id", n.cast("long").alias("n_lines"), F.coalesce(F.size(F.filter("__drop", lambda x: x)), F.lit(0)).cast("long").alias("n_removed"), F.expr(_KEPT).alias("text"))


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without later copies of repeated line runs and without documents left with no word."""
    done = _apply(docs, min_words).withColumn("__text", F.expr(_KEPT))
    kept = done.where(F.col("__drop").isNull() | F.expr(_LEFT))
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col("__text").alias("text"))
        elif c == "n_chars":
            columns.append(F.when(F.col("__drop").isNull(), F.col(c)).otherwise(F.length("__text")).cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(F.col(c))
    return kept.select(*columns)
