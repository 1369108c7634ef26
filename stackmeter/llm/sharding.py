"""Consistent-hash ring with virtual nodes and bounded loads (operator 9).

A key's place is the hash of its id.  The ring is cut into ``CELLS`` cells of equal
width; each virtual node of a shard owns the cells from its own up to the next
node's.  A shard takes at most its share of all bytes; what no longer fits goes on
clockwise to the next shard with room.  Only the cells' totals (a fixed number of
rows) reach the driver, which walks the ring once; every row then finds its shard
by its cell and, in the few cells that are cut, by the bytes before it in the cell.
Rows of one id have one cell; a heavy one is cut over several shards.

Defined results: a null text has no bytes (size ``ROW_BYTES``); a null id hashes like
any other value, and so do ids of other types; equal rows are placed each; a long text is
one row, of which only the size and checksum go on; an empty table gives an empty result;
other columns pass through, a column named like an output is replaced.
"""

from __future__ import annotations

import bisect
import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import storage

CELLS = 1 << 14
#: Rows of a cell that are ordered together.
GROUP = 50_000
ROW_BYTES = 8


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(ROW_BYTES)).cast("long")


@dataclass(frozen=True)
class Piece:
    """Bytes ``[start, ...)`` of a cell go to ``shard``."""

    cell: int
    start: int
    shard: int


class Ring:
    """``nodes`` virtual nodes a shard; a shard's nodes don't move when others come or go."""

    def __init__(self, shards: int, nodes: int = 64):
        self.shards = shards
        at: dict[int, int] = {}
        for s in range(shards):
            for v in range(nodes):
                h = int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:8], "big") % CELLS
                while h in at:
                    h = (h + 1) % CELLS
                at[h] = s
        self.places = sorted(at)
        self.owner = [at[p] for p in self.places]

    def node(self, cell: int) -> int:
        """The number of the node that owns a cell: the first at or after it, clockwise."""
        return bisect.bisect_left(self.places, cell) % len(self.places)

    def place(self, loads: dict[int, tuple[int, int]]) -> list[Piece]:
        """Pieces of the cells ``{cell: (bytes, rows)}``, so that each shard has an equal share of the bytes.

        The largest cells come first.  A cell goes to its own node's shard, or clockwise to
        the next shard with room; if none has room for all of it, the emptiest takes it.
        A cell is only cut if it is a good part of a share and has several rows.
        """
        total = sum(b for b, _ in loads.values())
        share = -(-total // self.shards)
        room = [share] * self.shards
        pieces: list[Piece] = []
        for cell, (size, rows) in sorted(loads.items(), key=lambda x: (-x[1][0], x[0])):
            can_cut = rows > 1 and size > share // 64
            first, start = self.node(cell), 0
            for turn in range(len(self.owner)):
                shard = self.owner[(first + turn) % len(self.owner)]
                take = size if size <= room[shard] else max(0, room[shard]) if can_cut else 0
                if take:
                    pieces.append(Piece(cell, start, shard))
                    room[shard] -= take
                    start, size = start + take, size - take
                if not size:
                    break
            if size:
                shard = max(range(self.shards), key=lambda s: (room[s], -s))
                pieces.append(Piece(cell, start, shard))
                room[shard] -= size
        return pieces


def assign(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text", nodes: int = 64) -> DataFrame:
    """``docs`` (without ``text``) plus size, text_crc32, shard, slot.

    One pass over the texts, which leaves rows without them, each with a number of its own; then cell totals and the
    placement.  A cell's rows are dealt by their numbers over groups of about ``GROUP`` rows, so the windows, which run
    over groups, don't grow with a key, a source or a number of equal rows; the bytes before a group are prefix
    sums over the groups (a row for each).
    """
    spark = docs.sparkSession
    new = {"size", "text_crc32", "shard", "slot", "__h", "__cell", "__row"}
    keep = [k for k in docs.columns if k not in new and k != text]
    rows = docs.select(
        *[docs[k] for k in keep],
        size_of(docs[text]).alias("size"),
        F.crc32(F.coalesce(docs[text], F.lit(""))).cast("long").alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(docs[key].cast("string")), 50).cast("int").alias("__cell"),
        F.monotonically_increasing_id().alias("__row"),
    )
    rows = storage.materialise(rows, "rows")
    loads = {r["__cell"]: (r["b"], r["n"]) for r in rows.groupBy("__cell").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect()}
    pieces = sorted(Ring(shards, nodes).place(loads), key=lambda p: (p.cell, p.start))
    starts: dict[int, list[Piece]] = {}
    for p in pieces:
        starts.setdefault(p.cell, []).append(p)
    table = spark.createDataFrame(
        [(cell, [p.start for p in ps], [p.shard for p in ps], -(-loads[cell][1] // GROUP)) for cell, ps in starts.items()],
        "__cell int, __starts array<long>, __shards array<int>, __groups long",
    )
    grouped = rows.join(F.broadcast(table), "__cell")  # at most CELLS rows
    grouped = grouped.withColumn("__group", F.pmod(F.xxhash64("__row"), F.col("__groups")))
    totals = grouped.groupBy("__cell", "__group").agg(F.sum("size").alias("b"))
    ahead = Window.partitionBy("__cell").orderBy("__group")
    totals = totals.select("__cell", "__group", (F.sum("b").over(ahead) - F.col("b")).alias("__ahead"))
    w = Window.partitionBy("__cell", "__group").orderBy("__row")
    placed = (
        grouped.join(totals, ["__cell", "__group"])
        .withColumn("__before", F.col("__ahead") + F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("__n", F.size(F.filter("__starts", lambda x: x <= F.col("__before"))))
        .withColumn("shard", F.element_at("__shards", F.col("__n")))
    )
    placed = storage.materialise(placed.select(*keep, "size", "text_crc32", "__cell", "__group", "__row", "shard"), "placed")
    counted = placed.withColumn("__rank", F.row_number().over(Window.partitionBy("__cell", "__group", "shard").orderBy("__row")))
    # Rows of a shard in each group, summed over the groups before it.
    per_group = placed.groupBy("shard", "__cell", "__group").count()
    base = per_group.select("shard", "__cell", "__group", (F.sum("count").over(Window.partitionBy("shard").orderBy("__cell", "__group")) - F.col("count")).alias("__base"))
    out = counted.join(base, ["shard", "__cell", "__group"])
    return out.select(*keep, "size", "text_crc32", "shard", (F.col("__base") + F.col("__rank") - 1).cast("long").alias("slot"))
