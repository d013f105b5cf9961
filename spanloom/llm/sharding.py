"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

Each shard has `nodes` points on a ring of 2**32 places. A document's place is a hash of its id; it belongs to the next
point clockwise, and where that point's shard is full it continues clockwise to the first point whose shard isn't. A
shard's capacity is the mean load rounded up or down, so that loads differ by one row at most.

A sequential process would place documents one by one. Here only the loads of arcs (the stretch before a point: at most
shards x nodes numbers) reach the driver, which lets whole stretches of ranks overflow at once; a document then finds its
shard by its arc and its rank there. Ranks come from counts of fine cells of the ring, as many as there are rows for, so
that a window holds some `cell_rows` rows at most; all cells with more are ranked in parts by checksum, and equal rows there
are counted first. Adding or removing documents changes capacities by few rows and moves few of them.

Cases: null texts have size 8 and checksum 0; null ids share one place; repeated rows are separate rows of the same
place. An empty table gives an empty result.
"""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .shared import partitions

RING = 1 << 32


def points(shards: int, nodes: int) -> list[tuple[int, int]]:
    """(place, shard) of every virtual node, in ring order."""
    return sorted((int(md5(f"{s}/{v}".encode()).hexdigest()[:8], 16), s) for s in range(shards) for v in range(nodes))


def place(key: Column) -> Column:
    """A document's place on the ring: the first 32 bits of its id's MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, 8), 16, 10).cast("long")


def capacities(total: int, shards: int) -> list[int]:
    base, more = divmod(total, shards)
    return [base + (s < more) for s in range(shards)]


def flow(loads: dict[int, int], ring: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int, int]]:
    """Where each arc's documents go: (arc, first rank, rank after the last, shard, first slot).

    Every shard first takes documents of its own arcs, in ring order, while it has room; what doesn't fit walks on
    clockwise, arc by arc, and settles wherever a shard has room left.
    """
    free = capacities(sum(loads.values()), shards)
    taken = [0] * shards
    out = []
    waiting: list[tuple[int, int, int]] = []  # (arc, first rank, rank after the last) on their way, oldest first

    def settle(shard: int, arc: int, a: int, b: int) -> int:
        n = min(free[shard], b - a)
        if n:
            out.append((arc, a, a + n, shard, taken[shard]))
            free[shard] -= n
            taken[shard] += n
        return a + n

    for arc, (_, shard) in enumerate(ring):
        if n := loads.get(arc, 0):
            begin = settle(shard, arc, 0, n)
            if begin < n:
                waiting.append((arc, begin, n))
    left = {arc: (a, b) for arc, a, b in waiting}
    moving: list[tuple[int, int, int]] = []
    for turn in range(2):  # all that overflow are met in the first turn, and the second ends where it began
        for arc, (_, shard) in enumerate(ring):
            still = []
            for src, a, b in moving:
                a = settle(shard, src, a, b)
                if a < b:
                    still.append((src, a, b))
            moving = still
            if turn == 0 and arc in left:
                moving.append((arc, *left[arc]))
    assert not moving
    return out


def shard(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shards: int = 24, nodes: int = 64, cells: int | None = None, cell_rows: int = 1 << 17) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row; slots of a shard run from 0 without gaps."""
    spark = docs.sparkSession
    ring = points(shards, nodes)
    total = docs.count()
    n = 1 << ((cells or max(256, 4 * partitions(spark), 2 * total // cell_rows)) - 1).bit_length()  # half of cell_rows a cell, on average
    n = min(n, RING)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
    ).withColumn("_place", place(F.col("doc_id")))
    # the arc of a place: how many points lie before it, found by halving
    rows = rows.withColumn("_arc", _search([p for p, _ in ring], F.col("_place")) % len(ring)).withColumn("_cell", F.shiftright("_place", 32 - n.bit_length() + 1))
    counted = rows.groupBy("_arc", "_cell").agg(F.count("*").alias("_n")).withColumn("_sub", F.lit(0))
    full = counted.filter(F.col("_n") > cell_rows).select("_arc", "_cell", F.ceil(F.col("_n") / cell_rows).cast("int").alias("_parts"))
    hot = None
    if full.limit(1).count():  # rows that share an id, or have none, share a place
        if total // cell_rows < 1 << 20:  # no more cells than that can be full: some 24 MB
            full = F.broadcast(full)
        hot = rows.join(full, ["_arc", "_cell"]).withColumn("_sub", F.pmod("text_crc32", "_parts").cast("int")).drop("_parts")
        rows = rows.join(full, ["_arc", "_cell"], "left_anti")
        parts = hot.groupBy("_arc", "_cell", "_sub").agg(F.count("*").alias("_n"))
        counted = counted.join(full, ["_arc", "_cell"], "left_anti").unionByName(parts)
    loads = {r[0]: r[1] for r in counted.groupBy("_arc").agg(F.sum("_n")).collect()}  # at most shards x nodes
    ranges = sorted(flow(loads, ring, shards))
    # the arc after the last point begins the ring anew: its cells of small places come after those of large ones
    turn = F.when(F.col("_arc") == 0, F.col("_cell") <= ((ring[0][0] if ring else 0) >> (32 - n.bit_length() + 1))).otherwise(F.lit(False))
    before = Window.partitionBy("_arc").orderBy(turn, "_cell", "_sub").rowsBetween(Window.unboundedPreceding, -1)
    bases = counted.select("_arc", "_cell", "_sub", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_arc", "_cell", "_sub").orderBy("_place", "doc_id", "text_crc32", "size")
    ranked = rows.withColumn("_sub", F.lit(0)).withColumn("_rank", F.row_number().over(inside).cast("long") - 1)
    if hot is not None:
        ranked = ranked.unionByName(_ranked_copies(hot, inside, cell_rows))
    ranked = ranked.join(bases, ["_arc", "_cell", "_sub"]).withColumn("_rank", F.col("_rank") + F.col("_base"))
    # (arc, rank) as one number finds its range by halving too; there are at most shards x nodes + shards of those
    starts = [(arc << 40) | a for arc, a, *_ in ranges]
    at = _search(starts, F.shiftleft(F.col("_arc").cast("long"), 40) + F.col("_rank") + 1) - 1
    found = ranked.withColumn("_at", at.cast("int")) if ranges else ranked.withColumn("_at", F.lit(0))
    shard_of, shift = F.lit([r[3] for r in ranges] or [0]), F.lit([r[4] - r[1] for r in ranges] or [0])
    return found.select(
        "doc_id", "size", "text_crc32", F.get(shard_of, F.col("_at")).cast("int").alias("shard"),
        (F.col("_rank") + F.get(shift, F.col("_at"))).cast("long").alias("slot"),
    )


def _ranked_copies(rows: DataFrame, inside: WindowSpec, chunk: int) -> DataFrame:
    """rows with _rank inside their part of a cell. Equal rows are counted before they are shuffled, so that a window holds different rows only, and told out again in chunks, each by a task of its own."""
    counted = rows.groupBy("_arc", "_cell", "_sub", "_place", "doc_id", "text_crc32", "size").agg(F.count("*").alias("_n"))
    first = F.coalesce(F.sum("_n").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chunks = counted.withColumn("_first", first).withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(chunk).cast("long"))))
    dealt = chunks.repartition("_arc", "_cell", "_sub", "doc_id", "text_crc32", "_from")
    each = dealt.withColumn("_i", F.explode(F.sequence("_from", F.least(F.col("_n"), F.col("_from") + chunk) - 1)))
    return each.withColumn("_rank", F.col("_first") + F.col("_i")).drop("_first", "_from", "_i", "_n")


def _search(values: list[int], x: Column) -> Column:
    """How many of the sorted values are less than x: a binary search with a fixed number of steps in one literal array."""
    if not values:
        return F.lit(0)
    table = F.lit(values).cast("array<bigint>")
    steps = len(values).bit_length()
    lo = F.lit(0)

    def step(at: Column, k: Column) -> Column:
        to = at + k
        return F.when((to <= len(values)) & (F.get(table, (to - 1).cast("int")) < x), to).otherwise(at)

    return F.aggregate(F.lit([1 << k for k in reversed(range(steps))]), lo, step)
