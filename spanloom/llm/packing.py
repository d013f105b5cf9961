"""Best-fit packing of token sequences with Martello-Toth dominance reduction.

What is packed is the histogram of piece lengths (at most `capacity` numbers), never a list of documents: the driver
fixes dominating sets length by length, packs the rest best-fit decreasing, and gets patterns (lengths that share a
sequence) with multiplicities. A document's piece takes its place by its rank among the pieces of its length, so the
distributed work is one count and one ranking, however many documents there are.

Cases: a null text is an empty one and gives the end id alone. Repeated rows are packed one by one. An empty table gives
an empty result. Document ids are whole numbers (others are an error when cast). Columns other than the named ones are left behind.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import partitions, slices, stage
from .tokens import at_once, encoder, tokenizer_path

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def pieces(docs: DataFrame, *, capacity: int = 2048, end_id: int = 0, tokenizer: str | None = None, with_ids: bool = True, spare: bool = False) -> DataFrame:
    """Token pieces of (doc_id, text): `capacity` ids each, only a document's first piece may be shorter; ids as little-endian 32-bit numbers. spare: workers keep less, beside other operators."""
    schema = PIECES if with_ids else PIECES.removesuffix(", ids binary")
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in PIECES.split(", ")]

    def run(batches):
        enc = encoder(tokenizer_path(tokenizer), spare)
        end = np.array([end_id], "<u4")
        for batch in batches:
            for part in slices(batch, 1, at_once(spare)):
                rows: list[tuple] = []
                for doc, ids in zip(part.column(0).to_pylist(), enc.encode(part.column(1)), strict=True):
                    ids = np.concatenate((ids, end))
                    cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                        data = ids[a:b].tobytes()
                        rows.append((doc, k, a, b - a, zlib.crc32(data), data))
                n = 6 if with_ids else 5
                cols = list(zip(*rows, strict=True))[:n]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=False)], names=names[:n])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


class Lengths:
    """A multiset of lengths, kept as counts, with the largest length not above a bound in O(log n)."""

    def __init__(self, counts: dict[int, int]):
        self.count = {k: v for k, v in counts.items() if v}
        self.sorted = sorted(self.count)

    def take(self, length: int, n: int) -> None:
        self.count[length] -= n
        if not self.count[length]:
            del self.count[length]
            self.sorted.pop(bisect_left(self.sorted, length))

    def fitting(self, bound: int, but: int = 0) -> int:
        """The largest length of at most `bound`, 0 if none; `but`: one item of this length is set aside."""
        i = bisect_left(self.sorted, bound + 1) - 1
        if i >= 0 and self.sorted[i] == but and self.count[but] == 1:
            i -= 1
        return self.sorted[i] if i >= 0 else 0

    def smallest(self, n: int, but: int) -> int:
        """The sum of the n smallest items, one of length `but` set aside; as good as infinite if there are fewer."""
        total = 0
        for k in self.sorted:
            have = self.count[k] - (k == but)
            use = min(n, have)
            total, n = total + use * k, n - use
            if not n:
                return total
        return 1 << 60


def dominant(items: Lengths, j: int, capacity: int) -> tuple[tuple[int, ...], int] | None:
    """A set with an item of length j that dominates every feasible set with that item, and how often it may be fixed at once; None if none of these tests proves one."""
    room = capacity - j
    k = items.fitting(room, j)
    have = items.count[j]
    if not k:  # nothing fits beside it
        return (j,), have if j > room else 1
    most = have // 2 if k == j else min(have, items.count[k])
    if k == room:  # a full sequence: the partner is as large as all that could stand beside j
        return (j, k), most
    if items.smallest(2, j) > room:  # one more item at most: the largest that fits
        return (j, k), most if k != j and not (j <= room and k < j) else 1
    if items.smallest(3, j) > room:  # two more at most
        best = _best_pair(items, j, room)
        if best is None or k >= sum(best):
            return (j, k), 1
        a, b = best
        if a == k and b >= _largest_second(items, j, room):  # {a, b} covers any pair item by item, and any single item
            return (j, a, b), 1
    return None


def _pairs(items: Lengths, j: int, room: int):
    """For each length x of a partner the largest y <= x that fits with it beside j."""
    for x in items.sorted:
        left = items.count[x] - (x == j)
        if left <= 0 or x >= room:
            continue
        i = bisect_left(items.sorted, min(x, room - x) + 1) - 1
        while i >= 0:
            y = items.sorted[i]
            if items.count[y] - (y == j) - (y == x) > 0:
                yield x, y
                break
            i -= 1


def _best_pair(items: Lengths, j: int, room: int) -> tuple[int, int] | None:
    return max(_pairs(items, j, room), key=lambda p: (sum(p), p), default=None)


def _largest_second(items: Lengths, j: int, room: int) -> int:
    return max((y for _, y in _pairs(items, j, room)), default=0)


def reduce(items: Lengths, capacity: int) -> dict[tuple[int, ...], int]:
    """Martello-Toth reduction: fixes dominating sets, by falling length, until a pass over all lengths proves none."""
    fixed: dict[tuple[int, ...], int] = {}
    again = True
    while again:
        again = False
        for j in sorted(items.count, reverse=True):
            while j in items.count and (found := dominant(items, j, capacity)):
                group, n = found
                fixed[group] = fixed.get(group, 0) + n
                for x in group:
                    items.take(x, n)
                again = True
    return fixed


def best_fit(items: Lengths, capacity: int) -> dict[tuple[int, ...], int]:
    """Best-fit decreasing on counts: equal open sequences are handled together."""
    room: dict[int, dict[tuple[int, ...], int]] = {}
    rooms: list[int] = []

    def put(r: int, group: tuple[int, ...], n: int) -> None:
        if r not in room:
            room[r] = {}
            rooms.insert(bisect_left(rooms, r), r)
        room[r][group] = room[r].get(group, 0) + n

    for size in sorted(items.count, reverse=True):
        left = items.count[size]
        while left:
            i = bisect_left(rooms, size)
            if i == len(rooms):  # no open sequence has room: as many new ones as take all that is left
                per = capacity // size
                whole, rest = divmod(left, per)
                if whole:
                    put(capacity - per * size, (size,) * per, whole)
                if rest:
                    put(capacity - rest * size, (size,) * rest, 1)
                break
            r = rooms[i]
            group, have = next(iter(room[r].items()))
            fit = r // size
            deep = min(have, left // fit) if fit else 0
            if deep:  # each takes as many of this size as fit, before the next sequence is begun
                n, put_in = deep, fit
            else:
                n, put_in = 1, left
            if have == n:
                del room[r][group]
                if not room[r]:
                    del room[r]
                    rooms.pop(i)
            else:
                room[r][group] = have - n
            put(r - put_in * size, group + (size,) * put_in, n)
            left -= n * put_in
    out: dict[tuple[int, ...], int] = {}
    for groups in room.values():
        for group, n in groups.items():
            out[group] = out.get(group, 0) + n
    return out


def plan(counts: dict[int, int], capacity: int = 2048) -> dict[tuple[int, ...], int]:
    """Patterns with multiplicities for a histogram of lengths: reduction first, then best fit."""
    items = Lengths(counts)
    out = reduce(items, capacity)
    for group, n in best_fit(items, capacity).items():
        key = tuple(sorted(group, reverse=True))
        out[key] = out.get(key, 0) + n
    return out


def _places(patterns: dict[tuple[int, ...], int]) -> tuple[np.ndarray, ...]:
    """Ranges of ranks within a length and where they go, sorted by (length, first rank): bounded by the patterns, not by the documents."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for group, n in sorted(patterns.items(), reverse=True):
        offset = 0
        for size in group:
            rows.append((size, used.get(size, 0), base, offset))
            used[size] = used.get(size, 0) + n
            offset += size
        base += n
    rows.sort()
    return tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 4


def pack(cut: DataFrame, *, capacity: int = 2048, key: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Adds sequence_id and offset to pieces (a staged table with a length column): few sequences, filled without gaps from offset 0."""
    spark = cut.sparkSession
    n = max(64, 2 * partitions(spark))
    keyed = cut.withColumn("_bucket", F.pmod(F.xxhash64(*key, "start"), F.lit(n)).cast("int"))
    counted = keyed.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    histogram = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    size, rank, base, offset = _places(plan(histogram, capacity))
    shared = spark.sparkContext.broadcast((size << 40 | rank, rank, base, offset))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counted.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inner = Window.partitionBy("length", "_bucket").orderBy(*key, "start")
    ranked = (
        keyed.withColumn("_rank", F.row_number().over(inner) - 1)
        .join(bases, ["length", "_bucket"])
        .select(*cut.columns, (F.col("_rank") + F.col("_base")).cast("long").alias("_rank"))
    )
    names = cut.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"

    def run(batches):
        keys, first, base, offset = shared.value
        at = names.index("length")
        for batch in batches:
            length, rank = batch.column(at).to_numpy(), batch.column(len(names)).to_numpy()
            i = np.searchsorted(keys, length << 40 | rank, "right") - 1
            cols = [*batch.columns[: len(names)], pa.array(base[i] + rank - first[i]), pa.array(offset[i])]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, *, capacity: int = 2048, end_id: int = 0, tokenizer: str | None = None, with_ids: bool = True, spare: bool = False) -> DataFrame:
    """Cuts, tokenises and packs documents; the pieces are staged once, as both the histogram and the ranking read them."""
    return pack(stage(pieces(docs, capacity=capacity, end_id=end_id, tokenizer=tokenizer, with_ids=with_ids, spare=spare), "pieces"), capacity=capacity)
