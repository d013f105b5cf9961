"""Document fingerprints: invertible Bloom look-up sketches of paragraph digests.

A text is cut at line ends into paragraphs, and long paragraphs into pieces of `piece` code points, counted from the
paragraph's start. A piece's digest is XXH64 of its text and of how often it has come before in the text, so a multiset
becomes a set. Each digest goes into three cells of a sketch; a cell holds a count, the XOR of its digests and the XOR of
their check sums. Two sketches of one size subtract cell by cell; digests of common pieces vanish, and peeling cells with
a single digest left recovers those of the differing pieces. If peeling sticks, both are sketched again at four times the
size, until it succeeds. Likeness: common pieces over all pieces, 2 * common / (n + m); 1 for two texts without pieces.

Only sketches and piece counts are compared. A whole batch of pairs is sketched and peeled at once in numpy.

Cases: null is the empty text, whose sketch is empty. Texts of one piece are like only their equals. Equal texts have
equal fingerprints. Documents follow by falling id, ties by the text's checksum, null ids last; a single document is its own next.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .shared import partitions, release

#: Cells of the sketch that is kept as the fingerprint, and code points of a piece.
CELLS, PIECE = 24, 48


def digests(text: str, piece: int = PIECE) -> np.ndarray:
    """Digests of a text's pieces, distinct."""
    seen: dict[str, int] = {}
    out = []
    for line in text.split("\n"):
        for k in range(0, len(line), piece):
            part = line[k : k + piece]
            n = seen.get(part, 0)
            seen[part] = n + 1
            out.append(xxh64_intdigest(part.encode("utf-8", "surrogatepass"), n))
    return np.array(out, np.uint64)


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _cells(keys: np.ndarray, size: int, turn: int) -> np.ndarray:
    """The three cells of each digest, one in each third of a sketch."""
    third = size // 3
    return np.stack([k * third + (_mix(keys, 3 * turn + k + 1) >> np.uint64(32)).astype(np.int64) % third for k in range(3)], 1)


class Sketches:
    """Sketches of many texts, side by side: count, digest and check sum of each cell."""

    def __init__(self, n: int, size: int, turn: int = 0):
        self.size, self.turn = size, turn
        self.count = np.zeros(n * size, np.int32)
        self.key = np.zeros(n * size, np.uint64)
        self.check = np.zeros(n * size, np.uint64)

    def add(self, owner: np.ndarray, keys: np.ndarray, sign: int | np.ndarray) -> None:
        at = (owner[:, None] * self.size + _cells(keys, self.size, self.turn)).ravel()
        np.add.at(self.count, at, np.repeat(np.broadcast_to(np.asarray(sign, np.int32), len(keys)), 3))
        np.bitwise_xor.at(self.key, at, np.repeat(keys, 3))
        np.bitwise_xor.at(self.check, at, np.repeat(_mix(keys, 99), 3))

    def text(self, i: int) -> str:
        """A sketch as a string: of each cell a 32-bit count, 64-bit digest and 16-bit check sum, in hexadecimal."""
        part = slice(i * self.size, (i + 1) * self.size)
        cells = np.zeros(self.size, [("n", ">i4"), ("k", ">u8"), ("c", ">u2")])
        cells["n"], cells["k"], cells["c"] = self.count[part], self.key[part], self.check[part] & np.uint64(0xFFFF)
        return f"{self.size:x}-{cells.tobytes().hex()}"

    def peel(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each difference, whether peeling emptied it, and how many digests it recovered on either side."""
        plus, minus = np.zeros(n, np.int64), np.zeros(n, np.int64)
        look = np.arange(len(self.count))
        while len(look):
            pure = look[(np.abs(self.count[look]) == 1) & (self.check[look] == _mix(self.key[look], 99))]
            if not len(pure):
                break
            owner, keys, sign = pure // self.size, self.key[pure], self.count[pure]
            _, one = np.unique(np.stack([owner.astype(np.uint64), keys], 1), axis=0, return_index=True)
            owner, keys, sign = owner[one], keys[one].copy(), sign[one].copy()
            np.add.at(plus, owner[sign > 0], 1)
            np.add.at(minus, owner[sign < 0], 1)
            self.add(owner, keys, -sign)
            look = np.unique(owner[:, None] * self.size + _cells(keys, self.size, self.turn))
        left = (self.count != 0) | (self.key != 0)
        return ~left.reshape(n, self.size).any(1), plus, minus


def likeness(first: list[np.ndarray], second: list[np.ndarray], size: int = CELLS) -> np.ndarray:
    """Likeness of each pair of digest sets, by subtracting and peeling sketches; sketches grow until peeling succeeds."""
    n = np.array([len(x) for x in first]), np.array([len(x) for x in second])
    differ = np.zeros(len(first), np.int64)
    todo, turn = np.arange(len(first)), 0
    while len(todo):
        later = []
        most = max(1, (1 << 21) // size)  # pairs sketched at once
        for at in range(0, len(todo), most):
            part = todo[at : at + most]
            s = Sketches(len(part), size, turn)
            for side, sign in ((first, 1), (second, -1)):
                keys = np.concatenate([side[i] for i in part])
                s.add(np.repeat(np.arange(len(part)), [len(side[i]) for i in part]), keys, sign)
            done, plus, minus = s.peel(len(part))
            done &= plus - minus == (n[0] - n[1])[part]
            differ[part[done]] = (plus + minus)[done]
            later.append(part[~done])
        todo = np.concatenate(later)
        size, turn = size * 4, turn + 1
    total = n[0] + n[1]
    return np.where(total == 0, 1.0, (total - differ) / np.maximum(total, 1))


def edited(text: str, after: str) -> str:
    """text with its last third of code points replaced by the first as many (or all) of the text after it."""
    n = len(text) // 3
    return text[: len(text) - n] + after[:n]


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _judge(rows: list[tuple[int | None, str]], after: list[str]) -> pa.RecordBatch:
    texts = [t for _, t in rows]
    new = [edited(t, a) for t, a in zip(texts, after, strict=True)]
    own, changed = [digests(t) for t in texts], [digests(t) for t in new]
    follow = [*own[1:], digests(after[-1])]  # the next text is the next row
    kept = []
    for side in (own, changed):
        s = Sketches(len(side), CELLS)
        s.add(np.repeat(np.arange(len(side)), [len(x) for x in side]), np.concatenate(side), 1)
        kept.append([s.text(i) for i in range(len(side))])
    cols = [
        pa.array([d for d, _ in rows], pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in new]),
        pa.array(kept[0]), pa.array(kept[1]), pa.array(likeness(own, changed)), pa.array(likeness(own, follow)),
    ]
    return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in _SCHEMA.split(", ")])


def _after(bounds: list[tuple[int, int]], doc: Column, c: Column) -> Column:
    """How many bounds (id, checksum) a row lies after, ids falling and checksums rising: a binary search in literal arrays."""
    if not bounds:
        return F.lit(0)
    ids, sums = F.lit([b for b, _ in bounds]).cast("array<bigint>"), F.lit([c for _, c in bounds]).cast("array<bigint>")

    def step(at: Column, k: Column) -> Column:
        b = F.get(ids, at + k - 1)
        return F.when((at + k <= len(bounds)) & ((doc < b) | (doc == b) & (c > F.get(sums, at + k - 1))), at + k).otherwise(at)

    return F.aggregate(F.lit([1 << k for k in reversed(range(len(bounds).bit_length()))]), F.lit(0), step)


def ranges_of(quantiles: list[int], total: int, nulls: int, n: int) -> tuple[list[tuple[int, int]], int]:
    """Bounds (id, last checksum) between ranges of ids in falling order, and the number of ranges for rows without id. An id that is several quantiles gets as many ranges, by checksum."""
    times: dict[int, int] = {}
    for q in quantiles:
        times[q] = times.get(q, 0) + 1
    bounds = []
    for q in sorted(times, reverse=True):
        bounds += [(q, (1 << 32) * k // times[q] - 1) for k in range(1, times[q] + 1)]
    return bounds, max(1, n * nulls // max(total, 1))


def with_edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", batch_chars: int = 4 << 20, range_bytes: int = 64 << 20) -> DataFrame:
    """Fingerprints of each document and of its edited text, with likenesses. Texts are shuffled once, into ranges of ids of some `range_bytes`, each a task of its own; each range also gets the first document of the range after it."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n"), F.count_if(F.col("doc_id").isNull()).alias("null")).first()
    if not size["n"]:
        return spark.createDataFrame([], _SCHEMA)
    n = max(2 * partitions(spark), -(-size["b"] // range_bytes))
    quantiles = rows.select("doc_id").filter("doc_id is not null").approxQuantile("doc_id", [k / n for k in range(1, n)], 0.1 / n)
    bounds, without = ranges_of([int(q) for q in quantiles], size["n"], size["null"], n)
    # rows without id come last, in ranges by checksum
    last = F.floor(F.col("_c") * F.lit(without) / F.lit(1 << 32)).cast("int") + len(bounds) + 1
    ranged = rows.withColumn("_c", F.crc32("text")).withColumn("_range", F.when(F.col("doc_id").isNull(), last).otherwise(_after(bounds, F.col("doc_id"), F.col("_c"))).cast("int"))
    # a range's first document: the largest id, then the least checksum
    head = F.max(F.struct("doc_id", (-F.col("_c")).alias("c")))
    firsts = {r[0]: (r[1]["doc_id"], -r[1]["c"]) for r in ranged.groupBy("_range").agg(head).collect()}  # one row a range
    there = sorted(firsts)
    before = {r: there[k - 1] for k, r in enumerate(there)}  # the range that ends before this one; the last ends before the first
    every = range(len(bounds) + without + 1)
    ids, sums, to = (F.lit([f(r) for r in every]).cast(f"array<{t}>") for f, t in ((lambda r: firsts.get(r, (0, 0))[0] or 0, "bigint"), (lambda r: firsts.get(r, (0, -1))[1], "bigint"), (lambda r: before.get(r, -1), "int")))
    is_first = (F.coalesce("doc_id", F.lit(0)) == F.get(ids, F.col("_range"))) & (F.col("_c") == F.get(sums, F.col("_range")))
    # extra rows go to the end of the range before: of all rows with that id and checksum each reader takes the one that sorts first
    own, extra = (F.struct(r.alias("_range"), F.lit(k).alias("_extra")) for k, r in enumerate((F.col("_range"), F.get(to, F.col("_range")))))
    spread = ranged.withColumn("_p", F.explode(F.when(is_first, F.array(own, extra)).otherwise(F.array(own))))
    laid = spread.select(F.col("_p._range").alias("_range"), F.col("_p._extra").alias("_extra"), "doc_id", "text", "_c").repartitionById(len(every), "_range")
    laid = laid.sortWithinPartitions("_range", "_extra", F.col("doc_id").desc_nulls_last(), "_c").select("_range", "_extra", "doc_id", "text")

    def run(batches):
        release()
        now, held, size, ended = None, [], 0, False
        for batch in batches:
            cols = [batch.column(k) for k in range(4)]
            for r, extra, doc, text in zip(*(c.to_pylist() for c in cols), strict=True):
                if r != now:
                    now, ended = r, False
                if ended:
                    continue  # further rows with the first id of the next range
                if extra:
                    ended = True
                    if held:
                        yield _judge(held, [*(t for _, t in held[1:]), text])
                    held, size = [], 0
                    continue
                if size > batch_chars:  # the row at hand is the next of the last one held
                    yield _judge(held, [*(t for _, t in held[1:]), text])
                    held, size = [], 0
                held.append((doc, text))
                size += len(text)

    return laid.mapInArrow(run, _SCHEMA)
