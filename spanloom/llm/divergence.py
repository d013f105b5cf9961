"""Source divergence audit: how far each source's words are from those of the other sources of its language, and which words set it apart.

Terms are counted once: occurrences by (language, source, term) and documents by (language, term). The terms of a language
that enough of its documents have are dealt into buckets by hash, and its sources into blocks. A unit is a block of sources
on a bucket of terms: its counts as compressed sparse rows. Divergences add up over terms, so buckets never meet.

Within a bucket the blocks play a round-robin tournament (circle method): in each round every block meets another one.
The blocks of lower number stay in their partitions (one shuffle, reused by all rounds) and the vectors of the other one
travel to them; a meeting evaluates both directions. In a round of its own each unit compares its own sources and ranks
the terms of each in a local heap; windows merge what the buckets found.

Numbers: p = 1 + (10**9 * (count + 2)) div (N + 2 V), the divergence of a term is ((p - q)**2) div (p + q). All of it is in
integers; where 64 bits don't hold a count's product, Python's integers do.

Cases: null text, language and source are ''; sources without kept terms (or without terms at all) take part with counts
of 0; a language without kept terms has pairs of divergence 0 and no terms; a language with one source has no pairs;
repeated rows count each; equal values go by the bytes of their names; an empty table gives an empty result. Columns
other than these three are never read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import partitions, release, slices, stage, unstage
from .terms import LETTERS, counted

_UNIT = "lang string, bucket int, block int, sources array<string>, sums array<bigint>, v bigint, size int, vectors binary"
_MEET = "lang string, source string, item string, value bigint"


def _tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, occurrences, documents) of (lang, source, text) rows, added up by slices of 16 MB."""
    release()
    for batch in batches:
        for part in slices(batch, 2, 16 << 20):
            who, term, times, names = counted(part.column(2), LETTERS)
            if not len(who):
                continue
            groups: dict[tuple, int] = {}
            of = np.array([groups.setdefault(g, len(groups)) for g in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)], np.int64)
            both, first, n = np.unique(term * len(groups) + of[who], return_inverse=True, return_counts=True)
            total = np.bincount(first, weights=times, minlength=len(both)).astype(np.int64)
            langs, sources = (pa.array([g[j] for g in groups], pa.string()) for j in (0, 1))
            g, t = pa.array(both % len(groups)), pa.array(both // len(groups))
            yield pa.record_batch({"lang": langs.take(g), "source": sources.take(g), "term": names.take(t).cast(pa.string()), "n": pa.array(total), "d": pa.array(n.astype(np.int64))})


def counts(docs: DataFrame, *, least_docs: int = 10, text_col: str = "text") -> DataFrame:
    """(lang, source, term, n) of the terms that enough of a language's documents have."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    parts = docs.select(empty("lang"), empty("source"), empty(text_col)).mapInArrow(_tallies, "lang string, source string, term string, n bigint, d bigint")
    by = parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    return by.withColumn("d", F.sum("d").over(Window.partitionBy("lang", "term"))).filter(F.col("d") >= least_docs).select("lang", "source", "term", "n")


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + (10**9 * (count + 2)) div total."""
    if int(count.max(initial=0)) + 2 < (1 << 63) // 10**9:
        return 1 + 10**9 * (count + 2) // total
    exact = np.vectorize(lambda c, n: 1 + 10**9 * (int(c) + 2) // int(n), otypes=[np.int64])
    return exact(count, np.broadcast_to(total, count.shape))


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _pack(rows: np.ndarray, terms: np.ndarray, n: np.ndarray) -> bytes:
    """Sparse counts: rows and terms as 32-bit numbers, terms by their differences, compressed."""
    order = np.lexsort((terms, rows))
    rows, terms, n = rows[order].astype(np.int32), terms[order].astype(np.int32), n[order].astype(np.int64)
    return zlib.compress(np.diff(rows, prepend=0).astype(np.int32).tobytes() + np.diff(terms, prepend=0).astype(np.int32).tobytes() + n.tobytes(), 1)


def _unpack(data: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = zlib.decompress(data) if data else b""
    k = len(raw) // 16
    return np.cumsum(np.frombuffer(raw, np.int32, k)), np.cumsum(np.frombuffer(raw, np.int32, k, 4 * k)), np.frombuffer(raw, np.int64, k, 8 * k)


class _Unit:
    """A block of sources on a bucket of terms, of which shares are made for a stretch of terms at a time."""

    def __init__(self, sources: list[str], sums: list[int], v: int, size: int, vectors: bytes | None):
        self.sources, self.size = sources, size
        self.totals = np.array([n + 2 * v for n in sums], np.int64)[:, None]
        self.rows, self.terms, self.n = _unpack(vectors)
        order = np.argsort(self.terms, kind="stable")
        self.rows, self.terms, self.n = self.rows[order], self.terms[order], self.n[order]

    def counts(self, a: int, b: int) -> np.ndarray:
        i, j = np.searchsorted(self.terms, (a, b))
        out = np.zeros((len(self.sources), b - a), np.int64)
        out[self.rows[i:j], self.terms[i:j] - a] = self.n[i:j]
        return out


def _meet(x: _Unit, y: _Unit, cells: int = 1 << 20) -> np.ndarray:
    """Divergences of each source of x from each of y."""
    out = np.zeros((len(x.sources), len(y.sources)), np.int64)
    step = max(1, cells // max(1, len(x.sources), len(y.sources)))
    for a in range(0, x.size, step):
        b = min(x.size, a + step)
        p, q = (shares(u.counts(a, b), u.totals) for u in (x, y))
        for i in range(len(p)):
            out[i] += distance(p[i], q).sum(axis=1)
    return out


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both directions of each pair of sources of a resident unit and a visitor."""
    for batch in batches:
        for r in batch.to_pylist():
            x = _Unit(r["sources"], r["sums"], r["v"], r["size"], r["vectors"])
            y = _Unit(r["sources_2"], r["sums_2"], r["v"], r["size"], r["vectors_2"])
            d = _meet(x, y)
            i, j = (k.ravel() for k in np.indices(d.shape))
            a, b = pa.array(x.sources, pa.string()).take(pa.array(i)), pa.array(y.sources, pa.string()).take(pa.array(j))
            for one, other in ((a, b), (b, a)):
                yield _rows(r["lang"], one, other, d.ravel())


def _rows(lang: str, source: pa.Array, item: pa.Array, value: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch({"lang": pa.array([lang] * len(source), pa.string()), "source": source, "item": item, "value": pa.array(value, pa.int64())})


def _at_home(k: int):
    """Pairs within a unit, and each source's k terms that stand out most there: (lang, source, part, item, value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                x = _Unit(r["sources"], r["sums"], r["v"], r["size"], r["vectors"])
                d = _meet(x, x)
                out = [(s, "pair", o, int(d[i, j])) for i, s in enumerate(x.sources) for j, o in enumerate(x.sources) if i != j]
                if x.size:
                    q = shares(np.array(r["totals"], np.int64), np.array([r["whole"] + 2 * r["v"]], np.int64))
                    order = np.lexsort((x.terms, x.rows))
                    rows, terms, n = x.rows[order], x.terms[order], x.n[order]
                    for i, s in enumerate(x.sources):
                        a, b = np.searchsorted(rows, (i, i + 1))
                        t = terms[a:b]
                        p = shares(n[a:b], x.totals[i])
                        f = distance(p, q[t])
                        heap = heapq.nsmallest(k, ((-int(f[j]), int(t[j])) for j in np.flatnonzero((p > q[t]) & (n[a:b] > 0))))  # numbers of terms follow their bytes
                        out += [(s, "term", r["terms"][j], -f) for f, j in heap]
                cols = list(zip(*out, strict=True)) if out else [(), (), (), ()]
                yield pa.record_batch({"lang": pa.array([r["lang"]] * len(out), pa.string()), **{c: pa.array(v, pa.int64() if c == "value" else pa.string()) for c, v in zip(("source", "part", "item", "value"), cols, strict=True)}})

    return run


def _units(seeds: int):
    """A bucket's rows (lang, bucket, source, block, term, n) as units, and as the bucket's terms with their totals (block -1)."""

    def run(rows: pa.Table) -> pa.Table:
        lang, bucket = rows.column("lang")[0].as_py(), rows.column("bucket")[0].as_py()
        coded = pc.dictionary_encode(rows.column("term").combine_chunks())
        order = pc.sort_indices(coded.dictionary.cast(pa.binary())).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        term, n, block = rank[coded.indices.to_numpy()], rows.column("n").to_numpy(), rows.column("block").to_numpy()
        totals = np.zeros(len(order), np.int64)
        np.add.at(totals, term, n)
        names = coded.dictionary.take(pa.array(order)).to_pylist()
        out = [{"block": -1, "present": None, "vectors": None, "terms": names, "totals": totals.tolist(), "size": len(names)}]
        source = pc.dictionary_encode(rows.column("source").combine_chunks())
        for k in range(seeds):
            here = np.flatnonzero(block == k)
            if len(here):
                codes, at = np.unique(source.indices.to_numpy()[here], return_inverse=True)
                out.append({"block": k, "present": source.dictionary.take(pa.array(codes)).to_pylist(), "vectors": _pack(at, term[here], n[here]), "terms": None, "totals": None, "size": len(names)})
        return pa.Table.from_pylist([{"lang": lang, "bucket": bucket, **x} for x in out], pa.schema([
            ("lang", pa.string()), ("bucket", pa.int32()), ("block", pa.int32()), ("present", pa.list_(pa.string())), ("vectors", pa.binary()),
            ("terms", pa.list_(pa.string())), ("totals", pa.list_(pa.int64())), ("size", pa.int32()),
        ]))

    return run


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units' rows numbered by the block's whole list of sources instead of those present."""
    for batch in batches:
        made = []
        for r in batch.to_pylist():
            if r["vectors"]:
                place = {s: i for i, s in enumerate(r["sources"])}
                rows, terms, n = _unpack(r["vectors"])
                r["vectors"] = _pack(np.array([place[s] for s in r["present"]], np.int64)[rows], terms, n)
            made.append(r["vectors"])
        yield pa.record_batch([batch.column(c) if c != "vectors" else pa.array(made, pa.binary()) for c in ("lang", "bucket", "block", "sources", "sums", "v", "size", "vectors")], ["lang", "bucket", "block", "sources", "sums", "v", "size", "vectors"])


def opponent(block: Column, turn: int, blocks: int) -> Column:
    """Whom a block meets in a turn of the circle method: the last block stays, the others go round. Of an odd number, the one who would meet the last has a rest."""
    last = blocks - 1 if blocks % 2 == 0 else blocks
    mirror = F.pmod(F.lit(2 * turn) - block, F.lit(last))
    return F.when(block == last, F.lit(turn)).when(mirror == block, F.lit(last)).otherwise(mirror).cast("int")


def audit(docs: DataFrame, *, least_docs: int = 10, k: int = 10, block_sources: int = 8, most_blocks: int = 16, unit_rows: int = 1 << 15) -> DataFrame:
    """(lang, source, part, item, value, rank): every other source of the language by divergence, and the k terms that set a source apart.

    A block has some `block_sources` sources, more where that would make over `most_blocks` blocks; a bucket has some `unit_rows` counts.
    """
    kept = stage(counts(docs, least_docs=least_docs), "terms")
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    groups = docs.select(empty("lang"), empty("source")).distinct()
    of = stage(groups.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("sum")), ["lang", "source"], "left").na.fill(0, ["sum"]), "sources")
    sizes = of.groupBy("lang").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    rows = kept.count()
    blocks = max(1, min(most_blocks, -(-sizes // block_sources)))
    buckets = max(1, -(-rows // unit_rows))
    block = F.pmod(F.xxhash64("source"), F.lit(blocks)).cast("int")
    dealt = kept.withColumns({"bucket": F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"), "block": block})
    packed = stage(dealt.groupBy("lang", "bucket").applyInArrow(_units(blocks), "lang string, bucket int, block int, present array<string>, vectors binary, terms array<string>, totals array<bigint>, size int"), "vectors")
    v = kept.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("v"))
    whole = of.groupBy("lang").agg(F.sum("sum").alias("whole")).join(v, "lang", "left").na.fill(0, ["v"])
    # every language has a bucket without terms, so that all its sources meet even if no term is kept
    names = packed.filter("block = -1").select("lang", "bucket", "size", "terms", "totals")
    names = stage(names.unionByName(whole.select("lang", F.lit(-1).alias("bucket"), F.lit(0).alias("size"), F.lit(None).cast("array<string>").alias("terms"), F.lit(None).cast("array<bigint>").alias("totals"))).join(whole, "lang"), "buckets")
    listed = of.withColumn("block", block).groupBy("lang", "block").agg(F.sort_array(F.collect_list(F.struct("source", "sum"))).alias("s"))  # a block's sources
    listed = listed.select("lang", "block", F.col("s.source").alias("sources"), F.col("s.sum").alias("sums"))
    units = names.select("lang", "bucket", "size", "v").join(listed, "lang").join(packed.filter("block >= 0").select("lang", "bucket", "block", "present", "vectors"), ["lang", "bucket", "block"], "left")
    units = stage(units.select("lang", "bucket", "block", "sources", "sums", "v", "size", "present", "vectors").mapInArrow(_named, _UNIT), "units")
    unstage(packed)
    home = units.join(names.select("lang", "bucket", "terms", "totals", "whole"), ["lang", "bucket"]).mapInArrow(_at_home(k), "lang string, source string, part string, item string, value bigint")
    found = [home]
    resident = units.repartition(partitions(docs.sparkSession), "lang", "bucket", "block")
    for turn in range(blocks - 1 if blocks % 2 == 0 else blocks) if blocks > 1 else ():
        other = opponent(F.col("block"), turn, blocks)
        visitors = units.filter((other < F.col("block")) & (other >= 0)).select("lang", "bucket", other.alias("block"), F.col("sources").alias("sources_2"), F.col("sums").alias("sums_2"), F.col("vectors").alias("vectors_2"))
        met = resident.join(visitors, ["lang", "bucket", "block"]).select("lang", "sources", "sums", "v", "size", "vectors", "sources_2", "sums_2", "vectors_2")
        found.append(met.mapInArrow(_meetings, _MEET).select("lang", "source", F.lit("pair").alias("part"), "item", "value"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    # a pair has a row a bucket, a term one in all
    out = out.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    place = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), F.asc("item"))
    return out.withColumn("rank", F.row_number().over(place)).filter((F.col("part") == "pair") | (F.col("rank") <= k))
