"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints: 64 bits, each the majority over a text's word shingles. Two fingerprints of distance at most `distance`
must, for any partition of the bits, be within t_i in some part i, as soon as the t_i + 1 add up to `distance` + 1. Here
correlated bits are put into common parts, and the t_i (a part may also be left out) are found by dynamic programming on
estimated costs: the candidate pairs that the part will bring, from agreement of bits over all fingerprints, and the
index rows that it takes. Parts are probed by masks: distance t on a part is equality with t of its bits blanked, so each
fingerprint makes one index row a mask, and the rows of a mask and key form a bucket.

Equal fingerprints are one node from the start. A bucket's pairs are verified exactly in numpy, and only edges that
connect something new inside the bucket leave it: a spanning forest, never all pairs. Buckets of more than `bucket` rows
are dealt in chunks whose pairs are separate groups, so no task holds a large bucket. Components follow by alternating
large-star and small-star steps over tables in the shared folder.

Cases: null and wordless texts have fingerprint zero, which links like any other. A null id gets a fingerprint and a
component but names none. Repeated rows link to themselves. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations
from math import comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from .shared import free_name, partitions, release, slices, stage, unstage

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_hashes(text: str | None, width: int = 4, seed: int = 42) -> np.ndarray:
    """The XXH64 of the text's word shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxh64_intdigest(joined, seed)], "<u8")
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    begins = (ends - sizes)[: len(words) - width + 1].tolist()
    return np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(begins, ends[width - 1 :].tolist(), strict=True)], "<u8")


def majority(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half the hashes."""
    if not len(hashes):
        return 0
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        total += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """The majority over the text's word shingles; zero without words."""
    return majority(shingle_hashes(text, width, seed))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, text_key, fp): fingerprints as signed 64-bit numbers, and a hash of the text that tells rows of one id apart."""

    def run(batches):
        release()
        for batch in batches:
            for part in slices(batch, 2):
                fps = np.array([fingerprint(x, width, seed) for x in part.column(2).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fps.view(np.int64))], names=["doc_id", "text_key", "fp"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("text_key", T.LongType()), T.StructField("fp", T.LongType())])
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def bit_statistics(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and for each two bits in how many both are set (64 x 64), over all fingerprints."""

    def run(batches):
        total = np.zeros((64, 64))
        n = 0
        for batch in batches:
            fps = batch.column(0).to_numpy().astype("<i8")
            for at in range(0, len(fps), 4096):
                bits = np.unpackbits(fps[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total += bits.T @ bits
                n += len(bits)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([[n, *total.ravel().astype(np.int64).tolist()]], pa.list_(pa.int64()))], names=["v"])

    each = nodes.select("fp").mapInArrow(run, "v array<long>").select(F.posexplode("v").alias("at", "n"))
    got = {r[0]: r[1] for r in each.groupBy("at").agg(F.sum("n")).collect()}  # 1 + 64 x 64 numbers
    return got.get(0, 0), np.array([got.get(k + 1, 0) for k in range(64 * 64)], float).reshape(64, 64)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in `parts` groups of nearly equal size; a group grows by the bit most correlated with it."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(corr, 0)
    left = set(range(64))
    out = []
    for k in range(parts):
        size = 64 // parts + (k < 64 % parts)
        group = [max(sorted(left), key=lambda b: corr[b, sorted(left)].sum())]
        left.remove(group[0])
        while len(group) < size:
            b = max(sorted(left), key=lambda b: corr[b, group].max())
            group.append(b)
            left.remove(b)
        out.append(sorted(group))
    return out


def agreement(n: int, both: np.ndarray, bits: list[int]) -> float:
    """Estimated logarithm of the chance that two fingerprints agree on all these bits: a maximum spanning tree of pairwise agreements."""
    n = max(n, 1)
    one = np.diag(both) / n
    q = one**2 + (1 - one) ** 2

    def pair(a: int, b: int) -> float:
        x11 = both[a, b] / n
        x10, x01 = one[a] - x11, one[b] - x11
        return x11**2 + x10**2 + x01**2 + (1 - x11 - x10 - x01) ** 2

    if not bits:
        return 0.0
    total, inside, rest = log(q[bits[0]]), [bits[0]], set(bits[1:])
    gain = {b: (log(pair(bits[0], b) / (q[bits[0]] * q[b])), b) for b in rest}
    while rest:
        b = max(sorted(rest), key=lambda x: gain[x][0])
        rest.remove(b)
        total += log(q[b]) + gain.pop(b)[0]
        inside.append(b)
        for x in rest:
            g = log(pair(b, x) / (q[b] * q[x]))
            if g > gain[x][0]:
                gain[x] = (g, x)
    return total


#: What a candidate pair costs against an index row: a comparison in numpy against a row's way through a shuffle.
PAIR, ROW = 1.0, 150.0


def choose(n: int, both: np.ndarray, distance: int = 4, most: int = 3) -> list[tuple[list[int], int]]:
    """Parts with their thresholds: the cheapest plan over 1 to distance + 1 parts, thresholds by dynamic programming."""
    plans = []
    for parts in range(2, distance + 2):
        groups = group_bits(n, both, parts)
        cost = []
        for bits in groups:
            row = [0.0]
            whole = agreement(n, both, bits)
            per_bit = whole / len(bits)
            for t in range(min(most, len(bits))):
                masks = comb(len(bits), t)
                pairs = n * n / 2 * masks * np.exp(whole - t * per_bit)
                row.append(PAIR * pairs + ROW * masks * n)
            cost.append(row)
        best = {0: (0.0, [])}
        for row in cost:
            nxt: dict[int, tuple[float, list[int]]] = {}
            for units, (c, ts) in best.items():
                for u, x in enumerate(row):
                    k = units + u
                    if k <= distance + 1 and (k not in nxt or c + x < nxt[k][0]):
                        nxt[k] = (c + x, [*ts, u - 1])
            best = nxt
        if distance + 1 in best:
            c, ts = best[distance + 1]
            plans.append((c, parts, [(g, t) for g, t in zip(groups, ts, strict=True) if t >= 0]))
    return min(plans)[2]


def masks(plan: list[tuple[list[int], int]]) -> list[int]:
    """One mask for each part and choice of blanked bits, as signed 64-bit numbers."""
    out = []
    for bits, t in plan:
        for blank in combinations(bits, t):
            m = sum(1 << b for b in bits if b not in blank)
            out.append(m - (1 << 64) if m >> 63 else m)
    return out


def forest(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Labels after joining a[i] with b[i]: the least index of each component."""
    while True:
        la, lb = label[a], label[b]
        if (la == lb).all():
            return label
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            nxt = label[label]
            if (nxt == label).all():
                break
            label = nxt


def bucket_edges(group: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges between fingerprints of the same group (equal ids are adjacent) within the distance; pairs already connected inside a group are passed over."""
    n = len(fp)
    label = np.arange(n)
    found_a, found_b = [], []
    end = np.searchsorted(group, group, "right")
    at = np.arange(n)
    for lag in range(1, n):
        at = at[at + lag < end[at]]
        if not len(at):
            break
        a = at[label[at] != label[at + lag]]
        if not len(a):
            continue
        a = a[np.bitwise_count(fp[a] ^ fp[a + lag]) <= distance]
        if len(a):
            found_a.append(a)
            found_b.append(a + lag)
            label = forest(n, a, a + lag, label)
    if not found_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return fp[np.concatenate(found_a)].view(np.int64), fp[np.concatenate(found_b)].view(np.int64)


def links(nodes: DataFrame, *, distance: int = 4, bucket: int = 2048) -> DataFrame:
    """(a, b): verified edges between distinct fingerprints (a staged table `fp`) whose components are those of all links."""
    spark = nodes.sparkSession
    n, both = bit_statistics(nodes)
    rows = nodes.select(
        "fp", F.explode(F.transform(F.sequence(F.lit(0), F.lit(len(m := masks(choose(n, both, distance))) - 1)), lambda i: F.struct(i.alias("mask"), F.col("fp").bitwiseAND(F.get(F.lit(m).cast("array<bigint>"), i)).alias("key")))).alias("x"),
    ).select("x.mask", "x.key", "fp")
    large = stage(rows.groupBy("mask", "key").agg(F.count("*").alias("n")).filter(F.col("n") > bucket), "large-buckets")
    if not large.isEmpty():
        chunks = F.ceil(F.col("n") / bucket).cast("int")
        own = F.pmod(F.xxhash64("fp", F.lit(7)), chunks).cast("int")
        dealt = rows.join(large, ["mask", "key"], "left").withColumn("own", F.coalesce(own, F.lit(0)))
        other = F.explode(F.sequence(F.lit(0), F.coalesce(chunks - 1, F.lit(0))))
        rows = dealt.withColumn("other", other).select(
            "mask", "key", "fp", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")
        )
    else:
        rows = rows.withColumns({"low": F.lit(0), "high": F.lit(0)})
    by = ["mask", "key", "low", "high"]

    def run(batches):
        held = None
        for batch in batches:
            keys = [batch.column(k).to_numpy() for k in range(4)]
            fp = batch.column(4).to_numpy().view(np.uint64)
            if held is not None:
                keys = [np.concatenate(x) for x in zip(held[0], keys, strict=True)]
                fp = np.concatenate((held[1], fp))
            new = np.ones(len(fp), bool)
            new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
            last = int(np.flatnonzero(new)[-1])  # the last group may go on in the next batch
            held = ([k[last:].copy() for k in keys], fp[last:].copy())
            if last:
                yield from _edges(np.cumsum(new[:last]), fp[:last], distance)
        if held is not None:
            yield from _edges(np.zeros(len(held[1]), np.int64), held[1], distance)

    sorted_rows = rows.select(*by, "fp").repartition(partitions(spark), *by).sortWithinPartitions(*by)
    return sorted_rows.mapInArrow(run, "a long, b long")


def _edges(group: np.ndarray, fp: np.ndarray, distance: int):
    some = np.zeros(len(group), bool)
    same = group[1:] == group[:-1]
    some[1:] |= same
    some[:-1] |= same
    a, b = bucket_edges(group[some], fp[some], distance)
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node reachable, for every node with an edge, by alternating stars; each round is a table in the shared folder."""
    now = stage(edges.filter("a <> b").distinct(), "stars")
    before = None
    while True:
        size = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if size == before or not size[0]:
            break
        before = size
        # large star: each node hands its larger neighbours to the least of all; small star: its smaller ones, and itself
        ways = now.select("a", "b").union(now.select(F.col("b"), F.col("a")))
        least = ways.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = ways.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("x")).select(F.col("x.b").alias("a"), F.col("x.m").alias("b")).filter("a <> b").distinct()
        nxt = stage(small, "stars")
        unstage(now)
        now = nxt
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b"))).distinct()


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42, distance: int = 4, bucket: int = 2048,
) -> DataFrame:
    """(doc_id, text_key, fp, group, component_id): component_id is the least doc_id reachable through links of at most `distance` differing bits; group names the component even where ids repeat."""
    marked = stage(fingerprints(docs, id_col=id_col, text_col=text_col, width=width, seed=seed), "fingerprints")
    nodes = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes, distance=distance, bucket=bucket))
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("group"))
    named = rooted.join(rooted.groupBy("group").agg(F.min("least").alias("component_id")), "group").select("fp", "group", "component_id")
    return marked.join(stage(named, "named"), "fp").select("doc_id", "text_key", "fp", "group", "component_id")


def hexed(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs, same columns: of each component one row stays, that of the least id (of its texts, that of the least hash); rows without id stay."""
    return keep_first(docs, near_duplicates(docs, id_col=id_col, text_col=text_col, **how), id_col=id_col, text_col=text_col)


def keep_first(docs: DataFrame, groups: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, same columns, with one row of each group of groups (doc_id, text_key, group); rows without id stay. Of rows with equal id and text any one may be the one that stays."""
    same = groups.filter("doc_id is not null").groupBy("group", "doc_id", "text_key").agg(F.count("*").alias("n"))
    chosen = stage(same.groupBy("group").agg(F.min(F.struct("doc_id", "text_key", "n")).alias("f")).select("f.*"), "kept")
    names = {c: free_name(docs, f"_{c}") for c in chosen.columns}
    named = chosen.select(*[F.col(c).alias(n) for c, n in names.items()])
    on = (F.col(f"`{id_col}`") == F.col(names["doc_id"])) & (F.xxhash64(F.col(f"`{text_col}`")) == F.col(names["text_key"]))
    some = docs.join(named.hint("merge"), on)  # the kept ids grow with the documents: one plan at every size
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if chosen.filter("n > 1").isEmpty():
        once = some.select(*columns)
    else:
        once = some.filter(F.col(names["n"]) == 1).select(*columns).union(some.filter(F.col(names["n"]) > 1).dropDuplicates([id_col]).select(*columns))
    return once.union(docs.filter(F.col(f"`{id_col}`").isNull()))
