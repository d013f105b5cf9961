"""Near copies by SimHash and by Jaccard similarity of word shingles: linked fingerprints first, then an exact pass for the rest.

Texts with the same set of shingles are one node. Fingerprints of nodes are linked as in simhash.py, and linked nodes whose
sets have the similarity s are joined, so that large groups of copies are one component early. As texts of similarity 0.8
often differ in more bits than can be probed, a prefix filter finds all other pairs: of two sets with similarity s or more,
the first n - ceil(s n) + 1 members of each, in any order common to all, share one; so each node makes an index row for
each of these, and only rows that share a shingle go on. The order puts shingles that are frequent in a sample last: it
changes the cost, not the pairs. Pairs whose components differ are verified in two steps: first, of each shingle's pairs, a
spanning forest of the likeliest ones, so that their number grows with the rows and not with their square; then, for a shingle
with a forest edge whose ends are still in two components, all pairs whose components still differ. Elsewhere the forest has
joined all that its pairs could join, so no link is lost. A pair is passed over only by bounds that hold
for it: the sizes; the places of the first shared member in both orders, as no more than what follows can be common; and a
parity of the members in each of 1,024 classes or four a member (coarser ones in the buckets), as sets differ by at least as many members as parities. The rest is
verified against the whole sets.

Cases: null and wordless texts are one node, which is like no other. Texts of fewer words than a shingle are one shingle.
Rows without an id take no part. Rows that share an id are told apart by a hash of their text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window
from xxhash import xxh64_intdigest

from .shared import partitions, release, slices, stage, unstage
from .simhash import components, forest, links, majority, shingle_hashes


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """The sorted distinct hashes of the text's word shingles, as signed numbers."""
    return np.unique(shingle_hashes(text, width).view(np.int64))


def prefix(found: np.ndarray, frequent: np.ndarray, rank: np.ndarray, num: int, den: int) -> np.ndarray:
    """The members of a set that an index for similarity num / den needs: rare ones first, frequent ones by rank."""
    n = len(found)
    if n and len(frequent):
        at = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
        found = found[np.lexsort((found, np.where(frequent[at] == found, rank[at] + 1, 0)))]
    return found[: n - -(-num * n // den) + 1] if n else found


def _frequent(docs: DataFrame, text_col: str, width: int, rows: int = 4000, most: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that repeat in a sample, sorted, and their ranks by frequency."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 0):
                found = [shingles(x, width) for x in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found))], names=["s"])

    n = docs.count()
    some = docs.select(text_col).sample(min(1.0, rows / max(n, 1)), seed=1)
    got = some.mapInArrow(run, "s long").groupBy("s").agg(F.count("*").alias("n")).filter("n > 2").orderBy(F.desc("n"), "s").limit(most).collect()
    hashes = np.array([r[0] for r in got], np.int64)
    order = np.argsort(hashes)
    return hashes[order], (len(got) - order).astype(np.int64)


def parities(found: np.ndarray) -> list[list[int]]:
    """Whether the numbers of members in classes are odd, as bits of 64-bit words: for 1,024 classes and for each power of two up to four classes a member."""
    size = 1024
    while size < 4 * len(found):
        size *= 2
    odd = (np.bincount(found & (size - 1), minlength=size) & 1).astype(np.uint8)
    out = [odd]
    while size > 1024:
        size //= 2
        odd = odd[:size] ^ odd[size:]
        out.append(odd)
    return [np.packbits(x, bitorder="little").view("<i8").tolist() for x in reversed(out)]


#: Bits of the filter that keeps texts nobody asks for out of a shuffle: half a megabyte, whatever the number of rows.
FILTER = 1 << 22


def _in_filter(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of docs whose id's hash is that of a wanted id. The bits are broadcast in words of 64 (65,536 rows at most); as a literal they would stand in every text of the plan that the driver keeps. With very many ids all rows pass, and the join behind decides."""
    h = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER))
    word, bit = F.shiftright(h, 6).cast("int"), F.pmod(h, F.lit(64)).cast("int")
    words = wanted.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"))
    found = docs.withColumns({"_at": word, "_bit": bit}).join(F.broadcast(words), F.col("_at") == F.col("_word"))
    return found.filter(F.call_function("getbit", "_bits", "_bit") == 1).select(*docs.columns)


def sketch(bits: list[list[int]], n: int) -> list[int]:
    """The parities of the fewest classes, 256 at least, that are as many as members."""
    size = 256
    while size < n:
        size *= 2
    out = np.array(bits[max(0, (size // 1024).bit_length() - 1)], np.int64)
    while len(out) > size // 64:
        out = _half(out)
    return out.tolist()


def _half(words: np.ndarray) -> np.ndarray:
    """Parities of half as many classes."""
    w = words.shape[-1] // 2
    return words[..., :w] ^ words[..., w:]


def _differ(a: np.ndarray, b: np.ndarray, words: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """In how many classes the parities of rows a[i] and b[i] differ; the finer sketch of two is halved until it is as coarse as the other. words: all rows' sketches on end."""
    out = np.zeros(len(a), np.int64)
    for pair in np.unique(size[a].astype(np.int64) << 32 | size[b]).tolist():
        x, y = pair >> 32, pair & 0xFFFFFFFF
        at = np.flatnonzero((size[a] == x) & (size[b] == y))
        for part in np.array_split(at, len(at) * (x + y) // (1 << 20) + 1):
            left, right = (words[first[r[part]][:, None] + np.arange(w)] for r, w in ((a, x), (b, y)))
            while left.shape[1] > right.shape[1]:
                left = _half(left)
            while right.shape[1] > left.shape[1]:
                right = _half(right)
            out[part] = np.bitwise_count((left ^ right).view(np.uint64)).sum(1)
    return out


def _cross(group, key, n, pos, label, words, size, num: int, den: int):
    """Pairs (row, row, classes they differ in) of a group (rows sorted by group and n) with different labels whose sizes and sketches allow the similarity, lag by lag."""
    end = np.searchsorted(group, group, "right")
    first = np.cumsum(size) - size
    at, lag = np.arange(len(group)), 0
    while len(at):
        lag += 1
        at = at[at + lag < end[at]]
        at = at[num * n[at + lag] <= den * n[at]]
        a = at[label[at] != label[at + lag]]
        b = a + lag
        a = a[np.minimum(n[a] - pos[a], n[b] - pos[b]) * (num + den) >= (n[a] + n[b]) * num]
        if len(a):
            differ = _differ(a, a + lag, words, first, size)
            some = differ * (num + den) <= (n[a] + n[a + lag]) * (den - num)
            a, differ = a[some], differ[some]
        if len(a):
            yield a, a + lag, differ


def _every(group, key, n, pos, label, words, size, num: int, den: int):
    """All pairs of _cross, as keys."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    waiting = 0
    for a, b, _ in _cross(group, key, n, pos, label, words, size, num, den):
        held.append((np.maximum(key[a], key[b]), np.minimum(key[a], key[b])))
        waiting += len(a)
        if waiting > 100_000:
            yield _batch(("a", "b"), *map(np.concatenate, zip(*held, strict=True)))
            held, waiting = [], 0
    if held:  # once for each shared shingle; the aggregation behind it makes them distinct before the shuffle
        yield _batch(("a", "b"), *map(np.concatenate, zip(*held, strict=True)))


def _batch(names: tuple[str, ...], *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=list(names))


def _lightest(start: np.ndarray, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Which of the edges a[i] - b[i] make a lightest spanning forest over the components `start` (of each row the first one of its component), by Boruvka's rounds."""
    label, chosen = start.copy(), []
    order = np.argsort(weight, kind="stable")
    a, b = a[order], b[order]
    left = np.arange(len(order))
    while len(left := left[label[a[left]] != label[b[left]]]):
        best = np.full(len(label), len(order))
        np.minimum.at(best, label[a[left]], left)
        np.minimum.at(best, label[b[left]], left)
        take = np.unique(best[best < len(order)])
        chosen.append(take)
        label = forest(len(label), a[take], b[take], label)
    return order[np.concatenate(chosen)] if chosen else left


def _trees(group, key, n, pos, label, words, size, num: int, den: int, most: int = 1 << 20):
    """Of the pairs of _cross those that span the components they make, the likeliest first: fewer than rows. s names the group where there are other pairs as well, else it is null."""
    by = np.lexsort((label, group))
    new = np.ones(len(by), bool)
    new[1:] = (group[by][1:] != group[by][:-1]) | (label[by][1:] != label[by][:-1])
    start = np.empty(len(by), np.int64)
    start[by] = by[np.flatnonzero(new)][np.cumsum(new) - 1] if len(by) else by  # lexsort is stable: the first row comes first
    begin = np.searchsorted(group, group)
    pairs = np.zeros(len(group), np.int64)
    held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    waiting = 0

    def spanning():
        a, b, weight = map(np.concatenate, zip(*held, strict=True))
        some = _lightest(start, a, b, weight)
        return a[some], b[some], weight[some]

    for a, b, differ in _cross(group, key, n, pos, label, words, size, num, den):
        pairs += np.bincount(begin[a], minlength=len(pairs))
        held.append((a, b, differ / (n[a] + n[b])))
        waiting += len(a)
        if waiting > most:
            held, waiting = [spanning()], 0
    a, b, _ = spanning()
    if len(a):
        more = pairs[begin[a]] > np.bincount(begin[a], minlength=len(pairs))[begin[a]]
        yield pa.RecordBatch.from_arrays([pa.array(np.maximum(key[a], key[b])), pa.array(np.minimum(key[a], key[b])), pa.array(group[a], mask=~more)], names=["a", "b", "s"])


def _by_group(pairs, num: int, den: int):
    """A function of batches (rows sorted by s and n) that gives `pairs` whole groups."""

    def cross(batches):
        release()
        held = None
        for batch in batches:
            *cols, lists = batch.columns
            cols = [c.to_numpy() for c in cols]
            cols += [lists.flatten().to_numpy(), pc.list_value_length(lists).to_numpy()]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            last = int(np.searchsorted(cols[0], cols[0][-1])) if len(cols[0]) else 0  # the last group may go on in the next batch
            word = int(cols[6][:last].sum())
            cuts = [last] * 5 + [word, last]
            held = [c[k:].copy() for c, k in zip(cols, cuts, strict=True)]
            if last:
                yield from pairs(*(c[:k] for c, k in zip(cols, cuts, strict=True)), num, den)
        if held is not None:
            yield from pairs(*held, num, den)

    return cross


def near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: tuple[int, int] = (4, 5), distance: int = 4) -> DataFrame:
    """(doc_id, text_key, group, component_id) of rows with an id: component_id is the least doc_id reachable through texts of at least that similarity (a fraction), group names the component."""
    num, den = similarity
    spark = docs.sparkSession
    docs = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    frequent, rank = _frequent(docs, "text", width)

    def index(batches):
        release()
        for batch in batches:
            for part in slices(batch, 2):
                rows = []
                for x in part.column(2).to_pylist():
                    hashes = shingle_hashes(x, width)
                    s = np.unique(hashes.view(np.int64))
                    bits = parities(s)
                    rows.append((xxh64_intdigest(s.tobytes()), majority(hashes), len(s), prefix(s, frequent, rank, num, den), bits, sketch(bits, len(s))))
                keys, fps, sizes, heads, bits, rough = zip(*rows, strict=True)
                numbers = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (keys, fps)]
                lists = [pa.array(heads, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.list_(pa.int64()))), pa.array(rough, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *numbers, pa.array(sizes, pa.int64()), *lists], names=["doc_id", "text_key", "key", "fp", "n", "head", "bits", "sketch"])

    long, longs = T.LongType(), T.ArrayType(T.LongType())
    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), *[T.StructField(c, long) for c in ("text_key", "key", "fp", "n")], T.StructField("head", longs), T.StructField("bits", T.ArrayType(longs)), T.StructField("sketch", longs)]
    marked = stage(docs.mapInArrow(index, T.StructType(fields)), "shingled")
    nodes = stage(marked.groupBy("key").agg(F.min("doc_id").alias("least"), *[F.first(c).alias(c) for c in ("fp", "n", "head", "bits", "sketch")]), "shingle-sets")
    by = Window.partitionBy("s").orderBy("n", "key")
    rows = nodes.select(F.posexplode("head").alias("pos", "s"), "key", "n").withColumns({"prev": F.lag("key").over(by), "next": F.lead("key").over(by)})
    shared = stage(rows.filter("prev is not null or next is not null"), "shared-shingles")

    def whole(batches):
        release()
        for batch in batches:
            for part in slices(batch, 1):
                sets = [shingles(x, width) for x in part.column(1).to_pylist()]
                keys = pa.array(np.array([xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64))
                rows = pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["key", "members"])
                yield rows.filter(pc.equal(keys, part.column(0)))  # repeated ids may have other texts

    def verified(pairs: DataFrame, label: str) -> DataFrame:
        x, y = (nodes.select(F.col("key").alias(k), F.col("n").alias(f"_n{k}"), F.col("bits").alias(f"_bits{k}"), F.col("least").alias(f"_least{k}")) for k in "ab")
        finest = F.least(F.size("_bitsa"), F.size("_bitsb")) - 1
        differ = F.aggregate(F.zip_with(F.get("_bitsa", finest), F.get("_bitsb", finest), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, v: t + v)
        # sets of n and m members with c in common differ by n + m - 2 c, and c (num + den) >= (n + m) num
        some = stage(pairs.distinct().join(x, "a").join(y, "b").filter(differ * (num + den) <= (F.col("_na") + F.col("_nb")) * (den - num)).select("a", "b", "_leasta", "_leastb"), "near-candidates")
        wanted = some.select(F.col("a").alias("key"), F.col("_leasta").alias("doc_id")).union(some.select("b", "_leastb")).distinct()
        texts = _in_filter(docs, wanted).join(wanted.hint("merge"), "doc_id").dropDuplicates(["doc_id", "key", "text_key"])  # dealt by id already
        sets = stage(texts.select("key", "text").mapInArrow(whole, "key long, members array<long>"), "shingle-members")
        x, y = (sets.select(F.col("key").alias(k), F.col("members").alias(f"_{k}")) for k in "ab")
        common = F.size(F.array_intersect("_a", "_b"))
        out = stage(some.select("a", "b").join(x, "a").join(y, "b").filter(common * (num + den) >= (F.size("_a") + F.size("_b")) * num).select("a", "b"), label)
        unstage(sets)
        unstage(some)
        return out

    # SimHash: fingerprints within `distance` bits by the generalised pigeonhole, one node for each; nodes of one fingerprint with that node
    prints = stage(nodes.filter("n > 0").groupBy("fp").agg(F.min("key").alias("first")), "fingerprints")
    near = links(prints.select("fp"), distance=distance)
    ends = [prints.select(F.col("fp").alias(c), F.col("first").alias(f"_{c}")) for c in "ab"]
    linked = near.join(ends[0], "a").join(ends[1], "b").select(F.col("_a").alias("x"), F.col("_b").alias("y"))
    same = nodes.join(prints, "fp").filter("key <> first").select(F.col("key").alias("x"), F.col("first").alias("y"))
    edges = verified(linked.union(same).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")), "near-neighbours")
    roots = stage(components(edges), "near-roots")

    def crossed(shared: DataFrame, roots: DataFrame, pairs, schema: str) -> DataFrame:
        marks = nodes.join(roots, nodes.key == roots.node, "left").select(F.col("key").alias("k"), F.coalesce("root", "key").alias("label"), "sketch")
        labelled = shared.join(marks.hint("merge"), shared.key == F.col("k")).select("s", "key", "n", "pos", "label", "sketch")
        return labelled.repartition(partitions(spark), "s").sortWithinPartitions("s", "n", "key").mapInArrow(_by_group(pairs, num, den), schema)

    def joined(roots: DataFrame, edges: DataFrame) -> DataFrame:
        return stage(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(edges)), "near-roots")

    # a spanning forest of each shingle's pairs; where one of its edges joins nothing, the other pairs of that shingle are asked too
    trees = stage(crossed(shared, roots, _trees, "a long, b long, s long"), "near-trees")
    roots = joined(roots, verified(trees.select("a", "b"), "near-pairs"))
    ends = [roots.select(F.col("node").alias(c), F.col("root").alias(f"_{c}")) for c in "ab"]
    apart = ~F.coalesce("_a", "a").eqNullSafe(F.coalesce("_b", "b"))
    unsettled = stage(trees.filter("s is not null").join(ends[0], "a", "left").join(ends[1], "b", "left").filter(apart).select("s").distinct(), "near-unsettled")
    if not unsettled.isEmpty():
        roots = joined(roots, verified(crossed(shared.join(unsettled, "s", "left_semi"), roots, _every, "a long, b long"), "near-pairs"))
    rooted = nodes.join(roots, nodes.key == roots.node, "left").select("key", "least", F.coalesce("root", "key").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("key", F.col("root").alias("group"), "component_id")
    return marked.select("doc_id", "text_key", "key").join(stage(named, "near-named"), "key").select("doc_id", "text_key", "group", "component_id")
