"""Ranked search, divergence of sources and toxicity against brute force, and in odd cases."""

import math
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.llm import divergence, lexical, toxicity
from spanloom.llm.queries import op11_toxicity
from spanloom.llm.terms import LETTERS, WORDS, counted

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LETTER = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms(text, pattern=WORD):
    return pattern.findall((text or "").translate(LOWER))


TEXTS = [
    "The cat sat on the mat", "the CAT, the cat; the dog", None, "", "Éa éa ÉA cat 42 42x", "the cat sat on the mat", "dog " * 50 + "mat", "the",
    "x" * 200_000 + " cat", "日本 cat\x00dog_mouse-cat", "... !!!",
]


def test_terms_are_those_of_the_pattern():
    rng = np.random.default_rng(1)
    texts = [*TEXTS, *("".join(map(chr, rng.choice([32, 46, 48, 65, 97, 122, 0xE9, 0x4E2D, 0x1F600, 0, 10, 127, 95], n))) for n in range(40))]
    for table, pattern in ((WORDS, WORD), (LETTERS, LETTER)):
        who, term, times, names = counted(pa.array(texts, pa.string()).slice(1), table)
        got = {(int(w), names[int(t)].as_py().decode()): int(n) for w, t, n in zip(who, term, times, strict=True)}
        want = {(i, t): n for i, x in enumerate(texts[1:]) for t, n in Counter(terms(x, pattern)).items()}
        assert got == want
        assert names.to_pylist() == sorted(names.to_pylist())


def ranked(docs, items, k):
    held = [(d, Counter(terms(t))) for d, t in docs]
    full = [c for _, c in held if c]
    n, total = len(full), sum(sum(c.values()) for c in full)
    df = Counter(t for c in full for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c in held:
            s = 0
            for t, many in Counter(terms(text)).items():
                if t in c:
                    m = 75 + 25 * sum(c.values()) * n // total
                    s += many * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
            if s > 0:
                found.append((-s, math.inf if d is None else d, d))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard_bytes", [1, 300, 1 << 20])
def test_search_equals_brute_force(spark, shard_bytes):
    docs = [(None if i == 5 else i % 9, t, "clash") for i, t in enumerate(TEXTS)]
    items = [(1, "cat"), (2, "The the dog"), (3, None), (4, "nowhere"), (5, "É éa mat mouse"), (5, "dog")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, score string").repartition(3)
    asked = spark.createDataFrame([(*i, 0) for i in items], "item_id bigint, text string, rank int")
    for k, block in ((3, 1 << 20), (20, 8)):
        got = lexical.search(lexical.build(frame, shard_bytes=shard_bytes), asked, k=k, block_bytes=block)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted((tuple(r) for r in got.collect()), key=repr) == ranked([d[:2] for d in docs], items, k)


def test_search_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    asked = spark.createDataFrame([(1, "cat")], "item_id bigint, text string")
    assert lexical.search(lexical.build(none), asked).collect() == []
    some = lexical.build(spark.createDataFrame([(1, "cat")], "doc_id bigint, text string"))
    for items in (asked.limit(0), spark.createDataFrame([(1, None), (2, "")], "item_id bigint, text string")):
        assert lexical.search(some, items).collect() == []


def test_ties_beyond_the_last_rank_go_by_id():
    rng = np.random.default_rng(3)
    for _ in range(200):
        scores, ids = rng.integers(0, 4, 60), rng.permutation(60)
        want = sorted((-s, i) for s, i in zip(scores.tolist(), ids.tolist(), strict=True) if s)[:7]
        at = lexical.best(scores, ids, 7)
        assert [(-s, i) for s, i in zip(scores[at].tolist(), ids[at].tolist(), strict=True)] == want


def test_impacts_beyond_64_bits():
    lengths, times = np.array([1, 10**9]), np.array([1, 10**10])
    docs, total = 10**12, 10**15
    want = [10**9 * int(t) // (1000 * int(t) + 12 * (75 + 25 * int(n) * docs // total)) for n, t in zip(lengths, times, strict=True)]
    assert lexical.impacts(times, lengths, docs, total).tolist() == want


def audited(docs, least, k):
    docs = [(t or "", a or "", s or "") for t, a, s in docs]
    df, count, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for t, a, s in docs:
        groups[a].add(s)
        for x, n in Counter(terms(t, LETTER)).items():
            df[a][x] += 1
            count[a, s][x] += n
    out = []
    for a, sources in groups.items():
        kept = [x for x, n in df[a].items() if n >= least]
        whole = Counter()
        for s in sources:
            whole.update({x: count[a, s][x] for x in kept})
        p = lambda c: {x: 1 + 10**9 * (c[x] + 2) // (sum(c[y] for y in kept) + 2 * len(kept)) for x in kept}
        of, q = {s: p(count[a, s]) for s in sources}, p(whole)
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in sources:
            pairs = sorted((-sum(f(of[s][x], of[o][x]) for x in kept), o) for o in sources if o != s)
            best = sorted((-f(of[s][x], q[x]), x.encode()) for x in kept if count[a, s][x] and of[s][x] > q[x])[:k]
            out += [(a, s, "pair", o, -v, r) for r, (v, o) in enumerate(pairs, 1)]
            out += [(a, s, "term", x.decode(), -v, r) for r, (v, x) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize(("block_sources", "unit_rows", "least"), [(8, 1 << 15, 2), (1, 5, 2), (2, 3, 1), (3, 1000, 1000)])
def test_divergence_equals_brute_force(spark, block_sources, unit_rows, least):
    rng = np.random.default_rng(5)
    words = ["Ab", "ab", "éa", "c1d", "dog", "cat", "zz", "x"]
    docs = [(" ".join(rng.choice(words, rng.integers(0, 12))), str(rng.choice(["a", "b"])), f"s{rng.integers(0, 7)}", "clash") for _ in range(80)]
    docs += [(None, "a", None, "x"), ("dog dog", None, "s1", "x"), ("dog dog", None, "s1", "x"), ("", "c", "s1", "x"), ("cat", "c", "s2", "x"), ("!!", "d", "only", "x"), ("cat " * 40_000, "a", "s1", "x")]
    frame = spark.createDataFrame(docs, "text string, lang string, source string, value string").repartition(3)
    got = divergence.audit(frame, least_docs=least, block_sources=block_sources, unit_rows=unit_rows, k=3)
    assert sorted(tuple(r) for r in got.collect()) == [(*x[:5], x[5]) for x in audited([d[:3] for d in docs], least, 3)]
    assert divergence.audit(frame.limit(0)).collect() == []


def test_every_pair_of_blocks_meets_once(spark):
    for blocks in range(2, 9):
        met = Counter()
        for turn in range(blocks - 1 if blocks % 2 == 0 else blocks):
            rows = spark.range(blocks).select(F.col("id").cast("int").alias("a"), divergence.opponent(F.col("id").cast("int"), turn, blocks).alias("b")).collect()
            assert all(dict(map(tuple, rows)).get(b) == a for a, b in rows if b < blocks)
            met.update((a, b) for a, b in rows if b < a)
        assert met == Counter((a, b) for a in range(blocks) for b in range(a))


def test_shares_beyond_64_bits():
    count, total = np.array([[1, 10**11]]), np.array([[10**12]])
    assert divergence.shares(count, total).tolist() == [[1 + 10**9 * 3 // 10**12, 1 + 10**9 * (10**11 + 2) // 10**12]]


def area(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    for v in np.unique(s):
        rank[s == v] = rank[s == v].mean()
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def test_toxicity_on_held_out_rows(spark):
    """At sf0.1; some labels of 1 have no sign in their text at all, so the area is bounded by them."""
    sf = SF.replace("0.01", "0.1")
    out = op11_toxicity(spark, sf)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    rows = out.join(labels, "doc_id", "left").collect()
    assert len(rows) == 10_000 and all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    told = [r for r in rows if r["held_out"] and r["toxic"] is not None]
    y, s = np.array([r["toxic"] for r in told]), np.array([r["score"] for r in told])
    assert area(y, s) > 0.88
    caught = s >= 0.7
    assert y[caught].mean() > 0.97 and caught[y == 1].mean() > 0.75


def test_features_see_through_disguise():
    book = toxicity.Lexicon({"grok": 3.0, "floop": 2.0})
    names = {n: i for i, n in enumerate(toxicity.NAMES)}
    texts = ["you grok!!", "they gr0k", "a g.r.o.k", "GRROOOK", "g r o k", "clean text", "", "you are not one two three four five grok", "Floop, grok"]
    got = toxicity.features(pa.array(texts), book)
    column = lambda n: got[:, names[n]].round(6).tolist()
    assert [x > 0 for x in column("hidden")] == [False, True, True, True, True, False, False, False, False]
    assert [x > 0 for x in column("hits")] == [True] * 5 + [False, False, True, True]  # hidden ones too
    assert [x > 0 for x in column("near")] == [True] + [False] * 8
    assert column("strongest") == [3, 3, 3, 3, 3, 0, 0, 3, 3]
    assert column("capitals")[3] == 1 and column("exclamations")[0] == round(2 / len(texts[0]), 6)


def test_toxicity_in_odd_cases(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS * 4)] + [(None, "cat", "x"), (1, "cat", "x")], "doc_id bigint, text string, score string")
    for told in ([], [(0, 1)], [(0, 1), (1, 0), (2, 0), (2, 1), (None, 1), (3, None), (4, 7)], [(i, i % 2) for i in range(44)]):
        labels = spark.createDataFrame(told, "doc_id bigint, toxic int").withColumn("text", F.lit("clash"))
        rows = toxicity.score(docs, toxicity.train(docs, labels, trees=3)).collect()
        assert len(rows) == 46 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), labels.limit(0))).collect() == []


def test_a_shard_has_a_file_of_its_own(spark):
    docs = spark.createDataFrame([(i, f"cat dog w{i} " * 20) for i in range(60)], "doc_id bigint, text string").coalesce(1)
    shards, n = lexical.build(docs, shard_bytes=1000)
    files = shards.groupBy(F.input_file_name()).count()
    assert n == 60 and shards.count() > 10 and files.agg(F.max("count")).first()[0] == 1
