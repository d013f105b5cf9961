"""Pairs of near copies: as many as rows, not as rows squared, and no link lost."""

import random

import numpy as np

from spanloom.llm import shared, similar, simhash
from spanloom.llm.shared import ship


def test_pairs_of_a_large_group_grow_with_its_rows(spark, monkeypatch):
    r = random.Random(3)
    word = lambda: "".join(r.choices("abcdefghij", k=6))
    base = [word() for _ in range(120)]
    rows = [(k, " ".join([*base[: k % 120], word(), *base[k % 120 + 1 :]])) for k in range(300)]
    counts, write = {}, similar.stage

    def counted(df, label):
        out = write(df, label)
        counts[label] = counts.get(label, 0) + out.count()
        return out

    monkeypatch.setattr(similar, "stage", counted)
    ship(spark)
    got = similar.near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {x.component_id for x in got.collect()} == {0}
    assert counts["near-candidates"] <= 2 * len(rows)


def test_trees_span_what_all_pairs_join():
    r = np.random.default_rng(4)
    rows = 400
    group = np.sort(r.integers(0, 6, rows))
    n = r.integers(80, 120, rows)
    at = np.lexsort((n, group))
    n = n[at]
    key, pos, label = r.permutation(rows), r.integers(0, 10, rows), r.integers(0, 150, rows)
    bits = [similar.sketch(similar.parities(np.unique(r.integers(0, 1 << 62, 9) + 7)), 100) for _ in range(rows)]
    words, size = np.concatenate([np.array(x, np.int64) for x in bits]), np.array([len(x) for x in bits])
    cols = (group, key, n, pos, label, words, size, 4, 5)
    every = [(a, b) for x in similar._every(*cols) for a, b in zip(*(c.to_pylist() for c in x.columns), strict=True)]

    def joined(pairs, alike):
        out = np.arange(rows)
        both = [*pairs, *alike]
        return simhash.forest(rows, np.array([a for a, _ in both]), np.array([b for _, b in both]), out)

    for most in (1 << 20, 50):  # in one go, and reduced on the way
        trees = [x for b in similar._trees(*cols, most=most) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        assert len(trees) < rows < len(every) and {x[:2] for x in trees} <= set(every)
        for g in range(6):
            inside = set(key[group == g].tolist())
            first: dict[int, int] = {}
            alike = [(k, first.setdefault(x, k)) for k, x in zip(key[group == g].tolist(), label[group == g].tolist(), strict=True)]
            mine = [x for x in trees if x[0] in inside]
            assert (joined([x[:2] for x in mine], alike) == joined([x for x in every if x[0] in inside], alike)).all()
            assert {x[2] for x in mine} == {g}  # there are other pairs, so they are asked if one of these fails


def test_bits_of_ids_stay_out_of_the_plans(spark):
    r = random.Random(5)
    words = [[r.choice("abcdefgh") + str(r.randrange(900)) for _ in range(60)] for _ in range(400)]
    rows = [(k, " ".join(w)) for k, w in enumerate(words)] + [(1000 + k, " ".join(["x", *w[1:]])) for k, w in enumerate(words)]
    ship(spark)
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    got = similar.near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {x.doc_id: x.component_id for x in got.collect()} == {i: i % 1000 for i, _ in rows}
    plans = [store.executionsList().apply(k).physicalPlanDescription() for k in range(before, store.executionsCount())]
    assert len(plans) > 10 and max(map(len, plans)) < 100_000


def test_filter_of_ids_keeps_the_wanted(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "cast(id as string) as text")
    wanted = docs.filter("doc_id % 7 = 0").select("doc_id")
    kept = [x.doc_id for x in similar._in_filter(docs, wanted).collect()]
    assert len(kept) == len(set(kept)) < 600 and set(range(0, 3000, 7)) <= set(kept)
    assert similar._in_filter(docs, wanted.limit(0)).count() == 0


def test_tidy_gives_grown_heap_back(spark):
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    much = runtime.maxMemory() // 2
    spark.range(1).selectExpr(f"octet_length(repeat(cast(id as string), {min(much, (1 << 31) - 64)}))").collect()
    grown = runtime.totalMemory()
    assert 2 * grown > runtime.maxMemory()
    shared.tidy(spark, every=0, share=1)
    assert runtime.totalMemory() < grown
