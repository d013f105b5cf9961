"""Work and memory of large tables: keys are counted in many tasks, long plans are staged, small keys share a call, tables marked small aren't dealt in bins."""

import numpy as np
from pyspark.sql import functions as F

from spanloom.functions.cuts import Dim, Open
from spanloom.operators import frame, meeting, tiles
from spanloom.operators.frame import IntervalFrame

N = Dim("n")


def _plain(spark):
    rows = spark.range(60).select((F.col("id") % 3).alias("k"), F.col("id").alias("a"), (F.col("id") + 2).alias("b"), F.lit("x").alias("value"))
    return IntervalFrame.from_df(rows, {N: (F.col("a"), Open(F.col("b")))}, keys=["k"])


def _staged(monkeypatch):
    from spanloom.sources import staging

    names, real = [], staging.stage
    monkeypatch.setattr(staging, "stage", lambda df, label: names.append(label) or real(df, label))
    return names


def test_chains_of_coalescing_are_staged(spark, monkeypatch):
    """each coalesce is a few sorts, and a task holds memory for every one of its stage."""
    names, f = _staged(monkeypatch), _plain(spark)
    for _ in range(6):
        f = f.map_values(value=F.upper("value"))
    assert "cells" in names
    assert f.df.select("k").distinct().count() == 3


def test_boxes_of_other_groups_stay_apart(spark):
    """groups that share a call aren't joined, however their boxes lie."""
    spans = [(np.array([0, 1, 0, 1]), np.array([2, 3, 2, 3]))] * 2
    assert len(set(tiles.parts(spans, np.array([7, 7, 8, 8])).tolist())) == 2
    assert len(set(tiles.parts(spans).tolist())) == 1


def test_tables_marked_small_are_not_dealt(spark, monkeypatch):
    """rates of a few rows meet rows of any number where they are."""
    f = _plain(spark).on_keys(skewed=True)
    g = IntervalFrame(F.broadcast(f.df.limit(9)), f.dims, f.values, f.keys)
    monkeypatch.setattr(meeting, "HOT_ROWS", 4)
    assert "_l_bin" not in f.zip(g).df._jdf.queryExecution().analyzed().toString()
    assert "_l_bin" in f.zip(f).df._jdf.queryExecution().analyzed().toString()


def test_keys_are_counted_in_many_tasks(spark, monkeypatch):
    """the counts of many keys of few rows aren't one table of a task."""
    f, asked = _plain(spark), []
    monkeypatch.setattr(meeting, "together", lambda rows, keys: asked.append(list(keys)) or rows)
    assert meeting.counted(["k"], N, [(f.df, N.lo, N.hi)], most=320, skewed=True) is meeting.CALM
    assert asked == [["_h_k"]]


def test_cuts_of_a_key_are_ordered_once(spark):
    """No row puts its key's cuts in order for itself."""
    f = _plain(spark)
    plan = f.atoms().df._jdf.queryExecution().analyzed().toString()
    assert "Window" not in plan and plan.count("sort_array") == 1
    got = {tuple(r) for r in f.atoms().df.select("k", "n_lo", "n_hi").collect()}
    assert all(b - a in (1, 2) for _, a, b in got) and frame._gridded is not None
