"""A frame that takes many small writes.

Writes are appended as runs with numbers and rewrite nothing. Keys are dealt into buckets; the stored rows of a bucket are
one generation. `compact` rewrites the buckets that runs have touched, and in them only touched keys are overlaid and
coalesced; all other generations stay as they are. A read overlays the runs since then on the keys they touch. The last
write wins: by the number of its run, then by `order` inside a run.

The names of generations and runs are the only state, a few hundred strings on the driver (at most `buckets` and the runs
since the last compaction); rows are in the shared folder.

Cases: null keys are a bucket's like any other; empty writes are runs without rows; repeated rows of a run are one row; a
read before any write is empty.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..sources.staging import shared_folder
from .frame import IntervalFrame


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


class RunFrame:
    def __init__(self, like: IntervalFrame, *, buckets: int = 64):
        """Empty, with the dimensions, values and keys of a frame."""
        self.like, self.buckets = like._with(like.df.limit(0)), buckets
        self.spark, self.keys = like.spark, list(like.keys)
        self.path = f"{shared_folder(like.spark)}/spanloom/runs-{uuid.uuid4().hex}"
        self.generations: dict[int, str] = {}  # bucket -> folder of the generation that holds it
        self.runs: list[str] = []
        self.number = 0
        self.schema = self.like.df.schema

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int") if self.keys else F.lit(0)

    def append(self, rows: IntervalFrame, *, order: Column | None = None) -> RunFrame:
        """Adds a run of writes; rows may overlap, order is a Column over the table they carry, by default their starts."""
        by = order if order is not None else F.struct(*[_col(d.lo).alias(f"o{k}") for k, d in enumerate(self.like.dims)])
        self.number += 1
        name = f"{self.path}/log/_run={self.number}"
        run = rows.df_full.select(*self.like.columns, by.alias("_by")).distinct()
        run.select(*self.like.columns, F.row_number().over(Window.partitionBy(*(self.keys or [F.lit(0)])).orderBy("_by")).cast("bigint").alias("_by"), self._bucket().alias("_bucket")).write.partitionBy("_bucket").parquet(name)
        self.runs.append(name)
        return self

    def _log(self) -> DataFrame | None:
        """All runs since the last compaction, one table."""
        schema = StructType([*self.schema.fields, StructField("_by", LongType()), StructField("_run", IntegerType()), StructField("_bucket", IntegerType())])
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/log").parquet(*self.runs) if self.runs else None

    def _stored(self, buckets: list[int] | None = None) -> DataFrame:
        named = {b: g for b, g in self.generations.items() if buckets is None or b in buckets}
        return self.spark.read.schema(self.schema).parquet(*[f"{g}/_bucket={b}" for b, g in named.items()]) if named else self.like.df

    def _overlaid(self, stored: DataFrame, log: DataFrame) -> DataFrame:
        """Stored rows with the log's writes: keys that the log doesn't name pass by."""
        named = log.select(*[_col(k).alias(f"_t_{k}") for k in self.keys]).distinct()
        on = reduce(lambda a, b: a & b, [_col(k).eqNullSafe(_col(f"_t_{k}")) for k in self.keys], F.lit(True))
        touched = stored.join(named, on, "left_semi") if self.keys else stored
        base, writes = self.like._with(touched), self.like._with(log).carrying(log)
        new = base.set_many(writes, order=F.struct("_run", "_by")).df
        return new if not self.keys else stored.join(named, on, "left_anti").unionByName(new)

    def frame(self) -> IntervalFrame:
        """What holds now."""
        log = self._log()
        return self.like._with(self._stored() if log is None else self._overlaid(self._stored(), log))

    def touched(self) -> list[int]:
        """Buckets that runs have touched since the last compaction."""
        log = self._log()
        return [] if log is None else sorted(r[0] for r in log.select("_bucket").distinct().collect())  # at most `buckets` numbers

    def compact(self) -> RunFrame:
        """Writes a new generation of the touched buckets; the others keep theirs."""
        buckets = self.touched()
        if buckets:
            name = f"{self.path}/generation-{self.number}"
            new = self._overlaid(self._stored(buckets), self._log()).withColumn("_bucket", self._bucket())
            new.repartition("_bucket").write.partitionBy("_bucket").parquet(name)
            written = {r[0] for r in self.spark.read.parquet(name).select("_bucket").distinct().collect()}
            self.generations = {b: g for b, g in self.generations.items() if b not in buckets} | {b: name for b in buckets if b in written}
        self.runs = []
        return self
