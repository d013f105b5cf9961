"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

A corpus is a folder of two tables written by Spark's own writers, so that commits survive lost executors:
`ranks` (one row: the ids by falling frequency) and `blocks` (binary files in the order of the documents).
A file is a run of blocks. A block is, little-endian:
  magic b"SLT1", uint32 documents, uint32 ids, uint32 data bytes,
  int64 doc_id x documents (the smallest int64 stands for null), uint32 ids x documents,
  one control byte for every four ids (two bits each, lowest first: data bytes less one),
  the data bytes (each id's rank, lowest byte first), then one line feed, which the writer puts between rows.
Decoding looks the lengths of four ids up in a table of 256 rows and gathers bytes, all in numpy.

Document ids are whole numbers (others are an error when cast). Cases: null texts count as empty and hold the end id alone; equal doc_ids stay in order of their text's checksum; null
doc_ids come first; an empty table gives no files and no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import new_path, partitions, slices, stage
from .tokens import at_once, encoder, tokenizer_path

MAGIC = b"SLT1"
_NULL = np.iinfo(np.int64).min
#: Data bytes of the four ids of each control byte.
LENGTHS = (((np.arange(256)[:, None] >> (2 * np.arange(4))) & 3) + 1).astype(np.uint8)


def pack_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of an array of ranks."""
    width = 2 if not len(ranks) or ranks.max() <= 0xFFFF else 4
    whole = ranks.astype(f"<u{width}").view(np.uint8).reshape(-1, width)
    has = np.ones(whole.shape, bool)
    code = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    for k in range(1, width):
        has[:, k] = ranks >= 1 << 8 * k
        code[: len(ranks)] += has[:, k]
    control = code[::4] | code[1::4] << 2 | code[2::4] << 4 | code[3::4] << 6
    return control.tobytes(), whole[has].tobytes()


def unpack_ranks(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The ranks again: lengths by table, then one gather for each byte place."""
    sizes = LENGTHS[control].ravel()[:n]
    first = np.cumsum(sizes, dtype=np.int64) - sizes
    out = data[first].astype(np.uint32)
    k, at = 1, np.flatnonzero(sizes > 1)
    while len(at):
        out[at] |= data[first[at] + k].astype(np.uint32) << np.uint32(8 * k)
        k += 1
        at = at[sizes[at] > k]
    return out


def block(doc_ids: list[int | None], ids: list[np.ndarray], rank_of: np.ndarray) -> bytes:
    sizes = np.array([len(x) for x in ids], "<u4")
    control, data = pack_ranks(rank_of[np.concatenate(ids)])
    head = np.array([len(ids), int(sizes.sum()), len(data)], "<u4").tobytes()
    names = np.array([_NULL if x is None else x for x in doc_ids], "<i8")
    return MAGIC + head + names.tobytes() + sizes.tobytes() + control + data


def blocks_of(content: memoryview, id_of: np.ndarray):
    """(doc_ids, sizes, ids) of each block of a file."""
    at = 0
    while at < len(content):
        if bytes(content[at : at + 4]) != MAGIC:
            raise ValueError(f"no block at byte {at}")
        docs, n, size = (int(x) for x in np.frombuffer(content, "<u4", 3, at + 4))
        at += 16
        names = np.frombuffer(content, "<i8", docs, at)
        sizes = np.frombuffer(content, "<u4", docs, at + 8 * docs)
        at += 12 * docs
        control = np.frombuffer(content, np.uint8, -(-n // 4), at)
        data = np.frombuffer(content, np.uint8, size, at + len(control))
        yield names, sizes, id_of[unpack_ranks(control, data, n)]
        at += len(control) + size + 1


def tokenised(docs: DataFrame, *, end_id: int = 2, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, n, ids binary): 16-bit ids if they all fit (as their length then says), each with the end id. Each task adds a last row without n: how often each id occurred in it, as 64-bit numbers."""

    def run(batches):
        enc = encoder(tokenizer_path(tokenizer))
        end = np.array([end_id], "<u4")
        total = np.zeros(0, np.int64)
        for batch in batches:
            for part in slices(batch, 1, at_once()):
                found = [np.concatenate((x, end)) for x in enc.encode(part.column(1))]
                got = np.bincount(np.concatenate(found), minlength=len(total))
                got[: len(total)] += total
                total = got
                n = pa.array([len(x) for x in found], pa.int32())
                data = [(x.astype("<u2") if x.max() <= 0xFFFF else x).tobytes() for x in found]
                yield pa.RecordBatch.from_arrays([part.column(0), n, pa.array(data, pa.binary())], names=["doc_id", "n", "ids"])
        if len(total):
            last = [pa.array([None], pa.int64()), pa.array([None], pa.int32()), pa.array([total.astype("<i8").tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(last, names=["doc_id", "n", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n int, ids binary")


def _ids(n: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4").astype(np.uint32)


def count_ids(counts: DataFrame) -> DataFrame:
    """(id, n): how often each id occurs, from the tasks' own counts; a task adds up what it reads, so no more rows than ids leave it."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                got = np.frombuffer(data, "<i8")
                if len(got) < len(total):
                    got, total = total, got
                total, less = got.copy(), total
                total[: len(less)] += less
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["id", "n"])

    return counts.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write(docs: DataFrame, path: str, *, end_id: int = 2, tokenizer: str | None = None, block_ids: int = 1 << 18, file_bytes: int = 64 << 20) -> None:
    """Writes documents in ascending doc_id order, one file a range of ids (and checksums, where an id repeats) of some `file_bytes` at most. The ranks hold at most one entry for each id of the vocabulary, so they are broadcast."""
    spark = docs.sparkSession
    staged = stage(tokenised(docs, end_id=end_id, tokenizer=tokenizer), "tokens")
    tokens = staged.filter("n is not null")
    counted = count_ids(staged.filter("n is null")).collect()  # bounded by the vocabulary
    order = np.array([r[0] for r in sorted(counted, key=lambda r: (-r[1], r[0]))], "<u4")
    rank_of = np.zeros(int(order.max()) + 1 if len(order) else 1, np.uint32)
    rank_of[order] = np.arange(len(order))
    shared = spark.sparkContext.broadcast(rank_of)
    spark.createDataFrame([(bytearray(order.tobytes()),)], "ranks binary").write.parquet(f"{path}/ranks")

    def run(batches):
        names: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for doc, n, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                names.append(doc)
                held.append(_ids(n, data))
                size += n
                if size >= block_ids:
                    yield _rows(block(names, held, shared.value))
                    names, held, size = [], [], 0
        if held:
            yield _rows(block(names, held, shared.value))

    n = max(partitions(spark), -(-2 * sum(r[1] for r in counted) // file_bytes))  # files are read whole
    ranged = tokens.withColumn("_c", F.crc32("ids")).repartitionByRange(n, "doc_id", "_c").sortWithinPartitions("doc_id", "_c").drop("_c")
    ranged.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\n").text(f"{path}/blocks")


def _rows(value: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([value], pa.binary())], names=["value"])


def read(spark: SparkSession, path: str, *, with_ids: bool = True) -> DataFrame:
    """(file, seq, doc_id, n_tokens, ids_crc32, ids binary) of every document, decoded from the files."""
    ranks = spark.read.parquet(f"{path}/ranks").collect()  # one row, bounded by the vocabulary
    shared = spark.sparkContext.broadcast(np.frombuffer(bytes(ranks[0][0]), "<u4"))
    schema = "file string, seq long, doc_id long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                seq = 0
                for docs, sizes, ids in blocks_of(memoryview(content.as_buffer()), shared.value):
                    ids = ids.astype("<u4")
                    ends = np.cumsum(sizes.astype(np.int64))
                    data = [ids[b - a : b].tobytes() for a, b in zip(sizes.tolist(), ends.tolist(), strict=True)]
                    k = len(docs)
                    cols = [
                        pa.array([name] * k), pa.array(np.arange(seq, seq + k)), pa.array([None if x == _NULL else x for x in docs.tolist()], pa.int64()),
                        pa.array(sizes.astype(np.int64)), pa.array([zlib.crc32(x) for x in data], pa.int64()),
                    ]
                    if with_ids:
                        cols.append(pa.array(data, pa.binary()))
                    yield pa.RecordBatch.from_arrays(cols, names=["file", "seq", "doc_id", "n_tokens", "ids_crc32", "ids"][: len(cols)])
                    seq += k

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/blocks")
    return files.select("path", "content").mapInArrow(run, schema)


def with_starts(rows: DataFrame) -> DataFrame:
    """Adds start: ids of all documents before. Sums are taken within files; across files one row a file is summed up."""
    tokens = stage(rows, "token-rows")
    files = tokens.groupBy("file").agg(F.sum("n_tokens").alias("_n"))
    number = F.regexp_extract("file", r"part-(\d+)", 1).cast("int")  # the writer numbers the ranges
    across = Window.orderBy(number, "file").rowsBetween(Window.unboundedPreceding, -1)
    bases = files.select("file", F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("file").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    local = tokens.withColumn("_start", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return local.join(bases, "file").withColumn("start", (F.col("_start") + F.col("_base")).cast("long")).drop("_start", "_base")


def round_trip(docs: DataFrame, *, end_id: int = 2, tokenizer: str | None = None) -> DataFrame:
    """Writes the files to the shared folder, reads them back, and tells of each document what was read."""
    path = new_path(docs.sparkSession, "token-files")
    write(docs, path, end_id=end_id, tokenizer=tokenizer)
    return with_starts(read(docs.sparkSession, path, with_ids=False))
