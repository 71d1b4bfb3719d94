"""Documents as token ids in files of range-coded blocks, and back.

Writing: documents are range-partitioned and sorted by doc_id (null first; ties
by a hash of the text), encoded with a public vocabulary, ended by an end id,
and written as segments. A segment is a run of whole documents of one task, at
least ``SEGMENT`` ids long unless the task ends, stored as one row of a Parquet
folder: its task and number in it, the doc_ids, the ids of each document as
lengths, and the ids in the blocks of ``range_coder``. The folder is written by
Spark, so it can be on any store that Spark writes to.

Reading: segments are decoded and checked (a wrong checksum is an error), and
cut into documents. The ids before a document are a running sum over segments:
first over tasks (one number each), then inside each task.

Edge cases: null and empty texts are the end id alone; repeated rows and null
or repeated doc_ids are kept row by row; an empty table gives an empty result;
a document of any length is in one segment.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordloom.durable import shared_folder
from recordloom.llm.common import crc_of, short_batches, text_bytes
from recordloom.llm.range_coder import BLOCK, decode_many, encode
from recordloom.llm.tokens import default_path, encoder

END_ID = 2
SEGMENT = 1024 * BLOCK
# Segments decoded in step; more only take memory.
TOGETHER = 1


def write_files(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, segment: int = SEGMENT) -> None:
    """Write ``doc_id`` and ``text`` of all rows to ``folder``."""
    path = path or default_path()
    spark = docs.sparkSession
    short_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        docs.select("doc_id", "text", F.xxhash64("text").alias("_hash"), F.monotonically_increasing_id().alias("_row"))
        .repartitionByRange(parts, "doc_id", "_hash", "_row")  # the row number splits repeated rows, however many
        .sortWithinPartitions("doc_id", "_hash", "_row")
        .select("doc_id", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw_of, end = encoder(path).raw, np.array([end_id], "<u4").tobytes()
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0
        doc_ids: list[pa.Array] = []

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), "<u4")
            own = pa.concat_arrays(doc_ids)
            columns = {
                "part": pa.array([part], pa.int32()),
                "number": pa.array([number], pa.int64()),
                "n_ids": pa.array([len(ids)], pa.int64()),
                "doc_ids": pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own),
                "lengths": pa.array([[len(raw) // 4 for raw in held]], pa.list_(pa.int64())),
                "payload": pa.array([encode(ids)], pa.binary()),
            }
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            before = 0
            found = raw_of(text_bytes(batch))
            for i, raw in enumerate(found):
                held.append(raw + end)
                size += len(raw) // 4 + 1
                if size >= segment:
                    doc_ids.append(batch.column("doc_id").slice(before, i + 1 - before))
                    yield flush()
                    number, size, before = number + 1, 0, i + 1
                    held.clear()
                    doc_ids.clear()
            doc_ids.append(batch.column("doc_id").slice(before))
        if held:
            yield flush()

    schema = f"part int, number long, n_ids long, doc_ids array<{kind}>, lengths array<long>, payload binary"
    ordered.mapInArrow(run, schema).write.parquet(folder)


def read_files(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document in ``folder``."""
    files = spark.read.parquet(folder)
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    heads = files.select("part", "number", "n_ids")
    by_part = heads.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each writing task
    inside = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    offsets = heads.join(by_part.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")), "part").select(
        "part", "number", (F.col("base") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).alias("before")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                rows = batch.slice(at, TOGETHER)
                decoded = decode_many([p.as_py() for p in rows.column("payload")])
                for i, ids in enumerate(decoded):
                    lengths = rows.column("lengths")[i].values.to_numpy()
                    starts = np.cumsum(lengths) - lengths
                    n = len(lengths)
                    own = [ids[a : a + k] for a, k in zip(starts.tolist(), lengths.tolist(), strict=True)]
                    columns = {
                        "doc_id": rows.column("doc_ids")[i].values,
                        "part": pa.array(np.repeat(rows.column("part")[i].as_py(), n), pa.int32()),
                        "number": pa.array(np.repeat(rows.column("number")[i].as_py(), n), pa.int64()),
                        "inside": pa.array(starts, pa.int64()),
                        "n_tokens": pa.array(lengths, pa.int64()),
                        "ids_crc32": pa.array([crc_of(x) for x in own], pa.int64()),
                    }
                    if with_ids:
                        columns["ids"] = pa.array([x.astype(np.int64) for x in own], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_pydict(columns)

    schema = f"doc_id {kind}, part int, number long, inside long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    found = files.select("part", "number", "doc_ids", "lengths", "payload").mapInArrow(run, schema)
    names = ["n_tokens", "ids_crc32"] + ["ids"] * with_ids
    return found.join(offsets, ["part", "number"]).select("doc_id", (F.col("before") + F.col("inside")).alias("start"), *names)


def round_trip(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write all documents to a new folder of the shared space and read it back."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/recordloom/token_files-{uuid.uuid4().hex}"
    write_files(docs, folder, path, end_id)
    return read_files(spark, folder)
