"""Token ids of a corpus in files of wavelet matrices, in ascending order of document ids.

One range exchange sorts the documents by doc_id, a hash of the text and the
place they were read from, so rows of one id have a stated order and even one
repeated row is dealt out. Each task encodes its range and writes a file when
`shard_tokens` ids are together. A file is written under a name of its attempt
and then moved to its final name, which depends on its place alone: a task that
is run again replaces it with the same bytes. What the tasks return is a line
for each file, and the ids before a file are those of earlier ranges (a sum for
each range) and those that its header states.

Files go to a folder under spark.checkpoint.dir and stay there; the folder must
be one that pyarrow can write to. A null or empty text has the end id alone.
Null ids come first; rows of one id each have their own line. An empty table
writes no file. Texts of any length are encoded whole, and a file holds whole
documents. Other columns play no part.
"""

from __future__ import annotations

import mmap
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, shared_dir, table, unused
from .tokens import encoder
from .wavelet import Shard, pack

#: The id after each document.
END = 2
#: Characters of text that are encoded at a time.
SLAB = 1 << 22


def folder_of(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri.replace("file:///", "file:/", 1).replace("file:/", "file:///", 1))


def put(folder: str, name: str, data: bytes) -> None:
    fs, path = folder_of(folder)
    fs.create_dir(path, recursive=True)
    own = f"{path}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as f:
        f.write(data)
    fs.move(own, f"{path}/{name}")


def opened(folder: str, name: str) -> Shard:
    """A file for queries: mapped where it is local, else read."""
    fs, path = folder_of(folder)
    if isinstance(fs, pyarrow.fs.LocalFileSystem):
        with open(f"{path}/{name}", "rb") as f:
            return Shard(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
    with fs.open_input_file(f"{path}/{name}") as f:
        return Shard(f.read())


def slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], list[str]]]:
    ids, texts, size = [], [], 0
    for b in batches:
        for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            ids.append(d)
            texts.append(t or "")
            size += len(texts[-1])
            if size >= SLAB or len(texts) >= 50_000:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def write(docs: DataFrame, tokenizer: str, end: int = END, shard_tokens: int = 1 << 22) -> tuple[DataFrame, str]:
    """Writes the files; returns a line for each (part, seq, name, documents, tokens, before) and their folder."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/phonyx/tokens-{uuid.uuid4().hex}"
    tie, place = unused(docs.columns, 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer), TaskContext.get().partitionId()
        held, names, sizes, total, before, seq = [], [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            name = f"part-{part:06d}-{seq:06d}.tokens"
            put(folder, name, pack(np.concatenate(held), np.concatenate(sizes), names, {"part": part, "seq": seq, "before": before}))
            return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "name": [name], "documents": [len(names)], "tokens": [total], "before": [before]})

        for ids, texts in slabs(batches):
            found, counts = encode.slab(texts)
            # The end id after each document.
            found, ends = np.insert(found, np.cumsum(counts), np.uint32(end)), np.cumsum(counts + 1)
            first = 0
            while first < len(ids):
                # As many documents as fill the file, at least one.
                room = shard_tokens - total + (ends[first - 1] if first else 0)
                last = min(len(ids), int(np.searchsorted(ends, room, "left")) + 1)
                a, z = (ends[first - 1] if first else 0), ends[last - 1]
                held.append(found[a:z])
                sizes.append(counts[first:last] + 1)
                names += ids[first:last]
                total, first = total + int(z - a), last
                if total >= shard_tokens:
                    yield flush()
                    held, names, sizes, before, total, seq = [], [], [], before + total, 0, seq + 1
        if names:
            yield flush()

    keys = ["doc_id", tie, place]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn(tie, F.xxhash64("text")).withColumn(place, F.monotonically_increasing_id())
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")
    files = ordered.mapInArrow(run, "part long, seq long, name string, documents long, tokens long, before long")
    return materialize(files, "tokenfiles"), folder


def read(files: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone; several files are read by a task one after another."""
    spark = files.sparkSession
    n = files.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                shard = opened(folder, name)
                ids = shard.ids().astype("<u4")
                crc = [zlib.crc32(ids[a:z]) for a, z in zip(shard.starts[:-1], shard.starts[1:])]
                where = [shard.header["part"]] * len(crc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(where, pa.int64()), pa.array(shard.doc_ids, pa.int64()), pa.array(shard.starts[:-1] + shard.header["before"], pa.int64()), pa.array(shard.lengths, pa.int64()), pa.array(crc, pa.int64())],
                    ["part", "doc_id", "start", "n_tokens", "ids_crc32"],
                )

    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each range of the exchange.
    ranges = files.groupBy("part").agg(F.sum("tokens").alias("tokens")).select("part", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("ahead"))
    tasks = max(1, min(n, 8 * spark.sparkContext.defaultParallelism))
    rows = files.select("name").repartition(tasks).mapInArrow(run, "part long, doc_id long, start long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(ranges), "part").select("doc_id", (F.col("start") + F.col("ahead")).alias("start"), "n_tokens", "ids_crc32")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read(*write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
