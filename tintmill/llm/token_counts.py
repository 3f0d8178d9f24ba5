"""Token counts by a separator scan over flat, unindexed token files.

A token file is nothing but ids one after the other, each document ended by an end-of-document id.
Files are held as blocks of a fixed number of ids (`token_blocks` cuts raw files into them,
`write_tokens` writes documents that way; a document may span many blocks). Each block is searched
for separators at once (vectorised), and block boundaries are stitched by a prefix scan in two
levels: within runs of RUN blocks, and over the runs of a file. No task holds more than a run of
block summaries, however long a file is.

Defined cases: null or empty text is a document of 0 tokens; ids after the last separator of a file
are a document with terminated = false; a file without ids has no documents, one that ends inside an
id is an error; repeated documents are counted each; a very long text is encoded whole and its ids
span as many blocks as they need; null doc_id is carried as null; other columns are not read; no
files, no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tintmill.llm.shared import byte_bpe, documents, settle, slices, texts_of

END = 50256
BLOCK = 1 << 16
RUN = 1 << 10


def _flat(batches, vocabulary: str, end: int) -> Iterator[pa.RecordBatch]:
    """The partition's documents as one flat run of ids, cut into blocks. ends: the doc_ids whose
    separators lie in the block, in order; the scan does not use them to find anything."""
    encode = byte_bpe(vocabulary)
    file, block = TaskContext.get().partitionId(), 0
    ids, have, ends = [], 0, []
    kind = None

    def rows(last: bool):
        nonlocal ids, have, ends, block
        flat = np.concatenate(ids) if ids else np.zeros(0, "<u2")
        take = len(flat) if last else len(flat) // BLOCK * BLOCK
        spots = np.flatnonzero(flat == end)
        out, done = [], 0
        for at in range(0, take, BLOCK):
            n = int(np.searchsorted(spots, min(at + BLOCK, take)))
            out.append((file, block, flat[at:min(at + BLOCK, take)].tobytes(), ends[done:n]))
            done, block = n, block + 1
        ids, have, ends = [flat[take:]], len(flat) - take, ends[done:]
        return pa.record_batch({"file": pa.array([r[0] for r in out], pa.int64()), "block": pa.array([r[1] for r in out], pa.int64()), "ids": pa.array([r[2] for r in out], pa.binary()), "ends": pa.array([r[3] for r in out], pa.list_(kind))})

    for batch in batches:
        kind = batch.column(0).type
        for part in slices([batch]):
            for doc_id, text in zip(part.column(0).to_pylist(), texts_of(part)):
                own = np.array([*encode(text), end], dtype="<u2")
                ids.append(own)
                ends.append(doc_id)
                have += len(own)
                if have >= 16 * BLOCK:
                    yield rows(False)
    if have:
        yield rows(True)


def write_tokens(docs: DataFrame, vocabulary: str = "byte_bpe_50k", end: int = END) -> DataFrame:
    """Documents as blocks of flat token files: file, block, ids (unsigned 16 bits, little-endian), ends."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return settle(docs.select("doc_id", "text").mapInArrow(lambda it: _flat(it, vocabulary, end), f"file long, block long, ids binary, ends array<{kind}>"), "tokens")


def _open(path: str):
    """A file for reading at any place, by its URI: of the folders that all nodes share, or of any
    other store that pyarrow knows."""
    from pyarrow import fs

    if path.startswith("file:"):
        return open("/" + path[5:].lstrip("/"), "rb")
    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def token_blocks(spark: SparkSession, path: str, width: int = 2, opener=_open) -> DataFrame:
    """Raw token files below path as blocks: file, block, ids. Spark lists the files; their byte ranges,
    a row for each run of RUN blocks, are dealt to tasks, which read one block at a time: so a file of
    any size is read by as many tasks as it has runs. `opener` opens a file for reading at a place."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    size = BLOCK * width
    wrong = F.raise_error(F.concat("path", F.lit(": no whole number of ids"))).cast("long")
    files = files.withColumn("length", F.when(F.col("length") % width == 0, F.col("length")).otherwise(wrong)).filter("length > 0")
    runs = files.select("path", "length", F.explode(F.expr(f"sequence(0L, (length - 1) div {size * RUN})")).alias("run")).repartition("path", "run")

    def read(batches):
        for batch in batches:
            for name, length, run in zip(*(batch.column(k).to_pylist() for k in range(3))):
                with opener(name) as own:
                    for block in range(run * RUN, min((run + 1) * RUN, -(-length // size))):
                        own.seek(block * size)
                        raw = own.read(min(size, length - block * size))
                        yield pa.record_batch({"file": [name], "block": pa.array([block], pa.int64()), "ids": pa.array([raw], pa.binary())})

    return runs.mapInArrow(read, "file string, block long, ids binary")


def separator_scan(blocks: DataFrame, end: int = END, width: int = 2, carried: str | None = None) -> DataFrame:
    """blocks (file, block, ids) to a row for each document: file, ordinal, start, n_tokens,
    terminated. carried names a column with one value for each separator of a block, in order."""

    def search(batches):
        for batch in batches:
            spots, sizes = [], []
            for raw in batch.column(2).to_pylist():
                ids = np.frombuffer(raw, dtype=f"<u{width}")
                spots.append(np.flatnonzero(ids == end).astype(np.int32))
                sizes.append(len(ids))
            offsets = np.cumsum([0, *map(len, spots)]).astype(np.int32)
            found = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(spots) if spots else np.zeros(0, np.int32)))
            own = {"carried": batch.column(3)} if carried else {}
            yield pa.record_batch({"file": batch.column(0), "block": batch.column(1), "n_ids": pa.array(sizes, pa.int64()), "found": found, **own})

    kinds = dict(blocks.dtypes)
    columns = ["file", "block", "ids", *([carried] if carried else [])]
    schema = f"file {kinds['file']}, block long, n_ids long, found array<int>" + (f", carried {kinds[carried]}" if carried else "")
    table = blocks.select(*columns).mapInArrow(search, schema).withColumn("run", F.expr(f"block div {RUN}"))
    # Level 1: ids, documents and the last separator before each block, counted from its run's start.
    ahead = Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    n = F.size("found")
    table = table.withColumn("start", F.coalesce(F.sum("n_ids").over(ahead), F.lit(0)))
    table = table.withColumn("last", F.when(n > 0, F.col("start") + F.element_at("found", -1)))
    table = table.withColumns({"docs": F.coalesce(F.sum(n).over(ahead), F.lit(0)), "previous": F.max("last").over(ahead)})
    # Level 2: the same over the runs of a file; a run is one row.
    runs = table.groupBy("file", "run").agg(F.sum("n_ids").alias("run_ids"), F.sum(n).alias("run_docs"), F.max("last").alias("run_last"))
    over = Window.partitionBy("file").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("run_start", F.coalesce(F.sum("run_ids").over(over), F.lit(0)))
    runs = runs.withColumns({"docs_before": F.coalesce(F.sum("run_docs").over(over), F.lit(0)), "last_before": F.max(F.col("run_start") + F.col("run_last")).over(over)})
    runs = runs.withColumn("last_here", F.greatest("last_before", F.col("run_start") + F.col("run_last")))
    table = table.join(runs.select("file", "run", "run_start", "docs_before", "last_before"), ["file", "run"])
    before = F.coalesce(F.col("run_start") + F.col("previous"), F.col("last_before"), F.lit(-1))
    out = table.withColumn("before", before).filter(n > 0)
    values = F.arrays_zip("found", "carried") if carried else F.arrays_zip("found")
    if carried:
        out = out.withColumn("found", F.when(n == F.size("carried"), F.col("found")).otherwise(F.raise_error(F.lit("carried values and separators differ in number")).cast("array<int>")))
    base = F.col("run_start") + F.col("start")
    out = out.select("file", "before", base.alias("base"), (F.col("docs_before") + F.col("docs")).alias("ordinal0"), "found", F.posexplode(values).alias("at", "hit"))
    from_id = F.when(F.col("at") > 0, F.col("base") + F.get("found", F.col("at") - 1)).otherwise(F.col("before")) + 1
    own = [F.col("hit.carried").alias(carried)] if carried else []
    done = out.select("file", (F.col("ordinal0") + F.col("at")).alias("ordinal"), from_id.alias("start"), (F.col("base") + F.col("hit.found") - from_id).alias("n_tokens"), F.lit(True).alias("terminated"), *own)
    files = runs.groupBy("file").agg(F.sum("run_ids").alias("ids"), F.sum("run_docs").alias("docs"), F.coalesce(F.max("last_here"), F.lit(-1)).alias("last"))
    none = [F.lit(None).cast(done.schema[carried].dataType).alias(carried)] if carried else []
    rest = files.filter("last + 1 < ids").select("file", F.col("docs").alias("ordinal"), (F.col("last") + 1).alias("start"), (F.col("ids") - F.col("last") - 1).alias("n_tokens"), F.lit(False).alias("terminated"), *none)
    return done.unionByName(rest)


def op4_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = separator_scan(write_tokens(documents(spark, sf_dir)), carried="ends")
    return counted.select(F.col("ends").alias("doc_id"), "n_tokens", "file", "ordinal", "start", "terminated")
