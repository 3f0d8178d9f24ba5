"""Helpers that several operators use: durable tables, tokenizer access, Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One run of what contracts call white space: space and U+0009..U+000D.
SPACE = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.
    Only where a local session leaves it unset (as in tests) a folder of our own is set."""
    key = "spark.checkpoint.dir"
    where = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set(key, where)
    return where.rstrip("/")


#: Tables that this driver has settled and not deleted.
_made: list[str] = []


def shared_place(spark: SparkSession, tag: str) -> str:
    """A new place in the shared folder, which clear_settled deletes like a settled table."""
    path = f"{shared_dir(spark)}/settled/{tag}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def settle(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, so a lost executor
    costs no more than the stage that reads the table."""
    spark = df.sparkSession
    path = shared_place(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_settled(spark: SparkSession, keep: int = 0) -> None:
    """Delete the tables that this driver settled, but for the first `keep`; call it when no result
    that reads them is needed any more. Tables of other drivers in the folder stay."""
    for path in _made[keep:]:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    del _made[keep:]


def settle_stage(spark: SparkSession, make: Callable[[], DataFrame], tag: str) -> DataFrame:
    """The settled result of make(); the tables that make() settled on the way are deleted."""
    before = len(_made)
    table = settle(make(), tag)
    own = _made.pop()
    clear_settled(spark, before)
    _made.append(own)
    return table


def quoted(name: str) -> str:
    """A column's name as Spark reads it, whatever is in it."""
    return "`" + name.replace("`", "``") + "`"


def unused(df: DataFrame) -> str:
    """A beginning that no column of df has, for names of helper columns."""
    start = "__"
    while any(c.lower().startswith(start) for c in df.columns):
        start += "_"
    return start


def slots(spark: SparkSession) -> int:
    """Shuffle partitions of the session: how widely its owner wants data dealt."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def is_held_out(doc_id: str, modulus: int, remainder: int = 2):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % modulus == remainder


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], size: int = 4 << 20, name: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about `size` bytes of text (one row at least):
    what a task keeps in memory is bounded by that and the longest text."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(name))
        lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = 0
        ends = np.cumsum(lengths)
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + size, side="right")))
            yield batch.slice(at, to - at)
            at = to


#: A run of one kind of character as long as this goes through the `tokenizers` library.
LONG_RUN = 2000
_LONG = re.compile(rf"\s{{{LONG_RUN}}}|\S{{{LONG_RUN}}}")
_encoders: dict = {}


def byte_bpe(name: str = "byte_bpe_50k"):
    """encode(text) -> ids of the named public vocabulary, made once in each Python worker.
    The ids are those of the `tokenizers` library and its .json file, with special tokens as ordinary
    text. Ordinary texts go through the .tiktoken form of the same vocabulary, whose ids are equal
    (tests hold the two against each other) and take a third of the time; its matcher overflows on
    runs of a million spaces, so a text with a run of LONG_RUN white-space or other characters goes
    through `tokenizers` itself."""
    if name not in _encoders:
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        quick = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        whole = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        whole.encode_special_tokens = True

        def encode(text: str) -> list[int]:
            if len(text) >= LONG_RUN and _LONG.search(text):
                return whole.encode(text, add_special_tokens=False).ids
            return quick(text)

        _encoders[name] = encode
    return _encoders[name]
