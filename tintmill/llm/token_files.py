"""Token ids as binary files of range-coded blocks.

Documents are dealt by ranges of doc_id; each task encodes its documents in order and writes files of
about FILE ids. A file is a run of sections, each a list of the documents that end in it (how many ids
in after the section's start, and doc_id) and one block of `range_coder`, reset and checked on its own. A
file ends where a document ends, so every file is read without any other. What the driver sees of them
is their number; the ids before each file are a prefix sum in two levels.

Files are written beside their place and then renamed, and a task that is run again writes the same
files, so a lost executor leaves nothing half done. Places are URIs that pyarrow's file systems know.

Defined cases: null or empty text is the end id alone; rows without a doc_id come first; rows that share
a doc_id are ordered by a hash of their text, repeated rows stand side by side, and each counts; a third of all rows
may share doc_id and text, since row numbers part them; a very long text is encoded piece by piece and
its ids fill as many blocks of its file as they need; other columns are not read; no rows, no files.
"""

from __future__ import annotations

import gc
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tintmill.llm import range_coder
from tintmill.llm.shared import documents, settle, shared_place, slices, slots, texts_of

VOCABULARY, END = "word_bpe_49k", 2
#: Ids after which a file is closed at the next end of a document; bytes of text dealt to a task.
FILE, TASK = 2 * range_coder.BLOCK, 128 << 20
#: Pieces of text in a generation of those that a task remembers, none of more than WORD bytes.
REMEMBERED, WORD = 1 << 20, 64
RUN = 1 << 10
#: Before each block: magic, packed bytes, documents that end in the section, crc32 of the packed list.
SECTION = struct.Struct("<4sIII")
MAGIC = b"DOCS"
_coders: dict = {}


#: Bytes that are ASCII letters: 1; marks and digits that end a run of them: 2. White space, the apostrophe (it
#: begins contractions) and all that is beyond ASCII: 0.
_KIND = bytes(0 if c >= 128 or c == 39 or chr(c).isspace() else 1 if chr(c).isalpha() else 2 for c in range(256))


#: How byte-level vocabularies spell bytes: printing ones of Latin-1 as they are, all others in order from U+0100.
_PRINTS = {*range(33, 127), *range(161, 173), *range(174, 256)}
_LETTERS = dict(zip((b for b in range(256) if b not in _PRINTS), range(256, 512)))
_PLAIN = re.compile("[a-z\xdf-\xf6\xf8-\xff]+").fullmatch


class Words(dict):
    """Ids of texts by the tokenizers library. This tokenizer lower-cases, drops white space and joins
    neither across it nor from an ASCII letter to an ASCII mark or digit, so a text's ids are those of its
    pieces between these places, in order. Pieces that come often are looked up here; those remembered are in
    two generations, of which the older one is let go. Lower-case letters of Latin-1 alone are one pre-token
    that no normaliser changes, so they go straight to the library's model; all other pieces go through the
    tokenizer, and a text that spells a special token is encoded whole."""

    def __init__(self, name: str):
        super().__init__()
        import public_tokenizers
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        self.size = self.coder.get_vocab_size()
        self.special = [t.content.encode() for t in self.coder.get_added_tokens_decoder().values()]
        self.model = self.coder.model
        self.older: dict[bytes, bytes] = {}

    def __missing__(self, piece: bytes) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            text = piece.decode()
            if _PLAIN(text):
                own = [t.id for t in self.model.tokenize(text if text.isascii() else piece.decode("latin-1").translate(_LETTERS))]
            else:
                own = self.coder.encode(text, add_special_tokens=False).ids
            ids = array("H", own).tobytes()
        if len(piece) <= WORD:
            self[piece] = ids
        return ids

    def pieces(self, text: str) -> list[bytes]:
        raw = text.encode()
        if any(x in raw for x in self.special):
            return [raw]
        raw = raw.lower()  # of bytes: A to Z only
        kind = raw.translate(_KIND)
        if 2 in kind:
            kind = np.frombuffer(kind, np.uint8)
            ends = [0, *(np.flatnonzero((kind[1:] ^ kind[:-1]) == 3) + 1).tolist(), len(raw)]
            raw = b" ".join([raw[a:b] for a, b in zip(ends, ends[1:])])
        return raw.split()  # at space and 09..0D only

    def ids(self, text: str) -> np.ndarray:
        if len(self) > REMEMBERED:
            self.older = dict(self)
            self.clear()
        return np.frombuffer(b"".join(map(self.__getitem__, self.pieces(text))), np.uint16)


def words_of(name: str = VOCABULARY) -> Words:
    """Made once in each Python worker."""
    if name not in _coders:
        _coders[name] = Words(name)
    return _coders[name]


def _place(path: str):
    """File system and name of a URI."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _section(ids: np.ndarray, ends: list[int], doc_ids: list, size: int) -> bytes:
    """The documents that end in ids (where, and their doc_ids) and ids as a block."""
    own = np.array([x or 0 for x in doc_ids], "<i8").tobytes() + np.array([x is None for x in doc_ids], np.uint8).tobytes()
    packed = zlib.compress(np.array(ends, "<u4").tobytes() + own)
    return SECTION.pack(MAGIC, len(packed), len(ends), zlib.crc32(packed)) + packed + range_coder.encode(ids, size)


def sections(read) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
    """(ids, ends, doc_ids) of each section; read(n) gives up to n bytes of a file."""
    while head := read(SECTION.size):
        if len(head) < SECTION.size or head[:4] != MAGIC:
            raise ValueError("no section begins here")
        _, size, n, crc = SECTION.unpack(head)
        packed = read(size)
        if zlib.crc32(packed) != crc:
            raise ValueError("a list of documents is damaged")
        raw = zlib.decompress(packed)
        doc_ids = np.frombuffer(raw, "<i8", n, 4 * n).tolist()
        none = np.frombuffer(raw, np.uint8, n, 12 * n)
        ids = range_coder.decode(read)
        if ids is None:
            raise ValueError("a file ends early")
        yield ids, np.frombuffer(raw, "<u4", n).astype(np.int64), [None if x else d for d, x in zip(doc_ids, none)]


class _Writer:
    """One file: ids come in, full blocks go out; `close` gives its row of the manifest."""

    def __init__(self, folder: str, part: int, number: int, size: int):
        self.part, self.number, self.size = part, number, size
        self.path = f"{folder}/part-{part:06d}-{number:06d}.ids"
        self.store, self.name = _place(self.path)
        self.beside = f"{self.name}.{uuid.uuid4().hex}"
        self.store.create_dir(os.path.dirname(self.name), recursive=True)
        self.out = self.store.open_output_stream(self.beside, compression=None)
        self.ids, self.have, self.ends, self.doc_ids = [], 0, [], []
        self.total = self.documents = self.bytes = 0

    def add(self, ids: np.ndarray, doc_id) -> None:
        """The next document, its end id last."""
        self.ids.append(ids)
        self.have += len(ids)
        self.total += len(ids)
        while self.have > range_coder.BLOCK:
            self._block(range_coder.BLOCK)
        self.ends.append(self.have)
        self.doc_ids.append(doc_id)
        self.documents += 1

    def _block(self, n: int) -> None:
        flat = np.concatenate(self.ids)
        raw = _section(flat[:n], self.ends, self.doc_ids, self.size)
        self.out.write(raw)
        self.bytes += len(raw)
        self.ids, self.have, self.ends, self.doc_ids = [flat[n:]], len(flat) - n, [], []

    def close(self) -> pa.RecordBatch:
        if self.have:
            self._block(self.have)
        self.out.close()
        self.store.move(self.beside, self.name)
        return pa.record_batch({"part": [self.part], "number": [self.number], "path": [self.path], "n_ids": [self.total], "n_documents": [self.documents], "n_bytes": [self.bytes]})


def _written(batches, folder: str, vocabulary: str, end: int) -> Iterator[pa.RecordBatch]:
    """Files of the partition's rows. Nothing here makes cycles of objects, so their collector, which would
    look through all that is remembered again and again, rests meanwhile."""
    gc.disable()
    try:
        yield from _files(batches, folder, vocabulary, end)
    finally:
        gc.enable()


def _files(batches, folder: str, vocabulary: str, end: int) -> Iterator[pa.RecordBatch]:
    words, part, number, file = words_of(vocabulary), TaskContext.get().partitionId(), 0, None
    for batch in batches:
        for own in slices([batch]):
            for doc_id, text in zip(own.column(0).to_pylist(), texts_of(own)):
                file = file or _Writer(folder, part, number, words.size)
                file.add(np.append(words.ids(text), np.uint16(end)), doc_id)
                if file.total >= FILE:
                    yield file.close()
                    file, number = None, number + 1
    if file:
        yield file.close()


def write_files(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, end: int = END) -> DataFrame:
    """Write docs (doc_id, a whole number, and text) in ascending doc_id order to files in folder.
    Returns the manifest, a row for each file: part, number (its order), path, n_ids, n_documents, n_bytes."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(slots(docs.sparkSession), -(-size // TASK))
    keys = [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("own"), F.monotonically_increasing_id().alias("row")]
    dealt = docs.select(*keys, "text").repartitionByRange(parts, "doc_id", "own", "row").sortWithinPartitions("doc_id", "own", "row")
    schema = "part long, number long, path string, n_ids long, n_documents long, n_bytes long"
    return settle(dealt.select("doc_id", "text").mapInArrow(lambda it: _written(it, folder, vocabulary, end), schema), "token-manifest")


def placed(manifest: DataFrame) -> DataFrame:
    """The manifest with `before`, the ids in all files before each."""
    run = F.expr(f"part div {RUN}")
    within = Window.partitionBy("run").orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)  # a row for RUN tasks
    files = manifest.withColumn("run", run).withColumn("in_run", F.coalesce(F.sum("n_ids").over(within), F.lit(0)))
    runs = files.groupBy("run").agg(F.sum("n_ids").alias("run_ids")).withColumn("ahead", F.coalesce(F.sum("run_ids").over(over), F.lit(0)))
    return files.join(runs, "run").withColumn("before", F.col("in_run") + F.col("ahead")).select(*manifest.columns, "before")


def read_files(files: DataFrame, number: int | None = None) -> DataFrame:
    """The documents of files (path, and before if there is one), read back: doc_id, start (ids before
    it: before + those in its file), n_tokens (with the end id), ids_crc32, path. A task holds one block."""
    columns = ["path", F.col("before") if "before" in files.columns else F.lit(0).cast("long")]
    kind = "doc_id long, start long, n_tokens long, ids_crc32 long, path string"

    def read(batches):
        for batch in batches:
            for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, name = _place(path)
                with store.open_input_stream(name, compression=None) as own:
                    crc, begun = 0, 0  # of the document that goes on; ids of it in earlier sections
                    for ids, ends, doc_ids in sections(own.read):
                        raw = memoryview(ids.astype("<u4").tobytes())
                        sums, starts, sizes, at = [], [], [], 0
                        for to in ends.tolist():
                            sums.append(zlib.crc32(raw[4 * at:4 * to], crc))
                            starts.append(before + at - begun)
                            sizes.append(to - at + begun)
                            at, crc, begun = to, 0, 0
                        crc, begun = zlib.crc32(raw[4 * at:], crc), begun + len(ids) - at
                        before += len(ids)
                        values = [pa.array(x, pa.int64()) for x in (doc_ids, starts, sizes, sums)]
                        yield pa.record_batch([*values, pa.array([path] * len(sums), pa.string())], ["doc_id", "start", "n_tokens", "ids_crc32", "path"])

    number = number or files.count()
    return files.select(*columns).repartition(max(1, number)).mapInArrow(read, kind)


def op11_mixed_range_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_files(documents(spark, sf_dir), shared_place(spark, "token-files"))
    return read_files(placed(manifest), manifest.count())
