"""Interleaved document sequences with a media column.

`sequences` parses HTML into ordered items: text, and references to media by digest with their
captions; items keep their position. `resolve` joins references to a store of payloads by digest.
`store` makes such a store: each payload becomes an 8-bit grey PNG (WIDTH samples a row), once for
each task that meets it, and one form of each digest is kept; it is read back without loss.

The query interleaves each document: its text is cut into pieces of PIECE code points, its payload
(UTF-8, padded) into parts of PART bytes, and its page holds piece and figure in turn, each figure with
a caption that tells its bytes. The page is parsed; references are resolved by digest; the parts that
come back are put together by position, after their captions are held against their sizes, and digests
and features are computed from them. Pages that are equal are resolved once. So a document of several
parts has several ordered references, and no task holds more than one document's payload beside its own.

Defined cases: null text counts as empty (one row of padding, no text item); equal texts have equal
values; a very long text has many pieces and parts, which meet again in one row; pages that are null
or have no reference give text items or nothing; a reference without a payload stays, with null
values; repeated rows are resolved each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tintmill.llm.shared import documents, settle

UNIT, WIDTH = 576, 24
#: Bytes of a part of a payload, a multiple of UNIT; code points of a piece of text.
PART, PIECE = 64 * UNIT, 32_768
#: Digests that a task remembers as stored.
REMEMBERED = 1 << 16
#: The signature that begins every PNG file: a fixed value of the format.
PNG = b"\x89PNG\r\n\x1a\n"
SCHEME = "sha256:"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    """Samples, WIDTH a row, as a grey 8-bit PNG without row filters."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of a PNG that `to_png` wrote; checks signature, chunk sums and shape."""
    if media[:8] != PNG:
        raise ValueError("no PNG")
    at, shape, packed = 8, None, []
    while at < len(media):
        (size,) = struct.unpack(">I", media[at:at + 4])
        kind, body = media[at + 4:at + 8], media[at + 8:at + 8 + size]
        if struct.unpack(">I", media[at + 8 + size:at + 12 + size])[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk's sum is wrong")
        if kind == b"IHDR":
            shape = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        at += size + 12
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(shape[1], shape[0] + 1)
    if shape[2:] != (8, 0, 0, 0, 0) or lines[:, 0].any():
        raise ValueError("only 8-bit grey without row filters")
    return lines[:, 1:].tobytes()


def features(samples: bytes) -> str:
    """Mean, deviation and a histogram of eight bands, as text."""
    counts = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
    n, values = counts.sum(), np.arange(256)
    mean = (counts * values).sum() / n
    deviation = np.sqrt(max(0.0, (counts * values * values).sum() / n - mean * mean))
    return f"{mean:.4f} {deviation:.4f} " + ",".join(map(str, counts.reshape(8, 32).sum(axis=1).tolist()))


def payload(text):
    """UTF-8 bytes, and bytes 255 up to a positive multiple of UNIT; columns."""
    raw = F.coalesce(text, F.lit("")).cast("binary")
    size = F.octet_length(raw)
    missing = F.when(size == 0, UNIT).otherwise(F.pmod(-size, F.lit(UNIT)))
    return F.concat(raw, F.unhex(F.repeat(F.lit("FF"), missing.cast("int")))), size.cast("long")


def store(payloads: DataFrame) -> DataFrame:
    """payloads (digest, payload, repeats allowed) to a row for each digest: digest, media."""

    def encode(batches) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                new = []
                for k, digest in enumerate(part.column(0).to_pylist()):
                    if digest not in seen:
                        new.append(k)
                        seen.add(digest)
                if len(seen) > REMEMBERED:  # repeats after that are stored again, and meet below
                    seen = set()
                own = part.take(pa.array(new, pa.int64()))
                yield pa.record_batch({"digest": own.column(0), "media": pa.array([to_png(x) for x in own.column(1).to_pylist()], pa.binary())})

    encoded = payloads.select("digest", "payload").mapInArrow(encode, "digest string, media binary")
    return encoded.groupBy("digest").agg(F.first("media").alias("media"))


TOLD = {
    "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(),
    "feature": pa.string(), "n_media": pa.int64(), "positions": pa.string(), "captions": pa.string(),
}
TOLD_SQL = ", ".join(f"{name} {'long' if kind == pa.int64() else 'string'}" for name, kind in TOLD.items())


def _tell(items: list[dict]) -> tuple:
    """The media of a page in order of their positions, read back and put together, and what follows from that."""
    items = sorted(items, key=lambda x: x["position"])
    parts = [from_png(x["media"]) for x in items]
    at = 0
    for item, part in zip(items, parts):
        if item["caption"] != f"bytes {at} to {at + len(part)}":
            raise ValueError(f"{item['caption']!r} stands beside {len(part)} bytes from {at}")
        at += len(part)
    samples, media = b"".join(parts), b"".join(x["media"] for x in items)
    places, captions = (",".join(str(x[name]) for x in items) for name in ("position", "caption"))
    return at, hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(media), hashlib.sha256(media).hexdigest(), features(samples), len(items), places, captions


def described(found: DataFrame) -> DataFrame:
    """found (page, n: references of the page, position, caption, media) to a row for each page. A page's
    only reference is read where its digest met the store; only media of pages with several move on."""

    def alone(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told, media = [], []
            for k in range(batch.num_rows):
                item = {name: batch.column(name)[k].as_py() for name in ("position", "caption", "media")}
                single = batch.column("n")[k].as_py() == 1
                told.append(_tell([item]) if single else (None,) * len(TOLD))
                media.append(None if single else item["media"])
            own = [batch.column(name) for name in ("page", "position", "caption")] + [pa.array(media, pa.binary())]
            yield pa.record_batch(own + [pa.array([r[k] for r in told], kind) for k, kind in enumerate(TOLD.values())], ["page", "position", "caption", "media", *TOLD])

    def together(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                known = tuple(batch.column(name)[k].as_py() for name in TOLD)
                out.append(_tell(batch.column("items")[k].as_py()) if known[0] is None else known)
            yield pa.record_batch([batch.column("page"), *(pa.array([r[k] for r in out], kind) for k, kind in enumerate(TOLD.values()))], ["page", *TOLD])

    each = found.select("page", "n", "position", "caption", "media").mapInArrow(alone, f"page string, position long, caption string, media binary, {TOLD_SQL}")
    item = F.when(F.col("media").isNotNull(), F.struct("position", "caption", "media"))
    pages = each.groupBy("page").agg(F.collect_list(item).alias("items"), *[F.max(name).alias(name) for name in TOLD])
    return pages.select("page", "items", *TOLD).mapInArrow(together, f"page string, {TOLD_SQL}")


class _Items(HTMLParser):
    """Ordered items of a page: (kind, text, digest, caption). A figure's caption goes with its image."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items, self.words, self.caption, self.open, self.silent, self.exact = [], [], None, [], 0, False

    def flush(self):
        text = "".join(self.words)
        if not self.exact:
            text = " ".join(text.split())
        if text:
            self.items.append(["text", text, None, None])
        self.words = []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.silent += 1
        elif tag == "pre":  # what stands inside is kept as it is
            self.flush()
            self.exact = True
        elif tag == "figure":
            self.flush()
            self.open.append(len(self.items))
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in ("img", "video", "audio", "source"):
            own = dict(attrs)
            self.flush()
            self.items.append(["media", None, (own.get("src") or "").removeprefix(SCHEME), own.get("alt")])
        elif tag in ("p", "div", "li", "h1", "h2", "h3", "article", "section", "br", "td", "tr"):
            self.flush()

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.silent = max(0, self.silent - 1)
        elif tag == "pre":
            self.flush()
            self.exact = False
        elif tag == "figcaption" and self.caption is not None:
            caption = " ".join("".join(self.caption).split())
            for item in self.items[self.open[-1] if self.open else len(self.items):]:
                if item[0] == "media":
                    item[3] = caption
            self.caption = None
        elif tag == "figure" and self.open:
            self.open.pop()
        elif tag in ("p", "div", "li", "h1", "h2", "h3", "article", "section", "td", "tr"):
            self.flush()

    def handle_data(self, data):
        if not self.silent:
            (self.words if self.caption is None else self.caption).append(data)


def sequences(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """pages to items in order: key, position, kind (text or media), text, digest, caption."""
    kind = pages.schema[key].dataType.simpleString()

    def parse(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, items = [], []
            for row, page in enumerate(batch.column(1).to_pylist()):
                parser = _Items()
                parser.feed(page or "")
                parser.close()
                parser.flush()
                keys += [row] * len(parser.items)
                items += [(at, *item) for at, item in enumerate(parser.items)]
            columns = [pa.array([i[k] for i in items], t) for k, t in enumerate([pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()])]
            yield pa.record_batch([batch.column(0).take(pa.array(keys, pa.int64())), *columns], ["key", "position", "kind", "text", "digest", "caption"])

    return pages.select(F.col(key).alias("key"), F.col(html).alias("html")).mapInArrow(parse, f"key {kind}, position long, kind string, text string, digest string, caption string")


def resolve(items: DataFrame, stored: DataFrame) -> DataFrame:
    """items with the store's columns beside each reference whose digest the store has."""
    theirs = stored.withColumnRenamed("digest", "__digest")
    return items.join(theirs, items["digest"] == theirs["__digest"], "left").drop("__digest")


def parts_of(raw: Column) -> Column:
    """A payload as an array of its parts, with digest and place."""
    places = F.sequence(F.lit(0), F.ceil(F.octet_length(raw) / PART).cast("int") - 1)
    cut = lambda k: F.substring(raw, k * PART + 1, F.lit(PART))
    return F.transform(places, lambda k: F.struct(k.alias("k"), F.sha2(cut(k), 256).alias("digest"), cut(k).alias("payload")))


def page_of(text: Column, parts: Column) -> Column:
    """The page of a document: pieces of its text and figures of its parts in turn, as long as there are
    any; a figure's caption tells which bytes of the payload it holds."""
    escape = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    n_pieces = F.ceil(F.length(text) / PIECE).cast("int")
    turns = F.sequence(F.lit(0), F.greatest(n_pieces, F.size(parts)) - 1)

    def turn(k: Column) -> Column:
        piece = F.when(k < n_pieces, F.concat(F.lit("<pre>"), escape(F.substring(text, k * PIECE + 1, F.lit(PIECE))), F.lit("</pre>"))).otherwise("")
        part = F.get(parts, k)
        size = F.octet_length(part["payload"])
        caption = F.concat(F.lit("bytes "), (k * PART).cast("string"), F.lit(" to "), (k * PART + size).cast("string"))
        figure = F.concat(F.lit(f"<figure><img src='{SCHEME}"), part["digest"], F.lit("'><figcaption>"), caption, F.lit("</figcaption></figure>"))
        return F.concat(piece, F.when(k < F.size(parts), figure).otherwise(""))

    return F.concat(F.lit("<article>"), F.array_join(F.transform(turns, turn), ""), F.lit("</article>"))


def media_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, n_bytes, what the media say about the payload, the positions
    and captions of the media, and the number and bytes of the text items around them."""
    raw, size = payload(F.col(text))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), size.alias("n_bytes"), raw.alias("payload"))
    rows = rows.withColumn("page", F.sha2("payload", 256))
    parts = rows.select("page", "text", parts_of(F.col("payload")).alias("parts"))
    stored = store(parts.select(F.explode("parts").alias("p")).select("p.digest", "p.payload"))
    items = sequences(parts.select("page", page_of(F.col("text"), F.col("parts")).alias("html")), "page")
    # Texts stay where they are parsed: what goes on is their size. Equal pages are one from here on.
    items = items.select("key", "position", "kind", "digest", "caption", F.octet_length("text").cast("long").alias("text_bytes")).distinct()
    items = settle(items, "media-items")
    is_text = F.col("kind") == "text"
    pages = items.groupBy("key").agg(F.count_if(~is_text).alias("n"), F.count_if(is_text).alias("n_texts"), F.coalesce(F.sum("text_bytes"), F.lit(0)).alias("text_bytes"))
    pages = settle(pages.withColumnRenamed("key", "page"), "media-pages")
    asked = items.filter(~is_text).select(F.col("key").alias("page"), "position", "digest", "caption").join(pages.select("page", "n"), "page")
    told = described(resolve(asked, stored)).join(pages.drop("n"), "page")
    told = settle(told, "media-told")
    return rows.select("doc_id", "n_bytes", "page").join(told.withColumnRenamed("page", "__page"), F.col("page") == F.col("__page")).drop("page", "__page")


def op10_interleaved_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_of(documents(spark, sf_dir))
