import hashlib
import re
import zlib

from conftest import ROWS, put

from tintmill.llm import media


def test_round_trip():
    for n in (1, 2, 5):
        raw = bytes(range(256)) * 9 * n
        raw = raw[:576 * n]
        assert media.from_png(media.to_png(raw)) == raw


def decoded(png):
    """Samples of a PNG by its published format, apart from the code under test."""
    assert png.startswith(b"\x89PNG\r\n\x1a\n")
    at, width, height, data = 8, 0, 0, b""
    while at < len(png):
        n, kind = int.from_bytes(png[at:at + 4], "big"), png[at + 4:at + 8]
        body = png[at + 8:at + 8 + n]
        assert zlib.crc32(kind + body) == int.from_bytes(png[at + 8 + n:at + 12 + n], "big")
        if kind == b"IHDR":
            width, height = (int.from_bytes(body[k:k + 4], "big") for k in (0, 4))
            assert body[8:] == bytes([8, 0, 0, 0, 0])
        data += body if kind == b"IDAT" else b""
        at += 12 + n
    raw = zlib.decompress(data)
    lines = [raw[k * (width + 1):(k + 1) * (width + 1)] for k in range(height)]
    assert all(x[0] == 0 for x in lines) and len(raw) == height * (width + 1)
    return b"".join(x[1:] for x in lines)


def plain_features(samples):
    n = len(samples)
    mean = sum(samples) / n
    spread = (sum(x * x for x in samples) / n - mean * mean) ** 0.5
    return f"{mean:.4f} {spread:.4f} " + ",".join(str(sum(32 * k <= x < 32 * k + 32 for x in samples)) for k in range(8))


LONGER = "ab <b>c</b> & d\r\n é\U0001f600 " * 9000


def test_documents(spark, odd, tmp_path):
    rows = ROWS + [(100, LONGER, "en", "a"), (101, LONGER, "en", "a"), (102, LONGER[1:], "en", "a")]
    got = media.op10_interleaved_media(spark, put(tmp_path, rows)).collect()
    assert len(got) == len(rows)
    stored = {}
    for r in media.store(spark.createDataFrame([(hashlib.sha256(x).hexdigest(), bytearray(x)) for x in {p for t in rows for p in cut(t[1])}], "digest string, payload binary")).collect():
        stored[r.digest] = bytes(r.media)
    want = []
    for r in rows:
        raw, parts = (r[1] or "").encode(), cut(r[1])
        pngs = [stored[hashlib.sha256(p).hexdigest()] for p in parts]
        assert b"".join(map(decoded, pngs)) == b"".join(parts)
        full, file = b"".join(parts), b"".join(pngs)
        want.append((str(r[0]), len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]), len(file), hashlib.sha256(file).hexdigest(), plain_features(full), len(parts), len(raw)))
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature, r.n_media, r.text_bytes) for r in got) == sorted(want)
    long = next(r for r in got if r.doc_id == 100)
    assert long.n_media > 5 and long.n_texts > 5 and long.captions.startswith(f"bytes 0 to {media.PART},bytes {media.PART} to")
    assert long.positions.startswith("1,3,5,")


def cut(text):
    raw = (text or "").encode()
    full = raw + b"\xff" * (576 if not raw else -len(raw) % 576)
    return [full[k:k + media.PART] for k in range(0, len(full), media.PART)]


def test_order_and_captions(spark):
    html = "<h1>Top</h1><p>one <b>two</b></p><figure><img src='sha256:aa' alt='x'><figcaption>first &amp; best</figcaption></figure>tail<script>no</script><img src='sha256:zz' alt='lost'>"
    pages = spark.createDataFrame([(1, html), (2, None), (3, "")], "id long, html string")
    items = media.sequences(pages, "id")
    got = [tuple(r) for r in items.orderBy("key", "position").collect()]
    assert got == [
        (1, 0, "text", "Top", None, None), (1, 1, "text", "one two", None, None), (1, 2, "media", None, "aa", "first & best"), (1, 3, "text", "tail", None, None), (1, 4, "media", None, "zz", "lost"),
    ]
    stored = spark.createDataFrame([("aa", bytearray(b"payload"))], "digest string, media binary")
    out = {r.position: r.media for r in media.resolve(items, stored).collect()}
    assert bytes(out[2]) == b"payload" and out[0] is None and out[4] is None


def test_pages_of_a_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    items = media.sequences(pages, "page_id").collect()
    assert len({r.key for r in items}) > 40 and all((r.kind == "text") == (r.digest is None) for r in items)
    assert not any(re.search("<[a-z]+>", r.text or "") for r in items)
