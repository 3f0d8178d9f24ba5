import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

#: Names that operators use inside or return; as extra columns of the input they must not disturb.
CLASHES = ("shard", "slot", "size", "row", "row_number", "position", "keep_id", "kept", "recipe", "key", "ids", "block", "bucket", "file", "epoch", "tokens", "budget", "language", "fp", "component_id", "digest", "payload", "start", "node", "held_out", "score")


def table(rows):
    """rows (doc_id, text, lang, source) as documents with extra columns of clashing names."""
    ids, texts, langs, sources = zip(*rows) if rows else ((), (), (), ())
    own = {"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "lang": pa.array(langs, pa.string()), "source": pa.array(sources, pa.string()), "n_chars": pa.array([len(t or "") for t in texts], pa.int64())}
    return pa.table(own | {c: pa.array(["x"] * len(ids), pa.string()) for c in CLASHES})


LONG = "the quick brown fox jumps over it and runs away from there again " * 3000
ROWS = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n ", None, "a"), (4, "Hello big wide world of ours", "en", None),
    (5, "Hello  big\twide world of ours", "en", "b"), (6, "Hello big wide world of ours", "en", "b"), (7, LONG, "en", "a"), (8, LONG, "en", "c"), (9, LONG[:-1] + "x", None, "c"),
    (10, "une petite phrase en français, là-bas où il y a des élèves", "fr", "c"), (11, "12 34 -- !!", "fr", "c"), (12, "ein kleiner Satz über schöne Häuser", "de", "c"),
    (13, "twice the same row here now", "en", "b"), (13, "twice the same row here now", "en", "b"), (None, "a row without an id", None, None), (None, "a row without an id", None, None),
    (14, "a", "en", "b"), (15, "A", "en", "b"), (16, "日本語の文章です", "ja", "b"), (17, "mail ann@ex.org now, or +1 (203) 555-0199", "en", "b"), (18, "x\x00y ퟿ z\U0001f600", "en", "b"),
] + [(20 + k, "copies copies copies of one text", "en", "hot") for k in range(30)]


def vectors(rows):
    """rows (vec_id, vector, label) as embeddings with extra columns of clashing names."""
    ids, values, labels = zip(*rows) if rows else ((), (), ())
    own = {"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(values, pa.list_(pa.float32())), "label": pa.array(labels, pa.int32())}
    return pa.table(own | {c: pa.array(["x"] * len(ids), pa.string()) for c in ("list", "block", "v", "w", "own", "rank", "cluster", "score", "far", "kind")})


def odd_vectors(n=320):
    """Vectors with ties and equal rows; some are null, or have a component that is null or not finite."""
    draw = random.Random(12)
    rows = [(k, [draw.choice((-0.5, -0.25, 0.0, 0.1, 0.25, 0.5)) if d < 6 else 0.0 for d in range(64)], draw.randrange(4)) for k in range(n)]
    rows += [(n + k, rows[5][1], k % 4) for k in range(30)]  # copies, a hot label among them
    rows[7], rows[14], rows[21] = (7, None, 1), (14, [None, *rows[14][1][1:]], 1), (21, [float("nan"), *rows[21][1][1:]], 1)
    rows[28], rows[100], rows[35] = (28, [float("inf"), *rows[28][1][1:]], 1), (100, rows[100][1], None), (35, [0.0] * 64, 2)
    return rows


def put(folder, rows):
    pq.write_table(table(rows), folder / "documents.parquet")
    pq.write_table(vectors(odd_vectors() if rows else []), folder / "embeddings.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def odd(tmp_path_factory):
    return put(tmp_path_factory.mktemp("odd"), ROWS)


@pytest.fixture(scope="session")
def empty(tmp_path_factory):
    return put(tmp_path_factory.mktemp("empty"), [])
