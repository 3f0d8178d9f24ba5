import zlib

import numpy as np
from tokenizers import Tokenizer

from tintmill.llm import packing

TEXTS = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "it's <|endoftext|>\n\n  y", "<|endoftext| >", "no mark"]


def test_the_literal_mark_is_one_id(spark):
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = [[*e.ids, 0] for e in t.encode_batch(TEXTS, add_special_tokens=False)]
    assert want[0] == [64, 220, 50256, 275, 0]
    pieces = packing.pack(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")).collect()
    got = {r.doc_id: (r.start, r.length, r.doc_tokens, r.ids_crc32) for r in pieces}
    assert got == {k: (0, len(x), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for k, x in enumerate(want)}
