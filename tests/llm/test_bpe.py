import base64
import os
import random

import pytest
import tiktoken

from oppflow.llm import bpe

PATH = bpe.tokenizer_path()
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary file")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pieces(reference):
    ranks, r = bpe.load_ranks(PATH), random.Random(5)
    for _ in range(400):
        piece = "".join(r.choice("abcde éß漢0 ") for _ in range(r.randint(1, 60))).encode()
        assert bpe.merge_ids(piece, ranks) == reference._encode_single_piece(piece)
    assert bpe.merge_ids(b"a" * 5000, ranks) == reference._encode_single_piece(b"a" * 5000)


def test_texts(reference):
    encode = bpe.Encoder(PATH).encode
    for t in ["", "   ", "\n\n a  b", "<|endoftext|>", "It's 1234 é́ \u200b漢字🙂", "x" * 3000, "a\tb \r\n c"]:
        assert encode(t) == reference.encode_ordinary(t)
        assert reference.decode(encode(t)) == t
    assert encode(None) == []


def test_corpus(spark):
    rows = [(1, "Hello wereld", 5), (2, "", 5), (3, None, 5), (None, "x", 5), (1, "Hello wereld", 5), (4, "woord " * 50_000, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = sorted(((r.doc_id, r.ids) for r in bpe.encode_corpus(df).collect()), key=lambda x: (x[0] is None, x[0] or 0))
    assert len(got) == 6 and got[2] == (2, []) and got[3] == (3, []) and got[0] == got[1]
    assert len(got[4][1]) > 50_000
    assert bpe.encode_corpus(df.limit(0)).collect() == []
