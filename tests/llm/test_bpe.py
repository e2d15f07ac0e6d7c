import base64

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from seqloom.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    long = "word, and 12 more\n  " * 30 + "x" * 900 + " don't we'll   \n\n" + "été 中文字 😀" * 200
    return [None, "", " ", "a", "Hello  world's\n\n end ", "ab" * 300, long, "z" * 5000, " " * 3000 + "q", long * 3]


def test_like_the_library_in_chunks_and_whole(spark, library):
    cut = {"chunk": 256, "overlap": 64}
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(3, "a", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = [(r.doc_id, list(np.frombuffer(r.ids, "<u4"))) for r in bpe.encode(docs, PATH, P.PATTERN, **cut).collect()]
    assert sorted(out) == sorted((i, library.encode_ordinary(t or "")) for i, t, _ in rows)
    back = {r.doc_id: bytes(r.data) for r in bpe.decode(bpe.encode(docs, PATH, P.PATTERN, **cut), PATH, P.PATTERN).collect()}
    assert all(back[i] == (t or "").encode() for i, t, _ in rows)


def test_merges_agree_on_short_and_long_pieces(library):
    own = bpe.vocabulary(PATH, P.PATTERN)
    for n in (1, 2, 7, 90, 399, 400, 1300):
        piece = ("etaoinshrdlu" * 120)[n : 2 * n].encode()
        many = np.frombuffer(own.merges([b"q", piece, b"zx"])[1], "<u4").tolist()
        assert many == bpe._merge_long(piece, own.ranks) == library.encode_ordinary(piece.decode())


def test_empty_table(spark):
    assert bpe.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_stretches_agree_with_the_library(library):
    own, whole, rng = bpe.vocabulary(PATH, P.PATTERN), bpe.vocabulary(PATH, P.PATTERN, None), np.random.default_rng(3)
    signs = [" ", " ", " ", "\n", "\t", "\r\n", " ", "　", "\x1c", "\x85", "​", "a", "word", "don't", "'s", "12", "é", "中", "!", "..", "😀"]
    for n in [*range(12), *[30] * 300]:
        t = "".join(rng.choice(signs, n))
        got = own.encode([t])[0]
        assert np.frombuffer(got, "<u4").tolist() == library.encode_ordinary(t), repr(t)
        assert own.decode(got).decode() == t
        assert got == whole.encode([t])[0]


def test_null_ids_and_long_documents_that_repeat(spark, library):
    long = "some words, 12 of them\n\n" * 20
    rows = [(None, long), (None, long), (None, "x y"), (7, long), (7, long + "z")]
    got = bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), PATH, P.PATTERN, chunk=100, overlap=40).collect()
    key = lambda i: -1 if i is None else i
    assert sorted((key(r.doc_id), list(np.frombuffer(r.ids, "<u4"))) for r in got) == sorted((key(i), library.encode_ordinary(t)) for i, t in rows)
