import random

import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from watchloom.llm import bpe

from .fixtures import documents, sha, texts

PATH = P.path("byte_bpe_multi_50k.tiktoken")
RANKS = bpe.read_ranks(PATH)
PUBLIC = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(RANKS, P.PATTERN)


def odd_texts() -> list[str]:
    r = random.Random(11)
    pool = list("aeiounrst  \n\t'’ß漢字éñ🙂0123456789.,!?-—\x00\x1c\x1f\x85​ 　ǅ٣")
    made = ["".join(r.choice(pool) for _ in range(r.randrange(1, 80))) for _ in range(200)]
    return made + ["a" * 3000, "ab" * 700, "don't I'll we're", "  \n\n  x ", "é" * 600, "<|endoftext|>"]


def test_ids_equal_the_public_library(codec):
    every = [t or "" for t in texts()] + odd_texts()
    for text, ids in zip(every, codec.encode(every), strict=True):
        assert ids.tolist() == PUBLIC.encode_ordinary(text), text[:60]


def test_decode_is_the_inverse(codec):
    every = odd_texts() + [""]
    assert codec.decode(codec.encode(every)) == [t.encode() for t in every]
    assert codec.decode([None]) == [None]
    with pytest.raises(ValueError, match="vocabulary"):
        import numpy as np

        codec.decode([np.array([len(RANKS) + 5], np.int32)])


def test_slices_do_not_matter(codec, monkeypatch):
    every = texts() + odd_texts()
    want = [x.tolist() for x in codec.encode(every)]
    monkeypatch.setattr(bpe, "SLICE", 60)
    monkeypatch.setattr(bpe, "KNOWN", 20)
    monkeypatch.setattr(bpe, "CONTRACTED", 500)
    codec.known, codec.older = {}, {}
    monkeypatch.setattr(bpe, "DECODED", 40)
    small = [t for t in every if not t or len(t) < 500]
    got = [x.tolist() for x in codec.encode(small)]
    assert got == [w for w, t in zip(want, every, strict=True) if not t or len(t) < 500]
    assert codec.decode(codec.encode(small)) == [(t or "").encode() for t in small]


def test_long_pieces_go_the_same_way(codec, monkeypatch):
    words = ["".join(random.Random(k).choice("etaoinshr") for _ in range(60)).encode() for k in range(50)]
    assert codec._contract(words) == [codec._contract_long(w) for w in words]


def test_digests(spark):
    docs = documents(spark)
    got = bpe.round_trip(docs, PATH, P.PATTERN, keep_ids=True).collect()
    assert len(got) == docs.count()
    by = {sha(r["text"] or ""): r["text"] or "" for r in docs.collect()}
    for r in got:
        ids = PUBLIC.encode_ordinary(by[r["decoded_sha256"]])
        assert (r["n_tokens"], r["ids_sha256"], r["ids"]) == (len(ids), sha(",".join(map(str, ids))), ids)
    assert bpe.round_trip(documents(spark, []), PATH, P.PATTERN).count() == 0


def test_columns_pass_nulls(spark):
    encode, decode, _ = bpe.codec(spark, PATH, P.PATTERN)
    row = spark.createDataFrame([(None,)], "ids array<int>").select(decode(F.col("ids")).alias("d")).first()
    assert row["d"] is None
    text = spark.createDataFrame([("two words",), (None,)], "t string").select(encode(F.col("t")).alias("ids"))
    assert [bytes(r["d"]) for r in text.select(decode(F.col("ids")).alias("d")).collect()] == [b"two words", b""]


def test_results_leave_a_worker_in_parts(spark):
    """A batch is handed back ``ROWS`` rows at a time, whole and in order, and so are empty ones."""
    batches = [pa.array([str(k) for k in range(3 * bpe.ROWS + 1)]), pa.array([], pa.string()), pa.array(["x", None])]
    cut = list(bpe._parts(iter(batches)))
    assert max(map(len, cut)) == bpe.ROWS and pa.concat_arrays(cut).to_pylist() == pa.concat_arrays(batches).to_pylist()
    encode, decode, both = bpe.codec(spark, PATH, P.PATTERN)
    docs = spark.range(3 * bpe.ROWS + 1).coalesce(1).selectExpr("id", "if(id % 7 = 0, null, concat('text ', id)) text")
    got = docs.select("id", "text", both(docs["text"]).alias("x"), encode(docs["text"]).alias("ids")).select("*", decode(F.col("ids")).alias("data")).collect()
    assert len(got) == 3 * bpe.ROWS + 1
    assert all(bytes(r["x"]["data"]).decode() == bytes(r["data"]).decode() == (r["text"] or "") and r["x"]["ids"] == r["ids"] for r in got)
