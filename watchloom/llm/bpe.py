"""Byte-level BPE encoding and decoding with recursive DuckDB queries inside Spark tasks.

A task cuts its texts into pieces, and one recursive query contracts all pieces it hasn't met
yet: token-position rows join the merge table, every word contracts its leftmost pair of
least rank, until no pair of any word is in the table. Decoding joins id-position rows with the
vocabulary and concatenates the bytes in order. Texts never leave their partition: there is no
shuffle, and a lost task is simply repeated.

A vocabulary is a bounded file (its size is checked) and is broadcast once. A task holds one slice of
pieces and a table of known pieces that is emptied when full, so memory doesn't follow the input.

Defined results: a null or empty text has no ids, and no ids decode to no bytes; a null list of
ids decodes to null, an id outside the vocabulary is an error; a piece that is a token itself
is that token, as in the public library; pieces longer than ``LONG_PIECE`` bytes go the same way by
a heap, since one contraction per round would cost the square of their length. Repeated rows are
encoded alike; other columns don't matter.
"""

from __future__ import annotations

import hashlib
import heapq
import sys
from collections.abc import Iterator
from itertools import chain, islice

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchloom.llm.ranks import read_ranks

LONG_PIECE = 256
#: Token positions over all rounds of one recursive query, at most.
CONTRACTED = 8_000_000
#: Pieces handled at once, known pieces kept, ids decoded at once.
SLICE, KNOWN, DECODED = 200_000, 150_000, 250_000
#: Rows whose ids and bytes a worker holds at once.
ROWS = 500

_ENCODE = """
with recursive state(word, round, toks) as (
  select word, 0, toks from fresh
  union all
  select s.word, s.round + 1, s.toks[:b.place - 1] || [b.id] || s.toks[b.place + 2:]
  from state s join (
    select word, least_pair & 1048575 as place, (least_pair >> 20)::int id
    from (select word, min(m.id::bigint * 1048576 + place) least_pair
          from (select word, unnest(toks[:-2]) l, unnest(toks[2:]) r, unnest(range(1, len(toks))) place from state) p
          join merges m on m.l = p.l and m.r = p.r
          group by word)) b on b.word = s.word)
select word, arg_max(toks, round) ids from state group by word order by word
"""
_DECODE = """
select doc, array_to_string(list(v.chars order by place), '') chars
from tokens t join vocabulary v using (id)
group by doc order by doc
"""


class Codec:
    """Encoder and decoder of one worker process."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find = ranks, regex.compile(pattern)
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.known: dict[str, bytes] = {}  # ids as their int32 bytes
        self.older: dict[str, bytes] = {}
        self.vocabulary = np.zeros(max(ranks.values()) + 1, bool)
        self.vocabulary[list(ranks.values())] = True
        pairs = [(ranks[t[:k]], ranks[t[k:]], i) for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        left, right, merged = ([p[k] for p in pairs] for k in range(3))
        self.merges = dict(zip(zip(left, right, strict=True), merged, strict=True))
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "256MB", "temp_directory": ""})
        self._table("merges", l=pa.array(left, pa.int32()), r=pa.array(right, pa.int32()), id=pa.array(merged, pa.int32()))
        self._table("vocabulary", id=pa.array(list(ranks.values()), pa.int32()), chars=pa.array([t.decode("latin-1") for t in ranks]))

    def _table(self, name: str, **columns: pa.Array) -> None:
        given = pa.table(columns)
        self.con.register("given", given)
        self.con.execute(f"create table {name} as select * from given")
        self.con.unregister("given")

    def _contract(self, pieces: list[bytes]) -> list[bytes]:
        ends = np.cumsum([0, *map(len, pieces)]).astype(np.int32)
        toks = pa.ListArray.from_arrays(ends, self.byte[np.frombuffer(b"".join(pieces), np.uint8)])
        self.con.register("fresh", pa.table({"word": pa.array(np.arange(len(pieces), dtype=np.int32)), "toks": toks}))
        ids = self.con.sql(_ENCODE).to_arrow_table().column("ids").combine_chunks()
        self.con.unregister("fresh")
        raw = ids.flatten().to_numpy().astype("<i4").tobytes()
        cuts = (4 * np.cumsum(np.concatenate([[0], ids.value_lengths().to_numpy()]))).tolist()
        return [raw[x:y] for x, y in zip(cuts, cuts[1:], strict=False)]

    def _contract_long(self, piece: bytes) -> bytes:
        toks, n = self.byte[np.frombuffer(piece, np.uint8)].tolist(), len(piece)
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), n
        heap = [(m, i, toks[i], toks[i + 1]) for i in range(n - 1) if (m := self.merges.get((toks[i], toks[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            merged, i, left, right = heapq.heappop(heap)
            j = after[i]
            if toks[i] != left or j == end or toks[j] != right:
                continue
            toks[i], toks[j], after[i] = merged, -1, after[j]
            if after[i] != end:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b != end and (m := self.merges.get((toks[a], toks[b]))) is not None:
                    heapq.heappush(heap, (m, a, toks[a], toks[b]))
        return np.array([t for t in toks if t >= 0], "<i4").tobytes()

    def _learn(self, pieces: set[str]) -> None:
        fresh, data, size = [], [], 0
        for p in pieces:
            raw = p.encode()
            if raw in self.ranks:
                self.known[p] = self.ranks[raw].to_bytes(4, "little")
            elif len(raw) > LONG_PIECE:
                self.known[p] = self._contract_long(raw)
            else:
                fresh.append(p)
                data.append(raw)
                size += len(raw) ** 2  # the query keeps a word's tokens of every round
                if size > CONTRACTED:
                    self.known.update(zip(fresh, self._contract(data), strict=True))
                    fresh, data, size = [], [], 0
        if fresh:
            self.known.update(zip(fresh, self._contract(data), strict=True))

    def _slices(self, texts: list[str | None]):
        """(place of the text, its next pieces), and after some slices None: learn now."""
        size = 0
        for k, text in enumerate(texts):
            if not text:
                continue
            pieces = iter(self.find.findall(text)) if len(text) < 2_000_000 else (m[0] for m in self.find.finditer(text))
            while part := list(islice(pieces, SLICE)):
                yield k, part
                size += len(part)
                if size >= SLICE:
                    yield None
                    size = 0
        yield None

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        parts: list[list[np.ndarray]] = [[] for _ in texts]
        held: list[tuple[int, list[str]]] = []
        for x in self._slices(texts):
            if x:
                held.append(x)
                continue
            if len(self.known) > KNOWN:  # the generation before stays at hand for a while
                self.known, self.older = {}, self.known
            fresh = set(chain.from_iterable(p for _, p in held)).difference(self.known)
            again = fresh.intersection(self.older)
            self.known.update((p, self.older[p]) for p in again)
            self._learn(fresh - again)
            for k, pieces in held:
                parts[k].append(np.frombuffer(b"".join(map(self.known.__getitem__, pieces)), "<i4"))
            held.clear()
        return [np.concatenate(p) if p else np.empty(0, np.int32) for p in parts]

    def decode(self, lists: list[np.ndarray | None]) -> list[bytes | None]:
        out: list[list[bytes]] = [[] for _ in lists]
        held, places, size = [], [], 0
        for k, ids in enumerate(lists):
            for a in range(0, len(ids) if ids is not None else 0, DECODED):
                held.append(ids[a : a + DECODED])
                places.append(k)
                size += len(held[-1])
                if size >= DECODED:
                    self._decode_into(out, held, places)
                    held, places, size = [], [], 0
        if held:
            self._decode_into(out, held, places)
        return [None if ids is None else b"".join(out[k]) for k, ids in enumerate(lists)]

    def _decode_into(self, out: list[list[bytes]], held: list[np.ndarray], places: list[int]) -> None:
        flat = np.concatenate(held).astype(np.int32)
        if flat.min() < 0 or flat.max() >= len(self.vocabulary) or not self.vocabulary[flat].all():
            raise ValueError("ids that are not in the vocabulary")
        docs = np.repeat(np.arange(len(held), dtype=np.int32), [len(x) for x in held])
        self.con.register("tokens", pa.table({"doc": docs, "place": np.arange(len(flat), dtype=np.int32), "id": flat}))
        found = self.con.sql(_DECODE).to_arrow_table()
        self.con.unregister("tokens")
        data = [x.encode("latin-1") for x in found.column("chars").to_pylist()]
        for doc, x in zip(found.column("doc").to_pylist(), data, strict=True):
            out[places[doc]].append(x)


def _parts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Batches cut to ``ROWS`` rows: results go back part by part, so a worker never holds those of a whole batch."""
    for batch in batches:
        for k in range(0, len(batch), ROWS):
            yield batch.slice(k, ROWS)


def codec(spark: SparkSession, path: str, pattern: str) -> tuple:
    """Column functions ``encode(text) -> array<int>`` and ``decode(ids) -> binary`` of a vocabulary, and both in one
    worker: ``both(text) -> struct<ids, data>``."""
    ranks = read_ranks(path)
    shared = spark.sparkContext.broadcast(ranks)
    key = hashlib.sha256(repr((pattern, sorted(ranks.items()))).encode()).hexdigest()

    def own() -> Codec:
        # One codec per worker process: functions are unpickled for every task, the process goes on.
        codecs = sys.__dict__.setdefault("_byte_bpe_codecs", {})
        if key not in codecs:
            codecs.clear()
            codecs[key] = Codec(shared.value, pattern)
        return codecs[key]

    def lists(found: list[np.ndarray]) -> pa.Array:
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
        return pa.ListArray.from_arrays(offsets, np.concatenate([np.empty(0, np.int32), *found]))

    def encode_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in _parts(batches):
            yield lists(own().encode(texts.to_pylist()))

    def both_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in _parts(batches):
            found = own().encode(texts.to_pylist())
            yield pa.StructArray.from_arrays([lists(found), pa.array(own().decode(found), pa.binary())], ["ids", "data"])

    def decode_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for ids in _parts(batches):
            yield pa.array(own().decode([x.values.to_numpy(zero_copy_only=False) if x.is_valid else None for x in ids]), pa.binary())

    def encode(text: Column) -> Column:
        return F.arrow_udf(encode_batches, "array<int>").asNondeterministic()(text.cast("string"))

    def decode(ids: Column) -> Column:
        return F.arrow_udf(decode_batches, "binary").asNondeterministic()(ids.cast("array<int>"))

    def both(text: Column) -> Column:
        return F.arrow_udf(both_batches, "ids array<int>, data binary").asNondeterministic()(text.cast("string"))

    return encode, decode, both


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Per row the number of ids, SHA-256 of the ids and of the bytes they decode to, and the ids if asked."""
    _, _, both = codec(docs.sparkSession, path, pattern)
    coded = docs.select(docs[f"`{id_col}`"].alias("doc_id"), both(docs[f"`{text}`"]).alias("x")).select("doc_id", "x.*")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("data", 256).alias("decoded_sha256"),
        *["ids"] * keep_ids,
    )


def op9_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """One row per document: its ids and their decoded bytes, as digests."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
