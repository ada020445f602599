"""Packing token ids into fixed-length sequences by best fit decreasing.

A task tokenizes its documents, splits those over the sequence length into full pieces and a
rest, and packs a group of pieces whenever enough tokens have come together: longest first, each into
the open sequence with the least room that still holds it, found by a segment tree over
capacities. Groups have a bounded number of tokens, so memory doesn't follow the input; there
is no shuffle, and a lost task packs the same groups again. A group wastes about one sequence.

No token is lost or cut off: the pieces of a document, in order, are its ids. ``write_matrices``
stores sequences as id matrices with their cumulative segment lengths and position resets.

Defined results: a null or empty text has no tokens and no piece; a text of any length is split;
pieces of one length keep the order of the rows; repeated rows are packed each; rows without an
id are packed under a null id; no rows give no sequences; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegralType, LongType

from watchloom.llm.ranks import read_ranks

#: Tokens of a sequence, and tokens packed together.
LENGTH = 2048
GROUP = 2_000_000
#: Columns of packed sequences; whole-number ids come out as bigint, other ids in their own type.
PACKED = "doc_group string, row int, n_tokens int, doc_ids array<{id}>, parts array<int>, cu_seqlens array<int>, ids binary, positions binary"


class Rooms:
    """Open sequences by free room: a segment tree answers "least room of at least w"."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.most = [0] * (2 * self.size)  # largest occupied room below each node
        self.open: dict[int, list[int]] = {}

    def put(self, room: int, row: int) -> None:
        if room:
            self.open.setdefault(room, []).append(row)
            self._set(room, room)

    def take(self, width: int) -> tuple[int, int] | None:
        """(room, row) of the tightest fit, or None."""
        if self.most[1] < width:
            return None
        node, low, half = 1, 0, self.size
        while node < self.size:
            half //= 2
            node *= 2
            if self.most[node] < width:  # nothing wide enough among the smaller rooms
                node += 1
                low += half
        rows = self.open[low]
        row = rows.pop()
        if not rows:
            self._set(low, 0)
        return low, row

    def _set(self, room: int, value: int) -> None:
        node = room + self.size
        self.most[node] = value
        while node > 1:
            node //= 2
            self.most[node] = max(self.most[2 * node], self.most[2 * node + 1])


def best_fit(widths: list[int], length: int) -> list[list[int]]:
    """Rows of places in ``widths``, longest first; every width is from 1 to ``length``."""
    rooms, rows = Rooms(length), []
    for k in sorted(range(len(widths)), key=lambda k: -widths[k]):
        found = rooms.take(widths[k])
        if found:
            room, row = found
        else:
            room, row = length, len(rows)
            rows.append([])
        rows[row].append(k)
        rooms.put(room - widths[k], row)
    return rows


def split(ids: np.ndarray, length: int) -> list[np.ndarray]:
    return [ids[a : a + length] for a in range(0, len(ids), length)]


def _sequences(name: str, pieces: list[tuple], length: int, pad: int, bits: int, id_type: pa.DataType) -> pa.RecordBatch:
    if max(length, pad, *(int(p[2].max()) for p in pieces)) >> bits:
        raise ValueError(f"ids need more than {bits} bits")
    cols: dict[str, list] = {x.split()[0]: [] for x in PACKED.split(", ")}
    for row, places in enumerate(best_fit([len(p[2]) for p in pieces], length)):
        ends = np.cumsum([0] + [len(pieces[k][2]) for k in places])
        ids, positions = np.full(length, pad, "<u4"), np.zeros(length, "<u4")
        for k, a, b in zip(places, ends, ends[1:], strict=False):
            ids[a:b], positions[a:b] = pieces[k][2], np.arange(b - a)
        positions[ends[-1] :] = np.arange(length - ends[-1])  # padding is a segment of its own
        kind = f"<u{bits // 8}"
        values = (name, row, int(ends[-1]), [pieces[k][0] for k in places], [pieces[k][1] for k in places], ends.tolist(), ids.astype(kind).tobytes(), positions.astype(kind).tobytes())
        for c, v in zip(cols, values, strict=True):
            cols[c].append(v)
    types = (pa.string(), pa.int32(), pa.int32(), pa.list_(id_type), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary())
    return pa.RecordBatch.from_pydict({c: pa.array(v, t) for (c, v), t in zip(cols.items(), types, strict=True)})


def pack(docs: DataFrame, encode: Callable[[], Callable[[str], list[int]]], id_col: str = "doc_id", text: str = "text", length: int = LENGTH, group: int = GROUP, pad: int = 0, bits: int = 16) -> DataFrame:
    """One row per sequence (``PACKED``); ``encode()`` makes a task's tokenizer.

    ``ids`` and ``positions`` are little-endian, ``bits`` (16 or 32) wide; a value that doesn't fit is an
    error. Positions start at 0 in each segment; ``parts`` counts the pieces of a document from 0.
    Ids may be of any simple type and come out as they are (whole numbers as bigint, so a decimal without
    a fraction stays a decimal); null ids stay null.
    """
    own = docs.schema[id_col].dataType
    kind = LongType() if isinstance(own, IntegralType) else own
    id_type = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, pieces, size, made = encode(), [], 0, 0
        task = TaskContext.get().partitionId()
        for batch in batches:
            for doc, body in zip(batch.column(0), batch.column(1), strict=True):
                if not (body := body.as_py()):
                    continue
                for part, ids in enumerate(split(np.asarray(tokens(body), np.uint32), length)):
                    pieces.append((doc.as_py(), part, ids))
                    size += len(ids)
                    if size >= group:
                        yield _sequences(f"{task}-{made}", pieces, length, pad, bits, id_type)
                        pieces, size, made = [], 0, made + 1
        if pieces:
            yield _sequences(f"{task}-{made}", pieces, length, pad, bits, id_type)

    return docs.select(docs[f"`{id_col}`"].cast(kind), docs[f"`{text}`"].cast("string")).mapInArrow(run, PACKED.format(id=kind.simpleString()))


def tiktoken_encoder(spark: SparkSession, path: str, pattern: str) -> Callable:
    """``encode`` for ``pack`` from a vocabulary file; the file is bounded and broadcast once."""
    shared = spark.sparkContext.broadcast(read_ranks(path))

    def make():
        import tiktoken

        return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=shared.value, special_tokens={}).encode_ordinary

    return make


def write_matrices(packed: DataFrame, path: str, rows: int = 256) -> None:
    """Store sequences as matrices of up to ``rows`` rows: ids and positions, row by row, and the
    segment ends of all rows one after the other with the number of segments of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(
                [
                    {
                        "n_rows": len(held),
                        "ids": b"".join(x["ids"] for x in held),
                        "positions": b"".join(x["positions"] for x in held),
                        "cu_seqlens": [v for x in held for v in x["cu_seqlens"]],
                        "n_segments": [len(x["doc_ids"]) for x in held],
                        "doc_ids": [v for x in held for v in x["doc_ids"]],
                        "parts": [v for x in held for v in x["parts"]],
                    }
                ],
                schema,
            )

        for batch in batches:
            for x in batch.to_pylist():
                if len(held) == rows or held and len(held[0]["ids"]) != len(x["ids"]):
                    yield made()
                    held = []
                held.append(x)
        if held:
            yield made()

    kind = packed.schema["doc_ids"].dataType
    fields = f"n_rows int, ids binary, positions binary, cu_seqlens array<int>, n_segments array<int>, doc_ids {kind.simpleString()}, parts array<int>"
    ints = pa.list_(pa.int32())
    schema = pa.schema([("n_rows", pa.int32()), ("ids", pa.binary()), ("positions", pa.binary()), ("cu_seqlens", ints), ("n_segments", ints), ("doc_ids", to_arrow_type(kind)), ("parts", ints)])
    packed.mapInArrow(run, fields).write.parquet(path)


def op6_packed_sequences(spark, sf_dir: str) -> DataFrame:
    """One row per packed sequence of all documents: pieces, segment lengths, digests of ids and positions."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    encode = tiktoken_encoder(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    packed = pack(docs, encode, pad=50256)
    return packed.select(
        "doc_group", "row", "n_tokens", "doc_ids", "parts", "cu_seqlens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("positions", 256).alias("positions_sha256")
    )
