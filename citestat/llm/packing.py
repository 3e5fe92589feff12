"""Token ids packed into rows of fixed length, with segment lengths and position resets.

Texts are tokenized and packed inside the task that reads them, block by block, so nothing is
shuffled and a block of tokens bounds the memory. Texts longer than a row are split without
loss: full rows of their own, and a rest that is packed like a short text. Rests are packed by
best-fit decreasing: from the longest on, each enters the row with the least room that holds
it, found by a segment tree over the remaining capacities.

Tokenizing is done once per distinct piece of text. A text may be cut before a space between two
characters that are no white space, because byte-pair patterns start a new token there; the
tokens of the text are those of its pieces.
"""

from __future__ import annotations

import base64
import importlib.util
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from citestat.llm.common import col
from citestat.llm.words import SPACES, _power, mixed

ROW_TOKENS = 2048
#: Tokens packed together; two rows or so per block stay partly empty.
BLOCK_TOKENS = 4_000_000
#: Bytes of text that are tokenized together, and distinct pieces remembered.
RUN_BYTES = 2 << 20
REMEMBERED = 1_000_000
TOKENIZERS = "/opt/tokenizers"
RANKS = "byte_bpe_50k.tiktoken"
#: The id after the last rank ends every text.
END = 50256

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Last bytes of characters that may be white space beyond ASCII; no cut is made after them.
_MAYBE_SPACE = np.zeros(256, dtype=bool)
_MAYBE_SPACE[[0x80, 0x81, 0x82, 0x83, 0x84, 0x85, 0x86, 0x87, 0x88, 0x89, 0x8A, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True
#: First bytes of such characters; no cut is made before them.
_MAYBE_SPACE_FIRST = np.zeros(256, dtype=bool)
_MAYBE_SPACE_FIRST[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_ASCII_SPACE = SPACES.copy()
_ASCII_SPACE[[0x1C, 0x1D, 0x1E, 0x1F]] = True
_NO_CUT_AFTER = _ASCII_SPACE | _MAYBE_SPACE
_NO_CUT_BEFORE = _ASCII_SPACE | _MAYBE_SPACE_FIRST


@lru_cache(maxsize=2)
def load_encoding(folder: str, ranks: str):
    """Encoding from a rank file of the folder, split by the folder's pattern."""
    import tiktoken

    spec = importlib.util.spec_from_file_location("token_pattern", Path(folder) / "__init__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    lines = (Path(folder) / ranks).read_bytes().splitlines()
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=module.PATTERN, mergeable_ranks=table, special_tokens={})


class PieceTokenizer:
    """Tokenizes runs of texts; tokens of pieces seen before are looked up."""

    def __init__(self, folder: str, ranks: str):
        self._encoding = load_encoding(folder, ranks)
        self._forget()

    def _forget(self) -> None:
        self._known = np.zeros(0, dtype=np.uint64)  # sorted hashes
        self._check = np.zeros(0, dtype=np.uint64)
        self._at = np.zeros(0, dtype=np.int64)
        self._size = np.zeros(0, dtype=np.int64)
        self._tokens = np.zeros(0, dtype=np.int32)

    def tokens(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all texts in ``data`` one after another, and the end of each text among them."""
        n = len(data)
        if not n:
            return np.zeros(0, dtype=np.int32), np.zeros(len(offsets) - 1, dtype=np.int64)
        cut = np.zeros(n + 1, dtype=bool)
        cut[1 : n - 1] = (data[1:-1] == 0x20) & ~_NO_CUT_AFTER[data[:-2]] & ~_NO_CUT_BEFORE[data[2:]] if n > 2 else False
        cut[offsets] = True
        edges = np.flatnonzero(cut)
        starts, ends = edges[:-1], edges[1:]
        keys = []
        for base in _BASES:
            sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(base, n), out=sums[1:])
            keys.append(mixed((sums[ends] - sums[starts]) * _power(pow(base, -1, 1 << 64), n + 1)[starts]))
        distinct, first, which = np.unique(keys[0], return_index=True, return_inverse=True)
        if not (keys[1] == keys[1][first][which]).all():
            return self._plain(data, offsets)
        at = np.searchsorted(self._known, distinct)
        found = at < len(self._known)
        found[found] = self._known[at[found]] == distinct[found]
        if not (self._check[at[found]] == keys[1][first[found]]).all():
            return self._plain(data, offsets)
        fresh = np.flatnonzero(~found)
        if len(fresh):
            self._learn(data, distinct[fresh], keys[1][first[fresh]], starts[first[fresh]], ends[first[fresh]])
            at = np.searchsorted(self._known, distinct)
        size, place = self._size[at][which], self._at[at][which]
        stops = np.cumsum(size)
        source = np.repeat(place - (stops - size), size) + np.arange(stops[-1])
        out = self._tokens[source]
        piece = np.searchsorted(starts, offsets[1:])
        text_ends = np.concatenate([[0], stops])[piece]
        if len(self._known) > REMEMBERED:
            self._forget()
        return out, text_ends

    def _encoded(self, pieces: list[bytes]) -> list[list[int]]:
        return [self._encoding.encode_ordinary(p.decode()) for p in pieces]

    def _learn(self, data: np.ndarray, keys: np.ndarray, check: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        raw = data.tobytes()
        made = self._encoded([raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
        size = np.array([len(m) for m in made], dtype=np.int64)
        flat = np.array([t for m in made for t in m], dtype=np.int32)
        begin = len(self._tokens) + np.cumsum(size) - size
        place = np.searchsorted(self._known, keys)
        self._known = np.insert(self._known, place, keys)
        self._check = np.insert(self._check, place, check)
        self._at = np.insert(self._at, place, begin)
        self._size = np.insert(self._size, place, size)
        self._tokens = np.concatenate([self._tokens, flat])

    def _plain(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Without the lookup, for the run in which two pieces share a hash."""
        raw = data.tobytes()
        made = self._encoded([raw[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
        return np.array([t for m in made for t in m], dtype=np.int32), np.cumsum([len(m) for m in made])


class CapacityTree:
    """Segment tree over capacities 0 .. top: which remaining capacities some open row has."""

    def __init__(self, top: int):
        self._leaves = 1 << top.bit_length()
        self._count = [0] * (2 * self._leaves)
        self._rows: list[list[int]] = [[] for _ in range(top + 1)]

    def put(self, capacity: int, row: int) -> None:
        self._rows[capacity].append(row)
        self._shift(capacity, 1)

    def tightest(self, size: int) -> tuple[int, int] | None:
        """Capacity and row of the open row with the least room for ``size``; it is taken out."""
        count, i = self._count, self._leaves + size
        if not count[i]:
            # up to the first ancestor with something on its right, then down its left edge
            while i > 1 and (i & 1 or not count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self._leaves:
                i = 2 * i if count[2 * i] else 2 * i + 1
        capacity = i - self._leaves
        self._shift(capacity, -1)
        return capacity, self._rows[capacity].pop()

    def _shift(self, capacity: int, by: int) -> None:
        i = self._leaves + capacity
        while i:
            self._count[i] += by
            i >>= 1


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Row of each item, rows opened as needed; no size is above ``capacity``."""
    tree, rows, opened = CapacityTree(capacity), np.zeros(len(sizes), dtype=np.int64), 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        room, row = tree.tightest(size) or (capacity, opened)
        opened += row == opened
        rows[i] = row
        tree.put(room - size, row)
    return rows


def _pack(tokens: np.ndarray, ends: np.ndarray, rows: np.ndarray, ids: list, length: int, pad: int) -> pa.RecordBatch:
    """Rows of one block. ``rows`` and ``ids`` name the texts that end at ``ends``."""
    begins = np.concatenate([[0], ends[:-1]])
    full = (ends - begins) // length
    # a full row per stretch of `length` tokens, then what is left of each text
    text = np.repeat(np.arange(len(ends)), full)
    start = begins[text] + (np.arange(len(text)) - np.repeat(np.cumsum(full) - full, full)) * length
    rest = (ends - begins) % length
    some = np.flatnonzero(rest)
    home = best_fit_decreasing(rest[some], length) + len(text)
    text = np.concatenate([text, some])
    start = np.concatenate([start, ends[some] - rest[some]])
    size = np.concatenate([np.full(len(start) - len(some), length), rest[some]]).astype(np.int64)
    home = np.concatenate([np.arange(len(start) - len(some)), home])
    order = np.lexsort((start, home))
    text, start, size, home = text[order], start[order], size[order], home[order]
    n = int(home[-1]) + 1 if len(home) else 0
    stops = np.cumsum(size)
    row_first = np.searchsorted(home, np.arange(n + 1))
    before = np.concatenate([[0], stops])[row_first[:-1]]
    inside = stops - size - before[home]  # where each segment begins in its row
    step = np.arange(stops[-1] if n else 0) - np.repeat(stops - size, size)
    target = np.repeat(home * length + inside, size) + step
    wide = np.uint16 if pad < 1 << 16 else np.int32
    matrix = np.full(n * length, pad, dtype=wide)
    matrix[target] = tokens[np.repeat(start, size) + step]
    positions = np.zeros(n * length, dtype=np.uint16 if length <= 1 << 16 else np.int32)
    positions[target] = step
    cut = [inside[a:b].tolist() + [int(inside[b - 1] + size[b - 1])] for a, b in zip(row_first[:-1], row_first[1:], strict=True)]
    bounds = pa.array(row_first, pa.int32())
    kind = ids[0].type if ids else pa.int64()
    return pa.RecordBatch.from_arrays(
        [
            _binary(matrix, n, length), _binary(positions, n, length), pa.array(cut, pa.list_(pa.int32())),
            pa.ListArray.from_arrays(bounds, pa.array(rows[text])),
            pa.ListArray.from_arrays(bounds, pc.take(pa.concat_arrays(ids), pa.array(text)) if ids else pa.array([], kind)),
            pa.ListArray.from_arrays(bounds, pa.array((start - begins[text]).astype(np.int64))),
        ],
        names=["ids", "positions", "cu_seqlens", "rows", "doc_ids", "starts"],
    )


def _binary(matrix: np.ndarray, n: int, length: int) -> pa.Array:
    width = length * matrix.itemsize
    fixed = pa.Array.from_buffers(pa.binary(width), n, [None, pa.py_buffer(matrix.tobytes())])
    return fixed.cast(pa.binary())


def packed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = ROW_TOKENS, end: int = END,
    folder: str = TOKENIZERS, ranks: str = RANKS,
) -> DataFrame:
    """One row per packed sequence of ``length`` tokens.

    ids: little-endian token ids, filled up with ``end`` (16 bits wide while ``end`` is below 65,536);
    positions: the place of each token in its segment, starting over at every segment; cu_seqlens:
    where segments begin, and the end of the last; and per segment rows (a number of the input
    row), doc_ids and starts (the segment's first token in its text). Every text ends with ``end``,
    so null and empty texts are one token. Repeated rows are packed one by one.
    """
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = PieceTokenizer(folder, ranks)
        tokens, ends, rows, ids, held = [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            shift = np.cumsum([0] + [len(t) for t in tokens[:-1]])
            all_ends = np.concatenate([e + s for e, s in zip(ends, shift, strict=True)])
            return _pack(np.concatenate(tokens), all_ends, np.concatenate(rows), ids, length, end)

        for batch in batches:
            texts = pc.fill_null(batch.column(2).cast(pa.large_string()), "")
            offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
            buffer = texts.buffers()[2]
            data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.zeros(0, np.uint8)
            first = 0
            while first < len(texts):
                last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + RUN_BYTES, "right")) - 1)
                last = min(last, len(texts))
                found, stops = tokenizer.tokens(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                # the end mark goes behind each text
                found = np.insert(found, stops, end)
                tokens.append(found)
                ends.append(stops + np.arange(1, last - first + 1))
                rows.append(batch.column(0).slice(first, last - first).to_numpy())
                ids.append(batch.column(1).slice(first, last - first))
                held, first = held + len(found), last
                if held >= BLOCK_TOKENS:
                    yield flush()
                    tokens, ends, rows, ids, held = [], [], [], [], 0
        if tokens:
            yield flush()

    return docs.select(
        F.monotonically_increasing_id().alias("row"), col(id_col).alias("id"), col(text_col).alias("text")
    ).mapInArrow(
        run,
        f"ids binary, positions binary, cu_seqlens array<int>, rows array<bigint>, doc_ids array<{kind}>, starts array<bigint>",
    )


def unpacked(
    rows: DataFrame, folder: str = TOKENIZERS, ranks: str = RANKS, end: int = END
) -> DataFrame:
    """(doc_id, text): the texts back from packed rows, one row per text packed."""
    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"row": [], "doc_id": [], "start": [], "part": []}
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], dtype=np.uint16 if end < 1 << 16 else np.int32)
                for k, (a, b) in enumerate(zip(r["cu_seqlens"], r["cu_seqlens"][1:], strict=False)):
                    out["row"].append(r["rows"][k])
                    out["doc_id"].append(r["doc_ids"][k])
                    out["start"].append(r["starts"][k])
                    out["part"].append(ids[a:b].astype(np.int32).tolist())
            yield pa.RecordBatch.from_pydict(out, pa.schema([
                ("row", pa.int64()), ("doc_id", batch.schema.field("doc_ids").type.value_type), ("start", pa.int64()),
                ("part", pa.list_(pa.int32())),
            ]))

    kind = dict(rows.dtypes)["doc_ids"][len("array<") : -1]
    parts = rows.mapInArrow(segments, f"row bigint, doc_id {kind}, start bigint, part array<int>")
    whole = parts.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("start", "part"))), lambda s: s["part"])).alias("tokens"),
    )

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load_encoding(folder, ranks)
        for batch in batches:
            texts = [encoding.decode(t[:-1]) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return whole.select("doc_id", "tokens").mapInArrow(decode, f"doc_id {kind}, text string")
