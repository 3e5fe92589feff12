"""Alignment of the tokens of two tokenizers over the same texts, with corpus-wide pair counts.

Each text, with a space before it, is encoded by a byte-level tokenizer (A) and a piece tokenizer
(B). The byte offsets where tokens of both end cut the tokens into groups; two tokens are linked where
their byte ranges overlap. The count of an id pair is the number of texts that hold it linked.

Texts are worked on in blocks, as Arrow columns: the token lists are flattened, their parent indices
name the text, a cumulative sum of token lengths within each text gives the ends, and a full outer hash join of
both sides on (text, end) gives the stretches between neighbouring ends, which are the links: the token of
each side that covers a stretch is the next one that ends. `Table.group_by` makes the block's counts, which
Spark sums over all blocks, and whose totals return to the blocks. A block is a few megabytes of text (or one
longer text), so neither its table nor its pairs grow with the corpus.

Both tokenizers begin a token before a space between two characters that are no white space, so distinct
pieces between such places are encoded once and looked up afterwards.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from citestat.llm.common import col
from citestat.llm.packing import TOKENIZERS, PieceTokenizer
from citestat.session import save_and_reload

BYTE_FILE = "byte_bpe_50k.json"
PIECE_FILE = "piece_bpe_32k.model"
#: Bytes of text that are aligned together.
BLOCK_BYTES = 2 << 20
#: Bytes of text that are tokenized together, and distinct pieces that are encoded at a time.
RUN_BYTES = 1 << 19
ENCODED = 4096

#: The piece tokenizer's mark for a space.
SPACE_MARK = "▁"


class ByteVocabulary:
    """Encoder of the byte-level tokenizer, and its tokens' bytes."""

    def __init__(self, file: str):
        # a task has one core
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(file)
        # special tokens inside a text are plain text
        self._tokenizer.encode_special_tokens = True
        alphabet = _byte_alphabet()
        words = json.loads(Path(file).read_text())["model"]["vocab"]
        self.bytes: list[bytes] = [b""] * (max(words.values()) + 1)
        for word, i in words.items():
            self.bytes[i] = bytes(alphabet[c] for c in word) if all(c in alphabet for c in word) else word.encode()

    def encode(self, pieces: list[str]) -> list[list[int]]:
        return [e.ids for e in self._tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]


class PieceVocabulary:
    """Encoder of the piece tokenizer, which adds the space in front, and its tokens' bytes."""

    def __init__(self, file: str):
        import sentencepiece

        self._processor = sentencepiece.SentencePieceProcessor(model_file=file)
        p = self._processor
        self.bytes = [
            bytes([int(p.id_to_piece(i)[3:-1], 16)]) if p.is_byte(i) else p.id_to_piece(i).replace(SPACE_MARK, " ").encode()
            for i in range(p.get_piece_size())
        ]

    def encode(self, pieces: list[str]) -> list[list[int]]:
        return self._processor.encode([p[1:] for p in pieces], num_threads=1)


class Side(PieceTokenizer):
    """One tokenizer, its distinct pieces, and per id the number of bytes and the decimal text."""

    def __init__(self, vocabulary: ByteVocabulary | PieceVocabulary):
        self._vocabulary = vocabulary
        self._forget()
        self.lengths = pa.array([len(b) for b in vocabulary.bytes], pa.int64())
        self.names = pa.array([str(i) for i in range(len(vocabulary.bytes))], pa.large_string())

    def _encoded(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece, or the single id -1 if they don't spell it."""
        known, out = self._vocabulary.bytes, []
        for at in range(0, len(pieces), ENCODED):
            some = pieces[at : at + ENCODED]
            found = self._vocabulary.encode([p.decode() for p in some])
            out += [ids if b"".join([known[i] for i in ids]) == piece else [-1] for ids, piece in zip(found, some, strict=True)]
        return out


def _byte_alphabet() -> dict[str, int]:
    """Characters that byte-level vocabularies write for bytes: printable ones as they are, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def sides(folder: str, byte_file: str, piece_file: str) -> tuple[Side, Side]:
    """Both tokenizers, kept by a Python worker from task to task."""
    return Side(ByteVocabulary(f"{folder}/{byte_file}")), Side(PieceVocabulary(f"{folder}/{piece_file}"))


def _text(value: str) -> pa.Scalar:
    return pa.scalar(value, pa.large_string())


def _spaced(texts: pa.Array) -> pa.Array:
    """A space and the text; an empty string for null and empty texts."""
    texts = pc.fill_null(texts.cast(pa.large_string()), _text(""))
    return pc.if_else(pc.equal(texts, _text("")), _text(""), pc.binary_join_element_wise(_text(" "), texts, _text("")))


def _token_lists(side: Side, texts: pa.Array) -> pa.LargeListArray:
    """Ids of each text."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    found, stops, first, held = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)], 0, 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + RUN_BYTES, "right")) - 1)
        last = min(last, len(texts))
        ids, ends = side.tokens(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        found.append(ids)
        stops.append(ends + held)
        held, first = held + len(ids), last
    return pa.LargeListArray.from_arrays(pa.array(np.concatenate(stops), pa.int64()), pa.array(np.concatenate(found), pa.int32()))


def _ends(side: Side, lists: pa.LargeListArray, name: str) -> pa.Table:
    """(doc, end, id) of all tokens: end is the byte offset in the text where the token ends."""
    ids, doc = pc.list_flatten(lists), pc.list_parent_indices(lists)
    end = pc.cumulative_sum(pc.take(side.lengths, ids))
    # what the texts before have added is taken off again
    before = pc.take(pa.concat_arrays([pa.array([0], pa.int64()), end]), lists.offsets.slice(0, len(lists)))
    return pa.table({"doc": doc, "end": pc.subtract(end, pc.take(before, doc)), name: ids})


def _joined_names(names: pa.Array, ids: pa.Array, last: np.ndarray) -> pa.Array:
    """Decimal ids with commas, one string per run of ids; ``last`` marks the last id of a run."""
    stops = np.concatenate([[0], np.flatnonzero(last) + 1])
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(stops, pa.int64()), pc.take(names, ids)), _text(","))


def align(texts: pa.Array, a: Side, b: Side) -> dict[str, pa.Array]:
    """Columns per text: n_a, n_b, n_groups, n_links, groups, pairs (places in the pair table) and times; and the
    pair table: a, b and docs (texts that hold the pair). Texts without tokens have zeros and ''."""
    spaced = _spaced(texts)
    lists = [_token_lists(s, spaced) for s in (a, b)]
    # a text that either side doesn't spell has no tokens
    wrong = [np.unique(pc.list_parent_indices(x).to_numpy()[pc.list_flatten(x).to_numpy() < 0]) for x in lists]
    if any(len(w) for w in wrong):
        keep = np.ones(len(texts), dtype=bool)
        keep[np.concatenate(wrong).astype(np.int64)] = False
        spaced = pc.if_else(pa.array(keep), spaced, _text(""))
        lists = [_token_lists(s, spaced) for s in (a, b)]
    n = len(texts)
    tables = [_ends(s, x, name) for s, x, name in zip((a, b), lists, "ab", strict=True)]
    both = tables[0].join(tables[1], keys=["doc", "end"], join_type="full outer", use_threads=False)
    both = both.sort_by([("doc", "ascending"), ("end", "ascending")]).combine_chunks()
    at = {c: both[c].combine_chunks() if isinstance(both[c], pa.ChunkedArray) else both[c] for c in ("doc", "a", "b")}
    here = {c: at[c].is_valid().to_numpy(zero_copy_only=False) for c in "ab"}
    cut = here["a"] & here["b"]
    doc = at["doc"].to_numpy()
    groups = pc.binary_join_element_wise(
        _joined_names(a.names, pc.list_flatten(lists[0]), cut[here["a"]]), _joined_names(b.names, pc.list_flatten(lists[1]), cut[here["b"]]), _text("|")
    )
    group_stops = np.searchsorted(doc[cut], np.arange(n + 1))
    shown = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(group_stops, pa.int64()), groups), _text(";"))
    links = pa.table({
        "doc": at["doc"],
        "pair": pc.add(
            pc.multiply(pc.fill_null_backward(at["a"]).cast(pa.int64()), len(b.names)), pc.fill_null_backward(at["b"]).cast(pa.int64())
        ),
    })
    held = links.group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")]).sort_by("doc").combine_chunks()
    known = _whole(held["pair"]).dictionary_encode()
    place, pair = known.indices.to_numpy(), known.dictionary.to_numpy()
    stops = pa.array(np.searchsorted(_whole(held["doc"]).to_numpy(), np.arange(n + 1)), pa.int32())
    return {
        "n_a": pc.list_value_length(lists[0]), "n_b": pc.list_value_length(lists[1]),
        "n_groups": pa.array(np.diff(group_stops), pa.int64()),
        "n_links": pa.array(np.diff(np.searchsorted(doc, np.arange(n + 1))), pa.int64()), "groups": shown,
        "pairs": pa.ListArray.from_arrays(stops, known.indices.cast(pa.int32())),
        "times": pa.ListArray.from_arrays(stops, _whole(held["count_all"]).cast(pa.int32())),
        "a": pa.array((pair // len(b.names)).astype(np.int32)), "b": pa.array((pair % len(b.names)).astype(np.int32)),
        "docs": pa.array(np.bincount(place, minlength=len(pair)).astype(np.int32)),
    }


def _whole(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    """One array; a table's column may come in chunks."""
    if isinstance(column, pa.ChunkedArray):
        return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column


def _sha256(texts: pa.Array) -> pa.Array:
    """Lowercase hex digests; '' stays ''."""
    return pa.array([hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts.to_pylist()], pa.string())


def aligned_blocks(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS,
    byte_file: str = BYTE_FILE, piece_file: str = PIECE_FILE, keep_groups: bool = False, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Rows of texts (block, id, n_a, n_b, n_groups, n_links, groups, groups_sha256, pairs, times), and one row per
    block with its pair table (a, b, docs); the other columns of either are null."""
    kind = dict(docs.dtypes)[id_col]
    names = "block bigint, id " + kind + ", n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, groups_sha256 string, "
    names += "pairs array<int>, times array<int>, a array<int>, b array<int>, docs array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = sides(folder, byte_file, piece_file)
        part, number = TaskContext.get().partitionId(), 0
        ids: list[pa.Array] = []
        texts: list[pa.Array] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            found = align(pa.concat_arrays(texts), a, b)
            n, block = sum(map(len, texts)), (part << 32) + number
            groups = found.pop("groups")
            table = {k: found.pop(k) for k in ("a", "b", "docs")}
            whole = pa.array([0, len(table["a"])], pa.int32())
            lists = [pa.ListArray.from_arrays(whole, x) for x in table.values()]
            none = [pa.nulls(n, pa.list_(pa.int32()))] * 3
            shown = groups.cast(pa.string()) if keep_groups else pa.nulls(n, pa.string())
            id_type = ids[0].type
            columns = [pa.array(np.full(n, block)), pa.concat_arrays(ids), *[found[c].cast(pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")]]
            columns += [shown, _sha256(groups), found["pairs"], found["times"], *none]
            labels = ["block", "id", "n_a", "n_b", "n_groups", "n_links", "groups", "groups_sha256", "pairs", "times", "a", "b", "docs"]
            yield pa.RecordBatch.from_arrays(columns, names=labels)
            empty = [pa.nulls(1, t) for t in (id_type, *[pa.int64()] * 4, pa.string(), pa.string(), *[pa.list_(pa.int32())] * 2)]
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *empty, *lists], names=labels)
            # a worker gives back what the block has needed
            pa.default_memory_pool().release_unused()

        for batch in batches:
            text = batch.column(1).cast(pa.large_string())
            sizes = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy())
            first = 0
            while first < len(text):
                before = int(sizes[first - 1]) if first else 0
                last = max(first + 1, int(np.searchsorted(sizes, before + block_bytes - held, "right")))
                last = min(last, len(text))
                ids.append(batch.column(0).slice(first, last - first))
                texts.append(text.slice(first, last - first))
                held, first = held + int(sizes[last - 1]) - before, last
                if held >= block_bytes or first < len(text):
                    yield from flush()
                    ids, texts, held, number = [], [], 0, number + 1
        if texts:
            yield from flush()

    return docs.select(col(id_col).alias("id"), col(text_col).alias("text")).mapInArrow(run, names)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(a, b, n, best): texts of the corpus that hold the pair, and whether no pair of that a is in more."""
    counts = _tables(blocks).groupBy("a", "b").agg(F.sum("docs").alias("n"))
    counts = save_and_reload(counts, "align-counts")
    top = counts.groupBy("a").agg(F.max("n").alias("top"))
    return counts.join(top, "a").select("a", "b", "n", (F.col("n") == F.col("top")).alias("best"))


def _tables(blocks: DataFrame) -> DataFrame:
    """(block, pos, a, b, docs) from the pair tables of the blocks."""
    rows = blocks.filter("a IS NOT NULL").select("block", F.posexplode(F.arrays_zip("a", "b", "docs")).alias("pos", "x"))
    return rows.select("block", "pos", "x.a", "x.b", "x.docs")


def alignment(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS,
    byte_file: str = BYTE_FILE, piece_file: str = PIECE_FILE, keep_groups: bool = False, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Per row: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and groups if ``keep_groups``.

    n_best: links whose pair is in as many texts as the first token is with any token (ties included). count_sum: the
    pair counts over all links. groups reads ``a1,a2|b1;a3|b2,b3``, ids in order. Texts that are null or empty, or that
    one of the tokenizers doesn't spell byte by byte (U+2581 inside), have no tokens: zeros and ''. Repeated rows are texts
    of their own, null ids are ids. An empty table gives none.
    """
    blocks = save_and_reload(aligned_blocks(docs, id_col, text_col, folder, byte_file, piece_file, keep_groups, block_bytes), "align-blocks")
    counts = save_and_reload(pair_counts(blocks), "align-pairs")
    # each block's pair table again, with the totals; a block's own size bounds it
    totals = _tables(blocks).join(counts, ["a", "b"]).groupBy("block").agg(F.array_sort(F.collect_list(F.struct("pos", "n", "best"))).alias("t"))
    totals = totals.select(F.col("block").alias("home"), F.col("t.n").alias("n"), F.col("t.best").alias("best"))
    kept = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups"]
    kind = dict(blocks.dtypes)["id"]

    def score(texts: pa.Table, total: pa.Table) -> pa.Table:
        texts = texts.combine_chunks()
        pairs, times = _whole(texts["pairs"]), _whole(texts["times"])
        row, times = pc.list_parent_indices(pairs).to_numpy(), pc.list_flatten(times).to_numpy().astype(np.int64)
        sums = np.zeros((2, len(texts)), dtype=np.int64)
        if len(row):
            place = pc.list_flatten(pairs).to_numpy()
            n, best = (pc.list_flatten(_whole(total[c])).to_numpy(zero_copy_only=False) for c in ("n", "best"))
            for out, value in zip(sums, (times * best[place], times * n[place]), strict=True):
                running = np.concatenate([[0], np.cumsum(value)])
                stops = np.searchsorted(row, np.arange(len(texts) + 1))
                out[:] = running[stops[1:]] - running[stops[:-1]]
        return pa.table({c: texts[c] for c in kept} | {"n_best": pa.array(sums[0]), "count_sum": pa.array(sums[1])})

    schema = f"id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, groups string, n_best bigint, count_sum bigint"
    rows = blocks.filter("a IS NULL").select("block", *kept, "pairs", "times")
    found = rows.groupBy("block").cogroup(totals.groupBy("home")).applyInArrow(score, schema)
    wanted = [F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return found.select(*wanted, *["groups"] * keep_groups)
