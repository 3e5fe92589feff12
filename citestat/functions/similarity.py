"""Similarity of two short texts."""

from __future__ import annotations

import sys
from os.path import commonprefix

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F, types as T

from citestat.functions.text import clean_text, extract_year

# ship the small helpers with the task, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# bits of a word, the top one is for the carry
WORD = 63
FULL = np.uint64((1 << WORD) - 1)
# words of a batch, most entries of its table; fewer words than the last are treated pair by pair
BATCH_WORDS = 4096
BATCH_CELLS = 4_000_000
SMALL_BATCH = 200


def levenshtein_similarity(a: Column | str, b: Column | str) -> Column:
    """``1 - distance / longer length`` on cleaned lower-case texts; 0 if either is empty."""
    x, y = F.lower(clean_text(a)), F.lower(clean_text(b))
    sim = F.lit(1.0) - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y))
    return F.coalesce(sim, F.lit(0.0))


def year_match(a: Column | str, b: Column | str) -> Column:
    """True when both texts hold a year and it is the same."""
    return F.coalesce(extract_year(a) == extract_year(b), F.lit(False))


def same_slot(a, b) -> Column:
    """Same year and the same volume, issue and page; two empty fields count as the same.

    ``a`` and ``b`` map a field name to a Column.
    """
    same = year_match(a("pub_date"), b("pub_date"))
    for field in ("volume", "issue", "page"):
        same = same & clean_text(a(field)).eqNullSafe(clean_text(b(field)))
    return same


def char_masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    bit = 1
    for ch in pattern:
        masks[ch] = masks.get(ch, 0) | bit
        bit <<= 1
    return masks


def edit_distance(a: str, b: str, limit: int | None = None) -> int:
    """Bit-parallel edit distance; gives up with ``limit + 1`` once it must exceed ``limit``."""
    if a == b:
        return 0
    width, rest = len(a), len(b)
    limit = max(width, rest) if limit is None else limit
    full, top = (1 << width) - 1, 1 << (width - 1)
    masks = char_masks(a)
    plus, minus, score = full, 0, width
    for ch in b:
        eq = masks.get(ch, 0)
        diag = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | (full & ~(diag | plus)), plus & diag
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        rest -= 1
        if score - rest > limit:
            return limit + 1
        up, down = ((up << 1) | 1) & full, (down << 1) & full
        vertical = eq | minus
        plus, minus = down | (full & ~(vertical | up)), up & vertical
    return score


def _whole_distance(a: str, b: str) -> int:
    """Edit distance without a limit; a common beginning and a common end cost nothing."""
    start = len(commonprefix((a, b)))
    a, b = a[start:], b[start:]
    end = len(commonprefix((a[::-1], b[::-1])))
    a, b = a[: len(a) - end], b[: len(b) - end]
    if not a or not b:
        return len(a) + len(b)
    # one step per character of the shorter text
    return edit_distance(a, b) if len(a) >= len(b) else edit_distance(b, a)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _similarities(texts: pd.Series, others: pd.Series) -> pd.Series:
    known: dict[tuple[str, str], float] = {}

    def similarity(a: str | None, b: str | None) -> float:
        if a is None or b is None:
            return 0.0
        if (a, b) not in known:
            known[a, b] = 1.0 - _whole_distance(a, b) / max(len(a), len(b))
        return known[a, b]

    return pd.Series([None if row is None else [similarity(a, b) for b in row] for a, row in zip(texts, others)], dtype=object)


def levenshtein_similarities(text: Column | str, others: Column) -> Column:
    """`levenshtein_similarity` of a text and each text of an array, as an array.

    For long texts: a step treats a character against a whole text. Called non-deterministic, as a plan
    may repeat other expressions wherever their result is used.
    """
    cleaned = F.transform(others, lambda o: F.lower(clean_text(o)))
    return _similarities.asNondeterministic()(F.lower(clean_text(text)), cleaned)


def common_subsequence(masks: dict[str, int], width: int, text: str) -> int:
    """Length of the longest common subsequence, one machine-wide addition per character."""
    full = (1 << width) - 1
    state = full
    for m in map(masks.get, text):
        if m:
            u = state & m
            state = ((state + u) | (state - u)) & full
    return width - state.bit_count()


def common_subsequences(a: list[str], b: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of many pairs of texts.

    Pairs of like length go together as columns of words, the bits of the shorter texts. One step treats a
    character of the longer texts; a word is one step behind the word before it, whose carry it takes, so
    all words of all pairs change together.
    """
    out = np.zeros(len(a), dtype=np.int64)
    pairs = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b)]
    words = [-(-len(x) // WORD) for x, _ in pairs]
    order = sorted((i for i, w in enumerate(words) if w), key=lambda i: (words[i], len(pairs[i][1])))
    done = 0
    while done < len(order):
        n = 1
        while done + n < len(order) and words[order[done + n]] * (n + 1) <= BATCH_WORDS:
            n += 1
        batch = order[done:done + n]
        done += n
        if n * words[batch[-1]] < SMALL_BATCH:
            for i in batch:
                x, y = pairs[i]
                # one addition per character of the shorter text
                out[i] = common_subsequence(char_masks(y), len(y), x)
        else:
            out[batch] = _common_batch([pairs[i][0] for i in batch], [pairs[i][1] for i in batch])
    return out


def _common_batch(short: list[str], long: list[str]) -> np.ndarray:
    n, words, steps = len(short), -(-max(map(len, short)) // WORD), max(map(len, long))
    points = [[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in side] for side in (short, long)]
    used = np.zeros(0x110000, dtype=bool)
    for side in points:
        for p in side:
            used[p] = True
    # code 0 stands outside a text and matches nothing
    code = np.cumsum(used)
    alphabet = int(code[-1]) + 1
    if n > 1 and n * alphabet * words > BATCH_CELLS:
        half = n // 2
        return np.concatenate([_common_batch(short[:half], long[:half]), _common_batch(short[half:], long[half:])])
    bits = np.zeros((words * WORD, n), dtype=np.int64)
    place = np.zeros((words - 1 + steps + words - 1, n), dtype=np.int64)
    for k in range(n):
        bits[: len(short[k]), k] = code[points[0][k]]
        place[words - 1 : words - 1 + len(long[k]), k] = code[points[1][k]]
    column, row = np.arange(n) * alphabet, np.arange(words)[:, None] * (n * alphabet)
    place += column
    masks = np.zeros(words * n * alphabet, dtype=np.uint64)
    for bit in range(WORD):
        masks[bits[bit::WORD] + column + row] |= np.uint64(1 << bit)
    masks[column + row] = 0
    state = np.full((words, n), FULL)
    carry = np.zeros((words + 1, n), dtype=np.uint64)
    match, both, index = np.empty_like(state), np.empty_like(state), np.empty((words, n), dtype=np.int64)
    for t in range(words - 1, len(place)):
        np.add(place[t - words + 1 : t + 1][::-1], row, out=index)
        np.take(masks, index, out=match, mode="clip")
        np.bitwise_and(state, match, out=both)
        np.add(state, both, out=match)
        np.add(match, carry[:-1], out=match)
        np.right_shift(match, WORD, out=carry[1:])
        np.bitwise_xor(state, both, out=state)
        np.bitwise_or(state, match, out=state)
        np.bitwise_and(state, FULL, out=state)
    return words * WORD - np.bitwise_count(state).sum(axis=0, dtype=np.int64)


class PackedTexts:
    """Texts side by side in one number, to meet other texts all at once.

    A bit between two texts takes the carry. The masks are made once, so a character of another text costs
    five operations on the whole number, whatever the number of texts.
    """

    def __init__(self, texts: list[str]):
        points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        ends = np.cumsum([len(p) + 1 for p in points])
        self.size, self.lengths = int(ends[-1]), np.array([len(p) for p in points], dtype=np.int64)
        self.starts = ends - self.lengths - 1
        codes, inside = np.zeros(self.size, dtype=np.uint32), np.ones(self.size, dtype=bool)
        inside[ends - 1] = False
        codes[inside] = np.concatenate(points)
        self.full = self._number(inside)
        self.masks = {chr(c): self._number(inside & (codes == c)) for c in np.unique(codes[inside])}

    @staticmethod
    def _number(bits: np.ndarray) -> int:
        return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")

    def common(self, text: str) -> np.ndarray:
        """Length of the longest common subsequence of ``text`` and each of the texts."""
        state = full = self.full
        for m in map(self.masks.get, text):
            if m:
                u = state & m
                state = ((state + u) | (state ^ u)) & full
        left = np.frombuffer(state.to_bytes(-(-self.size // 8), "little"), np.uint8)
        left = np.unpackbits(left, bitorder="little", count=self.size)
        return self.lengths - np.add.reduceat(left, self.starts, dtype=np.int64)


def ratios_from_common(common: np.ndarray, total: np.ndarray) -> np.ndarray:
    """0-100 similarity; ``total`` holds the lengths of both texts together, 0 gives 100."""
    return np.where(total == 0, 100.0, (1.0 - (total - 2 * common) / np.maximum(total, 1)) * 100.0)


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """0-100 similarity by insertions and deletions: ``200 * LCS / (len a + len b)``."""
    both = (a.notna() & b.notna()).to_numpy()
    x, y = a[both].tolist(), b[both].tolist()
    total = np.array([len(p) + len(q) for p, q in zip(x, y)], dtype=np.int64)
    out = np.full(len(a), np.nan)
    out[both] = ratios_from_common(common_subsequences(x, y), total)
    return pd.Series(out).astype("object").where(both, None)


def indel_ratio_native(a: Column | str, b: Column | str) -> Column:
    """The same ratio from Spark expressions only: a fold over the characters of ``b``.

    Quadratic in the text length and without Python; meant for short texts and for checks.
    """
    x = F.col(a) if isinstance(a, str) else a
    y = F.col(b) if isinstance(b, str) else b
    xs = F.filter(F.split(x, ""), lambda ch: ch != "")
    ys = F.filter(F.split(y, ""), lambda ch: ch != "")

    def next_row(row: Column, ch: Column) -> Column:
        # row[i] = LCS of the first i characters of a with the characters of b seen so far
        start = F.array(F.lit(0))
        return F.aggregate(
            F.sequence(F.lit(1), F.size(xs)),
            start,
            lambda acc, i: F.concat(
                acc,
                F.array(
                    F.when(F.element_at(xs, i) == ch, F.element_at(row, i) + 1).otherwise(
                        F.greatest(F.element_at(row, i + 1), F.element_at(acc, -1))
                    )
                ),
            ),
        )

    zero = F.array_repeat(F.lit(0), F.size(xs) + 1)
    last = F.aggregate(ys, zero, next_row)
    total = F.length(x) + F.length(y)
    lcs = F.when((F.length(x) > 0) & (F.length(y) > 0), F.element_at(last, -1)).otherwise(0)
    return F.when(total == 0, 100.0).otherwise((1.0 - (total - 2 * lcs) / total) * 100.0)
