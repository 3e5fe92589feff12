"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

A text becomes a sparse TF-IDF vector over a vocabulary of words and word beginnings. The
vocabulary is every term of a bounded sample of labelled texts that a chi-squared test holds for
evidence, however many, rare or common they are; document frequencies are counted over all texts. The labelled examples form an inverted index: a
posting list per term, sorted by example and cut into blocks of `BLOCK` examples, with the
largest weight of the term in each block. A text's bound for a block is the sum of its own
weights times these maxima; blocks are scored in the order of their bounds, some at a time, until
a bound is no better than the k-th neighbour found, so the neighbours are exact. Neighbours vote with
their cosine as weight, and the share of toxic examples among those without evidence is mixed in,
which keeps the score a probability.

The examples are bounded by a parameter and the vocabulary by their words, so the index is a few
MB whatever the size of the table, and is broadcast. Texts stay where they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from citestat.llm.classifier import labelled_sample
from citestat.llm.common import col
from citestat.llm.words import Run, mixed, runs
from citestat.session import save_and_reload

#: Labelled examples in the index, at most.
MAX_EXAMPLES = 8000
#: Chi-squared below this is no evidence: chance alone reaches it once in two million terms.
LEAST_CHI2 = 25.0
#: Beginnings of words, in bytes, that are terms beside the words themselves.
PREFIXES = (4, 5, 6)
BLOCK = 64
#: Blocks scored together at first; each further lot is twice as large.
FIRST_LOT = 4
NEIGHBOURS = 15
#: Weight of the prior in a vote, in units of a neighbour with cosine 1.
PRIOR = 0.5

_PLACES = 1 << 16


def _terms(run: Run) -> list[np.ndarray]:
    """Hashes of the words and of their beginnings; a beginning counts only if the word is longer."""
    size = run.ends - run.starts
    out = [mixed(run.hashes() ^ np.uint64(1))]
    for n in PREFIXES:
        h = mixed(run.hashes(n) ^ np.uint64(n))
        h[size <= n] = 0
        out.append(h)
    return out


class Vocabulary:
    """Terms by hash; ``counts`` gives the (text, term, times) triples of a run."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)
        self.place = np.zeros(_PLACES, dtype=bool)
        self.place[(self.hashes & np.uint64(_PLACES - 1)).astype(np.int64)] = True

    def counts(self, run: Run) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(self.hashes)
        owner = np.repeat(np.arange(len(run.bounds) - 1), np.diff(run.bounds))
        keys = []
        for h in _terms(run):
            maybe = np.flatnonzero(self.place[(h & np.uint64(_PLACES - 1)).astype(np.int64)])
            at = np.searchsorted(self.hashes, h[maybe])
            at[at == n] = 0
            known = self.hashes[at] == h[maybe] if n else np.zeros(0, dtype=bool)
            keys.append(owner[maybe[known]] * max(n, 1) + at[known])
        key, times = np.unique(np.concatenate(keys), return_counts=True)
        return key // max(n, 1), key % max(n, 1), times


class Index(NamedTuple):
    """Block-max inverted index of the examples that have a term; ``plain`` is the score of a text without any."""

    vocabulary: Vocabulary
    idf: np.ndarray
    ids: np.ndarray
    toxic: np.ndarray
    pointers: np.ndarray  # (terms, blocks + 1): where a term's postings of a block begin
    postings: np.ndarray  # example numbers, by term and example
    weights: np.ndarray
    block_max: np.ndarray  # (terms, blocks)
    plain: float
    prior: float

    def nearest(self, terms: np.ndarray, weights: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Examples and cosines of the ``k`` nearest with a positive cosine; ties by example."""
        best = np.zeros(0, dtype=np.int64)
        cosine = np.zeros(0)
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > 1e-9]
        at, size = 0, FIRST_LOT
        while at < len(order):
            lot = order[at : at + size]
            at, size = at + size, 2 * size
            if len(best) == k:
                lot = lot[bounds[lot] >= cosine[-1] - 1e-6]
                if not len(lot):
                    break
            scores = self._scores(terms, weights, lot)
            found = np.flatnonzero(scores > 1e-9)
            if len(found) > k:
                found = found[scores[found] >= np.partition(scores[found], len(found) - k)[len(found) - k]]
            best = np.concatenate([best, lot[found // BLOCK] * BLOCK + found % BLOCK])
            cosine = np.concatenate([cosine, scores[found]])
            first = np.lexsort((best, -cosine))[:k]
            best, cosine = best[first], cosine[first]
        return best, cosine

    def _scores(self, terms: np.ndarray, weights: np.ndarray, lot: np.ndarray) -> np.ndarray:
        """Cosines with the examples of the blocks of ``lot``, block by block."""
        begin = self.pointers[terms[:, None], lot]
        n = (self.pointers[terms[:, None], lot + 1] - begin).ravel()
        spots = np.repeat(begin.ravel() - (np.cumsum(n) - n), n) + np.arange(n.sum())
        shift = np.tile((np.arange(len(lot)) - lot) * BLOCK, len(terms))
        own = np.repeat(np.repeat(weights, len(lot)), n)
        return np.bincount(
            self.postings[spots] + np.repeat(shift, n), own * self.weights[spots], minlength=len(lot) * BLOCK
        )


def _unit(owner: np.ndarray, term: np.ndarray, times: np.ndarray, idf: np.ndarray, n: int) -> np.ndarray:
    weight = (1 + np.log(times)) * idf[term]
    norm = np.sqrt(np.bincount(owner, weight * weight, minlength=n))
    return weight / np.maximum(norm[owner], 1e-300)


def _choose_terms(sample: DataFrame) -> np.ndarray:
    """Hashes of all terms that tell the labels of the sample apart."""
    def spread_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False)
            for run in runs(batch.column(0)):
                n = len(run.bounds) - 1
                owner = np.repeat(np.arange(n), np.diff(run.bounds))
                hashes = np.concatenate(_terms(run))
                pairs = np.stack([hashes, np.tile(owner, 1 + len(PREFIXES)).astype(np.uint64)])
                pairs = np.unique(pairs[:, hashes != 0], axis=1)
                term, where = np.unique(pairs[0], return_inverse=True)
                toxic = label[run.first + pairs[1].astype(np.int64)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(term.view(np.int64)), pa.array(np.bincount(where, minlength=len(term))),
                     pa.array(np.bincount(where, toxic, minlength=len(term)))], names=["term", "n", "toxic"],
                )

    # copies of a text are one example here, or a copied text's words would fill the vocabulary
    sample = sample.groupBy("text", "label").agg(F.count(F.lit(1)).alias("n")).select("text", "label")
    total, positive = sample.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not total or not positive or positive == total:
        return np.zeros(0, dtype=np.uint64)
    a, n = F.col("toxic"), F.col("n")
    b, c, d = n - a, F.lit(float(positive)) - a, F.lit(float(total - positive)) - (n - a)
    chi2 = F.lit(float(total)) * (a * d - b * c) ** 2 / (n * (c + d) * F.lit(float(positive)) * F.lit(float(total - positive)))
    ranked = (
        sample.select("text", "label").mapInArrow(spread_out, "term bigint, n bigint, toxic double")
        .groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
        .filter(n < F.lit(int(total))).withColumn("chi2", chi2).filter(F.col("chi2") >= LEAST_CHI2).select("term")
    )
    # no more than the sample's own words and beginnings
    return np.array([r["term"] for r in ranked.collect()], dtype=np.int64).view(np.uint64)


def _document_frequency(texts: DataFrame, vocabulary: Vocabulary) -> tuple[int, np.ndarray]:
    """Number of texts, and of texts with each term, over the whole table."""
    size = len(vocabulary.hashes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, having = 0, np.zeros(size, dtype=np.int64)
        for batch in batches:
            n += batch.num_rows
            for run in runs(batch.column(0)):
                having += np.bincount(vocabulary.counts(run)[1], minlength=size)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(-1, size)), pa.array(np.concatenate([[n], having]))], names=["term", "n"]
        )

    # one row per term
    rows = texts.mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = {r["term"]: r["n"] for r in rows}
    return found.get(-1, 0), np.array([found.get(t, 0) for t in range(size)], dtype=np.int64)


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    examples: int = MAX_EXAMPLES,
) -> Index:
    """Index of at most ``examples`` labelled texts; document frequencies cover all ``docs``.

    Without labels the index is empty and every score is one half.
    """
    sample = save_and_reload(labelled_sample(docs, labels, id_col, text_col, label_col, examples), "toxicity-sample")
    vocabulary = Vocabulary(_choose_terms(sample))
    n_terms = len(vocabulary.hashes)
    n_docs, having = _document_frequency(docs.select(col(text_col).alias("text")), vocabulary)
    idf = np.log((1 + n_docs) / (1 + having)) + 0.1

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in runs(batch.column(2)):
                n = len(run.bounds) - 1
                owner, term, times = vocabulary.counts(run)
                ends = np.searchsorted(owner, np.arange(n + 1))
                part = batch.slice(run.first, n)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(term)),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(times))],
                    names=["id", "label", "terms", "times"],
                )

    kind = dict(sample.dtypes)["id"]
    # at most ``examples`` rows, of their own terms
    rows = sample.select("id", "label", "text").mapInArrow(
        vectors, f"id {kind}, label double, terms array<bigint>, times array<bigint>"
    ).collect()
    labels_all = np.array([r["label"] for r in rows])
    prior = (labels_all.sum() + 1) / (len(rows) + 2)
    bare = np.array([r["label"] for r in rows if not r["terms"]])
    plain = (bare.sum() + prior) / (len(bare) + 1)
    # alike examples side by side make tight block bounds
    rows = sorted((r for r in rows if r["terms"]), key=lambda r: (r["label"], max(r["terms"], key=lambda t: (idf[t], t)), r["id"]))
    n, blocks = len(rows), -(-len(rows) // BLOCK)
    owner = np.repeat(np.arange(n), [len(r["terms"]) for r in rows]).astype(np.int64)
    term = np.array([t for r in rows for t in r["terms"]], dtype=np.int64)
    times = np.array([t for r in rows for t in r["times"]], dtype=np.int64)
    weight = _unit(owner, term, times, idf, n) if n else np.zeros(0)
    order = np.lexsort((owner, term))
    owner, term, weight = owner[order], term[order], weight[order]
    places = (np.arange(n_terms)[:, None] * (blocks + 1) + np.arange(blocks + 1)[None, :]).ravel()
    pointers = np.searchsorted(term * (blocks + 1) + owner // BLOCK, places).reshape(n_terms, blocks + 1)
    block_max = np.zeros((n_terms, blocks))
    np.maximum.at(block_max, (term, owner // BLOCK), weight)
    return Index(
        vocabulary, idf, np.array([r["id"] for r in rows]), np.array([r["label"] for r in rows]), pointers, owner, weight,
        block_max, float(plain), float(prior),
    )


def scored(
    docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text", k: int = NEIGHBOURS, prior: float = PRIOR
) -> DataFrame:
    """(id, score, evidence) per row; evidence lists all neighbours that voted, with their cosine and label.

    A text without any term, null and empty texts included, has the share of toxic examples among
    examples without terms as its score, and no evidence. Repeated rows are scored one by one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(index)
    empty_vote = prior * index.prior

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        for batch in batches:
            for run in runs(batch.column(1)):
                n = len(run.bounds) - 1
                owner, term, times = ix.vocabulary.counts(run)
                weight = _unit(owner, term, times, ix.idf, n)
                ends = np.searchsorted(owner, np.arange(n + 1))
                scores = np.full(n, ix.plain)
                voted, votes, n_votes = [np.zeros(0, dtype=np.int64)], [np.zeros(0)], np.zeros(n + 1, dtype=np.int32)
                for i in np.flatnonzero(np.diff(ends)):
                    part = slice(ends[i], ends[i + 1])
                    bounds = weight[part] @ ix.block_max[term[part]]
                    best, cosine = ix.nearest(term[part], weight[part], bounds, k)
                    scores[i] = (cosine @ ix.toxic[best] + empty_vote) / (cosine.sum() + prior)
                    voted.append(best)
                    votes.append(cosine)
                    n_votes[i + 1] = len(best)
                who = np.concatenate(voted)
                neighbours = pa.StructArray.from_arrays(
                    [pa.array(ix.ids[who].astype(np.int64)), pa.array(np.concatenate(votes)), pa.array(ix.toxic[who].astype(np.int32))],
                    fields=list(_NEIGHBOUR),
                )
                evidence = pa.ListArray.from_arrays(pa.array(np.cumsum(n_votes, dtype=np.int32)), neighbours)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(run.first, n), pa.array(scores), evidence],
                    names=["id", "score", "evidence"],
                )

    kind = dict(docs.dtypes)[id_col]
    return docs.select(col(id_col).alias("id"), col(text_col).alias("text")).mapInArrow(
        vote, f"id {kind}, score double, evidence array<struct<example:bigint,cosine:double,label:int>>"
    )


_NEIGHBOUR = pa.struct([("example", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())])
