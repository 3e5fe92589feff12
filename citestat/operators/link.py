"""Record linkage of two article sources in four stages, and the master table.

Stages: same DOI in a venue, same title and year in a venue, fuzzy title in a venue and
year, pairs confirmed by hand. Row order is the article id on both sides.

Exact stages never build the pairs of a key: the only pairs that can survive one-to-one
resolution involve the first right-hand row of a key, so the right side is reduced to it
before the join.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window as W, functions as F

from citestat.functions import text as X
from citestat.functions.similarity import PackedTexts, common_subsequences, ratios_from_common
from citestat.operators.selection import first_match, manually_accepted
from citestat.operators.tables import one_to_one, union_all
from citestat.session import result_only, save_and_reload, spread, sweep

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FUZZY_THRESHOLD = 96.0
MIN_GAP_TO_SECOND = 3.0
NO_SECOND = -999.0
# titles and characters of a tile; scoring a tile pair takes time with the product of the characters
TILE = 4000
TILE_CHARS = 100_000
# with a floor nearly all pairs fall to their bounds, so larger tiles take no longer, and titles travel to fewer of them
WIDE_CHARS = 1_000_000
# pairs of titles whose bounds a task holds at once
SLAB = 200_000
# a title whose open partners hold this share of a tile's characters meets the whole tile at once
WHOLE_SHARE = 0.25
# share of the left-hand titles whose beginnings bound the score where there is a floor
PREFIX = 0.25
# lengths grow by this factor from class to class; classes this near are scored first
LENGTH_STEP = 1.25
NEAR = 3
# bounds are allowed this much above the exact value, so that rounding loses no candidate
ROUNDING = 1e-9
MATCH_PRIORITY = {
    "doi_exact": 1, "title_exact_year": 2, "manual_confirmed": 3, "title_fuzzy_year_auto": 4,
}

A_COLUMNS = [
    "article_id_oc", "venue_internal_id", "venue_name_oc", "title_oc", "title_norm", "doi_raw",
    "doi_norm", "year", "pub_date_oc", "citedby_count_oc",
]
B_COLUMNS = [
    "article_id_scopus", "venue_internal_id", "venue_name_scopus", "title_scopus", "title_norm",
    "doi_raw_scopus", "doi_norm", "year", "pub_date_scopus", "citedby_count_scopus",
]
MATCH_COLUMNS = [
    "article_id_oc", "article_id_scopus", "venue_internal_id", "venue_name_oc",
    "venue_name_scopus", "title_oc", "title_scopus", "title_norm_oc", "title_norm_sc", "doi_raw",
    "doi_raw_scopus", "doi_norm", "year_oc", "year_sc", "pub_date_oc", "pub_date_scopus",
    "citedby_count_oc", "citedby_count_scopus", "match_method", "fuzzy_score",
]


def _compact(prepared: DataFrame, title: str) -> DataFrame:
    """Digests in place of the titles: equal texts have equal digests."""
    return prepared.withColumns({title: F.md5(title), "title_norm": F.sha2("title_norm", 256)})


def _distinct(rows: DataFrame, title: str, digests: bool) -> DataFrame:
    """Distinct ``rows`` with ``title_norm``, which follows from the title, so whole texts are shuffled without it."""
    norm = X.normalize_title(title)
    if digests:
        return _compact(rows.withColumn("title_norm", norm), title).distinct()
    return rows.distinct().withColumn("title_norm", norm)


def prepare_a(articles: DataFrame, digests: bool = False) -> DataFrame:
    """Open-index articles: keys normalised, counts to 0, exact duplicates out.

    ``digests`` puts the MD5 of the title and the SHA-256 of the normalised one in their places, before
    anything is shuffled. The exact stages match the same articles by them; fuzzy titles need the texts.
    """
    doi = X.extract_doi("id")
    rows = articles.select(
        F.col("article_omid").alias("article_id_oc"),
        "venue_internal_id",
        F.col("venue_name").alias("venue_name_oc"),
        F.col("title").alias("title_oc"),
        doi.alias("doi_raw"),
        X.normalize_doi(doi).alias("doi_norm"),
        X.safe_year("pub_date").alias("year"),
        F.col("pub_date").alias("pub_date_oc"),
        X.number_or_zero("citedby_count").alias("citedby_count_oc"),
        "id",
    )
    return _distinct(rows, "title_oc", digests).select(*A_COLUMNS, "id")


def prepare_b(articles: DataFrame, digests: bool = False) -> DataFrame:
    """Second-index articles in the same form."""
    rows = articles.select(
        F.col("eid").alias("article_id_scopus"),
        "venue_internal_id",
        F.col("publication_name").alias("venue_name_scopus"),
        F.col("title").alias("title_scopus"),
        F.col("doi").alias("doi_raw_scopus"),
        X.normalize_doi("doi").alias("doi_norm"),
        X.safe_year("cover_date").alias("year"),
        F.col("cover_date").alias("pub_date_scopus"),
        X.number_or_zero("citedby_count").alias("citedby_count_scopus"),
    )
    return _distinct(rows, "title_scopus", digests).select(*B_COLUMNS)


def _standard(pairs: DataFrame, method: str) -> DataFrame:
    """(a struct, b struct, fuzzy_score) to the common match layout."""
    a, b = F.col("a"), F.col("b")
    return pairs.select(
        a["article_id_oc"].alias("article_id_oc"),
        b["article_id_scopus"].alias("article_id_scopus"),
        F.coalesce(a["venue_internal_id"], b["venue_internal_id"]).alias("venue_internal_id"),
        a["venue_name_oc"].alias("venue_name_oc"),
        b["venue_name_scopus"].alias("venue_name_scopus"),
        a["title_oc"].alias("title_oc"),
        b["title_scopus"].alias("title_scopus"),
        a["title_norm"].alias("title_norm_oc"),
        b["title_norm"].alias("title_norm_sc"),
        a["doi_raw"].alias("doi_raw"),
        b["doi_raw_scopus"].alias("doi_raw_scopus"),
        F.coalesce(a["doi_norm"], b["doi_norm"]).alias("doi_norm"),
        a["year"].alias("year_oc"),
        b["year"].alias("year_sc"),
        a["pub_date_oc"].alias("pub_date_oc"),
        b["pub_date_scopus"].alias("pub_date_scopus"),
        a["citedby_count_oc"].alias("citedby_count_oc"),
        b["citedby_count_scopus"].alias("citedby_count_scopus"),
        F.lit(method).alias("match_method"),
        F.col("fuzzy_score").cast("double").alias("fuzzy_score"),
    )


def _struct_a(a: DataFrame) -> F.Column:
    return F.struct(*[a[c] for c in A_COLUMNS])


def match_exact(a: DataFrame, b: DataFrame, keys: Sequence[str], method: str,
                legacy_null_match: bool = False) -> DataFrame:
    """One-to-one matches on equal keys.

    A missing key matches nothing. ``legacy_null_match`` lets missing keys match each
    other, for comparison with tools whose joins do so.
    """
    if not legacy_null_match:
        a, b = a.dropna(subset=list(keys)), b.dropna(subset=list(keys))
    first_b = b.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(
        F.min_by(F.struct(*B_COLUMNS), "article_id_scopus").alias("b")
    )
    cond = F.lit(True)
    for k in keys:
        same = a[k].eqNullSafe(F.col(f"_{k}")) if legacy_null_match else a[k] == F.col(f"_{k}")
        cond = cond & same
    pairs = a.join(first_b, cond).select(
        a["article_id_oc"].alias("id_a"),
        F.col("b.article_id_scopus").alias("id_b"),
        _struct_a(a).alias("a"), "b",
        F.lit(None).cast("double").alias("fuzzy_score"),
    )
    return _standard(one_to_one(pairs, "id_a", "id_b", ["id_a", "id_b"]), method)


def match_doi(a: DataFrame, b: DataFrame, legacy_null_match: bool = False) -> DataFrame:
    return match_exact(a, b, ["venue_internal_id", "doi_norm"], "doi_exact", legacy_null_match)


def match_title_year(a: DataFrame, b: DataFrame, legacy_null_match: bool = False) -> DataFrame:
    return match_exact(
        a, b, ["venue_internal_id", "title_norm", "year"], "title_exact_year", legacy_null_match
    )


def without_matched(a: DataFrame, b: DataFrame, *matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of both sides that no earlier stage has matched."""
    for m in matches:
        a = a.join(m.select("article_id_oc"), "article_id_oc", "left_anti")
        b = b.join(m.select("article_id_scopus"), "article_id_scopus", "left_anti")
    return a, b


def _tile_scorer(floor: float):
    """Two best right-hand titles, of at least ``floor`` and the row's ``known``, per left-hand title of a tile.

    The characters two titles share bound their common subsequence; with a floor, their beginnings do so as well. A
    title with many open partners meets all titles of the tile at once. Of the others the pairs of highest bound are
    scored first, and then those whose bound reaches the second best score found.
    """
    letters = "abcdefghijklmnopqrstuvwxyz0123456789 "
    code = np.zeros(128, dtype=np.int64)
    code[[ord(ch) for ch in letters]] = np.arange(1, len(letters) + 1)

    def bags(titles: list[str]) -> np.ndarray:
        counted = [np.bincount(code[np.frombuffer(t.encode(), np.uint8)], minlength=len(letters) + 1) for t in titles]
        return np.stack(counted).astype(np.int32)

    def lower_by_prefix(bound: np.ndarray, total: np.ndarray, left: list[str], right: list[str]) -> None:
        """What the beginning of a title can keep, with all of the rest, bounds the score.

        A score of ``floor`` leaves room for so many insertions, and the beginning meets no more than these
        and its own length of the other title. Bounds below the floor may come out lower than they are.
        """
        open_ = bound >= floor
        if not open_.any():
            return
        n = np.array([len(t) for t in left])
        inserted = ((1.0 - floor / 100.0) * total + total - 2 * n[:, None]) / 2
        first = int(np.ceil(PREFIX * n.max()))
        width = first + int(np.ceil(inserted[open_].max())) + 1
        met = np.flatnonzero(open_.any(axis=0))
        packed = PackedTexts([right[j][:width] for j in met])
        for i in np.flatnonzero(open_.any(axis=1)):
            common = packed.common(left[i][:first]) + max(0, len(left[i]) - first)
            bound[i, met] = np.minimum(bound[i, met], ratios_from_common(common, total[i, met]))

    def scores(left: list[str], right: list[str], least: np.ndarray, bags_r: np.ndarray, packed) -> np.ndarray:
        """Score of every pair that may be among the two best of its left-hand title; -1 for the others."""
        length = np.array([len(t) for t in right])
        total = np.array([len(t) for t in left])[:, None] + length[None, :]
        shared = np.stack([np.minimum(bags_r, own).sum(axis=1) for own in bags(left)])
        bound = ratios_from_common(shared, total)
        if floor > 0:
            lower_by_prefix(bound, total, left, right)
        found = np.full(bound.shape, -1.0)
        whole = ((bound >= least[:, None]) @ length) > WHOLE_SHARE * length.sum()
        if whole.any():
            mine = np.flatnonzero(whole)
            if sum(len(left[i]) for i in mine) > length.sum():
                # more characters on the left: those titles lie side by side and the others pass along them
                side = PackedTexts([left[i] for i in mine])
                common = np.stack([side.common(t) for t in right], axis=1)
            else:
                common = np.stack([packed().common(left[i]) for i in mine])
            found[mine] = ratios_from_common(common, total[mine])
        few = np.flatnonzero(~whole)
        if not len(few):
            return found
        order = np.argsort(-bound[few], axis=1, kind="stable")
        done = 0
        for upto in (2, 8, len(right)):
            upto = min(upto, len(right))
            rows = np.repeat(np.arange(len(few)), upto - done)
            cols = order[:, done:upto].ravel()
            limit = least[few] if done < 2 else np.maximum(least[few], np.partition(found[few], -2, axis=1)[:, -2])
            open_ = bound[few[rows], cols] >= limit[rows]
            rows, cols = few[rows[open_]], cols[open_]
            common = common_subsequences([left[i] for i in rows], [right[j] for j in cols])
            found[rows, cols] = ratios_from_common(common, total[rows, cols])
            done = upto
        return found

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            titles = right["title_norm"].tolist()
            ids, copies = right["first_id"].tolist(), right["copies"].tolist()
            bags_r, made = bags(titles), []

            def packed() -> PackedTexts:
                if not made:
                    made.append(PackedTexts(titles))
                return made[0]

            step = max(1, SLAB // len(titles))
            # titles of like length meet the same ones
            left = left.loc[left["title_norm"].str.len().sort_values(kind="stable").index]
            for start in range(0, len(left), step):
                part = left.iloc[start:start + step]
                least = np.maximum(floor, part["known"].to_numpy())
                found = scores(part["title_norm"].tolist(), titles, least, bags_r, packed)
                for key, low, row in zip(part["title_id"], least, found):
                    if len(titles) > 2:
                        low = max(low, np.partition(row, -2)[-2])
                    best = sorted((-float(row[j]), ids[j], copies[j]) for j in np.flatnonzero(row >= low))
                    out += [(key, -s, i, c) for s, i, c in best[:2]]
        return pd.DataFrame(out, columns=["title_id", "score", "first_id", "copies"])

    return run


def _length_tiles(titles: DataFrame, tile: int, tile_chars: int, name: str) -> tuple[DataFrame, DataFrame]:
    """Titles with length class and part, and one row per class of a block: parts, shortest and longest length.

    Both stem from saved tables, so that Spark knows the size of the classes and need not shuffle the texts to meet them.
    """
    keys = ["venue_internal_id", "year"]
    length = F.length("title_norm")
    classed = titles.withColumns(
        {"n": length, "cls": F.floor(F.log(F.greatest(length, F.lit(1))) / F.log(F.lit(LENGTH_STEP))).cast("int")}
    )
    classed = save_and_reload(classed, f"fuzzy-{name}")
    classes = classed.groupBy(*keys, "cls").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / tile), F.ceil(F.sum("n") / tile_chars)).cast("int").alias("parts"),
        F.min("n").alias("shortest"), F.max("n").alias("longest"),
    )
    classes = save_and_reload(classes, f"fuzzy-classes-{name}")
    parts = classes.select(*keys, "cls", "parts")
    placed = classed.join(parts, [*keys, "cls"]).withColumn("part", F.pmod(F.xxhash64("title_norm"), "parts").cast("int"))
    return placed.drop("parts"), classes


def _two_best(scored: DataFrame) -> DataFrame:
    w = W.partitionBy("title_id").orderBy(F.desc("score"), F.asc("first_id"))
    return scored.withColumn("place", F.row_number().over(w)).filter("place <= 2")


def fuzzy_candidates(a: DataFrame, b: DataFrame, tile: int = TILE, floor: float = 0.0,
                     tile_chars: int | None = None) -> DataFrame:
    """Best and second best title of the other source in the same venue and year, per A row.

    ``floor`` leaves out candidates that score less. Automatic matches stay the same for any
    floor up to threshold minus gap; the review queue needs floor 0.

    Copies of a title are scored once. Titles of a block lie in classes of similar length, cut
    into tiles of about ``tile`` titles or ``tile_chars`` characters (larger ones with a floor). Near classes are scored
    first. A title then meets a tile of the other classes only if the lengths there allow its
    second best score so far, so no candidate is lost, and no task holds a whole block.
    """
    keys = ["venue_internal_id", "year"]
    tile_chars = tile_chars or (WIDE_CHARS if floor > 0 else TILE_CHARS)
    a = a.dropna(subset=keys + ["title_norm"]).withColumn("title_id", F.sha2(F.concat_ws(" ", *keys, "title_norm"), 256))
    b = b.dropna(subset=keys + ["title_norm"])
    titles_a = a.select(*keys, "title_norm", "title_id").distinct()
    titles_b = b.groupBy(*keys, "title_norm").agg(
        F.min("article_id_scopus").alias("first_id"), F.count(F.lit(1)).alias("copies")
    )
    placed_a, _ = _length_tiles(titles_a, tile, tile_chars, "a")
    placed_b, classes_b = _length_tiles(titles_b, tile, tile_chars, "b")
    classes_b = classes_b.withColumnRenamed("cls", "cls_b")
    sweep(a.sparkSession, now=True)

    group = [*keys, "cls", "part", "cls_b", "part_b"]
    schema = "title_id string, score double, first_id string, copies bigint"
    # the length in the class that is nearest to the title's own gives the highest score possible
    nearest = F.greatest("shortest", F.least("longest", "n"))
    possible = F.coalesce(F.least("n", nearest) * 200.0 / (F.col("n") + nearest), F.lit(100.0))
    apart = F.abs(F.col("cls") - F.col("cls_b"))

    def score(left: DataFrame) -> DataFrame:
        """``left``: titles with ``known`` and the class of the other side that they meet."""
        left = left.withColumn("part_b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        met = left.groupBy(*group).agg(F.min("n").alias("least_n"), F.max("n").alias("most_n"), F.min("known").alias("lowest"))
        met = save_and_reload(met, "fuzzy-met")
        left = left.select(*group, "title_id", "title_norm", "known")
        # a title whose length allows no title of the tile enough is not sent there
        nearest = F.greatest("least_n", F.least("most_n", "n"))
        possible = F.coalesce(F.least("n", nearest) * 200.0 / (F.col("n") + nearest), F.lit(100.0))
        right = placed_b.withColumnsRenamed({"cls": "cls_b", "part": "part_b"}).join(met, [*keys, "cls_b", "part_b"])
        right = right.filter(possible + ROUNDING >= F.col("lowest")).select(*group, "title_norm", "first_id", "copies")
        # fresh columns, as both sides may stem from one table
        right = right.select(*[F.col(c).alias(c) for c in right.columns])
        pairs = spread(left, *group).groupBy(*group).cogroup(spread(right, *group).groupBy(*group))
        return pairs.applyInPandas(_tile_scorer(floor), schema)

    meets = placed_a.join(classes_b, keys)
    near = meets.filter((apart <= NEAR) & (possible + ROUNDING >= floor)).withColumn("known", F.lit(floor))
    best = save_and_reload(_two_best(score(near)), "fuzzy-near")
    sweep(a.sparkSession, now=True)
    if 200.0 / (1.0 + LENGTH_STEP**NEAR) >= floor:
        # with a second copy of the best title, or a second best one, lower scores change nothing
        known = best.groupBy("title_id").agg(
            F.max(F.when((F.col("place") == 2) | (F.col("copies") > 1), F.col("score"))).alias("known")
        )
        far = (
            meets.filter(apart > NEAR).join(known, "title_id", "left")
            .withColumn("known", F.coalesce("known", F.lit(floor))).filter(possible + ROUNDING >= F.col("known"))
        )
        best = _two_best(best.drop("place").unionByName(score(far)))
    two = best.groupBy("title_id").agg(
        F.max_by(F.struct("first_id", "score", "copies"), -F.col("place")).alias("top"),
        F.max(F.when(F.col("place") == 2, F.col("score"))).alias("next_score"),
    )
    found = two.select(
        "title_id",
        F.col("top.first_id").alias("article_id_scopus"),
        F.col("top.score").alias("best_score"),
        F.when(F.col("top.copies") > 1, F.col("top.score"))
        .otherwise(F.coalesce("next_score", F.lit(NO_SECOND))).alias("second_score"),
    )
    found = save_and_reload(found, "fuzzy-found")
    sweep(a.sparkSession, now=True)
    return a.join(found, "title_id").drop("title_id").withColumn(
        "score_gap", F.col("best_score") - F.col("second_score")
    )


def resolve_fuzzy(candidates: DataFrame, threshold: float = FUZZY_THRESHOLD,
                  min_gap: float = MIN_GAP_TO_SECOND) -> DataFrame:
    """Mark the accepted candidates: score and gap suffice, and first claim on the B article."""
    passing = candidates.filter((F.col("best_score") >= threshold) & (F.col("score_gap") >= min_gap))
    winners = passing.groupBy("article_id_scopus").agg(F.min("article_id_oc").alias("_winner"))
    ok = (
        (F.col("best_score") >= threshold) & (F.col("score_gap") >= min_gap)
        & (F.col("article_id_oc") == F.col("_winner"))
    )
    return (
        candidates.join(winners, "article_id_scopus", "left")
        .withColumn("accepted", F.coalesce(ok, F.lit(False)))
        .drop("_winner")
    )


def _with_b(rows: DataFrame, b: DataFrame) -> DataFrame:
    """Attach the B row as a struct, and pack the A columns."""
    side = b.select(F.col("article_id_scopus").alias("_id"), F.struct(*B_COLUMNS).alias("b"))
    return rows.join(side, F.col("article_id_scopus") == F.col("_id")).withColumn(
        "a", F.struct(*A_COLUMNS)
    )


def fuzzy_matches(resolved: DataFrame, b: DataFrame) -> DataFrame:
    rows = _with_b(resolved.filter("accepted"), b)
    return _standard(rows.withColumn("fuzzy_score", F.col("best_score")), "title_fuzzy_year_auto")


def review_queue(resolved: DataFrame, b: DataFrame) -> DataFrame:
    """Best candidates that were not accepted, for a decision by hand."""
    rows = _with_b(resolved.filter(~F.col("accepted")), b)
    return rows.select(
        "venue_internal_id", "year", "article_id_oc", "title_oc", F.col("doi_norm").alias("doi_oc"),
        "article_id_scopus", F.col("b.title_scopus").alias("title_scopus"),
        F.col("b.doi_norm").alias("doi_scopus"), "best_score", "second_score", "score_gap",
    )


def _blocks(b: DataFrame, every_b: DataFrame) -> DataFrame:
    """Venues and years with titles, ``plain`` where every id names one record of ``every_b``."""
    records = every_b.groupBy("article_id_scopus").agg(F.count(F.lit(1)).alias("_records"))
    ids = b.dropna(subset=["venue_internal_id", "year", "title_norm"]).join(records, "article_id_scopus", "left")
    plain = F.bool_and(F.coalesce(F.col("_records") == 1, F.lit(False)))
    return ids.groupBy("venue_internal_id", "year").agg(plain.alias("plain"))


def _asking(a: DataFrame, blocks: DataFrame) -> DataFrame:
    """Articles that have a candidate at all, marked ``plain``."""
    return a.dropna(subset=["venue_internal_id", "year", "title_norm"]).join(blocks, ["venue_internal_id", "year"])


def _counted_candidates(a: DataFrame, b: DataFrame, blocks: DataFrame, tile: int, floor: float) -> DataFrame:
    """Candidates of at least ``floor``, marked ``plain``.

    An article with any title of the other source in its venue and year has a best candidate. One that is below
    the floor is a row of the review queue whatever it is, if its id names one record. Where ids
    repeat, the number of rows depends on the candidate, so there the best ones are found without a floor.
    """
    asking = _asking(a, blocks)
    others = b.join(blocks.filter("NOT plain"), ["venue_internal_id", "year"], "left_semi")
    found = fuzzy_candidates(asking.filter("plain"), b, tile, floor)
    return found.unionByName(fuzzy_candidates(asking.filter("NOT plain"), others, tile))


def match_manual(reviewed: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs a person marked as the same, with both records attached."""
    # the ids alone say which pairs stay, so records are attached to these only
    ids = ["article_id_oc", "article_id_scopus"]
    pairs = one_to_one(manually_accepted(reviewed).select(ids), *ids, ids)
    side_a = a.select(F.col("article_id_oc").alias("_a"), F.struct(*A_COLUMNS).alias("a"))
    side_b = b.select(F.col("article_id_scopus").alias("_b"), F.struct(*B_COLUMNS).alias("b"))
    rows = (
        pairs.join(side_a, F.col("article_id_oc") == F.col("_a"), "left")
        .join(side_b, F.col("article_id_scopus") == F.col("_b"), "left")
        .select(
            F.col("article_id_oc").alias("id_a"), F.col("article_id_scopus").alias("id_b"), "a", "b",
            F.lit(None).cast("double").alias("fuzzy_score"),
        )
    )
    rows = one_to_one(rows, "id_a", "id_b", ["id_a", "id_b"])
    # the ids come from the reviewed list, also where a record is missing
    rows = rows.withColumns(
        {
            "a": F.struct(F.col("id_a").alias("article_id_oc"), *[F.col("a")[c].alias(c) for c in A_COLUMNS[1:]]),
            "b": F.struct(F.col("id_b").alias("article_id_scopus"), *[F.col("b")[c].alias(c) for c in B_COLUMNS[1:]]),
        }
    )
    return _standard(rows, "manual_confirmed")


def merge_stages(*stages: DataFrame) -> DataFrame:
    """All matches, one per article on either side, by stage priority and then ids."""
    every = union_all(*stages)
    method = F.col("match_method")
    priority = F.lit(999)
    for name, p in MATCH_PRIORITY.items():
        priority = F.when(method == name, p).otherwise(priority)
    ranked = every.withColumn("_priority", priority)
    order = ["_priority", "article_id_oc", "article_id_scopus"]
    return one_to_one(ranked, "article_id_oc", "article_id_scopus", order).drop("_priority")


def _one_sided(rows: DataFrame, side: str) -> DataFrame:
    null = F.lit(None)
    empty_b = F.struct(*[null.cast(t).alias(c) for c, t in _b_types().items()])
    empty_a = F.struct(*[null.cast(t).alias(c) for c, t in _a_types().items()])
    if side == "a":
        pairs = rows.select(F.struct(*A_COLUMNS).alias("a"), empty_b.alias("b"))
        method = "oc_only"
    else:
        pairs = rows.select(empty_a.alias("a"), F.struct(*B_COLUMNS).alias("b"))
        method = "scopus_only"
    return _standard(pairs.withColumn("fuzzy_score", null), method)


def _a_types() -> dict[str, str]:
    types = dict.fromkeys(A_COLUMNS, "string")
    return types | {"venue_internal_id": "bigint", "year": "int", "citedby_count_oc": "double"}


def _b_types() -> dict[str, str]:
    types = dict.fromkeys(B_COLUMNS, "string")
    return types | {"venue_internal_id": "bigint", "year": "int", "citedby_count_scopus": "double"}


def master_table(matches: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Matches and the rest of both sources, with status and preferred fields."""
    rest_a, rest_b = without_matched(a, b, matches)
    every = union_all(
        matches.select(MATCH_COLUMNS), _one_sided(rest_a, "a"), _one_sided(rest_b, "b")
    )
    method = F.col("match_method")
    return every.withColumns(
        {
            "source_status": first_match(
                [
                    (method.isin(*MATCH_PRIORITY), "both"),
                    (method == "oc_only", "open_citations_only"),
                    (method == "scopus_only", "scopus_only"),
                ],
                "unknown",
            ),
            "venue_name": F.coalesce("venue_name_oc", "venue_name_scopus"),
            "title_preferred": F.coalesce("title_oc", "title_scopus"),
            "year_preferred": F.coalesce("year_oc", "year_sc"),
        }
    )


@dataclass
class Linkage:
    """Results of all stages. ``a`` and ``b`` are the sources with digests of the titles.

    ``poor`` is one row, the size ``n`` of the part of the review queue that was counted only.
    """

    doi: DataFrame
    title: DataFrame
    candidates: DataFrame
    fuzzy: DataFrame
    review: DataFrame
    manual: DataFrame | None
    matches: DataFrame
    master: DataFrame
    poor: DataFrame | None = None
    a: DataFrame | None = None
    b: DataFrame | None = None


def _with_texts(matches: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Matches of compact sources with the titles of ``a`` and ``b`` in place of the digests."""
    for rows, key, title, norm in (
        (a, "article_id_oc", "title_oc", "title_norm_oc"), (b, "article_id_scopus", "title_scopus", "title_norm_sc")
    ):
        texts = rows.select(
            F.col(key).alias("_id"), F.md5(title).alias("_digest"), F.col(title).alias("_title"), F.col("title_norm").alias("_norm")
        )
        wanted = matches.select(F.col(key).alias("_id")).dropna().distinct()
        texts = texts.join(wanted, "_id", "left_semi").dropDuplicates(["_id", "_digest"])
        same = (F.col(key) == F.col("_id")) & (F.col(title) == F.col("_digest"))
        matches = matches.join(texts, same, "left").withColumns({title: F.col("_title"), norm: F.col("_norm")})
        matches = matches.drop("_id", "_digest", "_title", "_norm")
    return matches


def link_sources(a: DataFrame, b: DataFrame, reviewed: DataFrame | None = None,
                 legacy_null_match: bool = False, tile: int = TILE, review: bool = True, count_review: bool = False,
                 texts: bool = True) -> Linkage:
    """Run all stages on two prepared sources (`prepare_a`, `prepare_b`).

    ``review=False`` looks for automatic matches only, which skips nearly all scoring. ``count_review`` then
    counts the articles whose best candidate was not sought, as `linkage_summary` needs them. ``texts=False`` leaves
    digests in place of the titles, for counts.

    The exact stages run on digests of the titles, so texts are shuffled for the fuzzy stage and the results only. Stage
    results are small next to the sources and feed several later steps, so each is written once to the shared folder.
    """
    spark = a.sparkSession
    a, b = save_and_reload(a, "source-a"), save_and_reload(b, "source-b")
    sweep(spark, now=True)
    keys_a = save_and_reload(_compact(a, "title_oc"), "keys-a")
    keys_b = save_and_reload(_compact(b, "title_scopus"), "keys-b")
    doi = save_and_reload(match_doi(keys_a, keys_b, legacy_null_match), "doi")
    rest_a, rest_b = without_matched(keys_a, keys_b, doi)
    title = save_and_reload(match_title_year(rest_a, rest_b, legacy_null_match), "title")
    matched = [doi.select("article_id_oc", "article_id_scopus"), title.select("article_id_oc", "article_id_scopus")]
    left_a, left_b = without_matched(a, b, matched[0].unionByName(matched[1]))
    floor = 0.0 if review else FUZZY_THRESHOLD - MIN_GAP_TO_SECOND
    poor = None
    if count_review and not review:
        blocks = save_and_reload(_blocks(left_b, b), "fuzzy-blocks")
        resolved = result_only(spark, lambda: resolve_fuzzy(_counted_candidates(left_a, left_b, blocks, tile, floor)), "fuzzy")
        sizes = [
            df.filter("plain").agg(F.count(F.lit(1)).alias(n)) for df, n in ((_asking(left_a, blocks), "_asking"), (resolved, "_found"))
        ]
        poor = sizes[0].join(F.broadcast(sizes[1])).select((F.col("_asking") - F.col("_found")).alias("n"))
    else:
        resolved = result_only(spark, lambda: resolve_fuzzy(fuzzy_candidates(left_a, left_b, tile, floor)), "fuzzy")
    sweep(spark, now=True)
    short = resolved.withColumns({"title_oc": F.md5("title_oc"), "title_norm": F.sha2("title_norm", 256)})
    fuzzy = fuzzy_matches(short, keys_b)
    manual = match_manual(reviewed, keys_a, keys_b) if reviewed is not None else None
    stages = [doi, title, fuzzy] + ([manual] if manual is not None else [])
    matches = save_and_reload(merge_stages(*stages), "matches")
    sweep(spark, now=True)
    if not texts:
        queue = review_queue(short, keys_b)
        return Linkage(doi, title, resolved, fuzzy, queue, manual, matches, master_table(matches, keys_a, keys_b), poor, keys_a, keys_b)

    def whole(df: DataFrame | None) -> DataFrame | None:
        return None if df is None else _with_texts(df, a, b)

    return Linkage(
        whole(doi), whole(title), resolved, fuzzy_matches(resolved, b), review_queue(resolved, b), whole(manual), whole(matches),
        master_table(whole(matches), a, b), poor, keys_a, keys_b,
    )


def linkage_summary(a: DataFrame, b: DataFrame, link: Linkage) -> DataFrame:
    """Row counts of every stage as (stage, n)."""
    parts = {
        "open index records": a, "second index records": b, "DOI matches": link.doi,
        "exact title and year matches": link.title, "automatic fuzzy matches": link.fuzzy,
        "review candidates": link.review, "total matched pairs": link.matches,
        "open index only": link.master.filter("source_status = 'open_citations_only'"),
        "second index only": link.master.filter("source_status = 'scopus_only'"),
    }
    if link.manual is not None:
        parts["manually confirmed matches"] = link.manual
    sizes = {k: df.agg(F.count(F.lit(1)).alias("n")) for k, df in parts.items()}
    if link.poor is not None:
        both = sizes["review candidates"].unionByName(link.poor)
        sizes["review candidates"] = both.agg(F.sum("n").alias("n"))
    return union_all(*[df.select(F.lit(k).alias("stage"), "n") for k, df in sizes.items()])
