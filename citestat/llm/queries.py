"""Registered queries of this package and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from citestat.llm import (
    alignment, chat, classifier, decontamination, htmltext, linededup, merkle, mixing, neardup, packing, quality_rules, sharding, toxicity,
)
from citestat.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


_QUALITY_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]') AS pieces FROM documents),
w AS (
    SELECT *, list_filter(pieces, lambda x: x <> '') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d
),
s AS (
    SELECT doc_id, words, CAST(len(words) AS BIGINT) AS n_words, CAST(length(text) - len(pieces) + 1 AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines,
        len(regexp_extract_all(text, '[A-Z]')) AS n_upper, len(regexp_extract_all(text, '[!?]')) AS n_marks FROM w
),
windows AS (
    SELECT doc_id, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM s WHERE len(words) > 2)
),
found AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM windows),
covered AS (
    SELECT doc_id, count(DISTINCT i + j) AS n FROM found, (SELECT unnest([0, 1, 2]) AS j) WHERE n > 1 GROUP BY doc_id
),
t AS (
    SELECT s.doc_id, n_words, word_chars, n_symbols, n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
        n_lines, n_upper, n_marks FROM s LEFT JOIN covered ON s.doc_id = covered.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words OR 100 * n_dup_lines > 30 * n_lines
        OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 100 * n_upper > 30 * word_chars OR 10 * n_marks > n_words) AS kept
FROM t
"""


@query("op2_quality_rules", _QUALITY_SQL)
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


_LEAK_SQL = r"""
WITH d AS (
    SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
),
b AS (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL
),
bw AS (
    SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
    FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
),
dw AS (
    SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
    FROM (
        SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n
    )
),
hits AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
words AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
),
items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query("op5_benchmark_decontamination", _LEAK_SQL)
def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


_NEAR_SQL = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+'), []) AS w FROM documents
),
g AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (
    SELECT p.a, p.b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)
),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS seen FROM d UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a),
m AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM d JOIN m ON d.doc_id = m.node LEFT JOIN n ON d.doc_id = n.doc_id
"""


@query("op6_minhash_near_dedup", _NEAR_SQL)
def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicate_components(table(spark, sf_dir, "documents"), k=3, percent=85)
    return found.select(
        F.col("node").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"),
        F.col("node").eqNullSafe(F.col("component")).alias("kept"),
    )


def _taught(labels: DataFrame, modulus: int, held: int) -> DataFrame:
    return labels.filter(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus)) != held)


def _judged(docs: DataFrame, modulus: int, held: int, least: float) -> DataFrame:
    return docs.select(
        "doc_id", (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus)) == held).alias("held_out"),
        "score", (F.col("score") >= least).cast("int").alias("predicted"),
    )


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    index = toxicity.fit(docs, _taught(table(spark, sf_dir, "labels"), 4, 2))
    return _judged(toxicity.scored(docs, index).withColumnRenamed("id", "doc_id"), 4, 2, 0.3)


@query("op7_quality_classifier")
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = classifier.fit(docs, _taught(table(spark, sf_dir, "labels"), 3, 1))
    return _judged(classifier.scored(docs, model), 3, 1, 0.5)


@query("op9_sharding")
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query("op10_mixing_sources")
def op10_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


@query("op3_token_packing")
def op3_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


@query("op4_chat_formatting")
def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repaired_turns(table(spark, sf_dir, "conversations")).drop("place")


_LINES_SQL = r"""
WITH l AS (
    SELECT doc_id, i AS pos, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line, line AS raw
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS j FROM l WHERE line <> ''),
w AS (
    SELECT doc_id, j, line AS a, lead(line) OVER d AS b, lead(line, 2) OVER d AS c FROM f WINDOW d AS (PARTITION BY doc_id ORDER BY j)
),
o AS (
    SELECT doc_id, j, row_number() OVER g AS nth, first_value(doc_id) OVER g AS d0, first_value(j) OVER g AS j0
    FROM w WHERE c IS NOT NULL WINDOW g AS (PARTITION BY a, b, c ORDER BY doc_id, j)
),
gone AS (
    SELECT DISTINCT doc_id, j + k AS j FROM o, (SELECT unnest([0, 1, 2]) AS k) WHERE nth > 1 AND (d0 <> doc_id OR j + k >= j0 + 3)
),
kept AS (
    SELECT l.doc_id, string_agg(l.raw, chr(10) ORDER BY l.pos) AS text FROM l LEFT JOIN f USING (doc_id, pos)
    LEFT JOIN gone ON f.doc_id = gone.doc_id AND f.j = gone.j WHERE gone.j IS NULL GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_lines, coalesce(g.n, 0) AS n_removed, md5(CASE WHEN d.text IS NOT NULL THEN coalesce(kept.text, '') END) AS clean_md5
FROM documents d LEFT JOIN kept USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n FROM f GROUP BY doc_id) n USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g USING (doc_id)
"""


@query("op8_line_dedup", _LINES_SQL)
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs, report=True).select("doc_id", "n_lines", "n_removed", F.md5("text").alias("clean_md5"))


_MERKLE_SQL = r"""
WITH RECURSIVE e AS (
    SELECT doc_id, source, prefix, prefix || coalesce(strlen(text) || ':' || text, '-') AS whole,
        prefix || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-') AS cut,
        list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT)),
            lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0],
                lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)) % 2 = 1 AS even
    FROM (
        SELECT doc_id, source, text, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-')
            || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
            || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS prefix FROM documents
    )
),
l AS (
    SELECT doc_id, source, leaf, shown, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r,
        count(*) OVER (PARTITION BY source) AS n
    FROM (SELECT doc_id, source, sha256(whole) AS leaf, CASE WHEN even THEN sha256(cut) ELSE sha256(whole) END AS shown FROM e)
),
t AS (
    SELECT source, 0 AS lv, r, leaf AS h, n FROM l
    UNION ALL SELECT source, lv + 1, r // 3, sha256(string_agg(h, '' ORDER BY r)), (any_value(n) + 2) // 3 FROM t WHERE n > 1 GROUP BY source, lv, r // 3
),
subs AS (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS r, count(*) OVER () AS n FROM t WHERE n = 1),
s AS (
    SELECT 0 AS lv, r, h, n FROM subs
    UNION ALL SELECT lv + 1, r // 3, sha256(string_agg(h, '' ORDER BY r)), (any_value(n) + 2) // 3 FROM s WHERE n > 1 GROUP BY lv, r // 3
),
p AS (
    SELECT source, lv, r, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
        coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b
    FROM t WHERE n > 1 WINDOW w AS (PARTITION BY source, lv, r // 3 ORDER BY r)
),
q AS (
    SELECT lv, r, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
        coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b
    FROM s WHERE n > 1 WINDOW w AS (PARTITION BY lv, r // 3 ORDER BY r)
),
steps AS (
    SELECT source, r, a, b, row_number() OVER (PARTITION BY source, r ORDER BY k) - 1 AS i
    FROM (
        SELECT l.source, l.r, p.lv AS k, a, b FROM l JOIN p ON l.source IS NOT DISTINCT FROM p.source AND p.r = l.r // CAST(pow(3, p.lv) AS BIGINT)
        UNION ALL SELECT l.source, l.r, 1000 + q.lv, a, b FROM l JOIN subs ON l.source IS NOT DISTINCT FROM subs.source
        JOIN q ON q.r = subs.r // CAST(pow(3, q.lv) AS BIGINT)
    )
),
f AS (
    SELECT source, r, 0 AS i, shown AS h FROM l
    UNION ALL SELECT f.source, f.r, f.i + 1, sha256(a || h || b) FROM f JOIN steps ON f.source IS NOT DISTINCT FROM steps.source AND f.r = steps.r AND f.i = steps.i
),
folds AS (SELECT source, r, arg_max(h, i) AS h FROM f GROUP BY source, r),
proofs AS (SELECT source, r, sha256(string_agg(a || b, '' ORDER BY i)) AS h FROM steps GROUP BY source, r)
SELECT doc_id, leaf, subs.h AS subroot, root.h AS root, coalesce(proofs.h, sha256('')) AS proof_sha256, folds.h AS folded_root, folds.h = root.h AS verified
FROM l JOIN subs ON l.source IS NOT DISTINCT FROM subs.source JOIN folds ON l.source IS NOT DISTINCT FROM folds.source AND l.r = folds.r
LEFT JOIN proofs ON l.source IS NOT DISTINCT FROM proofs.source AND l.r = proofs.r, (SELECT h FROM s WHERE n = 1) AS root
"""


@query("op11_merkle_manifest", _MERKLE_SQL)
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tampered = merkle.leaf_digest(replaced={"text": F.translate("text", "\n", "")})
    found = merkle.manifest(docs.withColumn("tampered", F.when(even, tampered)), keep=("tampered",))
    fold = merkle.folded(F.coalesce("tampered", "leaf"), F.col("path"))
    return found.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), fold.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


@query("op12_html_extraction")
def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query("op13_tokenizer_alignment")
def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(table(spark, sf_dir, "documents"))
