"""The queries of this folder, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import bpe, chat, divergence, fingerprints, langid, licenses, lm, negatives, neardup, packing, quality, secrets, token_files


def vocabulary_path(name: str) -> str:
    """Where an installed vocabulary file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": lambda s, d: bpe.digests(_documents(s, d), vocabulary_path("byte_bpe_50k.tiktoken")),
        "op2_token_files": lambda s, d: token_files.round_trip(_documents(s, d), vocabulary_path("byte_bpe_50k.json"), end_id=2),
        "op3_packing": lambda s, d: packing.pack(_documents(s, d), vocabulary_path("word_bpe_49k.json"), capacity=2048, end_id=0),
        "op4_secrets": lambda s, d: secrets.digests(_documents(s, d)),
        "op5_langid": lambda s, d: langid.digests(_documents(s, d)),
        "op6_quality": op6_quality,
        "op7_fingerprints": lambda s, d: fingerprints.digests(_documents(s, d)),
        "op8_licenses": lambda s, d: licenses.digests(_documents(s, d)),
        "op9_neardup": lambda s, d: neardup.near_duplicates(_documents(s, d), words=2, percent=80),
        "op10_chat": lambda s, d: chat.digests(s.read.parquet(f"{d}/conversations.parquet")),
        "op11_hard_negatives": lambda s, d: negatives.mined(s.read.parquet(f"{d}/embeddings.parquet")),
        "op12_divergence": lambda s, d: divergence.audit(_documents(s, d)),
        "op13_lm_scoring": lambda s, d: lm.score(_documents(s, d)),
        "lm_base": lm_base,
        "quality_counts": quality_counts,
        "edited_texts": edited_texts,
        "secret_bases": secret_bases,
    }


#: Words of a text, as the operators take them.
WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"

#: The contract of op9, without its method: every pair whose sizes allow a link is compared in full.
NEARDUP_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) > 1 THEN list_distinct(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) ELSE w END AS s FROM w),
u AS (SELECT s, len(s) AS n, min(doc_id) AS node FROM (SELECT doc_id, list_sort(s) AS s FROM s) WHERE len(s) > 0 GROUP BY s),
e AS (SELECT a.node AS a, b.node AS b FROM u a JOIN u b ON a.node < b.node AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n WHERE 180 * len(list_intersect(a.s, b.s)) >= 80 * (a.n + b.n)),
ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(a, b) AS (SELECT node, node FROM u UNION SELECT r.a, ways.b FROM reach r JOIN ways ON ways.a = r.b),
lowest AS (SELECT a AS node, min(b) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(l.component_id, s.doc_id) AS component_id, s.doc_id = coalesce(l.component_id, s.doc_id) AS kept FROM s LEFT JOIN u ON u.s = list_sort(s.s) LEFT JOIN lowest l ON l.node = u.node"""

QUALITY_SQL = f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
g AS (SELECT doc_id, k, list_slice(w, k, k + 4) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1))) AS k FROM t)),
again AS (SELECT doc_id, k FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT k + j) AS n FROM again, range(5) x(j) GROUP BY doc_id),
l AS (SELECT doc_id, len(x) - len(list_distinct(x)) AS n FROM (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')) AS x FROM t)),
c AS (SELECT t.doc_id, len(t.w) AS n_words, length(array_to_string(t.w, '')) AS word_chars, length(regexp_replace(t.t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, l.n AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words FROM t JOIN l USING (doc_id) LEFT JOIN r USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c"""

EDITED_SQL = """WITH t AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id), '') AS f FROM documents)
SELECT doc_id, length(t) AS n_chars, sha256(left(t, length(t) - length(t) // 4) || left(f, length(t) // 4)) AS edited_sha256 FROM t"""


def _any_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


#: The base kinds of op4 in the contract's order: pattern, the group that is measured, its least length.
BASE_KINDS = {
    "assign": ("(" + _any_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": ("AKIA[A-Z0-9]+", 0, 20),
    "hex": ("[0-9a-f]+", 0, 24),
}
_MATCHES = " UNION ALL ".join(f"SELECT doc_id, {place} AS place, '{kind}' AS kind, {least} AS least, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {group}) AS g, regexp_split_to_array(t, '{p}') AS gaps FROM t" for place, (kind, (p, group, least)) in enumerate((k, (p.replace("'", "''"), *rest)) for k, (p, *rest) in BASE_KINDS.items()))
#: A match begins after the gaps up to it and the matches before it.
SECRETS_SQL = f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), found AS ({_MATCHES}),
each AS (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM found),
spans AS (SELECT doc_id, place, kind, len(m[k]) AS n, CAST(list_sum(list_transform(gaps[1:k], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: len(x))), 0) AS BIGINT) AS s FROM each WHERE len(g[k]) >= least)
SELECT t.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, sha256(coalesce(string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, place), '')) AS base_sha256 FROM t LEFT JOIN spans USING (doc_id) GROUP BY t.doc_id"""


#: The contract of op11 by all products with the anchors.
NEGATIVES_SQL = """WITH r AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.n, a.vec_id AS anchor_id, b.n AS other, b.vec_id, a.label = b.label AS same, CAST(coalesce(list_sum(list_transform(range(1, len(a.v) + 1), lambda k: a.v[k] * b.v[k])), 0) AS BIGINT) AS score FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.n != b.n AND len(a.v) = len(b.v)),
p AS (SELECT n, anchor_id, other, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) <= 5),
w AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.n, p.other ORDER BY s.score DESC, s.vec_id) AS rank FROM p JOIN s ON s.n = p.n WHERE NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM w WHERE rank <= 5"""

#: The contract of op12 by dense sums over every kept term of every group.
DIVERGENCE_SQL = r"""WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS n, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
kept AS (SELECT lang, term FROM (SELECT DISTINCT lang, n, unnest(w) AS term FROM d) GROUP BY lang, term HAVING count(*) >= 10),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS c FROM (SELECT lang, source, unnest(w) AS term FROM d) SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
every AS (SELECT g.lang, g.source, kept.term, coalesce(c.c, 0)::HUGEINT AS c FROM g JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
p AS (SELECT lang, source, term, c, 1 + 1000000000 * (c + 2) // (sum(c) OVER (PARTITION BY lang, source)::HUGEINT + 2 * v) AS p FROM every JOIN v USING (lang)),
q AS (SELECT lang, term, 1 + 1000000000 * (c + 2) // (sum(c) OVER (PARTITION BY lang)::HUGEINT + 2 * v) AS q FROM (SELECT lang, term, sum(c)::HUGEINT AS c FROM every GROUP BY lang, term) JOIN v USING (lang)),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source != b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
 UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r QUALIFY part = 'pair' OR rank <= 10"""


#: CRC-32 of an id as text, a bit at a time: after each byte, eight shifts (-1).
_CRC = "xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295)"

LM_BASE_SQL = f"""WITH d AS (SELECT doc_id, row_number() OVER () AS n, {_CRC} % 10 = 0 AS held_out, list_append({WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}, '') AS w FROM documents),
t AS (SELECT doc_id, n, held_out, unnest(w) AS w FROM d), c AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w), s AS (SELECT coalesce(sum(c), 0)::BIGINT AS total, count(*) AS kinds FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, total AS train_tokens, round(sum(log10((coalesce(c, 0) + 0.1::DOUBLE) / (total + 0.1::DOUBLE * (kinds + 1)))), 4) AS base_score FROM t LEFT JOIN c USING (w), s GROUP BY doc_id, n, held_out, total"""


def lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op13 says without its model."""
    return lm.score(_documents(spark, sf_dir)).withColumn("base_score", F.round("base_score", 4)).drop("score")


def secret_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op4 says of the base kinds."""
    return secrets.digests(_documents(spark, sf_dir)).drop("spans")


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op6's model starts from."""
    return quality.judge(_documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edited texts that op7 fingerprints."""
    return fingerprints.digests(_documents(spark, sf_dir)).select("doc_id", "n_chars", "edited_sha256")


def oracle_sql() -> dict[str, str]:
    """For op9, op11 and op12 in full; for op4, op6, op7 and op13 as far as SQL goes, under names of their own."""
    return {"op9_neardup": NEARDUP_SQL, "op11_hard_negatives": NEGATIVES_SQL, "op12_divergence": DIVERGENCE_SQL, "lm_base": LM_BASE_SQL, "secret_bases": SECRETS_SQL, "quality_counts": QUALITY_SQL, "edited_texts": EDITED_SQL}
