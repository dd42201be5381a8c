"""Registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (centroids, decontaminate, divergence, lines, packing, pieces, ppm, quality, secrets, simhash,
               substrings, token_orc, urls)
from .base import table

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return add


_OP1 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                  regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
       FROM b, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS t(i) WHERE len(w) > 0),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
       FROM d, ns, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n),
hit AS (SELECT DISTINCT r, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.s = bw.s),
cov AS (SELECT r, count(DISTINCT i + j) AS n_hit FROM hit, unnest(range(0, n)) AS t(j) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
        FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (r) LEFT JOIN its USING (r)"""


@register("op1_decontaminate", _OP1)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contamination of every document by the benchmark items."""
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op2_quality_rules")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, base rule and classifier verdict of every document."""
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op10_token_orc")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written to and read from ORC files."""
    return token_orc.report(table(spark, sf_dir, "documents"))


@register("op3_curve_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed in Hilbert order."""
    return packing.report(table(spark, sf_dir, "documents"))


@register("op6_simhash_groups")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    return simhash.report(table(spark, sf_dir, "documents"))


_OP8 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS s
        FROM d, unnest(range(1, len(w) - 33)) AS t(i) WHERE len(w) >= 35),
twice AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, i + j AS i FROM win JOIN twice USING (s), unnest(range(0, 35)) AS t(j)),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS s FROM
         (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d) ANTI JOIN gone USING (r, i) GROUP BY r),
n AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r) LEFT JOIN n USING (r)"""


@register("op8_substring_dedup", _OP8)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document under windows of 35 words that occur elsewhere."""
    return substrings.report(table(spark, sf_dir, "documents"))


_OP9 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS site, text,
                  string_split(text, E'\n') AS ls FROM documents),
l AS (SELECT r, doc_id, site, i, ls[i] AS raw,
             lower(trim(ls[i], ' ')) AS line
      FROM d, unnest(range(1, len(ls) + 1)) AS t(i)),
bad AS (SELECT line, min(doc_id) AS first_doc FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
        GROUP BY line HAVING count(DISTINCT site) >= 10),
gone AS (SELECT r, i FROM l JOIN bad USING (line) WHERE doc_id IS DISTINCT FROM first_doc OR first_doc IS NULL),
kept AS (SELECT r, string_agg(raw, E'\n' ORDER BY i) AS s FROM l ANTI JOIN gone USING (r, i) GROUP BY r),
n AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r) LEFT JOIN n USING (r)"""


@register("op9_line_dedup", _OP9)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without boilerplate lines, as counts and a digest."""
    return lines.report(table(spark, sf_dir, "documents"))


@register("op7_ppm_scores")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and PPM log10 probability of every document."""
    return ppm.scored(table(spark, sf_dir, "documents"))


@register("op4_secret_scan")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: base patterns and Markov models."""
    return secrets.report(table(spark, sf_dir, "documents"))


@register("op5_url_filter")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page by rules and link-graph propagation."""
    return urls.report(table(spark, sf_dir, "pages"))


@register("op11_sentencepiece")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of ids and decoded text of every document."""
    return pieces.report(table(spark, sf_dir, "documents"))


_OP12 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
w AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(total) AS size FROM kept GROUP BY lang),
s AS (SELECT lang, source, coalesce(sum(n), 0) AS size FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT lang, source, term, coalesce(n, 0) AS n,
             1 + (1000000000::HUGEINT * (coalesce(n, 0) + 2)) // (s.size + 2 * v) AS p,
             1 + (1000000000::HUGEINT * (total + 2)) // (v.size + 2 * v) AS q
      FROM s JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
pair AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
         FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value
          FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS k
           FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(k AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR k <= 10"""


@register("op12_source_divergence", _OP12)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of every two sources of a language, and the terms that mark a source."""
    return divergence.audit(table(spark, sf_dir, "documents"))


def _op13() -> str:
    near = "list_sum(list_transform(list_zip(e.q, m.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    parts = ["""
WITH e AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
           FROM embeddings WHERE len(embedding) = 64
           AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE)))) = 64),
m0 AS (SELECT k, q FROM (SELECT q, row_number() OVER (ORDER BY vec_id IS NULL, sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), q) - 1 AS k
                         FROM e) WHERE k < 16)"""]
    for i in range(4):
        parts.append(f"""
a{i} AS (SELECT r, vec_id, e.q, arg_min(m.k, {near} * 16 + m.k) AS k, min({near}) AS d FROM e, m{i} m GROUP BY r, vec_id, e.q)""")
        if i < 3:
            parts.append(f"""
s{i} AS (SELECT k, j, sum(x) AS s, count(*) AS n FROM (SELECT k, unnest(q) AS x, unnest(range(1, 65)) AS j FROM a{i}) GROUP BY k, j),
n{i} AS (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS q FROM s{i} GROUP BY k),
m{i + 1} AS (SELECT m.k, coalesce(n.q, m.q) AS q FROM m{i} m LEFT JOIN n{i} n ON n.k = m.k)""")
    return ",".join(parts) + """
SELECT vec_id, CAST(a.k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
       CAST(sum(d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(m.q, ',')) AS centroid_sha256
FROM a3 a JOIN m3 m ON a.k = m.k"""


@register("op13_centroid_clusters", _op13())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every vector after three rounds."""
    return centroids.report(table(spark, sf_dir, "embeddings"))
