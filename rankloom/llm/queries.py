"""One query for each operator over its whole table, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import backoff, decontaminate, html, jaccard, lines, neighbours, pieces, quality, sharding, substrings
from .frames import table


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", "kept_sha256")


#: All runs of MIN_WORDS words or more, of any length: all places of a run but the first lose it.
OP1_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS t FROM documents),
every AS (SELECT r, doc_id, unnest(t) AS line, generate_subscripts(t, 1) AS i FROM docs),
sized AS (SELECT *, len(regexp_extract_all(line, '[^ \x09-\x0D]+')) AS w FROM every),
full_lines AS (
  SELECT r, doc_id, i, line, w, row_number() OVER o AS p, sum(w) OVER o AS upto
  FROM sized WHERE w > 0 WINDOW o AS (PARTITION BY r ORDER BY i)),
texts AS (SELECT r, list(line ORDER BY p) AS l FROM full_lines GROUP BY r),
named AS (
  SELECT a.r, a.doc_id, a.p, b.p AS e, md5(array_to_string(l[a.p:b.p], chr(10))) AS run
  FROM full_lines a JOIN full_lines b ON a.r = b.r AND b.p >= a.p JOIN texts ON texts.r = a.r
  WHERE b.upto - a.upto + a.w >= {lines.MIN_WORDS}),
later AS (SELECT r, p, e FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, p) AS k FROM named) WHERE k > 1),
gone AS (SELECT DISTINCT r, unnest(range(p, e + 1)) AS p FROM later),
marked AS (
  SELECT s.r, s.doc_id, s.i, s.line, f.p IS NOT NULL AS has, g.p IS NOT NULL AS away
  FROM sized s LEFT JOIN full_lines f ON s.r = f.r AND s.i = f.i LEFT JOIN gone g ON f.r = g.r AND f.p = g.p)
SELECT doc_id, (count(*) FILTER (has))::BIGINT AS n_lines, (count(*) FILTER (away))::BIGINT AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT away), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents").select("doc_id"), "doc_id").select("doc_id", "slot", "shard")


#: Turns are taken one after the other; each looks along its shard's order for the first free slot.
OP2_SQL = f"""
WITH RECURSIVE
shards AS (SELECT i, md5('shard-' || i) AS d FROM range({sharding.SHARDS}) t(i)),
prefs AS (
  SELECT i, ('0x' || d[1:7])::BIGINT % {sharding.SLOTS} AS o, ('0x' || d[8:14])::BIGINT % ({sharding.SLOTS} - 1) + 1 AS s FROM shards),
orders AS (
  SELECT list(o ORDER BY i) AS os, list(s ORDER BY i) AS ss FROM prefs),
turns(t, owner) AS (
  SELECT 0, list_transform(range({sharding.SLOTS}), lambda x: -1) FROM orders
  UNION ALL
  SELECT t + 1, list_concat(list_concat(owner[1:slot], [t % {sharding.SHARDS}]), owner[slot + 2:])
  FROM (
    SELECT t, owner, list_filter(
      list_transform(range({sharding.SLOTS}), lambda j: (os[t % {sharding.SHARDS} + 1] + j * ss[t % {sharding.SHARDS} + 1]) % {sharding.SLOTS}),
      lambda x: owner[x + 1] = -1)[1] AS slot
    FROM turns, orders WHERE t < {sharding.SLOTS})),
filled AS (SELECT owner FROM turns WHERE t = {sharding.SLOTS}),
placed AS (
  SELECT doc_id, ('0x' || md5(coalesce(doc_id::VARCHAR, ''))[1:13])::BIGINT % {sharding.SLOTS} AS slot FROM documents)
SELECT doc_id, slot, owner[slot + 1]::INT AS shard FROM placed, filled
"""


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digest(decontaminate.find(docs, table(spark, sf_dir, "benchmark")))


OP4_SQL = f"""
WITH items AS (
  SELECT item_id, regexp_extract_all({_LOWER.format("text")}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
wins AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[p:p + 12], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS p FROM items WHERE len(w) > 0)),
docs AS (
  SELECT row_number() OVER () AS r, doc_id,
    coalesce(regexp_extract_all({_LOWER.format("text")}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+'), []) AS w
  FROM documents),
starts AS (
  SELECT r, n, p, array_to_string(w[p:p + n - 1], ' ') AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM docs, (SELECT DISTINCT n FROM wins) WHERE len(w) >= n)),
found AS (SELECT r, p, n, item_id FROM starts JOIN wins USING (n, win)),
hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS p FROM found) GROUP BY r),
its AS (SELECT r, list(DISTINCT item_id::VARCHAR) AS items FROM found GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(list_sort(items), ','), '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN its USING (r)
"""


def op5_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = backoff.score(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scored.select("doc_id", "n_words", F.round("score", 6).alias("score"))


OP5_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all({_LOWER.format("text")}, '[^ \x09-\x0D]+'), []) AS t FROM documents),
words AS (SELECT r, unnest(t) AS w, generate_subscripts(t, 1) AS p FROM docs),
pairs AS (SELECT r, p, w, lag(w) OVER (PARTITION BY r ORDER BY p) AS v FROM words),
n1 AS (SELECT w, count(*) AS n FROM words GROUP BY w),
n2 AS (SELECT v, w, count(*) AS n FROM pairs WHERE v IS NOT NULL GROUP BY v, w HAVING count(*) >= {backoff.LEAST}),
scores AS (
  SELECT r, CASE WHEN n2.n IS NOT NULL THEN ln(n2.n / nv.n)
    ELSE CASE WHEN pairs.v IS NULL THEN 0 ELSE ln({backoff.ALPHA}) END + ln(nw.n / (SELECT sum(n) FROM n1)) END AS s
  FROM pairs LEFT JOIN n2 ON pairs.v = n2.v AND pairs.w = n2.w LEFT JOIN n1 nv ON pairs.v = nv.w JOIN n1 nw ON pairs.w = nw.w)
SELECT doc_id, len(t)::BIGINT AS n_words, round(s, 6) AS score
FROM docs LEFT JOIN (SELECT r, avg(s) AS s FROM scores GROUP BY r) USING (r)
"""


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's ids, and the digest of the text that they decode to."""
    done = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), decoded=True)
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), pieces.ids_digest(F.col("ids")).alias("ids_sha256"), F.sha2("text", 256).alias("text_sha256"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


_WORDS = "coalesce(regexp_extract_all(text, '[^ \x09-\x0D]+'), [])"
OP7_SQL = f"""
WITH RECURSIVE
docs AS (SELECT doc_id, {_LOWER.format("x")} AS y, x FROM (SELECT doc_id, text AS x FROM documents)),
words AS (SELECT doc_id, coalesce(regexp_extract_all(y, '[^ \x09-\x0D]+'), []) AS w FROM docs),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(
    range(1, greatest(1, len(w) - 3) + 1), lambda p: array_to_string(w[p:p + 3], ' '))) END AS s
  FROM words),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT doc_id, len(s)::BIGINT AS n_shingles,
  least(doc_id, coalesce((SELECT min(b) FROM reach WHERE a = doc_id), doc_id)) AS component_id
FROM sets
"""


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.dedup(docs, with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP8_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
wins AS (
  SELECT r, p, sha256(array_to_string(w[p:p + 34], ' ')) AS h
  FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS p FROM docs WHERE len(w) >= 35)),
dup AS (SELECT r, p FROM wins WHERE h IN (SELECT h FROM wins GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT r, list(DISTINCT q) AS g FROM (SELECT r, unnest(range(p, p + 35)) AS q FROM dup) GROUP BY r),
kept AS (
  SELECT doc_id, w, g, CASE WHEN g IS NULL THEN w ELSE list_transform(
    list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(g, i)), lambda i: w[i]) END AS k
  FROM docs LEFT JOIN gone USING (r))
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(g), 0)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256
FROM kept
"""


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


OP9_SQL = """
WITH RECURSIVE
v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least_of AS (SELECT a AS vec_id, min(b) AS m FROM reach GROUP BY a),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM embeddings LEFT JOIN least_of USING (vec_id) LEFT JOIN counts USING (vec_id)
"""


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")



def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lines": op1_lines,
    "op2_sharding": op2_sharding,
    "op3_quality": op3_quality,
    "op4_decontaminate": op4_decontaminate,
    "op5_backoff": op5_backoff,
    "op6_pieces": op6_pieces,
    "op7_jaccard": op7_jaccard,
    "op8_substrings": op8_substrings,
    "op9_neighbours": op9_neighbours,
    "op10_html": op10_html,
    "pipeline": pipeline,
}
SQL: dict[str, str] = {"op1_lines": OP1_SQL, "op2_sharding": OP2_SQL, "op4_decontaminate": OP4_SQL, "op5_backoff": OP5_SQL, "op7_jaccard": OP7_SQL, "op8_substrings": OP8_SQL, "op9_neighbours": OP9_SQL}
