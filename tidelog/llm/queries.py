"""The corpus operators as named queries over the driver's tables, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import ann, decontamination, html, lm, negatives, neardup, packing, phrases, pii, ranking, substrings, tokens, toxicity
from tidelog.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = toxicity.fit(documents, table(spark, sf_dir, "labels"))
    return toxicity.grade(documents.select("doc_id", "text"), model).drop("text")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html.extract(pages, html.fit(pages))


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), neardup.Params(shingle=4))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"), neighbours=20)


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents")).drop("kept", "spans")


def op11_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.fingerprints(table(spark, sf_dir, "documents"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mined(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=label)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_token_counts": op2_token_counts,
    "op3_neighbours": op3_neighbours,
    "op4_packing": op4_packing,
    "op5_repeats": op5_repeats,
    "op6_decontamination": op6_decontamination,
    "op7_html": op7_html,
    "op8_lm_scores": op8_lm_scores,
    "op9_minhash": op9_minhash,
    "op10_pii": op10_pii,
    "op11_ranking": op11_ranking,
    "op12_phrases": op12_phrases,
    "op13_negatives": op13_negatives,
}

_WORDS = r"list_filter(regexp_split_to_array({0}, '[\x09-\x0D\x20]+'), lambda x: x <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    # every given page marks its text by one article element, and holds few character references
    "op7_html": r"""WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article[^>]*>(.*)</article>', 1) AS h FROM pages),
 t AS (SELECT page_id, url, regexp_replace(regexp_replace(h, '</?b>', '', 'g'), '<[^>]+>', ' ', 'g') AS t FROM a),
 d AS (SELECT page_id, url, trim(regexp_replace(replace(replace(replace(replace(replace(t, '&quot;', '"'), '&middot;', '·'), '&copy;', '©'), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM t)
 SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM d""",
    "op11_ranking": f"""WITH d AS (SELECT doc_id, {_TERMS} AS ts FROM documents), total AS (SELECT count(*) AS n, CAST(sum(len(ts)) AS BIGINT) AS l FROM d WHERE len(ts) > 0),
 asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark), each AS (SELECT doc_id, len(ts) AS n, unnest(ts) AS term FROM d),
 tf AS (SELECT doc_id, n, term, count(*) AS tf FROM each WHERE term IN (SELECT term FROM asked) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
 w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * total.n + 2) / (2 * df + 1))) AS BIGINT) AS w FROM df, total),
 s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * tf.n * total.n) // total.l)))) AS BIGINT) AS score FROM asked JOIN tf USING (term) JOIN w USING (term), total GROUP BY item_id, doc_id)
 SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 50""",
    "op5_repeats": f"""WITH w AS (SELECT doc_id, row_number() OVER () AS k, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
 windows AS (SELECT k, s, md5(array_to_string(ws[s:s + 34], ' ')) AS h FROM (SELECT k, ws, unnest(range(1, len(ws) - 33)) AS s FROM w)),
 again AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
 gone AS (SELECT DISTINCT k, unnest(range(s, s + 35)) AS i FROM windows WHERE h IN (SELECT h FROM again)),
 each AS (SELECT k, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
 kept AS (SELECT k, string_agg(word, ' ' ORDER BY i) AS text FROM each ANTI JOIN gone USING (k, i) GROUP BY k), n AS (SELECT k, count(*) AS removed FROM gone GROUP BY k)
 SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(removed, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM w LEFT JOIN n USING (k) LEFT JOIN kept USING (k)""",
    "op9_minhash": f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS ws FROM documents),
 s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS g FROM w),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
 links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
 ways AS (SELECT a AS x, b AS y FROM links UNION SELECT b, a FROM links), reach(node, label) AS (SELECT x, x FROM ways UNION SELECT y, label FROM reach JOIN ways ON node = x),
 parts AS (SELECT node AS doc_id, min(label) AS component FROM reach GROUP BY node)
 SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(component, doc_id) = doc_id AS kept FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN parts USING (doc_id)""",
    "op13_negatives": """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
 p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
 SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INT) AS rank, id AS negative_id, positive_score, score AS negative_score
 FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10""",
}
