"""The registered query of each operator, over its whole table, and the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import fold


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op9_suffix_array_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import matches, report

    return report(matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op2_png_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .png import report

    return report(_table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judged

    return judged(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op4_bpe_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import Counts, token_counts

    return token_counts(_table(spark, sf_dir, "documents"), Counts.from_file(public_tokenizers.path("byte_bpe_50k.json")))


def op5_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .extract import main_text

    pages = _table(spark, sf_dir, "pages")
    return main_text(pages, keep=("url",)).select("page_id", "url", "text", "n_chars")


def op6_mil_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score

    docs = _table(spark, sf_dir, "documents")
    out = score(docs, toxicity_model(spark, sf_dir))
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def toxicity_model(spark: SparkSession, sf_dir: str):
    from .toxicity import train

    return train(*(_table(spark, sf_dir, t).where(fold("doc_id", 3) != 1) for t in ("documents", "labels")))


def op7_ecoc_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import predict

    docs = _table(spark, sf_dir, "documents")
    out = predict(docs, language_model(spark, sf_dir))
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def language_model(spark: SparkSession, sf_dir: str):
    from .language import train

    return train(_table(spark, sf_dir, "documents").where(fold("doc_id", 4) != 2))


def op8_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score, train

    docs = _table(spark, sf_dir, "documents")
    model = train(*(_table(spark, sf_dir, t).where(fold("doc_id", 4) != 2) for t in ("documents", "labels")))
    out = score(docs, model)
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import report

    return report(_table(spark, sf_dir, "documents"), piece_model())


def piece_model():
    import public_tokenizers

    from .pieces import Model

    return Model.from_file(public_tokenizers.path("piece_bpe_32k.model"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup,
        op2_png_media,
        op3_url_filter,
        op4_bpe_token_counts,
        op5_html_main_text,
        op6_mil_toxicity,
        op7_ecoc_language,
        op8_attention_quality,
        op9_suffix_array_decontamination,
        op10_sentencepiece,
        pipeline,
    )
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op1_minhash_near_dedup": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.id),
c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.id = d.doc_id""",
    "op9_suffix_array_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
q AS (
  SELECT DISTINCT item_id, least(len(w), 8) AS m, array_to_string(w[i : i + least(len(w), 8) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 8) + 2)) AS i FROM b WHERE len(w) > 0)
),
h AS (
  SELECT d.doc_id, i, q.m, q.item_id FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM q) WHERE len(w) >= m) d
  JOIN q ON q.m = d.m AND q.g = array_to_string(d.w[d.i : d.i + d.m - 1], ' ')
),
c AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(t.items, '')) AS items_sha256, coalesce(t.n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id""",
}


def _url_sql() -> str:
    from .url_filter import RULES, VOCABULARY

    terms = ", ".join(f"('{t}', {w})" for t, w in VOCABULARY.items())
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for (h, p), v in RULES.items())
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH terms(term, weight) AS (VALUES {terms}), rules(h, p, v) AS (VALUES {rules}),
u AS (SELECT row_number() OVER () AS k, page_id, coalesce(url, '') AS url, CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages),
s AS (SELECT k, page_id, url, {lower.format("CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, 1, strpos(rest, '/') - 1) ELSE rest END")} AS host, CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path FROM u),
r AS (SELECT k, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v FROM s JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY k),
w AS (SELECT k, sum(weight) AS weight FROM s JOIN terms ON regexp_matches({lower.format("url")}, '(^|[^0-9a-z])' || term || '([^0-9a-z]|$)') GROUP BY k)
SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN v WHEN coalesce(weight, 0) >= 2 THEN 'block' ELSE 'allow' END AS verdict
FROM s LEFT JOIN r ON r.k = s.k LEFT JOIN w ON w.k = s.k"""


ORACLE_SQL["op3_url_filter"] = _url_sql()
