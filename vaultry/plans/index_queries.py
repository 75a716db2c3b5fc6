"""The stored search index, brought up to date and asked."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import mapping, search_index
from ..session import checkpoint_folder
from ..sources.tables import table
from .registry import query
from .text_vault import _cat
from .vault_sql import with_views

_QUESTION = "AND, la of the Zusatz?"
_TERMS = ["and", "la", "of", "the", "zusatz"]

#: A third of the texts changes, some go, some come.
TEXTS = """
old_v AS (SELECT doc_id, text FROM documents WHERE doc_id % 7 <> 3),
new_v AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || ' Zusatz of ' || doc_id ELSE text END AS text FROM documents
          WHERE doc_id % 11 <> 5)"""


def versions(spark, sf):
    """The texts before and after; every text that has one brings a vector."""
    key, docs = F.col("doc_id"), table(spark, sf, "documents")
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = docs.select("doc_id", "text").join(vectors, "doc_id", "left")
    changed = F.when(key % 3 == 0, _cat(F.col("text"), " Zusatz of ", key.cast("string"))).otherwise(F.col("text"))
    before = rows.where(key % 7 != 3).select(key.cast("string").alias("key"), F.col("text").alias("content"), "vector")
    after = rows.where(key % 11 != 5).select(key.cast("string").alias("key"), changed.alias("content"), "vector")
    return before, after


def _index(spark, sf) -> str:
    """An index of the earlier texts that was updated to the later ones."""
    folder = f"{checkpoint_folder(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
    before, after = versions(spark, sf)
    search_index.update(spark, folder, before)
    search_index.update(spark, folder, after)
    return folder


_LEXICAL = f"""
t_v AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS toks FROM new_v),
f_v AS (SELECT doc_id, len, term, len(list_filter(toks, lambda x: x = term)) AS tf
        FROM (SELECT doc_id, len(toks) AS len, unnest({_TERMS}) AS term, toks FROM t_v)),
st_v AS (SELECT count(*) AS n, avg(len(toks)) AS av FROM t_v),
df_v AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM f_v GROUP BY term),
lexical_v AS (
  SELECT doc_id::VARCHAR AS key, round(sum(CASE WHEN tf > 0 THEN ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2
    / (tf + 1.2 * (0.25 + 0.75 * len / av)) ELSE 0 END), 6) AS score
  FROM f_v JOIN df_v USING (term) CROSS JOIN st_v GROUP BY doc_id HAVING score > 0 ORDER BY score DESC, key LIMIT 15)"""


@query("search_index_lexical", with_views(TEXTS, _LEXICAL) + "SELECT key, score FROM lexical_v")
def search_index_lexical(spark, sf):
    return search_index.lexical(spark, _index(spark, sf), _QUESTION)


@query(
    "search_index_changes",
    with_views(TEXTS)
    + """SELECT CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'deleted' WHEN o.text <> n.text THEN 'changed' ELSE 'same' END AS change,
           count(*) AS texts FROM old_v o FULL JOIN new_v n USING (doc_id) GROUP BY ALL""",
)
def search_index_changes(spark, sf):
    folder = f"{checkpoint_folder(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
    before, after = versions(spark, sf)
    search_index.update(spark, folder, before)
    return search_index.changes(spark, folder, after).groupBy("change").agg(F.count(F.lit(1)).alias("texts"))


_VECTOR = """
vector_v AS (
  SELECT doc_id::VARCHAR AS key, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]),
    (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6) AS similarity
  FROM embeddings JOIN new_v ON vec_id = doc_id ORDER BY similarity DESC, key LIMIT 15)"""


def _asked(spark, sf) -> list[float]:
    return list(table(spark, sf, "embeddings").where("vec_id = 0").select("embedding").first()[0])


@query("search_index_nearest", with_views(TEXTS, _VECTOR) + "SELECT key, similarity FROM vector_v")
def search_index_nearest(spark, sf):
    return search_index.nearest(spark, _index(spark, sf), _asked(spark, sf))


_FUSED = """
ranked_v AS (
  SELECT key, l.r AS lexical_rank, v.r AS vector_rank,
    round(coalesce(1.0 / (60 + l.r), 0) + coalesce(1.0 / (60 + v.r), 0), 9) AS score
  FROM (SELECT key, row_number() OVER (ORDER BY score DESC, key) AS r FROM lexical_v) l
  FULL JOIN (SELECT key, row_number() OVER (ORDER BY similarity DESC, key) AS r FROM vector_v) v USING (key))"""


@query(
    "search_index_fused",
    with_views(TEXTS, _LEXICAL, _VECTOR, _FUSED)
    + "SELECT key, score::DOUBLE AS score, lexical_rank, vector_rank FROM ranked_v ORDER BY score DESC, key LIMIT 20",
)
def search_index_fused(spark, sf):
    folder = _index(spark, sf)
    hits = search_index.fused(
        search_index.lexical(spark, folder, _QUESTION), search_index.nearest(spark, folder, _asked(spark, sf)), 20
    )
    return hits.select("key", "score", F.col("lexical_rank").cast("bigint").alias("lexical_rank"), F.col("vector_rank").cast("bigint").alias("vector_rank"))


@query(
    "search_hit_lines",
    with_views(TEXTS, _LEXICAL)
    + "SELECT row_number() OVER (ORDER BY score DESC, key) - 1 AS rank, 'notes://vault/raw/' || key || '.md' AS id FROM lexical_v",
)
def search_hit_lines(spark, sf):
    """Hits of the index as ``score,path`` lines among lines that are none, read as ranks and ids."""
    hits = search_index.lexical(spark, _index(spark, sf), _QUESTION)
    named = hits.withColumn("key", _cat("notes://vault/raw/", F.col("key"), ".md"))
    place = F.row_number().over(Window.orderBy(F.desc("score"), "key")) - 1  # of fifteen rows
    placed = named.select(place.alias("line_no"), search_index.hit_line("score").alias("line"))
    lines = placed.select("line_no", F.explode(F.array(F.col("line"), F.lit("searched 3 collections"), F.lit("best, first"))).alias("value"))
    return mapping.parse_hit_lines(lines).select(F.col("rank").cast("bigint").alias("rank"), "id")
