"""A stored search index that follows changes of its texts.

A generation is a folder of postings (term, key, tf, length), dealt into buckets by term and sorted by term within them, and a folder of
vectors; a question reads the buckets and row groups of its terms.  An update compares content hashes and writes a generation with the texts that
are new or changed, the keys whose entries in earlier generations are dead from then on, and a table of all live texts.  Dead entries
go when generations are merged.  Versions are published by :mod:`vaultry.sinks.commits`, so readers see one state or the next.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sinks import commits
from .retrieval import B, K1, cosine, lexical_index, question_terms

#: Folders that postings are dealt into, by term.
BUCKETS = 64
#: Generations above which an update writes all live postings as one.
MOST_GENERATIONS = 8
#: Fixed value: the rank that reciprocal rank fusion adds to every rank.
FUSION = 60

_LIVE = "key string, hash string, length bigint, generation string"
_DEAD = "key string, generation string"
_VECTORS = "key string, vector array<double>"
_POSTINGS = "term string, key string, tf bigint, length bigint, bucket int"


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _table(spark: SparkSession, folder: str, schema: str, names: list[str], generations: bool = False) -> DataFrame:
    """The rows of some data folders, with the name of each as ``generation`` if asked for."""
    if not names:
        return spark.createDataFrame([], f"{schema}, generation string" if generations else schema)
    parts = [spark.read.schema(schema).parquet(f"{folder}/{name}") for name in names]
    if generations:
        parts = [part.withColumn("generation", F.lit(name.rsplit("-", 1)[1])) for name, part in zip(names, parts)]
    return reduce(DataFrame.unionByName, parts)


def _live(spark: SparkSession, folder: str, content: dict) -> DataFrame:
    return _table(spark, folder, _LIVE, [content["live"]] if content else [])


def _kept(rows: DataFrame, spark: SparkSession, folder: str, content: dict) -> DataFrame:
    """Rows of generations without those of texts that were changed or deleted since."""
    return rows.join(_table(spark, folder, _DEAD, content.get("dead", [])), ["key", "generation"], "left_anti")


def _write_postings(postings: DataFrame, folder: str) -> None:
    (
        postings.select("term", "key", "tf", "length", _bucket(F.col("term")).alias("bucket"))
        # a range on the term too, so that a frequent term's postings are several tasks' work
        .repartitionByRange("bucket", "term", "key").sortWithinPartitions("bucket", "term", "key")
        .write.partitionBy("bucket").parquet(folder)
    )


def changes(spark: SparkSession, folder: str, texts: DataFrame) -> DataFrame:
    """What an update with ``texts`` would do: key, change (added, changed, deleted, same)."""
    folder = folder.rstrip("/")
    return _compared(_live(spark, folder, commits.current(spark, folder)[1]), _texts(texts)).select("key", "change")


def _texts(texts: DataFrame) -> DataFrame:
    vector = (F.col("vector") if "vector" in texts.columns else F.lit(None)).cast("array<double>")
    return texts.select(F.col("key").cast("string").alias("key"), F.coalesce("content", F.lit("")).alias("content"), vector.alias("vector"))


def _compared(live: DataFrame, texts: DataFrame) -> DataFrame:
    digest = F.concat(F.sha2(F.col("content").cast("binary"), 256), F.lit(":"), F.hex(F.xxhash64("vector")))
    now = texts.select("key", digest.alias("_now"))
    before, after = F.col("hash"), F.col("_now")
    change = F.when(before.isNull(), "added").when(after.isNull(), "deleted").when(before != after, "changed").otherwise("same")
    return live.join(now, "key", "full").select("key", "length", "generation", "_now", change.alias("change"))


def update(spark: SparkSession, folder: str, texts: DataFrame, operation: str | None = None) -> int:
    """Bring the index to ``texts``: key, content and, if there, vector (array of numbers); returns the version.

    ``key`` is unique and not NULL; a NULL content is indexed as an empty text.  Only new and changed texts are cut into terms.  An update
    that is repeated under one ``operation`` name is done once.
    """
    folder, texts = folder.rstrip("/"), _texts(texts)

    def write(before: dict) -> dict:
        number = uuid.uuid4().hex
        name = {kind: f"{kind}-{number}" for kind in ("compared", "postings", "vectors", "dead", "live")}
        at = {kind: f"{folder}/{n}" for kind, n in name.items()}
        _compared(_live(spark, folder, before), texts).write.parquet(at["compared"])
        compared = spark.read.parquet(at["compared"])
        fresh = F.col("change").isin("added", "changed")
        new = texts.join(compared.where(fresh).select("key"), "key", "left_semi")
        _write_postings(lexical_index(new, "key", "content").withColumnRenamed("doc_length", "length"), at["postings"])
        new.where("vector IS NOT NULL").select("key", "vector").write.parquet(at["vectors"])
        compared.where("change IN ('changed', 'deleted')").select("key", "generation").write.parquet(at["dead"])
        # lengths come from the postings: a text without terms has none, and length 0
        sizes = _table(spark, folder, _POSTINGS, [name["postings"]]).groupBy("key").agg(F.first("length").alias("_length"))
        compared.where("change <> 'deleted'").join(sizes, "key", "left").select(
            "key", F.col("_now").alias("hash"), F.when(fresh, F.coalesce("_length", F.lit(0))).otherwise(F.col("length")).alias("length"),
            F.when(fresh, F.lit(number)).otherwise(F.col("generation")).alias("generation"),
        ).write.parquet(at["live"])
        content = {k: [*before.get(k, []), name[k]] for k in ("postings", "vectors", "dead")} | {"live": name["live"]}
        n, total = _live(spark, folder, content).agg(F.count(F.lit(1)), F.sum("length")).first()
        content |= {"texts": n, "terms": total or 0}
        return _merged(spark, folder, content) if len(content["postings"]) > MOST_GENERATIONS else content

    return commits.once(spark, folder, operation or uuid.uuid4().hex, write)


def _merged(spark: SparkSession, folder: str, content: dict) -> dict:
    """All that is live as one generation."""
    number = uuid.uuid4().hex
    name = {kind: f"{kind}-{number}" for kind in ("postings", "vectors", "live")}
    for kind, schema in (("postings", _POSTINGS), ("vectors", _VECTORS)):
        rows = _kept(_table(spark, folder, schema, content[kind], generations=True), spark, folder, content).drop("generation")
        if kind == "postings":
            _write_postings(rows, f"{folder}/{name[kind]}")
        else:
            rows.write.parquet(f"{folder}/{name[kind]}")
    _live(spark, folder, content).withColumn("generation", F.lit(number)).write.parquet(f"{folder}/{name['live']}")
    return content | {"postings": [name["postings"]], "vectors": [name["vectors"]], "live": name["live"], "dead": []}


def compact(spark: SparkSession, folder: str, operation: str | None = None) -> int:
    """Write all that is live as one generation; returns the version."""
    folder = folder.rstrip("/")
    return commits.once(spark, folder, operation or uuid.uuid4().hex, lambda before: _merged(spark, folder, before))


def _asked(spark: SparkSession, terms: list[str]) -> Column:
    """Condition on postings: the terms, and the buckets they lie in, as literals that prune folders and row groups."""
    buckets = [r[0] for r in spark.createDataFrame([(t,) for t in terms], "term string").select(_bucket(F.col("term"))).distinct().collect()]
    return F.col("bucket").isin(buckets) & F.col("term").isin(terms)


def lexical(spark: SparkSession, folder: str, question: str, k: int = 15) -> DataFrame:
    """Top ``k`` live texts for a question by BM25: key, score.  Reads the postings of the question's terms alone."""
    folder = folder.rstrip("/")
    content, terms = commits.current(spark, folder)[1], question_terms(question)
    if not terms or not content:
        return spark.createDataFrame([], "key string, score double")
    postings = _table(spark, folder, _POSTINGS, content["postings"], generations=True).where(_asked(spark, terms))
    hits = _kept(postings, spark, folder, content)
    held = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # a row for every term asked
    n, average = F.lit(content["texts"]), F.lit(content["terms"] / max(content["texts"], 1))
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + K1 * (1 - B + B * F.col("length") / average)
    scored = hits.join(F.broadcast(held), "term").groupBy("key").agg(F.round(F.sum(idf * F.col("tf") * (K1 + 1) / norm), 6).alias("score"))
    return scored.where("score > 0").orderBy(F.desc("score"), "key").limit(k)


def nearest(spark: SparkSession, folder: str, asked: list[float], k: int = 15) -> DataFrame:
    """Top ``k`` live texts by cosine similarity of their stored vectors: key, similarity."""
    folder = folder.rstrip("/")
    content = commits.current(spark, folder)[1]
    vectors = _kept(_table(spark, folder, _VECTORS, content.get("vectors", []), generations=True), spark, folder, content)
    wanted = F.array(*[F.lit(float(x)) for x in asked])
    close = vectors.where(F.size("vector") == len(asked)).select("key", F.round(cosine(F.col("vector"), wanted), 6).alias("similarity"))
    return close.where("similarity IS NOT NULL").orderBy(F.desc("similarity"), "key").limit(k)


def _ranked(hits: DataFrame, score: str) -> DataFrame:
    # at most the k rows of a top-k report
    return hits.select("key", F.row_number().over(Window.orderBy(F.desc(score), "key")).alias("rank"))


def fused(lexical_hits: DataFrame, vector_hits: DataFrame, k: int = 15) -> DataFrame:
    """Reciprocal rank fusion of two top lists: key, score, lexical_rank, vector_rank; a text may be in one list only."""
    a = _ranked(lexical_hits, "score").withColumnRenamed("rank", "lexical_rank")
    b = _ranked(vector_hits, "similarity").withColumnRenamed("rank", "vector_rank")
    part = lambda c: F.coalesce(1.0 / (F.col(c) + FUSION), F.lit(0.0))
    both = a.join(b, "key", "full").withColumn("score", F.round(part("lexical_rank") + part("vector_rank"), 9))
    return both.orderBy(F.desc("score"), "key").limit(k).select("key", "score", "lexical_rank", "vector_rank")


def hit_line(score: str) -> Column:
    """A hit as the ``score,path`` line that :func:`vaultry.operators.mapping.parse_hit_lines` reads."""
    return F.format_string("%.6f,%s", score, "key")
