"""The registered queries of the subpackage, each over whole tables, with SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_tree, hard_negatives, lm, mixing, neighbours, periods, rules, secrets, simhash, token_files, toxicity, warc
from .shared import documents

TOKENIZER = "byte_bpe_50k.json"

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


@query("op1_nn_descent_near_dedup")
def nn_descent_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.near_duplicates(spark.read.parquet(f"{folder}/embeddings.parquet"))


@query("op2_counterfactual_toxicity")
def counterfactual_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return toxicity.scored(docs, toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet")))


WARC_SQL = r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS r FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN r <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN r <> page_id THEN r END AS refers_to FROM q
"""


@query("op3_warc_dictionary", WARC_SQL)
def warc_dictionary(spark: SparkSession, folder: str) -> DataFrame:
    manifest = warc.write(spark.read.parquet(f"{folder}/pages.parquet"))
    return warc.read(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op4_simhash_near_dedup")
def simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.grouped(documents(spark, folder))


RULES_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i+1], w[i+2], w[i+3], w[i+4]) AS n
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
r AS (
  SELECT doc_id, count(*) AS n FROM (
    SELECT DISTINCT doc_id, i + unnest(range(0, 5)) AS p FROM g WHERE n > 1) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
    len(l)::BIGINT AS n_lines, (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::BIGINT AS n_caps
  FROM w LEFT JOIN r USING (doc_id)),
f AS (
  SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > 5 * n_words THEN 4 ELSE 0 END
    + CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN n_words > 0 AND word_chars < 2 * n_words THEN 16 ELSE 0 END
    + CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END
    + CASE WHEN 10 * n_caps > 4 * word_chars THEN 64 ELSE 0 END)::BIGINT AS failed_bits FROM m)
SELECT *, 2 AS policy, (failed_bits & 3) <> 0 AS base_failed, failed_bits = 0 AS kept FROM f
"""


@query("op5_rule_bitmask_ledger", RULES_SQL)
def rule_bitmask_ledger(spark: SparkSession, folder: str) -> DataFrame:
    return rules.verdicts(rules.ledger(documents(spark, folder)))


MIXING_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, 3 * source_size AS cap, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM s),
l AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS budget,
    sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS shares
  FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)),
c AS (SELECT *, cap * shares <= budget * weight AS capped FROM l),
v AS (SELECT budget, shares FROM c WHERE NOT capped ORDER BY cap / weight, source NULLS LAST LIMIT 1),
t AS (
  SELECT source, source_size,
    CASE WHEN capped THEN cap::DOUBLE ELSE (v.budget * weight)::DOUBLE / v.shares END AS target
  FROM c LEFT JOIN v ON true),
u AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t),
x AS (
  SELECT d.*, source_size, target, whole + CASE WHEN
    sum(size) OVER (PARTITION BY d.source ORDER BY h) <= target - whole * source_size THEN 1 ELSE 0 END AS copies
  FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source)
SELECT doc_id, source, size, source_size, target, copies::BIGINT AS copies, (size * copies)::BIGINT AS taken FROM x
"""


@query("op6_hash_threshold_mix", MIXING_SQL)
def hash_threshold_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed(documents(spark, folder))


@query("op7_secret_forest")
def secret_forest(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.findings(documents(spark, folder))


@query("op8_orc_token_files")
def orc_token_files(spark: SparkSession, folder: str) -> DataFrame:
    files = token_files.write(documents(spark, folder), public_tokenizers.path(TOKENIZER))
    return token_files.checksums(token_files.read(spark, files))


@query("op9_backoff_automaton")
def backoff_automaton(spark: SparkSession, folder: str) -> DataFrame:
    return lm.scored(documents(spark, folder))


@query("op10_bpe_transducer")
def bpe_transducer(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    coded = bpe.encode(docs, public_tokenizers.path(TOKENIZER), ids=False, keep_text=False)
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


NEGATIVES_SQL = r"""
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
p AS (SELECT * FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, p.vec_id AS positive_id,
  (row_number() OVER (PARTITION BY anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id))::INT AS rank,
  s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT s.alike AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
QUALIFY rank <= 3
"""


@query("op11_one_bit_hard_negatives", NEGATIVES_SQL)
def one_bit_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = hard_negatives.with_moved_labels(spark.read.parquet(f"{folder}/embeddings.parquet"))
    return hard_negatives.mine(rows, F.col("vec_id") % 50 == 0)


@query("op12_block_convolution_runs")
def block_convolution_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periods.digest(periods.detect(periods.with_planted_periods(documents(spark, folder))))


CHAT_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, t, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(t, r)),
e AS (
  SELECT *, replace(replace(role, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n') AS head FROM c),
f AS (
  SELECT *, length(head) + length(text) + len(regexp_extract_all(head, '<\\*\|')) + len(regexp_extract_all(text, '<\\*\|')) + 24 AS chars FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""


@query("op13_prefix_tree_chat", CHAT_SQL)
def prefix_tree_chat(spark: SparkSession, folder: str) -> DataFrame:
    conversations = chat_tree.with_control_strings(spark.read.parquet(f"{folder}/conversations.parquet"))
    tree = chat_tree.write(conversations, public_tokenizers.path(TOKENIZER))
    return chat_tree.digest(chat_tree.read(spark, tree))
