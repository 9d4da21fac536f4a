"""The registered queries of the operators, with production parameters, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import archive, audio, codec, common, langid, line_dedup, near_duplicates, packing, topk, toxicity, training_order

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sequence of the packed documents: its slot, where its shard holds it, and the documents in it, as read back."""
    path = common.new_path(spark, "shards")
    n, index = training_order.shards(common.table(spark, sf_dir, "documents"), TOKENIZER, key=20240229, path=path)
    schema = "slot long, shard long, byte_offset long, sequence_id long, n_ids long, ids_crc32 long, sound boolean"
    held = training_order.read(spark, path) if n else spark.createDataFrame([], schema)
    docs = index.groupBy("slot").agg(F.transform(F.sort_array(F.collect_list(F.struct("offset", "doc_id"))), lambda x: x["doc_id"]).alias("doc_ids"))
    return held.join(docs, "slot")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.table(spark, sf_dir, "documents"), TOKENIZER, with_ids=False).drop("ids")


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.round_trip(common.table(spark, sf_dir, "documents"), TOKENIZER)


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


#: What op4 returns, in SQL.
OP4_SQL = """
WITH v AS (SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_training_order": op1_training_order,
    "op2_packing": op2_packing,
    "op3_bpe_codec": op3_bpe_codec,
    "op4_exact_topk": op4_exact_topk,
}
ORACLE_SQL: dict[str, str] = {"op4_exact_topk": OP4_SQL}


def op6_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as ARC files of both versions, converted to WARC files, which are read back."""
    arc, warc = common.new_path(spark, "arc"), common.new_path(spark, "warc")
    archive.write_arc(common.table(spark, sf_dir, "pages"), arc)
    archive.write_warc(common.read_blobs(spark, arc), warc)
    return archive.read_warc(spark, warc).drop("url")


QUERIES["op6_arc_to_warc"] = op6_arc_to_warc


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(common.table(spark, sf_dir, "documents"))


QUERIES["op9_language_id"] = op9_language_id


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


QUERIES["op10_toxicity"] = op10_toxicity


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.join(common.table(spark, sf_dir, "documents"))


QUERIES["op8_jaccard_join"] = op8_jaccard_join


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(common.table(spark, sf_dir, "documents"))


#: What op5 returns, in SQL: all pairs of different lines that share a shingle.
OP5_SQL = """
WITH l AS (SELECT doc_id, pos - 1 AS pos, list_filter(string_split(translate(lower(line), chr(9) || chr(13) || chr(12) || chr(11), '    '), ' '), lambda w: w <> '') AS w
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE doc_id IS NOT NULL)),
k AS (SELECT doc_id, pos, array_to_string(w, ' ') AS lid, w FROM l WHERE len(w) > 0),
f AS (SELECT lid, min((doc_id, pos)) AS first, any_value(w) AS w FROM k GROUP BY lid),
s AS (SELECT lid, first, list_distinct(CASE WHEN len(w) < 5 THEN [lid] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS t FROM f),
x AS (SELECT lid, first, len(t) AS n, unnest(t) AS g FROM s),
c AS (SELECT a.lid, count(*) AS inter, any_value(a.n) AS n, any_value(b.n) AS m FROM x a JOIN x b ON a.g = b.g AND b.first < a.first GROUP BY a.lid, b.lid),
near AS (SELECT DISTINCT lid FROM c WHERE inter >= 0.8 * (n + m - inter) - 1e-9),
gone AS (SELECT k.doc_id, k.pos FROM k JOIN f USING (lid) LEFT JOIN near USING (lid) WHERE near.lid IS NOT NULL OR (k.doc_id, k.pos) <> f.first),
r AS (SELECT doc_id, count(*) AS n_removed, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS removed FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed
FROM documents d LEFT JOIN r USING (doc_id)
"""
QUERIES["op5_line_dedup"] = op5_line_dedup
ORACLE_SQL["op5_line_dedup"] = OP5_SQL


def op7_chroma_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no audio, so every vector of embeddings is made audible first."""
    prints = audio.fingerprints(common.table(spark, sf_dir, "embeddings"), audio.sonified, ["embedding"], "vec_id")
    return audio.match(prints).withColumnsRenamed({"id": "vec_id", "n": "n_values", "crc": "values_crc32"})


QUERIES["op7_chroma_match"] = op7_chroma_match
