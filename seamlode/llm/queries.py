"""The queries ``opN_<name>`` and ``pipeline``, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamlode.llm import descriptors, hmm, licenses, packing, piece_dropout, rules, simhash, sst, suffix, tokens, topk
from seamlode.llm.common import crc_mod, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under the hidden Markov model and the unigram base."""
    return hmm.score(table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 7) == 2)


@query
def op2_sst_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written to shards and read back."""
    folder = sst.shard_folder(spark)
    return sst.scan_shards(sst.write_shards(table(spark, sf_dir, "documents"), folder, tokens.public_vocabulary()))


@query
def op3_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies among the images that the vectors of ``embeddings`` draw."""
    found = descriptors.copies(descriptors.rendered(table(spark, sf_dir, "embeddings")))
    return found.withColumnRenamed("id", "vec_id")


@query
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash class of every document (3-word shingles, 64 bits, radius 2)."""
    found = simhash.near_duplicate_classes(table(spark, sf_dir, "documents"), width=3)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.hex("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


@query
def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best integer inner products of every 50th vector."""
    return topk.top_k(table(spark, sf_dir, "embeddings"))


ORACLE["op5_top_k"] = """
WITH v AS (
  SELECT row_number() OVER () AS at, vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.at AS q_at, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.at <> c.at
), r AS (SELECT *, row_number() OVER (PARTITION BY q_at ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


@query
def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every document.

    Documents have no paths, so they are placed at <source>/<lang>/<thousands>/<hundreds>/<id>.txt;
    ids that 100 divides are the LICENSE.txt of that directory, those that 1000 divides of the one above.
    """
    docs, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    folder = [F.col("source"), F.col("lang"), F.floor(i / 1000).cast("string")]
    hundreds, named = F.floor(i / 100).cast("string"), F.lit("LICENSE.txt")
    path = F.when(i % 1000 == 0, F.concat_ws("/", *folder, named)).when(i % 100 == 0, F.concat_ws("/", *folder, hundreds, named)).otherwise(F.concat_ws("/", *folder, hundreds, F.concat(i.cast("string"), F.lit(".txt"))))
    return licenses.detect(docs.select("doc_id", path.alias("path"), "text")).withColumnRenamed("id", "doc_id")


@query
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated strings of 200 bytes."""
    return suffix.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of at most 1024 ids."""
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), tokens.public_vocabulary()))


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned outside the held-out third."""
    docs = table(spark, sf_dir, "documents")
    model = rules.train(docs, table(spark, sf_dir, "labels"), fold=1, folds=3)
    held = crc_mod(F.col("id"), 3) == 1
    return rules.score(docs, model).select(
        F.col("id").alias("doc_id"), held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query
def op9_piece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with merge dropout at rate 0.1 and decoded again."""
    docs = table(spark, sf_dir, "documents")
    found = piece_dropout.encode_documents(docs, tokens.public_vocabulary("piece_bpe_32k.model"), rate=0.1, seed=17)
    return found.withColumnRenamed("id", "doc_id")
