"""The queries of this subpackage: one for each operator, over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.llm import bpe, context_trees, edit_embedding, filter_audit, licenses, neighbours, packing, range_join, secrets, simhash, token_files, toxicity, whitening
from tarnwick.llm.common import shared_path


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    token_files.write_tokens(documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.with_checksums(token_files.read_tokens(spark, path, "n_tokens", "ids"))


def op4_context_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    return context_trees.score(documents(spark, sf_dir), ~held_out)


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(documents(spark, sf_dir))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op7_embedding_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_join.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op9_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_embedding.compare_with_edits(documents(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.learn_from_labels(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


#: The audit said plainly: each order is applied to each document's mask.
FILTER_AUDIT_SQL = """
with docs as (
  select doc_id, coalesce(lang, '') part, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') w from documents),
failed as (
  select part, doc_id, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * len(t),
    regexp_matches(t, '[#$%&*|]'), coalesce(min(doc_id) over (partition by t) < doc_id, false)] f from docs),
tags as (select doc_id, bool_or(quality = 1) good, bool_or(toxic = 1) toxic from labels group by doc_id),
masks as (
  select part, f, coalesce(good, false) good, coalesce(toxic, false) toxic, count(*) n
  from failed left join tags using (doc_id) group by all),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) l, unnest([1, 2, 3, 4, 5]) i),
orders as (
  select a.l || b.l || c.l || d.l || e.l filter_order, [a.i, b.i, c.i, d.i, e.i] o from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
steps as (select *, unnest([1, 2, 3, 4, 5]) step from orders),
each_step as (
  select part, filter_order, step, o[step] own, n, good, toxic, f[o[step]] fails, len(list_filter(f, lambda x: x)) many,
    len(list_filter(o[:step - 1], lambda k: f[k])) > 0 gone from masks, steps),
counted as (
  select part, filter_order, step, own, sum(case when not gone and not fails then n else 0 end) kept, sum(case when not gone and fails then n else 0 end) removed,
    sum(case when gone and fails then n else 0 end) redundant, sum(case when fails and many = 1 then n else 0 end) unique_fails,
    sum(case when not gone and fails and good then n else 0 end) good_lost, sum(case when not gone and fails and toxic then n else 0 end) toxic_lost
  from each_step group by all)
select part, filter_order, cast(step as int) step, cast(kept as bigint) kept, cast(removed as bigint) removed, cast(redundant as bigint) redundant,
  cast(unique_fails as bigint) unique_fails, cast(good_lost as bigint) good_lost, cast(toxic_lost as bigint) toxic_lost,
  cast(sum(removed) over (partition by part, own) as bigint) shapley from counted"""

QUERIES = {
    f.__name__: f
    for f in (
        op1_byte_bpe, op2_license_scans, op3_token_files, op4_context_trees, op5_secret_scans, op6_best_fit_packing, op7_embedding_range_join,
        op8_simhash, op9_edit_fingerprints, op10_toxicity, op11_filter_audit, op12_projection_forest, op13_whitening,
    )
}
ORACLES: dict[str, str] = {"op11_filter_audit": FILTER_AUDIT_SQL}
