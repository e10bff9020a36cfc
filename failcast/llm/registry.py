"""Driver queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from failcast.llm import (bpe, embeddings, filter_audit, hpylm, jaccard, licenses, line_templates, mixing, passages, periods, pieces,
                          quality, url_rules)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder. Texts can be long, so Arrow batches are kept to few rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", corpus_pipeline.ARROW_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pitman_yor_scores(spark, sf_dir):
    return hpylm.document_scores(table(spark, sf_dir, "documents"))


def op2_license_diagonals(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_p_stable_neighbours(spark, sf_dir):
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_curriculum_mix(spark, sf_dir):
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op5_url_rules(spark, sf_dir):
    return url_rules.page_verdicts(table(spark, sf_dir, "pages"))


def op6_adaptive_jaccard(spark, sf_dir):
    return jaccard.link_components(table(spark, sf_dir, "documents"), k=3, percent=90)


def op7_line_field_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.judged(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op8_line_templates(spark, sf_dir):
    return line_templates.cleaned(table(spark, sf_dir, "documents"))


def op9_repeated_passages(spark, sf_dir):
    return passages.removed(table(spark, sf_dir, "documents"))


def op10_bpe_round_trip(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"), corpus_pipeline.tokenizer_path())


def op11_periodic_runs(spark, sf_dir):
    return periods.digests(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark, sf_dir):
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_merge_rounds(spark, sf_dir):
    return pieces.round_trip(table(spark, sf_dir, "documents"), pieces.model_path())


QUERIES = {f.__name__: f for f in (op1_pitman_yor_scores, op2_license_diagonals, op3_p_stable_neighbours, op4_curriculum_mix, op5_url_rules, op6_adaptive_jaccard,
                                    op7_line_field_quality, op8_line_templates, op9_repeated_passages, op10_bpe_round_trip,
                                    op11_periodic_runs, op12_filter_audit, op13_merge_rounds)}
QUERIES["pipeline"] = corpus_pipeline.run
ORACLE: dict[str, str] = {"op4_curriculum_mix": mixing.mixed_sql(), "op5_url_rules": url_rules.page_verdicts_sql(),
                          "op8_line_templates": line_templates.cleaned_sql(), "op12_filter_audit": filter_audit.audit_sql()}
