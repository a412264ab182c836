"""Queries of the training-data operators, over the whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.sources.tables import spread, table

FIELDS = ("code", "body")


def _p1_texts(spark: SparkSession, d: str) -> DataFrame:
    code = table(spark, d, "masked_files", "file_id", "code").select(F.lit(0).alias("field"), F.col("file_id").alias("rec"), F.col("code").alias("text"))
    body = table(spark, d, "if_branches", "branch_id", "body").select(F.lit(1).alias("field"), F.col("branch_id").alias("rec"), F.col("body").alias("text"))
    return code.unionByName(body)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from lodestrata.llm.spans import shared_spans

    name = F.when(F.col("field") == 0, FIELDS[0]).otherwise(FIELDS[1])
    return shared_spans(_p1_texts(spark, d)).select(name.alias("field"), F.col("rec").alias("record_id"), "from_pos", "to_pos")


def _p1_named(df: DataFrame) -> DataFrame:
    name = F.when(F.col("field") == 0, FIELDS[0]).otherwise(FIELDS[1])
    return df.withColumn("field", name).withColumnRenamed("rec", "record_id")


def p1_shares(spark: SparkSession, d: str) -> DataFrame:
    from lodestrata.llm.spans import shared_share, shared_spans

    texts = _p1_texts(spark, d)
    return _p1_named(shared_share(texts.filter("rec IS NOT NULL"), shared_spans(texts)))


def p1_levels(spark: SparkSession, d: str) -> DataFrame:
    from lodestrata.llm.spans import levels

    return _p1_named(levels(_p1_texts(spark, d)))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    from lodestrata.llm.docpairs import found

    return found(_files(spark, d, "repo", "rel_path"))


def p2_pairs(spark: SparkSession, d: str) -> DataFrame:
    from lodestrata.llm.docpairs import pairs

    return pairs(_files(spark, d, "repo", "rel_path"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    from lodestrata.llm.secrets import found

    return found(spread(table(spark, d, "findings", "finding_id", "snippet")))


def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    from lodestrata.llm.secrets import scan

    return scan(spread(table(spark, d, "findings", "finding_id", "snippet")), "finding_id", "snippet").select("finding_id", F.col("masked").alias("snippet"))


def p3_files(spark: SparkSession, d: str) -> DataFrame:
    from lodestrata.llm.secrets import scan

    return scan(spread(table(spark, d, "source_files", "file_id", "content")), "file_id", "content").select("file_id", "n", F.col("masked").alias("content"))


def _files(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return spread(table(spark, d, "source_files", "file_id", "language_id", *more, "content"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    from lodestrata.llm.handwritten import found

    return found(_files(spark, d, "file_path")).select("file_id")


def p4_kinds(spark: SparkSession, d: str) -> DataFrame:
    from lodestrata.llm.handwritten import classified

    return classified(_files(spark, d, "file_path")).distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from lodestrata.llm.validity import parsed

    return parsed(_files(spark, d)).filter("NOT valid").select("file_id").distinct()


def p5_files(spark: SparkSession, d: str) -> DataFrame:
    from lodestrata.llm.validity import parsed

    return parsed(_files(spark, d)).distinct()


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    from lodestrata.llm.validity import rates

    return rates(_files(spark, d, "repo"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    from lodestrata.llm.tokenize import encode_corpus

    return encode_corpus(spread(table(spark, d, "documents", "doc_id", "text")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    from lodestrata.llm.leakage import leaked

    return leaked(spread(table(spark, d, "documents", "doc_id", "text")), table(spark, d, "benchmark", "item_id", "text"))


def _p8(spark: SparkSession, d: str) -> DataFrame:
    from lodestrata.llm.abuse import scored

    return scored(spread(table(spark, d, "documents", "doc_id", "text")), table(spark, d, "labels", "doc_id", "toxic"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    from lodestrata.llm.abuse import FOUND_FROM

    return _p8(spark, d).filter(F.col("score") >= FOUND_FROM).select("doc_id").distinct()


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    return _p8(spark, d)


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    from lodestrata.llm.abuse import rates

    return rates(table(spark, d, "documents", "doc_id", "source"), _p8(spark, d))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_shares": p1_shares, "p1_levels": p1_levels, "p2_found": p2_found, "p2_pairs": p2_pairs, "p3_found": p3_found, "p3_redacted": p3_redacted, "p3_files": p3_files, "p4_found": p4_found, "p4_kinds": p4_kinds, "p5_found": p5_found, "p5_files": p5_files, "p5_rates": p5_rates, "p6_ids": p6_ids, "p7_found": p7_found, "p8_found": p8_found, "p8_scores": p8_scores, "p8_rates": p8_rates}


def oracle_sql() -> dict[str, str]:
    return {}
