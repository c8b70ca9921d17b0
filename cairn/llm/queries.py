"""Queries of the text operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairn.llm import documented, handwritten, leaks, splitting, tokenizer, validity
from cairn.session import load


def p1_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return handwritten.not_handwritten(load(spark, sf_dir, "file_records"), load(spark, sf_dir, "documents"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_kinds(spark, sf_dir).select("path")


def p4_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documented.function_pairs(load(spark, sf_dir, "parsed_symbols"), load(spark, sf_dir, "documents"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_pairs(spark, sf_dir).select("path", "qualified_name", "start_line")


def p5_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validity.syntax_status(load(spark, sf_dir, "file_records"), load(spark, sf_dir, "documents"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_status(spark, sf_dir).where("not valid").select("path")


def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validity.fault_rates(p5_status(spark, sf_dir))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.encode_corpus(load(spark, sf_dir, "documents").select("doc_id", "text"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return leaks.find_leaks(docs, load(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = splitting.split_documents(load(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)
    return pieces.where("piece = 0").select("doc_id")


def p9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_documents(load(spark, sf_dir, "documents").select("doc_id", "text"))


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_kinds, p4_found, p4_pairs, p5_found, p5_rates, p5_status, p7_ids, p8_found, p9_found, p9_pieces)}


def oracle_sql() -> dict[str, str]:
    return {}
