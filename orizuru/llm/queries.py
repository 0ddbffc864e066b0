"""Queries of the subpackage: name -> (spark, sf_dir) -> DataFrame, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orizuru.llm import encoding_repair, linking, lookalike, names, packing, pii, tokens, topn
from orizuru.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topn.board_leaders(table(spark, sf_dir, "leaderboards"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.changed_cells(spark, sf_dir).select("tab", "rec_id", "field").distinct()


def p2_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.changed_cells(spark, sf_dir)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.pairs(names.classes(names.strings(spark, sf_dir)))


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.counted(names.classes(names.strings(spark, sf_dir)))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.match(spark, sf_dir).select("page_id", "anilist_id")


def p4_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.match(spark, sf_dir)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_repair.garbled(encoding_repair.sources(spark, sf_dir)).select("tab", "rec_id").distinct()


def p6_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_repair.garbled(encoding_repair.sources(spark, sf_dir))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_column(table(spark, sf_dir, "documents"))


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(tokens.count_column(table(spark, sf_dir, "documents")))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents")).select("doc_id", "kind", "start_at").distinct()


def p9_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redact(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p2_found": p2_found, "p2_forms": p2_forms, "p3_found": p3_found, "p3_classes": p3_classes, "p4_found": p4_found, "p4_matches": p4_matches, "p6_found": p6_found, "p6_restored": p6_restored, "p7_ids": p7_ids, "p8_packed": p8_packed, "p9_found": p9_found, "p9_redacted": p9_redacted}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": """
            SELECT board, entry_id FROM (SELECT DISTINCT board, entry_id, r, rk, n FROM leaderboards WHERE r IS NOT NULL AND NOT isnan(r))
            QUALIFY row_number() OVER (PARTITION BY board ORDER BY r DESC, rk ASC NULLS LAST, n ASC NULLS LAST, entry_id) <= 5""",
    }
