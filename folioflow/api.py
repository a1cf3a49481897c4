"""Named views for callers: what a publishing service would list, each a DataFrame. Public ones show published works only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import blocks, ledger, lexical, relations
from .session import table


def editions(spark: SparkSession, sf_dir: str, public: bool = False) -> DataFrame:
    """One row a document; public: those of quality 1 that nothing speaks against."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    if not public:
        return d
    shown = table(spark, sf_dir, "labels").filter("quality = 1 and toxic = 0").select("doc_id").distinct()
    return d.join(shown, "doc_id", "left_semi")


def edition_blocks(spark: SparkSession, sf_dir: str, doc_id: int, chapter: int | None = None) -> DataFrame:
    b = blocks.blocks_view(spark, sf_dir).filter(F.col("doc_id") == doc_id)
    return b if chapter is None else b.filter(F.col("chapter") == chapter)


def chapters(spark: SparkSession, sf_dir: str, doc_id: int) -> DataFrame:
    return blocks.chapter_roles(spark, sf_dir).filter(F.col("doc_id") == doc_id)


def vocabulary(spark: SparkSession, sf_dir: str, doc_id: int) -> DataFrame:
    return lexical.useful_words(spark, sf_dir).filter(F.col("doc_id") == doc_id)


def spend(spark: SparkSession, sf_dir: str, since: str, until: str) -> DataFrame:
    calls = ledger.between(ledger.ledger(spark, sf_dir), since, until)
    return calls.groupBy("purpose", "model").agg(F.count(F.lit(1)).alias("calls"), ledger.usd(F.sum("cost")).alias("usd"))


VIEWS: dict[str, Callable[..., DataFrame]] = {
    "editions": editions, "blocks": edition_blocks, "chapters": chapters, "vocabulary": vocabulary, "spend": spend,
    "estimate": ledger.work_estimate, "promotions": relations.promotion_rollup, "imports": relations.upsert_merge, "runs": ledger.stage_progress,
}


def read_only(spark: SparkSession, sf_dir: str, prefix: str = "lexicon") -> list[str]:
    """A second catalogue to read from: temporary views, which nothing can be written to."""
    names = []
    for name in ("documents", "benchmark", "labels"):
        table(spark, sf_dir, name).createOrReplaceTempView(f"{prefix}_{name}")
        names.append(f"{prefix}_{name}")
    return names
