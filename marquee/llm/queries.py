"""Queries of the llm problems, p1 and p4 to p10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm import canonical, components, lookalikes, matching, packing, sentences, survivors, tokens
from marquee.session import spread, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """showtime_id, field, ref_id of every value that is not a canonical of its field byte for byte."""
    out = canonical.canonicalise(table(spark, sf_dir, "showtime"), "showtime_id", table(spark, sf_dir, "tag_reference"))
    return out.select(F.col("showtime_id").cast("bigint").alias("showtime_id"), "field", F.col("ref_id").cast("int").alias("ref_id"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, row_id, field, pos of every title or genre with invisible characters or characters in place of others."""
    values = lookalikes.values_of(table(spark, sf_dir, "listing"), table(spark, sf_dir, "title_dim"))
    return lookalikes.disguised(values).select("src", "row_id", "field", F.col("pos").cast("int").alias("pos"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """distributor_code, field, listing_id of the surviving values."""
    return survivors.representatives(table(spark, sf_dir, "listing"), table(spark, sf_dir, "dim_venue")).select("distributor_code", "field", "listing_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """group_no, root_no of every title_group row in a linked set of two rows or more."""
    return components.group_rows(table(spark, sf_dir, "title_group"), table(spark, sf_dir, "key_match")).where("several").select("group_no", "root_no")


def _p7(spark: SparkSession, sf_dir: str, confident: bool) -> DataFrame:
    listing, films = table(spark, sf_dir, "listing"), table(spark, sf_dir, "title_dim")
    model = lookalikes.train(lookalikes.values_of(listing, films))
    return matching.match(spread(listing), spread(films), model, confident=confident)


def p7_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """listing_id, title_id, confidence of every listing that is the same film as a row of title_dim."""
    return _p7(spark, sf_dir, True).select("listing_id", "title_id", "confidence")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """listing_id, title_id of every listing that is the same film as a row of title_dim."""
    return _p7(spark, sf_dir, False).select("listing_id", "title_id")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ids of every document by byte_bpe_50k; no ids where the text is null or empty."""
    return tokens.encode_documents(documents(spark, sf_dir))


def p9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """budget_id, pack_group, container, doc_id, piece, tok_start, tok_end of every text's pieces for every budget."""
    return packing.pack(tokens.token_counts(documents(spark, sf_dir)), table(spark, sf_dir, "token_budget"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, sent_start, sent_end of every sentence unit."""
    scan = sentences.scan_documents(documents(spark, sf_dir))
    return sentences.split_documents(scan, sentences.train(scan))


def queries() -> dict:
    return {"p1_found": p1_found, "p4_found": p4_found, "p5_found": p5_found, "p6_found": p6_found, "p7_found": p7_found, "p7_matches": p7_matches, "p8_ids": p8_ids, "p9_pack": p9_pack, "p10_found": p10_found}
