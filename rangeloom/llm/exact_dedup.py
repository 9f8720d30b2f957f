"""Exact deduplication by skew-safe combining.

Three stages, each of which groups by the whole normalised text beside its digest, so equal digests alone never merge
two texts:

1. local: Spark's partial aggregation leaves one row a text in every input task;
2. salted: those rows meet by (digest, salt), the salt being the input task's number modulo ``salts``, so a text with
   a third of all rows is spread over ``salts`` tasks;
3. global: at most ``salts`` winners a text meet by digest.

Members then learn their group by digest. Groups with at least one row in ``HOT_GROUPS`` of the table (so at most
``HOT_GROUPS`` groups), and ``HOT_ROWS`` rows, travel by broadcast, all others by a shuffle on the digest, where no key has more
rows than that.
Should two texts ever share a SHA-256, an extra branch joins that digest's members on the text itself.

Defined results: a null text counts as empty; empty texts are equal to each other; of equal texts the largest id stays,
and a null id is below all others (a group of null ids only keeps those rows); rows that repeat the winning id are all
flagged as kept; an empty table gives an empty result; other columns, of whatever names, pass through ``deduplicate`` unchanged
and are ignored by ``report``; a very long text is compared whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize

HOT_GROUPS, HOT_ROWS = 5000, 200


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row a distinct text that occurs more than once: digest, keep_id, group_size, clash text (null unless digests clash)."""
    rows = docs.select(
        F.col(id_col).alias("_id"),
        ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("_text"),
        F.pmod(F.spark_partition_id(), F.lit(salts)).alias("_salt"),
    ).withColumn("_digest", F.sha2(F.col("_text"), 256))
    salted = rows.groupBy("_digest", "_salt", "_text").agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
    merged = (
        salted.repartition("_digest")
        .groupBy("_digest", "_text")
        .agg(F.max("_keep").alias("keep_id"), F.sum("_n").alias("group_size"))
    )
    texts = F.count(F.lit(1)).over(_over("_digest"))
    return (
        merged.withColumn("_texts", texts)
        .where((F.col("group_size") > 1) | (F.col("_texts") > 1))
        .select("_digest", "keep_id", "group_size", F.when(F.col("_texts") > 1, F.col("_text")).alias("_clash"))
    )


def _over(*keys: str):
    from pyspark.sql import Window

    return Window.partitionBy(*keys)


def _members(docs: DataFrame, columns: list[str], id_col: str, text_col: str, salts: int) -> DataFrame:
    """_row (a struct of ``columns``), _keep, _size, _kept, _digest of each row; the caller's columns stay inside the struct."""
    found = materialize(groups(docs, id_col, text_col, salts), "exact-groups")
    total = docs.count()
    plain, clash = found.where("_clash IS NULL").drop("_clash"), found.where("_clash IS NOT NULL")
    is_hot = F.col("group_size") >= F.lit(max(-(-total // HOT_GROUPS), HOT_ROWS))
    hot = plain.where(is_hot).select("_digest", F.col("keep_id").alias("_hk"), F.col("group_size").alias("_hn"))
    cold = plain.where(~is_hot).select(F.col("_digest").alias("_key"), F.col("keep_id").alias("_ck"), F.col("group_size").alias("_cn"))
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    own = F.col(f"_row.`{id_col}`")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("_row"), F.sha2(text, 256).alias("_digest")).join(F.broadcast(hot), "_digest", "left")
    # rows of hot groups are done: a key of their own spreads them, and matches nothing
    key = F.when(F.col("_hn").isNull(), F.col("_digest")).otherwise(F.concat(F.lit("-"), F.xxhash64(own).cast("string")))
    rows = rows.withColumn("_key", key).join(cold, "_key", "left")
    keep, size = F.coalesce("_hk", "_ck"), F.coalesce("_hn", "_cn")
    if clash.limit(1).count():
        by_text = clash.select(F.col("_digest").alias("_xd"), F.col("_clash").alias("_xt"), F.col("keep_id").alias("_xk"), F.col("group_size").alias("_xn"))
        mine = ascii_lower(F.coalesce(F.col(f"_row.`{text_col}`"), F.lit("")))
        rows = rows.join(by_text, (F.col("_digest") == F.col("_xd")) & (mine == F.col("_xt")), "left")
        keep, size = F.coalesce("_xk", keep), F.coalesce("_xn", size)
    single = size.isNull()
    return rows.select(
        "_row",
        F.when(single, own).otherwise(keep).alias("_keep"),
        F.coalesce(size, F.lit(1).cast("long")).alias("_size"),
        (single | own.eqNullSafe(keep)).alias("_kept"),
        "_digest",
    )


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """The input rows with keep_id, group_size, kept and text_sha256 added (columns of those names are replaced)."""
    own = [c for c in docs.columns if c.lower() not in ("keep_id", "group_size", "kept", "text_sha256")]
    rows = _members(docs, list(dict.fromkeys([*own, id_col, text_col])), id_col, text_col, salts)
    return rows.select(*(F.col(f"_row.`{c}`").alias(c) for c in own), F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"), F.col("_kept").alias("kept"), F.col("_digest").alias("text_sha256"))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its id, keep_id, group_size, kept, text_sha256."""
    return annotate(docs.select(id_col, text_col), id_col, text_col).drop(text_col)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """The documents that stay, with all their own columns as they were, whatever their names."""
    return _members(docs, docs.columns, id_col, text_col, salts).where("_kept").select("_row.*")
