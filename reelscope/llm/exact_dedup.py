"""Exact deduplication: 128-bit content hash, smallest id stays, bytes compared inside the hash groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelscope.llm.common import lookup, materialize, single_spaced, table


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashed: Callable[[Column], Column] = content_hash
) -> DataFrame:
    """One row per document: ``id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are identical with each run of white space as one space; a null text is empty,
    and empty texts are copies of each other.  The row with the smallest id stays; repeated rows with that id
    are copies too, and each of them says ``kept``.  Null ids sort last: a group of null ids only keeps null.  Other
    columns of ``docs`` are not looked at.  An empty table gives an empty result.

    Copies collapse before the shuffle (grouping by hash *and* bytes), so a group that holds a third of all
    rows sends one row per task.  Two texts with one hash are two groups; rows of such a hash are told apart
    by a second join on the bytes, which is built only if there is such a hash.
    """
    text = single_spaced(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("_text"))
    hashed_rows = rows.withColumn("_hash", hashed(F.col("_text")))
    classes = hashed_rows.groupBy("_hash", "_text").agg(
        F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    answers = materialize(
        classes.select("_hash", "keep_id", "group_size", F.sha2("_text", 256).alias("text_sha256")), "exact-groups"
    )
    keys = materialize(hashed_rows.select("doc_id", "_hash"), "exact-keys")
    clashes = answers.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_hash")
    if clashes.isEmpty():
        found = lookup(keys, answers, "_hash", "group_size")
    else:
        clashes = materialize(clashes, "exact-clashes")
        alone = lookup(
            keys.join(clashes, "_hash", "left_anti"), answers.join(clashes, "_hash", "left_anti"), "_hash", "group_size"
        )
        apart = (
            hashed_rows.join(clashes, "_hash", "left_semi")
            .withColumn("text_sha256", F.sha2("_text", 256))
            .join(
                classes.join(clashes, "_hash", "left_semi").select(
                    F.col("_hash").alias("_h"), F.col("_text").alias("_t"), "keep_id", "group_size"
                ),
                (F.col("_hash") == F.col("_h")) & (F.col("_text") == F.col("_t")),
            )
        )
        found = alone.unionByName(apart.select(*alone.columns))
    return found.select(
        F.col("doc_id").alias(id_col), "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256",
    )


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body
  FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY body)
"""
