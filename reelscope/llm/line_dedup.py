"""Line dedup by distinct-site spread: sketches per line hash, exact counts near the threshold, native throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelscope.llm.common import lookup, materialize, measured_joins, plain_text, table

#: A line is boilerplate from so many sites on, and in as many different texts.
SITES = 5
#: Shorter lines (code points, outer spaces off) are left alone: they repeat by chance.
MIN_CHARS = 20
#: Registers are 2 to this power; up to a few hundred distinct values the sketch is nearly exact, beyond its error is below 2 %.
SKETCH_BITS = 12
#: An estimate this much off the threshold, in parts of it, is counted exactly.
NEAR = 0.25


def spread_lines(docs: DataFrame, sites: int = SITES, min_chars: int = MIN_CHARS) -> DataFrame:
    """The places of boilerplate lines: ``doc_id, text_hash, line`` (numbers of lines from 0).

    Sites and texts of each line are counted by HyperLogLog sketches that merge map-side; lines whose estimate is near the
    threshold are counted again exactly.  The different texts must reach the threshold too, so copies of whole
    documents don't make their lines boilerplate.  The text with the smallest hash keeps the line.
    """
    text = plain_text()
    lines = materialize(
        docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("site"),
                    F.md5(text).alias("text_hash"), F.posexplode(F.split(text, "\n")).alias("line", "_raw"))
        .withColumn("_raw", F.trim("_raw")).where(F.char_length("_raw") >= min_chars)
        .select("doc_id", "site", "text_hash", "line", F.unhex(F.md5("_raw")).alias("hash")),
        "lines",
    )
    low, high = sites * (1 - NEAR) - 1, sites * (1 + NEAR) + 1
    sketched = lines.groupBy("hash").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(SKETCH_BITS))).alias("n_sites"),
        F.hll_sketch_estimate(F.hll_sketch_agg("text_hash", F.lit(SKETCH_BITS))).alias("n_texts"),
        F.min("text_hash").alias("first"), F.count(F.lit(1)).alias("n"),
    ).withColumn("least", F.least("n_sites", "n_texts")).where(F.col("least") >= low)
    suspects = materialize(sketched.select("hash", "first", "n", (F.col("least") <= high).alias("near")), "line-suspects")
    # few suspects are left after the sketches, but one of them may stand in a third of all texts
    places = materialize(lookup(lines, suspects, "hash", "n").where("first is not null"), "line-places")
    counted = (
        places.where("near").groupBy("hash").agg(
            F.count_distinct("site").alias("n_sites"), F.count_distinct("text_hash").alias("n_texts"),
            F.count(F.lit(1)).alias("n"),
        ).select("hash", "n", (F.least("n_sites", "n_texts") >= sites).alias("spread"))
    )
    judged = lookup(places.where("near").drop("n"), materialize(counted, "line-counts"), "hash", "n")
    found = places.where("not near").unionByName(judged.where("spread").select(places.columns))
    return found.where("text_hash != first").select("doc_id", "text_hash", "line")


def remove_spread_lines(
    docs: DataFrame, sites: int = SITES, min_chars: int = MIN_CHARS, counts: bool = True
) -> DataFrame:
    """``docs`` without its boilerplate lines, and (with ``counts``) with ``n_lines`` and ``n_removed``.

    Lines are split at line feeds; a null text stays null and has no line, an empty text has one.  A null ``source`` is
    a site of its own.  Repeated rows lose the same lines.  A text of boilerplate alone becomes empty; no document goes.
    All other columns are kept, except that ``counts`` replaces a column named ``n_lines`` or ``n_removed``.
    """
    with measured_joins(docs.sparkSession):
        found = spread_lines(docs, sites, min_chars)
    found = found.groupBy("doc_id", "text_hash").agg(F.collect_set("line").alias("gone")).hint("merge")
    own = [c for c in docs.columns if not counts or c not in ("n_lines", "n_removed")]
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.md5(plain_text()).alias("md5"))
    joined = whole.join(
        found, F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("md5") == F.col("text_hash")), "left"
    )
    text = F.col("row.text")
    # the lines that stay are picked by number, so a long text costs as much a line as a short one
    joined = joined.withColumn("lines", F.when(F.col("gone").isNotNull(), F.split(text, "\n")))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    left = F.transform(stay, lambda i: F.get("lines", i))
    cleaned = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(left, "\n"))
    columns = [cleaned.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in own]
    if not counts:
        return joined.select(*columns)
    return joined.select(
        *columns,
        F.when(text.isNull(), 0).otherwise(
            F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
        ).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
    )


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_spread_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS site, md5(coalesce(text, '')) AS h, text,
         string_split(text, chr(10)) AS parts
  FROM documents
), l AS (
  SELECT r, site, h, unnest(parts) AS raw, unnest(range(len(parts))) AS line FROM d
), k AS (
  SELECT r, site, h, line, trim(raw, ' ') AS body FROM l WHERE length(trim(raw, ' ')) >= {MIN_CHARS}
), s AS (
  SELECT body, min(h) AS first FROM k GROUP BY body
  HAVING count(DISTINCT site) >= {SITES} AND count(DISTINCT h) >= {SITES}
), g AS (
  SELECT r, list(line) AS gone FROM k JOIN s USING (body) WHERE h <> first GROUP BY r
)
SELECT doc_id, coalesce(len(parts), 0) AS n_lines, coalesce(len(gone), 0) AS n_removed,
       CASE WHEN gone IS NULL THEN text ELSE array_to_string(
         [parts[i + 1] FOR i IN range(len(parts)) IF NOT list_contains(gone, i)], chr(10)) END AS text
FROM d LEFT JOIN g USING (r)
"""
