"""Exact duplicates, with frequent texts split off before the shuffle.

A Misra-Gries summary (Spark's mergeable frequent-items aggregate) names digests that may be frequent. One filtered
aggregate over those few verifies them: exact count and smallest id. The verified winners, MAX_WINNERS rows at most
whatever the input, are broadcast, and their rows are decided where they are read. The other digests are shuffled
and numbered in a window; none of them holds more than a small share of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm.common import SPACE_CLASS, col, fresh, staged, table

MAX_WINNERS = 1024
TRACKED = 16384


def text_digest(text_col: str):
    """SHA-256 (hex) of the text with each run of white space made one space; null counts as empty."""
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    return F.sha2(F.encode(F.regexp_replace(text, f"{SPACE_CLASS}+", " "), "UTF-8"), 256)


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_col: str | None = None,
                max_winners: int = MAX_WINNERS, tracked: int = TRACKED) -> DataFrame:
    """Adds keep_id, group_size, kept and text_sha256 to each row of df; no row is lost.

    Null texts count as empty; texts of any length are read whole. Null ids sort last: keep_id is null only if the group has no other id. Of rows that
    repeat the smallest id of a group, one is kept. digest_col: a column that holds the digest already. Columns of df
    named like the added ones are replaced, other names never clash. An empty table gives an empty result.
    """
    out = ["keep_id", "group_size", "kept", "text_sha256"]
    base = df.drop(*[c for c in out if c != digest_col and c not in (id_col, text_col)])
    dg, keep, size, rank = fresh(base, "dg_", "keep_", "size_", "rank_")
    rows = base.withColumn(dg, col(digest_col) if digest_col else text_digest(text_col))

    top = rows.select(dg).agg(F.expr(f"approx_top_k({dg}, {max_winners}, {max(tracked, max_winners)})").alias("top"))
    frequent = top.select(F.explode("top.item").alias(dg))
    winners = (
        rows.select(dg, col(id_col).alias(keep)).join(F.broadcast(frequent), dg)
        .groupBy(dg).agg(F.min(keep).alias(keep), F.count(F.lit(1)).alias(size)).where(F.col(size) > 1)
    )
    winners = staged(winners, "winners")  # at most max_winners rows

    by_digest = Window.partitionBy(dg)
    order = by_digest.orderBy(col(id_col).asc_nulls_last())
    light = rows.join(F.broadcast(winners.select(dg)), dg, "left_anti").withColumns({
        keep: F.min(col(id_col)).over(by_digest), size: F.count(F.lit(1)).over(by_digest), rank: F.row_number().over(order)})
    heavy = rows.join(F.broadcast(winners), dg)
    first = heavy.where(col(id_col).eqNullSafe(F.col(keep)))
    rest = heavy.where(~col(id_col).eqNullSafe(F.col(keep))).withColumn(rank, F.lit(2))
    first = first.withColumn(rank, F.row_number().over(order))
    every = light.unionByName(first).unionByName(rest)
    plain = [c for c in base.columns if c != digest_col]
    return every.select(*[col(c) for c in plain], F.col(keep).alias("keep_id"), F.col(size).alias("group_size"),
                        (F.col(rank) == 1).alias("kept"), F.col(dg).alias("text_sha256"))


def op2_exact_dedup(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    keyed = staged(docs.select("doc_id", text_digest("text").alias("digest")), "digests")
    out = exact_dedup(keyed, "doc_id", "digest", digest_col="digest")
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept,
       text_sha256
FROM d
"""
