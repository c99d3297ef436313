"""Documents to packed training sequences in five stages.

Quality rules, exact duplicates, near duplicates, mixing of sources, packing. Each stage gets what its predecessor kept,
written and read again, and all but the last return the columns of documents; further columns are dropped.

Decisions are made on narrow tables (ids, hashes, statistics); texts meet them once, by a broadcast where the counted number
of keys allows it and by a shuffle beyond. A row is known by its id and the hash of its other columns, so that rows that repeat
an id are decided each, and a missing id is an id like others unless a stage says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import checked, staged, table
from quadrille.llm.exact_dedup import exact_dedup, text_digest
from quadrille.llm.mixing import pareto_mix
from quadrille.llm.near_copies import near_copies
from quadrille.llm.packing import best_fit_pack
from quadrille.llm.quality import quality_rules, with_stats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _content() -> Column:
    return F.xxhash64(*[c for c in COLUMNS if c != "doc_id"])


def _of(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """The rows that are in a written table of (id_r, content_r), or that are not."""
    return docs.join(checked(keys), F.col("doc_id").eqNullSafe(F.col("id_r")) & (_content() == F.col("content_r")), how)


def quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality rules reject.

    Null and empty texts have no words and are rejected, as is any text under 50 words. Null languages and sources are groups of
    their own. Repeated rows are judged alike. No rows in, none out. Statistics are written beside the texts, which nothing shuffles.
    """
    docs = docs.select(*COLUMNS)
    stats = staged(with_stats(docs, "text", [F.col(c) for c in COLUMNS]), "stats")
    return quality_rules(stats).where("kept").select(*COLUMNS)


def exact(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts: the smallest id, and of rows that repeat it one.

    Null and empty texts are equal; missing ids come last. No rows in, none out.
    """
    docs = docs.select(*COLUMNS)
    keyed = staged(docs.select("doc_id", _content().alias("content"), text_digest("text").alias("digest")), "digests")
    judged = exact_dedup(keyed, "doc_id", "digest", digest_col="digest").where("group_size > 1")
    rows = judged.groupBy("doc_id", "content").agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("n")).where("not stays or n > 1")
    rows = staged(rows.select(F.col("doc_id").alias("id_r"), F.col("content").alias("content_r"), "stays"), "dropped")
    out, again = _of(docs, rows.drop("stays"), "left_anti"), rows.where("stays").drop("stays")
    if again.isEmpty():
        return out
    return out.unionByName(_of(docs, again, "left_semi").dropDuplicates())  # rows that are repeated as a whole


def near(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the smallest id, of each component of texts whose sets of five-word shingles have similarity 0.8.

    Rows without an id stay, as do rows that repeat a row that stays. Null and empty texts are alike. No rows in, none out.
    """
    docs = docs.select(*COLUMNS)
    dropped = near_copies(docs, "doc_id", _content()).select(F.col("id").alias("id_r"), F.col("content").alias("content_r"))
    return _of(docs, staged(dropped, "dropped"), "left_anti")


def mixed(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it, none to three times.

    Null texts have no words; a null source is one of its own; rows that repeat an id share a draw. No rows in, none out.
    """
    drawn = pareto_mix(docs.select(*COLUMNS)).where("copies > 0")
    return drawn.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def packed(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences; null and empty texts are an end id. No rows in, none out."""
    return best_fit_pack(docs)


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near dedup", near), ("mixing", mixed), ("packing", packed)]

#: Tokenisation, fingerprints and packing are beyond SQL.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
