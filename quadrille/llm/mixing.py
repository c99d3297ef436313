"""Mixing sources to target weights by Pareto order sampling.

1. Targets. Each source gets a share of all words by its weight, at most MAX_COPIES times its own size; what is over is
   shared again by weight among the others (the level at which this ends is found in one pass over sources in order of
   cap / weight).
2. Whole copies. A source whose target is r times its size takes every document floor(r) times for certain.
3. The rest of the target is drawn without replacement. Inclusion probabilities are min(1, c * w) for a document's
   weight w (equal where none is given), in 64ths, with c set so that the expected words are the rest. Documents are ranked
   by odds(u) / odds(probability), u a fixed hash of the id (Pareto order sampling), and taken in this order until the rest
   is filled. The draw is of fixed size in words: it stops before the document that would exceed the rest.
4. What is then missing, under one document, is closed by documents not drawn: the largest that fits, again and again, at most
   CLOSING of them, and at the end one more that exceeds the rest if that is nearer. Candidates are the first few by rank of
   each size (of each sixteenth of an octave for large ones), so that they are bounded whatever the input.

No source is ever sorted as a whole: ranks are counted in RANK_BINS bins, and only the bin in which a source's draw ends
is put in order. The decisions are two thresholds for each source, so that documents are never shuffled for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm.common import WORD_CLASS, col, fresh, staged, table

SOURCE_WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
RANK_BINS = 4096
WEIGHT_PARTS = 64
CLOSING = 64
#: Sizes that are classes of their own among candidates for closing, classes an octave above, and candidates a class.
EXACT_SIZES, PARTS_AN_OCTAVE, A_CLASS = 256, 16, 32


def n_words(text: Column) -> Column:
    """Words in a text; null has none."""
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD_CLASS)).cast("long")


def draw(key: Column) -> Column:
    """A number in (0, 1), fixed for an id; a null id has one as well."""
    digest = F.md5(F.encode(F.coalesce(key.cast("string"), F.lit("")), "UTF-8"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(2**48))


def source_targets(sizes: DataFrame, max_copies: int = MAX_COPIES, weights=SOURCE_WEIGHTS) -> DataFrame:
    """source, source_size -> target added. A row a source; sources by code point with null last take the weights in turn."""
    everything = Window.partitionBy(F.lit(0))
    order = everything.orderBy(F.encode(F.col("source"), "UTF-8").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (place + 1).cast("int"))
    s = sizes.withColumn("w_", w).withColumn("cap_", F.lit(float(max_copies)) * F.col("source_size"))
    s = s.withColumn("total_", F.sum("source_size").over(everything).cast("double"))
    by_level = everything.orderBy((F.col("cap_") / F.col("w_")).asc(), F.encode(F.col("source"), "UTF-8").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("total_") - F.coalesce(F.sum("cap_").over(before), F.lit(0.0))) / F.sum("w_").over(after)
    s = s.withColumn("level_", level)
    # The first source, in this order, whose cap is not below the level ends the sharing.
    s = s.withColumn("final_", F.min(F.when(F.col("level_") * F.col("w_") <= F.col("cap_"), F.struct(F.col("cap_") / F.col("w_"), F.col("level_")))).over(everything)["level_"])
    target = F.when(F.col("final_").isNull(), F.col("cap_")).otherwise(F.least(F.col("cap_"), F.col("final_") * F.col("w_")))
    return s.select("source", "source_size", "n_docs", target.alias("target"))


def scores(rows: DataFrame) -> DataFrame:
    """Adds u-based rank_ (Pareto order) and its bin_ to rows that carry key_, parts_, c_."""
    p = F.least(F.lit(1.0), F.col("c_") * F.col("parts_"))
    u = draw(F.col("key_"))
    rank = F.when(p >= 1, F.lit(0.0)).when(p <= 0, F.lit(float("inf"))).otherwise(u / (1 - u) * (1 - p) / p)
    return rows.withColumn("rank_", rank).withColumn("bin_", F.when(F.col("rank_") == float("inf"), F.lit(RANK_BINS)).otherwise(F.floor(F.col("rank_") / (1 + F.col("rank_")) * RANK_BINS).cast("int")))


def _plan(narrow: DataFrame, max_copies: int, weights) -> DataFrame:
    """narrow (key_, source, size, parts_) -> a row a source with target, copies_ and thresholds."""
    by_source = narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    s = source_targets(by_source, max_copies, weights)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    s = s.withColumn("copies_", F.least(F.floor(ratio), F.lit(max_copies)).cast("long"))
    s = s.withColumn("rest_", F.col("target") - F.col("copies_") * F.col("source_size"))
    s = staged(s, "mix-sources")

    def tied(left: DataFrame, right: DataFrame) -> DataFrame:
        r = right.withColumnRenamed("source", "source_r")
        return left.join(r, F.col("source").eqNullSafe(F.col("source_r")), "left").drop("source_r")

    # c: the most heavily weighted classes have probability 1; the others share what is left in proportion to weight.
    classes = tied(narrow.groupBy("source", "parts_").agg(F.sum("size").alias("words_")), s.select("source", "rest_"))
    falling = Window.partitionBy("source").orderBy(F.col("parts_").desc())
    certain = F.coalesce(F.sum("words_").over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weighted = F.sum(F.col("words_") * F.col("parts_")).over(falling.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    c = F.when(weighted > 0, (F.col("rest_") - certain) / weighted).otherwise(F.lit(0.0))
    classes = classes.withColumn("c_", c).where(F.col("c_") * F.col("parts_") <= 1)
    chosen = classes.groupBy("source").agg(F.max_by("c_", "parts_").alias("c_"))
    s = staged(tied(s, chosen).withColumn("c_", F.greatest(F.coalesce(F.col("c_"), F.lit(1.0)), F.lit(0.0))), "mix-odds")

    ranked = scores(tied(narrow, s.select("source", "rest_", "c_")))
    bins = ranked.groupBy("source", "bin_").agg(F.sum("size").alias("words_"), F.first("rest_").alias("rest_"))
    upward = Window.partitionBy("source").orderBy("bin_").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins = bins.withColumn("upto_", F.sum("words_").over(upward)).where(F.col("upto_") > F.col("rest_"))
    last = staged(bins.groupBy("source").agg(F.min(F.struct("bin_", (F.col("upto_") - F.col("words_")).alias("before_"))).alias("m")).select("source", F.col("m.bin_").alias("end_bin_"), F.col("m.before_").alias("before_")), "mix-bins")
    # In the bin where the draw ends, documents are put in order; the draw ends before the first that does not fit.
    edge = tied(ranked, last).where(F.col("bin_") == F.col("end_bin_"))
    inside = Window.partitionBy("source").orderBy("rank_", "order_", _text(F.col("key_")))
    upto = F.col("before_") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    edge = edge.withColumn("order_", draw(F.col("key_"))).withColumn("upto_", upto).where(F.col("upto_") > F.col("rest_"))
    cut = edge.groupBy("source").agg(F.min(F.struct("rank_", "order_", _text(F.col("key_")).alias("tie_"), (F.col("upto_") - F.col("size")).alias("filled_"))).alias("cut_"))
    s = staged(tied(s, cut), "mix-cuts")
    # Candidates for closing: not drawn, and under twice what is missing, so that one may also exceed it and be nearer.
    missing = F.col("rest_") - F.col("cut_.filled_")
    open_ = scores(tied(narrow, s).where(F.col("cut_").isNotNull())).where(~_drawn() & (F.col("size") > 0) & (F.col("size") < 2 * missing))
    klass = F.when(F.col("size") <= EXACT_SIZES, F.col("size")).otherwise(F.floor(F.log2("size") * PARTS_AN_OCTAVE) + EXACT_SIZES)
    first = Window.partitionBy("source", "class_").orderBy(F.col("size").desc(), "rank_", "order_", "tie_")
    open_ = open_.withColumns({"class_": klass, "order_": draw(F.col("key_")), "tie_": _text(F.col("key_")), "missing_": missing})
    few = open_.withColumn("nth_", F.row_number().over(first)).where(F.col("nth_") <= A_CLASS)
    one = F.struct(F.col("size"), F.col("order_"), F.col("tie_"))
    lists = few.groupBy("source").agg(F.sort_array(F.collect_set(one), asc=False).alias("all_"), F.min("missing_").alias("missing_"))
    start = F.struct(F.col("missing_").alias("left"), F.slice("all_", 1, 0).alias("took"))
    fits = lambda st, x: (x["size"] <= st["left"]) & (F.size(st["took"]) < CLOSING)
    filled = lists.select("source", "all_", F.aggregate("all_", start, lambda st, x: F.when(fits(st, x), F.struct((st["left"] - x["size"]).alias("left"), F.concat(st["took"], F.array(x)).alias("took"))).otherwise(st)).alias("end_"))
    # The smallest that is left exceeds the rest; it comes in where that is nearer.
    filled = filled.withColumn("over_", F.try_element_at(F.sort_array(F.filter(F.array_except("all_", F.col("end_.took")), lambda x: (x["size"] > F.col("end_.left")) & (x["size"] - F.col("end_.left") < F.col("end_.left")))), F.lit(1)))
    close = filled.select("source", F.when(F.col("over_").isNull(), F.col("end_.took")).otherwise(F.concat(F.col("end_.took"), F.array("over_"))).alias("close_"))
    return staged(tied(s, close), "mix-plan")


def _text(key: Column) -> Column:
    return F.coalesce(key.cast("string"), F.lit(""))


def _drawn() -> Column:
    """Whether a scored row with its source's cut_ is in the draw."""
    at = F.struct(F.col("rank_"), draw(F.col("key_")).alias("order_"), _text(F.col("key_")).alias("tie_"))
    cut = F.struct(F.col("cut_.rank_"), F.col("cut_.order_"), F.col("cut_.tie_"))
    return F.coalesce(at < cut, F.col("rest_") > 0)


def pareto_mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", size_col: str | None = None,
               weight_col: str | None = None, weights=SOURCE_WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """Adds size, source_size, target, taken and copies to each row; rows not drawn have taken and copies 0.

    size_col: a column with the words of a row, else they are counted in text_col. weight_col: a weight in (0, 1], used in
    64ths; without it all documents of a source are drawn alike. Null sources are a source of their own, the last; null
    texts have no words; rows without words are never drawn by the closing step. Texts of any length are one document. Equal
    draws are put in order by id; rows that repeat an id share one draw, so that they are taken together, and those that repeat
    id and size close together. As copies are whole, a source's words miss the target by up to half of the smallest
    document that closing leaves (where no id is repeated, and CLOSING documents suffice). An empty table gives an empty result. Columns of df named like the added ones are
    replaced, other names never clash.
    """
    made = ["size", "source_size", "target", "taken", "copies"]
    base = df.drop(*[c for c in made if c not in (size_col, weight_col, source_col, id_col, text_col)])
    sz, = fresh(base, "sz_")
    size = col(size_col).cast("long") if size_col else n_words(col(text_col))
    parts = F.coalesce(F.greatest(F.lit(1), F.least(F.lit(WEIGHT_PARTS), F.ceil(col(weight_col) * WEIGHT_PARTS))).cast("int"), F.lit(WEIGHT_PARTS)) if weight_col else F.lit(WEIGHT_PARTS)
    narrow = staged(base.select(col(id_col).alias("key_"), col(source_col).alias("source"), F.coalesce(size, F.lit(0)).alias("size"), parts.alias("parts_")), "mix-sizes")
    plan = _plan(narrow, max_copies, weights).withColumnRenamed("source", "source_r").withColumnRenamed("source_size", "total_")
    names = fresh(base, *[f"m{i}_" for i in range(len(base.columns))])
    rows = base.select(*[col(c).alias(n) for c, n in zip(base.columns, names)], size.alias("size"), col(id_col).alias("key_"), col(source_col).alias("source_l"), parts.alias("parts_"))
    rows = rows.withColumn("size", F.coalesce("size", F.lit(0)))
    rows = rows.join(plan, F.col("source_l").eqNullSafe(F.col("source_r")), "left")
    rows = scores(rows)
    same = lambda x: (x["size"] == F.col("size")) & (x["order_"] == draw(F.col("key_"))) & (x["tie_"] == _text(F.col("key_")))
    closing = F.coalesce(~_drawn() & F.exists("close_", same), F.lit(False))
    copies = (F.col("copies_") + F.when(_drawn() | closing, 1).otherwise(0)).cast("long")
    copies = F.least(copies, F.lit(max_copies))
    plain = [c for c in base.columns if c not in made]
    return rows.select(*[col(n).alias(c) for c, n in zip(base.columns, names) if c in plain], F.col("size"), F.col("total_").alias("source_size"),
                       F.col("target"), (copies * F.col("size")).alias("taken"), copies.alias("copies"))


def op4_mix(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("words"))
    docs = staged(docs, "words")
    return pareto_mix(docs, size_col="words").select("doc_id", "size", "source_size", "target", "taken")
