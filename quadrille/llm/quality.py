"""Quality rules: base statistics of a text, then robust multivariate outliers.

For each language and source, a regularised minimum-covariance-determinant estimate of location and scatter is made of
six transformed statistics: it is that of the half of the rows whose scatter has the smallest determinant. From each of
STARTS starts (middle and quartiles of each statistic; two small samples drawn by hash) concentration steps lead to a
candidate: the half nearest to the present estimate makes the next one. Of the candidates the one of smallest determinant is
taken. A row whose squared Mahalanobis distance from its group's estimate exceeds CUTOFF is rejected, on whichever side it
lies. "Half" is taken in bins of distance: it holds half of the rows and besides only those that are at most 1.1 % farther
than the median distance (2 ** (1 / BIN_PARTS), on one plus the distance).

Every step is a pre-aggregated groupBy on language and source: no group meets in one task. Groups under MIN_GROUP rows
are estimated with the other small groups of their language, then with all small ones; where even that is under MIN_GROUP,
nothing is rejected. `estimate` tells which it was. A text's length takes no part: long texts are no outliers, and the base
rules take the short ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm.common import SPACE_CLASS, col, staged, table

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_GROUP = 200
STEPS = 4
STARTS = 3
#: Rows of a starting sample, about.
START_ROWS = 64
#: 99.99 % point of chi-square with 6 degrees of freedom.
CUTOFF = 27.856
#: Standard deviations that regularise: the diagonal of their squares is added to the scatter, as texts that are all alike in a statistic
#: (no symbols, no repetition, in the nearer half) would make it singular. In the order of STATISTICS.
FLOORS = (0.05, 0.02, 0.2, 0.2, 0.02, 0.02)
#: Variance of the nearer half of a normal sample in 6 dimensions, against the whole's.
HALF_FACTOR = 0.5604
#: A distance's bin is floor(BIN_PARTS * log2(1 + distance)).
BIN_PARTS = 64
DIMS = len(FLOORS)
#: A table of one small row a group and start is broadcast up to so many groups (about 60 MB); beyond it, rows meet their group by shuffle.
MOST_BROADCAST_GROUPS = 50_000
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_marks", "n_upper")
XS = [f"x{i}" for i in range(DIMS)]
PAIRS = [(i, j) for i in range(DIMS) for j in range(i + 1)]


def text_stats(text: Column) -> list[tuple[str, Column]]:
    """In the order in which they must be added, one projection each."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    words = F.filter(F.split(t, f"{SPACE_CLASS}+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    count = lambda pattern: F.regexp_count(t, F.lit(pattern)).cast("long")
    return [("words_", words), ("lines_", lines), ("n_symbols", count("[#*$%&|<>]")), ("n_marks", count("[.,;:!?]")), ("n_upper", count(r"\p{Lu}"))]


def with_stats(df: DataFrame, text_col: str, keep: list[Column]) -> DataFrame:
    """keep and STATISTICS; everything within a row, nothing exploded, texts of any length whole.

    Null and empty texts have no words and no lines. Columns of keep that are named like a statistic are replaced, other names
    never clash. Repeated rows are repeated; no rows in, none out.
    """
    names = df.select(*keep).columns
    mine = {n: f"keep{i}_" for i, n in enumerate(names) if n not in STATISTICS}
    first = df.select(*[c.alias(mine[n]) for n, c in zip(names, keep) if n in mine], F.inline(F.array(F.struct(*[c.alias(n) for n, c in text_stats(col(text_col))]))))
    out = _counted(first)
    return out.select(*[F.col(m).alias(n) for n, m in mine.items()], *STATISTICS)


def _counted(first: DataFrame) -> DataFrame:
    """words_ and lines_ to counts."""
    # inline() of one struct keeps the arrays materialised: each is computed once.
    n = F.size("words_")
    windows = F.zip_with(F.zip_with(F.slice("words_", 1, F.greatest(n - 2, F.lit(0))), F.slice("words_", 2, F.greatest(n - 2, F.lit(0))), lambda a, b: F.xxhash64(a, b)),
                         F.slice("words_", 3, F.greatest(n - 2, F.lit(0))), lambda h, c: F.xxhash64(h, c))
    windows = F.when(n >= 3, windows).otherwise(F.array().cast("array<long>"))
    kept = [F.col(c) for c in first.columns if c not in ("words_", "lines_")]
    second = first.select(*kept, n.cast("long").alias("n_words"), F.length(F.array_join("words_", "")).cast("long").alias("word_chars"),
                          F.size("lines_").cast("long").alias("n_lines"), (F.size("lines_") - F.size(F.array_distinct("lines_"))).cast("long").alias("n_dup_lines"),
                          F.inline(F.array(F.struct(windows.alias("windows_")))))
    # Positions of windows that occur again: sorted (hash, place) pairs whose neighbour has the same hash.
    has = F.size(F.array_distinct("windows_")) < F.size("windows_")
    pairs = F.when(has, F.array_sort(F.transform("windows_", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    kept = [F.col(c) for c in second.columns if c != "windows_"]
    third = second.select(*kept, F.inline(F.array(F.struct(pairs.alias("pairs_")))))
    m = F.size("pairs_")
    empty = F.array().cast("array<struct<h:bigint,i:int>>")
    before = F.when(m > 0, F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice("pairs_", 1, F.greatest(m - 1, F.lit(0))))).otherwise(empty)
    after = F.when(m > 0, F.concat(F.slice("pairs_", 2, m), F.array(F.lit(None).cast("struct<h:bigint,i:int>")))).otherwise(empty)
    again = F.filter(F.arrays_zip(F.col("pairs_").alias("p"), before.alias("b"), after.alias("a")), lambda z: F.coalesce((z["p"]["h"] == z["b"]["h"]), F.lit(False)) | F.coalesce((z["p"]["h"] == z["a"]["h"]), F.lit(False)))
    places = F.array_sort(F.transform(again, lambda z: z["p"]["i"]))
    kept = [F.col(c) for c in third.columns if c != "pairs_"]
    fourth = third.select(*kept, F.inline(F.array(F.struct(places.alias("places_")))))
    # Each window covers three words; from its predecessor it adds min(3, distance).
    k = F.size("places_")
    steps = F.zip_with(F.slice("places_", 2, F.greatest(k, F.lit(1))), F.slice("places_", 1, F.greatest(k - 1, F.lit(0))), lambda b, a: F.least(F.lit(3), b - a))
    covered = F.when(k > 0, F.lit(3) + F.aggregate(steps, F.lit(0), lambda s, x: s + x)).otherwise(F.lit(0))
    kept = [F.col(c) for c in fourth.columns if c != "places_"]
    return fourth.select(*kept, covered.cast("long").alias("n_repeat_words"))


def transformed() -> list[Column]:
    """Log of the mean word length; log of symbols a word; square roots of the shares of words in repeated windows, of repeated
    lines, of marks and of capitals (of the letters in words)."""
    n, letters = (F.greatest(F.col(c), F.lit(1)).cast("double") for c in ("n_words", "word_chars"))
    return [F.log(letters / n), F.log1p(F.col("n_symbols") / n), F.sqrt(F.col("n_repeat_words") / n), F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
            F.sqrt(F.col("n_marks") / letters), F.sqrt(F.col("n_upper") / letters)]


def _level(df: DataFrame, made: dict[str, Column]) -> DataFrame:
    """Adds columns that are computed once, so that those built on them do not repeat their work."""
    return df.select(*df.columns, F.inline(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))))


def whitened(model: DataFrame, *keys: str) -> DataFrame:
    """keys, m0.., w00.. and logdet of scatters c00..: w is the inverse of the lower Cholesky factor of c."""
    c = lambda n, i, j: F.col(f"{n}{i}{j}")
    total = lambda terms: sum(terms, F.lit(0.0))
    out = model
    for j in range(DIMS):
        out = _level(out, {f"l{j}{j}": F.sqrt(F.greatest(c("c", j, j) - total(c("l", j, k) * c("l", j, k) for k in range(j)), F.lit(1e-12)))})
        if j + 1 < DIMS:
            out = _level(out, {f"l{i}{j}": (c("c", i, j) - total(c("l", i, k) * c("l", j, k) for k in range(j))) / c("l", j, j) for i in range(j + 1, DIMS)})
    for i in range(DIMS):
        row = {f"w{i}{j}": -total(c("l", i, k) * c("w", k, j) for k in range(j, i)) / c("l", i, i) for j in range(i)}
        out = _level(out, row | {f"w{i}{i}": 1 / c("l", i, i)})
    return out.select(*keys, *[f"m{i}" for i in range(DIMS)], *[f"w{i}{j}" for i, j in PAIRS], (2 * total(F.log(c("l", i, i)) for i in range(DIMS))).alias("logdet"))


def distance() -> Column:
    """Squared Mahalanobis distance of a row that carries x0.., m0.. and w00...."""
    d = [F.col(f"x{i}") - F.col(f"m{i}") for i in range(DIMS)]
    parts = [sum((F.col(f"w{i}{j}") * d[j] for j in range(i + 1)), F.lit(0.0)) for i in range(DIMS)]
    return sum((y * y for y in parts), F.lit(0.0))


def _few(groups: DataFrame, n: int) -> DataFrame:
    """A table of n groups or fewer, to be joined with: broadcast where n is small, so that a large group is not sent to one task."""
    return F.broadcast(groups) if n <= MOST_BROADCAST_GROUPS else groups


def _regular(model: DataFrame, *keys: str) -> DataFrame:
    """Scatter of the whole from that of the half s00.., regularised, in the form that distance() takes."""
    c = [(F.col(f"s{i}{j}") / HALF_FACTOR + (FLOORS[i] ** 2 if i == j else 0.0)).alias(f"c{i}{j}") for i, j in PAIRS]
    return whitened(model.select(*keys, *[f"m{i}" for i in range(DIMS)], *c), *keys)


def _moments(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, means m0.. and scatter s00.. of the rows of each group."""
    m = [F.avg(x).alias(f"m{i}") for i, x in enumerate(XS)]
    s = [F.avg(F.col(XS[i]) * F.col(XS[j])).alias(f"s{i}{j}") for i, j in PAIRS]
    out = rows.groupBy(*keys).agg(*m, *s)
    s = {(i, j): F.col(f"s{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}") for i, j in PAIRS}
    return out.select(*keys, *[f"m{i}" for i in range(DIMS)], *[(F.greatest(v, F.lit(0.0)) if i == j else v).alias(f"s{i}{j}") for (i, j), v in s.items()])


def mcd_models(rows: DataFrame, n: int, steps: int = STEPS) -> DataFrame:
    """A row a group g_: location m0.., w00.. of the scatter and its logdet, of the best half.

    rows: g_, u_ (uniform in [0, 1)), gn_ (rows of the group), x0.., all non-null, of n groups at most.
    """
    mids = [F.percentile_approx(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 1000).alias(f"q{i}") for i, x in enumerate(XS)]
    middle = rows.groupBy("g_").agg(*mids)
    spread = lambda i: F.pow((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, 2) * HALF_FACTOR
    middle = middle.select("g_", F.lit(0).alias("start_"), *[F.col(f"q{i}")[1].alias(f"m{i}") for i in range(DIMS)], *[(spread(i) if i == j else F.lit(0.0)).alias(f"s{i}{j}") for i, j in PAIRS])
    # Samples: each takes another stretch of u_, about START_ROWS rows of a group; a group that gives it no row does without.
    place = F.floor(F.col("u_") * F.greatest(F.col("gn_") / F.lit(float(START_ROWS)), F.lit(float(STARTS - 1)))).cast("int")
    samples = _moments(rows.withColumn("start_", place + 1).where(F.col("start_") < STARTS), "g_", "start_")
    model = staged(_regular(middle.unionByName(samples), "g_", "start_"), "mcd-start")
    for k in range(steps):
        near = rows.join(_few(model, n), "g_").withColumn("bin_", F.floor(F.log2(1 + distance()) * BIN_PARTS).cast("int")).select("g_", "start_", "bin_", *XS)
        bins = near.groupBy("g_", "start_", "bin_").agg(F.count(F.lit(1)).alias("n_"))
        group = Window.partitionBy("g_", "start_")
        bins = bins.withColumn("upto_", F.sum("n_").over(group.orderBy("bin_").rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("all_", F.sum("n_").over(group))
        half = bins.where(2 * F.col("upto_") >= F.col("all_")).groupBy("g_", "start_").agg(F.min("bin_").alias("half_"))
        model = staged(_regular(_moments(near.join(_few(half, n), ["g_", "start_"]).where(F.col("bin_") <= F.col("half_")), "g_", "start_"), "g_", "start_"), f"mcd-{k}")
    best = Window.partitionBy("g_").orderBy("logdet", "start_")
    return staged(model.withColumn("nth_", F.row_number().over(best)).where("nth_ = 1").drop("nth_", "start_"), "mcd")


def quality_rules(stats: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", source_col: str = "source",
                  min_group: int = MIN_GROUP, cutoff: float = CUTOFF) -> DataFrame:
    """Adds base_failed, distance, estimate and kept to rows that carry STATISTICS (with_stats); other columns pass through.

    base_failed: fewer than 50 words, or over half of the words in repeated windows; such rows are not kept and take no
    part in estimates. Null languages and sources are groups of their own. estimate: source, language or all, for the rows that
    share the row's estimate; null, as distance is, where none was made (too few rows, or base_failed), and then the row is kept
    if the base rules are met. A row is rejected if it is beyond the cutoff on any side. Repeated rows count each.
    No rows in, none out. Columns named like the added ones are replaced; other names never clash.
    """
    made = ("base_failed", "distance", "estimate", "kept")
    names = [c for c in stats.columns if c not in made or c in (lang_col, source_col)]
    mine = [f"c{i}_" for i in range(len(names))]
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    key = lambda *parts: F.concat_ws("\x01", *[F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("-")) for p in parts])
    lang, source, x = col(lang_col), col(source_col), transformed()
    rows = stats.select(*[col(c).alias(m) for c, m in zip(names, mine)], key(lang, source).alias("k2_"), key(lang).alias("k1_"), failed.alias("failed_"),
                        (F.pmod(F.xxhash64(col(id_col), *STATISTICS, F.lit("start")), F.lit(1 << 30)) / float(1 << 30)).alias("u_"), *[c.alias(n) for n, c in zip(XS, x)])
    n2 = rows.where(~F.col("failed_")).groupBy("k2_", "k1_").agg(F.count(F.lit(1)).alias("n2_"))
    small = n2.where(F.col("n2_") < min_group)
    n1 = small.groupBy("k1_").agg(F.sum("n2_").alias("n1_"))
    rest = n1.where(F.col("n1_") < min_group).agg(F.coalesce(F.sum("n1_"), F.lit(0)).alias("n0_"))
    groups = n2.join(n1, "k1_", "left").crossJoin(F.broadcast(rest))  # rest is one row: a constant for the whole table
    level = lambda a, b, c: F.when(F.col("n2_") >= min_group, a).when(F.col("n1_") >= min_group, b).when(F.col("n0_") >= min_group, c)
    g = level(F.concat(F.lit("2"), F.col("k2_")), F.concat(F.lit("1"), F.col("k1_")), F.lit("0"))
    groups = staged(groups.select("k2_", g.alias("g_"), level("source", "language", "all").alias("estimate_"), level(F.col("n2_"), F.col("n1_"), F.col("n0_")).alias("gn_")), "groups")
    n = groups.count()
    grouped = rows.join(_few(groups, n), "k2_", "left")
    model = mcd_models(grouped.where(~F.col("failed_") & F.col("g_").isNotNull()).select("g_", "u_", "gn_", *XS), n)
    out = grouped.join(_few(model.withColumnRenamed("g_", "gm_"), n), F.col("g_") == F.col("gm_"), "left").withColumn("d2_", F.when(~F.col("failed_"), distance()))
    return out.select(*[F.col(m).alias(c) for c, m in zip(names, mine)], F.col("failed_").alias("base_failed"), F.col("d2_").alias("distance"),
                      F.when(F.col("d2_").isNotNull(), F.col("estimate_")).alias("estimate"), (~F.col("failed_") & F.coalesce(F.col("d2_") <= cutoff, F.lit(True))).alias("kept"))


def op9_quality(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    stats = staged(with_stats(docs, "text", [F.col("doc_id"), F.col("lang"), F.col("source")]), "stats")
    return quality_rules(stats).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "estimate")
