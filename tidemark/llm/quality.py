"""Quality rules: counts per text, and outliers by minimum-covariance-determinant estimates per language and source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import counted_small, let, words_of
from tidemark.session import stage

WINDOW = 8
# Statistics are kept as whole multiples of 1 / SCALE, so that all sums are exact in any order.
SCALE = 256
STATS = ("word_length", "symbols", "marks", "capitals", "repeats", "lines")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_marks", "n_capitals", "base_failed", "distance", "outlier", "kept")
# Least standard deviation of each statistic in an estimate: below it a difference says nothing about quality.
LEAST_SPREAD = {"word_length": 0.35, "symbols": 0.12, "marks": 0.12, "capitals": 0.12, "repeats": 0.1, "lines": 0.1}
# Quantile 0.999 of chi-squared with six degrees of freedom.
CUTOFF = 22.458
# Median of chi-squared with six degrees of freedom.
CHI2_MEDIAN = 5.348


def repeated_words(words: Column) -> Column:
    """Words in windows of eight words that a text holds twice or more, the first included.

    Windows are compared by 64-bit hashes. Texts without a repeated window stop after one distinct count;
    in others, hashes are sorted with their places and the places of repeated ones measured.
    """
    n = F.size(words)

    def covered(places):  # ascending starts of repeated windows: each adds what the next one does not cover
        steps = F.zip_with(places, F.slice(places, 2, F.size(places)), lambda a, b: F.coalesce(F.least(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(steps, F.lit(0), lambda s, x: s + x)

    def repeated(hashes):
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(pairs, lambda s: F.transform(
            F.filter(s, lambda e, k: F.get(s, k - 1)["h"].eqNullSafe(e["h"]) | F.get(s, k + 1)["h"].eqNullSafe(e["h"])),
            lambda e: e["i"]))

    def counted(hashes):
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(F.array_sort(repeated(hashes)), covered))

    def doubled(width):  # hashes of runs of 2 * width words from those of width words
        return lambda h: F.zip_with(F.slice(h, 1, F.greatest(F.size(h) - width, F.lit(0))), F.slice(h, width + 1, F.size(h)), lambda a, b: F.xxhash64(a, b))

    windows = F.transform(words, lambda w: F.xxhash64(w))
    for width in (1, 2, 4):
        windows = let(windows, doubled(width))
    return F.when(n <= WINDOW, 0).otherwise(let(windows, counted)).cast("long")


def _length_of(text: Column, other_than: str) -> Column:
    return F.length(F.regexp_replace(text, other_than, ""))


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """The input's columns with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_marks, n_capitals, base_failed.

    NULL and empty texts have no words and fail the base rules. An input column with the name of a count is replaced by it.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    split = docs.withColumn("__words", words_of(F.col(text)))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = split.select(
        *[F.col(c) for c in docs.columns if c not in COUNTS],
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "__words")).cast("long").alias("word_chars"),
        _length_of(whole, r"[^#*$%&|<>]+").cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        let(lines, F.size).cast("long").alias("n_lines"),
        repeated_words(F.col("__words")).alias("n_repeat_words"),
        _length_of(whole, r"\P{Punct}+").cast("long").alias("n_marks"),
        _length_of(whole, r"\P{Lu}+").cast("long").alias("n_capitals"),
    )
    return out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def statistics() -> dict[str, Column]:
    """Statistics of a text that do not grow with its length; rates go through ln(1 + rate), so that a few marks say little."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "word_length": F.col("word_chars") / words,
        "symbols": F.log1p(F.col("n_symbols") / words),
        "marks": F.log1p(F.col("n_marks") / words),
        "capitals": F.log1p(F.col("n_capitals") / words),
        "repeats": F.col("n_repeat_words") / words,
        "lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
    }


P = len(STATS)
# Cells of distances for each factor e: quantiles are exact over cells, and their table is bounded.
CELLS = 256
# Transformed deviations are whole multiples of 1 / FINE, so that sums of their products are exact as well.
FINE = 1 << 12
# First estimates per group, and how many of them go on after the first two steps.
STARTS = 5 + 2 * P
GOING = 4
# A step counts as one down if the logarithm of the determinant falls by this much.
FALL = 1e-4
# Rows of estimates (group and start, some 400 bytes each) that are sent to all tasks.
SENT = 50_000
# Gauss-Jordan over the rows of (matrix | unit matrix): the right half becomes the inverse, pivots give the determinant.
INVERSE = f"""aggregate(sequence(0, {P - 1}),
  struct(transform(sequence(0, {P - 1}), i -> concat(slice(c, i * {P} + 1, {P}), transform(sequence(0, {P - 1}), j -> if(i = j, 1D, 0D)))) AS m, 0D AS det),
  (s, k) -> struct(transform(s.m, (r, i) -> if(i = k, transform(r, x -> x / s.m[k][k]), zip_with(r, s.m[k], (x, y) -> x - y * r[k] / s.m[k][k]))) AS m,
    s.det + ln(greatest(s.m[k][k], 1e-12D)) AS det))"""


def _solved(estimates: DataFrame, keys: list[str]) -> DataFrame:
    """Centre m, inverse and ln determinant of covariances c, a row of P * P numbers."""
    found = estimates.select(*keys, "m", F.expr(INVERSE).alias("__x"))
    return found.select(*keys, "m", F.expr(f"flatten(transform(__x.m, r -> slice(r, {P + 1}, {P})))").alias("inv"), F.col("__x.det").alias("det"))


def _distance() -> Column:
    """Squared Mahalanobis distance of a row of statistics from the centre and inverse covariance next to it."""
    d = [F.col(f"__{s}") / SCALE - F.col("m")[i] for i, s in enumerate(STATS)]
    total = F.lit(0.0)
    for i in range(P):
        across = sum((F.col("inv")[i * P + j] * d[j] for j in range(i)), F.lit(0.0))
        total = total + d[i] * (F.col("inv")[i * P + i] * d[i] + 2 * across)
    return F.greatest(total, F.lit(0.0))


def _cell(distance: Column) -> Column:
    return F.floor(F.log(distance + 1e-6) * CELLS).cast("int")


def _matrix(entry) -> Column:
    return F.array(*[entry(max(i, j), min(i, j)) for i in range(P) for j in range(P)])


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Centre and covariance (with a floor under each variance) of the statistics, from sums of whole numbers."""
    q = [F.col(f"__{s}") for s in STATS]
    sums = [F.sum(q[i]).alias(f"s_{i}") for i in range(P)]
    products = [F.sum(q[i] * q[j]).alias(f"p_{i}_{j}") for i in range(P) for j in range(i + 1)]
    mean = [F.col(f"s_{i}") / F.col("n") / SCALE for i in range(P)]
    entry = lambda i, j: F.col(f"p_{i}_{j}") / F.col("n") / SCALE**2 - mean[i] * mean[j] + (LEAST_SPREAD[STATS[i]] ** 2 if i == j else 0.0)
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sums, *products).select(*keys, F.array(*mean).alias("m"), _matrix(entry).alias("c"))


def _starts(ok: DataFrame, least: int) -> DataFrame:
    """STARTS first estimates per group.

    Four are medians with quartile spreads and correlations of nothing, of tanh, of spatial signs and of signs; the others are moments
    of all rows, and of the rows without the upper or the lower quarter of one statistic.
    """
    quarters = ok.groupBy("__group").agg(
        F.count(F.lit(1)).alias("n"), *[F.percentile(f"__{s}", [0.25, 0.5, 0.75]).alias(f"q_{i}") for i, s in enumerate(STATS)]).where(F.col("n") >= least)
    spread = [F.greatest((F.col(f"q_{i}")[2] - F.col(f"q_{i}")[0]) / SCALE / 1.349, F.lit(LEAST_SPREAD[s])) for i, s in enumerate(STATS)]
    low, middle, high = (F.array(*[F.col(f"q_{i}")[k] / SCALE for i in range(P)]) for k in range(3))
    base = counted_small(stage(quarters.select("__group", middle.alias("m"), F.array(*spread).alias("w"), low.alias("lo"), high.alias("hi")), "medians"))
    u = [(F.col(f"__{s}") / SCALE - F.col("m")[i]) / F.col("w")[i] for i, s in enumerate(STATS)]
    whole = lambda values: F.array(*[F.round(v * FINE).cast("long") for v in values])
    length = F.greatest(F.sqrt(sum((F.col("u")[i] * F.col("u")[i] for i in range(1, P)), F.col("u")[0] * F.col("u")[0])), F.lit(1e-9))
    ways = [[F.tanh(F.col("u")[i]) for i in range(P)], [F.col("u")[i] / length for i in range(P)], [F.signum(F.col("u")[i]) for i in range(P)]]
    turned = ok.join(base, "__group").select("__group", F.array(*u).alias("u")).select(
        "__group", F.posexplode(F.array(*[whole(w) for w in ways])).alias("__start", "t"))
    products = turned.groupBy("__group", "__start").agg(*[F.sum(F.col("t")[i] * F.col("t")[j]).alias(f"p_{i}_{j}") for i in range(P) for j in range(i + 1)])
    # shrunk a little towards no correlation, so that every start has an inverse
    related = lambda i, j: F.lit(1.0) if i == j else F.coalesce(
        0.95 * F.col(f"p_{i}_{j}") / F.sqrt(F.nullif(F.col(f"p_{i}_{i}").cast("double") * F.col(f"p_{j}_{j}"), F.lit(0.0))), F.lit(0.0))
    relations = products.select("__group", (F.col("__start") + 1).alias("__start"), _matrix(related).alias("r"))
    plain = base.select("__group", F.lit(0).alias("__start"), _matrix(lambda i, j: F.lit(1.0 if i == j else 0.0)).alias("r"))
    scaled = F.array(*[F.col("r")[i * P + j] * F.col("w")[i] * F.col("w")[j] for i in range(P) for j in range(P)])
    turned = relations.union(plain).join(base, "__group").select("__group", "__start", "m", scaled.alias("c"))
    x = [F.col(f"__{s}") / SCALE for s in STATS]
    inside = [F.when(x[i] <= F.col("hi")[i], 5 + 2 * i) for i in range(P)] + [F.when(x[i] >= F.col("lo")[i], 6 + 2 * i) for i in range(P)]
    parts = ok.join(base, "__group").select(*ok.columns, F.explode(F.array_compact(F.array(F.lit(4), *inside))).alias("__start"))
    return _solved(turned.union(_moments(parts, ["__group", "__start"])), ["__group", "__start"])


def _with_group_names(rows: DataFrame, group: tuple[str, ...]) -> DataFrame:
    # the length prefix keeps ("a", "b|c") apart from ("a|b", "c"), and NULL apart from any text
    part = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-"))
    return rows.withColumn("__fine", F.concat(F.lit("f"), *[part(c) for c in group])).withColumn("__coarse", F.concat(F.lit("c"), part(group[0])))


def _with_group(rows: DataFrame, large: DataFrame) -> DataFrame:
    rows = rows.join(large, "__fine", "left")
    return rows.withColumn("__group", F.when(F.col("__large"), F.col("__fine")).otherwise(F.col("__coarse"))).drop("__large", "__fine", "__coarse")


def _with_statistics(rows: DataFrame) -> DataFrame:
    return rows.select("*", *[F.round(c * SCALE).cast("long").alias(f"__{s}") for s, c in statistics().items()])


def estimates(
    counted: DataFrame, group: tuple[str, ...] = ("lang", "source"), least: int = 60, share: float = 0.75
) -> tuple[DataFrame, DataFrame]:
    """Minimum-covariance-determinant estimates from the result of `counts`: (groups that have their own, estimates by group).

    Rows that the base rules passed estimate centre and covariance of their group. From each of STARTS deterministic first estimates, concentration
    steps go on: the `share` of rows nearest to the last estimate gives the next one, until the determinant stops falling; after two steps
    only the GOING lowest of a group go on. The estimate with the least determinant of all that stopped is the group's. Variances have a floor (the determinant compared is that of the covariance with
    it), so a constant statistic rejects nobody over a trifle. Distances are put on scale by their
    median. Groups with fewer than `least` passing rows share one estimate per first group column, and NULL is a value like any other;
    where even that has fewer, there is no estimate. Groups are aggregated with partial sums of whole numbers, so a group with
    a third of all rows sends one partial row per task, and reruns agree to the last bit.
    """
    large, ok = _grouped(counted, group, least)
    best = concentrated(ok, least, share)
    middle = ok.join(best, "__group").groupBy("__group").agg(F.percentile(_cell(_distance()), 0.5).alias("__middle"))
    scale = F.greatest(F.exp((F.col("__middle") + 0.5) / CELLS) / CHI2_MEDIAN, F.lit(1.0))
    return large, counted_small(stage(best.join(middle.select("__group", scale.alias("__scale")), "__group"), "estimate"))


def _grouped(counted: DataFrame, group: tuple[str, ...], least: int) -> tuple[DataFrame, DataFrame]:
    """Groups that have their own estimate, and the passing rows' statistics by group."""
    named = _with_group_names(_with_statistics(counted.where("not base_failed")), group)
    rows = stage(named.select("__fine", "__coarse", *[f"__{s}" for s in STATS]), "statistics")
    large = rows.groupBy("__fine").agg((F.count(F.lit(1)) >= least).alias("__large")).where("__large")
    large = counted_small(stage(large, "groups"))
    return large, stage(_with_group(rows, large), "statistics")


def concentrated(ok: DataFrame, least: int, share: float) -> DataFrame:
    """(__group, m, inv, det): the least determinant that concentration steps from all starts reach."""
    keys = ["__group", "__start"]
    going = stage(_starts(ok, least).withColumn("det", F.lit(float("inf"))), "estimate")
    done, turn = going.limit(0), 0
    while (rows := going.count()) > 0:  # a row for each group and start
        sent = F.broadcast if rows <= SENT else lambda df: df
        turn += 1
        cells = ok.join(sent(going), "__group").groupBy(*keys, _cell(_distance()).alias("__cell")).agg(F.count(F.lit(1)).alias("__n"))
        bound = cells.groupBy(*keys).agg(F.percentile("__cell", share, F.col("__n")).alias("__bound"))
        aimed = stage(going.join(bound, keys).withColumnRenamed("det", "__before"), "bound")
        near = ok.join(sent(aimed), "__group").where(_cell(_distance()) <= F.col("__bound"))
        found = _solved(_moments(near, keys), keys).join(sent(aimed.select(*keys, "__before", F.col("m").alias("__m"), F.col("inv").alias("__inv"))), keys)
        found = stage(found, "estimate")
        fell = F.col("det") < F.col("__before") - FALL
        done = done.union(found.where(~fell).select(*keys, F.col("__m").alias("m"), F.col("__inv").alias("inv"), F.col("__before").alias("det")))
        going = found.where(fell).select(*keys, "m", "inv", "det")
        if turn == 2:
            lowest = Window.partitionBy("__group").orderBy("det", "__start")  # a row for each start
            going = stage(going.withColumn("__place", F.row_number().over(lowest)).where(F.col("__place") <= GOING).drop("__place"), "estimate")
    best = done.groupBy("__group").agg(F.min_by(F.struct("m", "inv", "det"), F.struct("det", "__start")).alias("b"))
    return counted_small(stage(best.select("__group", "b.*"), "best"))


def outliers(
    counted: DataFrame, fitted: tuple[DataFrame, DataFrame], group: tuple[str, ...] = ("lang", "source"), cutoff: float = CUTOFF
) -> DataFrame:
    """The rows of `counts` with (distance, outlier). Rows without an estimate have distance NULL and are no outliers."""
    large, estimate = fitted
    rows = _with_group(_with_group_names(_with_statistics(counted), group), large).join(estimate.drop("det"), "__group", "left")
    distance = _distance_or_null() / F.col("__scale")
    return rows.select(*counted.columns, distance.alias("distance")).withColumn("outlier", F.coalesce(F.col("distance") > cutoff, F.lit(False)))


def _distance_or_null() -> Column:
    return F.when(F.col("inv").isNotNull(), _distance())


def judge(docs: DataFrame, text: str = "text", group: tuple[str, ...] = ("lang", "source"), cutoff: float = CUTOFF, keep_text: bool = True) -> DataFrame:
    """The input's columns with all counts, distance, and kept: not failed by the base rules and no outlier.

    Texts stay where they are: estimates come from a written table of counts. With the text kept, counts are made again next
    to it, which costs less than moving it; without it they are read from that table.
    """
    counted = counts(docs, text)
    slim = stage(counted.drop(text), "counts")
    out = outliers(counted if keep_text else slim, estimates(slim, group), group, cutoff)
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("outlier"))
