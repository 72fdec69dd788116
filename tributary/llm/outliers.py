"""Robust multivariate outliers among text statistics, by minimum-covariance-determinant estimates per group.

Everything is DataFrame functions: statistics are array expressions over one
row, the estimates are rounds of grouped sums over a narrow table.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import exp

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.llm.common import word_array
from tributary.session import durable

WINDOW = 3
#: The share of a group whose covariance is made smallest, and the steps towards it.
SUPPORT, STEPS = 0.5, 5
#: Rows are outliers above this chi-square quantile of the robust squared distance.
QUANTILE = 0.999999
#: Groups with fewer distinct texts than this are judged by the estimate of their language, then of all rows.
LEAST_ROWS = 200
#: Names of the transformed statistics, with the least standard deviation of each: where nearly all rows
#: are alike the smallest deviation must not make an outlier.
STATISTICS = {"length": 0.05, "symbols": 0.15, "lines": 0.15, "repeats": 0.15}
#: Histogram bins per unit of a transformed statistic, and per factor of two of a squared distance.
UNIT_BINS, OCTAVE_BINS = 256, 64


def with_statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of its texts, all long.

    ``n_repeat_words`` counts the words inside windows of three that occur twice
    or more in the text. Windows are compared by 64-bit hash: sorted with their
    places, equal ones are neighbours, so the work per text is n log n. Rows
    are not moved. A null text has none of anything.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    base = df.withColumn("__words", word_array(F.col(f"`{text_col}`"))).withColumn("__lines", F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    base = base.withColumn("n_words", F.size("__words").cast("long"))
    hashes = base.withColumn("__h", F.transform("__words", lambda w: F.xxhash64(w)))
    windows = F.transform(
        F.slice("__h", 1, F.greatest(F.size("__h") - (WINDOW - 1), F.lit(0))),
        lambda h, i: F.struct(F.xxhash64(h, *[F.get("__h", i + k) for k in range(1, WINDOW)]).alias("h"), i.alias("i")),
    )
    # Most texts repeat no window: those need no sort.
    hashed = hashes.withColumn("__w", windows)
    distinct = F.size(F.array_distinct(F.transform("__w", lambda w: w["h"])))
    sorted_w = hashed.withColumn("__s", F.when(distinct < F.size("__w"), F.sort_array("__w")))
    repeats = F.filter(
        "__s",
        lambda w, i: F.coalesce(F.get("__s", i - 1)["h"] == w["h"], F.lit(False)) | F.coalesce(F.get("__s", i + 1)["h"] == w["h"], F.lit(False)),
    )
    placed = sorted_w.withColumn("__p", F.sort_array(F.transform(repeats, lambda w: w["i"])))
    # Windows that overlap share words: each covers up to the next one's start.
    covered = F.aggregate(
        F.transform("__p", lambda p, i: F.least(F.coalesce(F.get("__p", i + 1) - p, F.lit(WINDOW)), F.lit(WINDOW))),
        F.lit(0).cast("long"), lambda s, x: s + x,
    )
    stripped = F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", ""))
    return placed.withColumns({
        "word_chars": stripped.cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
    }).drop("__words", "__lines", "__h", "__w", "__s", "__p")


def transformed() -> dict[str, Column]:
    """Mean word length, and shares of symbols, doubled lines and repeated words.

    Shares are smoothed and put on a logarithmic scale, so that they are near to
    symmetric and the chance of short texts does not decide.
    """
    n = F.col("n_words").cast("double")
    values = (
        F.log((F.col("word_chars") + 100) / (n + 20)),
        F.log1p(20 * F.col("n_symbols") / (n + 20)),
        F.log1p(20 * F.col("n_dup_lines") / (n + 20)),
        F.log1p(2 * F.col("n_repeat_words") / (n + 20)),
    )
    return dict(zip(STATISTICS, values, strict=True))


def _at_share(counts: DataFrame, keys: Sequence[str], share: float) -> DataFrame:
    """``keys, edge``: the bin in which the running count of ``counts(keys, bin, n)`` reaches the share."""
    running = Window.partitionBy(*keys).orderBy("bin")
    summed = counts.withColumn("__run", F.sum("n").over(running)).withColumn("__all", F.sum("n").over(Window.partitionBy(*keys)))
    return summed.where(F.col("__run") >= share * F.col("__all")).groupBy(*keys).agg(F.min("bin").alias("edge"))


def _medians(rows: DataFrame, values: dict[str, Column], name: str) -> DataFrame:
    """``e`` and one column ``name_statistic`` each: medians by histogram, as middles of bins."""
    cells = F.array(*[F.struct(F.lit(k).alias("k"), F.floor(v * UNIT_BINS).alias("bin")) for k, v in values.items()])
    counts = rows.select("e", F.explode(cells).alias("c")).groupBy("e", "c.k", "c.bin").agg(F.count(F.lit(1)).alias("n"))
    edges = _at_share(counts, ["e", "k"], 0.5)
    return edges.groupBy("e").agg(*[F.max(F.when(F.col("k") == k, (F.col("edge") + 0.5) / UNIT_BINS)).alias(f"{name}_{k}") for k in values])


def _moments(rows: DataFrame) -> DataFrame:
    """Means and covariances of the statistics by ``e``."""
    names = list(STATISTICS)
    sums = [F.avg(x).alias(f"m_{x}") for x in names]
    sums += [F.covar_pop(a, b).alias(f"s_{a}_{b}") for i, a in enumerate(names) for b in names[: i + 1]]
    return rows.groupBy("e").agg(*sums)


def _factored(moments: DataFrame, scale: float) -> DataFrame:
    """``e``, means and the Cholesky factor of ``scale`` times the covariances, variances not below their floor."""
    names = list(STATISTICS)
    for i, a in enumerate(names):
        for j, b in enumerate(names[: i + 1]):
            rest = scale * F.col(f"s_{a}_{b}")
            for k in range(j):
                rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            value = F.sqrt(F.greatest(rest, F.lit(STATISTICS[a] ** 2))) if i == j else rest / F.col(f"l_{j}_{j}")
            moments = moments.withColumn(f"l_{i}_{j}", value)
    return moments.select("e", *[f"m_{x}" for x in names], *[f"l_{i}_{j}" for i in range(len(names)) for j in range(i + 1)])


def _distances(rows: DataFrame, factors: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` with ``d2``, the squared Mahalanobis distance under the estimate of their ``e``."""
    names, own = list(STATISTICS), rows.columns
    joined = rows.join(factors, "e", how)
    for i, a in enumerate(names):
        rest = F.col(a) - F.col(f"m_{a}")
        for k in range(i):
            rest = rest - F.col(f"l_{i}_{k}") * F.col(f"y_{k}")
        joined = joined.withColumn(f"y_{i}", rest / F.col(f"l_{i}_{i}"))
    total = sum((F.col(f"y_{i}") * F.col(f"y_{i}") for i in range(len(names))), F.lit(0.0))
    return joined.select(*own, total.alias("d2"))


def chi_square_quantile(p: float, half: int) -> float:
    """Quantile of the chi-square distribution with ``2 * half`` degrees of freedom."""
    low, high = 0.0, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, half) < p else (low, mid)
    return high


def chi_square(x: float, half: int) -> float:
    """Its distribution function, a finite sum for an even number of degrees."""
    term, total = 1.0, 0.0
    for k in range(half):
        total += term
        term *= x / 2 / (k + 1)
    return 1 - exp(-x / 2) * total


def estimates(rows: DataFrame, *, support: float = SUPPORT, steps: int = STEPS) -> DataFrame:
    """``e``, mean and Cholesky factor of the minimum covariance determinant of ``rows(e, statistics)``.

    From medians and median deviations on, each step takes the ``support`` of
    the rows nearest to the last estimate (the border is a histogram bin) and
    estimates anew, which never enlarges the determinant. A last step takes all
    rows within the 97.5 % quantile. Every step is a grouped sum of a few
    numbers per group and task.
    """
    half = len(STATISTICS) // 2
    mid = durable(_medians(rows, {k: F.col(k) for k in STATISTICS}, "m"), "mcd-medians")
    away = rows.join(mid, "e")
    spread = _medians(away, {k: F.abs(F.col(k) - F.col(f"m_{k}")) for k in STATISTICS}, "d")
    names = list(STATISTICS)
    zero = {f"s_{a}_{b}": F.lit(0.0) for i, a in enumerate(names) for b in names[:i]}
    start = mid.join(spread, "e").withColumns(zero | {f"s_{a}_{a}": F.pow(1.4826 * F.col(f"d_{a}"), 2) for a in names})
    factors = durable(_factored(start, 1.0), "mcd-factors")
    inner = support / chi_square(chi_square_quantile(support, half), half + 1)
    for _ in range(steps):
        far = _distances(rows, factors).withColumn("bin", F.floor(F.log2(F.col("d2") + 1e-6) * OCTAVE_BINS))
        edges = _at_share(far.groupBy("e", "bin").agg(F.count(F.lit(1)).alias("n")), ["e"], support)
        factors = durable(_factored(_moments(far.join(edges, "e").where("bin <= edge")), inner), "mcd-factors")
    last = 0.975 / chi_square(chi_square_quantile(0.975, half), half + 1)
    near = _distances(rows, factors).where(F.col("d2") <= chi_square_quantile(0.975, half))
    # A group with no row that near keeps the estimate before.
    final = _factored(_moments(near), last)
    return durable(final.unionByName(factors.join(final, "e", "left_anti")), "mcd-final")


def classify(
    df: DataFrame,
    *,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    quantile: float = QUANTILE,
    least_rows: int = LEAST_ROWS,
    **options: float,
) -> DataFrame:
    """``df`` without its text, with base statistics, ``base_failed, distance, kept``.

    Rows that fail the base rules (under 50 words, or over half of the words in
    repeated windows) are not kept and estimate nothing. The others are grouped
    by language and source. Estimates take each text once, so that copies of one
    text, however many, cannot become the rule; all rows are judged. Groups with
    under ``least_rows`` distinct texts use their language's estimate, small
    languages that of all rows. A row is kept unless its squared distance is
    above the chi-square quantile. Null languages and sources are
    groups of their own; a null text has no words and fails. Texts are read
    once; only statistics are kept and joined, to a few numbers per group.
    """
    names = list(STATISTICS)
    counted = with_statistics(df, text_col).withColumn("__t", F.xxhash64(F.col(f"`{text_col}`"))).drop(text_col)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    group, lang = F.xxhash64(F.lit("g"), F.col(lang_col).isNull(), lang_col, F.col(source_col).isNull(), source_col), F.xxhash64(F.lit("l"), F.col(lang_col).isNull(), lang_col)
    counted = counted.withColumn("base_failed", failed).withColumns(transformed()).withColumns({"__g": group, "__l": lang})
    counted = durable(counted, "mcd-statistics")
    texts = durable(counted.where("not base_failed").select("__g", "__l", "__t", *names).distinct(), "mcd-texts")
    sizes = durable(texts.groupBy("__g", "__l").agg(F.count(F.lit(1)).alias("n")), "mcd-sizes")
    small = F.col("n") < least_rows
    of_lang = texts.select("__l", "__t").distinct().groupBy("__l").agg(F.count(F.lit(1)).alias("of_lang"))
    langs = sizes.groupBy("__l").agg(F.max(small.cast("int")).alias("some_small")).join(of_lang, "__l")
    level = F.when(~small, F.col("__g")).when(F.col("of_lang") >= least_rows, F.col("__l")).otherwise(F.lit(0).cast("long"))
    plan = durable(sizes.join(langs, "__l").select("__g", "__l", "some_small", level.alias("e"), (F.col("of_lang") < least_rows).alias("all")), "mcd-plan")
    # A language's estimate takes all its texts, not only those of its small groups.
    needed = plan.select("__g", F.array_distinct(F.array("e", F.when(F.col("some_small") == 1, F.col("__l")).otherwise(F.col("e")))).alias("es"))
    every = [F.lit(0).cast("long")] if not plan.where("all").isEmpty() else []
    es = F.array_distinct(F.concat("es", F.array(*every))) if every else F.col("es")
    # A text of several sources is one text of its language.
    rows = texts.select("__g", "__t", *names).join(needed, "__g").select(F.explode(es).alias("e"), "__t", *names).distinct()
    factors = estimates(durable(rows.drop("__t"), "mcd-rows"), **options)
    keyed = counted.join(plan.select("__g", "e"), "__g", "left").withColumn("e", F.coalesce("e", F.lit(0).cast("long")))
    limit = chi_square_quantile(quantile, len(names) // 2)
    judged = _distances(keyed, factors, "left")
    kept = ~F.col("base_failed") & F.coalesce(F.col("d2") <= limit, F.lit(True))
    return judged.withColumn("distance", F.sqrt("d2")).withColumn("kept", kept).drop("__g", "__l", "__t", "e", "d2", *names)
