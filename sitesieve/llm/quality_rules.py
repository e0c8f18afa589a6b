"""Quality rules: fixed limits, then robust multivariate outliers.

For each language and source the location and scatter of five transformed text
statistics are estimated by the minimum covariance determinant: from three
starts, concentration steps take the mean and covariance of the ``SHARE`` of rows with the
smallest Mahalanobis distance until the determinant stops falling, and the smallest
determinant wins.  A text further than ``CUTOFF`` (a squared
distance, scaled so that its median is at most that of a chi-squared variable) is
rejected: the quantile that such a variable exceeds with probability ``TAIL``.

Everything is DataFrame expressions: each step is an aggregation with map-side
combine over the narrow table of statistics, and the Cholesky factors are columns, so any
number of groups and a group of any size work alike.  A group's few parameters go to its rows, not its
rows to one task (``hot_keys.attach``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_key, saved
from .hot_keys import attach, hot_keys
from .text_stats import with_statistics

SHARE = 0.6  #: of a group's rows that a concentration step keeps
TRIAL_STEPS = 2  #: concentration steps from every start; the one of the smallest determinant goes on
MOST_STEPS = 6  #: concentration steps in all; they stop when no determinant falls
MIN_ROWS = 50  #: a smaller group is judged by the estimate of its language, then of all rows
FLOOR = 0.2  #: standard deviation that every statistic has at least
CHI2_MEDIAN = 4.351460191  #: of five degrees of freedom
D = 5
PAIRS = [(i, j) for i in range(D) for j in range(i + 1)]
#: Probability of a larger distance in a normal group.  Real groups have longer tails than normal ones; of 1e-3, 1e-4, ... this
#: is the largest that rejects at most one in 1000 good rows of check_s that are not held out.
TAIL = 1e-6


def chi2_cutoff(tail: float) -> float:
    """What a chi-squared variable of five degrees of freedom exceeds with probability ``tail``."""
    above = lambda x: math.erfc(math.sqrt(x / 2)) + math.sqrt(2 * x / math.pi) * math.exp(-x / 2) * (1 + x / 3)
    low, high = 0.0, 1500.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if above(middle) > tail else (low, middle)
    return high


CUTOFF = chi2_cutoff(TAIL)


def _transformed() -> list[Column]:
    s = {k: F.col(f"s.{k}").cast("double") for k in ("n_chars", "n_words", "word_chars", "n_symbols", "n_upper", "n_lines", "n_distinct")}
    return [
        F.ln((s["word_chars"] + 5) / (s["n_words"] + 1)),
        F.ln((s["n_symbols"] + 1) / (s["n_chars"] + 50)),
        F.ln((s["n_upper"] + 1) / (s["n_chars"] + 20)),
        F.ln((s["n_distinct"] + 1) / (s["n_words"] + 1)) / F.ln(s["n_words"] + 10),
        F.ln((s["n_words"] + 5) / (s["n_lines"] + 0.5)),
    ]


def _factors(params: DataFrame) -> DataFrame:
    """(g, start, m0.., c00, c10, ..) to (g, start, m0.., l00, l10, .., logdet): Cholesky factors of the covariances."""
    for i in range(D):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            # the floor keeps the covariance positive definite; rounding must not undo it
            params = params.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}{j}"))
    det = 2 * sum(F.ln(f"l{i}{i}") for i in range(D))
    return params.select("g", "start", *[f"m{i}" for i in range(D)], *[f"l{i}{j}" for i, j in PAIRS], det.alias("logdet"))


def _with_distance(rows: DataFrame, params: DataFrame, hot: DataFrame) -> DataFrame:
    """``rows`` with d2, their squared Mahalanobis distance by the parameters of their group, and params' other columns."""
    extra = [c for c in params.columns if c != "g" and c[0] not in "ml"]
    kept = rows.columns
    out = attach(rows, params, "g", hot)
    for i in range(D):
        z = F.col(f"x{i}") - F.col(f"m{i}")
        for j in range(i):
            z = z - F.col(f"l{i}{j}") * F.col(f"z{j}")
        out = out.withColumn(f"z{i}", z / F.col(f"l{i}{i}"))
    return out.select(*kept, *extra, sum(F.col(f"z{i}") * F.col(f"z{i}") for i in range(D)).alias("d2"))


def _half(c) -> Column:
    return F.percentile_approx(c, 0.5, 10_000)


def _moments(*by: str):
    """Aggregation of rows to the mean and covariance (with its floor) of each group."""
    cov = lambda i, j: F.coalesce(F.covar_samp(f"x{i}", f"x{j}"), F.lit(0.0)) + (FLOOR**2 if i == j else 0.0)
    return lambda rows: rows.groupBy(*by).agg(*[F.avg(f"x{i}").alias(f"m{i}") for i in range(D)], *[cov(i, j).alias(f"c{i}{j}") for i, j in PAIRS])


def _starts(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """Three starts of every group (g, start, m.., c..): medians with median absolute deviations, medians with the
    covariance of spatial signs, and the moments of the half of the rows that is closest to the medians."""
    middle = saved(rows.groupBy("g").agg(*[_half(f"x{i}").alias(f"m{i}") for i in range(D)]), "medians")
    near = attach(rows, middle, "g", hot)
    spread = near.groupBy("g").agg(*[_half(F.abs(F.col(f"x{i}") - F.col(f"m{i}"))).alias(f"s{i}") for i in range(D)])
    spread = saved(middle.join(spread.select("g", *[F.sqrt(F.pow(1.4826 * F.col(f"s{i}"), 2) + FLOOR**2).alias(f"s{i}") for i in range(D)]), "g"), "spreads")
    plain = spread.select("g", F.lit(0).alias("start"), *[f"m{i}" for i in range(D)], *[(F.pow(f"s{i}", 2) if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in PAIRS])
    z = [((F.col(f"x{i}") - F.col(f"m{i}")) / F.col(f"s{i}")).alias(f"z{i}") for i in range(D)]
    centred = attach(rows, spread, "g", hot).select("g", *[f"x{i}" for i in range(D)], *[f"s{i}" for i in range(D)], *z)
    norm = sum(F.pow(f"z{i}", 2) for i in range(D))
    centred = centred.withColumn("norm", norm)
    sign = lambda i, j: F.avg(F.col(f"z{i}") * F.col(f"z{j}") / F.greatest("norm", F.lit(1e-9))) * D * F.first(f"s{i}") * F.first(f"s{j}")
    signs = centred.groupBy("g").agg(_half("norm").alias("limit"), *[(sign(i, j) + (FLOOR**2 if i == j else 0.0)).alias(f"c{i}{j}") for i, j in PAIRS])
    signs = saved(signs, "signs")
    spatial = middle.join(signs.drop("limit"), "g").select("g", F.lit(1).alias("start"), *[f"m{i}" for i in range(D)], *[f"c{i}{j}" for i, j in PAIRS])
    within = saved(spread.join(signs.select("g", "limit"), "g"), "within")
    inner = attach(rows, within, "g", hot).where(sum(F.pow((F.col(f"x{i}") - F.col(f"m{i}")) / F.col(f"s{i}"), 2) for i in range(D)) <= F.col("limit"))
    inner = inner.select("g", *[f"x{i}" for i in range(D)])
    closest = _moments("g")(inner).select("g", F.lit(2).alias("start"), *[f"m{i}" for i in range(D)], *[f"c{i}{j}" for i, j in PAIRS])
    return plain.unionAll(spatial).unionAll(closest)


def _estimates(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """(g, m.., l.., scale): the minimum covariance determinant of every group of ``rows`` (g, x0..x4).

    After ``TRIAL_STEPS`` concentration steps from each start the smallest determinant of a group wins, and
    steps go on from there until no group's determinant falls any more.  An action a step reads whether one still does.
    """
    params = saved(_factors(_starts(rows, hot)), "mcd")
    for step in range(MOST_STEPS):
        if step == TRIAL_STEPS:
            params = saved(_best(params), "best")
        limit = _with_distance(rows, params, hot).groupBy("g", "start").agg(F.percentile_approx("d2", SHARE, 10_000).alias("cut"))
        core = _with_distance(rows, saved(params.join(limit, ["g", "start"]), "cut"), hot).where("d2 <= cut")
        after = saved(_factors(_moments("g", "start")(core)), "mcd")
        was = params.select("g", "start", F.col("logdet").alias("was"))
        falling = step < TRIAL_STEPS or after.join(was, ["g", "start"]).where("logdet < was - 0.001").limit(1).count()
        params = after
        if not falling:
            break
    best = params.drop("start", "logdet")
    scale = _with_distance(rows, best, hot).groupBy("g").agg((_half("d2") / CHI2_MEDIAN).alias("scale"))
    return saved(best.join(scale, "g"), "mcd")


def _best(params: DataFrame) -> DataFrame:
    """The start of the smallest determinant of each group."""
    rest = F.struct(*[c for c in params.columns if c != "g"])
    return params.groupBy("g").agg(F.min_by(rest, F.struct("logdet", "start")).alias("b")).select("g", "b.*")


def quality_verdicts(docs: DataFrame, min_rows: int = MIN_ROWS, cutoff: float = CUTOFF) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang, source): its statistics and verdicts.

    Columns: doc_id, key (names the row by its contents), n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, base_failed (fewer than 50 words, or
    more than half of them in repeated 3-word windows), distance (null if
    base_failed), kept.  Estimates are made from the rows that did not fail; a null
    lang or source is a value of its own.  A group of fewer than ``min_rows`` rows is judged by the estimate of
    all rows of its language, and if these are fewer by that of all rows.  A null text counts as
    empty and fails; very long texts are one row like any other.  Equal rows get equal verdicts; other columns are
    ignored; an empty table gives an empty result.
    """
    rows = with_statistics(docs.select("doc_id", "lang", "source", "text", row_key(docs).alias("key")))
    failed = (F.col("s.n_words") < 50) | (100 * F.col("s.n_repeat_words") > 50 * F.col("s.n_words"))
    rows = rows.select("doc_id", "key", "lang", "source", *[f"s.{k}" for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
                       failed.alias("base_failed"), *[x.alias(f"x{i}") for i, x in enumerate(_transformed())])
    # groups by level: language and source, language, all
    levels = [F.to_json(F.struct(F.lit(level).alias("level"), *c)) for level, c in enumerate((("lang", "source"), ("lang",), ()))]
    rows = saved(rows.withColumns({f"g{i}": g for i, g in enumerate(levels)}), "statistics")
    sound = rows.where("not base_failed")
    counts = saved(sound.groupBy("g0", "g1", "g2").agg(F.count("*").alias("n")), "counts")
    languages = counts.groupBy("g1").agg(F.sum("n").alias("n1"))
    groups = counts.join(languages, "g1").select("g0", F.when(F.col("n") >= min_rows, F.col("g0")).when(F.col("n1") >= min_rows, F.col("g1")).otherwise(F.col("g2")).alias("g"))
    groups = saved(groups, "groups")
    used = saved(groups.select("g").distinct(), "used")
    rows = attach(rows, groups, "g0")
    # a row takes part in the estimate of each of its levels that some group uses; estimates need the statistics only
    x = [f"x{i}" for i in range(D)]
    parts = sound.select(F.explode(F.array("g0", "g1", "g2")).alias("g"), *x)
    first = attach(parts, used.withColumn("used", F.lit(True)), "g").where("used").select("g", *x)
    parts = saved(first, "sound")
    hot = hot_keys(parts, "g")
    params = _estimates(parts, hot)
    rows = saved(rows.withColumn("g", F.when(~F.col("base_failed"), F.col("g"))).drop("g0", "g1", "g2"), "grouped")
    out = _with_distance(rows, params, hot_keys(rows, "g"))
    # the core underestimates the spread, so the factor is at least 1; where the floor decides it must not undo it
    distance = F.col("d2") / F.greatest(F.col("scale"), F.lit(1.0))
    out = out.withColumn("distance", distance)
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True))
    return out.select("doc_id", "key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", kept.alias("kept"))


def keep_rows(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose row_key is in ``keys`` (key, doc_id)."""
    k = keys.select(F.col("key").alias("__key"), F.col("doc_id").alias("__id"))
    return docs.withColumn("__row", row_key(docs)).join(k, (F.col("__row") == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi").drop("__row")
