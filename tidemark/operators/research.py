"""Regressions and calibration as grouped sums."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import series as ts
from tidemark.operators.selection import quantiles
from tidemark.operators.stores import written


def trend(df: DataFrame, by: str, order: str, y: str, lags: int) -> DataFrame:
    """(by, slope, intercept, r2, se): least squares on the row number, Newey-West error of the slope.

    The products of a row's score with its lags come from windows; all else are sums by series.
    """
    w = ts.w(by, order)
    x = df.select(by, order, F.col(y).alias("y"), F.row_number().over(w).cast("double").alias("i"))
    fit = x.groupBy(by).agg(F.regr_slope("y", "i").alias("slope"), F.regr_intercept("y", "i").alias("intercept"), F.regr_r2("y", "i").alias("r2"), F.avg("i").alias("mi"), F.regr_sxx("y", "i").alias("sxx"))
    scored = x.join(fit, by).withColumn("u", (F.col("y") - F.col("intercept") - F.col("slope") * F.col("i")) * (F.col("i") - F.col("mi")))
    near = F.lit(0.0)
    for k in range(1, lags + 1):
        near = near + 2 * (1 - k / (lags + 1)) * F.col("u") * F.coalesce(F.lag("u", k).over(w), F.lit(0.0))
    parts = scored.withColumn("_s", F.col("u") * F.col("u") + near)
    return parts.groupBy(by, "slope", "intercept", "r2", "sxx").agg(F.sum("_s").alias("_s")).select(by, "slope", "intercept", "r2", (F.sqrt(F.greatest(F.col("_s"), F.lit(0.0))) / F.col("sxx")).alias("se"))


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function, to about 15 places: a ratio of polynomials within 7 deviations, a continued fraction beyond."""
    # fixed values: published coefficients of the double-precision approximation
    above = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
    below = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
    size = F.least(F.abs(x), F.lit(38.0))
    horner = lambda c: reduce(lambda a, k: a * size + F.lit(k), c[1:], F.lit(c[0]))
    e = F.exp(-size * size / 2)
    far = reduce(lambda a, k: size + F.lit(float(k)) / a, (4, 3, 2, 1), size + 0.65)
    tail = F.when(size < 7.07106781186547, e * horner(above) / horner(below)).otherwise(e / far / 2.506628274631)
    return F.when(x > 0, 1 - tail).otherwise(tail)


def standardised(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns less their mean over their population deviation; a constant one becomes 0."""
    stats = df.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    zed = lambda c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") < 1e-12, 1.0).otherwise(F.col(f"_s_{c}"))
    return df.crossJoin(F.broadcast(stats)).select(*[c for c in df.columns if c not in columns], *[zed(c).alias(c) for c in columns])  # one row


#: Most rounds of a fit, and the change of a coefficient at which it ends.
ROUNDS, SETTLED = 100, 1e-8


def probit_fits(rows: DataFrame, by: str, label: str, features: Sequence[str], ridge: float = 0.0) -> DataFrame:
    """(by, b0, b1, ...): probit coefficients (constant first) of every group of ``rows``, all fitted at once.

    Iteratively reweighted least squares: a round is one grouped sum of X'WX and X'Wz over all groups, whose small
    systems are solved by elimination in columns. ``ridge`` is added to the diagonal, but for the constant, per row.
    Groups with one kind of label only are left out.
    """
    k = len(features) + 1
    x = [F.lit(1.0), *[F.col(c) for c in features]]
    both = rows.groupBy(by).agg(F.min(label).alias("lo"), F.max(label).alias("hi")).filter("lo <> hi")
    fits = written(both.select(by, *[F.lit(0.0).alias(f"b{i}") for i in range(k)]), "fit")
    rows = rows.select(by, label, *features)
    for _ in range(ROUNDS):
        eta = F.greatest(F.least(sum((x[i] * F.col(f"b{i}") for i in range(1, k)), F.col("b0")), F.lit(30.0)), F.lit(-30.0))
        scored = rows.join(fits, by).withColumn("_eta", eta)
        scored = scored.withColumn("_p", F.greatest(F.least(normal_cdf(F.col("_eta")), F.lit(1 - 1e-15)), F.lit(1e-300))).withColumn("_d", F.exp(-F.col("_eta") ** 2 / 2) / (2 * math.pi) ** 0.5)
        scored = scored.withColumn("_w", F.col("_d") ** 2 / (F.col("_p") * (1 - F.col("_p"))))
        pull = F.col("_w") * F.col("_eta") + F.col("_d") * (F.col(label) - F.col("_p")) / (F.col("_p") * (1 - F.col("_p")))
        sums = [F.sum(F.col("_w") * x[i] * x[j]).alias(f"a{i}{j}") for i in range(k) for j in range(i, k)] + [F.sum(pull * x[i]).alias(f"c{i}") for i in range(k)]
        solved = scored.groupBy(by, *[f"b{i}" for i in range(k)]).agg(F.count("*").alias("_n"), *sums)
        a = {(i, j): F.col(f"a{min(i, j)}{max(i, j)}") for i in range(k) for j in range(k)}
        for i in range(1, k):
            a[i, i] = a[i, i] + ridge * F.col("_n")
        solved = _solve(solved, a, [F.col(f"c{i}") for i in range(k)])
        moved = F.greatest(*[F.abs(F.col(f"_x{i}") - F.col(f"b{i}")) for i in range(k)]) if k > 1 else F.abs(F.col("_x0") - F.col("b0"))
        fits = written(solved.select(by, *[F.col(f"_x{i}").alias(f"b{i}") for i in range(k)], moved.alias("moved")), "fit")
        if fits.filter(F.col("moved") > SETTLED).isEmpty():
            break
        fits = fits.drop("moved")
    return fits.select(by, *[f"b{i}" for i in range(k)])


def _solve(df: DataFrame, a: dict[tuple[int, int], Column], c: list[Column]) -> DataFrame:
    """Adds _x0, _x1, ...: the solution of the symmetric positive system of each row, by elimination; a column a step."""
    k = len(c)
    df = df.select("*", *[a[i, j].alias(f"_e0_{i}{j}") for i in range(k) for j in range(k)], *[c[i].alias(f"_e0_{i}r") for i in range(k)])
    for p in range(k):
        here = lambda i, j, p=p: F.col(f"_e{p}_{i}{j}")
        share = lambda i, p=p: F.try_divide(here(i, p), here(p, p))  # noqa: B023, E731
        df = df.select("*", *[(here(i, j) - share(i) * here(p, j)).alias(f"_e{p + 1}_{i}{j}") for i in range(p + 1, k) for j in [*range(p + 1, k), "r"]])
    for i in reversed(range(k)):
        rest = F.col(f"_e{i}_{i}r")
        for j in range(i + 1, k):
            rest = rest - F.col(f"_e{i}_{i}{j}") * F.col(f"_x{j}")
        df = df.withColumn(f"_x{i}", F.coalesce(F.try_divide(rest, F.col(f"_e{i}_{i}{i}")), F.lit(0.0)))
    return df


def probit_walk_forward(df: DataFrame, order: str, features: Sequence[str], label: str, horizon: int, least: int = 80, step: int = 13, ridge: float = 1e-6) -> DataFrame:
    """(origin, p, label, brier): at every ``step``-th row from ``least`` on, a probit of ``label`` fitted to the rows before it predicts it.

    Features are standardised over all rows, and the last ``horizon`` rows are no origins. All origins are fitted at
    once; ``ridge`` only keeps the coefficients finite where the labels can be told apart without error.
    """
    w = Window.orderBy(order)  # one weekly series
    rows = standardised(df.select(order, label, *features).dropna(), features)
    rows = written(rows.select((F.row_number().over(w) - 1).alias("i"), F.col(label).cast("double").alias(label), *features), "probit")
    n = rows.agg(F.count("*").alias("n"))
    last = F.col("n") - horizon - 1
    origins = n.filter(last >= least).select(F.explode(F.sequence(F.lit(least).cast("long"), last, F.lit(step).cast("long"))).alias("origin"))  # a row a quarter
    train = rows.join(F.broadcast(origins), F.col("i") < F.col("origin"))
    fits = probit_fits(train, "origin", label, features, ridge)
    eta = sum((F.col(c) * F.col(f"b{i}") for i, c in enumerate(features, 1)), F.col("b0"))
    scored = rows.join(F.broadcast(fits), F.col("i") == F.col("origin")).select("origin", normal_cdf(eta).alias("p"), label)
    return scored.withColumn("brier", (F.col("p") - F.col(label)) ** 2)


def _uniform(*key) -> Column:
    """Between 0 and 1, from the hash of a key."""
    return (F.pmod(F.xxhash64(*key), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def normal_draw(*key) -> Column:
    """A standard normal value for every key, by the polar form of two hashed uniforms."""
    return F.sqrt(-2 * F.log(_uniform(*key, F.lit("radius")))) * F.cos(2 * math.pi * _uniform(*key, F.lit("angle")))


def prefix_fits(x: DataFrame, by: str) -> DataFrame:
    """(by, origin, slope, intercept, and the Cholesky factor l11, l21, l22 of their covariance): least squares on the
    first ``origin`` rows of (by, i, y), for every origin over 2, from running sums alone."""
    w = Window.partitionBy(by).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    first = F.first("y").over(w)  # values are taken from the first, so that sums stay small
    y = F.col("y") - first
    sums = {"n": F.count("y").over(w), "si": F.sum("i").over(w), "sy": F.sum("_y").over(w), "sii": F.sum(F.col("i") * F.col("i")).over(w), "siy": F.sum(F.col("i") * F.col("_y")).over(w), "syy": F.sum(F.col("_y") ** 2).over(w)}
    p = x.withColumn("_y", y).withColumn("_first", first).withColumns(sums).filter("n > 2")
    c = F.col
    sxx, sxy, syy = c("sii") - c("si") ** 2 / c("n"), c("siy") - c("si") * c("sy") / c("n"), c("syy") - c("sy") ** 2 / c("n")
    p = p.select(by, c("n").alias("origin"), (sxy / sxx).alias("slope"), (c("si") / c("n")).alias("mi"), sxx.alias("sxx"), F.greatest(syy - sxy**2 / sxx, F.lit(0.0)).alias("sse"), (c("_first") + c("sy") / c("n")).alias("my"))
    s2 = c("sse") / (c("origin") - 2)
    va, vb, cov = s2 * (1 / c("origin") + c("mi") ** 2 / c("sxx")), s2 / c("sxx"), -s2 * c("mi") / c("sxx")
    p = p.withColumn("intercept", c("my") - c("slope") * c("mi")).withColumns({"l11": F.sqrt(va), "l21": F.coalesce(F.try_divide(cov, F.sqrt(va)), F.lit(0.0))})
    return p.withColumn("l22", F.sqrt(F.greatest(vb - c("l21") ** 2, F.lit(0.0)))).select(by, "origin", "slope", "intercept", "l11", "l21", "l22")


def fan_paths(fits: DataFrame, rows: DataFrame, by: str, horizons: Sequence[int], draws: int) -> DataFrame:
    """(by, origin, horizon, draw, value): the trend of each fit so many rows on, with drawn coefficients and a drawn residual of its rows."""
    paths = fits.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    paths = paths.withColumns({"z1": normal_draw(by, "origin", "draw", F.lit(1)), "z2": normal_draw(by, "origin", "draw", F.lit(2))})
    paths = paths.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
    paths = paths.withColumn("pick", F.pmod(F.xxhash64(by, "origin", "draw", "horizon"), F.col("origin")) + 1)
    paths = paths.join(rows.select(by, F.col("i").cast("long").alias("pick"), F.col("y").alias("_y")), [by, "pick"])
    residual = F.col("_y") - F.col("intercept") - F.col("slope") * F.col("pick")
    a, b = F.col("intercept") + F.col("l11") * F.col("z1"), F.col("slope") + F.col("l21") * F.col("z1") + F.col("l22") * F.col("z2")
    value = F.least(F.greatest(a + b * (F.col("origin") + F.col("horizon")) + residual, F.lit(-25.0)), F.lit(30.0))  # fixed values: bounds of a log price
    return paths.select(by, "origin", "horizon", "draw", value.alias("value"))


def _numbered(df: DataFrame, by: str, order: str, y: str) -> DataFrame:
    return df.select(by, F.col(y).alias("y"), F.row_number().over(ts.w(by, order)).cast("double").alias("i"))


def bootstrap_fan(df: DataFrame, by: str, order: str, y: str, horizons: Sequence[int], draws: int, shares: Sequence[float] = (0.05, 0.5, 0.95)) -> DataFrame:
    """(by, horizon, p05, p50, ...) of the trend: each draw takes coefficients from their normal distribution (Cholesky
    factor of the least-squares covariance) and, for each horizon, a residual by hash. Draws repeat, as they hang on keys."""
    x = _numbered(df, by, order, y)
    fits = prefix_fits(x, by)
    last = fits.withColumn("_last", F.max("origin").over(Window.partitionBy(by))).filter("origin = _last").drop("_last")
    paths = fan_paths(last, x, by, horizons, draws)
    return paths.groupBy(by, "horizon").agg(*[F.percentile("value", p).alias(f"p{round(1000 * p):03d}" if 1000 * p % 10 else f"p{round(100 * p):02d}") for p in shares])  # ``draws`` values each


def calibrated_fan(df: DataFrame, by: str, order: str, y: str, horizons: Sequence[int], draws: int, step: int, least: int, back: int) -> DataFrame:
    """(by, horizon, origins, emp_50, emp_95, scale_50, scale_95, median, lo50, hi50, lo95, hi95): intervals of the last row's fan,
    rescaled in log space by what earlier origins' intervals lacked.

    Origins are every ``step`` rows from ``back`` rows before the end (``least`` at least) on, for each horizon as far as
    its outcome is known. A score is an outcome's distance from the median over the interval's half width; the scales
    are the 50th and 95th percentile of the scores, 1 where there is no origin.
    """
    x = written(_numbered(df, by, order, y), "numbered")
    fits = written(prefix_fits(x, by), "fits")
    last = fits.groupBy(by).agg(F.max("origin").alias("n"))
    spread = [F.percentile("value", p).alias(n) for n, p in (("med", 0.5), ("lo50", 0.25), ("hi50", 0.75), ("lo95", 0.025), ("hi95", 0.975))]
    widths = {f"half{k}": F.greatest((F.col(f"hi{k}") - F.col(f"lo{k}")) / 2, F.lit(1e-8)) for k in (50, 95)}
    start = F.greatest(F.col("n") - back, F.lit(0))
    origins = fits.join(last, by).filter((F.col("origin") >= least) & (F.col("origin") >= start) & (F.pmod(F.col("origin") - start, F.lit(step)) == 0) & (F.col("origin") + min(horizons) < F.col("n")))
    tried = fan_paths(origins.drop("n"), x, by, horizons, draws).groupBy(by, "origin", "horizon").agg(*spread).withColumns(widths)  # ``draws`` values each
    outcome = x.select(by, F.col("i").cast("long").alias("at"), F.col("y").alias("actual"))
    scored = tried.withColumn("at", F.col("origin") + F.col("horizon")).join(outcome, [by, "at"])
    gap = F.abs(F.col("actual") - F.col("med"))
    scored = written(scored.select(by, "horizon", *[(gap / F.col(f"half{k}")).alias(f"s{k}") for k in (50, 95)], *[F.col("actual").between(F.col(f"lo{k}"), F.col(f"hi{k}")).cast("double").alias(f"h{k}") for k in (50, 95)]), "scores")
    learned = scored.groupBy(by, "horizon").agg(F.count("*").alias("origins"), F.avg("h50").alias("emp_50"), F.avg("h95").alias("emp_95"))
    for k in (50, 95):
        learned = learned.join(quantiles(scored, [by, "horizon"], f"s{k}", [k / 100]).select(by, "horizon", F.col("q0").alias(f"scale_{k}")), [by, "horizon"])
    now = fits.join(last, by).filter("origin = n").drop("n")
    now = fan_paths(now, x, by, horizons, draws).groupBy(by, "horizon").agg(*spread).withColumns(widths)
    out = now.join(learned, [by, "horizon"], "left").fillna({"origins": 0, "emp_50": 0.0, "emp_95": 0.0, "scale_50": 1.0, "scale_95": 1.0})
    ends = [F.exp(F.col("med") + sign * F.col(f"half{k}") * F.col(f"scale_{k}")).alias(f"{n}{k}") for k in (50, 95) for n, sign in (("lo", -1), ("hi", 1))]
    return out.select(by, "horizon", "origins", "emp_50", "emp_95", "scale_50", "scale_95", F.exp("med").alias("median"), *ends)


def lagged_f_test(df: DataFrame, order: str, y: str, x: str, most: int) -> DataFrame:
    """(lag, f, n): whether x of ``lag`` rows ago adds to y's own lag, by the residual sums of the two regressions."""
    w = Window.orderBy(order)  # one daily series
    lagged = [F.struct(F.lit(k).alias("lag"), F.lag(y, k).over(w).alias("a"), F.lag(x, k).over(w).alias("b")) for k in range(1, most + 1)]
    rows = df.select(F.col(y).alias("y"), F.array(*lagged).alias("lags")).select("y", F.explode("lags").alias("s")).select("y", "s.*").dropna()
    m = rows.groupBy("lag").agg(F.count("*").alias("n"), *[F.covar_pop(p, q).alias(f"{p}{q}") for p, q in ("yy", "aa", "bb", "ya", "yb", "ab")])
    c = F.col
    restricted = c("yy") - c("ya") ** 2 / c("aa")
    det = c("aa") * c("bb") - c("ab") ** 2
    full = c("yy") - (c("ya") * (c("ya") * c("bb") - c("yb") * c("ab")) + c("yb") * (c("yb") * c("aa") - c("ya") * c("ab"))) / det
    return m.select("lag", ((restricted - full) / (full / (c("n") - 3))).alias("f"), "n")
