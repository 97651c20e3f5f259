"""Pairs of traces: cross-correlation, lead and lag, cross spectra and coherence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import finite


def unordered(pops: DataFrame, self_pairs: bool = True) -> DataFrame:
    """Pairs (pop_i, pop_j) of a small table with pop_ord, i before j, or equal."""
    a = pops.select(F.col("pop").alias("pop_i"), F.col("pop_ord").alias("_i"))
    b = pops.select(F.col("pop").alias("pop_j"), F.col("pop_ord").alias("_j"))
    return a.join(b, F.col("_i") <= F.col("_j") if self_pairs else F.col("_i") < F.col("_j")).select("pop_i", "pop_j")


def crosscorr(signal: DataFrame, pairs: DataFrame, lo: int, hi: int, demean: bool = False, normalise: bool = False, eps: float = 1e-12) -> DataFrame:
    """``pop_i, pop_j, lag, c`` with c = sum of x_i[t + lag] x_j[t]: an equi-join on the shifted index, no range join.

    signal: ``pop, i, v`` on one dense grid. Divided by the length, or by the root of the products of squares (NaN if that is 0).
    """
    by_pop = Window.partitionBy("pop")
    x = signal.withColumn("v", F.col("v") - F.avg("v").over(by_pop)) if demean else signal
    stats = x.groupBy("pop").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("v") * F.col("v")).alias("ss"))
    left = x.select(F.col("pop").alias("pop_i"), "i", F.col("v").alias("a"))
    right = x.select(F.col("pop").alias("pop_j"), F.explode(F.sequence(F.lit(lo).cast("long"), F.lit(hi).cast("long"))).alias("lag"), F.col("i").alias("_i"), F.col("v").alias("b"))
    right = right.join(pairs, "pop_j").select("pop_i", "pop_j", "lag", (F.col("_i") + F.col("lag")).alias("i"), "b")
    sums = right.join(left, ["pop_i", "i"]).groupBy("pop_i", "pop_j", "lag").agg(F.sum(F.col("a") * F.col("b")).alias("s"))
    d = sums.join(stats.select(F.col("pop").alias("pop_i"), "n", F.col("ss").alias("ss_i")), "pop_i").join(stats.select(F.col("pop").alias("pop_j"), F.col("ss").alias("ss_j")), "pop_j")
    scale = F.sqrt(F.col("ss_i") * F.col("ss_j")) if normalise else F.col("n").cast("double")
    return d.select("pop_i", "pop_j", "lag", F.when(scale > eps, F.try_divide(F.col("s"), scale)).otherwise(F.lit(float("nan"))).alias("c"))


def mirrored(df: DataFrame, negate: tuple[str, ...] = (), conjugate: bool = False) -> DataFrame:
    """Pairs and their mirror images; ``negate`` names antisymmetric columns."""
    other = df.where("pop_i <> pop_j").select(F.col("pop_j").alias("pop_i"), F.col("pop_i").alias("pop_j"), *[(-F.col(c)).alias(c) if c in negate else F.col(c) for c in df.columns if c not in ("pop_i", "pop_j")])
    return df.unionByName(other)


def peak(corr: DataFrame) -> DataFrame:
    """Value and lag of the largest |c| of each pair, the first lag on ties; NaN is skipped."""
    best = F.max_by(F.struct("lag", "c"), F.struct(F.abs("c"), -F.col("lag")))
    return corr.where(~F.isnan("c")).groupBy("pop_i", "pop_j").agg(best.alias("b")).select("pop_i", "pop_j", F.col("b.c").alias("amp"), F.col("b.lag").alias("lag"))


def lead_lag(corr: DataFrame, dt: float, w0: int, w1: int, eps: float = 1e-12) -> DataFrame:
    """Trapezoid integrals of c over negative and positive lags of a window, their difference, and its bounded form; positive: i leads."""
    # One window and one aggregation: a step joins two neighbouring lags of one side, the lag 0 is in neither.
    side = F.signum(F.col("lag"))
    ahead = F.lead("c").over(Window.partitionBy("pop_i", "pop_j", side).orderBy("lag"))
    steps = corr.withColumn("_s", (F.col("c") + ahead) / 2 * dt)

    def area(rows: Column) -> Column:
        inside = F.when(rows, F.col("c"))
        return F.when(F.count(inside) == 1, F.max(inside) * dt).otherwise(F.sum(F.when(rows, F.col("_s"))))

    # A step that leaves the window is none: its right end must be inside as well.
    left, right = (F.col("lag") >= w0) & (F.col("lag") < 0), (F.col("lag") > 0) & (F.col("lag") <= w1)
    steps = steps.withColumn("_s", F.when((F.col("lag") < 0) | (F.col("lag") < w1), F.col("_s")))
    out = steps.groupBy("pop_i", "pop_j").agg(area(left).alias("lead"), area(right).alias("lag"))
    d = F.col("lead") - F.col("lag")
    nan = F.lit(float("nan"))
    return out.select("pop_i", "pop_j", F.coalesce("lead", nan).alias("lead"), F.coalesce("lag", nan).alias("lag"), F.coalesce(d, nan).alias("diff"), F.coalesce(d / (F.abs("lead") + F.abs("lag") + eps), nan).alias("bounded"))


def segment_dft(signal: DataFrame, size: int, step: int, n: int, k_lo: int, k_hi: int, fs: float) -> DataFrame:
    """``pop, seg, k, re, im``: scaled DFT of detrended Hann segments, one join from sample to segment by index arithmetic."""
    n_seg = (n - size) // step + 1
    first = F.greatest(F.ceil((F.col("i") - (size - 1)) / F.lit(step)), F.lit(0))
    last = F.least(F.floor(F.col("i") / F.lit(step)), F.lit(n_seg - 1))
    rows = signal.where(first <= last).select("pop", "i", "v", F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("seg"))
    rows = rows.withColumn("j", F.col("i") - F.col("seg") * step).withColumn("d", F.col("v") - F.avg("v").over(Window.partitionBy("pop", "seg")))
    w = 0.5 - 0.5 * F.cos(F.lit(6.283185307179586) * F.col("j") / size)
    scale = (fs * 0.375 * size) ** 0.5  # the sum of squares of a periodic Hann window is 3/8 of its length
    rows = rows.select("pop", "seg", "j", (F.col("d") * w / scale).alias("x"), F.explode(F.sequence(F.lit(k_lo).cast("long"), F.lit(k_hi).cast("long"))).alias("k"))
    angle = F.lit(-6.283185307179586) * ((F.col("j") * F.col("k")) % size) / size
    return rows.groupBy("pop", "seg", "k").agg(F.sum(F.col("x") * F.cos(angle)).alias("re"), F.sum(F.col("x") * F.sin(angle)).alias("im"))


def one_sided(k: Column, size: int) -> Column:
    return F.when((k == 0) | (2 * k == size), 1.0).otherwise(2.0)


def welch(dft: DataFrame, size: int, fs: float, average: str = "mean") -> DataFrame:
    """``pop, freq, psd`` from segment spectra; mean, or median over its bias."""
    power = F.col("re") * F.col("re") + F.col("im") * F.col("im")
    rows = dft.withColumn("p", power * one_sided(F.col("k"), size))
    if average == "median":
        n = F.count(F.lit(1))
        bias = F.aggregate(F.sequence(F.lit(1), F.greatest(F.floor((n - 1) / F.lit(2)).cast("int"), F.lit(1))), F.lit(1.0), lambda a, i: a + F.when(n >= 3, 1 / (2 * i + 1) - 1 / (2 * i)).otherwise(0.0))
        psd = F.median("p") / bias
    else:
        psd = F.avg("p")
    return rows.groupBy("pop", "k").agg(psd.alias("psd")).select("pop", (F.col("k") * fs / size).alias("freq"), "psd")


def cross_spectrum(dft: DataFrame, pairs: DataFrame, size: int, fs: float) -> DataFrame:
    """``pop_i, pop_j, freq, re, im`` of conj(X_i) X_j, from the segments' spectra: no transform per pair."""
    a = dft.select(F.col("pop").alias("pop_i"), "seg", "k", F.col("re").alias("ar"), F.col("im").alias("ai"))
    b = dft.select(F.col("pop").alias("pop_j"), "seg", "k", F.col("re").alias("br"), F.col("im").alias("bi"))
    both = a.join(pairs, "pop_i").join(b, ["pop_j", "seg", "k"])
    s = one_sided(F.col("k"), size)
    out = both.groupBy("pop_i", "pop_j", "k").agg((F.avg(F.col("ar") * F.col("br") + F.col("ai") * F.col("bi"))).alias("re"), (F.avg(F.col("ar") * F.col("bi") - F.col("ai") * F.col("br"))).alias("im"))
    return out.select("pop_i", "pop_j", (F.col("k") * fs / size).alias("freq"), (F.col("re") * s).alias("re"), (F.col("im") * s).alias("im"))


def coherence(cross: DataFrame, eps: float = 1e-12) -> DataFrame:
    """Complex coherence: cross spectrum over the root of the product of auto spectra; NaN where that is too small."""
    auto = cross.where("pop_i = pop_j").select(F.col("pop_i").alias("pop"), "freq", F.hypot("re", "im").alias("p"))
    both = cross.join(auto.select(F.col("pop").alias("pop_i"), "freq", F.col("p").alias("p_i")), ["pop_i", "freq"]).join(auto.select(F.col("pop").alias("pop_j"), "freq", F.col("p").alias("p_j")), ["pop_j", "freq"])
    d = F.sqrt(F.col("p_i") * F.col("p_j"))
    nan = F.lit(float("nan"))
    return both.select("pop_i", "pop_j", "freq", F.when(d > eps, F.col("re") / d).otherwise(nan).alias("re"), F.when(d > eps, F.col("im") / d).otherwise(nan).alias("im"))


def band_mean(spectrum: DataFrame, lo: float, hi: float) -> DataFrame:
    """Complex mean over a closed band first, modulus and angle after."""
    m = spectrum.where(F.col("freq").between(lo, hi)).groupBy("pop_i", "pop_j").agg(F.avg(finite("re")).alias("re"), F.avg(finite("im")).alias("im"))
    return m.select("pop_i", "pop_j", F.hypot("re", "im").alias("coh"), F.when(F.col("pop_i") == F.col("pop_j"), 0.0).otherwise(F.atan2("im", "re")).alias("phase"))


def summarise_cpsd(spectrum: DataFrame, lo: float, hi: float, mult: float = 1.0) -> DataFrame:
    """Modulus first, mean after; the angle is that of the mean."""
    return spectrum.where(F.col("freq").between(lo, hi)).groupBy("pop_i", "pop_j").agg((F.avg(F.hypot("re", "im")) * mult).alias("amp"), F.atan2(F.avg("im"), F.avg("re")).alias("phase"))


def basis_vectors(matrix: DataFrame, basis: str, threshold: float | None = None) -> DataFrame:
    """Vectors coh e^(i phase) of each population from a basis population, which is (1, 0); those below the threshold go."""
    rows = matrix.where(F.col("pop_i") == basis)
    keep = ~F.isnan("coh") & (F.lit(True) if threshold is None else F.col("coh") >= threshold)
    rows = rows.where(keep | (F.col("pop_j") == basis))
    own = F.col("pop_j") == basis
    return rows.select(F.col("pop_j").alias("pop"), F.when(own, 1.0).otherwise(F.col("coh") * F.cos("phase")).alias("x"), F.when(own, 0.0).otherwise(F.col("coh") * F.sin("phase")).alias("y"))
