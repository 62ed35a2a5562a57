"""Quality rules: robust multivariate outliers by minimum-covariance-determinant estimates for each language and source.

Counts of each text become a vector of transformed statistics. For each language and source, for each language and
for all rows, the estimate is the mean and covariance of the half of the rows whose covariance has the least
determinant. It is sought from three starts (medians with interquartile ranges; the scatter of hyperbolic tangents; that
of spatial signs) by concentration steps: a step measures all rows' distances, finds the quantile in a histogram, and sums the rows
inside it. After two steps the start of least determinant goes on until the determinant falls no more. All sums
are partial before the shuffle, so a hot source costs no single task.

The covariance is made consistent for the normal distribution and gets ``FLOOR`` on its diagonal, since most texts have
no symbols or repeats at all. A row is rejected if its squared Mahalanobis distance from its group is beyond the
chi-square quantile of 1 - ``rate``.

Rows that fail the base rules are rejected and take no part in the estimates. Groups of fewer than ``least`` rows
use their language's estimate, then that of all rows; without one either, only the base rules hold.

Defined results: a null or empty text has no words and fails; so does one of white space. Null languages and sources are
groups of their own. Repeated rows count each time. A very long text is counted whole, as one slice. An empty table
gives no rows. Columns that the table has besides doc_id, text, lang and source pass through whatever their names;
those named like a column that ``judge`` adds are replaced, ``keep`` adds none. Ties in distance are on the
same side of every quantile.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from .common import boxed, broadcast_few, cut, row_slices, small_batches, unboxed, words_of

SYMBOLS, SPACE = b"#*$%&|<>", b" \t\n\v\f\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
NAMES = ("word_length", "symbols", "dup_lines", "repeats")
P = len(NAMES)
MODEL = "struct<mean:array<double>,low:array<double>,diag:array<double>>"
FEW_TASKS = 16  #: that write a table of one row a group


def repeated_words(ids: np.ndarray) -> int:
    """Words in windows of three that occur twice or more."""
    if len(ids) < 4:
        return 0
    _, small = np.unique(ids, return_inverse=True)
    small = small.astype(np.int64)
    pair = np.unique(small[:-1] * (int(small.max()) + 1) + small[1:], return_inverse=True)[1].astype(np.int64)
    _, which, often = np.unique(pair[:-1] * (int(small.max()) + 1) + small[2:], return_inverse=True, return_counts=True)
    twice = often[which] > 1
    held = np.zeros(len(ids), bool)
    for j in range(3):
        held[j : j + len(twice)] |= twice
    return int(held.sum())


def duplicate_lines(text: str) -> int:
    lines = text.split("\n")
    if len(lines) < 2:
        return 0
    full = [x for x in lines if x and (not x.isspace() or x.encode().strip(SPACE))]
    return len(full) - len(set(full))


def counts(texts: pa.Array) -> list[np.ndarray]:
    """COUNTS of each text."""
    flat, n = words_of(texts, False)
    ids = flat.dictionary_encode().indices.to_numpy()
    ends = np.cumsum(n)
    out = [n.astype(np.int64), *(np.zeros(len(n), np.int64) for _ in COUNTS[1:])]
    for i, t in enumerate(texts):
        text = t.as_py()
        raw = text.encode()
        out[1][i] = len(text) - (len(raw) - len(raw.translate(None, SPACE)))
        out[2][i] = len(raw) - len(raw.translate(None, SYMBOLS))
        out[3][i] = duplicate_lines(text)
        out[4][i] = repeated_words(ids[ends[i] - n[i] : ends[i]])
    return out


def with_counts(docs: DataFrame) -> DataFrame:
    """row, a struct of each row of ``docs``, and __ and each of COUNTS."""
    own = boxed(docs)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in row_slices(batch, 4_000_000):
                yield pa.RecordBatch.from_arrays([rows, *map(pa.array, counts(texts))], ["row", *(f"__{c}" for c in COUNTS)])

    return small_batches(own).mapInArrow(task, StructType([own.schema["row"], *(StructField(f"__{c}", LongType()) for c in COUNTS)]))


def base_failed() -> Column:
    return (F.col("__n_words") < 50) | (100 * F.col("__n_repeat_words") > 50 * F.col("__n_words"))


def vector() -> list[Column]:
    """Rates as square roots, which evens out the variance of counts; a word's mean length as its logarithm."""
    n, chars = "cast(greatest(__n_words, 1) as double)", "cast(greatest(__word_chars, 1) as double)"
    return [F.expr(f"ln({chars} / {n})"), F.expr(f"sqrt(__n_symbols / {chars})"), F.expr("sqrt(__n_dup_lines / (__n_dup_lines + 10D))"), F.expr(f"sqrt(__n_repeat_words / {n})")]


def distance(model: str) -> Column:
    """Squared Mahalanobis distance of x0.. under ``model``: with covariance L D L', the squares of y = L^-1 (x - mean) by D.

    Long formulas here are SQL text: one call each, where Column operators take one for each sign.
    """
    y: list[str] = []
    for i in range(P):
        y.append(f"(x{i} - {model}.mean[{i}]" + "".join(f" - {model}.low[{i * P + k}] * {y[k]}" for k in range(i)) + ")")
    return F.expr(" + ".join(f"{v} * {v} / {model}.diag[{i}]" for i, v in enumerate(y)))


#: Least variance of each statistic: below it, differences are rounding, a lone symbol or a repeated line, not quality.
FLOOR = [0.05**2, 0.05**2, 0.12**2, 0.12**2]
BINS = 16  #: of the distance histogram, for each doubling
KEYS = ["level", "lang", "source"]
FALL = 0.01  #: least fall of the logarithm of a determinant that is worth another step


def above(x: float, degrees: int) -> float:
    """Probability that a chi-square variable of an even number of degrees of freedom is above x."""
    return math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(degrees // 2))


def quantile(rate: float, degrees: int) -> float:
    """Where ``above`` is ``rate``."""
    low, high = 0.0, 2000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if above(mid, degrees) > rate else (low, mid)
    return low


def consistency(part: float, degrees: int = P) -> float:
    """By what the covariance of the central ``part`` of normal rows must grow."""
    return part / (1 - above(quantile(1 - part, degrees), degrees + 2)) if part < 1 else 1.0


PAIRS = [(i, j) for i in range(P) for j in range(i, P)]


def sums() -> list[Column]:
    return [F.expr("cast(count(1) as double) as n"), *(F.expr(f"sum(x{i}) as s{i}") for i in range(P)), *(F.expr(f"sum(x{i} * x{j}) as p{i}_{j}") for i, j in PAIRS)]


def solved(some: DataFrame, factor: float = 1.0, keys: list[str] = KEYS) -> DataFrame:
    """(keys, m, det): mean and LDL' factors of ``factor`` times the covariance plus FLOOR, from n, sums and products, and the logarithm of its determinant."""
    some = some.selectExpr("*", *(f"s{i} / n as m{i}" for i in range(P)))
    for j in range(P):
        rest = [f"({factor} * (p{j}_{i} / n - m{i} * m{j}){f' + {FLOOR[i]}' if i == j else ''}" + "".join(f" - l{i}_{k} * l{j}_{k} * d{k}" for k in range(j)) + ")" for i in range(j, P)]
        some = some.selectExpr("*", f"greatest({rest[0]}, {FLOOR[j] / 2}) as d{j}").selectExpr("*", *(f"{r} / d{j} as l{i}_{j}" for i, r in enumerate(rest[1:], j + 1)))
    low = ", ".join(f"l{i}_{k}" if k < i else "0D" for i in range(P) for k in range(P))
    every = lambda c: ", ".join(f"{c}{i}" for i in range(P))
    return some.selectExpr(*keys, f"struct(array({every('m')}) as mean, array({low}) as low, array({every('d')}) as diag) as m", " + ".join(f"ln(d{i})" for i in range(P)) + " as det")


def starts(x: DataFrame, least: int) -> DataFrame:
    """(KEYS, start, m, det): three robust scatters around the medians of each group of at least ``least`` rows."""
    quartiles = [F.expr(f"percentile_approx(x{i}, array(0.25, 0.5, 0.75), 1000) as q{i}") for i in range(P)]
    first = x.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), *quartiles).filter(F.col("n") >= least)
    first = cut(first.selectExpr(*KEYS, *(f"q{i}[1] as q{i}" for i in range(P)), *(f"sqrt(pow((q{i}[2] - q{i}[0]) / 1.349, 2) + {FLOOR[i]}) as w{i}" for i in range(P))).coalesce(FEW_TASKS))
    near = x.join(broadcast_few(first), KEYS).selectExpr(*KEYS, *(f"(x{i} - q{i}) / w{i} as z{i}" for i in range(P)))
    near = near.selectExpr("*", f"greatest({' + '.join(f'z{i} * z{i}' for i in range(P))}, 1e-12) as length")
    tangents, signs = ([F.expr(f.format(i=i, j=j)) for i, j in PAIRS] for f in ("avg(tanh(z{i}) * tanh(z{j})) as t{i}_{j}", f"avg({P} * z{{i}} * z{{j}} / length) as u{{i}}_{{j}}"))
    both = first.join(broadcast_few(cut(near.groupBy(*KEYS).agg(*tangents, *signs).coalesce(FEW_TASKS))), KEYS)
    # as sums of one row, so that the covariance about the median comes out
    kinds = (lambda i, j: f"{int(i == j)}D", lambda i, j: f"t{i}_{j}", lambda i, j: f"u{i}_{j}")
    options = (f"struct({n} as start, " + ", ".join(f"{cov(i, j)} * w{i} * w{j} + q{i} * q{j} as p{i}_{j}" for i, j in PAIRS) + ")" for n, cov in enumerate(kinds))
    made = both.selectExpr(*KEYS, "1D as n", *(f"q{i} as s{i}" for i in range(P)), f"inline(array({', '.join(options)}))")
    return cut(solved(made, 1.0, [*KEYS, "start"]).coalesce(FEW_TASKS))


def concentrated(x: DataFrame, fits: DataFrame, part: float, keys: list[str]) -> DataFrame:
    """(keys, m, det) after one step: the estimate of the ``part`` of each group that is nearest under ``fits``."""
    by_bin, whole = Window.partitionBy(*keys).orderBy("bin"), Window.partitionBy(*keys)
    far = x.join(broadcast_few(fits.drop("det")), KEYS).withColumn("bin", F.floor(F.log2(F.greatest(distance("m"), F.lit(1e-9))) * BINS).cast("int"))
    bins = far.groupBy(*keys, "bin").agg(*sums())
    ranked = bins.withColumns({"upto": F.sum("n").over(by_bin), "every": F.sum("n").over(whole)})
    near = ranked.filter(F.col("upto") - F.col("n") < part * F.col("every"))  # up to the bin that holds the quantile
    total = near.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in bins.columns if c not in (*keys, "bin")))
    return cut(solved(total, consistency(part), keys).coalesce(FEW_TASKS))


def estimates(rows: DataFrame, part: float, steps: int, least: int) -> DataFrame:
    """(KEYS, model): robust estimates of each group of at least ``least`` rows.

    ``rows``: lang, source, x0... Level 2 is a language and source, 1 a language, 0 all rows; empty names stand for all.
    ``steps`` is a limit to the steps after the first two; usually two or three find no lesser determinant.
    """
    key = lambda n, a, b: F.struct(F.lit(n).alias("level"), a.alias("lang"), b.alias("source"))
    none = F.lit("")
    levels = F.array(key(2, F.col("lang"), F.col("source")), key(1, F.col("lang"), none), key(0, none, none))
    x = rows.select(F.explode(levels).alias("g"), *(f"x{i}" for i in range(P))).select("g.*", *(f"x{i}" for i in range(P)))
    fits = starts(x, least)
    for _ in range(2):
        fits = concentrated(x, fits, part, [*KEYS, "start"])
    fits = cut(fits.groupBy(*KEYS).agg(F.min_by(F.struct("m", "det"), F.struct("det", "start")).alias("b")).select(*KEYS, "b.m", "b.det").coalesce(FEW_TASKS))
    for _ in range(steps):
        fresh = concentrated(x, fits, part, KEYS)
        both = fresh.join(broadcast_few(fits.select(*KEYS, F.col("m").alias("old"), F.col("det").alias("before"))), KEYS)
        lower = F.col("det") < F.col("before")
        fits = cut(both.select(*KEYS, F.when(lower, F.col("m")).otherwise(F.col("old")).alias("m"), F.least("det", "before").alias("det"), (F.col("before") - F.col("det")).alias("fall")).coalesce(FEW_TASKS))
        if (fits.agg(F.max("fall")).first()[0] or 0.0) < FALL:
            break
    return fits.select(*KEYS, F.col("m").alias("model"))


def judged(docs: DataFrame, rate: float, part: float, steps: int, least: int) -> DataFrame:
    """row, a struct of each row of ``docs``; __ and each of COUNTS; __base_failed and __kept."""
    counted = with_counts(docs)
    key = lambda c: F.coalesce(F.col("row").getField(c).cast("string") if c in docs.columns else F.lit(None).cast("string"), F.lit("\0"))
    rows = cut(counted.select(key("lang").alias("lang"), key("source").alias("source"), base_failed().alias("failed"), *(v.alias(f"x{i}") for i, v in enumerate(vector()))))
    found = estimates(rows.filter("not failed"), part, steps, least)
    of = lambda n: found.filter(F.col("level") == n).select(F.col("lang").alias("l"), F.col("source").alias("s"), F.col("model").alias(f"m{n}"))
    whole = found.filter("level = 0").select("model").first()  # one model
    every = F.lit(None) if whole is None else F.struct(*(F.array(*map(F.lit, whole[0][c])).alias(c) for c in ("mean", "low", "diag")))
    pairs = rows.select("lang", "source").distinct()
    models = pairs.join(broadcast_few(of(2)), (F.col("lang") == F.col("l")) & (F.col("source") == F.col("s")), "left").drop("l", "s").join(broadcast_few(of(1)), F.col("lang") == F.col("l"), "left")
    models = cut(models.select(F.col("lang").alias("__l"), F.col("source").alias("__s"), F.coalesce("m2", "m1", every.cast(MODEL)).alias("__m")).coalesce(FEW_TASKS))
    out = counted.select("*", *(v.alias(f"x{i}") for i, v in enumerate(vector())))
    out = out.join(broadcast_few(models), (key("lang") == F.col("__l")) & (key("source") == F.col("__s")), "left")
    far = F.coalesce(distance("__m") > quantile(rate, P), F.lit(False))
    failed = base_failed()
    return out.select("row", *(f"__{c}" for c in COUNTS), failed.alias("__base_failed"), (~failed & ~far).alias("__kept"))


def judge(docs: DataFrame, rate: float = 1e-6, part: float = 0.5, steps: int = 4, least: int = 200) -> DataFrame:
    """``docs``, __ and each of COUNTS, __base_failed and __kept. ``rate`` is that of normal rows which are rejected."""
    return unboxed(judged(docs, rate, part, steps, least), **{f"__{c}": f"__{c}" for c in (*COUNTS, "base_failed", "kept")})


def keep(docs: DataFrame, rate: float = 1e-6, part: float = 0.5, steps: int = 4, least: int = 200) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with the columns of ``docs``."""
    return unboxed(judged(docs, rate, part, steps, least).filter("__kept"))
