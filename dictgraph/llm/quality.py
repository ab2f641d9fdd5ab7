"""Quality rules: word statistics and robust multivariate outliers."""

from __future__ import annotations

import math
from collections import Counter
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dictgraph.llm.common import cut, place_of, release, ship_package, texts_of

# Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOLS = bytes(set(range(256)) - set(SYMBOLS))
_CONTINUATION = bytes(range(0x80, 0xC0))
_SPACES = b" \t\n\x0b\x0c\r"
_LETTERS = bytes(set(range(256)) - set(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") - set(range(0xC0, 0x100)))

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
STATISTICS = [*BASE, "n_lines", "n_letter_bytes"]

# The transformed statistics: name, SQL, and the least standard deviation that
# counts (a group where nearly all texts agree has none of its own).
FEATURES = [
    ("word_length", "ln(word_chars / n_words)", 0.05),
    ("symbol_rate", "sqrt(n_symbols / n_words)", 0.1),
    ("dup_line_share", "n_dup_lines / n_lines", 0.15),
    ("repeat_share", "n_repeat_words / n_words", 0.15),
    ("letter_share", "n_letter_bytes / word_chars", 0.05),
    ("line_length", "ln(n_words / n_lines)", 0.5),
]
P = len(FEATURES)
SUBSET = 0.5  # share of a group's rows that the determinant is least for
REWEIGHT = 0.975  # share of a normal group's rows that the last estimate is from
REJECT = 1e-6  # share of a normal group's rows beyond the cut
MIN_ROWS = 10 * P  # a smaller group cannot carry an estimate: pooled by language, then with all
SHRINKS = 1e-5  # a logarithm of a determinant that falls by less stands still
BROADCAST_GROUPS = 20_000  # rows of about 300 bytes


def repeated_words(words: list[bytes]) -> int:
    """Words inside a window of three consecutive words that the text has twice
    or more, first occurrences included."""
    n = len(words)
    if n < 4:
        return 0
    grams = list(zip(words, words[1:], words[2:]))
    seen = Counter(grams)
    if len(seen) == n - 2:
        return 0
    hit = np.zeros(n, bool)
    twice = np.fromiter((seen[g] > 1 for g in grams), bool, n - 2)
    hit[: n - 2] = twice
    hit[1 : n - 1] |= twice
    hit[2:] |= twice
    return int(hit.sum())


def statistics(text: str) -> tuple[int, ...]:
    """The values of ``STATISTICS`` for a whole text."""
    data = text.encode()
    words = data.split()  # of bytes: splits on ASCII white space alone
    chars = len(data.translate(None, _CONTINUATION + _SPACES))
    seen: set[bytes] = set()
    dup = lines = 0
    for line in data.split(b"\n"):
        if line.strip(_SPACES):
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    letters = len(data.translate(None, _LETTERS))
    return len(words), chars, len(data.translate(None, _NOT_SYMBOLS)), dup, repeated_words(words), lines, letters


def _statistics(text_at, batches):
    release()
    for batch in batches:
        values = np.array([statistics(t) for t in texts_of(batch.column(text_at))], np.int64).reshape(-1, len(STATISTICS))
        struct = pa.StructArray.from_arrays([pa.array(values[:, i]) for i in range(len(STATISTICS))], names=STATISTICS)
        yield batch.append_column("_q", struct)


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` and a struct ``_q`` of ``STATISTICS`` of each whole text."""
    ship_package(docs.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    schema += ", _q struct<" + ", ".join(f"{c}: bigint" for c in STATISTICS) + ">"
    return docs.mapInArrow(partial(_statistics, place_of(docs, text_col)), schema)


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def chi2_cdf(x: float, k: int) -> float:
    """Chi-squared distribution of an even number ``k`` of degrees."""
    term = total = 1.0
    for i in range(1, k // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def chi2_cut(p: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return high


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 0.0
    f = 1.0
    for i in range(500):
        m = i // 2
        if i == 0:
            step = 1.0
        elif i % 2:
            step = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        else:
            step = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1 / ((1 + step * d) or tiny)
        c = (1 + step / c) or tiny
        f *= c * d
        if i and abs(1 - c * d) < 1e-13:
            break
    return front * (f - 1)


def outlier_cut(n: float, reject: float) -> float:
    """Squared distance that a share ``reject`` of normal rows exceeds, for an
    estimate from ``n`` other rows: a scaled F distribution with P and n - P
    degrees of freedom, chi-squared for very many rows."""
    if n - P < 1:
        return math.inf
    low, high = 0.0, 1.0  # F = (n - P) v / (P (1 - v)) for v of the beta distribution
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - beta_cdf(mid, P / 2, (n - P) / 2) > reject else (low, mid)
    return (n + 1) / n * (n - 1) * high / max(1 - high, 1e-300)


def consistency(share: float) -> float:
    """The factor by which covariances of the nearest ``share`` of normal rows
    are too small."""
    return share / chi2_cdf(chi2_cut(share, P), P + 2)


_X = [f"x{i}" for i in range(P)]
_M = [f"m{i}" for i in range(P)]
_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
_A = [f"a{i}_{j}" for i, j in _PAIRS]
_PARAMS = "g string, start int, n double, " + ", ".join(f"{c} double" for c in [*_M, *_A]) + ", logdet double"


def distance(prefix: str = "") -> Column:
    """Squared Mahalanobis distance of columns x to means m, inverse a."""
    d = [F.col(f"x{i}") - F.col(f"{prefix}m{i}") for i in range(P)]
    terms = [(1 if i == j else 2) * F.col(f"{prefix}a{i}_{j}") * d[i] * d[j] for i, j in _PAIRS]
    return sum(terms[1:], terms[0])


def _estimate(scale, sums):
    """Means and inverse covariances from counts, sums and sums of products;
    the least variances are added to the covariance's diagonal."""
    floor = np.diag([f[2] ** 2 for f in FEATURES])
    for batch in sums:
        out = []
        for r in batch.to_pylist():
            mean = np.array([r[f"s{i}"] for i in range(P)]) / r["n"]
            cov = np.empty((P, P))
            for i, j in _PAIRS:
                cov[i, j] = cov[j, i] = r[f"s{i}_{j}"] / r["n"] - mean[i] * mean[j]
            cov = cov * scale + floor
            inverse = np.linalg.inv(cov)
            out.append([r["g"], r["start"], r["n"], *mean, *(inverse[i, j] for i, j in _PAIRS), np.linalg.slogdet(cov)[1]])
        yield _params_batch(out)


def _params_batch(rows) -> pa.RecordBatch:
    names = ["g", "start", "n", *_M, *_A, "logdet"]
    kinds = [pa.string(), pa.int32(), *[pa.float64()] * (len(names) - 2)]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def _sign_shape(sums):
    """Starts from the covariance of the rows' directions, seen from the medians
    in units of the median deviations: a far outlier weighs as much as any row."""
    for batch in sums:
        out = []
        for r in batch.to_pylist():
            shape = np.empty((P, P))
            for i, j in _PAIRS:
                shape[i, j] = shape[j, i] = r[f"s{i}_{j}"] / r["n"]
            unit = np.array([r[f"u{i}"] for i in range(P)])
            inverse = np.linalg.inv(shape + np.eye(P) * 1e-3 / P) / np.outer(unit, unit)
            out.append([r["g"], 2, 0.0, *(r[m] for m in _M), *(inverse[i, j] for i, j in _PAIRS), None])
        yield _params_batch(out)


def _moments(rows: DataFrame, scale: float = 1.0) -> DataFrame:
    sums = [F.sum(c).alias(f"s{c[1:]}") for c in _X]
    products = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}") for i, j in _PAIRS]
    return (
        rows.groupBy("g", "start")
        .agg(F.count(F.lit(1)).cast("double").alias("n"), *sums, *products)
        .mapInArrow(partial(_estimate, scale), _PARAMS)
    )


def _groups(stats: DataFrame, min_rows: int) -> DataFrame:
    """(lang, source) to the group whose estimate judges it: its own, that of
    the language's small sources, or that of all that is still too small."""
    counts = stats.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    small = F.col("n") < min_rows
    by_lang = counts.where(small).groupBy("lang").agg(F.sum("n").alias("n_lang"))
    lang = F.col("l.lang").eqNullSafe(F.col("c.lang"))
    return (
        counts.alias("c")
        .join(by_lang.alias("l"), lang, "left")
        .select(
            "c.lang",
            "c.source",
            F.when(~small, F.to_json(F.struct(F.col("c.lang").alias("lang"), F.col("c.source").alias("source"))))
            .when(F.col("n_lang") >= min_rows, F.to_json(F.struct(F.col("c.lang").alias("lang"), F.lit(True).alias("rest"))))
            .otherwise("rest")
            .alias("g"),
        )
    )


def fit_outliers(stats: DataFrame, min_rows: int = MIN_ROWS, reject: float = REJECT) -> DataFrame:
    """Minimum-covariance-determinant estimates of the transformed statistics
    per language and source: one row for each (``lang``, ``source``) with the
    means ``m``, the inverse covariance ``a``, the group ``g`` it is from, and ``cut``.

    ``stats`` has ``lang``, ``source`` and ``STATISTICS``; rows that fail the
    base rules take no part. Each group has three starts: its medians and median
    deviations, its plain moments, and the covariance of directions from the
    medians. Concentration steps follow: the half of the rows with the least
    distances (their quantile by a mergeable summary) give the next estimate, as
    sums over all rows, until the determinant stops to shrink; groups that have
    come to rest take no part in further steps. The start with the least
    determinant wins. So up to half of a group may be outliers. Half of the rows
    alone give a rough estimate: its distances are scaled to the median of a
    normal group, and all rows that lie within the cut for a share REWEIGHT give
    the last one. ``cut`` is the distance that a share ``reject`` of normal rows
    exceeds under an estimate from so many rows. No group is gathered anywhere.
    """
    usable = stats.where(~base_failed(F.col("n_words"), F.col("n_repeat_words")))
    xs = [F.expr(sql).alias(c) for c, (_, sql, _) in zip(_X, FEATURES)]
    groups = cut(_groups(usable, min_rows))
    few = groups.count() <= BROADCAST_GROUPS
    small = F.broadcast if few else (lambda df: df)
    same = F.col("v.lang").eqNullSafe(F.col("k.lang")) & F.col("v.source").eqNullSafe(F.col("k.source"))
    rows = cut(usable.select("lang", "source", *xs).alias("v").join(small(groups.alias("k")), same).select("g", *_X))
    counts = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_rows).select("g")

    medians = rows.join(small(counts), "g").groupBy("g").agg(*[F.percentile_approx(x, 0.5, 1000).alias(m) for x, m in zip(_X, _M)])
    spread = cut(
        rows.join(small(medians), "g")
        .groupBy("g", *_M)
        .agg(*[F.percentile_approx(F.abs(F.col(x) - F.col(m)), 0.5, 1000).alias(f"d{x[1:]}") for x, m in zip(_X, _M)])
    )
    units = spread.select("g", *_M, *[F.sqrt(F.pow(1.4826 * F.col(f"d{i}"), 2) + FEATURES[i][2] ** 2).alias(f"u{i}") for i in range(P)])
    robust = units.select(
        "g",
        F.lit(0).alias("start"),
        F.lit(0.0).alias("n"),
        *_M,
        *[(1 / F.pow(F.col(f"u{i}"), 2) if i == j else F.lit(0.0)).alias(f"a{i}_{j}") for i, j in _PAIRS],
        F.lit(None).cast("double").alias("logdet"),
    )
    plain = _moments(rows.join(small(counts), "g").withColumn("start", F.lit(1)))
    z = [(F.col(f"x{i}") - F.col(f"m{i}")) / F.col(f"u{i}") for i in range(P)]
    norm = F.greatest(sum((c * c for c in z[1:]), z[0] * z[0]), F.lit(1e-12))  # a row at the medians has no direction
    signs = (
        rows.join(small(units), "g")
        .groupBy("g", *_M, *[f"u{i}" for i in range(P)])
        .agg(F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(z[i] * z[j] / norm).alias(f"s{i}_{j}") for i, j in _PAIRS])
        .mapInArrow(_sign_shape, _PARAMS)
    )
    params = cut(robust.unionByName(plain).unionByName(signs))
    at_rest = []
    while True:
        near = rows.join(small(params), "g").select("g", "start", *_X, distance().alias("d2"))
        reach = near.groupBy("g", "start").agg(F.percentile_approx("d2", SUBSET, 1000).alias("reach"))
        after = _moments(near.join(small(reach), ["g", "start"]).where("d2 <= reach"))
        before = params.select("g", "start", F.col("logdet").alias("before"))
        after = cut(after.join(small(before), ["g", "start"]).withColumn("moves", F.col("before").isNull() | (F.col("logdet") < F.col("before") - SHRINKS)))
        at_rest.append(after.where(~F.col("moves")).drop("before", "moves"))
        params = after.where("moves").drop("before", "moves")
        if params.isEmpty():
            break
    least = reduce(DataFrame.unionByName, at_rest)
    best = cut(least.groupBy("g").agg(F.min_by(F.struct(*_M, *_A), F.struct("logdet", "start")).alias("b")).select("g", "b.*"))
    # the estimate so far is that of half of the rows: its covariance is too small by a constant
    shrink = consistency(SUBSET)
    raw = rows.join(small(best), "g").select("g", F.lit(0).alias("start"), *_X, (distance() / shrink).alias("d2"))
    middle = raw.groupBy("g").agg((F.percentile_approx("d2", 0.5, 1000) / chi2_cut(0.5, P)).alias("unit"))
    inner = raw.join(small(middle), "g").where(F.col("d2") <= chi2_cut(REWEIGHT, P) * F.greatest("unit", F.lit(1.0)))
    last = _moments(inner, consistency(REWEIGHT)).mapInArrow(partial(_with_cut, reject), _PARAMS + ", cut double").select("g", *_M, *_A, "cut")
    return cut(groups.join(last, "g"))


def _with_cut(reject, batches):
    for batch in batches:
        known = {n: outlier_cut(n, reject) for n in set(batch.column("n").to_pylist())}
        yield batch.append_column("cut", pa.array([known[n] for n in batch.column("n").to_pylist()], pa.float64()))


def outlier_distance(stats: DataFrame, fitted: DataFrame) -> DataFrame:
    """``stats`` with ``distance2`` and the cut ``cut2``; null where base rules
    fail or where no group had rows enough."""
    few = fitted.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    side = fitted.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), F.struct(*_M, *_A, "cut").alias("_fit"))
    same = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    joined = stats.join(F.broadcast(side) if few else side, same, "left")
    ok = ~base_failed(F.col("_q.n_words"), F.col("_q.n_repeat_words"))
    xs = {c: F.when(ok, F.expr(sql_in_struct(sql))) for c, (_, sql, _) in zip(_X, FEATURES)}
    return joined.withColumns(xs).withColumns({"distance2": distance("_fit."), "cut2": F.when(ok, F.col("_fit.cut"))}).drop(*_X, "_lang", "_source", "_fit")


def sql_in_struct(sql: str) -> str:
    for c in STATISTICS:
        sql = sql.replace(c, f"_q.{c}")
    return sql


def judge(docs: DataFrame, fitted: DataFrame) -> DataFrame:
    """``docs`` (with ``_q``), ``base_failed``, ``distance2``, ``cut2`` and ``kept``."""
    out = outlier_distance(docs, fitted)
    failed = base_failed(F.col("_q.n_words"), F.col("_q.n_repeat_words"))
    near = F.coalesce(F.col("distance2") <= F.col("cut2"), F.lit(True))
    return out.withColumns({"base_failed": failed, "kept": ~failed & near})


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    min_rows: int = MIN_ROWS,
    reject: float = REJECT,
) -> DataFrame:
    """Every row's ``id_col``, ``BASE`` statistics, ``base_failed``, ``kept``
    ``distance2`` (squared robust Mahalanobis distance to its language and
    source) and ``cut2`` (the distance up to which a row is kept).

    Words are what white space of ASCII parts. A row fails the base rules with
    under 50 words or over half its words in repeated windows of three; another
    is rejected if its transformed statistics lie farther from its group's
    minimum-covariance-determinant estimate than all but a share ``reject`` of
    a normal group's rows.

    A null text has no words and fails; null languages and sources are values
    of their own; groups under ``min_rows`` are judged with the rest of their
    language, then with all such rests, and if these are too few by the base
    rules alone. Repeated rows and null ids are kept, one result each; an empty
    table gives an empty result. A very long text is held whole by its task.
    """
    chosen = docs.select(
        F.col(id_col).alias("_id"),
        F.col(text_col).cast("string").alias("_t"),
        F.col(lang_col).cast("string").alias("lang"),
        F.col(source_col).cast("string").alias("source"),
    )
    stats = cut(with_statistics(chosen, "_t").drop("_t"))
    fitted = fit_outliers(stats.select("lang", "source", "_q.*"), min_rows, reject)
    return judge(stats, fitted).select(
        F.col("_id").alias(id_col), *[F.col(f"_q.{c}").alias(c) for c in BASE], "base_failed", "kept", "distance2", "cut2"
    )


def keep_quality(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_rows: int = MIN_ROWS, reject: float = REJECT
) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps. The statistics of all
    texts are gathered first (numbers only), then each text is judged where it
    is read."""
    chosen = docs.select(
        F.col(text_col).cast("string").alias("_t"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source")
    )
    stats = cut(with_statistics(chosen, "_t").select("lang", "source", "_q.*"))
    fitted = fit_outliers(stats, min_rows, reject)
    text_col, lang_col, source_col = (docs.columns[place_of(docs, c)] for c in (text_col, lang_col, source_col))
    at = {c: f"_c{i}" for i, c in enumerate(docs.columns)}  # no name clashes with those added
    rows = with_statistics(docs.toDF(*at.values()).withColumn(at[text_col], F.col(at[text_col]).cast("string")), at[text_col])
    named = rows.withColumns({"lang": F.col(at[lang_col]).cast("string"), "source": F.col(at[source_col]).cast("string")})
    return judge(named, fitted).where("kept").select(*[F.col(b).alias(a) for a, b in at.items()])
