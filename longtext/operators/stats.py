"""Statistics over time: trimming, trends, composites, smoothing, variance decomposition."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longtext.functions.udfs import pearson_p
from longtext.operators import ranges
from longtext.operators.ranges import BLOCK, Save, broadcast_if_small, placed


def chronological(df: DataFrame, key: str, *order: str, save: Save) -> DataFrame:
    """Add idx, the 0-based place within the key; give enough order columns to leave no tie. A key of any size: see placed()."""
    return placed(df, key, list(order), save, "chronological").drop("_n")


def trimmed(df: DataFrame, key: str, value: str, width: float = 2.0) -> DataFrame:
    """Rows within width population deviations of their key's mean. Two grouped sums and a join: no key's rows meet in one task."""
    limits = df.groupBy(key).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    a, b = df.alias("a"), limits.alias("b")
    both = a.join(b, F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}")))
    return both.filter(F.abs(F.col(f"a.{value}") - F.col("_m")) <= width * F.col("_s") + 1e-12).select("a.*")


def trend(df: DataFrame, key: str, x: str, y: str, alpha: float = 0.05) -> DataFrame:
    """(key, n, dropped, r, p, slope, intercept, verdict) of y over x after trimming; r and p are null below three rows."""
    all_rows = df.groupBy(key).agg(F.count(y).alias("_all"))
    sums = trimmed(df, key, y).groupBy(key).agg(
        F.count(y).alias("n"), F.covar_pop(x, y).alias("_c"), F.var_pop(x).alias("_vx"), F.var_pop(y).alias("_vy"), F.avg(x).alias("_mx"), F.avg(y).alias("_my")
    )
    # corr() divides by zero where a series does not vary
    fitted = sums.withColumns({"r": F.when((F.col("_vx") > 0) & (F.col("_vy") > 0), F.col("_c") / F.sqrt(F.col("_vx") * F.col("_vy"))), "slope": F.when(F.col("_vx") > 0, F.col("_c") / F.col("_vx"))})
    fitted = fitted.withColumn("intercept", F.col("_my") - F.col("slope") * F.col("_mx"))
    both = fitted.join(all_rows, key).withColumn("dropped", F.col("_all") - F.col("n")).withColumn("r", F.when(F.col("n") >= 3, F.col("r")))
    both = both.withColumn("p", F.when(F.col("r").isNotNull(), pearson_p("r", F.col("n").cast("double"))))
    return both.withColumn("verdict", verdict(F.col("r"), F.col("p"), alpha)).select(key, "n", "dropped", "r", "p", "slope", "intercept", "verdict")


def verdict(r: Column, p: Column, alpha: float = 0.05) -> Column:
    return F.when(p.isNull() | F.isnan(p) | (p >= alpha), "null").when(r > 0, "sig-pos").otherwise("sig-neg")


def against_published(trends: DataFrame, published: DataFrame, key: str, feature: str) -> DataFrame:
    """Join trends of one feature to published (speaker, feature, r, p, n) and say whether the verdicts agree."""
    p = published.filter(F.col("feature") == feature).select(F.col("speaker").alias(key), F.col("r").alias("published_r"), F.col("p").alias("published_p"))
    both = trends.join(F.broadcast(p), key, "left").withColumn("published_verdict", verdict(F.col("published_r"), F.col("published_p")))
    return both.withColumn("matches", F.when(F.col("published_r").isNotNull(), F.col("verdict") == F.col("published_verdict")))


def z_scores(df: DataFrame, columns: list[str]) -> DataFrame:
    """Add z_<column> over all rows with the sample deviation; the moments are one row, broadcast."""
    moments = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_samp(c).alias(f"_s_{c}") for c in columns])
    both = df.crossJoin(F.broadcast(moments))
    return both.withColumns({f"z_{c}": (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}") for c in columns}).drop(*[f"_{k}_{c}" for k in "ms" for c in columns])


def composite(df: DataFrame, up: list[str], down: list[str], name: str = "complexity") -> DataFrame:
    """z-scores added up with their signs, over their number."""
    scored = z_scores(df, [*up, *down])
    total = sum((F.col(f"z_{c}") for c in up), F.lit(0.0)) - sum((F.col(f"z_{c}") for c in down), F.lit(0.0))
    return scored.withColumn(name, total / (len(up) + len(down)))


def rolling_mean(df: DataFrame, key: str, order: list[str], value: str, rows: int = 50, least: int = 10, *, save: Save, block: int = BLOCK) -> DataFrame:
    """Add `rolling`, the mean of the last rows in order, from blocks of the key and the rows just before them."""
    placed_rows = placed(df, key, order, save, "rolling")
    return ranges.rolling_mean(placed_rows, key, value, rows, least, block).drop("idx", "_n")


def years_between(start: Column, end: Column) -> Column:
    return F.datediff(end, start) / F.lit(365.25)


def progress(df: DataFrame, key: str, x: str) -> DataFrame:
    """x over the greatest x of the key: a grouped maximum, joined back."""
    most = df.groupBy(F.col(key).alias("_key")).agg(F.max(x).alias("_most"))
    both = df.join(broadcast_if_small(most), F.col(key).eqNullSafe(F.col("_key")))
    return both.withColumn("progress", F.col(x) / F.coalesce(F.nullif("_most", F.lit(0)), F.lit(1))).drop("_key", "_most")


def centred(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    means = df.groupBy(key).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns])
    return df.join(means, key).withColumns({c: F.col(c) - F.col(f"_m_{c}") for c in columns}).drop(*[f"_m_{c}" for c in columns])


def histogram(df: DataFrame, value: str, bins: int = 40) -> DataFrame:
    """(bin, n) over equal widths from the least to the greatest value; bins are 0-based."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    place = F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins))
    placed = df.select(value).dropna().crossJoin(F.broadcast(ends)).withColumn("bin", F.coalesce(place, F.lit(0)).cast("int"))
    return placed.groupBy("bin").agg(F.count("*").alias("n"))


#: From so many columns on, products are summed as matrices in tasks: as expressions they would be one for each pair of columns.
WIDE = 16


def moments(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, means, population covariance); only numbers by the columns, never by the rows, reach the driver. Rows with a null are left out."""
    d, p = df.select(*columns).dropna(subset=columns), len(columns)
    if p >= WIDE:
        return wide_moments(d, columns)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    row = d.agg(F.count("*"), *[F.avg(c) for c in columns], *[F.covar_pop(columns[i], columns[j]) for i, j in pairs]).first()
    cov = np.zeros((p, p))
    for (i, j), v in zip(pairs, row[1 + p :], strict=True):
        cov[i, j] = cov[j, i] = v or 0.0
    return row[0], np.array([v or 0.0 for v in row[1 : 1 + p]]), cov


def wide_moments(d: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """moments() of many columns: means first, then each task's matrix of products around them, added up by cell."""
    p = len(columns)
    n, *means = d.agg(F.count("*"), *[F.avg(c) for c in columns]).first()
    means = np.array([v or 0.0 for v in means])

    def products(batches):
        total = np.zeros((p, p))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float) - means
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(p * p)), pa.array(total.ravel())], names=["cell", "v"])

    cells = d.mapInArrow(products, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    cov = np.zeros(p * p)
    for r in cells:
        cov[r.cell] = r.v / max(n, 1)
    return n, means, cov.reshape(p, p)


def correlation(cov: np.ndarray) -> np.ndarray:
    sd = np.sqrt(np.diag(cov))
    sd[sd == 0] = 1
    return cov / np.outer(sd, sd)


def explained_variance(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Shares of variance of the principal components of standardised columns, largest first."""
    values = np.linalg.eigvalsh(correlation(moments(df, columns)[2]))[::-1]
    return values / values.sum()


def varimax(loadings: np.ndarray, sweeps: int = 100) -> np.ndarray:
    """Rotate each pair of factors by the angle that is best for it, until none turns."""
    out, (p, k) = loadings.copy(), loadings.shape
    for _ in range(sweeps):
        most = 0.0
        for i in range(k):
            for j in range(i + 1, k):
                x, y = out[:, i].copy(), out[:, j].copy()
                u, v = x * x - y * y, 2 * x * y
                top = 2 * (u * v).sum() - 2 * u.sum() * v.sum() / p
                low = (u * u - v * v).sum() - (u.sum() ** 2 - v.sum() ** 2) / p
                turn = np.arctan2(top, low) / 4
                out[:, i], out[:, j] = np.cos(turn) * x + np.sin(turn) * y, np.cos(turn) * y - np.sin(turn) * x
                most = max(most, abs(turn))
        if most < 1e-9:
            break
    return out


def factor_loadings(r: np.ndarray, k: int, rounds: int = 3000) -> tuple[np.ndarray, np.ndarray]:
    """(varimax loadings p x k, noise variances): maximum likelihood by iterated eigenvectors of the scaled matrix."""
    noise, load = np.ones(len(r)), None
    for _ in range(rounds):
        scale = np.sqrt(noise)
        values, vectors = np.linalg.eigh(r / np.outer(scale, scale))
        values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
        new = scale[:, None] * vectors * np.sqrt(np.clip(values - 1, 0, None))
        noise_new = np.clip(np.diag(r) - (new**2).sum(axis=1), 1e-8, None)
        done = load is not None and np.abs(noise_new - noise).max() < 1e-9
        load, noise = new, noise_new
        if done:
            break
    return varimax(load), noise


def factor_scores(df: DataFrame, columns: list[str], k: int = 4, within: str | None = None) -> tuple[DataFrame, np.ndarray]:
    """(df with f1..fk, loadings). With `within`, columns are first centred on that key. Scores are sums of columns times constants."""
    base = centred(df, within, columns) if within else df
    base = base.dropna(subset=columns)
    _, means, cov = moments(base, columns)
    sd = np.sqrt(np.diag(cov))
    sd[sd == 0] = 1
    load, noise = factor_loadings(correlation(cov), k)
    weights = (load / noise[:, None]) @ np.linalg.inv(np.eye(k) + (load.T / noise) @ load)
    scores = {}
    for f in range(k):
        terms = [(F.col(c) - float(means[i])) * float(weights[i, f] / sd[i]) for i, c in enumerate(columns)]
        scores[f"f{f + 1}"] = sum(terms[1:], terms[0])
    return base.withColumns(scores), load


def top_loadings(loadings: np.ndarray, columns: list[str], k: int = 5) -> list[list[tuple[str, float]]]:
    return [sorted(zip(columns, loadings[:, f].tolist(), strict=True), key=lambda x: -abs(x[1]))[:k] for f in range(loadings.shape[1])]
