"""Active learning: seeded split, Gaussian process, Expected Improvement, the loop and rankings."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written

# The polynomial of the normal distribution function (error under 7.5e-8).
PHI = (0.2316419, 0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
#: Values of a table that a prediction fills at once: 16 MB.
BLOCK = 1 << 21


@dataclass(frozen=True)
class Config:
    seed: int = 2
    initial: int = 50
    test: int = 50
    acquired: int = 20
    threshold: float = 0.01
    patience: int = 2
    features: int = 10
    cutoff: float = 0.95
    restarts: int = 20
    trees: int = 100


def expected_improvement(mean: Column, sd: Column, best: float | Column) -> Column:
    """(mean - best) * Phi(z) + sd * phi(z), with sd of 1e-9 at least."""
    s = F.greatest(sd, F.lit(1e-9))
    gain = mean - best
    z = gain / s
    density = F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    t = 1 / (1 + PHI[0] * F.abs(z))
    tail = density * t * (PHI[1] + t * (PHI[2] + t * (PHI[3] + t * (PHI[4] + t * PHI[5]))))
    return gain * F.when(z >= 0, 1 - tail).otherwise(tail) + s * density


def top_k(df: DataFrame, score: str, tie: str, k: int) -> DataFrame:
    """The k best rows; NaN first, larger ties first."""
    return df.orderBy(F.desc(score), F.desc(tie)).limit(k)


def split_places(n: int, config: Config = Config()) -> tuple[np.ndarray, np.ndarray]:  # noqa: B008
    """The row numbers of train and of test; all others are the pool. One seeded generator shuffles all rows, then what the first draw left."""
    if n <= config.initial + config.test:
        raise ValueError("too few rows to split")
    random = np.random.RandomState(config.seed)
    order = np.arange(n)
    random.shuffle(order)
    rest = order[config.initial :].copy()
    random.shuffle(rest)
    return order[: config.initial], rest[: config.test]


def split_roles(n: int, config: Config = Config()) -> list[str]:  # noqa: B008
    """train, test or pool for each row number."""
    train, test = split_places(n, config)
    role = np.full(n, "pool", object)
    role[train], role[test] = "train", "test"
    return role.tolist()


@dataclass
class Process:
    """A Gaussian process: constant times Matern 3/2 with a length a feature, plus noise, on a standardised target."""

    x: np.ndarray
    alpha: np.ndarray
    chol: np.ndarray
    theta: np.ndarray
    mean: float
    scale: float

    @staticmethod
    def kernel(a: np.ndarray, b: np.ndarray, theta: np.ndarray) -> np.ndarray:
        length = np.exp(theta[2:])
        out, step = np.empty((len(a), len(b))), max(1, BLOCK // max(1, b.size))
        for k in range(0, len(a), step):  # a block at a time, as its table has a value for each pair and column
            d = np.sqrt(np.maximum(((a[k : k + step, None] / length - b[None] / length) ** 2).sum(-1), 0)) * math.sqrt(3)
            out[k : k + step] = np.exp(theta[0]) * (1 + d) * np.exp(-d)
        return out

    @classmethod
    def _loss(cls, theta: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
        """Negative log marginal likelihood and its gradient."""
        n, z = len(x), x / np.exp(theta[2:])
        size = (z * z).sum(1)
        d = np.sqrt(np.maximum(size[:, None] + size[None] - 2 * z @ z.T, 0)) * math.sqrt(3)
        e = np.exp(theta[0]) * np.exp(-d)
        k = e * (1 + d)
        try:
            chol = np.linalg.cholesky(k + (np.exp(theta[1]) + 1e-10) * np.eye(n))
        except np.linalg.LinAlgError:
            return np.inf, np.zeros_like(theta)
        inv = np.linalg.inv(chol)
        inv = inv.T @ inv
        alpha = inv @ y
        w = inv - np.outer(alpha, alpha)
        # By length: the sum over pairs of m times the squared distance in one column, without a table of all pairs and columns.
        m = w * e
        by_length = 3 * ((z * z).T @ m.sum(1) - ((m @ z) * z).sum(0))
        grad = np.concatenate([[(w * k).sum() / 2, np.exp(theta[1]) * np.trace(w) / 2], by_length])
        return float(y @ alpha / 2 + np.log(np.diag(chol)).sum() + n * math.log(2 * math.pi) / 2), grad

    @classmethod
    def _descended(cls, k: int, x: np.ndarray, t: np.ndarray, seed: int, steps: int) -> tuple[float, np.ndarray]:
        """The loss and parameters that start k reaches by projected gradient descent with adaptive steps."""
        # The constant, the noise and the lengths: bounds of each; the first start is 1 for all, the others are drawn.
        low, high = np.log([1e-3, 1e-5, *[1e-5] * x.shape[1]]), np.log([1e3, 1e5, *[1e5] * x.shape[1]])
        theta = np.random.RandomState(seed + 1000 * k).uniform(low, high) if k else np.zeros(2 + x.shape[1])
        loss, grad = cls._loss(theta, x, t)
        rate = 0.1
        for _ in range(steps):
            new = np.clip(theta - rate * grad / max(1.0, np.abs(grad).max()), low, high)
            other, g = cls._loss(new, x, t)
            if other < loss:
                gain, theta, loss, grad, rate = loss - other, new, other, g, rate * 1.5
                if gain < 1e-6:
                    break
            else:
                rate /= 3
                if rate < 1e-5:
                    break
        return loss, theta

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, restarts: int = 20, seed: int = 2, steps: int = 60, spark: SparkSession | None = None) -> Process:
        """The best of several starts, each a task of its own where a session is given."""
        mean, scale = float(y.mean()), float(y.std()) or 1.0
        t = (y - mean) / scale
        if spark is None:
            found = [cls._descended(k, x, t, seed, steps) for k in range(restarts + 1)]
        else:

            def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for f in frames:
                    for k in f["id"]:
                        loss, theta = cls._descended(int(k), x, t, seed, steps)
                        yield pd.DataFrame({"loss": [loss], "theta": [theta.tolist()]})

            rows = spark.range(0, restarts + 1, 1, restarts + 1).mapInPandas(run, "loss double, theta array<double>").collect()
            found = [(r["loss"], np.array(r["theta"])) for r in rows]
        chosen = min(found, key=lambda r: r[0])[1]
        k = cls.kernel(x, x, chosen) + (np.exp(chosen[1]) + 1e-10) * np.eye(len(x))
        chol = np.linalg.cholesky(k)
        return cls(x, np.linalg.solve(chol.T, np.linalg.solve(chol, t)), chol, chosen, mean, scale)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        step = max(1, BLOCK // max(1, len(self.x)))
        told = [self._predicted(x[k : k + step]) for k in range(0, max(1, len(x)), step)]
        return tuple(np.concatenate(t) for t in zip(*told, strict=True))

    def _predicted(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = self.kernel(x, self.x, self.theta)
        v = np.linalg.solve(self.chol, k.T)
        variance = np.exp(self.theta[0]) + np.exp(self.theta[1]) - (v**2).sum(0)
        return k @ self.alpha * self.scale + self.mean, np.sqrt(np.maximum(variance, 0)) * self.scale


def predicted(df: DataFrame, process: Process, columns: list[str], mean: np.ndarray, width: np.ndarray) -> DataFrame:
    """df with mu and sigma: the fitted process, whose size is bounded by its training rows, scores batches in parallel."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            mu, sigma = process.predict((f[columns].to_numpy(float) - mean) / width) if len(f) else (np.zeros(0), np.zeros(0))
            yield f.assign(mu=mu, sigma=sigma)

    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in df.schema) + ", mu double, sigma double"
    return df.mapInPandas(run, schema)


def importances(df: DataFrame, columns: list[str], target: str, seed: int = 2, trees: int = 100) -> list[tuple[str, int]]:
    """(feature, splits) by how often boosted trees split on it, most first, then in column order."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    rows = VectorAssembler(inputCols=columns, outputCol="_x").transform(df.select(*columns, F.col(target).alias("_y"))).select("_x", "_y")
    model = GBTRegressor(featuresCol="_x", labelCol="_y", maxIter=trees, maxDepth=3, seed=seed).fit(rows)
    splits = dict.fromkeys(range(len(columns)), 0)
    for line in model.toDebugString.splitlines():
        if line.strip().startswith("If (feature "):
            splits[int(line.split("feature ")[1].split()[0])] += 1
    return [(columns[k], n) for k, n in sorted(splits.items(), key=lambda x: (-x[1], x[0]))]


def split_counts(x: np.ndarray, y: np.ndarray, trees: int = 100, leaves: int = 31, least: int = 20, rate: float = 0.1) -> np.ndarray:
    """How often boosted regression trees split on each column: rows that fit the driver.

    Each tree grows by the leaf whose best split lowers the squared error most, up to `leaves` leaves of `least` rows each. NaN counts as less
    than any number. Ties go to the first column and the least place.
    """
    counts, fitted = np.zeros(x.shape[1], int), np.full(len(y), y.mean())
    order = np.argsort(np.where(np.isnan(x), -np.inf, x), axis=0, kind="stable")

    def best(rows: np.ndarray, rest: np.ndarray) -> tuple[float, int, np.ndarray]:
        """(gain, column, which rows go left) of a leaf."""
        own = np.zeros(len(y), bool)
        own[rows] = True
        n = len(rows)
        if n < 2 * least:
            return 0.0, -1, own
        sorted_rows = order.T[own[order.T]].reshape(x.shape[1], n)
        sums = np.cumsum(rest[sorted_rows], axis=1)[:, :-1]
        left = np.arange(1, n)
        total = rest[rows].sum()
        values = np.take_along_axis(np.where(np.isnan(x), -np.inf, x).T, sorted_rows, 1)
        gain = sums**2 / left + (total - sums) ** 2 / (n - left) - total**2 / n
        gain = np.where((left >= least) & (n - left >= least) & (values[:, 1:] > values[:, :-1]), gain, 0.0)
        c, k = np.unravel_index(np.argmax(gain), gain.shape)
        return float(gain[c, k]), int(c), sorted_rows[c, : k + 1]

    for _ in range(trees):
        rest = y - fitted
        grown = [(best(np.arange(len(y)), rest), np.arange(len(y)))]
        while len(grown) < leaves:
            at = max(range(len(grown)), key=lambda k: grown[k][0][0])
            (gain, column, left), rows = grown[at]
            if gain <= 1e-12:
                break
            counts[column] += 1
            right = np.setdiff1d(rows, left, assume_unique=True)
            grown[at : at + 1] = [(best(left, rest), left), (best(right, rest), right)]
        if len(grown) == 1:
            break
        for _, rows in grown:
            fitted[rows] += rate * rest[rows].mean()
    return counts


def r2(y: np.ndarray, p: np.ndarray) -> float:
    return float(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())


def r2_of(df: DataFrame, y: Column, p: Column) -> DataFrame:
    """One row, r2: 1 less the squared errors' share of the squared distances from the mean, which a first pass takes."""
    mean = df.agg(F.avg(y).alias("_mean"))
    return df.crossJoin(F.broadcast(mean)).agg((1 - F.try_divide(F.sum((y - p) ** 2), F.sum((y - F.col("_mean")) ** 2))).alias("r2"))


def settling(df: DataFrame, group: str, order: str, score: str, patience: int = 2, threshold: float = 0.01) -> DataFrame:
    """df with spread, the range of the last `patience` scores of a group, and settled: whether there are so many and it is under the threshold."""
    from pyspark.sql import Window as W

    last = W.partitionBy(group).orderBy(order).rowsBetween(1 - patience, 0)
    spread = F.max(score).over(last) - F.min(score).over(last)
    return df.withColumns({"spread": spread, "settled": (F.count(score).over(last) == patience) & (spread < threshold)})


def normalized(raw: np.ndarray) -> np.ndarray:
    """Shares of the sum; alike for all where that isn't positive."""
    return raw / raw.sum() if raw.sum() > 0 else np.full(len(raw), 1 / max(1, len(raw)))


def require(df: DataFrame, columns: list[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {missing}")


def validated(df: DataFrame, columns: list[str], target: str, config: Config = Config()) -> None:  # noqa: B008
    """Raises for missing columns, infinite features (NaN may be), targets that aren't finite, and too few rows."""
    require(df, [*columns, target])
    infinite = lambda c: F.coalesce(F.abs(F.col(c)) == float("inf"), F.lit(False))
    bad_y = F.col(target).isNull() | F.isnan(target) | infinite(target)
    told = df.agg(F.count("*").alias("n"), F.count_if(bad_y).alias("y"), *[F.count_if(infinite(c)).alias(f"x{k}") for k, c in enumerate(columns)]).first()
    wrong = [c for k, c in enumerate(columns) if told[f"x{k}"]]
    if wrong:
        raise ValueError(f"infinite values in {wrong[:20]}")
    if told["y"]:
        raise ValueError(f"{told['y']} target values aren't finite")
    if told["n"] <= config.initial + config.test:
        raise ValueError(f"more than {config.initial + config.test} rows are needed, there are {told['n']}")


@dataclass
class Learned:
    """What a run leaves: tables of rows a round, and the last round's model with its features, scaling and best training value."""

    history: list[tuple] = field(default_factory=list)  # Iteration, Training_Size, Pool_Size, R2
    selected: list[tuple] = field(default_factory=list)  # Iteration, Rank, Feature_Name, LGB_Raw_Importance, Normalized_Weight
    parity: list[tuple] = field(default_factory=list)  # Iteration, row id, y_true, y_pred, residual
    roles: list[tuple] = field(default_factory=list)  # row number, role, Iteration of its acquisition or 0: of all rows but those left in the pool
    rows: DataFrame | None = None  # n (the row number), id and the values of all rows
    correlations: list[tuple] = field(default_factory=list)  # Iteration, feature, other feature, r: of the selected ones
    process: Process | None = None
    features: list[str] = field(default_factory=list)
    mean: np.ndarray | None = None
    width: np.ndarray | None = None
    best: float = 0.0

    def tables(self, spark: SparkSession, config: Config = Config()) -> dict[str, DataFrame]:  # noqa: B008
        last = self.history[-1]
        final = [(name, raw, weight, 100 * weight) for i, _, name, raw, weight in self.selected if i == last[0]]
        parity = "Iteration int, row_id long, y_true double, y_pred double, residual double"
        return {
            "history": spark.createDataFrame(self.history, "Iteration int, Training_Size int, Pool_Size int, R2 double"),
            "selected_features": spark.createDataFrame(self.selected, "Iteration int, Rank int, Feature_Name string, LGB_Raw_Importance long, Normalized_Weight double"),
            "feature_summary": spark.createDataFrame(final, "Feature_Name string, LGB_Raw_Importance long, Normalized_Weight double, Contribution_Percentage double"),
            "parity": spark.createDataFrame(self.parity, parity),
            "correlations": spark.createDataFrame(self.correlations, "Iteration int, feature string, other string, r double"),
            "roles": self.rows.select("n", F.col("id").cast("long").alias("row_id")).join(F.broadcast(spark.createDataFrame(self.roles, "n long, role string, acquired_iter int")), "n", "left")
            .select("row_id", F.coalesce("role", F.lit("pool")).alias("role"), F.coalesce("acquired_iter", F.lit(0)).alias("acquired_iter")),
            "summary": spark.createDataFrame([(last[0], last[3], config.initial, config.test, config.acquired, config.features)], "Total_Iterations int, Final_Converged_R2 double, Initial_Training_Size int, Fixed_Test_Size int, Selected_Per_Iteration int, Top_Features int"),
        }


def numbered(df: DataFrame, order: str) -> tuple[DataFrame, int]:
    """df with n, its row's number in that order, as a written table; and the count of rows. No row goes to the driver."""
    rows = df.orderBy(order).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_at"))
    rows = written(rows, "numbered")
    sizes = {r["_part"]: r["count"] for r in rows.groupBy("_part").count().collect()}
    before = np.concatenate([[0], np.cumsum([sizes.get(k, 0) for k in range(max(sizes, default=0) + 1)])]).tolist()
    starts = F.array(*[F.lit(k).cast("long") for k in before])
    return rows.withColumn("n", F.get(starts, F.col("_part")) + F.col("_at")).drop("_part", "_at"), before[-1]


def improvements(rows: DataFrame, columns: list[str], process: Process, mean: np.ndarray, width: np.ndarray, best: float) -> DataFrame:
    """(n, ei): the Expected Improvement of each row, in tasks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            mu, sigma = process.predict((f[columns].to_numpy(float) - mean) / width)
            s = np.maximum(sigma, 1e-9)
            z = (mu - best) / s
            ei = (mu - best) * np.array([0.5 * (1 + math.erf(v / math.sqrt(2))) for v in z]) + s * np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
            yield pd.DataFrame({"n": f["n"], "ei": ei})

    return rows.select("n", *columns).mapInPandas(run, "n long, ei double")


def learned(df: DataFrame, row_id: str, columns: list[str], target: str, config: Config = Config()) -> Learned:  # noqa: B008
    """Rounds of selecting features, fitting, scoring on the test rows and acquiring by Expected Improvement until R2 settles or the pool is empty.

    Rows of train and test are on the driver, where the sequential choice runs; the pool stays a table, which tasks score. The
    starts of a fit are Spark tasks.
    """
    from .features import greedy

    spark = df.sparkSession
    validated(df, columns, target, config)
    # The columns go under numbers, so that none of their names can clash with those used here.
    own = [f"x{k}" for k in range(len(columns))]
    rows, total = numbered(df.select(F.col(row_id).alias("id"), *[F.col(c).alias(o) for c, o in zip(columns, own, strict=True)], F.col(target).alias("y")), "id")

    def fetched(places: np.ndarray) -> pd.DataFrame:
        asked = F.broadcast(spark.createDataFrame([(int(k),) for k in places], "n long"))
        return rows.join(asked, "n").orderBy("n").toPandas()

    train_places, test_places = split_places(total, config)
    train, test, out = fetched(train_places), fetched(test_places), Learned(rows=rows)
    roles = {int(k): ("train", 0) for k in train_places} | {int(k): ("test", 0) for k in test_places}
    while True:
        number, n_pool = len(out.history) + 1, total - len(train) - len(test)
        x, y = train[own].to_numpy(float), train["y"].to_numpy(float)
        usable = np.flatnonzero(np.isfinite(x).all(0))
        counts = split_counts(x[:, usable], y, config.trees)
        ranked = [columns[usable[k]] for k in np.lexsort((usable, -counts))]
        raw = dict(zip((columns[k] for k in usable), counts.tolist(), strict=True))
        with np.errstate(invalid="ignore", divide="ignore"):
            corr = np.abs(np.atleast_2d(np.corrcoef(x[:, usable].T)))
        place = {columns[k]: i for i, k in enumerate(usable)}
        r = {(a, b): (None if np.isnan(corr[place[a], place[b]]) else float(corr[place[a], place[b]])) for a in place for b in place}
        chosen = greedy(ranked, r, config.features, config.cutoff)
        weights = normalized(np.array([raw[f] for f in chosen], float))
        out.selected += [(number, k, f, raw[f], float(w)) for k, (f, w) in enumerate(zip(chosen, weights, strict=True), 1)]
        out.correlations += [(number, a, b, r[a, b]) for a in chosen for b in chosen]
        used = [own[usable[place[f]]] for f in chosen]
        x = train[used].to_numpy(float)
        mean, width = x.mean(0), x.std(0)
        width = np.where(width > 0, width, 1)
        process = Process.fit((x - mean) / width, y, config.restarts, config.seed, spark=spark)
        told, y_test = process.predict((test[used].to_numpy(float) - mean) / width)[0], test["y"].to_numpy(float)
        score = r2(y_test, told)
        out.parity += [(number, int(i), float(v), float(p), float(v - p)) for i, v, p in zip(test["id"], y_test, told, strict=True)]
        out.history.append((number, len(train), n_pool, score))
        out.process, out.features, out.mean, out.width, out.best = process, chosen, mean, width, float(y.max())
        last = [h[3] for h in out.history[-config.patience :]]
        if not n_pool or (len(last) == config.patience and max(last) - min(last) < config.threshold):
            break
        taken = F.broadcast(spark.createDataFrame([(k,) for k in roles], "n long"))
        scored = improvements(rows.join(taken, "n", "left_anti"), used, process, mean, width, out.best)
        new = [r["n"] for r in top_k(scored, "ei", "n", config.acquired).select("n").collect()]
        roles |= {int(k): ("train", number) for k in new}
        train = pd.concat([train, fetched(np.array(new))]).sort_values("n", ignore_index=True)
    out.roles = [(k, role, i) for k, (role, i) in roles.items()]
    return out


def screened(candidates: DataFrame, model: Learned) -> DataFrame:
    """candidates with Predicted_Mobility, Uncertainty and EI_Score by the last round's features, scaling and process; the features must be there."""
    require(candidates, model.features)
    own = [c for c in candidates.columns if c not in ("mu", "sigma", "Predicted_Mobility", "Uncertainty", "EI_Score")]
    out = predicted(candidates.select(*own), model.process, model.features, model.mean, model.width)
    score = expected_improvement(F.col("mu"), F.col("sigma"), model.best)
    return out.select(*own, F.col("mu").alias("Predicted_Mobility"), F.col("sigma").alias("Uncertainty"), score.alias("EI_Score"))


def rankings(scored: DataFrame, element: str = "Dopant_Element", hosts: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(by composition, by dopant) of screened candidates: means by the element column, best EI first, and by its one element that is no host, best prediction first."""
    from .features import single_dopant

    named = ("Predicted_Mobility", "EI_Score", "Uncertainty")
    by = ranking(scored, element, "avg_ei", *named).toDF(element, "Avg_Pred_Mobility", "Avg_EI", "Avg_Uncertainty", "Sample_Count")
    kinds = scored.withColumn("Dopant_Element_Type", single_dopant(F.col(element), hosts or ["Bi", "Te"]))
    dopant = ranking(kinds, "Dopant_Element_Type", "avg_mean", *named).toDF("Dopant_Element_Type", "Average_Predicted_Mobility", "Average_EI", "Average_Uncertainty", "Sample_Count")
    return by, dopant


def ranking(df: DataFrame, group: str, by: str, mean: str = "mu", ei: str = "ei", sigma: str = "sigma") -> DataFrame:
    """Means by group, null groups left out, sorted by one of them and the name."""
    out = df.filter(F.col(group).isNotNull()).groupBy(group).agg(F.avg(mean).alias("avg_mean"), F.avg(ei).alias("avg_ei"), F.avg(sigma).alias("avg_sigma"), F.count("*").alias("samples"))
    return out.orderBy(F.desc(by), group)
