"""Small models of outcome probabilities, fitted by distributed sums.

Fitted parameters are a few hundred numbers at most; rows stay distributed. The hierarchical
models need gradients: every step is one aggregate over the rows (grouped sums of a fixed number
of columns), solved on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.durable import durable
from tallyloom.functions.recode import clip, logit, sigmoid

CONSTRUCTS = ["threat", "acceptance_or_engagement", "barrier_capability", "cue", "navigation_self_efficacy"]


def construct_frame(df: DataFrame, proxies: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """The five constructs in 0..1; barriers are turned round."""
    x = [clip(F.col(p).cast("double") / 5, 0, 1) for p in proxies]
    x[2] = clip(1 - F.col(proxies[2]).cast("double") / 5, 0, 1)
    return df.select(*keep, *[c.alias(n) for n, c in zip(CONSTRUCTS, x)])


@dataclass(frozen=True)
class Logistic:
    names: tuple[str, ...]
    medians: tuple[float, ...]
    intercept: float
    coefficients: tuple[float, ...]

    def probability(self) -> Column:
        z = F.lit(self.intercept)
        for n, m, b in zip(self.names, self.medians, self.coefficients):
            z = z + float(b) * F.coalesce(F.col(n), F.lit(float(m)))
        return sigmoid(z)


def nonnegative_logistic(df: DataFrame, y: str, names: Sequence[str] = CONSTRUCTS, weight: str | None = None, ridge: float = 0.01) -> Logistic:
    """Weighted mean log loss + ridge * sum of squares, coefficients not negative, free intercept.

    Missing values take the median of the fitted rows (0.5 if there is none).
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.linalg import DenseMatrix

    rows = df.filter(F.col(y).isNotNull())
    m = rows.agg(*[F.coalesce(F.median(n), F.lit(0.5)).alias(n) for n in names]).first()
    filled = rows.select(F.col(y).cast("double").alias("label"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"), *[F.coalesce(n, F.lit(float(m[n]))).alias(n) for n in names])
    data = VectorAssembler(inputCols=list(names), outputCol="features").transform(filled)
    lr = LogisticRegression(
        regParam=2 * ridge, elasticNetParam=0.0, standardization=False, weightCol="w", maxIter=200, tol=1e-9,
        lowerBoundsOnCoefficients=DenseMatrix(1, len(names), [0.0] * len(names)),
    ).fit(data)
    return Logistic(tuple(names), tuple(float(m[n]) for n in names), float(lr.intercept), tuple(map(float, lr.coefficients)))


def crossfit(df: DataFrame, y: str, fold: str, k: int, names: Sequence[str] = CONSTRUCTS, weight: str | None = None) -> DataFrame:
    """Add prior, residual and direction; a row's prior comes from the folds it is not in.

    The k fits are k small jobs; all rows are scored in one projection.
    """
    p = F.lit(None).cast("double")
    for i in range(k):
        p = F.when(F.col(fold) == i, nonnegative_logistic(df.filter(F.col(fold) != i), y, names, weight).probability()).otherwise(p)
    out = df.withColumn("prior", p).withColumn("residual", F.col(y) - F.col("prior"))
    return out.withColumn("residual_direction", F.when(F.col("residual") >= 0, "increase").otherwise("decrease"))


def _pinned(df: DataFrame) -> DataFrame:
    """Rows that are read in every step: computed once, cached, at most a partition a core."""
    return durable(df).coalesce(df.sparkSession.sparkContext.defaultParallelism).persist()


def _summed(rows: DataFrame, run) -> np.ndarray:
    """Sum of the vectors that the partitions yield; these are added up without a shuffle."""
    parts = rows.mapInPandas(lambda b: (pd.DataFrame({"v": [v]}) for v in run(b)), "v array<double>").collect()
    return np.sum([r["v"] for r in parts], axis=0)


@dataclass
class Reward:
    """Weights softplus(g), pattern multipliers exp(0.45 tanh(m)) and pattern means."""

    patterns: list[str]
    g: np.ndarray
    m: np.ndarray
    means: np.ndarray
    losses: list[float]

    @property
    def weights(self) -> np.ndarray:
        return np.log1p(np.exp(self.g)) * np.exp(0.45 * np.tanh(self.m))

    def contributions(self, names: Sequence[str] = CONSTRUCTS, pattern: str = "hbm8_pattern") -> list[Column]:
        out = []
        for i, n in enumerate(names):
            c = F.lit(0.0)
            for k, p in enumerate(self.patterns):
                c = F.when(F.col(pattern) == p, float(self.weights[k, i]) * (F.coalesce(n, F.lit(0.5)) - float(self.means[k, i]))).otherwise(c)
            out.append(c)
        return out


def fit_reward(df: DataFrame, y: str, anchor: str, patterns: Sequence[str], names: Sequence[str] = CONSTRUCTS, pattern: str = "hbm8_pattern",
               weight: str | None = None, steps: int = 300, rate: float = 0.05, ridge_pattern: float = 0.05, ridge_global: float = 0.01, patience: int = 30) -> Reward:
    """logit(p) = logit(anchor) + weights of the pattern . (x - mean of the pattern), by Adam.

    Each step, the partitions sum loss and derivatives per pattern in numpy, so 8 x 6 numbers a
    partition come to the driver. Missing constructs are 0.5. The fit ends after ``patience`` steps
    without a better loss and returns the best state.
    """
    n_x, n_p = len(names), len(patterns)
    x = [F.coalesce(F.col(n).cast("double"), F.lit(0.5)) for n in names]
    place = F.array_position(F.array(*map(F.lit, patterns)), F.col(pattern)) - 1
    w_col = (F.col(weight) if weight else F.lit(1.0)).cast("double")
    rows = df.filter(F.col(y).isNotNull() & (place >= 0)).select(place.cast("int").alias("p"), F.col(y).cast("double").alias("y"), logit(F.col(anchor)).alias("a"), w_col.alias("w"), *[c.alias(n) for n, c in zip(names, x)])
    rows = _pinned(rows)
    stat = {r["p"]: r for r in rows.groupBy("p").agg(F.sum("w").alias("w"), *[F.avg(n).alias(n) for n in names]).collect()}
    means = np.array([[stat[k][n] if k in stat else 0.5 for n in names] for k in range(n_p)])
    total = sum(r["w"] for r in stat.values()) or 1.0
    model = Reward(list(patterns), np.zeros(n_x), np.zeros((n_p, n_x)), means, [])
    best, stale, mom, var = None, 0, None, None
    for step in range(1, steps + 1):
        eff = model.weights

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
            acc = np.zeros((n_p, n_x + 1))
            for b in batches:
                k = b["p"].to_numpy()
                c = b[list(names)].to_numpy() - means[k]
                z = b["a"].to_numpy() + (eff[k] * c).sum(1)
                loss = b["w"].to_numpy() * (np.maximum(z, 0) - z * b["y"].to_numpy() + np.log1p(np.exp(-np.abs(z))))
                d = b["w"].to_numpy() * (1 / (1 + np.exp(-z)) - b["y"].to_numpy())
                np.add.at(acc, k, np.column_stack([loss, d[:, None] * c]))
            yield acc.ravel()

        got = _summed(rows, run).reshape(n_p, n_x + 1)
        d = got[:, 1:] / total
        soft, mult, t = np.log1p(np.exp(model.g)), np.exp(0.45 * np.tanh(model.m)), np.tanh(model.m)
        value = got[:, 0].sum() / total + ridge_pattern * np.mean(model.m**2) + ridge_global * np.mean(model.g**2)
        model.losses.append(float(value))
        if best is None or value < best[0] - 1e-6:
            best, stale = (value, model.g.copy(), model.m.copy()), 0
        else:
            stale += 1
            if stale >= patience:
                break
        grad = [(d * mult).sum(0) / (1 + np.exp(-model.g)) + 2 * ridge_global * model.g / model.g.size, d * soft * mult * 0.45 * (1 - t**2) + 2 * ridge_pattern * model.m / model.m.size]
        mom = [0.1 * g if mom is None else 0.9 * v + 0.1 * g for g, v in zip(grad, mom or grad)]
        var = [0.001 * g * g if var is None else 0.999 * v + 0.001 * g * g for g, v in zip(grad, var or grad)]
        for p, v, s in zip((model.g, model.m), mom, var):
            p -= rate * (v / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    rows.unpersist()
    model.g, model.m = best[1], best[2]
    return model


def reward_prior(df: DataFrame, model: Reward, anchor: str) -> DataFrame:
    """Add reward_prior_probability (percent) and one contribution per construct."""
    c = dict(zip(CONSTRUCTS, model.contributions()))
    out = df.withColumns({f"contribution_{n}": v for n, v in c.items()})
    z = logit(F.col(anchor)) + sum((F.col(f"contribution_{n}") for n in c), F.lit(0.0))
    return out.withColumn("reward_prior_probability", 100 * sigmoid(z))


def accept_revision(df: DataFrame, y: str, anchor: str, directions: dict[str, int], step: float = 0.15, least_gain: float = 2e-4) -> DataFrame:
    """Per pattern: log loss before and after multiplying contributions by exp(step * direction)."""
    now, new = logit(F.col(anchor)), logit(F.col(anchor))
    for n in CONSTRUCTS:
        c = F.col(f"contribution_{n}")
        now, new = now + c, new + c * float(np.exp(step * directions.get(n, 0)))
    nll = lambda z: F.avg(F.greatest(z, F.lit(0.0)) - z * F.col(y) + F.log1p(F.exp(-F.abs(z))))
    a = df.groupBy("hbm8_pattern").agg(nll(now).alias("loss_before"), nll(new).alias("loss_after"))
    return a.withColumn("accepted", F.col("loss_before") - F.col("loss_after") >= least_gain)


@dataclass(frozen=True)
class Latent:
    """Globals of the latent choice model: prior map (labels x inputs), intercepts and loadings."""

    prior_map: np.ndarray
    bias: np.ndarray
    beta: np.ndarray
    loadings: np.ndarray
    sign: np.ndarray


def latent_map(df: DataFrame, key: str, x: Sequence[str], actions: Sequence[str], weights: Sequence[str], model: Latent, steps: int = 80, rate: float = 0.05, ridge: float = 0.5) -> DataFrame:
    """Posterior mode of every row's latent vector theta = 2 tanh(W x + b + u); rows are independent.

    logits = beta + (theta * sign) . softplus(loadings)'. All rows of an Arrow batch take the same
    Adam steps in numpy; the step of a row depends on its own data only.
    """
    names = [f"theta_{n}" for n in x]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        load = np.log1p(np.exp(model.loadings))
        for b in batches:
            xs, a, w = (np.nan_to_num(b[list(c)].to_numpy(np.float64)) for c in (x, actions, weights))
            base, u = xs @ model.prior_map.T + model.bias, np.zeros((len(b), model.prior_map.shape[0]))
            m, v = np.zeros_like(u), np.zeros_like(u)
            for t in range(1, steps + 1):
                th = np.tanh(base + u)
                z = model.beta + (2 * th * model.sign) @ load.T
                g = ((w * (1 / (1 + np.exp(-z)) - a)) @ load) * model.sign * 2 * (1 - th**2) + ridge * u
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                u -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            out = pd.DataFrame(2 * np.tanh(base + u), columns=names)
            out.insert(0, key, b[key].to_numpy())
            yield out

    schema = f"{key} long, " + ", ".join(f"{n} double" for n in names)
    return df.select(key, *x, *actions, *weights).mapInPandas(run, schema)


def person_residuals(base: np.ndarray, u: np.ndarray, a: np.ndarray, w: np.ndarray, beta: np.ndarray, load: np.ndarray, sign: np.ndarray, c: float, most: int = 50, near: float = 1e-5) -> np.ndarray:
    """Residuals that minimise sum(w * log loss) + c * |u|^2 of every row, by damped Newton steps from u.

    A row whose step is below ``near`` is done; ``most`` steps are a guard.
    """
    def state(base, u, a, w):
        th = np.tanh(base + u)
        z = beta + (2 * th * sign) @ load.T
        return th, z, (w * (np.maximum(z, 0) - z * a + np.log1p(np.exp(-np.abs(z))))).sum(1) + c * (u * u).sum(1)

    u, at, damp = u.copy(), np.arange(len(u)), np.zeros(len(u))
    for _ in range(most):
        if not len(at):
            break
        b_, u_, a_, w_ = base[at], u[at], a[at], w[at]
        th, z, value = state(b_, u_, a_, w_)
        p = 1 / (1 + np.exp(-z))
        slope = 2 * (1 - th**2) * sign
        pull = ((w_ * (p - a_)) @ load) * slope
        g = pull + 2 * c * u_
        inner = (w_ * p * (1 - p)) @ (load[:, :, None] * load[:, None, :]).reshape(len(load), -1)
        h = inner.reshape(len(at), u.shape[1], -1) * slope[:, :, None] * slope[:, None, :]
        h[:, np.arange(u.shape[1]), np.arange(u.shape[1])] += 2 * c + damp[at, None] - 2 * th * pull
        step = np.linalg.solve(h, g[:, :, None])[:, :, 0]
        better = state(b_, u_ - step, a_, w_)[2] <= value + 1e-12
        u[at[better]] -= step[better]
        damp[at] = np.where(better, damp[at] / 4, np.maximum(4 * damp[at], c))
        at = at[~better | (np.abs(step).max(1) > near)]
    return u


def fit_latent(df: DataFrame, x: Sequence[str], actions: Sequence[str], weights: Sequence[str], sign: Sequence[float], anchors: Sequence[Sequence[float]] | None = None,
               steps: int = 300, rate: float = 0.02, patience: int = 35, least_gain: float = 1e-5, person: float = 0.25, ridge: float = 0.002, anchor_ridge: float = 0.2, keep_every: int = 25) -> tuple[Latent, list[float]]:
    """Globals of the hierarchical model by Adam, with a residual a person.

    Loss: weighted mean log loss + ``person`` * mean square of the residuals + ``ridge`` * (mean
    squares of prior map and of intercepts) + ``anchor_ridge`` * mean squared distance of the
    loadings from ``anchors``. Loadings start at the anchors, intercepts at logits of the
    prevalences, the prior map at the identity. The fit ends after ``patience`` steps that gain
    less than ``least_gain`` and returns the best state.

    Given the globals, residuals of different persons are independent. In every step each row's
    residual is solved for where the row is, so the loss and its gradient are those at the best
    residuals; a partition sends some dozen numbers. Every ``keep_every`` steps the residuals are
    stored with the rows as start of the next ones.
    """
    n, k = len(x), len(actions)
    anchor = np.log1p(np.ones((k, n))) if anchors is None else np.asarray(anchors, dtype=float)
    held = [f"__u{i}" for i in range(n)]
    rows = _pinned(df.select(*x, *actions, *weights, *[F.lit(0.0).alias(u) for u in held]))
    sums = rows.agg(F.count("*").alias("n"), *[F.sum(F.coalesce(w, F.lit(0.0))).alias(f"w{i}") for i, w in enumerate(weights)], *[F.sum(F.coalesce(F.col(w) * F.col(a), F.lit(0.0))).alias(f"a{i}") for i, (a, w) in enumerate(zip(actions, weights))]).first()
    mass = np.array([sums[f"w{i}"] or 0.0 for i in range(k)])
    prevalence = np.array([np.clip(sums[f"a{i}"] / m, 0.02, 0.98) if m > 0 else 0.5 for i, m in enumerate(mass)])
    people, total, sg = max(sums["n"], 1), max(mass.sum(), 1.0), np.array(sign, dtype=float)
    c = person * total / (people * n)  # of a person's squares, when its log loss is summed
    p = {"prior_map": np.eye(n), "bias": np.zeros(n), "beta": np.log(prevalence / (1 - prevalence)), "loadings": np.log(np.expm1(np.maximum(anchor, 1e-4)))}
    mom, var, losses, best, stale = None, None, [], None, 0
    for t in range(1, steps + 1):
        cur = {a: b.copy() for a, b in p.items()}

        def solved(b: pd.DataFrame):
            load = np.log1p(np.exp(cur["loadings"]))
            xs, a, w, u = (np.nan_to_num(b[list(names)].to_numpy(np.float64)) for names in (x, actions, weights, held))
            base = xs @ cur["prior_map"].T + cur["bias"]
            return xs, a, w, base, load, person_residuals(base, u, a, w, cur["beta"], load, sg, c)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
            acc = np.zeros(2 + n * n + n + k + k * n)
            for b in batches:
                xs, a, w, base, load, u = solved(b)
                th = np.tanh(base + u)
                z = cur["beta"] + (2 * th * sg) @ load.T
                dz = w * (1 / (1 + np.exp(-z)) - a)
                dth = (dz @ load) * sg * 2 * (1 - th**2)
                loss = (w * (np.maximum(z, 0) - z * a + np.log1p(np.exp(-np.abs(z))))).sum()
                acc += np.concatenate([[loss, (u * u).sum()], (dth.T @ xs).ravel(), dth.sum(0), dz.sum(0), ((dz.T @ (2 * th * sg)) / (1 + np.exp(-cur["loadings"]))).ravel()])
            yield acc

        def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                b[held] = solved(b)[-1]
                yield b

        if t > 1 and t % keep_every == 1 or t == 5:
            old, rows = rows, _pinned(rows.mapInPandas(keep, rows.schema))
            old.unpersist()
        got = _summed(rows, run)
        load = np.log1p(np.exp(cur["loadings"]))
        size = n * n + n
        value = got[0] / total + person * got[1] / (people * n) + ridge * (((cur["prior_map"] ** 2).sum() + (cur["bias"] ** 2).sum()) / size + (cur["beta"] ** 2).mean()) + anchor_ridge * ((load - anchor) ** 2).mean()
        losses.append(float(value))
        if best is None or value + least_gain < best[0]:
            best, stale = (value, cur), 0
        else:
            stale += 1
            if stale >= patience:
                break
        parts = np.split(got[2:] / total, np.cumsum([n * n, n, k]))
        grad = {a: g.reshape(p[a].shape) for a, g in zip(("prior_map", "bias", "beta", "loadings"), parts)}
        grad["prior_map"] = grad["prior_map"] + 2 * ridge * cur["prior_map"] / size
        grad["bias"] = grad["bias"] + 2 * ridge * cur["bias"] / size
        grad["beta"] = grad["beta"] + 2 * ridge * cur["beta"] / k
        grad["loadings"] = grad["loadings"] + 2 * anchor_ridge * (load - anchor) / (k * n) / (1 + np.exp(-cur["loadings"]))
        norm = np.sqrt(sum((g**2).sum() for g in grad.values()))
        grad = {a: g * min(1.0, 5.0 / max(norm, 1e-12)) for a, g in grad.items()}
        mom = {a: 0.1 * g if mom is None else 0.9 * mom[a] + 0.1 * g for a, g in grad.items()}
        var = {a: 0.001 * g * g if var is None else 0.999 * var[a] + 0.001 * g * g for a, g in grad.items()}
        for a in p:
            p[a] = p[a] - rate * (mom[a] / (1 - 0.9**t)) / (np.sqrt(var[a] / (1 - 0.999**t)) + 1e-8)
    rows.unpersist()
    return Latent(sign=sg, **best[1]), losses


def classifier(name: str, seed: int = 42):
    """A Spark ML classifier of the model zoo; ``linear_svc`` and ``gbt`` stand beside, not for,
    kernel and boosted models that Spark lacks."""
    from pyspark.ml import classification as C

    if name == "logistic":
        return C.LogisticRegression(maxIter=100)
    if name == "random_forest":
        return C.RandomForestClassifier(numTrees=100, maxDepth=10, seed=seed)
    if name == "gbt":
        return C.GBTClassifier(maxIter=40, maxDepth=5, seed=seed)
    if name == "mlp":
        return lambda n: C.MultilayerPerceptronClassifier(layers=[n, 64, 32, 2], maxIter=100, seed=seed)
    if name == "linear_svc":
        return C.LinearSVC(maxIter=100)
    raise ValueError(f"unknown model {name}")


def run_classifier(train: DataFrame, test: DataFrame, name: str, features: str = "x", y: str = "y", key: str = "id", seed: int = 42) -> DataFrame:
    """id, y, p (percent) of the test rows."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    prep = lambda d: d.filter(F.col(y).isNotNull()).select(key, F.col(y).cast("double").alias("label"), array_to_vector(features).alias("features"))
    data = prep(train)
    est = classifier(name, seed)
    if name == "mlp":
        est = est(len(data.first()["features"]))
    out = est.fit(data).transform(prep(test))
    p = vector_to_array("probability")[1] * 100 if "probability" in out.columns else 100 / (1 + F.exp(-vector_to_array("rawPrediction")[1]))
    return out.select(key, F.col("label").cast("int").alias(y), p.alias("p"))
