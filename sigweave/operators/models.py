"""Scalers, classifiers and decompositions: MLlib where it fits, else distributed sums and a small solve.

MLlib differs from the usual Python estimators in places: its linear SVM has hinge loss (so the one
here is not MLlib's), its forest no minimal split size, its scaler the sample deviation (not used here).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions import kernels

#: Features beyond which a p x p solve on the driver is refused (8 p^2 bytes: 200 MB).
MOST_FEATURES = 5_000


def scaler(train: DataFrame, column: str = "features") -> tuple[list[float], list[float]]:
    """Mean and population deviation of each feature of the training rows; a zero deviation counts as 1."""
    flat = train.select(F.posexplode(column).alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    rows = {r["i"]: (r["m"], r["s"]) for r in flat.collect()}  # one row a feature
    return [rows[i][0] for i in range(len(rows))], [rows[i][1] or 1.0 for i in range(len(rows))]


def scaled(rows: DataFrame, mean: list[float], std: list[float], column: str = "features") -> DataFrame:
    centred = F.zip_with(column, F.lit(mean), lambda x, m: x - m)
    return rows.withColumn(column, F.zip_with(centred, F.lit(std), lambda x, s: x / s))


def balanced_weights(rows: DataFrame) -> DataFrame:
    """``rows`` plus ``weight`` = n / (classes * n of the class)."""
    counts = rows.groupBy("label").agg(F.count("*").alias("k"))
    of = counts.agg(F.sum("k").alias("n"), F.count("*").alias("c")).first()
    return rows.join(F.broadcast(counts), "label").withColumn("weight", F.lit(float(of["n"] or 0)) / (F.lit(float(of["c"] or 1)) * F.col("k"))).drop("k")


def logistic(train: DataFrame, c: float = 1.0, max_iter: int = 500) -> Model:
    """L2 logistic regression with balanced classes, of scaled rows (features array, label)."""
    rows = balanced_weights(train).withColumn("vector", array_to_vector("features"))
    total = rows.agg(F.sum("weight")).first()[0]
    return LogisticRegression(featuresCol="vector", labelCol="label", weightCol="weight", regParam=1.0 / (c * total), elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=1e-5).fit(rows)


def logistic_weights(train: DataFrame, c: float = 1.0, max_iter: int = 500) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Labels, weights [label, feature] and offsets of ``logistic``. Labels need not be 0, 1, ..."""
    labels = [r[0] for r in train.select("label").distinct().orderBy("label").collect()]  # one row a class
    if len(labels) < 2:
        raise ValueError("a classifier takes two classes at least")
    numbered = train.withColumn("label", (F.array_position(F.lit(labels), F.col("label")) - 1).cast("int"))
    fitted = logistic(numbered, c, max_iter)
    weights, offsets = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
    if len(labels) == 2 and len(weights) == 1:  # MLlib keeps the second class's alone
        weights, offsets = np.vstack([0 * weights, weights]), np.append(0.0, offsets)
    return labels, weights, offsets


#: Features up to which steps are Newton's (a matrix of 8 p^2 bytes a class in each task: 2 MB), and the steps that
#: limited-memory BFGS remembers beyond that.
NEWTON, MEMORY = 512, 10


def squared_hinge(train: DataFrame, c: float = 1.0, max_iter: int = 1000, tol: float = 1e-5) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Labels, weights [label, feature] and offsets of linear support vector machines, one class against the rest.

    Minimises |w|^2 / 2 + c * sum of weight * max(0, 1 - y (w x + b))^2 with balanced class weights and the
    offset penalised as a weight, by Newton's steps, or limited-memory BFGS beyond ``NEWTON`` features: each step is
    one pass that adds up, over all tasks, the losses, gradients and curvatures of all classes at once. It ends when each
    gradient's norm is below ``tol`` times the first."""
    labels = [r[0] for r in train.select("label").distinct().orderBy("label").collect()]
    if len(labels) < 2:
        raise ValueError("a classifier takes two classes at least")
    targets = labels[1:] if len(labels) == 2 else labels
    counts = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    each = np.array([sum(counts.values()) / (len(labels) * counts[k]) for k in labels])
    rows = train.select(F.col("label").cast("int").alias("label"), F.col("features").cast("array<double>").alias("features")).cache()
    p = rows.select(F.size("features")).first()[0]

    second = p <= NEWTON

    def passed(w: np.ndarray) -> tuple[np.ndarray, ...]:
        """Loss, gradient and (for Newton's steps) curvature of each class at ``w`` [class, feature + 1]."""
        shapes = (w.shape[:1], w.shape, (*w.shape, w.shape[1] if second else 0))

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loss, grad, curve = map(np.zeros, shapes)
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = np.column_stack([batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1), np.ones(batch.num_rows)])
                own = batch.column(0).to_numpy()
                y = np.where(own[:, None] == np.array(targets), 1.0, -1.0)
                s = each[np.searchsorted(labels, own)][:, None]
                gap = np.maximum(0.0, 1 - y * (x @ w.T))
                loss += (s * gap**2).sum(axis=0)
                grad += (-2 * s * y * gap).T @ x
                if second:
                    for k in range(len(w)):
                        on = gap[:, k] > 0
                        curve[k] += 2 * (x[on].T * s[on, 0]) @ x[on]
            held = [pa.array([v.tobytes()], pa.binary()) for v in (loss, grad, curve)]
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), *held], names=["label", "loss", "grad", "curve"])

        sums = [np.zeros(shape) for shape in shapes]
        for r in _merged(rows.mapInArrow(part, "label int, loss binary, grad binary, curve binary")).toLocalIterator():
            sums = [a + np.frombuffer(r[c]).reshape(a.shape) for a, c in zip(sums, ("loss", "grad", "curve"))]
        loss, grad, curve = sums
        return (w**2).sum(axis=1) / 2 + c * loss, w + c * grad, c * curve

    w = np.zeros((len(targets), p + 1))
    loss, grad, curve = passed(w)
    first = np.linalg.norm(grad, axis=1)
    kept: list[tuple[np.ndarray, np.ndarray]] = []  # steps and gradient changes, of all classes
    for _ in range(max_iter):
        if (np.linalg.norm(grad, axis=1) <= tol * np.maximum(first, 1e-12)).all():
            break
        size = np.ones(len(w))
        if second:
            step = -np.linalg.solve(curve + np.eye(p + 1), grad[..., None])[..., 0]
        else:
            step = -_inverse_product(kept, grad)
            size /= 1.0 if kept else np.maximum(first, 1.0)
        slope = (grad * step).sum(axis=1)
        for _ in range(40):  # each class halves its own step until it descends enough
            new = w + size[:, None] * step
            new_loss, new_grad, new_curve = passed(new)
            short = new_loss > loss + 1e-4 * size * slope + 1e-12 * np.abs(loss)
            if not short.any():
                break
            size = np.where(short, size / 2, size)
        kept = [*kept[1 - MEMORY :], (new - w, new_grad - grad)] if len(kept) >= MEMORY else [*kept, (new - w, new_grad - grad)]
        w, loss, grad, curve = new, new_loss, new_grad, new_curve
    rows.unpersist()
    if len(labels) == 2:
        w = np.vstack([-w, w])
    return labels, w[:, :-1], w[:, -1]


def _inverse_product(kept: list[tuple[np.ndarray, np.ndarray]], grad: np.ndarray) -> np.ndarray:
    """The two-loop product of limited-memory BFGS, class by class."""
    out, held = grad.copy(), []
    for s, y in reversed(kept):
        sy = (s * y).sum(axis=1)
        rho = np.where(sy > 1e-300, 1 / np.where(sy > 1e-300, sy, 1), 0.0)
        a = rho * (s * out).sum(axis=1)
        out -= a[:, None] * y
        held.append((s, y, rho, a))
    if kept:
        s, y = kept[-1]
        yy = (y * y).sum(axis=1)
        out *= np.where(yy > 1e-300, (s * y).sum(axis=1) / np.where(yy > 1e-300, yy, 1), 1.0)[:, None]
    for s, y, rho, a in reversed(held):
        out += (a - rho * (y * out).sum(axis=1))[:, None] * s
    return out


def predict(model: Model, rows: DataFrame) -> DataFrame:
    """``rows`` plus an int ``prediction``."""
    out = model.transform(rows.withColumn("vector", array_to_vector("features")))
    return out.select(*rows.columns, F.col("prediction").cast("int").alias("prediction"))


def forest_grid(train: DataFrame, trees=(50, 100), depths=(5, 10), leaves=(1, 2), folds: int = 3, parallelism: int = 4, seed: int = 42) -> Model:
    """The best random forest of a grid by cross-validated accuracy."""
    rows = train.withColumn("vector", array_to_vector("features"))
    forest = RandomForestClassifier(featuresCol="vector", labelCol="label", seed=seed)
    grid = ParamGridBuilder().addGrid(forest.numTrees, list(trees)).addGrid(forest.maxDepth, list(depths)).addGrid(forest.minInstancesPerNode, list(leaves)).build()
    score = MulticlassClassificationEvaluator(labelCol="label", metricName="accuracy")
    return CrossValidator(estimator=forest, estimatorParamMaps=grid, evaluator=score, numFolds=folds, parallelism=parallelism, seed=seed).fit(rows)


def forest(train: DataFrame, trees: int = 100, depth: int = 10, leaf: int = 1, seed: int = 42) -> Model:
    return RandomForestClassifier(featuresCol="vector", labelCol="label", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, seed=seed).fit(train.withColumn("vector", array_to_vector("features")))


def _merged(parts: DataFrame) -> DataFrame:
    """Sums of numbers and float64 arrays (as binary) by ``label``, in a second step of as many tasks as there are cores."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for label, *values in zip(*(c.to_pylist() for c in batch.columns)):
                values = [np.frombuffer(v) if isinstance(v, bytes) else v for v in values]
                held[label] = [a + b for a, b in zip(held[label], values)] if label in held else values
            schema = batch.schema
        if held:
            columns = zip(*[(k, *[v.tobytes() if isinstance(v, np.ndarray) else v for v in vs]) for k, vs in held.items()])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return parts.repartition(parts.sparkSession.sparkContext.defaultParallelism).mapInArrow(add, parts.schema)


def _sums(rows: DataFrame, centre: dict[int, np.ndarray] | None, scale: dict[int, np.ndarray] | None) -> dict[int, tuple[int, np.ndarray, np.ndarray, float]]:
    """Per label: n, sum x, sum x x^T and sum |x|^4 of (centred, scaled) features, added in two steps."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            label = batch.column(0).to_numpy()
            x = np.stack(batch.column(1).to_numpy(zero_copy_only=False)) if batch.num_rows else np.zeros((0, 1))
            for k in np.unique(label):
                own = x[label == k].astype(float)
                if centre is not None:
                    own = (own - centre[int(k)]) / scale[int(k)]
                add = [len(own), own.sum(axis=0), own.T @ own, float(((own**2).sum(axis=1) ** 2).sum())]
                held[int(k)] = [a + b for a, b in zip(held[int(k)], add)] if int(k) in held else add
        rows_ = [(k, v[0], v[1].tobytes(), v[2].tobytes(), v[3]) for k, v in held.items()]
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows_) if rows_ else [()] * 5, kinds)], names=["label", "n", "s", "ss", "q"])

    out: dict[int, tuple[int, np.ndarray, np.ndarray, float]] = {}
    parts = rows.select(F.col("label").cast("int").alias("label"), F.col("features").cast("array<double>").alias("features")).mapInArrow(part, "label int, n long, s binary, ss binary, q double")
    for r in _merged(parts).toLocalIterator():
        s = np.frombuffer(r["s"])
        add = (r["n"], s, np.frombuffer(r["ss"]).reshape(len(s), len(s)), r["q"])
        out[r["label"]] = tuple(a + b for a, b in zip(out[r["label"]], add)) if r["label"] in out else add
    return out


def class_scores(weights: np.ndarray, offsets: np.ndarray, x: Column | str = "features") -> Column:
    """Array of class scores, as dot products."""
    dot = [F.aggregate(F.zip_with(x, F.lit(w.tolist()), lambda a, b: a * b), F.lit(float(b)), lambda s, v: s + v) for w, b in zip(np.atleast_2d(weights), offsets)]
    return F.array(*dot)


def best_label(rows: DataFrame, labels: list[int], scores: Column) -> DataFrame:
    """``rows`` plus ``prediction``: the label of the highest score, the first of equal ones."""
    held = rows.withColumn("_s", scores)
    return held.withColumn("prediction", F.element_at(F.lit(labels), F.array_position("_s", F.array_max("_s")).cast("int")).cast("int")).drop("_s")


class LDA:
    """Linear discriminant analysis by least squares, with Ledoit-Wolf shrinkage inside each class."""

    def __init__(self, train: DataFrame):
        p = train.select(F.size("features")).first()[0]
        if p > MOST_FEATURES:
            raise ValueError(f"{p} features: a {p} x {p} solve is refused")
        first = _sums(train, None, None)
        self.labels = sorted(first)
        n = np.array([first[k][0] for k in self.labels], float)
        means = np.stack([first[k][1] / first[k][0] for k in self.labels])
        spread = {k: np.sqrt(np.maximum(np.diag(first[k][2]) / first[k][0] - m**2, 0)) for k, m in zip(self.labels, means)}
        scale = {k: np.where(v > 0, v, 1.0) for k, v in spread.items()}
        second = _sums(train, dict(zip(self.labels, means)), scale)
        priors = n / n.sum()
        cov = sum(w * kernels.ledoit_wolf(second[k][0], second[k][2], second[k][3]) * np.outer(scale[k], scale[k]) for k, w in zip(self.labels, priors))
        self.coef, self.offset = kernels.lda_from_sums(priors, means, cov)

    def predict(self, rows: DataFrame) -> DataFrame:
        return best_label(rows, self.labels, class_scores(self.coef, self.offset))


class CSP:
    """Common spatial patterns of two classes over array epochs: log mean power of ``n`` components. No band-pass inside."""

    def __init__(self, epochs: DataFrame, n: int = 4):
        """``epochs``: one row per epoch with label and x, an array of channels' arrays."""
        self.channels = epochs.select(F.size("x")).first()[0]

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list] = {}
            for batch in batches:
                for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    m = np.asarray(x, float)
                    m = m - m.mean(axis=1, keepdims=True)
                    add = [m @ m.T, m.shape[1], float(((m**2).sum(axis=0) ** 2).sum())]
                    held[k] = [a + b for a, b in zip(held[k], add)] if k in held else add
            rows = [(k, v[0].tobytes(), v[1], v[2]) for k, v in held.items()]
            kinds = (pa.int32(), pa.binary(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, kinds)], names=["label", "ss", "n", "q"])

        sums: dict[int, list] = {}
        parts = epochs.select(F.col("label").cast("int").alias("label"), "x").mapInArrow(part, "label int, ss binary, n long, q double")
        for r in _merged(parts).toLocalIterator():
            add = [np.frombuffer(r["ss"]).reshape(self.channels, self.channels), r["n"], r["q"]]
            sums[r["label"]] = [a + b for a, b in zip(sums[r["label"]], add)] if r["label"] in sums else add
        if len(sums) != 2:
            raise ValueError("common spatial patterns take two classes")
        c1, c2 = (kernels.ledoit_wolf(v[1], v[0], v[2]) for _, v in sorted(sums.items()))
        self.filters = kernels.csp_filters(c1, c2, n)

    @classmethod
    def of(cls, filters: np.ndarray) -> CSP:
        out = cls.__new__(cls)
        out.filters, out.channels = filters, filters.shape[1]
        return out

    def transform(self, epochs: DataFrame) -> DataFrame:
        """``epochs`` with ``features`` in place of x."""
        filters = self.filters

        @pandas_udf("array<double>")
        def power(x):
            import pandas as pd

            out = np.zeros((len(x), len(filters)))
            sizes = np.array([len(m[0]) for m in x])
            for n in np.unique(sizes):  # epochs of one length at once
                at = np.flatnonzero(sizes == n)
                held = np.stack([np.stack(m) for m in x.iloc[at]]).astype(float)
                out[at] = np.log((np.einsum("fc,ect->eft", filters, held) ** 2).mean(axis=2) + 1e-300)
            return pd.Series(list(out))

        return epochs.withColumn("features", power("x")).drop("x")


class ICA:
    """Independent components of wide samples by infomax; every step is one distributed sum over a seeded sample of rows."""

    def __init__(self, samples: DataFrame, channels: list[str], n: int = 10, steps: int = 60, rate: float = 0.1, seed: int = 42, fraction: float = 1.0):
        x = samples.select(*[F.col(c).cast("double").alias(c) for c in channels])
        x = (x if fraction >= 1 else x.sample(fraction, seed)).cache()
        moments = x.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(channels)], *[F.covar_pop(a, b).alias(f"c{i}_{j}") for i, a in enumerate(channels) for j, b in enumerate(channels)]).first()
        k = len(channels)
        self.mean = np.array([moments[f"m{i}"] for i in range(k)])
        cov = np.array([[moments[f"c{i}_{j}"] for j in range(k)] for i in range(k)])
        d, u = np.linalg.eigh(cov)
        top = np.argsort(-d)[: min(n, k)]
        self.white = (u[:, top] / np.sqrt(np.maximum(d[top], 1e-15))).T
        m, rows = len(top), moments["n"]
        w, bias = np.eye(m), np.zeros(m)
        mean, white = self.mean, self.white
        for _ in range(steps):

            def part(batches, w=w, bias=bias):
                g, b = np.zeros((m, m)), np.zeros(m)
                for batch in batches:
                    z = (np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1) - mean) @ white.T
                    dg, db = kernels.infomax_step(w, bias, z)
                    g, b = g + dg, b + db
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([g.tobytes()], pa.binary()), pa.array([b.tobytes()], pa.binary())], names=["label", "g", "b"])

            g, b = np.zeros((m, m)), np.zeros(m)
            for r in _merged(x.mapInArrow(part, "label int, g binary, b binary")).toLocalIterator():
                g, b = g + np.frombuffer(r["g"]).reshape(m, m), b + np.frombuffer(r["b"])
            w = w + rate * (np.eye(m) + g / rows) @ w
            bias = bias + rate * b / rows
        x.unpersist()
        self.unmixing = w @ self.white

    def sources(self, samples: DataFrame, channels: list[str]) -> DataFrame:
        """``samples`` plus s0, s1, ...: plain column arithmetic."""
        out = samples
        for i, row in enumerate(self.unmixing):
            value = sum((F.col(c) - float(mu)) * float(w) for c, mu, w in zip(channels, self.mean, row))
            out = out.withColumn(f"s{i}", value)
        return out


def channels_array(epochs: DataFrame) -> DataFrame:
    """One row per epoch with x, the array of its channels' arrays."""
    rows = F.array_sort(F.collect_list(F.struct("channel", "x")))
    return epochs.groupBy("epoch_id", "group_id", "label").agg(F.transform(rows, lambda r: r["x"]).alias("x"))


