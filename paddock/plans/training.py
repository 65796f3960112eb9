"""Rank and outcome models: trained by gradients that Spark aggregates, scored with column expressions.

A race is a group of rows; the loss is the mean Plackett-Luce negative log likelihood of its finishing order plus a weighted cross
entropy of the outcomes. Each step runs one Spark job: a partition holds whole races and gives one sum of their losses and
gradients (as many numbers as the model has), and the sum of these comes to the driver. No race and no table is collected.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import scoring

OUTCOMES = ("finish", "dnf", "dsq")


@dataclass
class RankModel:
    """A hidden layer (rectified) with a rank head (one score) and a status head (three logits)."""

    features: list[str]
    hidden: int = 16
    seed: int = 42
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self):
        if not self.weights:
            rng, n = np.random.default_rng(self.seed), len(self.features)
            self.weights = {"w": rng.normal(0, n**-0.5, (n, self.hidden)), "b": np.zeros(self.hidden), "rank": rng.normal(0, self.hidden**-0.5, self.hidden), "status": rng.normal(0, self.hidden**-0.5, (self.hidden, 3)), "bias": np.zeros(3)}

    def hidden_layer(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.weights["w"] + self.weights["b"], 0)

    def hidden_gradient(self, x: np.ndarray, d_h: np.ndarray) -> dict[str, np.ndarray]:
        """The gradient of the hidden layer's own weights, from that of its outputs."""
        d = d_h * (x @ self.weights["w"] + self.weights["b"] > 0)
        return {"w": x.T @ d, "b": d.sum(0)}

    def hidden_columns(self, inputs: list[Column]) -> list[Column]:
        return [F.greatest(_weighted(inputs, self.weights["w"][:, i], self.weights["b"][i]), F.lit(0.0)) for i in range(self.weights["b"].size)]

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = self.hidden_layer(x)
        return h, h @ self.weights["rank"], h @ self.weights["status"] + self.weights["bias"]


_GELU = (2 / np.pi) ** 0.5


@dataclass
class GatedModel(RankModel):
    """The same heads over a gated residual layer: normalised inputs are projected twice, one projection gates the other by a
    smooth step, and the result is projected again and added to a projection of the inputs."""

    def __post_init__(self):
        if not self.weights:
            rng, n, k = np.random.default_rng(self.seed), len(self.features), self.hidden
            self.weights = {"up": rng.normal(0, n**-0.5, (n, k)), "up_bias": np.zeros(k), "gate": rng.normal(0, n**-0.5, (n, k)), "gate_bias": np.zeros(k), "down": rng.normal(0, k**-0.5, (k, k)), "down_bias": np.zeros(k), "skip": rng.normal(0, n**-0.5, (n, k)),
                            "rank": rng.normal(0, k**-0.5, k), "status": rng.normal(0, k**-0.5, (k, 3)), "bias": np.zeros(3)}

    def _parts(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        n = (x - x.mean(1, keepdims=True)) / np.sqrt(x.var(1, keepdims=True) + 1e-5)
        a, b = (n @ self.weights[p] + self.weights[f"{p}_bias"] for p in ("up", "gate"))
        return n, a, b, np.tanh(_GELU * (b + 0.044715 * b**3))

    def hidden_layer(self, x: np.ndarray) -> np.ndarray:
        _, a, b, t = self._parts(x)
        return (a * 0.5 * b * (1 + t)) @ self.weights["down"] + self.weights["down_bias"] + x @ self.weights["skip"]

    def hidden_gradient(self, x: np.ndarray, d_h: np.ndarray) -> dict[str, np.ndarray]:
        n, a, b, t = self._parts(x)
        g, slope = 0.5 * b * (1 + t), 0.5 * (1 + t) + 0.5 * b * (1 - t**2) * _GELU * (1 + 3 * 0.044715 * b**2)
        d_u = d_h @ self.weights["down"].T
        d_a, d_b = d_u * g, d_u * a * slope
        return {"up": n.T @ d_a, "up_bias": d_a.sum(0), "gate": n.T @ d_b, "gate_bias": d_b.sum(0), "down": (a * g).T @ d_h, "down_bias": d_h.sum(0), "skip": x.T @ d_h}

    def hidden_columns(self, inputs: list[Column]) -> list[Column]:
        """Three steps, each an array of which the next one takes single values, so that none is worked out twice."""
        w, size = self.weights, len(inputs)
        mean = sum(inputs[1:], inputs[0]) / size
        var = sum([(c - mean) * (c - mean) for c in inputs[1:]], (inputs[0] - mean) * (inputs[0] - mean)) / size
        step = lambda value, made: F.transform(F.array(value), made)[0]
        normal = F.array(*[(c - mean) / F.sqrt(var + 1e-5) for c in inputs])

        def gated(n: Column) -> Column:
            at = [n[j] for j in range(size)]
            a, b = ([_weighted(at, w[p][:, i], w[f"{p}_bias"][i]) for i in range(self.hidden)] for p in ("up", "gate"))
            return F.array(*[x * 0.5 * y * (1 + F.tanh(_GELU * (y + 0.044715 * y * y * y))) for x, y in zip(a, b)])

        u = step(normal, gated)
        return [_weighted([u[j] for j in range(self.hidden)], w["down"][:, i], w["down_bias"][i]) + _weighted(inputs, w["skip"][:, i]) for i in range(self.hidden)]


@dataclass
class DeepModel(RankModel):
    """The same heads over several rectified layers (``layers``, their sizes), of which training leaves out a share ``dropout`` of the
    outputs, another one for each race and epoch."""

    layers: tuple[int, ...] = (256, 128)
    dropout: float = 0.1
    epoch: int = 0

    def __post_init__(self):
        self.layers, self.hidden = tuple(self.layers), self.layers[-1]
        if not self.weights:
            rng, sizes = np.random.default_rng(self.seed), [len(self.features), *self.layers]
            self.weights = {"rank": rng.normal(0, self.hidden**-0.5, self.hidden), "status": rng.normal(0, self.hidden**-0.5, (self.hidden, 3)), "bias": np.zeros(3)}
            for i, (n, k) in enumerate(zip(sizes, self.layers)):
                self.weights |= {f"w{i}": rng.normal(0, (2 / n) ** 0.5, (n, k)), f"b{i}": np.zeros(k)}

    def _masks(self, x: np.ndarray) -> list[np.ndarray | float]:
        """What the layers' outputs are multiplied by: the same for the same race and epoch, nothing outside training (epoch 0)."""
        if not self.epoch or not self.dropout:
            return [1.0] * len(self.layers)
        rng = np.random.default_rng([self.seed, self.epoch, zlib.crc32(np.ascontiguousarray(x).tobytes())])
        return [(rng.random((len(x), k)) >= self.dropout) / (1 - self.dropout) for k in self.layers]

    def _outputs(self, x: np.ndarray) -> list[np.ndarray]:
        out = [x]
        for i, mask in enumerate(self._masks(x)):
            out.append(np.maximum(out[-1] @ self.weights[f"w{i}"] + self.weights[f"b{i}"], 0) * mask)
        return out

    def hidden_layer(self, x: np.ndarray) -> np.ndarray:
        return self._outputs(x)[-1]

    def hidden_gradient(self, x: np.ndarray, d_h: np.ndarray) -> dict[str, np.ndarray]:
        outputs, masks, grads = self._outputs(x), self._masks(x), {}
        for i in reversed(range(len(self.layers))):
            # an output that is zero was cut off or left out
            d = d_h * masks[i] * (outputs[i + 1] > 0)
            grads |= {f"w{i}": outputs[i].T @ d, f"b{i}": d.sum(0)}
            d_h = d @ self.weights[f"w{i}"].T
        return grads

    def hidden_columns(self, inputs: list[Column]) -> list[Column]:
        """Each layer is one array of sums of products, so that no value is worked out twice."""
        value = F.array(*inputs)
        for i in range(len(self.layers)):
            value = self._layer(value, i)
        return [value[j] for j in range(self.hidden)]

    def _layer(self, value: Column, i: int) -> Column:
        rows = F.array(*[F.array(*[F.lit(float(v)) for v in [*self.weights[f"w{i}"][:, j], self.weights[f"b{i}"][j]]]) for j in range(self.layers[i])])
        bound = F.transform(F.array(value), lambda x: F.transform(rows, lambda w: F.greatest(F.lit(0.0), F.aggregate(F.zip_with(F.concat(x, F.array(F.lit(1.0))), w, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b))))
        return bound[0]


def race_gradient(model: RankModel, x: np.ndarray, position: np.ndarray, outcome: np.ndarray, weight: float, class_weights: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Loss and gradient of one race. position: NaN for who did not finish; outcome: 0, 1, 2."""
    w = model.weights
    h, score, logits = model.forward(x)
    d_score, loss = np.zeros(len(x)), 0.0
    order = np.argsort(np.where(np.isnan(position), np.inf, position), kind="stable")
    ranked = order[: int((~np.isnan(position)).sum())]
    if len(ranked) > 1:
        s = score[ranked]
        e = np.exp(s - s.max())
        tail = np.cumsum(e[::-1])[::-1]
        loss += float(np.mean(np.log(tail) + s.max() - s))
        # each place k adds softmax over the places from k on, less one at k
        d_score[ranked] = (e * np.cumsum(1 / tail) - 1) / len(ranked)
    p = np.exp(logits - logits.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    cw = class_weights[outcome] / len(x)
    loss += float(-(cw * np.log(np.maximum(p[np.arange(len(x)), outcome], 1e-12))).sum())
    d_logits = cw[:, None] * (p - np.eye(3)[outcome])
    d_h = np.outer(d_score, w["rank"]) + d_logits @ w["status"].T
    grads = model.hidden_gradient(x, d_h) | {"rank": h.T @ d_score, "status": h.T @ d_logits, "bias": d_logits.sum(0)}
    return weight * loss, {k: weight * g for k, g in grads.items()}


@dataclass
class Fit:
    """A trained model, the loss of each epoch, and, with validation rows, the metrics of each epoch and which one was kept."""

    model: RankModel
    losses: list[float]
    metrics: list[dict[str, float]] = field(default_factory=list)
    best: int | None = None


def evaluate(rows: DataFrame, model: RankModel, key: list[str], entity: str, position: str = "finish_position", outcome: str = "outcome_id") -> dict[str, float]:
    """Means over races of spearman, mae, top1 and ndcg, and accuracy and macro_f1 of the outcomes; None where nothing is known."""
    scored = score(rows, model, key).cache()
    ranks = scoring.rank_metrics(scored, key, "score", position, entity).agg(*[F.avg(c).alias(c) for c in ("spearman", "mae", "top1", "ndcg")]).first().asDict()
    guess = F.coalesce(*[F.when(F.col("predicted_outcome") == o, F.lit(i)) for i, o in enumerate(OUTCOMES)])
    classes = scoring.class_metrics(scored.withColumn("_g", guess), outcome, "_g").agg(F.avg("f1").alias("macro_f1"), F.max("accuracy").alias("accuracy")).first().asDict()
    scored.unpersist()
    return ranks | classes


def fit(rows: DataFrame, features: list[str], key: list[str], validation: DataFrame, entity: str, patience: int | None = None, **options) -> Fit:
    """Trains on rows and keeps the weights of the epoch whose sum of spearman and macro_f1 on the validation rows is greatest, the
    first of equals. With ``patience``, so many epochs without a better one end the training."""
    best: list = [None, -np.inf, None]
    metrics: list[dict[str, float]] = []

    def after(epoch: int, model: RankModel) -> bool:
        metrics.append({"epoch": epoch} | evaluate(validation, model, key, entity, options.get("position", "finish_position"), options.get("outcome", "outcome_id")))
        known = [v for v in (metrics[-1]["spearman"], metrics[-1]["macro_f1"]) if v is not None and np.isfinite(v)]
        value = sum(known) if known else -np.inf
        if best[0] is None or value > best[1]:
            best[:] = [model, value, epoch]
        return patience is not None and epoch - best[2] >= patience

    model, losses = train(rows, features, key, after=after, **options)
    return Fit(best[0] or model, losses, metrics, best[2])


def train(rows: DataFrame, features: list[str], key: list[str], position: str = "finish_position", outcome: str = "outcome_id", weight: str | None = None, epochs: int = 30, step: float = 0.02, decay: float = 1e-4, hidden: int = 16, kind: type[RankModel] = RankModel, after: Callable[[int, RankModel], bool] | None = None, **shape) -> tuple[RankModel, list[float]]:
    """A trained model and the loss of each epoch. rows: scaled features without nulls, a race of two rows at least. ``after`` is
    called with each epoch's model and ends the training when it says so; ``shape`` are further fields of the model's kind."""
    model = kind(list(features), hidden, **shape)
    shapes = {k: v.shape for k, v in model.weights.items()}
    classes = {r[outcome]: r.weight for r in scoring.class_weights(rows, outcome).collect()}
    class_weights = np.array([classes.get(k, 1.0) for k in range(3)])
    moments = {k: (np.zeros(s), np.zeros(s)) for k, s in shapes.items()}
    columns = [*key, *features, F.col(position).cast("double").alias("_p"), F.col(outcome).cast("int").alias("_o"), (F.col(weight) if weight else F.lit(1.0)).alias("_w")]
    data = rows.select(*columns).repartition(*key).sortWithinPartitions(*key).cache()
    losses = []
    for epoch in range(1, epochs + 1):
        current = replace(model, epoch=epoch) if isinstance(model, DeepModel) else model

        def of_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, held = None, None

            def add(total: np.ndarray | None, pdf: pd.DataFrame) -> np.ndarray | None:
                if len(pdf) < 2:
                    return total
                pdf = pdf.sort_values(features)
                loss, grads = race_gradient(current, pdf[features].to_numpy(float), pdf["_p"].to_numpy(float), pdf["_o"].to_numpy(int), float(pdf["_w"].iloc[0]), class_weights)
                flat = np.concatenate([[loss, 1.0], *[grads[k].ravel() for k in shapes]])
                return flat if total is None else total + flat

            # a batch may end within a race, which the next one goes on with
            for pdf in batches:
                pdf = pdf if held is None else pd.concat([held, pdf])
                last = (pdf[key] == pdf[key].iloc[-1]).all(axis=1)
                held = pdf[last]
                for _, race in pdf[~last].groupby(key, sort=False):
                    total = add(total, race)
            total = add(total, held) if held is not None else total
            if total is not None:
                yield pd.DataFrame({"i": np.arange(len(total)), "g": total})

        sums = data.mapInPandas(of_partition, "i int, g double").groupBy("i").agg(F.sum("g").alias("g")).orderBy("i").toPandas()["g"].to_numpy()
        losses.append(sums[0] / sums[1])
        at, weights = 2, {}
        for k, shape in shapes.items():
            size = int(np.prod(shape))
            grad = sums[at : at + size].reshape(shape) / sums[1]
            at += size
            m, v = moments[k]
            m += 0.1 * (grad - m)
            v += 0.001 * (grad**2 - v)
            update = (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.999**epoch)) + 1e-8)
            weights[k] = model.weights[k] * (1 - step * decay) - step * update
        model = replace(model, weights=weights)
        if after is not None and after(epoch, model):
            break
    data.unpersist()
    return model, losses


def _weighted(columns: list[Column], weights: np.ndarray, bias: float = 0.0) -> Column:
    out = F.lit(float(bias))
    for c, w in zip(columns, weights):
        out = out + c * float(w)
    return out


def score(rows: DataFrame, model: RankModel, key: list[str], temperature: float = 1.2) -> DataFrame:
    """rows with p_finish, p_dnf, p_dsq, predicted_outcome, score, p_win: the forward pass as column expressions."""
    w = model.weights
    hidden = {f"_h{i}": c for i, c in enumerate(model.hidden_columns([F.col(c) for c in model.features]))}
    out = rows.withColumns(hidden)
    names = [F.col(h) for h in hidden]
    out = out.withColumns({"rank_score": _weighted(names, w["rank"]), **{f"_l{i}": _weighted(names, w["status"][:, i], w["bias"][i]) for i in range(3)}}).drop(*hidden)
    top = F.greatest("_l0", "_l1", "_l2")
    total = F.exp(F.col("_l0") - top) + F.exp(F.col("_l1") - top) + F.exp(F.col("_l2") - top)
    out = out.withColumns({f"p_{o}": F.exp(F.col(f"_l{i}") - top) / total for i, o in enumerate(OUTCOMES)}).drop("_l0", "_l1", "_l2")
    best = F.greatest(*[f"p_{o}" for o in OUTCOMES])
    named = out.withColumn("predicted_outcome", F.coalesce(*[F.when(F.col(f"p_{o}") == best, F.lit(o)) for o in OUTCOMES]))
    return scoring.race_scores(named, key, "rank_score", "p_finish", "p_dnf", temperature)


def importance(rows: DataFrame, model: RankModel, key: list[str], entity: str) -> DataFrame:
    """key, entity, feature, drop: the fall of the rank score when a (scaled) feature takes its mean."""
    base = score(rows, model, key).select(*key, entity, F.col("rank_score").alias("_base"))
    grid = rows.select(*key, entity, *model.features, F.explode(F.array(*[F.lit(c) for c in model.features])).alias("feature"))
    reset = grid.withColumns({c: F.when(F.col("feature") == c, 0.0).otherwise(F.col(c)) for c in model.features})
    hidden = model.hidden_columns([F.col(c) for c in model.features])
    changed = reset.select(*key, entity, "feature", _weighted(hidden, model.weights["rank"]).alias("_now"))
    return changed.join(base, [*key, entity]).select(*key, entity, "feature", (F.col("_base") - F.col("_now")).alias("drop"))


def explained(rows: DataFrame, model: RankModel, key: list[str], entity: str) -> DataFrame:
    """key, entity, feature, abs_z (the size of the scaled value) and grad_input (the rank score's gradient times the value)."""
    w = model.weights
    on = {f"_o{i}": (_weighted([F.col(c) for c in model.features], w["w"][:, i], w["b"][i]) > 0).cast("double") for i in range(w["b"].size)}
    grad = {c: _weighted([F.col(o) for o in on], w["w"][j] * w["rank"]) for j, c in enumerate(model.features)}
    one = F.array(*[F.struct(F.lit(c).alias("feature"), F.abs(c).alias("abs_z"), (g * F.col(c)).alias("grad_input")) for c, g in grad.items()])
    return rows.withColumns(on).select(*key, entity, F.explode(one).alias("e")).select(*key, entity, "e.*")


def simulate_seasons(features: DataFrame, model: RankModel, season: str, race: str, entity: str, temperature: float = 1.2) -> DataFrame:
    """Every season's standings over its races, from features that were built for each race as of its cut-off: all races are scored
    at once. season, entity, points, wins, podiums, races, rank. Scores are compared by nine digits, then by name."""
    scored = score(features, model, [season, race], temperature).withColumn("score", F.round("score", 9))
    ranked = scored.withColumn("rank", scoring.sequential_rank("score", [season, race], entity))
    place = F.when(F.col("predicted_outcome") == "finish", F.col("rank")).otherwise(F.lit(99))
    return scoring.standings(ranked.withColumn("rank", place), entity, "rank", [race], [season])


def simulate(scored: DataFrame, key: list[str], entity: str) -> DataFrame:
    """The standings of a season: each race's ranks by score, points by rank; races whose entity is not predicted to finish bring none."""
    ranked = scored.withColumn("rank", scoring.sequential_rank("score", key, entity))
    place = F.when(F.col("predicted_outcome") == "finish", F.col("rank")).otherwise(F.lit(99))
    return scoring.standings(ranked.withColumn("rank", place), entity, "rank", key)
