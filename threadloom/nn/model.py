"""Feed-forward models: parameters on the driver, batches in Arrow, updates in between.

A step broadcasts the parameters, sums loss and gradients of the batch in each task, adds
the sums on the driver and updates. Mini-batches are sequential by definition; the
parallelism is inside a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.nn.initializers import Random, Static
from threadloom.nn.losses import EPSILON
from threadloom.nn.optimizers import Optimizer
from threadloom.session import summed_blocks

REGISTRY: dict[str, type] = {}
#: Bytes of parameters that are sent to the tasks at most.
MOST_BYTES = 256 << 20


class Element:
    """A stage of a model with named parameters; ``forward`` keeps what ``backward`` needs."""

    trainable: tuple[str, ...] = ()

    def __init_subclass__(cls, **kwargs) -> None:
        super().__init_subclass__(**kwargs)
        REGISTRY[cls.__name__] = cls

    def get_parameters(self) -> dict[str, np.ndarray]:
        return {k: getattr(self, k) for k in self.trainable}

    def set_parameters(self, values: dict[str, np.ndarray]) -> None:
        for k, v in values.items():
            setattr(self, k, v)

    def config(self) -> dict:
        return {}

    def forward(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def backward(self, dv: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def gradients(self) -> dict[str, np.ndarray]:
        return {k: getattr(self, f"d{k}") for k in self.trainable}


class NLayer(Element):
    trainable = ("weights", "biases")

    def __init__(self, n_inputs: int, n_outputs: int, initialization=None) -> None:
        self.n_inputs, self.n_outputs = n_inputs, n_outputs
        self.weights = (initialization or Random(multiplier=0.1)).draw(n_inputs, n_outputs)
        self.biases = Static(0).draw(1, n_outputs)

    def config(self):
        return {"n_inputs": self.n_inputs, "n_outputs": self.n_outputs}

    def forward(self, x):
        self.inputs = x
        return x @ self.weights + self.biases

    def backward(self, dv):
        self.dweights, self.dbiases = self.inputs.T @ dv, dv.sum(0, keepdims=True)
        return dv @ self.weights.T


class _Pointwise(Element):
    def forward(self, x):
        self.inputs = x
        return self.value(x)

    def backward(self, dv):
        return dv * self.slope(self.inputs)


def _softplus(x):
    return np.logaddexp(0.0, x)


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


class ReLU(_Pointwise):
    value = staticmethod(lambda x: np.maximum(x, 0))
    slope = staticmethod(lambda x: (x > 0).astype(float))


class LeakyReLU(_Pointwise):
    def __init__(self, alpha: float = 0.01) -> None:
        self.alpha = alpha

    def config(self):
        return {"alpha": self.alpha}

    def value(self, x):
        return np.where(x > 0, x, x * self.alpha)

    def slope(self, x):
        return np.where(x > 0, 1.0, self.alpha)


class ELU(LeakyReLU):
    def __init__(self, alpha: float = 1.0) -> None:
        self.alpha = alpha

    def value(self, x):
        return np.where(x > 0, x, self.alpha * np.expm1(np.minimum(x, 0)))

    def slope(self, x):
        return np.where(x > 0, 1.0, self.alpha * np.exp(np.minimum(x, 0)))


class PReLU(Element):
    """A trainable slope for negative inputs, one for all or, ``multichannel``, one a feature."""

    trainable = ("alpha",)

    def __init__(self, alpha: float = 0.01, multichannel: bool = False) -> None:
        self.alpha, self.multichannel = np.array([float(alpha)]), multichannel

    def config(self):
        return {"multichannel": self.multichannel}

    def forward(self, x):
        if self.multichannel and len(self.alpha) == 1:
            self.alpha = np.full(x.shape[1], self.alpha[0])
        self.inputs = x
        return np.where(x < 0, x * self.alpha, x)

    def backward(self, dv):
        part = dv * np.where(self.inputs > 0, 0.0, self.inputs)
        self.dalpha = part.sum(0) if self.multichannel else np.array([part.sum()])
        return dv * np.where(self.inputs < 0, self.alpha, 1.0)


class Sigmoid(_Pointwise):
    value = staticmethod(_sigmoid)
    slope = staticmethod(lambda x: _sigmoid(x) * (1 - _sigmoid(x)))


class Tanh(_Pointwise):
    value = staticmethod(np.tanh)
    slope = staticmethod(lambda x: 1 - np.tanh(x) ** 2)


class Sin(_Pointwise):
    value = staticmethod(np.sin)
    slope = staticmethod(np.cos)


class Identity(_Pointwise):
    value = staticmethod(lambda x: x)
    slope = staticmethod(np.ones_like)


class Softplus(_Pointwise):
    def __init__(self, beta: float = 1.0) -> None:
        self.beta = beta

    def config(self):
        return {"beta": self.beta}

    def value(self, x):
        return _softplus(self.beta * x) / self.beta

    def slope(self, x):
        return _sigmoid(self.beta * x)


class Mish(_Pointwise):
    value = staticmethod(lambda x: x * np.tanh(_softplus(x)))

    @staticmethod
    def slope(x):
        t = np.tanh(_softplus(x))
        return t + x * _sigmoid(x) * (1 - t * t)


class ReLUClip(_Pointwise):
    def __init__(self, clip: float = 8.0) -> None:
        self.clip = clip

    def config(self):
        return {"clip": self.clip}

    def value(self, x):
        return np.clip(x, 0, self.clip)

    def slope(self, x):
        return ((x > 0) & (x < self.clip)).astype(float)


class Softmax(Element):
    def forward(self, x):
        e = np.exp(x - x.max(1, keepdims=True))
        self.outputs = e / e.sum(1, keepdims=True)
        return self.outputs

    def backward(self, dv):
        s = self.outputs
        return s * (dv - (s * dv).sum(1, keepdims=True))


class Loss(Element):
    """``forward`` gives the loss of each row, ``backward`` the gradient of their mean."""


class MeanSquaredError(Loss):
    def forward(self, x, y):
        return ((x - y) ** 2).mean(1)

    def backward(self, x, y, n):
        return -2 * (y - x) / x.shape[1] / n


class MeanAbsoluteError(Loss):
    def forward(self, x, y):
        return np.abs(x - y).mean(1)

    def backward(self, x, y, n):
        return np.sign(x - y) / x.shape[1] / n


class BinaryCrossEntropy(Loss):
    def forward(self, x, y):
        p = np.clip(x, EPSILON, 1 - EPSILON)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean(1)

    def backward(self, x, y, n):
        p = np.clip(x, EPSILON, 1 - EPSILON)
        return -(y / p - (1 - y) / (1 - p)) / x.shape[1] / n


class CategoricalCrossEntropy(Loss):
    """Targets are one column of class ids, or one-hot rows."""

    @staticmethod
    def _rows(x, y):
        return y if y.shape[1] == x.shape[1] and y.shape[1] > 1 else np.eye(x.shape[1])[y[:, 0].astype(int)]

    def forward(self, x, y):
        p = np.clip(x, EPSILON, 1 - EPSILON)
        return -np.log((p * self._rows(x, y)).sum(1))

    def backward(self, x, y, n):
        return -self._rows(x, y) / np.clip(x, EPSILON, 1 - EPSILON) / n


@dataclass
class Model:
    elements: list[Element]
    loss: Loss | None = None
    history: list[dict] = field(default_factory=list)

    def forward(self, x: np.ndarray) -> np.ndarray:
        if not self.elements:
            raise ValueError("the model has no elements")
        for e in self.elements:
            x = e.forward(x)
        return x

    def backward(self, dv: np.ndarray) -> np.ndarray:
        for e in reversed(self.elements):
            dv = e.backward(dv)
        return dv

    def parameters(self) -> dict[str, np.ndarray]:
        return {f"{k}.{name}": v for k, e in enumerate(self.elements) for name, v in e.get_parameters().items()}

    def set_parameters(self, values: dict[str, np.ndarray]) -> None:
        for key, v in values.items():
            k, name = key.split(".")
            self.elements[int(k)].set_parameters({name: v})

    def gradients(self) -> dict[str, np.ndarray]:
        return {f"{k}.{name}": v for k, e in enumerate(self.elements) for name, v in e.gradients().items()}

    # ------------------------------------------------------------ distributed

    def inference(self, rows: DataFrame, features: str = "features", output: str = "output") -> DataFrame:
        """Add the output array of each row, in Arrow batches; NULL features give NULL."""
        self.check_size()
        model = Model(self.elements)

        @F.pandas_udf("array<double>")
        def run(xs):
            ok = [k for k, v in enumerate(xs) if v is not None]
            out = [None] * len(xs)
            if ok:
                for k, y in zip(ok, model.forward(np.array([np.asarray(xs.iloc[k], dtype=float) for k in ok])), strict=True):
                    out[k] = y
            return pd.Series(out, dtype=object)

        return rows.withColumn(output, run(F.col(features).cast("array<double>")))

    def check_size(self) -> None:
        """Parameters go out with every job; beyond `MOST_BYTES` they are too large for that."""
        size = sum(v.nbytes for v in self.parameters().values())
        if size > MOST_BYTES:
            raise ValueError(f"{size} bytes of parameters are too many to send to every task")

    def _sums(self, n_batch: int) -> Callable:
        self.check_size()
        model = Model(self.elements, self.loss)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loss, n, grads = 0.0, 0, None
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, y = (np.array(batch[c].to_pylist(), dtype=float) for c in ("features", "label"))
                out = model.forward(x)
                loss += float(model.loss.forward(out, y).sum())
                n += len(x)
                model.backward(model.loss.backward(out, y, n_batch))
                g = np.concatenate([v.ravel() for v in model.gradients().values()] or [np.empty(0)])
                grads = g if grads is None else grads + g
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([n], pa.int64()), pa.array([grads.tobytes()], pa.binary())], names=["loss", "n", "grads"])

        return run

    def batch_step(self, rows: DataFrame, n_batch: int) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss of the batch and the gradients, summed over tasks."""
        shapes = {k: v.shape for k, v in self.parameters().items()}
        (loss, _), total = summed_blocks(rows.mapInArrow(self._sums(n_batch), "loss double, n bigint, grads binary"), ["loss", "n"], "grads")
        parts = np.split(total, np.cumsum([int(np.prod(s)) for s in shapes.values()])[:-1])
        return loss / n_batch, {k: p.reshape(s) for (k, s), p in zip(shapes.items(), parts, strict=True)}

    def train(self, dataset: DataFrame, optimizer: Optimizer, epochs: int = 1, tracker=None, metrics=None, callback=None) -> list[float]:
        """Mean loss of each epoch over rows (batch, features, label), in batch order.

        Each batch is one distributed sum and one update. The rows are kept in the order of
        their batches, so that a step skips the stored blocks of all other batches by their
        bounds; a large batch lies in several partitions. After a batch the callback gets
        the outputs as a lazy frame; after an epoch the tracker gets loss and rate.
        """
        data = dataset.select("batch", F.col("features").cast("array<double>").alias("features"), F.col("label").cast("array<double>").alias("label")).where("features IS NOT NULL AND label IS NOT NULL")
        data = data.repartitionByRange("batch", F.xxhash64("features")).sortWithinPartitions("batch").cache()
        sizes = [(r["batch"], r["count"]) for r in data.groupBy("batch").count().orderBy("batch").collect()]
        losses = []
        for epoch in range(epochs):
            optimizer.start_epoch(epoch)
            total = 0.0
            for b, n in sizes:
                rows = data.where(F.col("batch") == b)
                loss, grads = self.batch_step(rows.select("features", "label"), n)
                self.set_parameters(optimizer.step(self.parameters(), grads))
                optimizer.end_step()
                total += loss
                if callback is not None:
                    callback({"loss": loss, "results": self.inference(rows, output="output")})
            losses.append(total / max(len(sizes), 1))
            if tracker is not None:
                tracker.log({"epoch": epoch, "loss": losses[-1], "learning_rate": optimizer.rate})
            if metrics is not None:
                metrics(self.inference(data), epoch)
        data.unpersist()
        return losses
