"""Activations and their gradients as column expressions on a number.

Apply one to an array with `on_array`, to a batch of driver arrays with the classes of
`threadloom.nn.model`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def softplus(x: Column, beta: float = 1.0) -> Column:
    """ln(1 + e**(beta x)) / beta in a form that does not overflow."""
    return (F.greatest(x * beta, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x * beta)))) / beta


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _mish_gradient(x: Column) -> Column:
    t = F.tanh(softplus(x))
    return t + x * sigmoid(x) * (1 - t * t)


FORWARD: dict[str, Callable[[Column], Column]] = {
    "relu": lambda x: F.greatest(x, F.lit(0.0)),
    "leaky_relu": lambda x, alpha=0.01: F.when(x > 0, x).otherwise(x * alpha),
    "sigmoid": sigmoid,
    "elu": lambda x, alpha=1.0: F.when(x > 0, x).otherwise(alpha * F.expm1(F.least(x, F.lit(0.0)))),
    "prelu": lambda x, alpha=0.01: F.when(x < 0, x * alpha).otherwise(x),
    "tanh": F.tanh,
    "sin": F.sin,
    "identity": lambda x: x,
    "softplus": softplus,
    "mish": lambda x: x * F.tanh(softplus(x)),
    "relu_clip": lambda x, clip=8.0: F.least(F.greatest(x, F.lit(0.0)), F.lit(clip)),
}
#: Derivative at x; the backward pass multiplies it with the incoming gradient.
GRADIENT: dict[str, Callable[[Column], Column]] = {
    "relu": lambda x: F.when(x <= 0, 0.0).otherwise(1.0),
    "leaky_relu": lambda x, alpha=0.01: F.when(x <= 0, alpha).otherwise(1.0),
    "sigmoid": lambda x: sigmoid(x) * (1 - sigmoid(x)),
    "elu": lambda x, alpha=1.0: F.when(x > 0, 1.0).otherwise(alpha * F.exp(F.least(x, F.lit(0.0)))),
    "prelu": lambda x, alpha=0.01: F.when(x < 0, alpha).otherwise(1.0),
    "tanh": lambda x: 1 - F.tanh(x) * F.tanh(x),
    "sin": F.cos,
    "identity": lambda x: F.lit(1.0),
    "softplus": lambda x, beta=1.0: sigmoid(x * beta),
    "mish": _mish_gradient,
    "relu_clip": lambda x, clip=8.0: F.when((x <= 0) | (x >= clip), 0.0).otherwise(1.0),
}


def prelu_alpha_gradient(x: Column, incoming: Column) -> Column:
    """Aggregate: gradient of the slope over all rows."""
    return F.sum(incoming * F.when(x > 0, 0.0).otherwise(x))


def on_array(name: str, values: Column, **kwargs) -> Column:
    return F.transform(values, lambda x: FORWARD[name](x, **kwargs))


def softmax(values: Column) -> Column:
    """Softmax of an array, shifted by its largest value."""
    shifted = F.transform(values, lambda x: F.exp(x - F.array_max(values)))
    return F.transform(shifted, lambda e: e / F.aggregate(shifted, F.lit(0.0), lambda s, v: s + v))


def softmax_gradient(outputs: Column, incoming: Column) -> Column:
    """s * (dv - sum(s * dv)), the product with the Jacobian of each row."""
    inner = F.aggregate(F.zip_with(outputs, incoming, lambda s, d: s * d), F.lit(0.0), lambda a, v: a + v)
    return F.zip_with(outputs, incoming, lambda s, d: s * (d - inner))
