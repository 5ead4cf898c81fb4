"""Parameter updates. Gradients come from distributed sums; an update is driver arithmetic.

State is kept for each parameter by name. ``start_epoch`` sets the rate to
lr / (1 + epoch * decay) and restarts the step counter, as Adam's bias correction counts
the steps of the epoch; ``global_step`` keeps counting instead.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np


@dataclass
class Optimizer:
    learning_rate: float = 1.0
    decay: float = 0.0
    global_step: bool = False
    rate: float = field(init=False)
    iterations: int = field(init=False, default=0)
    state: dict = field(init=False, default_factory=dict)

    def __post_init__(self) -> None:
        self.rate = self.learning_rate

    def start_epoch(self, epoch: int) -> None:
        self.rate = self.learning_rate / (1 + epoch * self.decay)
        if not self.global_step:
            self.iterations = 0

    def step(self, params: dict[str, np.ndarray], grads: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """New values of all parameters that have a gradient."""
        new = {k: self.update(k, params[k], g) for k, g in grads.items()}
        return {**params, **new}

    def end_step(self) -> None:
        self.iterations += 1

    def slot(self, kind: str, name: str, like: np.ndarray) -> np.ndarray:
        return self.state.setdefault((kind, name), np.zeros_like(like, dtype=float))

    def update(self, name: str, w: np.ndarray, g: np.ndarray) -> np.ndarray:
        raise NotImplementedError


@dataclass
class SGD(Optimizer):
    momentum: float = 0.0

    def update(self, name, w, g):
        if not self.momentum:
            return w - self.rate * g
        m = self.momentum * self.slot("m", name, w) - self.rate * g
        self.state["m", name] = m
        return w + m


@dataclass
class AdaGrad(Optimizer):
    epsilon: float = 1e-7

    def update(self, name, w, g):
        c = self.state["c", name] = self.slot("c", name, w) + g * g
        return w - self.rate * g / (np.sqrt(c) + self.epsilon)


@dataclass
class RMSProp(Optimizer):
    learning_rate: float = 0.001
    epsilon: float = 1e-7
    rho: float = 0.9

    def update(self, name, w, g):
        c = self.state["c", name] = self.rho * self.slot("c", name, w) + (1 - self.rho) * g * g
        return w - self.rate * g / (np.sqrt(c) + self.epsilon)


@dataclass
class Adam(Optimizer):
    learning_rate: float = 0.001
    beta_1: float = 0.9
    beta_2: float = 0.999
    epsilon: float = 1e-7

    def update(self, name, w, g):
        m = self.state["m", name] = self.beta_1 * self.slot("m", name, w) + (1 - self.beta_1) * g
        c = self.state["c", name] = self.beta_2 * self.slot("c", name, w) + (1 - self.beta_2) * g * g
        t = self.iterations + 1
        m_hat, c_hat = m / (1 - self.beta_1**t), c / (1 - self.beta_2**t)
        return w - self.rate * m_hat / (np.sqrt(c_hat) + self.epsilon)


@dataclass
class AdamW(Adam):
    weight_decay: float = 0.01

    def update(self, name, w, g):
        return super().update(name, w, g) - self.rate * self.weight_decay * w


@dataclass
class Muon(Optimizer):
    """Momentum whose matrices are made orthogonal by a Newton-Schulz iteration.

    After the published algorithm (Jordan et al., 2024): the update of a matrix is replaced
    by a polynomial approximation of its nearest orthogonal matrix.
    """

    learning_rate: float = 1.0
    mode: str = "moonlight"
    nesterov: bool = True
    steps: int = 5
    momentum: float = 0.9
    epsilon: float = 1e-7

    # Coefficients of the quintic iteration.
    QUINTIC = (3.4445, -4.7750, 2.0315)

    def __post_init__(self) -> None:
        super().__post_init__()
        if self.mode not in ("naive", "kellerjordan", "mup", "moonlight"):
            raise ValueError(f"not a scale mode: {self.mode}")

    def update(self, name, w, g):
        m = self.state["m", name] = self.momentum * self.slot("m", name, w) + (1 - self.momentum) * g
        if w.ndim != 2 or min(w.shape) <= 1:
            return w - self.rate * m
        look = (1 - self.momentum) * g + self.momentum * m if self.nesterov else m
        return w - self.rate * scale(self.mode, *w.shape) * self.orthogonal(look)

    def orthogonal(self, g: np.ndarray) -> np.ndarray:
        a, b, c = self.QUINTIC
        wide = g.shape[0] <= g.shape[1]
        x = (g if wide else g.T) / (np.linalg.norm(g) + self.epsilon)
        for _ in range(self.steps):
            gram = x @ x.T
            x = a * x + (b * gram + c * gram @ gram) @ x
        return x if wide else x.T


def scale(mode: str, n_inputs: int, n_outputs: int) -> float:
    return {
        "naive": 1.0,
        "kellerjordan": math.sqrt(max(1.0, n_outputs / n_inputs)),
        "mup": math.sqrt(n_outputs / n_inputs),
        "moonlight": 0.2 * math.sqrt(max(n_inputs, n_outputs)),
    }[mode]
