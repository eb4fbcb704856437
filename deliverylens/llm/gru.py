"""Gated recurrent unit in numpy: steps over a batch, gradients through time, Adam."""

from __future__ import annotations

import numpy as np

F32 = np.float32


def sigmoid(x: np.ndarray) -> np.ndarray:
    return F32(0.5) * np.tanh(F32(0.5) * x) + F32(0.5)


def forward(x: np.ndarray, u: np.ndarray, bn: np.ndarray, h0: np.ndarray, keep: np.ndarray | None = None):
    """Run the unit over x [T, B, 3H] (input parts of update, reset and candidate gates).

    ``keep`` [T, B, 1] is 0 where a new sequence starts, so that the state is
    cleared before the step.  Returns the states [T + 1, B, H] and what
    :func:`backward` needs."""
    steps, batch, h3 = x.shape
    n = h3 // 3
    states = np.empty((steps + 1, batch, n), F32)
    states[0] = h0
    gates = np.empty((steps, batch, 2 * n), F32)
    cand = np.empty((steps, batch, n), F32)
    hidden = np.empty((steps, batch, n), F32)
    for t in range(steps):
        h = states[t] if keep is None else states[t] * keep[t]
        a = h @ u
        gates[t] = g = sigmoid(x[t, :, :2 * n] + a[:, :2 * n])
        hidden[t] = hn = a[:, 2 * n:] + bn
        cand[t] = c = np.tanh(x[t, :, 2 * n:] + g[:, n:] * hn)
        states[t + 1] = c + g[:, :n] * (h - c)
    return states, (gates, cand, hidden)


def states_only(x_of, steps: int, batch: int, u: np.ndarray, bn: np.ndarray, out: np.ndarray) -> None:
    """As :func:`forward` from a zero state, keeping states alone: out [T, B, H]; x_of(t) gives [B, 3H]."""
    n = u.shape[0]
    h = np.zeros((batch, n), F32)
    for t in range(steps):
        x = x_of(t)
        a = h @ u
        g = sigmoid(x[:, :2 * n] + a[:, :2 * n])
        c = np.tanh(x[:, 2 * n:] + g[:, n:] * (a[:, 2 * n:] + bn))
        h = c + g[:, :n] * (h - c)
        out[t] = h


def backward(d_states: np.ndarray, u: np.ndarray, states: np.ndarray, saved, keep: np.ndarray | None = None):
    """Gradients (d_x, d_u, d_bn) from gradients on the states after each step."""
    gates, cand, hidden = saved
    steps, batch, n = d_states.shape
    d_x = np.empty((steps, batch, 3 * n), F32)
    d_u, d_bn = np.zeros_like(u), np.zeros(n, F32)
    carry = np.zeros((batch, n), F32)
    for t in range(steps - 1, -1, -1):
        h = states[t] if keep is None else states[t] * keep[t]
        z, r, c = gates[t, :, :n], gates[t, :, n:], cand[t]
        dh = d_states[t] + carry
        d_c = dh * (1 - z) * (1 - c * c)
        pre = np.concatenate([dh * (h - c) * z * (1 - z), d_c * hidden[t] * r * (1 - r), d_c * r], axis=1)
        d_x[t, :, :2 * n] = pre[:, :2 * n]
        d_x[t, :, 2 * n:] = d_c
        d_u += h.T @ pre
        d_bn += pre[:, 2 * n:].sum(0)
        carry = dh * z + pre @ u.T
        if keep is not None:
            carry *= keep[t]
    return d_x, d_u, d_bn


class Adam:
    """Adam on a dict of arrays, changed in place."""

    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray], clip: float = 5.0) -> None:
        self.t += 1
        norm = np.sqrt(sum(float(np.vdot(g, g)) for g in grads.values()))
        scale = F32(min(1.0, clip / (norm + 1e-12)))
        rate = F32(self.rate * np.sqrt(1 - 0.999 ** self.t) / (1 - 0.9 ** self.t))
        for k, g in grads.items():
            g = g * scale
            m, v = self.m[k], self.v[k]
            m += F32(0.1) * (g - m)
            v += F32(0.001) * (g * g - v)
            self.p[k] -= rate * m / (np.sqrt(v) + F32(1e-8))
