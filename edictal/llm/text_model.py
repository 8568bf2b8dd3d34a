"""A bidirectional gated recurrent network with attention pooling, in numpy: forward, backward and Adam."""

from __future__ import annotations

import numpy as np

F32 = np.float32


def sigmoid(x: np.ndarray) -> np.ndarray:
    return F32(0.5) * (np.tanh(F32(0.5) * x) + F32(1))


class Network:
    """Logit of a window of word vectors.

    Both directions run gated recurrent units over the window; a learned attention weighs their joint states, and a linear layer reads
    the weighted sum.  Places beyond the end of a window leave the state as it is and get no attention.
    """

    def __init__(self, inputs: int, hidden: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        h = hidden
        self.hidden = h
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(F32)
        self.params = {"wx": draw(inputs, 6 * h), "bx": np.zeros(6 * h, F32), "uf": draw(h, 3 * h), "ub": draw(h, 3 * h), "att": draw(2 * h, 2 * h), "score": draw(2 * h), "out": draw(2 * h), "bias": np.zeros(1, F32)}
        # An open memory at the beginning.
        self.params["bx"][:h] = self.params["bx"][3 * h : 4 * h] = 1

    def project(self, vectors: np.ndarray) -> np.ndarray:
        """What a word adds to the gates of both directions; done once a distinct word."""
        return vectors @ self.params["wx"] + self.params["bx"]

    def _run(self, gates: np.ndarray, mask: np.ndarray, u: np.ndarray, back: bool, keep: bool) -> tuple[np.ndarray, list]:
        """gates (time, windows, 3h), mask (time, windows, 1); states of all places, and what the way back needs."""
        h, (steps, n, _) = self.hidden, gates.shape
        state, states, kept = np.zeros((n, h), F32), np.empty((steps, n, h), F32), []
        for t in range(steps - 1, -1, -1) if back else range(steps):
            inner = state @ u
            zr = sigmoid(gates[t, :, : 2 * h] + inner[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            new = np.tanh(gates[t, :, 2 * h :] + r * inner[:, 2 * h :])
            after = state + mask[t] * ((F32(1) - z) * (new - state))
            if keep:
                kept.append((t, state, z, r, new, inner[:, 2 * h :]))
            state = states[t] = after
        return states, kept

    def forward(self, gates: np.ndarray, mask: np.ndarray, keep: bool = False):
        """gates (time, windows, 6h) of projected words, mask (time, windows)."""
        h, p = self.hidden, self.params
        m = mask[:, :, None].astype(F32)
        forth, kept_f = self._run(gates[:, :, : 3 * h], m, p["uf"], False, keep)
        back, kept_b = self._run(gates[:, :, 3 * h :], m, p["ub"], True, keep)
        states = np.concatenate([forth, back], axis=2)
        hidden = np.tanh(states @ p["att"])
        score = np.where(mask, hidden @ p["score"], F32(-1e9))
        weight = np.exp(score - score.max(axis=0))
        weight = weight * mask
        weight /= np.maximum(weight.sum(axis=0), F32(1e-9))
        pooled = (weight[:, :, None] * states).sum(axis=0)
        logit = pooled @ p["out"] + p["bias"][0]
        return (logit, (m, kept_f, kept_b, states, hidden, weight, pooled)) if keep else logit

    def backward(self, d_logit: np.ndarray, kept) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the parameters behind the gates, and of the gates."""
        m, kept_f, kept_b, states, hidden, weight, pooled = kept
        h, p, g = self.hidden, self.params, {}
        g["bias"], g["out"] = d_logit.sum(keepdims=True), pooled.T @ d_logit
        d_pooled = d_logit[:, None] * p["out"]
        d_weight = (d_pooled[None] * states).sum(axis=2)
        d_states = weight[:, :, None] * d_pooled[None]
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["score"] = (hidden * d_score[:, :, None]).sum(axis=(0, 1))
        d_hidden = d_score[:, :, None] * p["score"] * (1 - hidden**2)
        flat = lambda x: x.reshape(-1, x.shape[-1])
        g["att"] = flat(states).T @ flat(d_hidden)
        d_states = d_states + d_hidden @ p["att"].T
        d_gates = np.empty((*states.shape[:2], 6 * h), F32)
        for name, kept_d, at in (("uf", kept_f, 0), ("ub", kept_b, 1)):
            u, grad, carry = p[name], np.zeros_like(p[name]), np.zeros((states.shape[1], h), F32)
            for t, state, z, r, new, inner in reversed(kept_d):
                d = carry + d_states[t, :, at * h : (at + 1) * h]
                dm = m[t] * d
                d_new = dm * (1 - z) * (1 - new**2)
                d_z = dm * (state - new) * z * (1 - z)
                d_r = d_new * inner * r * (1 - r)
                d_gates[t, :, 3 * h * at : 3 * h * (at + 1)] = np.concatenate([d_z, d_r, d_new], axis=1)
                d_inner = np.concatenate([d_z, d_r, d_new * r], axis=1)
                grad += state.T @ d_inner
                carry = d - dm * (1 - z) + d_inner @ u.T
            g[name] = grad
        return g, d_gates


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        scale = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grads.items():
            self.m[k] += F32(0.1) * (g - self.m[k])
            self.v[k] += F32(0.001) * (g * g - self.v[k])
            self.params[k] -= F32(scale) * self.m[k] / (np.sqrt(self.v[k]) + F32(1e-7))
