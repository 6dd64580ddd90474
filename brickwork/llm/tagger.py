"""A character-level bidirectional LSTM with CRF transitions, in numpy.

Characters enter as classes; the input matrix of a gate is a table of rows by
class.  Arrays are [time, window, ...].  ``fit`` runs Adam on the negative
log-likelihood of the labels; ``decode`` gives the best label of every character.
"""

from __future__ import annotations

import numpy as np

KINDS = ("email", "ip", "card", "phone")
#: Label 0 is outside; kind k begins with 1 + 2k and goes on with 2 + 2k.
LABELS = 1 + 2 * len(KINDS)
HIDDEN = 24
WIDTH = 96


def classes_of(text: str) -> np.ndarray:
    """Class of each character: ASCII letters without case, other ASCII as such, the rest."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _ASCII[np.minimum(codes, 128)]


_ASCII = np.array([ord(chr(c).lower()) for c in range(128)] + [128], np.uint8)
CHARACTERS = 129


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def init(seed: int = 5, hidden: int = HIDDEN) -> dict[str, np.ndarray]:
    g = np.random.default_rng(seed)
    p = {}
    for side in "fb":
        p[f"x{side}"] = g.normal(0, 0.3, (CHARACTERS, 4 * hidden))
        p[f"x{side}"][:, hidden : 2 * hidden] += 1.0  # gates start open to the past
        p[f"h{side}"] = g.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden))
        p[f"o{side}"] = g.normal(0, 1 / np.sqrt(hidden), (hidden, LABELS))
    p["bias"] = np.zeros(LABELS)
    p["moves"] = np.zeros((LABELS, LABELS))
    return {k: v.astype(np.float32) for k, v in p.items()}


def _lstm(x: np.ndarray, w: np.ndarray, keep: bool):
    """Hidden states [t, b, h] of gate inputs [t, b, 4h]; with ``keep`` also what the backward pass needs."""
    steps, batch, width = x.shape
    hidden = width // 4
    h, c = np.zeros((batch, hidden), np.float32), np.zeros((batch, hidden), np.float32)
    out = np.empty((steps, batch, hidden), np.float32)
    kept = []
    for t in range(steps):
        z = x[t] + h @ w
        gates = _sigmoid(z[:, : 3 * hidden])
        i, f, o = gates[:, :hidden], gates[:, hidden : 2 * hidden], gates[:, 2 * hidden :]
        g = np.tanh(z[:, 3 * hidden :])
        before = c
        c = f * c + i * g
        s = np.tanh(c)
        out[t] = o * s
        if keep:
            kept.append((h, before, i, f, o, g, s))
        h = out[t]
    return out, kept


def _lstm_back(d_out: np.ndarray, w: np.ndarray, kept: list):
    """Gradients of the gate inputs and of the recurrent matrix."""
    steps, batch, hidden = d_out.shape
    d_x = np.empty((steps, batch, 4 * hidden), np.float32)
    d_w = np.zeros_like(w)
    d_h, d_c = np.zeros((batch, hidden), np.float32), np.zeros((batch, hidden), np.float32)
    for t in range(steps - 1, -1, -1):
        h, before, i, f, o, g, s = kept[t]
        d = d_out[t] + d_h
        d_c = d_c + d * o * (1 - s * s)
        z = d_x[t]
        z[:, :hidden] = d_c * g * i * (1 - i)
        z[:, hidden : 2 * hidden] = d_c * before * f * (1 - f)
        z[:, 2 * hidden : 3 * hidden] = d * s * o * (1 - o)
        z[:, 3 * hidden :] = d_c * i * (1 - g * g)
        d_w += h.T @ z
        d_h = z @ w.T
        d_c = d_c * f
    return d_x, d_w


def _emissions(p: dict, x: np.ndarray, keep: bool):
    hf, kf = _lstm(p["xf"][x], p["hf"], keep)
    hb, kb = _lstm(p["xb"][x[::-1]], p["hb"], keep)
    hb = hb[::-1]
    return hf @ p["of"] + hb @ p["ob"] + p["bias"], hf, hb, kf, kb


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


def _crf_gradient(e: np.ndarray, moves: np.ndarray, y: np.ndarray):
    """Mean negative log-likelihood and its gradients for emissions [t, b, l]."""
    steps, batch, _ = e.shape
    ahead = np.empty_like(e)
    ahead[0] = e[0]
    for t in range(1, steps):
        ahead[t] = e[t] + _log_sum(ahead[t - 1][:, :, None] + moves[None], 1)
    total = _log_sum(ahead[-1], 1)
    back = np.zeros_like(e)
    d_moves = np.zeros_like(moves)
    for t in range(steps - 2, -1, -1):
        later = e[t + 1] + back[t + 1]
        back[t] = _log_sum(moves[None] + later[:, None, :], 2)
        joint = ahead[t][:, :, None] + moves[None] + later[:, None, :] - total[:, None, None]
        d_moves += np.exp(joint).sum(axis=0)
    d_e = np.exp(ahead + back - total[None, :, None])
    b = np.arange(batch)
    t = np.arange(steps)[:, None]
    gold = e[t, b[None], y].sum(axis=0) + moves[y[:-1], y[1:]].sum(axis=0)
    np.add.at(d_e, (t, b[None], y), -1)
    np.add.at(d_moves, (y[:-1], y[1:]), -1)
    return float((total - gold).mean()), d_e / batch, d_moves / batch


def gradient(p: dict, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    e, hf, hb, kf, kb = _emissions(p, x, True)
    loss, d_e, d_moves = _crf_gradient(e, p["moves"], y)
    d_e = d_e.astype(np.float32)
    out = {"moves": d_moves, "bias": d_e.sum(axis=(0, 1))}
    out["of"] = np.einsum("tbh,tbl->hl", hf, d_e, optimize=True)
    out["ob"] = np.einsum("tbh,tbl->hl", hb, d_e, optimize=True)
    for side, kept, order in (("f", kf, slice(None)), ("b", kb, slice(None, None, -1))):
        d_x, out[f"h{side}"] = _lstm_back((d_e @ p[f"o{side}"].T)[order], p[f"h{side}"], kept)
        table = np.zeros_like(p[f"x{side}"])
        np.add.at(table, x[order], d_x)
        out[f"x{side}"] = table
    return loss, out


def fit(x: np.ndarray, y: np.ndarray, epochs: int = 10, batch: int = 64, rate: float = 0.01, seed: int = 5) -> dict:
    """Parameters learned from windows of classes ``x`` and labels ``y``, both [n, WIDTH]."""
    p, g = init(seed), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in p.items()}
    s = {k: np.zeros_like(v) for k, v in p.items()}
    step, total = 0, epochs * -(-len(x) // batch)
    for _ in range(epochs):
        order = g.permutation(len(x))
        for at in range(0, len(x), batch):
            some = order[at : at + batch]
            _, d = gradient(p, np.ascontiguousarray(x[some].T), np.ascontiguousarray(y[some].T))
            norm = np.sqrt(sum(float((v * v).sum()) for v in d.values()))
            step += 1
            pace = rate * (1 - step / (total + 1))
            for k in p:
                v = d[k] * min(1.0, 5.0 / (norm + 1e-9))
                m[k] += 0.1 * (v - m[k])
                s[k] += 0.01 * (v * v - s[k])
                p[k] = (p[k] - pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return p


def decode(p: dict, x: np.ndarray) -> np.ndarray:
    """Best labels [n, WIDTH] of windows of classes [n, WIDTH] (Viterbi)."""
    e = _emissions(p, np.ascontiguousarray(x.T), False)[0]
    steps, batch, _ = e.shape
    came = np.empty((steps, batch, LABELS), np.uint8)
    best = e[0]
    for t in range(1, steps):
        each = best[:, :, None] + p["moves"][None]
        came[t] = each.argmax(axis=1)
        best = np.take_along_axis(each, came[t][:, None, :].astype(np.intp), axis=1)[:, 0] + e[t]
    out = np.empty((batch, steps), np.uint8)
    out[:, -1] = best.argmax(axis=1)
    b = np.arange(batch)
    for t in range(steps - 1, 0, -1):
        out[:, t - 1] = came[t][b, out[:, t]]
    return out
