"""A gated recurrent language model in numpy, with class-factored output.

Words of the vocabulary stand in classes of equal size by frequency; the probability of a
word is that of its class times that within the class, so an output costs the square root of
the vocabulary. Documents run side by side in lanes, one after the other in each; the state
is reset where one begins and carried on from window to window.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np

HIDDEN = 16
CLASS = 32
CLASSES = 32
WORDS = CLASS * CLASSES
END, RARE, FIRST_WORD = 0, 1, 2
START = WORDS  # input before the first word
WINDOW = 16
# Scoring keeps nothing for a way back, so its windows may be longer.
SCORED_WINDOW = 64
LANES = 256
PIECE = 1024


@dataclass
class Weights:
    """``given``: word to gates (update, reset, new); ``turn``: state to gates; then outputs."""

    given: np.ndarray
    turn: np.ndarray
    group: np.ndarray
    group_bias: np.ndarray
    word: np.ndarray
    word_bias: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return [getattr(self, f.name) for f in fields(self)]

    def packed(self) -> bytes:
        return b"".join(a.astype("<f4").tobytes() for a in self.arrays())


_SHAPES = [(WORDS + 1, 3 * HIDDEN), (HIDDEN, 3 * HIDDEN), (HIDDEN, CLASSES), (CLASSES,), (CLASSES, HIDDEN, CLASS), (CLASSES, CLASS)]


def unpacked(data: bytes) -> Weights:
    flat, at, out = np.frombuffer(data, "<f4"), 0, []
    for shape in _SHAPES:
        n = int(np.prod(shape))
        out.append(flat[at : at + n].reshape(shape).copy())
        at += n
    return Weights(*out)


def initial(counts: np.ndarray, seed: int = 5) -> Weights:
    """Small random weights; biases that give each word its share of ``counts``."""
    random = np.random.default_rng(seed)
    share = (counts + 1.0) / (counts + 1.0).sum()
    by_class = share.reshape(CLASSES, CLASS)
    out = [random.normal(0, 0.1, s) for s in _SHAPES]
    out[1] = random.normal(0, HIDDEN**-0.5, _SHAPES[1])
    out[3] = np.log(by_class.sum(axis=1))
    out[5] = np.log(by_class / by_class.sum(axis=1, keepdims=True))
    return Weights(*[a.astype(np.float32) for a in out])


@dataclass
class Lanes:
    """Inputs, targets, first steps and document numbers (-1: idle), one row a step.

    Fuller lanes come first, so the lanes that are busy at a step are the first few.
    """

    given: np.ndarray
    target: np.ndarray
    first: np.ndarray
    owner: np.ndarray

    def window(self, lo: int, steps: int) -> Lanes:
        busy = int((self.owner[lo] >= 0).sum())
        return Lanes(*[a[lo : lo + steps, :busy] for a in (self.given, self.target, self.first, self.owner)])


def lanes(documents: list[np.ndarray], most: int = LANES) -> Lanes:
    """Lay out documents (ids, the end included), the longest first, each in the emptiest lane."""
    sizes = np.array([len(d) for d in documents])
    width = min(most, len(documents))
    fill = np.zeros(width, np.int64)
    put = []
    for i in np.argsort(-sizes, kind="stable"):
        lane = int(fill.argmin())
        put.append((i, lane, int(fill[lane])))
        fill[lane] += sizes[i]
    steps = int(fill.max())
    column = np.empty(width, np.int64)
    column[np.argsort(-fill, kind="stable")] = np.arange(width)
    given = np.full((steps, width), START, np.int32)
    target = np.zeros((steps, width), np.int32)
    first = np.zeros((steps, width), bool)
    owner = np.full((steps, width), -1, np.int32)
    for i, lane, at in put:
        lane = column[lane]
        d, end = documents[i], at + len(documents[i])
        given[at + 1 : end, lane] = d[:-1]
        target[at:end, lane] = d
        first[at, lane] = True
        owner[at:end, lane] = i
    return Lanes(given, target, first, owner)


def _live(owner: np.ndarray) -> np.ndarray | slice:
    """Where documents are; mostly everywhere, and then nothing need be copied."""
    live = owner.ravel() >= 0
    return slice(None) if live.all() else live


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + np.float32(0.5)


def forward(w: Weights, state: np.ndarray, given: np.ndarray, first: np.ndarray):
    """States after each step, and what the way back needs."""
    inputs = w.given[given]
    kept = []
    states = np.empty((len(given), *state.shape), np.float32)
    two = 2 * HIDDEN
    for t in range(len(given)):
        if first[t].any():
            state = np.where(first[t][:, None], np.float32(0), state)
        gates = _sigmoid(inputs[t, :, :two] + state @ w.turn[:, :two])
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        rs = r * state
        new = np.tanh(inputs[t, :, two:] + rs @ w.turn[:, two:])
        kept.append((state, z, r, rs, new))
        state = new + z * (state - new)
        states[t] = state
    return states, kept


def _picked(x: np.ndarray, at: np.ndarray, slopes: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Log-softmax of row i at ``at[i]``, and its negative's gradient (in place of ``x``).

    Logits are small; only where they are not are they cut before the exponential.
    """
    row = np.arange(len(x))
    if x.size and (x.max() > 60 or x.min() < -60):
        np.clip(x, -60, 60, out=x)
    own = x[row, at]
    np.exp(x, out=x)
    total = x.sum(axis=1)
    if slopes:
        x /= total[:, None]
        x[row, at] -= 1
    return own - np.log(total), x


def outputs(w: Weights, states: np.ndarray, target: np.ndarray, slopes: Weights | None = None):
    """Log-probability of each target; with ``slopes`` also the states' gradient."""
    group = target // CLASS
    result, d = _picked(states @ w.group + w.group_bias, group, slopes is not None)
    back = None
    if slopes is not None:
        slopes.group += states.T @ d
        slopes.group_bias += d.sum(axis=0)
        back = d @ w.group.T
    order = np.argsort(group.astype(np.uint8), kind="stable")
    edges = np.searchsorted(group[order], np.arange(CLASSES + 1))
    inside = target % CLASS
    for c in range(CLASSES):
        at = order[edges[c] : edges[c + 1]]
        if not len(at):
            continue
        s = states[at]
        value, d = _picked(s @ w.word[c] + w.word_bias[c], inside[at], slopes is not None)
        result[at] += value
        if slopes is not None:
            slopes.word[c] += s.T @ d
            slopes.word_bias[c] += d.sum(axis=0)
            back[at] += d @ w.word[c].T
    return result, back


def gradients(w: Weights, state: np.ndarray, part: Lanes) -> tuple[Weights, np.ndarray, int]:
    """Of the negative log-likelihood of one window, truncated at its beginning."""
    slopes = Weights(*[np.zeros_like(a) for a in w.arrays()])
    states, kept = forward(w, state, part.given, part.first)
    live = _live(part.owner)
    _, back = outputs(w, states.reshape(-1, HIDDEN)[live], part.target.ravel()[live], slopes)
    from_output = np.zeros_like(states)
    from_output.reshape(-1, HIDDEN)[live] = back
    two = 2 * HIDDEN
    d_inputs = np.zeros((*part.given.shape, 3 * HIDDEN), np.float32)
    d_state = np.zeros_like(state)
    for t in range(len(kept) - 1, -1, -1):
        before, z, r, rs, new = kept[t]
        d_state = d_state + from_output[t]
        d_new = d_state * (1 - z) * (1 - new * new)
        d_z = d_state * (before - new) * z * (1 - z)
        d_rs = d_new @ w.turn[:, two:].T
        d_r = d_rs * before * r * (1 - r)
        gates = np.concatenate([d_z, d_r], axis=1)
        slopes.turn[:, :two] += before.T @ gates
        slopes.turn[:, two:] += rs.T @ d_new
        d_inputs[t, :, :two], d_inputs[t, :, two:] = gates, d_new
        d_state = d_state * z + d_rs * r + gates @ w.turn[:, :two].T
        d_state[part.first[t]] = 0
    ids = part.given.ravel()[live]
    order = np.argsort(ids.astype(np.uint16), kind="stable")
    found, at = np.unique(ids[order], return_index=True)
    slopes.given[found] += np.add.reduceat(d_inputs.reshape(-1, 3 * HIDDEN)[live][order], at, axis=0)
    return slopes, states[-1], len(ids)


class Trainer:
    """Truncated backpropagation with adaptive steps, over lanes of documents."""

    def __init__(self, weights: Weights, rate: float = 0.01):
        self.weights, self.rate, self.step, self.tokens = weights, rate, 0, 0
        self.mean = [np.zeros_like(a) for a in weights.arrays()]
        self.square = [np.zeros_like(a) for a in weights.arrays()]

    def train(self, documents: list[np.ndarray]) -> None:
        """One pass; documents longer than PIECE are learnt in pieces, side by side."""
        documents = [d[i : i + PIECE] for d in documents for i in range(0, len(d), PIECE)]
        laid = lanes(documents)
        state = np.zeros((laid.given.shape[1], HIDDEN), np.float32)
        for lo in range(0, len(laid.given), WINDOW):
            part = laid.window(lo, WINDOW)
            slopes, state, n = gradients(self.weights, state[: part.given.shape[1]], part)
            if n:
                self._move(slopes, n)

    def _move(self, slopes: Weights, n: int) -> None:
        self.step += 1
        self.tokens += n
        size = np.sqrt(sum(float((g * g).sum()) for g in slopes.arrays())) / n
        scale = np.float32(min(1.0, 1.0 / (size + 1e-12)) / n)
        rate = np.float32(self.rate * np.sqrt(1 - 0.999**self.step) / (1 - 0.9**self.step))
        for a, g, m, v in zip(self.weights.arrays(), slopes.arrays(), self.mean, self.square):
            g = g * scale
            m += (g - m) * np.float32(0.1)
            v += (g * g - v) * np.float32(0.001)
            a -= rate * m / (np.sqrt(v) + np.float32(1e-8))


def scores(w: Weights, documents: list[np.ndarray]) -> np.ndarray:
    """Natural log-likelihood of each whole document, its state carried across windows."""
    total = np.zeros(len(documents))
    if not documents:
        return total
    laid = lanes(documents)
    state = np.zeros((laid.given.shape[1], HIDDEN), np.float32)
    for lo in range(0, len(laid.given), SCORED_WINDOW):
        part = laid.window(lo, SCORED_WINDOW)
        states, _ = forward(w, state[: part.given.shape[1]], part.given, part.first)
        state = states[-1]
        live = _live(part.owner)
        value, _ = outputs(w, states.reshape(-1, HIDDEN)[live], part.target.ravel()[live])
        total += np.bincount(part.owner.ravel()[live], value.astype(np.float64), len(documents))
    return total
