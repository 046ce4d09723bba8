"""A gated recurrent language model in numpy: truncated backpropagation, class-factored softmax, state kept across windows.

Outputs are factored: a softmax over classes, then one over the words of the class. Frequent words are dealt to classes in
order of frequency; every other token belongs to a tail class, whose inner distribution is not part of the network (its
words are scored by their counts). Inputs are frequent words, or buckets of their last letters for other tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

HIDDEN = 12
EMBED = 12
#: Steps of a window of truncated backpropagation.
WINDOW = 16
#: A short stream has fewer lanes, so that it still makes about so many updates.
UPDATES = 100


def shapes(n_inputs: int, n_classes: int, n_words: int, per_class: int) -> dict[str, tuple[int, ...]]:
    inner = -(-n_words // per_class) if per_class else 0
    return {
        "embed": (n_inputs, EMBED),
        "w": (EMBED, 3 * HIDDEN),
        "u": (HIDDEN, 3 * HIDDEN),
        "b": (3 * HIDDEN,),
        "out": (HIDDEN + 1, n_classes),
        "inner": (inner, HIDDEN + 1, per_class),
    }


def start(sizes: dict[str, tuple[int, ...]], seed: int = 0) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    out = {}
    for name, shape in sizes.items():
        out[name] = np.zeros(shape, np.float32) if name == "b" else (rng.standard_normal(shape) * (0.3 if name in "wu" else 0.1)).astype(np.float32)
    return out


def flat(params: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([params[k].ravel() for k in sorted(params)])


def unflat(x: np.ndarray, sizes: dict[str, tuple[int, ...]]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(sizes):
        n = int(np.prod(sizes[k]))
        out[k] = x[at : at + n].reshape(sizes[k]).astype(np.float32)
        at += n
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _exp(x: np.ndarray) -> np.ndarray:
    """exp of logits in place, less the row's largest where numbers might overflow."""
    if x.size and (x.max() > 60 or x.min() < -60):
        x -= x.max(axis=1, keepdims=True)
    return np.exp(x, out=x)


def _totals(x: np.ndarray) -> np.ndarray:
    return x @ np.ones(x.shape[1], x.dtype)


class Model:
    """Gates are kept apart, so that every array of a step is contiguous."""

    def __init__(self, params: dict[str, np.ndarray]) -> None:
        self.p = params
        self.per_class = params["inner"].shape[2]
        self.u = [np.ascontiguousarray(x) for x in np.split(params["u"], 3, axis=1)]

    def states(self, inputs: np.ndarray, opens: np.ndarray, h: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """States after each step; inputs and opens: (steps, lanes); a lane's state is cleared where a text opens."""
        p, steps = self.p, len(inputs)
        gz, gr, gn = (np.ascontiguousarray(x) for x in np.split(p["embed"] @ p["w"] + p["b"], 3, axis=1))
        uz, ur, un = self.u
        clears = [np.flatnonzero(o) for o in opens]
        out, saved = np.empty((steps, len(h), HIDDEN), h.dtype), []
        for t in range(steps):
            if len(clears[t]):
                h = h.copy()
                h[clears[t]] = 0
            ids = inputs[t]
            z, r, hn = h @ uz, h @ ur, h @ un
            z += gz[ids]
            r += gr[ids]
            z, r = _sigmoid(z), _sigmoid(r)
            n = r * hn
            n += gn[ids]
            np.tanh(n, out=n)
            new = np.subtract(h, n, out=out[t])
            new *= z
            new += n
            if keep:
                saved.append((h, z, r, n, hn))
            h = new
        return out, saved

    def by_class(self, words: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """The rows of the frequent words, class by class. Small integers are sorted by radix."""
        frequent = np.flatnonzero(words >= 0)
        own = (words[frequent] // max(self.per_class, 1)).astype(np.int16)
        order = np.argsort(own, kind="stable")
        sizes = np.bincount(own, minlength=1)
        stops = np.cumsum(sizes)
        for k in np.flatnonzero(sizes).tolist():
            yield k, frequent[order[stops[k] - sizes[k] : stops[k]]]

    def log_probabilities(self, h: np.ndarray, classes: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Natural log-probability of each class, and of the word in it where words >= 0."""
        p = self.p
        x = _exp(h @ p["out"][:-1] + p["out"][-1])
        total = np.log((x[np.arange(len(h)), classes] / _totals(x)).astype(np.float64))
        for k, rows in self.by_class(words):
            m = p["inner"][k]
            x = _exp(h[rows] @ m[:-1] + m[-1])
            total[rows] += np.log((x[np.arange(len(rows)), words[rows] % self.per_class] / _totals(x)).astype(np.float64))
        return total

    def gradients(self, inputs: np.ndarray, opens: np.ndarray, classes: np.ndarray, words: np.ndarray, h0: np.ndarray, real: np.ndarray | None = None) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Mean gradients over the tokens of a window (those where ``real``, if given), and the last state."""
        p, (steps, lanes) = self.p, inputs.shape
        hs, saved = self.states(inputs, opens, h0, keep=True)
        size = steps * lanes
        h, c, w = hs.reshape(size, HIDDEN), classes.reshape(size), words.reshape(size)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        x = _exp(h @ p["out"][:-1] + p["out"][-1])
        x *= (1 / _totals(x))[:, None]
        x[np.arange(size), c] -= 1
        if real is not None:
            x[~real.reshape(size)] = 0
        g["out"][:-1], g["out"][-1] = h.T @ x, np.ones(size, x.dtype) @ x
        dh = x @ p["out"][:-1].T
        for k, rows in self.by_class(w):
            m, own = p["inner"][k], h[rows]
            x = _exp(own @ m[:-1] + m[-1])
            x *= (1 / _totals(x))[:, None]
            x[np.arange(len(rows)), w[rows] % self.per_class] -= 1
            g["inner"][k, :-1], g["inner"][k, -1] = own.T @ x, np.ones(len(rows), x.dtype) @ x
            dh[rows] += x @ m[:-1].T
        dh = dh.reshape(steps, lanes, HIDDEN)
        uz, ur, un = (np.ascontiguousarray(u.T) for u in self.u)
        later = np.zeros_like(h0)
        dz, dr, dn, dm, before = (np.empty((steps, lanes, HIDDEN), h.dtype) for _ in range(5))
        for t in range(steps - 1, -1, -1):
            old, z, r, n, hn = saved[t]
            d = dh[t] + later
            dz_, dr_, dn_, dm_ = dz[t], dr[t], dn[t], dm[t]
            rest = 1 - z
            np.multiply(d, rest, out=dn_)
            dn_ *= 1 - n * n
            np.subtract(old, n, out=dz_)
            dz_ *= d
            dz_ *= z
            dz_ *= rest
            np.multiply(dn_, r, out=dm_)
            np.multiply(dm_, hn, out=dr_)
            dr_ *= 1 - r
            before[t] = old
            later = d * z
            later += dz_ @ uz
            later += dr_ @ ur
            later += dm_ @ un
            later[np.flatnonzero(opens[t])] = 0
        dz, dr, dn, dm, before = (x.reshape(size, HIDDEN) for x in (dz, dr, dn, dm, before))
        g["u"][:] = np.concatenate([before.T @ dz, before.T @ dr, before.T @ dm], axis=1)
        dgates = np.concatenate([dz, dr, dn], axis=1)
        ids = inputs.reshape(size)
        g["b"] = np.ones(size, dgates.dtype) @ dgates
        order = np.argsort(ids.astype(np.int16), kind="stable")  # a radix sort: inputs are far fewer than 2**15
        first = np.flatnonzero(np.concatenate([[True], ids[order][1:] != ids[order][:-1]]))
        by_input, seen = np.add.reduceat(dgates[order], first, axis=0), ids[order][first]
        g["w"] = p["embed"][seen].T @ by_input
        g["embed"][seen] = by_input @ p["w"].T
        for v in g.values():
            v /= size if real is None else max(1, int(real.sum()))
        return g, hs[-1]


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float) -> None:
        self.p, self.rate, self.n = params, rate, 0
        self.m, self.v = {k: np.zeros_like(x) for k, x in params.items()}, {k: np.zeros_like(x) for k, x in params.items()}

    def step(self, g: dict[str, np.ndarray]) -> None:
        self.n += 1
        rate = self.rate * np.sqrt(1 - 0.999**self.n) / (1 - 0.9**self.n)
        for k, x in g.items():
            self.m[k] += 0.1 * (x - self.m[k])
            self.v[k] += 0.001 * (x * x - self.v[k])
            self.p[k] -= (rate * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)).astype(np.float32)


def train(params: dict[str, np.ndarray], inputs: np.ndarray, opens: np.ndarray, classes: np.ndarray, words: np.ndarray, rate: float, lanes: int = 256) -> None:
    """One pass over a stream of tokens, cut into lanes of equal length, windows in order with the state carried."""
    n = len(inputs)
    lanes = max(1, min(lanes, n // (UPDATES * WINDOW)))
    steps = -(-n // lanes)

    def laid(x: np.ndarray, fill: int) -> np.ndarray:
        return np.concatenate([x, np.full(lanes * steps - n, fill, x.dtype)]).reshape(lanes, steps).T.copy()

    x, o, c, w = laid(inputs, 0), laid(opens, True), laid(classes, 0), laid(words, -1)
    real = laid(np.ones(n, bool), False) if lanes * steps > n else None  # what fills the lanes up isn't trained on
    adam = Adam(params, rate)
    h = np.zeros((lanes, HIDDEN), np.float32)
    for at in range(0, steps, WINDOW):
        part = slice(at, at + WINDOW)
        g, h = Model(params).gradients(x[part], o[part], c[part], w[part], h, None if real is None else real[part])
        adam.step(g)


def score(params: dict[str, np.ndarray], lengths: np.ndarray, inputs: np.ndarray, classes: np.ndarray, words: np.ndarray, most_lanes: int = 384) -> np.ndarray:
    """Natural log-probability of each text; the texts' tokens are laid end to end. The state is carried through a whole text."""
    from heapq import heapify, heapreplace

    total = np.zeros(len(lengths))
    size = int(lengths.sum())
    if not size:
        return total
    lanes = int(max(1, min(most_lanes, len(lengths), size // max(1, int(lengths.max())) + 1)))
    starts = np.cumsum(lengths) - lengths
    loads = [(0, k) for k in range(lanes)]
    heapify(loads)
    places: list[list[int]] = [[] for _ in range(lanes)]
    for i in np.argsort(-lengths, kind="stable").tolist():  # the longest first, to the lane with the least
        load, k = loads[0]
        places[k].append(i)
        heapreplace(loads, (load + int(lengths[i]), k))
    steps = max(load for load, _ in loads)
    index = np.full((lanes, steps), -1, np.int32)
    opens = np.zeros((lanes, steps), bool)
    owner = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    for k, own in enumerate(places):
        at = 0
        for i in own:
            if n := int(lengths[i]):
                index[k, at : at + n] = np.arange(starts[i], starts[i] + n, dtype=np.int32)
                opens[k, at] = True
                at += n
    model, h = Model(params), np.zeros((lanes, HIDDEN), np.float32)
    span = max(WINDOW, (1 << 16) // lanes)
    for at in range(0, steps, span):
        part, o = index[:, at : at + span].T.copy(), opens[:, at : at + span].T.copy()
        real = part >= 0
        hs, _ = model.states(np.where(real, inputs[part], 0), o, h)
        h = hs[-1]
        where = part[real]
        total += np.bincount(owner[where], model.log_probabilities(hs[real], classes[where], words[where]), len(lengths))
    return total
