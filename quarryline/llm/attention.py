"""A causal self-attention model of subwords in numpy: one layer, one head, trained by Adam.

It predicts the next subword from those before it.  Every subword has a symbol: the
``MEMBERS - 1`` most frequent ones of a cluster have one each, the rest of the cluster
share one (``Symbols``).  The inputs are the symbols shifted by one; attention scores get
a learned bias by distance; with one head of full width the key map is part of the
query's, the output map of the value's; the layer's output is added to its input and read out twice,
to the next cluster and, by that cluster's own weights, to the symbol within it; a
subword that shares its symbol has its smoothed share of the symbol's training count.
The three factors are a distribution over all subwords: they sum to 1 after any text.

Subwords that begin a word differ from those that don't, and a text closes with an end
subword, so a word's end is an event of its own: the next subword begins a word or is
the end.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

WINDOW, CONTEXT = 32, 8  # a window scores its last WINDOW - CONTEXT places
STEP = WINDOW - CONTEXT
WIDTH, CLUSTERS, MEMBERS = 16, 32, 64
SYMBOLS = CLUSTERS * MEMBERS
START = SYMBOLS  # stands before a text
SHAPES = {
    "embed": (SYMBOLS + 1, WIDTH),
    "query": (WIDTH, WIDTH),
    "value": (WIDTH, WIDTH),
    "near": (WINDOW,),
    "cluster": (WIDTH, CLUSTERS),
    "cluster_bias": (CLUSTERS,),
    "member": (CLUSTERS, WIDTH, MEMBERS),
    "member_bias": (CLUSTERS, MEMBERS),
}
_ENDS = np.cumsum([np.prod(s) for s in SHAPES.values()]).tolist()
SIZE = _ENDS[-1]
_BACK = np.arange(CONTEXT, WINDOW)[:, None] - np.arange(WINDOW)[None, :]  # how far each key lies behind a scored place
_NEVER = -1e9
_MOST = 60  # attention scores are cut here, so exp stays finite without a shift


@dataclass
class Symbols:
    """Which symbol each subword id has, and log10 of its share of it."""

    of: np.ndarray
    share: np.ndarray

    @classmethod
    def from_counts(cls, cluster: np.ndarray, counts: np.ndarray, smooth: float = 0.1) -> Symbols:
        """The most frequent ids of each cluster get symbols of their own, ties to smaller ids."""
        order = np.lexsort((np.arange(len(counts)), -counts, cluster))
        sizes = np.bincount(cluster, minlength=CLUSTERS)
        nth = np.empty(len(counts), np.int64)
        nth[order] = np.arange(len(counts)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        of = cluster * MEMBERS + np.minimum(nth, MEMBERS - 1)
        mass = counts + smooth
        share = np.log10(mass / np.bincount(of, mass, SYMBOLS)[of])
        return cls(of.astype(np.int16), share.astype(np.float32))

    def there(self) -> np.ndarray:
        """Log-weights that rule out symbols no subword has."""
        return np.where(np.bincount(self.of, minlength=SYMBOLS) > 0, 0, _NEVER).astype(np.float32).reshape(CLUSTERS, MEMBERS)


def initial(symbols: Symbols, counts: np.ndarray, seed: int = 1) -> np.ndarray:
    """Small random weights; the biases begin at the training shares."""
    w = np.random.default_rng(seed).normal(0, 0.1, SIZE).astype(np.float32)
    p = parts(w)
    p["near"][:] = 0
    mass = (np.bincount(symbols.of, counts, SYMBOLS) + 0.5).reshape(CLUSTERS, MEMBERS)
    there = symbols.there()
    mass = np.where(there == 0, mass, 0)
    with np.errstate(divide="ignore"):
        p["cluster_bias"][:] = np.maximum(np.log(mass.sum(axis=1) / mass.sum()), _NEVER)
        p["member_bias"][:] = np.maximum(np.log(mass / np.maximum(mass.sum(axis=1), 1e-30)[:, None]), _NEVER)
    return w


def parts(w: np.ndarray) -> dict[str, np.ndarray]:
    """Views of the flat weights by name."""
    return {name: w[lo:hi].reshape(shape) for (name, shape), lo, hi in zip(SHAPES.items(), [0, *_ENDS], _ENDS, strict=False)}


def windows(lengths: np.ndarray) -> np.ndarray:
    """First place of each window in the texts laid end to end, and its text's bounds.

    Each place of a text is among the last STEP of exactly one window, with up to
    CONTEXT places and more before it.
    """
    starts = np.cumsum(lengths) - lengths
    per = -(-lengths // STEP)
    text = np.repeat(np.arange(len(lengths)), per)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    return np.stack([starts[text] + nth * STEP - CONTEXT, starts[text], starts[text] + lengths[text]], axis=1)


def shifted(symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The symbol before each place of texts laid end to end."""
    before = np.empty(len(symbols), np.int64)
    before[1:] = symbols[:-1]
    before[(np.cumsum(lengths) - lengths)[lengths > 0]] = START
    return before


def _near(p: dict, kind: type) -> np.ndarray:
    return np.where(_BACK >= 0, p["near"][np.maximum(_BACK, 0)], _NEVER).astype(kind)


def _forward(p: dict, before: np.ndarray, window: np.ndarray) -> dict:
    """Hidden states of the places in ``window`` rows; ``a`` holds attention before it is
    divided by ``total``."""
    place = window[:, :1] + np.arange(WINDOW)
    row = before.take(place, mode="clip")
    x = p["embed"].take(row, axis=0)
    own = x[:, CONTEXT:].reshape(-1, WIDTH)
    q = (p["embed"] @ (p["query"] * own.dtype.type(WIDTH**-0.5))).take(row[:, CONTEXT:], axis=0)  # one for each symbol
    a = np.matmul(q, x.transpose(0, 2, 1))
    a += _near(p, a.dtype)
    a[window[:, 0] < window[:, 1], :, :CONTEXT] = _NEVER  # the first window of a text: what it has before the text is masked
    if a.max(initial=0) > _MOST:  # exp stays finite
        np.minimum(a, _MOST, out=a)
    np.exp(a, out=a)
    total = (a.reshape(-1, WINDOW) @ np.ones(WINDOW, a.dtype))[:, None]
    mixed = np.matmul(a, x).reshape(-1, WIDTH)
    mixed /= total
    h = mixed @ p["value"]
    h += own
    scored = np.flatnonzero(place[:, CONTEXT:] < window[:, 2:])
    return {"row": row, "x": x, "own": own, "q": q, "a": a, "total": total, "mixed": mixed, "scored": scored, "h": h, "at": place[:, CONTEXT:].ravel().take(scored)}


def _exp(z: np.ndarray) -> np.ndarray:
    """exp in place, and what was taken off each row before, so that it stays finite."""
    off = np.maximum(z.max(axis=1) - _MOST, 0) if z.max(initial=0) > _MOST else 0
    if np.ndim(off):
        z -= off[:, None]
    np.exp(z, out=z)
    return off


def _read_out(p: dict, h: np.ndarray, goal: np.ndarray, d: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Log-probabilities of goals that are in order of their clusters; with ``d``, which
    takes the weights' gradients of the mean loss, also the gradient of ``h``.

    Biases weigh the sums, and what divides a row scales ``h``: exp(z + b) is exp(z) * exp(b),
    so nothing else runs over all outputs.
    """
    n, cluster, member = len(h), goal // MEMBERS, goal % MEMBERS
    ends = np.cumsum(np.bincount(cluster, minlength=CLUSTERS)).tolist()
    groups = [(c, slice(lo, hi)) for c, (lo, hi) in enumerate(zip([0, *ends[:-1]], ends, strict=True)) if hi > lo]
    share, shares = np.exp(p["cluster_bias"]), np.exp(p["member_bias"])

    y = h @ p["cluster"]
    at = np.arange(0, n * CLUSTERS, CLUSTERS) + cluster
    log = y.ravel().take(at) + p["cluster_bias"].take(cluster)
    log -= _exp(y)
    total = y @ share
    z, total_z = np.empty((n, MEMBERS), h.dtype), np.empty_like(total)
    at_z = np.arange(0, n * MEMBERS, MEMBERS) + member
    for c, own in groups:
        np.matmul(h[own], p["member"][c], out=z[own])
    log += z.ravel().take(at_z) + p["member_bias"].take(goal)
    log -= _exp(z)
    for c, own in groups:
        np.matmul(z[own], shares[c], out=total_z[own])
    log -= np.log(np.maximum(total, 1e-30)) + np.log(np.maximum(total_z, 1e-30))
    if d is None:
        return log, None

    y.ravel()[at] -= total / share.take(cluster)
    z.ravel()[at_z] -= total_z / shares.take(goal)
    scale, scale_z = 1 / (total * h.dtype.type(n)), 1 / (total_z * h.dtype.type(n))
    d["cluster"][:] = (y.T @ (h * scale[:, None])).T * share
    d["cluster_bias"][:] = (scale @ y) * share
    dh, dh_z = y @ (p["cluster"] * share).T, np.empty_like(h)
    dh *= scale[:, None]
    scaled, back = h * scale_z[:, None], (p["member"] * shares[:, None]).transpose(0, 2, 1)
    member_t = np.zeros((CLUSTERS, MEMBERS, WIDTH), h.dtype)
    for c, own in groups:
        part = z[own]
        np.matmul(part.T, scaled[own], out=member_t[c])
        np.matmul(scale_z[own], part, out=d["member_bias"][c])
        np.matmul(part, back[c], out=dh_z[own])
    d["member"][:] = member_t.transpose(0, 2, 1)
    d["member"] *= shares[:, None]
    d["member_bias"] *= shares
    dh_z *= scale_z[:, None]
    dh += dh_z
    return log, dh


def _by_cluster(goal: np.ndarray) -> np.ndarray:
    return np.argsort((goal // MEMBERS).astype(np.uint8), kind="stable")


def log_probabilities(w: np.ndarray, symbols: np.ndarray, lengths: np.ndarray, at_once: int = 768) -> np.ndarray:
    """Natural log of each place's symbol given what stands before it in its text."""
    p, before, window = parts(w), shifted(symbols, lengths), windows(lengths)
    out = np.zeros(len(symbols))
    for lo in range(0, len(window), at_once):
        f = _forward(p, before, window[lo : lo + at_once])
        goal = symbols.take(f["at"])
        order = _by_cluster(goal)
        out[f["at"].take(order)] = _read_out(p, f["h"].take(f["scored"].take(order), axis=0), goal.take(order))[0]
    return out


def gradient(w: np.ndarray, symbols: np.ndarray, before: np.ndarray, window: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean loss over the places the windows score, and its gradient."""
    p = parts(w)
    f = _forward(p, before, window)
    g = np.zeros_like(w)
    d = parts(g)
    goal = symbols.take(f["at"])
    order = _by_cluster(goal)
    place = f["scored"].take(order)
    log, dh = _read_out(p, f["h"].take(place, axis=0), goal.take(order), d)

    x, q, a, mixed = f["x"], f["q"], f["a"], f["mixed"]
    flat = np.zeros((len(window) * STEP, WIDTH), w.dtype)
    flat[place] = dh
    d["value"][:] = mixed.T @ flat
    dmix = flat @ p["value"].T
    dmix /= f["total"]  # a isn't divided by it
    ds = np.matmul(dmix.reshape(q.shape), x.transpose(0, 2, 1))
    ds -= np.einsum("ij,ij->i", dmix, mixed).reshape(-1, STEP, 1)  # the same sum as over ds * a
    ds *= a
    d["near"][:] = np.bincount(np.maximum(_BACK, 0).ravel(), (ds.sum(axis=0) * (_BACK >= 0)).ravel(), WINDOW)
    dq = np.matmul(ds, x).reshape(-1, WIDTH)
    scale = w.dtype.type(WIDTH**-0.5)
    d["query"][:] = (f["own"].T @ dq) * scale
    flat += dq @ (p["query"].T * scale)
    dx = np.matmul(ds.transpose(0, 2, 1), q)
    dx += np.matmul(a.transpose(0, 2, 1), dmix.reshape(q.shape))
    dx[:, CONTEXT:] += flat.reshape(q.shape)
    row, columns = f["row"].ravel(), dx.reshape(-1, WIDTH).T.astype(np.float64, order="C")
    for to, column in zip(d["embed"].T, columns, strict=True):
        to[:] = np.bincount(row, column, SYMBOLS + 1)
    return -float(log.mean()), g


class Trainer:
    """Adam over batch after batch of texts; ``used`` counts the windows learned from."""

    def __init__(self, w: np.ndarray, rate: float):
        self.w, self.rate, self.used, self.steps = w.copy(), rate, 0, 0
        self.m, self.v = np.zeros(SIZE, np.float32), np.zeros(SIZE, np.float32)

    def learn(self, symbols: np.ndarray, lengths: np.ndarray, batch: int = 256, seed: int = 0) -> None:
        """One pass over all windows of the texts, in random order."""
        window, before = windows(lengths), shifted(symbols, lengths)
        use = np.random.default_rng(seed).permutation(len(window))
        for lo in range(0, len(use), batch):
            self._step(gradient(self.w, symbols, before, window[use[lo : lo + batch]])[1])
        self.used += len(use)

    def _step(self, g: np.ndarray) -> None:
        self.steps += 1
        rate = self.rate * np.sqrt(1 - 0.98**self.steps) / (1 - 0.9**self.steps)
        for own in range(0, SIZE, 1 << 13):  # a part stays in the cache until it is done with
            part = slice(own, own + (1 << 13))
            m, v, gp = self.m[part], self.v[part], g[part]
            m += np.float32(0.1) * (gp - m)
            v += np.float32(0.02) * (gp * gp - v)
            self.w[part] -= np.float32(rate) * m / (np.sqrt(v) + np.float32(1e-8))
