"""A causal self-attention model of subword ids, trained and applied in numpy.

Ids are predicted in steps: the model gives the group and the class in it, the corpus the id in the
class. The most frequent ids are classes of their own, the others share classes of about equal mass.
Classes lie in groups of GROUP, apart by whether they end a word, so each target needs the logits of
the groups and of one group's classes only. One layer: shared embeddings, one head with a learned
bias for each distance, a residual, a hidden layer, the logits. The logits start from the logarithm of how often
each class follows the class before it in the whole corpus (`Prior`), so the layer learns what attention adds to that.
"""

from __future__ import annotations

import numpy as np

DIM = 24
HIDDEN = 48
SINGLES = 992
SHARED = 32
GROUP = 32
INPUTS = 1024
STRIDE = 48
CONTEXT = 16

#: Windows a step of a pass over the corpus. A pass takes every window, and every target of each.
TOGETHER = 256

#: Windows of a step that are worked on at a time, so that their numbers stay near the processor.
PART = 128

#: Steps in which a pass comes up to its rate, as its moments begin anew.
SLOW = 30

#: Counts that the corpus's own odds of the classes add to those after each class.
SMOOTH = 100.0


class Vocabulary:
    """Classes and input rows of ids 0 .. size (size: the end), from the corpus's counts of them."""

    def __init__(self, counts: np.ndarray, ends_word: np.ndarray, singles: int = SINGLES, shared: int = SHARED, inputs: int = INPUTS):
        n = len(counts)
        smooth = counts.astype(float) + 1
        order = np.lexsort((np.arange(n), -smooth))
        order = np.r_[n - 1, order[order != n - 1]]
        self.classes = min(singles, n) + (shared if n > singles else 0)
        of = np.empty(n, np.int32)
        alone = order[:singles]
        of[alone[np.lexsort((np.arange(len(alone)), ends_word[alone]))]] = np.arange(len(alone))
        rest = order[singles:]
        if len(rest):
            rest = rest[np.lexsort((np.arange(len(rest)), ends_word[rest]))]
            mass = np.cumsum(smooth[rest])
            of[rest] = singles + np.minimum(shared - 1, (shared * (mass - smooth[rest]) / mass[-1]).astype(int))
        self.of = of
        self.inner = (np.log(smooth) - np.log(np.bincount(of, smooth, self.classes))[of]).astype(np.float32)
        self.row = (of + inputs).astype(np.int32)
        own = order[:inputs]
        self.row[own] = np.arange(len(own))
        self.rows = inputs + self.classes + 1
        self.begin = self.rows - 1


class Prior:
    """Logarithms of the odds of the groups, and of the classes in a group, after each class (the last row: at the beginning), from counts of both together."""

    def __init__(self, counts: np.ndarray, group: int = GROUP, smooth: float = SMOOTH):
        rows, n = counts.shape
        groups = -(-n // group)
        alone = counts.sum(axis=0) + 1.0
        odds = (counts + smooth * alone / alone.sum()) / (counts.sum(axis=1, keepdims=True) + smooth)
        padded = np.zeros((rows, groups * group))
        padded[:, :n] = odds
        padded = padded.reshape(rows, groups, group)
        each = padded.sum(axis=2)
        self.group = np.log(each).astype(np.float32)
        with np.errstate(divide="ignore"):
            self.inner = np.maximum(np.log(padded / each[:, :, None]), -1e9).astype(np.float32)


def pairs_of(ids: np.ndarray, lengths: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """Class before, and class, of all places, as one number."""
    of = vocabulary.of[ids].astype(np.int64)
    return before_of(ids, lengths, vocabulary).astype(np.int64) * vocabulary.classes + of


def before_of(ids: np.ndarray, lengths: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """The class before each place; at the beginning of a sequence, one more than the last class."""
    of = vocabulary.of[ids]
    before = np.r_[0, of[:-1]] if len(of) else of.copy()
    starts = np.cumsum(lengths) - lengths
    before[starts[lengths > 0]] = vocabulary.classes
    return before.astype(np.int32)


class Windows:
    """Sequences cut so that each target is scored once: STRIDE targets, and CONTEXT inputs before them."""

    def __init__(self, lengths: np.ndarray, stride: int = STRIDE, context: int = CONTEXT):
        per = -(-lengths // stride)
        self.doc = np.repeat(np.arange(len(lengths)), per)
        start = np.cumsum(lengths) - lengths
        k = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)
        self.first = (k == 0).astype(np.intp)
        self.base = start[self.doc] + k * stride
        self.left = np.minimum(stride, lengths[self.doc] - k * stride)

    def __len__(self) -> int:
        return len(self.doc)


class Model:
    def __init__(self, rows: int, classes: int, dim: int = DIM, hidden: int = HIDDEN, stride: int = STRIDE, context: int = CONTEXT, group: int = GROUP, seed: int = 0):
        r = np.random.default_rng(seed)
        self.stride, self.context, self.group = stride, context, group
        groups = -(-classes // group)
        shape = {"e": (rows, dim), "q": (dim, dim), "k": (dim, dim), "v": (dim, dim), "o": (dim, dim), "w1": (dim, hidden), "b1": (hidden,), "w2": (hidden, dim), "g": (dim, groups), "bg": (groups,), "c": (groups, dim, group), "bc": (groups, group), "far": (stride + context,)}
        scale = {"e": 0.3, "b1": 0, "bg": 0, "bc": 0, "far": 0, "o": 0.1, "w2": 0.1, "g": 0.05, "c": 0.05}
        self.p = {k: (r.standard_normal(s) * scale.get(k, 1 / np.sqrt(s[0]))).astype(np.float32) for k, s in shape.items()}
        at = np.arange(stride)[:, None] + context - np.arange(stride + context)[None]
        self.distance = np.maximum(at, 0)
        later = np.where(at < 0, np.float32(-1e9), np.float32(0))
        self.masks = np.stack([later, np.where(np.arange(stride + context)[None] < context, np.float32(-1e9), later)])

    def flat(self) -> np.ndarray:
        """All weights, one behind the other."""
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)])

    def load(self, weights: np.ndarray) -> None:
        at = 0
        for k in sorted(self.p):
            n = self.p[k].size
            self.p[k] = weights[at : at + n].reshape(self.p[k].shape).astype(np.float32)
            at += n

    def _tables(self) -> tuple[np.ndarray, ...]:
        """Products of the embeddings with the layer's matrices: what asks, and what is asked, a column of ones beside the values; and the biases below their weights."""
        p, d = self.p, self.p["q"].shape[0]
        query = np.hstack([p["e"] @ p["q"] / np.sqrt(d).astype(p["e"].dtype), p["e"]])
        key = np.hstack([p["e"] @ p["k"], p["e"] @ (p["v"] @ p["o"]), np.ones((len(p["e"]), 1), p["e"].dtype)])
        return query, key, self.masks[0] + p["far"][self.distance], np.vstack([p["w1"], p["b1"]])

    def hidden(self, u: np.ndarray, first: np.ndarray, begin: int = 0, many: int | None = None, tables: tuple | None = None):
        """What the layer makes of `many` (all: without it) of the last `stride` inputs of each window from `begin` on, and the steps to it. u: (windows, context + stride) input rows.

        Attention is left as exponentials beside their sums. They are taken as they are; where one overflows, or all vanish, again with the
        greatest taken off.
        """
        query, key, far, into = tables or self._tables()
        many, d, context = self.stride - begin if many is None else many, query.shape[1] // 2, self.context
        ask, held = query.take(u[:, context + begin : context + begin + many], axis=0), key.take(u[:, : context + begin + many], axis=0)
        fresh, far = np.flatnonzero(first), far[begin : begin + many]
        # the first half of a window's targets sees none of its last inputs
        halves = [(i, j, context + begin + j) for i, j in ((0, many // 2), (many // 2, many)) if i < j]
        mixed = np.empty((*ask.shape[:2], d + 1), key.dtype)
        for safe in (False, True):
            weights = []
            for i, j, seen in halves:
                a = ask[:, i:j, :d] @ held[:, :seen, :d].transpose(0, 2, 1)
                a += far[i:j, :seen]
                a[fresh, :, :context] = -1e9
                if safe:
                    a -= a.max(axis=2, keepdims=True)
                with np.errstate(all="ignore"):
                    np.exp(a, out=a)
                    mixed[:, i:j] = a @ held[:, :seen, d:]
                weights.append(a)
            if np.isfinite(mixed[:, :, d]).all() and mixed[:, :, d].min(initial=1) > 1e-30:
                break
        total = mixed[:, :, d:].copy()
        mixed /= total
        h = mixed.copy()
        h[:, :, :d] += ask[:, :, d:]
        z = h.reshape(-1, d + 1) @ into
        np.maximum(z, 0, out=z)
        f = z @ self.p["w2"]
        f += h.reshape(-1, d + 1)[:, :d]
        return f.reshape(ask.shape[0], many, d), (ask, held, halves, weights, total, mixed[:, :, :d], h.reshape(-1, d + 1), z)

    def step(self, prior: Prior, u: np.ndarray, first: np.ndarray, before: np.ndarray, target: np.ndarray, live: np.ndarray, begin: int = 0) -> tuple[float, dict]:
        """Mean loss over the live targets, and its gradient. before, target, live: (windows, many) of the targets from `begin` on.

        PART windows are worked on at a time. Gradients are summed by input row before they go through the layer's matrices.
        """
        p, d, many, kind = self.p, self.p["q"].shape[0], target.shape[1], self.p["e"].dtype
        u = u[:, : self.context + begin + many]
        tail, tables = u[:, self.context + begin :], self._tables()
        group, classes = np.vstack([p["g"], p["bg"]]), np.concatenate([p["c"], p["bc"][:, None]], axis=1)
        w1, w2 = np.ascontiguousarray(p["w1"].T), np.ascontiguousarray(p["w2"].T)
        n = max(1, int(live.sum()))
        loss, scale = 0.0, np.float32(1 / n)
        grad = {"c": np.zeros_like(classes), "g": np.zeros_like(group), "w1": np.zeros((d + 1, w2.shape[1]), kind), "w2": np.zeros_like(p["w2"])}
        by_query, by_key, by_far = np.empty((*tail.shape, 2 * d), kind), np.empty((*u.shape, 2 * d), kind), np.zeros((many, u.shape[1]), kind)
        for at in range(0, len(u), PART):
            some = slice(at, at + PART)
            f, (ask, held, halves, weights, total, mixed, h, z) = self.hidden(u[some], first[some], begin, many, tables)
            lost, back, by_group, by_class = _outputs(f.reshape(-1, d), group, classes, prior, before[some], target[some], live[some], self.group, scale)
            loss += lost
            grad["g"] += by_group
            grad["c"] += by_class
            grad["w2"] += z.T @ back
            dz = back @ w2
            dz *= z > 0
            grad["w1"] += h.T @ dz
            back += dz @ w1
            dh = back.reshape(f.shape)
            by_query[some, :, d:] = dh
            dh = dh / total
            even = np.einsum("wij,wij->wi", dh, mixed)[:, :, None]
            for a, (i, j, seen) in reversed(list(zip(weights, halves, strict=True))):
                ds = dh[:, i:j] @ held[:, :seen, d : 2 * d].transpose(0, 2, 1)
                ds -= even[:, i:j]
                ds *= a
                by_far[i:j, :seen] += ds.sum(axis=0)
                by_query[some, i:j, :d] = ds @ held[:, :seen, :d]
                to_key, to_value = ds.transpose(0, 2, 1) @ ask[:, i:j, :d], a.transpose(0, 2, 1) @ dh[:, i:j]
                if j == many:
                    by_key[some, :, :d], by_key[some, :, d:] = to_key, to_value
                else:
                    by_key[some, :seen, :d] += to_key
                    by_key[some, :seen, d:] += to_value
        grad["far"] = np.bincount(self.distance[begin : begin + many, : u.shape[1]].ravel(), by_far.ravel(), len(p["far"])).astype(kind)
        asks, keys = (_sum_rows(rows.ravel(), x.reshape(-1, 2 * d), len(p["e"])) for rows, x in ((tail, by_query), (u, by_key)))
        asked, weighed = asks[:, :d] / np.sqrt(d).astype(kind), p["e"].T @ keys[:, d:]
        grad |= {"q": p["e"].T @ asked, "k": p["e"].T @ keys[:, :d], "v": weighed @ p["o"].T, "o": p["v"].T @ weighed}
        grad["e"] = asks[:, d:] + asked @ p["q"].T + keys[:, :d] @ p["k"].T + keys[:, d:] @ (p["v"] @ p["o"]).T
        for k, bias in (("w1", "b1"), ("g", "bg")):
            grad[k], grad[bias] = grad[k][:-1], grad[k][-1]
        grad["c"], grad["bc"] = grad["c"][:, :-1], grad["c"][:, -1]
        return float(loss / n), grad


def _outputs(f: np.ndarray, group: np.ndarray, classes: np.ndarray, prior: Prior, before: np.ndarray, target: np.ndarray, live: np.ndarray, size: int, scale: np.float32) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """The sum of the live targets' losses, and `scale` times its gradients: by the layer's values f, by the groups' weights and by the classes', whose last row is the biases."""
    at = np.flatnonzero(live)
    # targets of one group lie together
    at = at[np.argsort((target.ravel()[at] // size).astype(np.int16), kind="stable")]
    of, place = np.divmod(target.ravel()[at], size)
    was, every = before.ravel()[at].astype(np.intp), np.arange(len(at))
    own = np.ones((len(at), f.shape[1] + 1), f.dtype)
    own[:, :-1] = f.take(at, axis=0)
    cuts = np.searchsorted(of, np.arange(len(classes) + 1)).tolist()
    parts = [(i, x, y) for i, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if x < y]
    odds = own @ group
    odds += prior.group.take(was, axis=0)
    inner = np.empty((len(at), prior.inner.shape[2]), f.dtype)
    for i, x, y in parts:
        np.matmul(own[x:y], classes[i], out=inner[x:y])
    inner += prior.inner.reshape(-1, inner.shape[1]).take(was * prior.inner.shape[1] + of, axis=0)
    loss = 0.0
    for x, hit in ((odds, of), (inner, place)):
        total = _exponentials(x)
        loss -= np.log(x[every, hit] / total + 1e-9).sum()
        x *= (scale / total)[:, None]
        x[every, hit] -= scale
    by_class, back = np.zeros_like(classes), odds @ np.ascontiguousarray(group[:-1].T)
    turned = np.ascontiguousarray(classes[:, :-1].transpose(0, 2, 1))
    for i, x, y in parts:
        np.matmul(own[x:y].T, inner[x:y], out=by_class[i])
        back[x:y] += inner[x:y] @ turned[i]
    out = np.zeros_like(f)
    out[at] = back
    return loss, out, own.T @ odds, by_class


#: Rows whose sums one product makes.
_TOGETHER = 16


def _sum_rows(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """The sums of the values of equal rows, for rows 0 .. n - 1: products of which row each value is of, a few rows at a time, with the values."""
    out = np.zeros((-(-n // _TOGETHER), _TOGETHER, values.shape[1]), values.dtype)
    block = rows // _TOGETHER
    order = np.argsort(block.astype(np.uint16) if n <= 1 << 16 else block, kind="stable")  # two bytes are sorted by radix
    is_of = np.zeros((len(rows), _TOGETHER), values.dtype)
    is_of.ravel()[np.arange(0, is_of.size, _TOGETHER) + rows[order] % _TOGETHER] = 1
    values = values.take(order, axis=0)
    cuts = np.searchsorted(block[order], np.arange(len(out) + 1)).tolist()
    for i, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if x < y:
            out[i] = is_of[x:y].T @ values[x:y]
    return out.reshape(-1, values.shape[1])[:n]


def _exponentials(x: np.ndarray) -> np.ndarray:
    """In place; their sums over the last axis. The greatest is taken off first where one could overflow, or all vanish."""
    if x.max(initial=0) > 80 or x[:, 0].min(initial=0) < -60:
        x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    return x @ np.ones(x.shape[1], x.dtype)


def inputs_of(ids: np.ndarray, lengths: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """Input rows: the beginning, then each sequence's ids but the last."""
    rows = vocabulary.row[ids]
    rows = np.r_[0, rows[:-1]] if len(rows) else rows
    starts = np.cumsum(lengths) - lengths
    rows[starts[lengths > 0]] = vocabulary.begin
    return rows.astype(np.int32)


def _gather(w: Windows, some: np.ndarray, stride: int, context: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    at = w.base[some][:, None] + np.arange(-context, stride)
    return np.clip(at, 0, max(0, n - 1)), w.base[some][:, None] + np.arange(stride)


class Adam:
    """Steps down the gradient."""

    def __init__(self, model: Model):
        self.model, self.t = model, 0
        self.m, self.s = ({k: np.zeros_like(v) for k, v in model.p.items()} for _ in range(2))

    def step(self, grad: dict, rate: float) -> None:
        self.t += 1
        a, b = np.float32(1 - 0.9**self.t), np.float32(1 - 0.995**self.t)
        for k, x in grad.items():
            self.m[k] += np.float32(0.1) * (x - self.m[k])
            self.s[k] += np.float32(0.005) * (x * x - self.s[k])
            self.model.p[k] -= np.float32(rate) * (self.m[k] / a) / (np.sqrt(self.s[k] / b) + np.float32(1e-8))


class Places:
    """Sequences as windows, ready to be cut into training steps."""

    def __init__(self, model: Model, ids: np.ndarray, lengths: np.ndarray, vocabulary: Vocabulary):
        self.model, self.n = model, len(ids)
        self.windows = Windows(lengths, model.stride, model.context)
        self.rows, self.target, self.before = inputs_of(ids, lengths, vocabulary), vocabulary.of[ids], before_of(ids, lengths, vocabulary)

    def cut(self, some: np.ndarray, begin: int, many: int) -> tuple:
        w, model = self.windows, self.model
        u, y = _gather(w, some, model.stride, model.context, self.n)
        y = np.minimum(y, self.n - 1)[:, begin : begin + many]
        live = np.arange(begin, begin + many) < w.left[some][:, None]
        return self.rows[u], w.first[some], self.before[y], self.target[y], live, begin


def train(ids: np.ndarray, lengths: np.ndarray, vocabulary: Vocabulary, prior: Prior, steps: int = 500, batch: int = 48, rate: float = 0.01, seed: int = 1, **shape) -> Model:
    """A model fitted to random windows of sequences by Adam, in at most `steps` steps and no more than see each window about three times; their ends count as targets."""
    model = Model(vocabulary.rows, vocabulary.classes, **shape)
    places, adam, r = Places(model, ids, lengths, vocabulary), Adam(model), np.random.default_rng(seed)
    steps = min(steps, 3 * -(-len(places.windows) // batch))
    for t in range(1, steps + 1):
        some = r.integers(0, len(places.windows), batch)
        _, g = model.step(prior, *places.cut(some, 0, model.stride))
        adam.step(g, rate * min(1, t / 50) * (1 - 0.95 * t / steps))
    return model


def learn(model: Model, adam: Adam, ids: np.ndarray, lengths: np.ndarray, vocabulary: Vocabulary, prior: Prior, rate: float, r: np.random.Generator, many: int = STRIDE, together: int = TOGETHER, apart: int = 1) -> tuple[float, int]:
    """One pass over sequences, in a random order of their windows: the sum of the losses, and the targets. It takes every window, and every target of each.
    apart: of each sequence every `apart`-th window from a random one on, at least one; many: so many targets of each from a place that each step draws."""
    places = Places(model, ids, lengths, vocabulary)
    per = -(-lengths // model.stride)
    first = (r.random(len(per)) * np.minimum(apart, per)).astype(np.int64)
    nth = np.arange(len(places.windows)) - np.repeat(np.cumsum(per) - per, per)
    order, total, seen = r.permutation(np.flatnonzero((nth - np.repeat(first, per)) % apart == 0)), 0.0, 0
    many = min(many, model.stride)
    for at in range(0, len(order), together):
        some = order[at : at + together]
        # a place that the shorter windows of a step do not reach has no targets there
        begin = int(r.integers(0, -(-int(places.windows.left[some].max()) // many))) * many
        cut = places.cut(some, min(begin, model.stride - many), many)
        n = int(cut[4].sum())
        if n:
            loss, g = model.step(prior, *cut)
            adam.step(g, rate * min(1, (adam.t + 1) / SLOW))
            total, seen = total + loss * n, seen + n
    return total, seen


def log_probabilities(model: Model, ids: np.ndarray, lengths: np.ndarray, vocabulary: Vocabulary, prior: Prior, batch: int = 256) -> np.ndarray:
    """The natural log probability of each sequence, ends included, all targets scored once in overlapping windows.

    Products of the embeddings with the layer's matrices are made once per call. Exponentials are
    taken as they are; where one overflows, the batch is done again with its greatest taken off.
    """
    out = np.zeros(len(lengths))
    w = Windows(lengths, model.stride, model.context)
    rows, target = inputs_of(ids, lengths, vocabulary), vocabulary.of[ids]
    inner, before = vocabulary.inner[ids], before_of(ids, lengths, vocabulary)
    of, place = (target // model.group).astype(np.int16), target % model.group
    p, context, d = model.p, model.context, model.p["q"].shape[0]
    query, key, far, into = model._tables()
    group_prior, inner_prior = prior.group + p["bg"], np.ascontiguousarray((prior.inner + p["bc"]).transpose(1, 0, 2))

    def log_odds(f: np.ndarray, weights: np.ndarray, bias: np.ndarray, at: np.ndarray, safe: bool) -> np.ndarray:
        x = f @ weights
        x += bias
        if safe:
            x -= x.max(axis=1, keepdims=True)
        hit = x.ravel()[np.arange(0, x.size, x.shape[1]) + at]
        np.exp(x, out=x)
        return hit - np.log(x @ np.ones(x.shape[1], np.float32))

    # the first half of a window's targets sees none of its last inputs
    half = model.stride // 2
    halves = [(0, half, context + half), (half, model.stride, context + model.stride)]

    def value(u: np.ndarray, first: np.ndarray, y: np.ndarray, safe: bool) -> np.ndarray:
        ask, held, fresh = query.take(u[:, context:], axis=0), key.take(u, axis=0), np.flatnonzero(first)
        f = np.ones((*ask.shape[:2], d + 1), np.float32)
        for i, j, seen in halves:
            a = ask[:, i:j, :d] @ held[:, :seen, :d].transpose(0, 2, 1)
            a += far[i:j, :seen]
            a[fresh, :, :context] = -1e9
            if safe:
                a -= a.max(axis=2, keepdims=True)
            np.exp(a, out=a)
            h = a @ held[:, :seen, d:]
            np.divide(h[:, :, :d], h[:, :, d:], out=f[:, i:j, :d])
        f[:, :, :d] += ask[:, :, d:]
        f = f.reshape(-1, d + 1)
        z = f @ into
        np.maximum(z, 0, out=z)
        f = f[:, :d] + z @ p["w2"]
        group = of[y]
        order = np.argsort(group, kind="stable")
        f, sorted_place, was = f.take(order, axis=0), place[y[order]], before[y[order]]
        got = log_odds(f, p["g"], group_prior.take(was, axis=0), group[order], safe)
        cuts = np.searchsorted(group[order], np.arange(len(p["bg"]) + 1))
        for g, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            if j > i:
                got[i:j] += log_odds(f[i:j], p["c"][g], inner_prior[g].take(was[i:j], axis=0), sorted_place[i:j], safe)
        back = np.empty(len(y))
        back[order] = got
        return back + inner[y]

    with np.errstate(all="ignore"):
        for i in range(0, len(w), batch):
            some = np.arange(i, min(len(w), i + batch))
            at, y = _gather(w, some, model.stride, context, len(ids))
            u, y = rows[at], np.minimum(y, len(ids) - 1).ravel()
            got = value(u, w.first[some], y, False)
            if not np.isfinite(got).all():
                got = value(u, w.first[some], y, True)
            got = got.reshape(len(some), -1)
            got[np.arange(model.stride) >= w.left[some][:, None]] = 0
            out += np.bincount(w.doc[some], got.sum(axis=1), len(lengths))
    return out
