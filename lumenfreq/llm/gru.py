"""A gated recurrent language model in numpy, with a class-factored output softmax.

P(word | h) = P(class | h) P(word | class, h).  The most frequent words have ids by falling frequency; the last id
stands for all other words and is a class of its own.  These other words are the leaves of a tree:
P(word | class, h) = P(branch | h) P(next node | branch, h) ... P(leaf | twig, h), so the state has a say in every word.
Their ids follow on the vocabulary's (see Tree).  The input of a word is a row of gate inputs (other words: of their branch), so a
step is one gather and one small product.  Training is backpropagation truncated to windows; the state is carried across windows
and reset where a document begins, in training as in scoring, so a document's log-likelihood covers it whole.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

WINDOW = 16


#: The logarithm of a weight that is none.
NEVER = -60.0


class Tree:
    """Branches, below each `levels` levels of `fan` nodes; nodes of the last but one are twigs, with `fan` + 1 leaves each.

    weights: those of the leaves (twigs x leaves).  Leaf k of twig t has the id words + t * (fan + 1) + k.
    top: the logarithms of the branches' weights.  rows: for each twig those of all nodes below the branch that a way down to
    its leaves chooses from, level by level; the state adds to them.  ways: the columns of the nodes that lead to the twig.
    """

    def __init__(self, branches: int, fan: int, levels: int, weights: np.ndarray):
        self.branches, self.fan, self.levels = branches, fan, levels
        self.below = fan ** (levels - 1)  # twigs of a branch
        self.leaves = self.below * (fan + 1)
        twig = np.arange(branches * self.below)
        nodes, sums = [weights], weights.sum(axis=1)
        for _ in range(levels - 1):
            nodes.append(sums.reshape(-1, fan))
            sums = nodes[-1].sum(axis=1)
        nodes.reverse()  # of each branch, and so on down to each twig
        with np.errstate(divide="ignore"):
            self.top = np.maximum(np.log(sums), NEVER).astype(np.float32)
            self.rows = np.concatenate([np.maximum(np.log(x), NEVER).astype(np.float32).repeat(len(twig) // len(x), axis=0) for x in nodes], axis=1)
        self.ways = np.stack([twig // fan**k % fan + (levels - 2 - k) * fan for k in range(levels - 2, -1, -1)], axis=1) if levels > 1 else np.zeros((len(twig), 0), int)
        self.first_leaf = (levels - 1) * fan
        level = np.minimum(np.arange(self.rows.shape[1]) // fan, levels - 1)
        self.level = (level[:, None] == np.arange(levels)).astype(np.float32)  # columns x levels


@dataclass
class Shape:
    words: int  # with the id of other words, which is words - 1
    hidden: int
    edges: np.ndarray  # class c holds the ids edges[c] to edges[c + 1] - 1
    tree: Tree | None = None

    def parts(self) -> dict[str, tuple[int, ...]]:
        h, c, k = self.hidden, len(self.edges) - 1, self.tree.branches if self.tree else 0
        own = {"x": (self.words + k, 3 * h), "wh": (h, 3 * h), "wc": (h, c), "bc": (c,), "u": (self.words, h), "b": (self.words,)}
        # What the state, and a constant, give the branches, and those of each branch the nodes below it, level by level.
        return own | {"ub": (h + 1, k), "ut": (k, h + 1, self.tree.rows.shape[1])} if k else own

    @functools.cached_property
    def keys(self) -> np.ndarray:
        """By id: the class of a word; the number of classes and the branch of a leaf."""
        own = np.arange(len(self.edges) - 1).repeat(np.diff(self.edges))
        return np.concatenate([own, len(self.edges) - 1 + np.arange(self.tree.branches).repeat(self.tree.leaves)] if self.tree else [own]).astype(np.uint16)

    @functools.cached_property
    def inputs(self) -> np.ndarray:
        """By id: the row of gate inputs."""
        own = np.arange(self.words)
        return np.concatenate([own, self.words + np.arange(self.tree.branches).repeat(self.tree.leaves)] if self.tree else [own]).astype(np.int32)


def classes_of(counts: np.ndarray, classes: int) -> np.ndarray:
    """Borders of classes of falling frequency with about equal sums of square roots; the last id is alone."""
    mass = np.cumsum(np.sqrt(np.maximum(counts[:-1], 1.0)))
    edges = np.searchsorted(mass, mass[-1] * np.arange(1, classes) / classes) + 1 if len(mass) else np.zeros(0, int)
    return np.unique(np.concatenate([[0], edges[edges < len(mass)], [len(mass), len(mass) + 1]]))


def start(shape: Shape, counts: np.ndarray, seed: int = 11) -> np.ndarray:
    """Small random weights, and biases at which the model is the unigram model."""
    rng = np.random.default_rng(seed)
    p = {k: (rng.standard_normal(s) * 0.1).astype(np.float32) for k, s in shape.parts().items()}
    log = np.log(np.maximum(counts, 0.5))
    p["b"] = log.astype(np.float32)
    p["bc"] = np.log(np.maximum(np.add.reduceat(np.maximum(counts, 0.5), shape.edges[:-1]), 0.5)).astype(np.float32)
    p["bc"] -= p["bc"].max()
    if shape.tree:
        p["ub"][-1] = p["ut"][:, -1] = 0
    return flat(p)


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([x.ravel() for x in p.values()])


def unflat(shape: Shape, v: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in shape.parts().items():
        n = int(np.prod(s))
        out[k] = v[at : at + n].reshape(s)
        at += n
    return out


def lanes(docs: list[np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents laid end to end in lanes of about equal length, longest lane first: (targets, document numbers, lane lengths), steps x lanes."""
    n = min(most, len(docs))
    heap = [(0, k) for k in range(n)]
    own: list[list[int]] = [[] for _ in range(n)]
    for d in sorted(range(len(docs)), key=lambda d: -len(docs[d])):
        size, k = heapq.heappop(heap)
        own[k].append(d)
        heapq.heappush(heap, (size + len(docs[d]), k))
    size = np.array([sum(len(docs[d]) for d in o) for o in own])
    order = np.argsort(-size, kind="stable")
    steps = int(size.max())
    target, of = np.zeros((steps, n), np.int32), np.full((steps, n), -1, np.int32)
    for lane, k in enumerate(order):
        at = 0
        for d in own[k]:
            target[at : at + len(docs[d]), lane] = docs[d]
            of[at : at + len(docs[d]), lane] = d
            at += len(docs[d])
    return target, of, size[order]


@dataclass
class Window:
    """What output and backpropagation need of a window: arrays of steps x lanes, or steps x hidden x lanes, so that a step's
    gates are whole rows of lanes; h is hidden x steps x lanes."""

    word: np.ndarray  # the word read at each step
    stay: np.ndarray  # whether the state is carried into it
    before: np.ndarray  # the state carried
    z: np.ndarray
    r: np.ndarray
    c: np.ndarray
    gate: np.ndarray  # what the state gives the candidate, before r
    h: np.ndarray
    target: np.ndarray
    doc: np.ndarray


def _windows(shape: Shape, p: dict[str, np.ndarray], target: np.ndarray, of: np.ndarray, size: np.ndarray, end: int) -> Iterator[Window]:
    """Runs the gates window by window; the state is carried from one to the next."""
    hid = shape.hidden
    h = np.zeros((hid, target.shape[1]), np.float32)
    for t0 in range(0, len(target), WINDOW):
        live = int(np.searchsorted(-size, -t0, side="left"))  # lanes longer than t0
        h, tgt, doc = h[:, :live], target[t0 : t0 + WINDOW, :live], of[t0 : t0 + WINDOW, :live]
        new, word = np.ones(tgt.shape, bool), np.full(tgt.shape, end, np.int32)
        new[1:] = doc[1:] != doc[:-1]
        word[1:] = np.where(new[1:], end, tgt[:-1])
        if t0:
            new[0] = doc[0] != of[t0 - 1, :live]
            word[0] = np.where(new[0], end, target[t0 - 1, :live])
        stay = (~new).astype(np.float32)
        # Both gates are 1 / (1 + exp(-a)): their inputs are turned once for the window.
        gx = np.ascontiguousarray(p["x"].take(word := shape.inputs.take(word), axis=0).transpose(0, 2, 1))
        wh = p["wh"].T.copy()
        np.negative(gx[:, : 2 * hid], out=gx[:, : 2 * hid])
        np.negative(wh[: 2 * hid], out=wh[: 2 * hid])
        before, c, out = (np.empty(x, np.float32) for x in ((len(tgt), hid, live), (len(tgt), hid, live), (hid, len(tgt), live)))
        gh, zr, part = np.empty((len(tgt), 3 * hid, live), np.float32), np.empty((len(tgt), 2 * hid, live), np.float32), np.empty((hid, live), np.float32)
        for k in range(len(tgt)):
            b, g, s, o = before[k], gh[k], zr[k], out[:, k]
            np.multiply(h, stay[k], out=b)
            np.matmul(wh, b, out=g)
            np.add(gx[k, : 2 * hid], g[: 2 * hid], out=s)
            np.exp(s, out=s)
            s += 1
            np.reciprocal(s, out=s)
            np.multiply(s[hid:], g[2 * hid :], out=part)
            part += gx[k, 2 * hid :]
            np.tanh(part, out=c[k])
            np.subtract(b, c[k], out=o)
            o *= s[:hid]
            o += c[k]
            h = o
        yield Window(word, stay, before, zr[:, :hid], zr[:, hid:], c, gh[:, 2 * hid :], out, tgt, doc)


@dataclass
class Outputs:
    """A window's targets in order of class, leaves after the words and in order of branch."""

    at: np.ndarray  # where they are in the window
    target: np.ndarray
    own: np.ndarray  # the states there, with a constant: (hidden + 1) x targets
    classes: list[tuple[int, int, int]]  # class, and where it begins and ends
    branches: list[tuple[int, int, int]]  # as for classes, counted from the first leaf
    words: int  # where the last class begins, which is one id or the leaves
    leaf: int  # where the leaves begin


def _order(x: np.ndarray) -> np.ndarray:
    """A stable order of small numbers, which numpy sorts by their digits if they have two bytes."""
    return np.argsort(x.astype(np.uint16) if len(x) and x.max() < 1 << 16 else x, kind="stable")


def _outputs(shape: Shape, w: Window) -> Outputs:
    at, n = np.flatnonzero(w.doc >= 0), len(shape.edges) - 1
    t = w.target.ravel().take(at)
    key = shape.keys.take(t)
    order = np.argsort(key, kind="stable")
    at = at.take(order)
    own = np.empty((shape.hidden + 1, len(at)), np.float32)
    w.h.reshape(shape.hidden, -1).take(at, axis=1, out=own[:-1], mode="clip")
    own[-1] = 1
    cuts = [0, *np.cumsum(np.bincount(key, minlength=n + (shape.tree.branches if shape.tree else 0))).tolist()]
    classes = [(c, x, y) for c, (x, y) in enumerate(zip(cuts, [*cuts[1:n], len(at)], strict=False)) if y > x]
    branches = [(c, x - cuts[n], y - cuts[n]) for c, (x, y) in enumerate(zip(cuts[n:], cuts[n + 1 :], strict=False)) if y > x]
    return Outputs(at, t.take(order), own, classes, branches, cuts[n - 1], cuts[n])


def _held(a: np.ndarray) -> np.ndarray:
    """The logits of this model are far from the bounds they are held to."""
    return a.clip(-80, 80, out=a)


def _head(p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """What the state, and a constant, give the classes, and the words."""
    return np.vstack([p["wc"], p["bc"]]), np.vstack([p["u"].T, p["b"]])


def _words(shape: Shape, words: np.ndarray, o: Outputs) -> tuple[list[tuple[int, int, int, int, np.ndarray]], np.ndarray, np.ndarray, np.ndarray]:
    """Of the targets that are words: (first and last id, where they begin and end, logits: targets x words) of each class; all
    of these in one flat array; where each target's begin there; and the places of those chosen."""
    own = [(x, y, shape.edges[c], shape.edges[c + 1]) for c, x, y in o.classes if x < o.words]
    width = np.array([hi - lo for _, _, lo, hi in own]).repeat([y - x for x, y, _, _ in own])
    ends = np.cumsum(width)
    flat, groups, used = np.empty(ends[-1], np.float32), [], 0
    for x, y, lo, hi in own:
        a = flat[used : (used := used + (y - x) * (hi - lo))].reshape(y - x, hi - lo)
        np.matmul(o.own[:, x:y].T, words[:, lo:hi], out=a)
        groups.append((lo, hi, x, y, a))
    ends -= width
    return groups, _held(flat), ends, ends + o.target[: o.words] - np.array([lo for _, _, lo, _ in own]).repeat([y - x for x, y, _, _ in own])


def _branches(shape: Shape, p: dict[str, np.ndarray]) -> np.ndarray:
    """What the state, and a constant, give the branches."""
    out = p["ub"].copy()
    out[-1] += shape.tree.top
    return out


def _leaves(shape: Shape, give: np.ndarray, o: Outputs) -> tuple[np.ndarray, np.ndarray]:
    """Of the targets that are leaves: logits of all nodes to choose from below the branch, and the places of those chosen, in the flat array."""
    tree, own = shape.tree, o.own[:, o.leaf :]
    twig, leaf = np.divmod(o.target[o.leaf :] - shape.words, tree.fan + 1)
    a = np.empty((len(twig), tree.rows.shape[1]), np.float32)
    for c, x, y in o.branches:
        np.matmul(own[:, x:y].T, give[c], out=a[x:y])
    a += tree.rows.take(twig, axis=0)
    way = np.empty((len(twig), tree.levels), np.intp)
    way[:, :-1] = tree.ways.take(twig, axis=0)
    way[:, -1] = leaf + tree.first_leaf
    way += np.arange(0, a.size, a.shape[1])[:, None]
    return _held(a), way


def _log_prob(give: np.ndarray, own: np.ndarray, cuts: list[tuple[int, int, int]]) -> np.ndarray:
    """log softmax of what own states give, at the choices in cuts (choice, and where its targets begin and end)."""
    a, out = _held(give.T @ own), np.empty(own.shape[1], np.float32)
    for c, x, y in cuts:
        out[x:y] = a[c, x:y]
    out -= np.log(np.exp(a, out=a).sum(axis=0))
    return out


def _pull(give: np.ndarray, own: np.ndarray, cuts: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The gradients of -_log_prob() by give and by the states."""
    a = _held(give.T @ own)
    total = np.exp(a, out=a).sum(axis=0)
    for c, x, y in cuts:
        a[c, x:y] -= total[x:y]
    np.reciprocal(total, out=total)
    by_state = give[:-1] @ a
    by_state *= total
    return (a @ (own * total).T).T, by_state


def score(shape: Shape, v: np.ndarray, docs: list[np.ndarray], end: int, most: int = 512) -> np.ndarray:
    """Natural log-likelihood of each document (arrays of ids, each ending with the end token)."""
    out = np.zeros(len(docs))
    if not docs:
        return out
    p = unflat(shape, v)
    target, of, size = lanes(docs, most)
    classes, words = _head(p)
    for w in _windows(shape, p, target, of, size, end):
        o = _outputs(shape, w)
        lp = _log_prob(classes, o.own, o.classes)
        if o.words:
            _, a, starts, chosen = _words(shape, words, o)
            lp[: o.words] += a.take(chosen)
            lp[: o.words] -= np.log(np.add.reduceat(np.exp(a, out=a), starts))
        if o.branches:
            lp[o.leaf :] += _log_prob(_branches(shape, p), o.own[:, o.leaf :], o.branches)
            a, way = _leaves(shape, p["ut"], o)
            lp[o.leaf :] += a.ravel().take(way).sum(axis=1)
            lp[o.leaf :] -= np.log(np.exp(a, out=a) @ shape.tree.level).sum(axis=1)
        out += np.bincount(w.doc.ravel().take(o.at), weights=lp, minlength=len(docs))
    return out


def _add_rows(g: np.ndarray, at: np.ndarray, x: np.ndarray) -> None:
    o = _order(at)
    rows = at.take(o)
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    g[rows[first]] += np.add.reduceat(x.take(o, axis=0), first, axis=0)


def gradients(shape: Shape, p: dict[str, np.ndarray], w: Window, g: dict[str, np.ndarray]) -> int:
    """Sets g to the gradient of the window's negative log-likelihood, with the carried state held fixed, and returns its tokens."""
    hid, (_, steps, live) = shape.hidden, w.h.shape
    o = _outputs(shape, w)
    for x in g.values():
        x[...] = 0
    n = len(o.at)
    dr = np.zeros((hid, n + 1), np.float32)  # the last column is for steps without a target
    classes, words = _head(p)
    both, dr[:, :n] = _pull(classes, o.own, o.classes)
    g["wc"] += both[:-1]
    g["bc"] += both[-1]
    if o.words:
        groups, a, starts, chosen = _words(shape, words, o)
        total = np.add.reduceat(np.exp(a, out=a), starts)
        a[chosen] -= total
        np.reciprocal(total, out=total)
        own, by_state = o.own[:, : o.words] * total, np.empty((hid, o.words), np.float32)
        for lo, hi, x, y, a in groups:
            words_g = own[:, x:y] @ a
            g["u"][lo:hi] = words_g[:-1].T
            g["b"][lo:hi] = words_g[-1]
            np.matmul(words[:-1, lo:hi], a.T, out=by_state[:, x:y])
        by_state *= total
        dr[:, : o.words] += by_state
    if o.branches:
        own = o.own[:, o.leaf :]
        g["ub"][...], by_state = _pull(_branches(shape, p), own, o.branches)
        a, way = _leaves(shape, p["ut"], o)
        np.exp(a, out=a)
        a *= np.reciprocal(a @ shape.tree.level) @ shape.tree.level.T
        a.ravel()[way] -= 1
        for c, x, y in o.branches:
            np.matmul(own[:, x:y], a[x:y], out=g["ut"][c])
            by_state[:, x:y] += p["ut"][c, :-1] @ a[x:y].T
        dr[:, o.leaf : n] += by_state
    back = np.full(steps * live, n)
    back[o.at] = np.arange(n)
    dh = dr.take(back, axis=1, mode="clip").reshape(hid, steps, live)
    # Factors of each step's gradient that don't depend on later steps: of z, r, the candidate's gate and the candidate.
    by = np.empty((steps, 4, hid, live), np.float32)
    np.multiply((w.before - w.c) * w.z, 1 - w.z, out=by[:, 0])
    np.subtract(1, w.c * w.c, out=by[:, 3])
    by[:, 3] *= 1 - w.z
    np.multiply(by[:, 3], w.r, out=by[:, 2])
    np.multiply(by[:, 2] * w.gate, 1 - w.r, out=by[:, 1])
    later = np.zeros((hid, live), np.float32)
    for k in range(steps - 1, -1, -1):
        later += dh[:, k]
        by[k] *= later
        later *= w.z[k]
        later += p["wh"] @ by[k, :3].reshape(3 * hid, live)
        later *= w.stay[k]
    g["wh"] += np.matmul(w.before, by[:, :3].reshape(steps, 3 * hid, live).transpose(0, 2, 1)).sum(axis=0)
    by[:, 2] = by[:, 3]
    _add_rows(g["x"], w.word.ravel(), by[:, :3].reshape(steps, 3 * hid, live).transpose(0, 2, 1).reshape(-1, 3 * hid))
    return n


def train(shape: Shape, v: np.ndarray, docs: list[np.ndarray], end: int, square: np.ndarray, rate: float = 0.1, most: int = 256) -> int:
    """Improves v in place by truncated backpropagation over the documents (Adagrad; square is its state) and returns the tokens seen."""
    if not docs:
        return 0
    most = min(most, max(32, sum(map(len, docs)) // (64 * WINDOW)))  # few tokens: smaller steps, but enough of them
    p, seen = unflat(shape, v), 0
    flat_g, root = np.zeros_like(v), np.empty_like(v)
    g = unflat(shape, flat_g)
    target, of, size = lanes(docs, most)
    # A window of few lanes (the rest of the longest documents) counts by its tokens, not as much as a full one.
    scale = np.float32(64 / (WINDOW * len(size)))
    for w in _windows(shape, p, target, of, size, end):
        n = gradients(shape, p, w, g)
        flat_g *= scale
        flat_g.clip(-1, 1, out=flat_g)
        np.multiply(flat_g, flat_g, out=root)
        square += root
        np.sqrt(np.add(square, np.float32(1e-6), out=root), out=root)
        flat_g *= np.float32(rate)
        flat_g /= root
        v -= flat_g
        seen += n
    return seen
