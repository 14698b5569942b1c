"""A gated recurrent network with a class-factored output, in numpy.

Symbols are HEAD frequent words, then TAIL classes of all others.  The output is
a softmax over classes and, for a frequent word, one over its class of CLASS
words.  Training is by back-propagation through windows of WINDOW steps with the
state carried from window to window through a whole text, and Adagrad steps;
scoring carries the state through a whole text too.

Inside a step, arrays hold units in rows and texts in columns: a gate is then a
block of rows, and every operation runs over long contiguous rows.  What goes by
symbol (the vectors that the inputs look up, logits, their gradients) has a row a
symbol, so that picking and dealing out symbols moves whole rows.  A bias is the
factor of a one that follows each state.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence

import numpy as np

HIDDEN, HEAD, CLASS, TAIL = 24, 2048, 64, 32
WORD_CLASSES = HEAD // CLASS
CLASSES = WORD_CLASSES + TAIL
WINDOW, LANES, RATE = 16, 256, 0.08
#: Steps laid out at a time while training.
LAID = 256
#: Texts of like length that are scored side by side, and symbols evaluated at a time.
SIDE_BY_SIDE, EVALUATED = 1024, 16_384
#: Logits below this need no shift before the exponential in single precision.
SAFE = 60.0


def _shapes() -> dict[str, tuple[int, ...]]:
    return {
        "inputs": (3 * HIDDEN, HEAD + TAIL), "recur": (3 * HIDDEN, HIDDEN), "recur_bias": (3 * HIDDEN, 1),
        "class_out": (CLASSES, HIDDEN), "class_bias": (CLASSES, 1), "word_out": (HEAD, HIDDEN), "word_bias": (HEAD, 1),
    }


SIZE = sum(int(np.prod(s)) for s in _shapes().values())


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    """Views of one vector of weights."""
    out, at = {}, 0
    for name, shape in _shapes().items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def fresh(symbol_counts: np.ndarray, seed: int = 7) -> np.ndarray:
    """Weights whose biases say the symbols' frequencies; ``symbol_counts`` has HEAD + TAIL numbers."""
    rng = np.random.default_rng(seed)
    flat = np.zeros(SIZE, np.float32)
    p = unpack(flat)
    p["inputs"][:] = rng.normal(0, 0.3, p["inputs"].shape)
    p["recur"][:] = rng.normal(0, HIDDEN**-0.5, p["recur"].shape)
    p["class_out"][:] = rng.normal(0, 0.05, p["class_out"].shape)
    counts = symbol_counts.astype(np.float64) + 0.01
    head = counts[:HEAD].reshape(-1, CLASS)
    p["word_bias"][:, 0] = np.log(head / head.sum(axis=1, keepdims=True)).ravel()
    classes = np.concatenate((head.sum(axis=1), counts[HEAD:]))
    p["class_bias"][:, 0] = np.log(classes / classes.sum())
    return flat


_CLASS_OF = np.concatenate((np.arange(HEAD) // CLASS, WORD_CLASSES + np.arange(TAIL)))


def class_of(symbols: np.ndarray) -> np.ndarray:
    return _CLASS_OF.take(symbols)


class _Laid:
    """Weights as the steps read them, and under ``p`` views of them as ``unpack`` names them."""

    def __init__(self, flat: np.ndarray):
        p = unpack(flat)
        self.inputs = np.array(p["inputs"].T, order="C")
        self.recur, self.classes, self.words = (np.concatenate((p[a], p[b]), axis=1) for a, b in (("recur", "recur_bias"), ("class_out", "class_bias"), ("word_out", "word_bias")))
        self.p = {"inputs": self.inputs.T}
        for name, bias, held in (("recur", "recur_bias", self.recur), ("class_out", "class_bias", self.classes), ("word_out", "word_bias", self.words)):
            self.p[name], self.p[bias] = held[:, :HIDDEN], held[:, HIDDEN:]

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[name].ravel() for name in _shapes()])

    def signed(self) -> np.ndarray:
        """The recurrent weights, those of the gates negated."""
        out = self.recur.copy()
        np.negative(out[: 2 * HIDDEN], out=out[: 2 * HIDDEN])
        return out


class _Rooms:
    """Arrays to write into; a name's memory is kept from one use to the next."""

    def __init__(self, dtype: np.dtype):
        self.dtype, self.held = dtype, {}

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        size = math.prod(shape)
        held = self.held.get(name)
        if held is None or len(held) < size:
            held = self.held[name] = np.empty(size, self.dtype)
        return held[:size].reshape(shape)


def _is_safe(p: dict[str, np.ndarray], kind: str) -> bool:
    """Whether no logit can leave the safe range; states lie between -1 and 1."""
    return _margin(p, kind) > 0


def _margin(p: dict[str, np.ndarray], kind: str) -> float:
    """How far the largest possible logit is below SAFE."""
    return SAFE - float((np.abs(p[f"{kind}_out"]).sum(axis=1) + np.abs(p[f"{kind}_bias"][:, 0])).max())


def _exp(logits: np.ndarray, safe: bool) -> np.ndarray | float:
    """In place, the exponentials by row; returns what was taken off each row's logits."""
    shift = 0.0 if safe else logits.max(axis=1)
    if not safe:
        logits -= shift[:, None]
    np.exp(logits, out=logits)
    return shift


def _sums(rows: np.ndarray) -> np.ndarray:
    return rows @ np.ones(rows.shape[1], rows.dtype)


def _words_by_class(symbols: np.ndarray, classes: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, list[tuple[slice, slice]]]:
    """Rows of frequent words ordered by class; for each class its words and its part of the order."""
    at = np.flatnonzero(use)
    order = at[np.argsort(classes[at].astype(np.int16), kind="stable")]
    bounds = np.searchsorted(classes[order], np.arange(WORD_CLASSES + 1)).tolist()
    return order, [(slice(c * CLASS, (c + 1) * CLASS), slice(i, j)) for c, (i, j) in enumerate(zip(bounds, bounds[1:], strict=False)) if i < j]


def _given(w: _Laid, symbols: np.ndarray, room: _Rooms) -> np.ndarray:
    """What the inputs give to each step: (steps, gates, texts)."""
    steps, width = symbols.shape
    rows = w.inputs.take(symbols.ravel(), axis=0, out=room("looked up", steps * width, 3 * HIDDEN), mode="clip")
    out = room("given", steps, 3 * HIDDEN, width)
    np.copyto(out, rows.reshape(steps, width, 3 * HIDDEN).transpose(0, 2, 1))
    return out


def _step(signed: np.ndarray, given: np.ndarray, h: np.ndarray, made: np.ndarray, new: np.ndarray, out: np.ndarray) -> None:
    """One step from states with their ones: writes the gates and the state's part of the new state, the new state, the next state."""
    np.matmul(signed, h, out=made)
    gates = made[: 2 * HIDDEN]
    gates -= given[: 2 * HIDDEN]
    np.exp(gates, out=gates)
    gates += 1
    np.reciprocal(gates, out=gates)
    np.multiply(gates[HIDDEN:], made[2 * HIDDEN :], out=new)
    new += given[2 * HIDDEN :]
    np.tanh(new, out=new)
    np.subtract(h[:HIDDEN], new, out=out)
    out *= gates[:HIDDEN]
    out += new


def log_probabilities(p: dict[str, np.ndarray], states: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Natural log of each target symbol's probability (of a tail symbol, of its class); states by column."""
    w = _Laid(np.concatenate([p[name].ravel() for name in _shapes()]))
    rows = np.ones((len(targets), HIDDEN + 1), w.recur.dtype)
    rows[:, :HIDDEN] = states.T
    return _logs(w, {kind: _is_safe(p, kind) for kind in ("class", "word")}, rows, targets, _Rooms(w.recur.dtype))


def _logs(w: _Laid, safe: dict[str, bool], rows: np.ndarray, targets: np.ndarray, room: _Rooms) -> np.ndarray:
    """The logs of ``log_probabilities`` from rows of states with their ones."""
    n, classes = len(targets), class_of(targets)
    logits = np.matmul(rows, w.classes.T, out=room("classes", n, CLASSES))
    out = logits.ravel()[np.arange(n) * CLASSES + classes].astype(np.float64)
    out -= _exp(logits, safe["class"])
    out -= np.log(_sums(logits))
    order, parts = _words_by_class(targets, classes, targets < HEAD)
    m = len(order)
    own = rows.take(order, axis=0, out=room("own", m, HIDDEN + 1), mode="clip")
    logits = room("words", m, CLASS)
    for words, at in parts:
        np.matmul(own[at], w.words[words].T, out=logits[at])
    found = logits.ravel()[np.arange(m) * CLASS + targets[order] % CLASS].astype(np.float64)
    found -= _exp(logits, safe["word"])
    found -= np.log(_sums(logits))
    out[order] += found
    return out


def score(flat: np.ndarray, texts: Sequence[np.ndarray], end: int) -> np.ndarray:
    """Natural log-likelihood of each text of symbols; every text ends with ``end`` and begins after one."""
    w, room = _Laid(flat), _Rooms(flat.dtype)
    safe = {kind: _is_safe(w.p, kind) for kind in ("class", "word")}
    out = np.empty(len(texts))
    order = np.argsort([-len(t) for t in texts], kind="stable")
    for at in range(0, len(order), SIDE_BY_SIDE):
        group = order[at : at + SIDE_BY_SIDE]
        out[group] = _score_group(w, safe, [texts[i] for i in group], end, room)
    return out


def _score_group(w: _Laid, safe: dict[str, bool], texts: list[np.ndarray], end: int, room: _Rooms) -> np.ndarray:
    """Texts of falling length, step by step; those that have ended drop out."""
    lengths = np.array([len(t) for t in texts])
    total = np.zeros(len(texts))
    h = np.zeros((HIDDEN + 1, len(texts)), room.dtype)
    h[HIDDEN] = 1
    signed = w.signed()
    at, longest = 0, int(lengths[0])
    while at < longest:
        live = int(np.searchsorted(-lengths, -at, side="left"))  # texts longer than `at`
        steps = min(max(WINDOW, EVALUATED // live), longest - at)
        block = np.full((steps + 1, live), end, np.int16)
        for k in range(live):
            part = texts[k][max(0, at - 1) : at + steps]
            begin = 0 if at else 1
            block[begin : begin + len(part), k] = part
        running = np.searchsorted(-lengths, -(at + np.arange(steps)), side="left")
        given, rows, done = _given(w, block[:-1], room), room("rows", int(running.sum()), HIDDEN + 1), 0
        rows[:, HIDDEN] = 1
        for t, n in enumerate(running.tolist()):
            now = h[:, :n]
            _step(signed, given[t, :, :n], now, room("made", 3 * HIDDEN, n), room("new", HIDDEN, n), now[:HIDDEN])
            rows[done : done + n, :HIDDEN] = now[:HIDDEN].T
            done += n
        there = np.arange(live) < running[:, None]
        logs = _logs(w, safe, rows, block[1:][there], room)
        total[:live] += np.bincount(np.nonzero(there)[1], logs, live)
        at += steps
    return total


class Trainer:
    """Truncated back-propagation over lanes of texts laid end to end."""

    def __init__(self, flat: np.ndarray, squares: np.ndarray | None = None, rate: float = RATE):
        self.w = _Laid(flat.astype(np.float32))
        self.s = _Laid(np.full(SIZE, 1e-4, np.float32) if squares is None else squares.astype(np.float32))
        self.p, self.rate, self.room = self.w.p, np.float32(rate), _Rooms(np.float32)
        self.seen = 0
        self.sure = {"class": 0, "word": 0}

    @property
    def flat(self) -> np.ndarray:
        return self.w.flat()

    @property
    def squares(self) -> np.ndarray:
        return self.s.flat()

    def _safe(self, kind: str) -> bool:
        """Whether no logit can leave the safe range, looked up only when updates may have used up the margin.

        An Adagrad step moves a weight by the rate at most.
        """
        if self.sure[kind] > 0:
            self.sure[kind] -= 1
            return True
        margin = _margin(self.p, kind)
        self.sure[kind] = max(0, int(margin / (self.rate * (HIDDEN + 1)) - 0.01))
        return margin > 0

    def _move(self, weights: np.ndarray, squares: np.ndarray, gradient: np.ndarray) -> None:
        """An Adagrad step in place."""
        step = np.multiply(gradient, gradient, out=self.room("step", *gradient.shape))
        squares += step
        np.sqrt(squares, out=step)
        np.divide(gradient, step, out=step)
        step *= self.rate
        weights -= step

    def window(self, h: np.ndarray, inputs: np.ndarray, targets: np.ndarray, live: np.ndarray | None, end: int) -> np.ndarray:
        """One update from (steps, lanes) arrays; returns the states to carry on.

        A lane's state is fresh after every ``end``; where ``live`` is false (None: nowhere) nothing is learned.
        """
        room, (steps, width) = self.room, inputs.shape
        starts = inputs == end
        begins = starts.any(axis=1).tolist()
        given, signed = _given(self.w, inputs, room), self.w.signed()
        before, made, new = room("before", steps, HIDDEN + 1, width), room("made", steps, 3 * HIDDEN, width), room("new", steps, HIDDEN, width)
        rows = room("rows", steps, width, HIDDEN + 1)
        before[:, HIDDEN], rows[:, :, HIDDEN] = 1, 1
        last = np.empty((HIDDEN, width), np.float32)
        before[0, :HIDDEN] = h
        for t in range(steps):
            if begins[t]:
                before[t, :HIDDEN, starts[t]] = 0
            state = before[t + 1, :HIDDEN] if t + 1 < steps else last
            _step(signed, given[t], before[t], made[t], new[t], state)
            rows[t, :, :HIDDEN] = state.T
        use = None if live is None or live.all() else live.ravel()
        count = inputs.size if use is None else int(use.sum())
        self.seen += count
        back = self._output(rows.reshape(-1, HIDDEN + 1), targets.ravel(), use, np.float32(1 / count))
        self._recurrent(before, made, new, back.reshape(steps, width, HIDDEN), inputs, starts, begins)
        return last

    def _output(self, rows: np.ndarray, goal: np.ndarray, use: np.ndarray | None, share: np.float32) -> np.ndarray:
        """Updates the output's weights; returns the gradient of the states, by row."""
        w, room, n, classes = self.w, self.room, len(goal), class_of(goal)
        d = np.matmul(rows, w.classes.T, out=room("classes", n, CLASSES))
        _exp(d, self._safe("class"))
        d *= (share / _sums(d))[:, None]
        d.ravel()[np.arange(n) * CLASSES + classes] -= share
        if use is not None:
            d *= use[:, None]
        back = np.matmul(d, w.classes[:, :HIDDEN], out=room("back", n, HIDDEN))
        frequent = goal < HEAD
        order, parts = _words_by_class(goal, classes, frequent if use is None else frequent & use)
        m = len(order)
        own = rows.take(order, axis=0, out=room("own", m, HIDDEN + 1), mode="clip")
        e, own_back, gradient = room("words", m, CLASS), room("own back", m, HIDDEN), room("gradient", HEAD, HIDDEN + 1)
        for words, at in parts:
            np.matmul(own[at], w.words[words].T, out=e[at])
        _exp(e, self._safe("word"))
        e *= (share / _sums(e))[:, None]
        e.ravel()[np.arange(m) * CLASS + goal[order] % CLASS] -= share
        gradient[:] = 0
        for words, at in parts:
            np.matmul(e[at], w.words[words, :HIDDEN], out=own_back[at])
            np.matmul(e[at].T, own[at], out=gradient[words])
        back[order] += own_back
        self._move(w.words, self.s.words, gradient)
        self._move(w.classes, self.s.classes, d.T @ rows)
        return back

    def _recurrent(self, before: np.ndarray, made: np.ndarray, new: np.ndarray, back: np.ndarray, inputs: np.ndarray, starts: np.ndarray, begins: list[bool]) -> None:
        w, room, (steps, width) = self.w, self.room, inputs.shape
        z, r, inner = (made[:, i * HIDDEN : (i + 1) * HIDDEN] for i in range(3))
        by_gate, by_new, by_reset, closed = (room(name, *new.shape) for name in ("by gate", "by new", "by reset", "closed"))
        np.subtract(1, z, out=closed)
        np.subtract(before[:, :HIDDEN], new, out=by_gate)
        by_gate *= z
        by_gate *= closed
        np.multiply(new, new, out=by_new)
        np.subtract(1, by_new, out=by_new)
        by_new *= closed
        np.subtract(1, r, out=by_reset)
        by_reset *= r
        by_reset *= inner
        # Gradients of the state's part of the new state, of the gates, and of what the inputs gave to the new state.
        grads = room("grads", steps, 4 * HIDDEN, width)
        of_inner, of_gate, of_reset, of_new = (grads[:, i * HIDDEN : (i + 1) * HIDDEN] for i in range(4))
        dh = np.zeros((HIDDEN, width), np.float32)
        turned = np.ascontiguousarray(np.concatenate((w.recur[2 * HIDDEN :, :HIDDEN], w.recur[: 2 * HIDDEN, :HIDDEN])).T)
        for t in range(steps - 1, -1, -1):
            dh += back[t].T
            np.multiply(dh, by_gate[t], out=of_gate[t])
            np.multiply(dh, by_new[t], out=of_new[t])
            np.multiply(of_new[t], by_reset[t], out=of_reset[t])
            np.multiply(of_new[t], r[t], out=of_inner[t])
            dh *= z[t]
            dh += turned @ grads[t, : 3 * HIDDEN]
            if begins[t]:
                dh[:, starts[t]] = 0
        rows = room("by row", steps, width, 3 * HIDDEN)
        np.copyto(rows, grads[:, HIDDEN:].transpose(0, 2, 1))
        symbols = inputs.ravel()
        order = np.argsort(symbols, kind="stable")
        found = symbols[order]
        first = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1])))
        ordered = rows.reshape(-1, 3 * HIDDEN).take(order, axis=0, out=room("ordered", len(order), 3 * HIDDEN), mode="clip")
        at = found[first]
        weights, squares = w.inputs.take(at, axis=0), self.s.inputs.take(at, axis=0)
        self._move(weights, squares, np.add.reduceat(ordered, first, axis=0))
        w.inputs[at], self.s.inputs[at] = weights, squares
        recur = np.matmul(grads[:, : 3 * HIDDEN], before.transpose(0, 2, 1)).sum(axis=0)
        self._move(w.recur, self.s.recur, np.concatenate((recur[HIDDEN:], recur[:HIDDEN])))

    def train(self, texts: Sequence[np.ndarray], end: int, lanes: int = LANES) -> None:
        """One pass over texts of symbols, each ending with ``end``; every text goes whole to the shortest lane."""
        if not len(texts):
            return
        lanes = min(lanes, len(texts))
        shortest, laid = [(0, k) for k in range(lanes)], [[] for _ in range(lanes)]
        for text in texts:
            n, k = shortest[0]
            laid[k].append(text)
            heapq.heapreplace(shortest, (n + len(text), k))
        streams = sorted((np.concatenate(x) for x in laid), key=len, reverse=True)
        lengths = np.array([len(s) for s in streams])
        h = np.zeros((HIDDEN, lanes), np.float32)
        for at in range(0, int(lengths[0]), LAID):
            live = int((lengths > at).sum())
            block = np.full((LAID + 1, live), end, np.int16)
            for k in range(live):
                part = streams[k][max(0, at - 1) : at + LAID]
                begin = 0 if at else 1
                block[begin : begin + len(part), k] = part
            for i in range(0, min(LAID, int(lengths[0]) - at), WINDOW):
                width = int((lengths > at + i).sum())
                inputs, targets = (np.ascontiguousarray(block[j : j + WINDOW, :width]) for j in (i, i + 1))
                there = at + i + np.arange(WINDOW)[:, None] < lengths[:width]
                h = self.window(h[:, :width], inputs, targets, None if there.all() else there, end)
