"""A gated recurrent language model in numpy: truncated backpropagation, class-factored softmax.

Token codes: 0..head-1 are the head words by frequency, head + k the tail words of frequency bin k (bin
0: words seen once, and unknown ones). A head word's probability is P(class | state) * P(word | class,
state), with CLASS head words to a class; a tail bin is a class by itself, in which words have fixed
shares. Parameters are one float32 vector, so that they can be averaged.
"""

from __future__ import annotations

import numpy as np

HIDDEN, CLASS, BINS, STEPS, STREAMS, SOFTMAX_ROWS = 16, 128, 40, 16, 128, 8192


def shapes(head: int) -> dict[str, tuple[int, ...]]:
    classes, h = -(-head // CLASS) + BINS, HIDDEN
    return {"E": (head + BINS, 3 * h), "U": (h, 3 * h), "bu": (3 * h,), "Wc": (h, classes), "bc": (classes,), "Wh": (h, head), "bh": (head,)}


def views(vec: np.ndarray, head: int) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in shapes(head).items():
        n = int(np.prod(shape))
        out[name] = vec[at : at + n].reshape(shape)
        at += n
    return out


def layers(vec: np.ndarray, head: int) -> tuple[np.ndarray, np.ndarray]:
    """The weights of classes and of words, each with its biases, which follow it in the vector, as a last row."""
    words = (HIDDEN + 1) * head
    classes = (HIDDEN + 1) * shapes(head)["bc"][0]
    return vec[-words - classes : -words].reshape(HIDDEN + 1, -1), vec[-words:].reshape(HIDDEN + 1, -1)


def class_of(head: int) -> np.ndarray:
    return np.r_[np.arange(head) // CLASS, -(-head // CLASS) + np.arange(BINS)]


def start(head_counts: np.ndarray, bin_counts: np.ndarray, seed: int = 3) -> np.ndarray:
    """Random small weights; biases give the unigram distribution."""
    head, rng = len(head_counts), np.random.default_rng(seed)
    vec = np.zeros(sum(int(np.prod(s)) for s in shapes(head).values()), np.float32)
    v = views(vec, head)
    for name, size in (("E", 0.3), ("U", 0.25), ("Wc", 0.05), ("Wh", 0.05)):
        v[name][:] = rng.normal(0, size, v[name].shape)
    counts = np.r_[head_counts, bin_counts] + 0.5
    v["bc"][:] = np.log(np.bincount(class_of(head), counts, len(v["bc"])) / counts.sum())
    v["bh"][:] = np.log(counts[:head])
    return vec


def _gates(p: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a code adds to the gates, biases of z and r included, the state's weights, and the candidate's bias.

    The part of z and r is halved: sigmoid(x) is (1 + tanh(x / 2)) / 2.
    """
    codes, weights = p["E"].copy(), np.ascontiguousarray(p["U"].T)
    codes[:, : 2 * HIDDEN] += p["bu"][: 2 * HIDDEN]
    codes[:, : 2 * HIDDEN] *= 0.5
    weights[: 2 * HIDDEN] *= 0.5
    return codes, weights, p["bu"][2 * HIDDEN :, None].copy()


def _inputs(codes: np.ndarray, x: np.ndarray) -> np.ndarray:
    """What the given codes (steps, streams) add to the gates: (steps, 3 * HIDDEN, streams)."""
    return np.ascontiguousarray(codes.take(x.ravel(), 0).reshape(*x.shape, -1).transpose(0, 2, 1))


def _step(weights: np.ndarray, bn: np.ndarray, h: np.ndarray, a: np.ndarray, out: np.ndarray):
    """The next state, into out (HIDDEN, streams); z and r, the candidate, and its part from the state."""
    k = HIDDEN
    g = weights @ h
    zr, gn = g[: 2 * k], g[2 * k :]
    zr += a[: 2 * k]
    np.tanh(zr, zr)
    zr += 1
    zr *= 0.5
    gn += bn
    n = zr[k:] * gn
    n += a[2 * k :]
    np.tanh(n, n)
    np.subtract(h, n, out)
    out *= zr[:k]
    out += n
    return zr, n, gn


def _with_one(states: np.ndarray) -> np.ndarray:
    """States with a 1 behind each, which biases are multiplied with."""
    out = np.ones((len(states), HIDDEN + 1), states.dtype)
    out[:, :HIDDEN] = states
    return out


def _rows(x: np.ndarray) -> np.ndarray:
    """(steps, width, streams) as rows in the order of steps and streams."""
    return np.ascontiguousarray(x.transpose(0, 2, 1)).reshape(-1, x.shape[1])


def _by_class(c: np.ndarray, heads: int):
    """The places ordered by class, and (class, first, last) of each head class present among them."""
    order = np.argsort(c.astype(np.uint8) if heads + BINS < 256 else c, kind="stable")
    edge = np.searchsorted(c[order], np.arange(heads + 1)).tolist()
    return order[: edge[-1]], [(k, edge[k], edge[k + 1]) for k in range(heads) if edge[k] < edge[k + 1]]


def _softmax(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In place over the first axis: exponentials of w less its maximum, and their sums."""
    w -= w.max(0)
    np.exp(w, w)
    return w, np.ones(len(w), w.dtype) @ w


def log_probs(vec: np.ndarray, states: np.ndarray, y: np.ndarray, head: int, classes: np.ndarray) -> np.ndarray:
    """Natural log of P(code y) after each state (a row of states)."""
    c, states = classes[y], _with_one(states)
    to_class, to_word = layers(vec, head)
    e, total = _softmax(to_class.T @ states.T)
    tiny = np.finfo(np.float32).tiny
    out = np.log(np.maximum(e[c, np.arange(len(y))], tiny)) - np.log(total)
    order, parts = _by_class(c, -(-head // CLASS))
    own, within = states.take(order, 0), np.empty(len(order), np.float32)
    word = y[order] % CLASS
    for k, i, j in parts:
        cut = slice(k * CLASS, min(head, (k + 1) * CLASS))
        e, total = _softmax(to_word[:, cut].T @ own[i:j].T)
        within[i:j] = np.log(np.maximum(e[word[i:j], np.arange(j - i)], tiny)) - np.log(total)
    out[order] += within
    return out


def score(vec: np.ndarray, head: int, end: int, codes: np.ndarray, lengths: np.ndarray, together: int = 512, window: int = 16) -> np.ndarray:
    """log10 probability of each document's codes; the state goes on from window to window through the whole document.

    Documents go from the longest to the shortest; a window takes those that reach it, `together` at a time.
    """
    p, classes = views(vec, head), class_of(head)
    gates, weights, bn = _gates(p)
    order = np.argsort(-lengths, kind="stable")
    n = lengths[order]
    # Before each document stands the end; the rest of a last window reads any code and is not counted.
    begin = (np.cumsum(lengths) - lengths)[order]
    state, total = np.zeros((HIDDEN, len(n)), np.float32), np.zeros(len(n))
    steps, kept, size = np.arange(window)[:, None], [], 0

    def flush():
        states, ys, rows = (np.concatenate(x) for x in zip(*kept, strict=True))
        np.add(total, np.bincount(rows, log_probs(vec, states, ys, head, classes), len(n)), total)
        kept.clear()

    for t0 in range(0, int(n.max(initial=0)), window):
        live = int(np.searchsorted(-n, -t0, "left"))
        for g in range(0, live, together):
            docs = slice(g, min(g + together, live))
            at = begin[docs] + t0 + steps
            y = codes.take(at, mode="clip")
            x = np.vstack([codes.take(at[:1] - 1, mode="clip") if t0 else np.full((1, at.shape[1]), end, codes.dtype), y[:-1]])
            a, h = _inputs(gates, x), state[:, docs]
            states = np.empty((window, HIDDEN, x.shape[1]), np.float32)
            for t in range(window):
                _step(weights, bn, h, a[t], states[t])
                h = states[t]
            state[:, docs] = h
            valid = np.flatnonzero((t0 + steps < n[docs]).ravel())
            kept.append((_rows(states).take(valid, 0), y.ravel()[valid], g + valid % x.shape[1]))
            size += len(valid)
            if size >= SOFTMAX_ROWS:
                flush()
                size = 0
    if kept:
        flush()
    out = np.empty(len(n))
    out[order] = total
    return out / np.log(10)


def train(vec: np.ndarray, head: int, end: int, codes: np.ndarray, rate: float) -> np.ndarray:
    """Parameters after one pass over the codes, cut into parallel streams; gradients flow back STEPS tokens at most."""
    if not len(codes):
        return vec
    vec = vec.copy()
    p, classes, heads, k = views(vec, head), class_of(head), -(-head // CLASS), HIDDEN
    streams = int(np.clip(len(codes) // 2000, 4, STREAMS))
    codes = np.r_[codes, np.full(-len(codes) % streams, end, codes.dtype)]
    target = np.ascontiguousarray(codes.reshape(streams, -1).T.astype(np.int64))
    given = np.vstack([np.full((1, streams), end), target[:-1]])
    m, s, done = np.zeros_like(vec), np.zeros_like(vec), 0
    grad, buffer = np.zeros_like(vec), np.empty_like(vec)
    g, (to_class, to_word), (of_class, of_word) = views(grad, head), layers(vec, head), layers(grad, head)
    inputs = np.arange(3 * k)[None, :, None]
    last = np.zeros((k, streams), np.float32)
    for t0 in range(0, len(target), STEPS):
        x, y = given[t0 : t0 + STEPS], target[t0 : t0 + STEPS].ravel()
        kept = (x != end).astype(np.float32)
        table, weights, bn = _gates(p)
        a = _inputs(table, x)
        old, states, gates = np.empty((len(x), k, streams), np.float32), np.empty((len(x), k, streams), np.float32), []
        for t in range(len(x)):
            np.multiply(last, kept[t], old[t])
            gates.append(_step(weights, bn, old[t], a[t], states[t]))
            last = states[t]
        rows, n = _with_one(_rows(states)), len(y)
        grad.fill(0)
        c = classes[y]
        d, total = _softmax(to_class.T @ rows.T)
        # d is `total` times the gradient of each place; what it is multiplied with is divided, being narrower
        d[c, np.arange(n)] -= total
        share = 1 / total
        of_class[:] = (d @ (rows * share[:, None])).T
        dh = d.T @ p["Wc"].T
        dh *= share[:, None]
        order, parts = _by_class(c, heads)
        own, word = rows.take(order, 0), y[order] % CLASS
        back = np.empty((len(own), k), np.float32)
        for q, i, j in parts:
            cut = slice(q * CLASS, min(head, (q + 1) * CLASS))
            d, total = _softmax(to_word[:, cut].T @ own[i:j].T)
            d[word[i:j], np.arange(j - i)] -= total
            share = 1 / total
            of_word[:, cut] = (d @ (own[i:j] * share[:, None])).T
            np.multiply(d.T @ p["Wh"][:, cut].T, share[:, None], back[i:j])
        dh[order] += back
        dh = np.ascontiguousarray(dh.reshape(len(x), streams, k).transpose(0, 2, 1))
        da, dg, carried = np.empty((len(x), 3 * k, streams), np.float32), np.empty((len(x), 3 * k, streams), np.float32), 0.0
        for t in range(len(x) - 1, -1, -1):
            zr, cand, gn = gates[t]
            dt, at, gt = dh[t], da[t], dg[t]
            dt += carried
            slope = 1 - zr
            dn = np.multiply(dt, slope[:k], at[2 * k :])
            slope *= zr
            dn -= dn * (cand * cand)
            np.subtract(old[t], cand, at[:k])
            at[:k] *= dt
            np.multiply(dn, gn, at[k : 2 * k])
            at[: 2 * k] *= slope
            gt[: 2 * k] = at[: 2 * k]
            np.multiply(dn, zr[k:], gt[2 * k :])
            carried = p["U"] @ gt
            dt *= zr[:k]
            carried += dt
            carried *= kept[t]
        g["U"][:], g["bu"][:] = _rows(old).T @ _rows(dg), dg.sum((0, 2))
        at_input = x[:, None] * (3 * k) + inputs
        g["E"][:] = np.bincount(at_input.ravel(), da.ravel(), g["E"].size).reshape(g["E"].shape)
        # the mean over the places, of a length of 1 at most
        grad *= min(1.0, 1.0 / max(float(np.sqrt(grad @ grad)) / n, 1e-9)) / n
        done += 1
        # Adam in place: m and s are running means of the gradient and its square
        np.multiply(grad, grad, buffer)
        buffer -= s
        buffer *= 0.01
        s += buffer
        grad -= m
        grad *= 0.1
        m += grad
        unbias = np.sqrt(1 - 0.99**done)
        np.sqrt(s, buffer)
        buffer += np.float32(1e-6 * unbias)
        np.divide(m, buffer, buffer)
        buffer *= np.float32(rate * unbias / (1 - 0.9**done))
        vec -= buffer
    return vec
