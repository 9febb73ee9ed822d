"""A small gated recurrent language model in numpy.

Words fall into classes. The most frequent words form the neural classes, whose members are told apart
by a softmax over the state; the end of a text is a class of its own; the other words form bands by
count, inside which shares are fixed by the counts. The class comes from a softmax over the state. So
the model gives every token a probability, unseen words included. As input every word has a vector: a
frequent one its own, the others one for their band and hash bucket. Training is truncated
backpropagation through windows; the state is carried from window to window, in training and scoring,
and set to zero where a text starts.

Tokens are 16-bit codes: 0 the end, then BANDS x BUCKETS codes of other words, then the frequent words by
rank, then the start.
"""

from __future__ import annotations

import heapq

import numpy as np

HIDDEN = 16
CLASS_WORDS = 64
CLASSES = 48
BANDS = 20
BUCKETS = 256
SAFE = 60.0  # logits that cannot exceed this need no shift before exp


class Gru:
    """Parameters: G input rows by token, U recurrent, Wc class logits, Wo member logits; in Wc and Wo the last row is a bias."""

    names = ("G", "U", "Wc", "Wo")

    def __init__(self, neural: int, bands: int = BANDS, buckets: int = BUCKETS, hidden: int = HIDDEN, members: int = CLASS_WORDS, seed: int = 1):
        rng = np.random.default_rng(seed)
        f = np.float32
        self.neural, self.members, self.hidden, self.buckets = neural, members, hidden, buckets
        self.plain = 1 + bands  # the end and the bands
        self.classes = self.plain + neural
        self.words = 1 + bands * buckets  # the first frequent word
        self.start = self.words + neural * members
        self.G = (rng.standard_normal((self.start + 1, 3 * hidden)) * 0.1).astype(f)
        self.U = (rng.standard_normal((hidden, 3 * hidden)) / np.sqrt(hidden)).astype(f)
        self.Wc, self.Wo = (rng.standard_normal((hidden + 1, self.classes)) * 0.1).astype(f), (rng.standard_normal((neural, hidden + 1, members)) * 0.1).astype(f)
        self.Wc[-1], self.Wo[:, -1] = 0, 0

    def dump(self) -> bytes:
        return b"".join(getattr(self, n).tobytes() for n in self.names)

    def load(self, raw: bytes) -> Gru:
        at = 0
        for n in self.names:
            a = getattr(self, n)
            setattr(self, n, np.frombuffer(raw, np.float32, a.size, at).reshape(a.shape).copy())
            at += a.nbytes
        return self

    def class_of(self, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and member of tokens."""
        token = token.astype(np.int32)
        over = token - self.words
        cls = np.where(over < 0, (token + self.buckets - 1) // self.buckets, self.plain + over // self.members)
        return cls, np.where(over < 0, 0, over % self.members)

    def run(self, h: np.ndarray, x: np.ndarray, fresh: np.ndarray, kept: list | None = None) -> np.ndarray:
        """States after each of x[t], with a 1 at their end, from state h; fresh[t]: the lane starts a text at t. Gates are tanh(a)/2 + 1/2."""
        n = self.hidden
        out = np.ones((*x.shape, n + 1), np.float32)
        gx = self.G[x]
        half, some = np.float32(0.5), fresh.any(1)
        for t in range(len(x)):
            if some[t]:
                h = h * ~fresh[t][:, None]
            gh = h @ self.U
            zr = gx[t, :, : 2 * n] + gh[:, : 2 * n]
            np.tanh(zr, out=zr)
            zr *= half
            zr += half
            z, r = zr[:, :n], zr[:, n:]
            new = r * gh[:, 2 * n :]
            new += gx[t, :, 2 * n :]
            np.tanh(new, out=new)
            if kept is not None:
                kept.append((h, zr, new, gh))
            h = h - new
            h *= z
            h += new
            out[t, :, :n] = h
        return out

    def log_probs(self, h: np.ndarray, token: np.ndarray, grads: dict | None = None) -> np.ndarray:
        """Natural log-probability of each token's class, and of the member in neural classes; with ``grads``, also their gradients."""
        cls, member = self.class_of(token)
        order = np.argsort(cls.astype(np.uint16), kind="stable")
        bounds = np.searchsorted(cls[order], np.arange(self.plain, self.classes + 1))
        h, cls, member = h[order], cls[order], member[order]  # by class from here on
        at, slope = np.arange(len(token)), grads is not None
        done, p = self._softmax(h, self.Wc, at, cls, slope)
        if slope:
            grads["Wc"], grads["Wo"] = h.T @ p, np.zeros_like(self.Wo)
            back = p @ self.Wc[:-1].T
        for c in range(self.neural):
            a, b = bounds[c], bounds[c + 1]
            if a == b:
                continue
            more, p = self._softmax(h[a:b], self.Wo[c], at[: b - a], member[a:b], slope)
            done[a:b] += more
            if slope:
                np.dot(h[a:b].T, p, out=grads["Wo"][c])
                back[a:b] += p @ self.Wo[c, :-1].T
        out = np.empty_like(done)
        out[order] = done
        if slope:
            grads["h"] = np.empty_like(back)
            grads["h"][order] = back
        return out

    @staticmethod
    def _softmax(h: np.ndarray, w: np.ndarray, at: np.ndarray, target: np.ndarray, slope: bool) -> tuple[np.ndarray, np.ndarray]:
        """Log-probabilities of targets; with ``slope``, probabilities less the targets' ones. States are in -1 to 1, so the weights bound the logits."""
        e = h @ w
        if np.abs(w).sum(0).max() > SAFE:
            e -= e.max(1, keepdims=True)
        done = e[at, target]
        np.exp(e, out=e)
        s = e @ np.ones(e.shape[1], e.dtype)
        done -= np.log(s)
        if slope:
            e *= (1 / s)[:, None]
            e[at, target] -= 1
        return done, e


def lanes(sizes: list[int], wide: int) -> list[list[int]]:
    """Texts dealt to at most ``wide`` lanes of like length, longest lane first."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    heap = [(0, k) for k in range(min(wide, len(sizes)))]
    out: list[list[int]] = [[] for _ in heap]
    for i in order:
        n, k = heapq.heappop(heap)
        out[k].append(i)
        heapq.heappush(heap, (n + sizes[i], k))
    return [out[k] for _, k in sorted(heap, key=lambda x: -x[0])]


def streams(model: Gru, texts: list[np.ndarray], wide: int, window: int):
    """Windows (x, target, fresh, text index) over texts dealt to lanes; lanes that ended are left out.

    ``texts``: tokens of each text, the end included. Rows of padding have text index -1.
    """
    sizes = [len(t) for t in texts]
    dealt = lanes(sizes, wide)
    if not dealt:
        return
    flat = [np.concatenate([texts[i] for i in lane]) for lane in dealt]
    length = np.array([len(f) for f in flat])
    whole = -(-int(length[0]) // window) * window
    # lanes beside each other, time first; padded at the end
    y = np.zeros((whole, len(flat)), np.uint16)
    own = np.full((whole, len(flat)), -1, np.int32)
    for k, (f, lane) in enumerate(zip(flat, dealt, strict=True)):
        y[: len(f), k] = f
        own[: len(f), k] = np.repeat(np.array(lane, np.int32), [sizes[i] for i in lane])
    x = np.empty_like(y)
    x[0], x[1:] = model.start, y[:-1]
    fresh = np.ones(own.shape, bool)
    fresh[1:] = own[1:] != own[:-1]
    x[fresh] = model.start
    for t in range(0, whole, window):
        live = int((length > t).sum())
        part = slice(t, min(t + window, int(length[0])))
        yield x[part, :live], y[part, :live], fresh[part, :live], own[part, :live]


def score(model: Gru, texts: list[np.ndarray], wide: int = 512, window: int = 32) -> np.ndarray:
    """Natural log-probability of the classes and neural members of each whole text."""
    total = np.zeros(len(texts))
    h = np.zeros((0, model.hidden), np.float32)
    for x, y, fresh, own in streams(model, texts, wide, window):
        live = x.shape[1]
        h = h[:live] if len(h) else np.zeros((live, model.hidden), np.float32)
        states = model.run(h, x, fresh)
        h = states[-1, :, :-1]
        ok = own >= 0
        total += np.bincount(own[ok], model.log_probs(states[ok], y[ok]), len(texts))
    return total


class Trainer:
    """Adagrad over windows; a lane's state enters the next window, gradients do not."""

    def __init__(self, model: Gru, rate: float = 0.08):
        self.model, self.rate = model, np.float32(rate)
        self.seen = {n: np.full_like(getattr(model, n), 1e-3) for n in model.names}

    def step(self, name: str, grad: np.ndarray, rows: np.ndarray | slice = slice(None)) -> None:
        s = self.seen[name][rows] + grad * grad
        self.seen[name][rows] = s
        grad *= self.rate
        grad /= np.sqrt(s)
        getattr(self.model, name)[rows] -= grad

    def gradients(self, x: np.ndarray, y: np.ndarray, fresh: np.ndarray, ok: np.ndarray, h: np.ndarray) -> tuple[dict, np.ndarray, np.ndarray]:
        """Gradients by parameter (that of G by input row, with the rows), and the last states."""
        m, n = self.model, self.model.hidden
        kept: list = []
        states = m.run(h, x, fresh, kept)
        g: dict = {}
        full = bool(ok.all())
        m.log_probs(states.reshape(-1, n + 1) if full else states[ok], y.reshape(-1) if full else y[ok], g)
        if full:
            dh = g.pop("h").reshape(*x.shape, n)
        else:
            dh = np.zeros((*x.shape, n), np.float32)
            dh[ok] = g.pop("h")
        dgx, dgh, hp = np.empty((*x.shape, 3 * n), np.float32), np.empty((*x.shape, 3 * n), np.float32), np.empty((*x.shape, n), np.float32)
        carry, back = np.zeros(h.shape, np.float32), np.ascontiguousarray(m.U.T)
        two, some = np.float32(2), fresh.any(1)
        for t in range(len(x) - 1, -1, -1):
            hp[t], zr, new, gh = kept[t]
            z, r, gx = zr[:, :n], zr[:, n:], dgx[t]
            d = dh[t]
            d += carry
            dn = (1 - z) * d
            dn *= 1 - new * new
            gx[:, 2 * n :] = dn
            np.multiply(d * two, hp[t] - new, out=gx[:, :n])
            np.multiply(dn * two, gh[:, 2 * n :], out=gx[:, n : 2 * n])
            gx[:, : 2 * n] *= zr * (1 - zr)
            dgh[t, :, : 2 * n] = gx[:, : 2 * n]
            np.multiply(dn, r, out=dgh[t, :, 2 * n :])
            carry = dgh[t] @ back
            d *= z
            carry += d
            if some[t]:
                carry *= ~fresh[t][:, None]
        g["U"] = hp.reshape(-1, n).T @ dgh.reshape(-1, 3 * n)
        flat = x.reshape(-1)
        order = np.argsort(flat, kind="stable")
        sorted_x = flat[order]
        at = np.flatnonzero(np.concatenate(([True], sorted_x[1:] != sorted_x[:-1])))
        g["G"] = np.add.reduceat(dgx.reshape(-1, 3 * n)[order], at)
        return g, sorted_x[at], states[-1, :, :-1]

    def learn(self, texts: list[np.ndarray], wide: int = 256, window: int = 32) -> int:
        """Tokens learnt from."""
        m, tokens = self.model, 0
        h = np.zeros((0, m.hidden), np.float32)
        for x, y, fresh, own in streams(m, texts, wide, window):
            live = x.shape[1]
            h = h[:live] if len(h) else np.zeros((live, m.hidden), np.float32)
            ok = own >= 0
            g, rows, h = self.gradients(x, y, fresh, ok, h)
            count = int(ok.sum())
            tokens += count
            scale = np.float32(1 / np.sqrt(count))
            for name, grad in g.items():
                grad *= scale
                self.step(name, grad, rows if name == "G" else slice(None))
        return tokens
