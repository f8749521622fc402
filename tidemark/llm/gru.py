"""A bidirectional gated recurrent network over bytes, in numpy.

Each byte has an embedding; one recurrent layer reads forwards, one backwards; every position gets class
probabilities from both states. Training is backpropagation through time over windows, with Adam.
"""

from __future__ import annotations

import numpy as np

F32 = np.float32


def bend(x: np.ndarray) -> np.ndarray:
    """x / sqrt(1 + x * x): between -1 and 1 as tanh, at a fifth of its time. The slope is (1 - y * y) ** 1.5."""
    return x / np.sqrt(F32(1) + x * x)


def gate(x: np.ndarray) -> np.ndarray:
    """The same between 0 and 1. The slope is 4 * (y - y * y) ** 1.5."""
    return F32(0.5) * bend(x) + F32(0.5)


def _bend_into(x: np.ndarray, room: np.ndarray) -> None:
    np.multiply(x, x, out=room)
    room += F32(1)
    np.sqrt(room, out=room)
    x /= room


class ByteGru:
    """Parameters and passes. Bytes are integers 0..255; arrays are (time, batch, ...)."""

    def __init__(self, classes: int, hidden: int = 40, embed: int = 24, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.h, self.e, self.c = hidden, embed, classes
        w = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(F32)
        self.p = {"E": (rng.standard_normal((256, embed)) * 0.5).astype(F32), "Wo": w(2 * hidden, classes), "bo": np.zeros(classes, F32)}
        for d in "fb":
            self.p |= {f"Wx{d}": w(embed, 3 * hidden), f"Wg{d}": w(hidden, 2 * hidden), f"Wn{d}": w(hidden, hidden), f"b{d}": np.zeros(3 * hidden, F32)}

    @classmethod
    def restored(cls, p) -> ByteGru:
        """A network with the given parameters."""
        embed, hidden, classes = p["E"].shape[1], p["Wnf"].shape[0], p["bo"].shape[0]
        net = cls(classes, hidden, embed)
        net.p = {k: np.asarray(p[k], dtype=F32) for k in net.p}
        return net

    def tables(self) -> dict[str, np.ndarray]:
        """The input part of each byte, for fast reading."""
        return {d: self.p["E"] @ self.p[f"Wx{d}"] + self.p[f"b{d}"] for d in "fb"}

    def _scan(self, d: str, x: np.ndarray):
        """States, gates and candidates of one direction for inputs x (time, batch, 3h), already in reading order."""
        T, B, h = len(x), x.shape[1], self.h
        wg, wn = self.p[f"Wg{d}"], self.p[f"Wn{d}"]
        s = np.zeros((B, h), F32)
        out = np.empty((T, B, h), F32)
        g, n = np.empty((T, B, 2 * h), F32), np.empty((T, B, h), F32)
        for t in range(T):
            a = gate(x[t, :, : 2 * h] + s @ wg)
            r, z = a[:, :h], a[:, h:]
            m = bend(x[t, :, 2 * h :] + (r * s) @ wn)
            s = m + z * (s - m)
            out[t], g[t], n[t] = s, a, m
        return out, g, n

    def probabilities(self, ids: np.ndarray, tables: dict[str, np.ndarray]) -> np.ndarray:
        """Class probabilities of every position of ids (time, batch); both directions step together, inputs are looked up step by step."""
        (T, B), h = ids.shape, self.h
        table = (tables["f"], tables["b"])
        wg, wn = np.stack([self.p["Wgf"], self.p["Wgb"]]), np.stack([self.p["Wnf"], self.p["Wnb"]])
        states = np.empty((2, T, B, h), F32)
        s, a, m = np.zeros((2, B, h), F32), np.empty((2, B, 2 * h), F32), np.empty((2, B, h), F32)
        room_a, room_m, x = np.empty_like(a), np.empty_like(m), np.empty((2, B, 3 * h), F32)
        for t in range(T):
            back = T - 1 - t
            np.take(table[0], ids[t], axis=0, out=x[0], mode="clip")
            np.take(table[1], ids[back], axis=0, out=x[1], mode="clip")
            np.matmul(s, wg, out=a)
            a += x[:, :, : 2 * h]
            _bend_into(a, room_a)
            a *= F32(0.5)
            a += F32(0.5)
            np.matmul(a[:, :, :h] * s, wn, out=m)
            m += x[:, :, 2 * h :]
            _bend_into(m, room_m)
            s = s - m
            s *= a[:, :, h:]
            s += m
            states[0, t], states[1, back] = s[0], s[1]
        z = states[0].reshape(-1, h) @ self.p["Wo"][:h]
        z += states[1].reshape(-1, h) @ self.p["Wo"][h:]
        z += self.p["bo"]
        z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(axis=1, keepdims=True)
        return z.reshape(T, B, self.c)

    def loss_and_gradients(self, ids: np.ndarray, target: np.ndarray, weight: np.ndarray, doubt: float = 0.0):
        """Mean cross-entropy, gradients and mean probability of the target, by backpropagation through time.

        target: a class for each text of the batch, or one for each position (time, batch). A text that gets
        less than `doubt` for its labels on average says nothing.
        """
        p, h, e = self.p, self.h, self.e
        T, B = ids.shape
        target = np.broadcast_to(target, (T, B))
        emb = p["E"][ids]
        seqs = {"f": emb, "b": emb[::-1]}
        states = {d: self._scan(d, (seqs[d].reshape(-1, e) @ p[f"Wx{d}"] + p[f"b{d}"]).reshape(T, B, 3 * h)) for d in "fb"}
        both = np.concatenate([states["f"][0], states["b"][0][::-1]], axis=2)
        z = (both.reshape(-1, 2 * h) @ p["Wo"] + p["bo"]).reshape(T, B, self.c)
        z -= z.max(axis=2, keepdims=True)
        q = np.exp(z)
        q /= q.sum(axis=2, keepdims=True)
        own = np.take_along_axis(q, target[..., None], 2)[..., 0]
        sure = (own * weight).sum(axis=0) / np.maximum(1, weight.sum(axis=0))
        weight = weight * (sure >= doubt)
        total = max(1.0, float(weight.sum()))
        loss = float(-(np.log(own + 1e-9) * weight).sum() / total)
        dz = q.copy()
        dz[np.arange(T)[:, None], np.arange(B)[None, :], target] -= 1
        dz *= (weight / F32(total))[..., None]
        dz2 = dz.reshape(-1, self.c)
        grad = {"Wo": both.reshape(-1, 2 * h).T @ dz2, "bo": dz2.sum(axis=0)}
        dboth = (dz2 @ p["Wo"].T).reshape(T, B, 2 * h)
        demb = np.zeros((T, B, e), F32)
        slope = lambda y: y * np.sqrt(y)
        for d in "fb":
            out, g, n = states[d]
            dh_all = dboth[:, :, :h] if d == "f" else dboth[::-1, :, h:]
            wg, wn = np.ascontiguousarray(p[f"Wg{d}"].T), np.ascontiguousarray(p[f"Wn{d}"].T)
            dg_all, dm_all, carry = np.empty((T, B, 2 * h), F32), np.empty((T, B, h), F32), np.zeros((B, h), F32)
            start = np.zeros((B, h), F32)
            for t in range(T - 1, -1, -1):
                s0 = out[t - 1] if t else start
                r, u, m, bent = g[t, :, :h], g[t, :, h:], n[t], g[t] * (1 - g[t])
                bent = 4 * slope(bent)
                dh = dh_all[t] + carry
                dm = dh * (1 - u) * slope(1 - m * m)
                drs = dm @ wn
                dg = np.concatenate([drs * s0, dh * (s0 - m)], axis=1) * bent
                carry = dh * u + drs * r + dg @ wg
                dg_all[t], dm_all[t] = dg, dm
            before = np.concatenate([start[None], out[:-1]]).reshape(-1, h)
            dg, dm, own = dg_all.reshape(-1, 2 * h), dm_all.reshape(-1, h), seqs[d].reshape(-1, e)
            grad |= {f"Wg{d}": before.T @ dg, f"Wn{d}": (g[:, :, :h].reshape(-1, h) * before).T @ dm, f"b{d}": np.concatenate([dg.sum(axis=0), dm.sum(axis=0)]), f"Wx{d}": np.concatenate([own.T @ dg, own.T @ dm], axis=1)}
            wx = p[f"Wx{d}"]
            back = (dg @ wx[:, : 2 * h].T + dm @ wx[:, 2 * h :].T).reshape(T, B, e)
            demb += back if d == "f" else back[::-1]
        order = np.argsort(ids.reshape(-1), kind="stable")
        b = ids.reshape(-1)[order]
        start = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
        grad["E"] = np.zeros_like(p["E"])
        grad["E"][b[start]] = np.add.reduceat(demb.reshape(-1, e)[order], start, axis=0)
        return loss, grad, sure


def train(texts: list[bytes], labels: np.ndarray, classes: int, steps: int = 300, batch: int = 192, window: int = 64, rate: float = 0.012, hidden: int = 32, seed: int = 5, doubt: float = 0.25, changing: float = 0.3) -> ByteGru:
    """A network trained on windows of texts, from their start or a random place, drawn from each class by the root of its size.

    A share `changing` of the windows begins in one class and goes on, from a random word, in another, so that the network sees
    changes within a window; their positions have the labels of their parts. After a third of the steps a window that the network
    itself gives its labels less than `doubt` on average is left out: labels are partly wrong.
    """
    rng = np.random.default_rng(seed)
    net = ByteGru(classes, hidden, seed=seed)
    by = [np.flatnonzero(labels == c) for c in range(classes)]
    present = [c for c in range(classes) if len(by[c])]
    share = np.sqrt([len(by[c]) for c in present])
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}

    def piece(c: int, most: int) -> bytes:
        t = texts[by[c][rng.integers(len(by[c]))]]
        at = int(rng.integers(max(1, len(t) - most + 1))) if rng.random() < 0.4 else 0
        return t[at : at + most]

    for step in range(1, steps + 1):
        first, second = rng.choice(present, batch, p=share / share.sum()), rng.choice(present, batch, p=share / share.sum())
        ids = np.full((window, batch), 32, dtype=np.int64)
        target = np.repeat(first[None, :], window, axis=0)
        weight = np.zeros((window, batch), F32)
        for i in range(batch):
            part, rest = piece(first[i], window), b""
            if first[i] != second[i] and rng.random() < changing:
                # a blank stands between words; a language without blanks may end anywhere
                stop = part.find(b" ", int(rng.integers(8, window - 16))) + 1
                part = part[: stop or min(len(part), window // 2)]
                rest = piece(second[i], window - len(part))
                target[len(part) :, i] = second[i]
            both = np.frombuffer(part + rest, dtype=np.uint8)
            ids[: len(both), i] = both
            weight[: len(both), i] = 1
        _, grad, _ = net.loss_and_gradients(ids, target, weight, doubt if step > steps // 3 else 0.0)
        size = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        lr = rate * min(1.0, step / 20) * (0.5 + 0.5 * np.cos(np.pi * step / (steps + 1)))
        for k, g in grad.items():
            g = g * F32(min(1.0, 1.0 / (size + 1e-9)))
            m[k] += F32(0.1) * (g - m[k])
            v[k] += F32(0.01) * (g * g - v[k])
            net.p[k] -= F32(lr / (1 - 0.9**step)) * m[k] / (np.sqrt(v[k] / F32(1 - 0.99**step)) + F32(1e-8))
    return net
