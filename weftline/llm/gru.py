"""A bidirectional gated recurrent network over bytes; trained in numpy by backpropagation through time.

A time step reads ``STRIDE`` bytes (the sum of one learned table per offset), so a text of n bytes takes n / STRIDE
steps; a head of its own per offset gives every byte position a distribution over the labels. Reading may run in
onnxruntime, which computes the same recurrence natively from the same parameters; without it numpy does.
"""

from __future__ import annotations

import numpy as np

STRIDE, TABLE = 6, 16


def frames(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``(time, text, STRIDE)`` byte values (0 pads) and the number of steps of each text."""
    n = np.array([max(1, -(-len(t) // STRIDE)) for t in texts])
    return _padded(texts, int(n.max())).reshape(len(texts), -1, STRIDE).transpose(1, 0, 2), n


def _padded(texts: list[bytes], steps: int) -> np.ndarray:
    return np.frombuffer(b"".join(t.ljust(steps * STRIDE, b"\0") for t in texts), dtype=np.uint8)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class BiGru:
    """Parameters are float32 arrays in ``p``; ``f`` and ``b`` are the two directions."""

    def __init__(self, labels: int, hidden: int = 16, seed: int = 0):
        rng = np.random.default_rng(seed)
        h = hidden
        self.h, self.labels = h, labels
        self.p: dict[str, np.ndarray] = {"e": rng.normal(0, 0.5, (STRIDE, 256, TABLE)), "w": rng.normal(0, 0.2, (2 * h, STRIDE * labels)), "c": np.zeros(STRIDE * labels)}
        for d in "fb":
            self.p[f"i{d}"] = rng.normal(0, 0.6 / np.sqrt(TABLE), (TABLE, 3 * h))
            self.p[f"u{d}"] = rng.normal(0, 0.6 / np.sqrt(h), (h, 3 * h))
            self.p[f"k{d}"] = np.zeros(3 * h)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self._session = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_session": None}

    def _read(self, x: np.ndarray) -> np.ndarray:
        e = self.p["e"]
        g = e[0][x[:, :, 0]]
        for o in range(1, STRIDE):
            g += e[o][x[:, :, o]]
        return g

    def _run(self, v: np.ndarray, mask: np.ndarray, d: str, keep: bool = False):
        h, u = self.h, self.p[f"u{d}"]
        g = v @ self.p[f"i{d}"] + self.p[f"k{d}"]
        steps, n = v.shape[:2]
        state = np.zeros((n, h), dtype=v.dtype)
        out = np.empty((steps, n, h), dtype=v.dtype)
        saved = []
        whole = int(mask.all(axis=1).sum())  # steps that all texts have
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a = state @ u
            zr = _sigmoid(g[t, :, : 2 * h] + a[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            c = np.tanh(g[t, :, 2 * h :] + r * a[:, 2 * h :])
            new = c + z * (state - c)
            if keep:
                saved.append((t, state, z, r, c, a[:, 2 * h :]))
            # what follows a text's end is never read; from behind, a text begins with a state of zeros
            state = new * mask[t][:, None] if d == "b" and t >= whole else new
            out[t] = state
        return out, saved

    def _scores(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``(STRIDE, label, time, text)`` scores, and steps of each text."""
        if self._session is None:
            self._session = _session(self) or False
        if self._session:
            n = np.array([max(1, -(-len(t) // STRIDE)) for t in texts], dtype=np.int32)
            pairs = _padded(texts, int(n.max())).view("<u2").reshape(len(texts), -1).T.astype(np.int32).reshape(-1, STRIDE // 2, len(texts))
            pairs += np.arange(0, STRIDE << 15, 1 << 16, dtype=np.int32)[:, None]
            s = self._session.run(None, {"x": pairs, "n": n})[0]
        else:
            x, n = frames(texts)
            mask = (np.arange(len(x))[:, None] < n[None, :]).astype(np.float32)
            v = self._read(x)
            both = np.concatenate([self._run(v, mask, "f")[0], self._run(v, mask, "b")[0]], axis=2)
            s = self.p["w"].T @ both.reshape(-1, 2 * self.h).T + self.p["c"][:, None]
        return s.reshape(STRIDE, self.labels, -1, len(texts)), n

    def log_probs(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``(STRIDE, label, time, text)`` log-probabilities, byte ``time * STRIDE + offset`` of each text, and steps per text."""
        s, n = self._scores(texts)
        return s - self._normal(s)[:, None], n

    def _normal(self, s: np.ndarray) -> np.ndarray:
        """Logarithm of the sum of exponentials over the labels."""
        bound = float((np.abs(self.p["w"]).sum(axis=0) + np.abs(self.p["c"])).max())
        top = s.max(axis=1) if bound > 60 else None  # below, no exponential overflows
        e = np.exp(s if top is None else s - top[:, None])
        total = np.log(e.sum(axis=1))
        return total if top is None else total + top

    def pooled(self, texts: list[bytes], at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The log-probabilities of the labels summed over the bytes between neighbouring bounds of each text, text by text, ``(part, label)``.

        ``at``: the bounds of all texts, one after the other; ``counts``: how many each text has.
        """
        s, _ = self._scores(texts)
        norm = self._normal(s)
        total = np.zeros((self.labels, s.shape[2] + 1, s.shape[3]), dtype=np.float64)
        np.cumsum(s.sum(axis=0) - norm.sum(axis=0), axis=1, out=total[:, 1:])
        text = np.repeat(np.arange(len(texts)), counts)
        step, rest = at // STRIDE, at % STRIDE
        value = total[:, step, text]
        for o in range(STRIDE - 1):  # the bytes of a step before a bound within it
            inside = np.flatnonzero(rest > o)
            value[:, inside] += s[o][:, step[inside], text[inside]] - norm[o][step[inside], text[inside]]
        return np.diff(value, axis=1)[:, text[1:] == text[:-1]].T

    def gradients(self, x: np.ndarray, n: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over all bytes and its gradient; ``y``: label of each byte, ``(time, text, STRIDE)``, -1 where none is."""
        h, p = self.h, self.p
        mask = (np.arange(len(x))[:, None] < n[None, :]).astype(np.float32)
        v = self._read(x)
        outs = {d: self._run(v, mask, d, True) for d in "fb"}
        both = np.concatenate([outs["f"][0], outs["b"][0]], axis=2)
        s = (both @ p["w"] + p["c"]).reshape(*y.shape, self.labels)
        s -= s.max(axis=3, keepdims=True)
        q = np.exp(s)
        q /= q.sum(axis=3, keepdims=True)
        seen = y >= 0
        total = seen.sum()
        label = np.where(seen, y, 0)[..., None]
        loss = float(-(np.log(np.take_along_axis(q, label, 3)[..., 0] + 1e-9) * seen).sum() / total)
        ds = q
        np.put_along_axis(ds, label, np.take_along_axis(ds, label, 3) - 1, 3)
        ds *= seen[..., None] / total
        ds = ds.reshape(*y.shape[:2], -1)
        flat = both.reshape(-1, 2 * h)
        grad = {"w": flat.T @ ds.reshape(len(flat), -1), "c": ds.sum(axis=(0, 1))}
        dboth = ds @ p["w"].T
        dv = np.zeros_like(v)
        for k, d in enumerate("fb"):
            u = p[f"u{d}"]
            dout = dboth[:, :, k * h : (k + 1) * h]
            du, dg = np.zeros_like(u), np.zeros((*x.shape[:2], 3 * h), dtype=v.dtype)
            carry = np.zeros((x.shape[1], h), dtype=v.dtype)
            for t, before, z, r, c, ac in reversed(outs[d][1]):
                m = mask[t][:, None]
                dh = (dout[t] + carry) * m
                dz = dh * (before - c) * z * (1 - z)
                dc = dh * (1 - z) * (1 - c * c)
                dr = dc * ac * r * (1 - r)
                da = np.concatenate([dz, dr, dc * r], axis=1)
                dg[t] = np.concatenate([dz, dr, dc], axis=1)
                du += before.T @ da
                carry = da @ u.T + dh * z + carry * (1 - m)
            grad[f"u{d}"], grad[f"k{d}"] = du, dg.sum(axis=(0, 1))
            grad[f"i{d}"] = v.reshape(-1, TABLE).T @ dg.reshape(-1, 3 * h)
            dv += dg @ p[f"i{d}"].T
        e = np.zeros_like(p["e"])
        rows = dv.reshape(-1, TABLE)
        for o in range(STRIDE):
            b = x[:, :, o].ravel()
            order = np.argsort(b, kind="stable")
            values, starts = np.unique(b[order], return_index=True)
            e[o][values] = np.add.reduceat(rows[order], starts, axis=0)
        grad["e"] = e
        return loss, grad

    def fit(self, texts: list[bytes], labels: list[np.ndarray], rounds: int = 8, size: int = 64, rate: float = 0.02, seed: int = 0) -> list[float]:
        """Adam over mini-batches of similar length, with a rate that falls to nothing; ``labels``: one per byte of each text. Gives the mean loss of each round."""
        rng = np.random.default_rng(seed)
        self._session = None
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        order = np.argsort([len(t) for t in texts], kind="stable")
        batches = [order[a : a + size] for a in range(0, len(order), size)]
        step, losses = 0, []
        for _ in range(rounds):
            rng.shuffle(batches)
            total = 0.0
            for ids in batches:
                x, n = frames([texts[i] for i in ids])
                y = np.full((len(ids), len(x) * STRIDE), -1)
                for j, i in enumerate(ids):
                    y[j, : len(labels[i])] = labels[i]
                loss, grad = self.gradients(x, n, y.reshape(len(ids), -1, STRIDE).transpose(1, 0, 2))
                total += loss
                step += 1
                norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
                for k, g in grad.items():
                    g = g * min(1.0, 1.0 / (norm + 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v2[k] = 0.99 * v2[k] + 0.01 * g * g
                    self.p[k] -= (rate * (1 - step / (rounds * len(batches) + 1)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
            losses.append(total / len(batches))
        return losses


# --- the network as an ONNX graph: messages of the public ONNX format, written field by field


def _number(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _int(field: int, value: int) -> bytes:
    return _number(field << 3) + _number(value)


def _part(field: int, value: bytes | str) -> bytes:
    raw = value.encode() if isinstance(value, str) else value
    return _number(field << 3 | 2) + _number(len(raw)) + raw


def _tensor(name: str, a: np.ndarray) -> bytes:
    kind = {"float32": 1, "int64": 7}[a.dtype.name]
    return b"".join(_int(1, d) for d in a.shape) + _int(2, kind) + _part(8, name) + _part(9, np.ascontiguousarray(a).tobytes())


def _attribute(name: str, value: int | str | list[int]) -> bytes:
    if isinstance(value, int):
        return _part(1, name) + _int(3, value) + _int(20, 2)
    if isinstance(value, str):
        return _part(1, name) + _part(4, value) + _int(20, 3)
    return _part(1, name) + b"".join(_int(8, x) for x in value) + _int(20, 7)


def _node(op: str, inputs: str, output: str, **attributes: int | str | list[int]) -> bytes:
    return b"".join(_part(1, x) for x in inputs.split()) + _part(2, output) + _part(4, op) + b"".join(_part(5, _attribute(k, v)) for k, v in attributes.items())


def _value(name: str, kind: int, *shape: int | str) -> bytes:
    dims = b"".join(_part(1, _part(2, d) if isinstance(d, str) else _int(1, d)) for d in shape)
    return _part(1, name) + _part(2, _part(1, _int(1, kind) + _part(2, dims)))


def graph(net: BiGru) -> bytes:
    """The network from pairs of bytes (offset by their table, which adds up those of two bytes) to scores, as an ONNX model."""
    p, h = net.p, net.h
    weights = {
        "e": (p["e"][0::2, None, :] + p["e"][1::2, :, None]).reshape(-1, TABLE), "i": np.stack([p["if"].T, p["ib"].T]), "u": np.stack([p["uf"].T, p["ub"].T]), "w": p["w"].T, "c": p["c"][:, None],
        "k": np.stack([np.concatenate([p[f"k{d}"], np.zeros(3 * h, np.float32)]) for d in "fb"]), "axis": np.array([1]), "flat": np.array([-1, 2 * h]),
    }
    nodes = [
        _node("Gather", "e x", "rows"), _node("ReduceSum", "rows axis", "read", keepdims=0), _node("GRU", "read i u k n", "states", hidden_size=h, linear_before_reset=1, direction="bidirectional"),
        _node("Transpose", "states", "turned", perm=[0, 2, 1, 3]), _node("Reshape", "turned flat", "both"), _node("Gemm", "w both c", "scores", transB=1),
    ]
    body = b"".join(_part(1, x) for x in nodes) + _part(2, "net") + b"".join(_part(5, _tensor(k, v)) for k, v in weights.items())
    body += _part(11, _value("x", 6, "time", STRIDE // 2, "text")) + _part(11, _value("n", 6, "text")) + _part(12, _value("scores", 1, STRIDE * net.labels, "steps"))
    return _int(1, 8) + _part(7, body) + _part(8, _part(1, "") + _int(2, 14))


def _session(net: BiGru):
    """A session of one thread, or None where the runtime is absent."""
    try:
        import onnxruntime
    except ImportError:
        return None
    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = options.inter_op_num_threads = 1
    options.log_severity_level = 3
    options.enable_cpu_mem_arena = False
    return onnxruntime.InferenceSession(graph(net), options, providers=["CPUExecutionProvider"])
