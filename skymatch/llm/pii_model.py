"""The character model of personal data: bidirectional LSTMs with a CRF that tag windows, a coarse and a fine one, and a gate that asks for more of them, all in numpy.

The gate weighs character triples by how much more often they stand in mentions than elsewhere and marks where neighbouring triples add
up to what nearly all mentions it has learnt reach. It knows no notation; what stands there is for the tagger to decide.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, str]
WINDOW = 128
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
CHARS = 98  # padding, printable ASCII, other letters, others
CLASSES = 64  # the gate's: space, letters without case, digits, signs, others


def _char_table() -> tuple[np.ndarray, np.ndarray]:
    """The tagger's and the gate's number of each code point below 2**16."""
    fine, coarse = np.full(2**16, 97, np.uint8), np.zeros(2**16, np.uint8)
    fine[32:127] = np.arange(1, 96)
    signs = 0
    for i in range(2**16):
        c = chr(i)
        if i >= 127 and c.isalpha():
            fine[i] = 96
        if i < 127 and c.isalpha():
            coarse[i] = 1 + ord(c.lower()) - ord("a")
        elif i < 127 and c.isdigit():
            coarse[i] = 27
        elif 32 < i < 127:
            coarse[i] = 30 + signs
            signs += 1
        elif i >= 127:
            coarse[i] = 28 if c.isalpha() else 29
    return fine, coarse


_FINE, _COARSE = _char_table()


def code_points(text: str) -> np.ndarray:
    """Those above 2**16 count as one of them."""
    return np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), 2**16 - 1)


def char_ids(text: str) -> np.ndarray:
    return _FINE[code_points(text)].astype(np.int64)


@dataclass
class Gate:
    """weights: of character triples; least: what `span` neighbouring ones must add up to."""

    weights: np.ndarray
    least: float
    span: int = 8

    @staticmethod
    def triples(text: str) -> np.ndarray:
        x = _COARSE[code_points(text)].astype(np.int32)
        x = np.concatenate([np.zeros(1, np.int32), x, np.zeros(1, np.int32)])
        return (x[:-2] * CLASSES + x[1:-1]) * CLASSES + x[2:]

    def sums(self, text: str) -> np.ndarray:
        """For each character the sum of the triples around it and the next span - 1 ones."""
        w = np.concatenate([self.weights[self.triples(text)], np.zeros(self.span - 1, np.float32)])
        total = np.concatenate([[0.0], np.cumsum(w, dtype=float)])
        return total[self.span :] - total[: -self.span]

    def hits(self, text: str, piece: int = 1_000_000) -> np.ndarray:
        """Characters from which on the triples reach the least sum. Long texts are taken in pieces that overlap."""
        if len(text) <= piece:
            return np.flatnonzero(self.sums(text) >= self.least)
        more = self.span + 1
        out = []
        for at in range(0, len(text), piece):
            a = max(0, at - 1)
            sums = self.sums(text[a : at + piece + more])[at - a :][: min(piece, len(text) - at)]
            out.append(at + np.flatnonzero(sums >= self.least))
        return np.concatenate(out)


def learn_gate(examples: list[tuple[str, list[Span]]], lost: float = 0.003) -> Gate:
    """lost: share of each kind's mentions that may stay below the least sum."""
    inside, outside = np.zeros(CLASSES**3), np.zeros(CLASSES**3)
    for text, spans in examples:
        t, mark = Gate.triples(text), np.zeros(len(text), bool)
        for a, b, _ in spans:
            mark[a:b] = True
        np.add.at(inside, t[mark], 1)
        np.add.at(outside, t[~mark], 1)
    share = np.log((inside + 0.5) / (inside.sum() + 1)) - np.log((outside + 0.5) / (outside.sum() + 1))
    gate = Gate(np.where(inside + outside > 0, np.clip(share, -3, 5), 0).astype(np.float32), 0.0)
    best: dict[str, list[float]] = {}
    for text, spans in examples:
        sums = gate.sums(text)
        for a, b, kind in spans:
            best.setdefault(kind, []).append(float(sums[max(0, a - 4) : b].max()))
    gate.least = min((float(np.quantile(x, lost)) for x in best.values()), default=np.inf)
    return gate


@dataclass
class Tagger:
    """Tags groups of as many neighbouring characters as emb has tables, one by default.

    emb[step, chars, e]; wx[2, e, 4h], wh[2, h, 4h], b[2, 4h] for both directions; wo[2h, tags], bo; moves[from, to], first, last. coarse: a tagger of larger groups and
    fewer units that says where this one has to look."""

    p: dict[str, np.ndarray]
    coarse: Tagger | None = None

    @classmethod
    def new(cls, e: int = 16, h: int = 24, seed: int = 5, step: int = 1) -> Tagger:
        r = np.random.default_rng(seed)
        scale = lambda *s: (r.standard_normal(s) / np.sqrt(s[-2])).astype(np.float32)
        p = {"emb": r.standard_normal((step, CHARS, e)).astype(np.float32) * 0.3, "wx": scale(2, e, 4 * h), "wh": scale(2, h, 4 * h), "b": np.zeros((2, 4 * h), np.float32)}
        p |= {"wo": scale(2 * h, TAGS), "bo": np.zeros(TAGS, np.float32), "moves": np.zeros((TAGS, TAGS), np.float32), "first": np.zeros(TAGS, np.float32), "last": np.zeros(TAGS, np.float32)}
        p["b"][:, h : 2 * h] = 1  # gates that forget start open
        return cls(p)

    def grouped(self, ids: np.ndarray) -> np.ndarray:
        """ids[batch, steps, step], the last ones padded."""
        k = len(self.p["emb"])
        return np.pad(ids, ((0, 0), (0, -ids.shape[1] % k))).reshape(len(ids), -1, k)

    def lengths(self, ids: np.ndarray) -> np.ndarray:
        """How many groups of each window aren't padding."""
        return -(-(ids > 0).sum(1) // len(self.p["emb"]))

    def _emissions(self, ids: np.ndarray, piece: int = 256) -> np.ndarray:
        """The same without what the gradient needs, in place, a piece of the batch at a time. Windows lie along the last axis, so that every operation runs over whole rows; signs and the
        doubled argument of tanh(x) = 1 - 2 / (1 + exp(2x)) are in the weights, so that one exponential a step serves all gates."""
        p = self.p
        groups, h, dtype = self.grouped(ids), p["wh"].shape[1], p["emb"].dtype
        count, t, k = groups.shape
        sign = np.repeat(np.array([-1, 2], dtype), [3 * h, h])
        wx, wh = (np.ascontiguousarray((np.concatenate(w, axis=1) * sign).transpose(0, 2, 1)) for w in ((p["wx"], p["b"][:, None]), (p["wh"],)))
        emb = np.pad(p["emb"], ((0, 0), (0, 0), (0, 1)))
        emb[0, :, -1] = 1  # meets the biases
        wo, bo = np.ascontiguousarray(p["wo"].T), p["bo"][:, None]
        out = np.empty((t, TAGS, count), dtype)
        for start in range(0, count, piece):
            by_step = np.ascontiguousarray(groups[start : start + piece].transpose(1, 2, 0))  # [t, step, n]
            n = by_step.shape[2]
            x = np.take(emb[0], by_step[:, 0], axis=0, mode="clip")
            for j in range(1, k):
                x += np.take(emb[j], by_step[:, j], axis=0, mode="clip")
            real = by_step[:, 0] > 0
            full = real.all(1)
            state, cell, z, add = np.zeros((2, h, n), dtype), np.zeros((2, h, n), dtype), np.empty((2, 4 * h, n), dtype), np.empty((2, 4 * h, n), dtype)
            new, hs = np.empty_like(cell), np.empty((t, 2 * h, n), dtype)
            with np.errstate(over="ignore"):
                for i in range(t):
                    back = t - 1 - i
                    np.matmul(wh, state, out=z)
                    np.matmul(wx[0], x[i].T, out=add[0])
                    np.matmul(wx[1], x[back].T, out=add[1])
                    z += add
                    np.exp(z, out=z)
                    z += 1
                    np.reciprocal(z, out=z)
                    np.multiply(z[:, 3 * h :], -2, out=new)
                    new += 1
                    new *= z[:, :h]
                    cell *= z[:, h : 2 * h]
                    cell += new
                    if not full[back]:  # forward, padding comes after all that counts
                        cell[1] *= real[back]
                    np.multiply(cell, 2, out=new)
                    np.exp(new, out=new)
                    new += 1
                    np.reciprocal(new, out=new)
                    new *= -2
                    new += 1
                    np.multiply(new, z[:, 2 * h : 3 * h], out=state)
                    if not full[back]:
                        state[1] *= real[back]
                    hs[i, :h] = state[0]
                    hs[back, h:] = state[1]
            np.add(np.matmul(wo, hs), bo, out=out[:, :, start : start + n])
        return out.transpose(2, 0, 1)

    def clear(self, e: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """float[time, batch]: each place's marginal of the outside tag, by the recursions of `marginals` in the precision of the emissions, windows along the last axis; 1 on padding, NaN where that doesn't do."""
        moves, first, last = (np.exp(self.p[c].astype(float)).astype(e.dtype)[..., None] for c in ("moves", "first", "last"))
        moves = moves[..., 0] / moves[0, 0, 0]
        onward = np.ascontiguousarray(moves.T)
        on = np.arange(e.shape[1])[:, None] < lengths
        full = on.all(1)
        with np.errstate(divide="ignore", invalid="ignore", over="ignore", under="ignore"):
            x = e.transpose(1, 2, 0)
            x = np.subtract(x, x[:, :1], order="C")
            np.exp(x, out=x)
            ahead = np.empty_like(x)
            np.multiply(first, x[0], out=ahead[0])
            for t in range(1, len(x)):
                np.matmul(onward, ahead[t - 1], out=ahead[t])
                ahead[t] *= x[t]
                if not t % 8:
                    ahead[t] /= ahead[t].sum(0)
            out, b = np.empty(on.shape, e.dtype), np.repeat(last, len(e), axis=1)
            step = np.empty_like(b)
            for t in range(len(x) - 1, -1, -1):
                if t < len(x) - 1:
                    x[t + 1] *= b
                    np.matmul(moves, x[t + 1], out=step)
                    if not t % 8:
                        step /= step.sum(0)
                    b, step = (step, b) if full[t + 1] else (np.where(on[t + 1], step, b), step)
                ahead[t] *= b
                np.divide(ahead[t, 0], ahead[t].sum(0), out=out[t])
        out[~on] = 1
        return out

    def outside(self, e: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """For each window the least marginal of the outside tag; NaN where single precision doesn't do."""
        return self.clear(e, lengths).min(0)

    def suspected(self, ids: np.ndarray, least: float) -> list[np.ndarray]:
        """Where the groups of each window begin that have a tag other than outside with at least this probability."""
        e, lengths = self.emissions(ids), self.lengths(ids)
        q = self.clear(e, lengths)
        lost = np.flatnonzero(np.isnan(q).any(0))
        if len(lost):
            q[:, lost] = np.where(np.arange(len(q))[:, None] < lengths[lost], self.marginals(e[lost].astype(float), lengths[lost])[0][:, :, 0].T, 1)
        window, at = np.nonzero((q <= 1 - least).T)
        return np.split(at * len(self.p["emb"]), np.searchsorted(window, np.arange(1, len(ids))))

    def emissions(self, ids: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """float[batch, groups, tags] of ids[batch, time], 0 where there is padding (at the end). keep: gets what the gradient needs."""
        if keep is None:
            return self._emissions(ids)
        p = self.p
        groups, h = self.grouped(ids), p["wh"].shape[1]
        n, t, k = groups.shape
        mask = (groups[:, :, 0] > 0).astype(p["emb"].dtype)
        masks = np.stack([mask, mask[:, ::-1]])
        x = p["emb"][np.arange(k), groups].sum(2)
        both = np.stack([x, x[:, ::-1]])
        by_step = both @ p["wx"][:, None] + p["b"][:, None, None]  # what the characters add to the gates of either direction
        state, cell = np.zeros((2, n, h), mask.dtype), np.zeros((2, n, h), mask.dtype)
        hs = np.empty((t, 2, n, h), mask.dtype)
        steps = []
        for i in range(t):
            z = by_step[:, :, i] + state @ p["wh"]
            gates = 1 / (1 + np.exp(-z[..., : 3 * h]))
            new = np.tanh(z[..., 3 * h :])
            m = masks[:, :, i, None]
            before = cell
            cell = (gates[..., h : 2 * h] * cell + gates[..., :h] * new) * m
            out = np.tanh(cell)
            state_before = state
            state = gates[..., 2 * h :] * out * m
            hs[i] = state
            steps.append((gates, new, before, out, state_before, m))
        features = np.concatenate([hs[:, 0].transpose(1, 0, 2), hs[::-1, 1].transpose(1, 0, 2)], axis=2)  # [n, t, 2h]
        keep |= {"groups": groups, "both": both, "steps": steps, "features": features}
        return features @ p["wo"] + p["bo"]

    def gradients(self, d: np.ndarray, keep: dict) -> dict[str, np.ndarray]:
        """Of the parameters up to the emissions, from those of the emissions."""
        p, g = self.p, {k: np.zeros_like(v) for k, v in self.p.items()}
        h, f = p["wh"].shape[1], keep["features"]
        n, t, k = keep["groups"].shape
        g["wo"] = f.reshape(n * t, -1).T @ d.reshape(n * t, -1)
        g["bo"] = d.sum((0, 1))
        df = d @ p["wo"].T
        dh = np.stack([df[:, :, :h], df[:, ::-1, h:]])  # [2, n, t, h] in the directions' own order
        dz_all = np.empty((t, 2, n, 4 * h), d.dtype)
        d_state, d_cell = np.zeros((2, n, h), d.dtype), np.zeros((2, n, h), d.dtype)
        for i in range(t - 1, -1, -1):
            gates, new, before, out, state_before, m = keep["steps"][i]
            ds = (d_state + dh[:, :, i]) * m
            i_, f_, o_ = gates[..., :h], gates[..., h : 2 * h], gates[..., 2 * h :]
            dc = (d_cell + ds * o_ * (1 - out**2)) * m
            dz = dz_all[i]
            dz[..., :h] = dc * new * i_ * (1 - i_)
            dz[..., h : 2 * h] = dc * before * f_ * (1 - f_)
            dz[..., 2 * h : 3 * h] = ds * out * o_ * (1 - o_)
            dz[..., 3 * h :] = dc * i_ * (1 - new**2)
            d_cell = dc * f_
            d_state = dz @ p["wh"].transpose(0, 2, 1)
            g["wh"] += state_before.transpose(0, 2, 1) @ dz
        g["b"] = dz_all.sum((0, 2))
        by_row = dz_all.transpose(1, 2, 0, 3).reshape(2, n * t, 4 * h)  # [2, n * t, 4h] in the directions' own order
        both = keep["both"].reshape(2, n * t, -1)
        g["wx"] = both.transpose(0, 2, 1) @ by_row
        dx = (by_row @ p["wx"].transpose(0, 2, 1)).reshape(2, n, t, -1)
        dx = (dx[0] + dx[1, :, ::-1]).reshape(n * t, -1)
        for j in range(k):
            g["emb"][j] = np.eye(CHARS, dtype=d.dtype)[:, keep["groups"][:, :, j].ravel()] @ dx
        return g

    def marginals(self, e: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tag marginals, log-partition, and forward and backward messages, each step's scaled to sum to 1, the latter with the emissions."""
        p = self.p
        n, t, k = e.shape
        moves, last = np.exp(p["moves"].astype(float)), np.exp(p["last"].astype(float))
        top = e.max(2, keepdims=True).astype(float)
        x = np.exp(e - top)
        ahead, back = np.empty((n, t, k)), np.empty((n, t, k))
        on = (np.arange(t)[:, None] < lengths)[:, :, None]
        a = np.exp(p["first"].astype(float)) * x[:, 0]
        scale = a.sum(1, keepdims=True)
        z = np.log(scale[:, 0]) + top[:, 0, 0]
        ahead[:, 0] = a = a / scale
        for i in range(1, t):
            step = (a @ moves) * x[:, i]
            scale = step.sum(1, keepdims=True)
            ahead[:, i] = a = np.where(on[i], step / scale, a)
            z += np.where(on[i, :, 0], np.log(scale[:, 0]) + top[:, i, 0], 0)
        z += np.log(a @ last)
        back[:, t - 1] = b = np.broadcast_to(last / last.sum(), (n, k))
        for i in range(t - 2, -1, -1):
            step = (x[:, i + 1] * b) @ moves.T
            back[:, i] = b = np.where(on[i + 1], step / step.sum(1, keepdims=True), b)
        q = ahead * back
        return q / q.sum(2, keepdims=True), z, ahead, x * back

    def loss(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tags of the windows' groups, and its gradients."""
        keep: dict = {}
        p = self.p
        e = self.emissions(ids, keep)
        n, t, k = e.shape
        lengths = self.lengths(ids)
        q, z, ahead, back = self.marginals(e, lengths)
        real = np.arange(t) < lengths[:, None]
        one = np.eye(k, dtype=e.dtype)[tags]
        score = (e * one).sum((1, 2), where=real[:, :, None]) + p["first"][tags[:, 0]]
        pairs = real[:, 1:]
        score += (p["moves"][tags[:, :-1], tags[:, 1:]] * pairs).sum(1)
        ends = tags[np.arange(n), lengths - 1]
        score += p["last"][ends]
        g = self.gradients((np.where(real[:, :, None], q - one, 0) / n).astype(e.dtype), keep)
        moves = np.exp(p["moves"].astype(float))
        joint = np.einsum("ntj,ntj->nt", ahead[:, :-1] @ moves, back[:, 1:])
        expected = moves * ((ahead[:, :-1] * (pairs / joint)[:, :, None]).reshape(-1, k).T @ back[:, 1:].reshape(-1, k))
        observed = (one[:, :-1] * pairs[:, :, None]).reshape(-1, k).T @ one[:, 1:].reshape(-1, k)
        g["moves"] = (expected - observed) / n
        g["first"] = (q[:, 0] - one[:, 0]).sum(0) / n
        g["last"] = (q[np.arange(n), lengths - 1] - np.eye(k)[ends]).sum(0) / n
        return float((z - score).mean()), g

    def decode(self, ids: np.ndarray) -> list[list[tuple[int, int, str, float]]]:
        """Spans (start, end, kind, least marginal of their tags) of each window's best tag sequence, in groups."""
        p = self.p
        e = self.emissions(ids)
        lengths = self.lengths(ids)
        out: list[list[tuple[int, int, str, float]]] = [[] for _ in range(len(e))]
        hot = np.flatnonzero(~(self.outside(e, lengths) >= 0.9))  # elsewhere the best sequence marks nothing that counts
        if not len(hot):
            return out
        e, lengths = e[hot].astype(float), lengths[hot]
        q = self.marginals(e, lengths)[0]
        n, t, k = e.shape
        best, from_ = p["first"] + e[:, 0], np.zeros((n, t, k), np.int8)
        for i in range(1, t):
            x = best[:, :, None] + p["moves"]
            on = (i < lengths)[:, None]
            from_[:, i] = np.where(on, x.argmax(1), np.arange(k))
            best = np.where(on, x.max(1) + e[:, i], best)
        path = np.empty((n, t), int)
        path[:, t - 1] = (best + p["last"]).argmax(1)
        for i in range(t - 1, 0, -1):
            path[:, i - 1] = from_[np.arange(n), i, path[:, i]]
        for w in np.flatnonzero((path > 0).any(1)):
            i, size = 0, int(lengths[w])
            while i < size:
                tag = int(path[w, i])
                if not tag:
                    i += 1
                    continue
                kind, j = (tag - 1) // 2, i + 1
                while j < size and path[w, j] == 2 + 2 * kind:
                    j += 1
                out[hot[w]].append((i, j, KINDS[kind], float(q[w, np.arange(i, j), path[w, i:j]].min())))
                i = j
        return out


def later(ids: np.ndarray, tags: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows without their first n characters, so that mentions lie otherwise in groups each time. Windows that this would empty stay."""
    if not n:
        return ids, tags
    cut = ids[:, n] > 0
    ids, tags = (np.where(cut[:, None], np.pad(x[:, n:], ((0, 0), (0, n))), x) for x in (ids, tags))
    tags[:, 0] -= (tags[:, 0] > 0) & (tags[:, 0] % 2 == 0)
    return ids, tags


def train(examples: list[tuple[str, list[Span]]], epochs: int = 10, batch: int = 64, rate: float = 0.03, seed: int = 5, h: int = 24, step: int = 1) -> Tagger:
    """Adam on windows of at most WINDOW characters with their spans. A group has the first tag in it that isn't outside."""
    model = Tagger.new(h=h, seed=seed, step=step)
    if not examples:
        return model
    ids, tags = np.zeros((len(examples), WINDOW), np.int64), np.zeros((len(examples), WINDOW), np.int64)
    for n, (text, spans) in enumerate(examples):
        ids[n, : len(text)] = char_ids(text)
        for a, b, kind in spans:
            tags[n, a:b] = 2 + 2 * KINDS.index(kind)
            tags[n, a] -= 1
    r = np.random.default_rng(seed)
    m, v, done = {k: 0.0 for k in model.p}, {k: 0.0 for k in model.p}, 0
    for epoch in range(epochs):
        order_ = r.permutation(len(ids))
        for i in range(0, len(ids), batch):
            at = order_[i : i + batch]
            x, y = later(ids[at], tags[at], int(r.integers(step)) if step > 1 else 0)
            y = model.grouped(y)
            _, g = model.loss(x, np.take_along_axis(y, (y > 0).argmax(2)[:, :, None], 2)[:, :, 0])
            norm = np.sqrt(sum(float((x.astype(float) ** 2).sum()) for x in g.values()))
            done += 1
            speed = rate * min(1.0, 2 * (1 - (epoch + i / len(ids)) / epochs) + 0.05)
            for k, x in g.items():
                x = x * min(1.0, 5 / max(norm, 1e-9))
                m[k], v[k] = 0.9 * m[k] + 0.1 * x, 0.99 * v[k] + 0.01 * x * x
                model.p[k] -= (speed * (m[k] / (1 - 0.9**done)) / (np.sqrt(v[k] / (1 - 0.99**done)) + 1e-8)).astype(model.p[k].dtype)
    return model


def packed(gate: Gate, tagger: Tagger) -> bytes:
    out = io.BytesIO()
    coarse = tagger.coarse.p if tagger.coarse else {}
    np.savez_compressed(out, gate=gate.weights, least=np.array([gate.least, gate.span]), **{f"p_{k}": v for k, v in tagger.p.items()}, **{f"c_{k}": v for k, v in coarse.items()})
    return out.getvalue()


def unpacked(data: bytes) -> tuple[Gate, Tagger]:
    with np.load(io.BytesIO(data), allow_pickle=False) as z:
        fine, coarse = ({k[2:]: z[k] for k in z.files if k.startswith(start)} for start in ("p_", "c_"))
        return Gate(z["gate"], float(z["least"][0]), int(z["least"][1])), Tagger(fine, Tagger(coarse) if coarse else None)
