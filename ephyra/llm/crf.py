"""Linear-chain conditional random fields over words: hashed features, training on the driver, batched forward-backward."""

from __future__ import annotations

from itertools import islice

import numpy as np
import regex
import xxhash

WORD = regex.compile(r"\p{L}+")
WORDS = WORD.findall
#: Rows of the feature table; words that a worker remembers before it starts anew.
DIM, MEMO = 1 << 17, 200_000
NGRAMS = (2, 3, 4)
PRIMES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def words_of(text: str | None) -> list[str]:
    """The runs of letters of a text in lower case."""
    return WORDS(text.lower()) if text else []


def places_of(text: str) -> list[tuple[int, int]]:
    """Where in the text, in its own code points, each of words_of(text) begins and ends, though lower case may be longer."""
    low = text.lower()
    found = [m.span() for m in WORD.finditer(low)]
    if len(low) == len(text):
        return found
    at = np.repeat(np.arange(len(text)), [len(c.lower()) for c in text])  # the character that each one of low comes from
    return [(int(at[a]), int(at[b - 1]) + 1) for a, b in found]


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the feature table, start of each word's rows): byte n-grams of the word between two marks, so that those with
    a mark are its prefixes and suffixes, and the word itself (the lexicon)."""
    raw = [b"\x01" + w.encode() + b"\x02" for w in words]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    b = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64) + np.uint64(1)
    word = np.repeat(np.arange(len(raw)), size)
    at, rows = [np.arange(len(raw))], []
    whole = np.fromiter((xxhash.xxh64_intdigest(r, 1) for r in raw), np.uint64, len(raw))
    rows.append(whole)
    for n in NGRAMS:
        if len(b) < n:
            continue
        h = np.full(len(b) - n + 1, n, np.uint64)
        for k in range(n):
            h = (h ^ b[k : len(b) - n + 1 + k]) * PRIMES[k]
            h ^= h >> np.uint64(29)
        inside = word[: len(h)] == word[n - 1 :]
        at.append(word[: len(h)][inside])
        rows.append(h[inside])
    at = np.concatenate(at)
    order = np.argsort(at, kind="stable")
    rows = (np.concatenate(rows)[order] % np.uint64(DIM)).astype(np.int64)
    return rows, np.searchsorted(at[order], np.arange(len(raw)))


class CRF:
    """Labels 0..k-1. weight: (DIM, k) of features; trans: (k, k) from label to label; first: (k,) at a text's begin."""

    def __init__(self, k: int):
        self.k = k
        self.weight, self.trans, self.first = np.zeros((DIM, k), np.float32), np.zeros((k, k)), np.zeros(k)

    # training

    def fit(self, sequences: list[tuple[list[str], list[int]]], epochs: int = 4, rate: float = 0.3, length: int = 48, batch: int = 64, seed: int = 0, decay: float = 1e-6) -> CRF:
        """Maximum likelihood by AdaGrad on pieces of `length` words. Time is linear in the words given."""
        vocab: dict[str, int] = {}
        pieces = [(np.array([vocab.setdefault(w, len(vocab)) for w in ws[i : i + length]]), np.array(ys[i : i + length])) for ws, ys in sequences for i in range(0, len(ws), length)]
        pieces = [p for p in pieces if len(p[0])]
        if not pieces:
            return self
        rows, start = features(list(vocab))
        ends = np.append(start[1:], len(rows))
        g_w, g_t, g_f = np.full_like(self.weight, 1e-4), np.full_like(self.trans, 1e-2), np.full_like(self.first, 1e-2)
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            order = rng.permutation(len(pieces))
            order = order[np.argsort([len(pieces[i][0]) // 8 for i in order], kind="stable")]
            groups = [order[i : i + batch] for i in range(0, len(order), batch)]
            for gi in rng.permutation(len(groups)):
                own = [pieces[i] for i in groups[gi]]
                n = np.array([len(x) for x, _ in own])
                t = n.max()
                x, y = np.zeros((len(own), t), np.int64), np.zeros((len(own), t), np.int64)
                mask = np.arange(t) < n[:, None]
                for i, (a, b) in enumerate(own):
                    x[i, : len(a)], y[i, : len(b)] = a, b
                used, inv = np.unique(x[mask], return_inverse=True)
                feat = np.concatenate([rows[start[u] : ends[u]] for u in used])
                seg = np.cumsum([0, *(ends[used] - start[used])[:-1]])
                emit_u = np.add.reduceat(self.weight[feat], seg, axis=0).astype(np.float64)
                emit = np.zeros((len(own), t, self.k))
                emit[mask] = emit_u[inv]
                node, edge = self._expect(emit, mask)
                gold = np.eye(self.k)[y]
                diff = ((node - gold) * mask[..., None])[mask]
                g_u = np.zeros((len(used), self.k))
                np.add.at(g_u, inv, diff)
                per = np.repeat(g_u, ends[used] - start[used], axis=0).astype(np.float32)
                fu, fi = np.unique(feat, return_inverse=True)
                g = np.zeros((len(fu), self.k), np.float32)
                np.add.at(g, fi, per)
                g = g / len(own) + decay * self.weight[fu]
                g_w[fu] += g * g
                self.weight[fu] -= rate * g / np.sqrt(g_w[fu])
                pair = mask[:, 1:]
                gt = np.zeros((self.k, self.k))
                np.add.at(gt, (y[:, :-1][pair], y[:, 1:][pair]), -1)
                gt = (gt + edge) / len(own)
                g_t += gt * gt
                self.trans -= rate * gt / np.sqrt(g_t)
                gf = (node[:, 0] - gold[:, 0]).mean(axis=0)
                g_f += gf * gf
                self.first -= rate * gf / np.sqrt(g_f)
        return self

    def _expect(self, emit: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of labels and summed marginals of label pairs, in scaled probabilities."""
        b, t, k = emit.shape
        e = np.exp(emit - emit.max(axis=2, keepdims=True))
        a, f = np.exp(self.trans - self.trans.max()), np.exp(self.first - self.first.max())
        alpha, beta = np.zeros((b, t, k)), np.ones((b, t, k))
        alpha[:, 0] = f * e[:, 0]
        alpha[:, 0] /= alpha[:, 0].sum(axis=1, keepdims=True)
        for i in range(1, t):
            alpha[:, i] = (alpha[:, i - 1] @ a) * e[:, i]
            alpha[:, i] /= alpha[:, i].sum(axis=1, keepdims=True)
        for i in range(t - 2, -1, -1):
            new = (e[:, i + 1] * beta[:, i + 1]) @ a.T
            new /= new.max(axis=1, keepdims=True)
            beta[:, i] = np.where(mask[:, i + 1, None], new, 1.0)
        node = alpha * beta
        node /= node.sum(axis=2, keepdims=True)
        pair = alpha[:, :-1, :, None] * a * (e[:, 1:] * beta[:, 1:])[:, :, None, :]
        pair /= pair.sum(axis=(2, 3), keepdims=True)
        return node, (pair * mask[:, 1:, None, None]).sum(axis=(0, 1))


class Tagger:
    """Forward-backward over many texts at once. The words of all texts form one chain in which the first word of a text
    forgets what came before. The chain is cut in blocks: the product of the transfer matrices of each block carries
    the messages over it, so that all blocks advance together, whatever the lengths of the texts."""

    def __init__(self, model: CRF, block: int = 64):
        self.m, self.block = model, block
        self.ids: dict[str, int] = {}
        self.table = np.zeros((0, model.k))
        self.a = np.exp(model.trans - model.trans.max())
        self.f = np.exp(model.first - model.first.max())

    def emissions(self, words: list[str]) -> np.ndarray:
        """exp of each word's summed weights, 1 at most; each new word is looked up once."""
        ids = self.ids
        if len(ids) > MEMO:
            ids.clear()
            self.table = self.table[:0]
        known = len(ids)
        at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
        if len(ids) > known:
            new = list(islice(reversed(ids), len(ids) - known))[::-1]
            rows, start = features(new)
            e = np.add.reduceat(self.m.weight[rows], start, axis=0).astype(np.float64)
            self.table = np.concatenate([self.table, np.exp(np.maximum(e - e.max(axis=1, keepdims=True), -60))])
        return self.table[at]

    def marginals(self, docs: list[list[str]]) -> np.ndarray:
        """The label marginals of all words of all texts, one after the other."""
        n = sum(map(len, docs))
        k, size = self.m.k, self.block
        if not n:
            return np.zeros((0, k))
        e = self.emissions([w for d in docs for w in d])
        begins = np.cumsum([0, *[len(d) for d in docs if d]])[:-1]
        blocks = -(-n // size)
        pad = blocks * size - n
        e = np.concatenate([e, np.ones((pad, k))]).reshape(blocks, size, k)
        fresh = np.zeros(blocks * size, bool)
        fresh[begins] = fresh[n:] = True  # what is past the end weighs on nothing
        fresh = fresh.reshape(blocks, size)
        a, f = self.a, self.f

        def step(v, i):  # row messages v (rows, k) over position i of each block
            return np.where(fresh[:, i, None], v.sum(axis=1, keepdims=True) * f, v @ a) * e[:, i]

        product = np.broadcast_to(np.eye(k), (blocks, k, k)).copy()
        for i in range(size):
            new = np.where(fresh[:, i, None, None], product.sum(axis=2, keepdims=True) * f, product @ a) * e[:, i, None, :]
            product = new / new.max(axis=(1, 2), keepdims=True)
        into, v = np.empty((blocks, k)), np.full(k, 1.0 / k)
        for b in range(blocks):
            into[b] = v
            v = v @ product[b]
            v = v / v.sum()
        back, v = np.empty((blocks, k)), np.ones(k)
        for b in range(blocks - 1, -1, -1):
            back[b] = v
            v = product[b] @ v
            v = v / v.max()
        alpha = np.empty((blocks, size, k))
        v = into
        for i in range(size):
            v = step(v, i)
            v = v / v.sum(axis=1, keepdims=True)
            alpha[:, i] = v
        v = back
        for i in range(size - 1, -1, -1):
            alpha[:, i] *= v
            ev = e[:, i] * v
            v = np.where(fresh[:, i, None], (ev * f).sum(axis=1, keepdims=True), ev @ a.T)
            v = v / v.max(axis=1, keepdims=True)
        out = alpha.reshape(-1, k)[:n]
        return out / out.sum(axis=1, keepdims=True)


def batches(texts, words: int = 200_000):
    """Lists of (place, words) whose words number about `words`, longer texts alone."""
    own, held = [], 0
    for i, t in enumerate(texts):
        w = words_of(t)
        own.append((i, w))
        held += len(w)
        if held >= words:
            yield own
            own, held = [], 0
    if own:
        yield own
