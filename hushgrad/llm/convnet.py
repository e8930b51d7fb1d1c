"""A convolutional text classifier in numpy: hashed word embeddings, several filter widths, max pooling, one output.

A word's vector is the sum of an embedding of the word's hash and one of its first bytes' hash, so that unseen forms
of a stem have a meaning too. Filters of each width slide over the words; each keeps its largest value over the whole
text. Gradients reach only the words where those maxima lie, which keeps training cheap.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

#: Buckets of whole words and of stems, bytes of a stem, width of a vector, filter widths and filters of each.
WORD_BUCKETS, STEM_BUCKETS, STEM, SIZE, WIDTHS, FILTERS = 1 << 15, 1 << 13, 4, 12, (1, 2, 3), 12
#: Words that are scored at once; longer texts are scored in parts that overlap by all but one word of the widest
#: filter, so that each place of a filter lies in exactly one part.
CHUNK = 1 << 15
#: Passes over the labelled texts, texts in a step, step size.
EPOCHS, BATCH, RATE = 8, 48, 0.004

_TO_SPACE = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
#: Frequent short words that tell languages apart (fixed values).
TELLING = {
    "en": "the of and to is that for it with as was this from by are",
    "fr": "le et les des une du dans est pour qui au par avec sur",
    "de": "der die und das ist von den mit nicht ein eine im dem für auf",
    "es": "el los las y del una con por se su para al como más lo",
}
LANGUAGES = ("other", *TELLING)
_LANGUAGE = {w.encode(): i for i, words in enumerate(TELLING.values(), 1) for w in words.split()}
_CACHE = 500_000


class Words(dict):
    """Word -> its bucket, its stem's bucket and its language's number, in one integer."""

    def __missing__(self, w: bytes) -> int:
        x = zlib.crc32(w) % WORD_BUCKETS | zlib.crc32(w[:STEM], 7) % STEM_BUCKETS << 15 | _LANGUAGE.get(w, 0) << 28
        if len(w) <= 40:
            if len(self) >= _CACHE:
                self.clear()
            self[w] = x
        return x


_words = Words()


def codes(text: str | None) -> np.ndarray:
    words = text.encode().lower().translate(_TO_SPACE).split() if text else []
    return np.fromiter(map(_words.__getitem__, words), np.int64, len(words))


def language(code: np.ndarray) -> int:
    """Which language's telling words the text has most of; 0 if none."""
    n = np.bincount(code >> 28, minlength=len(LANGUAGES))
    n[0] = 0
    return int(n.argmax())


@dataclass
class Net:
    word: np.ndarray
    stem: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def new(cls, seed: int = 11) -> Net:
        rng = np.random.default_rng(seed)
        f = lambda *s, k: (rng.standard_normal(s) * k).astype(np.float32)
        total = FILTERS * len(WIDTHS)
        return cls(f(WORD_BUCKETS, SIZE, k=0.05), f(STEM_BUCKETS, SIZE, k=0.05), [f(w * SIZE, FILTERS, k=(w * SIZE) ** -0.5) for w in WIDTHS], np.zeros(total, np.float32), f(total, k=0.2), np.zeros(1, np.float32))

    def vectors(self, code: np.ndarray) -> np.ndarray:
        return self.word[code & (WORD_BUCKETS - 1)] + self.stem[(code >> 15) & (STEM_BUCKETS - 1)]

    def slid(self, x: np.ndarray) -> list[np.ndarray]:
        """For each width, every filter (rows) at each position (columns) of vectors that end in zeros."""
        n = len(x) - WIDTHS[-1] + 1
        parts = np.concatenate([f.reshape(w, SIZE, FILTERS).transpose(0, 2, 1).reshape(-1, SIZE) for f, w in zip(self.filters, WIDTHS, strict=True)]) @ x.T
        out, at = [], 0
        for w in WIDTHS:
            v = parts[at : at + FILTERS, :n]
            for i in range(1, w):
                v = v + parts[at + i * FILTERS : at + (i + 1) * FILTERS, i : i + n]
            out.append(v)
            at += w * FILTERS
        return out


def _laid_out(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of several texts one after the other, each followed by places for zeros, and where each begins and ends."""
    gap = WIDTHS[-1] - 1
    starts = np.cumsum([0, *[max(1, len(t)) + gap for t in texts]])
    flat = np.full(starts[-1] + gap, -1, np.int64)
    for t, s in zip(texts, starts, strict=False):
        flat[s : s + len(t)] = t
    return flat, starts[:-1], starts[1:] - gap


def pooled(net: Net, texts: list[np.ndarray], goes_on: bool = False) -> np.ndarray:
    """Largest value of each filter over each text; of a part of a text that goes on, only over places inside it."""
    flat, starts, ends = _laid_out(texts)
    if goes_on:
        ends = ends - (WIDTHS[-1] - 1)
    x = net.vectors(flat)
    x[flat < 0] = 0
    at = np.stack([starts, ends], axis=1).ravel()
    return np.concatenate([np.maximum.reduceat(v, at, axis=1)[:, ::2] for v in net.slid(x)]).T


def logits(net: Net, texts: list[np.ndarray]) -> np.ndarray:
    out, group, size = np.zeros(len(texts)), [], 0

    def close():
        nonlocal group, size
        if group:
            out[group] = np.maximum(pooled(net, [texts[i] for i in group]) + net.bias, 0) @ net.out + net.out_bias[0]
        group, size = [], 0

    for i, t in enumerate(texts):
        if len(t) > CHUNK:
            step = CHUNK - WIDTHS[-1] + 1
            # Filters reach into the zeros behind a text only where it ends, as they do in one piece.
            top = np.max([pooled(net, [t[k : k + CHUNK]], goes_on=k + CHUNK < len(t))[0] for k in range(0, len(t) - WIDTHS[-1] + 1, step)], axis=0)
            out[i] = np.maximum(top + net.bias, 0) @ net.out + net.out_bias[0]
            continue
        if size + len(t) > CHUNK:
            close()
        group.append(i)
        size += len(t)
    close()
    return out


def peaks(net: Net, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each width, the place of every filter's largest value over each text, and that value; CHUNK places at once."""
    gap = WIDTHS[-1] - 1
    where = [np.zeros((len(starts), FILTERS), np.int64) for _ in WIDTHS]
    top = [np.full((len(starts), FILTERS), -np.inf, np.float32) for _ in WIDTHS]
    for a in range(0, int(ends[-1]), CHUNK):
        piece = flat[a : a + CHUNK + gap]
        x = net.vectors(piece)
        x[piece < 0] = 0
        inside = np.flatnonzero((starts < a + CHUNK) & (ends > a))
        for v, w, t in zip(net.slid(x), where, top, strict=True):
            for i in inside:
                s, e = max(starts[i], a) - a, min(ends[i] - a, CHUNK)
                at = v[:, s:e].argmax(axis=1)
                high = v[np.arange(FILTERS), s + at]
                better = high > t[i]
                w[i, better], t[i, better] = (a + s + at)[better], high[better]
    return where, top


class Training:
    """Adam on the logistic loss; embedding rows are updated only where a maximum lies."""

    def __init__(self, seed: int = 11):
        self.net, self.steps = Net.new(seed), 0
        self.first, self.second = ([np.zeros_like(p) for p in self.dense()] for _ in range(2))
        self.seen = {"word": np.zeros(WORD_BUCKETS, np.float32), "stem": np.zeros(STEM_BUCKETS, np.float32)}

    def dense(self) -> list[np.ndarray]:
        return [*self.net.filters, self.net.bias, self.net.out, self.net.out_bias]

    def step(self, texts: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> None:
        net = self.net
        flat, starts, ends = _laid_out(texts)
        where, top = peaks(net, flat, starts, ends)
        h = np.concatenate(top, axis=1) + net.bias
        a = np.maximum(h, 0)
        p = 1 / (1 + np.exp(-np.clip(a @ net.out + net.out_bias[0], -80, 80)))
        g = ((p - y) * weight / len(texts)).astype(np.float32)
        dh = np.outer(g, net.out) * (h > 0)
        grads: list[np.ndarray] = []
        rows, deltas = [], []
        for j, w in enumerate(WIDTHS):
            d = dh[:, j * FILTERS : (j + 1) * FILTERS]
            filt = net.filters[j].reshape(w, SIZE, FILTERS)
            gw = np.zeros_like(filt)
            for i in range(w):
                code = flat[where[j] + i]
                x = net.vectors(code)
                x[code < 0] = 0
                gw[i] = np.einsum("bfs,bf->sf", x, d)
                rows.append(code.ravel())
                deltas.append((d[:, :, None] * filt[i].T[None]).reshape(-1, SIZE))
            grads.append(gw.reshape(w * SIZE, FILTERS))
        grads += [dh.sum(axis=0), a.T @ g, np.array([g.sum()], np.float32)]
        self.steps += 1
        for q, gr, m, s in zip(self.dense(), grads, self.first, self.second, strict=True):
            m += 0.1 * (gr - m)
            s += 0.001 * (gr * gr - s)
            q -= RATE * (m / (1 - 0.9**self.steps)) / (np.sqrt(s / (1 - 0.999**self.steps)) + 1e-7)
        code, delta = np.concatenate(rows), np.concatenate(deltas)
        real = code >= 0
        for name, table, bucket in (("word", net.word, code & (WORD_BUCKETS - 1)), ("stem", net.stem, (code >> 15) & (STEM_BUCKETS - 1))):
            ids, inverse = np.unique(bucket[real], return_inverse=True)
            total = np.zeros((len(ids), SIZE), np.float32)
            np.add.at(total, inverse, delta[real])
            self.seen[name][ids] += (total * total).mean(axis=1)
            table[ids] -= 0.05 * total / (np.sqrt(self.seen[name][ids])[:, None] + 1e-6)

    def since(self, before: Training, n: int) -> dict:
        """What n texts changed: everything dense, and of the embeddings the rows that were touched."""
        out = {"n": n, "steps": self.steps, "dense": [*self.dense(), *self.first, *self.second]}
        for name in self.seen:
            ids = np.flatnonzero(self.seen[name] != before.seen[name])
            now, then = getattr(self.net, name), getattr(before.net, name)
            out[name] = (ids, now[ids] - then[ids], self.seen[name][ids] - before.seen[name][ids])
        return out

    def joined(self, parts: list[dict]) -> None:
        """Takes in what parts made of this state: the mean by texts, of an embedding's row over the parts that touched it."""
        n = sum(p["n"] for p in parts)
        for i, q in enumerate([*self.dense(), *self.first, *self.second]):
            q[...] = sum(p["dense"][i] * (p["n"] / n) for p in parts)
        self.steps = max(p["steps"] for p in parts)
        for name in self.seen:
            table, weight = getattr(self.net, name), np.zeros(len(self.seen[name]), np.float32)
            for p in parts:
                weight[p[name][0]] += p["n"]
            for p in parts:
                ids, change, seen = p[name]
                share = p["n"] / weight[ids]
                table[ids] += change * share[:, None]
                self.seen[name][ids] += seen * share
