"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word enters as a vector of the word and one of its runs of characters, both learnt with the network. The network reads
windows of words in both directions, attention weighs the positions, and a text's score is that of its most toxic window;
windows overlap by half and cover the whole text.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DoubleType, StructField, StructType

from cnvspark.llm.common import give_back, remembers, single_threaded, working
from cnvspark.llm.labelled import training_rows

_MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»„“”‘’…–—¿¡"
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def plain(word: str) -> str:
    """A word in lower case without marks at its edges."""
    return word.lower().strip(_MARKS)


def _log_odds(pos: Counter, neg: Counter, n_pos: int, n_neg: int, least: int) -> dict[str, float]:
    """How much likelier each item is in one class, less two standard errors, so that rare items tell nothing."""
    out = {}
    for x in pos.keys() | neg.keys():
        if pos[x] + neg[x] >= least:
            lift = math.log((pos[x] + 0.5) / (n_pos + 1)) - math.log((neg[x] + 0.5) / (n_neg + 1))
            sure = abs(lift) - 2 * math.sqrt(1 / (pos[x] + 0.5) + 1 / (neg[x] + 0.5))
            if sure > 0.2:
                out[x] = math.copysign(min(4.0, sure), lift)
    return out


class WordInputs:
    """Vectors of words: a learnt one of the word itself (of those in ``least`` training texts or more; others share one), the
    scaled sum of learnt ones of its runs of three and four characters and its beginning, by a hash, and two marks of its form.

    Vectors start along one direction, by how much more often the word or run occurs in toxic texts, with a little noise.
    """

    def __init__(self, texts: list[str], labels: list[int], least: int = 3, size: int = 8, buckets: int = 16_384, seed: int = 5):
        counted = (Counter(), Counter())
        for text, y in zip(texts, labels, strict=True):
            counted[y].update({plain(w) for w in text.split()})
        n_pos, n_neg = sum(labels), len(labels) - sum(labels)
        known = [w for w in sorted(counted[0].keys() | counted[1].keys()) if counted[0][w] + counted[1][w] >= least]
        self.rows = {w: k for k, w in enumerate(known, 1)}
        self.size, self.buckets, self.features = size, buckets, 2 * size + 2
        odds = _log_odds(counted[1], counted[0], n_pos, n_neg, least)
        run_odds = _log_odds(*(self._run_counts(counted[y]) for y in (1, 0)), n_pos, n_neg, least)
        rng = np.random.default_rng(seed)
        direction = rng.normal(0, 1, (2, size))
        direction /= np.linalg.norm(direction, axis=1, keepdims=True)
        first = np.array([0.0, *(odds.get(w, 0.0) for w in known)])
        second = np.zeros(buckets)
        second[[*run_odds]] = [*run_odds.values()]
        self.p = {"E": first[:, None] * direction[0] + rng.normal(0, 0.02, (len(first), size)), "C": second[:, None] * direction[1] + rng.normal(0, 0.02, (buckets, size))}
        self.evidence = (odds, second)

    def evidence_of(self, words: list[str]) -> np.ndarray:
        """How much words as written speak for a toxic text, by counts alone."""
        odds, run_odds = self.evidence
        _, runs, begins, _ = self.keys(words)
        return np.maximum(0.0, np.array([odds.get(plain(w), 0.0) for w in words]) + np.maximum.reduceat(run_odds[runs], begins))

    def _run_counts(self, counted: Counter) -> Counter:
        """The texts of each run's words, by the run's place."""
        if not counted:
            return Counter()
        runs, begins = self._runs([*counted])
        word = np.repeat(np.arange(len(counted)), np.diff(np.append(begins, len(runs))))
        once = np.unique(word * self.buckets + runs)
        sums = np.bincount(once % self.buckets, np.array([*counted.values()])[once // self.buckets], self.buckets)
        return Counter({int(g): int(sums[g]) for g in np.flatnonzero(sums)})

    def _runs(self, bare: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The places of the runs of three and four characters of plain words with their edges marked, and of their first five;
        and where those of each word begin.
        """
        text = "".join([f"^{w}$" for w in bare])
        c = np.concatenate([np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), np.zeros(5, np.uint32)]).astype(np.uint64)
        sizes = np.fromiter(map(len, bare), np.int64, len(bare)) + 2
        ends = np.cumsum(sizes)
        word = np.repeat(np.arange(len(bare)), sizes)
        left = ends[word] - np.arange(len(word))  # characters from here to the end of the word
        value, places, of = np.zeros(len(word), np.uint64), [], []
        for n in range(1, 6):
            value = (value ^ np.where(left >= n, c[n - 1 : n - 1 + len(word)], 0)) * _MIX
            value ^= value >> np.uint64(29)
            if n in (3, 4):
                places.append(value[left >= n])
                of.append(word[left >= n])
        places.append(value[ends - sizes] ^ np.uint64(1))
        of.append(np.arange(len(bare)))
        of = np.concatenate(of)
        order = np.argsort(of, kind="stable")
        return (np.concatenate(places)[order] % np.uint64(self.buckets)).astype(np.int64), np.searchsorted(of[order], np.arange(len(bare)))

    def keys(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For words as written: their rows, all their runs' places, where those of each begin, and the marks of their form."""
        bare = [*map(plain, words)]
        runs, begins = self._runs(bare)
        marks = np.array([(w.isupper(), not b.isalpha()) for w, b in zip(words, bare, strict=True)], float).reshape(-1, 2)
        return np.array([self.rows.get(b, 0) for b in bare], np.int64), runs, begins, marks

    def vectors(self, keys: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """The inputs of words, one a row."""
        rows, runs, begins, marks = keys
        scale = np.sqrt(np.diff(np.append(begins, len(runs))))[:, None]
        return np.concatenate([self.p["E"][rows], np.add.reduceat(self.p["C"][runs], begins) / scale, marks], axis=1)

    def gradients(self, keys: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], dx: np.ndarray) -> dict[str, np.ndarray]:
        """What the gradients of words' inputs mean for the vectors."""
        rows, runs, begins, _ = keys
        counts = np.diff(np.append(begins, len(runs)))
        of_runs = np.repeat(dx[:, self.size : 2 * self.size] / np.sqrt(counts)[:, None], counts, axis=0)
        sums = lambda at, x, n: np.stack([np.bincount(at, x[:, k], n) for k in range(self.size)], axis=1)
        return {"E": sums(rows, dx[:, : self.size], len(self.p["E"])), "C": sums(runs, of_runs, self.buckets)}

    def compiled(self) -> WordInputs:
        """A copy for scoring, in single precision and without what only training needs."""
        out = object.__new__(WordInputs)
        out.__dict__ = {k: v for k, v in self.__dict__.items() if k != "evidence"} | {"p": {k: v.astype(np.float32) for k, v in self.p.items()}}
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BiGRU:
    """Parameters, forward pass and gradients. Inputs are (windows, positions, features) and a mask of positions."""

    def __init__(self, features: int, hidden: int, attention: int, seed: int):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        w = lambda *shape: rng.normal(0, 1 / math.sqrt(shape[0]), shape)
        self.p = {f"{d}W": w(features, 3 * hidden) for d in "fb"} | {f"{d}U": w(hidden, 3 * hidden) for d in "fb"} | {f"{d}b": np.zeros(3 * hidden) for d in "fb"}
        self.p |= {"A": w(2 * hidden, attention), "Ab": np.zeros(attention), "v": w(attention), "o": w(2 * hidden), "ob": np.zeros(1)}

    def _read(self, gx: np.ndarray, mask: np.ndarray, U: np.ndarray, tape: list | None) -> np.ndarray:  # noqa: N803
        n, t, _ = gx.shape
        h, k = np.zeros((n, self.hidden), gx.dtype), self.hidden
        out = np.empty((n, t, k), gx.dtype)
        for i in range(t):
            hu = h @ U
            zr = _sigmoid(gx[:, i, : 2 * k] + hu[:, : 2 * k])
            z, r = zr[:, :k], zr[:, k:]
            c = np.tanh(gx[:, i, 2 * k :] + r * hu[:, 2 * k :])
            m = mask[:, i, None]
            new = h + m * (1 - z) * (c - h)
            if tape is not None:
                tape.append((h, hu, z, r, c, m))
            h = new
            out[:, i] = h
        return out

    def _unread(self, dout: np.ndarray, tape: list, U: np.ndarray) -> tuple[np.ndarray, np.ndarray]:  # noqa: N803
        k = self.hidden
        dgx, dU, dh = np.zeros((*dout.shape[:2], 3 * k)), np.zeros_like(U), np.zeros((len(dout), k))
        for i in range(dout.shape[1] - 1, -1, -1):
            h, hu, z, r, c, m = tape[i]
            d = dh + dout[:, i]
            dc, dz = d * m * (1 - z), -d * m * (c - h)
            dh = d * (1 - m * (1 - z))
            da = dc * (1 - c * c)
            dr = da * hu[:, 2 * k :]
            dhu = np.concatenate([dz * z * (1 - z), dr * r * (1 - r), da * r], axis=1)
            dgx[:, i] = np.concatenate([dhu[:, : 2 * k], da], axis=1)
            dU += h.T @ dhu
            dh += dhu @ U.T
        return dgx, dU

    def loss(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, gradients: bool = True) -> tuple[float, np.ndarray, dict[str, np.ndarray]]:
        """Mean cross-entropy, logits, and gradients of all parameters and of the inputs (``x``)."""
        p, tapes = self.p, {"f": [], "b": []}
        hf = self._read(x @ p["fW"] + p["fb"], mask, p["fU"], tapes["f"])
        hb = self._read((x @ p["bW"] + p["bb"])[:, ::-1], mask[:, ::-1], p["bU"], tapes["b"])[:, ::-1]
        s = np.concatenate([hf, hb], axis=2)
        u = np.tanh(s @ p["A"] + p["Ab"])
        e = np.where(mask > 0, u @ p["v"], -1e9)
        a = np.exp(e - e.max(axis=1, keepdims=True))
        a /= a.sum(axis=1, keepdims=True)
        c = np.einsum("nt,ntk->nk", a, s)
        logit = c @ p["o"] + p["ob"]
        q = _sigmoid(logit)
        value = float(-np.mean(y * np.log(q + 1e-12) + (1 - y) * np.log(1 - q + 1e-12)))
        if not gradients:
            return value, logit, {}
        g = {}
        dl = (q - y) / len(y)
        g["o"], g["ob"] = c.T @ dl, dl.sum(keepdims=True)
        dc = dl[:, None] * p["o"]
        da = np.einsum("nk,ntk->nt", dc, s)
        ds = a[:, :, None] * dc[:, None, :]
        de = a * (da - (a * da).sum(axis=1, keepdims=True)) * (mask > 0)
        g["v"] = np.einsum("nt,nta->a", de, u)
        du = de[:, :, None] * p["v"] * (1 - u * u)
        g["A"], g["Ab"] = np.einsum("ntk,nta->ka", s, du), du.sum(axis=(0, 1))
        ds += du @ p["A"].T
        k = self.hidden
        for d, dh, xs in (("f", ds[:, :, :k], x), ("b", ds[:, ::-1, k:], x[:, ::-1])):
            dgx, g[f"{d}U"] = self._unread(dh, tapes[d], p[f"{d}U"])
            g[f"{d}W"], g[f"{d}b"] = np.einsum("ntf,ntk->fk", xs, dgx), dgx.sum(axis=(0, 1))
            dx = dgx @ p[f"{d}W"].T
            g["x"] = dx if d == "f" else g["x"] + dx[:, ::-1]
        return value, logit, g

    def compiled(self) -> dict[str, np.ndarray]:
        """Parameters for scoring, in single precision."""
        return {k: v.astype(np.float32) for k, v in self.p.items()}


class Adam:
    """Adam steps on a dict of arrays."""

    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.t = p, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def step(self, g: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k in self.p:
            x = g[k]
            self.m[k] = 0.9 * self.m[k] + 0.1 * x
            self.v[k] = 0.999 * self.v[k] + 0.001 * x * x
            self.p[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)


def window_starts(n: int, size: int) -> range:
    """Where the windows of a text of ``n`` words begin: half a window apart, the last one reaching the end."""
    step = size // 2
    return range(0, max(1, -(-(n - size) // step) * step + 1 if n > size else 1), step)


class ToxicityModel:
    """Word inputs, network, window size, and the scale and shift that turn the greatest logit into a probability."""

    def __init__(self, inputs: WordInputs | None, net: BiGRU | None, window: int, scale: float, shift: float):
        self.window, self.scale, self.shift = window, scale, shift
        self.inputs = inputs.compiled() if inputs else None
        self.p = net.compiled() if net else None
        self.hidden = net.hidden if net else 0

    def score_windows(self, gates: np.ndarray, rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Logits of windows; ``gates`` holds each known word's input to all gates of both directions."""
        p, k, t = self.p, self.hidden, rows.shape[1]
        mask = (np.arange(t) < lengths[:, None]).astype(np.float32)
        out = []
        for d, half in (("f", slice(0, 3 * k)), ("b", slice(3 * k, 6 * k))):
            h, seq, U = np.zeros((len(rows), k), np.float32), [None] * t, p[f"{d}U"]  # noqa: N806
            part = gates[:, half]
            for i in range(t) if d == "f" else range(t - 1, -1, -1):
                gx, hu = part[rows[:, i]], h @ U
                zr = gx[:, : 2 * k] + hu[:, : 2 * k]
                np.negative(zr, out=zr)
                np.exp(zr, out=zr)
                zr += 1
                np.reciprocal(zr, out=zr)
                c = np.tanh(gx[:, 2 * k :] + zr[:, k:] * hu[:, 2 * k :])
                h = h + mask[:, i, None] * (1 - zr[:, :k]) * (c - h)
                seq[i] = h
            out.append(seq)
        top = np.full((len(rows), t), -1e9, np.float32)
        a_f, a_b, o_f, o_b = p["A"][:k], p["A"][k:], p["o"][:k], p["o"][k:]
        value = np.zeros((len(rows), t), np.float32)
        for i in range(t):
            f, b = out[0][i], out[1][i]
            e = np.tanh(f @ a_f + b @ a_b + p["Ab"]) @ p["v"]
            top[:, i] = np.where(mask[:, i] > 0, e, -1e9)
            value[:, i] = f @ o_f + b @ o_b
        a = np.exp(top - top.max(axis=1, keepdims=True))
        return (a * value).sum(axis=1) / a.sum(axis=1) + p["ob"][0]


class Scorer:
    """Scores texts with a model; the gate inputs of words are remembered, at most ``memo`` of them."""

    def __init__(self, model: ToxicityModel, memo: int = 200_000):
        single_threaded()
        self.model, self.memo = model, memo
        self._forget()

    def _forget(self) -> None:
        self.ids: dict[str, int] = {}  # words by their rows; row 0 is what stands after the end of a text
        # Zeros take no memory until they are written, so a table for all words that are remembered never has to be copied.
        self.gates = np.zeros((self.memo + 131_072, 6 * self.model.hidden), np.float32)

    def _known(self, words: list[list[str]]) -> None:
        missing = [*set().union(*words).difference(self.ids)]
        p, first = self.model.p, len(self.ids) + 1
        if first + len(missing) > len(self.gates):
            grown = np.zeros((first + len(missing) + 16_384, self.gates.shape[1]), np.float32)
            grown[: len(self.gates)] = self.gates
            self.gates = grown
        for k in range(0, len(missing), 8192):
            some = missing[k : k + 8192]
            x = self.model.inputs.vectors(self.model.inputs.keys(some)).astype(np.float32)
            self.gates[first + k : first + k + len(some)] = np.concatenate([x @ p["fW"] + p["fb"], x @ p["bW"] + p["bb"]], axis=1)
        self.ids.update(zip(missing, range(first, first + len(missing)), strict=True))

    def logits(self, texts: list[str]) -> list[np.ndarray]:
        """The logits of all windows of each text; none for a text without words."""
        out, words, size = [], [], 0
        for t in texts:
            words.append(t.split())
            size += len(words[-1])
            if size > 100_000:
                out += self._logits(words)
                words, size = [], 0
        return out + self._logits(words)

    def _logits(self, words: list[list[str]]) -> list[np.ndarray]:
        size = self.model.window
        if len(self.ids) > self.memo:
            self._forget()
        self._known(words)
        get, counts, starts, lengths, runs, at = self.ids.__getitem__, [], [], [], [], 0
        for w in words:
            x = np.fromiter(map(get, w), np.int32, len(w))
            if len(x):
                s = np.array(window_starts(len(x), size))
                starts.append(at + s)
                lengths.append(np.minimum(len(x) - s, size))
                runs += [x, np.zeros(size, np.int32)]
                at += len(x) + size
            counts.append(len(starts[-1]) if len(x) else 0)
        if not runs:
            return [np.empty(0, np.float32)] * len(words)
        run, starts, lengths = np.concatenate(runs), np.concatenate(starts), np.concatenate(lengths)
        places = np.arange(size)
        scored = [self.model.score_windows(self.gates, run[starts[i : i + 4096, None] + places], lengths[i : i + 4096]) for i in range(0, len(starts), 4096)]
        return np.split(np.concatenate(scored), np.cumsum(counts)[:-1])

    def scores(self, texts: list[str]) -> list[float]:
        """The probability of each whole text; 0 for one without words or without a trained network."""
        if self.model.p is None:
            return [0.0] * len(texts)
        return [float(_sigmoid(np.array(self.model.scale * x.max() + self.model.shift))) if len(x) else 0.0 for x in self.logits(texts)]


def train(rows: list[tuple[str, int]], *, window: int = 32, hidden: int = 8, attention: int = 8, rounds: int = 2, epochs: int = 3, batch: int = 64, rate: float = 0.01, unknown: float = 0.3, clean_weight: float = 4.0, seed: int = 11) -> ToxicityModel:
    """Trains on (text, label). Labels are of texts, so a toxic text is first stood for by the window with the most evidence
    of its words, then, round by round, by the one that the network scores highest; a clean text by its worst window and one
    other. A share ``unknown`` of the words is read by characters alone, so that these are learnt too. Scale and shift are
    fitted to the greatest logits of a fifth of the texts that the network has not seen, where clean ones weigh
    ``clean_weight`` times as much, as they are that much more frequent.
    """
    rows = [*dict.fromkeys((t, y) for t, y in rows if t.split())]  # copies are no evidence
    rng = np.random.default_rng(seed)
    rows = [rows[k] for k in rng.permutation(len(rows))]
    n = len(rows) - len(rows) // 5
    texts, labels = [t for t, _ in rows], [y for _, y in rows]
    if len(set(labels[:n])) < 2:
        return ToxicityModel(None, None, window, 1.0, 0.0)
    inputs = WordInputs(texts[:n], labels[:n])
    series = [t.split() for t in texts[:n]]
    names = sorted({w for s in series for w in s})
    place = {w: k for k, w in enumerate(names)}
    series = [np.array([place[w] for w in s]) for s in series]
    evidence = inputs.evidence_of(names)
    rows_of, runs_of, begins, marks = inputs.keys(names)
    ends = np.append(begins, len(runs_of))[1:]
    net = BiGRU(inputs.features, hidden, attention, seed)
    adam, slow, y = Adam(net.p, rate), Adam(inputs.p, rate), np.array(labels)

    def step(some: list[tuple[int, int]]) -> None:
        lengths = np.array([min(window, len(series[d]) - s) for d, s in some])
        mask = np.arange(window) < lengths[:, None]
        words, back = np.unique(np.concatenate([series[d][s : s + n] for (d, s), n in zip(some, lengths, strict=True)]), return_inverse=True)
        sizes = ends[words] - begins[words]
        first = np.cumsum(sizes) - sizes
        runs = runs_of[np.repeat(begins[words] - first, sizes) + np.arange(int(sizes.sum()))]
        keys = (np.where(rng.random(len(words)) < unknown, 0, rows_of[words]), runs, first, marks[words])
        x = np.zeros((*mask.shape, inputs.features))
        x[mask] = inputs.vectors(keys)[back]
        g = net.loss(x, mask.astype(float), y[[d for d, _ in some]].astype(float))[2]
        dx = np.stack([np.bincount(back, g["x"][mask][:, k], len(words)) for k in range(inputs.features)], axis=1)
        adam.step(g)
        slow.step(inputs.gradients(keys, dx))

    starts = [list(window_starts(len(s), window)) for s in series]
    worst = [max(st, key=lambda k, s=s: float(evidence[s[k : k + window]].sum())) for s, st in zip(series, starts, strict=True)]
    for r in range(rounds):
        chosen = [(d, worst[d]) for d in range(n)] + [(d, starts[d][int(rng.integers(len(starts[d])))]) for d in range(n) if not y[d]]
        for _ in range(epochs):
            order = rng.permutation(len(chosen))
            for i in range(0, len(order), batch):
                step([chosen[j] for j in order[i : i + batch]])
        scorer = Scorer(ToxicityModel(inputs, net, window, 1.0, 0.0))
        if r < rounds - 1:
            worst = [starts[d][int(x.argmax())] for d, x in enumerate(scorer.logits(texts[:n]))]
    unseen = slice(n, None) if len(set(labels[n:])) == 2 else slice(None)
    top, y = np.array([x.max() for x in scorer.logits(texts[unseen])], float), y[unseen]
    scale, shift = 1.0, 0.0
    w = np.where(y == 1, 1.0 / max(1, int(y.sum())), clean_weight / max(1, int((1 - y).sum()))) / (1 + clean_weight)
    for _ in range(400):  # logistic fit of one scale and one shift, with a little shrinkage
        e = w * (_sigmoid(scale * top + shift) - y)
        h = w * 0.25
        scale -= float((e * top).sum() + 1e-3 * (scale - 1)) / float((h * top * top).sum() + 1e-3)
        shift -= float(e.sum()) / float(h.sum())
    return ToxicityModel(inputs, net, window, max(scale, 1e-3), shift)


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, per_class: int = 1200, longest: int = 20_000, **options) -> ToxicityModel:
    """Trains on at most ``per_class`` labelled texts of each class of at most ``longest`` code points, never on held-out
    rows. Those two parameters bound what the driver holds. Without labels of both classes every score is 0.
    """
    model = train(training_rows(docs, labels, "toxic", per_class, longest), **options)
    give_back()  # what training took, before the driver plans later steps
    return model


@lru_cache(maxsize=1)
def _scorer(key: int, shared) -> Scorer:
    return Scorer(shared.value)


remembers("toxicity", _scorer.cache_clear)


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text", score_col: str = "toxicity") -> DataFrame:
    """All rows of ``docs`` with the score of their whole text, between 0 and 1.

    A null text is empty; texts without words score 0; equal texts score equal; an empty table gives no rows; a column
    named ``score_col`` is replaced and all others stay. Rows are scored where they lie; nothing is shuffled.
    """
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    rows = docs.drop(score_col)
    at, schema = rows.columns.index(text_col), rows.schema
    key = id(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("toxicity")
        scorer = _scorer(key, shared)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                scores = scorer.scores([t or "" for t in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64())], [*part.schema.names, score_col])
        give_back()

    return rows.mapInArrow(score, StructType([*schema.fields, StructField(score_col, DoubleType())]))
