"""Language-model scoring: a causal self-attention model in numpy over subword ids.

The text is its words (runs without ASCII white space, A-Z in lower case) and an end.
Subwords are those of a public byte-level BPE, each word with a space before it.  The
model reads windows of ``WINDOW`` subwords that begin every ``STRIDE``; each subword is
scored once, in the later half of its window, so with at least half a window of context
where the text has it.  Windows of many texts are scored together with masked attention;
as there is one layer and distance enters as a bias of the attention, what two windows
share is computed once.

The output is a softmax over classes of subwords; within its class a subword has its
frequency.  Classes hold either subwords that begin a word or subwords that continue
one, so the model tells where words end, and a word's probability is that of its
subwords and of a beginning after them.

Words are then mixed with the add-one word frequencies of the whole training corpus,
in which each unknown word has the share of one unknown.  The network's weight in the
mixture depends on how often the training texts hold the word; it is fitted by EM on
training texts that the network was not yet trained on, whose own words are first taken
out of the counts.

Every training text trains the network.  A hash of id and text deals them to ``PARTS``
parts, which train one after the other: a part's texts are dealt to tasks of about
``SHARD_TEXTS``, each task goes on by Adam from the same network, and the network that
comes out is the mean of theirs, weighted by what they read.  The last part is scored
before it trains; the mixture is fitted on all of its words, by counts of their odds.
The first network is trained on the driver on ``SAMPLE_DOCS`` texts of the other parts.
Classes follow from the neighbours of subwords, these and the frequencies of subwords
within classes and of words from all training texts: the most frequent words
(``TOP_WORDS`` at most) go to every task, all others are joined by shuffle, with the
same scores.  The driver holds one network and a table of neighbours of fixed size,
however many texts there are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import tiktoken
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chromaweave.llm.bpe import batches_by_size, read_ranks
from chromaweave.llm.store import free_shuffles, materialise

WINDOW, STRIDE = 32, 16
WIDTH = 16
START_CLASSES, REST_CLASSES = 32, 20
#: Subwords with an input embedding of their own, and those whose neighbourhood tells classes.
INPUTS, FREQUENT = 6000, 300
#: Texts that the driver trains the first network on, at most, and how often.
SAMPLE_DOCS = 1500
SAMPLE_EVERY = 100
EPOCHS = 4
#: Parts of the training texts that train one after the other; the last one first fits the mixture.
PARTS = 5
#: Texts that a task trains on before networks are averaged.
SHARD_TEXTS = 2000
#: Half windows of a step, and the greatest rate of the driver's steps and of the tasks'.
STEP_HALVES = 256
RATE, SHARD_RATE = 0.01, 0.005
#: Parts of a table or network that tasks add up apart.
BLOCKS = 16
#: Odds of the two models are counted in so many steps for each natural logarithm, up to ODDS either way.
ODDS, ODDS_STEPS = 50, 32
TOP_WORDS = 1_000_000
#: Words are told apart by the binary logarithm of their count, up to this one; unknown ones are the first level.
MIX_LEVELS = 16
BATCH_BYTES = 1 << 20
WINDOWS_AT_ONCE = 512
CACHE_WORDS = 250_000
HASH_BITS = 62

_SUBWORDS: dict[str, tuple] = {}


def subwords(path: str):
    """(encoding, number of ids, which of them begin with a space)."""
    if path not in _SUBWORDS:
        import public_tokenizers

        ranks = read_ranks(path)
        begins = np.zeros(max(ranks.values()) + 1, bool)
        begins[[i for piece, i in ranks.items() if piece[:1] == b" "]] = True
        encoding = tiktoken.Encoding("lm", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        _SUBWORDS[path] = encoding, len(begins), begins
    return _SUBWORDS[path]


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split() if text else []


def ids_of(words: list[bytes], path: str) -> np.ndarray:
    if not words:
        return np.empty(0, np.int64)
    return subwords(path)[0].encode_to_numpy((b" " + b" ".join(words)).decode("utf-8", "replace")).astype(np.int64)


class WordIds:
    """Numbers of words, and the subword ids of each: those of a text are its words' in a row."""

    def __init__(self, path: str):
        self.path, self.number = path, {}
        self.flat, self.at, self.used = np.empty(1 << 16, np.int64), np.zeros(1, np.int64), 0

    def learn(self, new: list[bytes]) -> None:
        if not new:
            return
        ids = ids_of(new, self.path)
        # A word's first subword holds its space.
        ends = np.append(np.flatnonzero(subwords(self.path)[2][ids])[1:], len(ids))
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.empty(self.used + 2 * len(ids), np.int64)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.at = np.concatenate([self.at, self.used + ends])
        self.used += len(ids)
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))

    def of(self, numbers: np.ndarray) -> np.ndarray:
        starts, sizes = self.at[numbers], self.at[numbers + 1] - self.at[numbers]
        where = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        return self.flat[where]


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) >> (64 - HASH_BITS)


@dataclass
class Network:
    """Parameters; ``p`` holds the trained arrays."""

    p: dict[str, np.ndarray]
    input_of: np.ndarray  # embedding row of a subword
    class_of: np.ndarray  # class of a subword; the end is the last id
    inside: np.ndarray  # log probability of a subword within its class
    starts: int  # classes below it begin a word

    def qkv(self, x: np.ndarray):
        """Inputs and their queries, keys and values."""
        e = self.p["E"][x]
        # One product over all positions, not one for each window.
        out = (e.reshape(-1, WIDTH) @ self.p["W"]).reshape(*x.shape, 3 * WIDTH)
        return e, *np.split(out, 3, axis=-1)

    def attend(self, q: np.ndarray, k: np.ndarray, v: np.ndarray, first: np.ndarray):
        """Weights and sums for the last STRIDE positions of windows; ``first`` windows have no earlier half."""
        s = q @ k.swapaxes(1, 2)
        s *= np.float32(WIDTH**-0.5)
        s += self.p["P"][DISTANCE] + MASK
        s[first, :, : WINDOW - STRIDE] = -1e9
        # A position sees itself at least; far from overflow no row's greatest has to be taken off.
        reach = float(np.sqrt(np.square(q).sum(-1).max() * np.square(k).sum(-1).max())) * WIDTH**-0.5 + float(np.abs(self.p["P"]).max())
        if not reach < SAFE:
            s -= s.max(-1, keepdims=True)
        a = np.exp(s, out=s)
        a /= (a.reshape(-1, WINDOW) @ ONES).reshape(*a.shape[:-1], 1)
        return a, a @ v

    def forward(self, x: np.ndarray, first: np.ndarray):
        """Hidden states of the last STRIDE positions of windows (n x WINDOW), and what led there."""
        e, q, k, v = self.qkv(x)
        q, late = q[:, -STRIDE:], e[:, -STRIDE:]
        a, y = self.attend(q, k, v, first)
        h = late + (y.reshape(-1, WIDTH) @ self.p["O"]).reshape(late.shape)
        return e, q, k, v, a, y, h

    def log_classes(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        h = self.forward(x, first)[-1]
        z = h.reshape(-1, WIDTH) @ self.p["U"] + self.p["b"]
        z -= z.max(-1, keepdims=True)
        z -= np.log(np.exp(z).sum(-1, keepdims=True))
        return z

    def halves(self, texts: list[np.ndarray]):
        """Inputs of half windows, one behind the other, and which begin a text; each target's place there, the targets, and where texts begin."""
        end = len(self.class_of) - 1
        sizes = np.array([len(t) + 1 for t in texts])
        at = np.concatenate([[0], np.cumsum(sizes)])
        targets = np.concatenate([np.append(t, end) for t in texts])
        inputs = np.empty(len(targets), np.int64)
        inputs[1:] = self.input_of[targets[:-1]]
        inputs[at[:-1]] = len(self.p["E"]) - 1  # the beginning of a text
        halves = -(-sizes // STRIDE)
        begins_at = np.cumsum(halves) - halves
        slot = np.arange(len(targets)) + np.repeat(begins_at * STRIDE - at[:-1], sizes)
        x = np.zeros(int(halves.sum()) * STRIDE, np.int64)
        x[slot] = inputs
        first = np.zeros(len(x) // STRIDE, bool)
        first[begins_at] = True
        return x.reshape(-1, STRIDE), first, slot, targets, at

    def score(self, texts: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text's ids: log probability of each subword and the end; of a word beginning there."""
        own, begin, _, at = self.score_flat(texts)
        return [(own[a:b], begin[a:b]) for a, b in zip(at, at[1:], strict=False)]

    def score_flat(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """:meth:`score` of all texts in one array each, the subwords scored, and where texts begin."""
        x, first, slot, targets, at = self.halves(texts)
        total = len(x)
        own, begin = np.empty(len(targets), np.float32), np.empty(len(targets), np.float32)
        kinds = np.arange(self.p["U"].shape[1]) < self.starts
        halves_of = np.stack([kinds, ~kinds], 1).astype(np.float32)
        cut = np.searchsorted(slot, np.arange(0, total + WINDOWS_AT_ONCE, WINDOWS_AT_ONCE) * STRIDE)
        for n, i in enumerate(range(0, total, WINDOWS_AT_ONCE)):
            lead = i > 0  # the half before, for its keys and values
            e, q, k, v = self.qkv(x[i - lead : i + WINDOWS_AT_ONCE])
            if not lead:
                k, v = (np.concatenate([np.zeros_like(t[:1]), t]) for t in (k, v))
            k, v = (np.concatenate([t[:-1], t[1:]], axis=1) for t in (k, v))
            _, y = self.attend(q[int(lead) :], k, v, first[i : i + WINDOWS_AT_ONCE])
            part = slice(cut[n], cut[n + 1])
            here = slot[part] - i * STRIDE
            h = e[int(lead) :].reshape(-1, WIDTH)[here] + y.reshape(-1, WIDTH)[here] @ self.p["O"]
            t = targets[part]
            z = h @ self.p["U"] + self.p["b"]
            if not (np.abs(z).max(initial=0) < SAFE):
                z -= z.max(-1, keepdims=True)
            c = self.class_of[t]
            chosen = z[np.arange(len(t)), c]
            np.exp(z, out=z)
            starting, rest = (z @ halves_of).T
            sums = np.log(starting + rest)
            own[part] = chosen - sums + self.inside[t]
            begin[part] = np.log(starting) - sums
        return own, begin, targets, at


#: How far back each position of a window lies from each of its last STRIDE ones, and what those must not see.
DISTANCE = np.maximum(np.arange(WINDOW - STRIDE, WINDOW)[:, None] - np.arange(WINDOW), 0)
ONES = np.ones((WINDOW, 1), np.float32)
#: Exponents whose sums neither overflow nor vanish in single precision.
SAFE = 40.0
MASK = np.triu(np.full((STRIDE, WINDOW), -1e9, np.float32), 1 + WINDOW - STRIDE)


def _clusters(features: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """k-means of the feature rows by their weights, from the first k rows on."""
    k = min(k, len(features))
    centers = features[:k].copy()
    label = np.zeros(len(features), np.int64)
    for _ in range(20 if k else 0):
        label = (features @ centers.T).argmax(1)
        for c in range(k):
            if (label == c).any():
                centers[c] = weights[label == c] @ features[label == c]
        centers /= np.linalg.norm(centers, axis=1, keepdims=True) + 1e-9
    return label


def common_subwords(counts: np.ndarray) -> np.ndarray:
    """The subwords with inputs of their own, the most frequent first."""
    common = np.argsort(-counts[:-1], kind="stable")[:INPUTS]
    return common[counts[common] > 0]


def neighbours(streams, common: np.ndarray, n_ids: int) -> np.ndarray:
    """How often each common subword has each of the FREQUENT first ones before it, and behind it."""
    frequent = common[:FREQUENT]
    column = np.full(n_ids + 1, -1)
    column[frequent] = np.arange(len(frequent))
    row = np.full(n_ids + 1, -1)
    row[common] = np.arange(len(common))
    found = np.zeros((len(common), 2 * len(frequent)), np.int64)
    for stream in streams:
        for a, b, shift in ((stream[1:], stream[:-1], 0), (stream[:-1], stream[1:], len(frequent))):
            r, c = row[a], column[b]
            ok = (r >= 0) & (c >= 0)
            np.add.at(found.reshape(-1), r[ok] * found.shape[1] + c[ok] + shift, 1)
    return found


class Adam:
    """Adam in place; ``share`` of the greatest rate is left."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p, self.steps = p, 0
        self.m, self.v = ({k: np.zeros_like(w) for k, w in p.items()} for _ in range(2))

    def step(self, grads: dict[str, np.ndarray], rate: float) -> None:
        self.steps += 1
        rate *= min(1.0, self.steps / 50)
        for name, g in grads.items():
            m, v = self.m[name], self.v[name]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            self.p[name] -= (rate / (1 - 0.9**self.steps) * m / (np.sqrt(v / (1 - 0.99**self.steps)) + 1e-6)).astype(np.float32)


def train(texts: list[np.ndarray], n_ids: int, begins: np.ndarray, seed: int = 0, totals: np.ndarray | None = None, near: np.ndarray | None = None) -> Network:
    """Classes from neighbours' statistics, then the network by Adam on overlapping windows.

    ``totals``: how often each subword, and the end, occurs in all training texts, not only in these.
    ``near``: the :func:`neighbours` in all training texts, of the subwords common by ``totals``.
    """
    rng = np.random.default_rng(seed)
    end = n_ids
    stream = np.concatenate([np.append(t, end) for t in texts] or [np.array([end])])
    counts = np.bincount(stream, minlength=n_ids + 1)
    often = counts if near is None else totals
    common = common_subwords(often)
    row = np.full(n_ids + 1, -1)
    row[common] = np.arange(len(common))
    near = neighbours([stream], common, n_ids) if near is None else near
    features = np.sqrt(np.append(near, np.full((len(common), 1), 1e-3), axis=1).astype(np.float32))
    features /= np.linalg.norm(features, axis=1, keepdims=True)
    is_start = np.append(begins, True)
    class_of = np.where(is_start, START_CLASSES, START_CLASSES + 2 + REST_CLASSES)  # rare ones
    class_of[end] = START_CLASSES + 1
    starts = START_CLASSES + 2
    for kind, k, base in ((True, START_CLASSES, 0), (False, REST_CLASSES, starts)):
        pick = is_start[common] == kind
        class_of[common[pick]] = base + _clusters(features[pick], np.sqrt(often[common[pick]]).astype(np.float32), k)
    n_classes = starts + REST_CLASSES + 1
    mass = (counts if totals is None else totals) + 0.05
    inside = np.log(mass / np.bincount(class_of, mass, n_classes)[class_of]).astype(np.float32)
    # Own inputs for common subwords, one for each class for the others, one for the beginning.
    input_of = np.where(row >= 0, row, len(common) + class_of)
    rows = len(common) + n_classes + 1
    f32 = lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
    p = {"E": f32(rows, WIDTH), "P": np.zeros(WINDOW, np.float32), "W": f32(WIDTH, 3 * WIDTH) * 2, "O": f32(WIDTH, WIDTH) * 2, "U": f32(WIDTH, n_classes) * 2, "b": np.zeros(n_classes, np.float32)}
    net = Network(p, input_of, class_of, inside, starts)
    if not texts:
        return net
    x, first, slot, targets, _ = net.halves(texts)
    y = np.full(x.size, -1)
    y[slot] = class_of[targets]
    x, y = np.concatenate([np.concatenate([x[:1], x[:-1]]), x], axis=1), y.reshape(x.shape)
    adam, total = Adam(p), EPOCHS * -(-len(x) // STEP_HALVES)
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for i in range(0, len(x), STEP_HALVES):
            pick = order[i : i + STEP_HALVES]
            adam.step(_gradients(net, x[pick], y[pick], first[pick]), RATE * (1 - 0.9 * (adam.steps + 1) / total))
    return net


def train_on(net: Network, adam: Adam, texts: list[np.ndarray], rate: float) -> np.ndarray:
    """Steps of Adam over texts in their order; gives how often each input was read."""
    x, first, slot, targets, _ = net.halves(texts)
    y = np.full(x.size, -1)
    y[slot] = net.class_of[targets]
    y = y.reshape(x.shape)
    # The half window before, of which a step has the keys and values; a text's first has none.
    x = np.concatenate([np.zeros_like(x[:1]), x])
    cuts = np.linspace(0, len(y), max(1, round(len(y) / STEP_HALVES)) + 1).astype(int)
    for a, b in zip(cuts, cuts[1:], strict=False):
        adam.step(_half_gradients(net, x[a : b + 1], y[a:b], first[a:b], slice(0, -1), slice(1, None)), rate)
    return np.bincount(x[1:].reshape(-1)[slot], minlength=len(net.p["E"]))


def _gradients(net: Network, x: np.ndarray, y: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    """Of windows that share nothing (n x WINDOW)."""
    return _half_gradients(net, x.reshape(-1, STRIDE), y, first, slice(0, None, 2), slice(1, None, 2))


def _half_gradients(net: Network, x: np.ndarray, y: np.ndarray, first: np.ndarray, early: slice, late: slice) -> dict[str, np.ndarray]:
    """Of half windows x: those at ``late`` are predicted, each with the one at ``early`` before it."""
    p, n = net.p, len(y)
    inputs = x.ravel()
    e = p["E"][inputs]
    weights = p["W"].copy()
    weights[:, :WIDTH] *= np.float32(WIDTH**-0.5)
    qkv = (e @ weights).reshape(len(x), STRIDE, 3 * WIDTH)
    q = np.ascontiguousarray(qkv[late, :, :WIDTH])
    k, v = (np.concatenate([t[early], t[late]], axis=1) for t in (qkv[:, :, WIDTH : 2 * WIDTH], qkv[:, :, 2 * WIDTH :]))
    a = q @ np.ascontiguousarray(k.swapaxes(1, 2))
    a += p["P"][DISTANCE] + MASK
    a[first, :, : WINDOW - STRIDE] = -1e9
    reach = float(np.abs(q).max(initial=0)) * float(np.abs(k).max(initial=0)) * WIDTH + float(np.abs(p["P"]).max())
    if not reach < SAFE:
        a -= a.max(-1, keepdims=True)
    np.exp(a, out=a)
    a /= (a.reshape(-1, WINDOW) @ ONES).reshape(n, STRIDE, 1)
    o = a @ v
    flat = lambda t: t.reshape(-1, t.shape[-1])
    h = flat(e.reshape(len(x), STRIDE, WIDTH)[late]) + flat(o) @ p["O"]
    z = h @ p["U"]
    z += p["b"]
    if not np.abs(z).max(initial=0) < SAFE:
        z -= z.max(-1, keepdims=True)
    np.exp(z, out=z)
    t = y.ravel()
    real = np.flatnonzero(t >= 0)
    share = np.zeros((len(t), 1), z.dtype)
    share[real] = 1 / max(1, len(real))
    z *= share / z.sum(-1, keepdims=True)
    z[real, t[real]] -= share[real, 0]
    dh = z @ p["U"].T
    do = (dh @ p["O"].T).reshape(o.shape)
    ds = do @ np.ascontiguousarray(v.swapaxes(1, 2))
    # What a row of weights times its gradients sums up to.
    ds -= (do * o).sum(-1, keepdims=True)
    ds *= a
    g_p = np.bincount(DISTANCE.ravel(), ds.sum(0).ravel(), WINDOW).astype(p["P"].dtype)
    dqkv = np.zeros((len(x), STRIDE, 3 * WIDTH), e.dtype)
    dqkv[late, :, :WIDTH] = ds @ k
    for shift, d in ((WIDTH, ds.swapaxes(1, 2) @ q), (2 * WIDTH, a.swapaxes(1, 2) @ do)):
        dqkv[late, :, shift : shift + WIDTH] += d[:, -STRIDE:]
        dqkv[early, :, shift : shift + WIDTH] += d[:, : WINDOW - STRIDE]
    de = (flat(dqkv) @ weights.T).reshape(len(x), STRIDE, WIDTH)
    de[late] += dh.reshape(n, STRIDE, WIDTH)
    g_w = e.T @ flat(dqkv)
    g_w[:, :WIDTH] *= np.float32(WIDTH**-0.5)
    # Sums of the rows of each input.
    order = np.argsort(inputs, kind="stable")
    starts = np.flatnonzero(np.diff(inputs[order], prepend=-1))
    g_e = np.zeros_like(p["E"])
    g_e[inputs[order[starts]]] = np.add.reduceat(flat(de)[order], starts, axis=0)
    return {"E": g_e, "P": g_p, "W": g_w, "O": flat(o).T @ dh, "U": h.T @ z, "b": z.sum(0)}


def pack_change(net: Network, trained: dict[str, np.ndarray], read: np.ndarray) -> np.ndarray:
    """How a task's parameters differ from the network's, times what it read; sums of these are averaged by :func:`add_change`."""
    change = {k: trained[k] - w for k, w in net.p.items()}
    change["E"] *= read[:, None]
    parts = [change["E"].ravel(), *[change[k].ravel() * float(read.sum()) for k in sorted(net.p) if k != "E"], read, [read.sum()]]
    return np.concatenate([np.asarray(x, np.float64) for x in parts])


def add_change(net: Network, total: np.ndarray) -> Network:
    """The mean of the tasks' networks: an input's row by how often each task read it, the others by all that it read."""
    sizes = [net.p["E"].size, *[net.p[k].size for k in sorted(net.p) if k != "E"], len(net.p["E"]), 1]
    change, *others, read, (n,) = np.split(total, np.cumsum(sizes)[:-1])
    mean = {"E": change.reshape(net.p["E"].shape) / np.maximum(read, 1)[:, None]}
    mean |= {k: x.reshape(net.p[k].shape) / max(n, 1) for k, x in zip([k for k in sorted(net.p) if k != "E"], others, strict=True)}
    return replace(net, p={k: (w + mean[k]).astype(np.float32) for k, w in net.p.items()})


def word_logs(own: np.ndarray, begin: np.ndarray, targets: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The network's log probability of each word and end in a row of texts, and which are ends."""
    starts = np.flatnonzero(begins[targets])
    is_end = targets[starts] == len(begins) - 1
    total = np.add.reduceat(own.astype(np.float64), starts) - begin[starts]
    total[:-1] += np.where(is_end[:-1], 0, begin[starts[1:]])
    return total, is_end


def mix_level(counts: np.ndarray) -> np.ndarray:
    """0 for unknown words, else one more than the binary logarithm of the count, MIX_LEVELS - 1 at most."""
    return np.where(counts > 0, np.minimum(np.log2(np.maximum(counts, 1)).astype(np.int64) + 1, MIX_LEVELS - 1), 0)


def odds_bin(apart: np.ndarray) -> np.ndarray:
    """The bin of differences of log probabilities."""
    return np.clip(np.floor((apart + ODDS) * ODDS_STEPS), 0, 2 * ODDS * ODDS_STEPS - 1).astype(np.int64)


def fit_mix(network: np.ndarray, frequency: np.ndarray, levels: np.ndarray, steps: int = 30, times: np.ndarray | None = None) -> np.ndarray:
    """By EM, the network's weight for words of each level, from both log probabilities of words; ``times`` each."""
    mix = np.full(MIX_LEVELS, 0.5)
    times = np.ones(len(levels)) if times is None else times
    counts = np.bincount(levels, times, MIX_LEVELS)
    for _ in range(steps):
        share = 1 / (1 + np.exp(np.clip(frequency + np.log1p(-mix[levels]) - network - np.log(mix[levels]), -50, 50)))
        # As if each level had a few words of either kind more, so that no weight is 0 or 1.
        mix = (np.bincount(levels, share * times, MIX_LEVELS) + 2) / (counts + 4)
    return mix


def sample_size(rows: int, least: int = SAMPLE_DOCS) -> int:
    """How many of so many texts :func:`sampled` takes, if not fewer are asked for."""
    return max(least, rows // SAMPLE_EVERY)


def word_counts(docs: DataFrame, text: str, train_rows: Column, path: str) -> DataFrame:
    """(h, c): how often each word occurs in the training texts; h = -1 counts the ends, -2 - i the subword i."""

    def count(batches):
        seen: Counter = Counter()
        ends = 0
        _, size, begins = subwords(path)
        inner = np.zeros(size)

        def count_subwords():
            if seen:
                ids = ids_of(list(seen), path)
                # Each word's subwords begin with the one that holds its space.
                of = np.cumsum(begins[ids]) - 1
                inner[:] += np.bincount(ids, np.fromiter(seen.values(), np.int64, len(seen))[of], size)

        def out(pairs):
            return pa.RecordBatch.from_arrays([pa.array([h for h, _ in pairs], pa.int64()), pa.array([c for _, c in pairs], pa.int64())], names=["h", "c"])

        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update(words_of(t))
                ends += 1
                if len(seen) > CACHE_WORDS:
                    count_subwords()
                    yield out([(word_hash(w), c) for w, c in seen.items()])
                    seen.clear()
        count_subwords()
        yield out([(word_hash(w), c) for w, c in seen.items()] + [(-1, ends)] + [(-2 - int(i), int(inner[i])) for i in np.flatnonzero(inner)])

    rows = docs.where(train_rows).select(F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(count, "h long, c long").where("c > 0").groupBy("h").agg(F.sum("c").alias("c"))


def _arrays(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and counts of a table of at most TOP_WORDS rows."""

    def pack(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.column(c).to_numpy().tobytes()], pa.binary()) for c in ("h", "c")], names=["h", "c"])

    parts = counts.select("h", "c").mapInArrow(pack, "h binary, c binary").collect()
    h, c = (np.concatenate([np.frombuffer(r[i], np.int64) for r in parts] or [np.empty(0, np.int64)]) for i in (0, 1))
    order = np.argsort(h)
    return h[order], c[order]


def sampled(docs: DataFrame, doc_id: str, text: str, train_rows: Column, rows: int, least: int, path: str, most: int | None = None) -> list[list[bytes]]:
    """The words of sample_size(rows) training texts, ``most`` at most, the least by a hash of id and text; copies do not go together."""
    size = sample_size(rows, least) if most is None else min(sample_size(rows, least), most)
    h = F.xxhash64(F.col(doc_id).cast("string"), F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(3))
    # A little more than the share, so that the least of them can be cut to the size.
    share = min(1.0, 1.2 * (size + 50) / max(rows, 1))
    chosen = F.pmod(h, F.lit(1 << 30)) < int(share * (1 << 30))
    picked = docs.where(train_rows & chosen).select(F.pmod(h, F.lit(1 << 30)).alias("h"), F.col(text).cast("string").alias("t"))
    picked = picked.orderBy("h", "t").limit(size)
    return [words_of(r["t"]) for r in picked.collect()]  # sample_size texts at most


def _summed(parts: DataFrame, kind: type) -> list[np.ndarray]:
    """For each of BLOCKS blocks, the sum of its arrays (block, source, x as bytes of ``kind``): no task or driver holds more than two."""

    def add(batches):
        total, block = None, None
        for b in batches:
            for at, x in zip(b.column("block").to_pylist(), b.column("x"), strict=True):
                x = np.frombuffer(x.as_buffer(), kind)
                if at != block and block is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["block", "x"])
                total, block = (x.copy() if at != block else total + x), at
        if block is not None:
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["block", "x"])

    # In the order of their sources, so that sums of fractions repeat.
    dealt = parts.repartitionById(BLOCKS, "block").sortWithinPartitions("block", "source")
    return [np.frombuffer(r["x"], kind) for r in sorted(dealt.mapInArrow(add, "block int, x binary").collect(), key=lambda r: r["block"])]


def _blocks(source: int, arrays) -> Iterator[pa.RecordBatch]:
    """A row for each block, as :func:`_summed` takes them."""
    for i, x in enumerate(arrays):
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([source], pa.int64()), pa.array([np.ascontiguousarray(x).tobytes()], pa.binary())], names=["block", "source", "x"])


BLOCK_SCHEMA = "block int, source long, x binary"


def all_neighbours(docs: DataFrame, text: str, train_rows: Column, common: np.ndarray, n_ids: int, path: str) -> np.ndarray:
    """:func:`neighbours` in all training texts, counted in tasks."""

    def count(batches):
        words = [WordIds(path)]

        def streams():
            for whole in batches:
                for b in batches_by_size(whole, "t", BATCH_BYTES):
                    yield np.concatenate([np.append(ids, n_ids) for ids in _ids_of_texts(words, b.column("t").to_pylist())[1]])

        yield from _blocks(0, np.array_split(neighbours(streams(), common, n_ids), BLOCKS))

    rows = docs.where(train_rows).select(F.col(text).cast("string").alias("t"))
    width = 2 * min(FREQUENT, len(common))
    return np.concatenate([np.empty((0, width), np.float32), *[x.reshape(-1, width).astype(np.float32) for x in _summed(rows.mapInArrow(count, BLOCK_SCHEMA), np.int64) if width]])


def _ids_of_texts(words: list[WordIds], texts: list[str | None]) -> tuple[list[list[bytes]], list[np.ndarray]]:
    """The words and subword ids of each text; ``words`` holds what a task keeps of them, and is emptied when it grows too large."""
    split = [words_of(t) for t in texts]
    every = set().union(*split)
    if len(words[0].number) + len(every) > CACHE_WORDS:
        words[0] = WordIds(words[0].path)
    words[0].learn([w for w in every if w not in words[0].number])
    return split, [words[0].of(np.fromiter(map(words[0].number.__getitem__, ws), np.int64, len(ws))) for ws in split]


def trained_by(network: Network, docs: DataFrame, shards: int, left: float, path: str) -> Network:
    """The network after tasks have each trained it on their own texts of ``docs`` (place, t), and the mean of what they learnt."""
    net = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches):
        own = replace(net.value, p={k: w.copy() for k, w in net.value.p.items()})
        adam, read, words, shard = Adam(own.p), np.zeros(len(own.p["E"])), [WordIds(path)], None
        for whole in batches:
            for b in batches_by_size(whole, "t", BATCH_BYTES):
                shard = b.column("shard")[0].as_py()
                read += train_on(own, adam, _ids_of_texts(words, b.column("t").to_pylist())[1], SHARD_RATE * left)
        if shard is not None:
            yield from _blocks(shard, np.array_split(pack_change(net.value, own.p, read), BLOCKS))

    dealt = docs.withColumn("shard", F.pmod(F.xxhash64("place"), F.lit(shards)).cast("int")).repartitionById(shards, "shard").sortWithinPartitions("place", "t")
    found = _summed(dealt.select("shard", "t").mapInArrow(run, BLOCK_SCHEMA), np.float64)
    out = add_change(network, np.concatenate(found)) if found else network
    net.destroy()
    return out


def score(docs: DataFrame, path: str, train_rows: Column, doc_id: str = "doc_id", text: str = "text", sample_docs: int = SAMPLE_DOCS, top_words: int = TOP_WORDS) -> DataFrame:
    """One row per document: the id, n_tokens, n_known, train_tokens, base_score and score.

    base_score is the add-one word unigram's log10 probability, score the model's.
    ``train_rows`` picks the training rows.  Null, empty and blank texts are one end
    token.  Repeated rows are scored each and count each in training.  Without training
    rows all counts are 0 and the network stays as it was drawn.  An empty table gives
    an empty table.  Other columns are ignored.
    """
    spark = docs.sparkSession
    every = materialise(word_counts(docs, text, train_rows, path), "words")
    counts = every.where("h >= -1")
    n, v = (x or 0 for x in counts.agg(F.sum("c"), F.count("*")).first())
    # By powers of two: the least count from which on there are top_words words at most.
    level = F.floor(F.log2("c")).cast("int")
    levels = {r["l"]: r["n"] for r in counts.groupBy(level.alias("l")).agg(F.count("*").alias("n")).collect()}  # 64 rows at most
    least, room = 64, top_words
    while least > 0 and levels.get(least - 1, 0) <= room:
        least -= 1
        room -= levels.get(least, 0)
    is_top = (level >= least) | (F.col("h") == -1)
    top = spark.sparkContext.broadcast(_arrays(counts.where(is_top)))

    size, begins = subwords(path)[1:]
    begins = np.append(begins, True)  # the end comes last
    lower = float(np.log(n + v + 1))
    totals = np.zeros(size + 1)
    for h, c in every.where("h < 0").collect():  # at most one row for each subword, and the end
        totals[-2 - h if h < -1 else size] = c
    rows = int(totals[size])

    def passed(batches, net):
        """For bounded batches: the batch, its texts' words, each word's number, and for the words and ends of all texts in a row the count (-1 - hash for words of no top count), the network's log probability and which are ends."""
        (hashes, numbers), model = top.value, net.value
        ends = int(numbers[np.searchsorted(hashes, -1)]) if -1 in hashes[:1] else 0
        words, known = WordIds(path), np.empty(0, np.int64)  # count of a top word; -1 - hash of another

        def counted(new):
            h = np.fromiter(map(word_hash, new), np.int64, len(new))
            i = np.minimum(np.searchsorted(hashes, h), max(len(hashes) - 1, 0))
            hit = hashes[i] == h if len(hashes) else np.zeros(len(h), bool)
            return np.where(hit, numbers[i] if len(numbers) else 0, -1 - h)

        for whole in batches:
            for b in batches_by_size(whole, "_text", BATCH_BYTES):
                split = [words_of(t) for t in b.column("_text").to_pylist()]
                every = set().union(*split)
                new = [w for w in every if w not in words.number]
                if len(words.number) + len(new) > CACHE_WORDS:
                    words, known, new = WordIds(path), known[:0], list(every)
                words.learn(new)
                known = np.concatenate([known, counted(new)])
                which = [np.fromiter(map(words.number.__getitem__, ws), np.int64, len(ws)) for ws in split]
                own, begin, targets, _ = model.score_flat([words.of(w) for w in which])
                # One entry for each word and each end, of all texts in a row.
                total, is_end = word_logs(own, begin, targets, begins)
                c = np.full(len(total), ends)
                c[~is_end] = known[np.concatenate(which)]
                yield b, which, c, total, is_end

    def odds(batches, net):
        """Counts (level, bin, n) of the odds of top words, which leave out the text's own words; others as (h, x, n, mine): in n places, mine of the text's."""
        table = np.zeros((MIX_LEVELS, 2 * ODDS * ODDS_STEPS), np.int64)
        names = ["level", "bin", "n", "h", "x", "mine"]
        none = lambda k, kind: pa.nulls(k, kind)
        for _, which, c, total, is_end in passed(batches, net):
            mine = np.ones(len(total), np.int64)
            for_words = [np.unique(w, return_inverse=True, return_counts=True)[1:] for w in which]
            mine[~is_end] = np.concatenate([n[i] for i, n in for_words] or [mine[:0]])
            seen = c >= 0
            left = np.maximum(c[seen] - mine[seen], 0)
            np.add.at(table, (mix_level(left), odds_bin(np.log(left + 1.0) - lower - total[seen])), 1)
            rest = ~seen
            k = int(rest.sum())
            if k:
                yield pa.RecordBatch.from_arrays([none(k, pa.int32()), none(k, pa.int32()), pa.array(np.ones(k, np.int64)), pa.array(-1 - c[rest]), pa.array(total[rest]), pa.array(mine[rest])], names=names)
        level, at = np.nonzero(table)
        k = len(level)
        yield pa.RecordBatch.from_arrays([pa.array(level, pa.int32()), pa.array(at, pa.int32()), pa.array(table[level, at]), none(k, pa.int64()), none(k, pa.float64()), none(k, pa.int64())], names=names)

    common = common_subwords(totals)
    near = all_neighbours(docs, text, train_rows, common, size, path)
    place = F.xxhash64(F.col(doc_id).cast("string"), F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(4))
    part = lambda i: docs.where(train_rows & (F.pmod(place, F.lit(PARTS)) == i))
    start = sampled(docs, doc_id, text, train_rows & (F.pmod(place, F.lit(PARTS)) != PARTS - 1), rows - rows // PARTS, sample_docs, path, most=sample_docs)
    network = train([ids_of(ws, path) for ws in start], size, begins[:-1], totals=totals, near=near)
    del start
    shards = max(1, round(rows / (PARTS * SHARD_TEXTS)))
    mix = np.full(MIX_LEVELS, 0.5)
    for i in range(PARTS):
        if i == PARTS - 1:  # the last part fits the mixture first
            net = spark.sparkContext.broadcast(network)
            told = part(i).select(F.col(text).cast("string").alias("_text")).mapInArrow(lambda batches, net=net: odds(batches, net), "level int, bin int, n long, h long, x double, mine long")
            told = materialise(told, "odds")
            rare = told.where("h IS NOT NULL").join(counts.where(~is_top).select("h", "c"), "h").withColumn("_left", F.greatest(F.col("c") - F.col("mine"), F.lit(0)))
            apart = F.log(F.col("_left") + F.lit(1.0)) - F.lit(lower) - F.col("x")
            bin_ = F.least(F.greatest(F.floor((apart + ODDS) * ODDS_STEPS), F.lit(0)), F.lit(2 * ODDS * ODDS_STEPS - 1)).cast("int")
            kind = F.when(F.col("_left") > 0, F.least(F.floor(F.log2("_left")).cast("int") + 1, F.lit(MIX_LEVELS - 1))).otherwise(0)
            told = told.where("h IS NULL").select("level", "bin", "n").unionByName(rare.select(kind.alias("level"), bin_.alias("bin"), "n"))
            found = told.groupBy("level", "bin").agg(F.sum("n").alias("n")).toPandas()  # at most a row for each level and bin
            middle = (found["bin"].to_numpy(np.float64) + 0.5) / ODDS_STEPS - ODDS
            mix = fit_mix(np.zeros(len(found)), middle, found["level"].to_numpy(np.int64), times=found["n"].to_numpy(np.float64))
        network = trained_by(network, part(i).select(place.alias("place"), F.col(text).cast("string").alias("t")), shards, 1 - 0.9 * i / (PARTS - 1), path)
        free_shuffles(spark)
    net = spark.sparkContext.broadcast(network)
    in_net, in_words = np.log(mix), np.log1p(-mix)

    schema = T.StructType([T.StructField("_id", docs.schema[doc_id].dataType)] + [T.StructField(c, T.LongType()) for c in ("n_tokens", "known")] + [T.StructField(c, T.DoubleType()) for c in ("logs", "score")] + [T.StructField("tail", T.ArrayType(T.StructType([T.StructField("h", T.LongType()), T.StructField("x", T.DoubleType())])))])

    def run(batches):
        for b, which, c, total, _ in passed(batches, net):
            seen = c >= 0
            # Words of no top count are taken for unknown here; the join below mends the others.
            count = np.maximum(c, 0)
            kind = mix_level(count)
            mixed = np.logaddexp(total + in_net[kind], np.log(count + 1.0) - lower + in_words[kind])
            sizes = np.array([len(ws) + 1 for ws in which])
            at = np.cumsum(sizes) - sizes
            tail_ends = np.concatenate([[0], np.cumsum(np.add.reduceat((~seen).astype(np.int32), at))])
            tail = pa.StructArray.from_arrays([pa.array(-1 - c[~seen], pa.int64()), pa.array(total[~seen], pa.float64())], names=["h", "x"])
            tails = pa.ListArray.from_arrays(pa.array(tail_ends, pa.int32()), tail)
            out = {
                "n_tokens": sizes,
                "known": np.add.reduceat((c > 0).astype(np.int64), at),
                "logs": np.add.reduceat(np.where(seen, np.log10(count + 1.0), 0), at),
                "score": np.add.reduceat(mixed, at) / np.log(10),
            }
            yield pa.RecordBatch.from_arrays(
                [b.column("_id"), *[pa.array(out[c], pa.int64()) for c in ("n_tokens", "known")], *[pa.array(out[c], pa.float64()) for c in ("logs", "score")], tails],
                names=[f.name for f in schema],
            )

    scored = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_text")).mapInArrow(run, schema)
    scored = materialise(scored.withColumn("_row", F.monotonically_increasing_id()), "scored")
    rare = scored.select("_row", F.explode("tail").alias("t")).select("_row", "t.h", "t.x").join(counts.where(~is_top), "h")

    def mixture(count, kind):
        """log(exp(x) * weight + (count + 1) / (N + V + 1) * (1 - weight))."""
        weights = [F.element_at(F.array(*[F.lit(float(w)) for w in ws]), kind + 1) for ws in (in_net, in_words)]
        a, b = F.col("x") + weights[0], F.log(count + F.lit(1.0)) - F.lit(lower) + weights[1]
        return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))

    more = mixture(F.col("c"), F.least(level + 1, F.lit(MIX_LEVELS - 1))) - mixture(F.lit(0), F.lit(0))
    rare = rare.groupBy("_row").agg(F.sum(F.log10(F.col("c") + 1)).alias("rare_logs"), F.count("*").alias("rare_known"), (F.sum(more) / float(np.log(10))).alias("rare_score"))
    out = scored.drop("tail").join(rare, "_row", "left")
    return out.select(
        F.col("_id").alias(doc_id),
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("rare_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(lower / float(np.log(10)))).alias("base_score"),
        (F.col("score") + F.coalesce("rare_score", F.lit(0.0))).alias("score"),
    )
