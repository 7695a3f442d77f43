"""Language-model scores: a gated recurrent network with a class-factored output, in numpy.

Counts of all training tokens are gathered by Spark. The most frequent words are
the network's vocabulary, in classes of equal size by rank; every other word
falls into one of a few *shape* classes, inside which the corpus counts decide.
The output is a softmax over classes and, for vocabulary words, one over the
class's words, both from the recurrent state. Training is truncated
backpropagation over all documents that are not held out, once, the state carried
from window to window: their pieces are dealt out to rounds and shards, every shard
of a round starts from the same parameters, and the mean of theirs, weighted by
tokens, is the next round's start. Scoring runs many documents side by side and carries each one's state
through to its end, so a text's score is its complete log-likelihood.

Words beyond the ``HEAD`` most frequent never reach the driver or a broadcast:
they are joined with the counts by a shuffle, where no word is frequent any more.
"""

from __future__ import annotations

import copy
import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warpline.llm.langid import fold
from warpline.plans.scratch import Scratch, pick

#: The end of a text as a token; no word can equal it.
END = b"\n"
#: Words whose counts every task holds; vocabulary of the network and words of a class.
HEAD, VOCAB, CLASS_SIZE = 1 << 16, 1024, 32
SHAPES = 8
HIDDEN = 32
#: Tokens of a training shard, about, and rounds after which the shards' parameters are averaged.
SHARD_TOKENS, ROUNDS = 2_000_000, 2
#: Tokens of the pieces that longer documents are cut into for training, and tokens that a shard holds at a time.
PIECE, BLOCK = 2_000, 256_000
#: Tokens of texts longer than a piece that a task holds for scoring.
LONG_BLOCK = 2_000_000
LANES, WINDOW, RATE = 256, 20, 0.01
SCORE_LANES, SCORE_WINDOW = 384, 32
#: Steps of the lanes that are laid out at a time.
STEPS = 640
#: Parts of a power of two by which counts are told apart to find the head.
_GRADES = 16
_FLUSH = 200_000


def words_of(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased, and the end."""
    out = (text or "").encode("utf-8", "replace").lower().split()
    out.append(END)
    return out


def shape(word: bytes) -> int:
    """Class of a word outside the vocabulary, by its letters and its end."""
    if not word[:-1].isalnum() and word.isascii():
        return 6 if any(c in b"0123456789" for c in word) else 7
    if word.isdigit():
        return 6
    last = word[-1:]
    end = 1 if last == b"," else 2 if last in (b".", b"!", b"?") else 0
    return end + (0 if word.isascii() else 3)


@dataclass
class Network:
    """Parameters of the recurrent model over ``words`` vocabulary words and SHAPES shapes.

    Input and class ids: vocabulary words first, then shapes; one more input is the start of a text.
    """

    words: int
    x: np.ndarray  # (words + SHAPES + 1, 3H) input part of the gates
    u: np.ndarray  # (H, 3H) recurrent part
    b: np.ndarray  # (3H,)
    wc: np.ndarray  # (H, classes)
    bc: np.ndarray  # (classes,)
    wo: np.ndarray  # (word classes, H, CLASS_SIZE)
    bo: np.ndarray  # (word classes, CLASS_SIZE); -1e9 where a class has no such word

    def params(self) -> list[np.ndarray]:
        return [self.x, self.u, self.b, self.wc, self.bc, self.wo, self.bo]

    @property
    def word_classes(self) -> int:
        return len(self.bo)

    def class_of(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids < self.words, ids // CLASS_SIZE, self.word_classes + ids - self.words)


def new_network(word_counts: np.ndarray, shape_counts: np.ndarray, hidden: int = HIDDEN, seed: int = 5) -> Network:
    """A network that starts from the unigram distribution of the counts."""
    rng = np.random.default_rng(seed)
    n = len(word_counts)
    k = -(-n // CLASS_SIZE)
    f = np.float32
    padded = np.zeros(k * CLASS_SIZE)
    padded[:n] = word_counts + 1.0
    grid = padded.reshape(k, CLASS_SIZE)
    total = np.concatenate([grid.sum(axis=1), shape_counts + 1.0])
    with np.errstate(divide="ignore"):
        bo = np.where(grid > 0, np.log(np.maximum(grid, 1e-9)), -1e9)
    return Network(
        n,
        rng.normal(0, 0.1, (n + SHAPES + 1, 3 * hidden)).astype(f),
        rng.normal(0, 0.5 / math.sqrt(hidden), (hidden, 3 * hidden)).astype(f),
        np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(hidden)]).astype(f),
        np.zeros((hidden, k + SHAPES), dtype=f),
        np.log(total / total.sum()).astype(f),
        np.zeros((k, hidden, CLASS_SIZE), dtype=f),
        bo.astype(f),
    )


def _runs(classes: np.ndarray, limit: int) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """Positions of the classes below ``limit`` in order of class, and each class's part of them."""
    order = np.argsort(classes.astype(np.int16), kind="stable")
    cuts = np.searchsorted(classes[order], np.arange(limit + 1)).tolist()
    return order[: cuts[limit]], [(c, slice(cuts[c], cuts[c + 1])) for c in range(limit) if cuts[c + 1] > cuts[c]]


def _word_logits(net: Network, s: np.ndarray, parts: list[tuple[int, slice]]) -> np.ndarray:
    """(M, CLASS_SIZE) logits inside their classes of states ``s`` in order of class."""
    z = np.empty((len(s), CLASS_SIZE), dtype=s.dtype)
    for c, own in parts:
        np.matmul(s[own], net.wo[c], out=z[own])
        z[own] += net.bo[c]
    return z


def _softmax(z: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities by row, in place of the logits, and the log-probability of each row's ``k``."""
    rows = np.arange(len(z))
    z -= z.max(axis=-1, keepdims=True)
    picked = z[rows, k]
    np.exp(z, out=z)
    total = z @ np.ones(z.shape[1], dtype=z.dtype)
    z /= total[:, None]
    return z, picked - np.log(total)


def _forward(net: Network, ids: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: bool) -> tuple[np.ndarray, list, np.ndarray]:
    """States (T * B, H) of a window, what backpropagation needs, and the last state.

    Lanes are the last axis inside, so that each gate is one block of memory.
    """
    hid = net.u.shape[0]
    inputs = np.ascontiguousarray((net.x + net.b).T)
    across = np.ascontiguousarray(net.u.T)
    now = np.ascontiguousarray(h.T)
    states = np.empty((len(ids), hid, ids.shape[1]), dtype=now.dtype)
    saved = []
    for t in range(len(ids)):
        if fresh[t].any():
            now = now * (1 - fresh[t])
        a = across @ now
        gx = inputs.take(ids[t], axis=1, mode="clip")
        g = gx[: 2 * hid] + a[: 2 * hid]
        np.negative(g, out=g)
        np.exp(np.minimum(g, 60, out=g), out=g)
        g += 1
        np.reciprocal(g, out=g)
        r, z, rest = g[:hid], g[hid:], a[2 * hid :]
        n = np.tanh(gx[2 * hid :] + r * rest)
        new = n + z * (now - n)
        if keep:
            saved.append((now, r, z, n, rest))
        now = states[t] = new
    return states.transpose(0, 2, 1).reshape(-1, hid), saved, now.T


def _log_probs(net: Network, s: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural log-probabilities of targets (class part alone for shapes) from states (M, H)."""
    cls = net.class_of(target)
    z = s @ net.wc
    z += net.bc
    out = _softmax(z, cls)[1].astype(np.float64)
    at, parts = _runs(cls, net.word_classes)
    out[at] += _softmax(_word_logits(net, s[at], parts), target[at] % CLASS_SIZE)[1]
    return out


def gradients(net: Network, ids: np.ndarray, target: np.ndarray, fresh: np.ndarray, valid: np.ndarray, h: np.ndarray) -> tuple[float, int, list[np.ndarray], np.ndarray]:
    """A window's summed loss and valid tokens, the gradients of its mean loss by ``params()``, and the last state."""
    hid, lanes = net.u.shape[0], ids.shape[1]
    s, saved, last = _forward(net, ids, fresh, h, True)
    y, w = target.reshape(-1), valid.reshape(-1).astype(np.float32)
    count = max(1.0, float(w.sum()))
    # output layer
    cls = net.class_of(y)
    rows = np.arange(len(y))
    d = s @ net.wc
    d += net.bc
    d, lp = _softmax(d, cls)
    loss = -float((lp * w).sum())
    d[rows, cls] -= 1
    d *= (w / count)[:, None]
    g_wc, g_bc = s.T @ d, d.sum(axis=0)
    ds = d @ net.wc.T
    g_wo, g_bo = np.zeros_like(net.wo), np.zeros_like(net.bo)
    at, parts = _runs(cls, net.word_classes)
    of, k = s[at], y[at] % CLASS_SIZE
    e, lp = _softmax(_word_logits(net, of, parts), k)
    loss -= float((lp * w[at]).sum())
    e[rows[: len(at)], k] -= 1
    e *= (w[at] / count)[:, None]
    back = np.empty_like(of)
    for c, own in parts:
        g_wo[c], g_bo[c] = of[own].T @ e[own], e[own].sum(axis=0)
        np.matmul(e[own], net.wo[c].T, out=back[own])
    ds[at] += back
    # recurrence, back through the window
    ds = np.ascontiguousarray(ds.reshape(*ids.shape, hid).transpose(0, 2, 1))
    dg = np.empty((len(ids), 3 * hid, lanes), dtype=net.x.dtype)
    g_u = np.zeros_like(net.u)
    dh = np.zeros_like(ds[0])
    for t in reversed(range(len(ids))):
        h0, r, z, n, rest = saved[t]
        dh += ds[t]
        own = dg[t]
        dn = own[2 * hid :] = dh * (1 - z) * (1 - n * n)
        own[hid : 2 * hid] = dh * (h0 - n) * z * (1 - z)
        own[:hid] = dn * rest * r * (1 - r)
        da = np.concatenate([own[: 2 * hid], dn * r])
        g_u += h0 @ da.T
        dh = dh * z + net.u @ da
        dh *= 1 - fresh[t]
    flat = dg.transpose(0, 2, 1).reshape(-1, 3 * hid)
    g_x = np.zeros_like(net.x)
    order = np.argsort(ids.reshape(-1), kind="stable")
    sorted_ids = ids.reshape(-1)[order]
    first = np.flatnonzero(np.r_[True, sorted_ids[1:] != sorted_ids[:-1]])
    g_x[sorted_ids[first]] = np.add.reduceat(flat[order], first, axis=0)
    return loss, int(w.sum()), [g_x, g_u, flat.sum(axis=0), g_wc, g_bc, g_wo, g_bo], last


class Trainer:
    """Adam on windows of truncated backpropagation; the rate falls over ``total`` steps, ``done`` of them made before."""

    def __init__(self, net: Network, total: int, done: int = 0) -> None:
        self.net, self.total, self.done, self.step = net, total, done, 0
        self.m1 = [np.zeros_like(p) for p in net.params()]
        self.m2 = [np.zeros_like(p) for p in net.params()]

    def run(self, docs: list[np.ndarray]) -> tuple[float, int]:
        """One pass over ``docs``; the loss and the number of tokens."""
        net = self.net
        lanes = min(LANES, max(1, len(docs)))
        h = np.zeros((lanes, net.u.shape[0]), dtype=np.float32)
        loss, seen = 0.0, 0
        alive = np.arange(lanes)
        for ids, target, fresh, valid, _ in _windows(net, docs, lanes, WINDOW):
            left = valid[0, alive]
            if not left.all():  # lanes that have ended add nothing to any gradient
                alive, h = alive[left], h[left]
            if len(alive) < lanes:
                ids, target, fresh, valid = (a[:, alive] for a in (ids, target, fresh, valid))
            lost, count, grads, h = gradients(net, ids, target, fresh, valid, h)
            if not count:
                continue
            loss += lost
            seen += count
            norm = math.sqrt(sum(float((g * g).sum()) for g in grads))
            scale = min(1.0, 1.0 / norm) if norm else 1.0
            self.step += 1
            rate = RATE * max(0.1, 1 - (self.done + self.step) / self.total) * math.sqrt(1 - 0.999**self.step) / (1 - 0.9**self.step)
            for p, g, a1, a2 in zip(net.params(), grads, self.m1, self.m2):
                g = g * scale
                a1 += 0.1 * (g - a1)
                a2 += 0.001 * (g * g - a2)
                p -= (rate * a1 / (np.sqrt(a2) + 1e-8)).astype(np.float32)
        return loss, seen


def _windows(net: Network, docs: list[np.ndarray], lanes: int, width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Documents laid end to end in lanes, a window at a time: inputs, targets, starts, validity (T, lanes) and document numbers.

    Each document goes to the shortest lane, longest first. A document's first
    input is the start of a text, and the state is reset there. Memory is that of
    ``STEPS`` steps, whatever the length of a document.
    """
    lengths = np.array([len(d) for d in docs], dtype=np.int64)
    heap = [(0, k) for k in range(lanes)]
    put: list[list[int]] = [[] for _ in range(lanes)]
    for i in np.argsort(-lengths, kind="stable"):
        n, k = heapq.heappop(heap)
        put[k].append(int(i))
        heapq.heappush(heap, (n + int(lengths[i]), k))
    longest = max(n for n, _ in heap)
    steps = max(1, STEPS // width) * width
    at = [(0, 0)] * lanes  # the lane's document, and how much of it has been laid out
    for base in range(0, longest, steps):
        size = min(steps, longest - base)
        ids = np.zeros((size, lanes), dtype=np.int32)
        target = np.zeros((size, lanes), dtype=np.int32)
        fresh = np.zeros((size, lanes), dtype=np.float32)
        valid = np.zeros((size, lanes), dtype=bool)
        number = np.zeros((size, lanes), dtype=np.int64)
        for k, own in enumerate(put):
            (j, off), t = at[k], 0
            while j < len(own) and t < size:
                doc = docs[own[j]]
                n = min(len(doc) - off, size - t)
                target[t : t + n, k] = doc[off : off + n]
                valid[t : t + n, k] = True
                number[t : t + n, k] = own[j]
                if off:
                    ids[t : t + n, k] = doc[off - 1 : off + n - 1]
                elif n:
                    ids[t, k] = net.words + SHAPES
                    ids[t + 1 : t + n, k] = doc[: n - 1]
                    fresh[t, k] = 1
                t, off = t + n, off + n
                if off == len(doc):
                    j, off = j + 1, 0
            at[k] = (j, off)
        for a in range(0, size, width):
            w = slice(a, a + width)
            yield ids[w], target[w], fresh[w], valid[w], number[w]


def score(net: Network, docs: list[np.ndarray]) -> np.ndarray:
    """Natural log-likelihood of each id sequence, the state carried from its start to its end."""
    if not docs:
        return np.zeros(0)
    lanes = min(SCORE_LANES, len(docs))
    out = np.zeros(len(docs))
    h = np.zeros((lanes, net.u.shape[0]), dtype=np.float32)
    alive = np.arange(lanes)
    for ids, target, fresh, valid, number in _windows(net, docs, lanes, SCORE_WINDOW):
        left = valid[0, alive]
        if not left.all():  # lanes that have ended drop out
            alive, h = alive[left], h[left]
        states, _, h = _forward(net, ids[:, alive], fresh[:, alive], h, False)
        ok = valid[:, alive].reshape(-1)
        lp = _log_probs(net, states[ok], target[:, alive].reshape(-1)[ok])
        out += np.bincount(number[:, alive].reshape(-1)[ok], weights=lp, minlength=len(docs))
    return out


@dataclass
class Lexicon:
    """The head words, and what is known of the rest."""

    index: dict[bytes, int]
    ids: np.ndarray  # head word -> network id
    log_c: np.ndarray  # head word -> log10(c + 1)
    words: int
    shape_norm: np.ndarray  # log10(N_s + V_s + 1) of each shape

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(head positions or -1, network ids)."""
        at = np.fromiter(map(self.index.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        ids = self.ids[at].astype(np.int32) if len(self.ids) else np.zeros(len(at), dtype=np.int32)
        rare = np.flatnonzero(at < 0).tolist()
        ids[rare] = [self.words + shape(words[i]) for i in rare]
        return at, ids


def count_tokens(docs: DataFrame) -> DataFrame:
    """``(word binary, c, shape)`` of the tokens of ``docs(text)``, the end included; tasks combine their own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            w = list(seen)
            out = pa.RecordBatch.from_arrays([pa.array(w, pa.binary()), pa.array(seen.values(), pa.int64()), pa.array(list(map(shape, w)), pa.int32())], names=["word", "n", "shape"])
            seen.clear()
            return out

        for b in batches:
            for t in b.column(0):
                seen.update(words_of(t.as_py()))
                if len(seen) > _FLUSH:
                    yield flush()
        if seen:
            yield flush()

    part = docs.select("text").mapInArrow(run, "word binary, n long, shape int")
    return part.groupBy("word").agg(F.sum("n").alias("c"), F.min("shape").alias("shape"))


def _head(counts: DataFrame) -> list:
    """The most frequent words, ``HEAD`` at most, by falling count.

    A histogram of counts finds where to cut before any word goes to the driver;
    of the words at the cut, which are all about as frequent, a hash takes a share.
    """
    grade = F.floor(F.log2("c") * _GRADES).cast("int")
    sizes = {r["g"]: r["n"] for r in counts.groupBy(grade.alias("g")).agg(F.count(F.lit(1)).alias("n")).collect()}
    taken, cut, share = 0, -1, 0
    for g in sorted(sizes, reverse=True):
        if taken + sizes[g] > HEAD:
            cut, share = g, int((HEAD - taken) / sizes[g] * 0.97 * (1 << 20))
            break
        taken += sizes[g]
    some = counts.where((grade > cut) | ((grade == cut) & (F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < share)))
    return sorted(some.collect(), key=lambda r: (-r["c"], bytes(r["word"])))[:HEAD]


def lexicon(counts: DataFrame) -> tuple[Lexicon, Network, int, int]:
    """(lexicon, untrained network, N, V) of ``count_tokens``' table; the driver gets HEAD words at most."""
    head = _head(counts)
    by_shape = {r["shape"]: (r["n"], r["v"]) for r in counts.groupBy("shape").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    total = sum(n for n, _ in by_shape.values())
    distinct = sum(v for _, v in by_shape.values())
    words = min(VOCAB, len(head))
    n = np.array([by_shape.get(s, (0, 0))[0] for s in range(SHAPES)], dtype=np.float64)
    v = np.array([by_shape.get(s, (0, 0))[1] for s in range(SHAPES)], dtype=np.float64)
    for r in head[:words]:
        n[r["shape"]] -= r["c"]
        v[r["shape"]] -= 1
    ids = np.array([i if i < words else words + r["shape"] for i, r in enumerate(head)], dtype=np.int32)
    log_c = np.log10(np.array([r["c"] for r in head], dtype=np.float64) + 1)
    lex = Lexicon({bytes(r["word"]): i for i, r in enumerate(head)}, ids, log_c, words, np.log10(n + v + 1))
    net = new_network(np.array([r["c"] for r in head[:words]], dtype=np.float64), n)
    return lex, net, total, distinct


def pieces(docs: DataFrame, lex: Lexicon, shards: int) -> DataFrame:
    """``(round, shard, place, ids)``: network ids of all ``docs(doc_id, text)`` in pieces, in an order that a hash makes."""
    sent = docs.sparkSession.sparkContext.broadcast(lex)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            held = 0
            for key, t in zip(b.column(0).to_pylist(), b.column(1)):
                ids = sent.value.encode(words_of(t.as_py()))[1].astype(np.int16)
                for k in range(0, len(ids), PIECE):
                    out.append((key, k, ids[k : k + PIECE]))
                    held += len(out[-1][2])
                    if held > BLOCK:
                        yield batch(out)
                        out, held = [], 0
            if out:
                yield batch(out)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        keys, at, ids = zip(*out)
        ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
        cols = [pa.array(keys, pa.int64()), pa.array(at, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "at", "ids"])

    cut = docs.mapInArrow(run, "doc_id long, at long, ids array<short>")
    place = F.xxhash64("doc_id", "at", "ids", F.lit("grulm"))
    turn = F.pmod(F.xxhash64(place, F.lit(2)), F.lit(ROUNDS)).cast("int")
    return cut.select(turn.alias("round"), F.pmod(place, F.lit(shards)).cast("int").alias("shard"), F.xxhash64(place, F.lit(1)).alias("place"), "ids")


_SUM = "tokens long, params binary"


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for all: tokens, and the sum of parameters."""
    tokens, total = 0, None
    for b in batches:
        for n, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            tokens += n
            total = np.frombuffer(p, dtype=np.float64) + (0.0 if total is None else total)
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([tokens], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["tokens", "params"])


def _round(rows: DataFrame, net: Network, shards: int, total: int, done: int) -> DataFrame:
    """``(tokens, params)``, a row for each shard: the parameters times the tokens after one pass over its pieces, from ``net`` on."""
    sent = rows.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, own, tokens, block, held = None, None, 0, [], 0

        def ended() -> pa.RecordBatch:
            params = np.concatenate([p.ravel() for p in own.net.params()]).astype(np.float64) * tokens
            return pa.RecordBatch.from_arrays([pa.array([tokens], pa.int64()), pa.array([params.tobytes()], pa.binary())], names=["tokens", "params"])

        for b in batches:
            for s, ids in zip(b.column(0).to_pylist(), b.column(1)):
                if s != shard or held > BLOCK:
                    if block:
                        tokens += own.run(block)[1]
                    block, held = [], 0
                if s != shard:
                    if own is not None:
                        yield ended()
                    shard, own, tokens = s, Trainer(copy.deepcopy(sent.value), total, done), 0
                block.append(ids.values.to_numpy().astype(np.int32))
                held += len(ids)
        if own is not None:
            tokens += own.run(block)[1]
            yield ended()

    dealt = rows.repartition(shards, "shard").sortWithinPartitions("shard", "place").select("shard", "ids")
    return dealt.mapInArrow(run, _SUM)


def fit(docs: DataFrame, lex: Lexicon, net: Network, tokens: int, scratch: Scratch) -> list[int]:
    """Train ``net`` on all ``docs(doc_id, text)`` of ``tokens`` tokens; the tokens that each round has learned from.

    Shards grow in number with the corpus. Their parameters are summed on the
    executors, and the driver gets as many sums as the root of that number.
    """
    shards = max(1, -(-tokens // (SHARD_TOKENS * ROUNDS)))
    rows = scratch.save(pieces(docs, lex, shards), "pieces")
    steps = tokens // (ROUNDS * shards * LANES * WINDOW) + 1
    learned = []
    for r in range(ROUNDS):
        table = scratch.save(_round(rows.where(F.col("round") == r), net, shards, ROUNDS * steps, r * steps), f"round{r}")
        params = net.params()
        total, seen = np.zeros(sum(p.size for p in params)), 0
        for row in table.repartition(math.isqrt(shards)).mapInArrow(_summed, _SUM).toLocalIterator():
            total += np.frombuffer(row["params"], dtype=np.float64)
            seen += row["tokens"]
        if seen:
            cuts = np.cumsum([p.size for p in params])[:-1]
            for p, v in zip(params, np.split(total / seen, cuts)):
                p[...] = v.reshape(p.shape)
        learned.append(seen)
        scratch.drop(table)
    scratch.drop(rows)
    return learned


def language_model_scores(docs: DataFrame) -> DataFrame:
    """Unigram and recurrent log10-likelihoods of every row of ``docs(doc_id, text)``.

    Columns: doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score. Rows whose crc32(doc_id) mod 7 is 2 are held out; counts come from
    all others, and the network learns from all of those too. A null
    text counts as empty and is the end alone. Without training rows all words
    are unknown. Repeated rows give repeated results; an empty table gives an
    empty one; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "grulm")
    rows = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = rows.select("doc_id", (fold(7) == 2).alias("held_out"), "text")
    learn = rows.where("not held_out")
    counts = scratch.save(count_tokens(learn), "counts")
    lex, net, total, distinct = lexicon(counts)
    fit(learn.select("doc_id", "text"), lex, net, total, scratch)
    sent = docs.sparkSession.sparkContext.broadcast((lex, net))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexic, model = sent.value

        def scored(part: list[tuple]) -> pa.RecordBatch:
            keys, seqs, stats, tails = zip(*part)
            lm = score(model, list(seqs)) / math.log(10)
            cols = list(zip(*stats))
            own = [pa.array(c, kind) for c, kind in zip(zip(*keys), (pa.int64(), pa.int64(), pa.bool_()))]
            own += [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()), pa.array([float(a + c) for a, c in zip(lm, cols[3])], pa.float64())]
            own += [pa.array([list(t) for t in tails], pa.list_(pa.binary())), pa.array([list(t.values()) for t in tails], pa.list_(pa.int32()))]
            return pa.RecordBatch.from_arrays(own, names=["uid", "doc_id", "held_out", "n_tokens", "known", "head", "lm", "tail", "times"])

        # long texts wait for each other, so that their many steps have many lanes
        pools, held = [[], []], [0, 0]
        for b in batches:
            for *key, t in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3)):
                words = words_of(t.as_py())
                at, ids = lexic.encode(words)
                known = at[at >= 0]
                rare = ids - model.words
                norm = lexic.shape_norm[rare[rare >= 0]].sum()
                rare_head = known[known >= model.words]
                tail = Counter([words[j] for j in np.flatnonzero(at < 0).tolist()])
                stats = (len(words), len(known), float(lexic.log_c[known].sum()) if len(known) else 0.0, (float(lexic.log_c[rare_head].sum()) if len(rare_head) else 0.0) - float(norm))
                k = int(len(ids) > PIECE)
                pools[k].append((key, ids, stats, tail))
                held[k] += len(ids)
                if held[k] > (BLOCK, LONG_BLOCK)[k]:
                    yield scored(pools[k])
                    pools[k], held[k] = [], 0
        for part in filter(None, pools):
            yield scored(part)

    numbered = rows.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "held_out", "text")
    done = scratch.save(numbered.mapInArrow(run, "uid long, doc_id long, held_out boolean, n_tokens long, known long, head double, lm double, tail array<binary>, times array<int>"), "scored")
    tail = done.select("uid", F.explode(F.arrays_zip("tail", "times")).alias("w")).select("uid", F.col("w.tail").alias("word"), F.col("w.times").alias("times"))
    known = tail.join(counts.select("word", "c"), "word")
    known = known.groupBy("uid").agg(F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("tail_log"), F.sum("times").alias("tail_known"))
    out = done.drop("tail", "times").join(known, "uid", "left")
    log = F.coalesce("tail_log", F.lit(0.0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("head") + log - F.col("n_tokens") * F.lit(math.log10(total + distinct + 1))).alias("base_score"),
        (F.col("lm") + log).alias("score"),
    )
