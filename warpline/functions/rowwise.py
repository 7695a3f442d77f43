"""Kernels that are sequential or table-driven within a row: Arrow batches and NumPy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

EXTENSION_FIELDS = ["q_beg", "r_beg", "q_end", "r_end", "score", "true_score", "width"]


@dataclass(frozen=True)
class Penalties:
    """Costs of opening and of each symbol of a deletion and an insertion, the bonus at the query's end, and the drop that ends an extension (0: none)."""

    open_del: int = 6
    each_del: int = 1
    open_ins: int = 6
    each_ins: int = 1
    bonus: int = 5
    drop: int = 100


@dataclass
class Extended:
    """Results of extensions, one entry for each: the best score and where it ends, and the same for paths to the query's end."""

    score: np.ndarray
    q_end: np.ndarray
    t_end: np.ndarray
    whole_t_end: np.ndarray
    whole_score: np.ndarray
    off: np.ndarray  # farthest from the diagonal that the best score rose


def _padded(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(r) for r in rows], dtype=np.int64)
    out = np.full((len(rows), max(1, size.max(initial=0))), 4, dtype=np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out, size


def extend_all(queries: list[list[int]], targets: list[list[int]], scores: np.ndarray, cost: Penalties, width: np.ndarray, seed: np.ndarray) -> Extended:
    """Banded affine-gap extensions of many seeds side by side, one target symbol a step.

    Within a step the score of a cell is the best of: its diagonal neighbour and
    the symbols' score, a deletion that goes on, and an insertion. Insertions from
    all cells to the left are one running maximum of ``score + each * column``.
    A seed's live columns ``[low, high)`` follow the band and the cells above zero
    around the step's best one; it is finished where no cell is above zero or
    the score has dropped too far.
    """
    q, n = _padded(queries)
    t, m = _padded(targets)
    count, columns = len(n), q.shape[1]
    at = np.arange(columns + 1)
    top = max(0, int(scores.max()))
    band = width.copy()
    for opening, each in ((cost.open_ins, cost.each_ins), (cost.open_del, cost.each_del)):
        band = np.minimum(band, np.maximum(1, ((n * top + cost.bonus - opening) / each + 1.0).astype(np.int64)))
    diagonal = np.maximum(0, seed[:, None] - cost.open_ins - cost.each_ins * at)
    diagonal[:, 0] = seed
    deletion = np.zeros_like(diagonal)
    low, high = np.zeros(count, dtype=np.int64), n.copy()
    found = Extended(seed.copy(), *(np.full(count, -1, dtype=np.int64) for _ in range(4)), np.zeros(count, dtype=np.int64))
    live = np.flatnonzero(m > 0)
    for step in range(t.shape[1]):
        live = live[m[live] > step]
        if not len(live):
            break
        lo, hi = np.maximum(low[live], step - band[live]), np.minimum(np.minimum(high[live], step + band[live] + 1), n[live])
        inside = (at[:-1] >= lo[:, None]) & (at[:-1] < hi[:, None])
        down = deletion[live, :-1]
        match = np.maximum(diagonal[live, :-1] + scores[t[live, step][:, None], q[live]], down)
        source = np.where(inside, match - cost.open_ins + cost.each_ins * at[:-1], np.iinfo(np.int32).min)
        reach = np.maximum.accumulate(source, axis=1)
        insertion = np.zeros_like(match)
        insertion[:, 1:] = np.maximum(0, reach[:, :-1] - cost.each_ins * at[1:-1])
        cell = np.where(inside, np.maximum(match, insertion), -1)

        peak = np.maximum(cell.max(axis=1), 0)
        where = np.where(hi > lo, columns - 1 - cell[:, ::-1].argmax(axis=1), -1)
        border = np.maximum(0, seed[live] - cost.open_del - cost.each_del * (step + 1))
        rows = np.arange(len(live))
        final = np.where(hi > lo, cell[rows, np.maximum(hi - 1, 0)], border)
        shifted = diagonal[live]
        shifted[:, 1:] = np.where(inside, cell, shifted[:, 1:])
        begins = np.where(hi > lo, lo, hi)
        shifted[rows, begins] = border
        diagonal[live] = shifted
        later = deletion[live]
        later[:, :-1] = np.where(inside, np.maximum(np.maximum(down - cost.each_del, cell - cost.open_del - cost.each_del), 0), down)
        later[rows, hi] = 0
        deletion[live] = later

        ends = (np.maximum(lo, hi) == n[live]) & (final >= found.whole_score[live])
        found.whole_t_end[live[ends]], found.whole_score[live[ends]] = step, final[ends]
        up = peak > found.score[live]
        drift = (step - found.t_end[live]) - (where - found.q_end[live])
        lost = found.score[live] - peak
        # fixed rule: the cost of an insertion is added to what is lost, that of a deletion taken from it
        dropped = ~up & (cost.drop > 0) & (drift > 0) & ((lost - drift * cost.each_del > cost.drop) | (lost + drift * cost.each_ins > cost.drop))
        risen = live[up]
        found.score[risen], found.t_end[risen], found.q_end[risen] = peak[up], step, where[up]
        found.off[risen] = np.maximum(found.off[risen], np.abs(where[up] - step))

        empty = shifted <= 0
        before = empty & (at >= lo[:, None]) & (at <= where[:, None])
        after = empty & (at >= where[:, None] + 2) & (at <= hi[:, None])
        low[live] = np.where(before.any(axis=1), columns + 1 - before[:, ::-1].argmax(axis=1), lo)
        high[live] = np.where(after.any(axis=1), after.argmax(axis=1), hi + 1)
        live = live[(peak > 0) & ~dropped]
    found.q_end += 1
    found.t_end += 1
    found.whole_t_end += 1
    return found


def _widening(queries: list[list[int]], targets: list[list[int]], scores: np.ndarray, cost: Penalties, width: int, seed: np.ndarray, known: np.ndarray, tries: int) -> tuple[Extended, np.ndarray]:
    """Extensions, and the bands they took: a band is doubled while that changes the score and the path nears its edge."""
    bands = np.full(len(seed), width, dtype=np.int64)
    best, found = known.copy(), None
    left = np.arange(len(seed))
    for k in range(tries):
        if not len(left):
            break
        bands[left] = used = width << k
        got = extend_all([queries[i] for i in left], [targets[i] for i in left], scores, cost, bands[left], seed[left])
        if found is None:
            found = got
        else:
            for mine, new in zip(vars(found).values(), vars(got).values()):
                mine[left] = new
        more = (got.score != best[left]) & (got.off >= (used >> 1) + (used >> 2))
        best[left] = got.score
        left = left[more]
    return found, bands


def seed_extensions(left: tuple[list, list], right: tuple[list, list], q_beg: np.ndarray, h0: int, score: int, scores: np.ndarray, cost: Penalties = Penalties(), width: int = 8, tries: int = 2) -> dict[str, np.ndarray]:
    """Seeds extended to the left, then to the right: ``EXTENSION_FIELDS``; ``left`` and ``right`` are (queries, targets).

    Where the path to the query's end scores within the bonus of the best one,
    the seed reaches that end, and it counts for ``true_score``.
    """
    count = len(q_beg)
    whole = lambda v: np.full(count, v, dtype=np.int64)
    out = {"q_beg": whole(0), "r_beg": whole(0), "q_end": np.array([len(x) for x in right[0]], dtype=np.int64), "r_end": whole(0), "score": whole(-1), "true_score": whole(score)}
    widest, now = whole(width), whole(score)
    for side, (queries, targets) in enumerate((left, right)):
        on = np.array([i for i, x in enumerate(queries) if len(x)], dtype=np.int64)
        if not len(on):
            continue
        start = now[on] if side else whole(h0)[on]
        got, bands = _widening([queries[i] for i in on], [targets[i] for i in on], scores, cost, width, start, now[on], tries)
        reached = (got.whole_score > 0) & (got.whole_score > got.score - cost.bonus)
        t_end, trusted = np.where(reached, got.whole_t_end, got.t_end), np.where(reached, got.whole_score, got.score)
        if side:
            out["q_end"][on] = np.where(reached, [len(queries[i]) for i in on], got.q_end)
            out["r_end"][on] = t_end
            out["true_score"][on] += trusted - start
        else:
            out["q_beg"][on] = np.where(reached, 0, q_beg[on] - got.q_end)
            out["r_beg"][on] = -t_end
            out["true_score"][on] = trusted
        now[on] = out["score"][on] = got.score
        widest[on] = np.maximum(widest[on], bands)
    return out | {"width": widest}


def match_scores(match: int = 1, mismatch: int = -4) -> np.ndarray:
    """Scores of five symbols, the last of which is unknown and costs 1 against all."""
    out = np.where(np.eye(5, dtype=bool), match, mismatch).astype(np.int64)
    out[4, :] = out[:, 4] = -1
    return out


def extensions(df: DataFrame, id_: str) -> DataFrame:
    """``(id, EXTENSION_FIELDS)`` of rows with array<int> columns left_q, left_r, right_q, right_r, of symbols 0-4."""
    cols = [id_, "left_q", "left_r", "right_q", "right_r"]
    scores = match_scores()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lq, lr, rq, rr = (b.column(i).to_pylist() for i in range(1, 5))
            out = seed_extensions((lq, lr), (rq, rr), np.array([len(x) for x in lq], dtype=np.int64), h0=10, score=10, scores=scores)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(out[f], pa.int64()) for f in EXTENSION_FIELDS)], names=[id_, *EXTENSION_FIELDS])

    kind = df.schema[id_].dataType.simpleString()
    return df.select(*cols).mapInArrow(run, f"{id_} {kind}, " + ", ".join(f"{f} bigint" for f in EXTENSION_FIELDS))


@lru_cache(maxsize=1)
def sbox() -> np.ndarray:
    """The byte substitution: inverse in GF(2^8), then the affine map."""
    power, x = [], 1
    for _ in range(255):
        power.append(x)
        x ^= (x << 1) ^ (0x11B if x & 0x80 else 0)
        x &= 0xFF
    log = {v: i for i, v in enumerate(power)}
    out = []
    for v in range(256):
        inv = power[-log[v] % 255] if v else 0
        s = 0
        for turn in range(5):
            s ^= (inv << turn | inv >> (8 - turn)) & 0xFF
        out.append(s ^ 0x63)
    return np.array(out, dtype=np.int64)


#: Where each of 16 bytes comes from when rows are shifted.
_SHIFT = np.array([4 * ((c + r) % 4) + r for c in range(4) for r in range(4)])


def round_keys(key: list[int]) -> list[np.ndarray]:
    """First halves of the mixing key after each of 14 rounds and of the last one.

    The schedule does not depend on data. Only bytes 17-31 of the given key take
    part, and the substitution adds constants, as the kernel has it.
    """
    s = sbox()
    k = np.zeros(32, dtype=np.int64)
    k[17:] = key[17:32]
    rcon, out = 1, []
    for last in [False] * 14 + [True]:
        k[:4] ^= s[[29, 30, 31, 28]]
        k[0] ^= rcon
        rcon = (rcon << 1) ^ ((rcon >> 7 & 1) * 0x1B)
        for j in range(4, 16):
            k[j] ^= k[j - 4]
        k[16:20] ^= s[12:16]
        for j in range(20, 32):
            k[j] = (k[j - j % 4] if last and j % 4 else k[j]) ^ k[j - 4]
        out.append(k[:16].copy())
    return out


def mix_bytes(rows: np.ndarray, key: list[int]) -> np.ndarray:
    """Fourteen mixing rounds over rows of 16 bytes (0-255), all rows at once.

    Values are 32-bit ints that may outgrow a byte, and the first byte of a row
    is never substituted. It mixes like a block cipher and is none.
    """
    s, keys = sbox(), round_keys(key)
    x = rows.astype(np.int64).copy()
    if not len(x):
        return x
    x[:, 1:] ^= 1
    for k in keys[:14]:
        x[:, 1:] = s[x[:, 1:] & 0xFF]
        x = x[:, _SHIFT]
        for c in range(0, 16, 4):
            a, b, g, d = (x[:, c + i].copy() for i in range(4))
            e = a ^ b ^ g ^ d
            first = a ^ e ^ ((a ^ b) << 1)
            x[:, c] = first
            for i, pair in ((1, b ^ g), (2, g ^ d), (3, d ^ a)):
                x[:, c + i] = first ^ e ^ (pair << 1)
        x[:, 1:] ^= k[1:]
        x = x.astype(np.int32).astype(np.int64)
    x[:, 1:] = s[np.fmod(x[:, 1:], 0xFF)]
    x = x[:, _SHIFT]
    x[:, 1:] ^= keys[14][1:]
    return x


def mixed_bytes(df: DataFrame, id_: str, vec: str, key: list[int]) -> DataFrame:
    """``(id, out array<int>)`` of rows of 16 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column(1).to_pylist(), dtype=np.int64).reshape(-1, 16)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(mix_bytes(x, key)), pa.list_(pa.int64()))], names=[id_, "out"])

    kind = df.schema[id_].dataType.simpleString()
    return df.select(id_, vec).mapInArrow(run, f"{id_} {kind}, out array<bigint>")
