"""Skip-gram with negative sampling by tasks that hold the vectors of their own walks; the driver sees none of them.

Walks are written once by the hash of their first node, a part per task. A task makes a pass over its walks in numpy; what the passes
made of a node is averaged, weighted by its visits, and read by all tasks for their next pass. Vectors are written as two-byte numbers, by a task
those of the nodes it visits. Walks are put in the order of a hash, so results do not depend on how they come.

The windows of a chunk of successive nodes are one small matrix product: its nodes times the nodes around them and times noise that the
chunk shares. Products of many chunks are made at once; what they add to a vector is summed and, where much comes together, damped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.session import cut, discard, scratch

CHUNK = 24  # nodes whose windows are one product
NOISE = 24  # nodes of noise that a chunk shares
NEGATIVES = 5  # the weight of noise per pair
BATCH = 2400  # nodes looked at before vectors change
RATE, LAST = 0.025, 0.0001  # the step at the start, and the share of it at the end
DAMP = 0.5  # of a step times the weight of a vector's pairs, beyond 1 in all
BUCKET = 4_000_000  # numbers of the vectors that are averaged at once
ROWS = 5_000  # of a batch


def start(names: list[str], size: int, seed: int) -> np.ndarray:
    """The first vector of each node, from a hash of its name."""
    with np.errstate(over="ignore"):
        z = np.array([int.from_bytes(md5(f"{seed}|{x}".encode(), usedforsecurity=False).digest()[:8], "big") for x in names], np.uint64)[:, None]
        out = np.empty((len(names), size), np.float32)
        for k in range(size):  # splitmix64
            u = z[:, 0] + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
            u = (u ^ (u >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            u = (u ^ (u >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            out[:, k] = (((u ^ (u >> np.uint64(31))) >> np.uint64(40)).astype(np.float32) / np.float32(1 << 24) - np.float32(0.5)) / np.float32(size)
    return out


def _add(table: np.ndarray, ids: np.ndarray, change: np.ndarray, weight: np.ndarray, rate: float) -> None:
    """Add the changes of each id, damped where their weight is large."""
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    times = np.diff(np.r_[first, len(ids)])
    step = rate / np.maximum(1.0, np.add.reduceat(weight[order], first) * (rate * DAMP))
    total = change[order[first]]
    for k in range(1, int(times.max())):  # reduceat over rows is many times slower
        more = np.flatnonzero(times > k)
        if len(more) < 32:
            for i in more:
                total[i] += change[order[first[i] + k : first[i] + times[i]]].sum(0)
            break
        total[more] += change[order[first[more] + k]]
    total *= step.astype(np.float32)[:, None]
    table[ids[first]] += total


def fit(inner: np.ndarray, outer: np.ndarray, codes: np.ndarray, ends: np.ndarray, window: int, rng: np.random.Generator, done: float, share: float) -> None:
    """Change the vectors of the nodes (``inner``) and of what is around them (``outer``) by one pass over all walks.

    Walk i is codes[ends[i]:ends[i + 1]]. ``done``: the share of the whole fit before this pass, which is ``share`` of it.
    """
    n = len(inner)
    noise = np.cumsum(np.bincount(codes, minlength=n) ** 0.75)
    noise /= noise[-1]
    order = rng.permutation(len(ends) - 1)
    length = np.diff(ends)[order]
    at = np.cumsum(length)
    m = max(1, min(BATCH, n // 2) // CHUNK)
    per, width = m * CHUNK, CHUNK + 2 * window
    gap = np.abs(np.arange(width)[None, :] - window - np.arange(CHUNK)[:, None])
    gap = np.where(gap == 0, window + 1, gap).astype(np.int8)
    total = int(at[-1])
    for a in range(0, total, per):
        lo, hi = max(0, a - window), min(total, a + per + window)
        w0, w1 = np.searchsorted(at, lo, "right"), np.searchsorted(at, hi, "left") + 1
        walk = np.repeat(np.arange(w0, w1), length[w0:w1])
        base = at[w0] - length[w0]
        place = np.arange(len(walk)) + np.repeat(ends[order[w0:w1]] - (at[w0:w1] - length[w0:w1] - base), length[w0:w1])
        ids, of = np.zeros(per + 2 * window, np.int64), np.full(per + 2 * window, -1)
        s = slice(lo - (a - window), hi - (a - window))
        ids[s], of[s] = codes[place[lo - base : hi - base]], walk[lo - base : hi - base]
        rate = RATE * max(LAST, 1 - done - share * a / total)
        mid, own = ids[window:-window], of[window:-window].reshape(m, CHUNK)
        around = np.lib.stride_tricks.sliding_window_view(of, width)[::CHUNK]
        pair = (gap[None] <= rng.integers(1, window + 1, (m, CHUNK, 1), np.int8)) & (own[:, :, None] == around[:, None, :]) & (own >= 0)[:, :, None]
        many = pair.sum(2)
        x = inner[mid].reshape(m, CHUNK, -1)
        size = x.shape[2]
        c = outer[ids]
        view = np.lib.stride_tricks.as_strided(c, (m, width, size), (CHUNK * size * 4, size * 4, 4))
        other = np.searchsorted(noise, rng.random(m * NOISE))
        z = outer[other].reshape(m, NOISE, size)
        near = pair * _miss(x @ view.transpose(0, 2, 1))
        share_of = (many * (NEGATIVES / NOISE)).astype(np.float32)[:, :, None]
        far = share_of * (_miss(x @ z.transpose(0, 2, 1)) - np.float32(1))
        dx = near @ view + far @ z
        dz = (far.transpose(0, 2, 1) @ x).reshape(-1, size)
        back = near.transpose(0, 2, 1) @ x
        dc = np.zeros_like(c)
        dc[:per].reshape(m, CHUNK, size)[:] = back[:, :CHUNK]
        for k in range(width - CHUNK):
            dc[CHUNK + k :: CHUNK][:m] += back[:, CHUNK + k]
        _add(inner, mid, dx.reshape(-1, size), many.ravel() * (1.0 + NEGATIVES), rate)
        got = np.zeros(len(ids))
        np.add.at(got, (np.arange(m)[:, None] * CHUNK + np.arange(width)).ravel(), pair.sum(1).ravel().astype(np.float64))
        _add(outer, np.r_[ids, other], np.concatenate([dc, dz]), np.r_[got, np.repeat(share_of.sum((1, 2)), NOISE)], rate)


def _miss(score: np.ndarray) -> np.ndarray:
    """One minus the chance of a pair."""
    np.clip(score, -30, 30, out=score)
    np.exp(score, out=score)
    score += 1
    return np.reciprocal(score, out=score)


class Walks:
    """Walks and vectors as they come, then numbered: walk i is codes[ends[i]:ends[i + 1]], names are in order."""

    def __init__(self, batches: Iterator[pa.RecordBatch], size: int) -> None:
        number: dict[str, int] = {}
        codes, lengths, hashes, self.came, self.home = [], [], [], [], 0
        for b in batches:
            if not len(b):
                continue
            self.home = pc.max(b.column("home")).as_py() or self.home
            walk = b.column("walk")
            known = walk.is_valid().to_numpy(zero_copy_only=False)
            if known.any():
                coded = walk.flatten().dictionary_encode()
                of = np.array([number.setdefault(x, len(number)) for x in coded.dictionary.to_pylist()], np.int32)
                codes.append(of[coded.indices.to_numpy()])
                lengths.append(pc.list_value_length(walk).drop_null().to_numpy())
                hashes.append(b.column("h").to_numpy(zero_copy_only=False)[known].astype(np.int64))
            if not known.all():
                node = b.column("node").filter(pa.array(~known))
                both = [_numbers(b.column(c).filter(pa.array(~known)), size) for c in ("inner", "outer")]
                self.came.append((node, *both))
        self.names = sorted(number)
        rank = np.empty(len(number), np.int32)
        rank[[number[x] for x in self.names]] = np.arange(len(number), dtype=np.int32)
        raw = np.concatenate(codes) if codes else np.zeros(0, np.int32)
        codes.clear()
        length = np.concatenate(lengths) if lengths else np.zeros(0, np.int32)
        order = np.argsort(np.concatenate(hashes), kind="stable") if hashes else np.zeros(0, np.int64)
        at = np.cumsum(length, dtype=np.int64) - length
        self.ends = np.r_[0, np.cumsum(length[order], dtype=np.int64)]
        self.codes = rank[raw[np.repeat(at[order] - self.ends[:-1], length[order]) + np.arange(self.ends[-1])]]

    def vectors(self, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
        if not self.came:
            return start(self.names, size, seed), np.zeros((len(self.names), size), np.float32)
        inner, outer = (np.zeros((len(self.names), size), np.float32) for _ in range(2))
        names = pa.array(self.names, pa.string())
        for node, a, b in self.came:
            at = pc.index_in(node, names).fill_null(-1).to_numpy()
            mine = at >= 0
            inner[at[mine]], outer[at[mine]] = a[mine], b[mine]
        self.came.clear()
        return inner, outer


def _numbers(column: pa.Array, size: int) -> np.ndarray:
    """The vectors of a column of two-byte numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float16).reshape(len(column), size)


def _bytes(table: np.ndarray) -> pa.Array:
    half = table.astype(np.float16)
    at = np.arange(0, (len(half) + 1) * half.shape[1] * 2, half.shape[1] * 2, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(half), [None, pa.py_buffer(at), pa.py_buffer(half)])


def _lists(table: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, table.size + 1, table.shape[1], dtype=np.int32)), pa.array(table.ravel()))


def train(walks: DataFrame, size: int, window: int, iterations: int, tasks: int, seed: int, numbers: int) -> DataFrame:
    """(node, emb ARRAY<FLOAT>) from (walk), by ``tasks`` side by side; all vectors together have about ``numbers`` numbers."""
    w = walks.where("size(walk) > 0").select("walk", F.xxhash64("walk").alias("h"), F.pmod(F.xxhash64(F.col("walk")[0]), F.lit(tasks)).cast("int").alias("home"))
    by_home = _arranged(w, "home")
    alone = tasks == 1
    buckets = max(tasks, -(-numbers // BUCKET))

    def passes(first: int, last: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = Walks(batches, size)
            if not held.names:
                return
            inner, outer = held.vectors(size, seed)
            mine = int.from_bytes(md5(held.names[0].encode(), usedforsecurity=False).digest()[:4], "big")
            for k in range(first, last):
                if held.ends[-1]:
                    fit(inner, outer, held.codes, held.ends, window, np.random.default_rng([seed, k, mine]), k / iterations, 1 / iterations)
            visits = np.bincount(held.codes, minlength=len(inner))
            for a in range(0, len(inner), ROWS):
                s = slice(a, a + ROWS)
                names = pa.array(held.names[s], pa.string())
                if alone:
                    yield pa.RecordBatch.from_arrays([names, _lists(inner[s])], ["node", "emb"])
                else:
                    yield pa.RecordBatch.from_arrays([names, pa.array(np.full(len(names), held.home, np.int32)), pa.array(visits[s]), _bytes(inner[s]), _bytes(outer[s])], ["node", "home", "visits", "inner", "outer"])

        return run

    state: DataFrame | None = None
    try:
        if alone:
            return cut(_inputs(by_home, None, 1).mapInArrow(passes(0, iterations), "node string, emb array<float>"))
        for k in range(iterations):
            made = _inputs(by_home, state, tasks).mapInArrow(passes(k, k + 1), "node string, home int, visits bigint, inner binary, outer binary")
            met = _arranged(made.withColumn("bucket", F.pmod(F.xxhash64("node"), F.lit(buckets)).cast("int")), "bucket")
            discard(state)
            last = k + 1 == iterations
            each = _a_task_each(lambda b, met=met: met.where(F.col("bucket") == b).drop("bucket"), buckets)
            state = cut(each.mapInArrow(_average(size, last), "node string, emb array<float>" if last else "node string, inner binary, outer binary"))
            discard(met)
        return state
    finally:
        discard(by_home)


def _average(size: int, last: bool):
    """The mean of each node's vectors, weighted by visits; of the vectors that are the result at ``last``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if len(b)]
        if not got:
            return
        t = pa.Table.from_batches(got).sort_by([("node", "ascending"), ("home", "ascending")])
        coded = t.column("node").combine_chunks().dictionary_encode()
        of, n = coded.indices.to_numpy(), len(coded.dictionary)
        w = t.column("visits").to_numpy().astype(np.float64)
        w = (w / np.bincount(of, w, n)[of]).astype(np.float32)
        first = np.searchsorted(of, np.arange(n))
        place = np.arange(len(of)) - first[of]
        mean = []
        for c in ("inner", "outer")[: 1 if last else 2]:
            v = _numbers(t.column(c), size)
            m = np.zeros((n, size), np.float32)
            for k in range(int(place.max()) + 1):
                at = np.flatnonzero(place == k)
                m[of[at]] += v[at] * w[at][:, None]
            mean.append(m)
        for a in range(0, n, ROWS):
            of_mean = [_lists(mean[0][a : a + ROWS])] if last else [_bytes(m[a : a + ROWS]) for m in mean]
            yield pa.RecordBatch.from_arrays([coded.dictionary[a : a + ROWS], *of_mean], ["node", "emb"] if last else ["node", "inner", "outer"])

    return run


def _arranged(df: DataFrame, key: str) -> DataFrame:
    """``df`` written with a folder per ``key``, so that a task can read the rows of one."""
    path = scratch(df.sparkSession)
    df.write.partitionBy(key).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def _inputs(walks: DataFrame, state: DataFrame | None, tasks: int) -> DataFrame:
    """A partition per task: its walks, and its vectors from the second pass on."""
    no = lambda *types: [F.lit(None).cast(t).alias(c) for c, t in types]
    w = walks.select("home", "walk", "h", *no(("node", "string"), ("inner", "binary"), ("outer", "binary")))
    s = None if state is None else state.select(*no(("home", "int"), ("walk", "array<string>"), ("h", "bigint")), "node", "inner", "outer")
    part = lambda i: w.where(F.col("home") == i)
    return _a_task_each(lambda i: part(i) if s is None or i < 0 else part(i).unionByName(s), tasks)


def _a_task_each(part: Callable[[int], DataFrame], n: int) -> DataFrame:
    """Parts 0 to n - 1, a task for each. Part -1 has no rows: it keeps Spark from putting parts of one task each into one."""
    out = part(-1)
    for i in range(n):
        out = out.unionByName(part(i).coalesce(1))
    return out
