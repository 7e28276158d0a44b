"""SimHash near-duplicates found by a generalised pigeonhole search.

Fingerprints: the majority bits of the XXH64 (seed 42) of all word shingles. A longer fingerprint has further words of 64 bits
from mixed values of the same hashes. Search over the distinct fingerprints (after the GPH scheme of Qin et al., 2018):

* The bits of each word are grouped into partitions, correlated bits together, by the bit correlations over all fingerprints.
* With thresholds t_1..t_m whose sum is tau - m + 1, two fingerprints at distance <= tau agree up to
  t_i bits in some partition i. Each query gets thresholds of its own, from -1 (skip the
  partition), by dynamic programming on the estimated number of candidates and probes.
* A partition's leading bits name a cell. A query goes to the cells within its threshold; there it probes the
  values within what is left of it, and is verified by the full distance. There are as many cells as the number of fingerprints
  asks for, and a cell that still is too large for a task is dealt as pairs of blocks.

m is the number of partitions with the least estimated cost; every m finds every pair within tau. Of what a cell finds only a forest
leaves it, so copies and dense groups are never expanded into pairs. Connected components follow on these edges.

Defined cases: null or wordless text has fingerprint zero, linked like any other; fewer words
than a shingle are one shingle; repeated rows share a component; an empty table gives no rows.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, skewless_left_join, stored

SEED = 42
BITS = 64
TOP = 12  # leading bits of a partition whose value counts are gathered, at least
MOST_TOP = 16  # at most, which bounds what the driver holds
CELL = 1 << 16  # fingerprints of a cell aimed at
LEAST = 4  # leading bits that name a cell, at least
BLOCK = 1 << 18  # fingerprints of a cell beyond which it is dealt as pairs of blocks
CHUNK = 1 << 13  # shingles counted at a time
PROBE_COST = 4.0  # of a probe, against comparing a candidate
#: Odd factors of the words after the first.
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def fingerprint_of(hashes: np.ndarray, words: int = 1) -> np.ndarray:
    """The fingerprint as ``words`` words of 64 bits; the first is of the hashes themselves."""
    n, ones = len(hashes), np.zeros((words, BITS), np.int64)
    for k in range(0, n, CHUNK):
        part = hashes[k:k + CHUNK]
        for w in range(words):
            if w:
                x = (part ^ part >> np.uint64(32)) * _FACTORS[w - 1]
                x = (x ^ x >> np.uint64(29)) * _FACTORS[w - 1]
            else:
                x = part
            ones[w] += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones.ravel() > n, bitorder="little").view("<u8")


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """The hash of every word shingle of a text in turn; none of a text without words."""
    import xxhash

    w = (text or "").encode().lower().split()
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) >= words else [b" ".join(w)] if w else []
    return np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), shingles), np.uint64)


def text_fingerprint(text: str | None, words: int) -> int:
    return int(fingerprint_of(shingle_hashes(text, words))[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fp (64 bits as a long) of every row; one narrow pass over whole texts."""
    def run(batches):
        for b in batches:
            fp = np.array([text_fingerprint(t.as_py(), words) for t in b.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def bit_correlations(reps: DataFrame, words: int) -> list[np.ndarray]:
    """For each word the 64 x 64 correlations over all fingerprints, from tables of that size from each task."""
    def run(batches):
        both, n = np.zeros((words, BITS, BITS)), 0
        for b in batches:
            for w in range(words):
                bits = np.unpackbits(b.column(f"fp{w}").to_numpy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                for k in range(0, len(bits), 1 << 16):
                    both[w] += bits[k:k + (1 << 16)].T @ bits[k:k + (1 << 16)]
            n += len(b)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, both.size), pa.int64()), pa.array(np.append(n, both.ravel()).astype(np.int64))], ["at", "n"])

    got = {r["at"]: r["n"] for r in reps.select(*_words(words)).mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()}
    n = got.get(-1, 0)
    if not n:
        return [np.eye(BITS)] * words
    out = []
    for both in np.array([got[k] for k in range(words * BITS * BITS)], float).reshape(words, BITS, BITS) / n:
        mean = np.diag(both)
        sd = np.sqrt(np.maximum(mean * (1 - mean), 1e-9))
        out.append((both - np.outer(mean, mean)) / np.outer(sd, sd))
    return out


def _words(n: int) -> list[str]:
    return [f"fp{w}" for w in range(n)]


def group_bits(corr: np.ndarray, m: int) -> list[list[int]]:
    """m groups of nearly equal size; each takes, again and again, the free bit with the greatest mean |correlation| to it."""
    free, groups = set(range(BITS)), []
    strength = np.abs(corr)
    for g in range(m):
        size = BITS // m + (g < BITS % m)
        mine: list[int] = []
        while len(mine) < size:
            mean = {b: round(float(strength[b, mine or sorted(free - {b})].mean()) if len(free) > 1 or mine else 0.0, 6) for b in free}
            mine.append(min(free, key=lambda b: (-mean[b], b)))
            free.discard(mine[-1])
        groups.append(sorted(mine))
    return groups


def part_values(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fp), np.uint64)
    for k, b in enumerate(bits):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out


def within(width: int, e: int) -> np.ndarray:
    """All masks of at most e of width bits."""
    return np.array([sum(1 << b for b in c) for k in range(e + 1) for c in combinations(range(width), k)], np.uint64)


def estimate(value: np.ndarray, width: int, counts: np.ndarray, most: int) -> np.ndarray:
    """Estimated cost of thresholds -1..most for each query, one row per threshold.

    ``counts``: rows by the leading bits of the value, as many as its length has; the rest is taken as uniform.
    """
    top = len(counts).bit_length() - 1
    low = width - top
    lead = (value >> np.uint64(low)).astype(np.int64)
    near = np.zeros((most + 1, len(value)))  # rows whose lead differs in exactly k bits
    for k in range(min(most, top) + 1):
        for c in combinations(range(top), k) if k < 3 else ():
            near[k] += counts[lead ^ sum(1 << b for b in c)]
        if k >= 3:
            near[k] = comb(top, k) * counts.mean()
    cost = np.zeros((most + 2, len(value)))
    for e in range(most + 1):
        found = sum(near[k] * sum(comb(low, x) for x in range(e - k + 1)) for k in range(e + 1)) / 2.0 ** low
        cost[e + 1] = found + PROBE_COST * sum(comb(width, x) for x in range(e + 1))
    return cost


def allocate(costs: list[np.ndarray], total: int) -> tuple[np.ndarray, np.ndarray]:
    """Dynamic programming: thresholds (queries x m) of least summed cost whose sum is ``total``; and that cost."""
    n, m = costs[0].shape[1], len(costs)
    best = {0: np.zeros(n)}
    back: list[dict[int, np.ndarray]] = []
    for c in costs:
        new: dict[int, np.ndarray] = {}
        took: dict[int, np.ndarray] = {}
        for s, so_far in best.items():
            for e in range(-1, c.shape[0] - 1):
                cost = so_far + c[e + 1]
                if s + e not in new:
                    new[s + e], took[s + e] = cost, np.full(n, e)
                else:
                    better = cost < new[s + e]
                    new[s + e] = np.where(better, cost, new[s + e])
                    took[s + e] = np.where(better, e, took[s + e])
        best = new
        back.append(took)
    out, at = np.zeros((n, m), int), np.full(n, total)
    for i in range(m - 1, -1, -1):
        for s, e in back[i].items():
            here = at == s
            out[here, i] = e[here]
        at = at - out[:, i]
    return out, best[total]


class Plan:
    """Partitions (word, bits), counts by leading value, the sum of the thresholds and the leading bits that name a cell."""

    def __init__(self, parts: list[tuple[int, list[int]]], counts: list[np.ndarray], tau: int, n: int):
        self.parts, self.counts = parts, counts
        self.total = tau - len(parts) + 1
        self.most = max(0, min(self.total + len(parts) - 1, -(-self.total // len(parts)) + 1))
        top = max(LEAST, (max(1, n) - 1).bit_length() - (CELL.bit_length() - 1))
        self.top = [min(top, len(c).bit_length() - 1) for c in counts]

    def blocks(self) -> list[np.ndarray]:
        """For each partition and cell, in how many blocks its fingerprints are dealt."""
        return [-(-np.maximum(1, c.reshape(1 << t, -1).sum(axis=1)).astype(np.int64) // BLOCK) for c, t in zip(self.counts, self.top)]

    def thresholds(self, values: list[np.ndarray]) -> np.ndarray:
        costs = [estimate(v, len(bits), c, self.most) for v, (_, bits), c in zip(values, self.parts, self.counts)]
        return allocate(costs, self.total)[0]

    def values(self, fps: np.ndarray) -> list[np.ndarray]:
        return [part_values(fps[:, w], bits) for w, bits in self.parts]


def plan(reps: DataFrame, tau: int, words: int = 1) -> Plan:
    """Of equally many partitions a word, the number of least estimated cost. reps: a stored table of fp0, fp1, ..."""
    n = reps.count()
    lead = max(TOP, min(MOST_TOP, (max(1, n) - 1).bit_length() - (CELL.bit_length() - 1)))
    corr = bit_correlations(reps, words)
    choices = [[(w, bits) for w in range(words) for bits in group_bits(corr[w], m)] for m in (range(2, min(5, tau // words + 1) + 1) if tau else [1]) if words * m <= tau + 1]

    flat = [(c, g, w, bits) for c, parts in enumerate(choices) for g, (w, bits) in enumerate(parts)]

    def lead_counts(batches):
        held = [np.zeros(1 << min(lead, len(bits)), np.int64) for *_, bits in flat]
        for b in batches:
            fps = [b.column(c).to_numpy().view(np.uint64) for c in _words(words)]
            for k, (_, _, w, bits) in enumerate(flat):
                held[k] += np.bincount(part_values(fps[w], bits[max(0, len(bits) - lead):]).astype(np.int64), minlength=len(held[k]))
        for k, n_at in enumerate(held):
            at = np.flatnonzero(n_at)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(at), pa.array(n_at[at])], ["k", "v", "n"])

    counts = {(c, g): np.zeros(1 << min(lead, len(bits))) for c, g, _, bits in flat}
    rows = reps.select(*_words(words)).mapInArrow(lead_counts, "k long, v long, n long")
    for r in rows.groupBy("k", "v").agg(F.sum("n").alias("n")).collect():  # at most 2^MOST_TOP for each partition
        counts[flat[r["k"]][:2]][r["v"]] = r["n"]
    plans, cost = [], []
    for c, parts in enumerate(choices):  # at the value counts themselves, as queries drawn from them
        p = Plan(parts, [counts[c, g] for g in range(len(parts))], tau, n)
        high = p.total % len(parts)  # so many partitions have a threshold one higher
        total = 0.0
        for g, ((_, bits), k) in enumerate(zip(parts, p.counts)):
            e, w = p.total // len(parts) + (g < high), len(bits)
            est = estimate(np.arange(len(k), dtype=np.uint64) << np.uint64(w - len(k).bit_length() + 1), w, k, max(0, e))
            total += float((est[e + 1] * k).sum() / max(1, n))
        plans.append(p)
        cost.append(total)
    return plans[int(np.argmin(cost))]


def _dealt(reps: DataFrame, p: Plan, words: int) -> DataFrame:
    """part, cell, i, j (blocks), known, radius and the row of each fingerprint at home and wherever it probes."""
    blocks = p.blocks()
    names = ["node", *_words(words)]

    def run(batches):
        for batch in batches:
            for start in range(0, len(batch), 4096):
                b = batch.slice(start, 4096)
                fps = np.stack([b.column(c).to_numpy() for c in names[1:]], axis=1).view(np.uint64)
                values = p.values(fps)
                t = p.thresholds(values)
                spread = (fps[:, 0] * _FACTORS[0] >> np.uint64(33)).astype(np.int64)
                for g, ((_, bits), top) in enumerate(zip(p.parts, p.top)):
                    lead = (values[g] >> np.uint64(len(bits) - top)).astype(np.int64)
                    rows, cells, known, radius = [np.arange(len(fps))], [lead], [np.ones(len(fps), bool)], [t[:, g]]
                    for e in range(1, p.most + 1):
                        mine = np.flatnonzero(t[:, g] == e)
                        for j in range(1, min(e, top) + 1) if len(mine) else ():
                            masks = np.array([sum(1 << x for x in c) for c in combinations(range(top), j)], np.int64)
                            rows.append(np.repeat(mine, len(masks)))
                            cells.append((lead[mine][:, None] ^ masks).ravel())
                            known.append(np.zeros(len(rows[-1]), bool))
                            radius.append(np.full(len(rows[-1]), e - j))
                    rows, cells, known, radius = map(np.concatenate, (rows, cells, known, radius))
                    n = blocks[g][cells]
                    for k in range(2) if n.max(initial=1) > 1 else (2,):  # as known in (own, each), as query in (each, own)
                        takes = (n > 1) & (known if k == 0 else radius >= 0) if k < 2 else np.ones(len(n), bool)
                        each = np.repeat(np.flatnonzero(takes), n[takes])
                        other = np.arange(len(each)) - np.repeat(np.cumsum(n[takes]) - n[takes], n[takes])
                        own = spread[rows[each]] % n[each]
                        i, j = (own, other) if k == 0 else (other, own)
                        kn, ra = (known[each], np.full(len(each), -1)) if k == 0 else (np.zeros(len(each), bool), radius[each]) if k == 1 else (known[each], radius[each])
                        yield from _batch(b, names, rows[each], g, cells[each], i, j, kn, ra)
                    if n.max(initial=1) > 1 and (n == 1).any():
                        one = np.flatnonzero(n == 1)
                        yield from _batch(b, names, rows[one], g, cells[one], 0 * one, 0 * one, known[one], radius[one])

    fields = ", ".join(f"{c} long" for c in names)
    return reps.select(*names).mapInArrow(run, f"part int, cell int, i int, j int, known boolean, radius int, {fields}")


def _batch(b: pa.RecordBatch, names: list[str], rows: np.ndarray, g: int, cell, i, j, known, radius):
    if len(rows):
        small = [pa.array(x.astype(np.int32)) for x in (np.full(len(rows), g), cell, i, j)]
        yield pa.RecordBatch.from_arrays([*small, pa.array(known), pa.array(radius.astype(np.int32)), *(b.column(c).take(pa.array(rows)) for c in names)],
                                         ["part", "cell", "i", "j", "known", "radius", *names])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star to the least node for each component of the edges: as many edges as it has further nodes."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[:len(a)], at[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    more = label != np.arange(len(nodes))
    return nodes[more], nodes[label[more]]


def _near(x: np.ndarray, y: np.ndarray, first: int, limit: int) -> np.ndarray:
    """Which rows of x and y are at most ``limit`` bits apart; word ``first`` alone rules most pairs out."""
    d = np.bitwise_count(x[:, first] ^ y[:, first]).astype(np.int64)
    near = d <= limit
    if x.shape[1] > 1:
        # Of a pair that is kept, the word it met in is hardly over half the limit apart; the exact sum decides.
        at = np.flatnonzero(near)
        near[at] = np.bitwise_count(x[at] ^ y[at]).sum(axis=1, dtype=np.int64) <= limit
    return near


def _bucket(known: np.ndarray, query: np.ndarray, near) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges that connect all near pairs of known x query. ``near(a, b)`` compares rows one to one.

    What is near a pivot is connected by it, so a dense bucket costs about one comparison a row.
    """
    edges, todo = [], [(known, query)]
    while todo:
        known, query = todo.pop()
        if len(known) * len(query) <= 4096:
            a, b = np.repeat(known, len(query)), np.tile(query, len(known))
            hit = near(a, b)
            edges.append((a[hit], b[hit]))
            continue
        pivot = known[:1]
        close, reached = near(np.repeat(pivot, len(known)), known), near(np.repeat(pivot, len(query)), query)
        close[0] = True
        edges.append((np.repeat(pivot, close.sum()), known[close]))
        edges.append((np.repeat(pivot, reached.sum()), query[reached]))
        todo += [(known[~close], query), (known[close][1:], query[~reached])]
    return edges


def search(reps: DataFrame, tau: int, words: int = 1, limit: int | None = None, pairs: bool = False) -> DataFrame:
    """Edges (a, b), a > b, of nodes. reps: a stored table of node, fp0, fp1, ... with distinct nodes.

    The edges connect what links of at most ``limit`` bits (tau if not given) connect, of the pairs that the search meets; it meets
    all within ``tau``. With pairs, all of these links themselves.
    """
    p = plan(reps, tau, words)
    limit = tau if limit is None else limit

    def run(table: pa.Table) -> pa.Table:
        g = table.column("part")[0].as_py()
        word, bits = p.parts[g]
        low = len(bits) - p.top[g]
        fps = np.stack([table.column(c).to_numpy() for c in _words(words)], axis=1).view(np.uint64)
        node, known, radius = (table.column(c).to_numpy() for c in ("node", "known", "radius"))
        value = part_values(fps[:, word], bits) & np.uint64((1 << low) - 1)
        own = np.flatnonzero(known)
        own = own[np.argsort(value[own], kind="stable")]
        at = value[own]
        a = b = np.zeros(0, np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            return _near(fps[x], fps[y], word, limit) & (node[x] != node[y])

        def fold() -> None:
            nonlocal a, b, found
            a, b = np.concatenate([a, *(node[x] for x, _ in found)]), np.concatenate([b, *(node[y] for _, y in found)])
            if pairs:
                a, b = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)]), axis=1)
            else:
                a, b = forest(a, b) if len(a) else (a, b)
            found = []

        for r in np.unique(radius[radius >= 0]).tolist():
            query = np.flatnonzero(radius == r)
            for mask in within(low, r):
                wanted = value[query] ^ mask
                order = np.argsort(wanted, kind="stable")
                wanted, who = wanted[order], query[order]
                first, last = np.searchsorted(at, wanted, "left"), np.searchsorted(at, wanted, "right")
                # Runs of queries with one value meet one run of known rows.
                cut = np.flatnonzero(np.concatenate([[True], wanted[1:] != wanted[:-1], [True]]))
                size = (last - first)[cut[:-1]] * np.diff(cut)
                if not pairs:
                    for k in np.flatnonzero(size > 4096).tolist():
                        found += _bucket(own[first[cut[k]]:last[cut[k]]], who[cut[k]:cut[k + 1]], near)
                    last = np.where(np.repeat(size > 4096, np.diff(cut)), first, last)
                ends = np.cumsum(last - first)
                done = 0
                while done < len(who):  # blocks of at most about 2^20 pairs, or of one query
                    before = ends[done - 1] if done else 0
                    upto = max(done + 1, int(np.searchsorted(ends, before + (1 << 20), "right")))
                    n = (last - first)[done:upto]
                    left = np.repeat(who[done:upto], n)
                    right = own[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[done:upto], n)]
                    hit = near(left, right)
                    found.append((left[hit], right[hit]))
                    if sum(len(x) for x, _ in found) > 1 << 20:
                        fold()
                    done = upto
                if sum(len(x) for x, _ in found) > 1 << 20:
                    fold()
        fold()
        return pa.table({"a": np.maximum(a, b), "b": np.minimum(a, b)})

    return _dealt(reps, p, words).groupBy("part", "cell", "i", "j").applyInArrow(run, "a long, b long").filter("a <> b").distinct()


def near_duplicates(docs: DataFrame, words: int = 3, tau: int = 3) -> DataFrame:
    """doc_id, fp, component_id, component_size (rows) of every row; component_id: the smallest doc_id reachable over links."""
    own = stored(fingerprints(docs, words), "simhash-docs")
    reps = stored(own.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "simhash-reps")
    member = components(stored(search(reps.select(F.col("fp").alias("node"), F.col("fp").alias("fp0")), tau), "simhash-links"))
    full = reps.join(member, F.col("fp") == F.col("node"), "left")
    full = stored(full.select("fp", "n", "least", F.coalesce("root", "fp").alias("root")), "simhash-members")
    head = stored(full.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("component_size"), F.count(F.lit(1)).alias("__n")), "simhash-heads")
    n_reps, n_docs = full.agg(F.count(F.lit(1)), F.sum("n")).first()
    full = skewless_left_join(full, head, ["root"], "__n", n_reps)
    full = stored(full.select("fp", "component_id", "component_size", "n"), "simhash-classes")
    return skewless_left_join(own, full, ["fp"], "n", n_docs or 0)
