"""The deduplication stage of the pipeline: SimHash near-duplicates, verified by the Jaccard similarity of five-word shingles.

* Candidates come from the pigeonhole search of ``simhash`` over fingerprints of WORDS words of 64 bits. Two texts of similarity s differ in each bit with
  a chance of acos(2 s / (1 + s)) / pi, 0.15 at 0.8; the search meets all pairs within TAU bits and most of those beyond, and keeps
  what it meets up to LIMIT bits. With 16 partitions of 16 bits and thresholds of 1 a pair of similarity 0.8 is
  missed with a chance of (1 - 0.28) ** 16 = 0.005, of 0.85 with 0.0003, less above.
* Every link is verified: the candidates of one component come together with their whole shingle sets, and two are
  linked only if their exact similarity is SIMILARITY or more. In a task a search from text to text leaves out what is linked
  already, so a dense group costs one comparison a text. Components of more than BLOCK shingles are dealt as pairs of blocks.
* Groups are the connected components of the verified links.

Defined cases: shingles are compared as 64-bit hashes; fewer words than a shingle are one shingle; texts without words are
alike; equal sets are one node, so copies are never expanded into pairs; repeated rows share a group; rows without a doc_id
stay and link nothing; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, released, skewless_left_join, stored
from .simhash import SEED, fingerprint_of, search, shingle_hashes

SIMILARITY = (4, 5)  # as a fraction, so that the comparison is exact
WORDS, TAU, LIMIT = 4, 31, 64
BLOCK = 1 << 16  # shingles of a block: two of them meet in a task
CELLS = 64


def shingle_set(text: str | None, words: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, words))


def node_of(own: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), SEED)).view(np.int64))


def tree(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Edges with the same components as all pairs of sets of similarity SIMILARITY or more."""
    p, q = SIMILARITY
    size = np.array([len(s) for s in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    first = np.cumsum(size) - size
    mark = np.zeros(codes.max(initial=-1) + 1, bool)
    left = np.flatnonzero(size)
    flat = codes
    edges: list[tuple[int, int]] = []
    queue: list[int] = []
    while len(left):
        if not queue:
            queue.append(int(left[0]))
            flat, left = flat[size[left[0]]:], left[1:]
            continue
        x = queue.pop()
        own = codes[first[x]:first[x] + size[x]]
        mark[own] = True
        shared = np.add.reduceat(mark[flat], np.cumsum(size[left]) - size[left], dtype=np.int64)
        mark[own] = False
        hit = shared * (p + q) >= p * (size[x] + size[left])
        if hit.any():
            found = left[hit].tolist()
            edges += [(x, y) for y in found]
            queue += found
            flat, left = flat[np.repeat(~hit, size[left])], left[~hit]
    return edges


def _verified(docs: DataFrame, placed: DataFrame, words: int, cells: int) -> DataFrame:
    """Edges (a, b) of nodes. placed: node, root, least (a doc_id with this set), blocks, block."""
    def spread(batches):
        for batch in released(batches):
            for r in batch.to_pylist():
                own = shingle_set(r["text"], words)
                if node_of(own) != r["node"]:  # another text with the same doc_id
                    continue
                mine, n = r["block"], r["blocks"]
                pairs = [(0, 0)] if n == 1 else [(min(mine, k), max(mine, k)) for k in range(n) if k != mine]
                for lo, hi in pairs:
                    yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((r["root"], lo, hi, r["node"], own.tobytes()), (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()))],
                                                     ["root", "lo", "hi", "node", "own"])

    def link(table: pa.Table) -> pa.Table:
        table = table.sort_by([("root", "ascending"), ("lo", "ascending"), ("hi", "ascending")])
        root, lo, hi, node = (table.column(c).to_numpy() for c in ("root", "lo", "hi", "node"))
        own = table.column("own")
        cut = np.flatnonzero(np.concatenate([[True], (np.diff(root) != 0) | (np.diff(lo) != 0) | (np.diff(hi) != 0), [True]]))
        a, b = [], []
        for i, j in zip(cut[:-1].tolist(), cut[1:].tolist()):
            for x, y in tree([np.frombuffer(s.as_py(), np.uint64) for s in own[i:j]]):
                a.append(node[i + x])
                b.append(node[i + y])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    wanted = texts.join(placed, texts["doc_id"] == placed["least"]).select("text", "node", "root", "blocks", "block")
    sets = wanted.mapInArrow(spread, "root long, lo int, hi int, node long, own binary")
    cell = F.pmod(F.xxhash64("root", "lo", "hi"), F.lit(cells)).alias("cell")
    return sets.groupBy(cell).applyInArrow(link, "a long, b long").filter("a <> b").distinct()


def near_groups(docs: DataFrame, words: int = 5) -> DataFrame:
    """doc_id, group_id of every row with a doc_id that is not alone in its group; group_id: the least doc_id of the group."""
    fps = [f"fp{w}" for w in range(WORDS)]

    def one(text: str | None) -> tuple:
        hashes = shingle_hashes(text, words)
        own = np.unique(hashes)
        return node_of(own), len(own), *fingerprint_of(hashes, WORDS).view(np.int64).tolist()

    def run(batches):
        for whole in released(batches):
            for start in range(0, len(whole), 1024):
                b = whole.slice(start, 1024)
                found = np.array([one(t.as_py()) for t in b.column("text")], np.int64).reshape(-1, 2 + WORDS)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c) for c in found.T.copy())], ["doc_id", "node", "size", *fps])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    own = stored(texts.mapInArrow(run, "doc_id long, node long, size long, " + ", ".join(f"{f} long" for f in fps)), "near-docs")
    # Texts of one set may differ in repeated shingles: the fingerprint of the least doc_id stands for all.
    one = F.min(F.struct("doc_id", "size", *fps)).alias("one")
    reps = stored(own.groupBy("node").agg(one, F.count(F.lit(1)).alias("n")).select("node", F.col("one.doc_id").alias("least"), "one.size", *[f"one.{f}" for f in fps], "n"), "near-reps")
    candidates = components(stored(search(reps.select("node", *fps), TAU, WORDS, LIMIT), "near-candidates"))
    member = stored(candidates.join(reps.select("node", "least", "size"), "node"), "near-members")
    whole = stored(member.groupBy("root").agg(F.ceil(F.sum("size") / BLOCK).cast("int").alias("blocks"), F.count(F.lit(1)).alias("__n")), "near-roots")
    n_members, work = whole.agg(F.coalesce(F.sum("__n"), F.lit(0)), F.coalesce(F.sum(F.col("blocks").cast("long") * F.col("blocks")), F.lit(0))).first()
    placed = skewless_left_join(member, whole, ["root"], "__n", n_members)
    placed = stored(placed.select("node", "root", "least", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")), "near-placed")
    linked = stored(components(stored(_verified(docs, placed, words, max(CELLS, work)), "near-links")).join(reps.select("node", "least"), "node"), "near-linked")
    head = stored(linked.groupBy("root").agg(F.min("least").alias("group_id"), F.count(F.lit(1)).alias("__n")), "near-heads")
    led = skewless_left_join(linked, head, ["root"], "__n", linked.count()).select("node", "group_id")
    full = reps.join(led, "node", "left").filter("n > 1 or group_id is not null")
    full = stored(full.select("node", F.coalesce("group_id", "least").alias("group_id"), "n"), "near-groups")
    return skewless_left_join(own.select("doc_id", "node"), full, ["node"], "n", own.count()).filter("group_id is not null").select("doc_id", "group_id")


def drop_near_duplicates(docs: DataFrame, words: int = 5) -> DataFrame:
    """The rows of ``docs`` whose doc_id leads its group, with all their columns."""
    dropped = near_groups(docs, words).filter("doc_id <> group_id").select(F.col("doc_id").alias("__gone")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("__id"))
    # Stored, its size is known: where it is small the rows stay in place.
    return rows.join(stored(dropped, "near-gone"), F.col("__id") == F.col("__gone"), "left_anti").select("row.*")
