"""Interpolated modified Kneser-Ney language model of word trigrams (or bigrams), counted in Spark.

The model lives in the shared folder as sorted arrays that scoring workers map into memory:

* ``vocab``: sorted 64-bit hashes of the training words with their counts; a word's id is its place in this order.
* ``triples``: sorted 64-bit hashes of three ids with their counts (a byte each; of counts from 255 on the rest is in a table of its own), in
  shards by the middle word. ``histories``: for each pair of ids that begins more than one triple its total and how many words follow it
  once, twice, more often; a pair that is known and not among these begins one.
* ``pairs``: sorted keys (id of the word before << 32 | id of the word) with their counts, in shards by context; with triples
  above them the number of different words before the pair, and after the start mark the count itself.
  Contexts with many tokens have several shards of their own, of pairs by the following word, of triples by the first.
* ``contexts``: for each context of pairs the same as for histories.
* ``fresh``: for each word the number of different words before it.

Map tasks sort and count what they read and send each shard one compact blob; what is sent grows with the text. Pairs are counted from
the triples of their shard, without another pass. The
driver holds only counts of counts, shard sizes and the contexts that hold over 1/256 of all tokens.
P(w | tu) = max(c(tuw) - D(c), 0) / c(tu) + g(tu) P(w | u), likewise P(w | u) over the pairs, and P(w) is the same over ``fresh`` with the uniform 1 / (V + 1)
below it (Chen and Goodman, 1998). A text begins after two start marks and ends in an end token.

Defined cases: null text is empty text, the end token alone; unknown words have the uniform part of P(w); after
unknown words the shorter history is used; with no training text every token has probability 1; repeated rows count each time.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
import zlib
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import local_path, scratch, stored
from .langid import held_out

END = b""  # hashed as the end token; no word is empty
START = (1 << 32) - 1
SHARDS = 64
TOKENS_A_SHARD = 2_000_000
CHUNK = 4_000_000  # tokens a map task sorts at a time
ORDER = 3


def lower_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts in turn, each text's end token included, and the tokens of each."""
    import xxhash

    words: list[bytes] = []
    size = np.zeros(len(texts), np.int64)
    for k, t in enumerate(texts):
        own = lower_words(t)
        words += own
        words.append(END)
        size[k] = len(own) + 1
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)), size


def pack(keys: np.ndarray, counts: np.ndarray, thirds: np.ndarray | None = None) -> bytes:
    """Sorted keys and their counts, and third ids where there are any, as one blob: differences, byte by byte, compressed."""
    gaps = np.diff(keys, prepend=np.zeros(1, keys.dtype))
    parts = [gaps, counts.astype("<u4")] + ([] if thirds is None else [thirds.astype("<u4")])
    return zlib.compress(b"".join(x.view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes() for x in parts), 1)


def unpack(blob: bytes, kind: type, triples: bool = False) -> tuple[np.ndarray, ...]:
    raw = zlib.decompress(blob)
    width = np.dtype(kind).itemsize
    n = len(raw) // (width + 4 + 4 * triples)

    def plane(kind: type, at: int) -> np.ndarray:
        size = np.dtype(kind).itemsize
        return np.frombuffer(raw, np.uint8, n * size, at * n).reshape(size, n).T.copy().view(kind).ravel()

    keys, counts = np.cumsum(plane(kind, 0), dtype=kind), plane(np.uint32, width).astype(np.int64)
    return (keys, plane(np.uint32, width + 4), counts) if triples else (keys, counts)


RADIX = 1 << 21  # three ids below it fit one 64-bit key, which sorts faster than two


def summed(parts: list[tuple[np.ndarray, ...]], size: int = 0) -> tuple[np.ndarray, ...]:
    """Counts, which come last, added up by all keys before them."""
    if len(parts) == 1:
        return parts[0]
    return grouped(*map(np.concatenate, zip(*parts)), size=size)


def joined(pair: np.ndarray, third: np.ndarray, size: int) -> np.ndarray:
    """One key of three ids below ``size``, or START, in their order."""
    n, last = np.uint64(size + 1), np.uint64(size)
    return (np.minimum(pair >> np.uint64(32), last) * n + np.minimum(pair & np.uint64(START), last)) * n + third.astype(np.uint64)


def grouped(*arrays: np.ndarray, size: int = 0) -> tuple[np.ndarray, ...]:
    *keys, counts = arrays
    one = len(keys) == 1 or 0 < size < RADIX - 1
    sorting = keys[0] if len(keys) == 1 else joined(*keys, size) if one else None
    order = np.argsort(sorting) if one else np.lexsort(keys[::-1])
    keys, counts = [k[order] for k in keys], counts[order]
    if not len(counts):
        return (*keys, counts)
    new = reduce(np.logical_or, [k[1:] != k[:-1] for k in keys])
    first = np.flatnonzero(np.concatenate([[True], new]))
    return (*[k[first] for k in keys], np.add.reduceat(counts, first))


def counted(pair: np.ndarray, third: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Distinct triples in order, and how often each occurs."""
    if size >= RADIX - 1:
        return grouped(pair, third, np.ones(len(third), np.int64))
    keys, counts = np.unique(joined(pair, third, size), return_counts=True)
    n, last = np.uint64(size + 1), np.uint64(size)
    keys, third = np.divmod(keys, n)
    first, second = (np.where(x == last, np.uint64(START), x) for x in np.divmod(keys, n))
    return first << np.uint64(32) | second, third.astype(np.uint32), counts


def mixed(pair: np.ndarray, third: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of a pair of ids, or of a triple."""
    x = pair if third is None else pair * np.uint64(0x9E3779B97F4A7C15) + third.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
    return x ^ x >> np.uint64(31)


class Folder:
    """Files in the shared folder: plain files where it is mounted, else copies of what its file system holds."""

    def __init__(self, uri: str):
        self.uri, self.path = uri, local_path(uri)
        if self.path:
            os.makedirs(self.path, exist_ok=True)

    def put_counts(self, name: str, array: np.ndarray) -> None:
        """Counts in the least unsigned type that holds them all."""
        most = int(array.max(initial=0))
        self.put(name, array.astype(next(k for k in ("u1", "<u2", "<u4", "<u8") if most <= np.iinfo(k).max)))

    @lru_cache(maxsize=None)  # noqa: B019
    def counts(self, name: str, n: int) -> np.ndarray:
        """What ``put_counts`` wrote of n numbers."""
        raw = self.map(name, "u1")
        return raw.view(f"<u{len(raw) // n}") if n else raw

    def put(self, name: str, array: np.ndarray) -> None:
        if self.path:  # whole or not at all, so that a task may run twice
            part = f"{self.path}/.{name}.{uuid.uuid4().hex}"
            array.tofile(part)
            os.replace(part, f"{self.path}/{name}")
        else:
            from pyarrow import fs

            store, at = fs.FileSystem.from_uri(self.uri)
            with store.open_output_stream(f"{at}/{name}") as f:
                f.write(memoryview(np.ascontiguousarray(array)).cast("B"))

    @lru_cache(maxsize=None)  # noqa: B019  (a worker has one folder)
    def map(self, name: str, kind: str) -> np.ndarray:
        path = f"{self.path}/{name}"
        if not self.path:
            from pyarrow import fs

            store, at = fs.FileSystem.from_uri(self.uri)
            path = f"{tempfile.gettempdir()}/{self.uri.rsplit('/', 1)[-1]}-{name}"
            if not os.path.exists(path):
                with store.open_input_stream(f"{at}/{name}") as f, open(f"{path}.{os.getpid()}", "wb") as g:
                    shutil.copyfileobj(f, g)
                os.replace(f"{path}.{os.getpid()}", path)
        return np.memmap(path, kind, "r").view(np.ndarray) if os.path.getsize(path) else np.zeros(0, kind)


@lru_cache(maxsize=1)
def folder(uri: str) -> Folder:
    return Folder(uri)


class Vocabulary:
    """Ids and counts of words by hash; shard s holds the hashes whose leading bits are s."""

    def __init__(self, at: Folder, bits: int, starts: list[int]):
        self.at, self.bits, self.starts = at, bits, starts

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Id (or -1) and count of each hash."""
        unique, inverse = np.unique(h, return_inverse=True)
        ids, counts = np.full(len(unique), -1, np.int64), np.zeros(len(unique), np.int64)
        edges = np.searchsorted(unique >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64))
        for s in np.flatnonzero(np.diff(edges)):
            if self.starts[s] == self.starts[s + 1]:
                continue
            keys = self.at.map(f"vocab-{s}", "<u8")
            part = slice(edges[s], edges[s + 1])
            at = np.minimum(np.searchsorted(keys, unique[part]), len(keys) - 1)
            hit = keys[at] == unique[part]
            ids[part] = np.where(hit, at + self.starts[s], -1)
            counts[part] = np.where(hit, self.at.counts(f"vocab-n-{s}", len(keys))[at], 0)
        return ids[inverse], counts[inverse]


class Route:
    """The shard of a pair: by its context's id, or for a hot context one of its own by the following id."""

    def __init__(self, size: int, shards: int, hot: dict[int, tuple[int, int]]):
        self.size, self.shards = max(1, size), shards
        self.hot = np.array(sorted(hot), np.int64)
        self.own = np.array([hot[k] for k in sorted(hot)], np.int64).reshape(-1, 2)
        self.all = shards + int(self.own[:, 1].sum())

    def word(self, ids: np.ndarray) -> np.ndarray:
        return np.minimum(ids * self.shards // self.size, self.shards - 1)

    def pair(self, keys: np.ndarray) -> np.ndarray:
        before, after = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(START)).astype(np.int64)
        shard = self.word(np.where(before == START, 0, before))
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, before), len(self.hot) - 1)
            is_hot = self.hot[at] == before
            first, n = self.own[at, 0], self.own[at, 1]
            shard = np.where(is_hot, first + np.minimum(after * n // self.size, n - 1), shard)
        return shard

    def triple(self, pair: np.ndarray) -> np.ndarray:
        """The shard of all triples that begin with a pair: by its second id, or for a hot one of its own by the first."""
        before = (pair & np.uint64(START)).astype(np.int64)
        shard = self.word(np.where(before == START, 0, before))
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, before), len(self.hot) - 1)
            first, n = self.own[at, 0], self.own[at, 1]
            shard = np.where(self.hot[at] == before, first + (mixed(pair) % n.astype(np.uint64)).astype(np.int64), shard)
        return shard


def _pairs(ids: np.ndarray, size: np.ndarray) -> np.ndarray:
    before = np.concatenate([[START], ids[:-1]])
    before[np.cumsum(size)[:-1]] = START
    return before


def _blobs(shard: np.ndarray, keys: np.ndarray, *rest: np.ndarray):
    order = np.argsort(shard, kind="stable")  # keys stay sorted within a shard
    shard, keys, rest = shard[order], keys[order], [x[order] for x in rest]
    cut = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]])) if len(shard) else []
    for a, b in zip(cut[:-1], cut[1:]):
        blob = pack(keys[a:b], rest[-1][a:b], *(x[a:b] for x in rest[:-1]))
        yield pa.RecordBatch.from_arrays([pa.array([int(shard[a])], pa.int32()), pa.array([blob], pa.binary())], ["shard", "blob"])


class Model:
    """Where a trained model is, and its few global numbers. Small enough to be sent with a task."""

    def __init__(self, **known):
        self.__dict__.update(known)

    def opened(self) -> tuple[Folder, Vocabulary]:
        at = folder(self.uri)
        return at, Vocabulary(at, self.bits, self.starts)


def discounts(n: np.ndarray) -> tuple[float, float, float]:
    """D1, D2, D3+ from the numbers of items that occur once to four times; of too little data, 1/2, 1, 3/2."""
    if min(n[0], n[1]) == 0:
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    d = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] and n[k] else (0.5, 1.0, 1.5)[k - 1] for k in (1, 2, 3)]
    return tuple(float(min(max(x, 0.05), k)) for k, x in zip((1, 2, 3), d))


def train(docs: DataFrame, shards: int = SHARDS, order: int = ORDER) -> Model:
    """Count all rows of ``docs`` (column text) and write the model of ``order`` 2 or 3."""
    spark, texts = docs.sparkSession, docs.select(F.col("text").cast("string").alias("text"))
    uri, bits = scratch(spark, "lm"), 6
    with_triples = order == 3

    def count_words(batches):
        held, n = [], 0
        for whole in batches:
            for texts in _portions(whole.column("text")):
                h, _ = hashes(texts)
                held.append(np.unique(h, return_counts=True))
                n += len(h)
                if n >= CHUNK:
                    held, n = [summed(held)], 0
                    yield from _blobs((held[0][0] >> np.uint64(64 - bits)).astype(np.int64), *held[0])
                    held = []
        if held:
            keys, counts = summed(held)
            yield from _blobs((keys >> np.uint64(64 - bits)).astype(np.int64), keys, counts)

    def gather(batches, kind, finish, triples=False):
        """Blobs of each shard come together, one shard after the other."""
        held, shard = [], None
        for b in batches:
            for s, blob in zip(b.column("shard").to_pylist(), b.column("blob").to_pylist()):
                if s != shard and held:
                    yield from finish(shard, *summed(held, size if triples else 0))
                    held = []
                shard = s
                held.append(unpack(blob, kind, triples))
                if len(held) > 64:
                    held = [summed(held, size if triples else 0)]
        if held:
            yield from finish(shard, *summed(held, size if triples else 0))

    def dealt(blobs: DataFrame, n: int) -> DataFrame:
        return blobs.repartition(n, "shard").sortWithinPartitions("shard")

    def write_words(batches):
        at = folder(uri)

        def finish(s, keys, counts):
            at.put(f"vocab-{s}", keys)
            at.put_counts(f"vocab-n-{s}", counts)
            big = np.argsort(-counts, kind="stable")[:256]
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([int(counts.sum())], pa.int64()),
                                              pa.array([keys[big].view(np.int64)], pa.list_(pa.int64())), pa.array([big], pa.list_(pa.int64())), pa.array([counts[big]], pa.list_(pa.int64()))],
                                             ["shard", "size", "tokens", "hash", "place", "count"])

        yield from gather(batches, np.uint64, finish)

    words = dealt(texts.mapInArrow(count_words, "shard int, blob binary"), 1 << bits)
    # At most 64 rows with 256 words each.
    got = {r["shard"]: r for r in words.mapInArrow(write_words, "shard int, size long, tokens long, hash array<long>, place array<long>, count array<long>").collect()}
    sizes = [got[s]["size"] if s in got else 0 for s in range(1 << bits)]
    starts = [0, *np.cumsum(sizes).tolist()]
    size, tokens = starts[-1], sum(r["tokens"] for r in got.values())
    if size >= START:
        raise ValueError("more than 2^32 - 2 different words")
    n_shards = max(shards, tokens // TOKENS_A_SHARD)
    mass = tokens / n_shards / 4
    import xxhash

    end_hash = xxhash.xxh64_intdigest(END)
    n_texts = next((c for r in got.values() for h, c in zip(r["hash"], r["count"]) if h % (1 << 64) == end_hash), 0)
    heavy = {starts[s] + p: c for s, r in got.items() for h, p, c in zip(r["hash"], r["place"], r["count"]) if h % (1 << 64) != end_hash and c > mass}
    heavy[START] = n_texts
    hot: dict[int, tuple[int, int]] = {}
    free = n_shards
    for k in sorted(heavy):
        own = max(1, round(heavy[k] * n_shards / max(1, tokens)))
        hot[k] = (free, own)
        free += own
    route = Route(size, n_shards, hot)

    def count(batches):
        vocabulary = Vocabulary(folder(uri), bits, starts)
        held, n = [], 0

        def flush():
            keys = [np.concatenate(x) for x in zip(*held)]
            keys = counted(*keys, size) if with_triples else np.unique(keys[0], return_counts=True)
            yield from _blobs((route.triple if with_triples else route.pair)(keys[0]), *keys)

        for whole in batches:
            for texts in _portions(whole.column("text")):
                h, each = hashes(texts)
                ids, _ = vocabulary.find(h)
                before, w = _pairs(ids, each).astype(np.uint64), ids.astype(np.uint64)
                if with_triples:
                    second = _pairs(before.astype(np.int64), each).astype(np.uint64)
                    held.append((second << np.uint64(32) | before, w.astype(np.uint32)))
                else:
                    held.append((before << np.uint64(32) | w,))
                n += len(ids)
                if n >= CHUNK:
                    yield from flush()
                    held, n = [], 0
        if held:
            yield from flush()

    def follows(first, counts):
        """Of each group of counts its sum and how many are one, two, more."""
        return [np.add.reduceat(x.astype(np.int64), first) for x in (counts, counts == 1, counts == 2, counts > 2)]

    def counts_of(counts):
        return np.bincount(np.minimum(counts, 5), minlength=6)[1:5].tolist()

    def finish_pairs(s, keys, counts):
        at = folder(uri)
        at.put(f"pairs-{s}", keys)
        at.put_counts(f"pairs-n-{s}", counts)
        before, after = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(START)).astype(np.uint32)
        first = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
        follow = follows(first, counts)
        at.put(f"contexts-{s}", before[first].astype("<u4"))
        at.put_counts(f"contexts-n-{s}", np.stack(follow, axis=1))
        # The sums of a hot context's shards meet on the driver.
        sums = [int(x[0]) for x in follow] if s >= n_shards else [0, 0, 0, 0]
        yield _row([s, -1, b"", counts_of(counts), sums])
        fresh, n_fresh = np.unique(after, return_counts=True)
        for w, blob in _split(route.word(fresh.astype(np.int64)), fresh, n_fresh):
            yield _row([s, w, blob, [], []])

    def finish_triples(s, pair, third, counts):
        at = folder(uri)
        h = mixed(pair, third)
        order = np.argsort(h)
        at.put(f"triples-{s}", h[order])
        at.put(f"triples-n-{s}", np.minimum(counts[order], 255).astype("u1"))
        many = order[counts[order] >= 255]
        at.put(f"many-{s}", h[many])
        at.put(f"many-n-{s}", counts[many].astype("<u8"))
        first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        follow = np.stack(follows(first, counts), axis=1)
        kept = follow[:, 0] > 1
        at.put(f"histories-{s}", pair[first][kept])
        at.put_counts(f"histories-n-{s}", follow[kept])
        yield _row([s, -2, b"", counts_of(counts), [0, 0, 0, 0]])
        second = pair & np.uint64(START)
        keys, n = grouped(second << np.uint64(32) | third, np.where(second == START, counts, 1))
        if s < n_shards:  # all triples of these middle words are here
            yield from finish_pairs(s, keys, n)
        else:
            for w, blob in _split(route.pair(keys), keys, n):
                yield _row([w, -3, blob, [], []])

    schema = "shard int, word_shard int, blob binary, of array<long>, sums array<long>"
    sent = dealt(texts.mapInArrow(count, "shard int, blob binary"), route.all)
    pairs = stored(sent.mapInArrow(lambda b: gather(b, np.uint64, finish_triples if with_triples else finish_pairs, with_triples), schema), "lm-fresh")
    of_triples, triple_shards = np.zeros(4, np.int64), []
    if with_triples:
        got = pairs.filter("word_shard = -2").select("shard", "of").collect()  # one row a shard
        triple_shards, of_triples = sorted(r["shard"] for r in got), np.array([r["of"] for r in got]).reshape(-1, 4).sum(axis=0)
        late = dealt(pairs.filter("word_shard = -3").select("shard", "blob"), route.all).mapInArrow(lambda b: gather(b, np.uint64, finish_pairs), schema)
        pairs = pairs.filter("word_shard >= -1").union(stored(late, "lm-fresh"))
    totals = pairs.filter("word_shard = -1").select("shard", "of", "sums").collect()  # one row a shard
    of_pairs = np.array([r["of"] for r in totals]).reshape(-1, 4).sum(axis=0)
    hot_sums = {}
    for r in totals:
        for k, (first, n) in hot.items():
            if first <= r["shard"] < first + n:
                hot_sums[k] = [a + b for a, b in zip(hot_sums.get(k, [0] * 4), r["sums"])]

    edges = [-(-s * size // n_shards) for s in range(n_shards)] + [size]  # the first id of each word shard

    def write_fresh(batches):
        at = folder(uri)

        def finish(s, keys, counts):
            dense = np.zeros(edges[s + 1] - edges[s], np.int64)
            dense[keys.astype(np.int64) - edges[s]] = counts
            at.put_counts(f"fresh-{s}", dense)
            yield pa.RecordBatch.from_arrays([pa.array([np.bincount(np.minimum(counts, 5), minlength=6)[1:5]], pa.list_(pa.int64())),
                                              pa.array([int(counts.sum())], pa.int64()), pa.array([[int((counts == 1).sum()), int((counts == 2).sum()), int((counts > 2).sum())]], pa.list_(pa.int64()))],
                                             ["of", "all", "kinds"])

        yield from gather(batches, np.uint32, finish)

    fresh = dealt(pairs.filter("word_shard >= 0").select(F.col("word_shard").alias("shard"), "blob"), n_shards).mapInArrow(write_fresh, "of array<long>, all long, kinds array<long>").collect()
    of_fresh = np.array([r["of"] for r in fresh]).reshape(-1, 4).sum(axis=0)
    kinds = np.array([r["kinds"] for r in fresh]).reshape(-1, 3).sum(axis=0)
    return Model(uri=uri, bits=bits, starts=starts, size=size, tokens=tokens, hot=hot, hot_sums=hot_sums, shards=n_shards, edges=edges,
                 order=order, triple_shards=frozenset(triple_shards), pair_shards=frozenset(r["shard"] for r in totals),
                 d_triples=discounts(of_triples), d_pairs=discounts(of_pairs), d_fresh=discounts(of_fresh), all_fresh=sum(r["all"] for r in fresh), kinds=kinds.tolist())


def _row(row: list) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], ["shard", "word_shard", "blob", "of", "sums"])


def _portions(texts: pa.Array, most: int = 1 << 22):
    """Lists of texts of about ``most`` bytes, or of one text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield texts.slice(at, upto - at).to_pylist()
        at = upto


def _split(shard: np.ndarray, keys: np.ndarray, counts: np.ndarray):
    cut = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]])) if len(shard) else []
    for a, b in zip(cut[:-1], cut[1:]):
        yield int(shard[a]), pack(keys[a:b], counts[a:b])


class Scorer:
    def __init__(self, model: Model):
        self.m = model
        self.at, self.vocabulary = model.opened()
        self.route = Route(model.size, model.shards, model.hot)

    def _discount(self, counts: np.ndarray, d: tuple) -> np.ndarray:
        return np.array([0.0, *d])[np.minimum(counts, 3)]

    def unigram(self, ids: np.ndarray) -> np.ndarray:
        m = self.m
        below = sum(d * k for d, k in zip(m.d_fresh, m.kinds)) / m.all_fresh / (m.size + 1)
        k = np.zeros(len(ids), np.int64)
        shard = np.where(ids >= 0, self.route.word(ids), -1)
        for s in np.unique(shard[shard >= 0]):
            own = shard == s
            k[own] = self.at.counts(f"fresh-{s}", m.edges[s + 1] - m.edges[s])[ids[own] - m.edges[s]]
        return np.maximum(k - self._discount(k, m.d_fresh), 0) / m.all_fresh + below

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, ...]:
        """Tokens, known tokens, base score and model score of each text."""
        m = self.m
        h, size = hashes(texts)
        ends = np.cumsum(size) - size
        if not m.tokens:
            zero = np.zeros(len(texts))
            return size, zero.astype(np.int64), zero, zero
        ids, counts = self.vocabulary.find(h)
        base = np.log10((counts + 0.5) / (m.tokens + 0.5 * (m.size + 1)))
        before = _pairs(ids, size)
        p = self.unigram(ids)
        valid = np.flatnonzero(before >= 0)
        keys = before[valid].astype(np.uint64) << np.uint64(32) | np.where(ids[valid] >= 0, ids[valid], START).astype(np.uint64)
        keys, inverse = np.unique(keys, return_inverse=True)
        u = (keys >> np.uint64(32)).astype(np.int64)
        shard = self.route.pair(keys)
        c, follow = np.zeros(len(keys), np.int64), np.zeros((len(keys), 4), np.int64)
        order = np.argsort(shard, kind="stable")
        cut = np.flatnonzero(np.concatenate([[True], np.diff(shard[order]) != 0, [True]])) if len(keys) else []
        for a, b in zip(cut[:-1], cut[1:]):
            own = order[a:b]
            s = int(shard[own[0]])
            if s not in m.pair_shards:
                continue
            known = self.at.map(f"pairs-{s}", "<u8")
            n = self.at.counts(f"pairs-n-{s}", len(known))
            at = np.minimum(np.searchsorted(known, keys[own]), len(known) - 1)
            c[own] = np.where(known[at] == keys[own], n[at], 0)
            if s < m.shards:
                context = self.at.map(f"contexts-{s}", "<u4")
                stats = self.at.counts(f"contexts-n-{s}", 4 * len(context)).reshape(-1, 4)
                at = np.minimum(np.searchsorted(context, u[own]), len(context) - 1)
                follow[own] = np.where((context[at] == u[own])[:, None], stats[at], 0)
        for k, sums in m.hot_sums.items():
            follow[u == k] = sums
        total = np.maximum(follow[:, 0], 1)
        seen = follow[:, 0] > 0
        first = np.maximum(c - self._discount(c, m.d_pairs), 0) / total
        weight = np.where(seen, follow[:, 1:] @ np.array(m.d_pairs) / total, 1.0)
        p[valid] = first[inverse] + weight[inverse] * p[valid]
        if m.order == 3:
            known = np.zeros(len(ids), np.int64)
            known[valid] = c[inverse]
            p = self._third(ids, size, before, known, p)
        logs = np.log10(np.maximum(p, 1e-300))
        return size, np.add.reduceat((counts > 0).astype(np.int64), ends), np.add.reduceat(base, ends), np.add.reduceat(logs, ends)

    def _third(self, ids: np.ndarray, size: np.ndarray, before: np.ndarray, pairs: np.ndarray, p: np.ndarray) -> np.ndarray:
        """P of each token after two, from p after one. pairs: the count of each token's pair."""
        m = self.m
        second = _pairs(before, size)
        # A known pair begins a triple; so does the pair of start marks.
        seen = np.concatenate([[1], pairs[:-1]]) > 0
        seen[np.cumsum(size)[:-1]] = True
        at = np.flatnonzero((before >= 0) & (second >= 0) & seen)
        pair = second[at].astype(np.uint64) << np.uint64(32) | before[at].astype(np.uint64)
        h = mixed(pair, np.where(ids[at] >= 0, ids[at], START))
        h, inverse = np.unique(h, return_inverse=True)
        each, pair = pair, np.zeros(len(h), np.uint64)
        pair[inverse] = each
        c, follow = np.zeros(len(h), np.int64), np.tile(np.array([1, 1, 0, 0], np.int64), (len(h), 1))
        shard = self.route.triple(pair)
        order = np.argsort(shard, kind="stable")
        cut = np.flatnonzero(np.concatenate([[True], np.diff(shard[order]) != 0, [True]])) if len(h) else []
        for a, b in zip(cut[:-1], cut[1:]):
            own = order[a:b]
            s = int(shard[own[0]])
            if s not in m.triple_shards:
                continue
            hit, where = _found(self.at.map(f"triples-{s}", "<u8"), h[own])
            c[own[hit]] = self.at.map(f"triples-n-{s}", "u1")[where]
            hit, where = _found(self.at.map(f"many-{s}", "<u8"), h[own])
            c[own[hit]] = self.at.map(f"many-n-{s}", "<u8")[where]
            histories = self.at.map(f"histories-{s}", "<u8")
            wanted, place = np.unique(pair[own], return_inverse=True)  # in order, so that neighbours share pages
            hit, where = _found(histories, wanted)
            of = np.tile(np.array([1, 1, 0, 0], np.int64), (len(wanted), 1))
            of[hit] = self.at.counts(f"histories-n-{s}", 4 * len(histories)).reshape(-1, 4)[where]
            follow[own] = of[place]
        total = follow[:, 0]
        first = np.maximum(c - self._discount(c, m.d_triples), 0) / total
        weight = follow[:, 1:] @ np.array(m.d_triples) / total
        p = p.copy()
        p[at] = first[inverse] + weight[inverse] * p[at]
        return p


def _found(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are among the known ones, and where those are."""
    if not len(known):
        return np.zeros(len(keys), bool), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    hit = known[at] == keys
    return hit, at[hit]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every row."""
    def run(batches):
        scorer = Scorer(model)
        for whole in batches:
            at = 0
            for texts in _portions(whole.column("text")):
                got = scorer.score(texts)
                yield pa.RecordBatch.from_arrays([whole.column("doc_id").slice(at, len(texts)), *map(pa.array, got)], ["doc_id", "n_tokens", "n_known", "base_score", "score"])
                at += len(texts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def score_documents(docs: DataFrame, held: Column | None = None, order: int = ORDER) -> DataFrame:
    """Train on the rows that are not held out and score all rows."""
    held = held_out(5, 1) if held is None else held
    model = train(docs.filter(~held), order=order)
    return score(docs, model).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score",
                                     (F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))).alias("perplexity"))
