"""Packing documents into sequences by vector best-fit.

A bin has three residual capacities: tokens, documents and attention cost (the sum of squared
lengths). Lengths come in descending order; each goes to the fitting bin with the least weighted
residual norm (or the greatest weighted dot-product), else to a new bin.

Pieces of one length are interchangeable, so bins are chosen for the histogram of lengths, not
for rows: at most ``capacity`` lengths, and bins alike are one entry with a multiplicity. The plan's size
is bounded by the capacity, whatever the number of documents. Rows then find their
place by their rank within their length, which is counted in salted groups; no length, however common, meets in one task.

Defined cases: null text is empty text, that is its end token alone; repeated rows are packed
each; longer documents are cut into full pieces and a rest; an empty table gives no rows.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from itertools import pairwise
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import Memo, RankArrays
from .common import released, stored

WEIGHTS = (1.0, 0.05, 0.05)

#: Bytes of text whose distinct words are looked up together, and words whose ids are laid out together.
PORTION, WORDS = 8 << 20, 1 << 20


def best_fit(counts: dict[int, int], capacity: int, max_docs: int | None = None, max_cost: int | None = None,
             rule: str = "norm", weights: tuple[float, float, float] = WEIGHTS) -> tuple[np.ndarray, int]:
    """Place counts[length] pieces of each length. Returns the placements and the number of sequences.

    A placement (length, first rank, how many, first sequence, offset) puts the pieces with these ranks
    into as many successive sequences, each at the same offset. A length whose own cost exceeds max_cost is an error.
    """
    docs, cost = max_docs or capacity, max_cost or capacity * capacity
    if any(n * n > cost or not 0 < n <= capacity for n in counts):
        raise ValueError("a piece does not fit an empty sequence")
    scale = np.array([capacity, docs, cost], float)
    w = np.array(weights)
    bins = np.zeros((256, 5), np.int64)  # residual tokens, documents, cost; multiplicity, first sequence
    used = 0
    placed: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def add(row: tuple) -> None:
        nonlocal bins, used
        if used == len(bins):
            bins = np.vstack([bins, np.zeros_like(bins)])
        bins[used] = row
        used += 1

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        need = np.array([length, 1, length * length])
        while left:
            live = bins[:used]
            fit = np.flatnonzero((live[:, 0] >= length) & (live[:, 1] >= 1) & (live[:, 2] >= need[2]))
            if not len(fit):
                each = min(capacity // length, docs, cost // need[2])
                many, rest = divmod(left, each)
                for n, k in ((many, each), (1 if rest else 0, rest)):
                    if n:
                        for j in range(k):
                            placed.append((length, rank, n, sequences, j * length))
                            rank += n
                        if capacity - k * length and docs - k and cost - k * need[2] > 0:
                            add((capacity - k * length, docs - k, cost - k * need[2], n, sequences))
                        sequences += n
                break
            after = (live[fit, :3] - need) / scale
            if rule == "norm":
                at = fit[np.argmin((w * after * after).sum(axis=1))]
            elif rule == "dot":
                at = fit[np.argmax(-(w * (live[fit, :3] / scale) * (need / scale)).sum(axis=1))]
            else:
                raise ValueError(rule)
            tokens, d, c, many, first = (int(x) for x in bins[at])
            n = min(left, many)
            placed.append((length, rank, n, first, capacity - tokens))
            rank += n
            left -= n
            used -= 1 if n == many else 0
            if n == many:
                bins[at] = bins[used]
            else:
                bins[at, 3:] = (many - n, first + n)
            if tokens - length and d > 1 and c - need[2] > 0:
                add((tokens - length, d - 1, c - int(need[2]), n, first))
    return np.array(placed, np.int64).reshape(-1, 5), sequences


class WordIds:
    """Ids of whole texts for a vocabulary of words with an end mark, as the tokenizers library gives them.

    The vocabulary's normaliser (NFC, white space, lower case) and pre-tokeniser drop white space, and no match
    crosses it, so the ids of a text are those of its white-space words in turn. A word with a
    special token's string goes to the library itself.
    """

    #: Fixed value: the vocabulary's pre-tokenisation pattern.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.merges = RankArrays(spec["model"]["vocab"], spec["model"]["merges"], spec["model"]["end_of_word_suffix"])
        self.words = regex.compile(self.PATTERN).findall
        self.memo = Memo(self._ids)
        self.marks = pa.array([",", ".", "!", "|"])
        self.mark_ids = [*self.merges.merge([m.encode() for m in self.marks.to_pylist()]), b""]

    def _ids(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words without white space."""
        out, whole, cut = [b""] * len(words), [], []
        for k, w in enumerate(words):
            if not (w.isascii() and w.islower() and w.isalpha()):
                if "<" in w and any(s in w for s in self.special):
                    out[k] = np.array(self.library.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
                    continue
                if not w.isascii():
                    w = unicodedata.normalize("NFC", w)
                w = "".join(c.lower() for c in w) if "\u03a3" in w else w.lower()
                if not w.isalpha():
                    cut.append((k, self.words(w)))
                    continue
            whole.append((k, w))
        parts = list({p for _, ps in cut for p in ps})
        got = self.merges.merge([w.encode() for _, w in whole] + [p.encode() for p in parts])
        for (k, _), ids in zip(whole, got):
            out[k] = ids
        of = dict(zip(parts, got[len(whole):]))
        for k, ps in cut:
            out[k] = b"".join(map(of.__getitem__, ps))
        return out

    def _distinct(self, words: pa.Array) -> list[bytes]:
        """Ids of distinct words; ASCII letters with at most one mark after them are looked up in lower case, without it."""
        plain = pc.match_substring_regex(words, "^[A-Za-z]+[,.!|]?$")
        mark = pc.if_else(plain, pc.fill_null(pc.index_in(pc.utf8_slice_codeunits(words, -1), value_set=self.marks), len(self.marks)), len(self.marks))
        stem = pc.if_else(pc.less(mark, len(self.marks)), pc.utf8_slice_codeunits(words, 0, -1), words)
        stems = pc.if_else(plain, pc.ascii_lower(stem), stem).dictionary_encode()
        ids = self.memo.parts([stems.dictionary.to_pylist()])[0]
        return list(map(add, map(ids.__getitem__, stems.indices.to_pylist()), map(self.mark_ids.__getitem__, mark.to_pylist())))

    def batch(self, texts: pa.Array) -> list[bytes]:
        """The ids of whole texts, as little-endian 32-bit integers. Each distinct word of the texts is looked up once."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        words = split.flatten().dictionary_encode()
        known = self._distinct(words.dictionary)
        flat = np.frombuffer(b"".join(known), "<u4")
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        first = np.cumsum(size) - size
        at, out, ends = words.indices.to_numpy(), [], [np.zeros(1, np.int64)]
        for k in range(0, len(at), WORDS):
            here = at[k:k + WORDS]
            many = size[here]
            end = np.cumsum(many)
            out.append(flat[np.repeat(first[here] - (end - many), many) + np.arange(end[-1])].tobytes())
            ends.append(ends[-1][-1] + end)
        ids, cut = b"".join(out), 4 * np.concatenate(ends)[split.offsets.to_numpy()]
        return [ids[a:b] for a, b in pairwise(cut.tolist())]


def portions(batch: pa.RecordBatch, c: str, size: int = PORTION):
    """Slices of a batch whose strings in c have about ``size`` bytes together; a longer one is a slice of its own."""
    n = pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, k = np.cumsum(n), 0
    while k < len(n):
        end = max(k + 1, int(np.searchsorted(total, total[k] - n[k] + size, side="right")))
        yield batch.slice(k, end - k)
        k = end


def pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of at most ``capacity`` ids."""
    def run(batches):
        ids_of, end = WordIds(vocabulary), np.array([end_id], "<u4").tobytes()
        for whole in released(batches):
            for b in portions(whole, "text"):
                who = b.column("doc_id").to_pylist()
                rows: list[list] = [[], [], [], [], []]
                for doc, ids in zip(who, ids_of.batch(b.column("text"))):
                    ids += end
                    for p, s in enumerate(range(0, len(ids) // 4, capacity)):
                        part = ids[4 * s:4 * (s + capacity)]
                        for col, x in zip(rows, (doc, p, s, len(part) // 4, zlib.crc32(part))):
                            col.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(rows)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, max_docs: int | None = None,
         max_cost: int | None = None, rule: str = "norm", rows_per_salt: int = 1_000_000) -> DataFrame:
    """Pack all documents. doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    max_docs and max_cost default to the least values that no sequence of ``capacity`` tokens can exceed.
    """
    own = stored(pieces(docs, vocabulary, capacity, end_id), "pack-pieces")
    salts = int(min(4096, max(64, own.count() // rows_per_salt)))
    # A rank within the length is the rank within (length, salt) after the rows of lower salts.
    own = own.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    table = np.zeros((capacity + 1, salts), np.int64)
    for r in own.groupBy("length", "salt").count().toLocalIterator():  # at most capacity * salts rows
        table[r["length"], r["salt"]] = r["count"]
    counts = {int(n): int(c) for n, c in enumerate(table.sum(axis=1)) if c}
    placed, _ = best_fit(counts, capacity, max_docs, max_cost, rule)
    before = np.cumsum(table, axis=1) - table
    placed = placed[np.lexsort((placed[:, 1], placed[:, 0]))]
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((before, placed, np.searchsorted(placed[:, 0], np.arange(capacity + 2))))
    ranked = own.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1)

    def place(batches):
        base, plan, at = shared.value
        most = int(plan[:, 1].max()) + int(plan[:, 2].max()) + 1 if len(plan) else 1
        key = plan[:, 0] * most + plan[:, 1]
        for b in batches:
            length, salt = b.column("length").to_numpy(), b.column("salt").to_numpy()
            rank = base[length, salt] + b.column("rank").to_numpy()
            row = plan[np.searchsorted(key, length * most + rank, side="right") - 1]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")),
                                              pa.array(row[:, 3] + rank - row[:, 1]), pa.array(row[:, 4])],
                                             ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
