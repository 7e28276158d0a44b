"""BPE encoding and decoding with a contiguous rank array.

A short word is held as two contiguous arrays: its parts and the merge rank of each
adjacent pair. The least rank is found by a scan, its boundary deleted and the two
neighbouring ranks refreshed, until no pair has a rank; all new words of a batch are rows of the same
arrays. Words beyond ``SHORT`` parts take the same merges in the same order from a heap over a linked list, so that one
very long word costs n log n. A bounded memo keeps the ids of words met before.

Defined cases: null text is empty text; empty text has no ids; the special token's string in a
text is that token, as the tokenizers library has it; repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Callable
from functools import lru_cache, partial
from itertools import compress
from operator import is_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHORT = 64
MEMO = 400_000

#: Fixed value: the pre-tokenisation pattern of byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if visible, else the next from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class RankArrays:
    """The merges of a byte-level BPE vocabulary, applied to many words at a time.

    Each short word is a row of two contiguous arrays: its parts, and the ranks of its adjacent
    pairs. Every step finds the least rank of each row by a scan, replaces the part before its boundary,
    deletes the boundary, and refreshes the ranks beside it; rows without a rank are done.
    """

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str = ""):
        symbols = byte_symbols()
        self.first = np.array([vocab[s] for s in symbols], np.int32)
        self.last = np.array([vocab[s + suffix] for s in symbols], np.int32)
        self.rank: dict[tuple[int, int], int] = {}
        made = []
        for a, b in (m if isinstance(m, list) else m.split(" ") for m in merges):
            self.rank.setdefault((vocab[a], vocab[b]), len(made))
            made.append(vocab[a + b])
        self.made = np.array([*made, -1], np.int32)
        keys = np.array([a << 20 | b for a, b in self.rank], np.int64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.ranks = np.append(np.array(list(self.rank.values()), np.int32)[order], 0).astype(np.int32)
        self.none = np.int32(len(made))

    def look_up(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 20 | b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], self.none)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(size, kind="stable")
        order = order[np.searchsorted(size[order], 1):]
        short = int(np.searchsorted(size[order], SHORT, side="right"))
        for k in range(0, short, 8192):
            at = order[k:min(k + 8192, short)]
            for i, ids in zip(at.tolist(), self._rows([words[i] for i in at.tolist()], size[at])):
                out[i] = ids
        for i in order[short:].tolist():
            out[i] = self._long(words[i])
        return out

    def _rows(self, words: list[bytes], size: np.ndarray) -> list[bytes]:
        n, width = len(words), int(size[-1])
        raw = np.frombuffer(b"".join(words), np.uint8)
        parts = np.full((n, width + 1), -1, np.int32)
        parts[np.arange(width + 1) < size[:, None]] = self.first[raw]
        parts[np.arange(n), size - 1] = self.last[raw[np.cumsum(size) - 1]]
        ranks = self.look_up(parts[:, :-1], parts[:, 1:])
        rows, done = np.arange(n), np.full((n, width), -1, np.int32)
        while len(rows):
            low = ranks.argmin(axis=1)
            r = np.arange(len(rows))
            best = ranks[r, low]
            over = best == self.none
            if over.any():
                done[rows[over]] = np.pad(parts[over], ((0, 0), (0, width + 1 - parts.shape[1])), constant_values=-1)[:, :width]
                live = ~over
                rows, parts, ranks, low, best = rows[live], parts[live], ranks[live], low[live], best[live]
                if not len(rows):
                    break
                r = np.arange(len(rows))
            parts[r, low] = self.made[best]
            cols = np.arange(ranks.shape[1])  # one boundary less in every row
            parts = np.take_along_axis(parts, cols + (cols > low[:, None]), axis=1)
            if ranks.shape[1] == 1:
                ranks = np.full((len(rows), 1), self.none, np.int32)
                parts = np.hstack([parts, np.full((len(rows), 1), -1, np.int32)])
                continue
            cols = cols[:-1]
            ranks = np.take_along_axis(ranks, cols + (cols >= low[:, None]), axis=1)
            left = np.flatnonzero(low > 0)
            ranks[left, low[left] - 1] = self.look_up(parts[left, low[left] - 1], parts[left, low[left]])
            right = np.flatnonzero(low < ranks.shape[1])
            ranks[right, low[right]] = self.look_up(parts[right, low[right]], parts[right, low[right] + 1])
        kept = done >= 0
        ends = np.cumsum(kept.sum(axis=1)) * 4
        flat = done[kept].astype("<u4").tobytes()
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def _long(self, word: bytes) -> bytes:
        parts = self.first[np.frombuffer(word, np.uint8)].tolist()
        parts[-1] = int(self.last[word[-1]])
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := self.rank.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)

        def push(i: int) -> None:
            if i >= 0 and (j := after[i]) < n and (r := self.rank.get((parts[i], parts[j]))) is not None:
                heapq.heappush(heap, (r, i, parts[i], parts[j]))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = int(self.made[r]), -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            push(before[i])
            push(i)
        return np.array([p for p in parts if p >= 0], "<u4").tobytes()


class Memo:
    """Ids of short strings met before, in two generations of at most ``MEMO`` entries each.

    When the younger is full it becomes the older, so that what is in use stays.
    """

    def __init__(self, make: Callable[[list[str]], list[bytes]]):
        self.make, self.young, self.old = make, {}, {}
        self.missing = partial(is_, None)

    def parts(self, texts: list[list[str]]) -> list[list[bytes]]:
        """The ids of each text's strings; strings not met before go to ``make`` together."""
        young, old = self.young, self.old
        got = [list(map(young.get, ws)) for ws in texts]
        holes = [list(compress(range(len(g)), map(self.missing, g))) if None in g else () for g in got]
        wanted = {ws[i] for ws, at in zip(texts, holes) for i in at}
        found = {w: ids for w in wanted if (ids := old.get(w)) is not None}
        new = [w for w in wanted if w not in found]
        found.update(zip(new, self.make(new)))
        for g, ws, at in zip(got, texts, holes):
            for i in at:
                g[i] = found[ws[i]]
        young.update((w, ids) for w, ids in found.items() if len(w) <= SHORT)
        if len(young) >= MEMO:
            self.young, self.old = {}, young
        return got

    def join(self, texts: list[list[str]]) -> list[bytes]:
        """The joined ids of each text's strings."""
        return list(map(b"".join, self.parts(texts)))


class ByteBPE:
    """Encoder and decoder of a byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.merges = RankArrays(vocab, spec["model"]["merges"])
        to_byte = {s: i for i, s in enumerate(byte_symbols())}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for s, i in vocab.items():
            self.bytes_of[i] = bytes(to_byte[c] for c in s)
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = regex.compile(PATTERN).findall
        self.adjacent = re.compile(r"\s\s").search
        self.memo = Memo(self._pieces)

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces, each a run of whole pre-tokenised words."""
        words = [[p] if p[0] == " " and p[1:].isalpha() else self.words(p) for p in pieces]
        flat = list({w for ws in words for w in ws})
        ids = dict(zip(flat, self.merges.merge([w.encode() for w in flat])))
        return [ids[ws[0]] if len(ws) == 1 else b"".join(map(ids.__getitem__, ws)) for ws in words]

    def _split(self, text: str) -> list[str]:
        if not text:
            return []
        if text[0].isspace() or self.adjacent(text):
            return self.words(text)
        # All white space stands alone: no word of PATTERN crosses the place before a space or newline.
        return text.replace("\n", "\0\n").replace(" ", "\0 ").split("\0") if "\0" not in text else self.words(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of whole texts, as little-endian 32-bit integers."""
        parts, ours = [], []
        for t in texts:
            cut = self.at_special.split(t) if self.at_special and any(s in t for s in self.special) else [t]
            ours.append(len(cut))
            parts += [[x] if k % 2 else self._split(x) for k, x in enumerate(cut)]
        got = self.memo.join([[] if len(ws) == 1 and ws[0] in self.special else ws for ws in parts])
        out, at = [], 0
        for n in ours:
            out.append(got[at] if n == 1 else b"".join(
                np.array([self.special[parts[at + k][0]]], "<u4").tobytes() if k % 2 else got[at + k] for k in range(n)))
            at += n
        return out

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> ByteBPE:
    return ByteBPE(path)


def encode_decode(docs: DataFrame, vocabulary: str, ids: bool = False, text: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row; with ``ids`` or ``text`` the ids and decoded text too.

    One narrow pass: nothing is shuffled, and a worker holds one Arrow batch, the vocabulary and its memo.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids + ", decoded string" * text

    def run(batches):
        bpe = load(vocabulary)
        for batch in (whole.slice(k, 512) for whole in batches for k in range(0, len(whole), 512)):
            out: dict[str, list] = {k: [] for k in ("n", "i", "d", "ids", "text")}
            for raw in bpe.encode([t.as_py() or "" for t in batch.column("text")]):
                arr = np.frombuffer(raw, "<u4")
                back = bpe.decode(arr)
                out["n"].append(len(arr))
                out["i"].append(hashlib.sha256(raw).hexdigest())
                out["d"].append(hashlib.sha256(back.encode()).hexdigest())
                if ids:
                    out["ids"].append(arr.astype("int32"))
                if text:
                    out["text"].append(back)
            cols = [batch.column("doc_id").cast(pa.int64()), pa.array(out["n"], pa.int64()), pa.array(out["i"], pa.string()), pa.array(out["d"], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                cols.append(pa.array(out["ids"], pa.list_(pa.int32())))
                names.append("ids")
            if text:
                cols.append(pa.array(out["text"], pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
