"""Exact deduplication with an extendible-hash index on shared files, in DataFrame operations only.

Texts are equal when they agree after all white space is deleted. The index holds one entry
per distinct normalised text, under the 64-bit hash of its bytes:

* Entries are made by a grouping on hash and text, pre-aggregated, which compares the bytes of texts that share a hash. Different
  texts under one hash are a chain: its entries are numbered by digest.
* The directory starts with one bucket. Where a bucket holds more than ``capacity`` keys the directory doubles and the
  bucket is split by the next leading bit of the hash. The directory is as deep as the fullest bucket asks for. As a set this depends on
  the key counts of hash prefixes alone, so it is computed from these.
* The entries are written to the shared folder by owner tasks, each of one range of buckets, that is of keys.
* A document is looked up as in any such index: its hash names a directory cell, the cell its bucket, and bucket and hash the chain. A
  chain of one entry is the answer; of a longer one, the entry of equal bytes. A group of copies of any size is one entry, and hot
  cells and entries are answered by a broadcast of at most 1/HOT_SHARE rows.

Defined cases: null text is empty text; all empty texts are one group; null doc_ids group as
others do but stay only where the whole group has none; rows that repeat doc_id and text tie, and
each is returned with the flags of that document; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, scratch, skewless_left_join, stored

CAPACITY = 4096
HASH: Callable[[Column], Column] = F.xxhash64
_ID = 1 << 65  # beyond the ranks of doc_ids


def normalised(text: Column) -> Column:
    return reduce(lambda c, w: F.replace(c, F.lit(w), F.lit("")), WHITE, F.replace(F.coalesce(text, F.lit("")), F.lit(" "), F.lit("")))


def keyed(docs: DataFrame) -> DataFrame:
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    x = x.select("doc_id", F.length("text").alias("n_points"), F.xxhash64("text").alias("raw"), normalised(F.col("text")).alias("norm"))
    return x.select("doc_id", "n_points", "raw", "norm", HASH(F.col("norm")).alias("h"))


def entries(x: DataFrame) -> DataFrame:
    """One row per distinct text of keyed rows: h, norm, group_size, keep_id, n_points."""
    # The longest original stays, then the least doc_id; a null doc_id comes last. As one number, which a hash aggregation can update.
    last = F.lit(str(1 << 63)).cast("decimal(20,0)") - F.col("doc_id").cast("decimal(20,0)")
    rank = F.col("n_points").cast("decimal(10,0)") * F.lit(str(_ID)).cast("decimal(20,0)") + F.coalesce(last, F.lit(0).cast("decimal(21,0)"))
    g = x.groupBy("h", "norm").agg(F.count(F.lit(1)).alias("group_size"), F.max(rank.cast("decimal(38,0)")).alias("best"))
    low = F.expr(f"best % cast('{_ID}' AS decimal(20,0))")
    keep = F.when(low != 0, (F.lit(str(1 << 63)).cast("decimal(20,0)") - low).cast("long"))
    points = F.expr(f"cast((best - best % cast('{_ID}' AS decimal(20,0))) / cast('{_ID}' AS decimal(20,0)) AS int)")
    return g.select("h", "norm", "group_size", keep.alias("keep_id"), points.alias("n_points"))


def _cell(depth: int) -> Column:
    return F.shiftrightunsigned("h", 64 - depth) if depth else F.lit(0).cast("long")


def directory(index: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """The directory (cell, depth, bucket, __n: rows in the cell) and its depth. index: h, n; distinct keys.

    A bucket is named by its least cell.
    """
    n, depth = index.count(), 0
    while n > capacity << depth:
        depth += 1
    while True:
        cells = stored(index.groupBy(_cell(depth).alias("cell")).agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("__n")), "exact-cells")
        most = cells.agg(F.max("keys")).first()[0] or 0
        if most <= capacity or depth == 64:
            break
        depth = min(64, depth + max(1, (most // capacity).bit_length()))
    above = cells.select("cell", "keys", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("depth"))
    above = above.withColumn("prefix", F.expr(f"CASE WHEN {depth} - depth = 64 THEN 0L ELSE shiftrightunsigned(cell, {depth} - depth) END"))
    fits = above.groupBy("depth", "prefix").agg(F.sum("keys").alias("keys")).filter((F.col("keys") <= capacity) | (F.col("depth") == depth))
    found = above.drop("keys").join(fits.select("depth", "prefix"), ["depth", "prefix"])
    buckets = found.groupBy("cell").agg(F.min(F.struct("depth", "prefix")).alias("at"))
    buckets = buckets.select("cell", F.col("at.depth").alias("depth"), F.expr(f"shiftleft(at.prefix, {depth} - at.depth)").alias("bucket"))
    return stored(cells.select("cell", "__n").join(buckets, "cell"), "exact-directory"), depth


class Index:
    """Stored entries in bucket order (bucket, h, slot, chain, keep_id, n_points, group_size, digest) and their directory."""

    def __init__(self, docs: DataFrame, capacity: int = CAPACITY):
        x = keyed(docs)
        made = entries(x).select("h", "group_size", "keep_id", "n_points", F.sha2(F.encode("norm", "UTF-8"), 256).alias("digest"))
        made = stored(made, "exact-entries")
        keys = stored(made.groupBy("h").agg(F.sum("group_size").alias("n"), F.count(F.lit(1)).alias("chain"), F.array_sort(F.collect_list("digest")).alias("digests")), "exact-keys")
        self.directory, self.depth = directory(keys, capacity)
        self.rows = keys.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        placed = made.join(keys.select("h", "chain", "digests"), "h").withColumn("slot", F.array_position("digests", F.col("digest")).cast("int"))
        placed = placed.withColumn("cell", _cell(self.depth)).join(self.directory.select("cell", "bucket"), "cell").drop("cell", "digests")
        at = scratch(docs.sparkSession, "exact-index")
        placed.repartitionByRange("bucket", "h").sortWithinPartitions("bucket", "h", "slot").write.parquet(at)
        self.entries = docs.sparkSession.read.schema(placed.schema).parquet(at)
        chains = keys.filter("chain > 1").select(F.col("h").alias("__h"))
        self.texts = None
        if chains.limit(1).count():  # the texts of chains, to be compared with
            held = entries(x.join(chains, x["h"] == F.col("__h"), "left_semi"))
            held = held.select("h", "norm", F.sha2(F.encode("norm", "UTF-8"), 256).alias("digest"))
            self.texts = stored(held.join(self.entries.select("h", "digest", "bucket", "slot", "group_size"), ["h", "digest"]), "exact-chains")

    def find(self, x: DataFrame) -> DataFrame:
        """Keyed rows without their text and with their entry's columns."""
        x = x.withColumn("cell", _cell(self.depth))
        names = [c for c in x.columns if c not in ("norm", "cell")]
        wide = self.texts is not None
        x = x if wide else x.select(*names, "cell")
        x = skewless_left_join(x, self.directory.select("cell", "bucket", "__n"), ["cell"], "__n", self.rows).drop("cell")
        if wide:
            walked = self.texts.select("bucket", "h", "norm", "slot", F.col("group_size").alias("__n"))
            x = skewless_left_join(x, walked, ["bucket", "h", "norm"], "__n", self.rows)
            x = x.select(*names, "bucket", F.coalesce("slot", F.lit(1)).alias("slot"))
        else:
            x = x.withColumn("slot", F.lit(1))
        found = self.entries.select("bucket", "h", "slot", "keep_id", F.col("n_points").alias("most"), "group_size", "digest", F.col("group_size").alias("__n"))
        return skewless_left_join(x, found, ["bucket", "h", "slot"], "__n", self.rows)


def exact_groups(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    return _judged(docs, capacity).select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", F.col("digest").alias("text_sha256"))


def _judged(docs: DataFrame, capacity: int) -> DataFrame:
    found = Index(docs, capacity).find(keyed(docs))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("most")))


def drop_duplicates(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Only what goes is joined, so that rows stay in place where that is small."""
    gone = _judged(docs, capacity).filter(~F.col("kept")).select(F.col("doc_id").alias("__gone"), F.col("raw").alias("__raw")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("__id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("__h"))
    return rows.join(stored(gone, "exact-gone"), F.col("__id").eqNullSafe(F.col("__gone")) & (F.col("__h") == F.col("__raw")), "left_anti").select("row.*")
