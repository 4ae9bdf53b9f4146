"""Exact duplicates: a minimal perfect hash over the distinct digests of earlier rows, in shards; new rows are looked up in it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import field, materialize, table

#: Digests of one shard, about.
SHARD = 20_000
#: Bits of a level of the hash for each key that is left.
LOAD = 2
#: At most so many groups are broadcast: those with a share of all rows of at least one in HOT_GROUPS.
HOT_GROUPS, HOT_LEAST = 20_000, 64

_INDEX = T.StructType([
    field("shard", T.LongType()), field("shards", T.LongType()), field("sizes", T.ArrayType(T.LongType())), field("bits", T.BinaryType()),
    field("digests", T.BinaryType()), *[field(c, T.ArrayType(T.LongType())) for c in ("ids", "rows", "counts")],
])
_GROUPS = T.StructType([field("digest", T.BinaryType()), *[field(c, T.LongType()) for c in ("keep_id", "keep_row", "group_size")], field("member", T.BooleanType())])


def _words(digests: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(digests).view("<u8")


def _places(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """The bit of each key (its 64-bit words) at a level of `size` bits. All words take part, by other odd factors each level."""
    odd = np.random.default_rng(level).integers(0, 1 << 63, words.shape[1], np.uint64) * np.uint64(2) + np.uint64(1)
    h = (words * odd).sum(axis=1, dtype=np.uint64)
    return ((h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) % np.uint64(size)


class PerfectHash:
    """n distinct keys to the numbers 0 to n - 1. At each level a key whose bit no other key claims has its place; the
    others go on to the next, smaller level. The number of a key is the count of set bits before its own."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.before = np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])

    @classmethod
    def build(cls, digests: np.ndarray) -> PerfectHash:
        words, sizes, levels = _words(digests), [], []
        while len(words):
            size = LOAD * len(words) + 1
            at = _places(words, len(sizes), size).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            words = words[~alone[at]]
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, bool))

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """The number of each key; for others any number, or -1."""
        words, out = _words(digests), np.full(len(digests), -1, np.int64)
        left, start = np.arange(len(digests)), 0
        for level, size in enumerate(self.sizes):
            at = start + _places(words[left], level, size).astype(np.int64)
            hit = self.bits[at]
            out[left[hit]] = self.before[at[hit]]
            left, start = left[~hit], start + size
        return out


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def _built(group: pa.Table) -> pa.Table:
    digests = _matrix(group["digest"])
    mph = PerfectHash.build(digests)
    order = np.argsort(mph.slots(digests))
    in_order = group.take(pa.array(order))
    return pa.table([[v] for v in (group["shard"][0].as_py(), group["shards"][0].as_py(), mph.sizes, np.packbits(mph.bits).tobytes(), digests[order].tobytes(), *[in_order[c].to_pylist() for c in ("doc_id", "row", "n")])], schema=pa.schema([(f.name, _arrow(f.dataType)) for f in _INDEX]))


def _arrow(t: T.DataType) -> pa.DataType:
    return pa.list_(pa.int64()) if isinstance(t, T.ArrayType) else {T.LongType: pa.int64(), T.BinaryType: pa.binary(), T.BooleanType: pa.bool_()}[type(t)]


def _looked_up(index: pa.Table, new: pa.Table) -> pa.Table:
    """The groups of one shard: slots with the copies that came, and those of digests that no slot holds."""
    slots = index.num_rows
    known = np.frombuffer(index["digests"][0].as_py(), np.uint8).reshape(-1, 32) if slots else np.zeros((0, 32), np.uint8)
    ids, rows, counts = ([*index[c][0].as_py()] if slots else [] for c in ("ids", "rows", "counts"))
    came = _matrix(new["digest"])
    if slots:
        sizes = index["sizes"][0].as_py()
        at = PerfectHash(sizes, np.unpackbits(np.frombuffer(index["bits"][0].as_py(), np.uint8))[: sum(sizes)].astype(bool)).slots(came)
        member = (at >= 0) & (known[at] == came).all(axis=1)  # a slot counts only if all bytes of its digest are the same
    else:
        at, member = np.full(len(came), -1), np.zeros(len(came), bool)
    order = lambda i, r: (i is not None, i if i is not None else 0, r)
    news = list(zip(*[new[c].to_pylist() for c in ("doc_id", "row", "n")], strict=True)) if len(came) else []
    for k in np.flatnonzero(member):
        s, (i, r, n) = at[k], news[k]
        counts[s] += n
        if order(i, r) > order(ids[s], rows[s]):
            ids[s], rows[s] = i, r
    rest = np.flatnonzero(~member)
    out = [[*map(bytes, known), *(came[k].tobytes() for k in rest)], *[[*old, *(news[k][c] for k in rest)] for c, old in enumerate((ids, rows, counts))], [True] * len(known) + [False] * len(rest)]
    return pa.table(out, schema=pa.schema([(f.name, _arrow(f.dataType)) for f in _GROUPS]))


def digested(docs: DataFrame) -> DataFrame:
    """(doc_id, row, digest) of each row, written: row is a number of its own, the locator; null text counts as empty."""
    return materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("digest")))


def _distinct(rows: DataFrame, shards: int) -> DataFrame:
    """One row for each digest: the winner's id and locator and the number of copies. Tasks combine copies before the shuffle."""
    best = rows.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("best"), F.count(F.lit(1)).alias("n"))
    return best.select("digest", "best.doc_id", "best.row", "n", F.pmod(F.xxhash64("digest"), F.lit(shards)).alias("shard"), F.lit(shards).cast("long").alias("shards"))


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """The index of digested rows: one row a shard with the perfect hash, and by slot the full digest, the winner's
    doc_id and locator, and the copies so far. It can be written and used again with `look_up`. Digests spread evenly over
    shards, and copies are combined before, so that no shard is hot."""
    return _distinct(history, shards).groupBy("shard").applyInArrow(_built, _INDEX)


def look_up(index: DataFrame, new: DataFrame, shards: int) -> DataFrame:
    """(digest, keep_id, keep_row, group_size, member) of every digest of the index or of the digested rows `new`. A
    digest is a member if the slot that its hash gives holds the same 32 bytes; nonmembers make groups of their own."""
    return index.groupBy("shard").cogroup(_distinct(new, shards).groupBy("shard")).applyInArrow(_looked_up, _GROUPS)


def exact_dedup(rows: DataFrame, earlier: Column) -> DataFrame:
    """rows (as `digested` gives them) with keep_id, group_size and kept.

    Rows for which `earlier` is true are the history; their distinct digests are the keys of the index, in which all
    other rows are looked up. Of equal texts the row with the largest doc_id stays; null ids are less than any, and of
    rows with the same id the one with the largest locator stays, so exactly one row of each group is kept. Where all ids
    are null, keep_id is null. An empty table gives no rows.
    Groups that make up a large share of all rows come to their rows by a broadcast of at most HOT_GROUPS groups (that many can have such a
    share), the others by a join on the digest; single rows need no group.
    """
    total = rows.count()
    shards = max(1, -(-total // SHARD))
    index = materialize(build_index(rows.where(earlier), shards))
    groups = materialize(look_up(index, rows.where(~F.coalesce(earlier, F.lit(False))), shards).where("group_size > 1"))
    least = max(HOT_LEAST, -(-total // HOT_GROUPS))
    found = groups.select("digest", "keep_id", "keep_row", "group_size")
    marked = rows.join(F.broadcast(found.where(F.col("group_size") >= least)), "digest", "left")
    hot = marked.where("group_size is not null")
    cold = marked.where("group_size is null").select(*rows.columns).join(found.where(F.col("group_size") < least), "digest", "left")
    single = F.col("group_size").isNull()
    return hot.unionByName(cold).select(
        "doc_id", F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("row") == F.col("keep_row"))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op11_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """The lower half of the range of ids is the history."""
    rows = digested(table(spark, sf_dir, "documents"))
    lo, hi = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    return exact_dedup(rows, F.coalesce(F.col("doc_id") <= F.lit(((lo or 0) + (hi or 0)) // 2).cast("long"), F.lit(False)))


ORACLE_SQL = """
select doc_id, max(doc_id) over (partition by coalesce(text, '')) as keep_id, count(*) over (partition by coalesce(text, '')) as group_size,
 row_number() over (partition by coalesce(text, '') order by doc_id desc nulls last) = 1 as kept, sha256(coalesce(text, '')) as text_sha256 from documents
"""
