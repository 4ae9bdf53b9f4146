"""Embedding near-duplicates: random-hyperplane sign hashing in several tables, exact cosines, components."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import field, join_checked, materialize, table
from .components import connected_components

#: Members of a bucket that are compared as one block.
CHUNK = 2048
#: Signs of the sketch by which members of a bucket are compared before vectors are fetched.
SKETCH = 64


def plan(n: int, threshold: float = 0.95, miss: float = 5e-4) -> tuple[int, int]:
    """(bits, tables): bits grow with log2 of the number of different vectors, so that chance buckets stay small; tables
    then follow from the share `miss` of pairs at the threshold itself that may share no bucket (closer pairs: fewer)."""
    bits = min(30, max(8, math.ceil(math.log2(max(n, 2))) - 4))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - same))


def allowed(threshold: float, miss: float) -> int:
    """The least number of sketch signs that more than `miss` of the pairs at the threshold never exceed in differing."""
    share, left, d = math.acos(threshold) / math.pi, 1.0, -1
    while left > miss:
        d += 1
        left -= math.comb(SKETCH, d) * share**d * (1 - share) ** (SKETCH - d)
    return d


def planes(dim: int, bits: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, bits * tables)).astype(np.float32)


def _unit(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _hub(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix the least id of its component."""
    out, left = ids.copy(), linked.any(axis=1)
    while left.any():
        front = np.zeros(len(ids), bool)
        front[np.argmax(left)] = True
        seen = front.copy()
        while front.any():
            reach = linked[front].any(axis=0) & ~seen
            seen |= reach
            front = reach
        out[seen] = ids[seen].min()
        left &= ~seen
    return out


def _block(t, a, nid, m, x, sigs, threshold):
    """(nid, links, hub) of one block: unit rows x of one bucket, all of one chunk or of two (a: those of the first). A pair counts in
    the first table whose bucket both share, and in no later one."""
    b = ~a if not a.all() else a
    full = np.zeros((len(nid), len(nid)), bool)
    rows, cols = np.flatnonzero(a), np.flatnonzero(b)
    for lo in range(0, len(rows), 512):
        part = rows[lo : lo + 512]
        near = x[part] @ x[cols].T >= threshold
        if near.any():
            for e in range(t):
                near &= sigs[part, e][:, None] != sigs[cols, e][None, :]
            full[np.ix_(part, cols)] = near
    full |= full.T
    np.fill_diagonal(full, False)
    hit = full.any(axis=1)
    if not hit.any():
        return None
    links = np.concatenate([full[lo : lo + 512] @ m for lo in range(0, len(nid), 512)])
    return nid[hit], links[hit], _hub(full, nid)[hit]


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, seed: int = 7, miss: float = 5e-4, chunk: int = CHUNK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding), repeated rows too.

    Equal vectors become one node, so copies cost nothing and never pair. Nodes with equal signs in a table share a
    bucket. A bucket is cut in chunks of about `chunk` members, and each pair of chunks is a block of its own, so one
    bucket, however hot, spreads over many tasks and every pair in it is compared. That is done in two steps. Only ids and a sketch
    of SKETCH signs go to the blocks first; members without another within `allowed` signs leave. Vectors are then
    fetched by id for the rest: a block's cosines are matrix products in double precision, and it yields counts and a spanning
    edge for each member, never its pairs.
    Null or zero vectors, and those with null or non-finite components, link with nothing: n_links 0, a component of
    their own, kept. Vectors of different lengths never link. An empty table gives no rows.
    """
    wide = "<f4" if isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType) else "<f8"
    raw_schema = T.StructType([vectors.schema["vec_id"], field("raw", T.BinaryType())])

    def parse(batches):
        for batch in batches:
            raw = []
            for v in batch.column(1):
                v = v.as_py()
                ok = bool(v) and None not in v and all(map(math.isfinite, v)) and any(v)
                raw.append((np.array(v, wide) + np.array(0, wide)).tobytes() if ok else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=raw_schema.names)

    rows = materialize(vectors.select("vec_id", "embedding").mapInArrow(parse, raw_schema))
    nodes = materialize(rows.where("raw is not null").groupBy("raw").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("m")).withColumn("nid", F.monotonically_increasing_id()))
    bits, tables = plan(nodes.count(), threshold, miss)
    hash_schema = T.StructType([field("nid", T.LongType()), field("sketch", T.LongType()), field("keys", T.ArrayType(T.LongType()))])

    def hashed(batches):
        hasher = Hasher(bits, tables, seed)
        for batch in batches:
            raws = batch.column(1).to_pylist()
            keys, marks = np.empty((len(raws), tables), np.int64), np.empty(len(raws), np.int64)
            for at, x in _by_length(raws, wide):
                sigs, dim = hasher.signs(x), x.shape[1]
                # table, length and signs in one number
                keys[at] = sigs | (np.arange(tables) << 52) ^ ((dim & 0xFFFFF) << 32)
                marks[at] = hasher.sketch(x)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, tables, dtype=np.int32)), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks), flat], names=hash_schema.names)

    members = nodes.select("nid", "raw").mapInArrow(hashed, hash_schema).select("nid", "sketch", F.explode("keys").alias("key"))
    crowded = members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    cut = members.join(crowded, "key").withColumn("chunks", F.ceil(F.col("size") / chunk).cast("int")).withColumn("own", F.pmod(F.xxhash64("nid"), "chunks").cast("int"))
    pairs = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
    keys, distance = ["key", "lo", "hi"], allowed(threshold, miss / 5)
    where_schema = T.StructType([field("key", T.LongType()), *[field(c, T.IntegerType()) for c in ("lo", "hi", "own")], field("nid", T.LongType())])
    close = pairs.select(*keys, "own", "nid", "sketch").repartition(*keys).sortWithinPartitions(*keys)
    asked = materialize(close.mapInArrow(lambda batches: _streamed(batches, chunk, lambda part: _near(part, distance)), where_schema))
    blocks = asked.join(nodes.select("nid", "m", "raw"), "nid").select(*keys, "own", "nid", "m", "raw").repartition(*keys).sortWithinPartitions(*keys)
    out = T.StructType([field("nid", T.LongType()), field("links", T.LongType()), field("hub", T.LongType())])

    def compare(batches):
        hasher = Hasher(bits, tables, seed)
        yield from _streamed(batches, chunk, lambda part: _exact(part, threshold, wide, hasher))

    found = materialize(blocks.mapInArrow(compare, out))
    comp = connected_components(found.select(F.col("nid").alias("a"), F.col("hub").alias("b")))
    linked = nodes.join(found.groupBy("nid").agg(F.sum("links").alias("links")), "nid", "left").join(comp.withColumnRenamed("node", "nid"), "nid", "left")
    rooted = materialize(linked.select("raw", "rep", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "nid").alias("root")))
    least = materialize(rooted.groupBy("root").agg(F.min("rep").alias("component_id")))
    named = materialize(join_checked(rooted, least, "root", "inner").select("raw", "n_links", "component_id"))
    got = rows.join(named, "raw", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("raw").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return got.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("vec_id").eqNullSafe(F.col("component_id"))))


class Hasher:
    """Signs of unit vectors on each side of random hyperplanes, the same in every task."""

    def __init__(self, bits: int, tables: int, seed: int):
        self.bits, self.tables, self.seed, self.known = bits, tables, seed, {}

    def _planes(self, dim: int):
        if dim not in self.known:
            self.known[dim] = planes(dim, self.bits, self.tables, self.seed), planes(dim, SKETCH, 1, self.seed + 1)
        return self.known[dim]

    def signs(self, x: np.ndarray) -> np.ndarray:
        """(n, tables): the signs of each table as a number."""
        out = np.empty((len(x), self.tables), np.int64)
        for lo in range(0, len(x), 1024):
            part = x[lo : lo + 1024]
            out[lo : lo + 1024] = (part @ self._planes(x.shape[1])[0] >= 0).reshape(len(part), self.tables, self.bits) @ (1 << np.arange(self.bits, dtype=np.int64))
        return out

    def sketch(self, x: np.ndarray) -> np.ndarray:
        return np.packbits(x @ self._planes(x.shape[1])[1] >= 0, axis=1, bitorder="little").view("<i8")[:, 0]


def _by_length(raws: list[bytes], kind: str):
    """(places, unit vectors) of the vectors of each length."""
    size = np.array([len(r) for r in raws], np.int64)
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        yield at, _unit([raws[i] for i in at], kind)


def _streamed(batches, chunk: int, done):
    """done(table) of whole groups of the first three columns, a bounded number of rows at a time."""
    rest = None
    for batch in batches:
        for lo in range(0, batch.num_rows, 4 * chunk):
            part = pa.Table.from_batches([batch.slice(lo, 4 * chunk)])
            rest = part if rest is None else pa.concat_tables([rest, part])
            ks = np.stack([rest.column(i).to_numpy() for i in range(3)], 1)
            new = np.flatnonzero((ks[1:] != ks[:-1]).any(axis=1)) + 1
            if len(new):
                yield from done(rest.slice(0, int(new[-1])))
                rest = rest.slice(int(new[-1]))
    if rest is not None and rest.num_rows:
        yield from done(rest)


def _groups(part: pa.Table):
    """(first row, end, whether each row is of the first chunk) of the blocks; one of two chunks whose rows are all of one is that chunk's
    own block again."""
    ks = np.stack([part.column(i).to_numpy() for i in range(3)], 1)
    own = part.column(3).to_numpy()
    edges = [0, *(np.flatnonzero((ks[1:] != ks[:-1]).any(axis=1)) + 1).tolist(), len(ks)]
    for lo, hi in zip(edges, edges[1:]):
        first = own[lo:hi] == ks[lo, 1]
        if hi - lo > 1 and (ks[lo, 1] == ks[lo, 2] or not (first.all() or not first.any())):
            yield lo, hi, first


def _near(part: pa.Table, distance: int):
    """The rows (without sketch) that have another one of their block's other chunk within the distance."""
    sketch, hit = part.column(5).to_numpy().view(np.uint64), np.zeros(part.num_rows, bool)
    for lo, hi, first in _groups(part):
        a = lo + np.flatnonzero(first)
        b = a if first.all() else lo + np.flatnonzero(~first)
        for at in range(0, len(a), 512):
            rows = a[at : at + 512]
            near = np.bitwise_count(sketch[rows][:, None] ^ sketch[b][None, :]) <= distance
            if first.all():
                near[np.arange(len(rows)), at + np.arange(len(rows))] = False
            hit[rows] |= near.any(axis=1)
            hit[b] |= near.any(axis=0)
    kept = part.select(range(5)).filter(pa.array(hit)).combine_chunks()
    yield from kept.to_batches()


def _exact(part: pa.Table, threshold: float, wide: str, hasher: Hasher):
    table = part.column(0).to_numpy() >> 52
    nid, m = (part.column(i).to_numpy() for i in (4, 5))
    for lo, hi, first in _groups(part):
        order = np.argsort(nid[lo:hi])
        raw = part.column(6).slice(lo, hi - lo).to_pylist()
        t, x = int(table[lo]), _unit([raw[i] for i in order], wide)
        got = _block(t, first[order], nid[lo:hi][order], m[lo:hi][order], x, hasher.signs(x)[:, :t], threshold)
        if got:
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in got], names=["nid", "links", "hub"])


def op4_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


#: Every pair by brute force; components by the least id that spreads.
ORACLE_SQL = """
with recursive v as (select row_number() over () as k, vec_id, embedding::double[] as e, embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0 as ok from embeddings),
 p as (select a.k as a, b.k as b from v a join v b on a.k <> b.k and a.ok and b.ok and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.95),
 r(n, m) as (select k, vec_id from v union select p.a, r.m from r join p on p.b = r.n), c as (select n, min(m) as m from r group by n)
select v.vec_id, (select count(*) from p where p.a = v.k) as n_links, c.m as component_id, v.vec_id = c.m as kept from v join c on c.n = v.k
"""
