"""Interpolated modified Kneser-Ney models over byte n-grams: sharded counts, joins for their tables, scores by shards of the model."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import SLICE_ROWS, field, materialize, with_arrow, without

#: An n-gram of `ORDER` bytes is packed in a long, the last byte lowest. Texts begin after ORDER - 1 zero bytes.
ORDER = 5
#: Log probabilities are whole ten-thousandths of a nat, so that sums don't depend on the order of addition.
UNIT = 10_000
#: Entries (12 bytes each) of the models that a worker holds at a time: larger models go over the texts shard by shard.
MODEL_ROWS = 6_000_000
#: Texts fall in FOLDS parts by their hash (column `fold`); each part's trusted texts make a model of its own.
FOLDS = 2
#: Bytes of text that a worker takes at a time, and different n-grams after which it hands on its counts.
SLICE, FLUSH = 1 << 19, 1_000_000


def grams(texts, wanted=None) -> list:
    """Yields (keys, place of each text's first key, places of texts) for slices of the (wanted) texts: the packed n-gram that ends at each byte."""
    own, places, held = [], [], 0
    for i, text in enumerate(texts):
        raw = b"\0" * (ORDER - 1) + text.encode() if text and (wanted is None or wanted[i]) else b""
        for lo in range(0, max(0, len(raw) - ORDER + 1), SLICE):
            part = raw[lo : lo + SLICE + ORDER - 1]
            own.append(part)
            places.append(i)
            held += len(part)
            if held >= SLICE:
                yield _keys(own), places
                own, places, held = [], [], 0
    if own:
        yield _keys(own), places


def _keys(parts: list[bytes]):
    b = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64)
    n = len(b) - ORDER + 1
    key = b[:n].copy()
    for k in range(1, ORDER):
        key = key << 8 | b[k : n + k]
    size = np.array([len(p) for p in parts])
    begin = np.cumsum(size) - size
    inside = np.ones(n, bool)
    for k in range(1, ORDER):  # windows that would run into the next text
        at = begin[1:] - k
        inside[at] = False
    return key[inside], np.concatenate([[0], np.cumsum(size[:-1] - ORDER + 1)]).astype(np.int64)


def with_fold(docs: DataFrame) -> DataFrame:
    """docs with __fold__: equal texts fall in one part."""
    return docs.withColumn("__fold__", F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(FOLDS)).cast("int"))


COUNTED = T.StructType([field("key", T.LongType()), field("n", T.LongType())])


def counts(docs: DataFrame) -> DataFrame:
    """(f, key, c) of all n-grams of the texts of each fold. Each task adds up its own before the shuffle, a bounded number at a time."""

    def run(batches):
        keys, ns = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch, lo in ((b, i) for b in batches for i in range(0, b.num_rows, SLICE_ROWS)):
            texts, folds = batch.column(0).slice(lo, SLICE_ROWS).to_pylist(), batch.column(1).slice(lo, SLICE_ROWS).to_numpy()
            for f in range(FOLDS):
                for (new, _), _ in grams([t for t, own in zip(texts, folds) if own == f]):
                    u, c = np.unique(new | f << 8 * ORDER, return_counts=True)
                    both, inv = np.unique(np.concatenate([keys, u]), return_inverse=True)
                    ns = np.bincount(inv, weights=np.concatenate([ns, c]), minlength=len(both)).astype(np.int64)
                    keys = both
                    if len(keys) > FLUSH:
                        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ns)], names=["key", "n"])
                        keys, ns = keys[:0], ns[:0]
        if len(keys):
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ns)], names=["key", "n"])

    both = docs.select("text", "__fold__").mapInArrow(run, COUNTED).groupBy("key").agg(F.sum("n").alias("c"))
    return both.select(F.shiftright("key", 8 * ORDER).cast("int").alias("f"), F.col("key").bitwiseAND(F.lit((1 << 8 * ORDER) - 1)).alias("key"), "c")


def shard_of(key, shards: int):
    """The shard of the entries of order 3 and more that the n-gram `key` needs (of a context: that of key << 8): by the two bytes before
    the last, which every shorter form of it from order 3 on ends with too. Entries of orders 1 and 2 are in every shard."""
    return ((key >> 8 & 0xFFFF) * 40503 >> 4 & 0xFFF) % shards


class Model:
    """One model for each fold. probs[k]: (f, key, q) for the n-grams seen of order k; gammas[k]: (f, ctx, g) of their contexts; base: q of
    an unseen byte after its gamma. All q and g are in UNITs of the logarithm."""

    def __init__(self, probs: dict[int, DataFrame], gammas: dict[int, DataFrame]):
        self.probs, self.gammas, self.base = probs, gammas, round(UNIT * math.log(1 / 256))

    @classmethod
    def train(cls, trusted: DataFrame) -> Model:
        """From texts with __fold__. Counts of order ORDER from the texts; a lower order counts the different bytes that come before.
        Discounts come from the counts of counts of each order (four numbers). Every table is joined and grouped by n-gram or
        context, in shards; nothing of it is held by one task or the driver."""
        tables = {ORDER: materialize(counts(trusted))}
        for k in range(ORDER - 1, 0, -1):
            tables[k] = materialize(tables[k + 1].groupBy("f", F.col("key").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("key")).agg(F.count(F.lit(1)).alias("c")))
        probs, gammas, lower = {}, {}, None
        for k in range(1, ORDER + 1):
            of = {(r["f"], r["c"]): r["count"] for r in tables[k].where("c <= 4").groupBy("f", "c").count().collect()}
            cut = F.lit(None).cast("double")
            for f in range(FOLDS):
                d = discounts(*[of.get((f, i), 0) for i in (1, 2, 3, 4)])
                cut = F.when(F.col("f") == f, F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])).otherwise(cut)
            seen = tables[k].select("f", "key", "c", F.shiftright("key", 8).alias("ctx"), cut.alias("d"))
            ctx = materialize(seen.groupBy("f", "ctx").agg(F.sum("c").alias("s"), F.sum(F.col("d")).alias("free")))
            gammas[k] = ctx.select("f", "ctx", F.round(F.log(F.col("free") / F.col("s")) * UNIT).cast("int").alias("g"))
            own = seen.join(ctx, ["f", "ctx"]).select("f", "key", ((F.col("c") - F.col("d")) / F.col("s")).alias("p"), (F.col("free") / F.col("s")).alias("gamma"))
            if lower is None:
                own = own.select("f", "key", (F.col("p") + F.col("gamma") / 256).alias("p"))
            else:
                own = own.withColumn("low", F.col("key").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1))).join(lower.select("f", F.col("key").alias("low"), F.col("p").alias("pl")), ["f", "low"]).select("f", "key", (F.col("p") + F.col("gamma") * F.col("pl")).alias("p"))
            lower = materialize(own)
            probs[k] = lower.select("f", "key", F.round(F.log("p") * UNIT).cast("int").alias("q"))
        return cls(probs, gammas)

    def rows(self) -> DataFrame:
        """(t, f, key, v): the entries of all tables; t is twice the order, and one more for a context's gamma."""
        out = None
        for k in self.probs:
            for kind, df in ((0, self.probs[k].toDF("f", "key", "v")), (1, self.gammas[k].toDF("f", "key", "v"))):
                df = df.select(F.lit(2 * k + kind).alias("t"), "f", "key", "v")
                out = df if out is None else out.unionByName(df)
        return out

    def score(self, docs: DataFrame, model_rows: int = MODEL_ROWS) -> DataFrame:
        """docs (with text and __fold__) with n_bytes and nll (UNITs, the whole text's), each by the model of the next fold, which has
        not counted it. The models are cut in shards of about `model_rows` entries at most, and each shard goes over the texts by
        itself and adds up the n-grams that end in its entries; one shard is enough for a small model. No n-gram is shuffled: with
        several shards a row's partial sums are added by a number of the row."""
        docs = without(docs, "n_bytes", "nll")
        rows = self.rows()
        total = rows.count()
        if total <= model_rows:
            return self._pass(docs, rows, 1, 0)
        shards = -(-2 * total // model_rows)
        docs = materialize(without(docs, "__rid__").withColumn("__rid__", F.monotonically_increasing_id()))
        of = F.when(F.col("t") < 6, -1).otherwise(F.pmod(F.shiftright(F.when(F.col("t") % 2 == 0, F.shiftright("key", 8)).otherwise(F.col("key")).bitwiseAND(F.lit(0xFFFF)) * 40503, 4).bitwiseAND(F.lit(0xFFF)), F.lit(shards)))
        rows = materialize(rows.withColumn("shard", of.cast("int")))
        parts = None
        for s in range(shards):
            part = materialize(self._pass(docs.select("__rid__", "text", "__fold__"), rows.where(F.col("shard").isin(-1, s)).drop("shard"), shards, s).drop("text", "__fold__"))
            parts = part if parts is None else parts.unionByName(part)
        sums = materialize(parts.groupBy("__rid__").agg(F.max("n_bytes").alias("n_bytes"), F.sum("nll").alias("nll")))
        return docs.join(sums, "__rid__").drop("__rid__")

    def _pass(self, docs: DataFrame, rows: DataFrame, shards: int, shard: int) -> DataFrame:
        held = rows.toArrow()
        t, f, key, v = (held.column(c).to_numpy() for c in ("t", "f", "key", "v"))
        tables = []
        for own in range(FOLDS):
            tables.append({})
            for x in range(2, 2 * ORDER + 2):
                at = np.flatnonzero((t == x) & (f == own))
                at = at[np.argsort(key[at])]
                tables[own][x] = key[at], v[at].astype(np.int32)
        shared, base = docs.sparkSession.sparkContext.broadcast(tables), self.base

        def start():
            look = [Lookup(x, base) for x in shared.value]

            def of(texts, folds):
                n, nll = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
                for fold in range(FOLDS):
                    for (keys, begin), places in grams(texts, [own == fold for own in folds]):
                        use = look[(fold + 1) % FOLDS]
                        if shards == 1:
                            q = use(keys)
                        else:
                            q, own = np.zeros(len(keys), np.int64), shard_of(keys, shards) == shard
                            q[own] = use(keys[own])
                        np.add.at(n, places, np.diff(np.append(begin, len(keys))))
                        np.add.at(nll, places, -np.add.reduceat(q, begin))
                return n.tolist(), nll.tolist()

            return of

        return with_arrow(docs, start, ["text", "__fold__"], [field("n_bytes", T.LongType()), field("nll", T.LongType())])


class Lookup:
    """Log probabilities of packed n-grams by binary search, order by order, behind a direct-mapped cache."""

    def __init__(self, tables: dict, base: int, bits: int = 19):
        self.t, self.base, self.bits = tables, base, bits
        self.keys, self.vals = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).view(np.int64)
        out = self.vals[slot]
        miss = np.flatnonzero(self.keys[slot] != keys)
        if len(miss):
            new, inv = np.unique(keys[miss], return_inverse=True)
            val = self.exact(new)
            out[miss] = val[inv]
            at = (new.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).view(np.int64)
            # of keys with one slot the last written pair must stay a pair
            at, first = np.unique(at, return_index=True)
            self.keys[at], self.vals[at] = new[first], val[first]
        return out

    def exact(self, keys: np.ndarray) -> np.ndarray:
        out, open_, cur = np.zeros(len(keys), np.int64), np.arange(len(keys)), keys
        for k in range(ORDER, 0, -1):
            q, hit = self._find(2 * k, cur)
            out[open_[hit]] += q[hit]
            open_, cur = open_[~hit], cur[~hit]
            g, has = self._find(2 * k + 1, cur >> 8)
            out[open_] += np.where(has, g, 0)
            cur = cur & ((1 << 8 * (k - 1)) - 1)
        out[open_] += self.base
        return out

    def _find(self, table: int, keys: np.ndarray):
        have, v = self.t[table]
        if not len(have) or not len(keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
        return v[at].astype(np.int64), have[at] == keys


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """D1, D2 and D3+ of modified Kneser-Ney; where counts of counts are missing or odd, 1/2, 1 and 3/2."""
    if min(n1, n2, n3, n4) == 0:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(x if 0 < x < i + 1 else (i + 1) / 2 for i, x in enumerate(d))
