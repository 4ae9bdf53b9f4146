"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, Hamming verification, components."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .common import discard, field, freed, join_checked, materialize, table, with_arrow, written_rows
from .components import connected_components

#: Buckets of up to so many different fingerprints are joined with themselves; larger ones go by midpoints.
PAIR_BUCKET = 64
#: Fingerprint bits fall in 4 blocks of 16; two that differ at 2 bits or fewer agree on 2 blocks at least.
BLOCKS = 4
#: Where candidates fail: the 64-bit words of the fingerprints that nodes are looked at by again.
LONGER = 32
#: Standard deviations of the Hamming estimate within which a pair is a candidate.
SLACK = 2.0
#: Bits of a fingerprint that go to the blocks.
SKETCH = 128
#: Bytes of sets in a chunk of a family, about; and the columns of hashes that a task counts at a time.
CHUNK_BYTES, COLUMNS = 4 << 20, 4096


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit fingerprint of a text; no words (or null): 0."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    n = max(1, len(words) - width + 1)
    last = ends[min(width, len(words)) - 1 :] - 1
    hash_of = xxhash.xxh64_intdigest
    ones, count = np.zeros(64, np.int64), n
    for k in range(0, n, 1 << 16):  # bounded memory on very long texts
        part = [hash_of(flat[i:j], seed) for i, j in zip(starts[k : min(n, k + (1 << 16))].tolist(), last[k : k + (1 << 16)].tolist())]
        ones += bit_sums(np.array(part, "<u8").reshape(-1, 1))
    return int(np.packbits(ones * 2 > count, bitorder="little").view("<u8")[0])


def bit_sums(words: np.ndarray) -> np.ndarray:
    """How many rows of (n, k) 64-bit words have each of the 64 k bits set. Sums of 255 rows fit a byte."""
    out = np.zeros(words.shape[1] * 64, np.int64)
    raw = np.ascontiguousarray(words, "<u8").view(np.uint8)
    for i in range(0, len(raw), 255):
        out += np.unpackbits(raw[i : i + 255], axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return out


def shingle_set(text: str | None, width: int, seed: int = 42) -> np.ndarray:
    """The different shingle hashes of a text, in order."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    n, hash_of = max(1, len(words) - width + 1), xxhash.xxh64_intdigest
    last = ends[min(width, len(words)) - 1 :] - 1
    return np.unique(np.fromiter((hash_of(flat[i:j], seed) for i, j in zip(starts[:n].tolist(), last.tolist())), np.uint64, n))


def set_fingerprint(h: np.ndarray, words: int) -> bytes:
    """64 * words bits over a set of shingle hashes; each hash gives as many bits by mixing. Of an empty set: all zero."""
    if not len(h):
        return bytes(8 * words)
    ones = np.zeros(64 * words, np.int64)
    for lo in range(0, len(h), 1 << 14):
        m = h[lo : lo + (1 << 14), None] + np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        m = (m ^ (m >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        m = (m ^ (m >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        ones += bit_sums(m ^ (m >> np.uint64(31)))
    return np.packbits(2 * ones > len(h), bitorder="little").tobytes()


def long_fingerprint(text: str | None, width: int, words: int, seed: int = 42) -> bytes:
    """The fingerprint of a text's set of shingles. No words: all zero."""
    return set_fingerprint(shingle_set(text, width, seed), words)


def with_fingerprints(docs: DataFrame, width: int = 3, seed: int = 42, column: str = "_fp") -> DataFrame:
    """docs with the fingerprint as a signed long."""

    def start():
        return lambda texts: [[v - (1 << 64) if v >> 63 else v for v in (fingerprint(t, width, seed) for t in texts)]]

    return with_arrow(docs, start, ["text"], [field(column, T.LongType())])


def links(fps: DataFrame, distance: int = 2, pair_bucket: int = PAIR_BUCKET) -> DataFrame:
    """Edges (a, b) between different fingerprints `fp` that differ at `distance` bits or fewer (2 at most), enough to
    connect whatever such pairs connect.

    Each fingerprint enters one bucket for each pair of its 4 blocks (32 equal bits), so a linked pair meets in one
    bucket at least. Buckets of up to `pair_bucket` members are joined with themselves and every pair is verified. In a
    larger bucket pairs would be too many: there each member goes to the 33 values that its other 32 bits take when
    at most one of them flips. Two members within 2 bits share such a value, and whatever shares one is within 2 bits; so
    linking each to the least member that shares the value (verified again) loses no connection and stays linear.
    """
    if distance > 2:
        raise ValueError("midpoints of one flip bridge 2 bits")
    fp, size = F.col("fp"), 64 // BLOCKS
    masks = [sum(((1 << size) - 1) << (size * i) for i in c) for c in combinations(range(BLOCKS), 2)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    blocks = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), fp.bitwiseAND(F.lit(signed(m))).alias("key")) for i, m in enumerate(masks)]))
    members = fps.select("fp", blocks.alias("_b")).select("fp", "_b.t", "_b.key")
    crowded = materialize(members.groupBy("t", "key").agg(F.count(F.lit(1)).alias("m")).where("m > 1"))
    members = materialize(members.join(crowded, ["t", "key"]))
    near = lambda x, y: F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= distance
    few = members.where(F.col("m") <= pair_bucket)
    pairs = few.select("t", "key", fp.alias("a")).join(few.select("t", "key", fp.alias("b")), ["t", "key"]).where((F.col("a") < F.col("b")) & near("a", "b")).select("a", "b")
    free = F.element_at(F.array(*[F.array(*[F.lit(0).cast("long")], *[F.lit(signed(1 << i)) for i in range(64) if not m >> i & 1]) for m in masks]), F.col("t") + 1)
    spots = members.where(F.col("m") > pair_bucket).select("fp", "t", F.explode(free).alias("flip")).select("fp", "t", fp.bitwiseXOR(F.col("flip")).alias("spot"))
    hubs = spots.groupBy("t", "spot").agg(F.min("fp").alias("hub"), F.max("fp").alias("top")).where("hub <> top").select("t", "spot", "hub")
    stars = spots.join(hubs, ["t", "spot"]).where((fp != F.col("hub")) & near("fp", "hub")).select(F.col("hub").alias("a"), fp.alias("b"))
    return pairs.unionByName(stars)


def simhash_components(docs: DataFrame, width: int = 3, seed: int = 42, distance: int = 2, pair_bucket: int = PAIR_BUCKET) -> DataFrame:
    """(doc_id, _fp, component_id) for each row of docs, repeated rows too. component_id: the least doc_id that links
    reach (null if no linked row has one). Equal fingerprints are one node, so copies of a text add no pairs.
    Null or empty texts: fingerprint zero, linked like any other. An empty table gives no rows."""
    marked = materialize(with_fingerprints(docs.select("doc_id", "text"), width, seed).select("doc_id", "_fp"))
    nodes = materialize(marked.groupBy(F.col("_fp").alias("fp")).agg(F.min("doc_id").alias("rep")))
    comp = connected_components(links(nodes.select("fp"), distance, pair_bucket))
    rooted = nodes.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted)
    least = materialize(rooted.groupBy("root").agg(F.min("rep").alias("component_id")))
    named = materialize(join_checked(rooted, least, "root", "inner").select(F.col("fp").alias("_fp"), "component_id"))
    return marked.join(named, "_fp").select("doc_id", "_fp", "component_id")


def plan(n: int, bits: int, distance: int, miss: float) -> tuple[int, int]:
    """(bits of a block, blocks): blocks of so many bits that by chance some 64 of n fingerprints share one, and so many blocks that a
    pair at the distance itself shares none of them with the probability `miss` (closer pairs: far less). Comparisons inside a block
    are cheap next to another block for each row; the number of blocks grows as n to the power 0.24 at a similarity of 0.8."""
    size = min(48, max(12, math.ceil(math.log2(max(n, 2))) - 6))
    return size, math.ceil(math.log(miss) / math.log(1 - (1 - distance / bits) ** size))


def block_keys(raw: np.ndarray, size: int, blocks: int, seed: int) -> np.ndarray:
    """(n, blocks) keys of fingerprints (n, bytes): each block is a fixed choice of bits, below its number (from bit 48 on)."""
    rng = np.random.default_rng([seed, size])
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    out = np.empty((len(raw), blocks), np.int64)
    weight = 1 << np.arange(size, dtype=np.int64)
    for t in range(blocks):
        out[:, t] = (bits[:, rng.choice(bits.shape[1], size, replace=False)] @ weight) | (t << 48)
    return out


def allowed_distance(similarity: float, bits: int, slack: float = 1.0) -> int:
    """Differing bits of two sets of shingles with this Jaccard similarity: the angle between them over pi, and `slack` standard
    deviations of the estimate."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(bits * share + slack * math.sqrt(bits * share * (1 - share)))


def similar_groups(docs: DataFrame, width: int = 5, similarity: float = 0.8, words: int = 8, miss: float = 0.02, seed: int = 42, chunk: int = 512) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): docs with __rid__ (a number of the row), __set__ (digest of its shingles) and __fp__, written; and
    (__set__, __root__) for each digest: sets are linked where their Jaccard similarity is `similarity` or more, by count.

    At 0.8 some 15 of 100 fingerprint bits differ, so no split in disjoint blocks that are worth a join leaves one equal for sure.
    The fingerprint therefore has 64 * `words` bits and blocks are many choices of its bits (see plan). Pairs that meet in a block
    within the expected distance and SLACK standard deviations are candidates; each one that is used is verified on the sets
    themselves (see Linking). Equal sets are one node. Each block gives the closest candidates that connect what its candidates
    connect. Where some fail, the nodes of the groups that they keep apart are looked at again by LONGER fingerprints, and what any
    candidates connect is a family: its groups are compared whole, each set of one with each of another, by exact count (Linking.compare).
    Tasks do that on chunks of a family and give links that connect groups only, so no table holds the pairs of a family.
    Null and empty texts are copies of one another. An empty table gives no rows.
    """
    bits = 64 * words
    distance = allowed_distance(similarity, bits, SLACK)

    def marks():
        def of(texts):
            sets = [shingle_set(t, width, seed) for t in texts]
            return [xxhash.xxh3_128_digest(h.tobytes()) for h in sets], [set_fingerprint(h, words) for h in sets]

        return of

    marked = with_arrow(docs, marks, ["text"], [field("__set__", T.BinaryType()), field("__fp__", T.BinaryType())])
    rows = materialize(marked.withColumn("__rid__", F.monotonically_increasing_id()))
    nodes = materialize(rows.groupBy("__set__", F.col("__fp__").alias("_fp")).agg(F.min("__rid__").alias("nid")))
    size, blocks = plan(written_rows(nodes), bits, allowed_distance(similarity, bits), miss)
    found = candidates(nodes.select("nid", F.col("nid").alias("grp"), "_fp"), similarity, distance, size, blocks, seed, chunk)
    met = materialize(found.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    texts = join_checked(rows.select(F.col("__rid__").alias("node"), "text"), met, "node", "inner")
    sets = materialize(with_arrow(texts, lambda: lambda texts: [[shingle_set(t, width, seed).tobytes() for t in texts]], ["text"], [field("s", T.BinaryType())]).select("node", "s"))
    freed(docs.sparkSession)
    links = Linking(met, sets, similarity)
    links.take(found)
    discard(found)
    apart = links.apart()
    if written_rows(apart):
        longer = with_arrow(join_checked(sets, apart, "node", "inner"), lambda: lambda raw: [[set_fingerprint(np.frombuffer(x, np.uint64), LONGER) for x in raw]], ["s"], [field("_fp", T.BinaryType())])
        some = materialize(longer.select(F.col("node").alias("nid"), "grp", "_fp"))
        layout = plan(written_rows(some), 64 * LONGER, allowed_distance(similarity, 64 * LONGER), miss)
        more = candidates(some, similarity, allowed_distance(similarity, 64 * LONGER, SLACK), *layout, seed, chunk)
        links.compare(apart, more, chunk)
        discard(some, more)
        freed(docs.sparkSession)
    discard(apart)
    groups = materialize(links.rooted(nodes, "nid", "__root__").select("__set__", "__root__"))
    discard(nodes, met, sets, links.label, *links.written)
    return rows, groups


def candidates(nodes: DataFrame, similarity: float, distance: int, size: int, blocks: int, seed: int, chunk: int, nearest: int = 0) -> DataFrame:
    """(a, b, d), a < b: pairs of nodes (nid, grp, _fp) of different grp that share a block and differ at d <= distance bits: those of
    a least spanning forest of each bucket, or each node's `nearest` ones, with (nid, nid, 0) for nodes that have more. Only ids and 128 bits of the fingerprints go to the
    blocks; members without another that is close by these leave, and fingerprints are fetched by id for the rest. Sizes of
    buckets are summed in tasks before the shuffle. A bucket is cut in chunks, and each pair of chunks is compared by itself, so
    that hot buckets spread over tasks."""
    schema = T.StructType([field("nid", T.LongType()), field("s0", T.LongType()), field("s1", T.LongType()), field("keys", T.ArrayType(T.LongType()))])

    def keyed(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                raw = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(part.num_rows, -1)
                keys = block_keys(raw, size, blocks, seed)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, blocks, dtype=np.int32)), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(np.ascontiguousarray(raw[:, k : k + 8]).view("<i8")[:, 0]) for k in (0, 8)), flat], names=schema.names)

    members = nodes.select("nid", "_fp").mapInArrow(keyed, schema).select("nid", "s0", "s1", F.explode("keys").alias("key"))
    crowded = materialize(members.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1"))
    met = join_checked(members, crowded, "key", "inner")
    cut = met.withColumn("chunks", F.ceil(F.col("m") / chunk).cast("int")).withColumn("own", F.pmod(F.xxhash64("nid"), "chunks").cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})
    keys = ["key", "lo", "hi"]
    where = T.StructType([field("key", T.LongType()), field("lo", T.IntegerType()), field("hi", T.IntegerType()), field("nid", T.LongType())])
    near = allowed_distance(similarity, SKETCH, 3.5)
    by_block = cut.select(*keys, "nid", "s0", "s1").repartition(*keys).sortWithinPartitions(*keys)
    asked = materialize(by_block.mapInArrow(lambda batches: _streamed(batches, chunk, lambda part: _near(part, near)), where))
    sorted_blocks = join_checked(nodes, asked, "nid", "inner").select(*keys, "nid", "_fp", "grp").repartition(*keys).sortWithinPartitions(*keys)
    edge = T.StructType([field("a", T.LongType()), field("b", T.LongType()), field("d", T.LongType())])
    pick = (lambda part: _closest(part, distance, nearest)) if nearest else (lambda part: _spanning(part, distance))
    out = materialize(sorted_blocks.mapInArrow(lambda batches: _streamed(batches, chunk, pick), edge).distinct())
    discard(crowded, asked)
    return out


def _streamed(batches, chunk: int, done):
    """done(table) of whole groups of the first three columns, a bounded number of rows at a time."""
    rest = None
    for batch in batches:
        for lo in range(0, batch.num_rows, 8 * chunk):
            part = pa.Table.from_batches([batch.slice(lo, 8 * chunk)])
            rest = part if rest is None else pa.concat_tables([rest, part])
            ks = np.stack([rest.column(i).to_numpy() for i in range(3)], 1)
            new = np.flatnonzero((ks[1:] != ks[:-1]).any(axis=1)) + 1
            if len(new):
                yield from done(rest.slice(0, int(new[-1])))
                rest = rest.slice(int(new[-1]))
    if rest is not None and rest.num_rows:
        yield from done(rest)


def _near(part: pa.Table, distance: int):
    """The rows (key, lo, hi, nid) that have another one of their block within the distance by their 128 bits."""
    ks = np.stack([part.column(i).to_numpy() for i in range(3)], 1)
    s = np.stack([part.column(i).to_numpy().view(np.uint64) for i in (4, 5)], 1)
    edges = np.concatenate([[0], np.flatnonzero((ks[1:] != ks[:-1]).any(axis=1)) + 1, [len(ks)]])
    hit = np.zeros(len(ks), bool)
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
        own = s[lo:hi]
        for at in range(0, hi - lo, 512) if hi - lo > 1 else ():
            d = np.bitwise_count(own[at : at + 512, None] ^ own[None]).sum(axis=2, dtype=np.uint8)
            d[np.arange(len(d)), at + np.arange(len(d))] = 255
            hit[lo + at : lo + at + len(d)] = (d <= distance).any(axis=1)
    yield from part.select(range(4)).filter(pa.array(hit)).combine_chunks().to_batches()


class Linking:
    """Components of the pairs of nodes whose sets (node, s) have a Jaccard similarity of `similarity` or more. label: (node, root) of the
    nodes that have another root, the others are roots themselves; so what the driver broadcasts follows what was linked, not all nodes."""

    def __init__(self, nodes: DataFrame, sets: DataFrame, similarity: float):
        none = nodes.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
        self.label = materialize(none.toDF("node", "root"))
        self.sets, self.similarity, self.written, self.tried, self.n_tried = sets, similarity, [], none, 0

    def take(self, pairs: DataFrame) -> bool:
        """Verifies pairs (a, b, d); whether any was linked. A pair whose ends are connected already needs no look. First every
        node takes its closest candidate, then each pair of components theirs, so that a large group moves few sets; what is left
        then is for compare()."""
        grew, left = False, self.crossing(pairs)
        for turn in range(2):
            if not written_rows(left):
                break
            ends = [F.struct(F.col(x).alias("n"), F.col(y).alias("to"), "d", "a", "b", "ra", "rb") for x, y in (("ra", "rb"), ("rb", "ra"))]
            close = left.select(F.explode(F.array(*ends)).alias("e")).select("e.*") if turn == 0 else left.select(F.least("ra", "rb").alias("n"), F.greatest("ra", "rb").alias("to"), "d", "a", "b", "ra", "rb")
            close = close.groupBy("n", *(["to"] if turn else [])).agg(F.min(F.struct("d", "a", "b", "ra", "rb")).alias("e")).select("e.*").distinct()
            close = materialize(close.select("a", "b", "ra", "rb"))
            good = self.verified(close)
            self.written.append(close)
            self.tried, self.n_tried = self.tried.unionByName(close.select("a", "b")), self.n_tried + written_rows(close)
            if written_rows(good):
                grew = True
                comp, last = connected_components(good.select(F.col("ra").alias("a"), F.col("rb").alias("b"))), self.label
                self.label = merged(self.label, comp)
                discard(comp, last)
            discard(good)
            left, last = self.crossing(left.select("a", "b", "d")), left
            discard(last)
        self.written.append(left)
        self.tried, self.n_tried = self.tried.unionByName(left.select("a", "b")), self.n_tried + written_rows(left)
        return grew

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b, ra, rb) whose sets are similar."""
        x = join_checked(self.sets.select(F.col("node").alias("a"), F.col("s").alias("x")), pairs, "a", "inner").select("a", "b", "ra", "rb", "x")
        y = join_checked(self.sets.select(F.col("node").alias("b"), F.col("s").alias("y")), pairs.select("a", "b"), "b", "inner", rows=written_rows(pairs)).select("a", "b", "y")
        return materialize(x.join(y, ["a", "b"]).select("a", "b", "ra", "rb", "x", "y").mapInArrow(_alike(self.similarity), T.StructType([field(c, T.LongType()) for c in ("a", "b", "ra", "rb")])))

    def rooted(self, df: DataFrame, node: str, root: str) -> DataFrame:
        """df with the root of its nodes."""
        if not written_rows(self.label):
            return df.withColumn(root, F.col(node))
        return join_checked(df, self.label.toDF(node, root), node, rows=written_rows(self.label)).withColumn(root, F.coalesce(root, node))

    def crossing(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b, d) with the roots of their ends, where these differ and the pair was not tried."""
        new = self.rooted(self.rooted(pairs, "a", "ra"), "b", "rb").where("ra <> rb")
        if self.n_tried:
            new = join_checked(new, self.tried, ["a", "b"], "left_anti", rows=self.n_tried)
        return materialize(new.select("a", "b", "d", "ra", "rb"))

    def parted(self) -> DataFrame:
        """(a, b): the pairs of components that some pair taken did not connect."""
        pairs = self.rooted(self.rooted(self.tried, "a", "ra"), "b", "rb").where("ra <> rb")
        return materialize(pairs.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())

    def apart(self) -> DataFrame:
        """(node, grp) of the components that some pair taken did not connect."""
        pairs = self.parted()
        roots = materialize(pairs.select(F.explode(F.array("a", "b")).alias("root")).distinct())
        others = join_checked(self.label, roots, "root", "left_semi").select("node", F.col("root").alias("grp"))
        out = materialize(roots.select(F.col("root").alias("node"), F.col("root").alias("grp")).unionByName(others))
        self.written.append(pairs)
        self.between = pairs
        discard(roots)
        return out

    def compare(self, apart: DataFrame, more: DataFrame, chunk: int) -> None:
        """Links the groups of apart (node, grp; as apart() gave them) by all pairs of sets of different groups in each family: a family
        is what the pairs that apart() found and the candidates more (a, b) connect. The largest group of a family is compared with the
        others only. Both sides are cut in chunks, by rows and bytes, and each two chunks are one key; so a set is moved once for
        each chunk of the other side, and what a task returns are links that connect groups: one less than groups at most."""
        edges = self.between.unionByName(more.select("a", "b")).unionByName(apart.select(F.col("grp").alias("a"), F.col("node").alias("b")))
        family = connected_components(edges).withColumnRenamed("root", "fam")
        sized = join_checked(self.sets.select("node", F.length("s").cast("long").alias("size")), apart, "node", "inner")
        members = materialize(sized.join(family, "node").select("node", "grp", "fam", "size"))
        grouped = members.groupBy("fam", "grp").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
        whole = grouped.groupBy("fam").agg(F.max(F.struct("n", "bytes", "grp")).alias("top"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
        parts = lambda n, size: F.greatest(F.ceil(n / chunk), F.ceil(size / CHUNK_BYTES), F.lit(1)).cast("int")
        cut = materialize(whole.select("fam", F.col("top.grp").alias("main"), parts(F.col("top.n"), F.col("top.bytes")).alias("mains"), parts(F.col("n") - F.col("top.n"), F.col("bytes") - F.col("top.bytes")).alias("rests")))
        main, own = F.col("grp") == F.col("main"), lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
        placed = join_checked(members, cut, "fam", "inner").withColumn("own", F.when(main, F.col("rests") + own("mains")).otherwise(own("rests")))
        placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(main, F.col("rests")).otherwise(F.col("rests") + F.col("mains")) - 1)))
        keys = ["fam", "lo", "hi"]
        asked = materialize(placed.select("fam", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "node", "grp", "own"))
        by_key = join_checked(self.sets, asked, "node", "inner").select(*keys, "own", "grp", "s").repartition(*keys).sortWithinPartitions(*keys)
        found = materialize(by_key.mapInArrow(lambda batches, s=self.similarity: _streamed(batches, chunk, lambda part: _connecting(part, s)), T.StructType([field("a", T.LongType()), field("b", T.LongType())])))
        if written_rows(found):
            comp, last = connected_components(found), self.label
            self.label = merged(self.label, comp)
            discard(comp, last)
        discard(family, members, cut, asked, found)


def merged(label: DataFrame, comp: DataFrame) -> DataFrame:
    """label (node, root; without the roots) after the components comp (node, root) of its roots."""
    moved = join_checked(label, comp.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", rows=written_rows(comp)).select("node", F.coalesce("to", "root").alias("root"))
    return materialize(moved.unionByName(comp.where("node <> root")))


def _alike(similarity: float):
    """Of batches (a, b, ra, rb, x, y) the pairs whose sorted sets x and y of 64-bit hashes are similar, by exact count."""

    def run(batches):
        for batch in batches:
            ok = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(k)[i].as_buffer(), np.uint64) for k in (4, 5))
                ok.append(jaccard_reaches(x, y, similarity))
            yield pa.RecordBatch.from_arrays(batch.columns[:4], names=["a", "b", "ra", "rb"]).filter(pa.array(ok, pa.bool_()))

    return run


def jaccard_reaches(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two arrays of different values each have this Jaccard similarity or more."""
    if min(len(x), len(y)) < similarity * max(len(x), len(y)) - 1e-9:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= similarity * (len(x) + len(y) - both) - 1e-9


def _connecting(part: pa.Table, similarity: float):
    """Of each group of equal keys (fam, lo, hi; own, grp, s) pairs (a, b) of grp, enough to connect whatever pairs of similar sets connect:
    of chunk lo and chunk hi, or if these are one, within it."""
    ks = np.stack([part.column(i).to_numpy() for i in range(3)], 1)
    own, grp = part.column(3).to_numpy(), part.column(4).to_numpy()
    edges = np.concatenate([[0], np.flatnonzero((ks[1:] != ks[:-1]).any(axis=1)) + 1, [len(ks)]])
    out = []
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
        x, y = (np.flatnonzero(own[lo:hi] == ks[lo, k]) for k in (1, 2))
        g = grp[lo:hi].copy()
        if not len(x) or not len(y) or (g == g[0]).all():
            continue
        sets = [np.frombuffer(v.as_buffer(), np.uint64) for v in part.column(5).slice(lo, hi - lo)]
        n = np.array([len(v) for v in sets], np.int64)
        both = common(sets, x, y)
        like = both >= similarity * (n[x][:, None] + n[y][None] - both) - 1e-9
        like = np.argwhere(like & (g[x][:, None] != g[y][None]))
        like = np.stack([x[like[:, 0]], y[like[:, 1]]], 1)
        while len(like):  # each turn joins two groups of this key
            a, b = sorted(g[like[0]].tolist())
            out.append((a, b))
            g[g == b] = a
            like = like[g[like[:, 0]] != g[like[:, 1]]]
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])


def common(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many values each of the sets x has in common with each of the sets y, exactly. Values of one set alone count nowhere; the
    others are columns of a 0-1 matrix, of which COLUMNS are held at a time."""
    row = np.repeat(np.arange(len(sets)), [len(v) for v in sets])
    _, col, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    row, col = row[shared[col]], (np.cumsum(shared) - 1)[col[shared[col]]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((len(x), len(y)))
    cuts = np.searchsorted(col, np.arange(0, int(shared.sum()) + COLUMNS, COLUMNS))
    for k, (lo, hi) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
        at = np.zeros((len(sets), COLUMNS), np.float32)
        at[row[lo:hi], col[lo:hi] - k * COLUMNS] = 1
        out += at[x] @ at[y].T
    return out


def similar_components(docs: DataFrame, width: int = 5, similarity: float = 0.8, words: int = 8, miss: float = 0.02, seed: int = 42, chunk: int = 512) -> DataFrame:
    """(doc_id, _fp, component_id) for each row of docs, linked where shingle sets have `similarity` or more (similar_groups)."""
    rows, groups = similar_groups(docs.select("doc_id", "text"), width, similarity, words, miss, seed, chunk)
    marked = materialize(rows.join(groups, "__set__").select("doc_id", F.col("__fp__").alias("_fp"), "__root__"))
    least = materialize(marked.groupBy("__root__").agg(F.min("doc_id").alias("component_id")))
    return join_checked(marked, least, "__root__", "inner").select("doc_id", "_fp", "component_id")


def _buckets(part: pa.Table):
    """(nid, grp, fingerprints, first row and size of each group of equal keys)."""
    ks = np.stack([part.column(i).to_numpy() for i in range(3)], 1)
    edges = np.concatenate([[0], np.flatnonzero((ks[1:] != ks[:-1]).any(axis=1)) + 1, [len(ks)]])
    return part.column(3).to_numpy(), part.column(5).to_numpy(), np.frombuffer(b"".join(part.column(4).to_pylist()), np.uint64).reshape(len(ks), -1), edges[:-1], np.diff(edges)


def _edges(a: list, b: list, d: list):
    a, b, d = np.concatenate(a), np.concatenate(b), np.concatenate(d).astype(np.int64)
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(d)], names=["a", "b", "d"])


def _spanning(part: pa.Table, distance: int):
    """The least spanning forest of the close pairs in each group of equal keys. Most groups are pairs: those are compared at once."""
    nid, _, fp, start, size = _buckets(part)
    two = start[size == 2]
    d = np.bitwise_count(fp[two] ^ fp[two + 1]).sum(axis=1)
    close = d <= distance
    out_a, out_b, out_d = [nid[two[close]]], [nid[two[close] + 1]], [d[close]]
    for lo, n in zip(start[size > 2].tolist(), size[size > 2].tolist()):
        f, ids = fp[lo : lo + n].copy(), nid[lo : lo + n].copy()
        near, via = np.full(n, 1 << 30, np.int64), np.zeros(n, np.int64)
        a, b, c = [], [], []
        for m in range(n - 1, 0, -1):  # the tree's newest member is at m, those not in it are before
            d = np.bitwise_count(f[:m] ^ f[m]).sum(axis=1).astype(np.int64)
            closer = d < near[:m]
            near[:m][closer], via[:m][closer] = d[closer], ids[m]
            j = int(near[:m].argmin())
            if near[j] <= distance:
                a.append(via[j])
                b.append(ids[j])
                c.append(near[j])
            for v in (f, ids, near, via):
                v[[j, m - 1]] = v[[m - 1, j]]
        out_a.append(np.array(a, np.int64))
        out_b.append(np.array(b, np.int64))
        out_d.append(np.array(c, np.int64))
    yield from _edges(out_a, out_b, out_d)


def _closest(part: pa.Table, distance: int, nearest: int):
    """Of each member of each group of equal keys the nearest close ones of another grp; of one that has more, also (nid, nid, 0)."""
    nid, grp, fp, start, size = _buckets(part)
    out_a, out_b, out_d = [nid[:0]], [nid[:0]], [nid[:0]]
    for lo, n in zip(start.tolist(), size.tolist()):
        if (grp[lo : lo + n] == grp[lo]).all():
            continue
        for i in range(lo, lo + n):
            d = np.bitwise_count(fp[lo : lo + n] ^ fp[i]).sum(axis=1)
            hit = np.flatnonzero((d <= distance) & (grp[lo : lo + n] != grp[i]))
            if len(hit) > nearest:
                hit = hit[np.argsort(d[hit], kind="stable")[:nearest]]
                out_a.append(nid[i : i + 1])
                out_b.append(nid[i : i + 1])
                out_d.append(np.zeros(1, d.dtype))
            out_a.append(np.full(len(hit), nid[i]))
            out_b.append(nid[lo + hit])
            out_d.append(d[hit])
    yield from _edges(out_a, out_b, out_d)


def dedup(docs: DataFrame, width: int = 5, similarity: float = 0.8, words: int = 8, seed: int = 42, **options) -> DataFrame:
    """docs with one row of each near-duplicate group (similar_groups), whatever its ids: one with the least doc_id, nulls last, of
    those the set of shingles whose digest is least. Of several such rows the one stays whose columns sort first, nulls before all."""
    cols = docs.columns
    rows, groups = similar_groups(docs, width, similarity, words, seed=seed, **options)
    found = rows.groupBy("__set__", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("__rid__").alias("rid")).join(groups, "__set__")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__set__", "n", "rid")).alias("k")
    keep = materialize(found.groupBy("__root__").agg(best).select("__root__", "k.*"))
    freed(docs.sparkSession)
    # what goes is less than what stays, so texts move only if it is too much to be broadcast
    gone = materialize(rows.select("__rid__").join(keep.where("n = 1").select(F.col("rid").alias("__rid__")), "__rid__", "left_anti"))
    one = join_checked(rows, gone, "__rid__", "left_anti")
    several = materialize(keep.where("n > 1").select("__root__", "__set__", F.col("doc_id").alias("__id__")))
    held = join_checked(rows, several, "__set__", "inner").where(F.col("doc_id").eqNullSafe(F.col("__id__")))
    pick = lambda df: df.select(*[F.col(f"`{c}`") for c in cols])
    return pick(one).unionByName(held.groupBy("__root__").agg(F.min(F.struct(*[F.col(f"`{c}`") for c in cols])).alias("__row__")).select("__row__.*"))


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")
