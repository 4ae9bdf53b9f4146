"""Histogram sort into shards of near equal bytes; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .common import materialize, without

#: Least and greatest value of a 64-bit key.
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def _below(rows: DataFrame, key: Column, size: Column, probes: list[int]) -> list[int]:
    """The exact bytes of the rows with key < probe for each ascending probe. Each task sums the bytes between
    neighbouring probes before the shuffle; the driver gets one number for each gap."""
    gap = _search(key, probes)
    got = dict(rows.groupBy(gap.alias("g")).agg(F.sum(size).alias("s")).collect())
    out, run = [], 0
    for i in range(len(probes)):
        run += got.get(i, 0)
        out.append(run)
    return out


def _search(key: Column, probes: list[int]) -> Column:
    """How many of the ascending probes are <= key: a binary search as a fold over its step sizes."""
    arr, n = F.array(*[F.lit(p).cast("long") for p in probes]), len(probes)
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(n.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda pos, s: F.when((pos + s <= n) & (F.get(arr, pos + s - 1) <= key), pos + s).otherwise(pos))


def _refine(rows: DataFrame, key: Column, size: Column, targets: list[int], tolerance: int, fan: int) -> list[tuple[int, int, int]]:
    """For each target the (key k, bytes below k, bytes below k + 1) where the bytes below keys pass the target: probes
    between the bounds of each splitter are counted together, and the bounds close in until either end meets the
    tolerance or the bounds are neighbours."""
    total = targets[-1] if targets else 0
    bounds = [[LOW, 0, HIGH, None] for _ in targets]
    while True:
        live = [i for i, (lo, below, hi, above) in enumerate(bounds) if hi - lo > 1 and abs(targets[i] - below) > tolerance and (above is None or abs(targets[i] - above) > tolerance)]
        if not live:
            break
        probes = sorted({lo + (hi - lo) * j // fan for lo, _, hi, _ in (bounds[i] for i in live) for j in range(1, fan)} | {HIGH})
        counts = dict(zip(probes, _below(rows, key, size, probes), strict=True))
        for i in live:
            for p in probes:
                if bounds[i][0] < p <= bounds[i][2]:
                    if counts[p] <= targets[i]:
                        bounds[i][:2] = p, counts[p]
                    else:
                        bounds[i][2:] = p, counts[p]
                        break
    return [(lo, below, above if above is not None else max(below, total)) if hi - lo <= 1 else ((lo, below, above) if abs(t - below) <= tolerance else (hi - 1, None, above)) for (lo, below, hi, above), t in zip(bounds, targets, strict=True)]


def histogram_shards(docs: DataFrame, shards: int = 8, tolerance: float = 0.002, fan: int = 32, bucket_rows: int = 20_000, with_text: bool = False) -> DataFrame:
    """docs with size, text_crc32, shard and slot (gapless from 0 in each shard); shards hold near equal bytes.

    The order is (XXH64 of the text, a second key): equal texts are neighbours and stay in one shard unless a boundary must fall
    among copies. The second key is the XXH64 of the row's other columns and of a number of the row in the written narrow
    table, so that rows equal in every column are cut like any others. Candidate boundaries are probed on the text's key; each round counts the
    exact bytes below all probes in one scan of the written narrow table. Where one text alone is larger than the
    tolerance (`tolerance` of a shard's bytes), its copies are cut by the second key in the same way. The exchange is one shuffle by (shard, part of the second
    key): parts hold about `bucket_rows` rows even if a third of all rows are copies, and slots are a part's offset
    plus the place in it. with_text: the texts take part in that exchange and are returned; otherwise only the narrow
    columns move.

    A null or empty text has size 1 and the checksum of no bytes. An empty table gives no rows. Clashing columns of
    docs (size, text_crc32, shard, slot) are replaced.
    """
    docs = without(docs, "size", "text_crc32", "shard", "slot", *(f"__{n}__" for n in ("k", "t", "part", "n", "off", "rank")))
    text = F.coalesce("text", F.lit(""))
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    keyed = docs.select(*rest, "text", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("__k__"), F.xxhash64(*[c.cast("string") for c in rest], F.octet_length(text)).alias("__t__"))
    # numbered before it is written: what is read back is one row each, whatever runs again
    rows = materialize((keyed if with_text else keyed.drop("text")).withColumn("__t__", F.xxhash64("__t__", F.monotonically_increasing_id())))
    k, t, size = F.col("__k__"), F.col("__t__"), F.col("size")
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    slack = int(total * tolerance / shards)
    targets = [total * i // shards for i in range(1, shards)]
    shard = F.lit(0)
    inside: dict[int, list[tuple[int, int]]] = {}
    cuts: list[tuple[int, int]] = []
    for target, (key, below, above) in zip(targets, _refine(rows, k, size, targets, slack, fan), strict=True):
        if below is not None and abs(target - below) <= slack:
            cuts.append((key, LOW))
        elif above is not None and abs(above - target) <= slack:
            cuts.append((key + 1, LOW))
        else:
            inside.setdefault(key, []).append((target - below, above - below))
    for key, wanted in inside.items():
        group = rows.where(k == F.lit(key))
        for (target, whole), (key2, below, above) in zip(wanted, _refine(group, t, size, [w for w, _ in wanted], slack, fan), strict=True):
            options = [(abs(target - b), c) for b, c in ((below, (key, key2)), (above, (key, key2 + 1)), (0, (key, LOW)), (whole, (key + 1, LOW))) if b is not None]
            cuts.append(min(options)[1])
    for key, key2 in cuts:
        shard = shard + F.when((k > F.lit(key)) | ((k == F.lit(key)) & (t >= F.lit(key2))), 1).otherwise(0)
    parts = max(64, -(-n // (shards * bucket_rows)))
    placed = rows.withColumn("shard", shard.cast("int")).withColumn("__part__", F.pmod(F.shiftright(t, 7), F.lit(parts)).cast("int"))
    offsets = placed.groupBy("shard", "__part__").agg(F.count(F.lit(1)).alias("__n__")).withColumn("__off__", F.sum("__n__").over(Window.partitionBy("shard").orderBy("__part__").rowsBetween(Window.unboundedPreceding, -1))).select("shard", "__part__", F.coalesce("__off__", F.lit(0)).alias("__off__"))
    ranked = placed.withColumn("__rank__", F.row_number().over(Window.partitionBy("shard", "__part__").orderBy("__k__", "__t__")) - 1)
    return ranked.join(offsets, ["shard", "__part__"]).withColumn("slot", F.col("__off__") + F.col("__rank__")).drop("__part__", "__k__", "__t__", "__off__", "__rank__")
