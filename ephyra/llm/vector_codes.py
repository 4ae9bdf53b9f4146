"""Short codes of vectors: a codebook for each part by integer Lloyd rounds with Hamerly's bounds."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import discard, field, join_checked, materialize, table

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors that a worker compares at a time.
BLOCK = 8192
#: Relative slack of the bounds, far above the rounding of a few double operations.
SLACK = 1e-12
#: Components below this have squared distances that fit 64 bits, for parts of up to 2**14 components; others are compared as whole numbers of any size.
WORD = 1 << 23

_STATE = T.StructType([
    field("vec_id", T.LongType()), field("label", T.LongType()), field("raw", T.BinaryType()), field("own", T.BinaryType()), field("upper", T.BinaryType()), field("lower", T.BinaryType()),
    field("scans", T.LongType()), field("moved", T.ArrayType(T.StructType([field(c, T.LongType()) for c in ("cell", "limb", "value")]))),
])
_OUT = T.StructType([field("vec_id", T.LongType()), field("label", T.LongType()), field("code", T.StringType()), field("error", T.LongType())])
_LIMB = 30


def whole(raw: list[bytes], kind: str) -> np.ndarray:
    """floor(SCALE * x) of the components, as 64-bit numbers or, where one is too large for these, as Python's."""
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    if not x.size or np.abs(x).max() < WORD / SCALE:
        return np.floor(x * SCALE).astype(np.int64)
    big = lambda v: int(v) * SCALE if abs(v) >= 1 << 53 else math.floor(v * SCALE)
    return np.array([big(v) for v in x.ravel().tolist()], object).reshape(x.shape)


def _typed(values) -> np.ndarray:
    """A codebook part: 64-bit numbers if all are small."""
    a = np.array(values, object)
    return a.astype(np.int64) if not a.size or max(map(abs, a.ravel().tolist())) < WORD else a


def _scan(x: np.ndarray, book: np.ndarray):
    """(nearest entry, ties to the lower index; squared distances to it and to the second nearest) for each row, in whole numbers."""
    if x.dtype == object or book.dtype == object:
        x, book = x.astype(object), book.astype(object)
    d = ((x[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
    if d.dtype != object:
        own = d.argmin(axis=1)
        first = d[np.arange(len(d)), own]
        if len(book) == 1:
            return own, first, None
        d[np.arange(len(d)), own] = np.iinfo(np.int64).max
        return own, first, d.min(axis=1)
    own = np.array([min(range(len(row)), key=row.__getitem__) for row in d.tolist()], np.int64)
    return own, d[np.arange(len(d)), own], None


def _own_distance(x: np.ndarray, book: np.ndarray, own: np.ndarray) -> np.ndarray:
    if x.dtype == object or book.dtype == object:
        x, book = x.astype(object), book.astype(object)
    return ((x - book[own]) ** 2).sum(axis=1)


def _root(d: np.ndarray, up: bool) -> np.ndarray:
    return np.sqrt(d.astype(np.float64)) * (1 + SLACK if up else 1 - SLACK)


def step(x: np.ndarray, books: list[np.ndarray], shifts: list[np.ndarray] | None, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
    """Assigns each row's parts to their nearest entries; own, upper and lower (rows by parts) change in place. Returns
    how many parts were compared with all entries.

    upper is at least the distance to the part's entry, lower at most that to the second nearest one. When entries have
    moved by `shifts` (None: first round), upper grows by its entry's shift and lower shrinks by the greatest of the others'. While upper
    < lower, no other entry is as near, tied ones included, and the part stays; otherwise upper is made exact, and only
    if it still isn't less are all entries compared."""
    width, scans = x.shape[1] // PARTS, 0
    for p, book in enumerate(books):
        part = x[:, p * width : (p + 1) * width]
        if shifts is None:
            unsure = np.arange(len(x))
        else:
            s = shifts[p]
            most = np.array([np.delete(s, i).max(initial=0.0) for i in range(len(s))])
            with np.errstate(invalid="ignore"):  # bounds that became nan decide nothing
                upper[:, p] = (upper[:, p] + s[own[:, p]]) * (1 + SLACK)
                lower[:, p] = lower[:, p] - most[own[:, p]]
                lower[:, p] -= np.abs(lower[:, p]) * SLACK
            unsure = np.flatnonzero(~(upper[:, p] < lower[:, p]))
            if len(unsure) and part.dtype != object and book.dtype != object:
                upper[unsure, p] = _root(_own_distance(part[unsure], book, own[unsure, p]), True)
                unsure = unsure[~(upper[unsure, p] < lower[unsure, p])]
        scans += len(unsure)
        if len(unsure):
            nearest, first, second = _scan(part[unsure], book)
            own[unsure, p] = nearest
            exact = first.dtype != object
            upper[unsure, p] = _root(first, True) if exact else np.inf
            lower[unsure, p] = _root(second, False) if second is not None else np.inf if exact and len(book) == 1 else 0.0
    return scans


def _limbs(value: int):
    """value as (limb, part) with sum(part << _LIMB * limb) == value, so that parts of many tasks add up in 64 bits."""
    limb = 0
    while value not in (0, -1):
        yield limb, value & ((1 << _LIMB) - 1)
        value, limb = value >> _LIMB, limb + 1
    if value:
        yield limb, -1


def _assigned(batches, books, shifts, kind):
    """Rows with their new entries and bounds. The last row of a task has no vector: it tells by how much sums and counts of
    the entries (cells; a count is the cell after its entry's components) change, and how many comparisons were made."""
    change, scans = {}, 0
    for batch in batches:
        for lo in range(0, batch.num_rows, BLOCK):
            part = batch.slice(lo, BLOCK)
            raw = part.column(2).to_pylist()
            x, n = whole(raw, kind), part.num_rows
            if shifts is None:
                own, upper, lower = np.zeros((n, PARTS), np.uint8), np.zeros((n, PARTS)), np.zeros((n, PARTS))
            else:
                own, upper, lower = (np.frombuffer(b"".join(part.column(c).to_pylist()), t).reshape(n, PARTS).copy() for c, t in ((3, np.uint8), (4, "<f8"), (5, "<f8")))
            was = own.copy()
            scans += step(x, books, shifts, own, upper, lower)
            width = x.shape[1] // PARTS
            for p in range(PARTS):
                gone = np.arange(n) if shifts is None else np.flatnonzero(was[:, p] != own[:, p])
                for e in np.unique(np.concatenate([own[gone, p], was[gone, p]])) if len(gone) else ():
                    cell = (p * ENTRIES + int(e)) * (width + 1)
                    for rows, sign in ((gone[own[gone, p] == e], 1), (gone[was[gone, p] == e] if shifts is not None else gone[:0], -1)):
                        if len(rows):
                            for i, s in enumerate([*x[rows, p * width : (p + 1) * width].sum(axis=0).tolist(), len(rows)]):
                                change[cell + i] = change.get(cell + i, 0) + sign * s
            split = lambda a: [r.tobytes() for r in a]
            blank = pa.nulls(n, pa.int64())
            yield _batch([part.column(0), part.column(1), pa.array(raw, pa.binary()), pa.array(split(own)), pa.array(split(upper)), pa.array(split(lower)), blank, pa.nulls(n, _MOVED)])
    told = [{"cell": c, "limb": limb, "value": v} for c, s in change.items() for limb, v in _limbs(s)]
    yield _batch([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), *[pa.nulls(1, pa.binary())] * 4, pa.array([scans], pa.int64()), pa.array([told], _MOVED)])


_MOVED = pa.list_(pa.struct([(c, pa.int64()) for c in ("cell", "limb", "value")]))


def _batch(columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, names=_STATE.names)


def _coded(batches, books, kind):
    """The code of each row and its squared distance; null where that isn't a 64-bit number."""
    for batch in batches:
        for lo in range(0, batch.num_rows, BLOCK):
            part = batch.slice(lo, BLOCK)
            x, own = whole(part.column(2).to_pylist(), kind), np.frombuffer(b"".join(part.column(3).to_pylist()), np.uint8).reshape(-1, PARTS)
            width = x.shape[1] // PARTS
            error = sum(_own_distance(x[:, p * width : (p + 1) * width], b, own[:, p]).astype(object) for p, b in enumerate(books))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(["".join(f"{i:02x}" for i in r) for r in own.tolist()], pa.string()), pa.array([int(e) if e < 1 << 63 else None for e in error], pa.int64())], names=_OUT.names)


def _parsed(batches, kind):
    """vec_id, label and the bytes of each vector all of whose components are finite; no such row for others."""
    for batch in batches:
        v = batch.column(2)
        if isinstance(v.type, pa.FixedSizeListType) or v.offset:
            v = pa.array(v.to_pylist(), pa.list_(v.type.value_type))
        lengths = v.value_lengths().fill_null(0).to_numpy().astype(np.int64)
        flat = v.flatten()
        bad = ~np.isfinite(flat.fill_null(math.nan).to_numpy(zero_copy_only=False).astype(np.float64))
        ends = np.cumsum(lengths)
        wrong = np.concatenate([[0], np.cumsum(bad)])
        ok = v.is_valid().to_numpy(zero_copy_only=False) & (wrong[ends] == wrong[ends - lengths])
        data = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(kind).tobytes()
        size = np.dtype(kind).itemsize
        raw = [data[(e - n) * size : e * size] for e, n in zip(ends[ok].tolist(), lengths[ok].tolist())]
        keep = pa.array(ok)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(raw, pa.binary())], names=_STATE.names[:3])


class Codebooks:
    """The entries of all parts with the sums and counts behind them: ENTRIES numbers for each component, whatever the number of vectors."""

    def __init__(self, first: np.ndarray):
        self.width = first.shape[1] // PARTS
        self.books = [_typed(first[:, p * self.width : (p + 1) * self.width]) for p in range(PARTS)]
        self.sums: dict[int, int] = {}

    def moved(self, cells) -> list[np.ndarray]:
        """Adds the changes, replaces each entry by its mean (floor; unused ones stay) and returns how far each moved, at least."""
        for c, limb, value in cells:
            self.sums[c] = self.sums.get(c, 0) + (value << _LIMB * limb)
        shifts = []
        for p, old in enumerate(self.books):
            new = old.astype(object)
            for e in range(len(old)):
                cell = (p * ENTRIES + e) * (self.width + 1)
                if count := self.sums.get(cell + self.width, 0):
                    new[e] = [self.sums.get(cell + i, 0) // count for i in range(self.width)]
            gap = ((new - old.astype(object)) ** 2).sum(axis=1) if self.width else np.zeros(len(old), object)
            shifts.append(np.array([math.isqrt(int(g) << 64) / 2.0**32 * (1 + SLACK) + 2.0**-31 if 0 < g < 1 << 200 else math.inf if g else 0.0 for g in gap]))
            self.books[p] = _typed(new)
        return shifts

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(v) for b in self.books for v in b.ravel().tolist()).encode()).hexdigest()


def vector_codes(vectors: DataFrame, rounds: int = ROUNDS, watch: list | None = None) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) for the rows of vectors (vec_id, embedding, label) whose components are all finite.

    A round is one pass without a shuffle of vectors: rows carry their entries and bounds in a written table, each task compares
    what the bounds leave open and tells by how much the sums of entries change. Changes are summed by Spark; the driver gets
    at most a few numbers for each component of an entry, which is all that goes back to the tasks. Whole-number arithmetic throughout; components
    beyond 64 bits are compared as Python's numbers.
    Equal vectors and repeated rows are coded each. The first entries are those of the least vec_ids (null ids last, then by their bytes);
    with fewer than ENTRIES vectors there are fewer entries. A vector whose length isn't a positive multiple of PARTS, or another than that of the
    least vec_id, is dropped like those with nulls. error and label_error are null where they don't fit a long. An
    empty table gives no rows. watch: receives the number of parts compared with all entries in each round.
    """
    narrow = isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType)
    kind = "<f4" if narrow else "<f8"
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast(f"array<{'float' if narrow else 'double'}>").alias("v"))
    item = np.dtype(kind).itemsize
    rows = materialize(given.where("v is not null").mapInArrow(lambda b: _parsed(b, kind), T.StructType(_STATE.fields[:3])).where((F.octet_length("raw") > 0) & (F.octet_length("raw") % (PARTS * item) == 0)))
    order = [F.asc_nulls_last("vec_id"), F.col("raw")]
    head = rows.orderBy(*order).limit(1).collect()
    size = len(head[0].raw) if head else 0
    rows = rows.where(F.octet_length("raw") == size)
    first = [bytes(r.raw) for r in rows.orderBy(*order).limit(ENTRIES).collect()]
    books, shifts, state = Codebooks(whole(first, kind) if first else np.zeros((0, PARTS), np.int64)), None, None
    for r in range(rounds + 1 if first else 0):
        now = (rows if state is None else state.where("raw is not null")).select("vec_id", "label", "raw", *([] if state is None else ["own", "upper", "lower"]))
        new = materialize(now.mapInArrow(lambda b, k=list(books.books), s=shifts: _assigned(b, k, s, kind), _STATE))
        discard(state)
        state = new
        told = state.where("raw is null")
        if watch is not None:
            watch.append(told.agg(F.sum("scans")).first()[0])
        if r < rounds:
            cells = told.select(F.explode("moved").alias("m")).groupBy("m.cell", "m.limb").agg(F.sum("m.value").alias("value")).collect()
            shifts = books.moved(cells)
    if state is None:
        coded = rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).limit(0)
    else:
        coded = state.where("raw is not null").select("vec_id", "label", "raw", "own").mapInArrow(lambda b, k=list(books.books): _coded(b, k, kind), _OUT)
    coded = materialize(coded)
    summed = materialize(coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("s"), F.max(F.col("error").isNull()).alias("over")).select(F.col("label").alias("_label"), F.when(~F.col("over"), F.expr("try_cast(s as bigint)")).alias("label_error")))
    joined = join_checked(coded, summed, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    """Plain Lloyd rounds, one pair of tables for each."""
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"d{r} as (select p.k, p.j, c.i, list_sum(list_transform(range(1, len(p.e) + 1), lambda t: (p.e[t] - c.e[t]) * (p.e[t] - c.e[t]))) as d from p join c{r} c on c.j = p.j)")
        steps.append(f"a{r} as materialized (select k, j, min_by(i, d * {ENTRIES} + i) as i, min(d) as d from d{r} group by all)")
        if r < ROUNDS:
            steps.append(f"s{r} as (select j, i, t, sum(v) as s, count(*) as n from (select a.j, a.i, unnest(range(1, len(p.e) + 1)) as t, unnest(p.e) as v from a{r} a join p on p.k = a.k and p.j = a.j) group by all)")
            steps.append(f"m{r} as (select j, i, list(cast((s - (s % n + n) % n) // n as hugeint) order by t) as e from s{r} group by all)")
            steps.append(f"c{r + 1} as materialized (select c.j, c.i, coalesce(m.e, c.e) as e from c{r} c left join m{r} m on m.j = c.j and m.i = c.i)")
    return f"""
with v as (select row_number() over (order by vec_id) as k, vec_id, label, list_transform(embedding, lambda x: cast(floor({SCALE} * x::double) as hugeint)) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(embedding) > 0 and len(embedding) % {PARTS} = 0),
p as materialized (select k, j, list_slice(e, j * len(e) // {PARTS} + 1, (j + 1) * len(e) // {PARTS}) as e from v, range({PARTS}) q(j)),
c0 as (select j, k - 1 as i, e from p where k <= {ENTRIES}),
{", ".join(steps)},
h as (select sha256(string_agg(array_to_string(e, ','), ',' order by j, i)) as codebooks_sha256 from c{ROUNDS}),
o as (select k, string_agg(lower(lpad(to_hex(i), 2, '0')), '' order by j) as code, cast(sum(d) as bigint) as error from a{ROUNDS} group by k)
select v.vec_id, o.code, o.error, cast(sum(o.error) over (partition by v.label) as bigint) as label_error, h.codebooks_sha256 from v join o using (k), h
"""


ORACLE_SQL = _oracle()
