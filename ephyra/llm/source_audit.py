"""How far sources of a language differ in their use of terms: integer dictionaries of kept terms, dense vectors by chunk."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from .common import SLICE_ROWS, field, join_checked, materialize, table

#: A term is kept in a language if at least so many of its documents have it.
LEAST_DOCS = 30
#: Shares are whole parts of SCALE, with PRIOR added to each count.
SCALE_STEPS, STEP, PRIOR = 3, 1000, 5
TOP = 50
#: Terms of a chunk, and the cells (sources by terms) that one may have.
CHUNK, CELLS = 4096, 1 << 22
#: Terms that a task holds before it hands its counts on.
HELD = 300_000

#: A-Z to lower case, all other bytes below 128 but a-z to spaces; the bytes of longer characters stay.
_LETTERS = bytes(b if b > 127 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))

_COUNTS = T.StructType([field("lang", T.StringType()), field("source", T.StringType()), field("term", T.BinaryType()), field("n", T.LongType()), field("docs", T.LongType())])
_PARTS = T.StructType([*[field(c, T.StringType()) for c in ("lang", "source", "part", "item")], field("value", T.LongType())])
_KINDS = {T.StringType: pa.string(), T.BinaryType: pa.binary(), T.LongType: pa.int64()}


def _schema(t: T.StructType) -> pa.Schema:
    return pa.schema([(f.name, _KINDS[type(f.dataType)]) for f in t])


def _counted(batches):
    """Occurrences and documents of each term of each group in a task, and a row with a null term for the group itself."""
    held, size = {}, 0

    def rows():
        for (lang, source), (n, docs) in held.items():
            k = len(n) + 1
            yield pa.RecordBatch.from_arrays([pa.array([lang] * k, pa.string()), pa.array([source] * k, pa.string()), pa.array([None, *n], pa.binary()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *(docs[t] for t in n)], pa.int64())], schema=_schema(_COUNTS))

    for whole in batches:
        for lo in range(0, whole.num_rows, SLICE_ROWS):
            for text, *group in zip(*[c.to_pylist() for c in whole.slice(lo, SLICE_ROWS).columns], strict=True):
                n, docs = held.setdefault(tuple(group), (Counter(), Counter()))
                words, before = text.translate(_LETTERS).split(), len(n)
                n.update(words)
                docs.update(set(words))
                size += len(n) - before
                if size > HELD:
                    yield from rows()
                    held, size = {}, 0
    yield from rows()


def shares(counts: np.ndarray, total) -> np.ndarray:
    """1 + floor(SCALE * counts / total), exactly, in long division by STEP; total must stay below 2**63 / STEP."""
    left, out = counts, np.zeros_like(counts)
    for _ in range(SCALE_STEPS):
        left = left * STEP
        digit = left // total
        left, out = left - digit * total, out * STEP + digit
    return out + 1


def _vectors(cells: pa.Table, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(the chunk's terms in UTF-8 order, counts of each source by term id). Ids are places in the sorted array."""
    given = np.array([*cells["term"].to_pylist(), None], object)[:-1]
    terms = np.array([*sorted(set(given)), None], object)[:-1]
    ids = np.searchsorted(terms, given) if len(given) else np.zeros(0, np.int64)
    at = {s: i for i, s in enumerate(names)}
    group, n = np.array([at[s] for s in cells["source"].to_pylist()], np.int64), cells["n"].to_numpy()
    out = np.zeros((len(names), len(terms)), np.int64)
    order = np.argsort(group, kind="stable")
    edges = np.searchsorted(group[order], np.arange(len(names) + 1))
    for s in range(len(names)):
        own = order[edges[s] : edges[s + 1]]
        if len(own):  # two halves, as bincount adds weights in doubles
            low, high = (np.bincount(ids[own], weights=w[own], minlength=len(terms)).astype(np.int64) for w in (n & 0xFFFFFFFF, n >> 32))
            out[s] = (high << 32) + low
    return terms, out


def _compared(key, cells: pa.Table, groups: pa.Table) -> pa.Table:
    """A chunk's share of each pair's sum, and each source's best terms in the chunk."""
    lang = key[0].as_py()
    order = np.argsort(np.array([*groups["source"].to_pylist(), None], object)[:-1])
    names, totals, v = [groups["source"][int(i)].as_py() for i in order], groups["total"].to_numpy()[order], groups["v"][0].as_py()
    terms, n = _vectors(cells, names)
    out = []
    p, q = shares(n + PRIOR, (totals + PRIOR * v)[:, None]) if v else n, shares(n.sum(axis=0) + PRIOR, totals.sum() + PRIOR * v) if v else 0
    for i, source in enumerate(names):
        out += [(lang, source, "pair", other, int(d)) for other, d in zip(names[i + 1 :], np.abs(p[i + 1 :] - p[i]).sum(axis=1), strict=True)]
        gain = np.where(n[i] > 0, p[i] - q, 0)
        ids = np.flatnonzero(gain > 0)
        out += [(lang, source, "term", terms[k].decode(), int(gain[k])) for k in ids[np.argsort(-gain[ids], kind="stable")[:TOP]]]
    return pa.table([list(c) for c in zip(*out, strict=True)] or [[]] * 5, schema=_schema(_PARTS))


def source_audit(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank) of documents (text, lang, source).

    One pass counts the terms of each (lang, source): tasks sum them before the one shuffle by (lang, term), where the
    number of documents decides which are kept. Kept counts are written. A language's terms are dealt over chunks by
    hash, as many as keep a chunk's dense matrix (sources by terms) within CELLS; a chunk has its sorted terms, their
    ids, one vector of counts for each source, and gives sums for pairs and the best TOP terms of each source. Sums of
    chunks add up; ranks follow the value, then the UTF-8 order, which is that of the ids.
    Null text, lang or source counts as ''. A group without terms has all its pairs; a language without kept terms has
    pairs with value 0; one with a single source has none. Repeated rows count each. An empty table gives no rows.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    counted = docs.select(blank("text").cast("binary").alias("text"), blank("lang").alias("lang"), blank("source").alias("source")).mapInArrow(_counted, _COUNTS)
    same = Window.partitionBy("lang", "term")
    summed = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    judged = summed.withColumn("first", (F.row_number().over(same.orderBy("source")) == 1).cast("int")).withColumn("docs", F.sum("docs").over(same))
    cells = materialize(judged.where(F.col("term").isNull() | (F.col("docs") >= LEAST_DOCS)).drop("docs"))
    named = F.col("term").isNotNull()
    whole = Window.partitionBy("lang")
    groups = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum(F.when(named, F.col("first")).otherwise(0)).alias("v"))
    groups = materialize(groups.withColumn("v", F.sum("v").over(whole)).withColumn("chunks", F.ceil(F.col("v") / F.greatest(F.lit(1), F.least(F.lit(CHUNK), F.floor(F.lit(CELLS) / F.count(F.lit(1)).over(whole)))))).withColumn("chunks", F.greatest("chunks", F.lit(1)).cast("int")))
    langs = materialize(groups.select("lang", "chunks").distinct())
    dealt = join_checked(cells.where(named), langs, "lang", "inner").withColumn("chunk", F.pmod(F.xxhash64("term"), "chunks").cast("int"))
    asked = groups.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    keys = ["lang", "chunk"]
    parts = materialize(dealt.select(*keys, "source", "term", "n").groupBy(*keys).cogroup(asked.select(*keys, "source", "total", "v").groupBy(*keys)).applyInArrow(_compared, _PARTS))
    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    mirrored = pairs.select("lang", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("e"), "part", "value").select("lang", "e.source", "part", "e.item", "value")
    ranked = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return mirrored.unionByName(parts.where("part = 'term'")).withColumn("rank", F.row_number().over(ranked)).where((F.col("part") == "pair") | (F.col("rank") <= TOP))


def op12_source_audit(spark, sf_dir: str) -> DataFrame:
    return source_audit(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
with d as (select row_number() over () as k, coalesce(lang, '') as lang, coalesce(source, '') as source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
w as (select k, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
kept as (select lang, term from w group by all having count(distinct k) >= 30),
v as (select lang, count(*) as v from kept group by lang),
g as (select distinct d.lang, d.source, coalesce(v.v, 0) as v from d left join v using (lang)),
c as (select g.lang, g.source, kept.term, count(w.k) as n from g join kept using (lang) left join w on w.lang = g.lang and w.source = g.source and w.term = kept.term group by all),
s as (select lang, source, sum(n) as total from c group by all), ls as (select lang, sum(total) as total from s group by all), lc as (select lang, term, sum(n) as n from c group by all),
p as (select c.lang, c.source, c.term, c.n, 1 + 1000000000::hugeint * (c.n + 5) // (s.total + 5 * v.v) as p from c join s using (lang, source) join v using (lang)),
q as (select lc.lang, lc.term, 1 + 1000000000::hugeint * (lc.n + 5) // (ls.total + 5 * v.v) as q from lc join ls using (lang) join v using (lang)),
f as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
u as (select a.lang, a.source, 'pair' as part, b.source as item, cast(coalesce(f.value, 0) as bigint) as value from g a join g b on a.lang = b.lang and a.source <> b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source
 union all select p.lang, p.source, 'term', p.term, cast(p.p - q.q as bigint) from p join q using (lang, term) where p.n > 0 and p.p > q.q),
r as (select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as int) as rank from u)
select * from r where part = 'pair' or rank <= 50
"""
