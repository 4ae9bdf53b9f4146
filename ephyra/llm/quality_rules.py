"""Quality rules with adaptive thresholds from mergeable quantile sketches per language and source."""

from __future__ import annotations

import string
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import field, join_checked, materialize, quantiles, sketch, table, with_arrow, without

#: The metrics held against thresholds: count and of how many, in ten-thousandths. They are marks (ASCII punctuation), words equal to the
#: word before, and the letters A-Z.
SCALE = 10_000
RATES = {"mark_rate": ("_n_marks", "word_chars"), "stutter_rate": ("_n_stutter", "n_words"), "upper_rate": ("_n_upper", "word_chars")}
#: A group's limit is its third quartile and SPREADS times the distance of that from the first, or times the rate of one event in a
#: document of the group's median length if that is more: finer differences can't be seen in such documents.
SPREADS = 4
#: A count n stands for a rate of n - NOISE * sqrt(n) at least (deviations of a Poisson count), so that short texts don't fail by chance.
NOISE = 2
#: Groups of fewer documents use the sketch of their language, then that of all documents.
LEAST_GROUP = 50
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "_n_marks", "_n_stutter", "_n_upper"]
SPACE, SYMBOLS = " \t\n\r\x0b\x0c", "#*$%&|<>"
MARKS, UPPER = string.punctuation.encode(), string.ascii_uppercase.encode()
WINDOW = 8


class TextStats:
    """The base counts of texts, a bounded number of words at a time."""

    def __init__(self, batch_words: int = 500_000):
        self.batch_words = batch_words

    def __call__(self, texts):
        rows, words, sizes = [], [], []
        repeat, stutter = [], []
        held = 0
        for text in texts:
            text = text or ""
            raw = text.encode()
            w = raw.split()
            lines = [x for x in text.split("\n") if x.strip(SPACE)]
            rows.append((len(w), len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), len(raw) - len(raw.translate(None, MARKS)), len(raw) - len(raw.translate(None, UPPER))))
            words.append(w)
            sizes.append(len(w))
            held += len(w)
            if held >= self.batch_words:
                for known, new in zip((repeat, stutter), repeated(words, sizes)):
                    known += new
                words, sizes, held = [], [], 0
        for known, new in zip((repeat, stutter), repeated(words, sizes)):
            known += new
        cols = list(zip(*rows)) if rows else [[]] * 6
        return [*cols[:4], repeat, cols[4], stutter, cols[5]]


def repeated(docs: list[list[bytes]], sizes: list[int]) -> tuple[list[int], list[int]]:
    """For each document the number of words in windows of 8 words that it holds twice or more, and the number of words
    equal to the word before."""
    n = np.array(sizes, np.int64)
    total = int(n.sum())
    out = np.zeros(len(docs), np.int64)
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in chain.from_iterable(docs)), np.uint64, total)
    doc = np.repeat(np.arange(len(docs)), n)
    stutter = np.bincount(doc[1:][(doc[1:] == doc[:-1]) & (ids[1:] == ids[:-1])], minlength=len(docs)).tolist()
    if total < WINDOW:
        return out.tolist(), stutter
    starts = np.flatnonzero(doc[: total - WINDOW + 1] == doc[WINDOW - 1 :])
    if not len(starts):
        return out.tolist(), stutter
    h = doc[starts].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(WINDOW):
        h = (h ^ ids[starts + k]) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    left, right = starts[order[:-1][same]], starts[order[1:][same]]
    if any((ids[left + k] != ids[right + k]).any() for k in range(WINDOW)) or (doc[left] != doc[right]).any():
        seen: dict[tuple, list[int]] = {}  # two windows share a hash: count them plainly
        for s in starts.tolist():
            seen.setdefault((int(doc[s]), *ids[s : s + WINDOW].tolist()), []).append(s)
        hit = np.array([s for v in seen.values() if len(v) > 1 for s in v], np.int64)
    else:
        hit = np.concatenate([left, right])
    cover = np.zeros(total + 1, np.int64)
    hit = np.unique(hit)
    cover[hit] += 1
    np.add.at(cover, hit + WINDOW, -1)
    inside = np.cumsum(cover[:-1]) > 0
    return np.bincount(doc[inside], minlength=len(docs)).tolist(), stutter


def with_stats(docs: DataFrame) -> DataFrame:
    """docs with the base counts, the rates in ten-thousandths, and base_failed."""
    stats = with_arrow(without(docs, *RATES, "base_failed"), TextStats, ["text"], [field(c, T.LongType()) for c in BASE])
    rate = lambda a, b: F.when(F.col(b) > 0, F.floor(F.col(a) * SCALE / F.col(b))).otherwise(0).cast("long")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return stats.withColumns({k: rate(*v) for k, v in RATES.items()}).withColumn("base_failed", failed)


def thresholds(stats: DataFrame) -> DataFrame:
    """(lang, source, one limit for each rate): from the sketches of the documents that pass the base rules. Null
    languages or sources are groups like any other. The sketch of a language is the sum of its sources' sketches. All levels
    go through one grouping, as rows with their level: a plan of each level by itself is large enough to fill the driver."""
    passed = stats.where(~F.col("base_failed"))
    sizes = sorted({of for _, of in RATES.values()})
    fine = materialize(sketch(passed, ["lang", "source"], [*RATES, *sizes]))
    up_to = lambda c, level, i: (F.col(c) if i < level else F.lit(None).cast(fine.schema[c].dataType)).alias(f"_{c}")
    levels = F.array(*[F.struct(F.lit(i).alias("_level"), up_to("lang", 2, i), up_to("source", 1, i)) for i in range(3)])
    keys = ["_level", "_lang", "_source"]
    summed = fine.select(F.explode(levels).alias("_l"), "metric", "v", "n").select("_l.*", "metric", "v", "n").groupBy(*keys, "metric", "v").agg(F.sum("n").alias("n"))
    q = quantiles(summed, keys, {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    of = lambda metric, at: F.max(F.when(F.col("metric") == metric, F.col(at)))

    def limit(m: str, size: str) -> Column:
        # a median length of 0 (no word passes the base rules): nothing to hold against
        unit = F.coalesce(F.floor(SCALE / F.nullif(of(size, "q2"), F.lit(0))), F.lit(SCALE)).cast("long")
        return of(m, "q3") + SPREADS * F.greatest(of(m, "q3") - of(m, "q1"), unit)

    found = materialize(q.groupBy(*keys).agg(F.max("total").alias("_total"), *[limit(m, size).alias(m) for m, (_, size) in RATES.items()]))
    own, wider, every = (found.where(F.col("_level") == i).select(*[F.col(c).alias(f"_{i}{c}") for c in ("_lang", "_source", "_total", *RATES)]) for i in range(3))
    out = own.join(wider, F.col("_0_lang").eqNullSafe(F.col("_1_lang")), "left").crossJoin(every)
    pick = lambda m: F.when(F.col("_0_total") >= LEAST_GROUP, F.col(f"_0{m}")).when(F.col("_1_total") >= LEAST_GROUP, F.col(f"_1{m}")).otherwise(F.col(f"_2{m}"))
    return out.select(F.col("_0_lang").alias("__lang__"), F.col("_0_source").alias("__source__"), *[pick(m).alias(f"max_{m}") for m in RATES])


def verdicts(stats: DataFrame) -> DataFrame:
    """stats with the limits of each row's group and kept. The table of limits has one row for each language and
    source; it is broadcast only behind a count of it."""
    limits = materialize(thresholds(stats.select("lang", "source", "base_failed", "n_words", "word_chars", *RATES)))
    judged = join_checked(stats, limits, F.col("lang").eqNullSafe(F.col("__lang__")) & F.col("source").eqNullSafe(F.col("__source__")))
    over: Column = F.lit(False)
    for m, (n, of) in RATES.items():
        over = over | F.coalesce(F.col(n) - NOISE * F.sqrt(F.col(n)) > F.col(f"max_{m}") * F.col(of) / SCALE, F.lit(False))
    return judged.withColumn("kept", ~F.col("base_failed") & ~over).drop("__lang__", "__source__", "_n_marks", "_n_stutter", "_n_upper")


def quality_rules(docs: DataFrame) -> DataFrame:
    """docs with the base counts, base_failed, the limits of its group and kept.

    Two passes: sketches of all documents, then the verdict row by row, with no shuffle of texts. The sketches are
    counts that each task sums before the shuffle, so one source may hold any share of the rows.
    A document fails by the base rules, or by a rate that lies above its group's limit by more than chance. The limits come from
    the quartiles and the median length of the group alone: no cutoff is fixed, and where all of a group's documents are alike a few
    events in a long text don't fail it. Null or empty texts have no words and fail the base rules. A
    rate equal to the limit is kept. Repeated rows are judged each. An empty table gives no rows.
    Columns of docs with the names of this operator's are replaced.
    """
    return verdicts(with_stats(without(docs, "kept", *[f"max_{m}" for m in RATES], "__lang__", "__source__")))


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    narrow = with_stats(docs).drop("text")
    return verdicts(materialize(narrow)).select("doc_id", *BASE[:5], "base_failed", "kept", *RATES, *[f"max_{m}" for m in RATES])


ORACLE_SQL = r"""
with d as (select doc_id, lang, source, coalesce(text, '') as text, row_number() over () as k from documents),
t as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from d),
b as (select k, doc_id, lang, source, w, len(w) as n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
  length(regexp_replace(text, '[^!-/:-@\[-\x60{-~]', '', 'g')) as n_marks, length(regexp_replace(text, '[^A-Z]', '', 'g')) as n_upper,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from t),
g as (select k, i, list_slice(w, i, i + 7) as gram from (select k, w, unnest(range(1, len(w) - 6)) as i from b where len(w) >= 8)),
r as (select k, i from (select k, i, count(*) over (partition by k, gram) as c from g) where c > 1),
h as (select k, count(distinct i + o) as n_repeat_words from r, range(8) q(o) group by k),
s as (select k, count(*) as n_stutter from (select k, unnest(range(1, len(w))) as i, w from b where len(w) > 1) where w[i] = w[i + 1] group by k),
m as (select b.k, doc_id, lang, source, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, n_marks, n_upper, coalesce(n_stutter, 0) as n_stutter
  from b left join h using (k) left join s using (k)),
f as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed, coalesce(n_marks * 10000 // nullif(word_chars, 0), 0) as mark_rate, coalesce(n_stutter * 10000 // nullif(n_words, 0), 0) as stutter_rate,
  coalesce(n_upper * 10000 // nullif(word_chars, 0), 0) as upper_rate from m),
u as (unpivot (select lang, source, cast(mark_rate as bigint) as mark_rate, cast(stutter_rate as bigint) as stutter_rate, cast(upper_rate as bigint) as upper_rate, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars from f where not base_failed) on mark_rate, stutter_rate, upper_rate, n_words, word_chars into name metric value v),
z as (select lang, source, metric, (v >> greatest(0, length(bin(v)) - 6)) << greatest(0, length(bin(v)) - 6) as v from u),
l as (select 0 as level, lang, source, metric, v, count(*) as n from z group by all union all select 1, lang, null, metric, v, count(*) from z group by lang, metric, v union all select 2, null, null, metric, v, count(*) from z group by metric, v),
c as (select *, sum(n) over (partition by level, lang, source, metric order by v) as cum, sum(n) over (partition by level, lang, source, metric) as total from l),
q as (select level, lang, source, metric, max(total) as total, min(v) filter (where cum >= ceil(total * 0.25)) as q1, min(v) filter (where cum >= ceil(total * 0.5)) as q2, min(v) filter (where cum >= ceil(total * 0.75)) as q3 from c group by all),
y as (select level, lang, source, metric, q2 from q where metric in ('n_words', 'word_chars')),
x as (select q.*, q3 + 4 * greatest(q3 - q1, coalesce(10000 // nullif(y.q2, 0), 10000)) as most from q join y on y.level = q.level and y.lang is not distinct from q.lang and y.source is not distinct from q.source and y.metric = case q.metric when 'stutter_rate' then 'n_words' else 'word_chars' end
  where q.metric in ('mark_rate', 'stutter_rate', 'upper_rate')),
o as (select a.lang, a.source, a.metric, case when a.total >= 50 then a.most when b.total >= 50 then b.most else e.most end as most from x a
  left join x b on b.level = 1 and b.lang is not distinct from a.lang and b.metric = a.metric left join x e on e.level = 2 and e.metric = a.metric where a.level = 0),
p as (pivot o on metric in ('mark_rate', 'stutter_rate', 'upper_rate') using first(most) group by lang, source)
select f.doc_id, f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words, f.base_failed,
 not f.base_failed and not (coalesce(n_marks - 2 * sqrt(n_marks) > p.mark_rate * word_chars / 10000, false) or coalesce(n_stutter - 2 * sqrt(n_stutter) > p.stutter_rate * n_words / 10000, false)
  or coalesce(n_upper - 2 * sqrt(n_upper) > p.upper_rate * word_chars / 10000, false)) as kept,
 cast(f.mark_rate as bigint) as mark_rate, cast(f.stutter_rate as bigint) as stutter_rate, cast(f.upper_rate as bigint) as upper_rate,
 cast(p.mark_rate as bigint) as max_mark_rate, cast(p.stutter_rate as bigint) as max_stutter_rate, cast(p.upper_rate as bigint) as max_upper_rate
from f left join p on p.lang is not distinct from f.lang and p.source is not distinct from f.source
"""
