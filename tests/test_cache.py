"""Caches by digest: what is made anew, what stays, and what a broken run leaves."""

import datetime as dt
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ephyra.plans import cached
from ephyra.sources import cache, store

KEYS = ["odor", "state"]


def files(spark, changed=()):
    rows = [(o, s, f"m{o}{s}{i}", 100 + ((o, s) in changed), dt.datetime(2024, 1, 1)) for o in (1, 2) for s in ("pre", None) for i in range(2)]
    return spark.createDataFrame(rows, "odor int, state string, name string, size long, modified timestamp")


def results(spark):
    return spark.createDataFrame([(o, s, t, float(o * t)) for o in (1, 2) for s in ("pre", None) for t in range(5)], "odor int, state string, t int, v double")


def maker(spark, calls):
    def make(missing):
        calls.append(sorted(map(tuple, missing.collect()), key=str))
        return cache.matching(results(spark), missing, KEYS)

    return make


def seen(path):
    """Names and contents' times of the data files of each entry."""
    return {p.parent.name: (p.name, os.stat(p).st_mtime_ns) for p in Path(path, "data").rglob("part-*.parquet")}


def test_only_changed_entries_are_made_again(spark, tmp_path):
    held, calls = cache.ResultCache(spark, str(tmp_path / "c"), KEYS), []
    first = store.cache_key(files(spark), KEYS, sigma=1.0)
    out, found = held.refresh(first, maker(spark, calls))
    assert {r["status"] for r in found.collect()} == {"absent"} and out.count() == 20 and len(calls[0]) == 4
    before = seen(tmp_path / "c")
    out, found = held.refresh(first, maker(spark, calls))
    assert {r["status"] for r in found.collect()} == {"hit"} and len(calls) == 1 and seen(tmp_path / "c") == before
    out, found = held.refresh(store.cache_key(files(spark, {(2, None)}), KEYS, sigma=1.0), maker(spark, calls))
    assert calls[1] == [(2, None)] and sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, results(spark).collect()), key=str)
    after = seen(tmp_path / "c")
    assert sum(after[k] != before[k] for k in before) == 1 and set(after) == set(before)
    assert {r["status"] for r in held.status(store.cache_key(files(spark), KEYS, sigma=2.0)).collect()} == {"stale"}


def test_broken_entries_are_misses(spark, tmp_path):
    path = tmp_path / "c"
    held, calls = cache.ResultCache(spark, str(path), KEYS), []
    wanted = store.cache_key(files(spark), KEYS)
    with pytest.raises(ValueError, match="nothing was ever written"):
        held.read(wanted)
    held.refresh(wanted, maker(spark, calls))
    entries = sorted(p for p in (path / "data").iterdir() if p.is_dir())
    next(entries[0].glob("*.parquet")).unlink()  # the data are gone
    manifest = next((path / "manifest" / entries[1].name).glob("*.parquet"))
    manifest.write_bytes(b"not a table")  # the manifest can't be read
    (manifest.parent / f".{manifest.name}.crc").unlink(missing_ok=True)
    state = sorted(r["status"] for r in held.status(wanted).collect())
    assert state == ["absent", "broken", "hit", "hit"] and held.read(wanted).count() == 10
    out, _ = held.refresh(wanted, maker(spark, calls))
    assert len(calls[1]) == 2 and out.count() == 20


def test_a_run_that_stops_between_data_and_manifest_is_no_hit(spark, tmp_path, monkeypatch):
    held, calls = cache.ResultCache(spark, str(tmp_path / "c"), KEYS), []
    old, new = store.cache_key(files(spark), KEYS), store.cache_key(files(spark, {(1, "pre")}), KEYS)
    held.refresh(old, maker(spark, calls))
    replace = cache.ResultCache._replace
    monkeypatch.setattr(cache.ResultCache, "_replace", lambda self, name, rows: replace(self, name, rows) if name == "data" else (_ for _ in ()).throw(OSError("stopped")))
    with pytest.raises(OSError, match="stopped"):
        held.refresh(new, maker(spark, calls))
    monkeypatch.undo()
    assert sorted(r["status"] for r in held.status(new).collect()) == ["hit"] * 3 + ["stale"]
    assert sorted(r["status"] for r in held.status(old).collect()) == ["broken"] + ["hit"] * 3


def test_empty_results_and_other_columns(spark, tmp_path):
    held = cache.ResultCache(spark, str(tmp_path / "c"), KEYS)
    wanted = store.cache_key(files(spark), KEYS)
    out, _ = held.refresh(wanted, lambda missing: results(spark).where("odor = 1 and state = 'pre'"))
    assert out.count() == 5 and {r["status"] for r in held.status(wanted).collect()} == {"hit"}
    with pytest.raises(ValueError, match="other columns"):
        held.write(results(spark).withColumn("w", F.lit(1)), wanted)
    assert held.drop(wanted.where("odor = 1")) == 2 and held.drop(wanted.where("odor = 1")) == 0
    assert sorted(r["status"] for r in held.status(wanted).collect()) == ["absent", "absent", "hit", "hit"]


def movie(spark):
    rows = [(k, t, y, x, float((k * 7 + t * 3 + y * 5 + x * 2) % 11 + (t > 4))) for k in range(4) for t in range(10) for y in range(3) for x in range(3)]
    trials = spark.createDataFrame([(k, k % 2, 4) for k in range(4)], "trial int, odor int, on int")
    return spark.createDataFrame(rows, "trial int, t int, y int, x int, v double"), trials


def test_movies_and_maps_behind_caches(spark, tmp_path):
    from ephyra.plans import reports

    frames, trials = movie(spark)
    given = spark.createDataFrame([(k % 2, f"m{k}.tif", 10, dt.datetime(2024, 1, 1)) for k in range(4)], "odor int, name string, size long, modified timestamp")
    movies, maps = (cache.ResultCache(spark, str(tmp_path / n), ["odor"]) for n in ("movies", "maps"))
    got, found = cached.cached_movies(movies, frames, trials, given, 4, 8)
    want, _ = reports.group_z_movies(frames, trials, 4, 8, ["odor"])
    rows = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*want.columns).collect())
    assert rows(got) == rows(want) and {r["status"] for r in found.collect()} == {"absent"}
    moved = trials.withColumn("on", F.when(F.col("odor") == 1, 5).otherwise(F.col("on")))
    _, found = cached.cached_movies(movies, frames, moved.select("trial", "odor", F.col("on").cast("int").alias("on")), given, 4, 5)
    assert {r["status"] for r in found.collect()} == {"stale"}
    _, found = cached.cached_movies(movies, frames, trials, given, 4, 8)
    wanted = found.drop("status")
    done = cached.cached_maps(movies, wanted, maps)
    assert {r["converted"] for r in done.collect()} == {"done"}
    key = cache.derived_key(wanted, maps=cached.MAPS_VERSION)
    have = {(r.odor, r.y, r.x): round(r["corr"], 9) for r in maps.read(key).collect()}
    assert have == {(r.odor, r.y, r.x): round(r["corr"], 9) for r in reports.correlation_maps(want, ["odor"]).collect()}
    assert {r["converted"] for r in cached.cached_maps(movies, wanted, maps, delete_movies=True).collect()} == {"kept"}
    assert {r["status"] for r in movies.status(wanted).collect()} == {"absent"} and maps.read(key).count() == len(have)
    assert {r["converted"] for r in cached.cached_maps(movies, wanted, maps).collect()} == {"source is absent"}
