"""Sources, stores, clocks on odd inputs, dimension tables and streams."""

import datetime as dt
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from ephyra.functions import columns
from ephyra.operators import catalog, clock, pixels, response, stage0
from ephyra.sources import files, store
from ephyra.streaming import events


def test_sqlite_and_workbook(spark, tmp_path):
    db = tmp_path / "c.db"
    with sqlite3.connect(db) as con:
        con.execute("create table experiments (exp_id INTEGER, exp_name TEXT, frame_rate REAL)")
        con.executemany("insert into experiments values (?,?,?)", [(i, f"e{i}", None if i == 2 else i / 2) for i in range(5)])
    got = files.sqlite_table(spark, str(db), "experiments")
    assert got.count() == 5 and got.where("frame_rate is null").first()["exp_name"] == "e2"
    with pytest.raises(Exception):
        files.sqlite_table(spark, str(db), "a; drop table x").count()
    x = tmp_path / "w.xlsx"
    with zipfile.ZipFile(x, "w") as z:
        m, r = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
        z.writestr("xl/workbook.xml", f'<workbook {m} {r}><sheets><sheet name="Mono" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {m}><si><t>odor</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {m}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="AA1" t="s"><v>1</v></c></row><row r="2"><c r="A2"><v>7</v></c><c r="B2" t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>')
    cells = {(c["row"], c["col"]): c["text"] for c in files.workbook(spark, str(x)).collect()}
    assert cells == {(1, 0): "odor", (1, 26): "ab", (2, 0): "7", (2, 1): "in"}
    w = files.wide(files.workbook(spark, str(x)), "Mono", {"id": 0, "name": 1}).where("row = 2").first()
    assert (w["id"], w["name"]) == ("7", "in")


def test_session_round_trip_and_staleness(spark, tmp_path):
    p = str(tmp_path / "round")
    masks = spark.createDataFrame([(0, 0, 1), (0, 1, 1), (2, 2, 2)], "y int, x int, label int")
    traces = spark.createDataFrame([(1, 0, 0, 1.0)], "roi int, trial int, frame int, v double")
    assert store.verify_session(spark, p) == "no rounds found"
    store.write_session(p, {"masks": masks, "traces": traces}, group_id=7)
    assert store.verify_session(spark, p) == "ok" and {r["key"]: r["value"] for r in store.read_session(spark, p)["meta"].collect()}["group_id"] == "7"
    masks.where("label = 1").write.mode("overwrite").parquet(p + "/masks")
    assert store.verify_session(spark, p) == "STALE"
    q = str(tmp_path / "mask_only")
    store.write_session(q, {"masks": masks})
    assert store.verify_session(spark, q) == "mask only"
    assert store.session_name(7, "x", "20x", on=dt.date(2026, 1, 2), suffix=".pq") == "group7_x_20x_stage1_20260102.pq"
    with pytest.raises(ValueError):
        store.verified_rows(spark, p + "/masks", 99, ["label"])


def test_snapshot_and_resumption(spark, tmp_path):
    p, df = str(tmp_path / "snap"), spark.range(5)
    assert store.snapshot(df, p, 0.0)[1] == "copied" and store.snapshot(df, p, 0.0)[1] == "reused"
    assert store.snapshot(df, p, 4e9)[1] == "copied" and store.snapshot(df, p, 4e9, max_age_s=3600)[1] == "reused"
    trials = spark.createDataFrame([(i,) for i in range(4)], "trial_id long")
    e = store.Extraction(spark, str(tmp_path / "x"))
    assert e.pending(trials).count() == 4
    e.add(spark.createDataFrame([(1, 0.5), (2, 0.25)], "trial_id long, v double"))
    e.add(spark.createDataFrame([(2, 0.75)], "trial_id long, v double"))
    assert sorted(r[0] for r in e.pending(trials).collect()) == [0, 3] and spark.read.parquet(e.path).agg(F.sum("v")).first()[0] == 1.25


def test_csv_counts_and_times(spark, tmp_path):
    for name, text in (("a", "time,frame\n1,2\n3,4\n\n"), ("b", "1.5,2\n3,4\n")):
        (tmp_path / name).write_text(text)
        assert store.csv_frames(spark, str(tmp_path / name)) == 2
    assert store.check_counts(decoded=3, pulses=3) == 3
    with pytest.raises(ValueError, match="decoded 3.*pulses 2.*csv 2"):
        store.check_counts(decoded=3, pulses=2, csv=2)
    v = spark.createDataFrame([("v_20260819_120000.mp4", '{"mm_summary":{"StartTime":"2026-08-05 12:39:41.048 -0700"}}', None), ("v_20260819_140000.mp4", None, None)], "path string, sidecar string, container string").withColumn("modified", F.lit(None).cast("timestamp"))
    got = store.ordered_pair(store.recording_times(v)).collect()
    assert [r["at_source"] for r in got] == ["sidecar", "path"] and got[0]["at"] == dt.datetime(2026, 8, 5, 19, 39, 41, 48000)
    with pytest.raises(ValueError):
        store.ordered_pair(store.recording_times(v.limit(1)))


def test_digests_change_with_content(spark):
    f = spark.createDataFrame([("a", "m1", 10), ("a", "m2", 20)], "k string, name string, size long").withColumn("modified", F.lit("2026-01-01").cast("timestamp"))
    key = lambda df, **p: store.cache_key(df, ["k"], **p).first()["key"]
    assert key(f, pre=2.0) == key(f.orderBy(F.desc("name")), pre=2.0) != key(f, pre=3.0) and key(f, pre=2.0) != key(f.withColumn("size", F.col("size") + 1), pre=2.0)
    m = spark.createDataFrame([(0, 1, 1), (5, 2, 2)], "y int, x int, label int")
    assert pixels.mask_digest(m).first()[0] == pixels.mask_digest(m.orderBy(F.desc("y"))).first()[0] != pixels.mask_digest(m.withColumn("x", F.col("x") + 1)).first()[0]
    best = store.source_choice(spark.createDataFrame([("e", "trigger", "b"), ("e", "sync", "z"), ("e", "sync", "y")], "k string, kind string, path string"), ["k"], ["sync", "trigger"]).first()
    assert (best["kind"], best["path"]) == ("sync", "y")


def test_columns(spark):
    r = spark.createDataFrame([("AA3", " 2.5 ", "a b/c", "x\\y")], "ref string, n string, s string, p string").select(
        columns.column_index("ref").alias("i"), columns.whole_cell("n").alias("w"), columns.number_cell("s").alias("bad"), columns.slug("s").alias("slug"), columns.joined_path("m", "p").alias("path"), columns.percent(F.lit(0.256)).alias("pct")
    ).first()
    assert tuple(r) == (26, 2, None, "a_b_c", "m/x/y", "25.6%")


def test_states_and_resolution(spark):
    t = spark.createDataFrame([(1, "p", 3), (2, "q", 1), (3, "p", 4), (4, "q", 2)], "id int, program string, at int").withColumn("k", F.lit(0))
    got = {r["id"]: (r["state"], r["trial_in_block"]) for r in catalog.assign_state(t, ["k"], "program", "at", "id").collect()}
    assert got == {1: ("post", 1), 2: ("pre", 1), 3: ("post", 2), 4: ("pre", 2)}
    with pytest.raises(Exception, match="more than 2"):
        catalog.assign_state(t.withColumn("program", F.col("id").cast("string")), ["k"], "program", "at", "id").collect()
    trials = spark.createDataFrame([(1,), (2,), (3,), (4,), (None,)], "acq_id long")
    fl = spark.createDataFrame([(1, "a", True, 1, "s"), (2, "b", None, 1, "s"), (4, "old", True, 1, "s"), (4, "new", True, 2, "s")], "acq_id long, path string, approved boolean, file_id int, source string")
    win = spark.createDataFrame([(1, 5, 9)], "acq_id long, on_frame int, off_frame int")
    got = {r["acq_id"]: (r["path"], r["reason"]) for r in catalog.resolve_inputs(trials, fl, win).collect()}
    assert got == {1: ("a", None), 2: ("b", "not approved"), 3: (None, "no file"), 4: ("new", "no window"), None: (None, "no file")}
    with pytest.raises(ValueError):
        catalog.combine([t, t, t], ["a", "b", "c"])
    with pytest.raises(Exception, match="differ in number"):
        catalog.paired_by_place(t, t.limit(2).select("k", F.col("at").alias("w")), ["k"], ["at"], ["w"]).collect()


def test_clock_on_a_square_wave(spark):
    v = [0, 0, 5, 5, 0, 5, 0, 0, 5]
    s = spark.createDataFrame([("c", i, float(x)) for i, x in enumerate(v)], "k string, i long, v double")
    assert sorted((r["on"], r["off"]) for r in clock.pulses(s, ["k"], ["i"], "v", "i").collect()) == [(2, 4), (5, 6)]
    on = spark.createDataFrame([("c", i) for i in (0, 3, 6, 9, 20, 23, 26)], "k string, i long")
    assert sorted(r["i"] for r in clock.debounced(on, ["k"], "i", 5).collect()) == [0, 6, 20, 26]
    f = spark.createDataFrame([("c", i, 10 * i, i // 5) for i in range(10)], "k string, frame long, at long, block long")
    odor = spark.createDataFrame([("c", 14, 33), ("c", 22, 24), ("c", 65, 999)], "k string, on long, off long")
    want = {"contains": [(1, 3), (1, 4)], "next": [(2, 4), (2, 4)], "nearest": [(1, 3), (1, 4)]}
    for how, frames in want.items():
        got = clock.odor_frames(f, odor, ["k"], how).orderBy("block").collect()
        assert [(r["on_frame"], r["off_frame"]) for r in got] == frames, how
    w = clock.trigger_windows(spark.createDataFrame([("c", 0), ("c", 100)], "k string, at long"), spark.createDataFrame([("c", 30), ("c", 250)], "k string, at long"), spark.createDataFrame([("c", 55)], "k string, at long"), ["k"], "at", 100, 10.0, 5.0).collect()
    assert [(r["at"], r["on_frame"], r["off_frame"]) for r in w] == [(0, 15, 28)]


def test_feasibility_and_bh(spark):
    p = spark.createDataFrame([("A", 1, 101, "m", 1, 10.0, 2, 5.0), ("A", 2, 1, "x", 1, 10.0, None, None), ("A", 3, 2, "y", 2, 1.0, None, None)], "panel string, vial_position int, odor_id int, mix_name string, component_a_odor_id int, component_a_ppm double, component_b_odor_id int, component_b_ppm double")
    assert {r["slot"]: (r["status"], r["dose_ratio"]) for r in stage0.panel_feasibility(p).collect()} == {"A": ("exact", 1.0), "B": ("extrapolation", 5.0)}
    ps = [0.001, 0.008, 0.039, 0.041, 0.042, 0.06, 0.2, None]
    got = response.bh_reject(spark.createDataFrame([(i, x) for i, x in enumerate(ps)], "i int, p double"), "p", 0.05).collect()
    assert [r["i"] for r in sorted(got, key=lambda r: r["i"]) if r["rejected"]] == [0, 1]


def test_streams(spark, tmp_path, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value", "event_id")
    src = str(tmp_path / "in")
    e.repartition(1).sortWithinPartitions("ts").write.parquet(src)
    live = events.arriving(spark, src, e.schema)

    def run(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(120)
        return spark.table(name)

    assert run(events.tiles(live, "user_id", "ts", "value", "1 day"), "tiles", "complete").agg(F.sum("n")).first()[0] == e.count()
    assert run(events.sessions(live, "user_id", "ts", "4 hours"), "bursts", "complete").agg(F.sum("n")).first()[0] == e.count()
    assert run(events.first_of_each(live, ["event_id"], "ts"), "once").count() == e.count()
    us = live.select("user_id", columns.micros("ts").alias("us"))
    batch = clock.debounced(e.select("user_id", columns.micros("ts").alias("us")).distinct(), ["user_id"], "us", 7_200_000_000)
    assert sorted(map(tuple, run(events.debounced(us, "user_id", "us", 7_200_000_000), "deb").collect())) == sorted(map(tuple, batch.collect()))


def test_bundles_rounds_and_tuning(spark, tmp_path):
    m = spark.createDataFrame([(0, 0, 1), (0, 1, 2)], "y int, x int, label int")
    store.write_bundle(str(tmp_path / "b_masks_1"), "masks", {"masks": m}, block=5)
    t, meta = store.read_bundle(spark, str(tmp_path / "b_masks_1"), "masks")
    assert t["masks"].count() == 2 and meta["config.block"] == "5"
    with pytest.raises(ValueError, match="not 'other'"):
        store.read_bundle(spark, str(tmp_path / "b_masks_1"), "other")
    store.write_session(str(tmp_path / "g_stage1_2026"), {"masks": m.where("label = 1")})
    assert [p.rpartition("/")[2] for p in store.find_rounds(spark, str(tmp_path))] == ["g_stage1_2026"]
    assert store.latest_mask(spark, str(tmp_path)).count() == 1 and store.listed(spark, str(tmp_path / "none")) == []
    assert store.replayed(m, m).count() == 2
    with pytest.raises(ValueError):
        store.replayed(m, m.where("label = 1"))
    (tmp_path / "t.json").write_text('{"roi": [1, 2, 3, 4], "bright": 97.0}')
    assert store.tuning(spark, str(tmp_path / "t.json"))["roi"] == (1, 2, 3, 4)
    store.signed("a", None)
    with pytest.raises(ValueError):
        store.signed("a", "b")


def test_edits_points_and_channels(spark):
    from ephyra.operators import grouping

    m = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (0, 2, 3)], "y int, x int, label int")
    e = spark.createDataFrame([(1, "drop", 1), (2, "drop", 2), (3, "delete", 2)], "edit_id int, action string, target int")
    assert sorted((r["x"], r["label"]) for r in grouping.curated(m, e).collect()) == [(1, 1), (2, 2)]
    both = m.withColumn("kind", F.lit("process")).unionByName(spark.createDataFrame([(0, 1, 9, "soma")], "y int, x int, label int, kind string"))
    at = {r["x"]: (r["kind"], r["label"]) for r in grouping.roi_at(both, spark.createDataFrame([(0, 1), (0, 2), (5, 5)], "y int, x int")).collect()}
    assert at == {1: ("soma", 9), 2: ("process", 3), 5: (None, None)}
    assert grouping.mask_summary(m, 3, 3).first()["n_rois"] == 3
    s = spark.createDataFrame([("a", i, [float(i), 1.0]) for i in range(4)], "channel string, at long, value array<double>")
    assert clock.header(s, ["channel"], "at", 2.0).first()["duration_s"] == 2.0 and clock.channel(s, "a", 1).where("value = 1.0").count() == 4
