"""Catalogue snapshots, reconciliation, sources, plans and the stream."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from refrain.operators import catalog as cat
from refrain.operators import match, reconcile
from refrain.operators.catalog import Catalog
from refrain.plans import commands, progress, removal
from refrain.plans.params import DetectParams
from refrain.plans.scan import scan, summary
from refrain.sources import library
from refrain.streaming.incremental import watch_fingerprints
from test_core import plain_covered

SEC = 0.1238
P = DetectParams()


def noise(rng, n):
    return [rng.getrandbits(32) for _ in range(n)]


def fuzz(rng, items):
    return [v ^ (1 << rng.randrange(32)) for v in items]


def catalog(spark, patterns=(), clips=(), prints=()):
    """patterns: (status, items); clips: (pattern, file, start, end); prints: (file, items)."""
    c = Catalog.empty(spark)
    if patterns:
        rows = [("lib", "f", s, 32, SEC, i, len(i) * SEC, k) for k, (s, i) in enumerate(patterns)]
        c = cat.add_patterns(c, spark.createDataFrame(rows, "library string, folder string, status string, bits int, item_sec double, items array<long>, duration double, k int"), 1.0, ["k"])
    if clips:
        c = cat.add_clips(c, spark.createDataFrame([(*x, k) for k, x in enumerate(clips)], "pattern_id long, file_path string, start double, end double, k int"), 1.0, ("k",))
    if prints:
        c = cat.store_fingerprints(c, spark.createDataFrame([(f, "f", 32, SEC, i) for f, i in prints], "file_path string, folder string, bits int, item_sec double, items array<long>"), 1.0)
    return c.settled()


def spans(c):
    return sorted((r.pattern_id, r.file_path, round(r.start, 2), round(r.end, 2)) for r in c.clips.collect())


def test_known_pattern_is_applied_once_everywhere(spark):
    rng = random.Random(1)
    ad = noise(rng, 100)
    prints = [("a", noise(rng, 30) + fuzz(rng, ad)), ("b", noise(rng, 60) + fuzz(rng, ad) + noise(rng, 40) + fuzz(rng, ad)), ("c", noise(rng, 200))]
    c = catalog(spark, [("pending", ad)], prints=prints)
    c = reconcile.review(c, 1, "ad", P, 2.0).settled()
    assert [x[1] for x in spans(c)] == ["a", "b", "b"]
    assert c.patterns.first().shows == 4 or c.patterns.first().shows == 3
    again, added = reconcile.apply_known(c, P, 3.0)
    assert added.count() == 0
    with pytest.raises(ValueError):
        reconcile.review(c, 1, "maybe", P, 2.0)
    with pytest.raises(ValueError):
        cat.set_status(c, c.patterns, "odd", 1.0)


def test_scan_groups_normalises_and_reuses(spark):
    rng = random.Random(2)
    short, long = noise(rng, 80), noise(rng, 160)
    batch = [(f, "f", 32, SEC, noise(rng, 20 + 7 * k) + fuzz(rng, short) + noise(rng, 60) + fuzz(rng, long) + noise(rng, 20), k) for k, f in enumerate("abc")]
    df = spark.createDataFrame(batch, "file_path string, folder string, bits int, item_sec double, items array<long>, idx int")
    before = Catalog.empty(spark)
    events = []
    after = scan(before, df, P, 1.0, "lib", progress=lambda e: events.extend(progress.enriched(e).collect()))
    assert [e.stage for e in events if e.stage != "found"] == ["detect", "normalize", "done"] and sum(e.stage == "found" for e in events) == 6 and events[-1].percent == 99.0
    patterns = after.patterns.orderBy("duration").collect()
    assert [round(p.duration / SEC) for p in patterns] == pytest.approx([80, 160], abs=4)
    assert [p.shows for p in patterns] == [3, 3]
    lengths = {}
    for r in after.clips.collect():
        lengths.setdefault(r.pattern_id, []).append(r.end - r.start)
    assert all(max(x) - min(x) < 0.7 for x in lengths.values())
    assert tuple(summary(before, after, df).first()) == (3, 2, 6)
    assert cat.add_patterns(after, after.patterns.limit(0).select("library", "folder", "items", "item_sec", "bits", "duration"), 1.0, ["folder"]).patterns.count() == 2


def test_absorb_pending(spark):
    clips = [(1, "a", 10.0, 20.0), (2, "a", 10.5, 20.0), (2, "b", 0.0, 5.0), (3, "a", 11.0, 19.0), (4, "a", 10.0, 20.0), (5, "a", 3.0, 3.0)]
    c = catalog(spark, [("confirmed", [1]), ("pending", [1]), ("pending", [1]), ("dismissed", [1]), ("pending", [1])], clips)
    one = spark.createDataFrame([(1,)], "id long")
    assert [r.id for r in reconcile.absorbed(c.patterns, c.clips, one).collect()] == [3]
    assert sorted(r.id for r in reconcile.absorbed(c.patterns, c.clips, one, 0.5).collect()) == [2, 3]


def plain_dedupe(clips, tol):
    """Of (id, file, status, start, end), the ids that strictly shorter clips of the same file and status cover."""
    same = lambda c, o: c[1:3] == o[1:3] and (o[4] - o[3]) - (c[4] - c[3]) < -1e-6
    return {c[0] for c in clips if plain_covered([o[3:] for o in clips if same(c, o)], c[3], c[4], tol)}


def test_dedupe_contained_matches_plain_python(spark):
    rng = random.Random(7)
    status = {1: "confirmed", 2: "pending"}
    clips = []
    for k in range(160):
        s = rng.uniform(0, 40)
        clips.append((rng.choice((1, 2)), rng.choice("abcd"), s, s + rng.choice((0.5, 1.2, 4, 8, 16)) * rng.uniform(0.8, 1.2)))
    c = catalog(spark, [(status[1], [1]), (status[2], [1])], clips)
    rows = [(r.id, r.file_path, status[r.pattern_id], r.start, r.end) for r in c.clips.collect()]
    assert {r.id for r in reconcile.contained_clips(c.patterns, c.clips).collect()} == plain_dedupe(rows, 1.5)


def test_dedupe_keeps_atoms_and_deletes_empty_patterns(spark):
    c = catalog(spark, [("pending", [1])] * 3, [(1, "a", 0.0, 30.0), (2, "a", 30.8, 60.0), (3, "a", 0.0, 60.0)])
    after = reconcile.dedupe_contained(c)
    assert spans(after) == [(1, "a", 0.0, 30.0), (2, "a", 30.8, 60.0)]
    assert sorted(r.id for r in after.patterns.collect()) == [1, 2]


def test_relocate_snaps_pulls_in_and_splits(spark):
    rng = random.Random(3)
    ad = noise(rng, 500)
    prints = [("a", noise(rng, 100) + ad + noise(rng, 50)), ("b", noise(rng, 40) + fuzz(rng, ad) + noise(rng, 20)), ("c", noise(rng, 80) + fuzz(rng, ad)), ("d", noise(rng, 700))]
    at = lambda s, e: (s * SEC, e * SEC)
    clips = [(1, "a", *at(100, 600)), (1, "b", *at(20, 500)), (1, "d", *at(0, 400))]
    c = catalog(spark, [("pending", ad)], clips, prints)
    after = reconcile.relocate_group(c, 1, P, 2.0).settled()
    group = [x for x in spans(after) if x[0] == 1]
    assert [(f, s) for _, f, s, _ in group] == [("a", 12.38), ("b", round(40 * SEC, 2)), ("c", round(80 * SEC, 2))]
    assert len({round(e - s, 1) for _, _, s, e in group}) == 1
    assert [x[1] for x in spans(after) if x[0] != 1] == ["d"]
    kept = reconcile.relocate_group(c, 1, P, 2.0, split_nonmatches=False)
    assert [x[1] for x in spans(kept)] == ["a", "b", "c", "d"]
    with pytest.raises(LookupError):
        reconcile.relocate_group(catalog(spark, [("pending", ad)], clips), 1, P, 2.0)


def test_bounds_moves_and_groups(spark):
    rng = random.Random(4)
    items = noise(rng, 100)
    c = catalog(spark, [("pending", items), ("pending", items)], [(1, "a", 0.0, 5.0), (1, "a", 20 * SEC, 40 * SEC), (2, "b", 1.0, 2.0)], [("a", items)])
    moved = cat.set_bounds(c, spark.createDataFrame([(1, 1.0, 4.0)], "id long, start double, end double"))
    row = moved.clips.filter("id = 1").first()
    assert (row.start, row.end, row.orig_start, row.orig_end) == (1.0, 4.0, 0.0, 5.0)
    shown = {r.id: r for r in cat.payload(moved.patterns, moved.clips).collect()}
    assert [(x.id, x.edited) for x in shown[1].clips] == [(1, True), (2, False)]
    back = cat.reset_clips(moved, spark.createDataFrame([(1,)], "id long")).clips.filter("id = 1").first()
    assert (back.start, back.end) == (0.0, 5.0)
    gone = cat.move_clips(c, spark.createDataFrame([(3, 1)], "id long, pattern_id long"), 1.0)
    assert [(r.id, r.shows) for r in gone.patterns.collect()] == [(1, 3)]
    made, new = cat.new_group(c, 2, 1.0)
    row = made.patterns.filter(F.col("id") == new).first()
    assert row["items"] == items[20:40] and row.pinned and row.shows == 1
    with pytest.raises(LookupError):
        cat.new_group(c, 3, 1.0)


def test_catalogue_round_trip_and_exports(spark, tmp_path):
    c = catalog(spark, [("confirmed", [1, 2])], [(1, "x/a.mp3", 0.0, 5.0)], [("x/a.mp3", [1, 2, 3])])
    c = cat.add_processed(c, spark.createDataFrame([("x/a.mp3", "o", [(0.0, 5.123)], 3725.0)], "file_path string, output_path string, removed array<struct<start: double, end: double>>, saved_sec double"), 2.0)
    c.write(str(tmp_path / "c"))
    back = Catalog.read(spark, str(tmp_path / "c"))
    for name in cat.SCHEMAS:
        assert sorted(map(str, getattr(back, name).select(*getattr(c, name).columns).collect())) == sorted(map(str, getattr(c, name).collect()))
    lines = [r.line for r in cat.export_markdown(back.patterns, back.clips, back.processed).orderBy("part", "id", "at").collect()]
    assert "_1 patterns · 1 clips · 1 processed files_" in lines and "- `a.mp3` — saved 1:02:05" in lines and "  - 0:00 → 0:05" in lines
    assert cat.export_json(back, 1.0).count() == 4
    assert cat.delete_patterns(back, spark.createDataFrame([(1,)], "id long")).clips.count() == 0
    old = spark.createDataFrame([(1, "Ad", 2.0)], "id long, label string, duration double")
    row = cat.migrated(old, "patterns").first()
    assert (row.status, row.shows, row.orig_duration) == ("confirmed", 1, 2.0)


def test_library_listing(spark, tmp_path):
    for f in ("Show A/ep2.mp3", "Show A/ep1.mp3", "Show B/deep/clip.mp4", "loose.m4a", "Show B/note.txt", ".hidden/x.mp3", "_trimmed/y.mp3", "Show A/.cache/z.mp3", "Show A/.odd.mp3"):
        (tmp_path / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f).write_bytes(b"")
    files = library.scan_library(spark, str(tmp_path))
    assert [(r.folder, r.file_name) for r in files.collect()] == [("(root)", "loose.m4a"), ("Show A", ".odd.mp3"), ("Show A", "ep1.mp3"), ("Show A", "ep2.mp3"), ("Show B", "clip.mp4")]
    assert {r.folder: r.kind for r in library.folders(files).collect()} == {"(root)": "audio", "Show A": "audio", "Show B": "video"}
    script = tmp_path / "tool"
    script.write_text('#!/bin/sh\ncase "$4" in *ep1*) echo DURATION=4; echo FINGERPRINT=1,2;; *) echo bad >&2; exit 1;; esac\n')
    script.chmod(0o755)
    good, bad = library.fingerprint(files.filter("folder = 'Show A'"), fpcalc=str(script))
    assert [(r.file_name, r["items"], r.item_sec) for r in good.collect()] == [("ep1.mp3", [1, 2], 2.0)]
    assert {r.error for r in bad.collect()} == {"tool failed (exit 1): bad"}
    assert {r.kind for r in library.probe(files.withColumn("file_path", F.lit("x.odd")), str(script)).collect()} == {"audio"}
    parts = [(r.part, r.name) for r in commands.status(files).collect()]
    assert {n for p, n in parts if p == "folder"} == {"(root)", "Show A", "Show B"} and ("tool", "fpcalc") in parts and ("state", "confirmed") in parts


def test_removal_plan_and_progress(spark):
    ranges = spark.createDataFrame([("a.mp3", 0.0, 5.0), ("a.mp3", 4.0, 8.0), ("b.mkv", 0.0, 10.0)], "file_path string, start double, end double")
    files = spark.createDataFrame([("a.mp3", "audio", 20.0), ("b.mkv", "video", 10.0)], "file_path string, kind string, duration double")
    plan = {r.file_path: r for r in removal.remove_plan(ranges, files).collect()}
    assert [tuple(k) for k in plan["a.mp3"].keep] == [(8.0, 20.0)] and plan["a.mp3"].saved_sec == 8.0 and plan["a.mp3"].encoder == "libmp3lame" and plan["a.mp3"].error is None
    assert plan["b.mkv"].error and plan["b.mkv"].out_ext == "mp4"
    events = spark.createDataFrame([("fingerprint", "x", 5, 10, 10.0, 0), ("detect_progress", None, 1, 2, 4.0, 0), ("preview", "x", 0, 0, 0.0, 50), ("done", None, 0, 0, 0.0, 0)], "stage string, file string, index int, total int, elapsed double, previews int")
    assert [(r.percent, r.eta_seconds) for r in progress.enriched(events).collect()] == [(40.0, 10), (89.5, 4), (99.0, None), (99.0, None)]


def test_stream_matches_new_files(spark, tmp_path):
    rng = random.Random(9)
    ad = noise(rng, 100)
    c = catalog(spark, [("confirmed", ad)])
    prints = catalog(spark, prints=[("n", noise(rng, 30) + fuzz(rng, ad)), ("m", noise(rng, 90))]).fingerprints
    prints.write.parquet(str(tmp_path / "in"))
    watch_fingerprints(spark, str(tmp_path / "in"), c.patterns, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert [(r.pattern_id, r.file_path) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, "n")]
    # the same file again, and a new one: only the new one has a place that no clip marks
    catalog(spark, prints=[("n", prints.filter("file_path = 'n'").first()["items"]), ("o", fuzz(rng, ad))]).fingerprints.write.mode("append").parquet(str(tmp_path / "in"))
    watch_fingerprints(spark, str(tmp_path / "in"), c.patterns, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(r.file_path for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["n", "o"]


def plain_apart(rows, stored):
    """Clips added one after another: none within a second of one that is there."""
    there, out = list(stored), []
    for r in sorted(rows):
        if not any(r[:2] == x[:2] and abs(r[2] - x[2]) < 1.0 for x in there):
            there.append(r)
            out.append(r)
    return sorted(out)


def test_clips_are_added_one_after_another(spark):
    rng = random.Random(12)
    rows = [(rng.randrange(3), rng.choice("ab"), round(rng.uniform(0, 12), 1), 20.0) for _ in range(90)]
    stored = [(rng.randrange(3), rng.choice("ab"), round(rng.uniform(0, 12), 1)) for _ in range(6)]
    schema = "pattern_id long, file_path string, start double, end double"
    got = cat.new_clips(spark.createDataFrame(rows, schema), spark.createDataFrame(stored, "pattern_id long, file_path string, start double"))
    assert got.columns == ["pattern_id", "file_path", "start", "end"] and sorted(map(tuple, got.collect())) == plain_apart(rows, stored)
    ad = noise(rng, 6)  # 0.74 s, twice in a row: the second starts too close to the first
    c = catalog(spark, [("confirmed", ad)], prints=[("a", noise(rng, 40) + ad + ad + noise(rng, 40))])
    after, added = reconcile.apply_known(c, P, 1.0, c.patterns.select("id"))
    assert [round(r.start, 2) for r in added.collect()] == [round(40 * SEC, 2)] and after.patterns.first().shows == 2


def test_numbers_follow_one_order_over_all_partitions(spark):
    c = catalog(spark, [("pending", [1])] * 3)
    rows = spark.range(0, 500, 1, 7).select(F.lit(1).cast("long").alias("pattern_id"), F.concat(F.lit("f"), (F.col("id") * 37 % 500).cast("string")).alias("file_path"), (F.col("id") % 9).cast("double").alias("start"), F.lit(20.0).alias("end"))
    clips = cat.add_clips(cat.add_clips(c, rows.limit(0), 1.0), rows, 1.0, ("start", "file_path")).clips.orderBy("id").collect()
    assert [r.id for r in clips] == list(range(1, 501)) and clips == sorted(clips, key=lambda r: (r.start, r.file_path))


def test_leaders_are_those_of_one_walk(spark):
    rng = random.Random(15)
    segments = [(f, k, k) for f in "ab" for k in range(60)]
    among = [(f, a, b) for f in "ab" for a in range(60) for b in range(a) if rng.random() < 0.06]
    known = [(f, k, p) for f in "ab" for k in range(60) for p in (7, 9) if rng.random() < 0.1]
    want = set()
    for f in "ab":
        leads = []
        for k in range(60):
            first = [p for g, s, p in known if (g, s) == (f, k)]
            fits = [b for b in leads if (f, k, b) in among]
            want.add((f, k, min(first), True) if first else (f, k, min(fits), False) if fits else (f, k, k, False))
            if not first and not fits:
                leads.append(k)
    make = lambda rows, names: spark.createDataFrame(rows, f"folder string, {names}")
    found = reconcile.assign_leaders(make(segments, "segment long, idx long"), make(known, "segment long, pattern long"), make(among, "segment long, earlier long"))
    assert {tuple(r) for r in found.collect()} == want and found.count() == 120


def _segments(spark, n):
    rng = random.Random(21)
    lines = [noise(rng, 30) for _ in range(4)]
    rows = []
    for k in range(n):
        items = noise(rng, k % 5) + fuzz(rng, lines[k % 4]) + noise(rng, k % 7) if k % 6 else noise(rng, 30)
        rows.append((f"f{k % 2}", 32, k, k, 0.1238, items, len(items) * 0.1238))
    return spark.createDataFrame(rows, "folder string, bits int, file long, idx long, item_sec double, items array<long>, duration double")


def test_batches_have_the_same_leaders(spark, monkeypatch):
    segs, p = _segments(spark, 60), DetectParams(min_seconds=1.0)
    known = spark.createDataFrame([("f0", 2, 900), ("f0", 2, 800)], "folder string, segment long, pattern long")
    edges = reconcile.leader_edges(segs, segs, p, self_match=True)
    among = edges.select("folder", F.col("a").alias("segment"), F.col("b").alias("earlier"))
    rows = lambda df: sorted(tuple(r) for r in df.select("folder", "segment", "leader", "known").collect())
    wanted = rows(reconcile.assign_leaders(segs.select("folder", F.col("file").alias("segment"), "idx"), known, among))
    assert rows(reconcile.led(segs, known, p)) == wanted and len(wanted) == 60
    monkeypatch.setattr(reconcile, "FIRST", 8)
    monkeypatch.setattr(reconcile, "GROWTH", 2)
    met, edged = [], reconcile.leader_edges
    monkeypatch.setattr(reconcile, "leader_edges", lambda *a, **k: met.append(edged(*a, **k)) or met[-1])
    assert rows(reconcile.led(segs, known, p)) == wanted
    assert len(met) > 3 and sum(df.count() for df in met) < edges.count() / 2


def test_stored_tables_are_not_written_again(spark):
    once = Catalog.empty(spark).settled()
    again = replace(once, clips=once.clips.filter("id > 0")).settled()
    assert again.fingerprints is once.fingerprints and again.clips is not once.clips


def test_normalizing_looks_at_members_alone(spark, monkeypatch):
    rng, p = random.Random(5), DetectParams()
    ad = noise(rng, 100)
    prints = [(f"f{k}", "f", 32, 0.1238, noise(rng, 20) + ad + noise(rng, 20), 0.0) for k in range(4)]
    clips = [(k, k // 2, f"f{k}", 20 * 0.1238, 120 * 0.1238) for k in range(4)]
    found = Catalog.empty(spark)
    found = replace(
        found,
        fingerprints=spark.createDataFrame(prints, cat.SCHEMAS["fingerprints"]),
        patterns=cat.migrated(spark.createDataFrame([(k, "f", ad, 12.38, 0.1238, 32) for k in range(2)], "id long, folder string, items array<long>, duration double, item_sec double, bits int").withColumn("pinned", F.lit(False)), "patterns"),
        clips=cat.migrated(spark.createDataFrame(clips, "id long, pattern_id long, file_path string, start double, end double"), "clips"),
    )
    pairs, covered = [], match.coverage_at
    monkeypatch.setattr(match, "coverage_at", lambda cands, *a: pairs.append(cands.select("a", "b").distinct().count()) or covered(cands, *a))
    done = reconcile.normalize_lengths(found, found.patterns.select("id"), p, 1.0)
    assert pairs == [4] and {round(r.start / 0.1238) for r in done.clips.collect()} == {20}


def test_adjust_reset_relocate_and_remove(spark):
    rng = random.Random(16)
    ad = noise(rng, 300)
    at = lambda s, e: (s * SEC, e * SEC)
    prints = [("x/a.mp3", noise(rng, 100) + ad + noise(rng, 50)), ("x/b.mp3", noise(rng, 40) + fuzz(rng, ad)), ("x/d.mp3", noise(rng, 400))]
    c = catalog(spark, [("confirmed", ad)], [(1, "x/a.mp3", *at(100, 400)), (1, "x/d.mp3", *at(0, 200))], prints)
    for bad in ((5.0, 5.1), (3.0, 1.0), (-9.0, 0.1)):
        with pytest.raises(ValueError):
            commands.adjust(c, 1, *bad)
    with pytest.raises(LookupError):
        commands.adjust(c, 9, 0.0, 1.0)
    moved = commands.adjust(c, 1, -1.0, 20.0)
    row = moved.clips.filter("id = 1").first()
    assert (row.start, row.end) == (0.0, 20.0)
    row = commands.reset(moved, 1).clips.filter("id = 1").first()
    assert (round(row.start, 2), round(row.end, 2)) == (12.38, 49.52)
    near = commands.relocate(c, 1, P, 2.0, 100 * SEC + 0.5, 400 * SEC)  # hardly cropped: nothing leaves the group
    assert [x[1] for x in spans(near)] == ["x/a.mp3", "x/b.mp3", "x/d.mp3"] and near.patterns.count() == 1
    far = commands.relocate(c, 1, P, 2.0, 100 * SEC, 380 * SEC)
    assert [(p, f) for p, f, _, _ in spans(far)] == [(1, "x/a.mp3"), (1, "x/b.mp3"), (2, "x/d.mp3")]
    files = spark.createDataFrame([("x/a.mp3", "audio", 60.0), ("x/d.mp3", "audio", 0.0)], "file_path string, kind string, duration double")
    done, plan = commands.remove(c, files, "out", 3.0)
    assert [(r.file_path, r.output_path, [tuple(x) for x in r.removed], round(r.saved_sec, 2)) for r in done.processed.collect()] == [("x/a.mp3", "out/a.mp3", [(12.38, 49.52)], 37.14)]
    assert {r.file_path: r.error is None for r in plan.collect()} == {"x/a.mp3": True, "x/d.mp3": False}
    flags = cat.known_files(done, files).collect()
    assert {r.file_path: (r.has_fingerprint, r.is_processed) for r in flags} == {"x/a.mp3": (True, True), "x/d.mp3": (True, False)}
    assert [r.id for r in cat.processed_latest(cat.add_processed(done, done.processed.select("file_path", "output_path", "removed", "saved_sec"), 4.0).processed).collect()] == [2, 1]
    assert [r.id for r in cat.clips_of(c.clips, 1).collect()] == [2, 1]
    assert [r.status for r in cat.ordered_for_review(catalog(spark, [("dismissed", [1]), ("pending", [1]), ("confirmed", [1])]).patterns).collect()] == ["pending", "confirmed", "dismissed"]
    seen = cat.set_preview(c, spark.createDataFrame([(1, "p.mp3")], "id long, preview string"))
    assert [r.preview for r in seen.clips.orderBy("id").collect()] == ["p.mp3", None]
    assert {(r.id, r.seek, r.seconds) for r in removal.preview_plan(spark.createDataFrame([(1, "a", -1.0, 3.0), (2, "a", 4.0, 4.1)], "id long, file_path string, start double, end double")).collect()} == {(1, 0.0, 4.0), (2, 4.0, 0.2)}
