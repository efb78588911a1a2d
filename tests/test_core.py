"""Bits, intervals and the matcher, on small streams and against plain Python."""

import random
import re
import time
from collections import Counter
from itertools import accumulate

import numpy as np
import pytest
from pyspark.sql import functions as F

from refrain.functions import bits, media
from refrain.operators import blocks, intervals, match
from refrain.plans import registry
from refrain.plans.params import DetectParams
from refrain.sources import shared
from refrain.sources.shared import spread

STREAM = "folder string, file string, idx int, bits int, item_sec double, items array<long>"


def noise(rng, n):
    return [rng.getrandbits(32) for _ in range(n)]


def flipped(rng, items, k, bits=32):
    return [v ^ sum(1 << b for b in rng.sample(range(bits), k)) for v in items]


def streams(spark, named, item_sec=0.1238, width=32, folder="f"):
    return spark.createDataFrame([(folder, name, k, width, item_sec, items) for k, (name, items) in enumerate(named)], STREAM)


def column(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()[0]


def test_params():
    assert DetectParams().scaled(64).max_bit_err == 16
    assert DetectParams(max_bit_err=1).scaled(16).max_bit_err == 1
    with pytest.raises(ValueError):
        DetectParams(min_shows=1)


def test_items_match_at_eight_bits_and_not_nine(spark):
    assert column(spark, bits.items_match(F.lit(0xFF), F.lit(0).cast("long"), 8))
    assert not column(spark, bits.items_match(F.lit(0x1FF), F.lit(0).cast("long"), 8))


def test_keys_and_unsigned_values(spark):
    high = bits.unsigned(F.lit("18446744073709551615"))
    assert column(spark, high) == -1
    assert column(spark, bits.seed_key(high, 64)) == 65535
    assert column(spark, bits.seed_key(F.lit(2**32 - 1), 32)) == 65535
    assert column(spark, bits.items_match(high, F.lit(0).cast("long"), 63)) is False


def test_dhash(spark):
    assert column(spark, bits.dhash(F.array(*map(F.lit, (1, 2, 2, 5, 1))))) == 0b0101
    frame = bytes(range(9)) + bytes([9, 8, 7, 6, 5, 4, 3, 2, 1]) + bytes([5] * 54)
    assert column(spark, bits.frame_hashes(F.lit(frame + b"\x01"))) == [0xFF]
    assert column(spark, bits.frame_hashes(F.lit(b""))) == []


def test_slices_round_half_to_even(spark):
    items = F.array(*map(F.lit, range(10)))
    assert column(spark, bits.slice_seconds(items, F.lit(1.0), F.lit(0.5), F.lit(2.5))) == [0, 1]
    assert column(spark, bits.slice_seconds(items, F.lit(1.0), F.lit(1.5), F.lit(99.0))) == list(range(2, 10))
    assert column(spark, bits.slice_seconds(items, F.lit(1.0), F.lit(5.0), F.lit(2.0))) == []
    assert column(spark, bits.trimmed(items, F.lit(2), F.lit(3))) == [2, 3, 4, 5, 6]
    assert column(spark, bits.trimmed(items, F.lit(5), F.lit(5))) == list(range(10))


def test_media_functions(spark):
    assert [column(spark, media.classify_ext(F.lit(p))) for p in ("a/B.MP3", "x.mkv", "x.txt", "noext", "a.b/c")] == ["audio", "video", None, None, None]
    good = '{"format": {"duration": "12.5"}, "streams": [{"codec_type": "video", "disposition": {"attached_pic": 1}}, {"codec_type": "audio"}]}'
    assert tuple(column(spark, media.probed(F.lit(good), F.lit("a.mp3")))) == ("audio", 12.5)
    assert tuple(column(spark, media.probed(F.lit(good.replace(": 1}", ": 0}")), F.lit("a.mp3")))) == ("video", 12.5)
    assert tuple(column(spark, media.probed(F.lit("nonsense"), F.lit("a.mkv")))) == ("video", 0.0)
    out = "DURATION=6\nFINGERPRINT=1,2,-1\n"
    assert tuple(column(spark, media.parsed_fingerprint(F.lit(out)))) == ([1, 2, 0xFFFFFFFF], 2.0)


def plain_runs(cover, least, gap, density):
    """Covered positions, broken wherever two neighbours have more than ``gap`` positions between them."""
    at = [k for k, x in enumerate(cover) if x]
    breaks = [0, *(k for k in range(1, len(at)) if at[k] - at[k - 1] > gap + 1), len(at)]
    pieces = [at[i:j] for i, j in zip(breaks, breaks[1:], strict=False) if i < j]
    found = [(x[0], x[-1] + 1, len(x)) for x in pieces]
    return [(i, j, n) for i, j, n in found if j - i >= least and n >= density * (j - i)]


def test_runs_match_plain_python(spark):
    rng = random.Random(3)
    covers = [[int(rng.random() < d) for _ in range(60)] for d in (0.0, 0.1, 0.3, 0.5, 0.7, 0.9, 1.0) for _ in range(4)]
    rows = [(k, p) for k, c in enumerate(covers) for p, x in enumerate(c) if x]
    df = spark.createDataFrame(rows, "k int, pos int")
    found = sorted(map(tuple, intervals.runs(df, ["k"], 4, 2, 0.5).select("k", "start", "end", "n").collect()))
    assert found == [(k, *r) for k, c in enumerate(covers) for r in plain_runs(c, 4, 2, 0.5)]
    arrays = df.groupBy("k").agg(F.sort_array(F.collect_list("pos")).alias("p")).select("k", F.explode(intervals.run_arrays(F.col("p"), F.lit(4), F.lit(2), 0.5)).alias("r")).select("k", "r.*")
    assert sorted(map(tuple, arrays.collect())) == found


def test_merge_complement_saved(spark):
    ranges = spark.createDataFrame([("a", 2.0, 4.0), ("a", 4.0, 6.0), ("a", 5.0, 5.5), ("a", 9.98, 30.0), ("a", 7.0, 7.0), ("b", 0.0, 10.0)], "f string, start double, end double")
    merged = sorted(map(tuple, intervals.merge(ranges.filter("end > start"), ["f"]).collect()))
    assert merged == [("a", 2.0, 6.0), ("a", 9.98, 30.0), ("b", 0.0, 10.0)]
    whole = spark.createDataFrame([("a", 10.0), ("b", 10.0), ("c", 5.0), ("d", 0.0)], "f string, duration double")
    assert sorted(map(tuple, intervals.complement(ranges, whole, ["f"]).collect())) == [("a", 0.0, 2.0), ("a", 6.0, 9.98), ("c", 0.0, 5.0)]
    assert dict(intervals.saved_seconds(ranges, ["f"]).collect()) == pytest.approx({"a": 24.02, "b": 10.0})


def plain_covered(parts, s, e, tol):
    """By order of start, which comes first: a part that reaches the goal, or one that leaves a hole before it."""
    parts = sorted(parts)
    reach = list(accumulate((end for _, end in parts), max, initial=s))
    advancing = [k for k in range(len(parts)) if reach[k + 1] > reach[k]]
    hole = next((k for k in advancing if parts[k][0] > reach[k] + tol), None)
    goal = next((k for k in advancing if reach[k + 1] >= e - tol), None)
    if hole is None and goal is None:
        return s >= e - tol
    return hole is None or (goal is not None and goal < hole)


def test_covered_matches_plain_python(spark):
    rng = random.Random(5)
    cases = []
    for _ in range(150):
        s = rng.uniform(0, 5)
        parts = [(a, a + rng.uniform(0, 4)) for a in (rng.uniform(-2, 12) for _ in range(rng.randrange(5)))]
        cases.append((s, s + rng.uniform(0, 8), parts))
    spans = spark.createDataFrame([(k, s, e) for k, (s, e, _) in enumerate(cases)], "k int, start double, end double")
    parts = spark.createDataFrame([(k, a, b) for k, (_, _, ps) in enumerate(cases) for a, b in ps], "k int, part_start double, part_end double")
    found = {r[0] for r in intervals.covered(spans, parts, ["k"], 1.5).collect()}
    assert found == {k for k, (s, e, ps) in enumerate(cases) if plain_covered(ps, s, e, 1.5)}


def test_alignment_offset_and_coverage(spark):
    rng = random.Random(1)
    shared = noise(rng, 60)
    a, b = noise(rng, 20) + shared + noise(rng, 20), noise(rng, 50) + flipped(rng, shared, 3) + noise(rng, 10)
    pattern, stream = streams(spark, [("a", a)]), streams(spark, [("b", b)])
    p = DetectParams()
    cands = match.candidate_offsets(match.votes(pattern, stream, p), p)
    assert [r.off for r in cands.collect()] == [30]
    cover = match.match_cover(match.coverage_at(cands, pattern, stream, p)).count()
    assert cover >= 55


def test_bucket_cap_is_of_the_second_side(spark):
    p = DetectParams()
    same = 7 << 16
    for n, votes in ((48, True), (49, False)):
        many, few = streams(spark, [("m", [same] * n)]), streams(spark, [("f", [same] * 3)])
        assert bool(match.votes(few, many, p).count()) is votes
        assert match.votes(many, few, p).count() > 0


def test_hot_keys_vote_alike_in_parts(spark, monkeypatch):
    rng = random.Random(8)
    key = lambda k: (k << 16) + rng.getrandbits(16)
    files = [(str(f), [key(rng.choice((1, 1, 1, 2, 3, rng.randrange(4, 60)))) for _ in range(90)]) for f in range(4)]
    found, p = streams(spark, files), DetectParams(seed_max_bucket=46)
    plain = Counter()
    for a, xs in files:
        for b, ys in files:
            seen = Counter(y >> 16 for y in ys)
            plain.update((a, b, j - i) for i, x in enumerate(xs) for j, y in enumerate(ys) if x >> 16 == y >> 16 and a < b and seen[y >> 16] <= 46)
    for most in (match.HOT, 7):
        monkeypatch.setattr(match, "HOT", most)
        votes = match.votes(found, found, p, extra=["idx"], where=lambda a, b: a("idx") < b("idx"))
        assert {(r.a, r.b, r.off): r.votes for r in votes.collect()} == plain


def _family(rng, n):
    shared, line = noise(rng, 60), noise(rng, 12)
    return [(f"{k:02}", noise(rng, rng.randrange(3, 40)) + flipped(rng, shared[k : k + 40], k % 3) + line * (k % 3) + noise(rng, 5)) for k in range(n)]


def test_blocks_meet_like_votes(spark, monkeypatch):
    rng = random.Random(11)
    files = _family(rng, 14) + [("x", [7 << 16] * 60), ("y", [7 << 16] * 20 + noise(rng, 9)), ("z", [])]
    found, p = streams(spark, files), DetectParams(min_seconds=1.3)
    rows = lambda df, *c: sorted(tuple(r) for r in df.select(*c).collect())
    cols = ("a", "b", "off", "votes", "lo", "hi")
    strong = (F.col("votes") >= 3) & (F.col("hi") - F.col("lo") <= F.col("votes") * 40)
    voted = match.votes(found, found, p, extra=["idx"], where=lambda a, b: a("idx") < b("idx"))
    every = rows(match.votes(found, found, p).filter(strong), *cols)
    ordered = rows(voted.filter(strong), *cols)
    runs, shown = ({"a", "b", "off", "start", "end"}, {"file", "pos", "n"})
    seen = []
    for size, probes in ((blocks.BLOCK, 2), (150, 1), (150, 2)):
        monkeypatch.setattr(blocks, "BLOCK", size)
        monkeypatch.setattr(blocks, "PROBES", probes)
        assert rows(blocks.meet(found, found, p, match.SCOPE), *cols) == every
        assert rows(blocks.meet(found, None, p, match.SCOPE), *cols) == ordered
        seen.append((rows(match.pair_runs(found, p), *sorted(runs)), rows(match.shows(found, p), *sorted(shown))))
        assert seen[-1][1] == rows(match.recurrence_counts(match.pair_runs(found, p)), *sorted(shown))
    assert seen[0] == seen[1] == seen[2] and len(seen[0][0]) > 50


def test_an_index_looks_at_many_votes_by_stretches(monkeypatch):
    rng = random.Random(12)
    files = [np.array(items, np.uint32) for _, items in _family(rng, 20)]
    plain = blocks._Index(files, None, 48)
    wanted = [plain.strong(s, DetectParams(), None) for s in files]
    monkeypatch.setattr(blocks, "AT_ONCE", 40)
    monkeypatch.setattr(blocks, "FULL", 0)
    again = blocks._Index(files, None, 48)
    for s, found in zip(files, wanted, strict=True):
        assert sorted(zip(*map(list, again.strong(s, DetectParams(), None)), strict=True)) == sorted(zip(*map(list, found), strict=True))


def test_rounds_count_alike(spark, monkeypatch):
    found, p = streams(spark, _family(random.Random(14), 16)), DetectParams(min_seconds=1.3)
    rows = lambda: sorted(tuple(r) for r in match.shows(found, p).select("file", "pos", "n").collect())
    wanted = rows()
    monkeypatch.setattr(blocks, "BLOCK", 150)
    monkeypatch.setattr(blocks, "ROUND", 1)
    stored = []
    monkeypatch.setattr(blocks, "materialize", lambda df, label: stored.append(label) or shared.materialize(df, label))
    assert rows() == wanted and len(wanted) > 50
    assert stored.count("round") > 1


def test_stored_tables_leave_no_shuffle_files(spark):
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    kept = lambda: {x for x in env.blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "shuffle_" in x}
    before = kept()
    stored = shared.materialize(spark.range(0, 9000, 1, 3).repartition("id"), "shuffled")
    for _ in range(50):
        if not kept() - before:
            break
        time.sleep(0.1)
    assert not kept() - before and stored.count() == 9000


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder with documents of two sources that share passages of several lengths."""
    rng, folder = random.Random(15), str(tmp_path_factory.mktemp("corpus"))
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passages = [words(n) for n in (13, 15, 18, 22, 30, 31)]
    texts = [(k, f"s{k % 2}", " ".join(x for p in rng.sample(passages, 3) for x in (words(rng.randrange(9)), p, words(5)))) for k in range(30)]
    spark.createDataFrame(texts, "doc_id long, source string, text string").write.parquet(f"{folder}/documents.parquet")
    return folder


def _read_by(df):
    return {x for f in df.inputFiles() for x in re.findall("refrain-([a-z]+)-", f)}


def test_counts_are_returned_without_the_streams(spark, corpus):
    counts = registry.QUERIES["recurrence_counts"](spark, corpus)
    assert _read_by(counts) == {"round", "sizes"}
    runs = match.pair_runs(registry.document_streams(spark, corpus), registry.TEXT_PARAMS)
    rows = lambda df: sorted(tuple(r) for r in df.select("folder", "file", "pos", "n").collect())
    assert rows(counts) == rows(match.recurrence_counts(runs)) and counts.count() > 500


def test_one_round_is_stored_too(spark):
    steps = blocks.meet(streams(spark, _family(random.Random(14), 16)), None, DetectParams(min_seconds=1.3), match.SCOPE, result="shows")
    assert _read_by(steps) == {"round"} and "Exchange" not in steps._jdf.queryExecution().executedPlan().toString()
    assert steps.count() > 10


def test_length_compatible_pairs_take_no_items(spark, corpus, monkeypatch):
    monkeypatch.setattr(registry, "PAIRED", 3)
    pairs = registry.QUERIES["length_compatible_pairs"](spark, corpus)
    assert _read_by(pairs) == {"found", "classes"}
    segs = [(r.folder, r.file, r.start, r.end - r.start) for r in registry.QUERIES["recurring_segments"](spark, corpus).collect()]
    wanted = [(x[0], x[1], x[2], y[1], y[2]) for x in segs for y in segs if x[0] == y[0] and x[1:3] < y[1:3] and abs(x[3] - y[3]) / max(x[3], y[3]) <= 0.2]
    assert sorted(map(tuple, pairs.collect())) == sorted(wanted) and len(wanted) > 200


def test_pairs_are_no_rows_of_a_shuffle(spark):
    plan = match.shows(streams(spark, _family(random.Random(13), 4)), DetectParams())._jdf.queryExecution().executedPlan().toString()
    assert "explode(items" not in plan and "key#" not in plan


def test_few_tasks_are_spread(spark):
    one = spark.range(100).repartition(1)
    assert spread(one).rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
    assert sorted(r.id for r in spread(one).collect()) == list(range(100))
    many = spark.range(0, 100, 1, 9)
    assert spread(many) is many


def test_recurring_segments(spark):
    rng = random.Random(2)
    shared = noise(rng, 80)
    files = [(str(k), noise(rng, 10 * (k + 1)) + flipped(rng, shared, 2) + noise(rng, 15)) for k in range(3)]
    found = {r.file: r for r in match.recurring_segments(streams(spark, files), DetectParams()).collect()}
    assert len(found) == 3
    for k in range(3):
        assert abs(found[str(k)].start_sec - 10 * (k + 1) * 0.1238) < 1 and abs(found[str(k)].end_sec - (10 * (k + 1) + 80) * 0.1238) < 1
    three = DetectParams(min_shows=4)
    assert match.recurring_segments(streams(spark, files), three).count() == 0


def test_64_bit_items(spark):
    rng = random.Random(4)
    signed = lambda n: [rng.getrandbits(64) - 2**63 for _ in range(n)]
    shared = signed(40)
    a, b = streams(spark, [("a", signed(10) + shared)], width=64), streams(spark, [("b", signed(25) + shared)], width=64)
    p = DetectParams().scaled(64)
    cands = match.candidate_offsets(match.votes(a, b, p), p)
    assert match.match_cover(match.coverage_at(cands, a, b, p)).count() >= 40


def test_locate_and_ratio(spark):
    rng = random.Random(6)
    ad, p = noise(rng, 100), DetectParams()
    files = [("has", noise(rng, 120) + flipped(rng, ad, 2) + noise(rng, 50)), ("not", noise(rng, 300)), ("twice", noise(rng, 30) + flipped(rng, ad, 1) + noise(rng, 70) + flipped(rng, ad, 1))]
    found = match.alignments(streams(spark, [("ad", ad)]), streams(spark, files), p)
    one = {r.b: (r.start, r.end) for r in match.locate(found, p).collect()}
    assert one["has"] == (120, 220) and "not" not in one
    every = sorted((r.b, r.start, r.end) for r in match.locate_all(found, p).collect())
    assert every == [("has", 120, 220), ("twice", 30, 130), ("twice", 200, 300)]
    ratio = {r.b: r.ratio for r in match.best_ratio(found).collect()}
    assert ratio["has"] >= 0.6 and ratio.get("not", 0) < 0.3
