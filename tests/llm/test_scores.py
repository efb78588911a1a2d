"""The fields against enumeration, and the classifiers on held-out rows; the pipeline against its stages by hand."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from refrain.llm import crf, labelled, quality, toxicity
from refrain.llm.labelled import Sample
from refrain.llm.registry import ORACLES, QUERIES

CLEAN = "the of and to in is that it for as was with be by on are this from at stone river house garden".split()
INSULTS = ["zorkish", "blatter", "quimby"]


def corpus(rng, n):
    """(text, toxic, good)"""
    out = []
    for _ in range(n):
        toxic, good = rng.random() < 0.3, rng.random() < 0.7
        lines = [" ".join(rng.choice(CLEAN) for _ in range(rng.randrange(5, 25))) + "." for _ in range(rng.randrange(1, 6))]
        if not good:
            lines = [" ".join(x.upper() + "!!" for x in line.split()) for line in lines]
        if toxic:
            w = lines[-1].split()
            w.insert(rng.randrange(len(w)), rng.choice(INSULTS) + rng.choice(("", "er", "ing")))
            lines[-1] = " ".join(w)
        out.append(("\n".join(lines), int(toxic), int(good)))
    return out


def test_chains_match_enumeration():
    rng = np.random.default_rng(0)
    lengths = np.array([3, 0, 1, 5])
    s, pairs = rng.normal(size=9), rng.normal(size=(2, 2))
    y = rng.integers(0, 2, 9)
    layout = crf.Chains(lengths)

    def likelihood(s, pairs):
        total, k, marginals = 0.0, 0, []
        for n in lengths:
            score = lambda z: sum(s[k + i] * z[i] for i in range(n)) + sum(pairs[z[i], z[i + 1]] for i in range(n - 1))  # noqa: B023, E731
            ways = list(itertools.product((0, 1), repeat=int(n)))
            w = np.exp([score(z) for z in ways])
            total += score(tuple(y[k : k + n])) - np.log(w.sum())
            marginals.extend((w[:, None] * np.array(ways).reshape(len(ways), n)).sum(axis=0) / w.sum())
            k += n
        return total, marginals

    assert np.allclose(layout.marginals(s, pairs), likelihood(s, pairs)[1])
    by_item, by_pair = layout.gradients(s, y, pairs)
    for grad, x in ((by_item, s), (by_pair, pairs)):
        for i in np.ndindex(x.shape):
            x[i] += 1e-5
            up = likelihood(s, pairs)[0]
            x[i] -= 2e-5
            down = likelihood(s, pairs)[0]
            x[i] += 1e-5
            assert abs((up - down) / 2e-5 - grad[i]) < 1e-4
    assert crf.Chains(np.array([], int)).marginals(np.array([]), pairs).size == 0


def test_toxicity_on_held_out_rows(spark):
    rows = corpus(random.Random(1), 600)
    model = toxicity.ToxicityModel(Sample([r[0] for r in rows[:400]], [r[1] for r in rows[:400]], 0.3))
    df = spark.createDataFrame([(k, r[0], "x") for k, r in enumerate(rows[400:])] + [(900, None, "x"), (901, "", "x"), (902, "stone " * 30_000 + "zorkisher", "x")], "doc_id long, text string, score string")
    found = {r.doc_id: r.toxicity for r in toxicity.score_toxicity(df, model).collect()}
    hits = [(found[k].score >= 0.7) == bool(r[1]) for k, r in enumerate(rows[400:])]
    assert np.mean(hits) > 0.97
    assert found[900].score == found[901].score < 0.5 and found[900].spans == []
    long = found[902]
    assert long.score >= 0.7 and [(s.begin, s.end) for s in long.spans] == [(180_000, 180_009)]


def test_quality_on_held_out_rows(spark):
    rows = corpus(random.Random(2), 500)
    model = quality.QualityModel(Sample([r[0] for r in rows[:300]], [r[2] for r in rows[:300]], 0.7))
    df = spark.createDataFrame([(k, r[0]) for k, r in enumerate(rows[300:])] + [(900, None), (901, " \n "), (902, rows[0][0] + "\n" * 50)], "doc_id long, text string")
    found = {r.doc_id: r.quality for r in quality.score_quality(df, model).collect()}
    assert np.mean([(found[k] >= 0.3) == bool(r[2]) for k, r in enumerate(rows[300:])]) > 0.97
    assert found[900] == found[901] and all(0 <= s <= 1 for s in found.values())


def test_models_without_labels():
    assert quality.QualityModel(Sample([], [], 0.0)).score(["a", None]).tolist() == [0.0, 0.0]
    assert toxicity.ToxicityModel(Sample(["a"], [1], 1.0)).score(["a", None])[0].tolist() == [1.0, 1.0]


def test_sample_is_bounded_and_from_training_rows(spark):
    docs = spark.createDataFrame([(k, "t" * k) for k in range(100)] + [(None, "n")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(100)] + [(3, 1), (None, 1), (200, 1), (5, None)], "doc_id long, quality int")
    s = labelled.draw(docs, labels, "quality", labelled.fold(F.col("doc_id"), 5) != 0, per_class=10, most_bytes=50)
    assert len(s.texts) <= 20 and all(len(t) <= 50 for t in s.texts) and 0.4 < s.share < 0.6
    assert labelled.draw(docs, labels.limit(0), "quality", F.lit(True)).texts == []
    again = docs.unionByName(docs.withColumn("text", F.concat("text", F.lit("z")))).union(docs)
    assert labelled.draw(again, labels, "quality", F.lit(True), per_class=10, most_bytes=500).texts == [t + "z" for t in labelled.draw(docs, labels, "quality", F.lit(True), per_class=10, most_bytes=500).texts]
    few = labelled.draw(docs, labels, "quality", F.lit(True), per_class=50, total_bytes=600)
    assert 0 < sum(map(len, few.texts)) <= 600 and set(few.labels) == {0, 1}
    assert labelled.draw(docs.limit(0), labels, "quality", F.lit(True)).texts == []


def test_scores_of_empty_tables_and_clashing_columns(spark):
    rows = corpus(random.Random(4), 80)
    good = quality.QualityModel(Sample([r[0] for r in rows], [r[2] for r in rows], 0.7), rounds=50)
    toxic = toxicity.ToxicityModel(Sample([r[0] for r in rows], [r[1] for r in rows], 0.3), rounds=5)
    df = spark.createDataFrame([(k, r[0], "q", "r", 1.0) for k, r in enumerate(rows)] + [(None, None, "q", None, None)], "doc_id long, text string, quality string, row string, score double")
    scored = quality.score_quality(df, good)
    assert scored.columns == ["doc_id", "text", "quality", "row", "score"] and dict(scored.dtypes)["quality"] == "double" and scored.count() == 81
    kept = quality.keep_good(df, good, 0.3)
    assert kept.columns == df.columns and {r.quality for r in kept.collect()} == {"q"}
    want = {r.doc_id for r in scored.collect() if r.quality >= 0.3}
    assert {r.doc_id for r in kept.collect()} == want
    assert quality.keep_good(df, quality.QualityModel(Sample([], [], 0.0)), 0.3).count() == 81
    for f in (quality.score_quality(df.limit(0), good), quality.keep_good(df.limit(0), good, 0.3), toxicity.score_toxicity(df.limit(0), toxic)):
        assert f.count() == 0
    assert toxicity.score_toxicity(df, toxic).columns == ["doc_id", "text", "quality", "row", "score", "toxicity"]


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(3)
    rows = corpus(rng, 300)
    texts = [r[0] for r in rows]
    leak = " ".join(f"item{k}" for k in range(14))
    texts += [texts[0], " ".join(CLEAN) + ". " + leak, None, ""]
    docs = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, r[2], r[1]) for k, r in enumerate(rows)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    df = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, str(tmp_path))
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        left.append({r.doc_id for r in df.collect()})
    good = {k for k, r in enumerate(rows) if r[2]}
    assert len(good - left[0]) <= 2 and len(left[0] & {k for k, r in enumerate(rows) if not r[2]}) <= 3
    assert left[0] - left[1] == {k for k in left[0] if any(j > k and (texts[j] or "") == (texts[k] or "") for j in left[0])}
    assert left[2] <= left[1] and len(left[2]) >= 0.5 * len(left[1])
    assert left[2] - left[3] == {len(rows) + 1} & left[2]
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == left[3]


def test_pipeline_of_empty_tables_nulls_and_repeated_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, _row string, at long"
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(None, None, None, None, None, None, None)] * 3 + [(1, long, "en", "s", 1, "a", 1)] * 3 + [(None, long + " end", "en", "s", 1, "b", 2), (2, "alone", None, None, None, None, None)]
    for name, docs in (("some", rows), ("none", [])):
        at = str(tmp_path / name)
        spark.createDataFrame(docs, schema).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        spark.createDataFrame([(None, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
        pieces = corpus_pipeline.run(spark, at).collect()
        assert sorted((p.doc_id or 0, p.length) for p in pieces) == sorted((p.doc_id or 0, p.doc_tokens) for p in pieces)
        assert [p.doc_id for p in sorted(pieces, key=lambda p: p.doc_id or 0)] == ([None, 1, 2] if docs else [])


def test_registry_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert set(ORACLES) <= set(QUERIES)
