"""Each operator against a brute-force version, on small tables with nulls, empty and long texts, ties and repeats."""

import functools
import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from refrain.llm import decontaminate, exact_dedup, html_extract, near_copies, packing, registry, simhash, substring_dedup, token_counts, url_filter

SCHEMA = "doc_id long, text string, extra string, kept string"
WORDS = "the of and to in is that it for as was with be by on are this from at or an idiot stone river".split()


def texts(seed=0, n=60):
    rng = random.Random(seed)
    base = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 120))) for _ in range(n // 3)]
    out = [rng.choice(base) for _ in range(n // 3)] + base
    for t in base:
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    return [*out, None, "", " ", "\n\n", "a", "A  b\tc\x0bd\x1ce f", "é ﬁ 🙂 <|endoftext|> </s> ▁x\n\n\ny  ", "word " * 3000, "x" * 5000]


def docs(spark, rows=None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(k, t, "e", "k") for k, t in enumerate(rows)] + ([(0, rows[0], "e", "k"), (None, "no id", "e", "k")] if rows else []), SCHEMA)


def collected(df):
    return df.collect()


def plain_groups(rows):
    """(keep_id, group_size, kept) of each (id, text)."""
    same = {}
    for k, t in rows:
        same.setdefault(t or "", []).append(k)
    keep = {t: max((k for k in ks if k is not None), default=None) for t, ks in same.items()}
    return [(keep[t or ""], len(same[t or ""]), k == keep[t or ""]) for k, t in rows]


@pytest.mark.parametrize("bits", [1 << 27, 1 << 15])
def test_exact_groups(spark, bits):
    df = docs(spark)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want = Counter((k, *v, hashlib.sha256((t or "").encode()).digest()) for (k, t), v in zip(rows, plain_groups(rows), strict=True))
    found = exact_dedup.exact_groups(df, all_digests=True, bits=bits)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.sha256)) for r in found.collect()) == want
    fewer = exact_dedup.exact_groups(df, bits=bits).collect()
    assert all(r.sha256 for r in fewer if r.group_size > 1)
    assert bits < 1 << 20 or sum(r.sha256 is None for r in fewer) > 20
    assert exact_dedup.exact_groups(docs(spark, [])).count() == 0


def test_exact_dedup_keeps_one_row_of_each_group(spark):
    df = docs(spark)
    kept = exact_dedup.exact_dedup(df)
    assert kept.columns == ["doc_id", "text", "extra", "kept"]
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want = {t or "": v[0] for (_, t), v in zip(rows, plain_groups(rows), strict=True)}
    assert sorted((r.text or "", r.doc_id or -1) for r in kept.collect()) == sorted((t, k or -1) for t, k in want.items())
    odd = spark.createDataFrame([(1, "x", "a", 1), (1, "x", "b", 2), (None, "x", "c", 3), (None, "y", "d", 4), (None, "y", "d", 5), (None, None, "e", 6), (3, "", "f", 7)], "doc_id long, text string, _len string, _row int")
    got = exact_dedup.exact_dedup(odd).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == [(0, "y"), (1, "x"), (3, "")]
    assert [r.asDict() for r in exact_dedup.exact_dedup(odd.repartition(3)).orderBy("_row").collect()] == [r.asDict() for r in sorted(got, key=lambda r: r._row)]
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0


def shuffled(df):
    """Column names of every exchange by hash or range in a plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line or "Exchange rangepartitioning" in line], plan


def test_exact_groups_shuffle_no_text(spark):
    df = docs(spark).select("doc_id", F.concat("text", F.lit("")).alias("text"))
    lines, plan = shuffled(exact_dedup.exact_groups(df, all_digests=True))
    assert "text" not in plan and "_body" not in plan and not any("text" in x for x in lines)


def test_bitmap_has_no_false_negatives(spark):
    from refrain.llm import bitmaps

    keys = spark.range(0, 3000, 3).select(F.xxhash64("id").alias("h"))
    marked = bitmaps.marks(keys, F.col("h"), 1 << 18)
    found = bitmaps.flagged(spark.range(3000), F.xxhash64("id"), marked, "hit", 1 << 18).collect()
    assert all(r.hit for r in found if r.id % 3 == 0) and sum(r.hit for r in found) < 1050


@pytest.mark.parametrize("bits", [1 << 27, 1 << 15])
def test_op4_gives_every_rows_digest(spark, tmp_path, monkeypatch, bits):
    docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(exact_dedup, "exact_groups", functools.partial(exact_dedup.exact_groups, bits=bits))
    rows = registry.op4_exact_dedup(spark, str(tmp_path)).collect()
    owner = dict([*enumerate(texts()), (None, "no id")])
    assert len(rows) == len(texts()) + 2
    for r in rows:
        assert r.text_sha256 == hashlib.sha256((owner[r.doc_id] or "").encode()).hexdigest(), r


def plain_fingerprint(t):
    s = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", s)
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components_of(items, linked):
    parent = {k: k for k in items}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in items:
        for b in items:
            if a < b and linked(a, b) and root(a) != root(b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {k: root(k) for k in items}


def test_simhash(spark):
    found = simhash.near_duplicates(docs(spark)).filter("doc_id IS NOT NULL").collect()
    prints = {k: plain_fingerprint(t) for k, t in enumerate(texts())}
    roots = components_of(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    assert len(found) == len(prints) + 1
    for r in found:
        assert r.fingerprint % 2**64 == prints[r.doc_id] and r.component_id == roots[r.doc_id]
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_near_dedup_keeps_one_row_of_each_component(spark):
    prints = {k: plain_fingerprint(t) for k, t in enumerate(texts())}
    roots = components_of(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    kept = simhash.near_dedup(docs(spark))
    assert kept.columns == ["doc_id", "text", "extra", "kept"]
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(k for k in ids if k is not None) == sorted(set(roots.values())) and ids.count(None) == 1
    odd = spark.createDataFrame([(None, "some words", 1), (None, "some words", 2), (5, "other text", 3), (5, "other text", 4), (None, "other text", 5)], "doc_id long, text string, _dropped int")
    assert sorted((r.doc_id or 0, r.text) for r in simhash.near_dedup(odd).collect()) == [(0, "some words"), (5, "other text")]
    assert simhash.near_dedup(docs(spark, [])).count() == 0


@pytest.mark.parametrize("bits", [1, 2, 3])
def test_links_of_the_index_are_those_of_all_pairs(spark, bits):
    rng = random.Random(bits)
    values = {rng.getrandbits(64) for _ in range(40)}
    for v in list(values)[:6]:  # groups in which fingerprints differ in few bits, short and long lists
        for _ in range(rng.choice((4, 120))):
            w = v
            for _ in range(rng.randrange(1, 6)):
                w ^= 1 << rng.randrange(64)
            values.add(w)
    values = sorted(v - 2**64 if v >= 2**63 else v for v in values)
    from refrain.llm.components import components

    want = components_of(values, lambda a, b: ((a ^ b) % 2**64).bit_count() <= bits)
    links = simhash.fingerprint_links(spark.createDataFrame([(v,) for v in values], "fingerprint long"), bits=bits)
    assert {r.node: r.root for r in components(links).collect()} == {v: r for v, r in want.items() if v != r}


def test_a_pair_needs_the_guaranteed_minimum_of_matches(spark):
    """Two bits in two bytes: six bytes shared, six lists in common; three bytes: five and one."""
    few = simhash.index(spark.createDataFrame([(0,), (1 | 1 << 9,), (1 | 1 << 9 | 1 << 18,)], "fp long"), 5)
    assert few.count() == 3 * 56
    met = few.withColumn("n", F.count(F.lit(1)).over(simhash.Window.partitionBy("bytes", "choice"))).filter("n > 1")
    for least, want in ((1, {(512 + 1, 0), (512 + 1 + (1 << 18), 513), (512 + 1 + (1 << 18), 0)}), (6, {(513, 0), (512 + 1 + (1 << 18), 513)}), (7, {(512 + 1 + (1 << 18), 513)})):
        assert {(r.a, r.b) for r in simhash._tallied(met, least, 64).collect()} == want


@pytest.mark.parametrize("m", [2, 30, 300, 2000])
def test_posting_links_are_those_of_all_pairs(m):
    rng = np.random.default_rng(m)
    low = rng.choice(65536, m, replace=False).astype(np.uint64)
    x = (np.uint64(0x1234567800000000) | (low & np.uint64(255)) | ((low >> np.uint64(8)) << np.uint64(24))).view(np.int64)
    parent = {int(v): int(v) for v in x}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for v in x:
        for w in x[np.bitwise_count(x.view(np.uint64) ^ np.int64(v).view(np.uint64)) <= 2]:
            a, b = root(int(v)), root(int(w))
            parent[max(a, b)] = min(a, b)
    assert sorted(simhash.posting_links(x, 2)) == sorted((v, root(v)) for v in parent if root(v) != v)


def test_large_chain_of_near_copies_is_one_component(spark):
    chain = [0]
    for k in range(40):
        chain.append(chain[-1] ^ (1 << k))
    rows = spark.createDataFrame([(v,) for v in chain], "fingerprint long")
    from refrain.llm.components import components

    roots = components(simhash.fingerprint_links(rows)).collect()
    assert {(r.node, r.root) for r in roots} == {(v, 0) for v in chain[1:]}


def plain_shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_copies_of_shingle_similarity(spark):
    rng = random.Random(4)
    rows = texts(5)
    for k in range(12):  # copies of a base, each with some words changed: some above 0.8, some below
        base = [f"w{rng.randrange(400)}" for _ in range(150)]
        for n in (0, 1, 2, 3, 5, 9):
            w = list(base)
            for at in rng.sample(range(150), n):
                w[at] = f"x{k}"
            rows.append(" ".join(w))
    sets = dict(enumerate(map(plain_shingles, rows)))
    alike = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    roots = components_of(sets, alike)
    near = [r for r in corpus_pipeline.near_dedup_stage(spark, docs(spark, rows), "").collect() if r.text != "no id"]
    assert sorted(r.doc_id for r in near) == sorted(set(roots.values()))
    odd = spark.createDataFrame([(1, "a b c", 7), (2, "a b c", 8)], "doc_id long, text string, at int")
    assert [tuple(r) for r in near_copies.drop_near_copies(odd).collect()] == [(1, "a b c", 7)]
    assert near_copies.drop_near_copies(odd.limit(0)).count() == 0


@pytest.mark.parametrize("crowd", [2048, 3])
def test_large_group_of_near_copies_is_that_of_all_pairs(spark, crowd, monkeypatch):
    monkeypatch.setattr(near_copies, "CROWD", crowd)
    rng = random.Random(13)
    base = [f"w{rng.randrange(400)}" for _ in range(150)]
    rows = []
    for k in range(120):  # copies of one base and mixtures with another, from alike to hardly
        w = list(base)
        for at in rng.sample(range(150), rng.randrange(12)):
            w[at] = f"x{k}{at}"
        if k % 5 == 0:
            w[:70] = [f"y{k}{i}" for i in range(70)]
        rows.append(" ".join(w))
    sets = dict(enumerate(map(plain_shingles, rows)))
    roots = components_of(sets, lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    near = near_copies.drop_near_copies(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))
    assert sorted(r.doc_id for r in near.collect()) == sorted(set(roots.values())) and len(set(roots.values())) > 20


def test_sketches_of_similar_sets_agree():
    rng = np.random.default_rng(5)
    short = 0
    for _ in range(300):
        x = rng.integers(0, 2**64, 300, np.uint64)
        y = np.concatenate([x[:270], rng.integers(0, 2**64, 30, np.uint64)])  # similarity 0.818
        a, b = (np.frombuffer(near_copies.sketch(near_copies.signature(s)), np.uint8) for s in (x, y))
        short += (a == b).sum() < near_copies.agreements(0.8)
    assert short <= 2


def test_one_row_of_each_group_of_near_copies_stays_without_ids(spark):
    long = " ".join(f"w{k}" for k in range(100))
    rows = [(None, long), (None, long + " end"), (7, long + " fin"), (7, "alone and else"), (None, "twice here"), (None, "twice here"), (None, None), (None, " ")]
    got = near_copies.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, (r.text or "").strip()) for r in got) == [(0, ""), (0, "twice here"), (7, "alone and else"), (7, long + " fin")]


def plain_repeats(rows):
    seen, gone = {}, {}
    for k, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        cover = [False] * len(w)
        for i in range(len(w) - 19):
            key = tuple(w[i : i + 20])
            if seen.setdefault(key, (k, i)) != (k, i):
                cover[i : i + 20] = [True] * 20
        gone[k] = (len(w), sum(cover), " ".join(x for x, c in zip(w, cover, strict=True) if not c))
    return gone


@pytest.mark.parametrize("many", [1, 32])
def test_substring_dedup(spark, many):
    rng = random.Random(8)
    passage = [f"p{k}" for k in range(60)]
    rows = texts(3)
    for _ in range(40):
        a = rng.randrange(40)
        rows.append(" ".join([rng.choice(WORDS) + str(rng.randrange(9)) for _ in range(rng.randrange(40))] + passage[a : a + rng.randrange(15, 60)] + [rng.choice(WORDS) for _ in range(rng.randrange(30))]))
    found = substring_dedup.remove_repeats(docs(spark, rows).repartition(5), many=many).collect()
    want = plain_repeats(list(enumerate(rows)))
    assert len(found) == len(rows) + 2
    for r in found:
        if r.doc_id is not None:
            assert (r.n_words, r.n_removed, r.kept) == want[r.doc_id], r.doc_id
    assert substring_dedup.remove_repeats(docs(spark, [])).count() == 0


@pytest.mark.parametrize("many", [1, 32])
def test_substring_dedup_of_rows_without_or_with_shared_ids(spark, many):
    passage = " ".join(f"p{k}" for k in range(40))
    rows = [(None, passage + " " + " ".join(f"a{k}" for k in range(50))), (None, passage + " tail"), (None, "short"), (None, None), (None, " ".join(f"b{k}" for k in range(90)))]
    rows += [(7, "head " + passage[: passage.index(" p25")] + " x7"), (7, " ".join(f"c{k}" for k in range(60))), (9, passage)]
    rows += [(9, "y " + " ".join(f"p{k}" for k in range(10, 35)) + " z")]
    found = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), many=many).collect()
    assert len(found) == len(rows)
    from xxhash import xxh64_intdigest  # Spark's xxhash64 is XXH64 with seed 42

    def place(row):
        h = xxh64_intdigest((row[1] or "").encode(), 42)
        h = h | 1 if row[0] is None else h & ~1
        return (row[0] is not None, row[0] or 0, h - 2**64 if h >= 2**63 else h)

    order = sorted(range(len(rows)), key=lambda k: place(rows[k]))
    want = plain_repeats([(rank, rows[k][1]) for rank, k in enumerate(order)])
    by_text = {(rows[k][0], rows[k][1]): want[rank] for rank, k in enumerate(order)}
    for r in found:
        assert (r.n_words, r.n_removed, r.kept) == by_text[r.doc_id, r.text], r


def test_substring_dedup_of_string_ids_and_clashing_columns(spark):
    passage = " ".join(f"p{k}" for k in range(30))
    rows = [("x1", passage, 1, 2), ("x2", "a " + passage + " b", 3, 4), (None, None, 5, 6), ("x2", "a " + passage + " b", 7, 8), ("x9", "", 9, None)]
    df = spark.createDataFrame(rows, "doc_id string, text string, _doc int, spans int")
    found = substring_dedup.remove_repeats(df)
    assert found.columns == ["doc_id", "text", "_doc", "spans", "n_words", "n_removed", "kept"]
    got = {(r._doc, r.spans): (r.doc_id, r.text, r.n_words) for r in found.collect()}
    assert got == {(r[2], r[3]): (r[0], r[1], len((r[1] or "").split())) for r in rows}
    removed = {r._doc: r.n_removed for r in found.collect()}
    assert removed[3] == removed[7] and {removed[1], removed[3]} == {0, 30} and removed[5] == removed[9] == 0
    assert substring_dedup.remove_repeats(df.limit(0)).count() == 0


def test_rolling_hash_sizes():
    x = np.random.default_rng(0).integers(0, 2**63, 50).astype(np.uint64)
    for size in (1, 2, 3, 5, 8, 13, 20):
        want = [sum(int(v) * pow(7, size - 1 - j, 2**64) for j, v in enumerate(x[i : i + size])) % 2**64 for i in range(51 - size)]
        assert substring_dedup.rolling(x, size, 7).tolist() == want


def plain_words(t):
    s = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", s)


def test_decontamination(spark):
    rng = random.Random(5)
    items = [("i1", " ".join(f"q{k}" for k in range(15))), ("i2", "Short one!"), ("i3", None), ("i4", "..."), ("i1", "another, text of the same item q1 q2 q3 q4 q5 q6"), (None, "nameless é")]
    rows = [*texts(), "x " + " ".join(f"Q{k}" for k in range(12)) + " y", "a short ONE b short one short", "nameless É nameless é", "q1 q2 q3"]
    rng.shuffle(rows)
    bench = spark.createDataFrame([(a, b, "z") for a, b in items], "item_id string, text string, hits string")
    windows = {}
    for name, t in items:
        w = plain_words(t)
        for i in range(max(0, len(w) - 10) + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(name or "")
    for block in (10**6, 40):  # one broadcast, and several
        found = decontaminate.find_contamination(docs(spark, rows), bench, block_bytes=block).filter("doc_id IS NOT NULL").collect()
        for r in found:
            w = plain_words(rows[r.doc_id])
            cover, names = set(), set()
            for g, owners in windows.items():
                for i in range(len(w) - len(g) + 1):
                    if tuple(w[i : i + len(g)]) == g:
                        cover |= set(range(i, i + len(g)))
                        names |= owners
            assert (r.n_words, r.n_hit, r["items"], r.contaminated) == (len(w), len(cover), sorted(names), bool(cover)), r
    clean = decontaminate.decontaminate(docs(spark, rows), bench)
    assert clean.columns == ["doc_id", "text", "extra", "kept"] and clean.count() == len(rows) + 2 - sum(r.contaminated for r in found)
    spans = {r.doc_id: r.text for r in decontaminate.decontaminate(docs(spark, ["a short ONE b", "clean Text"]), bench, remove="spans").collect()}
    assert spans[0] == "a b" and spans[1] == "clean Text"
    assert decontaminate.find_contamination(docs(spark), bench.limit(0)).filter("contaminated").count() == 0


def test_window_set_is_small_and_verifies_words(monkeypatch):
    import pickle
    import tracemalloc

    rng = random.Random(6)
    items = [(f"i{k}", " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(200))) for k in range(1000)]
    tracemalloc.start()
    found = decontaminate.WindowSet(items, 10)
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    size, n = sum(len(t) for _, t in items), len(found.hashes)
    assert n == 191 * 1000 and held < size + 45 * n and len(pickle.dumps(found)) < size + 30 * n
    monkeypatch.setattr("xxhash.xxh3_64_intdigest", lambda x: len(x) % 3)  # few hashes: only words tell windows apart
    found = decontaminate.WindowSet(items[:9], 10)
    w = [x.encode() for x in items[7][1].split()]
    assert found.find(w[50:60]) == [(0, 10, "i7")] and found.find(w[50:59]) == found.find(w[59:49:-1]) == []
    assert decontaminate.WindowSet([("a", "x y x y x y")], 2).find([b"x", b"y", b"x"]) == [(0, 3, "a")]


def test_clashing_columns_are_replaced_and_rows_return_untouched(spark):
    df = spark.createDataFrame([(1, "a b", 5, "r"), (None, None, 6, "s"), (1, "a b", 5, "r"), (2, "c d", 7, None)], "doc_id long, text string, n_hit int, row string")
    bench = spark.createDataFrame([("i", "a b")], "item_id string, text string")
    for block in (10**6, 1):
        found = decontaminate.find_contamination(df, bench, block_bytes=block)
        assert found.columns == ["doc_id", "text", "row", "n_words", "hits", "n_hit", "items", "contaminated"]
        assert sorted((r.doc_id or 0, r.n_words, r.n_hit) for r in found.collect()) == [(0, 0, 0), (1, 2, 2), (1, 2, 2), (2, 2, 0)]
        assert sorted((r.doc_id or 0, r.n_hit, r.row or "") for r in decontaminate.decontaminate(df, bench, block_bytes=block).collect()) == [(0, 6, "s"), (2, 7, "")]
    assert decontaminate.find_contamination(df.limit(0), bench).count() == 0


def test_packing(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = texts()
    for size in (7, 2048):
        pieces = packing.pack(docs(spark), public_tokenizers.path("byte_bpe_50k.json"), group_docs=size).collect()
        ids = {k: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for k, t in [*enumerate(rows), (None, "no id")]}
        got = Counter()
        for p in pieces:
            assert p.ids == ids[p.doc_id][p.start : p.start + p.length].tobytes() and p.doc_tokens == len(ids[p.doc_id])
            got[p.doc_id] += p.length
        assert got == {k: len(x) * (2 if k == 0 else 1) for k, x in ids.items()}
        by = {}
        for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
            assert p.offset == by.get(p.sequence_id, 0)
            by[p.sequence_id] = p.offset + p.length
        assert max(by.values()) <= 1024
    assert sum(1024 - n for n in by.values()) < 1024
    assert packing.pack(docs(spark, []), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_packing_is_the_same_however_rows_arrive(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    df = docs(spark).filter("doc_id IS NOT NULL")

    def packed(df, **options):
        return sorted((p.doc_id, p.start, p.length, p.sequence_id, p.offset, bytes(p.ids)) for p in packing.pack(df, path, **options).collect())

    for options in ({}, {"group_docs": 9}, {"group_bytes": 2000}):
        want = packed(df, **options)
        assert want == packed(df.repartition(7, "text"), **options) == packed(df.orderBy(F.desc("text")).coalesce(1), **options)


def test_rows_without_id_spread_over_groups_and_lots_are_bounded(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = spark.range(400).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same").alias("text"))
    pieces = packing.pack(rows, path, group_docs=10).collect()
    assert sum(p.length for p in pieces) == 400 * pieces[0].doc_tokens
    by = Counter(p.sequence_id >> 32 for p in pieces)
    assert len(by) > 30 and max(by.values()) < 40
    long = spark.createDataFrame([(1, "word " * 400), (2, "word " * 400), (3, "word " * 400)], "doc_id long, text string")
    pieces = packing.pack(long, path, group_bytes=1000).collect()
    assert len({p.sequence_id for p in pieces}) == 3 and {p.sequence_id >> 32 for p in pieces} == {0}


def test_first_fit_decreasing_takes_the_first_bin_with_room():
    rng = random.Random(1)
    tree, free = packing.TournamentTree(50, 100), [100] * 50
    for size in sorted((rng.randrange(1, 100) for _ in range(50)), reverse=True):
        want = next(k for k, f in enumerate(free) if f >= size)
        assert tree.place(size) == want
        free[want] -= size


def test_token_ids_equal_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, fast, rng = Tokenizer.from_file(path), packing.TokenIds(path), random.Random(2)
    for _ in range(3000):
        t = "".join(rng.choice(["a", "the", " ", " ", "\n", "\t", "é", "'s", "12", "!", "\xa0", "\r", "中", "<|endoftext|>"]) for _ in range(rng.randrange(12)))
        assert np.frombuffer(fast.encode(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_token_counts(spark):
    from sentencepiece import SentencePieceProcessor

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, counter, rng = SentencePieceProcessor(model_file=path), token_counts.PieceCounter(path), random.Random(3)
    for _ in range(3000):
        t = "".join(rng.choice(["a", "the", " ", " ", "\n", "\t", "é", "▁", "<s>", "🙂", "\x00", "中", "ﬁ"]) for _ in range(rng.randrange(14)))
        assert counter.count(t) == len(sp.encode(t)), repr(t)
    found = token_counts.count_tokens(docs(spark).withColumn("n_bytes", F.lit("clash")), path, limit=100).filter("doc_id IS NOT NULL").collect()
    for r in found:
        t = texts()[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), len(sp.encode(t)), len(sp.encode(t)) > 100)


PAGE = """<html><head><title>no</title><script>var t="</p>";</script></head><body class="has-sidebar"><nav><ul><li><a href=1>Home</a></ul></nav>
<header><h1>Site</h1></header><div class="cookie-notice">We use cookies</div><div class="main-{k}"><h2>Title {k}</h2><p>First &eacute;&amp; text
 of   the page.<p>Second <b>one<br>more <a href=x>link</a></p><div class=advert>Buy</div><form><p>Name</p></form>
<section id="comments"><article class="comment"><p>A long reader comment that says very little and goes on and on and on.</p></article></section></div>
<aside><p>Side</p></aside><footer>&copy; us</footer>"""


def test_html_extraction(spark):
    rows = [(k, "http://a.example/x", PAGE.format(k=k)) for k in range(3)] + [(3, None, None), (4, "", ""), (5, "http://b.example", "just &lt;text&gt;"), (6, "http://c.example", "<p>unclosed <i>tag"), (0, "http://a.example/x", PAGE.format(k=0)), (7, "http://a.example/y", "<article><p>Another layout.</p></article>")]
    for hosts in (100, 0):
        found = html_extract.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string"), broadcast_hosts=hosts).collect()
        got = {r.page_id: r.text for r in found}
        assert len(found) == len(rows)
        for k in range(3):
            assert got[k] == f"Title {k}\nFirst é& text of the page.\nSecond one more link"
        assert [got[k] for k in range(3, 8)] == ["", "", "just <text>", "unclosed tag", "Another layout."]
    assert html_extract.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def plain_rule(url, rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, str(max(fit, key=lambda r: len(str(r)))) if fit else None


RULES = [url_filter.Rule.of(*x) for x in (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))]


def test_url_rules(spark):
    urls = [None, "", "nothing", "http://A.Example.COM/en/71?x", "http://example.com/en/6", "https://xexample.net/de/8", "https://m.example.net/de/8#", "a://b://c.org/es/", "http://cheap-pills.example/", "http://casinowin.test/poker1", "http://river-museum.example/history", "http://notcom/en/", "http://com/en/", "x://h?q://z.org/es/"]
    corpus = spark.createDataFrame([("casino win river museum test", 1), (None, 2), ("", 3)], "text string, n int").select("text")
    df = spark.createDataFrame([(k, u, "old", 1) for k, u in enumerate(urls)] + [(3, urls[3], "old", 1)], "page_id long, url string, host string, p int")
    found = url_filter.filter_urls(df, RULES, corpus).orderBy("page_id").collect()
    assert found[0].__fields__ == ["page_id", "url", "p", "host", "path", "rule", "words", "block_probability", "held_out", "verdict"] and len(found) == len(urls) + 1
    for r in found:
        assert (r.host, r.path, r.rule) == plain_rule(urls[r.page_id], RULES)
    verdict = {r.page_id: r.verdict for r in found}
    assert [verdict[k] for k in range(8)] == ["allow"] * 4 + ["block", "allow", "block", "allow"] and [verdict[k] for k in (8, 9, 10)] == ["block", "block", "allow"]
    assert {r.page_id: r.words for r in found}[9] == ["casino", "win", "test", "poker", "#1"]
    assert url_filter.filter_urls(df.limit(0), RULES, corpus).count() == 0


def test_segmentation_is_the_best_of_all_splits():
    rng = random.Random(9)
    for _ in range(300):
        counts = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 4))): rng.randrange(1, 50) for _ in range(6)}
        name, total = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 10))), sum(counts.values())

        def worth(words, counts=counts, total=total):
            return sum(np.log(counts[w] / (total + 1)) if w in counts else -np.log(total + 1) - 3 * len(w) for w in words)

        splits = []
        for mask in range(1 << (len(name) - 1)):
            at = [0, *(k + 1 for k in range(len(name) - 1) if mask >> k & 1), len(name)]
            splits.append([name[i:j] for i, j in zip(at, at[1:], strict=False)])
        found = url_filter.segment(name, counts, total)
        assert "".join(found) == name and worth(found) == pytest.approx(max(map(worth, splits)))


def test_unigrams_are_those_of_plain_counting(spark):
    rows = ["The Cat sat", None, "cat-sat 12 ÉTÉ\tété\nx", ""]
    want = Counter(w for t in rows for w in re.findall(r"[^\W\d_]+", (t or "").lower()))
    assert {r.word: r.n for r in url_filter.count_words(spark.createDataFrame([(t,) for t in rows], "text string")).collect()} == want
    names = spark.createDataFrame([("catsat",), ("satxcat",), ("q" * 70,), ("zz",)], "name string")
    words = spark.createDataFrame(list(want.items()), "word string, n long")
    assert {r.name: r.words for r in url_filter.segmented_names(names, words).collect()} == {"catsat": ["cat", "sat"], "satxcat": ["sat", "x", "cat"], "q" * 70: ["q" * 70], "zz": ["zz"]}


def plain_block_probability(words, allowed, blocked, prior):
    vocabulary = set(allowed) | set(blocked)
    p = [1 - prior, prior]
    for w in words:
        if w in vocabulary:
            for k, c in enumerate((allowed, blocked)):
                p[k] *= (c[w] + 1) / (sum(c.values()) + len(vocabulary))
    return p[1] / sum(p)


def test_naive_bayes_is_that_of_plain_counting(spark):
    rng = random.Random(11)
    urls = []
    for k in range(400):
        name, end, lang = rng.choice(("river", "casino", "stone", "bets")), rng.choice(("com", "net", "org")), rng.choice(("en", "de", "es", "fr"))
        urls.append((k % 350, f"https://{name}.example.{end}/{lang}/{rng.choice(('x', 'y', '7', '88'))}"))
    found = url_filter.filter_urls(spark.createDataFrame(urls, "page_id long, url string"), RULES, allowed=("river",), blocked=("casino win",), prior=0.4).collect()
    counts = {"allow": Counter(["river"]), "block": Counter(["casino", "win"])}
    for host, path in {(r.host, r.path) for r in found}:
        r = next(r for r in found if (r.host, r.path) == (host, path))
        if r.rule is not None and not r.held_out:
            counts[r.verdict].update(r.words)
    assert any(r.held_out for r in found) and len(counts["allow"]) > 4
    for r in found:
        assert r.words == [f"#{len(w)}" if w.isdigit() else w for w in re.findall(r"[a-z]+|\d+", r.host + " " + r.path)]
        assert r.block_probability == pytest.approx(plain_block_probability(r.words, counts["allow"], counts["block"], 0.4))
        if r.rule is None:
            assert r.verdict == ("block" if r.block_probability >= 0.5 else "allow")
    decided = [r for r in found if r.rule is not None and r.held_out]
    assert sum((r.block_probability >= 0.5) == (r.verdict == "block") for r in decided) >= 0.6 * len(decided)


def test_fold_is_zlib_crc32(spark):
    from refrain.llm.labelled import fold

    got = spark.range(50).select("id", fold(F.col("id"), 5).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in got)
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_members_alike_but_not_similar_leave_their_bucket_once():
    rng = np.random.default_rng(5)
    common = rng.integers(0, 2**63, 700, np.uint64)
    least = Fraction(4, 5)
    sets = [np.unique(np.concatenate([common, rng.integers(0, 2**63, 90, np.uint64)])) for _ in range(30)]  # 0.8 and less
    sets += [np.unique(np.append(sets[0][:-5], rng.integers(0, 2**63, 3, np.uint64)))]  # similar to the first
    rows = [(7, i, i, len(s), near_copies.sketch(near_copies.signature(s))) for i, s in enumerate(sets)]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    names = ["key", "entry", "root", "n", "sketch"]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
    halves = [batch.slice(0, 11), batch.slice(11)]
    near = pa.Table.from_batches(near_copies._across(least)(iter(halves)))
    assert len(near) <= len(sets) and {0, 30} <= set(near.column("entry").to_pylist())
    kept = near.append_column("set", pa.array([sets[i].tobytes() for i in near.column("entry").to_pylist()], pa.binary())).combine_chunks()
    links = pa.Table.from_batches(near_copies._joined(least)(iter(kept.to_batches()))).to_pylist()
    wanted = {i: i for i in range(len(sets))}
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if both * 5 >= (len(sets[i]) + len(sets[j]) - both) * 4:
                old, new = wanted[i], wanted[j]
                wanted = {k: new if v == old else v for k, v in wanted.items()}
    found = {i: i for i in range(len(sets))}
    for link in links:
        old, new = found[link["a"]], found[link["b"]]
        found = {k: new if v == old else v for k, v in found.items()}
    groups = lambda of: sorted(sorted(k for k in of if of[k] == v) for v in set(of.values()))
    assert groups(found) == groups(wanted) and len(links) == len(sets) - len(groups(wanted)) and found[30] == found[0]
