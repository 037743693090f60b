"""The corpus pipeline, stage by stage, against plain Python on a small corpus."""

import random
import re
from collections import Counter

import corpus_pipeline
import pytest
from lexiflow.llm import mixing, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    texts = [prose(rng.randint(30, 300)) for _ in range(80)]
    texts += [texts[0], texts[1], texts[1]]  # exact copies
    near = texts[5].split()
    near[10] = "changed"
    texts.append(" ".join(near) + " at the end")
    texts += ["too short", None, "", "again and again and again and " * 20]  # base rules
    texts += [f"{prose(30)}\nShare this page\n{prose(20)}" for _ in range(10)]
    texts += ["Share this page"] * 2
    rows = [(k, t, "en", f"src{k % 8}", len(t or "")) for k, t in enumerate(texts)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(0, 80, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


def read(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages(spark, corpus, tmp_path):
    folder, rows = corpus
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "SimHash near-dedup", "mixing", "packing"]
    results, docs = [], spark.read.parquet(f"{folder}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        found = stage(spark, docs, folder)
        if k < 4:
            assert found.columns == docs.columns
        found.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        results.append(docs)

    # quality: too few words or too much repetition goes, all else stays
    kept = {i: t for i, t, *_ in rows if len(WORD.findall(t or "")) >= 10 and not (t or "").startswith("again")}
    assert read(results[0]) == kept

    # lines: the shared line stays in the first document that has it
    first = min(i for i, t in kept.items() if "Share this page" in t.split("\n"))
    copies = {}
    for i, t in sorted(kept.items()):
        copies.setdefault(t, i)
    spread = {t for t in kept.values() if len({i % 8 for i, x in kept.items() if x == t}) >= 5}
    assert not spread  # copies stand in too few sources to be boilerplate
    lined = {i: "\n".join(x for x in t.split("\n") if x != "Share this page" or i == first) for i, t in kept.items()}
    assert read(results[1]) == lined

    # near-dedup: copies and the near copy go, the smallest doc_id stays
    gone = {80, 81, 82, 83}
    assert read(results[2]) == {i: t for i, t in lined.items() if i not in gone}

    # mixing: as often as the operator says
    expected = {r.doc_id: r.copies for r in mixing.mix(results[2]).collect() if r.copies}
    assert Counter(r.doc_id for r in results[3].collect()) == expected

    # packing: every emitted document is covered
    tokens = Counter()
    for r in results[4].collect():
        tokens[r.doc_id] += r.length
        assert r.offset + r.length <= 2048
    whole = {r.doc_id: r.doc_tokens for r in results[4].collect()}
    assert tokens == {i: whole[i] * n for i, n in expected.items()}


def test_run(spark, corpus):
    folder, _ = corpus
    assert {"doc_id", "sequence_id", "offset"} <= set(corpus_pipeline.run(spark, folder).columns)


def test_near_candidates_miss_no_pair_at_the_distance(spark, monkeypatch):
    """Fingerprints that differ in 21 random bits all link, with the pipeline's own segments."""
    rng = random.Random(21)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = []
    for k in range(300):
        a = rng.getrandbits(128)
        b = a ^ sum(1 << x for x in rng.sample(range(128), 21))
        rows += [(2 * k + i, 0, signed(p & (1 << 64) - 1), signed(p >> 64)) for i, p in enumerate((a, b))]
    table = spark.createDataFrame(rows, "doc_id long, text_key long, f0 long, f1 long")
    monkeypatch.setattr(simhash, "fingerprint_table", lambda *_, **__: table)
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(table, **getattr(corpus_pipeline, "NEAR", {"distance": 21, "lanes": 2, "segments": 4})).collect()}
    assert found == {k: k // 2 * 2 for k in range(600)}


def test_near_links_are_not_shadowed(spark, monkeypatch):
    """A-B and B-C are near, A-C is not, and A has every key at which B and C meet: they are one group."""
    table = spark.createDataFrame([(0, 0, 0, 0), (1, 0, 0x003F003F, 0), (2, 0, 0x0FFF0FFF, 0), (3, 0, -1, -1)], "doc_id long, text_key long, f0 long, f1 long")
    monkeypatch.setattr(simhash, "fingerprint_table", lambda *_, **__: table)
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(table, distance=12, lanes=2, segments=8).collect()}
    assert found == {0: 0, 1: 0, 2: 0, 3: 3}


def test_all_pairs_of_a_key_meet():
    import numpy as np

    rng = np.random.default_rng(5)
    key = np.sort(rng.integers(0, 4, 700).astype(np.uint64))
    key[:300] = 0
    label = rng.integers(0, 90, len(key))
    order = np.lexsort((label, key))
    key, label = key[order], label[order]
    prints = rng.integers(0, 1 << 63, (len(key), 2), dtype=np.uint64)
    i, j = simhash._across(key, label, prints, 60)
    apart = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2)
    want = np.argwhere((key[:, None] == key) & (label[:, None] != label) & (apart <= 60))
    assert sorted(zip(i.tolist(), j.tolist())) == [(a, b) for a, b in want.tolist() if a < b]


def test_near_links_are_those_of_the_shingle_sets(spark):
    """Of pairs around a similarity of 0.8, those at 0.8 or more go and no other, whatever repeats in them."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=7))
    shingles = lambda t: {tuple(t.lower().split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    texts = []
    for k in range(120):
        base = [word() for _ in range(200)]
        texts += [" ".join(base), " ".join(base[: 200 - k % 40 - 5] + [word() for _ in range(k % 40 + 5)])]
    said = " ".join(word() for _ in range(6)) + " "
    texts += [" ".join(word() for _ in range(30)) + " " + said * 60 for _ in range(2)]  # one fingerprint of all shingles, other sets
    similar = lambda a, b: len(a & b) / len(a | b)
    want = [2 * k + 1 for k in range(len(texts) // 2) if similar(shingles(texts[2 * k]), shingles(texts[2 * k + 1])) >= 0.8]
    assert 20 < len(want) < 100
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA)
    left = {r.doc_id for r in corpus_pipeline.near_stage(spark, docs, "").collect()}
    assert sorted(set(range(len(texts))) - left) == want


def test_near_stage_keeps_own_texts_of_shared_ids(spark):
    """A row with the doc_id of a copy and a text of its own stays."""
    rng = random.Random(9)
    prose = lambda: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(60))
    one, own = prose(), prose()
    rows = [(1, one), (5, one), (5, own), (7, prose()), (None, one), (8, own)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    left = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_stage(spark, docs, "").collect()), key=repr)
    assert left == sorted([(1, one), (5, own), rows[3], (None, one)], key=repr)


def test_pairs_are_given_once():
    """The key at which a pair is given is one that both post, the same from either side, for all pairs that meet."""
    import numpy as np

    rng = np.random.default_rng(6)
    one = rng.integers(0, 1 << 63, (400, 2), dtype=np.uint64)
    two = one.copy()
    for k in range(400):
        for bit in rng.choice(128, k % 33, replace=False).tolist():
            two[k, bit // 64] ^= np.uint64(1 << bit % 64)
    posted = []
    for prints in (one, two):
        values = simhash.segment_values(prints, 16, 8)
        posted.append([{int(v[k] ^ flip) << 4 | s for s, v in enumerate(values.astype(np.int64)) for flip in [0, *(1 << b for b in range(16))]} for k in range(400)])
    at = simhash.first_keys(one, two, 16, 8)
    assert (at == simhash.first_keys(two, one, 16, 8)).all()
    for k, (a, b) in enumerate(zip(*posted)):
        assert bool(a & b) == (int(at[k]) in a & b)
        assert a & b or k % 33 > 23


def test_bound_loses_no_similar_set():
    """Pairs that the bound sets aside have a lower similarity; it does set aside most that do."""
    import numpy as np

    rng = np.random.default_rng(7)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (1, 2, 5, 9, 40, 100, 146, 600)]
    for k in range(8):
        for share in (0.95, 0.89, 0.88, 0.8, 0.6):
            own = sets[k][rng.random(len(sets[k])) < share]
            sets.append(np.union1d(own, rng.integers(0, 1 << 63, len(sets[k]) - len(own), dtype=np.uint64)))
    sets.append(np.zeros(0, np.uint64))
    first = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    sketches = simhash.parity_sketches(np.concatenate(sets), first)
    i, j = np.triu_indices(len(sets))
    kept = simhash.may_reach(np.diff(first), sketches, 0.8, i, j)
    both = np.array([len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j)])
    union = np.diff(first)[i] + np.diff(first)[j] - both
    assert kept[both >= 0.8 * union].all()
    assert kept[both < 0.8 * union].mean() < 0.2


@pytest.mark.parametrize("name", ["quality", "lines", "near", "mixing", "emit", "shard", "dedup_lines", "keep"])
def test_columns_of_any_name(spark, corpus, name):
    """Dots, blanks and quotes in names of columns that are kept, also on an empty table."""
    from lexiflow.llm import lines, mixing, quality, sharding

    folder, rows = corpus
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    docs = spark.createDataFrame([(*r, f"v{k}", k, {"x.y": k}) for k, r in enumerate(rows)], SCHEMA + ", `a.b` string, `my col` long, `q``t` map<string,int>")
    step = {
        "quality": lambda d: corpus_pipeline.quality_stage(spark, d, folder),
        "lines": lambda d: corpus_pipeline.line_stage(spark, d, folder),
        "near": lambda d: corpus_pipeline.near_stage(spark, d, folder),
        "mixing": lambda d: corpus_pipeline.mixing_stage(spark, d, folder),
        "emit": mixing.emit,
        "shard": lambda d: sharding.shard(d, ["a", "b"]),
        "dedup_lines": lines.dedup_lines,
        "keep": lambda d: quality.keep(d, labels),
    }[name]
    found = step(docs)
    assert set(docs.columns) <= set(found.columns)
    values = {r.doc_id: (r["a.b"], r["my col"], r["q`t"]) for r in found.collect()}
    assert len(values) > 20 and all(v == (f"v{i}", i, {"x.y": i}) for i, v in values.items())
    assert step(docs.limit(0)).count() == 0
