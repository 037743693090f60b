"""The training-data operators against brute force, on small and awkward tables."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from lexiflow.llm import encode, exact, lines, mixing, packing, quality, repeats, sharding, shared, simhash, textops, token_files
from lexiflow.llm import queries
from lexiflow.llm.queries import SHARDS, vocabulary
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Columns of the operators' own names stand in the tables.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk long, bucket string, site int, row_key string, slot long, key string, doc long, parts string, copies string"
OWN = ("k", 8, "p", "c")


def thue_morse(n, a, b):
    """Strings that polynomial hashes modulo powers of two can't tell from their complements."""
    return "".join(b if bin(k).count("1") % 2 else a for k in range(n))


TWO = thue_morse(2048, "a", "b"), thue_morse(2048, "b", "a")



def corpus():
    rng = random.Random(7)
    vocab = ["".join(rng.choices("abcdefghé", k=rng.randint(2, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choices(vocab, k=n))
    shared = [prose(60) for _ in range(3)]
    texts = [prose(rng.randint(1, 120)) for _ in range(60)]
    texts += [t for t in texts[:10]] + [texts[3].upper()] * 3
    texts += [f"{prose(15)} {rng.choice(shared)} {prose(10)}" for _ in range(25)]
    near = prose(200).split()
    for k in range(8):
        copy = list(near)
        copy[k * 20] = "zzz"
        texts.append(" ".join(copy))
    texts += [None, "", "   \n\t ", "one", "two words", "a b c", "ÄÖ é　x y", "<|endoftext|> don't\n\nstop", "hello <|endoftext|> world", "x" * 300, "ab " * 500]
    texts += ["\n".join([prose(9), "Subscribe now to our list", prose(7), "  Subscribe now to our list\r"]) for _ in range(12)]
    lead = prose(12)
    texts += [f"{lead} {TWO[0]}", f"{lead} {TWO[1]}", f"{prose(12)}\n{TWO[0]}\n{TWO[1]}\n{TWO[0]}"]
    texts.append(prose(20_000))
    texts.append(texts[-1] + " end")
    rows = [(k * 3 % 1009, t, ["en", "de", None][k % 3], None if k % 11 == 0 else f"src{k % 7 if k % 2 else 0}", len(t or ""), k, "b", k, "r", k, *OWN) for k, t in enumerate(texts)]
    rows.append((None, texts[0], "en", "src1", 1, 1, "b", 1, "r", 1, *OWN))
    rows += [(None, "nobody's text", "en", "src1", 1, 1, "b", 1, "r", 1, *OWN)] * 2
    rows.append((rows[2][0], prose(80), "en", "src1", 1, 1, "b", 1, "r", 1, *OWN))  # one doc_id, another text
    rows.append((*rows[7][:3], "src2", *rows[7][4:]))  # one doc_id and text, another source
    rows.append(rows[5])  # a repeated row
    return rows


ROWS = corpus()
NAMED = [r for r in ROWS if r[0] is not None]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def removed(tokens_of, length, join):
    first, out = {}, []
    for i, t, *_ in sorted(NAMED, key=lambda r: r[0]):
        x = tokens_of(t)
        for s in range(len(x) - length + 1):
            first.setdefault(tuple(x[s : s + length]), i)
    for i, t, *_ in ROWS:
        x = tokens_of(t)
        gone = [False] * len(x)
        for s in range(len(x) - length + 1 if i is not None else 0):
            if first[tuple(x[s : s + length])] < i:
                gone[s : s + length] = [True] * length
        spans = sum(g and not p for g, p in zip(gone, [False, *gone]))
        out.append((i, len(x), sum(gone), spans, hashlib.sha256(join([c for c, g in zip(x, gone) if not g])).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most, windows", [(20_000, 1 << 18), (2, 100)])
@pytest.mark.parametrize("kind", ["bytes", "words"])
def test_repeats(docs, kind, most, windows, monkeypatch):
    """Also with all picks of more than two runs split, and few windows at once."""
    monkeypatch.setattr(repeats, "WINDOWS", windows)
    if kind == "bytes":
        want = removed(lambda t: (t or "").encode(), 50, bytes)
        found = repeats.depth_passes(docs, 50, chunk_bytes=60_000, most=most)
    else:
        want = removed(lambda t: WORD.findall(t or ""), 13, lambda w: " ".join(w).encode())
        found = repeats.doubling_levels(docs, 13, chunk_bytes=60_000, most=most)
    got = [(r.doc_id, r.n_tokens, r.n_removed, r.n_spans, r.kept_sha256) for r in found.collect()]
    assert sorted(got, key=repr) == want
    assert sum(r[2] for r in want) > 1000


@pytest.mark.parametrize("length", [3, 8, 17, 24])
def test_radix_and_doubling_order_windows(length):
    """Groups of equal windows are exact at any depth."""
    rng = np.random.default_rng(length)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    data[1500:1600] = data[:100]
    stretch = np.arange(len(data)) // 100
    doc, end = rng.integers(0, 6, 30)[stretch], (stretch + 1) * 100
    at = np.flatnonzero(np.arange(len(data)) + length <= end)
    first = {}
    for k in at.tolist():
        w = data[k : k + length].tobytes()
        first[w] = min(doc[k], first.get(w, doc[k]))
    want = [first[data[k : k + length].tobytes()] for k in at.tolist()]
    assert repeats.radix(data, at, doc[at], length).tolist() == want
    assert repeats.doubling(data.astype(np.int64), end, doc, length)[at].tolist() == want


@pytest.mark.parametrize("kind", ["bytes", "words"])
def test_blocks_and_long_documents(kind, monkeypatch):
    """Runs don't depend on the blocks a long document is read in."""
    import pyarrow as pa

    rng = random.Random(4)
    text = " ".join("".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(4000))
    table = pa.table({"doc_id": [3, 1, None], "text": [text, "x " + text[500:9000], text]})
    plan = repeats.Plan(kind, 50 if kind == "bytes" else 13, 7, 9)
    windows = lambda c: [(int(k), int(p)) for s, e, k in zip(c.start, c.end, c.key) for p in range(s, e)]
    one = windows(repeats.Chunk(plan, table))
    monkeypatch.setattr(repeats, "BLOCK", 97)
    assert windows(repeats.Chunk(plan, table)) == one
    data, bounds = textops.ragged(table["text"])
    w, v = textops.Words(data, bounds, limit=50), textops.Words(data, bounds)
    assert w.text.tobytes() == v.text.tobytes() and (w.first == v.first).all() and (w.start == v.start).all() and (w.bounds == v.bounds).all()


def removed_fast(tokens, texts, length):
    """(tokens, removed) of each of few texts (doc_id in order) that repeat themselves: windows as numbers of a period."""
    seen, out = set(), []
    for x in map(tokens, texts):
        own, gone, until = set(), 0, 0
        for s in range(len(x) - length + 1):
            w = x[s : s + length]
            if w in seen:
                gone += s + length - max(s, until)
                until = s + length
            own.add(w)
        seen |= own
        out.append((len(x), gone))
    return out


@pytest.mark.parametrize("texts", [["x" * 80_000, "x" * 70_000], ["-=+ " * 20_000, "-=+ " * 19_000], ["a " * 80_000, "a " * 70_000, "b " + "a " * 66_000 + "c"], ["x" * 300_000 + " end", "start " + "x" * 290_000]])
def test_runs_longer_than_any_counter(spark, texts):
    """Texts that repeat themselves over more windows than a run, a block or 16 bits hold."""
    docs = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")
    for found, tokens, length in ((repeats.depth_passes(docs, 50), str.encode, 50), (repeats.doubling_levels(docs, 13), lambda t: tuple(WORD.findall(t)), 13)):
        got = [(r.n_tokens, r.n_removed) for r in sorted(found.collect())]
        assert got == removed_fast(tokens, texts, length)


def test_repeats_return_text(spark):
    text = "the same long passage of some fifty bytes and a little more than that"
    found = repeats.depth_passes(spark.createDataFrame([(1, text), (2, "A " + text + " Z")], "doc_id long, text string"), 50, with_text=True)
    kept = {r.doc_id: bytes(r.kept).decode() for r in found.collect()}
    assert kept == {1: text, 2: "A  Z"}


def test_exact(docs):
    lower = lambda t: (t or "").translate({c: c + 32 for c in range(65, 91)})
    groups = defaultdict(list)
    for i, t, *_ in ROWS:
        groups[lower(t)].append(i)
    want = []
    for i, t, *_ in ROWS:
        ids = groups[lower(t)]
        keep = max((x for x in ids if x is not None), default=None)
        want.append((i, keep, len(ids), keep is None or i == keep, hashlib.sha256(lower(t).encode()).hexdigest()))
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact.exact_groups(docs, capacity=5).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_directory_doubles(spark):
    rng = random.Random(2)
    keys = [rng.getrandbits(64) - (1 << 63) for _ in range(300)] + [(5 << 54) + rng.getrandbits(48) for _ in range(20)]
    table, depth = exact.directory(spark.createDataFrame([(k,) for k in keys], "key long"), 10, 40)
    rows = table.collect()
    assert sorted(r.cell for r in rows) == list(range(1 << depth)) and depth > 5
    named = {r.cell: r.bucket for r in rows}
    held = Counter(named[(k & (1 << 64) - 1) >> 64 - depth] for k in keys)
    depths = {r.bucket: r.depth for r in rows}
    assert all(n <= 10 for n in held.values()) and min(depths.values()) < max(depths.values())
    above = Counter((d, (k & (1 << 64) - 1) >> 64 - d) for k in keys for d in range(depth))
    # no bucket could have been left whole one level above
    assert all(d == 0 or above[d - 1, bucket >> depth - d + 1] > 10 for bucket, d in depths.items())
    alone, depth = exact.directory(spark.createDataFrame([], "key long"), 10, 0)
    assert [tuple(r) for r in alone.collect()] == [(0, 0, 0)] and depth == 0


def test_exact_lookup_goes_through_the_index(docs):
    """Buckets, depths and chains are those of the files, and hold what the directory says."""
    folder = shared.new_folder(docs.sparkSession, "test-index")
    rows = exact.exact_groups(docs, capacity=5, folder=folder).collect()
    entries = {(r.text_sha256): r for r in docs.sparkSession.read.parquet(f"{folder}/entries").collect()}
    assert all((r.bucket, r.depth, r.chain) == (e.bucket, e.depth, e.chain) for r in rows for e in [entries[r.text_sha256]])
    sizes = Counter(e.bucket for e in entries.values())
    assert len(sizes) > 10 and max(sizes.values()) <= 5


def test_packing(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    want = Counter()
    for i, x, *_ in ROWS:
        want[i, tuple(t.encode(x or "", add_special_tokens=False).ids + [1])] += 1
    rows = packing.pack(docs, vocabulary(), open_sequences=8, part_pieces=50).collect()
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
    for v in sequences.values():
        at = 0
        for r in sorted(v, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    expected = Counter()
    for (i, ids), n in want.items():
        for a in range(0, len(ids), 2048):
            piece = ids[a : a + 2048]
            expected[i, a, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes()), len(ids)] += n
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == expected


def test_hilbert_is_a_curve():
    side = 8
    grid = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    keys = packing.hilbert_keys(grid, bits=3)
    assert sorted(keys) == list(range(side**3))
    path = grid[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_bins_pack_best_fit():
    bins = packing.Bins(10, 5)
    assert [bins.put(n) for n in (6, 7, 3, 4, 10)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0)]
    bins = packing.Bins(10, 2)  # the sequence begun first is closed
    assert [bins.put(n) for n in (5, 6, 7, 5, 3, 4)] == [(0, 0), (1, 0), (2, 0), (3, 0), (2, 7), (3, 5)]


def test_packing_keeps_neighbours_together(spark):
    """Documents of a sequence are nearer on the curve than by chance, also on a table of one part."""
    rng = random.Random(6)
    kinds = [["".join(rng.choices("abcdefghij", k=5)) for _ in range(40)] for _ in range(6)]
    rows = [(k, " ".join(rng.choices(kinds[k % 6], k=rng.randint(30, 200)))) for k in range(1500)]
    found = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary(), open_sequences=16).collect()
    mates = defaultdict(list)
    for r in found:
        mates[r.sequence_id].append(r.doc_id % 6)
    pairs = [a == b for v in mates.values() for x, a in enumerate(v) for b in v[:x]]
    assert sum(pairs) / len(pairs) > 2 / 6


def test_encoder_keeps_ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    texts = [r[1] or "" for r in ROWS] + ["a　b  c", " x", "x ", "a\r\nb", "naïve ÿ é è", "'s 'll  's", "1 2 3\n4", "\x1c a \x85 b", "a<|endoftext|>b <|endoftext|>\n<|endoftext|>", f"x {TWO[0]} {TWO[1]} y {TWO[0]}"]
    coder = encode.Encoder(vocabulary(), keep=500)  # so that generations change
    for _ in range(4):
        data = "".join(texts).encode()
        bounds = np.concatenate(([0], np.cumsum([len(x.encode()) for x in texts])))
        ids, at = coder.ids(np.frombuffer(data, np.uint8), bounds)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def quality_counts(t):
    t = t or ""
    words = WORD.findall(t)
    windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    marked = {k + j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(5)}
    own = [x for x in t.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(own), len(own) - len(set(own)), len(marked)


def test_quality_counts(docs):
    extra = [(9000, "# a | b\n# a | b\nc\n\nc", "en", "s", 0, 0, "", 0, "", 0, *OWN)]
    table = docs.unionByName(docs.sparkSession.createDataFrame(extra, SCHEMA))
    labels = docs.sparkSession.createDataFrame([(1, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality(table, labels).collect()
    want = sorted(((i, *quality_counts(t)) for i, t, *_ in ROWS + extra), key=repr)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words) for r in got), key=repr) == want
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.base_failed)  # two labels support no cutoff
    kept = quality.keep(table, labels)
    assert kept.columns == table.columns and kept.count() == sum(r.kept for r in got)


def test_binomial_bound():
    from fractions import Fraction
    from math import comb

    for k, n, p in ((0, 10, Fraction(1, 10)), (3, 100, Fraction(1, 20)), (1, 50, Fraction(1, 4))):
        exactly = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert quality.binomial_tail(k, n, float(p)) == pytest.approx(float(exactly), rel=1e-9)
    steps = len(quality.PATH)
    table = [("few", 250, [0] * steps), ("many", 100_000, [0] * 5 + [900] * 3 + [0] * (steps - 8)), ("bad", 1000, [90] * steps), ("all", 2000, [0] * steps)]
    # 250 texts can't pass at one in a hundred; a path ends at its first failure
    assert quality.choose_steps(table, 0.01, 0.05) == {"many": steps, "all": steps}
    table[1][2][6] = 990
    assert quality.choose_steps(table, 0.01, 0.05)["many"] == 6
    for k in range(1, steps):
        assert set(quality.policy(k)) <= set(quality.policy(k + 1))


def test_quality_windows_with_one_hash():
    """Unequal windows that share a hash are told apart."""
    import unittest.mock

    number, at = np.array([1, 2, 3, 1, 2, 3, 9, 9]), np.arange(6)
    owner = np.array([0, 0, 0, 0, 0, 1])
    with unittest.mock.patch.object(quality, "mix", lambda x: x * np.uint64(0)):
        assert quality._twins(number, at, owner, 3).tolist() == [True, False, False, True, False, False]
    assert quality._twins(number, at, owner, 3).tolist() == [True, False, False, True, False, False]


def test_quality_cutoffs_reject_outliers(spark):
    """Held-out rows: junk goes, and good rows are falsely rejected within the limit."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("aeiounst", k=rng.randint(2, 5)))
    good = lambda: " ".join(word() for _ in range(40))
    rows = [(i, good()) for i in range(6000)] + [(6000 + i, " ".join(w + "#" for w in good().split())) for i in range(200)]
    table = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 6000, 2)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in quality.quality(table, labels).collect()}
    assert not any(got[i] for i in range(6000, 6200))
    assert sum(not got[i] for i in range(1, 6000, 2)) <= 0.01 * 3000


def test_sharding(docs):
    found = sharding.shard(docs, SHARDS)
    assert set(found.columns) == {*docs.columns, "shard"} and found.count() == len(ROWS)
    table = sharding.lookup_table(SHARDS, 65_537)
    sizes = Counter(table)
    assert table == queries._filled(SHARDS, 65_537)
    assert set(sizes) == set(range(64)) and max(sizes.values()) - min(sizes.values()) <= 1
    fewer = sharding.lookup_table(SHARDS[:-1], 65_537)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 63)
    assert moved < 0.05 * len(table)
    for r in found.select("doc_id", "slot", "shard").collect():
        name = "" if r.doc_id is None else str(r.doc_id)
        assert r.slot == int(hashlib.md5(name.encode()).hexdigest()[:15], 16) % 65_537 and r.shard == table[r.slot]
    with pytest.raises(ValueError):
        sharding.lookup_table(SHARDS, 65_536)


def test_token_files(docs, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    manifest = token_files.write_token_files(docs, vocabulary(), 0, str(tmp_path / "files"), shard_bytes=40_000)
    rows = sorted(token_files.read_token_files(manifest, with_ids=True).collect(), key=lambda r: r.start)
    order = [r.doc_id for r in rows]
    assert order == sorted(order, key=lambda i: (i is not None, i))
    at, texts = 0, defaultdict(list)
    for i, x, *_ in ROWS:
        texts[i].append(t.encode(x or "", add_special_tokens=False).ids + [0])
    for r in rows:
        assert r.start == at and list(r.ids) in texts[r.doc_id]
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.n_tokens == len(r.ids)
        at += r.n_tokens
    first = manifest.orderBy("base").first()
    shard = token_files.Shard(first["folder"], first["name"])
    assert [shard.document(k).tolist() for k in range(first["docs"])] == [list(r.ids) for r in rows[: first["docs"]]]


def test_token_files_of_large_ids(spark):
    """Ids over two bytes are whole."""
    docs = spark.createDataFrame([(1, "one"), (2, "two words")], "doc_id long, text string")
    rows = token_files.read_token_files(token_files.write_token_files(docs, vocabulary(), end_id=70_000), with_ids=True).collect()
    assert all(r.ids[-1] == 70_000 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in rows) and len(rows) == 2


@pytest.mark.parametrize("values", [[], [0], [5, 5, 5], list(range(1000)), [0, 1 << 40], sorted(random.Random(1).choices(range(10**7), k=3000))])
def test_elias_fano(values):
    code = token_files.EliasFano.from_bytes(token_files.EliasFano.of(np.array(values, np.int64)).to_bytes())
    assert [int(x) for k in range(len(code.sampled)) for x in code.block(k)] == values and [code.select(i) for i in range(len(values))] == values
    if len(values) == 3000:
        assert 8 * len(code.to_bytes()) < 3000 * 15


def fingerprint(t, k):
    from xxhash import xxh64_intdigest

    w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    votes = [0] * 64
    for x in shingles:
        h = xxh64_intdigest(x.encode(), 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def test_simhash(docs):
    prints = [(i, fingerprint(t, 3)) for i, t, *_ in ROWS]
    label = {p: p for _, p in prints}

    def find(p):
        while label[p] != p:
            p = label[p]
        return p

    for a in label:
        for b in label:
            if bin(a ^ b).count("1") <= 2:
                label[find(a)] = find(b)
    least = {}
    for i, p in prints:
        if i is not None:
            least[find(p)] = min(i, least.get(find(p), i))
    want = sorted(((i, p, least.get(find(p))) for i, p in prints), key=repr)
    got = sorted(((r.doc_id, r.f0 & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=repr)
    assert got == want


@pytest.mark.parametrize("most, direct", [(100_000, 1 << 16), (100_000, 4), (3, 4)])
def test_links_within_two_bits(spark, monkeypatch, most, direct):
    """Components by brute force: direct pairs, long lists and split segments."""
    rng = random.Random(most + direct)
    prints = {rng.getrandbits(64) for _ in range(300)}
    for base in rng.sample(sorted(prints), 12):
        for _ in range(25):  # chains and clouds, many with one half in common
            base ^= sum(1 << b for b in rng.sample(range(32) if rng.random() < 0.6 else range(64), rng.randint(1, 3)))
            prints.add(base)
    prints = sorted(prints)
    label = list(range(len(prints)))

    def find(k):
        while label[k] != k:
            k = label[k]
        return k

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                label[y] = x
    monkeypatch.setattr(simhash, "DIRECT", direct)
    import pyarrow as pa

    node, f0 = np.arange(len(prints)), np.array(prints, np.uint64).view(np.int64)
    hot = [np.array([v for v, n in Counter((p >> 32 * s) & (1 << 32) - 1 for p in prints).items() if n > most], np.uint64) for s in range(2)]
    assert most > 3 or len(hot[0]) + len(hot[1]) > 3
    batches = list(simhash._post_halves(2, [np.sort(h) for h in hot], iter([pa.record_batch([pa.array(node), pa.array(f0)], names=["node", "f0"])])))
    table = pa.Table.from_batches(batches)
    union = list(range(len(prints)))

    def root(k):
        while union[k] != k:
            k = union[k]
        return k

    for bucket in set(table["bucket"].to_pylist()):
        links = simhash._meet_halves(table.filter(pa.compute.equal(table["bucket"], bucket)))
        for a, b in zip(links["node"].to_pylist(), links["other"].to_pylist()):
            assert a > b and (prints[a] ^ prints[b]).bit_count() <= 2
            x, y = sorted((root(a), root(b)))
            union[y] = x
    assert [root(k) for k in range(len(prints))] == [find(k) for k in range(len(prints))]


def test_simhash_chain_of_near_fingerprints(spark):
    """Links of at most two bits close over a long chain."""
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (102, 101)], "node long, other long")
    got = {r.node: r.component for r in simhash.components(links).collect()}
    assert got == {k: 0 for k in range(1, 41)} | {101: 100, 102: 100}


def test_wide_fingerprints_find_near_copies(spark):
    rng = random.Random(5)
    base = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(400)]
    rows = [(k, " ".join("new" if 20 * k <= j < 20 * k + 1 else w for j, w in enumerate(base))) for k in range(10)]
    rows += [(100 + k, " ".join(rng.choices(base, k=400))) for k in range(50)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(table, shingle=5, distance=19, lanes=2, segments=4).collect()}
    assert all(got[k] == 0 for k in range(10)) and all(got[100 + k] == 100 + k for k in range(50))


def test_mixing(docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS)
    size = defaultdict(int)
    for _, t, _, s, *_ in ROWS:
        size[s] += len(WORD.findall(t or ""))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(size.values())
    while True:  # the excess is shared again until none is above
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * size[s]}
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 2.0 * size[s]
            left -= target[s]
        open_ -= full
    taken, sizes = defaultdict(int), defaultdict(list)
    for r in rows:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
        sizes[r.source].append(r.size)
    for s in names:
        # a document of a large part of its source can't be made up for by the others
        assert abs(taken[s] - target[s]) <= max(sizes[s])
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, rows))
    emitted = mixing.emit(docs)
    assert emitted.columns == docs.columns
    assert emitted.count() == sum(r.copies for r in rows)


def test_mix_meets_targets(spark):
    """Words taken differ from a target by little more than a small document."""
    rng = random.Random(12)
    rows = [(k, "w " * int(rng.lognormvariate(4, 1)), f"s{rng.choice('aaab') if k % 9 else 'c'}") for k in range(900)]
    taken, target = Counter(), {}
    for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect():
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert len(target) == 3 and all(abs(taken[s] - target[s]) < 0.005 * target[s] for s in target)


def test_mix_takes_each_document_as_often_as_expected(spark):
    """Over many offsets a document's copies are target / size on average, and only the offset decides."""
    rng = random.Random(13)
    rows = [(k, "w " * rng.choice([0, 3, 3, 8, 50]), f"s{k % 3}") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)
    total, taken, seeds = Counter(), [], 24
    mixes = [mixing.mix(docs, seed=f"seed {k}") for k in range(seeds)]
    expected = {r.doc_id: r.target / r.source_size for r in mixes[0].collect()}
    for m in mixes:
        own = {r.doc_id: r.copies for r in m.collect()}
        assert set(own.values()) <= {0, 1, 2}
        total.update(own)
        taken.append(own)
    assert len(set(expected.values())) == 3
    for i, e in expected.items():
        assert abs(total[i] / seeds - e) < 0.45, (i, total[i] / seeds, e)
    by_source = Counter()
    for i in expected:
        by_source[i % 3] += total[i] / seeds / expected[i] / 20
    assert all(abs(x - 1) < 0.1 for x in by_source.values()), by_source
    # which documents are taken changes with the offset
    sometimes = [i for i in expected if 1 < total[i] < seeds * 2 - 1 and len({own[i] for own in taken}) > 1]
    assert len(sometimes) > 20


def test_emit_keeps_other_columns_apart(spark):
    """Rows equal but for another column are each emitted for themselves."""
    rows = [(k // 2, "some words that are the same", "s", "qz"[k % 2]) for k in range(40)] + [(7, "own", "s", None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, tag string")
    want = Counter()
    for r in mixing.mix(docs, share=2.0).collect():
        want[r.doc_id, r.size] += r.copies
    got = mixing.emit(docs, share=2.0).collect()
    assert Counter(r.tag for r in got if r.doc_id != 7 or r.tag) == {"q": 40, "z": 40}
    assert Counter((r.doc_id, len(r.text.split())) for r in got) == +want


def test_lines(docs):
    sites, first = defaultdict(set), {}
    core = lambda x: x.strip(" \t\r\x0b\x0c")
    for i, t, _, s, *_ in ROWS:
        for x in (t or "").split("\n"):
            if core(x):
                sites[core(x)].add(s)
                if i is not None:
                    first[core(x)] = min(i, first.get(core(x), i))
    bad = {x for x, s in sites.items() if len(s) >= 4}
    assert "Subscribe now to our list" in bad
    want = []
    for i, t, *_ in ROWS:
        parts = (t or "").split("\n")
        gone = [core(x) in bad and i != first.get(core(x)) for x in parts]
        kept = None if t is None else "\n".join(x for x, g in zip(parts, gone) if not g)
        want.append((i, kept, sum(bool(core(x)) for x in parts), sum(gone)))
    found = lines.dedup_lines(docs, min_sites=4)
    assert found.columns == [*docs.columns, "_lines", "_removed"]
    got = [(r.doc_id, r.text, r["_lines"], r["_removed"]) for r in found.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_empty_tables(none, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for found in (
        repeats.depth_passes(none), repeats.doubling_levels(none), exact.exact_groups(none), packing.pack(none, vocabulary()), quality.quality(none, labels),
        sharding.shard(none, SHARDS), token_files.read_token_files(token_files.write_token_files(none, vocabulary())), simhash.near_duplicates(none), mixing.mix(none), mixing.emit(none), lines.dedup_lines(none),
    ):
        assert found.count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_their_sql(spark, name):
    from compare import compare

    assert compare(spark, name, "/root/testdata/sf0.001") is None
