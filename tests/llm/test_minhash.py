"""MinHash near-dedup against all pairs in plain Python."""

import random
import re

import numpy as np
import pytest
from lexiflow.llm import minhash, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, node int, size string, `a.b` string, component_id int"


def lowered(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def shingles(t, k=4):
    w = WORD.findall(lowered(t))
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, min(len(w), 1)))}


def grouped(rows, similarity=80):
    """(doc_id, n, component, kept) of each row, by all pairs of different sets."""
    sets = [frozenset(shingles(t)) for _, t in rows]
    least, near = {}, {}
    for (i, _), s in zip(rows, sets):
        if i is not None and s:
            least[s] = min(i, least.get(s, i))
    found = list(least)
    for a in found:
        near[a] = [b for b in found if 100 * len(a & b) >= similarity * len(a | b)]
    component = {}
    for s in sorted(found, key=least.get):
        if s not in component:
            component[s], todo = least[s], [s]
            while todo:
                for b in near[todo.pop()]:
                    if b not in component:
                        component[b] = least[s]
                        todo.append(b)
    out = []
    for (i, _), s in zip(rows, sets):
        c = component.get(s) if s else i
        out.append((i, len(s), c, c is None or i == c))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(31)
    word = lambda: "".join(rng.choices("abcdefghijklm", k=rng.randint(2, 7)))
    prose = lambda n: [word() for _ in range(n)]
    texts = [" ".join(prose(rng.randint(1, 90))) for _ in range(60)]
    texts += texts[:8] + [t.upper() for t in texts[8:14]] + [texts[3].replace(" ", "\n\t")]
    for k in range(60):  # pairs around the similarity
        base = prose(60 + k)
        cut = 60 + k - (k % 18)
        texts += [" ".join(base), " ".join(base[:cut] + prose(k % 18))]
    near = prose(150)  # a large group of near copies, a chain among them
    for k in range(90):
        copy = list(near)
        copy[k] = "changed"
        if k % 3:
            copy[(k * 7) % 150] = "again"
        texts.append(" ".join(copy))
    drift = prose(120)
    for k in range(12):
        drift = drift[5:] + prose(5)
        texts.append(" ".join(drift))
    passage = " ".join(prose(70))  # a passage that many share without being near
    texts += [f"{' '.join(prose(25))} {passage} {' '.join(prose(20))}" for _ in range(80)]
    texts += [None, "", " \n\t", "one", "ONE", "two words", "a b c", "A b C", "a b c d", "é È x Y", "É è x y", "ab " * 400, "ab " * 900, " ".join(prose(9000))]
    texts += [texts[-1] + " end", "<P> nul\x00 x y z", "a　b c d e"]
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(o * 3 - 50, t) for o, t in zip(order, texts)]
    rows += [(None, texts[0]), (None, "nobody has this but two"), (None, "nobody has this but two"), (None, None), (rows[1][0], texts[200]), rows[9], (rows[9][0], rows[9][1])]
    return rows


ROWS = corpus()


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "s", "x", 2) for r in rows], SCHEMA).repartition(4)


@pytest.mark.parametrize("contractions", [2, 0])
def test_components_are_those_of_all_pairs(spark, contractions):
    want = grouped(ROWS)
    found = minhash.minhash_groups(table(spark, ROWS), contractions=contractions)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found.collect()), key=repr) == want
    assert sum(not r[3] for r in want) > 100 and sum(r[3] for r in want) > 150


def test_nothing_to_link(spark):
    assert minhash.minhash_groups(table(spark, [])).collect() == []
    rows = [(1, None), (2, ""), (2, " "), (None, "\n")]
    assert sorted(map(tuple, minhash.minhash_groups(table(spark, rows)).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr) == grouped(rows)
    with pytest.raises(ValueError):
        minhash.minhash_groups(table(spark, rows), bands=40)


def test_minima_estimate_similarity(monkeypatch):
    """Signatures agree as often as sets are similar; parts of a long document don't matter."""
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    sets = [np.unique(pool[a:b]) for a, b in ((0, 1000), (100, 1100), (500, 1500), (2000, 2001), (0, 0), (0, 3000))]
    h, first = np.concatenate(sets), np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    found = minhash.minima(h, first, 128, 5)
    monkeypatch.setattr(minhash, "AT_ONCE", 37)
    assert (minhash.minima(h, first, 128, 5) == found).all()
    agree = lambda i, j: (found[i] == found[j]).mean()
    for i, j in ((0, 1), (0, 2), (1, 2), (0, 5), (0, 3)):
        true = len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j]))
        assert abs(agree(i, j) - true) < 4 * (true * (1 - true) / 128) ** 0.5 + 1e-9
    assert (found[4] == 0).all()


def test_few_pairs_at_the_similarity_are_missed():
    """Of 2,000 pairs of sets at 0.8 all share a band and pass the signature bits."""
    rng = np.random.default_rng(9)
    sets = []
    for _ in range(2000):
        both = rng.integers(0, 1 << 63, 80, dtype=np.uint64)
        sets += [np.concatenate((both, rng.integers(0, 1 << 63, 10, dtype=np.uint64))) for _ in range(2)]
    first = np.arange(0, 90 * len(sets) + 1, 90)
    found = minhash.minima(np.concatenate(sets), first, 128, 42)
    keys, bits = minhash.band_keys(found, 32), minhash.signature_bits(found)
    assert (keys[::2] == keys[1::2]).any(axis=1).all()
    assert (np.bitwise_count(bits[::2] ^ bits[1::2]).sum(axis=1) <= 33).all()


def test_links_are_confirmed_on_sets(spark):
    """Candidates below the similarity are not links, whatever their signatures say."""
    sets = spark.createDataFrame([(1, list(range(100))), (2, list(range(5, 100))), (3, list(range(12, 100)) + [500]), (4, [])], "node long, shingles array<long>")
    links = spark.createDataFrame([(2, 1), (3, 1), (3, 2), (4, 1), (3, 1)], "node long, other long")
    assert sorted(map(tuple, simhash.confirmed(links, sets, 0.88).collect())) == [(2, 1), (3, 2)]
