"""Fill-in-the-middle and the conversation trie against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import pytest
from lexiflow.llm import infill, trie
from pyspark.sql import functions as F

UNIT = re.compile(r"[^\n]*\n|[^\n]+")
SHA = lambda t: hashlib.sha256(t.encode()).hexdigest()


def moved(doc_id, text, seed="7", rate=100, spm=50, markers=("<P>", "<S>", "<M>")):
    text = text or ""
    units = UNIT.findall(text)
    h = [int(SHA(f"{seed}:{'' if doc_id is None else doc_id}")[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    head, body, tail = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(m in text for m in markers) or h[2] % 100 >= rate:
        return doc_id, len(units), "plain", None, None, text
    p, s, m = markers
    if h[3] % 100 < spm:
        return doc_id, len(units), "spm", len(head), len(body), s + tail + p + head + m + body
    return doc_id, len(units), "psm", len(head), len(body), p + head + s + tail + m + body


def texts():
    rng = random.Random(3)
    out = [None, "", "\n", "\n\n\n", "one", "one\n", "a\r\nb\r\n", "x <P> y\nz", "<S>", "<M>\n", "<P", "P>\n<\nS>\n", "é\nüß\n漢字\n", "nul\x00\nin it\n", " not a line\u0085end\n", "\\E\\Q(.*)\n", "it's\n'quoted'\n", "y" * 300_000 + "\n" + "z" * 10]
    out += ["\n".join("".join(rng.choices("ab <>PSM\t\n", k=rng.randint(0, 30))) for _ in range(rng.randint(0, 40))) for _ in range(150)]
    return out


ROWS = [(k * 7 - 20, t, "x", 1, "u", "d") for k, t in enumerate(texts())] + [(None, "no id\nhere\n", "x", 1, "u", "d"), (1, "first\nsecond", "x", 1, "u", "d"), (1, "first\nsecond", "x", 1, "u", "d"), (1, "other\ntext\n", "x", 1, "u", "d")]
NAMES = "doc_id long, text string, output string, n int, `unit` string, `a.b c` string"


@pytest.mark.parametrize("more", [{}, {"seed": "it's", "rate": 40, "spm": 10, "markers": ("<|pre|>", "(.*)", "'m'")}])
@pytest.mark.parametrize("at_once", [4 << 20, 50])
def test_fill_in_middle(spark, more, at_once, monkeypatch):
    monkeypatch.setattr(infill, "AT_ONCE", at_once)
    docs = spark.createDataFrame(ROWS, NAMES).repartition(3)
    want = [moved(i, t, **more) for i, t, *_ in ROWS]
    got = infill.fill_in_middle(docs, **more).collect()
    assert sorted((tuple(r)[:5] + (r.output,) for r in got), key=repr) == sorted(want, key=repr)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    by_output = {(w[0], w[5]): SHA(t or "") for w, (_, t, *_) in zip(want, ROWS)}
    for r in got:
        assert r.output_sha256 == SHA(r.output) and r.restored_sha256 == by_output[r.doc_id, r.output]
    bare = infill.fill_in_middle(docs, **more, with_text=False)
    assert bare.columns == [c for c in got[0].asDict() if c != "output"]
    assert bare.exceptAll(spark.createDataFrame(got, infill.SCHEMA + ", output string").drop("output")).count() == 0


def test_fill_in_middle_of_nothing(spark):
    assert infill.fill_in_middle(spark.createDataFrame([], NAMES)).collect() == []
    for markers in (("a", "a", "b"), ("", "a", "b"), ("\\E", "a", "b")):
        with pytest.raises(ValueError):
            infill.fill_in_middle(spark.createDataFrame([], NAMES), markers=markers)


def plain_trie(rows, group=100, shared=6):
    """Nodes in plain Python: a dict of prefixes."""
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            name = SHA(f"{len(role.encode())}:{role}{text}")
            turns[c].append((turn is not None, turn or 0, name, role, text))
    turns = {c: [x[3:] for x in sorted(own)] for c, own in turns.items()}
    members = defaultdict(list)
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % shared
        lent = turns.get(c - int(math.fmod(c, group)), [])
        path = lent[:h] + own[h:]
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append((c, len(path)))
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    saved, leaves = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        saved[node] = own + sum(saved[x] for x in children[node])
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
    first = {node: min(c for c, _ in m) for node, m in members.items()}
    return sorted(
        (first[node], len(node), first[node[:-1]] if node else None, len(m), len(children[node]), leaves[node], saved[node], SHA(",".join(str(c) for c in sorted(c for c, n in m if n == len(node)))))
        for node, m in members.items()
    )


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def found(spark, rows, **more):
    """Also with columns of the operator's own names."""
    table = spark.createDataFrame([(*r, 7, "d", "x", 1) for r in rows], "conv_id long, turn long, role string, text string, depth int, name string, `a.b` string, turns int").repartition(4)
    got = trie.conversation_trie(table, **more)
    assert got.columns == COLUMNS and all(kind == "bigint" for name, kind in got.dtypes if name != "ends_sha256")
    return sorted(map(tuple, got.collect()), key=lambda r: (r[0], r[1], r))


def conversations():
    rng = random.Random(12)
    said = ["hello", "hi there", "", None, "é漢字", "more of it " * 5, "yes", "no"]
    rows = []
    for c in [*range(0, 30), *range(95, 130), 200, 205, 250, 399, -3, -100, -150, -199, 10**12, 10**12 + 7]:
        for turn in range(rng.randint(1, 9)):
            rows.append((c, rng.choice([turn, turn, turn, None, 3]), rng.choice(["user", "assistant", None, ""]), rng.choice(said)))
    # one conversation that many have, under bases that exist or not
    rows += [(c, t, "user", f"turn {t}") for c in range(300, 380) for t in range(3)]
    rows += [(c, t, "user", f"turn {t}") for c in range(7000, 7100) for t in range(9)]
    rows += [(c, t, "user", f"same {t}" if t < 6 else f"own {c}") for c in range(8001, 8060) for t in range(8)]
    rows += [(60, 1, "user", "twice"), (60, 1, "user", "twice"), (None, 1, "user", "nobody's"), (None, None, None, None)]
    rows += [(401, 0, "user", "short of its base")]  # often without a turn of its own
    rows += [(c, 0, "u", "x") for c in range(901, 940)]
    return rows


def test_conversation_trie(spark):
    rows = conversations()
    want = sorted(plain_trie(rows), key=lambda r: (r[0], r[1], r))
    got = found(spark, rows)
    assert got == want
    assert any(r[3] > 80 for r in got if r[1] > 3) and any(not r[6] for r in got)


@pytest.mark.parametrize("block, width", [(2, 3), (1024, 50)])
def test_long_conversations_are_split(spark, monkeypatch, block, width):
    """Conversations over many blocks, endings over many ranges."""
    monkeypatch.setattr(trie, "BLOCK", block)
    monkeypatch.setattr(trie, "RANGE", width)
    rows = conversations() + [(c, t, "user", f"turn {t % 5}") for c in (5000, 5001, 5002, 5150) for t in range(900)] + [(5000, None, "a", "b"), (5001, -5, "a", "b")]
    assert found(spark, rows) == sorted(plain_trie(rows), key=lambda r: (r[0], r[1], r))


def test_tries_of_little(spark):
    assert found(spark, []) == [] and found(spark, [(None, 1, "a", "b")]) == []
    # h of 701 takes its only turn, and nothing is lent: a root alone
    alone = next(c for c in range(701, 800) if zlib.crc32(str(c).encode()) % 6)
    empty = SHA("")
    assert found(spark, [(alone, 0, "u", "x")]) == [(alone, 0, None, 1, 0, 1, 0, SHA(str(alone)))]
    kept = next(c for c in range(701, 800) if not zlib.crc32(str(c).encode()) % 6)
    assert found(spark, [(kept, 0, "u", "x")]) == [(kept, 0, None, 1, 1, 1, 0, empty), (kept, 1, kept, 1, 0, 1, 0, SHA(str(kept)))]


def test_other_groups(spark):
    rows = conversations()
    assert found(spark, rows, group=10, shared=3) == sorted(plain_trie(rows, 10, 3), key=lambda r: (r[0], r[1], r))


def test_digests_go_on_over_batches():
    import pyarrow as pa

    rows = [((1, 0, 0, 0, 0), "1,2"), ((1, 0, 0, 0, 0), "7"), ((1, 0, 0, 0, 9), "3"), ((1, 0, 0, 0, 9), "4,5")]
    batch = lambda part: pa.record_batch([*map(pa.array, zip(*(k for k, _ in part))), pa.array([p for _, p in part])], names=[*trie.NODE, "piece"])
    for cut in range(1, 4):
        got = pa.Table.from_batches(list(trie._digested(iter([batch(rows[:cut]), batch(rows[cut:])])))).to_pylist()
        assert [r["ends_sha256"] for r in got] == [SHA("1,2,7"), SHA("3,4,5")]
