"""Operator 13 against a trie built by hand."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from ledgerline.llm import conversation_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string"


def expected(rows, max_depth=None):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + ts[h:]
    members = defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    out = []
    for node, of in members.items():
        below = [n for n in members if n[: len(node)] == node]
        ends = ",".join(map(str, sorted(c for c in of if len(built[c]) == len(node))))
        out.append(
            (
                min(of),
                len(node),
                min(members[node[:-1]]) if node else None,
                len(of),
                sum(len(n) == len(node) + 1 for n in below),
                sum(not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in below) for n in below),
                sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n),
                hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return sorted(out, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def found(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=str)


def generated(seed, convs, most=10, words=2):
    r = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(r.randrange(most)):
            rows.append((c, t if r.random() > 0.1 else None, r.choice(["user", "assistant", None]), r.choice(["a", "bé", "", None][: words + 2])))
            if r.random() < 0.1:
                rows.append(rows[-1])
    rows.append((None, 1, "user", "nobody's"))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_whole_trie(spark, seed):
    rows = generated(seed, 40)
    assert found(trie.conversation_trie(spark.createDataFrame(rows, SCHEMA))) == expected(rows)


def test_long_conversations_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 4)
    r = random.Random(3)
    rows = []
    for c in range(12):
        for t in range(r.choice([0, 3, 8, 13, 30])):
            rows.append((c, t, "user", "x" if t < 20 else r.choice("xy")))
    assert found(trie.conversation_trie(spark.createDataFrame(rows, SCHEMA))) == expected(rows)


def test_copies_ties_and_extra_columns(spark):
    rows = [(c, t, "user", "same" * 40000 if t == 1 else "s") for c in (0, 5, 7, 10) for t in range(12)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], SCHEMA + ", depth int, owner string")
    assert found(trie.conversation_trie(df.repartition(3))) == expected(rows)


def test_turnless_and_absent_base(spark):
    # conversations whose own turns all fall under their h, with and without a base
    rows = [(c, 0, "user", f"t{c % 3}") for c in range(3, 60) if c % 5]
    want = expected(rows)
    assert any(x[1] == 0 and x[3] > 1 for x in want)
    assert found(trie.conversation_trie(spark.createDataFrame(rows, SCHEMA))) == want


def test_only_turnless(spark):
    rows = [(c, 0, None, None) for c in range(1, 5) if zlib.crc32(str(c).encode()) % 9]
    assert found(trie.conversation_trie(spark.createDataFrame(rows, SCHEMA))) == expected(rows)


def test_empty_table(spark):
    assert found(trie.conversation_trie(spark.createDataFrame([], SCHEMA))) == []
