"""Operator 11 against brute force over all pairs of words."""

import random
import zlib
from collections import Counter

import pytest

from ledgerline.llm import spelling

LOW = str.maketrans(spelling.UPPER, spelling.LOWER)


def counted(docs):
    c = Counter()
    for doc_id, text in docs:
        run = ""
        for x in (text or "") + " ":
            if x.isascii() and x.isalpha() or "À" <= x <= "ÿ":
                run += x
                continue
            if run:
                run = run.translate(LOW)
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                c[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
            run = ""
    return {w: n for w, n in c.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(counts):
    forms, rows = {}, []
    for w, n in counts.items():
        other = sorted((-counts[x], x) for x in counts if x != w and near(w, x))
        forms[w] = (other[0][1], -other[0][0]) if other and -other[0][0] >= 10 * n else (None, None)
        rows.append((w, n, len(other)))
    out = []
    for w, n, k in rows:
        root = w
        while forms[root][0] is not None:
            root = forms[root][0]
        out.append((w, forms[w][0], root, n, k, forms[w][1]))
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def texts(seed, n=60):
    r = random.Random(seed)
    stems = ["straße" + x for x in ("nbahn", "n", "nlaterne")] + ["aaaaaaa", "abababab", "èéêëèéêë", "Thinking", "thinkings"]
    out = []
    for i in range(n):
        words = []
        for _ in range(r.randrange(1, 80)):
            w = r.choice(stems)
            if r.random() < 0.3:
                at = r.randrange(len(w))
                w = r.choice([w[:at] + w[at + 1 :], w[:at] + r.choice("aéz") + w[at:], w[:at] + r.choice("bé") + w[at + 1 :]])
            words.append(w)
        out.append((i, r.choice([" ", "-", ", ", "1"]).join(words)))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_all_pairs(spark, seed):
    docs = texts(seed)
    got = found(spelling.spelling_variants(spark.createDataFrame(docs, "doc_id long, text string")))
    assert got == expected(counted(docs)) and len(got) > 50 and any(r[1] for r in got)


def test_crowded_posting_lists_are_cut(spark):
    r = random.Random(5)
    vocabulary = {"common" + "".join(r.choice("xyz") for _ in range(5)): r.choice([2, 3, 40, 500]) for _ in range(150)}
    df = spark.createDataFrame(list(vocabulary.items()), "word string, n long")
    assert found(spelling.variant_forms(df, limit=7)) == expected(vocabulary)


def test_chains_of_forms(spark):
    words = ["baaaaaaa", "bbaaaaaa", "bbbaaaaa", "bbbbaaaa", "bbbbbaaa"]
    vocabulary = {w: 2 * 10**i for i, w in enumerate(words)}
    rows = found(spelling.variant_forms(spark.createDataFrame(list(vocabulary.items()), "word string, n long")))
    assert rows == expected(vocabulary) and {r[2] for r in rows} == {"bbbbbaaa"}


def test_nulls_long_words_repeats_and_extra_columns(spark):
    long = "ab" * 3000
    docs = [(1, None), (2, ""), (None, "Thinking thinking"), (3, "short words only"), (4, f"{long} {long}"), (5, f"{long}x {long}x"), (5, f"{long}x")]
    df = spark.createDataFrame([(*d, "n", 1) for d in docs], "doc_id long, text string, word string, n int")
    assert found(spelling.spelling_variants(df)) == expected(counted(docs))


def test_empty_table(spark):
    assert found(spelling.spelling_variants(spark.createDataFrame([], "doc_id long, text string"))) == []


def test_index_merges_under_the_bound(monkeypatch):
    words = sorted(["wording", "wordinx", "wxrding", "wordnig"])
    for few in (0, 8):
        monkeypatch.setattr(spelling, "FEW", few)
        index = spelling.PostingIndex(7)
        for w in words:
            index.add(w, 1)
        assert [w for w, _ in index.near("wording", (0,))] == ["wordinx", "wxrding"]
        assert [w for w, _ in index.near("wordig", (0, 1))] == ["wording", "wordnig"]
    with pytest.raises(ValueError):
        spelling.variant_forms(None, dominance=1)


@pytest.mark.parametrize("few", [0, 3])
def test_against_all_pairs_by_merging(spark, monkeypatch, few):
    # one vocabulary in one task here, so that the lists are merged in this process too
    r = random.Random(9)
    words = sorted({"".join(r.choice("ab") for _ in range(r.choice([7, 8, 9]))) for _ in range(300)})
    monkeypatch.setattr(spelling, "FEW", few)
    for length in (7, 8, 9):
        index, held = spelling.PostingIndex(length), [w for w in words if len(w) == length]
        for w in held:
            index.add(w, 1)
        for w in words:
            if len(w) in (length - 1, length):
                got = {x for x, _ in index.near(w, (0,) if len(w) == length else (0, 1))}
                assert got == {x for x in held if x != w and near(w, x)}
