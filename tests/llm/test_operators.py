"""Small cases for every operator, most of them against brute force."""

import base64
import gzip
import hashlib
import random
import re
import struct
import zlib
from collections import Counter
from urllib.parse import quote_from_bytes

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerline.llm import bpe, decontaminate, html_text, quality, queries, repeats, secrets, sharding, simhash
from ledgerline.llm import token_counts, warc
from ledgerline.llm.common import work_dir
from ledgerline.llm.html_training import labelled_page

RANKS, PATTERN = public_tokenizers.path(queries.RANKS), public_tokenizers.PATTERN
DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, size string, kept string"


def docs(spark, rows):
    """rows: (doc_id, text); further columns clash with names that operators use."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y", "z") for i, t in rows], DOCS)


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" + r.choice(("", "", ",", ".\n")) for _ in range(n))


EDGES = [(None, "null id"), (1, None), (2, ""), (3, " \n\t "), (4, "é" * 3000), (5, "long " * 30000), (5, "long " * 30000)]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(10 + i, prose(i, 60 + 7 * i)) for i in range(30)]
    rows += [(100 + i, rows[i][1]) for i in range(5)]
    rows += [(200 + i, rows[i][1] + " changed") for i in range(5)]
    return docs(spark, EDGES + rows).cache()


def pairs(df):
    return [(r["doc_id"], r["text"] or "") for r in df.collect()]


# 1 token counts


def test_token_counts_match_a_per_token_loop(spark, corpus):
    encoding, _ = token_counts.encoding(RANKS, PATTERN)
    got = {}
    for r in token_counts.count_tokens(corpus, RANKS, PATTERN).collect():
        got.setdefault(r["doc_id"], {}).setdefault(r["section"], []).append((r["n_tokens"], r["doc_tokens"]))
    for doc_id, text in pairs(corpus):
        ids = encoding.encode_ordinary(text)
        raw, at, want = text.encode(), 0, {k: 0 for k in range(text.count("\n") + 1)}
        lines, pos = [], 0
        for line in text.split("\n"):
            lines.append((pos, pos + len(line)))
            pos += len(line) + 1
        if len(ids) < 3000:
            for i in ids:
                size = len(encoding.decode_single_token_bytes(i))
                s = len(raw[:at].decode(errors="ignore"))
                e = max(s + 1, len(raw[: at + size].decode(errors="ignore")))
                over = [(min(e, b) - max(s, a), -k) for k, (a, b) in enumerate(lines)]
                best = max(over)
                owner = -best[1] if best[0] > 0 else -1
                want[owner] = want.get(owner, 0) + 1
                at += size
            assert {k: v[0][0] for k, v in got[doc_id].items()} == {k: v for k, v in want.items() if k >= 0 or v}
        assert all(t == len(ids) for v in got[doc_id].values() for _, t in v)
        assert sum(v[0][0] for v in got[doc_id].values()) == len(ids)


def test_token_counts_with_given_sections(spark):
    df = spark.createDataFrame(
        [(1, "alpha beta gamma", [(0, 5), (5, 10)]), (2, None, None), (3, "abc", [])],
        "doc_id long, text string, parts array<struct<start:long,end:long>>",
    )
    rows = token_counts.count_tokens(df, RANKS, PATTERN, sections_col="parts").collect()
    one = {r["section"]: r["n_tokens"] for r in rows if r["doc_id"] == 1}
    assert set(one) == {-1, 0, 1} and sum(one.values()) == [r["doc_tokens"] for r in rows if r["doc_id"] == 1][0]
    assert [r["section"] for r in rows if r["doc_id"] == 3] == [-1]
    assert token_counts.count_tokens(df.limit(0), RANKS, PATTERN, sections_col="parts").collect() == []


def test_token_counts_with_odd_sections(spark):
    """Overlapping, unordered, null, half null, negative, reversed and too long spans."""
    text = "one two three four five six"  # a token each, with the space before it
    odd = [(14, 18), None, (None, 3), (0, 7), (4, 13), (-1, 5), (9, 2), (18, 999), (18, 23)]
    df = spark.createDataFrame([(1, text, odd), (1, text, odd)], "doc_id long, text string, parts array<struct<start:long,end:long>>")
    rows = token_counts.count_tokens(df, RANKS, PATTERN, sections_col="parts").collect()
    n = {r["section"]: r["n_tokens"] for r in rows}
    assert len(rows) == 18 and n == {0: 1, 1: 0, 2: 0, 3: 2, 4: 1, 5: 0, 6: 0, 7: 1, 8: 1} | ({-1: n[-1]} if -1 in n else {})
    assert {r["section"]: (r["start"], r["end"]) for r in rows}[6] == (9, 2) and rows[0]["doc_tokens"] == 6
    order, s, e = token_counts.apart([x or (None, None) for x in odd], len(text))
    assert sorted(order.tolist()) == list(range(9)) and (s[1:] >= e[:-1]).all() and (s <= e).all()


def test_token_counts_of_no_rows(spark):
    assert token_counts.count_tokens(docs(spark, []), RANKS, PATTERN).collect() == []


def test_crossing_token_goes_to_the_larger_share_then_the_earlier():
    s = np.array
    owner, crossing = token_counts.attribute(s([0, 4, 8]), s([4, 8, 12]), s([0, 5, 10]), s([5, 10, 12]))
    assert owner.tolist() == [0, 1, 1] and crossing.tolist() == [False, True, True]
    owner, _ = token_counts.attribute(s([0]), s([3]), s([1, 2]), s([2, 3]))
    assert owner.tolist() == [0]


# 2 secret scans


def test_base_kinds():
    text = 'Password: "hunter22x" token=abc API_KEY = \'zzzzzz\' AKIA' + "A" * 16 + " " + "0af" * 8 + " AKIAshort"
    got = secrets.scan(text)
    assert [(k, text[s:e]) for k, s, e in got] == [
        ("assign", 'Password: "hunter22x'),
        ("assign", "API_KEY = 'zzzzzz"),
        ("access", "AKIA" + "A" * 16),
        ("hex", "0af" * 8),
    ]
    assert not secrets.scan("toKen=abcdefgh paſſword=abcdefgh")  # letters of ASCII only


def brute_base(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


def nest(text, *how):
    for h in how:
        if h == "url":
            text = "".join(f"%{b:02X}" for b in text.encode())
        elif h == "unicode":
            text = text.encode("utf-16-be").hex()
            text = "".join(f"\\u{text[i:i + 4]}" for i in range(0, len(text), 4))
        elif h == "base64":
            text = base64.b64encode(text.encode()).decode()
        elif h == "gzip":
            text = base64.b64encode(gzip.compress(text.encode(), mtime=0)).decode()
        else:
            text = base64.b64encode(zlib.compress(text.encode())).decode()
    return text


@pytest.mark.parametrize(
    "how",
    [("url",), ("unicode",), ("base64",), ("gzip",), ("zlib",), ("url", "base64"), ("base64", "base64", "url"), ("gzip", "unicode", "base64"), ("base64", "gzip", "base64")],
)
def test_nested_secrets_map_to_the_document(how):
    inner = "x é token=abcdef123 y"
    text = "héad " + nest(inner, *how) + " tail"
    found = secrets.unwrap(text, 1 << 20).rows
    assert found and all(k == "assign" for k, *_ in found)
    outer = (text.index(" ") + 1, len(text) - 5)
    assert all(outer[0] <= s < e <= outer[1] for _, s, e, _ in found)
    if how == ("url",):
        (_, s, e, _), = found
        assert bytes.fromhex(text[s:e].replace("%", "")).decode() == "token=abcdef123"


def wrapped(raw, width):
    text = base64.b64encode(raw).decode()
    return "\n".join(text[i : i + width] for i in range(0, len(text), width))


SECRET, FILL = b"token=abcdef123", bytes(random.Random(1).choices(b"ghijklmnop ", k=300))


@pytest.mark.parametrize(
    "text",
    [
        base64.b64encode(gzip.compress(gzip.compress(SECRET))).decode(),
        base64.b64encode(gzip.compress(zlib.compress(gzip.compress(SECRET)))).decode(),
        base64.b64encode(gzip.compress(FILL) + gzip.compress(SECRET)).decode(),
        base64.b64encode(gzip.compress(b"x toke") + gzip.compress(b"n=abcdef123")).decode(),
        base64.b64encode(gzip.compress(b"\x00\xff" + SECRET + b"\x00")).decode(),
        wrapped(gzip.compress(FILL + SECRET), 64),
        wrapped(FILL[:50] + SECRET, 76),
        wrapped(FILL[:50] + SECRET, 76).replace("\n", "\r\n  ") + "\nnext line",
        *[f"{glue}{base64.b64encode(b' ' + SECRET + b' ').decode()}" for glue in ("/x/y/", "data_", "a", "ab", "abc", "abcd")],
        *[f"{glue}{base64.b64encode(gzip.compress(SECRET)).decode()}" for glue in ("/x/y/", "data_", "a", "ab", "abc", "abcd")],
        base64.b64encode(b"\xff\x00 " + SECRET + b" \x00\xfe").decode(),
        base64.b64encode(b" " + SECRET + b" ..").decode().rstrip("=") + "a",
        "".join(f"%{b:02x}" for b in gzip.compress(SECRET)),
        quote_from_bytes(gzip.compress(FILL + SECRET)),
        quote_from_bytes(zlib.compress(SECRET)),
        "".join(f"\\x{b:02x}" for b in gzip.compress(SECRET)),
        repr(zlib.compress(FILL + SECRET))[2:-1],
        "%FF" + "".join(f"%{b:02x}" for b in SECRET),
        "\\xff\\xfe" + "".join(f"\\x{b:02x}" for b in SECRET),
        quote_from_bytes(base64.b64encode(b"\xff" + gzip.compress(zlib.compress(SECRET)))),
    ],
)
def test_secrets_in_streams_lines_and_glued_runs(text):
    found = secrets.unwrap(f"head {text} tail", 1 << 20)
    assert [k for k, *_ in found.rows].count("assign") >= 1 and not found.truncated
    left = secrets.redact(f"head {text} tail", found.rows)
    assert not secrets.unwrap(left, 1 << 20).rows and left.startswith("head ") and left.endswith(" tail")


def deflated(raw, wbits, level=9):
    c = zlib.compressobj(level, zlib.DEFLATED, wbits)
    return c.compress(raw) + c.flush()


LONGER = bytes(random.Random(2).choices(b"abcdefghij klmnop", k=400)) + b" password=hunter22x " + bytes(random.Random(3).choices(b"abcdefghij", k=60))


@pytest.mark.parametrize(
    "raw",
    [
        gzip.compress(LONGER)[:-9],
        gzip.compress(LONGER)[:-8] + b"\0\0\0\0" + gzip.compress(LONGER)[-4:],
        gzip.compress(FILL) + gzip.compress(LONGER)[:-1],
        zlib.compress(LONGER)[:-5],
        zlib.compress(LONGER)[:-4] + b"xxxx",
        deflated(LONGER, 15, 0)[:-60],
    ],
)
def test_damaged_streams_are_read_to_the_damage_and_redacted(raw):
    text = f"head {base64.b64encode(raw).decode()} tail"
    found = secrets.unwrap(text, 1 << 20)
    assert found.truncated and (5, len(text) - 5) in found.unread
    assert [k for k, *_ in found.rows] == ["assign"] * len(found.rows) and found.rows
    assert secrets.redact(text, [("unread", s, e, "") for s, e in found.unread]) == "head [SECRET] tail"


@pytest.mark.parametrize("wbits", [9, 10, 11, 12, 13, 14, 15, -9, -15, 25, 31])
@pytest.mark.parametrize("level", [0, 1, 9])
def test_streams_of_every_window_and_wrapper(wbits, level):
    text = f"head {base64.b64encode(deflated(LONGER, wbits, level)).decode()} tail"
    found = secrets.unwrap(text, 1 << 20)
    assert ("assign", 5, len(text) - 5) in {(k, s, e) for k, s, e, _ in found.rows} and not found.truncated


@pytest.mark.parametrize("encoding", ["utf-16-le", "utf-16-be", "utf-16"])
def test_wide_text_in_base64(encoding):
    text = "x" + base64.b64encode("é token=abcdef123 €".encode(encoding)).decode()
    (kind, s, e, path), = secrets.unwrap(text, 1 << 20).rows
    assert kind == "assign" and 1 <= s < e <= len(text) and path == "base64"


def test_octal_escapes():
    text = "a " + "".join(f"\\{b:03o}" for b in "é token=abcdef123".encode()) + " b"
    (kind, s, e, path), = secrets.unwrap(text, 1 << 20).rows
    assert (kind, text[s:e][:4], e, path) == ("assign", "\\164", len(text) - 2, "unicode")
    blob = "".join(f"\\{b:03o}" for b in gzip.compress(SECRET))
    assert secrets.unwrap(f"a {blob} b", 1 << 20).rows


def test_each_stream_has_room_of_its_own():
    large, small = nest("a" * 3_000_000, "gzip"), nest("z token=abcdefg z", "gzip")
    found = secrets.unwrap(f"{large} {small}", 10_000)
    assert small in {f"{large} {small}"[s:e] for _, s, e, _ in found.rows} and len(found.unread) == 1


def test_long_random_runs_are_left_alone():
    blob = base64.b64encode(random.Random(4).randbytes(30_000)).decode()
    assert not secrets.unwrap(f"a {blob} b", 1 << 20).unread


def test_decoding_ends_on_cycles_and_bombs():
    text = nest("a" * 100000 + " token=abcdef", "gzip")
    assert secrets.unwrap(text, 50).truncated
    assert not secrets.unwrap("%25%32%35" * 50, 1 << 20).truncated
    assert secrets.unwrap(nest("token=abcdef", *["base64"] * 12), 1 << 20).rows


def test_no_layer_is_skipped_after_a_large_one(monkeypatch):
    bomb, small = nest("a" * 100_000 + " token=abcdef " + "a" * 100_000, "gzip"), nest("a token=abcdefg z", "base64")
    text = f"{bomb} {small} {nest('b' * 300_000, 'gzip')}"
    found = secrets.unwrap(text, 50)
    spans = {text[s:e] for _, s, e, _ in found.rows}
    assert found.truncated and bomb in spans and any(small.startswith(x[:8]) or x in small for x in spans)
    assert text[slice(*found.unread[0])] == bomb and len(found.unread) == 2
    monkeypatch.setattr(secrets, "MOST_PIECES", 2)
    found = secrets.unwrap(text, 50)  # the first run is not read to its end
    assert found.truncated and any(x in small for x in {text[s:e] for _, s, e, _ in found.rows})
    assert bomb in {text[s:e] for s, e in found.unread}
    many = "%41" * 2000 + " " + nest("a token=abcdefg z", "base64", "url")
    deep = SECRET
    for _ in range(1500):
        deep = zlib.compress(deep)
    assert secrets.unwrap(base64.b64encode(deep).decode(), 16 << 20).rows
    assert secrets.unwrap(many, 1).rows and not secrets.unwrap(many, 1).truncated


def test_secret_report_and_redaction(spark, corpus):
    rows = [(1, "a token=abcdef b"), (2, None), (None, "AKIA" + "Z" * 17), (4, nest("secret: qwertyuiop", "url") + " password=%41bcdefgh")]
    got = {r["doc_id"]: r for r in secrets.secret_report(secrets.scan_secrets(docs(spark, rows))).collect()}
    for doc_id, text in rows:
        assert got[doc_id]["base_sha256"] == hashlib.sha256(brute_base(text or "").encode()).hexdigest()
        base = set(brute_base(text or "").split(",")) - {""}
        assert base <= set(got[doc_id]["spans"].split(","))
    assert got[1]["spans"] == "assign:2:14" and got[1]["n_assign"] == 1
    assert len(got[4]["spans"].split(",")) == 2
    assert secrets.redact("a token=abcdef b", [("assign", 2, 14, ""), ("hex", 8, 14, "")]) == "a [SECRET] b"
    everything = secrets.secret_report(secrets.scan_secrets(corpus))
    assert everything.count() == corpus.count()


# 3 decontamination


def test_containment_matches_brute_force(spark):
    r = random.Random(1)
    items = [(i, prose(1000 + i, r.choice((2, 4, 6, 12, 30, 60)))) for i in range(25)] + [(90, None), (91, "..."), (92, "w1"), (None, prose(7, 20)), (0, prose(1000, 12)), (7, prose(7, 20)), (8, prose(7, 20))]
    rows = EDGES + [(10 + i, prose(i, 300)) for i in range(20)]
    for i in range(60):
        words = decontaminate.words_of(items[i % 25][1])
        for _ in range(r.choice((0, 0, 1, 2, 5))):
            words[r.randrange(len(words))] = "zzz"
        rows.append((100 + i, f"{prose(i, 200)} {' '.join(words)} {prose(i + 50, 300)}".upper()))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(
        ((x["doc_id"], x["item_id"], x["n_shared"], x["n_item_shingles"]) for x in decontaminate.find_contaminated(docs(spark, rows), bench).collect()),
        key=str,
    )
    want = []
    for doc_id, text in rows:
        words = decontaminate.words_of(text or "")
        for item_id, item in items:
            own = decontaminate.words_of(item or "")
            if own:
                n = min(5, len(own))
                wanted, held = decontaminate.shingles(own, n), decontaminate.shingles(words, n)
                if len(wanted & held) >= 0.8 * len(wanted):
                    want.append((doc_id, item_id, len(wanted & held), len(wanted)))
    assert got == sorted(want, key=str) and len(want) > 30
    left = decontaminate.drop_contaminated(docs(spark, rows), bench)
    bad = {d for d, *_ in want}
    assert len(items) > len({t for _, t in items})  # a text that is an item twice
    assert left.columns == docs(spark, rows).columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted(str(d) for d, _ in rows if d not in bad)
    old, decontaminate.BLOCK_CHARS = decontaminate.BLOCK_CHARS, 1000
    try:  # several blocks of items give the same
        again = decontaminate.find_contaminated(docs(spark, rows), bench)
        assert sorted(((x["doc_id"], x["item_id"], x["n_shared"], x["n_item_shingles"]) for x in again.collect()), key=str) == got
        left = decontaminate.drop_contaminated(docs(spark, rows), bench)
        assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted(str(d) for d, _ in rows if d not in bad)
    finally:
        decontaminate.BLOCK_CHARS = old


# 4 SimHash


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    n = min(3, len(words))
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_roots(prints):
    """prints: {fingerprint: least id}; the least id that each reaches."""
    left, out = set(prints), {}
    while left:
        todo, seen = [left.pop()], []
        while todo:
            x = todo.pop()
            seen.append(x)
            near = [y for y in left if (x ^ y).bit_count() <= 2]
            left.difference_update(near)
            todo += near
        ids = [prints[x] for x in seen if prints[x] is not None]
        out |= dict.fromkeys(seen, min(ids, default=None))
    return out


def test_simhash_of_documents(spark, corpus):
    prints = {}
    for doc_id, text in pairs(corpus):
        f = brute_print(text)
        known = prints.get(f)
        prints[f] = known if doc_id is None else doc_id if known is None else min(known, doc_id)
    roots = brute_roots(prints)
    got = simhash.near_duplicates(corpus).collect()
    want = sorted((str(i), f"{brute_print(t):016x}", roots[brute_print(t)]) for i, t in pairs(corpus))
    assert sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in got) == want
    crowds = simhash.grouped(simhash.fingerprints(corpus), hot_rows=1).collect()  # copies of two rows count as hot
    assert sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in crowds) == want
    assert simhash.near_duplicates(corpus.limit(0)).collect() == []


@pytest.mark.parametrize("limit", [2048, 20, 3])
def test_links_join_what_brute_force_joins(spark, limit):
    r = random.Random(5)
    fps = {r.getrandbits(64) for _ in range(150)}
    for center in list(fps)[:6] + [0]:
        for _ in range(60):  # crowds that share many bits
            x = center
            for _ in range(r.randrange(5)):
                x ^= 1 << r.randrange(64)
            fps.add(x)
    df = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    roots = {x["node"]: x["root"] for x in simhash.components(simhash.near_links(df, limit)).collect()}
    want = brute_roots({f: simhash.signed(f) for f in fps})
    assert {simhash.signed(f): s for f, s in want.items() if simhash.signed(f) != s} == roots


# 5 quality


def test_rare_languages_are_one(spark):
    rows = [(i, prose(i, 60), "aa") for i in range(40)] + [(50, prose(50, 60) * 2, "bb"), (51, "x y z 1 2 3 " * 30, "cc"), (52, prose(52, 70), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    rules = quality.Rules(min_share=20)
    refs = quality.references(df, rules)
    assert set(refs) == {"aa", quality.RARE}
    renamed = df.withColumn("lang", F.when(df.lang == "aa", "aa").otherwise(quality.RARE))
    same = quality.references(renamed, rules)
    assert all((a[0] == b[0]).all() and a[1] == b[1] and (a[2] == b[2]).all() for a, b in ((refs[k], same[k]) for k in refs))
    got = sorted(map(tuple, quality.quality(df, rules=rules).collect()))
    assert got == sorted(map(tuple, quality.quality(renamed, rules=rules).collect()))
    assert set(quality.references(df, quality.Rules())) == {"aa", "bb", "cc", ""}


def test_quality_of_a_very_long_text(spark):
    text = "\n".join(f"{prose(i, 50)} #%" for i in range(2000)) + "\n" + prose(3, 50)
    (row,) = quality.quality(spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string")).collect()
    words = text.split()
    seen = Counter(zip(*(words[i:] for i in range(8)), strict=False))
    hit = {p + k for p in range(len(words) - 7) if seen[tuple(words[p : p + 8])] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\v\f")]
    assert (row["n_words"], row["n_symbols"], row["n_dup_lines"], row["n_repeat_words"]) == (len(words), 4000, len(lines) - len(set(lines)), len(hit))


def brute_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    inside = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            inside |= set(range(i, i + 8))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def test_quality_measures(spark):
    r = random.Random(3)
    rows = [(i, t) for i, t in EDGES if len(t or "") < 5000]
    for i in range(40):
        text = prose(i, r.randrange(10, 120), 60)
        rows.append((10 + i, f"{text}\n{text[:90]}\x1c\x85  #|\n{text}" if i % 3 else text))
    got = {r["doc_id"]: r for r in quality.quality(docs(spark, rows)).collect()}
    for doc_id, text in rows:
        want = brute_measures(text or "")
        row = got[doc_id]
        assert tuple(row[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert row["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (row["base_failed"] and row["kept"])
    assert quality.repeated_words([b"a"] * 5000) == 5000 and quality.repeated_words([b"%d" % i for i in range(5000)]) == 0


def test_divergence_rejects_junk_and_keeps_prose(spark):
    rows = [(i, prose(i, 150, 80).replace("w", "wo")) for i in range(80)]
    junk = [(900 + i, " ".join(f"{w}***" for w in prose(i, 150, 80).split())) for i in range(4)]
    short = [(990, "### $$$ %%% " * 4)]
    got = {r["doc_id"]: r for r in quality.quality(docs(spark, rows + junk + short)).collect()}
    assert all(got[i]["kept"] for i, _ in rows if not got[i]["base_failed"])
    assert not any(got[i]["kept"] for i, _ in junk)
    assert got[990]["class_distance"] is None  # under the guard's length
    p, q = np.array([3.0, 1.0, 0.0]), np.array([0.0, 1.0, 1.0])
    assert 0 < quality.js_distance(p, q) < 1 and quality.js_distance(p, 2 * p) < 1e-9
    assert quality.js_distance(np.array([1.0, 0]), np.array([0, 1.0])) == pytest.approx(1)
    assert quality.quality(docs(spark, [])).collect() == []


def test_small_languages_are_judged_like_large_ones(spark):
    """Junk in a language of one document goes, prose of any script and language stays."""
    def row(i, text, lang):
        return (i, text, lang, "s", len(text), "x", "y", "z")

    other = str.maketrans("woabcdefghijklmnpqrstuvxyz", "шолвырапдежзикмнптуфхцчщэю")
    large = [row(i, prose(i, 150, 80).replace("w", "wo"), "en") for i in range(200)]
    small = [row(300 + i, prose(400 + i, 120, 900).replace("w", f"q{i}zu"), f"x{i}") for i in range(6)]
    small += [row(320 + i, prose(500 + i, 120, 80).replace("w", "wo").translate(other), "ru") for i in range(3)]
    small += [row(330, prose(600, 120, 80).replace("w", "wo"), None)]
    junk = [row(340 + i, " ".join(f"{w}*** |" for w in prose(700 + i, 150, 900).split()), f"y{i}") for i in range(5)]
    got = {r["doc_id"]: r["kept"] for r in quality.quality(spark.createDataFrame(large + small + junk, DOCS)).collect()}
    assert all(got[r[0]] for r in small) and not any(got[r[0]] for r in junk)
    own = np.array([5.0, 5, 0, 0, 0, 0, 0])
    assert quality.with_pooled(own, np.array([0.0, 0, 0, 5, 0, 0, 5]), 100).tolist() == [30, 30, 0, 50, 0, 0, 0]
    assert quality.with_pooled(own * 0, own * 0, 100).tolist() == [0] * 7


# 6 WARC


def test_archives_round_trip(spark):
    big = "<p>" + "x" * 1200
    rows = [(i, f"http://h/{i}", big if i % 3 else f"{i}" * 600) for i in range(1, 40)]
    rows += [(50, None, None), (51, "u", ""), (None, "n", big), (52, "a\r\nb", "tiny"), (53, "u", "tiny"), (39, "again", rows[37][2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    folder = work_dir(spark, "warc-test")
    index = warc.write_archives(pages, folder)
    got = warc.read_archives(index, folder).collect()
    largest = {}
    for i, _, h in rows:
        if i is not None and len(h or "") >= 1000:
            largest[h] = max(i, largest.get(h, i))
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        groups = sum(x == h for *_, x in rows)
        refers = largest.get(h) if groups > 1 and largest.get(h) != i else None
        want.append((str(i), len(raw), hashlib.sha1(raw).hexdigest(), "response" if refers is None else "revisit", refers))
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == sorted(want, key=str)
    assert index.where("page_id = 1").count() == 1
    assert warc.archive_round_trip(pages.limit(0)).collect() == []


def test_bundles_are_seekable_zstandard(monkeypatch):
    import io

    import zstandard

    monkeypatch.setattr(warc, "FRAME_BYTES", 3000)
    sink = io.BytesIO()
    sink.close = lambda: None
    writer = warc.BundleWriter(sink)
    records = [warc.record(i, f"http://h/{i}", b"y" * 700, None, "1970-01-01T00:00:00Z") for i in range(20)]
    places = [writer.add(r) for r in records]
    writer.close()
    raw = sink.getvalue()
    plain = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
    assert plain == b"".join(records)  # an ordinary reader sees one stream
    frames = warc.frames_of(raw)
    assert len(frames) > 5 and all(frames[f][o : o + len(r)] == r for (f, o), r in zip(places, records, strict=True))


def test_frames_hold_a_bounded_number_of_records():
    import io

    writer = warc.BundleWriter(io.BytesIO())
    frames = [writer.add(warc.record(i, "u", b"z" * 1200, 1, "1970-01-01T00:00:00Z"))[0] for i in range(3 * warc.FRAME_RECORDS)]
    assert [frames.count(f) for f in range(3)] == [warc.FRAME_RECORDS] * 3


def test_archives_name_a_scheme_that_is_not_known(spark):
    pages = spark.createDataFrame([(1, "u", "h")], "page_id long, url string, html string")
    with pytest.raises(ValueError, match="can't be kept in nosuch"):
        warc.write_archives(pages, "nosuch://bucket/warc")


# 7 sharding


def brute_shard(key, tree):
    def draw(path, weight):
        h = xxhash.xxh64_intdigest(path.encode(), xxhash.xxh64_intdigest(struct.pack("<q", key), 42))
        return np.log(((h >> 12) + 1) / 2**52) / weight

    region = max(tree, key=lambda g: draw(g.name, g.weight))
    rack = max(region.racks, key=lambda r: draw(r.name, r.weight))
    return max(rack.shards, key=lambda s: draw(f"{rack.name}.{s[0]}", s[1]))[0]


def test_shards_match_brute_force_and_move_only_into_the_new_one(spark):
    rows = [(i * 7, f"t{i}") for i in range(600)] + [(None, None), (None, ""), (7, "t1"), (7, "t1")]
    tree, grown = sharding.even_tree(40), sharding.even_tree(41)
    got = sharding.assign_shards(docs(spark, rows), tree, grown).collect()
    assert len(got) == len(rows)
    for r in got:
        key = -1 if r["doc_id"] is None else r["doc_id"]
        assert r["shard"] == brute_shard(key, tree) and r["grown_shard"] == brute_shard(key, grown)
        assert r["grown_shard"] in (r["shard"], 40)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    texts = {i: t or "" for i, t in rows}
    assert all(r["size"] == len(texts[r["doc_id"]].encode()) + 16 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) for r in got)
    assert sharding.assign_shards(docs(spark, []), tree).collect() == []


def test_weight_changes_move_rows_only_in_their_subtree(spark):
    old = sharding.even_tree(16)
    rack = old[0].racks[0]
    heavier = sharding.Rack(rack.name, ((0, 3.0), *rack.shards[1:]))
    new = (sharding.Region(old[0].name, (heavier, old[0].racks[1])), old[1])
    df = spark.range(3000).select(sharding.shard_of(sharding.F.col("id"), old).alias("a"), sharding.shard_of(sharding.F.col("id"), new).alias("b"))
    moved = [(r["a"], r["b"]) for r in df.where("a <> b").collect()]
    assert moved and all(b < 8 for _, b in moved)  # only into or inside the changed region
    assert all(b < 4 or a >= 8 for a, b in moved)


# 8 BPE


def test_bpe_equals_tiktoken_and_round_trips(spark, corpus):
    encoding = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    more = [(1000, "don't  we'll\n\n x\t 12345 日本語 😀 \x00\x1c\x85 "), (1001, "<|endoftext|>"), (1002, " lead"), (1003, "a" * 5000), (1004, "tail ")]
    df = corpus.unionByName(docs(spark, more))
    got = bpe.decode_documents(bpe.encode_documents(df, RANKS, PATTERN), RANKS, PATTERN).collect()
    at_once = bpe.round_trip_documents(df, RANKS, PATTERN).collect()
    assert sorted(map(str, at_once)) == sorted(map(str, got))
    rows = sorted(pairs(df), key=str)
    assert len(got) == len(rows)
    for r, (doc_id, text) in zip(sorted(got, key=lambda r: str((r["doc_id"], bytes(r["decoded"]).decode()))), rows, strict=True):
        assert r["doc_id"] == doc_id and bytes(r["decoded"]).decode() == text
        assert np.frombuffer(r["ids"], "<u4").tolist() == encoding.encode_ordinary(text)


def test_bpe_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 50)
    codec = bpe.Codec(RANKS, PATTERN)
    encoding = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=codec.model and bpe.read_ranks(RANKS), special_tokens={})
    for i in range(20):
        text = prose(i, 40) + "x" * 100
        (ids,) = codec.encode([text])
        assert np.frombuffer(ids, "<u4").tolist() == encoding.encode_ordinary(text)
        assert len(codec.known) <= 100


# 9 HTML


def test_marginals_equal_enumeration():
    model = html_text.Model({"bias": 0.3, "tag=p": -0.9, "hint=ad": 1.1, "size=4": 0.7}, (0.8, 0.2, 1.4, 0.5, 0.3))
    nodes = html_text.parse("<div class=ad>hello there<p>one<p>two <b>x</b></div><div>tail</div>")
    own = [model.own(v) for v in nodes]
    total, good = 0.0, np.zeros(len(nodes))
    for state in range(1 << len(nodes)):
        y = [state >> v & 1 for v in range(len(nodes))]
        score = sum(o * b for o, b in zip(own, y, strict=True))
        for v in range(1, len(nodes)):
            score += model.edges[html_text.sort_of(nodes, v)] * (2 * y[v] - 1) * (2 * y[nodes[v].parent] - 1)
        total += np.exp(score)
        good += np.exp(score) * np.array(y)
    assert np.allclose(model.marginals(nodes), good / total)


def test_held_out_accuracy():
    model, right, n = html_text.trained(), 0, 0
    for seed in range(50_000, 50_080):
        nodes, inside = html_text.labels_of(labelled_page(seed))
        found = model.marginals(nodes) > 0.5
        leaves = [v for v, x in enumerate(nodes) if x.tag == "#text"]
        right += sum(found[v] == inside[v] for v in leaves)
        n += len(leaves)
    assert right / n >= 0.98


def test_page_text(spark):
    page = (
        '<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body>'
        '<nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- no --><div class="ad">Buy this now.</div><article>'
        "<h1>Title &amp; more</h1><p><b>First  line\n here.<br><p>Second &copy; one, with enough words to read.</p>"
        "<form><p>Your mail</p></form></article><div class='comments'><p>Nice post, I like it a lot.</p></div>"
        "<footer>&copy; host</footer>"
    )
    df = spark.createDataFrame([(1, "u", page), (2, None, None), (None, "v", "<p"), (4, "w", "plain & <b>simple")], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html_text.extract_text(df).collect()}
    assert got[1]["text"] == "Title & more\nFirst line here.\nSecond © one, with enough words to read."
    assert got[1]["n_chars"] == len(got[1]["text"]) and got[2]["text"] == "" and got[None]["text"] == ""
    assert html_text.extract_text(df.limit(0)).collect() == []


@pytest.mark.parametrize(
    "page",
    [
        "<head><title>x</title><body><p>AAA<p>BBB</body>",
        "<head><title>x</title><p>AAA<p>BBB",
        "<div><button>Go</div><p>AAA<p>BBB",
        "<button>Go<p>AAA</p><p>BBB</p><button>Go</button>",
        "<div><select><option>x</div><p>AAA<p>BBB",
        "<select><option>x<p>AAA<p>BBB",
        "<svg><text>x</text><p>AAA<p>BBB",
        "<p hidden>AAA<p>BBB",
        "<ul><li hidden>AAA<li>BBB</ul>",
        '<div style="color:red;display : none !important">AAA<div>BBB</div></div>',
        "<p>AAA</p><button><div>x</div><p>x</p></button><div hidden=''><p>BBB</div>",
        '<div class="overflow-hidden"><p>AAA</p></div><p style="overflow:hidden">BBB',
        '<div aria-hidden="false"><p>AAA</p></div><p data-x="hidden gems" data-style="display:none">BBB',
        "<object data=x><p>AAA</p><object data=y><p>BBB</p>",
        "<object><object>x</object>x</object><p>AAA</p><object><p>BBB",
        "<svg><svg>x</svg>x</svg>AAA<hr><canvas>x</canvas>BBB",
        "<p>AAA</p><p><math><semantics><mi>B</mi><mo>B</mo><mn>B</mn><annotation>x</annotation></semantics></math></p>",
    ],
)
def test_only_what_is_left_out_is_lost(page):
    texts = [html_text.block_text(v) for v in html_text.parse(page) if v.tag == "#text"]
    assert texts == ["AAA", "BBB"]


LONG = [f"Paragraph {k} of the article is long enough to be read as one, with a comma, some words and a full stop." for k in range(3)]


#: Written by hand, apart from the generator: what surrounds and wraps the article LONG. None of the rest is content.
@pytest.mark.parametrize(
    ("before", "after"),
    [
        ("<body>", ""),
        ("<article style='overflow:hidden'>", "</article>"),
        ("<article title='a hidden gem'>", "</article>"),
        ("<article data-state='hidden-lg' aria-hidden='false'>", "</article>"),
        ("<html><head><title>x</title><body><article>", "</article>"),
        ("<div class='post-tags-content'>", "</div>"),
        ("<div class='meta'>", "</div>"),
        ("<body class='single has-sidebar has-ads'><nav><a href=/>Home</a> <a href=/a>About</a></nav><div class='post'>", "</div><footer>(c) The owner of the site</footer>"),
        ("<header><a href=/>Site</a></header><div class='c12'><div class='row'>", "</div></div><aside><h3>Related</h3><ul><li><a href=/x>Another one</a><li><a href=/y>One more</a></ul></aside>"),
        ("<div id=cookie-banner>We use cookies. <button>OK</button></div><main>", "</main><section class='comments'><h3>2 comments</h3><div class='comment'><p>I liked this one a lot, thank you for it!</p></div><div class='comment'><p>So did I, and I will be back for more.</p></div></section>"),
        ("<ul class='menu'><li><a href=/>Start</a><li><a href=/n>News</a></ul><div class='story'>", "<div class='share'><a href=/f>Share</a> <a href=/t>Post</a></div></div><form action=/s><label>Mail</label><input name=q><p>Get our letter each week.</p></form>"),
        ("<table><tr><td class='nav'><a href=/>Index</a></td><td>", "</td></tr></table><div class='ad'>Buy two, get one free. Only this week.</div>"),
    ],
)
def test_article_by_hand(before, after):
    page = "<!DOCTYPE html>" + before + "".join(f"<p>{x}</p>" for x in LONG) + after
    assert html_text.main_text(page, html_text.trained()) == "\n".join(LONG)


@pytest.mark.parametrize(
    "inline", ["<button><div>x</div></button>", "<svg><path d='M0'/><text>x</text></svg>", "<svg/>", "<select><option>x</select>", "<object>x<object>y</object></object>", "</button>", "<canvas>x</canvas>"]
)
def test_text_goes_on_behind_a_control_in_its_paragraph(inline):
    nodes = html_text.parse(f"<p>See the <a href=/>icon {inline} in</a> the corner</p>")
    texts = [v for v in nodes if v.tag == "#text"]
    assert [nodes[v.parent].tag for v in texts] == ["p"] and html_text.block_text(texts[0]) == "See the icon in the corner"
    assert texts[0].linked == len("icon  in")


TABLE = "<table>" + "".join(f"<tr><td>Row {k}</td><td>{k * 7}</td></tr>" for k in range(12)) + "</table>"
CHAPTERS = "<ul>" + "".join(f"<li><a href=/c{k}>Chapter {k} of the book</a></li>" for k in range(8)) + "</ul>"


#: A block inside an article and its lines.
@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<div class='post'>{}</div>", "<article hidden>{}</article>", "<article style='display:none'>{}</article>", "<main><x-story>{}</x-story></main>"])
@pytest.mark.parametrize(
    ("block", "lines"),
    [
        (TABLE, [x for k in range(12) for x in (f"Row {k}", str(k * 7))]),
        ("<table><tr><td>One</td></tr></table>", ["One"]),
        ("<table><caption>The years</caption><thead><tr><th>Year</th></tr></thead><tbody><tr><td>1999</td></tr></tbody></table>", ["The years", "Year", "1999"]),
        ("<figure><img src=a.png><figcaption>A view of the harbour</figcaption></figure>", ["A view of the harbour"]),
        ("<dl><dt>Term</dt><dd>What the term means here</dd></dl>", ["Term", "What the term means here"]),
        (CHAPTERS, [f"Chapter {k} of the book" for k in range(8)]),
        ("<h2><a href=/more>A linked heading</a></h2>", ["A linked heading"]),
        ("<p>See the icon<svg><path d='M0 0'/></svg> in the corner, then press it.</p>", ["See the icon in the corner, then press it."]),
        ("<object data=a><object data=b>", []),
        ("<details><summary>More</summary><p>It goes on here.</p></details>", ["More", "It goes on here."]),
        ("<pre>a = 1\nb = 2</pre>", ["a = 1 b = 2"]),
        ("<center>In the middle of it</center>", ["In the middle of it"]),
    ],
)
def test_blocks_of_an_article(wrap, block, lines):
    body = f"<p>{LONG[0]}</p>{block}<p>{LONG[1]}</p><p>{LONG[2]}</p>"
    page = f"<html><body><nav><ul><li><a href=/>Home</a></li><li><a href=/b>News</a></li></ul></nav>{wrap.format(body)}<footer>&copy; the owner</footer></body></html>"
    assert html_text.main_text(page, html_text.trained()) == "\n".join([LONG[0], *lines, LONG[1], LONG[2]])


def page_by_other_rules(seed):
    """A page of another make than the training pages: own words, classes, order and
    frames, in the manner of common site builders. Returns it with its main text."""
    r = random.Random(seed)
    say = lambda n: " ".join("".join(r.choice("bdfklmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(n))
    anchor = lambda: f"<a class='lnk' href='/{r.randrange(99)}'>{say(2)}</a>"
    out, lines = [], []

    def put(markup, *texts):
        out.append(markup.format(*texts))
        lines.extend(texts)

    put("<h1 itemprop=headline>{}</h1>", say(6))
    for _ in range(r.randint(3, 8)):
        k = r.randrange(9)
        if k < 4:
            put("<p class=p{{}}>{}</p>".replace("{{}}", str(k)), say(r.randint(25, 60)) + ".")
        elif k == 4:
            put("<table class=tbl>" + "<tr><th>{}</th><td>{}</td></tr>" * 4 + "</table>", *[say(r.randint(1, 3)) for _ in range(8)])
        elif k == 5:
            put("<ul>" + "<li>{}</li>" * 3 + "</ul>", *[say(r.randint(3, 9)) for _ in range(3)])
        elif k == 6:
            put("<figure class=img><img alt=x><figcaption>{}</figcaption></figure>", say(7))
        elif k == 7:
            put("<dl><dt>{}</dt><dd>{}</dd></dl>", say(2), say(9))
        else:
            put("<h3>{}</h3><blockquote><p>{}</p></blockquote>", say(4), say(20))
    put("<p>{}</p>", say(40) + ".")
    top = f"<header class='site-head' role=banner><a href=/>{say(2)}</a></header><nav aria-label=main>{''.join(anchor() for _ in range(r.randint(3, 9)))}</nav>"
    end = f"<footer><p>{say(9)}</p><ul>{''.join(f'<li>{anchor()}</li>' for _ in range(4))}</ul></footer>"
    side = f"<aside class='widget-area'><h4>{say(2)}</h4><ul>{''.join(f'<li>{anchor()}</li>' for _ in range(5))}</ul></aside>"
    said = f"<section id=respond class='comments-area'><h3>{say(3)}</h3>" + "".join(f"<article class='comment'><p>{say(r.randint(8, 30))}</p></article>" for _ in range(r.randint(1, 4))) + "</section>"
    frame = r.choice(("<div class=site>{}{}{}{}{}</div>", "<div id=page><div class=cols>{}{}{}{}</div>{}</div>", "{}{}{}{}{}"))
    story = r.choice(("<article class='post-{} hentry'>", "<main><article>", "<div class='entry-content'>")).replace("{}", str(seed))
    tail = "</article></main>" if story.startswith("<main") else "</div>" if story.startswith("<div") else "</article>"
    body = frame.format(top, story + "".join(out) + tail, r.choice(("", said)), r.choice(("", side)), end)
    return f"<!doctype html><html><head><title>{say(4)}</title></head><body class='home wp'>{body}</body></html>", lines


def test_pages_by_other_rules():
    kept = lost = extra = 0
    for seed in range(120):
        page, lines = page_by_other_rules(seed)
        found = html_text.main_text(page, html_text.trained()).split("\n")
        kept += sum(x in set(found) for x in lines)
        lost += sum(x not in set(found) for x in lines)
        extra += sum(x not in set(lines) for x in found)
    assert lost <= 0.005 * kept and extra <= 0.02 * kept, (kept, lost, extra)


# tables without rows


def test_empty_tables_give_empty_results(spark):
    none = docs(spark, [])
    assert secrets.secret_report(secrets.scan_secrets(none)).collect() == []
    assert decontaminate.find_contaminated(none, spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).collect() == []
    assert decontaminate.find_contaminated(docs(spark, [(1, "a b c")]), spark.createDataFrame([], "item_id long, text string")).collect() == []
    assert sharding.assign_shards(none, sharding.even_tree(4), sharding.even_tree(5)).collect() == []
    assert bpe.round_trip_documents(none, RANKS, PATTERN).collect() == []
    assert corpus_pipeline.tokens(spark, none, "").collect() == []


# 10 repeats


def brute_repeats(rows):
    """{row position: (removed flags)}"""
    rows = [((1 << 63) - 1 if i is None else i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, raw in rows:
        for p in range(len(raw) - 49):
            w = raw[p : p + 50]
            least[w] = min(i, least.get(w, i))
    out = []
    for i, raw in rows:
        covered = bytearray(len(raw))
        for p in range(len(raw) - 49):
            if least[raw[p : p + 50]] < i:
                covered[p : p + 50] = b"\x01" * 50
        out.append(covered)
    return out


def repeating_rows(seed):
    r = random.Random(seed)
    passages = [prose(500 + k, 14, 40) for k in range(6)] + ["ab" * 60, "a" * 130, "é" * 60]
    rows = [(i, t) for i, t in EDGES if len(t or "") < 5000]
    for i in range(70):
        parts = [prose(r.randrange(10**6), r.randrange(1, 12), 40) for _ in range(r.randrange(1, 4))]
        parts += r.sample(passages, r.randrange(0, 4))
        r.shuffle(parts)
        rows.append((r.randrange(10, 70), r.choice((" ", "")).join(parts)))
    return rows + [(200 + i, rows[10 + i][1]) for i in range(4)] + [(300, rows[12][1][3:]), (301, rows[12][1][:-7])]


@pytest.mark.parametrize(("seed", "crowded"), [(0, 1 << 14), (1, 1 << 14), (2, 3), (3, 1)])
def test_repeats_match_brute_force(spark, seed, crowded):
    rows = repeating_rows(seed)
    got = repeats.remove_repeats(docs(spark, rows), block_bytes=2000, crowded=crowded).collect()
    want = []
    for (i, t), flags in zip(rows, brute_repeats(rows), strict=True):
        raw = (t or "").encode()
        kept = bytes(b for b, f in zip(raw, flags, strict=True) if not f)
        want.append((str(i), len(raw), sum(flags), len(re.findall(b"\x01+", bytes(flags))), kept))
    assert sorted((str(x["doc_id"]), x["n_bytes"], x["n_removed"], x["n_spans"], bytes(x["kept"])) for x in got) == sorted(want)
    assert repeats.remove_repeats(docs(spark, [])).collect() == []


def test_questions_do_not_depend_on_the_order_of_rows():
    rows = [(i, (t or "").encode()) for i, t in repeating_rows(7)] * 9 + [(i, prose(i, 20_000, 10**6).encode()) for i in range(12)]
    asked = []
    for seed in range(4):
        random.Random(seed).shuffle(rows)
        block = repeats.Block(repeats.pa.table({"doc_id": [i for i, _ in rows], "raw": [t for _, t in rows]}), 3)
        anchors = repeats.ask_anchors(0, block)
        answers = [(b, *repeats.answer_anchors(b, [0], [a], 2)[0][3:]) for b, _, a in anchors]
        asked.append((anchors, repeats.ask_bodies(0, block, block.pieces(answers))))
    assert all(a == asked[0] for a in asked)


def test_short_phrase_in_many_surroundings(spark):
    """One anchor in every document, always with other neighbours, and some passages around it that do repeat."""
    phrase = " the very same phrase in all of them "
    rows = [(i, prose(i, 6, 10**6) + phrase + prose(1000 + i % 50, 6, 10**6)) for i in range(120)]
    got = {r["doc_id"]: bytes(r["kept"]) for r in repeats.remove_repeats(docs(spark, rows), block_bytes=4000, crowded=8).collect()}
    for (i, t), flags in zip(rows, brute_repeats(rows), strict=True):
        assert got[i] == bytes(b for b, f in zip(t.encode(), flags, strict=True) if not f)


def test_long_text_with_repeats(spark):
    """Texts longer than a chunk, whose repeats lie across its edge."""
    body = " ".join(prose(k, 40, 10**6) for k in range(1500))
    rows = [(2, body), (1, body[1000:9000]), (3, "x" + body[300:]), (4, prose(99_999, 40, 10**6))]
    got = {r["doc_id"]: r for r in repeats.remove_repeats(docs(spark, rows)).collect()}
    assert [got[i]["n_removed"] for i in (1, 2, 3, 4)] == [0, 8000, len(body) - 300, 0] and bytes(got[3]["kept"]) == b"x"


def test_repeat_groups_have_all_occurrences(spark):
    rows = [(k, (t or "").encode()) for k, (_, t) in enumerate(repeating_rows(5)) if len(t or "") < 5000]
    texts = dict(rows)
    groups = {}
    for r in repeats.repeat_groups(docs(spark, [(i, t.decode()) for i, t in rows]), block_bytes=2000).collect():
        text = texts[r["doc_id"]][r["start"] : r["end"]]
        assert hashlib.md5(text).digest() == bytes(r["repeat"]) and len(text) >= 50
        groups.setdefault(text, set()).add((r["doc_id"], r["start"]))
    covered = {i: bytearray(len(t)) for i, t in rows}
    for text, found in groups.items():
        assert found == {(i, m.start()) for i, t in rows for m in re.finditer(b"(?=" + re.escape(text) + b")", t)}
        least = min(i for i, _ in found)
        assert len({i for i, _ in found}) > 1
        for i, at in found:
            if i > least:
                covered[i][at : at + len(text)] = b"\x01" * len(text)
    assert [covered[i] for i, _ in rows] == brute_repeats([(i, t.decode()) for i, t in rows])
    assert repeats.repeat_groups(docs(spark, [])).collect() == []


def test_suffix_array_and_intervals():
    bodies = [b"xx" + b"common part" + b"1", b"yy" + b"common part" + b"2", b"common pa"]
    of, start, end, low = repeats.shared_parts(bodies, np.array([5, 3, 9]), length=5)
    got = {(o, bodies[o][s:e], w) for o, s, e, w in zip(of.tolist(), start.tolist(), end.tolist(), low.tolist(), strict=True)}
    assert (0, b"common part", 3) in got and (2, b"common pa", 3) in got and not any(o == 1 for o, *_ in got)
    text = np.frombuffer(b"banana$bandana", np.uint8)
    where = np.arange(len(text))
    order = repeats.suffix_order(text, where, len(text) - where)
    assert [bytes(text[i:]) for i in order] == sorted(bytes(text[i:]) for i in range(len(text)))


def test_what_blocks_exchange_is_smaller_than_their_texts():
    rows = [(i, prose(i, 300, 4000).encode()) for i in range(200)] + [(None, None), (900, b"")]
    size = sum(len(t or b"") for _, t in rows)
    table = repeats.pa.table({"block": [k % 3 for k in range(len(rows))], "doc_id": [i for i, _ in rows], "raw": repeats.pa.array([t for _, t in rows], repeats.pa.binary())})
    sent = repeats.pa.Table.from_batches(repeats.pack_texts(iter(table.to_batches(max_chunksize=50))))
    assert sum(len(x) for x in sent.column("texts").to_pylist()) < size / 2
    got = repeats.unpack_texts(sent).to_pylist()
    assert sorted(map(repr, got)) == sorted(repr({"doc_id": i, "raw": t}) for i, t in rows)
    block = repeats.Block(repeats.pa.table({"doc_id": [i for i, t in rows if t], "raw": [t for _, t in rows if t]}), 5)
    asked = repeats.ask_anchors(0, block)
    assert sum(len(a) for *_, a in asked) < 5 * len(block.anchors)  # 7 bytes a key before
