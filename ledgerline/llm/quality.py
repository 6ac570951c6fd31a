"""Operator 5: quality rules by distribution divergence.

Each document's histograms of character classes and of its language's common words are
compared with the language's reference by Jensen-Shannon distance. References are summed
over every document of the language. Short documents have noisy histograms, so each
comparison has a guard on the document's length. Small languages have noisy references:
to every reference of classes some characters of all languages together are added, which
say much where the language says little (only how many are letters, not which), and the
limit of the words' distance is wider the fewer words the language has. Languages of less
than one in min_share documents have one reference together, so there are no more than
min_share + 1 references, whatever stands in the column. The rules are the same at every
size.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bytes_of, map_batches, saved

#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
#: Character classes, by byte: 0 lower, 1 upper, 2 digit, 3 space, 4 symbol, 5 other
#: punctuation and controls, 6 first byte of a non-ASCII character, 7 its other bytes.
N_CLASSES = 7
#: The language of all rare ones, and the class that counts documents among partial sums.
RARE, DOCUMENTS = "\x01rare", -1
LETTERS = [0, 1, 6]


def _classes() -> np.ndarray:
    of = np.full(256, 5, np.uint8)
    of[ord("a") : ord("z") + 1] = 0
    of[ord("A") : ord("Z") + 1] = 1
    of[ord("0") : ord("9") + 1] = 2
    of[[9, 10, 11, 12, 13, 32]] = 3
    of[list(SYMBOLS)] = 4
    of[0xC0:] = 6
    of[0x80:0xC0] = 7
    return of


CLASS_OF = _classes()


@dataclass(frozen=True)
class Rules:
    """Limits of the verdict."""

    common_words: int = 48
    min_class_chars: int = 200
    max_class_distance: float = 0.33
    min_word_count: int = 40
    max_word_distance: float = 0.36
    #: added to max_word_distance, divided by the root of the number of words, and again
    #: by the root of the number of words of the language
    word_noise: float = 0.9
    #: characters of all languages that are added to each reference
    pooled_chars: int = 30_000
    #: languages of fewer documents than one in so many are one language
    min_share: int = 1024


def class_counts(raw: bytes) -> np.ndarray:
    return np.bincount(CLASS_OF[np.frombuffer(raw, np.uint8)], minlength=8)[:N_CLASSES]


def repeated_words(words: list[bytes], window: int = 8) -> int:
    """Words inside windows of 8 words that occur twice or more, first ones included."""
    n = len(words)
    if n <= window:
        return 0
    if n <= 4096:
        windows = list(zip(*(words[i:] for i in range(window)), strict=False))
        if len(set(windows)) == len(windows):
            return 0
        seen = Counter(windows)
        twice = np.fromiter((seen[w] > 1 for w in windows), bool, len(windows))
    else:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
        width = 1
        while width < window:  # equal numbers stand for equal runs of 2, 4, then 8 words
            both = ids[:-width] * (int(ids.max()) + 1) + ids[width:]
            ids = np.unique(both, return_inverse=True)[1]
            width *= 2
        twice = np.bincount(ids)[ids] > 1
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int(np.count_nonzero(np.cumsum(edge)[:n]))


def base_measures(raw: bytes) -> tuple[list[bytes], int, int, int, int]:
    """words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a UTF-8 text.
    bytes.split() parts at exactly the space and the bytes 9 to 13."""
    words = raw.split()
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode("utf-8", "surrogatepass"))
    symbols = sum(raw.count(c) for c in SYMBOLS)
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return words, chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Square root of the Jensen-Shannon divergence in bits of two count vectors."""
    sp, sq = p.sum(), q.sum()
    if not sp or not sq:
        return 0.0
    p, q = p / sp, q / sq
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(q > 0, q * np.log2(q / m), 0).sum()
    return float(np.sqrt(max(d / 2, 0.0)))


def with_pooled(own: np.ndarray, pooled: np.ndarray, n: int) -> np.ndarray:
    """Class counts with n characters more, of all languages' shares; among letters, of
    the language's own."""
    if not pooled.sum():
        return own
    share = pooled / pooled.sum()
    if own[LETTERS].sum():
        share[LETTERS] = share[LETTERS].sum() * own[LETTERS] / own[LETTERS].sum()
    return own + n * share


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums of a task: (lang, word or null, class, n)."""
    words: dict[str, Counter] = defaultdict(Counter)
    classes: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(N_CLASSES, np.int64))
    documents: Counter = Counter()

    def flush() -> pa.RecordBatch:
        rows = [(g, w, None, n) for g, c in words.items() for w, n in c.items()]
        rows += [(g, None, k, int(n)) for g, c in classes.items() for k, n in enumerate(c)]
        rows += [(g, None, DOCUMENTS, n) for g, n in documents.items()]
        words.clear()
        classes.clear()
        documents.clear()
        g, w, k, n = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(g, pa.string()), pa.array(w, pa.binary()), pa.array(k, pa.int32()), pa.array(n, pa.int64())],
            names=["lang", "word", "class", "n"],
        )

    for batch in batches:
        for lang, raw in zip(batch.column(1).to_pylist(), bytes_of(batch.column(0)), strict=True):
            words[lang or ""].update(raw.lower().split())
            classes[lang or ""] += class_counts(raw)
            documents[lang or ""] += 1
        if sum(map(len, words.values())) + len(classes) > 200_000:
            yield flush()
    yield flush()


def references(docs: DataFrame, rules: Rules) -> dict[str, tuple[np.ndarray, list[bytes], np.ndarray]]:
    """By language: summed class counts, its common words, and their counts with the
    rest of the words last; RARE is the language of all rare ones. Sums over all documents;
    what comes to the driver has (min_share + 1) x (common_words + classes) rows at most."""
    langs = docs.select(
        F.coalesce(F.col("text"), F.lit("")).alias("text"), F.coalesce(F.col("lang"), F.lit("")).alias("lang")
    )
    sums = (
        langs.mapInArrow(_counts, "lang string, word binary, class int, n long")
        .groupBy("lang", "word", "class")
        .agg(F.sum("n").alias("n"))
    )
    # one pass over the sums: the most common words by rank, the rest in one total
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "word"))
    sums = saved(sums, "word-sums")
    each = sums.where(F.col("class") == DOCUMENTS).groupBy("lang").agg(F.sum("n").alias("docs"))
    rare = each.crossJoin(F.broadcast(each.agg(F.sum("docs").alias("all"))))  # one row
    rare = saved(rare.where(F.col("docs") * rules.min_share < F.col("all")).select("lang", F.lit(RARE).alias("to")), "rare-languages")
    if not rare.isEmpty():
        named = sums.join(rare, "lang", "left").select(F.coalesce("to", "lang").alias("lang"), "word", "class", "n")
        sums = saved(named.groupBy("lang", "word", "class").agg(F.sum("n").alias("n")), "pooled-sums")
    sums = sums.where(F.col("class").isNull() | (F.col("class") != DOCUMENTS))
    top = (
        sums.where("word is not null").withColumn("r", rank).where(F.col("r") <= rules.common_words).drop("r")
    )
    total = sums.where("word is not null").groupBy("lang").agg(F.sum("n").alias("n"))
    out: dict[str, tuple] = {}
    totals = {r["lang"]: r["n"] for r in total.collect()}
    classes: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(N_CLASSES))
    for r in sums.where("word is null").groupBy("lang", "class").agg(F.sum("n").alias("n")).collect():
        classes[r["lang"]][r["class"]] = r["n"]
    common: dict[str, list] = defaultdict(list)
    for r in top.collect():
        common[r["lang"]].append((-r["n"], bytes(r["word"])))
    pooled = sum(classes.values(), np.zeros(N_CLASSES))
    for lang, c in classes.items():
        c = with_pooled(c, pooled, rules.pooled_chars)
        pairs = sorted(common[lang])
        counts = [-n for n, _ in pairs]
        out[lang] = (c, [w for _, w in pairs], np.array([*counts, totals.get(lang, 0) - sum(counts)], float))
    return out


MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, class_distance double, word_distance double"
)


def judge(texts: list[bytes], langs: list[str | None], refs: dict, rules: Rules) -> dict[str, list]:
    out: dict[str, list] = {x.split()[0]: [] for x in MEASURES.split(", ")}
    for raw, lang in zip(texts, langs, strict=True):
        words, chars, symbols, dup_lines, repeat = base_measures(raw)
        n = len(words)
        failed = n < 20 or 100 * repeat > 30 * n
        class_ref, common, word_ref = refs.get(lang or "") or refs.get(RARE) or (np.zeros(N_CLASSES), [], np.zeros(1))
        class_d = word_d = None
        counts = class_counts(raw)
        if counts.sum() >= rules.min_class_chars:
            class_d = js_distance(counts, class_ref)
        verdict = class_d is None or class_d <= rules.max_class_distance
        if n >= rules.min_word_count:
            seen = Counter(raw.lower().split())
            own = [seen[w] for w in common]
            word_d = js_distance(np.array([*own, n - sum(own)], float), word_ref)
            noise = rules.word_noise / n**0.5 + rules.word_noise / max(word_ref.sum(), 1) ** 0.5
            verdict = verdict and word_d <= rules.max_word_distance + noise
        for name, value in zip(
            out, (n, chars, symbols, dup_lines, repeat, failed, verdict and not failed, class_d, word_d), strict=True
        ):
            out[name].append(value)
    return out


def quality(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    rules: Rules = Rules(),
) -> DataFrame:
    """One row per input row: doc_id, the measures, base_failed, kept and the distances.

    Null texts are empty (no words, so base_failed). A null language is a language of
    its own, as the empty one. A distance is null where its guard holds; then it rejects nothing. Null ids
    and repeated rows are kept as they are; an empty table gives an empty result; other
    columns of the input are ignored.
    """
    own = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.col(f"`{text_col}`").cast("string").alias("text"),
        F.col(f"`{lang_col}`").cast("string").alias("lang"),
    )
    refs = references(own, rules)

    def judged(batch: pa.RecordBatch) -> dict:
        out = judge(bytes_of(batch.column("text")), batch.column("lang").to_pylist(), refs, rules)
        return {"doc_id": batch.column("doc_id"), **out}

    return map_batches(own, judged, f"doc_id long, {MEASURES}")
