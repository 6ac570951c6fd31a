"""Operator 11: spelling variants by a positional q-gram index with a count filter.

A word of n q-grams keeps at least max(n) - q of them when one code point is inserted,
deleted or replaced, each at its position or one further. Such pairs share one of the
q + 1 rarest grams of either (by one order of all grams), so every word is posted under
those, by gram, position and length, and looks itself up under the same grams at the
positions and lengths that one edit allows. Where words meet, a task holds an inverted
index of one posting list's words by all their positional grams, and heap-merges the lists
of a word's grams: the shorter lists name candidates, the longer ones are only searched
for them, and a candidate with fewer shared grams than the bound falls. What is left is
verified. A posting list of more than LIST_LIMIT words is cut into pieces, each of which
every word that looks it up goes to, so a task's index is bounded.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, keyed, saved, to_batch

Q = 3
MIN_LENGTH, MIN_COUNT = 7, 2
#: How many times as often a word's form must occur.
DOMINANCE = 10
#: Words that the index of one task's posting list holds.
LIST_LIMIT = 4096
#: Words of a posting list that are compared as they are.
FEW = 32
LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word and n: the runs of letters of all texts (null: none), A-Z in lower case, some
    with one letter deleted: those where 31 divides crc32 of `<doc_id>:<run>` (a null id is
    empty there) lose their code point crc32 % length. Words have min_length code points
    and min_count occurrences. Only runs that long are looked at, since none grows."""
    runs = F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{min_length},}}"), F.lit(0)))
    rows = keyed(docs, id_col, text_col).where("text IS NOT NULL").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), runs.alias("run"))
    rows = rows.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    rows = rows.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2, F.char_length("run")))
    words = rows.select(F.when(F.col("h") % 31 == 0, cut).otherwise(F.col("run")).alias("word"))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where((F.col("n") >= min_count) & (F.char_length("word") >= min_length))


def grams(word: str, q: int = Q) -> list[str]:
    return [word[i : i + q] for i in range(len(word) - q + 1)]


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one code point of a is replaced (equal lengths), or one inserted in
    a, which gives b."""
    more, half = len(b) - len(a), len(a) >> 1
    if a[:half] == b[:half]:  # the edit lies behind
        k = half
    elif a[half:] == b[half + more :]:
        k = 0
    else:
        return False
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k:] == b[k + 1 :] if more else k < len(a) and a[k + 1 :] == b[k + 1 :]


class PostingIndex:
    """The words of one posting list, all of one length, by their positional grams. A list
    of at most FEW words is merged as it is: all of it are candidates."""

    def __init__(self, length: int, q: int = Q):
        self.q, self.bound = q, length - q + 1 - q
        self.words: list[tuple[str, int]] = []
        self.lists: dict[tuple[str, int], list[int]] = defaultdict(list)

    def add(self, word: str, n: int) -> None:
        self.words.append((word, n))
        if len(self.words) > FEW:
            first = len(self.words) - 1 if self.lists else 0
            for number in range(first, len(self.words)):
                for key in zip(grams(self.words[number][0], self.q), count(), strict=False):
                    self.lists[key].append(number)

    def near(self, word: str, shifts: tuple[int, ...]) -> Iterator[tuple[str, int]]:
        """The words one edit from a word of their length (shifts: how much further than
        in it its grams may lie; 0) or one less (0 and 1)."""
        if not self.lists:
            head, tail = word[: len(word) >> 1], word[len(word) >> 1 :]  # one edit leaves one of them
            for found in self.words:
                if (found[0].startswith(head) or found[0].endswith(tail)) and one_edit(word, found[0]):
                    yield found
            return
        q, words, lists = self.q, self.words, []
        for at in range(len(word) - q + 1):
            gram = word[at : at + q]
            for s in shifts:
                if x := self.lists.get((gram, at + s)):
                    lists.append((len(x), at + s, gram, x))
        spare = len(lists) - self.bound
        if spare < 0:
            return
        lists.sort()  # by length; no two agree in position and gram
        long = [(at, at + q, gram) for _, at, gram, _ in lists[spare + 1 :]]
        merged = heapq.merge(*[x for *_, x in lists[: spare + 1]]) if spare else iter(lists[0][3])
        number = next(merged)
        while number is not None:
            shared, following = 1, next(merged, None)
            while following == number:
                shared, following = shared + 1, next(merged, None)
            found, missing = words[number], len(long) + shared - self.bound
            for a, z, gram in long:  # a word is in a list if it has the gram there
                if found[0][a:z] != gram:
                    missing -= 1
                    if missing < 0:
                        break
            if missing >= 0 and one_edit(word, found[0]):
                yield found
            number = following


PAIRS = "a string, n_a long, b string, n_b long"


def _meet(rows: DataFrame, q: int) -> DataFrame:
    """Pairs one edit apart of rows (gram, pos, length, piece, asks, word, n): of listed
    words with each other, and of those that ask with the listed. Rows stream through
    sorted partitions; the words of one piece of one posting list are held."""
    arrow = arrow_schema(rows.sparkSession, PAIRS)
    keys = ["gram", "pos", "length", "piece"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, index = None, PostingIndex(0, q)
        for batch in batches:
            out: list[list] = [[], [], [], []]
            grams, words, counts = (batch.column(k).to_pylist() for k in (0, 5, 6))
            parts = [batch.column(0).dictionary_encode().indices.to_numpy(), *(batch.column(k).to_numpy() for k in (1, 2, 3)), batch.column(4).to_numpy(zero_copy_only=False)]
            changes = np.zeros(batch.num_rows, bool)
            changes[:1] = True
            for x in parts:
                changes[1:] |= x[1:] != x[:-1]
            starts = np.flatnonzero(changes)
            places, asking = [x[starts].tolist() for x in parts[1:4]], parts[4][starts].tolist()
            for a, z, pos, length, piece, asks in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows], *places, asking, strict=True):
                own = (grams[a], pos, length, piece)
                if own != key:
                    key, index = own, PostingIndex(length, q)
                if asks and not index.words:
                    continue
                for k in range(a, z):
                    x, n_x = words[k], counts[k]
                    for y, n_y in index.near(x, (0, 1) if len(x) < length else (0,)):
                        pair = (x, n_x, y, n_y) if (len(x), x) < (len(y), y) else (y, n_y, x, n_x)
                        for column, value in zip(out, pair, strict=True):
                            column.append(value)
                    if not asks:
                        index.add(x, n_x)
            if out[0]:
                yield to_batch(dict(zip(arrow.names, out, strict=True)), arrow)

    return rows.repartition(*keys).sortWithinPartitions(*keys, "asks").select(*keys, "asks", "word", "n").mapInArrow(run, PAIRS)


def near_words(vocabulary: DataFrame, q: int = Q, limit: int = LIST_LIMIT) -> DataFrame:
    """Pairs (a, n_a, b, n_b) of the words of a vocabulary (word, n; words of 2 q code
    points or more, without repeats) that are exactly one edit apart, each once."""
    last = F.char_length("word") - q
    posted = vocabulary.select(
        "word", "n", F.char_length("word").alias("length"), F.posexplode(F.transform(F.sequence(F.lit(0), last), lambda i: F.substring("word", i + 1, q))).alias("pos", "gram")
    )
    # at most one row per q letters: 90 ** 3 = 729,000 for the runs of this module
    common = F.broadcast(posted.groupBy("gram").agg(F.count(F.lit(1)).alias("spread")))
    rarest = (
        posted.join(common, "gram")
        .groupBy("word", "n", "length")
        .agg(F.slice(F.sort_array(F.collect_list(F.struct("spread", "gram", "pos"))), 1, q + 1).alias("keys"))
        .select("word", "n", "length", F.posexplode("keys").alias("rank", "k"))
        .select("word", "n", "length", "rank", "k.gram", "k.pos")
    )
    rarest = saved(rarest, "postings")
    # a longer word has its gram at the same position or the next, and misses no more than
    # q - 1 of the shorter one's, so that asks for its q rarest only
    moves = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(n).alias("l")) for p, n in ((0, 1), (1, 1))])
    asking = rarest.where(F.col("rank") < q).withColumn("m", F.explode(moves)).select(
        "gram", (F.col("pos") + F.col("m.p")).alias("pos"), (F.col("length") + F.col("m.l")).alias("length"), "word", "n", F.lit(True).alias("asks")
    )
    rarest = rarest.drop("rank")
    listed = rarest.withColumn("asks", F.lit(False))
    keys = ["gram", "pos", "length"]
    crowded = saved(rarest.groupBy(keys).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > limit), "crowded")
    if crowded.isEmpty():
        rows = listed.unionByName(asking).withColumn("piece", F.lit(0))
    else:  # words of one list in different pieces ask for each other
        across = rarest.join(crowded.select(keys), keys).withColumn("asks", F.lit(True))
        n_pieces = F.coalesce(F.ceil(F.col("size") / limit).cast("int"), F.lit(1))
        own, every = F.pmod(F.xxhash64("word"), n_pieces).cast("int"), F.explode(F.sequence(F.lit(0), n_pieces - 1))
        rows = listed.join(crowded, keys, "left").withColumn("piece", own).unionByName(
            asking.unionByName(across).join(crowded, keys, "left").withColumn("piece", every)
        )
    return _meet(rows.select(*keys, "piece", "asks", "word", "n"), q).distinct()


def variant_forms(vocabulary: DataFrame, dominance: int = DOMINANCE, q: int = Q, limit: int = LIST_LIMIT) -> DataFrame:
    """word, form, root, n, n_near and form_n per word of the vocabulary (word, n). The form
    is the near word of largest n (ties: the smallest), if that is dominance times the
    word's at least (dominance over 1); else null. The root is where the forms lead, the
    word itself without."""
    if dominance <= 1:
        raise ValueError("dominance must be over 1, else forms could go round in a circle")
    vocabulary = saved(vocabulary, "vocabulary")
    pairs = saved(near_words(vocabulary, q, limit), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("other_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("other_n"))
    )
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    chosen = F.col("best").isNotNull() & (-F.col("best.less") >= dominance * F.col("n"))
    rows = saved(
        vocabulary.join(best, "word", "left").select(
            "word",
            F.when(chosen, F.col("best.other")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(chosen, -F.col("best.less")).alias("form_n"),
        ),
        "forms",
    )
    # every step multiplies n by dominance, so paths are short; each round doubles them
    roots = rows.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        roots = saved(roots, "roots")
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = saved(roots.join(further, "root", "left"), "further")
        if longer.where("next IS NOT NULL").isEmpty():
            break
        roots = longer.select("word", F.coalesce("next", "root").alias("root"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """variant_forms of the words of all documents; see word_counts. Null texts have no
    words, repeated rows count again, an empty table gives no row, other columns don't
    matter."""
    return variant_forms(word_counts(docs, id_col, text_col))
