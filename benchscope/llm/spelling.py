"""Operator 11: spelling variants through a bit-sliced position index.

The vocabulary is indexed by position and letter: a bit set over the words for each, bit w
set if word w has that letter there.  A search walks along the letters of a word and keeps,
for all words at once, the set that agrees so far (no error) and three sets with one error:
a letter replaced, a letter of the searched word left out (the index is read one position
back from there on) and a letter added (one position ahead).  A step is a few word-parallel
ANDs and ORs.  At the end the sets with one error, cut to the words of fitting length, are
the near words.

A vocabulary of any size is dealt to many small indexes.  If two words differ by one edit,
then in the middle of the searched word (what lies between its ``a`` first and ``b`` last
letters, at first the whole word) either the first or the last half is free of it.  So a
word goes, for its own length and the lengths next to it, to two keys: the half's letters
at the start and at the end; near words share a key.  A key of more than ``CAP`` words is
cut again in the same way, its middle halved, until it is small or the middle is a single
letter, which the alphabet bounds.  Keys are hashed to buckets of about ``BUCKET`` letters,
and each bucket's words are indexed and searched by length in blocks of ``BLOCK``; words
that meet by chance of the hash are searched too, which costs time but changes nothing.
Nothing is left out, and every word moves about six times however the keys are skewed.

Counts are summed in the tasks before they are shuffled.  Forms are followed by pointer
jumping: a form is at least ``TIMES`` as frequent as its word, so no chain is longer than
19 links, and five jumps end any.

Null and empty texts have no words.  Without an id there is no checksum, and the runs of
that text stay as they are.  Repeated rows count each; long texts and words are taken whole;
ties go to the smaller word in code-point order; further columns play no part; an empty
table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchscope.llm.common import shipped, stored

LEAST, TWICE, TIMES, EVERY = 7, 2, 10, 31
CAP, BUCKET, BLOCK = 2048, 1 << 16, 8192
#: Different words that a task counts before it hands its counts on.
COUNTED = 200_000
JUMPS = 5


# ---------------------------------------------------------------- vocabulary


def words_of(doc_id: int | None, text: str, least: int = LEAST) -> Counter:
    """The words of a text: its runs of letters, one letter less where the checksum says so."""
    runs = Counter(re.findall(f"[a-zÀ-ÿ]{{{least},}}", text.encode().lower().decode()))  # bytes.lower: only A-Z
    if doc_id is None:
        return runs
    out, start = Counter(), zlib.crc32(f"{doc_id}:".encode())
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), start)
        if h % EVERY == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
            if len(run) < least:
                continue
        out[run] += n
    return out


def vocabulary(docs: DataFrame, least: int = LEAST, twice: int = TWICE) -> DataFrame:
    """(word, n): the words of at least ``least`` letters that occur ``twice`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter()

        def out():
            made = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return made

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                if (text := text.as_py()):
                    counts.update(words_of(doc_id, text, least))
                    if len(counts) > COUNTED:
                        yield out()
        yield out()

    shipped(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= twice)


# ---------------------------------------------------------------- keys


def middle() -> Column:
    return F.col("l") - F.col("a") - F.col("b")


def halves() -> Column:
    """The two keys below (l, a, b): the middle's first half is right, or its last half."""
    half = F.floor(middle() / 2).cast("int")
    return F.array(F.struct((F.col("a") + half).alias("a"), F.col("b").alias("b")), F.struct(F.col("a").alias("a"), (F.col("b") + half).alias("b")))


def keyed(rows: DataFrame) -> DataFrame:
    """Rows (word, n, l, a, b) of the next keys, and ``key``, the hash of their letters."""
    names = ["word", "n", "l"]
    down = rows.select(*names, F.explode(halves()).alias("h")).select(*names, "h.a", "h.b")
    ends = F.substr(F.col("word"), F.lit(1), F.col("a")), F.expr("right(word, b)")
    return down.select(*names, "a", "b", F.xxhash64("l", "a", "b", *ends).alias("key"))


def dealt(words: DataFrame, least: int = LEAST, cap: int = CAP) -> DataFrame:
    """(key, word, n, l): every word at the keys where it meets its near words.

    ``l`` is the length of the searched words of the key; the others are one longer or shorter.
    """
    size = F.length("word")
    around = words.withColumn("l", F.explode(F.sequence(F.greatest(size - 1, F.lit(least)), size + 1)))
    rows, done = keyed(around.select("word", "n", "l", F.lit(0).alias("a"), F.lit(0).alias("b"))), None
    while True:
        rows = stored(rows, "keys")
        many = rows.where(middle() > 1).groupBy("key").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > cap)
        many = stored(many.select("key", F.lit(True).alias("many")), "many")
        if many.isEmpty():
            small = rows
        else:
            rows = stored(rows.join(many, "key", "left"), "keys")
            small = rows.where("many is null")
        small = small.select("key", "word", "n", "l")
        done = small if done is None else done.unionByName(small)
        if "many" not in rows.columns:
            return done
        rows = keyed(rows.where("many").select("word", "n", "l", "a", "b"))


# ---------------------------------------------------------------- index


def bits(rows: np.ndarray) -> np.ndarray:
    """Boolean rows packed into 64-bit words."""
    pad = -rows.shape[1] % 64
    return np.packbits(np.pad(rows, ((0, 0), (0, pad))), axis=1, bitorder="little").view("<u8")


def search(asked: list[bytes], words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of ``asked[i]`` and ``words[j]`` that differ by one edit.

    All of ``asked`` have the same length; a letter is a byte.
    """
    size = len(asked[0])
    lengths = np.array([len(w) for w in words])
    width = size + 1
    letters = np.zeros((len(words), width + 1), dtype=np.uint8)
    fit = np.flatnonzero(abs(lengths - size) <= 1)
    if not len(fit):
        return np.zeros(0, dtype=int), np.zeros(0, dtype=int)
    letters = np.frombuffer(b"".join(words[j].ljust(width + 1, b"\0") for j in fit), dtype=np.uint8).reshape(len(fit), width + 1)
    by_position = np.ascontiguousarray(letters.T)
    lengths = lengths[fit]
    of = np.frombuffer(b"".join(asked), dtype=np.uint8).reshape(len(asked), size)

    def index(position: int, kinds: np.ndarray) -> np.ndarray:
        """The bit sets of the letters ``kinds`` at a position."""
        return bits(by_position[position][None, :] == kinds[:, None])

    n_words = -(-len(fit) // 64)
    same = np.full((len(asked), n_words), ~np.uint64(0))
    replaced, left_out, added = (np.zeros_like(same) for _ in range(3))
    for i in range(size):
        kinds, which = np.unique(of[:, i], return_inverse=True)
        here, ahead = index(i, kinds)[which], index(i + 1, kinds)[which]
        added |= same  # a letter of the word passed over; from here on one ahead
        added &= ahead
        if i:
            left_out &= index(i - 1, kinds)[which]
        left_out |= same
        replaced &= here
        replaced |= same & ~here
        same &= here
    added |= same  # or the letter added is the last
    found = replaced & bits((lengths == size)[None, :])
    found |= left_out & bits((lengths == size - 1)[None, :])
    found |= added & bits((lengths == size + 1)[None, :])
    i, j = np.nonzero(np.unpackbits(found.view(np.uint8), axis=1, bitorder="little")[:, : len(fit)])
    return i, fit[j]


def searched(rows: DataFrame) -> DataFrame:
    """(word, near, near_n): the near words found in the buckets, each once a bucket."""

    def run(table: pa.Table) -> pa.Table:
        lengths = np.array(table["l"])
        out = [[], [], []]
        for size in np.unique(lengths):
            at = np.flatnonzero(lengths == size)
            found = dict(zip(table["word"].take(at).to_pylist(), table["n"].take(at).to_pylist()))  # a word may have several keys here
            words = list(found)
            coded = [w.encode("latin-1") for w in words]
            asked = [k for k, w in enumerate(words) if len(w) == size]
            for p in range(0, len(asked), BLOCK // 8):
                mine = asked[p: p + BLOCK // 8]
                for q in range(0, len(words), BLOCK):
                    i, j = search([coded[k] for k in mine], coded[q: q + BLOCK])
                    for x, y in zip(i, j):
                        near = words[q + y]
                        out[0].append(words[mine[x]])
                        out[1].append(near)
                        out[2].append(found[near])
        return pa.table({"word": pa.array(out[0], pa.string()), "near": pa.array(out[1], pa.string()), "near_n": pa.array(out[2], pa.int64())})

    shipped(rows.sparkSession)
    return rows.groupBy("bucket").applyInArrow(run, "word string, near string, near_n long")


def near_words(words: DataFrame, least: int = LEAST, cap: int = CAP, bucket: int = BUCKET) -> DataFrame:
    """(word, near, near_n): every two words of ``words`` (word, n) that differ by one edit."""
    rows = dealt(words, least, cap)
    letters = rows.agg(F.sum(F.length("word"))).first()[0] or 0
    buckets = max(1, -(-letters // bucket))
    placed = rows.select(F.pmod("key", F.lit(buckets)).alias("bucket"), "word", "n", F.col("l").cast("int").alias("l"))
    return searched(placed).groupBy("word", "near").agg(F.first("near_n").alias("near_n"))


# ---------------------------------------------------------------- forms


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words with a ``form``: the last of the chain."""
    step = stored(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(JUMPS):
        ahead = step.select(F.col("word").alias("root"), F.col("root").alias("further"))
        jumped = step.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        jumped = stored(jumped, "roots")
        step = jumped.select("word", "root")
        if jumped.where("moved").isEmpty():
            break
    return step


def variants(docs: DataFrame, least: int = LEAST, twice: int = TWICE, times: int = TIMES, cap: int = CAP, bucket: int = BUCKET) -> DataFrame:
    """Every word of ``docs`` with its count, near words, form and root."""
    words = stored(vocabulary(docs, least, twice), "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    near = near_words(words, least, cap, bucket).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    both = words.join(near, "word", "left")
    form_n = -F.col("best.less")
    takes = form_n >= F.col("n") * times
    both = stored(both.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(takes, F.col("best.near")).alias("form"), F.when(takes, form_n).alias("form_n")), "forms")
    ends = roots(both.where("form is not null"))
    return both.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
