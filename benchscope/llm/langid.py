"""Operator 7: language identification with bit-sliced Bloom filters of n-grams.

Learning counts letter n-grams (three and four characters, word bounds included) per
language over all learning rows.  A language's filter holds the n-grams whose share in
that language is at least ``floor`` and at least ``part`` of their largest share in any
language; there are at most ``2 / floor`` of them, whatever the size of the corpus.  All
filters share their hash functions and lie side by side: row i of the table holds, one
bit a language, whether bit i of that language's filter is set.  The AND of the rows an
n-gram hashes to is the mask of all languages that contain it.

A text's n-grams are looked up, the bits of the masks are counted per language, counts
are corrected for each filter's false-positive rate, and the largest corrected count
decides; ties go to the first language by name.  The score is the winner's share of all
corrected counts.

A null text, or one without a letter, is ``und`` with score 0.  A text whose n-grams no
filter knows gets the language most frequent in learning, with score 0.  Repeated rows
count as often as they come; without learning rows every text is ``und``; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benchscope.llm.common import arrow_map, chunks, crc_fold, stored
from benchscope.llm.wordcache import LETTER, char_classes, code_points

UNKNOWN = "und"


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and text number of every n-gram, and whether each text has a letter."""
    _, cp, bounds = code_points([t.lower() + " " for t in texts])
    letter = char_classes()[np.minimum(cp, 0x10FFFF)] == LETTER
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    has = np.bincount(owner[letter], minlength=len(texts)) > 0
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one bound after each word
    c, owner = np.where(letter, cp, 0)[keep].astype(np.uint64), owner[keep]
    c, owner = np.concatenate([np.zeros(1, np.uint64), c]), np.concatenate([owner[:1], owner])
    hashes, owners = [], []
    for n in (3, 4):
        if len(c) < n:
            continue
        m = len(c) - n + 1
        with np.errstate(over="ignore"):
            h = np.full(m, n, np.uint64)
            for k in range(n):
                h = h * np.uint64(0x9E3779B97F4A7C15) + c[k : k + m] + np.uint64(1)
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
        inner = np.ones(m, bool)
        for k in range(1, n - 1):  # bounds only at the ends
            inner &= c[k : k + m] > 0
        hashes.append(h[inner])
        owners.append(owner[1 : 1 + m][inner])
    return np.concatenate([np.zeros(0, np.uint64), *hashes]), np.concatenate([np.zeros(0, np.int64), *owners]), has


@dataclass
class BitSliced:
    """The filters of all languages as rows of bit masks."""

    languages: list[str]
    rows: np.ndarray  # (bits, planes) of uint64; 64 languages a plane
    hashes: int
    common: str

    @classmethod
    def build(cls, grams: dict[str, np.ndarray], common: str, hashes: int = 4, room: int = 12) -> BitSliced:
        languages = sorted(grams)
        most = max([1, *(len(g) for g in grams.values())])
        rows = np.zeros((1 << int(np.ceil(np.log2(max(64, most * room)))), -(-len(languages) // 64) or 1), np.uint64)
        out = cls(languages, rows, hashes, common)
        for i, name in enumerate(languages):
            for at in out.places(grams[name]):
                rows[at, i // 64] |= np.uint64(1 << (i % 64))
        return out

    def places(self, grams: np.ndarray) -> list[np.ndarray]:
        """The rows that each n-gram hashes to, one array a hash function."""
        size = np.uint64(len(self.rows) - 1)
        with np.errstate(over="ignore"):
            step = (grams >> np.uint64(33)) | np.uint64(1)
            return [((grams + np.uint64(k) * step) & size).astype(np.int64) for k in range(self.hashes)]

    def false_rate(self) -> np.ndarray:
        """Chance that a filter claims an n-gram it does not hold, by language."""
        fill = [float((self.rows[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)).mean()) for i in range(len(self.languages))]
        return np.array(fill) ** self.hashes

    def masks(self, grams: np.ndarray) -> np.ndarray:
        first, *rest = self.places(grams)
        mask = self.rows[first]
        for at in rest:
            mask = mask & self.rows[at]
        return mask

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        grams, owner, has = ngrams([t or "" for t in texts])
        masks = self.masks(grams)
        total = np.bincount(owner, minlength=len(texts))
        rate = self.false_rate()
        found = np.empty((len(texts), len(self.languages)))
        for i in range(len(self.languages)):
            hit = (masks[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)).astype(bool)
            count = np.bincount(owner[hit], minlength=len(texts))
            found[:, i] = np.maximum(0, (count - total * rate[i]) / max(1e-9, 1 - rate[i]))
        best, every = found.argmax(axis=1), found.sum(axis=1)
        score = np.where(every > 0, found.max(axis=1) / np.maximum(every, 1e-9), 0.0)
        names = [self.languages[b] if e > 0 else self.common for b, e in zip(best.tolist(), every.tolist(), strict=True)]
        return [n if ok else UNKNOWN for n, ok in zip(names, has.tolist(), strict=True)], np.where(has, score, 0.0)


def learn(rows: DataFrame, floor: float = 2e-5, part: float = 0.1) -> BitSliced:
    """Filters from (text, lang) rows; rows without text or language teach nothing."""

    def make():
        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            langs, texts = b.column("_l").to_pylist(), b.column("_t").to_pylist()
            names = sorted(set(langs))
            which = {n: i for i, n in enumerate(names)}
            seen: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for a, z in chunks(texts):
                grams, owner, _ = ngrams(texts[a:z])
                of = np.array([which[x] for x in langs[a:z]])[owner]
                for i in np.unique(of):
                    g, n = np.unique(grams[of == i], return_counts=True)
                    seen.append((np.full(len(g), i), g, n))
            cols = [np.concatenate(x) for x in zip(*seen, strict=True)] if seen else [np.zeros(0, int)] * 3
            return pa.RecordBatch.from_arrays([pa.array([names[i] for i in cols[0].tolist()], pa.string()), pa.array(cols[1].astype(np.uint64).view(np.int64)), pa.array(cols[2].astype(np.int64))], ["lang", "gram", "n"])

        return f

    base = rows.where("text is not null and lang is not null").select(F.col("lang").cast("string").alias("_l"), F.col("text").cast("string").alias("_t"))
    counts = arrow_map(base, make, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = stored(counts, "ngrams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    shares = counts.join(F.broadcast(totals), "lang").withColumn("p", F.col("n") / F.col("total")).where(F.col("p") >= floor)
    top = shares.groupBy("gram").agg(F.max("p").alias("most"))
    kept = shares.join(top, "gram").where(F.col("p") >= part * F.col("most")).select("lang", "gram")
    grams: dict[str, list[int]] = {r["lang"]: [] for r in totals.collect()}
    for r in kept.toLocalIterator():
        grams[r["lang"]].append(r["gram"])
    common = rows.where("text is not null and lang is not null").groupBy("lang").count().orderBy(F.desc("count"), "lang").first()
    return BitSliced.build({k: np.array(sorted(v), np.int64).view(np.uint64) for k, v in grams.items()}, common["lang"] if common else UNKNOWN)


def predict(docs: DataFrame, filters: BitSliced) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(filters)

    def make():
        own = sent.value

        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            texts, names, scores = b.column("_t").to_pylist(), [], []
            for a, z in chunks([t or "" for t in texts]):
                n, s = own.predict(texts[a:z])
                names += n
                scores.append(s)
            return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(names, pa.string()), pa.array(np.concatenate(scores))], ["doc_id", "held_out", "lang_pred", "score"])

        return f

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(crc_fold() == 2, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("_t"))
    return arrow_map(base, make, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows that are not held out, predict all: the whole operator."""
    return predict(docs, learn(docs.where(crc_fold() != 2).select("text", "lang")))
