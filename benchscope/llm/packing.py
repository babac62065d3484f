"""Operator 9: best-fit packing with certified bounds and repacking.

``tokenize_pieces`` cuts every tokenised document into pieces of at most ``capacity``
tokens (only longer documents are cut; the first piece takes the remainder).
``pack`` deals the pieces to partitions of bounded size by a hash.  Each partition
packs its pieces best-fit decreasing and certifies its bin count with dual-feasible
functions: weights f(size) that no feasible bin can exceed in sum, so the total is a
lower bound.  The same bound on the counts of all lengths certifies the whole: rounds end
when the bins meet it.  Until then partitions with a gap (more bins than their bound, or
than their tokens would fill, which only an exchange can mend) exchange documents with
their neighbours: two and two are pooled, dealt anew as one and packed again, and the new
packing is kept where it takes fewer bins.  Rounds are a parameter; a partition never grows past ``2 ** rounds``
times its first size, whatever the input's size.

Null and empty texts are documents of the end token alone.  Rows with equal ids or
texts are packed as often as they come; ties fall by length, document and piece; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benchscope.llm.common import arrow_map, chunks, shipped, stored, text_of
from benchscope.llm.wordcache import WordIds

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


@lru_cache(maxsize=2)
def tokenizer_words(path: str) -> WordIds:
    """Ids by the tokenizer file, cached by distinct pre-token; special strings count as text."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [x.ids for x in tok.encode_batch_fast(words, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((i for x in ids for i in x), np.int32, int(sizes.sum())), sizes

    return WordIds(encode)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens; the first holds the remainder."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def tokenize_pieces(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32."""

    def make():
        words = tokenizer_words(path)
        end = np.array([end_id], "<u4")

        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            texts, rows = b.column("_t").to_pylist(), []
            names = b.column("doc_id").to_pylist()
            for a, z in chunks(texts):
                ids, sizes = words.of(texts[a:z])
                at = 0
                for name, n in zip(names[a:z], sizes.tolist(), strict=True):
                    own = np.concatenate([ids[at : at + n].astype("<u4"), end])
                    at += n
                    rows += [(name, k, s, m, zlib.crc32(own[s : s + m].tobytes())) for k, (s, m) in enumerate(cut(n + 1, capacity))]
            cols = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

        return f

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("_t")), make, PIECE)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """The best bound that dual-feasible functions give for counts of sizes 0..capacity."""
    size, best = np.arange(capacity + 1), 0.0
    best = float((counts * size).sum()) / capacity
    have = np.flatnonzero(counts)
    for low in np.unique(np.minimum(have, capacity - have)):
        if 0 < low <= capacity // 2:  # large sizes fill a bin, those under ``low`` count nothing
            f = np.where(size > capacity - low, capacity, np.where(size >= low, size, 0))
            best = max(best, float((counts * f).sum()) / capacity)
    for k in range(1, 101):  # steps of 1/k; exact multiples keep their size
        whole = (k + 1) * size % capacity == 0
        f = np.where(whole, size / capacity, ((k + 1) * size // capacity) / k)
        best = max(best, float((counts * f).sum()))
    return int(np.ceil(best - 1e-6))


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each of the sizes, which come in descending order, and the bin count."""
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by room left
    rooms, bins, offsets, n = 0, np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), 0
    for i, s in enumerate(sizes.tolist()):
        fits = rooms >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                rooms ^= 1 << room
        else:
            room, b, n = capacity, n, n + 1
        bins[i], offsets[i] = b, capacity - room
        left = room - s
        if left:
            open_bins[left].append(b)
            rooms |= 1 << left
    return bins, offsets, n


def pack(pieces: DataFrame, capacity: int = 1024, per_part: int = 8_192, rounds: int = 3) -> DataFrame:
    """Adds sequence_id, offset, and the partition's bin count and certified bound.

    ``pieces`` is read twice and must be stored (``common.stored``).
    """
    shipped(pieces.sparkSession)
    parts = max(1, -(-pieces.count() // per_part))
    schema = PIECE + ", part long, bin long, offset long, n_bins long, bound long, full long"

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        sizes = group["length"].to_numpy()
        b, o, n = best_fit(sizes, capacity)
        low = lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity)
        return group.assign(bin=b, offset=o, n_bins=n, bound=low, full=-(-int(sizes.sum()) // capacity))

    def again(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        before = group.drop_duplicates("part")
        if len(before) > 1 and (before["n_bins"] > before["full"]).any():
            new = run(key, group.assign(part=key[0]))
            if new["n_bins"].iloc[0] < before["n_bins"].sum():
                return new[group.columns]
        return group

    names = [c.split()[0] for c in PIECE.split(", ")]
    dealt = pieces.select(*names, F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)).alias("part"))
    packed = stored(dealt.groupBy("part").applyInPandas(run, schema), "packed")
    # the certificate of the whole, from at most ``capacity`` counts
    counts = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    least = lower_bound(counts, capacity)
    bins = lambda: packed.groupBy("part").agg(F.first("n_bins").alias("n")).agg(F.sum("n")).first()[0] or 0
    for turn in range(1, rounds + 1):
        if bins() == least:
            break
        # the partitions of a block of 2 ** turn exchange documents if one of them has a gap
        block = F.shiftleft(F.shiftright(F.col("part").bitwiseAND((1 << 28) - 1), turn), turn)
        pool = (block + F.lit(turn << 28)).alias("pool")
        packed = stored(packed.groupBy(pool).applyInPandas(again, schema), "packed")
    return packed.select(*names, (F.col("part") * F.lit(1 << 31) + F.col("bin")).alias("sequence_id"), "offset", "n_bins", "bound")


def pack_documents(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Pieces of all documents with their places: the whole operator."""
    pieces = stored(tokenize_pieces(docs, path, capacity, end_id), "pieces")
    return pack(pieces, capacity)
