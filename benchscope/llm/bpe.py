"""Operator 10: byte-level BPE encoding and decoding with a segment tree.

A piece of text starts as its bytes.  The leaves of a segment tree over the byte
positions hold the rank of the pair that begins there (none: infinity); every inner
node holds the leftmost minimum below it, so the root names the next merge.  A merge
writes three leaves (the merged token, its live left neighbour and the swallowed one)
and the paths above them.  Pieces of like size run side by side as the rows of one
array, so each step does one merge in every piece that has one left.

A distinct piece is encoded once a worker (``wordcache``); ids and decoded bytes of
whole texts are then gathers.  No state outlives a worker and none is shared, so a
lost executor costs only its own tasks.

Nulls and empty texts give no tokens and the hashes of the empty string.  Repeated
rows and further columns change nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benchscope.llm.common import arrow_map, chunks, text_of
from benchscope.llm.wordcache import WordIds, gather

_NONE = np.int64(1) << np.int64(62)


class SegmentTreeBpe:
    """Ranks of a vocabulary file, and the merges by them."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.rank = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        most = max(ranks.values()) + 1
        tokens = [b""] * most
        for token, rank in ranks.items():
            tokens[rank] = token
        self.token_len = np.array([len(t) for t in tokens], np.int64)
        self.token_off = np.cumsum(self.token_len) - self.token_len
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def leaf(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """What the leaf at position ``at`` holds: pair rank and position, or none."""
        key = left << 32 | right
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[i] == key) & (right >= 0)
        return np.where(hit, self.rank[i] << 32 | at, _NONE)

    def merge(self, pieces: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces of at most ``width`` bytes (a power of two), row after row."""
        n, leaves = len(pieces), np.arange(width)
        size = np.fromiter(map(len, pieces), np.int64, n)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        live = leaves < size[:, None]
        token = np.full((n, width + 1), -1, np.int64)  # the last column stands for "no neighbour"
        token[:, :width][live] = self.byte_id[raw[live]]
        after = np.where(leaves + 1 < size[:, None], leaves + 1, width)
        before = np.broadcast_to(np.where(leaves == 0, width, leaves - 1), (n, width)).copy()
        before = np.concatenate([before, np.full((n, 1), width)], axis=1)
        after = np.concatenate([after, np.full((n, 1), width)], axis=1)
        tree = np.full((n, 2 * width), _NONE)
        r, c = np.nonzero(live)
        tree[r, width + c] = self.leaf(token[r, c], token[r, after[r, c]], c)
        for i in range(width - 1, 0, -1) if width <= 64 else ():
            np.minimum(tree[:, 2 * i], tree[:, 2 * i + 1], out=tree[:, i])
        if width > 64:
            level = width
            while level > 1:
                tree[:, level // 2 : level] = tree[:, level : 2 * level].reshape(n, level // 2, 2).min(axis=2)
                level //= 2
        rows = np.flatnonzero(tree[:, 1] < _NONE)
        while len(rows):
            best = tree[rows, 1]
            at, rank = best & 0xFFFFFFFF, best >> 32
            gone = after[rows, at]
            nxt, prv = after[rows, gone], before[rows, at]
            token[rows, at] = rank
            token[rows, gone] = -1
            after[rows, at] = nxt
            before[rows, nxt] = at
            before[rows, width] = width
            new = self.leaf(rank, token[rows, nxt], at)
            old = self.leaf(token[rows, prv], rank, prv)
            tree[rows, width + at] = new
            tree[rows, width + gone] = _NONE
            real = prv < width
            tree[rows[real], width + prv[real]] = old[real]
            places = [(rows, width + at), (rows, width + gone), (rows[real], width + prv[real])]
            while width > 1 and places[0][1][0] > 1:
                places = [(x, i >> 1) for x, i in places]
                for x, i in places:
                    tree[x, i] = np.minimum(tree[x, 2 * i], tree[x, 2 * i + 1])
            rows = rows[tree[rows, 1] < _NONE]
        kept = token[:, :width] >= 0
        return token[:, :width][kept].astype(np.int32), kept.sum(axis=1)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after the other, and the number of each."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        found: list[np.ndarray | None] = [None] * len(raw)
        groups: dict[int, list[int]] = {}
        for i, w in enumerate(raw):
            rank = self.ranks.get(w)
            if rank is not None:
                found[i] = np.array([rank], np.int32)
            else:
                groups.setdefault(max(2, 1 << (len(w) - 1).bit_length()), []).append(i)
        for width, members in groups.items():
            step = max(1, 2_000_000 // width)
            for at in range(0, len(members), step):
                some = members[at : at + step]
                ids, sizes = self.merge([raw[i] for i in some], width)
                for i, x in zip(some, np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
                    found[i] = x
        return np.concatenate(found), np.fromiter(map(len, found), np.int64, len(found))

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that ids stand for."""
        return gather(self.token_bytes, self.token_off[ids], self.token_len[ids])


@lru_cache(maxsize=2)
def load(path: str) -> tuple[SegmentTreeBpe, WordIds]:
    """The vocabulary of a rank file and its word cache, once a worker."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    bpe = SegmentTreeBpe(ranks)
    return bpe, WordIds(bpe.encode_words)


def encode_texts(texts: list[str], path: str) -> list[list[int]]:
    """Ids of each text (local helper; the distributed form is ``encode``)."""
    ids, sizes = load(path)[1].of(texts)
    return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] if texts else []


def encode(df: DataFrame, path: str, column: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(id_column, ids array<int>) of every row's whole text."""

    def make():
        words = load(path)[1]

        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = b.column("_t").to_pylist()
            parts = [words.of(texts[a:z]) for a, z in chunks(texts)]
            ids, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
            off = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            return pa.RecordBatch.from_arrays([b.column("_i"), pa.ListArray.from_arrays(off, pa.array(ids))], ["_i", "_ids"])

        return f

    kind = df.schema[id_column].dataType.simpleString()
    out = arrow_map(df.select(F.col(id_column).alias("_i"), text_of(column).alias("_t")), make, f"_i {kind}, _ids array<int>")
    return out.select(F.col("_i").alias(id_column), F.col("_ids").alias("ids"))


def decode(df: DataFrame, path: str, column: str = "ids", id_column: str = "doc_id") -> DataFrame:
    """(id_column, data binary): the bytes that each row's ids stand for; null ids give none."""

    def make():
        bpe = load(path)[0]

        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            data = [bpe.decode(np.asarray(x or [], np.int64)).tobytes() for x in b.column("_ids").to_pylist()]
            return pa.RecordBatch.from_arrays([b.column("_i"), pa.array(data, pa.binary())], ["_i", "_data"])

        return f

    kind = df.schema[id_column].dataType.simpleString()
    out = arrow_map(df.select(F.col(id_column).alias("_i"), F.col(column).alias("_ids")), make, f"_i {kind}, _data binary")
    return out.select(F.col("_i").alias(id_column), F.col("_data").alias("data"))


def codec_digest(df: DataFrame, path: str) -> DataFrame:
    """Per document: token count and the hashes of its ids and of the bytes decoded from them."""

    def make():
        bpe, words = load(path)
        shown = [b"%d," % i for i in range(len(bpe.token_len))]
        width = np.fromiter(map(len, shown), np.int64, len(shown))
        digits, place = np.frombuffer(b"".join(shown), np.uint8), np.cumsum(width) - width

        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            texts, n, said, back = b.column("_t").to_pylist(), [], [], []
            for a, z in chunks(texts):
                ids, sizes = words.of(texts[a:z])
                n += sizes.tolist()
                upto = np.concatenate([[0], np.cumsum(sizes)])
                for pool, off, length, out, cut in ((digits, place, width, said, 1), (bpe.token_bytes, bpe.token_off, bpe.token_len, back, 0)):
                    flat = memoryview(gather(pool, off[ids], length[ids]))
                    ends = np.concatenate([[0], np.cumsum(length[ids])])[upto].tolist()
                    out += [hashlib.sha256(flat[s : max(s, e - cut)]).hexdigest() for s, e in zip(ends, ends[1:], strict=False)]
            return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(said), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return f

    return arrow_map(df.select(F.col("doc_id").cast("long"), text_of().alias("_t")), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
