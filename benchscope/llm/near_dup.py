"""Operator 1: near-duplicates by a chosen-path set similarity join over MinHash.

A document's set holds the hashes of its distinct word shingles.  Documents with equal
sets are one class, represented by the smallest id; only classes are joined, so copies
are never paired.

The join branches recursively.  In each of ``TREES`` independent trees the root picks
one of the ``WIDTH`` minwise tokens of a document and leads to the node of all classes
that share its value; a node that branches picks ``BRANCH`` tokens for its children by
the hash of its path.  Two sets of similarity J share a picked token with probability J,
so a pair at 0.8 misses the nodes of all trees with probability 0.2 ** TREES.  Sketches
of two bits a minwise token and the set sizes (which bound J) drop hopeless pairs; every
link is confirmed on the full sets.

First each node's pivot is compared with its members, m - 1 comparisons a node.  Nodes
whose members are then all connected are done, as no further link can change a
component.  A node of at most ``SMALL`` members joins the members of different
components.  One of at most ``CAP`` members is compared exhaustively as one group, in
two steps: sketches first, then the sets of the members that are still in question, by
counting common shingles.  A larger node branches; what is still larger at depth
``DEPTH`` is cut into blocks and compared block against block, so nothing is dropped.
So is a group whose sets hold more than ``ITEMS`` shingles in all: a task holds about
``ITEMS`` of them, or two sets if those are longer.
Components come from minimum labels with pointer jumping, all on the cluster; every
round is written to the shared folder.

Null and empty texts, and texts without a word, have an empty set and link with nothing.
A text with fewer words than a shingle is one shingle.  Rows that repeat a doc_id are one
document (of the smallest set signature, should texts differ); rows with a null doc_id
are not returned; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benchscope.llm.common import arrow_map, chunks, stored
from benchscope.llm.wordcache import gather, span_hashes

WIDTH, TREES, BRANCH, DEPTH, SMALL, CAP = 64, 6, 2, 6, 24, 4096
ITEMS = 4_000_000  # 32 MB of hashes
_U = np.uint64
_C1, _C2, _C3 = _U(0xFF51AFD7ED558CCD), _U(0xC4CEB9FE1A85EC53), _U(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> _U(33))) * _C1
        h = (h ^ (h >> _U(33))) * _C2
        return h ^ (h >> _U(33))


def shingle_sets(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted by text and hash, and their text numbers.

    Words are runs without ASCII white space; only A-Z are lower-cased.
    """
    raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    flat = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    ends_of = np.cumsum(np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw)))
    solid = ~((flat == 32) | ((flat >= 9) & (flat <= 13)))
    edge = np.flatnonzero(np.diff(np.concatenate([[0], solid.view(np.int8), [0]])))
    starts, ends = edge[::2], edge[1::2]
    h = span_hashes(flat, starts, ends)
    owner = np.searchsorted(ends_of, starts, side="right")
    count = np.bincount(owner, minlength=len(texts))
    with np.errstate(over="ignore"):
        long, at = h.copy(), len(h) - words + 1
        for k in range(1, words):
            long[: max(0, at)] = mix(long[: max(0, at)] * _C3 + h[k : k + max(0, at)])
        whole = np.zeros(len(h), bool)
        if at > 0:
            whole[:at] = owner[:at] == owner[words - 1 :]
        hashes, owners = long[whole], owner[whole]
        few = np.flatnonzero((count > 0) & (count < words))
        if len(few):  # the whole sequence as one
            first = np.concatenate([[0], np.cumsum(count)])[few]
            one = h[first].copy()
            for k in range(1, words - 1):
                more = count[few] > k
                one[more] = mix(one[more] * _C3 + h[first[more] + k])
            hashes, owners = np.concatenate([hashes, mix(one + _C1 * count[few].astype(np.uint64))]), np.concatenate([owners, few])
    order = np.lexsort((hashes, owners))
    hashes, owners = hashes[order], owners[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])
    return hashes[new], owners[new]


def minwise(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(sets, WIDTH) minwise tokens of non-empty sets that begin at ``first``."""
    rng = np.random.default_rng(11)
    a = rng.integers(0, 1 << 63, WIDTH, dtype=np.uint64) << _U(1) | _U(1)
    b = rng.integers(0, 1 << 63, WIDTH, dtype=np.uint64)
    out = np.empty((len(first), WIDTH), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(WIDTH):
            out[:, k] = np.minimum.reduceat(hashes * a[k] + b[k], first)
    return mix(out)


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n, s1, s2, k1, k2, sig): set size, 128-bit set hash, sketch, minwise tokens."""

    def make():
        bits = _U(1) << np.arange(WIDTH, dtype=np.uint64)

        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or "" for t in b.column("_t").to_pylist()]
            cols: list[list[np.ndarray]] = [[], [], [], [], [], []]
            for x, z in chunks(texts):
                hashes, owner = shingle_sets(texts[x:z], words)
                n = np.bincount(owner, minlength=z - x)
                sums, sketch, sig = np.zeros((2, z - x), np.uint64), np.zeros((2, z - x), np.uint64), np.zeros((z - x, WIDTH), np.int32)
                some = np.flatnonzero(n)
                if len(some):
                    first = (np.cumsum(n) - n)[some]
                    with np.errstate(over="ignore"):
                        sums[:, some] = [np.add.reduceat(mix(hashes + c), first) for c in (_C1, _C2)]
                        m = minwise(hashes, first)
                        sketch[:, some] = [((m >> _U(k) & _U(1)) * bits).sum(axis=1, dtype=np.uint64) for k in (7, 13)]
                    sig[some] = (m >> _U(32)).astype(np.uint32).view(np.int32)
                for c, v in zip(cols, (n, sums[0], sums[1], sketch[0], sketch[1], sig), strict=True):
                    c.append(v)
            n, s1, s2, k1, k2, sig = (np.concatenate(c) for c in cols)
            tokens = pa.ListArray.from_arrays(pa.array(np.arange(0, len(sig) * WIDTH + 1, WIDTH, dtype=np.int32)), pa.array(sig.ravel()))
            return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), *(pa.array(v.view(np.int64)) for v in (s1, s2, k1, k2)), tokens], ["doc_id", "n", "s1", "s2", "k1", "k2", "sig"])

        return f

    base = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("_t"))
    return arrow_map(base, make, "doc_id long, n long, s1 long, s2 long, k1 long, k2 long, sig array<int>")


def full_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(cid, items array<long>) of the documents named in ``ids`` (cid, s1, s2), whole sets in order."""

    def make():
        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or "" for t in b.column("_t").to_pylist()]
            items, sizes, s1 = [], [], []
            for x, z in chunks(texts):
                hashes, owner = shingle_sets(texts[x:z], words)
                n = np.bincount(owner, minlength=z - x)
                with np.errstate(over="ignore"):
                    total = np.concatenate([[_U(0)], np.cumsum(mix(hashes + _C1), dtype=np.uint64)])
                    upto = np.cumsum(n)
                    s1.append(total[upto] - total[upto - n])
                items.append(hashes)
                sizes.append(n)
            off = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(items).view(np.int64)))
            return pa.RecordBatch.from_arrays([b.column("cid"), pa.array(np.concatenate(s1).view(np.int64)), b.column("want"), lists], ["cid", "s1", "want", "items"])

        return f

    base = docs.select(F.col("doc_id").cast("long").alias("cid"), F.col("text").cast("string").alias("_t")).join(ids.select("cid", F.col("s1").alias("want")), "cid")
    return arrow_map(base, make, "cid long, s1 long, want long, items array<long>").where("s1 = want").select("cid", "items").dropDuplicates(["cid"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) pairs whose full sets reach the similarity."""

    def make():
        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            x, y = b.column("x"), b.column("y")
            xv, yv = (c.flatten().to_numpy(zero_copy_only=False).view(np.uint64) for c in (x, y))
            xo, yo = (np.concatenate([[0], np.cumsum(c.value_lengths().to_numpy(zero_copy_only=False))]) for c in (x, y))
            good = np.zeros(b.num_rows, bool)
            for i in range(b.num_rows):
                p, q = xv[xo[i] : xo[i + 1]], yv[yo[i] : yo[i + 1]]
                if len(p) > len(q):
                    p, q = q, p
                at = np.searchsorted(q, p)
                at[at == len(q)] = 0
                common = int((q[at] == p).sum())
                good[i] = 100 * common >= percent * (len(p) + len(q) - common)
            return pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(good))

        return f

    left = pairs.join(sets.select(F.col("cid").alias("a"), F.col("items").alias("x")), "a")
    both = left.join(sets.select(F.col("cid").alias("b"), F.col("items").alias("y")), "b")
    return arrow_map(both.select("a", "b", "x", "y"), make, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(cid, comp) of every end of a link: the smallest id that is reachable."""
    ends = stored(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b"), F.col("a"))).distinct(), "ends")
    labels = stored(ends.groupBy(F.col("u").alias("cid")).agg(F.least("cid", F.min("v")).alias("comp")), "labels")
    while True:
        seen = ends.join(labels.select(F.col("cid").alias("v"), "comp"), "v").groupBy(F.col("u").alias("cid")).agg(F.min("comp").alias("near"))
        best = labels.join(seen, "cid").select("cid", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        # a label's own label is at least as small
        jump = labels.select(F.col("cid").alias("comp"), F.col("comp").alias("beyond"))
        new = stored(best.join(jump, "comp", "left").select("cid", "was", F.least("comp", F.coalesce("beyond", "comp")).alias("comp")), "labels")
        done = new.where("was != comp").isEmpty()
        labels = new.select("cid", "comp")
        if done:
            return labels


def least_bits(percent: int) -> float:
    """Sketch bits that sets of the similarity share, six deviations below the mean."""
    share = percent / 100
    agree = 1 + share  # bits of a token's two that agree on average
    spread = (4 * (share + (1 - share) / 4) + (1 - share) / 2 - agree**2) ** 0.5
    return WIDTH * agree - 6.2 * (WIDTH**0.5) * spread


def alike(x: str, y: str, percent: int):
    """What two rows of similar sets must satisfy, by their sizes and sketches."""
    least = least_bits(percent)
    bits = 2 * WIDTH - F.bit_count(F.col(f"{x}.k1").bitwiseXOR(F.col(f"{y}.k1"))) - F.bit_count(F.col(f"{x}.k2").bitwiseXOR(F.col(f"{y}.k2")))
    sizes = F.least(f"{x}.n", f"{y}.n") * 100 >= F.greatest(f"{x}.n", f"{y}.n") * percent
    return sizes & (bits >= int(least))


def with_company(members: DataFrame) -> DataFrame:
    """Rows of nodes that have at least two members."""
    return members.join(members.groupBy("node").count().where("count > 1").select("node"), "node")


def pivot_pairs(members: DataFrame, percent: int) -> DataFrame:
    """(a, b): each member of a node with the node's pivot, the smallest id."""
    pivots = members.groupBy("node").agg(F.min(F.struct("cid", "n", "k1", "k2")).alias("p")).select("node", "p.*").alias("y")
    met = members.alias("x").join(pivots, (F.col("x.node") == F.col("y.node")) & (F.col("x.cid") != F.col("y.cid")) & alike("x", "y", percent))
    return met.select(F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b")).distinct()


def in_question(members: DataFrame, percent: int) -> DataFrame:
    """The rows (of ``group``) with a like row of another component in their group."""
    least = int(least_bits(percent))

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        n, comp = g["n"].to_numpy(), g["comp"].to_numpy()
        k = g[["k1", "k2"]].to_numpy().view(np.uint64)
        keep = np.zeros(len(g), bool)
        for at in range(0, len(g), 256):
            z = slice(at, at + 256)
            differ = np.bitwise_count(k[z, None, 0] ^ k[None, :, 0]).astype(np.int16) + np.bitwise_count(k[z, None, 1] ^ k[None, :, 1])
            like = (2 * WIDTH - differ >= least) & (comp[z, None] != comp[None])
            like &= 100 * np.minimum(n[z, None], n[None]) >= percent * np.maximum(n[z, None], n[None])
            keep[z] = like.any(axis=1)
        return g[keep]

    columns = ["group", "cid", "n", "k1", "k2", "comp"]
    return members.select(*columns).groupBy("group").applyInPandas(run, "group long, cid long, n long, k1 long, k2 long, comp long")


def in_blocks(members: DataFrame, blocks) -> DataFrame:
    """Rows whose ``blocks`` is above 1, once for each pair of blocks (of half a group) that theirs is in."""
    mine = F.pmod(F.xxhash64("cid"), blocks)
    cut = members.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    pair = F.xxhash64("group", F.least("mine", "other"), F.greatest("mine", "other"))
    return cut.withColumn("group", F.when(blocks > 1, pair).otherwise(F.col("group")))


def by_items(members: DataFrame, items: int) -> DataFrame:
    """The rows (of ``group``), groups of more than ``items`` shingles cut into pairs of blocks."""
    total = members.groupBy("group").agg(F.sum("n").alias("total"))
    blocks = F.when(F.col("total") > items, F.ceil(2 * F.col("total") / items)).otherwise(F.lit(1).cast("long"))
    return in_blocks(members.join(total, "group"), blocks).select(*members.columns)


def compared(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between components in each group, one that spans them where several do."""

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("cid", kind="stable").reset_index(drop=True)
        cid, comp, n = (g[c].to_numpy() for c in ("cid", "comp", "n"))
        size = np.fromiter(map(len, g["items"]), np.int64, len(g))
        item = np.unique(np.concatenate(g["items"].to_list()), return_inverse=True)[1]
        owner = np.repeat(np.arange(len(g)), size)
        order = np.argsort(item, kind="stable")
        posting, cuts = owner[order], np.searchsorted(item[order], np.arange(item.max() + 2))
        first = np.cumsum(size) - size
        joined = {c: c for c in comp.tolist()}

        def root(c: int) -> int:
            while joined[c] != c:
                c = joined[c]
            return c

        names, counts = np.unique(comp, return_counts=True)
        main, out = names[counts.argmax()], []
        for i in np.flatnonzero(comp != main).tolist():  # the largest component's members meet all others
            own = item[first[i] : first[i] + size[i]]
            common = np.bincount(gather(posting, cuts[own], cuts[own + 1] - cuts[own]), minlength=len(g))
            for j in np.flatnonzero((100 * common >= percent * (n + n[i] - common)) & (comp != comp[i])).tolist():
                x, y = root(int(comp[i])), root(int(comp[j]))
                if x != y:
                    joined[x] = y
                    out.append((min(cid[i], cid[j]), max(cid[i], cid[j])))
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    both = members.select("group", "cid", "comp", "n").join(sets, "cid")
    return both.groupBy("group").applyInPandas(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, small: int = SMALL, cap: int = CAP, depths: int = DEPTH, items: int = ITEMS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document."""
    key = ["n", "s1", "s2"]
    own = signatures(docs, words).groupBy("doc_id").agg(F.min(F.struct("n", "s1", "s2", "k1", "k2", "sig")).alias("s")).select("doc_id", "s.*")
    own = stored(own, "signatures")
    one = F.struct("doc_id", "k1", "k2", "sig")
    classes = own.where("n > 0").groupBy(*key).agg(F.min(one).alias("c")).select("c.doc_id", *key, "c.k1", "c.k2", "c.sig").withColumnRenamed("doc_id", "cid")
    classes = stored(classes, "classes")
    roots = F.array(*(F.xxhash64(F.lit(k), F.col("sig")[k]) for k in range(TREES)))
    members = stored(with_company(classes.select(F.explode(roots).alias("node"), "cid", "n", "k1", "k2")), "members")

    ends = lambda p: p.select(F.col("a").alias("cid")).union(p.select("b")).distinct()
    first = stored(pivot_pairs(members, percent), "pairs")
    sets = stored(full_sets(docs, classes.select("cid", "s1").join(ends(first), "cid", "left_semi"), words), "sets")
    links = stored(confirmed(first, sets, percent), "links")
    labels = components(links)

    pairs, groups = [], []
    for depth in range(depths + 1):
        known = members.join(labels, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
        open_nodes = known.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("node", "size")
        known = stored(known.join(open_nodes, "node"), "members")
        x, y = (known.where(F.col("size") <= small).alias(c) for c in "xy")
        meet = (F.col("x.node") == F.col("y.node")) & (F.col("x.comp") != F.col("y.comp")) & (F.col("x.cid") < F.col("y.cid")) & alike("x", "y", percent)
        pairs.append(stored(x.join(y, meet).select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b")).distinct(), "pairs"))
        middle = known.where((F.col("size") > small) & (F.col("size") <= cap))
        groups.append(stored(in_question(middle.withColumn("group", F.col("node")), percent), "groups"))
        large = known.where(F.col("size") > cap)
        if large.isEmpty():
            break
        if depth == depths:  # block against block, a block of half a group
            cut = in_blocks(large.withColumn("group", F.col("node")), F.ceil(2 * F.col("size") / cap))
            groups.append(stored(in_question(cut, percent), "groups"))
            break
        pick = [F.pmod(F.xxhash64("node", F.lit(depth), F.lit(k)), F.lit(WIDTH)).cast("int") for k in range(BRANCH)]
        down = F.array(*(F.xxhash64("node", p, F.get("sig", p)) for p in pick))
        large = large.select("node", "cid", "n", "k1", "k2").join(classes.select("cid", "sig"), "cid")
        members = stored(with_company(large.select(F.explode(down).alias("node"), "cid", "n", "k1", "k2")), "members")
    rest = pairs[0]
    asked = groups[0]
    for more in pairs[1:]:
        rest = rest.union(more)
    for more in groups[1:]:
        asked = asked.union(more)
    asked = stored(by_items(asked, items), "groups")
    rest = stored(rest.distinct().join(first, ["a", "b"], "left_anti"), "pairs")
    missing = classes.select("cid", "s1").join(ends(rest).union(asked.select("cid")).distinct(), "cid", "left_semi").join(sets.select("cid"), "cid", "left_anti")
    missing = stored(missing, "missing")
    if not missing.isEmpty():
        sets = stored(sets.union(full_sets(docs, missing, words)), "sets")
    links = stored(links.union(confirmed(rest, sets, percent)).union(compared(asked, sets, percent)), "links")
    labels = components(links)
    named = classes.select(*key, "cid").join(labels, "cid", "left").select(*key, F.coalesce("comp", "cid").alias("component_id"))
    out = own.select("doc_id", *key).join(named, key, "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
