"""Operator 3: nearest neighbours by a forest of random-projection trees.

The trees are fitted on at most ``SAMPLE`` vectors: a node splits its sample halfway
between two of its points, down to leaves of ``LEAF`` points.  Below a fitted leaf,
``extra`` more levels split by one random direction a tree and level through the leaf's
centre; their number follows from the number of vectors, so leaves stay small at any
size while the forest that is broadcast stays bounded by the sample.  Every vector is
routed to one leaf of each tree.

A query walks all trees through one shared priority queue: the open node with the
largest margin, of any tree, is opened next, until a ``share`` of all leaves (``FEWEST``
at least) is reached.  The share sets the recall: vectors without any structure, as in
the test tables, need about half of all rows as candidates for nine in ten of the true
neighbours, whatever the tree; clustered ones need far less and may set it lower.
Queries and vectors meet by leaf; candidates are ranked by their exact distance.

Equal vectors are one class: only the class is indexed, with the smallest ids of its
members, so a common vector costs one entry.  Leaves with more than ``BLOCK`` classes
are split into blocks that are searched apart.

Vectors that are null, empty, zero, hold null or non-finite components, or differ in
length from most of the sample, take no part.  A repeated (id, vector) row counts once.
Ties go to the smaller id.  An empty table, or one without queries, gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from benchscope.llm.common import arrow_map, shipped, stored

SAMPLE, LEAF, TREES, SHARE, FEWEST, BLOCK = 20_000, 128, 16, 0.06, 64, 4_096


@dataclass
class Forest:
    """Fitted nodes of all trees in one numbering; the first ``trees`` nodes are the roots."""

    normal: np.ndarray  # (nodes, dimensions); zero for leaves
    offset: np.ndarray
    child: np.ndarray  # (nodes, 2); -1 for leaves
    deep: np.ndarray  # (trees, extra, dimensions): directions below fitted leaves
    center: np.ndarray  # (nodes, extra): where they split
    tree: np.ndarray  # tree of each node

    @property
    def trees(self) -> int:
        return len(self.deep)

    @classmethod
    def fit(cls, sample: np.ndarray, trees: int, leaf: int, extra: int, seed: int = 7) -> Forest:
        rng = np.random.default_rng(seed)
        width = sample.shape[1]
        deep = rng.standard_normal((trees, extra, width))
        normal, offset, child, center, of = [], [], [], [], []

        def node(t: int) -> int:
            normal.append(np.zeros(width))
            offset.append(0.0)
            child.append([-1, -1])
            center.append(np.zeros(extra))
            of.append(t)
            return len(of) - 1

        open_nodes = [(node(t), np.arange(len(sample))) for t in range(trees)]
        while open_nodes:
            k, own = open_nodes.pop()
            if len(own) > leaf:
                for _ in range(5):
                    a, b = sample[rng.choice(own, 2, replace=False)]
                    w = a - b
                    size = np.linalg.norm(w)
                    if not size:
                        continue
                    w = w / size
                    cut = float(w @ (a + b) / 2)
                    right = sample[own] @ w > cut
                    if 0.05 < right.mean() < 0.95:
                        break
                else:  # lopsided five times: split by the middle of a random direction
                    w = rng.standard_normal(width)
                    w /= np.linalg.norm(w)
                    cut = float(np.median(sample[own] @ w))
                    right = sample[own] @ w > cut
                if 0 < right.sum() < len(own):
                    normal[k], offset[k] = w, cut
                    child[k] = [node(of[k]), node(of[k])]
                    open_nodes += [(child[k][0], own[~right]), (child[k][1], own[right])]
                    continue
            center[k] = np.median(sample[own] @ deep[of[k]].T, axis=0) if extra and len(own) else np.zeros(extra)
        return cls(np.array(normal), np.array(offset), np.array(child), deep, np.array(center).reshape(len(of), extra), np.array(of))

    def route(self, x: np.ndarray) -> np.ndarray:
        """Leaf of every vector in every tree: fitted leaf, then the extra levels' bits."""
        out = np.empty((len(x), self.trees), np.int64)
        extra = self.deep.shape[1]
        for t in range(self.trees):
            at = np.full(len(x), t)
            live = np.flatnonzero(self.child[at, 0] >= 0)
            while len(live):
                n = at[live]
                right = np.einsum("ij,ij->i", x[live], self.normal[n]) > self.offset[n]
                at[live] = self.child[n, right.astype(int)]
                live = live[self.child[at[live], 0] >= 0]
            code = at.copy()
            if extra:
                bits = x @ self.deep[t].T > self.center[at]
                for level in range(extra):
                    code = code << 1 | bits[:, level]
            out[:, t] = code
        return out

    def search(self, q: np.ndarray, leaves: int) -> list[int]:
        """Leaves of all trees for one query, most promising first."""
        margin = self.normal @ q - self.offset
        extra = self.deep.shape[1]
        deep = np.einsum("tej,j->te", self.deep, q) if extra else np.zeros((self.trees, 0))
        queue = [(-np.inf, t, 0, t) for t in range(self.trees)]  # -priority, code, level below, node
        heapq.heapify(queue)
        found: list[int] = []
        while queue and len(found) < leaves:
            bad, code, level, node = heapq.heappop(queue)
            if level == 0 and self.child[node, 0] >= 0:
                m = margin[node]
                for side, c in enumerate(self.child[node].tolist()):
                    heapq.heappush(queue, (max(bad, -m if side else m), c, 0, c))
            elif level < extra:
                m = deep[self.tree[node], level] - self.center[node, level]
                for side in (0, 1):
                    heapq.heappush(queue, (max(bad, -m if side else m), code << 1 | side, level + 1, node))
            else:
                found.append(code)
        return found


def usable(df: DataFrame, id_column: str, column: str) -> DataFrame:
    """(id, v) of the rows that take part, each once."""
    v = F.col(column).cast("array<double>")
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.where(F.col(id_column).isNotNull() & F.col(column).isNotNull()).where(F.coalesce(fine, F.lit(False)))
    # 0.0 for -0.0, so that equal vectors are equal as groups
    return rows.select(F.col(id_column).cast("long").alias("id"), F.transform(v, lambda x: x + F.lit(0.0)).alias("v")).distinct()


def search(df: DataFrame, k: int = 10, every: int = 100, id_column: str = "vec_id", column: str = "embedding", trees: int = TREES, share: float = SHARE, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row whose id ``every`` divides."""
    spark = shipped(df.sparkSession)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = stored(usable(df, id_column, column), "vectors")
    by_id = Window.partitionBy("v").orderBy("id")
    # the k + 1 smallest ids of a class are all that any query can return
    classes = rows.withColumn("r", F.row_number().over(by_id)).where(F.col("r") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    classes = stored(classes.select(F.col("ids")[0].alias("cid"), "v", "ids"), "classes")
    n = classes.count()
    taken = [r["v"] for r in classes.orderBy(F.xxhash64("cid"), "cid").limit(sample).select("v").collect()]  # a stated bound
    if not taken:
        return empty
    width = int(np.bincount([len(v) for v in taken]).argmax())
    classes = classes.where(F.size("v") == width)
    points = np.array([v for v in taken if len(v) == width])
    extra = max(0, int(np.ceil(np.log2(n / len(points)))))
    fitted = Forest.fit(points, trees, LEAF, extra)
    leaves = max(FEWEST, int(np.ceil(share * (fitted.child[:, 0] < 0).sum() * 2**extra)))
    sent = spark.sparkContext.broadcast(fitted)
    asked = rows.where(F.pmod("id", F.lit(every)) == 0).join(classes.select("cid", "v"), "v").select(F.col("id").alias("query_id"), "cid", "v")
    asked = stored(asked, "asked")

    def route():
        forest = sent.value

        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, width)
            code = forest.route(x)
            take = pa.array(np.repeat(np.arange(b.num_rows), forest.trees))
            return pa.RecordBatch.from_arrays([b.column("cid").take(take), b.column("v").take(take), pa.array(np.tile(np.arange(forest.trees, dtype=np.int32), b.num_rows)), pa.array(code.ravel())], ["cid", "v", "tree", "leaf"])

        return f

    def visit():
        forest = sent.value

        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, width)
            found = [np.array(forest.search(q, leaves), np.int64) for q in x]
            at = [forest.tree[c >> forest.deep.shape[1]].astype(np.int32) for c in found]
            return pa.RecordBatch.from_arrays([b.column("cid"), pa.array(at, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.int64()))], ["cid", "tree", "leaf"])

        return f

    kind = df.schema[column].dataType.elementType.simpleString()
    kind = "float" if kind == "float" else "double"  # single precision holds what came in single precision
    members = stored(arrow_map(classes.select("cid", "v"), route, "cid long, v array<double>, tree int, leaf long").withColumn("v", F.col("v").cast(f"array<{kind}>")), "members")
    opened = arrow_map(asked.groupBy("cid").agg(F.first("v").alias("v")), visit, "cid long, tree array<int>, leaf array<long>")
    opened = opened.select("cid", F.explode(F.arrays_zip("tree", "leaf")).alias("at")).select("cid", "at.tree", "at.leaf")
    # large leaves are split into blocks, each searched on its own
    large = members.groupBy("tree", "leaf").count().where(F.col("count") > BLOCK).select("tree", "leaf", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    large = stored(large, "large")
    blocks = F.coalesce("blocks", F.lit(1))
    parts = max(1, -(-n * trees // 20_000))
    part = F.pmod(F.xxhash64("tree", "leaf", "block"), F.lit(parts))
    members = members.join(large, ["tree", "leaf"], "left").withColumn("block", F.pmod(F.xxhash64("cid"), blocks).cast("int")).select(part.alias("part"), "tree", "leaf", "block", "cid", "v")
    opened = opened.join(large, ["tree", "leaf"], "left").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    opened = opened.groupBy(part.alias("part"), "cid").agg(F.collect_list(F.struct("tree", "leaf", "block")).alias("at"))  # a query's leaves are bounded
    visits = opened.join(asked.groupBy("cid").agg(F.first("v").alias("v")), "cid").select("part", F.col("cid").alias("q"), F.col("at.tree").alias("tree"), F.col("at.leaf").alias("leaf"), F.col("at.block").alias("block"), "v")

    def near(mine: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(mine) and len(asks):
            x, cid = np.stack(mine["v"].to_numpy()).astype(np.float64), mine["cid"].to_numpy()
            held = mine.groupby(["tree", "leaf", "block"], sort=False).indices
            for q, *at, v in asks[["q", "tree", "leaf", "block", "v"]].itertuples(index=False):
                own = [held[key] for key in zip(*(c.tolist() for c in at), strict=True) if key in held]
                if not own:
                    continue
                m = np.concatenate(own)
                m = m[np.unique(cid[m], return_index=True)[1]]
                d = np.sqrt(((x[m] - np.asarray(v)) ** 2).sum(axis=1))
                best = np.lexsort((cid[m], d))[: k + 1]
                out.append((np.full(len(best), q), cid[m][best], d[best]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pd.DataFrame({"q": cols[0], "cid": cols[1], "score": cols[2]})

    met = members.groupBy("part").cogroup(visits.groupBy("part")).applyInPandas(near, "q long, cid long, score double")
    pairs = met.groupBy("q", "cid").agg(F.min("score").alias("score"))
    few = pairs.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("score", "cid"))).where(F.col("r") <= k + 1).drop("r")
    found = few.join(classes.select("cid", "ids"), "cid").select("q", "score", F.explode("ids").alias("vec_id"))
    few = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id"))).where(F.col("r") <= k + 1).drop("r")
    each = asked.select("query_id", F.col("cid").alias("q")).join(few, "q").where("query_id != vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
