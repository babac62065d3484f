"""Operator 13: what filters do to each other, in every order, by wide packed counters.

Every document has a mask: which of the filters A to E it fails.  A mask (with the two
labels) decides what happens at each of the 600 steps of the 120 orders: the document is
kept after the step, removed in it, or fails it after an earlier step removed it.  So each
mask has one big integer whose fields, ``WIDTH`` bits each, hold all these outcomes as ones
and zeros.  Tasks add up the integers of their documents by part; the sums are added up by
part in two more rounds, and the fields of a part's sum are its counts.  A field never
overflows into the next: it counts documents, and a count is a long.

Shuffled are: one narrow row a document (part, mask, labels, hash of the text), and one
integer (``8 * FIELDS`` bytes) a part and task.  Equal texts are found by their SHA-256
through counts by (text, part, labels), aggregated before the shuffle, so a text that a
third of all documents share is no hot key: of a text's documents all fail E but those of
its smallest id.  A task's sums are flushed beyond ``PARTS`` parts.

Null texts are empty (they fail A, not B, C, D).  A null language is the part ``""``.  A
document without an id has no labels, and neither fails E nor makes others fail it.
Repeated rows count each; of repeated labels any 1 counts.  Further columns play no part;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from benchscope.llm.common import shipped, stored, text_of

FILTERS = "ABCDE"
ORDERS = tuple("".join(p) for p in permutations(FILTERS))
STEPS = len(FILTERS)
#: A field's bits; a count is a long.
WIDTH = 64
#: kept, removed, redundant, good_lost, toxic_lost of every step, then unique fails by filter.
KINDS = 5
FIELDS = len(ORDERS) * STEPS * KINDS + len(FILTERS)
#: Sums that a task holds at most before it hands them on, and sums that a merging task adds up.
PARTS, FAN_IN = 512, 1024
SPACE = r"[\x20\x09-\x0D]+"

COUNTS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def outcome_fields(mask: int, good: bool, toxic: bool) -> list[int]:
    """The fields, 0 or 1, of one document's integer."""
    fails = [bool(mask >> i & 1) for i in range(len(FILTERS))]
    out = []
    for order in ORDERS:
        gone = False
        for letter in order:
            fail = fails[FILTERS.index(letter)]
            removed, redundant = fail and not gone, fail and gone
            gone = gone or fail
            out += [not gone, removed, redundant, removed and good, removed and toxic]
    out += [mask == 1 << i for i in range(len(FILTERS))]
    return [int(x) for x in out]


def packed(fields: list[int]) -> int:
    return int.from_bytes(np.array(fields, dtype="<u8").tobytes(), "little")


def unpacked(total: int) -> np.ndarray:
    return np.frombuffer(total.to_bytes(FIELDS * WIDTH // 8, "little"), dtype="<u8").astype("int64")


def integers() -> list[int]:
    """The integer of each code: mask + 32 * good + 64 * toxic."""
    n = 1 << len(FILTERS)
    return [packed(outcome_fields(c % n, bool(c // n & 1), bool(c // n & 2))) for c in range(4 * n)]


# ---------------------------------------------------------------- masks


def masked(docs: DataFrame) -> DataFrame:
    """(d, part, th, mask): id, part, hash of the text, and the bits of A to D, which a text alone decides.

    Words are split and counted in projections of their own, so that each is done once a text.
    """
    text, part = text_of("text").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part")
    rows = docs.select(F.col("doc_id").cast("long").alias("d"), part, text).withColumn("words", F.array_remove(F.split("text", SPACE), ""))
    rows = rows.select("d", "part", "text", F.size("words").cast("long").alias("n"), F.size(F.array_distinct("words")).cast("long").alias("kinds"))
    upper = F.length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long")
    tests = [F.col("n") < 200, F.col("kinds") * 100 < F.col("n") * 50, upper * 100 > F.length("text").cast("long") * 3, F.col("text").rlike(r"[#$%&*|]")]
    mask = sum((t.cast("int") * (1 << i) for i, t in enumerate(tests)), F.lit(0))
    return rows.select("d", "part", F.sha2("text", 256).alias("th"), mask.alias("mask"))


def codes(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, code, n): how many documents of a part have a mask and labels."""
    rows = stored(masked(docs).groupBy("d", "part", "th", "mask").agg(F.count(F.lit(1)).alias("n")), "masks")
    flag = lambda c: F.max((F.col(c) == 1).cast("int"))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("d")).agg(F.coalesce(flag("quality"), F.lit(0)).alias("good"), F.coalesce(flag("toxic"), F.lit(0)).alias("bad"))
    # stored, so that both sides of the join are plain exchanges, which Spark may split where they are skewed
    known = stored(known.where("good + bad > 0"), "known")
    spread = F.when(F.col("d").isNull(), F.monotonically_increasing_id() % 1024).otherwise(0)  # rows without an id match nothing; not all in one task
    both = rows.withColumn("at", spread).join(known.withColumn("at", F.lit(0).cast("long")), ["d", "at"], "left")
    both = both.withColumn("code", F.col("mask") + 32 * F.coalesce("good", F.lit(0)) + 64 * F.coalesce("bad", F.lit(0)))
    # rows of a text by part and code: how many, and those of the smallest id
    with_id = F.col("d").isNotNull()
    least = F.min("d").alias("least"), F.min_by("n", "d").alias("least_n")
    groups = both.groupBy("th", "part", "code").agg(F.sum("n").alias("n"), F.sum(F.when(with_id, F.col("n")).otherwise(0)).alias("with_id"), *least)
    smallest = groups.withColumn("first", F.min("least").over(Window.partitionBy("th")))
    repeats = F.col("with_id") - F.when(F.col("least") == F.col("first"), F.col("least_n")).otherwise(0)
    split = F.explode(F.array(F.struct(F.col("code").alias("code"), (F.col("n") - F.col("repeats")).alias("n")), F.struct((F.col("code") + 16).alias("code"), F.col("repeats").alias("n")))).alias("s")
    out = smallest.withColumn("repeats", F.when(F.col("with_id") > 0, repeats).otherwise(F.lit(0))).select("part", split)
    return out.select("part", F.col("s.code").cast("int").alias("code"), F.col("s.n").cast("long").alias("n")).where("n > 0")


# ---------------------------------------------------------------- sums


def added(rows: DataFrame) -> DataFrame:
    """(part, slot, total): the sums of the integers by part, one of a part and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, sums = integers(), {}
        slot = TaskContext.get().partitionId() // FAN_IN

        def out():
            data = [list(sums), [slot] * len(sums), [x.to_bytes(FIELDS * WIDTH // 8, "little") for x in sums.values()]]
            sums.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(data, (pa.string(), pa.int64(), pa.binary()))], ["part", "slot", "total"])

        for b in batches:
            for part, code, n in zip(*(b.column(i).to_pylist() for i in range(3))):
                sums[part] = sums.get(part, 0) + n * table[code]
                if len(sums) > PARTS:
                    yield out()
        yield out()

    shipped(rows.sparkSession)
    return rows.select("part", "code", "n").mapInArrow(run, "part string, slot long, total binary")


def merged(sums: DataFrame, *keys: str) -> DataFrame:
    """The sums of one group added up."""

    def run(table: pa.Table) -> pa.Table:
        total = sum(int.from_bytes(x.as_py(), "little") for x in table.column("total"))
        first = table.slice(0, 1)
        return pa.table({"part": first["part"], "slot": first["slot"], "total": pa.array([total.to_bytes(FIELDS * WIDTH // 8, "little")], pa.binary())})

    return sums.groupBy(*keys).applyInArrow(run, "part string, slot long, total binary")


def counted(sums: DataFrame) -> DataFrame:
    """The counts of each part, unpacked from its sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = len(ORDERS) * STEPS
        orders = np.repeat(np.array(ORDERS), STEPS)
        steps = np.tile(np.arange(1, STEPS + 1, dtype="int32"), len(ORDERS))
        letter = np.array([FILTERS.index(o[s - 1]) for o, s in zip(orders, steps)])
        for b in batches:
            for part, total in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                fields = unpacked(int.from_bytes(total, "little"))
                of = fields[: kinds * KINDS].reshape(kinds, KINDS)
                unique = fields[kinds * KINDS:]
                share = np.zeros(STEPS, dtype="int64")
                np.add.at(share, letter, of[:, 1])
                columns = [[part] * kinds, orders.tolist(), steps, of[:, 0], of[:, 1], of[:, 2], unique[letter], of[:, 3], of[:, 4], share[letter]]
                kinds_of = [pa.string(), pa.string(), pa.int32()] + [pa.int64()] * 7
                names = [c.split()[0] for c in COUNTS.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds_of)], names)

    return sums.mapInArrow(run, COUNTS)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part, order of the filters and step: kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley."""
    sums = added(codes(docs, labels))
    return counted(merged(merged(sums, "part", "slot"), "part"))
