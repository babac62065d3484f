"""Operator 8 (native): I-Match fingerprints over randomised lexicons.

A term is a lower-cased run of letters and digits.  The lexicon holds the terms whose
inverse document frequency lies in a band: at least ``max(2, low * N)`` and at most
``max(2, high * N)`` of the N documents hold them.  It has at most (mean distinct terms
a document) / low entries however many documents there are, so it may be broadcast.
``LEVELS`` x ``PER_LEVEL`` random subsets of the lexicon are drawn, a subset of level s
holding one term in 2 ** s.  A text's fingerprint lists, for each subset, the hash of its
sorted distinct terms in that subset; a subset that none of the terms is in gives an
empty entry.

Two fingerprints are compared on the sparsest level of which at least ``ENOUGH`` subsets
are not empty in either (else the densest with any): the likeness is the share of those
subsets whose entries agree.  Equal fingerprints have likeness 1.  A text without a
lexicon term has the hash of its whole as its only entry.

The next document, in descending order of ids, is found in blocks of ``BLOCK`` ids: each
block is sorted by itself, and the blocks' first rows, few in number, link the blocks.
All of it is DataFrame operations.

Null texts are empty.  Rows with a null doc_id have no place in the order and are left
out; rows that repeat an id follow each other, ordered by text; a single document is its
own next one.  An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from benchscope.llm.common import stored, text_of

LEVELS, PER_LEVEL, ENOUGH, BLOCK = (1, 3, 5, 7), 20, 9, 512
LOW, HIGH = 0.0005, 0.1


def terms(text: Column) -> Column:
    """Hashes of the distinct terms of a text."""
    return F.array_distinct(F.transform(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != ""), lambda t: F.xxhash64(t)))


def lexicon(texts: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """(h) of the terms within the band of document frequencies of (text) rows."""
    n = texts.count()
    least, most = max(2, low * n), max(2, high * n)
    counts = texts.select(F.explode(terms(F.col("text"))).alias("h")).groupBy("h").count()
    return stored(counts.where((F.col("count") >= least) & (F.col("count") <= most)).select("h"), "lexicon")


def following(keys: DataFrame) -> DataFrame:
    """(k, nxt): the next smaller of distinct keys; the largest for the smallest."""
    keys = stored(keys.select(F.col("k").cast("long")), "keys")
    if keys.count() <= 4096:
        w = Window.orderBy(F.desc("k"))
        return keys.select("k", F.coalesce(F.lead("k").over(w), F.max("k").over(Window.partitionBy())).alias("nxt"))
    block = F.floor(F.col("k") / 4096)
    w = Window.partitionBy("b").orderBy(F.desc("k"))
    inner = keys.withColumn("b", block).withColumn("nxt", F.lead("k").over(w))
    heads = inner.groupBy("b").agg(F.max("k").alias("head"))
    nearby = following(heads.select(F.col("b").alias("k"))).select(F.col("k").alias("b"), F.col("nxt").alias("c"))
    bridge = nearby.join(heads.select(F.col("b").alias("c"), "head"), "c").select("b", "head")
    return inner.join(bridge, "b").select("k", F.coalesce("nxt", "head").alias("nxt"))


#: (level, shift) of each subset: a term hash belongs to it if ``level`` bits from ``shift`` on are zero.
SUBSETS = tuple((s, j * (56 - s) // (PER_LEVEL - 1)) for s in LEVELS for j in range(PER_LEVEL))
#: xxhash64 of an empty array is its seed.
EMPTY = 42


def entries(kept: Column) -> Column:
    """One entry a subset from the sorted hashes of a text's lexicon terms.

    Each subset's terms are picked and hashed once; the hashes become entries in a second step.
    """
    specs = F.array(*(F.struct(F.lit(shift).alias("shift"), F.lit((1 << s) - 1).cast("long").alias("mask")) for s, shift in SUBSETS))
    own = lambda spec: F.filter(kept, lambda h: F.call_function("shiftrightunsigned", h, spec["shift"]).bitwiseAND(spec["mask"]) == 0)
    hashes = F.transform(specs, lambda spec: F.xxhash64(own(spec)))
    return F.transform(hashes, lambda h: F.when(h == EMPTY, F.lit("")).otherwise(F.substring(F.lpad(F.hex(h), 16, "0"), 1, 6)))


def with_likeness(rows: DataFrame, sides: dict[str, tuple[str, str]]) -> DataFrame:
    """``rows`` and, for each name, the share of agreeing subsets of two entry lists, on the
    level that fits their size.

    Entries are paired, and pairs counted, in projections of their own: once a row.
    """
    agree = lambda x, y: F.when((x == "") & (y == ""), F.lit(0)).when(x == y, F.lit(3)).otherwise(F.lit(1))
    out = rows.withColumns({f"{n}_pairs": F.zip_with(a, b, agree) for n, (a, b) in sides.items()})
    levels = range(len(LEVELS))
    part = lambda n, i: F.slice(f"{n}_pairs", 1 + i * PER_LEVEL, PER_LEVEL)
    out = out.withColumns({f"{n}_{i}": F.struct(F.size(F.filter(part(n, i), lambda v: v > 0)).alias("some"), F.size(F.filter(part(n, i), lambda v: v == 3)).alias("same")) for n in sides for i in levels})
    for n, (a, b) in sides.items():
        ratio, least = None, None
        for i in levels:
            some, same = F.col(f"{n}_{i}.some"), F.col(f"{n}_{i}.same")
            share = F.when(some > 0, same / some)
            ratio = share if ratio is None else F.when(some >= ENOUGH, share).otherwise(ratio)
            least = share if least is None else F.coalesce(least, share)
        whole = F.when(F.size(a) == F.size(b), F.coalesce(ratio, least, F.lit(0.0))).otherwise(F.lit(0.0))
        out = out.withColumn(n, F.when(F.col(a) == F.col(b), F.lit(1.0)).otherwise(whole).cast("double"))
    return out


def listed(kept: str, whole: Column) -> Column:
    """The fingerprint's entries; the hash of the whole text where no term is in the lexicon."""
    return F.when(F.size(kept) > 0, entries(F.col(kept))).otherwise(F.array(whole))


def fingerprints(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """The contract's columns for every document."""
    base = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    words = lexicon(base.select("text"), low, high)
    # one more entry, which every text is given, carries what is known of the text
    known = words.unionByName(words.sparkSession.range(1).select(F.lit(0).cast("long").alias("h"))).distinct()
    hashes = lambda c: F.concat(terms(F.col(c)), F.array(F.lit(0).cast("long")))
    rows = base.withColumn("b", F.floor(F.col("doc_id") / BLOCK))
    # the first rows of the blocks, few in number, their fingerprints, and for each block those of the next one
    heads = stored(rows.groupBy("b").agg(F.max(F.struct("doc_id", F.struct("text").alias("t"))).alias("h")).select("b", F.col("h.t.text").alias("head")), "heads")
    link = following(heads.select(F.col("b").alias("k"))).select(F.col("k").alias("b"), F.col("nxt").alias("c"))
    hits = heads.select("b", "head", F.explode(hashes("head")).alias("h")).join(F.broadcast(known), "h")
    first = hits.groupBy("b", "head").agg(F.sort_array(F.collect_list(F.when(F.col("h") != 0, F.col("h")))).alias("own"))
    first = first.select(F.col("b").alias("c"), "head", listed("own", F.sha2("head", 256)).alias("head_fp"))
    bridge = stored(link.join(first, "c").select("b", "head", "head_fp"), "bridge")
    w = Window.partitionBy("b").orderBy(F.desc("doc_id"), F.desc("text"))
    n, third = F.length("text"), F.floor(F.length("text") / 3)
    rows = rows.withColumn("pos", F.row_number().over(w)).withColumn("after", F.lead("text").over(w)).join(bridge.select("b", "head"), "b")
    edited = F.concat(F.substring("text", F.lit(1), (n - third).cast("int")), F.substring(F.coalesce("after", "head"), F.lit(1), third.cast("int")))
    rows = rows.select("b", "pos", "doc_id", "text", n.cast("long").alias("n_chars"), edited.alias("edited"))
    facts = F.struct("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.sha2("text", 256).alias("text_sha256"))
    none = F.lit(None).cast("struct<doc_id:bigint,n_chars:bigint,edited_sha256:string,text_sha256:string>")
    own = lambda side: F.transform(terms(F.col(("text", "edited")[side])), lambda h: F.struct(F.lit(side).alias("side"), h.alias("h"), none.alias("facts")))
    one = F.array(F.struct(F.lit(2).alias("side"), F.lit(0).cast("long").alias("h"), facts.alias("facts")))
    exploded = rows.select("b", "pos", F.explode(F.concat(own(0), own(1), one)).alias("e")).select("b", "pos", "e.side", "e.h", "e.facts")
    kept = lambda side: F.sort_array(F.collect_list(F.when(F.col("side") == side, F.col("h"))))
    found = exploded.join(F.broadcast(known), "h").groupBy("b", "pos").agg(kept(0).alias("own"), kept(1).alias("cut"), F.max("facts").alias("f"))
    found = found.select("b", "pos", "f.doc_id", "f.n_chars", "f.edited_sha256", listed("own", F.col("f.text_sha256")).alias("fp"), listed("cut", F.col("f.edited_sha256")).alias("efp"))
    # all of this is still dealt by block: the next fingerprint is the following row's, or the next block's first
    found = found.withColumn("nfp", F.lead("fp").over(Window.partitionBy("b").orderBy("pos"))).join(bridge.select("b", "head_fp"), "b")
    found = found.withColumn("nfp", F.coalesce("nfp", "head_fp"))
    found = with_likeness(found, {"near_edited": ("fp", "efp"), "near_next": ("fp", "nfp")})
    lists = F.concat_ws(",", "fp").alias("fingerprint"), F.concat_ws(",", "efp").alias("edited_fingerprint")
    return found.select("doc_id", "n_chars", "edited_sha256", *lists, "near_edited", "near_next")
