"""Operator 4 (native): line de-duplication with a log-template tree.

Every line is parsed down a tree of fixed depth: first by its number of tokens, then by
its leading tokens, numbers counting as one token.  All positions of a line are looked at,
however long it is.  A leaf holds any number of templates: its
different lines are grouped by bands of positions, one band more than a template may have
fields, so that all lines of a template agree in a band.  In each group the tokens are
counted; where one holds at least half of the group's lines the group's template has that
token, elsewhere a variable field.  Of the templates a line meets it takes that of the
largest group.  A line takes a template if it has the fixed token at
``agree`` of all positions (of fewer than ten: at all of them), or at three quarters of
them for lines of ``long`` tokens, where chance plays no part; as the leaf fixes the
leading tokens, every field lies behind these.  Any other line is a template of its own,
numbers counting as one token; where tokens without a letter are the greater part, the
numbers count as they are.

A template recurs if at least ``docs`` documents hold it (``short_docs`` for lines of
fewer than ``short`` tokens, which meet by chance).  A document of which recurring lines
are the smaller part loses them all.  A document that mostly consists of recurring lines
is itself a copy; there a recurring line stays in the first such document (smallest id)
and is dropped from the others, so no text is lost with all of its copies.  A line of
``long`` tokens or more that meets none of this recurs from two documents on, if it is the
same or has the token of its template at ``agree`` of all positions; it stays in the
document of the smallest id.

All of it is DataFrame operations: counts are aggregated before they are shuffled and no
line's text is shuffled.  A line's tokens move only if its leaf holds different lines of
different documents, a text only if it loses lines: a bitmap of the keys that are asked for
(``may_be``) leaves out the others, and an exact join follows.

Null texts and rows with a null doc_id pass unchanged.  Empty lines are no templates and
stay, unless every other line of the text goes; then the text becomes empty.  Rows that
repeat an id and text are one document and get the same result; rows of one id with
different texts are different documents.  Further columns are kept, whatever their names;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchscope.llm.common import stored

DEPTH = 3
LONG, LOOSE = 16, 4
DOCS, SHORT_DOCS, SHORT, AGREE = 3, 10, 8, 0.9
#: Rows of a bitmap that is broadcast; lines up to which a band is counted in one place.
WORDS, FEW = 1 << 18, 1000
LETTER = r"\p{L}"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def cut(docs: DataFrame) -> DataFrame:
    """(d, th, pos, line) of every line that holds more than blanks; ``d`` is the id, ``th`` the text's hash."""
    one = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))
    lines = one.select("d", "th", F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    return lines.withColumn("line", F.trim("line")).where(F.col("line") != "")


def split_up(lines: DataFrame) -> DataFrame:
    """Lines with their tokens ``t``, numbers masked."""
    return lines.withColumn("t", F.split(F.regexp_replace("line", r"[0-9]+", "0"), r"\s+"))


def parsed(docs: DataFrame, agree: float = AGREE) -> DataFrame:
    """(d, th, pos, n, leaf, exact) of every line with a token.

    ``leaf`` is null for lines that take no template but their own.  No tokens are kept: few
    lines need them, see ``probed``.
    """
    lines = split_up(cut(docs)).withColumn("n", F.size("t"))
    # the tree's path, the whole line, and the tokens with a letter
    lead = F.xxhash64("n", F.slice("t", 1, DEPTH))
    lettered = F.size(F.filter("t", lambda x: x.rlike(LETTER)))
    lines = lines.select("d", "th", "pos", "n", lead.alias("leaf"), "line", F.xxhash64("t").alias("exact"), (lettered * 2 >= F.col("n")).alias("wordy"))
    leaf = F.when(F.col("wordy") & (fields(agree) > 0), F.col("leaf"))
    return lines.select("d", "th", "pos", "n", leaf.alias("leaf"), F.when(F.col("wordy"), F.col("exact")).otherwise(F.xxhash64("line")).alias("exact"))


def probed(docs: DataFrame, kinds: DataFrame) -> DataFrame:
    """``kinds`` with ``probes``, the hashes of all tokens of the line that each names by (d, th,
    pos), odd ones of tokens with a letter.  Texts are read again, only these lines are split up."""
    lines = split_up(may_be(cut(docs), kinds, "d", "th", "pos").where("may").drop("may"))
    token = lambda x: F.hash(x).bitwiseAND(F.lit(-2)) + x.rlike(LETTER).cast("int")
    lines = lines.select("d", "th", "pos", F.transform("t", token).alias("probes"))
    return kinds.join(lines, ["d", "th", "pos"]).dropDuplicates(["d", "th", "pos"]).drop("d", "th", "pos")


def may_be(rows: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    """``rows`` and a flag ``may``: true for all whose columns ``on`` are in ``keys``, and for few others.

    Only a bitmap of the keys' hashes is broadcast, ``WORDS`` rows of 64 bits at most however
    many keys there are, so that the other rows need no shuffle to be left out.
    """
    h = F.xxhash64(*on)
    word = F.pmod(h, F.lit(WORDS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 58).cast("int"))
    bits = keys.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    return rows.withColumn("word", word).join(F.broadcast(bits), "word", "left").withColumn("may", F.coalesce(F.col("bits").bitwiseAND(bit) != 0, F.lit(False))).drop("word", "bits")


def fields(agree: float) -> Column:
    """How many positions of a line of ``n`` tokens may be fields."""
    most = F.floor(F.col("n") * (1 - agree) + 1e-9)
    return F.when(F.col("n") >= LONG, F.greatest(F.lit(LOOSE), most)).otherwise(most)


def templates(docs: DataFrame, lines: DataFrame, agree: float = AGREE) -> DataFrame:
    """(exact, of_leaf, near) of the lines that take a template of their leaf; ``near`` is false
    where that has more fields than ``agree`` allows."""
    # leaves and bands that hold different lines and could recur; the others need no template
    leafy = lines.where("leaf is not null")
    leaves = leafy.groupBy("leaf").agg(F.min("exact").alias("a"), F.max("exact").alias("z"), F.min("d").alias("lo"), F.max("d").alias("hi"))
    leaves = stored(leaves.where("a < z and lo < hi").select("leaf"), "leaves", "zstd")
    some = may_be(leafy, leaves, "leaf").where("may").groupBy("leaf", "exact")
    some = some.agg(F.count(F.lit(1)).alias("c"), F.min("d").alias("lo"), F.max("d").alias("hi"), F.first("n").alias("n"), F.min(F.struct("d", "th", "pos")).alias("at"))
    some = stored(some.join(leaves, "leaf", "left_semi").select("leaf", "exact", "c", "lo", "hi", "n", "at.*"), "some", "zstd")
    kinds = stored(probed(docs, some), "kinds", "zstd")
    step = (fields(agree) + 1).cast("int")
    members = lambda b: F.transform(F.sequence(b, F.col("n") - 1, step), lambda i: F.get("probes", i))
    bands = F.transform(F.sequence(F.lit(0), step - 1), lambda b: F.xxhash64("leaf", b, members(b)))
    banded = kinds.select("leaf", "exact", "n", "c", "lo", "hi", F.explode(bands).alias("band"))
    # bands of the same lines give the same template: one of them is enough, and a line's
    # tokens join those that are left
    banded = banded.join(mixed(banded, "band"), "band")
    banded = banded.select(F.col("same").alias("band"), "leaf", "exact", "c", "total", "kinds").distinct()
    banded = stored(banded.join(kinds.select("leaf", "exact", "n", "probes"), ["leaf", "exact"]), "bands", "zstd")
    # a band of few lines is counted where its lines are put together, one of many is dealt out by its tokens
    takes = taken(banded.where(F.col("kinds") <= FEW).repartition("band"), agree).unionByName(taken(banded.where(F.col("kinds") > FEW), agree))
    return takes.groupBy("exact").agg(F.max(F.struct("total", "of_leaf", "near")).alias("of")).select("exact", "of.of_leaf", "of.near")


def taken(banded: DataFrame, agree: float) -> DataFrame:
    """(exact, total, of_leaf, near): the templates that the lines of a band take."""
    tokens = banded.select("band", "c", "total", F.posexplode("probes").alias("i", "token")).groupBy("band", "i", "token").agg(F.sum("c").alias("c"), F.first("total").alias("total"))
    fixed = tokens.where(F.col("c") * 2 >= F.col("total")).groupBy("band", "i").agg(F.max_by("token", F.struct("c", "token")).alias("token"))
    rule = fixed.groupBy("band").agg(F.sort_array(F.collect_list(F.struct("i", "token"))).alias("rule"))  # as many entries as the line has tokens
    same = F.size(F.filter("rule", lambda e: F.get("probes", e["i"]) == e["token"]))
    takes = banded.join(rule, "band").where(F.size("probes") - same <= fields(agree))
    near = same >= F.ceil(F.size("probes") * agree)
    return takes.select("exact", "total", F.xxhash64("leaf", "rule").alias("of_leaf"), near.alias("near"))


def mixed(rows: DataFrame, key: str) -> DataFrame:
    """(key, total, kinds, same) of the groups of different lines that could recur; groups of the same
    lines of a leaf share ``same``."""
    marks = [F.bit_xor("exact").alias("x"), F.bit_xor(F.xxhash64("exact")).alias("y")]
    groups = rows.groupBy(key).agg(F.count(F.lit(1)).alias("kinds"), F.sum("c").alias("total"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.first("leaf").alias("at"), *marks)
    groups = groups.where((F.col("kinds") > 1) & (F.col("lo") < F.col("hi")))
    return groups.select(key, "total", "kinds", F.xxhash64("at", "kinds", "total", "x", "y").alias("same"))


def drops(docs: DataFrame, least: int = DOCS, short_docs: int = SHORT_DOCS, short: int = SHORT, agree: float = AGREE) -> DataFrame:
    """(d, th, pos) of the lines that go."""
    lines = stored(parsed(docs, agree), "lines", "zstd")
    general = stored(templates(docs, lines, agree), "general", "zstd")
    # only lines that two documents hold or that take a template can go
    twice = lines.groupBy("exact").agg(F.min(F.struct("d", "th")).alias("lo"), F.max(F.struct("d", "th")).alias("hi")).where("lo < hi")
    wanted = stored(twice.select("exact").unionByName(general.select("exact")), "wanted", "zstd")
    named = may_be(lines, wanted, "exact").where("may").join(general, "exact", "left")
    close = F.when(F.col("near"), F.col("of_leaf")).otherwise(F.col("exact"))
    named = stored(named.select("d", "th", "pos", "n", F.coalesce("of_leaf", "exact").alias("template"), close.alias("close")), "named", "zstd")
    held = named.select("template", "n", "d", "th").distinct().groupBy("template").agg(F.count(F.lit(1)).alias("held"), F.min("n").alias("n"))
    recurring = stored(held.where(F.col("held") >= F.when(F.col("n") < short, F.lit(short_docs)).otherwise(F.lit(least))).select("template"), "recurring")
    marked = stored(named.join(recurring, "template").select("template", "d", "th", "pos", "n"), "marked", "zstd")
    part = marked.groupBy("d", "th").agg(F.sum("n").alias("part"))
    whole = lines.groupBy("d", "th").agg(F.sum("n").alias("whole"))
    copies = stored(part.join(whole, ["d", "th"]).where(F.col("part") * 2 > F.col("whole")).select("d", "th"), "copies")
    inside = marked.drop("n").join(copies, ["d", "th"])
    first = inside.groupBy("template").agg(F.min(F.struct("d", "th")).alias("first"))
    stay = inside.join(first, "template").where(F.struct("d", "th") == F.col("first")).select("d", "th", "pos")
    # the long lines of the others, from two documents on
    rest = named.where(F.col("n") >= LONG).join(recurring, "template", "left_anti").select("close", F.struct("d", "th").alias("at"), "pos")
    pairs = rest.groupBy("close").agg(F.min("at").alias("first"), F.max("at").alias("last")).where("first < last")
    again = rest.join(pairs, "close").where(F.col("at") != F.col("first")).select("at.d", "at.th", "pos")
    return marked.select("d", "th", "pos").join(stay, ["d", "th", "pos"], "left_anti").unionByName(again)


def dedup_lines(docs: DataFrame, least: int = DOCS, short_docs: int = SHORT_DOCS, short: int = SHORT, agree: float = AGREE) -> DataFrame:
    """``docs`` with recurring lines dropped from ``text``, and the columns n_lines, n_dropped."""
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    text, key = (f"c{names.index(c)}" for c in ("text", "doc_id"))
    gone = drops(docs.select("doc_id", "text"), least, short_docs, short, agree)
    per = gone.distinct().groupBy("d", "th").agg(F.sort_array(F.collect_list("pos")).alias("gone"))  # one text's lines
    per = stored(per, "gone", "zstd")
    # only texts that lose lines move to meet them
    both = may_be(plain.withColumn("d", F.col(key).cast("long")).withColumn("th", F.xxhash64(text)), per, "d", "th")
    whole = both.where(~F.col("may")).withColumn("gone", F.lit(None).cast("array<int>"))
    both = whole.unionByName(both.where("may").join(per, ["d", "th"], "left"))
    # only texts that lose lines are split, once, in a projection of their own: below it is
    # read by two expressions, so the optimiser does not move it into the lambda
    both = both.withColumn("ls", F.when(F.col("gone").isNotNull(), lines_of(F.col(text))))
    kept = F.array_except(F.sequence(F.lit(0), F.size("ls") - 1), F.col("gone"))
    both = both.withColumn("left", F.when(F.col("gone").isNotNull(), F.transform(kept, lambda i: F.get("ls", i))))
    clean = F.when(F.col("gone").isNull(), F.col(text)).when(F.exists("left", lambda x: F.trim(x) != ""), F.array_join("left", "\n")).otherwise(F.lit(""))
    n_lines = F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1)
    n_dropped = F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone"))
    out = both.select(*(clean.alias(c) if c == text else F.col(c) for c in plain.columns), n_lines.alias("n_lines"), n_dropped.alias("n_dropped"))
    return out.toDF(*names, "n_lines", "n_dropped")
