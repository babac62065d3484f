"""Operator 12 (native): URL filters by cascades of Bloom filters.

A list of keys is held as a cascade.  Level 0 is a Bloom filter of the listed keys; level 1
one of the keys of the corpus that pass level 0 without being listed; level 2 one of the
listed keys that pass level 1, and so on until a level lets nothing false through.  As the
levels are fitted to the complete key universe of the corpus (every key that any of its
urls will ask for), the answers are exact for it, and a url is judged from the filters
alone: no list is joined to the pages.

Rules are (host, path, verdict); a rule fits its host and all subdomains where the url's
path starts with the rule's.  The keys a url asks for are host suffixes with path prefixes
of the rules' shapes (number of host labels, length of path), longest first, so the first
key that a cascade holds is the longest rule that fits; of equally long ones that with the
longer host wins, and ``block`` where one key has both verdicts.  A url that no rule fits is
judged by the method: ``block`` if its host is on a list of hosts, a third cascade, else
``allow``.  The list is made from the corpus: hosts of which a label has a word of ``TERMS``.

Filters are made by aggregation and shipped as literals of at most ``PART`` bits.  A list
that needs more is cut by hash into as many cascades as it takes, each applied in a pass of
its own; no key is left out.  Everything is DataFrame functions.

A null url, or one without ``://``, has an empty host and path, fits no rule and is
allowed.  Rules and page rows may repeat; a null in a rule's host or path is empty, and
such a rule fits nothing, as an empty host is no host.  Further columns play no part.  An
empty table gives no rows; without rules the list alone decides.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from benchscope.llm.common import stored

ALLOW, BLOCK = "allow", "block"
#: (host, path, verdict), the rules of the contract.
RULES = (
    ("com", "/", ALLOW),
    ("example.com", "/en/", BLOCK),
    ("www.example.com", "/en/", ALLOW),
    ("net", "/es/", BLOCK),
    ("net", "/fr/", BLOCK),
)
#: Words of a host's labels that put it on the list of hosts.
TERMS = ("ads", "spam", "casino", "adult", "porn", "xxx", "pills", "bets", "betting", "viagra", "malware", "phishing")
#: The most bits of a filter; 1 MB as a literal.
PART = 1 << 23
#: False positives that a level may let through, as a share of the keys it holds.
LEFT = 1 / 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty if it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def rule_frame(spark: SparkSession, rules: tuple = RULES) -> DataFrame:
    """The rules as a frame (host, path, verdict)."""
    rows = F.array(*(F.struct(*(F.lit(x).cast("string").alias(n) for n, x in zip(("host", "path", "verdict"), r))) for r in rules))
    frame = spark.range(1).select(F.inline(rows if rules else F.lit(None).cast("array<struct<host:string,path:string,verdict:string>>")))
    return frame.select("host", "path", "verdict")


# ---------------------------------------------------------------- cascades


@dataclass(frozen=True)
class Level:
    """A Bloom filter: ``k`` hashes of a key, seeded by the level, into ``m`` bits."""

    seed: int
    k: int
    m: int
    words: tuple[int, ...]

    @staticmethod
    def places(key: Column, seed: int, k: int, m: int) -> tuple[Column, callable]:
        seeds = F.sequence(F.lit(seed), F.lit(seed + k - 1))
        return seeds, lambda s: F.pmod(F.xxhash64(key, s), F.lit(m).cast("long"))

    def passes(self, key: Column) -> Column:
        """Whether all the key's bits are set; looks no further than the first that is not."""
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")  # folded to one literal
        seeds, place = self.places(key, self.seed, self.k, self.m)

        def is_set(s):
            at = place(s)
            return F.getbit(F.get(words, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1

        return F.forall(seeds, is_set)


def level_of(keys: DataFrame, number: int, n: int, share: float) -> Level:
    """A filter of the ``n`` keys that lets ``share`` of the other keys through."""
    k = max(1, math.ceil(-math.log2(share)))
    m = max(64, 64 * math.ceil(n * k / math.log(2) / 64))
    seed = number * 100
    seeds, place = Level.places(F.col("key"), seed, k, m)
    bits = keys.select(F.explode(F.transform(seeds, place)).alias("at"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(F.lit(63)).cast("int"))
    rows = bits.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).collect()  # m / 64 at most
    words = dict((r.word, r.bits) for r in rows)
    return Level(seed, k, m, tuple(words.get(i, 0) for i in range(m // 64)))


@dataclass(frozen=True)
class Cascade:
    """Alternate levels of listed keys and false positives; exact on the universe it was made for."""

    levels: tuple[Level, ...]

    def holds(self, key: Column) -> Column:
        answer = F.lit(len(self.levels) % 2 == 1)
        for number, level in reversed(list(enumerate(self.levels))):
            answer = F.when(~level.passes(key), F.lit(number % 2 == 1)).otherwise(answer)
        return answer


def cascade(listed: DataFrame, universe: DataFrame, n: int, universe_size: int) -> Cascade:
    """The cascade of ``listed`` (distinct ``key``, ``n`` of them) over the keys of ``universe``.

    ``universe_size`` may be an estimate: it sets the size of level 0, not the answers.
    """
    if not n:
        return Cascade(())
    levels = [level_of(listed, 0, n, min(0.5, LEFT * n / max(1, universe_size)))]
    passing = universe.where(levels[0].passes(F.col("key"))).select("key", F.lit(False).alias("is_listed"))
    both = passing.unionByName(listed.select("key", F.lit(True).alias("is_listed"))).groupBy("key").agg(F.bool_or("is_listed").alias("is_listed"))
    both = stored(both, "passing")
    held, others = both.where("is_listed").select("key"), both.where("not is_listed").select("key")
    while n := others.count():
        levels.append(level_of(others, len(levels), n, LEFT))
        held, others = others, stored(held.where(levels[-1].passes(F.col("key"))), "passing")
    return Cascade(tuple(levels))


def cascades(listed: DataFrame, universe: DataFrame) -> list[Cascade]:
    """The cascades of a list, one for each part of it by hash of the key; none of an empty one."""
    listed = stored(listed.select("key").where("key is not null").distinct(), "listed")
    n = listed.count()
    if not n:
        return []
    size = universe.agg(F.approx_count_distinct("key")).first()[0]
    bits = n * -math.log2(min(0.5, LEFT * n / max(1, size))) / math.log(2)
    parts = math.ceil(bits / PART)
    mine = lambda df, i: df.where(part_of(F.col("key"), parts) == i) if parts > 1 else df
    out = []
    for i in range(parts):
        own = mine(listed, i)
        out.append(cascade(own, mine(universe, i), n if parts == 1 else own.count(), size // parts))
    return out


def part_of(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(parts).cast("long"))


def marked(rows: DataFrame, asked: str, made: list[Cascade], name: str) -> DataFrame:
    """``rows`` with the column ``name``: the keys of the array ``asked`` that are listed."""

    def of_part(i: int):
        return lambda k: (part_of(k, len(made)) == i) & made[i].holds(k) if len(made) > 1 else made[i].holds(k)

    out = rows.withColumn(name, F.array().cast("array<string>"))
    for i in range(len(made)):
        out = out.withColumn(name, F.concat(name, F.filter(asked, of_part(i))))
        if len(made) > 1:
            out = stored(out, "marked")
    return out


# ---------------------------------------------------------------- judging


def asked_keys(shapes: list[tuple[int, int]]) -> Column:
    """The keys that a url of ``host`` and ``path`` asks for, longest first, then longer host first."""
    if not shapes:
        return F.array().cast("array<string>")
    given = F.array(*(F.struct(F.lit(a).alias("labels"), F.lit(b).alias("chars")) for a, b in shapes))
    fits = F.filter(given, lambda s: (F.col("host") != "") & (F.col("n_labels") >= s["labels"]) & (F.length("path") >= s["chars"]))

    def key(s):
        suffix = F.call_function("substring_index", F.col("host"), F.lit("."), -s["labels"])
        whole = F.concat(suffix, F.substr(F.col("path"), F.lit(1), s["chars"]))
        return F.struct((-F.length(whole)).alias("size"), (-F.length(suffix)).alias("host_size"), whole.alias("key"))

    return F.transform(F.array_sort(F.transform(fits, key)), lambda k: k["key"])


def listed_hosts(hosts: DataFrame, terms: tuple[str, ...] = TERMS) -> DataFrame:
    """(key) the hosts of which a label has one of ``terms`` between its ends, hyphens and digits."""
    pattern = rf"(^|[.0-9-])({'|'.join(terms)})([.0-9-]|$)"
    return hosts.where(F.col("host").rlike(pattern) if terms else F.lit(False)).select(F.col("host").alias("key"))


def judge(pages: DataFrame, rules: DataFrame | None = None, terms: tuple[str, ...] = TERMS) -> DataFrame:
    """``pages`` and the columns host, path, rule, verdict, listed; a page's column of such a name is replaced."""
    names = pages.columns
    plain = pages.toDF(*(f"c{i}" for i in range(len(names))))
    host, path = host_and_path(F.col(f"c{names.index('url')}").cast("string"))
    rows = plain.withColumns({"host": host, "path": path}).withColumn("n_labels", labels(F.col("host")))
    rules = rules if rules is not None else rule_frame(pages.sparkSession)
    known = rules.select(F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host <> ''")
    known = stored(known.distinct(), "rules")
    shapes = [(r.a, r.b) for r in known.select(labels(F.col("host")).alias("a"), F.length("path").alias("b")).distinct().collect()]
    rows = rows.withColumn("asked", asked_keys(shapes)).withColumn("own", F.array("host"))
    urls = rows.select("host", "asked")
    universe = urls.select(F.explode("asked").alias("key"))
    hosts = urls.select("host").where("host <> ''")
    key = F.concat("host", "path").alias("key")
    for name, verdict in (("blocks", BLOCK), ("allows", ALLOW)):
        rows = marked(rows, "asked", cascades(known.where(F.col("verdict") == verdict).select(key), universe), name)
    rows = marked(rows, "own", cascades(listed_hosts(hosts.distinct(), terms), hosts.select(F.col("host").alias("key"))), "on_list")
    hit = lambda name, order, verdict: F.transform(name, lambda k: F.struct(F.array_position("asked", k).alias("at"), F.lit(order).alias("order"), F.lit(verdict).alias("verdict"), k.alias("rule")))
    rows = rows.withColumn("best", F.array_min(F.concat(hit("blocks", 0, BLOCK), hit("allows", 1, ALLOW))))
    listed = F.size("on_list") > 0
    verdict = F.coalesce("best.verdict", F.when(listed, F.lit(BLOCK)).otherwise(F.lit(ALLOW)))
    made = [F.col("host"), F.col("path"), F.col("best.rule").alias("rule"), verdict.alias("verdict"), listed.alias("listed")]
    kept = [F.col(f"c{i}").alias(n) for i, n in enumerate(names) if n not in ("host", "path", "rule", "verdict", "listed")]
    return rows.select(*kept, *made)


def allowed(pages: DataFrame, rules: DataFrame | None = None, terms: tuple[str, ...] = TERMS) -> DataFrame:
    """The pages that are not blocked, with their own columns."""
    at = pages.columns.index("url")
    plain = pages.toDF(*(f"p{i}" for i in range(len(pages.columns)))).withColumn("url", F.col(f"p{at}"))
    done = judge(plain, rules, terms).where(F.col("verdict") == ALLOW)
    return done.select(*(f"p{i}" for i in range(len(pages.columns)))).toDF(*pages.columns)


def verdicts(pages: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page, by the contract's rules."""
    return judge(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")
