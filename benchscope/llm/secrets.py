"""Operator 2: secret scans through a trigram inverted index.

Each rule's regular expression is read into a Boolean query in disjunctive form: sets of
trigrams of which all must occur wherever the rule matches.  Texts are indexed segment by
segment (a segment is a block of texts of about ``SEGMENT`` characters): trigram -> texts.
Only trigrams that some rule's query names get a posting list, as no other would be read.
Per segment the postings of each clause are intersected, clauses united, and the rule's
expression verifies the candidates over their whole text.  A rule without mandatory
trigrams scans every text.  A segment needs no other one, so nothing is shuffled and a
lost task is repeated alone.

Null texts are empty; empty texts, and an empty table, give no spans.  Repeated rows are
each scanned; further columns are ignored.  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from itertools import product
from re import _constants as sre
from re import _parser as sre_parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benchscope.llm.common import arrow_map, chunks, text_of

SEGMENT = 1_000_000
Query = frozenset  # of frozensets of trigrams; {frozenset()} is "every text"
EVERY: Query = frozenset([frozenset()])


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its expression, and the group whose length must reach ``least``."""

    kind: str
    pattern: str
    flags: int = 0
    group: int = 0
    least: int = 0


# A private key: its header with all up to its END line (no other marker between them) or,
# where END is missing, with the base64 lines that follow, the last of which may be short.
PEM_HEAD = r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY(?: BLOCK)?-----"
PEM_TO_END = r"[^-]*(?:-(?!----)[^-]*)*-----END (?:[A-Z]+ )*PRIVATE KEY(?: BLOCK)?-----"
_BREAK = r"(?:\s|\\[rn])+"  # line ends may be written as escapes
PEM_LINES = (rf"(?:{_BREAK}(?:Proc-Type|DEK-Info):[^\r\n\\]*)*(?:{_BREAK}[A-Za-z0-9+/]{{32,}}={{0,2}}(?![^\s\\]))+"
             rf"(?:{_BREAK}[A-Za-z0-9+/]{{1,31}}={{1,2}}(?![^\s\\])|(?:\r?\n|\\n)[A-Za-z0-9+/]{{1,31}}(?=[^\S\n]*(?:\n|\\|\Z)))?")

#: The first three are the base kinds of the contract; the others add spans.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 0, 16),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{32,}"),  # maximal runs; shorter ones fail the kind's test
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,255}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,250}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("private_key", PEM_HEAD + "(?:" + PEM_TO_END + "|" + PEM_LINES + ")?"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,100}:[^\s/:@]{3,100}@"),
)


def both(a: Query, b: Query) -> Query:
    return least(frozenset(x | y for x, y in product(a, b)))


def either(a: Query, b: Query) -> Query:
    return least(a | b)


def least(q: Query) -> Query:
    """Without clauses that another one implies."""
    return frozenset(x for x in q if not any(y < x for y in q))


def of_strings(strings: list[str]) -> Query:
    return least(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


def few_letters(items: list) -> list[str] | None:
    """The lower-case letters of a small character class."""
    found: set[str] = set()
    for op, arg in items:
        if op is sre.LITERAL:
            found.add(chr(arg).lower())
        elif op is sre.RANGE and arg[1] - arg[0] < 8:
            found.update(chr(c).lower() for c in range(arg[0], arg[1] + 1))
        else:
            return None
    return sorted(found) if len(found) <= 8 else None


def trigram_query(parsed, most: int = 64) -> tuple[Query, list[str] | None]:
    """What an expression demands, and all strings it can match if they are few."""
    query, runs, exact = EVERY, [""], True
    for op, arg in parsed:
        own: list[str] | None = None
        sub: Query = EVERY
        if op is sre.LITERAL:
            own = [chr(arg).lower()]
        elif op is sre.IN:
            own = few_letters(arg)
        elif op is sre.SUBPATTERN:
            sub, own = trigram_query(arg[-1])
        elif op is sre.BRANCH:
            parts = [trigram_query(x) for x in arg[1]]
            own = None if any(s is None for _, s in parts) else [s for _, p in parts for s in p]
            sub = parts[0][0]
            for q, _ in parts[1:]:
                sub = either(sub, q)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, body = arg
            sub, once = trigram_query(body)
            if low == 0:
                sub, own = EVERY, ["", *once] if once is not None and high == 1 else None
            elif once is not None and len(once) ** low <= most and low <= 8:
                own = ["".join(x) for x in product(once, repeat=low)]
                if high != low:  # what follows need not touch the first copies
                    query, runs, exact = both(query, of_strings([a + b for a, b in product(runs, own)])), [""], False
                    continue
        elif op is sre.AT or op in (sre.ASSERT, sre.ASSERT_NOT):
            continue
        if own is not None and len(own) * len(runs) <= most:
            runs = [a + b for a, b in product(runs, own)]
        else:
            query, runs, exact = both(both(query, of_strings(runs)), sub), [""], False
    return both(query, of_strings(runs)), runs if exact else None


def query_of(rule: Rule) -> Query:
    """The rule's trigram query over texts whose A-Z are lower-cased."""
    q = trigram_query(sre_parser.parse(rule.pattern, rule.flags))[0]
    # trigrams beyond ASCII are left out: their case folding differs from that of the index
    q = frozenset(frozenset(t for t in x if t.isascii()) for x in q)
    return EVERY if frozenset() in q else least(q)


class Segment:
    """Posting lists of one block of texts for the trigrams in ``lut``."""

    def __init__(self, texts: list[str], lut: np.ndarray, n_grams: int) -> None:
        raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
        flat = np.frombuffer(b"\0".join(raw) + b"\0\0", np.uint8).astype(np.int32)
        ends = np.cumsum(np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw)))
        gram = lut[flat[:-2] << 16 | flat[1:-1] << 8 | flat[2:]]
        at = np.flatnonzero(gram >= 0)
        pairs = np.unique(gram[at].astype(np.int64) * len(raw) + np.searchsorted(ends, at, side="right"))
        self.texts, self.n = pairs % len(raw), len(raw)
        self.cuts = np.searchsorted(pairs // len(raw), np.arange(n_grams + 1))

    def posting(self, gram: int) -> np.ndarray:
        return self.texts[self.cuts[gram] : self.cuts[gram + 1]]

    def candidates(self, clauses: list[list[int]]) -> np.ndarray:
        """Texts that hold all trigrams of some clause, shortest posting first."""
        found = []
        for clause in clauses:
            lists = sorted((self.posting(g) for g in clause), key=len)
            hit = lists[0]
            for other in lists[1:]:
                if not len(hit):
                    break
                hit = np.intersect1d(hit, other, assume_unique=True)
            found.append(hit)
        return np.unique(np.concatenate(found))


class Scanner:
    """Rules with their trigram queries, ready to scan blocks of texts."""

    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.rules = [(r, re.compile(r.pattern, r.flags)) for r in rules]
        queries = [query_of(r) for r in rules]
        grams = {g: i for i, g in enumerate(sorted({g for q in queries for c in q for g in c}))}
        self.lut = np.full(1 << 24, -1, np.int16)
        for g, i in grams.items():
            a, b, c = g.encode()
            self.lut[a << 16 | b << 8 | c] = i
        self.n_grams = len(grams)
        self.clauses = [None if q == EVERY else [[grams[g] for g in c] for c in q] for q in queries]

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """(start, rule number, end) of the spans of each text, in order."""
        spans: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        segment = Segment(texts, self.lut, self.n_grams)
        for k, ((rule, regex), clauses) in enumerate(zip(self.rules, self.clauses, strict=True)):
            for i in range(len(texts)) if clauses is None else segment.candidates(clauses).tolist():
                spans[i] += [(m.start(), k, m.end()) for m in regex.finditer(texts[i]) if m.end(rule.group) - m.start(rule.group) >= rule.least]
        return [sorted(x) for x in spans]


def scan(df: DataFrame, rules: tuple[Rule, ...] = RULES, column: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(id_column, spans array<struct<kind, start, stop>>) of every row, in order of start, then rule."""
    kind = df.schema[id_column].dataType.simpleString()
    entry = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])

    def make():
        scanner, names = Scanner(rules), [r.kind for r in rules]

        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            texts, out = b.column("_t").to_pylist(), []
            for a, z in chunks(texts, SEGMENT):
                out += [[(names[k], s, e) for s, k, e in x] for x in scanner.scan(texts[a:z])]
            return pa.RecordBatch.from_arrays([b.column("_i"), pa.array(out, pa.list_(entry))], ["_i", "_spans"])

        return f

    got = arrow_map(df.select(F.col(id_column).alias("_i"), text_of(column).alias("_t")), make, f"_i {kind}, _spans array<struct<kind:string,start:bigint,stop:bigint>>")
    return got.select(F.col("_i").alias(id_column), F.col("_spans").alias("spans"))


def masked(text: str, spans: list[tuple[str, int, int]], mask: Callable[[str], str] = "[{}]".format) -> str:
    """The text with each span, overlapping ones joined, replaced by its first kind's mask."""
    out, at = [], 0
    merged: list[list] = []
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if merged and s < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], e)
        else:
            merged.append([kind, s, e])
    for kind, s, e in merged:
        out += [text[at:s], mask(kind)]
        at = e
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, column: str = "text") -> DataFrame:
    """The rows with every span in ``column`` replaced by ``[kind]``; null stays null, no row is dropped."""
    schema, names = docs.schema, [r.kind for r in rules]
    at = docs.columns.index(column)

    def make():
        scanner = Scanner(rules)

        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            texts, out = b.column(at).to_pylist(), []
            for a, z in chunks([t or "" for t in texts], SEGMENT):
                found = scanner.scan([t or "" for t in texts[a:z]])
                out += [t if not x else masked(t, [(names[k], s, e) for s, k, e in x]) for t, x in zip(texts[a:z], found, strict=True)]
            cols = [pa.array(out, pa.string()) if i == at else b.column(i) for i in range(b.num_columns)]
            return pa.RecordBatch.from_arrays(cols, [str(i) for i in range(len(cols))])

        return f

    plain = docs.toDF(*map(str, range(len(docs.columns))))
    ddl = ", ".join(f"`{i}` {f.dataType.simpleString()}" for i, f in enumerate(schema.fields))
    return arrow_map(plain, make, ddl).toDF(*docs.columns)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: counts of the base kinds, hash of the base spans, all spans as text."""
    found = scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    shown = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda x: x["kind"].isin("assign", "access", "hex"))
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")), F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))
