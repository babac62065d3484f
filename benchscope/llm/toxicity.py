"""Operator 6: toxicity by weak supervision.

Sixteen voters look at a text: lexicons of several languages, words mined from labelled
rows, one and two words with mined stems, text patterns, and one that votes when nothing
was found.
The votes of all learning documents are counted by vote pattern (at most 2 ** 16).  A
generative model with a hidden class explains the counts: expectation maximisation
estimates how often each voter fires in either class, then voters whose votes still
depend on each other within a class are joined, and each joint group gets a table of its
own, so correlated voters are not counted as independent evidence.  Its posterior labels
train a linear classifier over hashed words, word stems and votes; the classifier scores
every document.

Labels come only from rows that are not held out.  Mining and the labelled vote counts use
all of them; the classifier is fitted on the driver on at most ``FITTED`` labelled rows,
taken by a hash of the id.  The vote counts cover all learning documents.

Null and empty texts are scored as texts without words.  Repeated labels of one
document count once (toxic if any says so); null labels teach nothing.  Without labelled
rows the general lexicons alone vote.  Repeated rows are each scored; further columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benchscope.llm.common import arrow_map, chunks, crc_fold, stored
from benchscope.llm.near_dup import mix, shingle_sets
from benchscope.llm.wordcache import LETTER, char_classes, code_points, span_hashes

#: Most labelled rows that the classifier is fitted on.
FITTED = 8_000
BUCKETS = 1 << 17
STEM = 5
#: Lengths of the stems that are mined.
STEMS = range(4, 9)
PREDICT_AT = 0.3

#: General words of contempt and abuse, one lexicon a voter.
LEXICONS = (
    "idiot idiots moron morons imbecile imbeciles cretin cretins dimwit dimwits halfwit halfwits dumbass dumbasses dunce nitwit retard retards retarded fool fools buffoon clown clowns loser losers",
    "stupid dumb worthless pathetic disgusting idiotic moronic brainless useless contemptible despicable repulsive revolting vile filthy hideous ugly laughable subhuman inferior",
    "trash garbage scum scumbag scumbags vermin parasite parasites filth pig pigs rat rats cockroach cockroaches maggot maggots degenerate degenerates pest dirtbag lowlife lowlifes",
    "fuck fucks fucking fucked fucker fuckers motherfucker shit shitty bullshit bitch bitches bastard bastards asshole assholes dick dickhead prick cunt cunts whore slut sluts crap damn",
    "idioten dumm dummkopf blöd blödmann trottel depp arschloch scheiße scheiß wichser hurensohn abschaum dreckskerl versager widerlich ekelhaft erbärmlich wertlos müll missgeburt schwachkopf vollidiot",
    "idiote idiots imbécile crétin débile abruti connard connasse salaud salope merde putain ordure minable pathétique dégoûtant stupide bouffon racaille vermine",
    "idiota idiotas imbécil estúpido estúpida tonto tonta pendejo cabrón puta puto mierda gilipollas basura escoria patético asqueroso inútil payaso maldito cerdo bastardo",
)
_INSULTS = ("idiot", "moron", "stupid", "dumb", "pathetic", "worthless", "disgusting", "trash", "scum", "loser", "clown", "fool", "hate", "shut up", "go die", "kill yourself", "dumm", "débile", "idiota")
_ADDRESS = re.compile(rf"\b(?:you|you're|you are|ur|du|ihr|tu|vous|eres|sois)\b[^.\n]{{0,24}}\b(?:{'|'.join(_INSULTS)})", re.I)
_MASKED = re.compile(r"\b[a-z][*#@$]{2,}[a-z]*\b|\b(?:kill|die|hang)\s+(?:yourself|yourselves)\b|\bshut\s+up\b|\bgo\s+to\s+hell\b|\bi\s+hate\s+you\b", re.I)
# What a match of either must hold; the four letters are those that re.I equates with ASCII ones.
_MARKS, _PAIR, _MASKED_WORDS, _LETTERS = "*#@$", re.compile(r"[*#@$]{2}"), ("yoursel", "shut", "hell", "hate"), "\u0130\u0131\u017f\u212a"


def pattern_votes(text: str) -> int:
    """The votes of the two patterns; each is searched only where all its matches could be."""
    low, odd = text.lower(), any(c in text for c in _LETTERS)
    address = odd or any(w in low for w in _INSULTS)
    masked = odd or any(w in low for w in _MASKED_WORDS) or (any(c in text for c in _MARKS) and _PAIR.search(text))
    return (1 << 12 if address and _ADDRESS.search(text) else 0) | (1 << 13 if masked and _MASKED.search(text) else 0)


VOTERS = 16


@dataclass
class Words:
    """The distinct words of some texts: text number, hash, and where an example stands."""

    cp: np.ndarray
    owner: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> Words:
        _, cp, bounds = code_points([t.lower() + " " for t in texts])
        letter = char_classes()[np.minimum(cp, 0x10FFFF)] == LETTER
        edge = np.flatnonzero(np.diff(np.concatenate([[0], letter.view(np.int8), [0]])))
        start, end = edge[::2], edge[1::2]
        owner = np.searchsorted(bounds, start, side="right") - 1
        h = span_hashes(cp, start, end) & ~np.uint64(1)
        order = np.lexsort((h, owner))
        owner, h = owner[order], h[order]
        first = np.ones(len(h), bool)
        first[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
        at = order[first]
        return cls(cp, owner[first], h[first], start[at], (end - start)[at])

    def stems(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Which words have more than ``n`` letters, and the hash of their first ``n``."""
        long = np.flatnonzero(self.size > n)
        h = span_hashes(self.cp, self.start[long], self.start[long] + n)
        return long, h ^ np.uint64(n << 1) | np.uint64(1)  # the last bit tells stems from words


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of the words and stems that the classifier weighs."""
    long, stems = words.stems(STEM)
    owner, hashes = np.concatenate([words.owner, words.owner[long]]), np.concatenate([words.hash, stems])
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    first = np.ones(len(owner), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    return owner[first], hashes[first]


def word_hashes(words: str) -> np.ndarray:
    return Words.of([words]).hash


def within(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Place of each hash in sorted keys, -1 where it is none."""
    if not len(keys):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, at, -1)


@dataclass
class Model:
    """Voters, label model and classifier, as far as they are fitted."""

    mined: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    posterior: np.ndarray | None = None  # by vote pattern
    weights: np.ndarray | None = None

    def __post_init__(self) -> None:
        word = self.mined & np.uint64(1) == 0
        group = (self.mined >> np.uint64(8)) % np.uint64(3)
        sets = [word_hashes(x) for x in LEXICONS] + [self.mined[word & (group == k)] for k in range(3)]
        pairs: dict[int, int] = {}
        for k, s in enumerate(sets):
            for h in s.tolist():
                pairs[h] = pairs.get(h, 0) | 1 << k
        self.keys = np.array(sorted(pairs), np.uint64)
        self.bits = np.array([pairs[h] for h in self.keys.tolist()], np.int64)
        self.stems = np.sort(self.mined[~word])

    def votes(self, texts: list[str], words: Words) -> np.ndarray:
        """The vote pattern of each text, bit k for voter k."""
        n = len(texts)
        at = within(self.keys, words.hash)
        hit = np.flatnonzero(at >= 0)
        out = np.zeros(n, np.int64)
        np.bitwise_or.at(out, words.owner[hit], self.bits[at[hit]])
        stemmed = np.zeros(len(words.hash), bool)
        for k in STEMS if len(self.stems) else ():
            long, h = words.stems(k)
            stemmed[long[within(self.stems, h) >= 0]] = True
        by_stem = np.bincount(words.owner[stemmed], minlength=n)
        by_word = np.bincount(words.owner[hit], minlength=n)
        out |= np.where(by_stem >= 1, 1 << 10, 0) | np.where(by_stem >= 2, 1 << 11, 0) | np.where(by_word >= 2, 1 << 14, 0)
        out |= np.array([pattern_votes(t) for t in texts], np.int64)
        return out | np.where(out == 0, 1 << 15, 0)

    def score(self, texts: list[str]) -> np.ndarray:
        words = Words.of(texts)
        owner, hashes = features(words)
        return sigmoid(linear(self.weights, owner, buckets(hashes), self.votes(texts, words), len(texts)))


def buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(20)).astype(np.int64) % BUCKETS


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def linear(w: np.ndarray, owner: np.ndarray, at: np.ndarray, votes: np.ndarray, n: int) -> np.ndarray:
    """Hashed features count 1 / sqrt(their number), votes 1, and a constant."""
    size = np.bincount(owner, minlength=n)
    own = np.bincount(owner, weights=w[at], minlength=n) / np.sqrt(np.maximum(size, 1))
    bits = (votes[:, None] >> np.arange(VOTERS)) & 1
    return own + bits @ w[BUCKETS : BUCKETS + VOTERS] + w[-1]


def fit_linear(owner: np.ndarray, at: np.ndarray, votes: np.ndarray, target: np.ndarray, steps: int = 80, rate: float = 0.5, ridge: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft labels by full-batch Adagrad."""
    n, w = len(target), np.zeros(BUCKETS + VOTERS + 1)
    scale = (1 / np.sqrt(np.maximum(np.bincount(owner, minlength=n), 1)))[owner] if len(owner) else np.zeros(0)
    bits = ((votes[:, None] >> np.arange(VOTERS)) & 1).astype(float)
    past = np.full(len(w), 1e-8)
    for _ in range(steps):
        err = (sigmoid(linear(w, owner, at, votes, n)) - target) / n
        grad = np.concatenate([np.bincount(at, weights=err[owner] * scale, minlength=BUCKETS), err @ bits, [err.sum()]])
        grad[:-1] += ridge * w[:-1]
        past += grad**2
        w -= rate * grad / np.sqrt(past)
    return w


def label_model(patterns: np.ndarray, counts: np.ndarray, label: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Posterior of class 1 for every vote pattern.

    ``label`` is -1 where unknown; a known label counts as right with odds 50 to 1.
    """
    bits = ((patterns[:, None] >> np.arange(VOTERS)) & 1).astype(np.int64)
    total = counts.sum()
    known = np.where(label == 1, np.log(50), np.where(label == 0, -np.log(50), 0.0))
    prior = (counts[label == 1].sum() + 1) / (counts[label >= 0].sum() + 10)
    # the last voter only says that the others are silent, which the model knows of them
    groups = [[k] for k in range(VOTERS - 1)]

    def joined(bond: np.ndarray, least: float) -> None:
        for i, j in sorted(((i, j) for i in range(VOTERS - 1) for j in range(i)), key=lambda x: -bond[x]):
            a, b = (next(g for g in groups if k in g) for k in (i, j))
            if bond[i, j] > least and a is not b and len(a) + len(b) <= 6:
                groups.remove(b)
                a += b

    def bonds(weight: np.ndarray) -> np.ndarray:
        p = weight / max(weight.sum(), 1e-9)
        dev = bits - p @ bits
        cov = dev.T @ (dev * p[:, None])
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        return np.abs(cov / sd / sd[:, None]) * min(1.0, weight.sum() / 50)

    joined(bonds(counts.astype(float)), 0.9)  # all but copies of one another, whatever the class
    several = sum(bits[:, g].any(axis=1).astype(int) for g in groups) >= 2
    q = sigmoid(known + np.where(several, 2.0, np.where(bits[:, 15] == 1, -4.0, 0.0)))
    for stage in range(2):
        for _ in range(rounds):
            odds = np.full(len(patterns), np.log(prior / (1 - prior)))
            for g in groups:
                cell = bits[:, g] @ (1 << np.arange(len(g)))
                tables = []
                for weight in (counts * q, counts * (1 - q)):
                    t = np.bincount(cell, weights=weight, minlength=1 << len(g)) + 0.5 / (1 << len(g))
                    tables.append(t / t.sum())
                odds += np.log(tables[0][cell] / tables[1][cell])
            q = sigmoid(odds + known)
            prior = float(np.clip((counts * q).sum() / total, 1e-4, 0.9))
        if stage:
            break
        # what is left of correlation within a class joins voters, at most six to a group
        joined(np.maximum(bonds(counts * q), bonds(counts * (1 - q))), 0.25)
    out = np.full(1 << VOTERS, prior)
    out[patterns] = sigmoid(odds)  # without the known label: the votes alone
    # a pattern's own labels, where it has any, correct what the model says of it
    toxic, clean = (np.bincount(patterns[label == y], weights=counts[label == y], minlength=1 << VOTERS) for y in (1, 0))
    return (2 * out + toxic) / (2 + toxic + clean)


def minima(texts: list[str], words: int = 3) -> np.ndarray:
    """Three minwise hashes of each text's word shingles; 0 for a text without words."""
    hashes, owner = shingle_sets(texts, words)
    n = np.bincount(owner, minlength=len(texts))
    some, out = np.flatnonzero(n), np.zeros((3, len(texts)), np.int64)
    for k in range(3) if len(some) else ():
        least = np.minimum.reduceat(mix(hashes ^ np.uint64(k * 0x9E3779B9)), (np.cumsum(n) - n)[some])
        out[k, some] = least.view(np.int64)
    return out


def unlike(rows: DataFrame) -> DataFrame:
    """(doc_id) of one row of each group of copies and near copies: else the rare words
    of one text that was copied often would look like a sign of its label."""

    def make():
        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = b.column("_t").to_pylist()
            m = np.concatenate([minima(texts[a:z]) for a, z in chunks(texts)], axis=1)
            return pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, m)], ["doc_id", "m0", "m1", "m2"])

        return f

    left = arrow_map(rows.select("doc_id", "_t"), make, "doc_id long, m0 long, m1 long, m2 long")
    for m in ("m0", "m1", "m2"):
        left = left.groupBy(m).agg(F.min(F.struct("doc_id", "m0", "m1", "m2")).alias("s")).select("s.*")
    return left.select("doc_id").distinct()


def fit(docs: DataFrame, labels: DataFrame, sample: int = FITTED) -> Model:
    """Learn from documents and labels that are not held out; the classifier from ``sample`` labelled rows at most."""
    learning = docs.where(crc_fold() != 2).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_t"))
    known = labels.where(crc_fold() != 2).where("toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    # the hints keep one strategy at every size: both tables grow
    known = stored(known, "known")
    rows = stored(learning.join(known.hint("merge"), "doc_id"), "labelled")

    def mine():
        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            texts, toxic = b.column("_t").to_pylist(), np.array(b.column("toxic").to_pylist(), np.int64)
            hashes, owners = [], []
            for a, z in chunks(texts):
                words = Words.of(texts[a:z])
                for where, h in ((np.arange(len(words.hash)), words.hash), *map(words.stems, STEMS)):
                    # a text counts once for each word or stem
                    pair = np.unique(np.stack([words.owner[where].astype(np.uint64), h]), axis=1) if len(h) else np.zeros((2, 0), np.uint64)
                    owners.append(pair[0].astype(np.int64) + a)
                    hashes.append(pair[1])
            g, back = np.unique(np.concatenate(hashes), return_inverse=True)
            y = toxic[np.concatenate(owners)]
            return pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(np.bincount(back, minlength=len(g))), pa.array(np.bincount(back, weights=y, minlength=len(g)).astype(np.int64))], ["hash", "n", "toxic"])

        return f

    # words and stems that stand almost only in toxic texts, by a cautious share
    texts = rows.join(stored(unlike(rows), "unlike").hint("merge"), "doc_id")
    sums = stored(arrow_map(texts.select("_t", "toxic"), mine, "hash long, n long, toxic long").groupBy("hash").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")), "mined")
    base, tests = texts.agg(F.avg("toxic")).first()[0] or 0.0, sums.count()
    # the chance to meet so many toxic texts by the base rate, against the number of words tried
    p0, r = min(max(base, 1e-3), 0.5), F.col("toxic") / F.col("n")
    bits = r * F.log(r / p0) + F.when(r < 1, (1 - r) * F.log((1 - r) / (1 - p0))).otherwise(0.0)
    found = sums.where("2 * toxic > n").where(bits * F.col("n") > float(np.log(max(tests, 1)) + 3)).select("hash").toArrow()  # few pass the test
    model = Model(np.sort(found.column("hash").to_numpy()).view(np.uint64))

    sent = docs.sparkSession.sparkContext.broadcast(model)

    def vote(with_features: bool = False):
        own = sent.value

        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            texts, out, feats = b.column("_t").to_pylist(), [], []
            for a, z in chunks(texts):
                words = Words.of(texts[a:z])
                out.append(own.votes(texts[a:z], words))
                if with_features:
                    owner, hashes = features(words)
                    feats += np.split(buckets(hashes).astype(np.int32), np.searchsorted(owner, np.arange(1, z - a)))
            votes = np.concatenate(out)
            if with_features:
                return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(votes), pa.array([x.tobytes() for x in feats], pa.binary())], ["doc_id", "votes", "at"])
            return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(votes)], ["doc_id", "votes"])

        return f

    key = F.xxhash64("doc_id")
    some = rows.select("doc_id").orderBy(key, "doc_id").limit(sample).distinct()  # a stated bound, so it may be broadcast
    fitted = arrow_map(rows.join(F.broadcast(some), "doc_id", "left_semi").select("doc_id", "_t"), lambda: vote(True), "doc_id long, votes long, at binary")
    local = fitted.orderBy(key, "doc_id").limit(sample).select("votes", "at").collect()
    # every row votes once; the votes, not the texts, meet the labels
    cast = stored(arrow_map(learning.select("doc_id", "_t"), vote, "doc_id long, votes long"), "votes")
    known_votes = cast.join(known, "doc_id").groupBy("votes", "toxic").count().collect()  # at most 2 ** 17 rows
    every = cast.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 2 ** 16 rows
    labelled = {(r["votes"], r["toxic"]): r["count"] for r in known_votes}
    cells = [(v, n, y) for (v, y), n in sorted(labelled.items())]
    cells += [(r["votes"], r["n"] - sum(labelled.get((r["votes"], y), 0) for y in (0, 1)), -1) for r in sorted(every)]
    cells = [c for c in cells if c[1] > 0]
    if not cells:
        model.posterior = np.full(1 << VOTERS, 0.1)
    else:
        model.posterior = label_model(*(np.array(c, np.int64) for c in zip(*cells, strict=True)))
    if local:
        at = [np.frombuffer(r["at"], np.int32) for r in local]
        votes = np.array([r["votes"] for r in local], np.int64)
        owner = np.repeat(np.arange(len(at), dtype=np.int32), [len(x) for x in at])
        model.weights = fit_linear(owner, np.concatenate(at), votes, model.posterior[votes])
    else:  # no labelled row: any vote but the last speaks for class 1
        model.weights = np.concatenate([np.zeros(BUCKETS), np.full(VOTERS - 1, 2.0), [-3.0], [-1.0]])
    return model


def predict(docs: DataFrame, model: Model, at: float = PREDICT_AT) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = sent.value

        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = b.column("_t").to_pylist()
            score = np.concatenate([own.score(texts[a:z]) for a, z in chunks(texts)])
            return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(score), pa.array((score >= at).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

        return f

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(crc_fold() == 2, F.lit(False)).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_t"))
    return arrow_map(base, make, "doc_id long, held_out boolean, score double, predicted int")


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn and score all rows: the whole operator."""
    return predict(docs, fit(docs, labels))


def keep_clean(docs: DataFrame, model: Model, at: float = PREDICT_AT) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, columns unchanged."""
    sent, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")
    ddl = ", ".join(f"`{i}` {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))

    def make():
        own = sent.value

        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or "" for t in b.column(place).to_pylist()]
            clean = np.concatenate([own.score(texts[a:z]) for a, z in chunks(texts)]) < at
            return b.filter(pa.array(clean))

        return f

    return arrow_map(docs.toDF(*map(str, range(len(docs.columns)))), make, ddl).toDF(*docs.columns)
