"""Operators 11 to 13 against plain Python, and their edge cases."""

import itertools
import random
import re
import zlib

import pytest

from benchscope.llm import filter_audit, spelling, url_filter

# ---------------------------------------------------------------- 11


def brute_words(rows):
    counts = {}
    for i, t in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            if i is not None:
                h = zlib.crc32(f"{i}:{run}".encode())
                if h % 31 == 0:
                    run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                counts[run] = counts.get(run, 0) + 1
    return {w: n for w, n in counts.items() if n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute_variants(rows):
    n = brute_words(rows)
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and one_edit(v, w)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=lambda r: r[0])


def found_variants(df, **how):
    rows = spelling.variants(df, **how).select("word", "form", "root", "n", "n_near", "form_n").collect()
    return sorted(map(tuple, rows), key=lambda r: r[0])


def variant_rows(seed):
    """Texts of few letters, so that words have many near words and keys many members."""
    rng = random.Random(seed)
    words = {"".join(rng.choice("abé") for _ in range(rng.choice([7, 7, 8, 9, 12]))) for _ in range(90)}
    words |= {w[:3] + rng.choice("abcÿ") + w[4:] for w in list(words)} | {w[:-1] for w in words} | {"z" + w for w in words}
    rows = []
    for i in range(60):
        text = []
        for w in rng.sample(sorted(words), 40):
            text += [w] * rng.choice([1, 1, 2, 30])
        rows.append((i, rng.choice([" ", "-", "9"]).join(text)))
    return rows


@pytest.mark.parametrize("how", [{}, {"cap": 6, "bucket": 300}, {"cap": 1, "bucket": 50}])
def test_variants_against_all_pairs(frame, how):
    rows = variant_rows(5)
    assert found_variants(frame(rows), **how) == brute_variants(rows)


def test_variants_of_documents(docs):
    assert found_variants(docs) == brute_variants([(r.doc_id, r.text) for r in docs.collect()])


def test_chains_ties_and_odd_rows(frame):
    chain = ["abcdefg"] * 2 + ["abcdefh"] * 20 + ["abcdeeh"] * 200 + ["abcdeh"] * 9
    ties = ["tttttta"] * 50 + ["ttttttb"] * 50 + ["ttttttc"] * 3
    long_word = ["q" * 3000 + "ü"] * 2 + ["q" * 3000] * 30
    rows = [(None, " ".join(chain)), (None, None), (None, ""), (None, "ÀBCDEFG Àbcdefg àbcdefg àbcdefg"), (None, " ".join(ties)), (None, " ".join(long_word)), (4, "Zebrafish" * 1), (4, "Zebrafish")]
    got = found_variants(frame(rows))
    assert got == brute_variants(rows)
    by_word = {r[0]: r for r in got}
    assert by_word["abcdefg"][1:3] == ("abcdefh", "abcdeeh")
    assert by_word["ttttttc"][1] == "tttttta"
    assert found_variants(frame([])) == []
    assert found_variants(frame([(1, "no word twice")])) == []


def test_index_search_is_exact():
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.choice([6, 7, 8]))) for _ in range(150)})
    asked = [w for w in words if len(w) == 7]
    i, j = spelling.search([w.encode() for w in asked], [w.encode() for w in words])
    assert sorted((asked[x], words[y]) for x, y in zip(i, j)) == sorted((a, b) for a in asked for b in words if one_edit(a, b))


# ---------------------------------------------------------------- 12


def brute_verdict(url, rules, terms=url_filter.TERMS):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest).group()
        path = re.match("[^?#]*", rest[len(host):]).group()
        host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if h and host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[3], max(fits)[4]
    listed = any(re.search(rf"(^|[0-9-])({'|'.join(terms)})([0-9-]|$)", label) for label in host.split("."))
    return host, path, None, "block" if listed else "allow"


URLS = [None, "", "no scheme", "http://", "://com/", "https://COM/x", "http://a.com", "http://a.com?x=/", "http://a.com#/", "http://example.com/en/a://b", "http://www.example.com/en/", "http://www.Example.com/en", "http://notexample.com/en/", "http://x.net/es/1", "http://x.net/es", "http://net/fr/", "http://a..net/fr/", "http://.net/es/", "http://casino-win.example.org/", "http://m.casinos.org/", "http://a.net:80/es/", "http://user@a.net/es/", "ftp://ü.org/é?#", "http://7.example.com/EN/\n", "http://w.ads-track.net/en/1", "http://" + "a." * 3000 + "net/fr/" + "x" * 5000]


@pytest.fixture()
def pages(spark):
    def make(urls):
        return spark.createDataFrame([(i, u, "r", "v", 1) for i, u in enumerate(urls)], "page_id long, url string, rule string, c0 string, asked int")
    return make


def test_verdicts_on_edge_cases(pages):
    got = [tuple(r)[1:] for r in url_filter.verdicts(pages(URLS)).orderBy("page_id").collect()]
    assert got == [brute_verdict(u, url_filter.RULES) for u in URLS]
    assert url_filter.verdicts(pages([])).collect() == []


def test_a_long_list_in_several_cascades(spark, pages, monkeypatch):
    rng = random.Random(2)
    hosts = [f"h{rng.randrange(900)}.{rng.choice('abc')}.org" for _ in range(1200)]
    urls = [f"http://{h}/{rng.choice(['x', 'y', 'xy'])}/{i % 7}" for i, h in enumerate(hosts)]
    rules = tuple((h, rng.choice(["/", "/x", "/x/"]), rng.choice(["allow", "block"])) for h in hosts[:400]) + (("org", "/y", "block"),)
    monkeypatch.setattr(url_filter, "PART", 1500)
    made = url_filter.cascades(spark.createDataFrame([(h,) for h in hosts[:500]], "key string"), spark.createDataFrame([(h,) for h in hosts], "key string"))
    assert len(made) > 1
    got = [tuple(r) for r in url_filter.judge(pages(urls), url_filter.rule_frame(spark, rules)).orderBy("page_id").select("host", "path", "rule", "verdict").collect()]
    assert got == [brute_verdict(u, rules) for u in urls]


def test_cascade_is_exact_with_bad_filters(spark, monkeypatch):
    """Filters that let half of everything through need many levels; the answers stay exact."""
    monkeypatch.setattr(url_filter, "LEFT", 0.5)
    universe = spark.range(4000).selectExpr("concat('k', id) AS key")
    listed = spark.range(0, 5000, 9).selectExpr("concat('k', id) AS key")
    one = url_filter.cascade(listed, universe, listed.count(), 1)
    assert len(one.levels) > 3
    held = {r.key for r in universe.where(one.holds(universe.key)).collect()}
    assert held == {f"k{i}" for i in range(0, 4000, 9)}


def test_allowed_pages_keep_their_columns(spark, pages):
    df = pages(URLS)
    out = url_filter.allowed(df)
    assert out.columns == df.columns
    assert [r.page_id for r in out.orderBy("page_id").collect()] == [i for i, u in enumerate(URLS) if brute_verdict(u, url_filter.RULES)[3] == "allow"]
    assert [r.verdict for r in url_filter.judge(df, url_filter.rule_frame(spark, ()), ()).collect()] == ["allow"] * len(URLS)


def test_no_python_in_the_plan(pages):
    plan = url_filter.verdicts(pages(URLS[:3]).selectExpr("page_id", "url"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Join", plan)


# ---------------------------------------------------------------- 13


def brute_audit(rows, labels):
    """rows: (doc_id, text, lang); labels: (doc_id, quality, toxic)."""
    good, bad = ({i for i, *flags in labels if i is not None and flags[k] == 1} for k in (0, 1))
    docs = []
    for i, t, lang in rows:
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        smaller = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": smaller}
        docs.append((lang or "", {k for k, x in fails.items() if x}, i in good, i in bad))
    out = []
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        steps = []
        for order in map("".join, itertools.permutations("ABCDE")):
            for s, letter in enumerate(order, 1):
                gone = [bool(f & set(order[:s - 1])) for _, f, _, _ in mine]
                here = [letter in f for _, f, _, _ in mine]
                removed = [h and not g for h, g in zip(here, gone)]
                steps.append((part, order, s, sum(not h and not g for h, g in zip(here, gone)), sum(removed), sum(h and g for h, g in zip(here, gone)), sum(f == {letter} for _, f, _, _ in mine), sum(r and d[2] for r, d in zip(removed, mine)), sum(r and d[3] for r, d in zip(removed, mine))))
        whole = {x: sum(st[4] for st in steps if st[1][st[2] - 1] == x) for x in "ABCDE"}
        out += [(*st, whole[st[1][st[2] - 1]]) for st in steps]
    return sorted(out)


def found_audit(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, code int, part string")
    return sorted(map(tuple, filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()))


def test_audit_of_documents(spark, docs):
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    labels = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert found_audit(spark, rows, labels) == brute_audit(rows, labels)


def test_audit_on_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "PARTS", 2)  # sums are flushed
    words = " ".join(f"w{i}" for i in range(250))
    rows = [(1, words, "en"), (2, words, "de"), (2, words, "de"), (1, words, "de"), (None, words, "en"), (None, None, None), (3, None, ""), (9, "", "fr"), (4, "\t \x1c\u00a0", "en"), (5, "a " * 300, "en"), (5, "other " * 200, "en"), (6, words + " # AB", "en"), (7, "ÄÖ" * 500 + " A", "x")]
    labels = [(1, 1, 0), (1, None, 1), (2, 0, None), (None, 1, 1), (5, 1, 1), (77, 1, 1), (6, None, None)]
    assert found_audit(spark, rows, labels) == brute_audit(rows, labels)
    assert found_audit(spark, [], []) == []


def test_fields_do_not_overflow():
    code = filter_audit.integers()
    n = (1 << 62) - 1
    total = sum(n * x for x in code[:2])
    assert filter_audit.unpacked(total).tolist() == [n * (a + b) for a, b in zip(*(filter_audit.outcome_fields(m, False, False) for m in (0, 1)))]
