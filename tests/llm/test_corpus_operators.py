"""Operators 1, 3, 4 and 6 against brute force, and the pipeline built from them."""

import math
import random
import zlib

import numpy as np
import pytest

from benchscope.llm import ann, line_dedup, near_dup, toxicity

# ---------------------------------------------------------------- 1


def word_sets(rows, k):
    out = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    return out


def brute_components(rows, k, percent=80):
    sets = word_sets(rows, k)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)):
                common = len(a & b)
                if 100 * common >= percent * (len(a) + len(b) - common):
                    x, y = root(i), root(j)
                    parent[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), root(i), root(i) == i) for i in ids)


def found(df, k):
    return sorted(map(tuple, near_dup.near_duplicates(df, k).select("doc_id", "n_shingles", "component_id", "kept").collect()))


@pytest.mark.parametrize("k", [2, 5])
def test_components_of_documents(docs, k):
    assert found(docs, k) == brute_components([(r.doc_id, r.text) for r in docs.collect()], k)


def test_borderline_copies_and_edge_cases(frame):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(4000)]
    rows, i = [], 0
    for group in range(12):  # chains of edits around the threshold
        base = [rng.choice(words) for _ in range(rng.choice([12, 60, 300]))]
        for _ in range(14):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 14))):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((i, " ".join(t)))
            i += 1
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "One"), (1004, "oNE"), (1005, "É one"), (1006, "é one"), (1007, "a b c"), (1008, "A B C")]
    want = brute_components(rows, 2)
    assert found(frame(rows + [(None, "One"), rows[3], rows[3]]), 2) == want
    assert found(frame([]), 2) == []


def test_a_large_group_of_near_copies(frame):
    """More members than one node compares exhaustively."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(3000)}" for _ in range(80)]
    rows = []
    for i in range(150):
        t = list(base)
        for _ in range(rng.randint(1, 6)):
            t[rng.randrange(len(t))] = f"z{rng.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    rows += [(i, rows[i % 3][1]) for i in range(150, 250)]
    want = brute_components(rows, 2)
    assert found(frame(rows), 2) == want
    for depths in (0, 2):  # nodes that are cut into blocks, at once or after branching
        got = near_dup.near_duplicates(frame(rows), 2, small=4, cap=40, depths=depths)
        assert sorted(map(tuple, got.collect())) == want
    # groups over a number of shingles are cut too: a task holds about that many
    got = near_dup.near_duplicates(frame(rows), 2, small=4, items=400)
    assert sorted(map(tuple, got.collect())) == want


def test_groups_are_cut_by_shingles(spark):
    members = spark.createDataFrame([(g, c, n) for g, size, n in ((1, 5, 10), (2, 40, 100), (3, 1, 9000)) for c in range(size)], "group long, cid long, n long")
    cut = near_dup.by_items(members, 1000).collect()
    assert sum(r.group == 1 for r in cut) == 5
    sizes, held = {}, {}
    for r in cut:
        sizes[r.group] = sizes.get(r.group, 0) + r.n
        held.setdefault(r.group, set()).add((r.cid, r.n))
    assert max(v for k, v in sizes.items() if not any(n == 9000 for _, n in held[k])) <= 2000
    heavy = [{c for c, n in v if n == 100} for v in held.values()]
    assert all(any({x, y} <= h for h in heavy) for x in range(40) for y in range(40))


def test_long_chain_of_links(spark):
    n = 300
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001)], "a long, b long")
    got = dict(map(tuple, near_dup.components(links).collect()))
    assert got == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 1001: 1000}


# ---------------------------------------------------------------- 3

def brute_nearest(rows, k=10):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    out = {}
    for i in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def searched(df, **more):
    out = {}
    for r in sorted(ann.search(df, **more).collect()):
        assert r["rank"] == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def test_small_tables_are_exact(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    assert searched(df) == brute_nearest([(r.vec_id, r.embedding) for r in df.collect()])


def test_recall_over_a_larger_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want, got = brute_nearest([(r.vec_id, r.embedding) for r in df.collect()]), searched(df, sample=1000)
    assert want.keys() == got.keys()
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want]
    assert np.mean(hits) >= 0.9


def test_common_vectors_ties_and_unusable_ones(spark):
    rng = np.random.default_rng(8)
    good = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(1, 150)]
    good += [(i, [1.0, 1.0, 1.0, 1.0]) for i in range(200, 420)] + [(500, [0.0, -0.0, 1.0, 1.0]), (501, [-0.0, 0.0, 1.0, 1.0])]
    good = [(i, v) for i, v in good if any(v)]
    bad = [(600, None), (700, [0.0] * 4), (800, [1.0, None, 2.0, 3.0]), (900, [1.0, math.nan, 2.0, 3.0]), (1000, [math.inf, 1.0, 1.0, 1.0]), (1100, []), (1200, [1.0, 2.0]), (None, [1.0, 2.0, 3.0, 4.0])]
    rows = [(i, v, 5.0) for i, v in good + good[:9] + bad]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score double")
    assert searched(df) == brute_nearest(good)
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert searched(few) == {0: [(1, 0.0), (2, math.sqrt(2))]}
    assert ann.search(df.limit(0)).count() == 0


# ---------------------------------------------------------------- 4

PASSAGE = " ".join(f"passage{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60))
LICENSE = "this text may be used under the usual license number {} of the year {}"


def lined(df, **more):
    return {r.doc_id: r for r in line_dedup.dedup_lines(df, **more).collect()}


def test_recurring_lines_go_and_clean_ones_stay(frame):
    word = lambda *x: "".join("abcdefghij"[int(c)] for c in "".join(f"{y:02d}" for y in x))
    own = lambda i, n: [" ".join(word(i, j, k) for k in range(15)) for j in range(n)]
    clean = {i: own(i, 6) for i in range(10)}
    rows = {i: list(v) for i, v in clean.items()}
    for i in range(4):
        rows[i].insert(i, PASSAGE)
    for i in range(3, 9):
        rows[i].append(LICENSE.format(i, 2000 + i))
    for i in range(10):
        rows[i].insert(2, "ok.")  # short lines of ten documents recur
        rows[i].append("Fine then." if i < 5 else f"so {i}")  # in five they are chance
    copy = own(99, 8)
    for i in (50, 51, 52):
        rows[i] = list(copy)
    rows[53] = [*copy[:7], copy[7].replace(word(99, 7, 13), "changed")]
    got = lined(frame([(i, "\n".join(v)) for i, v in rows.items()]))
    for i in range(10):
        tail = ["Fine then."] if i < 5 else [f"so {i}"]
        want = clean[i] + tail
        assert [x for x in got[i].text.split("\n")] == want, i
    assert got[50].text == "\n".join(copy) and got[50].n_dropped == 0
    assert got[51].text == got[52].text == got[53].text == ""
    assert got[51].n_dropped == got[51].n_lines == 8


def test_lines_that_only_start_alike_stay(frame):
    word = lambda *x: "".join("abcdefghij"[int(c)] for c in "".join(f"{y:02d}" for y in x))
    rows = [(i, f"I want to {word(i, 1)} {word(i, 2)}\n" + " ".join(str(i * 8 + k) for k in range(8)) + f"\nWe saw it the {word(i, 3)} {word(i, 4)} {word(i, 5)} {word(i, 6)}") for i in range(12)]
    got = lined(frame(rows))
    assert all(got[i].text == t for i, t in rows)
    # the same row of numbers is the same line
    assert [r.n_dropped for r in lined(frame([(i, "1 2 3 4 5 6 7 8\n" + rows[i][1]) for i in range(3)])).values()] == [1, 1, 1]


def test_a_leaf_holds_several_templates(frame):
    word = lambda *x: "".join("abcdefghij"[int(c)] for c in "".join(f"{y:02d}" for y in x))
    notice = ["this text was written by {} for the readers of our weekly paper", "this text was found by {} in the attic of an old house", "this text was taken from a book that {} had lent to one of the other people here last year or before"]
    own = lambda i, n: [" ".join(["this", "text", "was", *(word(i, n, j, k) for k in range(n))]) for j in range(4)]
    rows = {i: [*own(i, 9), *own(i, 19)] for i in range(15)}
    clean = {i: "\n".join(v) for i, v in rows.items()}
    for i, v in rows.items():
        v.insert(3, notice[i % 3].format(word(i, 77)))
    got = lined(frame([(i, "\n".join(v)) for i, v in rows.items()]))
    assert {i: r.text for i, r in got.items()} == clean


def test_a_long_line_of_two_documents_stays_in_the_first(frame):
    word = lambda *x: "".join("abcdefghij"[int(c)] for c in "".join(f"{y:02d}" for y in x))
    own = lambda i, n=15: "\n".join(" ".join(word(i, j, k) for k in range(n)) for j in range(4))
    both = " ".join(word(7, 7, k) for k in range(12))  # too short to recur in two
    near = PASSAGE.replace("passagebe", "another")
    got = lined(frame([(1, own(1)), (2, f"{PASSAGE}\n{both}\n{own(2)}"), (3, f"{own(3)}\n{near}\n{both}"), (4, own(4, 20)), (5, f"{own(4, 20)}\n{own(5)}")]))
    assert {i: r.text for i, r in got.items()} == {1: own(1), 2: f"{PASSAGE}\n{both}\n{own(2)}", 3: f"{own(3)}\n{both}", 4: own(4, 20), 5: own(5)}


def test_line_edge_cases(frame, spark):
    many = [(i, "shared line of a good many tokens, more than eight of them\n\nown " + str(i) * 3) for i in range(4)]
    rows = [*many, many[0], (9, None), (10, ""), (11, "\n\n"), (None, many[0][1]), (12, "long " * 20000)]
    df = frame(rows)
    out = line_dedup.dedup_lines(df)
    assert out.columns == [*df.columns, "n_lines", "n_dropped"]
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.text or "", r.count if not callable(r.count) else r["count"]) for r in out.collect())
    assert [x[0] for x in got] == [-1, 0, 0, 1, 2, 3, 9, 10, 11, 12]
    texts = {i: t for i, t, _ in got}
    assert texts[-1] == many[0][1] and texts[11] == "\n\n" and len(texts[12]) == 100000
    # the shared line is most of each of the four: it stays in the first
    assert "shared" in texts[0] and not any("shared" in texts[i] for i in (1, 2, 3))
    assert line_dedup.dedup_lines(frame([])).count() == 0
    clash = spark.createDataFrame([(1, "a", 1, 2, 3)], "doc_id long, text string, d int, th int, gone int")
    assert [tuple(r) for r in line_dedup.dedup_lines(clash).collect()] == [(1, "a", 1, 2, 3, 1, 0)]


def test_lines_of_documents_against_exact_counts(docs):
    """Every line of at least eight tokens that three documents share is left in one at most."""
    before, after = {}, {}
    got = lined(docs)
    for r in docs.collect():
        for line in set(r.text.split("\n")):
            before.setdefault(line, set()).add(r.doc_id)
        for line in set(got[r.doc_id].text.split("\n")):
            after.setdefault(line, set()).add(r.doc_id)
    shared = [x for x, v in before.items() if len(v) >= 3 and len(x.split()) >= 8]
    assert shared and all(len(after.get(x, ())) <= 1 for x in shared)


# ---------------------------------------------------------------- 6

def test_label_model_recovers_voters():
    """Votes drawn from a known model, two of the voters copies of one another."""
    rng = np.random.default_rng(2)
    y = rng.random(20000) < 0.15
    fire = {0: (0.6, 0.01), 1: (0.5, 0.02), 2: (0.4, 0.005), 3: (0.3, 0.3)}
    votes = np.zeros(len(y), np.int64)
    for k, (p1, p0) in fire.items():
        hit = rng.random(len(y)) < np.where(y, p1, p0)
        votes |= hit.astype(np.int64) << k
        if k == 3:  # correlated noise: says nothing, and twice
            votes |= hit.astype(np.int64) << 4
    votes |= (votes == 0).astype(np.int64) << 15
    v, n = np.unique(votes, return_counts=True)
    q = toxicity.label_model(v, n, np.full(len(v), -1))
    assert q[0b00111] > 0.99 and q[1 << 15] < 0.1
    assert abs(q[0b11001] - q[0b00001]) < 0.25
    assert np.mean((q[votes] > 0.5) == y) > 0.93


@pytest.fixture(scope="module")
def labelled(spark):
    base = "/root/testdata/sf0.1"
    return spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")


def test_toxic_documents_held_out(labelled):
    docs, labels = labelled
    got = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    held = [(got[r.doc_id], r.toxic) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(r.held_out and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r, _ in held)
    tp = sum(r.predicted and t for r, t in held)
    assert tp / sum(t for _, t in held) > 0.85 and tp / sum(r.predicted for r, _ in held) > 0.9


def test_labels_of_held_out_rows_are_not_used(labelled):
    docs, labels = labelled
    from benchscope.llm.common import crc_fold
    some = docs.where("doc_id < 600")
    flipped = labels.withColumn("toxic", (1 - labels.toxic)).where(crc_fold() == 2).unionByName(labels.where(crc_fold() != 2))
    a, b = ({r.doc_id: r.score for r in toxicity.score(some, x).collect()} for x in (labels, flipped))
    assert a == b


def test_words_are_mined_from_all_labels(frame, spark):
    word = lambda *x: "".join("abcdefghij"[int(c)] for c in "".join(f"{y:03d}" for y in x))
    df = frame([(i, " ".join(word(i, k) for k in range(12)) + (" zorblaxid" if i % 10 == 0 else "")) for i in range(400)])
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(400)], "doc_id long, toxic int")
    mined = toxicity.fit(df, labels, sample=4).mined
    assert len(mined) and np.array_equal(mined, toxicity.fit(df, labels).mined)


def test_toxicity_edge_cases(frame, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    df = frame([(1, None), (2, ""), (3, "you are a stupid idiot and a moron"), (4, "a calm text"), (4, "a calm text"), (5, "w " * 30000)])
    got = [(r.doc_id, r.predicted) for r in toxicity.score(df, none).collect()]
    assert sorted(got) == [(1, 0), (2, 0), (3, 1), (4, 0), (4, 0), (5, 0)]
    odd = spark.createDataFrame([(1, None), (3, 1), (3, 0), (3, 1), (None, 1)], "doc_id long, toxic int")
    assert toxicity.score(df, odd).count() == 6
    assert toxicity.score(frame([]), odd).count() == 0


# ---------------------------------------------------------------- pipeline

def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as cp
    sf = "/root/testdata/sf0.001"
    names = [n for n, _ in cp.STAGES]
    assert names == ["toxicity", "line_dedup", "near_dedup", "secret_scan", "best_fit_packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r.doc_id for r in out.select("doc_id").collect()}
        if name != "best_fit_packing":
            assert out.columns == columns
            assert all(r.n_chars == len(r.text) for r in out.collect())
        if name == "near_dedup":
            rows = [(r.doc_id, r.text) for r in docs.collect()]
            assert kept[name] == {i for i, _, _, keep in brute_components(rows, 5) if keep}
        if name == "secret_scan":
            from benchscope.llm import secrets
            assert secrets.scan(out).where("size(spans) > 0").count() == 0
            assert kept[name] == kept["near_dedup"]
        docs = out
    assert kept["best_fit_packing"] == kept["secret_scan"]
    assert {r.doc_id for r in cp.run(spark, sf).select("doc_id").collect()} == kept["best_fit_packing"]


def test_stages_take_odd_rows(frame):
    import corpus_pipeline as cp
    df = frame([(1, None), (2, ""), (3, "same text of some words here"), (4, "same text of some words here"), (4, "same text of some words here"), (None, "no id"), (None, "no id")])
    spark = df.sparkSession
    out = cp.drop_near_duplicates(spark, df, "")
    assert out.columns == df.columns
    assert sorted((r.doc_id or 0) for r in out.collect()) == [0, 0, 1, 2, 3]
    assert cp.mask_secrets(spark, df, "").count() == 7 and cp.drop_lines(spark, df, "").count() == 7
    assert cp.pack_sequences(spark, df.limit(0), "").count() == 0


def test_a_text_of_many_lines_takes_linear_time(frame):
    """Half of 50,000 lines recur; the text is split once, not once a line."""
    lines = [f"own {i}" if i % 2 else "these very words stand in every document of this corpus again" for i in range(50_000)]
    out = line_dedup.dedup_lines(frame([(j, "\n".join(lines)) for j in range(3)])).orderBy("doc_id").collect()
    assert [r.n_lines for r in out] == [50_000] * 3
    assert out[1].n_dropped >= 25_000 and "every document" not in out[1].text


def test_pattern_votes_skip_no_match():
    """The search for what a match must hold leaves none out, whatever the case of its letters."""
    rng = random.Random(6)
    bits = ["you", "YOU are", "du", " ", " ", ".", "IDIOT", "ıdiot", "ſtupid", "dumm", "DÉBILE", "die", "yourselves", "Kill", "yourself", "shut", "up", "go to hell", "i hate you", "a**", "b#", "x@$y", "x"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(8)))
        plain = (1 << 12 if toxicity._ADDRESS.search(text) else 0) | (1 << 13 if toxicity._MASKED.search(text) else 0)
        assert toxicity.pattern_votes(text) == plain


def test_every_position_of_a_long_line_counts(frame):
    """Lines that agree at every 16th part of their length but nowhere else are no template;
    lines that differ in a tenth of their tokens, wherever these are, are one."""
    n = 40
    looked = {i * n // 16 for i in range(16)}
    apart = [" ".join(f"same{chr(97 + i % 26)}{i}x" if i in looked else f"{w}{chr(97 + i % 26)}w" for i in range(n))
             for w in ("alpha", "beta", "gamma", "delta")]
    field = [" ".join("abcd"[j] * 9 if i in (11, 13, 14, 16) else f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(n))
             for j in range(4)]
    own = ["Quiet rivers run", "Tall ships sail", "Old men whistle", "Young birds sing"]
    more = [" ".join(f"{o.split()[0]}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(50)) for o in own]
    out = line_dedup.dedup_lines(frame([(j, apart[j] + "\n" + more[j]) for j in range(4)]))
    assert [r.n_dropped for r in out.collect()] == [0, 0, 0, 0]
    out = line_dedup.dedup_lines(frame([(j, field[j] + "\n" + more[j]) for j in range(4)]))
    assert [r.n_dropped for r in out.collect()] == [1, 1, 1, 1]


def test_line_tokens_are_written_small(spark, frame, monkeypatch):
    written, stored = {}, line_dedup.stored

    def seen(df, what, *codec):
        out = stored(df, what, *codec)
        written.setdefault(what, []).extend(out.inputFiles())
        return out

    monkeypatch.setattr(line_dedup, "stored", seen)
    lines = [f"a shared line of words with the number {i} in it and some more words here" for i in range(3)]
    assert line_dedup.dedup_lines(frame([(j, "\n".join(lines)) for j in range(3)])).count() == 3
    for what in ("lines", "kinds", "bands"):
        assert written[what] and all(".zstd." in f for f in written[what])


def test_tokens_and_texts_move_only_where_lines_recur(spark, frame, monkeypatch):
    written, stored = {}, line_dedup.stored

    def seen(df, what, *codec):
        written.setdefault(what, []).append(stored(df, what, *codec))
        return written[what][-1]

    monkeypatch.setattr(line_dedup, "stored", seen)
    # a leaf each for 40 lines of one document, one leaf of different lines of three documents
    own = [f"{chr(97 + j % 26)}{chr(97 + j // 26)} own words of this text alone" for j in range(40)]
    notice = "dear reader of this page we thank {} for all the letters that came in"
    docs = [(j, own[j]) for j in range(40)] + [(50 + j, notice.format(w) + "\n" + own[j].upper() + " and more" * 6) for j, w in enumerate(["anna", "bert", "carl"])]
    out = {r.doc_id: r for r in line_dedup.dedup_lines(frame(docs)).collect()}
    assert "probes" not in written["lines"][0].columns and written["lines"][0].count() == 46
    assert written["kinds"][0].count() == 3 and "probes" in written["kinds"][0].columns
    assert written["gone"][0].count() == 3 and [out[50 + j].n_dropped for j in range(3)] == [1, 1, 1]
    assert all(out[j].text == own[j] and out[j].n_dropped == 0 for j in range(40))


def test_a_bitmap_leaves_out_no_key(spark, monkeypatch):
    rows, keys = spark.range(5000).selectExpr("id as k", "id as v"), spark.range(0, 5000, 50).selectExpr("id as k")
    for words in (line_dedup.WORDS, 1):  # one row of bits: full, but right
        monkeypatch.setattr(line_dedup, "WORDS", words)
        out = line_dedup.may_be(rows, keys, "k")
        assert out.columns == ["k", "v", "may"] and out.count() == 5000
        assert out.where("may").join(keys, "k").count() == 100
        assert words == 1 or out.where("may").count() < 200
    assert line_dedup.may_be(rows, keys.limit(0), "k").where("may").count() == 0


def test_bands_of_few_and_of_many_lines_give_the_same(frame, monkeypatch):
    notice = "dear reader of this page we thank {} for all the letters that came in"
    docs = [(j, notice.format("xyzw"[j % 4] * (j + 1)) + f"\n{'pqrs'[j % 4] * (j + 2)} is a line that only text {j} has") for j in range(8)]
    found = []
    for few in (line_dedup.FEW, 0):
        monkeypatch.setattr(line_dedup, "FEW", few)
        found.append({r.doc_id: (r.text, r.n_dropped) for r in line_dedup.dedup_lines(frame(docs)).collect()})
    assert found[0] == found[1] and sum(n for _, n in found[0].values()) == 7  # the first copy keeps it
