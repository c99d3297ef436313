import random

import re

import corpus_pipeline
from pyspark.sql import functions as F

from quadrille.llm import near_copies, pipeline, quality
from quadrille.llm.common import staged


def test_stages_follow_one_another(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    ids = {r[0] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, "/root/testdata/sf0.001"), "t")
        assert docs.columns == corpus_pipeline.COLUMNS
        assert {r[0] for r in docs.select("doc_id").collect()} <= ids
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert packed.where("piece = 0").count() == docs.count()


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed, n):
    r = random.Random(seed)
    return [f"w{r.randrange(100000)}" for _ in range(n)]


def changed(w, seed, places):
    """places words replaced, far enough apart that each changes five shingles."""
    out = list(w)
    for k in range(places):
        out[10 + 10 * k] = f"x{seed}_{k}"
    return out


def test_near_drops_what_is_similar_by_five_words(spark):
    rows = []
    for i in range(40):  # 296 shingles: 5 changes leave 271, Jaccard 0.844; 7 changes 261, 0.789
        w = words(i, 300)
        rows += [(3 * i, w), (3 * i + 1, changed(w, "a", 5)), (3 * i + 2, changed(w, "b", 7))]
    docs = spark.createDataFrame([(i, " ".join(w), "en", "a", 1) for i, w in rows], DOCS)
    kept = {r[0] for r in pipeline.near(spark, docs, "").select("doc_id").collect()}
    assert kept == {k for i in range(40) for k in (3 * i, 3 * i + 2)}


def test_near_components_do_not_depend_on_chunks(spark):
    rows, base = [], words(1, 200)
    for i in range(60):
        base = changed(base, i, 3) if i % 20 else words(100 + i, 200)
        rows.append((i, " ".join(changed(base, f"y{i}", i % 4)), "en", "a", 1))
    sets = [near_copies.shingles(r[1]) for r in rows]
    label = list(range(60))
    for i in range(60):
        for j in range(i):
            if len(set(sets[i]) & set(sets[j])) / len(set(sets[i]) | set(sets[j])) >= 0.8:
                label = [label[j] if x == label[i] else x for x in label] if label[j] < label[i] else [label[i] if x == label[j] else x for x in label]
    docs = spark.createDataFrame(rows, DOCS)
    for chunk in (4, 2048):
        got = {r.id: r.root_id for r in near_copies.near_copies(docs, "doc_id", F.xxhash64("text"), chunk=chunk).collect()}
        assert got == {i: r for i, r in enumerate(label) if i != r}


def test_near_deals_a_large_component_in_proportion(spark, monkeypatch):
    """200 copies of one text, a chain that leads away from it, and one text that meets the others but resembles none."""
    base = words(1, 300)
    rows = [(i, changed(base, f"c{i}", 1)) for i in range(200)]
    link = base
    for i in range(200, 206):
        link = changed(link, f"d{i}", 4)
        rows.append((i, link))
    rows.append((206, changed(base, "far", 12)))
    docs = spark.createDataFrame([(i, " ".join(w), "en", "a", 1) for i, w in rows], DOCS)
    dealt, write = [], near_copies.staged

    def counted(df, label, *path):
        out = write(df, label, *path)
        if label == "dealt":
            dealt.append(out.count())
        return out

    monkeypatch.setattr(near_copies, "staged", counted)
    sets = {i: set(near_copies.shingles(" ".join(w)).tolist()) for i, w in rows}
    root, open_ = {0: 0}, [0]
    while open_:
        a = open_.pop()
        for b in sets.keys() - root.keys():
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                root[b] = 0
                open_.append(b)
    assert len(root) >= 200
    got = {r.id: r.root_id for r in near_copies.near_copies(docs, "doc_id", F.xxhash64("text"), chunk=8).collect()}
    assert got == {i: 0 for i in root if i}
    assert dealt[0] <= 3 * len(rows) and sum(dealt) <= 8 * len(rows)  # 26 times the rows if each chunk met each


def test_near_keeps_the_other_text_of_a_repeated_id(spark):
    a, b = words(1, 300), words(2, 300)
    rows = [(1, a), (2, changed(a, "a", 2)), (2, b), (3, changed(b, "b", 2))]  # id 2 goes with the first, and stands for the last
    docs = spark.createDataFrame([(i, " ".join(w), "en", "a", 1) for i, w in rows], DOCS)
    kept = {(r.doc_id, r.text) for r in pipeline.near(spark, docs, "").collect()}
    assert kept == {(1, " ".join(a)), (2, " ".join(b))}


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def awkward():
    """Nulls in every column, empty and long texts, rows repeated as a whole, ids repeated with other texts."""
    a, b, c = (" ".join(words(k, 120)) for k in (1, 2, 3))
    rows = [(1, a, "en", "s"), (2, a.replace(" ", "\n "), "en", "s"), (2, b, "en", "s"), (3, b, None, "t"), (3, b, None, "t"), (4, None, None, None), (5, "", "en", None), (5, "", "en", None),
            (None, a, "en", "s"), (None, c, "fr", None), (None, c, "fr", None), (6, " ".join(words(9, 60_000)), "en", "t"), (7, "few words", "en", "t"), (8, "x y z " * 60, "en", "t")]
    return [(*r, 1, 99, "clash") for r in rows]


EXTRA = DOCS + ", content long, id_r string"


def test_exact_stage_against_brute_force(spark):
    rows = awkward()
    got = pipeline.exact(spark, spark.createDataFrame(rows, EXTRA), "")
    assert got.columns == pipeline.COLUMNS
    left = {}
    for r in rows:
        left.setdefault(norm(r[1]), []).append(r[0])
    kept = sorted((norm(r.text), r.doc_id) for r in got.collect() if r.doc_id is not None)
    assert kept == sorted((t, min(i for i in ids if i is not None)) for t, ids in left.items() if any(i is not None for i in ids))
    assert [norm(r.text) for r in got.collect() if r.doc_id is None] == [t for t, ids in left.items() if all(i is None for i in ids)]


def test_quality_stage_against_brute_force(spark):
    rows = awkward()
    got = pipeline.quality(spark, spark.createDataFrame(rows, EXTRA), "")
    assert got.columns == pipeline.COLUMNS

    def good(t):
        w = (t or "").split()
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        again = {k + j for k, x in enumerate(grams) if grams.count(x) > 1 for j in range(3)} if len(w) < 1000 else ()
        return len(w) >= quality.MIN_WORDS and 100 * len(again) <= 50 * len(w)

    key = lambda r: tuple((x is None, x or 0) if k == 0 else str(x) for k, x in enumerate(r[:4]))
    assert sorted(key(r) for r in got.collect()) == sorted(key(r) for r in rows if good(r[1]))  # too few rows for an estimate


def test_stages_take_awkward_rows_and_empty_tables(spark):
    docs = spark.createDataFrame(awkward(), EXTRA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() >= 0
        assert stage(spark, docs.limit(0), "").collect() == []
    near = pipeline.near(spark, docs, "").collect()
    assert sum(r.doc_id is None for r in near) == 3 and sum(r.doc_id == 3 for r in near) == 0 and [r.doc_id for r in near if not r.text] == [4]


def test_near_finds_what_a_search_of_all_pairs_finds(spark):
    """Given documents that are no exact copies, by five-word Jaccard of 0.8 over all pairs that share a shingle."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null").dropDuplicates(["text"])
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    sets = [set(near_copies.shingles(r.text).tolist()) for r in rows]
    label, where = list(range(len(rows))), {}
    for k, s in enumerate(sets):
        for h in s:
            where.setdefault(h, []).append(k)
    pairs = {(i, j) for ks in where.values() for n, i in enumerate(ks) for j in ks[n + 1 :]}
    for i, j in sorted(pairs):
        if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and label[i] != label[j]:
            lo, hi = sorted((label[i], label[j]))
            label = [lo if x == hi else x for x in label]
    expected = {rows[k].doc_id for k, x in enumerate(label) if x != k}
    got = {r.id for r in near_copies.near_copies(docs, "doc_id", F.xxhash64("text")).collect()}
    assert expected and got == expected
