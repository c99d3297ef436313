"""Small tables with nulls, empty texts, ties, repeated rows, no rows and clashing names, against brute force."""

import hashlib
import html as entities
import io
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.llm import chat, common, exact_dedup, html, langid, mixing, packing, quality, simhash, tokenbin, tokens, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, dg_ string, size long, rank_ int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice("the of and thing erst oning anble re tion hand with there place world river stone green".split()) + r.choice(["", "", "s", "ed"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    out = [(i, prose(i, 60 + i), "en", f"s{i % 3}") for i in range(40)]
    out += [(100, None, None, None), (101, "", "en", None), (102, " \n\t", "de", "s0"), (103, prose(3, 63), "en", "s1"), (104, prose(3, 63).replace(" ", "  "), "en", "s1"),
            (None, prose(3, 63), "en", "s2"), (105, prose(7, 6000), "en", "s0"), (5, prose(5, 65), "en", "s2"), (106, "x", "en", "s0"), (107, "Ünï ß " * 30, "de", "s1"), (108, "a b c\na b c\n" * 40, "en", "s1")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "extra", 7, 3) for r in rows], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_tokens_equal_the_library():
    enc = tokens.TextEncoder(tokens.public_path("word_bpe_49k.json"), limit=5000)
    for t in ["", "Hello, world!! don't IT'S x.y a1b2", "Straße ÀÉ ǰ J̌ «Élan», Σίσυφος", "<|endoftext|> K \x85x\xa0y\x1cz ñandú…", "日本語 ﬁ Ⅷ ²", prose(1, 300)]:
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == enc.ids.tokenizer.encode(t, add_special_tokens=False).ids


def test_tokens_hold_no_more_bytes_than_their_bound():
    enc = tokens.TextEncoder(tokens.public_path("word_bpe_49k.json"), limit=1 << 20)
    r = random.Random(4)
    for _ in range(10_000):
        enc.encode("".join(chr(0x4E00 + r.randrange(2000)) for _ in range(40)))
    for k in range(10_000):
        enc.encode(f"w{k}x")
    held = sum(len(w) + len(i) + tokens.ENTRY_BYTES for w, i in enc.ids.items())
    assert held == enc.ids.held <= 1 << 20 and max(map(len, enc.ids)) <= tokens.LONGEST_KEPT


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master, applicationId = "spark://host:7077", "x"

    class Conf:
        get = staticmethod(lambda *_: None)

    class Session:
        sparkContext, conf = Context, Conf

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_root(Session)


def test_exact_dedup(docs, none, rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for r in rows:
        groups.setdefault(norm(r[1]), []).append(r[0])
    got = exact_dedup.exact_dedup(docs).select("doc_id", "text", "keep_id", "group_size", "kept", "text_sha256", "size", "rank_").collect()
    assert len(got) == len(rows)
    for r in got:
        ids = [i for i in groups[norm(r.text)] if i is not None]
        assert (r.keep_id, r.group_size, r.text_sha256) == (min(ids), len(groups[norm(r.text)]), hashlib.sha256(norm(r.text).encode()).hexdigest())
        assert (r.size, r.rank_) == (7, 3)
    assert Counter(norm(r.text) for r in got if r.kept) == Counter(groups.keys())
    light = exact_dedup.exact_dedup(docs, max_winners=1).select("doc_id", "keep_id", "group_size", "kept").collect()
    assert Counter(light) == Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got)
    assert exact_dedup.exact_dedup(none).collect() == []


def test_packing(docs, none, rows, monkeypatch):
    enc = tokens.TextEncoder(tokens.public_path("word_bpe_49k.json"))
    got = packing.best_fit_pack(docs, capacity=512).collect()
    expected = Counter()
    for i, t, *_ in rows:
        ids = enc.encode(t) + (1).to_bytes(4, "little")
        expected.update((i, k, s // 4, len(ids[s : s + 2048]) // 4, zlib.crc32(ids[s : s + 2048])) for k, s in enumerate(range(0, len(ids), 2048)))
    assert Counter(tuple(r[:5]) for r in got) == expected
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    assert len(seqs) <= 1.1 * -(-sum(r.length for r in got) // 512) + 1
    assert packing.best_fit_pack(none).collect() == []
    with monkeypatch.context() as m:  # the same by a sorted shuffle
        m.setattr(packing, "MOST_BROADCAST_COUNTS", 0)
        assert Counter(packing.best_fit_pack(docs, capacity=512).collect()) == Counter(got)


def test_plan_by_patterns_is_tight():
    r = np.random.default_rng(1)
    hist = np.bincount(np.minimum(4096, np.exp(r.normal(6, 1, 400_000)).astype(int) + 1), minlength=4097)
    plan = packing.make_plan(hist, 4096)
    assert plan["fitted"] > 0.8 * plan["sequences"] and plan["sequences"] <= sum(packing.best_fit(hist, 4096)[0])
    assert plan["sequences"] <= 1.001 * -(-int((hist * np.arange(4097)).sum()) // 4096) + 1


def test_mixing(docs, none, rows):
    got = mixing.pareto_mix(docs).collect()
    assert len(got) == len(rows)
    n = Counter()
    for i, t, _, s in rows:
        n[s] += len(WORD.findall(t or ""))
    order = sorted((s for s in n if s is not None)) + [None]
    w = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, capped = sum(n.values()), set()
    while True:
        free = {s for s in n if s not in capped}
        level = (total - sum(3 * n[s] for s in capped)) / sum(w[s] for s in free) if free else 0
        new = {s for s in free if level * w[s] > 3 * n[s]}
        if not new:
            break
        capped |= new
    target = {s: 3 * n[s] if s in capped else level * w[s] for s in n}
    taken = Counter()
    for r in got:
        assert r.source_size == n[r.source] and r.target == pytest.approx(target[r.source]) and r.taken == r.copies * r.size and 0 <= r.copies <= 3
        taken[r.source] += r.taken
    for s in n:
        # Whole copies come as near as half of the smallest document that is left, here at most the largest.
        assert abs(taken[s] - target[s]) <= max(r.size for r in got if r.source == s) / 2
    assert Counter(mixing.pareto_mix(docs).select("doc_id", "taken").collect()) == Counter((r.doc_id, r.taken) for r in got)
    assert mixing.pareto_mix(none).collect() == []


def test_mixing_closes_with_what_is_left_and_takes_weights(spark):
    r = random.Random(8)
    rows = [(i, "a" if i < 300 else "b", r.choice([3, 9, 9, 40, 700, 5000])) for i in range(900)]
    rows += [(1000 + i, "c", 7) for i in range(400)]
    docs = spark.createDataFrame([(i, s, n, 0.25 if i % 2 else 1.0) for i, s, n in rows], "doc_id long, source string, n long, w double")
    for weight in (None, "w"):
        got = mixing.pareto_mix(docs, size_col="n", weight_col=weight).collect()
        for s in "abc":
            mine = [x for x in got if x.source == s]
            assert abs(sum(x.taken for x in mine) - mine[0].target) <= 9
    odd = [x.copies for x in got if x.source == "b" and x.doc_id % 2]
    even = [x.copies for x in got if x.source == "b" and not x.doc_id % 2]
    assert sum(even) / len(even) > sum(odd) / len(odd) + 0.05


def test_langid(spark, none):
    en, fr = "the thing of world river stone green place", "le monde était une rivière très éloignée et verte"
    train = spark.createDataFrame([(i, lang, " ".join(random.Random(i).sample((en if lang == "en" else fr).split(), 6))) for i in range(80) for lang in ("en", "fr")], "key long, lang string, text string")
    model = langid.train_model(train, langid.public_path(langid.VOCABULARY))
    texts = [(1, en), (2, fr), (3, None), (4, ""), (5, "123 ²²!"), (6, "rivière " * 5000), (7, "z" * 3000), (None, en)]
    got = {r[0]: r[1:] for r in langid.identify(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    assert [got[i][0] for i in (1, 2, 3, 4, 5, 6, None)] == ["en", "fr", "und", "und", "und", "fr", "en"]
    assert all(0 <= s <= 1 for _, s in got.values())
    word = "thing"  # all segmentations, by brute force

    def total(s, k):
        return 1.0 if not s else sum((max(p[k], langid.CHAR_FLOOR) if j == 1 else p[k]) * total(s[j:], k) for j in range(1, len(s) + 1) if (p := model.table.get(s[:j], [0, 0])) is not None)

    assert np.allclose(model.forward([word])[0], [np.log(total("▁" + word, k)) for k in range(2)])
    assert np.allclose(model.forward_long(word), model.forward([word])[0])
    empty = langid.train_model(train.limit(0), langid.public_path(langid.VOCABULARY))
    assert [r[1] for r in langid.identify(spark.createDataFrame(texts[:2], "doc_id long, text string"), empty).collect()] == ["und", "und"]
    assert langid.identify(none, model).collect() == []


def test_langid_query_learns_from_part_and_predicts_the_rest(spark):
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = langid.op5_langid(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    known = [r for r in got if r.held_out and docs[r.doc_id].lang and docs[r.doc_id].text]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in known) >= 0.98 * len(known) > 0


def brute_components(rows, fps):
    ids = sorted({i for i in fps if i is not None})
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and any((x ^ y).bit_count() <= 4 for x in fps[a] for y in fps[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash(docs, none, rows):
    got = simhash.simhash_dedup(docs).collect()
    fps = {}
    for r in got:
        fps.setdefault(r.doc_id, set()).add(int(r.fingerprint, 16))
    for i, t, *_ in rows:
        assert simhash.fingerprint(t) in fps[i]
    parts = brute_components(rows, fps)
    assert all(r.component_id == parts[r.doc_id] for r in got if r.doc_id is not None) and len(got) == len(rows)
    assert simhash.simhash_dedup(none).collect() == []
    with pytest.raises(ValueError):
        simhash.simhash_dedup(docs, radius=9)


@pytest.mark.parametrize("chunk", [8, 4096])
def test_links_of_many_near_fingerprints(spark, chunk):
    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(30)]
    marks = sorted({b ^ sum(1 << r.randrange(64) for _ in range(r.randrange(4))) for b in base for _ in range(20)})
    nodes = spark.createDataFrame([(m - (1 << 64) if m >> 63 else m, k) for k, m in enumerate(marks)], "fp long, rep long")
    links = simhash.fingerprint_links(nodes, len(marks), chunk=chunk)
    got = dict(simhash.components(links).collect())
    expected = brute_components(None, {k: {m} for k, m in enumerate(marks)})
    assert {k: got.get(k, k) for k in expected} == expected


@pytest.mark.parametrize("radius", [0, 3, 4, 7, 8, 20])
def test_bit_sliced_distances(radius):
    r = np.random.default_rng(3)
    a = r.integers(0, 1 << 63, 150, dtype=np.uint64)
    for k in range(1, 150):
        if k % 3:
            a[k] = a[k - 1] ^ np.uint64(sum(1 << int(b) for b in r.integers(0, 63, k % 12)))
    expected = {(i, j) for i in range(150) for j in range(i + 1, 150) if (int(a[i]) ^ int(a[j])).bit_count() <= radius}
    assert set(zip(*(x.tolist() for x in simhash.links_by_shift(a, np.zeros(150, int), radius)))) == expected
    assert {(i, j) for x, y in simhash.links_between(a, a, radius) for i, j in zip(x.tolist(), y.tolist()) if i < j} == expected


def test_token_shards(docs, none, rows, tmp_path):
    enc = tokens.TextEncoder(tokens.public_path("word_bpe_49k.json"))
    folder = f"file://{tmp_path}"
    manifest = tokenbin.write_shards(docs, folder, tokens.public_path(tokenbin.VOCABULARY))
    got = sorted(tokenbin.read_shards(manifest, folder).collect(), key=lambda r: r.start)
    ids = {}
    for i, t, *_ in rows:
        ids.setdefault(i, []).append(np.frombuffer(enc.encode(t) + b"\1\0\0\0", "<u4"))
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    at = 0
    for r in got:
        assert r.start == at and (r.n_tokens, r.ids_crc32) in [(len(x), zlib.crc32(x.tobytes())) for x in ids[r.doc_id]]
        at += r.n_tokens
    shard = manifest.orderBy("shard").collect()[-1].path
    found = tokenbin.lookup(f"file://{shard}", iter([108, 999_999]))
    assert found[0].tolist() == ids[108][0].tolist() and found[1] is None
    assert tokenbin.token_shards(none).collect() == []


def test_token_shards_of_large_and_byte_level_vocabularies(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    made = Tokenizer(models.WordLevel({f"w{k}": k for k in range(70000)}, unk_token="w0"))
    made.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    made.save(str(tmp_path / "large.json"))
    text = "w69999 w5  w65536\nand the river"
    for path in (str(tmp_path / "large.json"), tokens.public_path("byte_bpe_50k.json")):
        ids = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids + [tokens.END_ID]
        [got] = tokenbin.token_shards(spark.createDataFrame([(1, text)], "doc_id long, text string"), path).collect()
        assert (got.n_tokens, got.ids_crc32) == (len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)))


def test_perfect_hash():
    keys = np.random.default_rng(0).choice(10**12, 20_000, replace=False)
    assert sorted(tokenbin.PerfectHash.build(keys)(keys).tolist()) == list(range(20_000))


class Counting(io.BytesIO):
    reads, taken = 0, 0

    def read(self, n=-1):
        out = super().read(n)
        self.reads, self.taken = self.reads + 1, self.taken + len(out)
        return out


@pytest.mark.parametrize("n", [1, 500, 50_000])
def test_a_lookup_reads_a_few_short_places(n):
    keys = np.random.default_rng(n).choice(10**12, n, replace=False)
    file = Counting(tokenbin.pack_index(keys, np.arange(n) * 7, np.arange(n) + 1, np.ones(n, int)))
    index = tokenbin.Index(file)
    reads, taken = [], []
    for k in range(0, n, max(1, n // 300)):
        file.reads = file.taken = 0
        assert index.find(int(keys[k])) == (7 * k, k + 1, 1)
        reads.append(file.reads)
        taken.append(file.taken)
    assert max(taken) <= 64 * len(index.levels) + 24 and sum(reads) / len(reads) < 4
    assert all(index.find(-k - 1) is None for k in range(100))
    starts, lengths, _ = index.find_all(np.append(keys, -5))
    assert starts[:-1].tolist() == [7 * k for k in range(n)] and starts[-1] == -1


def test_rows_without_a_key_are_dealt_out(spark, tmp_path):
    many = spark.createDataFrame([(None, f"text {k}") for k in range(4000)], "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = tokenbin.write_shards(many, f"file://{tmp_path}", tokens.public_path(tokenbin.VOCABULARY))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert manifest.count() > 1 and tokenbin.read_shards(manifest, f"file://{tmp_path}").count() == 4000


def test_chat_windows_keep_the_budget_as_written(spark):
    hard = "</turn> <turn \\ " * 40
    rows = [(1, 0, "system", "be brief"), *[(1, t, "user" if t % 2 else "assistant", hard) for t in range(1, 21)], *[(2, t, "user", prose(t, 30 * t)) for t in range(1, 40)]]
    turns = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, window string, mask int")
    enc = tokens.TextEncoder(tokens.public_path("word_bpe_49k.json"))
    windows = chat.format_windows(turns, budget=1024, history=300).collect()
    assert len(windows) > 10
    for w in windows:
        assert len(enc.encode(w.text)) // 4 <= 1024 or w.n_turns - w.new_from <= 1
        before = "".join(chat.format_turn(*t)[0] for t in chat.parse_turns(w.text)[: w.new_from] if t[0] != "system")
        assert len(enc.encode(before)) // 4 <= 300


def test_chat(spark):
    said = r"\### Assistant: </turn> ok"
    rows = [(1, 0, "system", "be brief"), *[(1, t, "user" if t % 2 else "assistant", prose(t, 150)) for t in range(1, 60)], (-7, 0, "user", said), (-7, 1, "assistant", said), (2, 0, None, None), (2, 0, "assistant", "<turn x>\\"),
            (2, None, "assistant", ""), (None, 3, "a>b\n", "tail\\"), (3, 0, "system", "only"), (4, 0, "assistant", prose(9, 5000))]
    windows = chat.format_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r[0]: r[1:] for r in chat.read_back(windows).collect()}
    for key in {r[0] for r in rows}:
        turns = [(r or "", t or "") for _, r, t in sorted(((x[1] if x[1] is not None else -1, x[2] or "", x[3] or "") for x in rows if x[0] == key))]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[key][:4] == (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    many = [w for w in windows.collect() if w.conv_id == 1]
    assert len(many) > 3 and all("be brief" in w.text for w in many) and all(w.new_from > 1 for w in many[1:])
    assert chat.read_back(chat.format_windows(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).collect() == []


def brute_stats(t):
    w = WORD.findall(t or "")
    grams = Counter(zip(w, w[1:], w[2:]))
    again = {i + k for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for k in range(3)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(again)


def test_quality(spark, docs, none, rows):
    stats = quality.with_stats(docs, "text", [F.col("doc_id"), F.col("lang"), F.col("source"), F.col("text")])
    got = quality.quality_rules(stats).collect()
    assert len(got) == len(rows)
    for r in got:
        e = brute_stats(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == e
        assert r.base_failed == (e[0] < 50 or 100 * e[4] > 50 * e[0]) and r.kept == (not r.base_failed)  # too few rows for an estimate
    assert quality.quality_rules(quality.with_stats(none, "text", [F.col("doc_id"), F.col("lang"), F.col("source")])).collect() == []
    good = [(i, prose(i, 80), "en", "a") for i in range(300)]
    junk = [(1000 + i, " ".join(w + "***" for w in prose(i, 80).split()), "en", "a") for i in range(20)]
    both = spark.createDataFrame(good + junk, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality.quality_rules(quality.with_stats(both, "text", [F.col("doc_id"), F.col("lang"), F.col("source")])).collect()}
    assert all(kept[i] for i, *_ in good) and not any(kept[i] for i, *_ in junk)


def test_quality_takes_clashing_names_and_nulls(spark, docs):
    odd = docs.withColumn("n_words", F.lit("mine")).withColumn("words_", F.lit(1)).withColumn("kept", F.lit("old")).withColumn("x0", F.lit("x")).withColumn("g_", F.lit(2))
    stats = quality.with_stats(odd, "text", [F.col(c) for c in ("doc_id", "lang", "source", "n_words", "words_", "kept", "x0", "g_", "text")])
    got = quality.quality_rules(stats).collect()
    assert len(got) == docs.count() and all(r.n_words == len(WORD.findall(r.text or "")) and r.words_ == 1 and r.x0 == "x" and isinstance(r.kept, bool) for r in got)


def test_quality_estimates_each_source_and_finds_the_majority(spark):
    """Sources of other kinds of text each have their own estimate, and two fifths of junk do not move it."""
    rows = []
    for s, (k, tail) in enumerate([(80, ""), (80, "ing")]):
        rows += [(1000 * s + i, " ".join(w + tail for w in prose(1000 * s + i, k).split()), "en", f"s{s}") for i in range(60)]
        rows += [(1000 * s + 500 + i, " ".join("#" + w for w in prose(7000 * s + i, k).split()), "en", f"s{s}") for i in range(40)]
    rows += [(9000 + i, prose(i, 80), "fr", None) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    stats = quality.with_stats(docs, "text", [F.col("doc_id"), F.col("lang"), F.col("source")])
    got = {r.doc_id: r for r in quality.quality_rules(stats, min_group=50).collect()}
    for i, *_ in rows:
        assert got[i].kept == (i >= 9000 or i % 1000 < 500)
        assert got[i].estimate == ("source" if i < 9000 else None)
    assert {r.estimate for r in quality.quality_rules(stats, min_group=150).collect()} == {"language", None}
    assert {r.estimate for r in quality.quality_rules(stats, min_group=210).collect()} == {"all"}


def test_whitening_and_distance_against_numpy(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(400, quality.DIMS)) @ r.normal(size=(quality.DIMS, quality.DIMS))
    rows = spark.createDataFrame([("g", *v) for v in x.tolist()], "g_ string, " + ", ".join(f"x{i} double" for i in range(quality.DIMS)))
    model = quality._regular(quality._moments(rows, "g_"), "g_")
    c = np.cov(x.T, bias=True) / quality.HALF_FACTOR + np.diag(np.square(quality.FLOORS))
    d = x - x.mean(0)
    got = [v[0] for v in rows.join(model, "g_").select(quality.distance()).collect()]
    assert np.allclose(sorted(got), sorted(np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d)))
    assert np.isclose(model.collect()[0].logdet, np.linalg.slogdet(c)[1])


def test_quality_rejects_text_with_a_mark_every_fifth_word(spark):
    good = [(i, prose(i, 80), "en", "a") for i in range(300)]
    marked = [(1000 + i, " | ".join(" ".join(p) for p in zip(*[iter(prose(i, 80).split())] * 4)), "en", "a") for i in range(20)]
    both = spark.createDataFrame(good + marked, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality.quality_rules(quality.with_stats(both, "text", [F.col("doc_id"), F.col("lang"), F.col("source")])).collect()}
    assert all(kept[i] for i, *_ in good) and not any(kept[i] for i, *_ in marked)


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body class="with-sidebar"><header>Top</header>
<nav><ul><li><a href="/x">Menu, one.</a></ul></nav><div class="ad">Buy this, now.</div><%s><h1>Title &amp; more</h1><p><b>First line,
 with   spaces.<br><p>Second &lt;one&gt;, longer text here, with marks.</p><ul><li>Item<li>Other</ul><section id="comments"><p>A reader, long remark, says this and that.</p></section>
<form><p>Mail us, please.</p></form></%s><div class="sidebar">Aside, more.</div><div id="cookie-notice">We use cookies.</div><footer>&copy; x</footer>"""
MAIN = "Title & more\n\nFirst line, with spaces.\n\nSecond <one>, longer text here, with marks.\n\nItem\n\nOther"


@pytest.mark.parametrize("tag", ["article", "main", 'div id="content"', "div"])
def test_html(tag):
    assert html.main_text(PAGE % (tag, tag.split()[0])) == MAIN


def test_html_rows(spark):
    rows = [(1, "u", PAGE % ("main", "main")), (2, None, None), (3, "u", ""), (None, "u", "just text, no tags"), (4, "u", "<p>a < b &am<p x='"), (4, "u", "<" * 5000)]
    got = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int")
    out = html.extract_main_text(got).collect()
    assert [r.page_id for r in out] == [r[0] for r in rows] and out[0].text == MAIN and out[1].text == out[2].text == "" and out[3].text == "just text, no tags"
    assert all(r.n_chars == len(r.text) for r in out) and out[4].text == "a < b &am"


def test_html_ratios_choose_the_nodes(monkeypatch):
    text = "A long text, with marks, and words. It goes on, as texts do."
    cases = [
        (f'<nav>x</nav><div class="social-science-story"><p>{text}</p></div>', text),
        (f'<div id="notice-board-article"><h1>T</h1><p>{text}</p></div>', f"T\n\n{text}"),
        (f'<article><h2 id="menus">Menus of Rome</h2><p>{text}</p><h2 id="related-work">Related</h2><p class="ad-hoc">Ad hoc.</p></article>', f"Menus of Rome\n\n{text}\n\nRelated\n\nAd hoc."),
        (f'<div class="x1"><ul><li><a href=a>Home</a><li><a>News</a><li><a>Sport and more, of it</a></ul></div><div class=c><h1>T</h1><p>{text}</p><p>Short</p></div>', f"T\n\n{text}\n\nShort"),
        (f"<form><div><h1>Title</h1><p>{text}</p></div></form>", f"Title\n\n{text}"),
        (f"<article><p>{text}</p></article><article><p>{text} {text}</p></article>", f"{text}\n\n{text} {text}"),
        (f"<article><h1>T</h1><p>{text}</p><article><p>I think, dear all, that this is wrong.</p></article></article>", f"T\n\n{text}"),
        (f'<h1>T</h1><div class=entry><p>{text}</p></div><div class="x7"><a href=1>One</a> <a href=2>Two</a></div>', f"T\n\n{text}"),
        ('<ul><li><a href="/">Home</a><li><a href="/x">Other</a></ul>', ""),
    ]
    for page, expected in cases:
        assert html.main_text(page) == expected
    monkeypatch.setattr(html, "content_blocks", lambda page: np.ones(len(page.text), bool))  # every path is content
    assert sum(html.main_text(page) != expected for page, expected in cases) >= 4


def test_html_path_ratios_by_hand():
    p = html.Page('<div class=a><p>One, two, three.</p><p>Four <a href=x>five</a></p></div><div class=b>Six</div>')
    paths, which, fused = html.path_ratios(p)
    size = [len("One, two, three."), len("Four five"), len("Six")]
    smooth = [min(size[0], 0.75 * size[0] + 0.25 * size[1]), min(size[1], 0.25 * size[0] + 0.5 * size[1] + 0.25 * size[2]), min(size[2], 0.25 * size[1] + 0.75 * size[2])]
    first = np.log1p((smooth[0] + smooth[1]) / 2) * np.log1p(1 + 3 / 2) * (1 - 4 / 25) ** 2 * (1 + np.log(2))
    assert which.tolist() == [0, 0, 1] and np.allclose(fused, [first, np.log1p(smooth[2]) * np.log(2)])


def test_html_time_is_in_proportion():
    for page in ("<div>a " * 300_000, "<ul><li>a <div>" * 60_000 + "<li>" * 60_000, "<article><div>a <article>" * 30_000, '<p a="' * 200_000, "<" * 500_000, "<!--" * 200_000, "<p>&amp" * 200_000):
        began = time.perf_counter()
        html.main_text(page)
        assert time.perf_counter() - began < 20


def test_html_given_pages(spark):
    """Their main text is the article element's, of which the ratios know nothing but its weight."""
    for h, in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect():
        inner = re.search(r"<article>(.*?)</article>", h, re.DOTALL)
        blocks = re.split(r"</?(?:p|h1|ul|li|blockquote|h2)[^>]*>", inner[1]) if inner else []
        expected = [re.sub(r"[\x20\x09-\x0D]+", " ", entities.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b)))).strip(" ") for b in blocks]
        assert html.main_text(h) == "\n\n".join(b for b in expected if b)


def test_warc_archives_that_end_early(spark, tmp_path):
    data = b"".join(warc.record_bytes(k, "u", b"payload %d" % k * 50, "0" * 64, 9, "response", None) for k in range(5))
    whole = zlib.compress(data, 6, 31)
    out, side = io.BytesIO(), io.BytesIO()
    assert warc.normalise_stream(io.BytesIO(whole), out, side) == 5
    assert warc.normalise_stream(io.BytesIO(out.getvalue()), io.BytesIO(), io.BytesIO()) == 5  # members of their own are taken too
    killed = zlib.compressobj(6, zlib.DEFLATED, 31)
    three = killed.compress(data[: len(data) * 3 // 5]) + killed.flush(zlib.Z_SYNC_FLUSH)
    for cut in (*(whole[:-k] for k in (1, 4, 8, 9, 50)), three, whole + whole[:15]):
        with pytest.raises(ValueError, match="ends within"):
            warc.normalise_stream(io.BytesIO(cut), io.BytesIO(), io.BytesIO())
    (tmp_path / "raw-a.warc.gz").write_bytes(whole)
    manifest = spark.createDataFrame([(str(tmp_path / "raw-a.warc.gz"), 6, 1)], warc.MANIFEST)
    with pytest.raises(Exception, match="6 in the manifest"):
        warc.normalise(manifest, f"file://{tmp_path}").count()


def test_warc(spark):
    big = "é" * 80
    rows = [(3, "http://a/\n", big), (1, None, big), (2, "u", None), (4, "u", "short"), (5, "u", "short"), (None, "u", big), (1, "u", big), (6, "u", "<p>" * 200_000)]
    pages = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, kind string")
    got = Counter(map(tuple, warc.archive_round_trip(pages).collect()))
    expected = Counter()
    for i, _, h in rows:
        data = (h or "").encode()
        again = h == big and i != 1
        expected[i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", 1 if again else None] += 1
    assert got == expected
    assert warc.archive_round_trip(pages.limit(0)).collect() == []
