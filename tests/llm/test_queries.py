"""The registered queries over whole small tables, against plain Python."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from quadrille.llm import chat, html, mixing, packing, quality, queries, simhash, tokenbin, tokens

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(name, columns, sf=SF):
    return duckdb.connect().execute(f"SELECT {columns} FROM '{sf}/{name}.parquet'").fetchall()


@pytest.fixture(scope="module")
def documents():
    return rows("documents", "doc_id, text, lang, source")


@pytest.fixture(scope="module")
def ids(documents):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.public_path("word_bpe_49k.json"))
    return {i: np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4") for i, x, *_ in documents}


@pytest.mark.parametrize("name", ["op1_warc", "op2_exact_dedup"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    assert Counter(map(tuple, queries.QUERIES[name](spark, SF).select(*names).collect())) == Counter(want.fetchall())


def test_op3_pack(spark, ids):
    got = packing.op3_pack(spark, SF).collect()
    expected = Counter((i, k, s, len(x[s : s + 4096]), zlib.crc32(x[s : s + 4096].tobytes())) for i, x in ids.items() for k, s in enumerate(range(0, len(x), 4096)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        ends = [0, *np.cumsum([n for _, n in sorted(parts)]).tolist()]
        assert [at for at, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 4096
    assert len(sequences) == -(-sum(map(len, ids.values())) // 4096)


def test_op4_mix(spark, documents):
    got = {r.doc_id: r for r in mixing.op4_mix(spark, SF).collect()}
    size = {i: len(WORD.findall(t or "")) for i, t, *_ in documents}
    total = Counter()
    for i, _, _, s in documents:
        total[s] += size[i]
    order = sorted(s for s in total if s is not None) + [None] * (None in total)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, left, free = {}, float(sum(total.values())), set(total)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * total[s]}
        for s in over or free:
            target[s] = float(3 * total[s]) if over else level * weight[s]
        left -= sum(target[s] for s in over)
        free -= over or free
    taken = Counter()
    for i, _, _, s in documents:
        r = got[i]
        assert (r.size, r.source_size) == (size[i], total[s]) and r.target == pytest.approx(target[s])
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
        taken[s] += r.taken
    assert len(got) == len(documents)
    for s in total:
        assert abs(taken[s] - target[s]) <= max(size[i] for i, _, _, x in documents if x == s) / 2
    assert {(r.doc_id, r.taken) for r in mixing.op4_mix(spark, SF).collect()} == {(i, r.taken) for i, r in got.items()}


def test_op6_simhash(spark, documents):
    import xxhash

    marks = {}
    for i, t, *_ in documents:
        w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in WORD.findall(t or "")]
        grams = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        marks[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    root = {i: i for i in marks}
    for a in marks:
        for b in marks:
            if a < b and (marks[a] ^ marks[b]).bit_count() <= 4 and root[a] != root[b]:
                lo, hi = sorted((root[a], root[b]))
                root = {k: lo if v == hi else v for k, v in root.items()}
    got = simhash.op6_simhash(spark, SF).collect()
    assert {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in got} == {i: (marks[i], root[i]) for i in marks} and len(got) == len(marks)


def test_op7_token_ids(spark, ids):
    at, expected = 0, []
    for i in sorted(ids):
        expected.append((i, at, len(ids[i]), zlib.crc32(ids[i].tobytes())))
        at += len(ids[i])
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tokenbin.op7_token_ids(spark, SF).collect()) == expected


def test_op8_chat(spark):
    said = r"\### Assistant: </turn> ok"
    turns = [*rows("conversations", "conv_id, turn, role, text"), (-7, 0, "user", said), (-7, 1, "assistant", said)]
    by = {}
    for c, n, role, text in sorted(turns, key=lambda r: (r[0], r[1])):
        by.setdefault(c, []).append((role, text or ""))
    expected = {}
    for c, x in by.items():
        loss = "".join(t for r, t in x if r == "assistant")
        expected[c] = (len(x), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in x).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    got = chat.op8_chat(spark, SF).collect()
    assert {r.conv_id: tuple(r[1:5]) for r in got} == expected and len(got) == len(expected)
    assert all(r.formatted_chars > r.loss_chars for r in got)


def test_op9_quality(spark):
    """Base columns by plain Python; the verdict by a robust estimate with many random starts over the same rows."""
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in quality.op9_quality(spark, sf).collect()}
    vectors, groups = {}, {}
    for i, t, lang, source in rows("documents", "doc_id, text, lang, source", sf):
        w, t = WORD.findall(t or ""), t or ""
        grams = Counter(zip(w, w[1:], w[2:]))
        again = {k + j for k, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        base = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again))
        failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (*base, failed)
        if not failed:
            letters = max(1, base[1])
            vectors[i] = (np.log(letters / base[0]), np.log1p(base[2] / base[0]), np.sqrt(base[4] / base[0]), np.sqrt(base[3] / len(lines)),
                          np.sqrt(len(re.findall("[.,;:!?]", t)) / letters), np.sqrt(sum(c.isupper() for c in t) / letters))
            groups.setdefault({"source": (lang, source), "language": lang, "all": "", None: None}[r.estimate], []).append(i)
    assert None not in groups and len(groups) > 1 and min(map(len, groups.values())) >= quality.MIN_GROUP
    rng, floor = np.random.default_rng(0), np.diag(np.square(quality.FLOORS))
    distances = {}
    for group in groups.values():
        y = np.array([vectors[i] for i in group])
        best = (np.inf,)
        for _ in range(40):
            half = y[rng.choice(len(y), 30, replace=False)]
            for _ in range(12):
                m, s = half.mean(0), np.cov(half.T, bias=True) / quality.HALF_FACTOR + floor
                d2 = np.einsum("ij,jk,ik->i", y - m, np.linalg.inv(s), y - m)
                half = y[d2 <= np.median(d2)]
            best = min(best, (np.linalg.slogdet(s)[1], m.tolist(), d2.tolist()), key=lambda b: b[0])
        distances |= dict(zip(group, best[2]))
    for i, r in got.items():
        if r.base_failed:
            assert not r.kept
        elif not 0.8 * quality.CUTOFF < distances[i] < 1.25 * quality.CUTOFF:  # near the cutoff, halves may differ
            assert r.kept == (distances[i] <= quality.CUTOFF)


def test_op10_main_text(spark):
    got = html.op10_main_text(spark, SF).collect()
    pages = {i: (u, h) for i, u, h in rows("pages", "page_id, url, html")}
    assert len(got) == len(pages)
    for r in got:
        url, page = pages[r.page_id]
        assert (r.url, r.text, r.n_chars) == (url, html.main_text(page), len(r.text))
        assert r.text and "©" not in r.text and "track(" not in r.text
