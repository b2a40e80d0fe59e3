"""Operators 11 to 13 against brute-force versions, with edge rows."""

import collections
import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from tallyman.llm import collocations, compression_bands, lexical_search

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, n long, term string, score string, item string, shard int"
ITEMS = "item_id long, text string, doc_id long, rank string, score string"
rng = random.Random(11)
VOCABULARY = ["".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(300)]


def words(n, seed, vocabulary=VOCABULARY):
    r = random.Random(seed)
    return [r.choice(vocabulary) for _ in range(n)]


LONG = " ".join(words(30_000, 1))
TEXTS = [
    (1, "", "en"), (2, None, None), (None, "no id here, but text.", "en"), (None, "no id here, but text.", "en"), (4, "   \n \n\t", "de"),
    (5, "naïve café — ünïcode 日本語 \U0001f600 ÀÉ ſ K", "fr"), (6, LONG, "en"), (7, "a" * 3000 + " " * 3000 + "=" * 500, None),
    (8, "same words here in two rows, twice", "en"), (8, "same words here in two rows, twice", "en"), (8, "another text of this id", "de"), (9, "one", ""),
    (10, "it's <|x|> a#b don't\x1fsplit\r\n  we'll  \x00 \x0b\x0c$%\n\nit's <|x|>\n it's <|x|>", "en"), (11, " wide blank\u0085next", "en"),
    (12, "A B C d! a b c? D a b c", "en"), (13, "New York, new york; NEW  YORK new\tyork", "en"), (14, "x " * 400, "de"), (15, "ab " * 5000, "de"),
]


def docs(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, lang, None, len(t or ""), "clash", 7, "clash", "clash", "clash", 3) for i, t, lang in rows], DOCS)


def many(n=300, seed=3):
    r = random.Random(seed)
    return [(i, " ".join(words(r.randint(5, 120), i)) + r.choice([".", "! ", "\n", ""]) + " ".join(words(9, i % 7)), r.choice(["en", "de", None])) for i in range(100, 100 + n)]


# --- 11 compression bands -------------------------------------------------------------
def counts_by_hand(text):
    text = text or ""
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(found[i:i + 3]) for i in range(len(found) - 2)]
    times = collections.Counter(windows)
    inside = {i + step for i, w in enumerate(windows) if times[w] > 1 for step in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(found) < 50 or 100 * len(inside) > 50 * len(found)
    return len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(inside), failed


def test_base_counts_equal_brute_force(spark):
    rows = TEXTS + many(60)
    got = compression_bands.compression_rules(docs(spark, rows)).collect()
    want = [(i, *counts_by_hand(t)) for i, t, _ in rows]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted([tuple(r)[:7] for r in got], key=key) == sorted(want, key=key)
    assert not any(r["kept"] and r["base_failed"] for r in got)


def verdict_by_hand(text):
    raw = text.encode()

    def ratio(part):
        return len(part) / len(zstandard.ZstdCompressor(level=3).compress(part))

    least, most = [(a, b) for up, a, b in compression_bands.BANDS if up is None or len(raw) <= up][0]
    if not least <= ratio(raw) <= most:
        return False
    if len(raw) <= 4096:
        return True
    cuts = list(range(0, len(raw), 4096))
    if len(raw) - cuts[-1] < 2048:
        cuts.pop()
    parts = [raw[a:b] for a, b in itertools.pairwise([*cuts, len(raw)])]
    bad = [p for p in parts if not 1.4 <= ratio(p) <= 4.2]
    return len(bad) * 4 <= len(parts)


def test_bands_reject_repetition_and_random_characters(spark):
    r = random.Random(5)
    key = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(n))
    prose = " ".join(words(4000, 2))
    spam = "\n".join(f"offer {i} " + "buy cheap tables and chairs from our store in town today and save money" for i in range(900))
    rows = [(1, prose, "en"), (2, " ".join(words(60, 3)), "en"), (3, " ".join(key(11) for _ in range(900)), "en"), (4, spam, "en"),
            (5, prose + "\n" + "and so on " * 300, "en"), (6, prose[:9000] + " ".join(key(11) for _ in range(1500)), "en"),
            (7, prose[:4096 + 2047], "en"), (8, prose[:4096 + 2048], "en"), (9, prose[:4096], "en")]
    got = {r["doc_id"]: r for r in compression_bands.compression_rules(docs(spark, rows)).collect()}
    assert [got[i]["kept"] for i in (1, 2, 3, 4, 5)] == [True, True, False, False, True]
    for i, text, _ in rows:
        assert got[i]["kept"] == (not got[i]["base_failed"] and verdict_by_hand(text)), i
    assert [got[i]["n_chunks"] for i in (7, 8, 9)] == [1, 2, 0]


def test_compression_rules_of_an_empty_table(spark):
    assert compression_bands.compression_rules(docs(spark).limit(0)).count() == 0


# --- 12 ranked lexical search ---------------------------------------------------------------
def search_by_hand(rows, items, k):
    bags = [(i, collections.Counter(b := re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda x: x[0].lower(), t or ""))), len(b)) for i, t, *_ in rows]
    bags = [b for b in bags if b[2]]
    n_docs, total = len(bags), sum(b[2] for b in bags)
    df = collections.Counter(t for b in bags for t in b[1])
    out = []
    for item, text in set(items):
        terms = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda x: x[0].lower(), text or ""))
        scored = []
        for i, bag, n in bags:
            m = 100 - 25 + (25 * n * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 12 * m)) for t in terms if bag[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored, key=lambda s: s[:3])[:k], 1)]
    return sorted(out, key=lambda r: tuple((x is None, x) for x in r))


ASKED = [(1, "same words here"), (1, "one"), (1, "one"), (2, None), (3, "—!? "), (None, "naïve CAFÉ 日本語 ſ"), (4, " ".join(words(200, 9))), (5, "zzz nowhere"),
         (6, "a a a b"), (7, LONG[:20_000])] + [(20 + i, " ".join(words(12, i % 7) + words(5, i))) for i in range(40)]


@pytest.mark.parametrize("k,most_items,most_terms", [(5, 512, 16_000), (20, 7, 16_000), (3, 512, 100)])
def test_search_equals_brute_force(spark, k, most_items, most_terms):
    rows = TEXTS + many(200)
    items = spark.createDataFrame([(i, t, 1, "clash", "clash") for i, t in ASKED], ITEMS)
    got = lexical_search.search(docs(spark, rows).repartition(5), items, k, most_items=most_items, most_terms=most_terms).collect()
    assert sorted([tuple(r) for r in got], key=lambda r: tuple((x is None, x) for x in r)) == search_by_hand(rows, ASKED, k)


def test_search_of_empty_tables(spark):
    items = spark.createDataFrame([(1, "same words", 1, "", "")], ITEMS)
    assert lexical_search.search(docs(spark).limit(0), items).count() == 0
    assert lexical_search.search(docs(spark), items.limit(0)).count() == 0
    assert lexical_search.search(docs(spark, [(1, None, "en"), (2, " ! ", "en")]), items).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_no_pair_that_can_enter_is_pruned(seed):
    r = np.random.default_rng(seed)
    n_items, n_docs, width, k = (1, 3, 40, 200)[seed], (5, 70, 300, 33)[seed], 25, 4
    bags = [{int(t): int(r.integers(1, 3)) for t in r.choice(width, r.integers(1, 6), replace=False)} for _ in range(n_items)]
    items = lexical_search.Items(bags, r.integers(0, 9, width).astype(np.int64))
    matrix = (r.integers(0, 1000, (n_docs, width)) * (r.random((n_docs, width)) < 0.2)).astype(float)
    scores = items.rows @ matrix.T
    kth = np.sort(scores, axis=1)[:, -k]
    alive = lexical_search.surviving(items, matrix, kth)
    wanted = (scores >= kth[:, None]) & (scores > 0)
    assert alive[wanted.nonzero()[0], wanted.nonzero()[1] // lexical_search.LEAF].all()


# --- 13 collocations --------------------------------------------------------------------------
def phrases_by_hand(rows, support, most):
    out = []
    for lang in {x[2] if x[2] is not None else "und" for x in rows}:
        counted, n = collections.Counter(), 0
        for _, text, own in rows:
            if (own if own is not None else "und") != lang:
                continue
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda x: x[0].lower(), text or "")):
                w = re.findall(r"[^\x20\x09]+", piece)
                n += len(w)
                counted.update(tuple(w[i:i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
        found = {p: a for p, a in counted.items() if len(p) > 1 and a >= support}
        scored = []
        for p, a in found.items():
            if any(len(q) > len(p) and b >= a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in found.items()):
                continue
            score, k = min((1000 * a * n // (counted[p[:k]] * counted[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), counted[p[:k]], counted[p[k:]]))
        out += [(lang, rank, s[2].decode(), -s[1], s[3], s[4], n, -s[0]) for rank, s in enumerate(sorted(scored)[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize("support,most,shards", [(3, 2000, 8), (2, 40, 3), (20, 2000, 1)])
def test_collocations_equal_brute_force(spark, support, most, shards):
    rows = [x if x[0] != 6 else (6, " ".join(words(3000, 1, VOCABULARY[:40])), "en") for x in TEXTS] + many(150)
    got = collocations.collocations(docs(spark, rows).repartition(4), support, most, shards).collect()
    assert sorted(tuple(r) for r in got) == phrases_by_hand(rows, support, most)


def test_collocations_with_crowded_bitmaps_and_small_tasks(spark, monkeypatch):
    monkeypatch.setattr(collocations, "MOST_BITS", 1 << 16)
    monkeypatch.setattr(collocations, "HELD", 500)
    monkeypatch.setattr(collocations, "HELD_TEXTS", 300)
    monkeypatch.setattr(collocations, "ROWS", 7)
    rows = [(i, LONG[i * 300:i * 300 + 900], "en") for i in range(400)]
    got = collocations.collocations(docs(spark, rows), 4).collect()
    assert sorted(tuple(r) for r in got) == phrases_by_hand(rows, 4, 2000)


def test_collocations_of_empty_tables(spark):
    assert collocations.collocations(docs(spark).limit(0)).count() == 0
    assert collocations.collocations(docs(spark, TEXTS[:2]), 1).count() == 0


def test_a_task_passes_a_candidate_on_once():
    batches = [pa.RecordBatch.from_pydict({"text": ["a b c", f"b c d{i} a b"], "lang": ["en", "de"]}) for i in range(50)]
    rows = [r for b in collocations._count_exactly(iter(batches), [np.full(1 << 13, 255, np.uint8)] * 5) for r in b.to_pylist()]
    got = {(r["lang"], r["phrase"], r["words"]): r["a"] for r in rows}
    assert len(got) == len(rows) and got["en", "a b c", 3] == got["de", "a b", 2] == 50 and got["de", "b c d7 a b", 5] == 1
