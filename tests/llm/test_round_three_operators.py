"""Lexical search, mixing and collocations on small hostile tables, against brute force."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapwise.llm import collocations, lexical, mixing

#: Columns whose names clash with those that the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, size long, part long, copies long, target double, k long, key string, words long, item long, segment long, term string, row_ long"
MORE = (9,) * 4 + (0.5, 9, "k", 9, 9, 9, "t", 9)


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 5))) for _ in range(60)]
    texts = [None, "", " ", "\t\n", "...", "One", "one TWO", "one two", "a\x01b a\x01b a", "x" * 5000, "日本 語 😀!", "a\u0085b c;d"]
    texts += [" ".join(r.choice(vocabulary) + r.choice(["", "", "", ".", ",", "\n", "\t"]) for _ in range(r.choice((3, 30, 90)))) for _ in range(150)]
    texts += [texts[20]] * 40 + ["the cat sat on the mat " * 3000]
    rows = [(i, t, r.choice(("en", "fr", None)), "hot" if i % 3 else r.choice(("a", "é", "", None, "😀")), None) for i, t in enumerate(texts)]
    rows += [rows[20], (None, "one two", None, None, 1), (None, None, None, None, None), (3, "one two", "en", "hot", 2)]
    return spark.createDataFrame([(*x, *MORE) for x in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def terms(text):
    low = (text or "").translate({k: k + 32 for k in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def best_documents(docs, queries, top):
    own = [(i, collections.Counter(terms(t))) for i, t in docs]
    own = [(i, c, c.total()) for i, c in own if c]
    count, words = len(own), sum(n for _, _, n in own)
    df = collections.Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in queries:
        weights = {t: math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) for t in set(terms(text)) if t in df}
        scores = []
        for i, c, n in own:
            m = 10 + 90 * n * count // words
            s = sum(w * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, w in weights.items() if t in c)
            if s:
                scores.append((-s, i is None, i or 0))
        out += [(item, k + 1, None if null else i, -s) for k, (s, null, i) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block, segment, stride", [(64, 16_384, 2048), (3, 40, 7), (1, 11, 1)])
def test_search(spark, docs, empty, monkeypatch, block, segment, stride):
    """Small blocks, segments and strides make blocks be passed over and thresholds travel between segments."""
    monkeypatch.setattr(lexical, "BLOCK", block)
    monkeypatch.setattr(lexical, "SEGMENT_DOCS", segment)
    monkeypatch.setattr(lexical, "STRIDE", stride)
    monkeypatch.setattr(lexical, "QUERY_BLOCK", 3)
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    asked = [(i, t) for i, (_, t) in enumerate(texts[::9])] + [(0, "one"), (None, "two"), (77, "nowhere"), (78, None), (79, "é x cat")]
    queries = spark.createDataFrame([(i, t, 1, "s") for i, t in asked], "item_id long, text string, item long, terms string")
    index = lexical.LexicalIndex(docs.repartition(2))
    rows = [tuple(r) for r in lexical.search(index, queries, top=4).collect()]
    assert sorted(rows, key=repr) == best_documents(texts, asked, 4)
    assert lexical.search(index, queries.limit(0)).count() == 0
    assert lexical.search(lexical.LexicalIndex(empty), queries).count() == 0


def test_packed_numbers():
    values = np.array([0, 1, 127, 128, 16_383, 16_384, 2**40, 5], np.int64)
    data, ends = lexical.packed_numbers(values)
    assert lexical.unpacked_numbers(data.tobytes()).tolist() == values.tolist() and ends[-1] == len(data)


def test_blocks_are_passed_over(spark, monkeypatch):
    """A rare term's blocks settle the query: most blocks of the frequent term are never opened."""
    monkeypatch.setattr(lexical, "STRIDE", 64)
    r = random.Random(2)
    texts = [(k, " ".join(["common"] + [f"w{r.randrange(10**6)}" for _ in range(r.randint(20, 60))] + (["rare"] if k in (5, 200, 700) else []))) for k in range(4000)]
    index = lexical.LexicalIndex(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1))
    opened = []
    real = lexical.unpacked_numbers
    monkeypatch.setattr(lexical, "unpacked_numbers", lambda data: opened.append(1) or real(data))
    columns = ["queries", "segment", "term", "block", "first", "last", "n", "impact", "data", "weight", "items"]
    rows = index.rows.filter("term is null or term in ('common', 'rare')").withColumn("queries", F.lit(0).cast("long")).withColumn("weight", F.when(F.col("term") == "rare", 7000).otherwise(1).cast("long"))
    rows = rows.withColumn("items", F.when(F.col("block") == 0, F.array(F.lit(1).cast("long")))).select(*columns).orderBy("queries", "segment", "term", "block")
    best = pytest.importorskip("pyarrow").Table.from_batches(list(lexical._best(rows.toArrow().to_batches(), 3))).to_pylist()
    assert sorted(x["doc_id"] for x in best) == [5, 200, 700]
    assert len(opened) < 25 < 4000 / lexical.BLOCK


def mixed(docs):
    """(doc_id, size, source_size, target, source) and each source's rate, by sharing again until no source is full."""
    rows = [(r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")), r.source) for r in docs.select("doc_id", "text", "source").collect()]
    size = collections.Counter()
    for _, n, s in rows:
        size[s] += n
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(size.values()), set(order)
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] >= 2 * size[s]}
        if not full:
            target |= {s: share * weight[s] for s in open_}
            break
        target |= {s: 2.0 * size[s] for s in full}
        left -= sum(target[s] for s in full)
        open_ -= full
    return rows, size, target


def test_mixing(docs, empty):
    rows, size, target = mixed(docs)
    got = mixing.mixed_sources(docs.repartition(5)).collect()
    assert sorted((repr(r.doc_id), r.size, repr(r.source)) for r in got) == sorted((repr(i), n, repr(s)) for i, n, s in rows)
    taken, most = collections.Counter(), collections.Counter()
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source])
        rate = target[r.source] / size[r.source] if size[r.source] else 0
        assert r.taken == r.copies * r.size and (r.copies in (math.floor(rate + 1e-9), math.ceil(rate - 1e-9)) or abs(rate - r.copies) < 1e-6)
        taken[r.source] += r.taken
        most[r.source] = max(most[r.source], r.size)
    assert all(abs(taken[s] - target[s]) <= most[s] + 1e-3 for s in size)
    again = mixing.mixed_sources(docs.repartition(2)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert mixing.mixed_sources(empty).count() == 0


def test_mixture_holds_whole_rows(docs, empty):
    got = mixing.mixture(docs)
    assert got.columns == docs.columns and mixing.mixture(empty).count() == 0
    want = collections.Counter()
    for r in mixing.mixed_sources(docs).collect():
        want[(r.doc_id, r.source)] += r.copies
    have = collections.Counter((r.doc_id, r.source) for r in got.collect())
    assert have == +want
    assert got.filter("key != 'k' or row != 9 or row_ != 9").count() == 0


def test_one_source_takes_all_that_it_may(spark):
    docs = spark.createDataFrame([(k, "a b c", "only") for k in range(10)], "doc_id long, text string, source string")
    assert {(r.target, r.taken) for r in mixing.mixed_sources(docs, share=(2, 1)).collect()} == {(60.0, 6)}
    assert sum(r.taken for r in mixing.mixed_sources(docs).collect()) == 45


def brute_collocations(docs, least, top, most_words=3):
    times = collections.defaultdict(collections.Counter)
    for lang, text in docs:
        low = (text or "").translate({k: k + 32 for k in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            for size in range(1, most_words + 1):
                for at in range(len(w) - size + 1):
                    times[lang or "und"][tuple(w[at : at + size])] += 1
    out = []
    for lang, f in times.items():
        found = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            if any(len(q) > len(p) and n >= least and 100 * n >= 50 * a and any(q[k : k + len(p)] == p for k in range(len(q) - len(p) + 1)) for q, n in f.items()):
                continue
            score, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        n = sum(v for p, v in f.items() if len(p) == 1)
        out += [(lang, k + 1, p.decode(), -a, l, r, n, -s) for k, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


@pytest.mark.parametrize("least, held, top, most_words", [(2, 500_000, 2000, 3), (3, 5, 7, 4)])
def test_collocations(docs, empty, monkeypatch, least, held, top, most_words):
    monkeypatch.setattr(collocations, "HELD_SUFFIXES", held)
    texts = [(r.lang, r.text) for r in docs.select("lang", "text").collect()]
    got = collocations.collocations(docs, most_words=most_words, least=least, top=top)
    assert sorted(map(tuple, got.collect())) == brute_collocations(texts, least, top, most_words)
    assert collocations.collocations(empty).count() == 0


def test_scores_past_64_bits(spark):
    """Counts are made up: 4e12 occurrences give products of 1e31."""
    counts = spark.createDataFrame([("en", "a b", 2, 4 * 10**12), ("en", "a", 1, 4 * 10**12 + 7), ("en", "b", 1, 5 * 10**12)], "lang string, phrase string, words int, times long")
    import unittest.mock

    with unittest.mock.patch.object(collocations, "phrase_counts", lambda *a: counts):
        row = collocations.collocations(counts).first()
    assert row.score == 10**6 * (4 * 10**12) ** 2 // ((4 * 10**12 + 7) * 5 * 10**12)
