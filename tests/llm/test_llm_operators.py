"""Each operator on small hostile tables, against brute force or an exact round trip."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapwise.llm import chat, embedding_dedup, exact_dedup, language_id, minhash, packing, pieces, pii, sharding, warc
from gapwise.llm.components import connected_components
from gapwise.llm.common import Scratch
from gapwise.llm.queries import tokenizer_file

# columns whose names clash with those that the operators use inside
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, row long, size long, class string, bands string, near string, text_sha256 string"


def random_words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


def hostile_texts():
    base = random_words(120, 1)
    words = base.split()
    near = [" ".join(words[:k] + ["other"] + words[k + 1 :]) for k in (3, 40, 80)]
    texts = [None, "", " ", "\n\t ", "...", "one", "One two", "one  two", "A b C", "a B c", base, base.upper(), base, *near, random_words(30_000, 2), "é" * 500, "日本 語 😀", "x<|endoftext|>y", "0 " * 400, "a\u0085b c"]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else "fr", "s", None) for i, t in enumerate(hostile_texts())]
    rows += [rows[10], rows[10], (None, "one", None, None, 1), (None, None, None, None, None), (3, random_words(120, 1), "en", "s", 2)]
    return spark.createDataFrame([(*r, 1, 2, 3, "c", "b", "n", "t") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def source(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def test_shards(docs, empty):
    rows = sharding.byte_shards(docs, 4).collect()
    want = sorted((repr(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in source(docs))
    assert sorted((repr(r.doc_id), r.size, r.text_crc32) for r in rows) == want
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}
    assert sharding.byte_shards(empty).count() == 0


def test_shards_are_even_and_contiguous(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat('x', cast(id % 37 as int))").alias("text")).repartition(7)
    rows = sorted(sharding.byte_shards(df, 8).collect(), key=lambda r: r.doc_id)
    total = collections.Counter()
    for r in rows:
        total[r.shard] += r.size
    assert max(total.values()) - min(total.values()) <= 2 * 38
    assert [r.shard for r in rows] == sorted(r.shard for r in rows)


def test_written_shards(spark, docs, empty, tmp_path):
    plain = docs.drop("size")
    sharding.write_shards(plain, str(tmp_path / "s"), 4, files=2)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(map(repr, (tuple(r)[:-2] for r in back.select(*plain.columns, "__slot", "shard").collect()))) == sorted(repr(tuple(r)) for r in plain.collect())
    placed = sorted((repr(r.doc_id), r.shard, r.slot) for r in sharding.byte_shards(plain, 4).collect())
    assert sorted((repr(r.doc_id), r.shard, r["__slot"]) for r in back.collect()) == placed
    sharding.write_shards(empty, str(tmp_path / "e"), 4)


def shingles(text, width):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in re.split("[\x20\x09-\x0d]+", low) if x]
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute_components(rows, width, percent):
    sets = [shingles(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, len(s), least.get(find(k)), i == least.get(find(k))) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))]


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, width, percent):
    got = minhash.near_duplicates(docs, width, percent).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute_components(source(docs), width, percent)))


def test_near_duplicate_chains(spark):
    """Texts that each differ a little from the one before, and groups that only resemble each other."""
    r = random.Random(5)
    texts, words = [], random_words(100, 9).split()
    for _ in range(40):
        words = list(words)
        words[r.randrange(100)] = f"new{r.random()}"
        texts.append(" ".join(words))
    frame = random_words(100, 10).split()
    texts += [" ".join(frame[:85] + random_words(15, 100 + k).split()) for k in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = minhash.near_duplicates(df, 3, 85).collect()
    assert sorted(map(tuple, got)) == sorted(brute_components(list(enumerate(texts)), 3, 85))


@pytest.mark.parametrize(("width", "percent", "seed"), [(3, 85, 1), (5, 80, 2)])
def test_near_duplicates_in_a_dense_group(spark, width, percent, seed):
    """Copies of one text with edits from few words, similar to each other by 0.4 to 1, and families within it."""
    r = random.Random(seed)
    base, texts = random_words(110, 20 + seed).split(), []
    families = [base, base[:60] + random_words(50, 40).split(), random_words(40, 41).split() + base[40:]]
    for _ in range(260):
        words = list(r.choice(families))
        for _ in range(r.randint(0, 9)):
            words[r.randrange(len(words))] = r.choice(["a", "b", "c", "of", "the"])
        if r.random() < 0.2:
            del words[r.randrange(len(words)) :][: r.randint(1, 30)]
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = minhash.near_duplicates(df, width, percent).collect()
    want = brute_components(list(enumerate(texts)), width, percent)
    assert sorted(map(tuple, got)) == sorted(want)
    assert 20 < len({w[2] for w in want}) < 250


def test_pages_of_one_frame_that_do_not_link(spark):
    """Texts that share 120 words and have some of their own: join rows grow with the texts, not with their pairs."""

    def met(n, own):
        r = random.Random(n)
        frame = [f"f{k}" for k in range(120)]
        rows = [(k, " ".join(frame + [f"w{r.randrange(10**7)}" for _ in range(own)])) for k in range(n)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        counted = []
        real = minhash.candidates

        def candidates(listed, percent):
            sides = listed.groupBy("g", "kind", "el").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("inner").cast("int")).alias("i"))
            pairs = F.when(F.col("kind") == 0, F.col("i") * (F.col("n") - F.col("i"))).otherwise(F.col("n") * F.col("n"))
            counted.append(sides.agg(F.sum(pairs)).first()[0] or 0)
            return real(listed, percent)

        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(minhash, "candidates", candidates)
            assert minhash.near_duplicates(docs, 3, 85).filter("not kept").count() == 0
        return sum(counted)

    assert met(600, 14) <= 6 * 600


def test_near_duplicates_without_ids(spark):
    """Rows without ids are compared once for each text, not with each other's texts."""
    texts = [random_words(30, k // 2) + (" x" if k % 2 else "") for k in range(300)]
    df = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    rows = minhash.near_duplicates(df, 3, 85).collect()
    assert len(rows) == 300 and all(r.component_id is None and r.kept for r in rows)


def test_words_that_polynomial_hashes_confuse():
    """Complementary Thue-Morse words are equal to any polynomial hash modulo 2**64."""
    word = b"a"
    while len(word) < 1024:
        word += word.translate(bytes.maketrans(b"ab", b"ba"))
    other = word.translate(bytes.maketrans(b"ab", b"ba"))
    assert not set(minhash.shingle_set(b"x " + word + b" y", 3)) & set(minhash.shingle_set(b"x " + other + b" y", 3))
    one, two = (minhash.Text(f"p q r s {w.decode()} t u v w", 3, None) for w in (word, other))
    assert one.common_with(two) == 4 == minhash.common_count(one.shingles, two.shingles)


def test_near_duplicates_of_nothing(empty):
    assert minhash.near_duplicates(empty).count() == 0


def test_signature_estimates_similarity():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, 2000, dtype=np.uint64) * np.uint64(2)
    b = np.concatenate([a[:1600], rng.integers(0, 2**63, 400, dtype=np.uint64) * np.uint64(2)])
    same = (minhash.signature(np.unique(a), 400) == minhash.signature(np.unique(b), 400)).mean()
    assert abs(same - 1600 / 2400) < 0.1


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(20)] + [(5, 5), (None, 1)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b and None not in (a, b):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"), "c").collect()
    assert {x.node: x.root for x in got} == {x: find(x) for x in list(root)}


def test_pieces(docs, empty):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    got = pieces.encode_decode(docs, tokenizer_file("piece_bpe_32k.model"), with_content=True).collect()
    want = []
    for i, t in source(docs):
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want.append((repr(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted((repr(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)
    assert pieces.encode_decode(empty, tokenizer_file("piece_bpe_32k.model")).count() == 0


def test_pieces_on_odd_strings():
    coder = pieces.PieceEncoder(tokenizer_file("piece_bpe_32k.model"))
    library = coder.v.library
    r = random.Random(8)
    odd = ["".join(r.choice(["a", "the", " ", "  ", "▁", "\n", "é", "😀", "ing", ",", "\u0000", "1"]) for _ in range(r.randint(0, 12))) for _ in range(400)]
    for text, packed in zip(odd, coder.encode(odd), strict=True):
        ids = library.encode(text, add_bos=True, add_eos=True)
        assert coder.pack(ids) == packed and library.decode(ids) == coder.decode(packed), text


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_groups(docs, empty, keep):
    norm = [(i, exact_text(t)) for i, t in source(docs)]
    groups = collections.defaultdict(list)
    for i, t in norm:
        groups[t].append(i)
    pick = max if keep == "largest" else min
    owner = {t: pick([i for i in ids if i is not None], default=None) for t, ids in groups.items()}
    want = sorted(repr((i, owner[t], len(groups[t]), i == owner[t], hashlib.sha256(t.encode()).hexdigest())) for i, t in norm)
    assert sorted(repr(tuple(r)) for r in exact_dedup.exact_groups(docs, keep=keep).collect()) == want
    left = exact_dedup.without_copies(docs, keep=keep)
    assert left.columns == docs.columns
    assert sorted(map(repr, ((r.doc_id, exact_text(r.text)) for r in left.collect()))) == sorted(repr((o, t)) for t, o in owner.items())
    assert exact_dedup.exact_groups(empty).count() == 0 == exact_dedup.without_copies(empty).count()


def exact_text(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.mark.parametrize("limit", [1 << 30, 2000, 300])
def test_trie_spills(limit):
    r = random.Random(2)
    trie, want = exact_dedup.PatriciaOwners(exact_dedup.larger, limit), {}
    for i in range(2000):
        key = bytes(r.choice(b"ab") for _ in range(r.randint(0, 12)))
        key = b"common prefix" * 3 + key if i % 7 == 0 else key
        trie.add(key, i, 1)
        want[key] = (i, want.get(key, (0, 0))[1] + 1)
    assert {k: (o, n) for k, o, n in trie.items()} == want


@pytest.mark.parametrize(("prefix", "limit"), [(5_000, 20_000), (30_000, 20_000), (5_000, 1 << 30)])
def test_trie_spills_below_a_long_common_prefix(prefix, limit):
    r = random.Random(4)
    head = bytes(r.choice(b"abc") for _ in range(prefix))
    trie, want = exact_dedup.PatriciaOwners(exact_dedup.larger, limit), {}
    # a comb of prefixes, many short ends, strings that leave the prefix early, and one alone above the limit
    keys = [head[:k] for k in range(0, prefix, prefix // 60)] + [head + bytes(r.choice(b"ab") for _ in range(r.randint(0, 10))) for _ in range(600)]
    keys += [head[: r.randrange(prefix)] + b"z" * r.randint(1, 90) for _ in range(300)] + [head + b"q" * 50_000]
    for i, key in enumerate(keys * 2):
        trie.add(key, i, 1)
        want[key] = (max(i, want.get(key, (0, 0))[0]), want.get(key, (0, 0))[1] + 1)
    found = list(trie.items())
    assert {k: (o, n) for k, o, n in found} == want and len(found) == len(want)


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(5, "http://a/ b\n", "same"), (2, None, "same"), (9, "u", None), (1, "u", ""), (7, "u", "é" * 1000), (7, "u", "é" * 1000), (None, "u", "same"), (None, "u", "lone"), (8, "u", "WARC/1.1\r\n\r\n")]
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, ordinal int, archive string").repartition(3)


@pytest.mark.parametrize("least", [0, 5])
def test_warc(pages, least):
    rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    owner = {}
    for i, b in rows:
        if len(b) >= least and i is not None:
            owner[b] = min(i, owner.get(b, i))
    want = []
    for i, b in rows:
        first = owner.get(b, i) if len(b) >= least else i
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if first == i else "revisit", None if first == i else first))
    got = warc.read_archives(*warc.archive_pages(pages, least))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_warc_members_are_seekable(pages):
    archives, folder = warc.archive_pages(pages)
    import gzip
    import json

    for (path,) in archives.collect():
        data = open(path, "rb").read()
        entries = [json.loads(line) for line in open(path + warc.INDEX_SUFFIX)]
        assert sum(e["length"] for e in entries) == len(data)
        for e in entries:
            assert gzip.decompress(data[e["offset"] : e["offset"] + e["length"]]).startswith(b"WARC/1.1\r\nWARC-Type: " + e["type"].encode())
    assert warc.read_archives(*warc.archive_pages(pages.limit(0))).count() == 0


def base_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 13 <= len(d) <= 19 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]


@pytest.fixture(scope="module")
def private(spark):
    texts = [None, "", "a@b.c_d@e.f x..@y-.z", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255", "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111111111111111", "+1 (555) 010-9999. +1 2 +49 30 123456 7", "😀é x@y.zz 日本 q@w.ee", "x@y" * 50 + ".z", "0" * 3000, "1 " * 3000, "a." * 3000 + "@b.c", "@" * 2000, "a@b" + ".c" * 3000]
    texts += ["".join(random.Random(k).choice(["a@b.co", "1.2.3.4", "+12 345 678 90", "4111 1111 1111 1111", " ", ".", "@", "9", "é", "😀", "-"]) for _ in range(40)) for k in range(60)]
    texts += [f"filler{k} zanzibar wrote to boss@corp.com yesterday evening" for k in range(4)] + [f"evening filler{k} yesterday" for k in range(300)]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_personal_spans(private):
    want = {r.doc_id: base_spans(r.text or "") for r in private.collect()}
    texts = {r.doc_id: r.text or "" for r in private.collect()}
    got = pii.span_digests(private).collect()
    assert len(got) == len(want)
    for r in got:
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in want[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest(), texts[r.doc_id][:200]
        assert r.spans.startswith(base)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in want[r.doc_id]) for k in pii.PATTERNS]
        terms = [texts[r.doc_id][int(s.split(":")[1]) : int(s.split(":")[2])] for s in r.spans.split(",") if s.startswith("term")]
        # the rare word beside an entity reveals it, the common ones don't; single occurrences prove nothing
        assert terms == (["zanzibar", "wrote"] if "zanzibar" in texts[r.doc_id] else [])


def test_sanitised(private, docs, empty):
    got = {r.doc_id: r.text for r in pii.sanitised(private).collect()}
    source_ = {r.doc_id: r.text for r in private.collect()}
    for i, t in source_.items():
        if t is not None and not base_spans(t):
            assert got[i] == t
    assert got[0] is None
    assert next(t for i, t in got.items() if "zanzibar" in (source_[i] or "")).split()[1:5] == ["[TERM]", "[TERM]", "to", "[EMAIL]"]
    assert pii.sanitised(docs).columns == docs.columns and pii.sanitised(docs).count() == docs.count()
    assert pii.span_digests(empty).count() == 0 == pii.sanitised(empty).count()


def test_spans_of_very_long_texts(spark):
    """A megabyte of personal data in one text, and texts that have few places to cut."""
    r = random.Random(6)
    bits = [lambda: f"user{r.randrange(10**6)}@mail{r.randrange(99)}.example.org", lambda: "10.2.3." + str(r.randrange(300)), lambda: "4111 1111 1111 1111", lambda: "+49 (30) 1234 567", lambda: "quiet Köln 日本。", lambda: "and\nso on,"]
    long = " ".join(r.choice(bits)() for _ in range(60_000))
    texts = [long, "8" * 9000 + " a@b.c", "1 " * 12_000 + "x@y.zz", "日本" * 6000 + "a@b.c", "(1) " * 5000 + "+1 (555) 010-9999" + " -" * 9000, "a b" * 10_000]
    assert len(long) > 1_000_000
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    for row in pii.span_digests(df).collect():
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in base_spans(texts[row.doc_id]))
        assert row.base_sha256 == hashlib.sha256(base.encode()).hexdigest(), row.doc_id
    clean = {x.doc_id: x.text for x in pii.sanitised(df).collect()}
    for row in pii.personal_spans(df).collect():
        want, at = "", 0
        for a, b, kind in sorted([(s.start, s.end, s.kind.upper()) for s in row.base] + [(s.start, s.end, "TERM") for s in row.terms]):
            if a >= at:
                want += texts[row.doc_id][at:a] + f"[{kind}]"
            at = max(at, b)
        assert clean[row.doc_id] == want + texts[row.doc_id][at:], row.doc_id


def brute_terms(texts):
    """The words that reveal an entity of each text, from plain counts of documents."""
    words = [set(re.findall(r"[^\W\d_]{4,}", t.lower())) for t in texts]
    spans = [base_spans(t) for t in texts]
    held = [{t[a:b].lower() for _, a, b in s} for t, s in zip(texts, spans, strict=True)]
    rest = [set(re.findall(r"[^\W\d_]{4,}", "".join("0" if any(a <= k < b for _, a, b in s) else c for k, c in enumerate(t)).lower())) for t, s in zip(texts, spans, strict=True)]
    alone, entity, both = (collections.Counter() for _ in range(3))
    for w, h, r in zip(words, held, rest, strict=True):
        alone.update(w)
        entity.update(h)
        both.update((e, t) for e in h for t in r)
    out = []
    for h, r in zip(held, rest, strict=True):
        share = {e: entity[e] / len(texts) for e in h}
        out.append({t for t in r if any(p < 1 and (both[e, t] + p) / (alone[t] + 1) >= p**0.2 * (1 - 1e-9) for e, p in share.items())})
    return out


def test_spans_of_texts_without_letters(spark):
    """Addresses, cards and numbers parted by spaces are cut into pieces, and give what the whole text gives."""
    r = random.Random(6)

    def address():
        return ".".join(str(r.randrange(256)) for _ in range(4))

    def number(n):
        return "".join(r.choice("0123456789") for _ in range(n))

    kinds = [
        " ".join(address() for _ in range(2000)), "+1 " + " ".join(address() for _ in range(2000)), "  ".join("4111 1111 1111 1111" for _ in range(1500)),
        " ".join(f"{number(2)}@{number(1)}.{number(2)}" for _ in range(3000)), " ".join(f"+1 {number(3)} {number(4)}{number(2)}" for _ in range(2500)),
        " ".join(r.choice([address(), number(r.randint(1, 19)), "+" + number(r.randint(8, 17)), f"{number(3)}@{number(2)}.{number(2)}", "(", "4111-1111-1111-1111", " "]) for _ in range(6000)),
        ".".join(str(k % 200) for k in range(9000)),
    ]
    df = spark.createDataFrame(list(enumerate(kinds)), "doc_id long, text string")
    for row in pii.personal_spans(df).collect():
        assert [tuple(s) for s in row.base] == base_spans(kinds[row.doc_id]), row.doc_id
    sizes = df.select("doc_id", F.array_max(F.transform(pii.pieces_of(F.col("text")), lambda p: F.length(p["text"]))).alias("most")).collect()
    assert all(x.most < 2 * pii.PIECE for x in sizes if x.doc_id < 6)


def test_terms_of_rare_entities(spark):
    """Entities in one and two documents, terms far from them and repeated; shared entities and common words."""
    r = random.Random(12)
    common = [f"{a}{b}word" for a in "abcdefghij" for b in "klmnopqrst"]
    texts = [" ".join(r.choices(common, k=40)) for _ in range(500)]
    far = " ".join(r.choices(common, k=60))
    texts += [f"Quixote {far} lone@one.org {far} quixote, QUIXOTE", f"umbrage {far} pair@two.org", f"pair@two.org and umbrage {far}"]
    texts += [f"{far} desk@many.org" + " lantern" * (k % 3 > 0) + " harbour" * (k < 2) + f" own{'xyz'[k % 3]}{'abcdefgh'[k % 8]}{'ijkl'[k % 4]}" for k in range(24)]
    texts += [f"lantern harbour {far}" for _ in range(6)]
    for _ in range(40):
        texts.append(" ".join([*r.choices(common, k=10), *(f"p{r.randrange(12)}@mix.org" for _ in range(3)), *(f"name{r.choice('abcdefghijkl')}{r.choice('mn')}" for _ in range(4))]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = brute_terms(texts)
    for row in pii.personal_spans(df).collect():
        text = texts[row.doc_id]
        assert {text[s.start : s.end].lower() for s in row.terms} == want[row.doc_id]
        assert len(row.terms) == sum(m[0].lower() in want[row.doc_id] for m in re.finditer(r"[^\W\d_]{4,}", text))
    assert want[500] == {"quixote"} and want[501] == want[502] == {"umbrage"}
    clean = {x.doc_id: x.text for x in pii.sanitised(df).collect()}
    assert clean[500] == f"[TERM] {far} [EMAIL] {far} [TERM], [TERM]"


def test_chat_round_trip(spark):
    r = random.Random(4)
    bits = ["<|im_start|>", "<|im_end|>", "<|im_esc|>", "\n", "\\", "|", "<", "a", "assistant", "\\n", "<\\|", "é", ""]
    rows = [(c, t, "".join(r.choice(bits) for _ in range(2)) if r.random() < 0.3 else r.choice(["user", "assistant", "system", None]), "".join(r.choice(bits) for _ in range(r.randint(0, 7))) if r.random() < 0.9 else None) for c in range(60) for t in range(r.randint(1, 5))]
    rows += [(99, 0, "user", "x"), (99, 0, "user", "x"), (99, None, "assistant", "y"), (None, 1, "user", "z" * 100_000)]
    df = spark.createDataFrame([(*x, "f") for x in rows], "conv_id long, turn long, role string, text string, formatted string")
    turns = collections.defaultdict(list)
    for c, t, role, text in rows:
        turns[c].append((t is not None, t or 0, role or "", text or ""))
    want = []
    for c, ts in turns.items():
        ts.sort()
        said = "".join(f"{role}\n{text}\n" for *_, role, text in ts)
        spoken = "".join(text for *_, role, text in ts if role == "assistant")
        want.append((c, len(ts), hashlib.sha256(said.encode()).hexdigest(), len(spoken), hashlib.sha256(spoken.encode()).hexdigest()))
    got = [tuple(x)[:5] for x in chat.conversation_digests(df).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert chat.conversation_digests(df.limit(0)).count() == 0
    for x in chat.format_conversations(df).collect():
        inside = [x.formatted[s.start : s.end] for s in x.loss_spans]
        spoken = [text for *_, role, text in turns[x.conv_id] if role == "assistant"]
        plain = [t for t, text in zip(inside, spoken, strict=True) if t == text]
        assert len(inside) == len(spoken) and all("\\" in t for t, text in zip(inside, spoken, strict=True) if t != text)
        assert x.conv_id != 99 or plain == ["y"]


def test_a_turn_that_no_rendering_keeps_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(chat, "escape", lambda text: text)
    df = spark.createDataFrame([(1, 0, "user", "a<|im_end|>\nb")], "conv_id long, turn long, role string, text string")
    with pytest.raises(Exception, match="no rendering"):
        chat.format_turns(df).collect()


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    got = packing.pack_documents(docs.coalesce(2), tokenizer_file("byte_bpe_50k.json")).collect()
    want = collections.Counter()
    for i, t in source(docs):
        want[i, len(library.encode(t or "", add_special_tokens=False).ids) + 1] += 1
    assert collections.Counter((r.doc_id, r.doc_tokens) for r in got if r.start == 0) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024 and at & (at - 1) == 0  # no padding
    whole = collections.defaultdict(list)
    for i, t in source(docs):
        whole[i].append(np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4"))
    for r in got:
        if len(whole[r.doc_id]) == 1:
            ids = whole[r.doc_id][0]
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    assert packing.pack_documents(empty, tokenizer_file("byte_bpe_50k.json")).count() == 0


def test_packed_ids(docs, monkeypatch):
    """Documents can be put together again from the ids of their pieces."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "BATCH_PIECES", 7)
    monkeypatch.setattr(packing, "BLOCK_TOKENS", 300)
    library = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    unique = docs.filter("doc_id is not null and doc_id not in (3, 10)")
    pieces_of = collections.defaultdict(list)
    for r in packing.pack_documents(unique, tokenizer_file("byte_bpe_50k.json")).collect():
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        pieces_of[r.doc_id].append((r.start, r.ids))
    want = {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in source(unique)}
    assert {i: [x for _, ids in sorted(parts) for x in ids] for i, parts in pieces_of.items()} == want


def test_packed_blocks():
    r = random.Random(1)
    for _ in range(100):
        lengths = [r.choice([1, 5, 60, 300, 1023, 1024, 1025, 5000, r.randint(1, 3000)]) for _ in range(r.randint(0, 60))]
        got = [[] for _ in lengths]
        first, left = packing.pack_block([(d, 0, n) for d, n in enumerate(lengths)], last=False)
        second, nothing = packing.pack_block(left)
        assert sum(n for *_, n in left) < 1024 and not nothing
        for window in first + second:
            size = sum(n for *_, n in window)
            assert size <= 1024 and size & (size - 1) == 0
            assert window in second or size in packing.TIERS
            for d, start, n in window:
                got[d].append((start, n))
        for parts, whole in zip(got, lengths, strict=True):
            at = 0
            for start, n in sorted(parts):
                assert start == at and n > 0
                at += n
            assert at == whole


def test_tiers():
    """Each tier has windows of its own size, opened by pieces of that tier; long windows' gaps hold shorter ones."""
    lengths = [600] * 4 + [400] * 30 + [200] * 30 + [100] * 40 + [20] * 60
    windows, _ = packing.pack_block([(d, 0, n) for d, n in enumerate(lengths)])
    sizes = collections.Counter(sum(n for *_, n in w) for w in windows)
    assert sizes[1024] == 4 and all(sizes[t] for t in packing.TIERS[:4])
    for window in windows:
        size = sum(n for *_, n in window)
        if size >= 128:
            assert size // 2 < window[0][2] <= size and all(n <= size // 2 for *_, n in window[1:])
    assert [w for w in windows if sum(n for *_, n in w) == 1024][0][:2] == [(3, 0, 600), (33, 0, 400)]


def test_balanced_steps():
    r = random.Random(3)
    sizes = [r.choice(packing.TIERS) for _ in range(3000)] + [7, 1]
    steps = packing.balanced_steps(sizes)
    total = collections.Counter()
    for size, step in zip(sizes, steps, strict=True):
        total[step] += size
    assert len(total) == -(-sum(sizes) // packing.STEP_TOKENS) and max(total.values()) - min(total.values()) <= 64


def test_unsupported_tokenizers(tmp_path):
    import json

    with open(tokenizer_file("byte_bpe_50k.json"), encoding="utf-8") as file:
        spec = json.load(file)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}):
        path = tmp_path / "other.json"
        path.write_text(json.dumps(spec | change))
        with pytest.raises(ValueError, match="not a byte-level"):
            packing.byte_bpe_encoder(str(path))


def test_encoder_equals_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    encode = packing.byte_bpe_encoder(tokenizer_file("byte_bpe_50k.json"))
    r = random.Random(6)
    odd = ["".join(r.choice(["a", "the", " ", "  ", "\n", "é", "😀", "ing", ",", ".", "'s", "1", "\u0085", "\x1c", "　", "<|endoftext|>", "²", "́"]) for _ in range(r.randint(0, 12))) for _ in range(600)]
    assert [np.frombuffer(x, "<u4").tolist() for x in encode(odd)] == [e.ids for e in library.encode_batch(odd, add_special_tokens=False)]


def test_language_ids(spark, sf_dir, docs, empty):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r for r in language_id.language_ids(table).collect()}
    truth = {r.doc_id: r.lang for r in table.collect()}
    held = [i for i in got if got[i].held_out]
    assert set(held) == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(got[i].lang_pred == truth[i] for i in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())
    unique = docs.filter("doc_id <> 3 and doc_id <> 10")
    texts = dict(source(unique))
    for r in language_id.identify(unique, language_id.fit(table)).collect():
        assert (r.lang_pred == "und") == (not re.search(r"[^\W\d_]", texts[r.doc_id] or ""))
    assert language_id.language_ids(docs).count() == docs.count()
    assert language_id.language_ids(empty).count() == 0
    unlabelled = language_id.language_ids(table.withColumn("lang", F.lit(None).cast("string"))).select("lang_pred").distinct().collect()
    assert [r.lang_pred for r in unlabelled] == ["und"]


def test_rare_languages_and_long_texts_are_learned(spark, monkeypatch):
    """A language of few documents has its share of the sample, and a long text is seen to its end."""
    monkeypatch.setattr(language_id, "TRAIN_DOCS", 40)
    common, rare = ("abcdef", "uvwxyz")
    r = random.Random(1)

    def text(letters, n):
        return " ".join("".join(r.choice(letters) for _ in range(5)) for _ in range(n))

    rows = [(k, text(common, 30), "aa") for k in range(3000)] + [(5000 + k, text(rare, 30), "zz") for k in range(8)]
    df = spark.createDataFrame([*rows, (9000, "1 2 ² _", "aa"), (9001, None, "bb")], "doc_id long, text string, lang string")
    crf = language_id.fit(df)
    assert crf.langs == ["aa", "zz"]
    pred = {x.doc_id: x.lang_pred for x in language_id.identify(df, crf).collect()}
    assert all(pred[i] == lang for i, _, lang in rows) and pred[9000] == pred[9001] == "und"


def test_all_words_of_a_sample_are_learned_from(monkeypatch):
    """Words that stand once, anywhere in a long text, are in the sequences of each pass."""
    seen = []
    real = np.unique

    def unique(x, **more):
        if x.ndim == 2 and more.get("return_inverse"):
            seen.append(set(x.ravel().tolist()))
        return real(x, **more)

    monkeypatch.setattr(language_id.np, "unique", unique)
    monkeypatch.setattr(language_id, "PASSES", 1)
    letters = "abcdefghij"
    language_id.train([("aa", ["".join(letters[int(d)] for d in str(k)) for k in range(30_000)]), ("bb", ["zz"] * 50)])
    assert set().union(*seen) == set(range(30_001))


def test_rows_of_few_ids_are_bounded_in_each_task(spark, monkeypatch):
    monkeypatch.setattr(language_id, "TRAIN_DOCS", 20)
    free = [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2][:2]
    rows = [(free[0], f"uno w{k} dos", "es") for k in range(3000)] + [(free[1], "one two three", "en")] * 3000
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    assert language_id.fit(df).langs == ["en", "es"]


def test_marginals_are_exact():
    """Forward-backward against the sum over all labellings."""
    import itertools

    rng = np.random.default_rng(1)
    crf = language_id.Crf(["a", "b", "c"], {}, np.zeros((1, 3), np.float32), rng.normal(size=(3, 3)), rng.normal(size=3))
    scores, word, lengths = rng.normal(size=(5, 3)), np.array([0, 1, 2, 3, 4, 1, 0, 2]), np.array([2, 5, 1])
    got = crf.marginals(scores, word, lengths)
    at = 0
    for n in lengths:
        want = np.zeros((n, 3))
        for y in itertools.product(range(3), repeat=int(n)):
            p = np.exp(crf.start[y[0]] + sum(scores[word[at + k], y[k]] for k in range(n)) + sum(crf.transitions[y[k], y[k + 1]] for k in range(n - 1)))
            for k in range(n):
                want[k, y[k]] += p
        assert np.allclose(got[at : at + n], want / want.sum(1, keepdims=True))
        at += n


def test_code_switching(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("lang in ('en', 'fr')").collect()
    samples = [(r.lang, language_id.words_of(r.text)) for r in rows]
    crf = language_id.train(samples[:80])
    en, fr = (next(w for lang, w in samples[80:] if lang == name and len(w) > 40)[:40] for name in ("en", "fr"))
    words = list(dict.fromkeys(en + fr))
    gamma = crf.marginals(crf.emissions(words), np.array([words.index(w) for w in en + fr]), np.array([80]))
    assert (gamma[:38].argmax(1) == 0).mean() > 0.9 and (gamma[42:].argmax(1) == 1).mean() > 0.9


@pytest.mark.parametrize("block", [512, 16])
def test_near_vectors(spark, block, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "MISS", 1e-9)
    rng = np.random.default_rng(2)
    rows = []
    for k in range(260):
        rows.append((k, rng.normal(size=16).tolist(), k % 3))
    dense = rng.normal(size=16)
    rows += [(1000 + k, (dense + rng.normal(size=16) * 0.03).tolist(), 1) for k in range(90)]
    rows += [(2000, rows[0][1], 0), (2001, rows[0][1], 1), (2002, [2 * x for x in rows[1][1]], 1), (2003, None, 1), (2004, [0.0] * 16, 1), (2005, [float("nan")] * 16, 1), (2006, rows[0][1], None), (2007, [1.0, 2.0], 0), (2008, [1.0, 2.0], 0), (None, rows[2][1], 2), (2009, [None, 1.0], 0), (2010, [], 0), (2000, rows[0][1], 0)]
    df = spark.createDataFrame([(*r, 1, "h") for r in rows], "vec_id long, embedding array<float>, label int, row int, head string").repartition(4)
    links, n = collections.defaultdict(list), len(rows)
    unit = [None if not v or None in v or not np.isfinite(v).all() or not any(v) else np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) for _, v, _ in rows]
    for a in range(n):
        for b in range(a):
            if rows[a][2] is not None and rows[a][2] == rows[b][2] and unit[a] is not None and unit[b] is not None and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.93:
                links[a].append(b)
                links[b].append(a)
    want = []
    for a in range(n):
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        least = min((rows[k][0] for k in seen if rows[k][0] is not None), default=None)
        want.append((rows[a][0], len(links[a]), least, rows[a][0] == least))
    got = [tuple(r) for r in embedding_dedup.near_vectors(df).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def test_passes_find_the_links(spark, monkeypatch):
    """Recall of the passes alone, at production settings, where one label is many blocks; what's left is exact."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(5000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    noise = rng.normal(size=(1500, 64))
    noise -= (noise * base[:1500]).sum(axis=1, keepdims=True) * base[:1500]
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    cosine = rng.uniform(0.9301, 1, size=(1500, 1))
    rows = np.concatenate([base, cosine * base[:1500] + np.sqrt(1 - cosine**2) * noise]).astype(np.float32)
    unit = rows.astype(float) / np.linalg.norm(rows.astype(float), axis=1, keepdims=True)
    want = ((unit @ unit.T) >= 0.93).sum(axis=1) - 1
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(rows)], "vec_id long, embedding array<float>, label int").repartition(4)

    def recall():
        got = {r.vec_id: r.n_links for r in embedding_dedup.near_vectors(df).collect()}
        assert all(got[k] <= want[k] for k in got)
        return sum(got.values()) / want.sum()

    assert recall() >= 0.999
    real = embedding_dedup._all_compared
    monkeypatch.setattr(embedding_dedup, "_all_compared", lambda placed, least: real(placed.limit(0), least))
    alone = recall()
    print("recall of the passes alone", alone)
    assert alone >= 0.9


def test_near_vectors_in_a_cone(spark, monkeypatch):
    """Background vectors of cosine 0.8 with each other, which few hyperplanes part."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 8)
    rng = np.random.default_rng(11)
    axis = np.eye(64)[0]

    def unit(x):
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    aside = unit(np.concatenate([np.zeros((1200, 1)), rng.normal(size=(1200, 63))], axis=1))
    cone = math.sqrt(0.8) * axis + math.sqrt(0.2) * aside
    turned = rng.normal(size=(400, 64))
    turned = unit(turned - (turned * cone[:400]).sum(axis=1, keepdims=True) * cone[:400])
    rows = np.concatenate([cone, 0.935 * cone[:400] + math.sqrt(1 - 0.935**2) * turned])
    want = ((rows @ rows.T) >= 0.93).sum(axis=1) - 1
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(rows)], "vec_id long, embedding array<double>, label int").repartition(4)
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_vectors(df).collect()}
    assert [got[k] for k in range(len(rows))] == want.tolist()


def test_pipeline(spark, sf_dir, docs, empty):
    import corpus_pipeline as pipeline

    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        for df in (table, docs, empty):
            assert stage(spark, df, sf_dir).columns == df.columns, name
    kept = pipeline.exact(spark, pipeline.language(spark, table, sf_dir), sf_dir)
    texts = [r.text for r in kept.collect()]
    assert len({exact_text(t) for t in texts}) == len(texts)
    final = pipeline.near(spark, kept, sf_dir).select("doc_id", "text").collect()
    assert len(final) == len({c for _, _, c, _ in brute_components([(r.doc_id, r.text) for r in kept.collect()], 5, 80)})
    clean = {r.doc_id: r.text for r in pipeline.private(spark, table, sf_dir).collect()}
    assert len(clean) == table.count() and all(not base_spans(t) for t in clean.values())
    kept_ids = [r.doc_id for r in pipeline.near(spark, docs, sf_dir).collect()]
    want = {c for i, _, c, _ in brute_components(source(docs), 5, 80)}
    assert {i for i in kept_ids if i is not None} == {i for i in want if i is not None}
    assert pipeline.packed(spark, docs, sf_dir).filter("start = 0").count() == docs.count() and pipeline.packed(spark, empty, sf_dir).count() == 0
    assert pipeline.run(spark, sf_dir).count() > 0


def test_columns_of_any_name_are_kept(spark, sf_dir, tmp_path):
    """Names that the operators use inside, with and without marks."""
    import corpus_pipeline as pipeline

    table = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id < 60")
    names = ["__row", "__key", "__words", "__terms", "__base", "__certainty", "row", "row_", "Base", "terms", "slot", "__slot", "shard", "best", "component", "certainty", "words", "c0", "id", "bytes", "hash", "label", "text_"]
    df = table.select("*", *(F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names))
    sharding.write_shards(df, str(tmp_path / "s"), 3)
    back = spark.read.parquet(str(tmp_path / "s"))
    for name, out in [("shards", back), *((name, stage(spark, df, sf_dir)) for name, stage in pipeline.STAGES[:-1])]:
        assert set(df.columns) <= set(out.columns), name
        wrong = [n for n in names if out.filter(F.col(f"`{n}`") != F.concat(F.lit(n), F.col("doc_id").cast("string"))).count()]
        assert not wrong, (name, wrong)
    assert back.count() == df.count() and set(back.columns) - set(df.columns) == {"__slot_", "shard_"}
    assert pipeline.packed(spark, df, sf_dir).count() > 0


def test_pipeline_keeps_mixed_and_unlabelled_texts(spark, sf_dir):
    import corpus_pipeline as pipeline

    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = {}
    for r in table.filter("n_chars > 1000").orderBy("doc_id").collect():
        words.setdefault(r.lang, []).extend(language_id.words_of(r.text))
    a, b, c = (words[k] for k in sorted(words)[:3])
    mixed = {-1: a[:80] + b[:60] + c[:60], -2: a[100:149] + b[100:149] + c[100:102], -3: c[200:240] + a[200:230] + b[200:230]}
    more = spark.createDataFrame([(k, " ".join(w), "zz", None, None) for k, w in mixed.items()], "doc_id long, text string, lang string, source string, n_chars long").withColumn("lang", F.lit(None).cast("string"))
    kept = {r.doc_id for r in pipeline.language(spark, table.unionByName(more.select(*table.columns)), sf_dir).select("doc_id").collect()}
    assert set(mixed) <= kept
    unlabelled = table.withColumn("lang", F.lit(None).cast("string"))
    assert pipeline.language(spark, unlabelled, sf_dir).count() == sum(bool(re.search(r"[^\W\d_]", r.text or "")) for r in table.collect())


def test_language_of_one_repeated_id_is_learned(spark):
    from gapwise.llm.language_id import fit, hash_edge

    assert hash_edge(0.0) == -(2**63) and hash_edge(0.5) == 0 and hash_edge(3.0) == 2**63 - 1
    free = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 2]
    rows = [(free[0], "uno dos tres", "es")] * 5000 + [(i, "one two three", "en") for i in free]
    model = fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == ["en", "es"]
