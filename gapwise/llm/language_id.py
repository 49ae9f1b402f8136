"""Language identification by a linear-chain conditional random field over words."""

from __future__ import annotations

import hashlib
import pickle
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column_or_null

#: Bound of the training sample: labelled documents of all languages together, alike for each. All their words count.
TRAIN_DOCS = 2_000
#: Shape of training: words of the pieces that documents are cut into, words of a sequence of spliced pieces, passes,
#: sequences in a step.
PIECE_WORDS, SEQUENCE_WORDS, PASSES, STEP = (8, 40), 64, 3, 300
BUCKETS = 1 << 18
NGRAMS = (2, 3, 4)
#: Characters that a task tags together, and words whose features it holds at a time.
BLOCK_CHARS, WORDS_AT_ONCE = 2_000_000, 20_000
UNDETERMINED = "und"

WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return [w for w in WORD.findall(text.lower()) if w.isalpha() or any(map(str.isalpha, w))]


def word_features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words, one after the other, and where each word's begin.

    Features are the n-grams of ^word$ (those with ^ or $ are affixes) and, for words of the lexicon, the word.
    """
    flat = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    length = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(length)
    word = np.repeat(np.arange(len(words)), length)
    place = np.arange(len(flat))
    found, owner = [], []
    for n in NGRAMS:
        if len(flat) < n:
            continue
        h = np.full(len(flat) - n + 1, 1469598103934665603 + n, np.uint64)
        for k in range(n):
            h = (h ^ flat[k : len(flat) - n + 1 + k]) * np.uint64(1099511628211)
        h ^= h >> np.uint64(29)
        own = word[: len(h)]
        fits = place[: len(h)] + n <= ends[own]
        found.append((h[fits] % np.uint64(BUCKETS)).astype(np.int64))
        owner.append(own[fits])
    known = [(i, f) for i, f in enumerate(map(lexicon.get, words)) if f is not None]
    if known:
        i, f = np.array(known, dtype=np.int64).T
        found.append(BUCKETS + f)
        owner.append(i)
    found, owner = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return found[order], np.searchsorted(owner[order], np.arange(len(words)))


@dataclass
class Crf:
    """weights: feature x language; transitions: from x to; start: language. Word k's score is the sum of its features'."""

    langs: list[str]
    lexicon: dict[str, int]
    weights: np.ndarray
    transitions: np.ndarray
    start: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        out = np.empty((len(words), len(self.langs)))
        for at in range(0, len(words), WORDS_AT_ONCE):
            features, begins = word_features(words[at : at + WORDS_AT_ONCE], self.lexicon)
            out[at : at + WORDS_AT_ONCE] = np.add.reduceat(self.weights[features], begins, axis=0)
        return out

    def marginals(self, scores: np.ndarray, word: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The posterior of each word of each sequence, by forward-backward; sequences stand one after another.

        All sequences advance together, the longest first, so a step works on those that still have words.
        """
        order = np.argsort(-lengths, kind="stable")
        start = np.concatenate([[0], np.cumsum(lengths)[:-1]])[order]
        size = lengths[order]
        steps = int(size[0])
        active = np.searchsorted(-size, -np.arange(steps), side="left")  # sequences longer than t
        potential = np.exp(scores - scores.max(axis=1, keepdims=True))
        step = np.exp(self.transitions - self.transitions.max())
        forward = np.empty((len(word), len(self.langs)))
        first = np.exp(self.start - self.start.max())
        message = None
        for t in range(steps):
            at = start[: active[t]] + t
            message = (potential[word[at]] * first) if t == 0 else (message[: active[t]] @ step) * potential[word[at]]
            message /= message.sum(axis=1, keepdims=True)
            forward[at] = message
        back = np.ones((active[-1], len(self.langs)))
        for t in range(steps - 2, -1, -1):
            ahead = start[: active[t + 1]] + t + 1
            back = (back * potential[word[ahead]]) @ step.T
            back /= back.sum(axis=1, keepdims=True)
            if active[t] > active[t + 1]:
                back = np.concatenate([back, np.ones((active[t] - active[t + 1], len(self.langs)))])
            forward[start[: active[t]] + t] *= back
        return forward / forward.sum(axis=1, keepdims=True)


def train(samples: list[tuple[str, list[str]]], seed: int = 7) -> Crf:
    """Learns from (language, words) pairs by AdaGrad on the conditional log-likelihood.

    Every word of every sample is learned from once a pass: samples are cut into pieces of 8 to 40 words, and the pieces,
    in random order, are spliced and cut into sequences, which gives the code switches that the transitions are learned
    from.
    """
    rng = np.random.default_rng(seed)
    langs = sorted({lang for lang, words in samples if len(words)})
    L = len(langs)
    counts: dict[str, int] = {}
    for _, words in samples:
        for w in words:
            counts[w] = counts.get(w, 0) + 1
    lexicon = {w: i for i, w in enumerate(sorted(w for w, n in counts.items() if n >= 8))}
    crf = Crf(langs, lexicon, np.zeros((BUCKETS + len(lexicon), L), np.float32), np.zeros((L, L)), np.zeros(L))
    if L < 2:
        return crf
    vocabulary = {w: i for i, w in enumerate(counts)}
    features, begins = word_features(list(vocabulary), lexicon)
    owner = np.repeat(np.arange(len(vocabulary)), np.diff([*begins, len(features)]))
    flat, label, piece = [], [], []
    pieces = 0
    for lang, words in samples:
        sizes = rng.integers(PIECE_WORDS[0], PIECE_WORDS[1] + 1, len(words) // PIECE_WORDS[0] + 1)
        cut = np.repeat(np.arange(len(sizes)), sizes)[: len(words)]
        flat.append(np.fromiter(map(vocabulary.__getitem__, words), np.int32, len(words)))
        label.append(np.full(len(words), langs.index(lang) if len(words) else 0, np.int32))
        piece.append(pieces + cut)
        pieces += len(sizes)
    shuffle = np.argsort(rng.permutation(pieces)[np.concatenate(piece)], kind="stable")
    # the last sequence is filled up from the start
    shuffle = np.resize(shuffle, -(-len(shuffle) // SEQUENCE_WORDS) * SEQUENCE_WORDS)
    X, Y = (np.concatenate(a)[shuffle].reshape(-1, SEQUENCE_WORDS) for a in (flat, label))
    squares = [np.full_like(p, 1e-6, dtype=np.float64) for p in (crf.weights, crf.transitions, crf.start)]
    hot = np.eye(L)
    for _ in range(PASSES):
        for at in range(0, len(X), STEP):
            x, y = X[at : at + STEP], Y[at : at + STEP]
            used, word = np.unique(x, return_inverse=True)
            rows = np.isin(owner, used)
            local = np.searchsorted(used, owner[rows])
            scores = np.zeros((len(used), L))
            feature = features[rows]
            values = crf.weights[feature]
            for k in range(L):
                scores[:, k] = np.bincount(local, values[:, k], len(used))
            gamma, pairs = _expectations(scores[word.reshape(x.shape)], crf)
            wrong = gamma - hot[y]
            per_word = np.stack([np.bincount(word.ravel(), wrong[..., k].ravel(), len(used)) for k in range(L)], 1)
            grad = np.stack([np.bincount(feature, per_word[local, k], len(crf.weights)) for k in range(L)], 1) / len(x)
            seen = np.stack([np.bincount(y[:, :-1].ravel(), (y[:, 1:] == k).ravel(), L) for k in range(L)], 1)
            for p, g, s in zip((crf.weights, crf.transitions, crf.start), (grad + 1e-6 * crf.weights, (pairs - seen) / len(x), wrong[:, 0].mean(0)), squares, strict=True):
                s += g * g
                p -= (0.3 * g / np.sqrt(s)).astype(p.dtype)
    return crf


def _expectations(scores: np.ndarray, crf: Crf) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of words and the expected number of each transition, for sequences of one length."""
    n, size, L = scores.shape
    potential = np.exp(scores - scores.max(axis=2, keepdims=True))
    step, first = np.exp(crf.transitions), np.exp(crf.start)
    forward, back = np.empty_like(potential), np.ones_like(potential)
    forward[:, 0] = potential[:, 0] * first
    forward[:, 0] /= forward[:, 0].sum(1, keepdims=True)
    for t in range(1, size):
        forward[:, t] = (forward[:, t - 1] @ step) * potential[:, t]
        forward[:, t] /= forward[:, t].sum(1, keepdims=True)
    pairs = np.zeros((L, L))
    for t in range(size - 2, -1, -1):
        ahead = back[:, t + 1] * potential[:, t + 1]
        joint = forward[:, t, :, None] * step * ahead[:, None, :]
        pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        back[:, t] = ahead @ step.T
        back[:, t] /= back[:, t].sum(1, keepdims=True)
    gamma = forward * back
    return gamma / gamma.sum(2, keepdims=True), pairs


def held_out(id_col: str = "doc_id"):
    """True for documents that nothing is learned from. Null ids: false, though nothing is learned from them either."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def hash_edge(share: float) -> int:
    """The signed 64-bit number that this share of all hashes doesn't exceed."""
    return min(2**63 - 1, int(share * 2**64) - 2**63)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Crf | None:
    """A model from at most TRAIN_DOCS labelled documents that aren't held out. None if there is nothing to learn.

    Each language has the same share of them, those with the smallest id hashes, so rare languages are learned too;
    of more languages than TRAIN_DOCS, those with the most documents are. All words of a chosen document count. Only
    documents with hashes below an edge are gathered, set from the number of a language's documents so that about
    twice its share is, and of these each task passes on no more than the share; one task learns from the bounded
    sample, and the model alone comes to the driver.

    Null ids, texts and languages: nothing is learned from such rows. Repeated rows count as often as they occur;
    where few ids bear most rows of a language its share may not be filled, but those of its smallest hash are there.
    Empty table: None. Other columns are ignored.
    """
    labelled = docs.select(
        F.xxhash64(column_or_null(docs, id_col, "long")).alias("h"), column_or_null(docs, id_col, "long").alias("id"), column_or_null(docs, text_col, "string").alias("text"), column_or_null(docs, lang_col, "string").alias("lang")
    ).filter(F.col("id").isNotNull() & ~held_out("id") & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counted = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("least")).orderBy(F.desc("n"), "lang").limit(TRAIN_DOCS).collect()
    if not counted:
        return None
    quota = max(1, TRAIN_DOCS // len(counted))
    edges = [(r.lang, max(r.least, hash_edge((2 * quota + 64) / r.n))) for r in counted]
    below = labelled.join(F.broadcast(docs.sparkSession.createDataFrame(edges, "lang string, edge long")), "lang").filter("h <= edge")

    def sample(batches):
        import pyarrow as pa

        least: dict[str, list] = {}  # each language's rows of this task that may be chosen: at most twice its share

        def cut(lang: str):
            rows = least[lang]
            rows.sort(key=lambda r: r[:2])
            del rows[quota:]

        for batch in batches:
            for h, text, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                least.setdefault(lang, []).append((h, hashlib.blake2b(text.encode(), digest_size=8).digest(), text))
                if len(least[lang]) >= 2 * quota:
                    cut(lang)
        for lang, rows in least.items():
            cut(lang)
            for h, tie, text in rows:
                yield pa.RecordBatch.from_arrays([pa.array([h], pa.int64()), pa.array([tie], pa.binary()), pa.array([lang], pa.string()), pa.array([words_of(text)], pa.list_(pa.string()))], names=["h", "tie", "lang", "words"])

    def learn(batches):
        import pyarrow as pa

        seen: dict[str, str] = {}  # one string for each word
        samples = [(lang.as_py(), [seen.setdefault(w, w) for w in words.as_py()]) for batch in batches for lang, words in zip(*batch.columns, strict=True) if len(words)]
        if samples:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(samples))], pa.binary())], names=["model"])

    near = below.select("h", "text", "lang").mapInArrow(sample, "h long, tie binary, lang string, words array<string>")
    # equal hashes are repeated ids; the bound holds for them too
    order = F.row_number().over(Window.partitionBy("lang").orderBy("h", "tie"))
    chosen = near.withColumn("place", order).filter(F.col("place") <= quota)
    found = chosen.repartition(1).sortWithinPartitions("lang", "place").select("lang", "words").mapInArrow(learn, "model binary").collect()
    return pickle.loads(found[0].model) if found else None


def identify(docs: DataFrame, model: Crf | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Adds to each row's id (and the columns in `keep`) lang_pred, score, n_words and certainty.

    Every word of the whole text gets the model's posterior over languages. The prediction is the language with
    the largest mean posterior, the score that mean. The certainty is the mean of each word's own largest posterior,
    which a mixed text can have as high as any.

    Null text, a text without letters, or no model: "und", 0. Null and repeated ids: each row gives a row. Long texts
    are tagged whole. Ties go to the language that comes first by name. Columns in `keep` may have any name; the text
    among them goes to Python once. Empty table: no rows.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def tag(texts: list[str | None]):
        crf = shared.value
        found = [words_of(t) if t else [] for t in texts]
        lengths = np.array([len(w) for w in found], dtype=np.int64)
        pred: list[str] = [UNDETERMINED] * len(texts)
        score, certainty = np.zeros(len(texts)), np.zeros(len(texts))
        full = np.flatnonzero(lengths)
        if crf is not None and len(full):
            flat = [w for words in found for w in words]
            vocabulary = {w: i for i, w in enumerate(dict.fromkeys(flat))}
            word = np.fromiter(map(vocabulary.__getitem__, flat), np.int64, len(flat))
            size = lengths[full]
            gamma = crf.marginals(crf.emissions(list(vocabulary)), word, size)
            begins = np.concatenate([[0], np.cumsum(size)[:-1]])
            share = np.add.reduceat(gamma, begins, axis=0) / size[:, None]
            certainty[full] = np.minimum(1.0, np.add.reduceat(gamma.max(axis=1), begins) / size)
            best = share.argmax(1)
            for k, b, s in zip(full, best, share.max(1), strict=True):
                pred[k] = crf.langs[b]
                score[k] = min(1.0, s)
        return pred, score, lengths, certainty

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute

        def done(parts):
            whole = pa.Table.from_batches(parts).combine_chunks()
            pred, score, lengths, certainty = tag(whole.column("text").to_pylist())
            if text_col not in keep:
                whole = whole.drop_columns(["text"])
            for name, values in (("lang_pred", pa.array(pred, pa.string())), ("score", pa.array(score)), ("n_words", pa.array(lengths)), ("certainty", pa.array(certainty))):
                whole = whole.append_column(name, values)
            yield from whole.to_batches()

        parts, held = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                parts.append(part)
                held += pa.compute.sum(pa.compute.binary_length(part.column("text"))).as_py() or 0
                if held >= BLOCK_CHARS:
                    yield from done(parts)
                    parts, held = [], 0
        if parts:
            yield from done(parts)

    thin = docs.select(column_or_null(docs, id_col, "long").alias("id"), column_or_null(docs, text_col, "string").alias("text"), *(F.col(f"`{c}`").alias(f"kept_{c}") for c in keep if c != text_col))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in thin.schema if f.name != "text" or text_col in keep)
    out = thin.mapInArrow(run, f"{kinds}, lang_pred string, score double, n_words long, certainty double")
    return out.select(F.col("id").alias(id_col), *(F.col("text" if c == text_col else f"`kept_{c}`").alias(c) for c in keep), "lang_pred", "score", "n_words", "certainty")


def language_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """fit() and identify() over one table: id, held_out, lang_pred, score, n_words.

    Null ids: not held out. Repeated rows: each gives a row. Long texts are tagged whole. Ties go to the language
    that comes first by name. Empty table: no rows. Other columns are ignored.
    """
    out = identify(docs, fit(docs, id_col, text_col, lang_col), id_col, text_col)
    return out.select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score", "n_words")
