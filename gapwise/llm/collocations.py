"""Phrase collocations by suffix-sigma: truncated suffixes, sorted in reverse, counted with one stack."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, column_or_null

#: Distinct suffixes that a task counts before it passes them on.
HELD_SUFFIXES = 500_000
#: A first word's suffixes go to as many groups, by their second word.
SPREAD = 64
#: Ends of pieces, as bytes, and what parts words beside the space; A-Z become a-z.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
NORMAL = bytes(10 if b in PIECE_ENDS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
ROWS = 50_000


def _suffixes(docs: DataFrame, most_words: int, text_col: str, lang_col: str) -> DataFrame:
    """(key, times): the suffixes of pieces, cut to most_words words, counted within a task. key is language, tab, words."""

    def run(batches):
        import pyarrow as pa

        held: dict[bytes, dict[bytes, int]] = {}

        def passed_on():
            for lang, own in held.items():
                keys, times = list(own), list(own.values())
                for at in range(0, len(keys), ROWS):
                    yield pa.RecordBatch.from_arrays([pa.array([lang + b"\t" + k for k in keys[at : at + ROWS]], pa.string()), pa.array(times[at : at + ROWS], pa.int64())], names=["key", "times"])
            held.clear()

        from collections import Counter

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                lang = lang.as_py().encode()
                for piece in text.as_py().translate(NORMAL).split(b"\n"):
                    words = piece.split()
                    whole = max(0, len(words) - most_words + 1)
                    own = held.setdefault(lang, Counter())
                    own.update(b" ".join(words[k:]) for k in range(whole, len(words)))
                    for at in range(0, whole, ROWS):  # a piece may be long
                        end = min(whole, at + ROWS)
                        own = held.setdefault(lang, Counter())
                        own.update(map(b" ".join, zip(*(words[at + k : end + k] for k in range(most_words)))))
                        if len(own) > HELD_SUFFIXES:
                            yield from passed_on()
                if sum(map(len, held.values())) > HELD_SUFFIXES:
                    yield from passed_on()
        yield from passed_on()

    text = F.coalesce(column_or_null(docs, text_col, "string"), F.lit("")).cast("binary")
    return docs.select(F.coalesce(column_or_null(docs, lang_col, "string"), F.lit("und")).alias("lang"), text.alias("text")).mapInArrow(run, "key string, times long")


def _prefixes(batches, most_words: int, least: int):
    """(key, words, times): the prefixes of suffixes that come in reverse order, with their counts.

    One stack holds, for each length, the prefix that is still open and its count so far; a prefix is passed on once a
    key comes that doesn't have it. Within a batch all prefixes of a length are closed together: their counts are sums
    over runs of rows. Phrases of two words or more that occur less than `least` times are left out.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute

    def closed(keys, words, times):
        return pa.RecordBatch.from_arrays([keys, pa.array(np.full(len(times), words, np.int32)), pa.array(times)], names=["key", "words", "times"])

    def cut(keys, words: int):
        return pa.array([" ".join(k.split(" ", words)[:words]) for k in keys.to_pylist()], pa.string())

    last, stack = None, []  # the key before, and the counts of its prefixes
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, times = batch.column(0), batch.column(1).to_numpy()
        if last is not None:
            keys, times = pa.concat_arrays([last, keys]), np.concatenate([[0], times])
        lists = pa.compute.split_pattern(keys, " ")
        at, values = lists.offsets.to_numpy(), lists.flatten()
        size, code = np.diff(at), values.dictionary_encode().indices.to_numpy()
        same = np.ones(len(size) - 1, bool)
        open_ = []
        for k in range(most_words):
            has = size > k
            own = np.where(has, code[np.minimum(at[:-1] + k, len(code) - 1)], -1)
            same = same & has[1:] & (own[1:] == own[:-1])
            starts = np.flatnonzero(np.concatenate([[True], ~same]))
            sums = np.add.reduceat(times, starts)
            if k < len(stack):
                sums[0] += stack[k]
            ends = has[starts]
            if has[-1]:
                open_.append(int(sums[-1]))
                ends[-1] = False
            if k:
                ends &= sums >= least
            done = pa.array(starts[ends])
            if len(done):
                yield closed(values.take(pa.array(at[starts[ends]])) if k == 0 else cut(keys.take(done), k + 1), k + 1, sums[ends])
        last, stack = keys[-1:], open_
    for k, total in enumerate(stack):
        if not k or total >= least:
            yield closed(cut(last, k + 1), k + 1, np.array([total]))


def phrase_counts(docs: DataFrame, most_words: int = 3, least: int = 10, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, phrase, words, times): all words, and all phrases of 2 to most_words words that occur `least` times or more.

    Suffixes of pieces are counted within each task, then shuffled by language and first word, where the second word
    spreads a frequent first word over SPREAD groups; a group is sorted in reverse and one stack counts all prefixes. A
    phrase of two words or more lies in one group whole; the parts of a single word's count are summed after that.
    """
    by_second = F.pmod(F.xxhash64(F.substring_index("key", " ", 2)), F.lit(SPREAD))
    dealt = _suffixes(docs, most_words, text_col, lang_col).repartition(F.substring_index("key", " ", 1), by_second)
    found = dealt.sortWithinPartitions(F.col("key").desc()).mapInArrow(lambda batches: _prefixes(batches, most_words, least), "key string, words int, times long")
    found = found.groupBy("key", "words").agg(F.sum("times").alias("times"))
    # words hold no tab, languages may
    phrase = F.substring_index("key", "\t", -1)
    return found.select(F.expr("substring(key, 1, length(key) - length(substring_index(key, '\t', -1)) - 1)").alias("lang"), phrase.alias("phrase"), "words", "times")


def collocations(docs: DataFrame, most_words: int = 3, least: int = 10, top: int | None = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Each language's phrases by how much oftener they occur than their parts let expect: lang, rank, phrase, a, l, r, n, score.

    Texts, A-Z in lower case, are split at . , ; : ! ? and line ends into pieces, those at spaces and tabs into words. a
    is the phrase's count; a cut after its first k words has l, r, the counts of both parts, and the score
    floor(1,000,000 a a / (l r)), in exact decimals. The cut with the lowest score counts, of equal ones the first. A
    phrase of 2 to most_words words with a >= least is listed, unless it lies within a longer one that is at least half
    as frequent. Ranks go by score, then a, highest first, then by the phrase's bytes; `top` ranks stay (None: all).
    n is the language's number of words.

    Null lang counts as `und`. Null and empty texts have no words. Long texts count whole, repeated rows each time; ids
    and other columns are ignored. Empty table: no rows.
    """
    scratch = Scratch(docs.sparkSession, "collocations")
    counts = scratch.save(phrase_counts(docs, most_words, least, text_col, lang_col), "counts")
    totals = counts.filter("words = 1").groupBy("lang").agg(F.sum("times").alias("n"))
    long = counts.filter("words > 1")
    words = F.split("phrase", " ")
    # parts of a frequent phrase are frequent, so they are among the counts
    cuts = long.select("lang", "phrase", F.col("times").alias("a"), words.alias("w"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("head"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("tail"))
    parts = counts.filter((F.col("words") > 1) | (F.col("times") >= least))
    lefts = parts.select("lang", F.col("phrase").alias("head"), F.col("times").alias("l"))
    rights = parts.select("lang", F.col("phrase").alias("tail"), F.col("times").alias("r"))
    cuts = cuts.join(lefts, ["lang", "head"]).join(rights, ["lang", "tail"])
    score = F.expr("(1000000BD * cast(a as decimal(16,0)) * cast(a as decimal(16,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.col("words") - 1),
            lambda size: F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda at: F.array_join(F.slice("w", at, size), " ")),
        )
    )
    within = long.filter("words > 2").withColumn("w", words).select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "times").groupBy("lang", "phrase").agg(F.max("times").alias("longer"))
    kept = best.join(within, ["lang", "phrase"], "left").filter("longer is null or 100 * longer < 50 * a")
    best_first = (F.col("cut.score").desc(), F.col("a").desc(), F.col("phrase"))
    if top is not None:  # a language's phrases are thinned in groups before they meet
        group = F.pmod(F.xxhash64("phrase"), F.lit(SPREAD))
        kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", group).orderBy(*best_first))).filter(F.col("rank") <= top)
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best_first)).cast("long"))
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
