"""Near-duplicate detection: circulant MinHash, banding, and verification on whole shingle sets."""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, WordHashes, column_or_null
from .components import connected_components

#: The universe of the two permutations.
UNIVERSE_BITS = 21
#: Coordinates of a band, and the chance that a pair at the threshold shares none.
BAND_ROWS, MISS = 5, 1e-6
#: Members of a representative that are compared with it in one group.
GROUP = 256
#: Representatives that the open members of a group are compared with, one after the other, before the rest are
#: matched by the elements in which they differ from the last of them.
LEVELS = 3
#: Shingles of the sets that a comparing task keeps at hand.
KEPT_SHINGLES = 4_000_000
CHUNK = 1 << 20


def band_count(percent: int) -> int:
    return math.ceil(math.log(MISS) / math.log1p(-((percent / 100) ** BAND_ROWS)))


@lru_cache(1)
def permutations(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    """sigma, and pi with its start repeated at its end: pi shifted by k is the slice that starts at k."""
    rng = np.random.default_rng(20240601)
    size = 1 << UNIVERSE_BITS
    sigma = rng.permutation(size).astype(np.uint32)
    pi = rng.permutation(size).astype(np.uint32)
    return sigma, np.concatenate([pi, pi[:coordinates]])


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def normal_words(text: str | None) -> bytes:
    """The words, A-Z in lower case, joined by single spaces; bytes.split() parts at exactly the bytes 9-13 and 32."""
    return b" ".join((text or "").encode().lower().split())


_hashes = WordHashes(400_000)


def forget_words() -> None:
    """At a task's end: a worker that waits for its next task holds little."""
    _hashes.clear()


def word_hashes(normal: bytes) -> np.ndarray:
    """64 bits of the BLAKE2 hash of each word; long texts in chunks."""
    out, at = [np.empty(0, np.uint64)], 0
    while at < len(normal):
        end = len(normal) if len(normal) - at <= CHUNK else normal.find(b" ", at + CHUNK)
        end = len(normal) if end < 0 else end
        words = normal[at:end].split(b" ")
        out.append(np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words)))
        at = end + 1
    return np.concatenate(out)


def shingle_set(normal: bytes, width: int) -> np.ndarray:
    """Sorted distinct hashes of the text's `width`-word shingles; a shorter text is one shingle."""
    h = word_hashes(normal)
    if not len(h):
        return h
    size = min(width, len(h))
    out = np.full(len(h) - size + 1, 1 + size, np.uint64)
    for k in range(size):
        out = mix(out * np.uint64(0x9DDFEA08EB382D69) + h[k : len(h) - size + 1 + k])
    return np.unique(out)


def whole_shingles(normal: bytes, width: int, number: dict[bytes, int]) -> np.ndarray:
    """The distinct shingles themselves, each as the numbers of its words in the dictionary, which grows."""
    words = normal.split(b" ")
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int32)
    size = min(width, len(ids))
    rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(ids, size))
    return np.unique(rows.view(np.dtype((np.void, 4 * size))).ravel())


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """Coordinate k is the least pi(sigma(x) + k) over the set: slices of pi, minimised element by element."""
    sigma, pi = permutations(coordinates)
    slices = np.lib.stride_tricks.sliding_window_view(pi, coordinates)
    start = sigma[(shingles >> np.uint64(64 - UNIVERSE_BITS)).astype(np.int64)]
    out = np.full(coordinates, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(start), 2048):
        np.minimum(out, slices[start[at : at + 2048]].min(axis=0), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(-1, BAND_ROWS).astype(np.uint64)
    h = np.arange(len(rows), dtype=np.uint64)
    for k in range(BAND_ROWS):
        h = mix(h * np.uint64(0x9DDFEA08EB382D69) + rows[:, k] + np.uint64(1))
    return h.view(np.int64)


def signatures(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(row, id, class, n, bands, text): class is a 128-bit hash of the words, null without any; row is unique."""
    coordinates = band_count(percent) * BAND_ROWS

    def run(batches):
        import pyarrow as pa

        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                classes, sizes, bands = [], [], []
                for text in part.column(1).to_pylist():
                    normal = normal_words(text)
                    shingles = shingle_set(normal, width)
                    sizes.append(len(shingles))
                    classes.append(hashlib.blake2b(normal, digest_size=16).digest() if normal else None)
                    bands.append(band_keys(signature(shingles, coordinates)) if normal else None)
                rows = pa.array(np.arange(row, row + part.num_rows))
                row += part.num_rows
                yield pa.RecordBatch.from_arrays([rows, part.column(0), pa.array(classes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64())), part.column(1)], names=["row", "id", "class", "n", "bands", "text"])
        forget_words()

    thin = docs.select(column_or_null(docs, id_col, "long").alias("id"), column_or_null(docs, text_col, "string").alias("text"))
    return thin.mapInArrow(run, "row long, id long, class binary, n long, bands array<long>, text string")


def repeated(rows: DataFrame) -> DataFrame:
    """The rows (bucket, row) of all buckets that hold several, after one shuffle of thin rows, and few others.

    Ranges of (bucket, row) put a hot bucket into many tasks. A task passes on rows beside another one of their bucket,
    and its first and last row, whose buckets may go on in the ranges next to it.
    """

    def run(batches):
        import pyarrow as pa

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            bucket = table.column(0).to_numpy()
            same = bucket[1:] == bucket[:-1]
            wanted = np.append(False, same) | np.append(same, False)
            wanted[0] |= held is None or also
            # the last row waits for what follows
            yield from table.slice(0, len(bucket) - 1).filter(pa.array(wanted[:-1])).to_batches()
            held, also = table.slice(len(bucket) - 1).to_batches()[0], bool(wanted[-1])
        if held is not None:
            yield held

    return rows.repartitionByRange("bucket", "row").sortWithinPartitions("bucket", "row").mapInArrow(run, "bucket long, row long")


def beside(pairs: DataFrame, texts: DataFrame, width: int, found, kinds: str, scratch: Scratch, name: str) -> DataFrame:
    """What found(head, own) gives for each pair (g, m), as columns of `kinds` after those of `pairs`.

    The members of a representative g are dealt to groups of about GROUP; each gets the representative's text once,
    ahead of its members', and a task streams through its groups. head and own are Texts. Sets that recur are kept,
    up to a bound.
    """
    # stored apart from its join, which adaptive execution can then split at a hot representative
    sizes = scratch.save(pairs.groupBy("g").agg(F.count(F.lit(1)).alias("members")), f"{name}-sizes")
    salt = F.pmod(F.xxhash64("m"), F.ceil(F.col("members") / GROUP)).cast("int").alias("salt")
    asked = pairs.join(sizes, "g").select("g", salt, F.lit(1).alias("role"), F.col("m").alias("row"), F.struct(*pairs.columns).alias("pair"))
    asked = scratch.save(asked, f"{name}-asked")
    heads = asked.select("g", "salt").distinct().select("g", "salt", F.lit(0).alias("role"), F.col("g").alias("row"), F.lit(None).cast(asked.schema["pair"].dataType).alias("pair"))
    rows = asked.unionByName(heads).join(texts, "row").select("g", "salt", "role", "row", "text", "pair")
    rows = rows.repartition("g", "salt").sortWithinPartitions("g", "salt", "role")

    def run(batches):
        import pyarrow as pa

        kept: dict[int, np.ndarray] = {}
        held = 0
        g, head = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts_, taken, out = part.column(4), [], []
                for k, (h, role, row) in enumerate(zip(*(part.column(i).to_pylist() for i in (0, 2, 3)), strict=True)):
                    own = Text(texts_[k].as_py(), width, kept.get(row))
                    if row not in kept:
                        if held + len(own.shingles) > KEPT_SHINGLES:
                            kept, held = {}, 0
                        kept[row] = own.shingles
                        held += len(own.shingles)
                    if role == 0:
                        g, head = h, own
                        continue
                    if h != g:
                        raise ValueError("a representative's text is missing")
                    taken.append(k)
                    out.append(found(head, own))
                if taken:
                    pair = part.column(5).take(pa.array(taken))
                    values = [pa.array(v, t) for v, t in zip(zip(*out, strict=True), arrow_kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([*pair.flatten(), *values], names=names)
        forget_words()

    schema = F.struct(*pairs.columns)
    given = pairs.select(schema.alias("pair")).schema["pair"].dataType.fields
    more = [part.strip().split(" ", 1) for part in kinds.split(",")]
    names = [f.name for f in given] + [n for n, _ in more]
    import pyarrow as pa

    of = {"long": pa.int64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    arrow_kinds = [of[t] for _, t in more]
    return rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given) + ", " + kinds)


class Text:
    """A text's shingle set, and on demand the shingles themselves in numbers of a representative's dictionary."""

    def __init__(self, text: str, width: int, shingles: np.ndarray | None):
        self.normal, self.width = normal_words(text), width
        self.shingles = shingle_set(self.normal, width) if shingles is None else shingles
        self.number: dict[bytes, int] = {}
        self.whole = None

    def common_with(self, other: Text) -> int:
        """The size of the intersection, by the words themselves."""
        if self.whole is None:
            self.whole = whole_shingles(self.normal, self.width, self.number)
        theirs = whole_shingles(other.normal, self.width, self.number)
        if self.whole.dtype != theirs.dtype:
            return 0
        return len(self.whole) + len(theirs) - len(np.unique(np.concatenate([self.whole, theirs])))


def common_count(a: np.ndarray, b: np.ndarray) -> int:
    """The size of the intersection of two sorted sets."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return int(np.count_nonzero(both[1:] == both[:-1]))


def compared(pairs: DataFrame, texts: DataFrame, width: int, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """(g, m, apart, linked) for each pair: how many shingles are in one set alone, and whether they link.

    A link has 100 * common >= percent * union. Hashes rule pairs out; those that they don't are confirmed on the
    shingles' words, so a collision of hashes makes no link.
    """

    def found(head: Text, own: Text):
        n = len(head.shingles) + len(own.shingles)
        common = common_count(head.shingles, own.shingles)
        linked = 100 * common >= percent * (n - common)
        if linked:
            common = head.common_with(own)
            linked = 100 * common >= percent * (n - common)
        return n - 2 * common, linked

    return beside(pairs.select("g", "m"), texts, width, found, "apart long, linked boolean", scratch, name)


def most_apart(total, percent: int):
    """How many shingles may be in one of two linked sets alone, if their sizes add up to this."""
    return F.floor(total * (100 - percent) / (100 + percent))


def from_consensus(members: DataFrame, texts: DataFrame, width: int, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """How the members of each representative differ from what most of them have in common.

    members: g, m, n (set size), root, inner (root is that of g), near, last. Members that are near are wanted in pairs
    of an inner and another one (kind 0), those that are last in all pairs of theirs (kind 1).

    Returns (g, kind, m, n, root, inner, own, excess) and (g, kind, el, rank). own is E, the shingles that one of m and
    the consensus lacks; the consensus is what more than half of the members of that kind have, so words of g that
    nearly all lack are in few E. excess is (100 + percent) |E| - (100 - percent) n: x and y have 100 * common >=
    percent * union if and only if excess(x) + excess(y) <= 2 (100 + percent) |E(x) & E(y)|. rank is 0 where no wanted
    pair can meet in the element, else it grows with the pairs that can.
    """

    def found(head: Text, own: Text):
        return (np.setxor1d(head.shingles, own.shingles, assume_unique=True).view(np.int64),)

    kinds = F.explode(F.filter(F.array(F.when(F.col("near"), 0), F.when(F.col("last"), 1)), lambda k: k.isNotNull()))
    e = beside(members, texts, width, found, "els array<long>", scratch, "differences")
    e = scratch.save(e.select("g", kinds.alias("kind"), "m", "n", "root", "inner", "els"), "differences")
    inners = F.sum(F.col("inner").cast("int"))
    sizes = e.groupBy("g", "kind").agg(F.count(F.lit(1)).alias("members"), inners.alias("inners"))
    times = e.select("g", "kind", "inner", F.explode("els").alias("el")).groupBy("g", "kind", "el").agg(F.count(F.lit(1)).alias("times"), inners.alias("ins"))
    most = 2 * F.col("times") > F.col("members")
    held = times.join(sizes, ["g", "kind"]).select(
        "g", "kind", "el", most.alias("most"),
        F.when(most, F.col("members") - F.col("times")).otherwise(F.col("times")).alias("times"),
        F.when(most, F.col("inners") - F.col("ins")).otherwise(F.col("ins")).alias("ins"),
    )
    rank = F.when(F.col("kind") == 0, F.col("ins") * (F.col("times") - F.col("ins"))).when(F.col("times") > 1, F.col("times")).otherwise(0)
    held = scratch.save(held.select("g", "kind", "el", "most", rank.alias("rank")), "elements")
    common = held.filter("most").groupBy("g", "kind").agg(F.collect_list("el").alias("common"))
    # more than half of the members hold each of these, so all these arrays together are at most twice all els
    own = F.when(F.col("common").isNull(), F.col("els")).otherwise(F.concat(F.array_except("els", "common"), F.array_except("common", "els")))
    whole = e.join(common, ["g", "kind"], "left").select("g", "kind", "m", "n", "root", "inner", own.alias("own"))
    excess = (100 + percent) * F.size("own").cast("long") - (100 - percent) * F.col("n")
    return scratch.save(whole.withColumn("excess", excess), "own"), held.filter("rank > 0").select("g", "kind", "el", "rank")


def central_pairs(whole: DataFrame) -> DataFrame:
    """(g, m): for each representative and kind, the member nearest to the consensus with each other of another root.

    It has the least excess. If those of x and y don't add up to more than 0, neither do theirs and its, so both link
    with it.
    """
    head = whole.groupBy("g", "kind").agg(F.min(F.struct("excess", "m", "root")).alias("head"))
    pairs = whole.join(head, ["g", "kind"]).filter(F.col("root") != F.col("head.root"))
    return pairs.select(F.least("m", "head.m").alias("g"), F.greatest("m", "head.m").alias("m")).distinct()


def listed_elements(whole: DataFrame, ranks: DataFrame, percent: int) -> DataFrame:
    """(g, kind, m, n, root, inner, excess, size, at, el): the elements of each member by which a link could be found.

    Wanted pairs of different roots have a positive sum of excesses, once central_pairs() are united, so they link only
    if they share o = (excess(x) + excess(y)) / (2 (100 + percent)), at least 1, of their elements, and hence one of the
    first |E| - o + 1 of each, in an order that both keep. Elements in which no pair meets come first, then rare ones.
    """
    low = F.min("excess")
    lows = whole.groupBy("g", "kind").agg(F.min("root").alias("first"), F.max("root").alias("final"), low.alias("low"), F.min(F.when(F.col("inner"), F.col("excess"))).alias("in_low"), F.min(F.when(~F.col("inner"), F.col("excess"))).alias("out_low"))
    lows = lows.filter("first != final").drop("first", "final")
    partner = F.when(F.col("kind") == 1, F.col("low")).when(F.col("inner"), F.col("out_low")).otherwise(F.col("in_low"))
    least = F.greatest(F.lit(1), F.ceil((F.col("excess") + partner) / (2 * (100 + percent))))
    open_ = whole.join(lows, ["g", "kind"]).withColumn("size", F.size("own")).withColumn("reach", F.col("size") - least + 1).filter("reach > 0")
    keys = ["g", "kind", "m"]
    met = open_.select(*keys, F.explode("own").alias("el")).join(ranks, ["g", "kind", "el"])
    met = met.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "el"))).alias("met"))
    listed = open_.join(met, keys).select(*keys, "n", "root", "inner", "excess", "size", "reach", (F.col("size") - F.size("met")).alias("alone"), F.posexplode("met").alias("at", "e"))
    listed = listed.withColumn("at", F.col("at") + F.col("alone")).filter("at < reach")
    return listed.select(*keys, "n", "root", "inner", "excess", "size", "at", F.col("e.el").alias("el"))


def candidates(listed: DataFrame, percent: int) -> DataFrame:
    """The pairs (g, m) that listed_elements() leave as possible links."""

    def side(name: str, rows: DataFrame) -> DataFrame:
        return rows.select("g", "el", *(F.col(c).alias(f"{name}_{c}") for c in ("m", "n", "root", "excess", "size", "at")))

    need = F.greatest(F.lit(1), F.ceil((F.col("x_excess") + F.col("y_excess")) / (2 * (100 + percent))))
    # from the first shared element on, both have enough
    enough = F.least(F.col("x_size") - F.col("x_at"), F.col("y_size") - F.col("y_at")) >= need
    sizes = (100 * F.col("x_n") >= percent * F.col("y_n")) & (100 * F.col("y_n") >= percent * F.col("x_n"))
    wanted = (F.col("x_root") != F.col("y_root")) & enough & sizes
    near, last = listed.filter("kind = 0"), listed.filter("kind = 1")
    mixed = side("x", near.filter("not inner")).join(side("y", near.filter("inner")), ["g", "el"]).filter(wanted)
    among = side("x", last).join(side("y", last), ["g", "el"]).filter(wanted & (F.col("x_m") < F.col("y_m")))
    return mixed.unionByName(among).select(F.least("x_m", "y_m").alias("g"), F.greatest("x_m", "y_m").alias("m")).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each document: id, n_shingles, component_id, kept.

    Documents link whose sets of width-word shingles have 100 * common >= percent * union. component_id is the
    least id that links reach, kept tells the row that bears it. Two permutations give all coordinates of a
    signature; bands of BAND_ROWS of them put a pair at the threshold into a common bucket but with chance MISS.

    Texts with equal words are one class, and work goes on between classes. Buckets aren't expanded into pairs:
    1. The member of a bucket that meets most others in its buckets represents it. Each member is compared with its
       representatives on whole sets. Those that links don't join to a representative are compared with one of
       themselves in the same way, LEVELS times in all.
    2. What may still link are members of one representative that are in different components. Their sets are taken as
       differences from what most of them have in common; the member nearest to that is compared with the others, and
       candidates() finds the rest by the rarest of the elements in which they differ from it. Whole sets are compared.
    So every pair of a bucket is compared, in one component already, or ruled out by counts of differing elements.

    Null or empty text, or no words: no shingles, no links. Null ids: such rows take part; a component whose ids
    are all null has none and all its rows are kept. Repeated rows are in one class. Long texts count whole; sets
    near the size of the permutations' universe (2 million) share buckets more often, which costs comparisons, not
    links. Empty table: no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    signed = scratch.save(signatures(docs, width, percent, id_col, text_col), "signed")
    classes = signed.filter(F.col("class").isNotNull()).groupBy("class").agg(F.min("id").alias("first_id"), F.min("row").alias("row"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = scratch.save(classes, "classes")
    rows = scratch.save(repeated(classes.select(F.explode("bands").alias("bucket"), "row")), "repeated")
    buckets = scratch.save(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "buckets")
    shared = scratch.save(rows.join(buckets, "bucket").select("bucket", "row", "size"), "shared")
    central = scratch.save(shared.groupBy("row").agg(F.sum("size").alias("score")), "central")
    texts = scratch.save(signed.select("row", "text").join(central.select("row"), "row", "left_semi"), "texts")
    scratch.sweep()
    first = F.max(F.struct("score", "row"))["row"].alias("g")
    picks = scratch.save(shared.join(central, "row").groupBy("bucket").agg(first), "picks")
    asked = scratch.save(shared.join(picks, "bucket").filter("row != g").select("g", F.col("row").alias("m")).distinct(), "asked-0")

    roots, groups, level = None, None, 0
    while True:
        tested = scratch.save(compared(asked, texts, width, percent, scratch, f"level-{level}"), f"tested-{level}")
        roots = _united(roots, tested.filter("linked"), scratch, f"roots-{level}")
        level += 1
        groups = tested.select("g", "m", "apart") if groups is None else groups.unionByName(tested.select("g", "m", "apart"))
        outer = _rooted(tested.select("g", "m"), roots).filter("root != g_root")
        open_ = outer.groupBy("g").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x != y").select("g")
        outer = scratch.save(outer.join(open_, "g").select("g", "m", "root"), f"outer-{level}")
        scratch.sweep()
        if level == LEVELS or outer.isEmpty():
            break
        heads = outer.join(central, F.col("m") == F.col("row")).groupBy("g").agg(F.max(F.struct("score", "m"))["m"].alias("head"))
        asked = scratch.save(outer.join(heads, "g").filter("m != head").select(F.col("head").alias("g"), "m").distinct(), f"asked-{level}")

    last = outer.select("g", "m", F.lit(True).alias("last")).distinct()
    sets = classes.select(F.col("row").alias("m"), "n")
    every = _rooted(groups.distinct().join(last, ["g", "m"], "left").join(sets, "m"), roots)
    every = every.select("g", "m", "n", "apart", "root", (F.col("root") == F.col("g_root")).alias("inner"), F.coalesce("last", F.lit(False)).alias("last"))
    every = scratch.save(every, "groups")
    # an inner and an outer member can link only if their distances from g are no further apart than their sets may be
    limit = most_apart(F.col("n") + F.floor(100 * F.col("n") / percent), percent)
    reach = every.groupBy("g").agg(
        F.max(F.when(F.col("inner"), F.col("apart"))).alias("inner_high"), F.min(F.when(F.col("inner"), F.col("apart"))).alias("inner_low"),
        F.max(F.when(~F.col("inner"), F.col("apart"))).alias("outer_high"), F.min(F.when(~F.col("inner"), F.col("apart"))).alias("outer_low"),
    ).filter("outer_low is not null")
    near = F.when(F.col("inner"), F.col("apart").between(F.col("outer_low") - limit, F.col("outer_high") + limit)).otherwise(F.col("apart").between(F.col("inner_low") - limit, F.col("inner_high") + limit))
    members = every.join(reach, "g", "left").withColumn("near", F.coalesce(near, F.lit(False))).filter("near or last")
    members = scratch.save(members.select("g", "m", "n", "root", "inner", "near", "last"), "members")
    if not members.isEmpty():
        whole, ranks = from_consensus(members, texts, width, percent, scratch)
        links = scratch.save(compared(scratch.save(central_pairs(whole), "central-pairs"), texts, width, percent, scratch, "central").filter("linked"), "central-links")
        roots = _united(roots, links, scratch, "roots-central")
        now = roots.select(F.col("node").alias("m"), F.col("root").alias("to"))
        scratch.sweep()
        whole = whole.join(now, "m", "left").withColumn("root", F.coalesce("to", "m")).drop("to")
        listed = scratch.save(listed_elements(whole, ranks, percent), "listed")
        pairs = scratch.save(candidates(listed, percent), "pairs")
        links = scratch.save(compared(pairs, texts, width, percent, scratch, "pairs").filter("linked"), "links")
        roots = _united(roots, links, scratch, "roots")
    scratch.sweep()
    scratch.drop("texts", "repeated", "shared", "buckets", "picks", "groups", "differences", "elements", "own", "listed", "members")

    joined = classes.select("class", "first_id", "row").join(roots.select(F.col("node").alias("row"), "root"), "row", "left").select("class", "first_id", F.coalesce("root", "row").alias("root"))
    least = joined.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = joined.join(least, "root").select("class", "component_id")
    out = signed.select("id", "class", "n").join(named, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def _rooted(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Adds root, that of m, and g_root; a node without links is its own."""
    out = pairs.join(roots.select(F.col("node").alias("m"), "root"), "m", "left").join(roots.select(F.col("node").alias("g"), F.col("root").alias("g_root")), "g", "left")
    return out.withColumn("root", F.coalesce("root", "m")).withColumn("g_root", F.coalesce("g_root", "g"))


def _united(roots: DataFrame | None, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) after the links (g, m) as well; the new links join roots of before."""
    if roots is None:
        return connected_components(links.select(F.col("g").alias("a"), F.col("m").alias("b")), scratch, name)
    if links.isEmpty():
        return roots
    step = connected_components(_rooted(links.select("g", "m"), roots).select(F.col("root").alias("a"), F.col("g_root").alias("b")), scratch, f"{name}-step")
    moved = roots.join(step.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    new = step.join(roots.select("node"), "node", "left_anti").select("node", "root")
    return scratch.save(moved.unionByName(new), name)
