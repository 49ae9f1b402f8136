"""Ranked lexical search: a segmented inverted index with block maxima, searched by Block-Max WAND."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, column_or_null, grouped

#: Postings of a block; documents and postings of a segment, which is built and searched in memory.
BLOCK, SEGMENT_DOCS, SEGMENT_POSTINGS = 64, 16_384, 2_000_000
#: Queries that are searched together, and documents between two looks at the threshold.
QUERY_BLOCK, STRIDE = 256, 2_048
#: Weights of the length in a document's m, in hundredths.
BASE, SLOPE = 10, 90
#: What of UTF-8 is in no term becomes spaces, A-Z become a-z.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
ROWS = 100_000


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a posting adds to a score, but for its term's weight."""
    return (1_000_000_000 * tf) // (1_000 * tf + 8 * m)


def packed_numbers(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in groups of seven bits, the lowest first, the last of a number below 128; and where each ends."""
    sizes = 1 + sum((values >= 1 << 7 * k).astype(np.int64) for k in range(1, 9))
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    at = ends - sizes
    for k in range(int(sizes.max(initial=0))):
        has = sizes > k
        out[at[has] + k] = ((values[has] >> 7 * k) & 127) | np.where(sizes[has] > k + 1, 128, 0)
    return out, ends


def unpacked_numbers(data: bytes) -> np.ndarray:
    a = np.frombuffer(data, np.uint8).astype(np.int64)
    ends = np.flatnonzero(a < 128)
    if len(ends) == len(a):
        return a
    starts = np.concatenate([[0], ends[:-1] + 1])
    return np.add.reduceat((a & 127) << 7 * (np.arange(len(a)) - np.repeat(starts, ends - starts + 1)), starts)


class Segment:
    """Documents of a task, up to a bound, and their postings."""

    def __init__(self):
        self.terms: dict[bytes, int] = defaultdict()
        self.terms.default_factory = self.terms.__len__
        self.ids, self.lengths, self.term, self.tf = [], [], [], []
        self.postings = 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        times = Counter(terms_of(text))
        if not times:
            return
        self.ids.append(doc_id)
        self.lengths.append(times.total())
        self.term.append(np.fromiter(map(self.terms.__getitem__, times), np.int32, len(times)))
        self.tf.append(np.fromiter(times.values(), np.int64, len(times)))
        self.postings += len(times)

    def full(self) -> bool:
        return len(self.ids) >= SEGMENT_DOCS or self.postings >= SEGMENT_POSTINGS

    def rows(self, number: int, docs: int, words: int):
        """A row of the documents' ids and m, with block -1, and one for each block of each term's postings."""
        import pyarrow as pa

        names = ["segment", "term", "block", "first", "last", "n", "impact", "data"]
        m = BASE + (SLOPE * np.array(self.lengths, np.int64) * docs) // words
        known = np.array([i is not None for i in self.ids], np.uint8)
        head = np.array([i or 0 for i in self.ids], np.int64).tobytes() + m.tobytes() + known.tobytes()
        yield pa.RecordBatch.from_arrays(
            [pa.array([number]), pa.array([None], pa.string()), pa.array([-1], pa.int32()), pa.array([0], pa.int32()), pa.array([0], pa.int32()), pa.array([len(m)], pa.int32()), pa.array([0], pa.int64()), pa.array([head], pa.binary())], names=names
        )
        term = np.concatenate(self.term)
        doc = np.repeat(np.arange(len(m)), [len(t) for t in self.term])
        order = np.argsort(term, kind="stable")
        term, doc, tf = term[order], doc[order], np.concatenate(self.tf)[order]
        starts = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
        place = np.arange(len(term)) - np.repeat(starts, np.diff(np.append(starts, len(term))))
        at = np.flatnonzero(place % BLOCK == 0)
        end = np.append(at[1:], len(term))
        gaps = np.diff(doc, prepend=0)
        gaps[at] = doc[at]
        data, ends = packed_numbers(np.stack([gaps, tf], axis=1).ravel())
        offsets = np.concatenate([[0], ends[2 * end - 1]]).astype(np.int32)
        blocks = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])
        top = np.maximum.reduceat(impact(tf, m[doc]), at)
        whole = pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(at), number)), pa.array(list(self.terms), pa.string()).take(pa.array(term[at])), pa.array((place[at] // BLOCK).astype(np.int32)), pa.array(doc[at].astype(np.int32)), pa.array(doc[end - 1].astype(np.int32)), pa.array((end - at).astype(np.int32)), pa.array(top), blocks],
            names=names,
        )
        for k in range(0, len(at), ROWS):
            yield whole.slice(k, ROWS)


class LexicalIndex:
    """A stored index: `rows` (segment, term, block, first, last, n, impact, data) and the corpus counts `docs`, `words`.

    Each segment is of documents that one task read, in their order there; a posting is a gap between places and a
    count. impact is the largest of the block's postings.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        self.scratch = Scratch(docs.sparkSession, "lexical")
        text = column_or_null(docs, text_col, "string")
        thin = docs.select(column_or_null(docs, id_col, "long").alias("id"), F.coalesce(text, F.lit("")).cast("binary").alias("text"))

        def lengths(batches):
            import pyarrow as pa

            for batch in batches:
                sizes = [n for text in batch.column(0) if (n := len(terms_of(text.as_py())))]
                yield pa.RecordBatch.from_arrays([pa.array([len(sizes)]), pa.array([sum(sizes)])], names=["docs", "words"])

        counted = thin.select("text").mapInArrow(lengths, "docs long, words long").agg(F.sum("docs"), F.sum("words")).first()
        count, words = self.docs, self.words = counted[0] or 0, counted[1] or 0

        def run(batches):
            number = TaskContext.get().partitionId() << 32
            segment = Segment()
            for batch in batches:
                for doc_id, own in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    segment.add(doc_id, own.as_py())
                    if segment.full():
                        yield from segment.rows(number, count, words)
                        number, segment = number + 1, Segment()
            if segment.ids:
                yield from segment.rows(number, count, words)

        self.rows = self.scratch.save(thin.mapInArrow(run, "segment long, term string, block int, first int, last int, n int, impact long, data binary"), "index")


def _best(batches, top: int):
    """(item, doc_id, score): the best documents of a task's segments for each query of each query block."""
    import pyarrow as pa

    kept: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # scores, ids, whether the id is null
    last = None

    def passed_on():
        for item, (score, ids, null) in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), item)), pa.array(ids, mask=null), pa.array(score)], names=["item", "doc_id", "score"])
        kept.clear()

    for (queries, _), rows in grouped(batches, 2):
        if queries != last:
            yield from passed_on()
            last = queries
        block, first, end, n, weight = (rows.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (3, 4, 5, 6, 9))
        high = rows.column(7).to_numpy(zero_copy_only=False) * weight
        data, end = rows.column(8), end + 1
        size, head = int(n[0]), data[0].as_py()
        ids, m = np.frombuffer(head, np.int64, size), np.frombuffer(head, np.int64, size, 8 * size)
        null = np.frombuffer(head, np.uint8, size, 16 * size) == 0
        starts = np.flatnonzero(block == 0)
        wanted: dict[int, list[np.ndarray]] = {}
        for a, b in zip(starts, np.append(starts[1:], len(block)), strict=True):
            for item in rows.column(10)[int(a)].as_py():
                wanted.setdefault(item, []).append(np.arange(a, b))
        opened: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def postings(k: int):
            if k not in opened:
                numbers = unpacked_numbers(data[k].as_py())
                doc = np.cumsum(numbers[0::2])
                opened[k] = doc, impact(numbers[1::2], m[doc]) * weight[k]
            return opened[k]

        for item, parts in wanted.items():
            own = np.concatenate(parts)
            # shallow: what blocks that reach over a document add up to, without opening them
            bound = np.zeros(size + 1, np.int64)
            np.add.at(bound, first[own], high[own])
            np.subtract.at(bound, end[own], high[own])
            bound = np.cumsum(bound)[:size]
            least, at = 1, 0
            if item in kept and len(kept[item][0]) == top:
                least = max(1, int(kept[item][0][-1]))
            while at < size:
                live = bound[at:] >= least
                step = int(live.argmax())
                if not live[step]:
                    break
                at, live = at + step, live[step : step + STRIDE]
                to = at + len(live)
                before = np.concatenate([[0], np.cumsum(live)])
                near = own[(end[own] > at) & (first[own] < to)]
                near = near[before[np.minimum(end[near], to) - at] > before[np.maximum(first[near], at) - at]]
                score = np.zeros(len(live), np.int64)
                docs, adds = zip(*map(postings, near.tolist()), strict=True)
                docs, adds = np.concatenate(docs) - at, np.concatenate(adds)
                inside = (docs >= 0) & (docs < len(live))
                np.add.at(score, docs[inside], adds[inside])
                good = np.flatnonzero(live & (score >= least))
                if len(good):
                    old = kept.get(item, (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)))
                    merged = [np.concatenate([o, new]) for o, new in zip(old, (score[good], ids[at + good], null[at + good]), strict=True)]
                    order = np.lexsort((merged[1], merged[2], -merged[0]))[:top]
                    kept[item] = tuple(x[order] for x in merged)
                    if len(order) == top:
                        least = max(1, int(kept[item][0][-1]))
                at = to
    yield from passed_on()


def search(index: LexicalIndex, queries: DataFrame, top: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The `top` documents of the index with the highest scores above 0 for each query: id, rank, doc_id, score.

    Terms are runs of ASCII letters, digits and characters beyond ASCII, A-Z in lower case. A term held by df of N
    documents weighs w = floor(1000 ln((2 N + 2) / (2 df + 1))); a document of n terms has m = 10 + 90 n N div L, where
    L counts all terms; it scores the sum of w (1e9 tf div (1000 tf + 8 m)) over the query's distinct terms, in 64-bit
    integers. Equal scores rank by ascending doc_id.

    A task gets, for a block of queries, the posting blocks of their terms in some segments, and for each query goes
    through a segment in document order. The largest impacts of the blocks that lie over a document bound its score;
    where that is below the query's threshold, its worst kept score, blocks are passed over without being opened.
    Equality doesn't rule out. Each task's best are merged for each query.

    Null or empty texts: no terms, no rows. Null doc_ids rank after others of their score. Queries that repeat an id,
    and documents that do, are ranked each on its own. Long texts count whole. Empty table on either side: no rows.
    """
    scratch = index.scratch

    def split(batches):
        import pyarrow as pa

        for batch in batches:
            terms = [list(dict.fromkeys(terms_of(x.as_py()))) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(terms, pa.list_(pa.string()))], names=["item", "id", "terms"])

    thin = queries.select(F.monotonically_increasing_id().alias("item"), column_or_null(queries, id_col, "long").alias("id"), F.coalesce(column_or_null(queries, text_col, "string"), F.lit("")).cast("binary").alias("text"))
    items = scratch.save(thin.mapInArrow(split, "item long, id long, terms array<string>"), "items")
    asked = items.select("item", F.explode("terms").alias("term"))
    needed = scratch.save(index.rows.filter("block >= 0").join(asked.select("term").distinct(), "term", "left_semi"), "needed")
    weight = F.floor(1000 * F.log(F.lit(2.0 * index.docs + 2) / (2 * F.sum("n") + 1).cast("double"))).cast("long")
    weights = scratch.save(needed.groupBy("term").agg(weight.alias("weight")), "weights")
    wanted = asked.join(weights, "term").groupBy(F.floor(F.col("item") / QUERY_BLOCK).alias("queries"), "term", "weight").agg(F.collect_list("item").alias("items"))
    wanted = scratch.save(wanted, "wanted")
    rows = needed.join(wanted, "term").select("queries", "segment", "term", "block", "first", "last", "n", "impact", "data", "weight", F.when(F.col("block") == 0, F.col("items")).alias("items"))
    heads = rows.select("queries", "segment").distinct().join(index.rows.filter("block < 0"), "segment")
    heads = heads.select("queries", "segment", "term", "block", "first", "last", "n", "impact", "data", F.lit(0).cast("long").alias("weight"), F.lit(None).cast("array<long>").alias("items"))
    dealt = rows.unionByName(heads).repartition("queries", "segment").sortWithinPartitions("queries", "segment", "term", "block")
    best = dealt.mapInArrow(lambda batches: _best(batches, top), "item long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(items.select("item", "id"), "item").select(F.col("id").alias(id_col), "rank", "doc_id", "score")
