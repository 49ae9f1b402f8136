"""Exact deduplication by Patricia tries that own all texts of their length and content hash."""

from __future__ import annotations

import hashlib
import os
import pickle
import struct
import tempfile
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .common import Scratch, column_or_null, lower_ascii

#: Bytes of texts that a trie holds in memory before it writes subtrees to disk, and what a node counts for.
TRIE_BYTES, NODE_BYTES = 48 << 20, 200


class Node:
    """`label` is the bytes on the edge to this node; `value` is set on terminals alone, `file` where the subtree is on disk."""

    __slots__ = ("label", "children", "value", "file")

    def __init__(self, label: bytes, value=None, file=None):
        self.label, self.children, self.value, self.file = label, {}, value, file


def shared_prefix(a: bytes, b: bytes, start: int) -> int:
    """How many bytes of `a` equal those of `b` from `start` on."""
    most = min(len(a), len(b) - start)
    if a[:most] == b[start : start + most]:
        return most
    low, high = 0, most
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[start + low : start + mid]:
            low = mid
        else:
            high = mid
    return low


class PatriciaOwners:
    """A compressed radix trie over byte strings; a terminal holds (owner id, row count) of its string.

    add() merges: counts add up and the owner is the one that `better` picks. When the trie exceeds `limit` bytes,
    subtrees go to files until half is left. They are taken along the heaviest edges, from where a subtree weighs
    half the limit at most, so a prefix that many strings share stays above them, however long it is. Later strings
    that lead to such a place are appended to its file, and items() builds a trie for each file in turn. A file that
    is too large alone spills again, further down.
    """

    def __init__(self, better, limit: int = TRIE_BYTES):
        self.better, self.limit = better, limit
        self.root, self.total, self.most = Node(b""), 0, limit

    def add(self, key: bytes, owner, count: int) -> None:
        self.total += self._insert(key, owner, count)
        if self.total > self.most:
            self._spill()
            self.most = max(self.limit, self.total + self.limit // 2)

    def _insert(self, key: bytes, owner, count: int) -> int:
        """Bytes that the trie has grown by."""
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                node.children[key[at]] = Node(key[at:], (owner, count))
                return len(key) - at + NODE_BYTES
            if child.file is not None:
                self._write(child.file, key, owner, count)
                return 0
            n = shared_prefix(child.label, key, at)
            if n < len(child.label):  # split the edge
                middle = Node(child.label[:n])
                child.label = child.label[n:]
                middle.children[child.label[0]] = child
                node.children[key[at]] = middle
                child = middle
            node, at = child, at + n
        old = node.value
        node.value = (owner, count) if old is None else (self.better(old[0], owner), old[1] + count)
        return NODE_BYTES if old is None else 0

    @staticmethod
    def _below(node: Node, prefix: bytes) -> Iterator[tuple[bytes, Node]]:
        """The nodes of a subtree with their whole strings; prefix is what stands above the subtree."""
        stack = [(node, prefix)]
        while stack:
            node, prefix = stack.pop()
            whole = prefix + node.label
            yield whole, node
            stack += [(child, whole) for child in node.children.values()]

    @staticmethod
    def _write(file, key: bytes, owner, count: int) -> None:
        data = pickle.dumps((key, owner, count), protocol=5)
        file.write(struct.pack("<Q", len(data)) + data)

    def _spill(self) -> None:
        order = [self.root]
        for node in order:
            order += node.children.values()
        weight: dict[int, int] = {}
        for node in reversed(order):
            weight[id(node)] = len(node.label) + NODE_BYTES + sum(weight[id(c)] for c in node.children.values())

        stays: set[int] = set()

        def heaviest(node: Node) -> Node | None:
            return max((c for c in node.children.values() if c.file is None and id(c) not in stays), key=lambda c: weight[id(c)], default=None)

        while self.total > self.limit // 2 and (child := heaviest(self.root)) is not None:
            path, prefix = [self.root], b""
            while weight[id(child)] > self.limit // 2 and (inner := heaviest(child)) is not None:
                path.append(child)
                prefix += child.label
                child = inner
            if all(len(n.children) == 1 and n.value is None for n in path):
                stays.add(id(child))  # nothing would be left here, and a file of all strings gains nothing
                continue
            file = tempfile.TemporaryFile(dir=os.environ.get("TMPDIR") or None)
            for key, node in self._below(child, prefix):
                if node.value is not None:
                    self._write(file, key, *node.value)
                if node.file is not None:
                    self._pour(node.file, file)
            first = child.label[:1]
            path[-1].children[first[0]] = stub = Node(first, file=file)
            gone = weight[id(child)] - len(first) - NODE_BYTES
            weight[id(stub)] = len(first) + NODE_BYTES
            for node in path:
                weight[id(node)] -= gone
            self.total -= weight[id(child)]

    @staticmethod
    def _pour(source, target) -> None:
        source.seek(0)
        while part := source.read(1 << 20):
            target.write(part)
        source.close()

    def items(self) -> Iterator[tuple[bytes, object, int]]:
        """Each string with its owner and count; the trie is empty afterwards. One file's trie is held at a time."""
        trie, waiting = self, []
        while True:
            for key, node in trie._below(trie.root, b""):
                if node.value is not None:
                    yield key, *node.value
                if node.file is not None:
                    waiting.append(node.file)
            trie.root, trie.total = Node(b""), 0
            if not waiting:
                return
            trie = PatriciaOwners(self.better, self.limit)
            with waiting.pop() as file:
                file.seek(0)
                while head := file.read(8):
                    trie.add(*pickle.loads(file.read(struct.unpack("<Q", head)[0])))


def larger(a, b):
    return b if a is None else a if b is None else max(a, b)


def smaller(a, b):
    return b if a is None else a if b is None else min(a, b)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """For each document, its group of equal texts: id, keep_id, group_size, kept, text_sha256.

    Texts are equal if their UTF-8 bytes are, after A-Z become lower case; null counts as empty. Of a group the
    row with the largest (or smallest) id stays; nulls rank below any id. kept is true where the row's id is
    keep_id, so a repeated row is kept with its twin, and a group whose ids are all null is kept.

    1. Each input task collapses the equal texts it sees in a trie, so a group of copies reaches its owner as
       one string from each task, however many copies there are. Long texts are compared whole.
    2. These go to the owner task of their (length, hash), whose trie compares whole strings; a terminal holds
       the id to keep and the number of rows. Tries spill by subtree.
    3. The thin rows (id, hash) meet the groups in a join that adaptive execution can split at hot keys.

    Empty table: no rows. Other columns are ignored.
    """
    rows, groups = _owned(docs, id_col, text_col, keep)
    thin = rows.select("id", F.sha2("key", 256).alias("text_sha256"))
    joined = thin.join(groups, "text_sha256")
    return joined.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """One whole row of each group of exact_groups(): that with the id that stays; of repeated rows with that id, one.

    As there, but the tries' terminals hold the row that stays so far, so rows move once, and of a group of copies one
    from each task. Null text counts as empty; null ids rank below any. Long texts are compared whole. Columns may have
    any name. Empty table: no rows.
    """
    pick = larger if keep == "largest" else smaller
    whole = [StructField(f"c{k}", f.dataType) for k, f in enumerate(docs.schema)]
    text_at = 1 + docs.columns.index(text_col) if text_col in docs.columns else None
    rows = docs.select(column_or_null(docs, id_col, "long").alias("id"), *(F.col(f"`{c}`").alias(f.name) for c, f in zip(docs.columns, whole, strict=True)))

    def better(a, b):
        return b if a[0] != b[0] and pick(a[0], b[0]) == b[0] else a

    def collapse(batches, local: bool):
        import pyarrow as pa

        trie, types, names, place = PatriciaOwners(better, TRIE_BYTES // 3), None, None, text_at
        for batch in batches:
            if types is None:
                skip = 0 if local else 2  # length and hash go ahead
                types, names = batch.schema.types[skip:], batch.schema.names[skip:]
            for row in zip(*(c.to_pylist() for c in batch.columns[-len(types) :]), strict=True):
                key = b"" if place is None or row[place] is None else row[place].encode().lower()
                trie.add(key, (row[0], row[1:]), 1)
        out, held = [], 0

        def passed_on():
            head, rest = zip(*out, strict=True)
            columns = [pa.array(c, t) for c, t in zip(zip(*head, strict=True), (pa.int64(), pa.binary()), strict=True)] if local else []
            columns += [pa.array(c, t) for c, t in zip(zip(*rest, strict=True), types, strict=True)]
            return pa.RecordBatch.from_arrays(columns, names=(["bytes", "hash"] if local else []) + names)

        for key, (own, row), _ in trie.items():
            out.append(((len(key), hashlib.sha256(key).digest()), (own, *row)))
            held += len(key) + 100
            if held >= 4 << 20:
                yield passed_on()
                out, held = [], 0
        if out:
            yield passed_on()

    full = [StructField("id", LongType()), *whole]
    part = rows.mapInArrow(lambda b: collapse(b, True), StructType([StructField("bytes", LongType()), StructField("hash", BinaryType()), *full]))
    kept = part.repartition("bytes", "hash").mapInArrow(lambda b: collapse(b, False), StructType(full))
    return kept.drop("id").toDF(*docs.columns)


def _normal(docs: DataFrame, text_col: str):
    return lower_ascii(F.coalesce(column_or_null(docs, text_col, "string"), F.lit(""))).cast("binary")


def _owned(docs: DataFrame, id_col: str, text_col: str, keep: str) -> tuple[DataFrame, DataFrame]:
    """The rows as (id, key), and the groups as (text_sha256, keep_id, group_size)."""
    scratch = Scratch(docs.sparkSession, "exact")
    pick = larger if keep == "largest" else smaller
    rows = docs.select(column_or_null(docs, id_col, "long").alias("id"), _normal(docs, text_col).alias("key"))

    def collapse(batches, local: bool):
        import pyarrow as pa

        names = ["bytes", "hash", "key", "owner", "n"] if local else ["hash", "keep_id", "group_size"]
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()] if local else [pa.binary(), pa.int64(), pa.int64()]
        trie = PatriciaOwners(pick)
        for batch in batches:
            at = {n: batch.schema.get_field_index(n) for n in batch.schema.names}
            keys = batch.column(at["key"])
            owners = batch.column(at["id" if local else "owner"]).to_pylist()
            counts = [1] * len(owners) if local else batch.column(at["n"]).to_pylist()
            for k, owner, n in zip(keys, owners, counts, strict=True):
                trie.add(k.as_py(), owner, n)
        out, held = [], 0
        for key, owner, n in trie.items():
            digest = hashlib.sha256(key).digest()
            out.append((len(key), digest, key, owner, n) if local else (digest, owner, n))
            held += len(key) + 100 if local else 60
            if held >= 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    part = rows.mapInArrow(lambda b: collapse(b, True), "bytes long, hash binary, key binary, owner long, n long")
    groups = part.repartition("bytes", "hash").mapInArrow(lambda b: collapse(b, False), "hash binary, keep_id long, group_size long")
    groups = scratch.save(groups, "groups")
    return rows, groups.select(F.lower(F.hex("hash")).alias("text_sha256"), "keep_id", "group_size")
