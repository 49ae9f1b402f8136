"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies."""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib

from pyspark.sql import DataFrame

from .common import WordCache, column_or_null

SPACE = "▁"
CACHED_SEGMENTS = 900_000


class PieceVocabulary:
    """The vocabulary of a model file, and its encoding rules.

    Covers merge-type models with the identity normaliser, a dummy prefix and byte fallback, whose pieces are all
    normal, unknown, control or byte pieces; others are refused.
    """

    def __init__(self, model_path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_path)
        with open(model_path, "rb") as file:
            proto = sentencepiece_model_pb2.ModelProto.FromString(file.read())
        normal, unknown, control, byte = 1, 2, 3, 6
        rules = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback or rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix or not rules.escape_whitespaces or {p.type for p in proto.pieces} - {normal, unknown, control, byte}:
            raise ValueError(f"{model_path}: not a merge-type model of the supported kind")
        self.begin, self.end = self.library.bos_id(), self.library.eos_id()
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == normal}
        #: The cost of a merge by what it makes; the lowest goes first.
        self.cost = {p.piece: -p.score for p in proto.pieces if p.type == normal and len(p.piece) > 1}
        self.bytes = [0] * 256
        self.text: list[bytes] = []
        for i, p in enumerate(proto.pieces):
            if p.type == byte:
                self.bytes[int(p.piece[1:-1], 16)] = i
            self.text.append(bytes([int(p.piece[1:-1], 16)]) if p.type == byte else b"" if p.type == control else p.piece.replace(SPACE, " ").encode() if p.type == normal else " ⁇ ".encode())
        #: Neighbouring characters within pieces; no merge spans any other two, so a text may be cut there.
        self.inside = {p[k : k + 2] for p in self.cost for k in range(len(p) - 1)}

    def merged(self, text: str) -> list[str]:
        """Merges adjacent symbols, best score first and leftmost of equals, until no pair makes a piece.

        The agenda holds (cost, left symbol, length of the merge); an entry is stale if either symbol has changed,
        which its length tells.
        """
        cost, push, pop = self.cost, heapq.heappush, heapq.heappop
        symbols = list(text)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(c, i, 2) for i in range(n - 1) if (c := cost.get(text[i : i + 2])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, i, size = pop(agenda)
            left, j = symbols[i], after[i]
            if not left or j >= n or len(left) + len(symbols[j]) != size:
                continue
            symbols[i] = left = left + symbols[j]
            symbols[j] = ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (c := cost.get(left + symbols[k])) is not None:
                    push(agenda, (c, i, size + len(symbols[k])))
            if (h := before[i]) >= 0 and (c := cost.get(symbols[h] + left)) is not None:
                push(agenda, (c, h, size + len(symbols[h])))
        return [s for s in symbols if s]

    def encode_segment(self, segment: str) -> list[int]:
        out = []
        for piece in self.merged(segment):
            if (i := self.ids.get(piece)) is not None:
                out.append(i)
            else:  # a single character that the vocabulary lacks
                out += [self.bytes[b] for b in piece.encode()]
        return out

    def decode(self, ids: list[int]) -> str:
        """Joins the pieces' bytes; the dummy prefix goes."""
        data = b"".join(map(self.text.__getitem__, ids))
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


class PieceEncoder:
    """Encodes texts by segments, which a worker keeps: each distinct segment goes through the agenda once.

    A segment is a run of spaces with what follows; no piece has a space after anything else (else whole texts
    are one segment each). New segments are checked against the library, all of a batch in one call.
    """

    def __init__(self, model_path: str):
        from array import array

        self.array = array
        self.v = PieceVocabulary(model_path)
        self.separable = not any(p[1] == SPACE and p[0] != SPACE for p in self.v.inside)
        self.known, self.chunks = WordCache(CACHED_SEGMENTS), WordCache(CACHED_SEGMENTS // 2)
        self.runs = re.compile(f"{SPACE}+[^{SPACE}]*")
        self.around = self.pack([self.v.begin]), self.pack([self.v.end])

    def pack(self, ids: list[int]) -> bytes:
        return self.array("I", ids).tobytes()

    def new_segment(self, segment: str) -> bytes:
        cuts = [k for k in range(1, len(segment)) if segment[k - 1 : k + 1] not in self.v.inside]
        out = []
        for a, b in zip([0, *cuts], [*cuts, len(segment)], strict=True):
            chunk = segment[a:b]
            if (ids := self.chunks.get(chunk)) is None:
                ids = self.chunks[chunk] = self.pack(self.v.encode_segment(chunk))
            out.append(ids)
        return b"".join(out)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text, with begin and end ids."""
        self.known.trim()
        self.chunks.trim()
        known, out, fresh = self.known, [], {}
        for text in texts:
            if not text:
                out.append(b"".join(self.around))
                continue
            if not self.separable:
                segments = [text]
            elif "  " in text or text[0] == " " or text[-1] == " " or SPACE in text:
                segments = [s[1:] for s in self.runs.findall(SPACE + text.replace(" ", SPACE))]
            else:
                segments = text.split(" ")
            packed = list(map(known.get, segments))
            at = -1
            for _ in range(packed.count(None)):
                at = packed.index(None, at + 1)
                segment = segments[at]
                if (ids := known.get(segment)) is None:
                    ids = known[segment] = fresh[segment] = self.new_segment(SPACE + segment.replace(" ", SPACE))
                packed[at] = ids
            out.append(b"".join([self.around[0], *packed, self.around[1]]))
        fresh.pop("", None)  # a space at the end of a text; the library reads an empty text as nothing
        for segment, ids, theirs in zip(fresh, fresh.values(), self.v.library.encode(list(fresh), num_threads=1), strict=True):
            if self.pack(theirs) != ids:
                raise ValueError(f"segment {segment!r} differs from the library's")
        return out

    def decode(self, packed: bytes) -> str:
        return self.v.decode(self.array("I", packed).tolist())


_encoders: dict[str, PieceEncoder] = {}


def _encoder(path: str) -> PieceEncoder:
    """One for each worker process, so that its segments stay known from task to task."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_content: bool = False) -> DataFrame:
    """Encodes and decodes whole texts as the sentencepiece library does: id, n_tokens, ids_sha256, decoded_sha256.

    With with_content also ids and decoded. Nothing is shuffled; a task holds a few hundred texts and caches of
    bounded size. The new segments are checked against the library, and so are, with their decodings, one whole text
    of each 256, chosen by its hash, and the longest of each Arrow batch; a difference is an error.

    Null text: as empty, begin and end ids alone. Null and repeated ids: each row gives a row. Long texts are encoded
    whole. Other columns are ignored. Empty table: no rows.
    """

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute

        coder = _encoder(model_path)
        library = coder.v.library
        for batch in batches:
            sizes = pa.compute.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False)
            longest = int(sizes.argmax()) if len(sizes) else 0
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                packed = coder.encode(texts)
                decoded = [coder.decode(p) for p in packed]
                probes = {min(range(len(texts)), key=lambda k: zlib.crc32(packed[k]))}
                if at <= longest < at + len(texts):
                    probes.add(longest - at)
                for k in probes:
                    ids = library.encode(texts[k], add_bos=True, add_eos=True)
                    if coder.pack(ids) != packed[k] or library.decode(ids) != decoded[k]:
                        raise ValueError(f"text {texts[k][:200]!r} differs from the library's")
                columns = [
                    part.column(0),
                    pa.array([len(p) // 4 for p in packed], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in packed]),
                    pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded]),
                ]
                if with_content:
                    columns += [pa.array([coder.array("I", p).tolist() for p in packed], pa.list_(pa.int32())), pa.array(decoded)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(columns)])

    thin = docs.select(column_or_null(docs, id_col, "long").alias("id"), column_or_null(docs, text_col, "string").alias("text"))
    kinds = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_content
    return thin.mapInArrow(run, kinds).withColumnRenamed("id", id_col)
