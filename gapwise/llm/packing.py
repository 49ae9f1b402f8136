"""Hierarchical multi-length packing of tokenised documents into training sequences."""

from __future__ import annotations

import heapq
import json
import os
import re
import zlib
from array import array
from collections.abc import Callable

from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import WordCache, column_or_null

CONTEXT = 1024
#: Context sizes, longest first; a document, or its rest after full windows, is routed to the shortest that holds it.
TIERS = (1024, 512, 256, 128, 64)
#: Tokens that are packed together; also bounds a task's memory.
BLOCK_TOKENS = 4_000_000
#: Tokens of one step; a block's steps get near-equal tokens from windows of all tiers.
STEP_TOKENS = 8 * CONTEXT
#: Words whose ids a task remembers, and those that a worker keeps while it waits for its next task.
CACHED_WORDS, CACHED_BETWEEN_TASKS = 900_000, 50_000
#: Pieces, of at most CONTEXT tokens each, that leave a task together.
BATCH_PIECES = 4_000


#: How byte-level vocabularies split text before merging (fixed value, public pattern of these vocabularies).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: printable Latin-1 bytes stand for themselves, others count up from 256."""
    own = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in own else chr(next(rest)) for b in range(256)}


def check_supported(tokenizer_path: str) -> None:
    """Refuses tokenizer files whose texts aren't split, or whose words aren't merged, as byte_bpe_encoder() does."""
    with open(tokenizer_path, encoding="utf-8") as file:
        spec = json.load(file)
    model, split = spec["model"], spec["pre_tokenizer"] or {}
    good = (
        model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
        and split.get("type") == "ByteLevel" and split.get("add_prefix_space") is False and split.get("use_regex", True)
        and not any(spec.get(k) for k in ("normalizer", "truncation", "padding"))
    )
    if not good:
        raise ValueError(f"{tokenizer_path}: not a byte-level BPE tokenizer without normaliser and prefix space")


def byte_bpe_encoder(tokenizer_path: str) -> Callable[[list[str]], list[bytes]]:
    """Encodes texts with the tokenizers library, each distinct word once; ids as packed little-endian uint32.

    The vocabulary's splitting pattern never puts a character after white space into one token with what stands
    before that white space, so a text may be cut before each space that follows a non-space. Pieces a worker has
    met are looked up; a new piece is split by the pattern, and the library's model merges each new word. Of each
    call one text, whichever its checksum picks, is encoded by the library as well; a difference is an error.
    """
    import regex
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    check_supported(tokenizer_path)
    library = Tokenizer.from_file(tokenizer_path)
    merge, letters = library.model.tokenize, byte_letters()
    added = [t.content for t in library.get_added_tokens_decoder().values()]
    unsafe = re.compile("|".join([r"\s\s", *map(re.escape, added)]))
    gap = re.compile(r"(?<=\S) ")
    words_of = regex.compile(SPLIT).findall
    spaced, others, words = WordCache(CACHED_WORDS), WordCache(CACHED_WORDS // 10), WordCache(CACHED_WORDS // 2)

    def encode_word(word: str) -> bytes:
        if (ids := words.get(word)) is None:
            ids = words[word] = array("I", [t.id for t in merge(word.encode().decode("latin-1").translate(letters))]).tobytes()
        return ids

    def encode_piece(before: str, piece: str) -> bytes:
        # the commonest shapes, split as the pattern does
        if piece.isalpha():
            return encode_word(before + piece)
        if piece[-1:] in {",", "."} and piece[:-1].isalpha():
            return encode_word(before + piece[:-1]) + encode_word(piece[-1])
        return b"".join(map(encode_word, words_of(before + piece)))

    def look_up(known: WordCache, pieces: list[str], before: str) -> list[bytes]:
        """The ids of each piece with `before` in front."""
        packed = list(map(known.get, pieces))
        at, missing = -1, packed.count(None)
        for _ in range(missing):
            at = packed.index(None, at + 1)
            piece = pieces[at]
            if (ids := known.get(piece)) is None:
                ids = known[piece] = encode_piece(before, piece)
            packed[at] = ids
        return packed

    def encode(texts: list[str]) -> list[bytes]:
        for cache in (spaced, others, words):
            cache.trim()
        out = []
        for text in texts:
            if (found := unsafe.search(text)) is None:
                pieces = text.split(" ")
            elif found[0].isspace() and not any(a in text for a in added):
                pieces = gap.split(text)
            else:  # strings of added tokens are one token each; the library cuts them out
                out.append(b"".join(i.to_bytes(4, "little") for i in library.encode(text, add_special_tokens=False).ids))
                continue
            first = look_up(others, pieces[:1], "")
            out.append(b"".join(first + look_up(spaced, pieces[1:], " ")))
        if texts:
            probe = zlib.crc32(texts[0][:100].encode()) % len(texts)
            if array("I", library.encode(texts[probe], add_special_tokens=False).ids).tobytes() != out[probe]:
                raise ValueError(f"ids of {texts[probe][:200]!r} differ from the library's")
        return out

    def rest() -> None:
        for cache in (spaced, others, words):
            cache.shrink(CACHED_BETWEEN_TASKS)

    encode.rest = rest
    return encode


Piece = tuple[int, int, int]  # document, start, length


class Rests:
    """Pieces of at most CONTEXT tokens by length, and the sum of their tokens."""

    def __init__(self):
        self.by_length: list[list[Piece]] = [[] for _ in range(CONTEXT + 1)]
        self.there, self.tokens = 0, 0  # bit n of `there`: pieces of n tokens

    def put(self, piece: Piece) -> None:
        self.by_length[piece[2]].append(piece)
        self.there |= 1 << piece[2]
        self.tokens += piece[2]

    def _take(self, n: int) -> Piece:
        piece = self.by_length[n].pop()
        if not self.by_length[n]:
            self.there &= ~(1 << n)
        self.tokens -= n
        return piece

    def longest(self, most: int, above: int = 0) -> Piece | None:
        """The longest piece of more than `above` and at most `most` tokens."""
        n = (self.there & ((2 << most) - 1)).bit_length() - 1
        return self._take(n) if n > above else None

    def shortest(self, above: int) -> Piece | None:
        """The shortest piece of more than `above` tokens."""
        there = self.there >> (above + 1)
        return self._take(above + 1 + (there & -there).bit_length() - 1) if there else None

    def all(self) -> list[Piece]:
        return [p for pieces in reversed(self.by_length) for p in pieces]


def pack_block(pieces: list[Piece], last: bool = True) -> tuple[list[list[Piece]], list[Piece]]:
    """Full windows of the sizes in TIERS, and the pieces of less than CONTEXT tokens in all that remain.

    1. A piece longer than the context gives full windows of CONTEXT; its rest goes to the shortest tier that holds it.
    2. Each tier, from the longest, is packed into windows of its own size. A piece of the tier, longest first, opens
       a window; its gap is filled from the tiers below, the longest whole rest first. A gap that no whole rest
       fits is closed by cutting the shortest that is longer, whose remainder goes to its own tier.
    3. With `last`, what doesn't fill a window of any tier goes into windows of shorter powers of two.
    """
    done: list[list[Piece]] = []
    rests = Rests()
    for d, start, n in pieces:
        whole = n - n % CONTEXT
        done += [[(d, start + at, CONTEXT)] for at in range(0, whole, CONTEXT)]
        if n > whole:
            rests.put((d, start + whole, n - whole))

    def fill(window: list[Piece], room: int) -> None:
        while room:
            if (piece := rests.longest(room)) is None:
                d, start, n = rests.shortest(room)
                rests.put((d, start + room, n - room))
                piece = (d, start, room)
            window.append(piece)
            room -= piece[2]
        done.append(window)

    for tier, below in zip(TIERS, (*TIERS[1:], 0), strict=True):
        while rests.tokens >= tier and (opener := rests.longest(tier, below)):
            fill([opener], tier - opener[2])
    size = CONTEXT // 2
    while last and size:
        if rests.tokens >= size:
            fill([], size)
        else:
            size //= 2
    return done, rests.all()


def balanced_steps(sizes: list[int], tokens: int = STEP_TOKENS) -> list[int]:
    """A step number for each sequence: as many steps as their tokens fill, near-equal in tokens.

    Each sequence, longest first, goes to the step that holds the fewest tokens so far.
    """
    steps = [(0, k) for k in range(-(-sum(sizes) // tokens))]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        held, out[i] = steps[0]
        heapq.heapreplace(steps, (held + sizes[i], out[i]))
    return out


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Tokenises whole documents and packs them into sequences of the sizes in TIERS.

    A document is its ids followed by end_id. Every partition packs its own rows in blocks of bounded size, so
    nothing is shuffled. What doesn't fill a window goes on to the partition's next block, and at its end into
    windows of shorter powers of two, so no sequence is padded. Sequence and step numbers are unique over the whole
    result: partition number above 33 bits, count within the partition below. They depend on the input's
    partitions, not on when a task runs.

    Returns a row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, window (the
    sequence's size), step_group and, with with_ids, ids (the piece's tokens). A sequence is the ids of its pieces
    by offset.

    Null or empty text: the end id alone. Null or repeated ids: each row is a document. Long texts: cut where a
    window ends. Empty table: no rows. Other columns are ignored.
    """

    def pack(batches):
        import numpy as np
        import pyarrow as pa

        encode = _encoder(tokenizer_path)
        base = TaskContext.get().partitionId() << 33
        end = np.array([end_id], dtype="<u4").tobytes()
        ids: list[int | None] = []
        packed: list[bytes] = []
        pieces: list[Piece] = []
        held = sequence = step = 0

        def flush(last: bool):
            nonlocal ids, packed, pieces, held, sequence, step
            windows, left = pack_block(pieces, last)
            sizes = [sum(n for _, _, n in w) for w in windows]
            steps = balanced_steps(sizes)
            rows, tokens = [], []
            for k, (window, size) in enumerate(zip(windows, sizes, strict=True)):
                at = 0
                for d, start, n in window:
                    tokens.append(memoryview(packed[d])[4 * start : 4 * (start + n)])
                    rows.append((ids[d], start, n, zlib.crc32(tokens[-1]), len(packed[d]) // 4, base + sequence + k, at, size, base + step + steps[k]))
                    at += n
            sequence += len(windows)
            step += max(steps, default=-1) + 1
            for at in range(0, len(rows), BATCH_PIECES):
                columns = [pa.array(c, pa.int64()) for c in zip(*rows[at : at + BATCH_PIECES], strict=True)]
                if with_ids:
                    offsets = np.concatenate([[0], np.cumsum(columns[2].to_numpy())]).astype(np.int32)
                    content = np.frombuffer(b"".join(tokens[at : at + BATCH_PIECES]), "<i4")
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(content)))
                yield pa.RecordBatch.from_arrays(columns, names=names[: len(columns)])
            kept = sorted({d for d, _, _ in left})
            ids, packed, held = [ids[d] for d in kept], [packed[d] for d in kept], 0
            pieces = [(kept.index(d), start, n) for d, start, n in left]

        names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "step_group", "ids"]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids += part.column(0).to_pylist()
                for new in encode([t or "" for t in part.column(1).to_pylist()]):
                    packed.append(new + end)
                    pieces.append((len(packed) - 1, 0, len(packed[-1]) // 4))
                    held += pieces[-1][2]
                if held >= BLOCK_TOKENS:
                    yield from flush(False)
        if pieces:
            yield from flush(True)
        encode.rest()

    thin = docs.select(column_or_null(docs, id_col, "long").alias("id"), column_or_null(docs, text_col, "string").alias("text"))
    kinds = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window long, step_group long" + ", ids array<int>" * with_ids
    return thin.mapInArrow(pack, kinds).withColumnRenamed("id", id_col)


_encoders: dict[str, Callable] = {}


def _encoder(path: str) -> Callable:
    """One for each worker process, so that its words stay known from task to task."""
    if path not in _encoders:
        _encoders[path] = byte_bpe_encoder(path)
    return _encoders[path]
