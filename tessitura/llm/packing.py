"""Hierarchical multi-length packing of documents into training sequences.

A document becomes the ids of a byte-level BPE with an end id appended. Whole
windows of the longest tier are cut off its front; the rest is routed to the
shortest tier that holds it. Each tier is packed from long to short: a piece
opens a sequence, the gap behind it is filled with the longest pieces of the
same or shorter tiers that fit, and at last one piece is cut so that the
sequence is exactly full. Sequences of a tier are then dealt to step groups of
equally many tokens, in a snake over their attention cost.

Every task packs what it reads, so there is no shuffle and no planning on the
driver, and a lost task is simply run again. What is left at the end of a task
is cut into sequences whose lengths are falling powers of two, at most one of
each under the shortest tier, so there is no padding.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import numbers, slices

TIERS = (256, 512, 1024, 2048)
#: Ids of a step group: so many, whatever the tier.
STEP_TOKENS = 16384
#: Ids that a task gathers before it packs them.
POOL_TOKENS = 1 << 20
END_ID = 1
#: White space next to a space, or of a kind that is rarely met. Texts with any of these aren't cut into chunks.
BLANKS = tuple("\t\v\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
SPECIAL = "<|endoftext|>"
IRREGULAR = ("  ", "\n ", " \n", SPECIAL)
#: Chunks of text whose ids a worker remembers.
CACHE = 200_000

_coders: dict = {}


class Coder:
    """Texts to ids, as little-endian unsigned 32-bit integers.

    A chunk between two single spaces is coded alike wherever it stands, so
    its ids are remembered. Chunks that aren't known yet are coded together
    and divided where their bytes end. Texts in which that rule doesn't hold
    (runs of white space, or the string of a special token) go to the
    tokenizer whole.
    """

    def __init__(self, name: str, ranks: str):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(public_tokenizers.path(name))
        with open(public_tokenizers.path(ranks), "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.leads = np.zeros(max(table.values()) + 1, dtype=bool)
        for token, rank in table.items():
            self.leads[rank] = token.startswith(b" ")
        self.known: dict[str, bytes] = {}
        self.sizes: dict[str, int] = {}

    def coded(self, chunks: list[str]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
        """Codes chunks together: a token that starts with a space starts a chunk. Yields chunks, all their ids, and where each one's begin."""
        for at in range(0, len(chunks), 50_000):
            part = chunks[at : at + 50_000]
            ids = self.fast.encode_to_numpy(" " + " ".join(part)).astype("<u4")
            yield part, ids, np.append(np.flatnonzero(self.leads[ids]), len(ids))

    def parts(self, texts: list[str], known: dict) -> tuple[list[list[str] | None], list[str]]:
        """The chunks of each text (None where they don't hold), and those that aren't known, for which there is room then."""
        parts = [text.split(" ") if self.regular(text) else None for text in texts]
        missing: set[str] = set()
        for chunks in parts:
            if chunks:
                missing.update(chunks)
        if len(known) + len(missing) > CACHE:
            known.clear()  # what these texts need may be more than is remembered, but a slice bounds it
        missing.difference_update(known)
        return parts, list(missing)

    def whole_text(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def regular(self, text: str) -> bool:
        if not text or text[0].isspace() or text[-1].isspace() or any(x in text for x in IRREGULAR):
            return False
        return not any(x in text for x in (BLANKS[:8] if text.isascii() else BLANKS))

    def code(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes."""
        parts, missing = self.parts(texts, self.known)
        for chunks, ids, starts in self.coded(missing):
            data, places = ids.tobytes(), (starts * 4).tolist()
            self.known.update(zip(chunks, map(data.__getitem__, map(slice, places, places[1:])), strict=False))
        known, out = self.known.__getitem__, []
        for text, chunks in zip(texts, parts, strict=True):
            if chunks is None:
                out.append(self.whole_text(text) if text else b"")
            else:
                first = self.fast.encode_to_numpy(chunks[0]).astype("<u4").tobytes()
                out.append(first + b"".join(map(known, chunks[1:])))
        return out

    def count(self, texts: list[str]) -> list[int]:
        """How many ids each text has."""
        parts, missing = self.parts(texts, self.sizes)
        for chunks, _, starts in self.coded(missing):
            self.sizes.update(zip(chunks, np.diff(starts).tolist(), strict=True))
        size, out = self.sizes.__getitem__, []
        for text, chunks in zip(texts, parts, strict=True):
            if chunks is None:
                out.append(len(self.whole_text(text)) // 4 if text else 0)
            else:
                out.append(len(self.fast.encode_to_numpy(chunks[0])) + sum(map(size, chunks[1:])))
        return out


def coder(name: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken") -> Coder:
    if (name, ranks) not in _coders:
        _coders[name, ranks] = Coder(name, ranks)
    return _coders[name, ranks]


class Packer:
    """Packs pieces (key, start, ids, ids of the document) of one task."""

    def __init__(self, task: int, tiers=TIERS, step_tokens=STEP_TOKENS):
        self.tiers, self.top, self.step_tokens = tiers, tiers[-1], step_tokens
        self.base = task << 40
        self.pools: list[list[tuple[int, int]]] = [[] for _ in tiers]  # (length, number), ascending
        self.pieces: dict[int, tuple] = {}
        self.numbered, self.sequences, self.steps, self.held = 0, 0, 0, 0
        self.waiting: dict[int, list] = defaultdict(list)
        self.rows: list[tuple] = []

    def route(self, piece: tuple) -> None:
        size = len(piece[2]) // 4
        level = next(k for k, tier in enumerate(self.tiers) if size <= tier)
        self.numbered += 1
        self.pieces[self.numbered] = piece
        insort(self.pools[level], (size, self.numbered))
        self.held += size

    def add(self, key, ids: bytes) -> None:
        total, window, start = len(ids) // 4, self.top * 4, 0
        while len(ids) - start >= window:
            self.close(self.top, [(key, start // 4, ids[start : start + window], total)])
            start += window
        if start < len(ids):
            self.route((key, start // 4, ids[start:], total))

    def take(self, level: int, at: int) -> tuple:
        size, number = self.pools[level].pop(at)
        self.held -= size
        return self.pieces.pop(number)

    def fitting(self, level: int, gap: int) -> tuple | None:
        """The longest piece of this tier or a shorter one that fits."""
        for k in range(level, -1, -1):
            at = bisect_right(self.pools[k], (gap, 1 << 62))
            if at:
                return self.take(k, at - 1)
        return None

    def head(self, level: int, gap: int) -> tuple | None:
        """The first ``gap`` ids of the shortest longer piece; its rest is routed anew."""
        for k in range(level + 1):
            if self.pools[k]:
                key, start, ids, total = self.take(k, bisect_right(self.pools[k], (gap, 1 << 62)))
                self.route((key, start + gap, ids[gap * 4 :], total))
                return key, start, ids[: gap * 4], total
        return None

    def pack(self, last: bool = False) -> None:
        for level in range(len(self.tiers) - 1, -1, -1):
            while self.pools[level]:
                parts, gap = [], self.tiers[level]
                while gap:
                    piece = self.fitting(level, gap) or self.head(level, gap)
                    if piece is None:
                        break
                    parts.append(piece)
                    gap -= len(piece[2]) // 4
                if gap:  # all is used up: wait for more
                    for piece in parts:
                        self.route(piece)
                    break
                self.close(self.tiers[level], parts)
        if last:
            self.finish([self.take(k, 0) for k in range(len(self.tiers) - 1, -1, -1) for _ in range(len(self.pools[k]))])
        self.deal(last)

    def finish(self, rest: list[tuple]) -> None:
        """Fills sequences of the longest tier, then of falling powers of two, with what is left."""
        rest.reverse()
        size, left = self.top, sum(len(x[2]) for x in rest) // 4
        while left:
            if size > left:
                size = 1 << (left.bit_length() - 1)
            parts, gap = [], size
            while gap:
                key, start, ids, total = rest.pop()
                if len(ids) > gap * 4:
                    rest.append((key, start + gap, ids[gap * 4 :], total))
                parts.append((key, start, ids[: gap * 4], total))
                gap -= len(parts[-1][2]) // 4
            self.close(size, parts)
            left -= size

    def close(self, tier: int, parts: list[tuple]) -> None:
        self.waiting[tier].append((sum((len(x[2]) // 4) ** 2 for x in parts), self.sequences, parts))
        self.sequences += 1

    def deal(self, last: bool) -> None:
        """Gives waiting sequences their step groups and makes their rows."""
        for tier, waiting in self.waiting.items():
            size = max(1, self.step_tokens // tier)
            steps = -(-len(waiting) // size) if last else len(waiting) // size
            chosen, self.waiting[tier] = waiting[: steps * size], waiting[steps * size :]
            chosen.sort(key=lambda x: (-x[0], x[1]))
            for k, (_, number, parts) in enumerate(chosen):
                lap, at = divmod(k, steps)
                step = self.steps + (at if lap % 2 == 0 else steps - 1 - at)
                offset = 0
                for key, start, ids, total in parts:
                    size_ = len(ids) // 4
                    self.rows.append((key, start, size_, zlib.crc32(ids), total, self.base + number, offset, tier, self.base + step, ids))
                    offset += size_
            self.steps += steps


def _schema(id_type: str) -> str:
    return f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


def pack_documents(docs: DataFrame, with_ids: bool = False, tiers=TIERS, step_tokens: int = STEP_TOKENS, pool_tokens: int = POOL_TOKENS) -> DataFrame:
    """One row per piece of a document: where it lies in which sequence.

    ``start`` counts the document's ids before the piece, ``offset`` the
    sequence's. ``tier`` is the sequence's context size (under the shortest tier
    for the few sequences that end a task) and ``step_group`` the
    group of sequences, of ``step_tokens`` ids, that a training step takes.
    With ``with_ids`` the ids follow as an array.

    A null text counts as empty: such a document is the end id alone. A null
    key stays null. Rows that repeat a key are documents of their own. Other
    columns are ignored. An empty table gives no rows.
    """
    schema = _schema(docs.schema["doc_id"].dataType.simpleString()) + (", ids array<int>" if with_ids else "")
    end = np.array([END_ID], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, own = Packer(TaskContext.get().partitionId(), tiers, step_tokens), coder()
        arrow = None

        def flush() -> pa.RecordBatch:
            rows, packer.rows = packer.rows, []
            columns = list(zip(*rows, strict=True))
            arrays = [pa.array(columns[0], type=arrow)] + [pa.array(x, type=pa.int64()) for x in columns[1:7]] + [pa.array(columns[7], type=pa.int32()), pa.array(columns[8], type=pa.int64())]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]
            if with_ids:
                values = np.frombuffer(b"".join(columns[9]), dtype="<i4")
                ends = np.cumsum([0, *(len(x) // 4 for x in columns[9])])
                arrays.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values)))
                names.append("ids")
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in slices(batches, "text"):
            arrow = batch.schema.field("doc_id").type
            texts = [x or "" for x in numbers(batch, "text")]
            for key, ids in zip(numbers(batch, "doc_id"), own.code(texts), strict=True):
                packer.add(key, ids + end)
            if packer.held >= pool_tokens:
                packer.pack()
            else:
                packer.deal(False)
            if packer.rows:
                yield flush()
        packer.pack(last=True)
        if packer.rows:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, schema)
