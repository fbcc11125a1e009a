"""Pack token ids into sequences of several power-of-two lengths with hardly any padding.

A document's full context windows become sequences of their own. Its rest is routed to the shortest tier (a power
of two up to the context) that holds it. Tiers are packed from long to short: a piece opens a window of its tier, and
the window's gap is filled with the longest fitting pieces of shorter tiers, then with the start of a cut one. So
every window is full, and only what is left at the end of a task is split into powers of two or padded.
Sequences of one tier are dealt to step groups of ``step`` sequences so that the groups' attention costs are even.

Each task packs the rows of its own partition in buffers of ``buffer`` rests: no shuffle, bounded memory, and a lost
task is repeated with the same result as long as its partition is read again in the same order, as files are.
Sequence ids are unique over tasks.

Nulls and edge cases: a null text is empty; an empty text is one end id; rows without id, repeated ids and repeated
texts are packed each for itself; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscry.llm.common import map_arrow
from tabscry.llm.tokens import encoder

CONTEXT = 2048
SHORTEST = 64
STEP = 16
BUFFER = 4096


class Packer:
    """Packs the documents of one task; a piece is (length, order, doc, start), doc = (id, ids, tokens)."""

    def __init__(self, first: int, context: int, buffer: int, step: int):
        self.next, self.context, self.buffer, self.step = first, context, buffer, step
        self.group = first
        self.rests: list[tuple] = []
        self.done: list[tuple[int, list[tuple]]] = []  # (tier, pieces) of finished sequences
        self.order = 0

    def piece(self, doc: tuple, start: int, length: int) -> tuple:
        self.order += 1
        return (length, self.order, doc, start)

    def tier(self, length: int) -> int:
        return max(SHORTEST, 1 << (length - 1).bit_length())

    def add(self, doc: tuple) -> None:
        start, tokens = 0, doc[2]
        while tokens - start >= self.context:
            self.done.append((self.context, [self.piece(doc, start, self.context)]))
            start += self.context
        if start < tokens:
            insort(self.rests, self.piece(doc, start, tokens - start))
        if len(self.rests) >= self.buffer:
            self.pack(last=False)

    def fill(self, window: list[tuple], gap: int) -> int:
        """Fill a window from the rests; the gap that remains when they run out."""
        while gap and self.rests:
            at = bisect_right(self.rests, (gap, 1 << 62))
            if at:
                piece = self.rests.pop(at - 1)
            else:
                length, _, doc, start = self.rests.pop(0)
                piece = self.piece(doc, start, gap)
                insort(self.rests, self.piece(doc, start + gap, length - gap))
            window.append(piece)
            gap -= piece[0]
        return gap

    def pack(self, last: bool) -> None:
        while self.rests:
            first = self.rests.pop()  # the longest
            tier, window = self.tier(first[0]), [first]
            gap = self.fill(window, tier - first[0])
            if not gap:
                self.done.append((tier, window))
            elif not last:
                for piece in window:  # they wait for the next documents
                    insort(self.rests, piece)
                return
            else:
                self.split(window)

    def split(self, window: list[tuple]) -> None:
        """Cut what is left into powers of two; only a tail below the shortest tier is padded."""
        left = sum(p[0] for p in window)
        pieces = window[::-1]
        while left:
            size = 1 << (left.bit_length() - 1)
            size = left if left < SHORTEST else size
            need, out = size, []
            while need:
                length, _, doc, start = pieces.pop()
                take = min(need, length)
                out.append(self.piece(doc, start, take))
                if take < length:
                    pieces.append(self.piece(doc, start + take, length - take))
                need -= take
            self.done.append((self.tier(size), out))
            left -= size

    def flush(self) -> Iterator[tuple]:
        """Rows of the finished sequences, dealt to step groups."""
        by_tier: dict[int, list] = {}
        for tier, window in self.done:
            by_tier.setdefault(tier, []).append((sum(p[0] ** 2 for p in window), window))
        self.done = []
        for tier, windows in sorted(by_tier.items()):
            windows.sort(key=lambda w: -w[0])
            groups = -(-len(windows) // self.step)
            for k, (_, window) in enumerate(windows):
                turn, at = divmod(k, groups)
                group = self.group + (at if turn % 2 == 0 else groups - 1 - at)
                offset = 0
                for length, _, (doc_id, ids, tokens), start in window:
                    yield doc_id, start, length, ids[4 * start : 4 * (start + length)], tokens, self.next, offset, tier, group
                    offset += length
                self.next += 1
            self.group += groups


def pack(
    docs: DataFrame, tokenizer: str, end_id: int, text: str = "text", doc_id: str = "doc_id",
    context: int = CONTEXT, buffer: int = BUFFER, step: int = STEP, with_ids: bool = False,
) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group (and ids)."""
    kind = docs.schema[doc_id].dataType.simpleString()
    end = end_id.to_bytes(4, "little")
    names = ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "tier", "step_group")

    def rows(packer: Packer) -> Iterator[dict]:
        done = list(packer.flush())
        if done:
            out = dict(zip(names, map(list, zip(*done, strict=True)), strict=True))
            out["ids_crc32"] = [zlib.crc32(x) for x in out["ids"]]
            yield out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        packer = Packer(TaskContext.get().partitionId() << 40, context, buffer, step)
        encode = encoder(tokenizer).encode
        for batch in batches:
            for i, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").to_pylist()), strict=True):
                packer.add((i, ids + end, len(ids) // 4 + 1))
            if len(packer.done) >= 64 * step:
                yield from rows(packer)
        packer.pack(last=True)
        yield from rows(packer)

    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, tier int, step_group bigint"
    return map_arrow(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), run, schema + ", ids binary" * with_ids)
