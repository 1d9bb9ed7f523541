"""Packing of documents into sequences of fixed capacity: Martello-Toth dominance, then best fit on what is left.

The plan needs the number of pieces of each length alone, at most `capacity` numbers, so one exact global plan is made
from a histogram whatever the corpus' size; pieces take their places by their rank among pieces of their length.

Edge cases: a null or empty text is a document of one token, the separator. Repeated rows are packed each. An empty
table gives no pieces. Ids may be null. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import tokens
from palimpsest.llm.shared import ranked, written

SEPARATOR = b"\0\0\0\0"


@dataclass
class Pattern:
    """count sequences, each holding items: (length, how many of it), in order from offset 0."""

    count: int
    items: tuple[tuple[int, int], ...]


def best_pair(lengths: list[int], spare: dict[int, int], room: int) -> int:
    """The most that two pieces of different or equal lengths fill of room; 0 if no two fit. spare (length: pieces)."""
    lengths = [x for x in lengths[: bisect.bisect_right(lengths, room)] if spare[x]]
    best, low, high = 0, 0, len(lengths) - 1
    while low <= high:
        both = lengths[low] + lengths[high]
        if both > room:
            high -= 1
            continue
        if low < high or spare[lengths[low]] > 1:
            best = max(best, both)
        low += 1
    return best


def largest(lengths: list[int], spare: dict[int, int], room: int) -> int:
    """The longest piece that room holds; 0 if none does."""
    at = bisect.bisect_right(lengths, room) - 1
    while at >= 0 and not spare[lengths[at]]:
        at -= 1
    return lengths[at] if at >= 0 else 0


def smallest(lengths: list[int], spare: dict[int, int], n: int, above: int = 0) -> list[int]:
    """The n shortest pieces longer than `above`, fewer if there are no more."""
    found: list[int] = []
    for at in range(bisect.bisect_right(lengths, above), len(lengths)):
        found += [lengths[at]] * min(spare[lengths[at]], n - len(found))
        if len(found) == n:
            break
    return found


def dominating(lengths: list[int], left: dict[int, int], size: int, capacity: int) -> tuple[int, ...] | None:
    """A set with one piece of length size that dominates every other such set: whatever shares a sequence with the piece
    can be exchanged for the set's pieces without making any sequence too long. None if it can't be told.

    At most one more piece fits: the longest that does. A piece that fills the room exactly can't be bettered. At most two
    more fit: the longest single piece if it is as long as any two together; or that piece and the longest beside it,
    if no two pieces longer than the latter fit, for then every other pair has its longer and its shorter piece there.
    """
    room, spare = capacity - size, left | {size: left[size] - 1}
    low = smallest(lengths, spare, 3)
    if not low or low[0] > room:
        return (size,)
    one = largest(lengths, spare, room)
    if one == room or len(low) < 2 or low[0] + low[1] > room:
        return size, one
    if len(low) == 3 and sum(low) <= room:
        return None
    if one >= best_pair(lengths, spare, room):
        return size, one
    beside = largest(lengths, spare | {one: spare[one] - 1}, room - one)
    above = smallest(lengths, spare, 2, beside)
    return (size, one, beside) if beside and (len(above) < 2 or sum(above) > room) else None


def dominate(left: dict[int, int], capacity: int) -> list[Pattern]:
    """Fixes dominating sets, from the longest piece down, past lengths that have none and again as long as any is found.

    A set stays dominating while its pieces last, so all pieces of the same lengths are fixed at once. left (length:
    pieces) loses what is fixed.
    """
    fixed: list[Pattern] = []
    lengths, again = sorted(x for x in left if left[x]), True
    while again:
        again = False
        for size in reversed(lengths.copy()):
            while left[size] and (found := dominating(lengths, left, size, capacity)):
                items = Counter(found)
                n = min(left[x] // k for x, k in items.items())
                fixed.append(Pattern(n, tuple(items.items())))
                for x, k in items.items():
                    left[x] -= n * k
                    if not left[x]:
                        del lengths[bisect.bisect_left(lengths, x)]
                again = True
    return fixed


def lower_bound(histogram: dict[int, int], capacity: int) -> int:
    """Martello and Toth's L2: no packing has fewer sequences."""
    best, sizes = 0, sorted(histogram)
    for least in [0, *(x for x in sizes if 2 * x <= capacity)]:
        alone = sum(n for x, n in histogram.items() if x > capacity - least)
        large = {x: n for x, n in histogram.items() if 2 * x > capacity and x <= capacity - least}
        small = sum(x * n for x, n in histogram.items() if least <= x and 2 * x <= capacity)
        free = sum((capacity - x) * n for x, n in large.items())
        best = max(best, alone + sum(large.values()) + max(0, -(-(small - free) // capacity)))
    return best


def best_fit(left: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit, longest first, on whole groups of equally filled sequences: free places -> groups with that much room."""
    room: dict[int, list[Pattern]] = {}
    order: list[int] = []

    def put(free: int, p: Pattern) -> None:
        if free not in room:
            room[free] = []
            bisect.insort(order, free)
        room[free].append(p)

    for size in sorted(left, reverse=True):
        n = left[size]
        while n:
            at = bisect.bisect_left(order, size)
            if at == len(order):
                each = capacity // size
                full, rest = divmod(n, each)
                if full:
                    put(capacity - each * size, Pattern(full, ((size, each),)))
                if rest:
                    put(capacity - rest * size, Pattern(1, ((size, rest),)))
                n = 0
                break
            free = order[at]
            group = room[free].pop()
            if not room[free]:
                del room[free]
                order.pop(at)
            each = min(free // size, n)
            take = min(group.count, n // each)
            put(free - each * size, Pattern(take, (*group.items, (size, each))))
            if group.count > take:
                put(free, Pattern(group.count - take, group.items))
            n -= take * each
    return [p for groups in room.values() for p in groups]


def plan(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    left = dict(histogram)
    return dominate(left, capacity) + best_fit({k: v for k, v in left.items() if v}, capacity)


def places(patterns: list[Pattern]) -> dict[int, tuple[list[int], list[tuple[int, int, int]]]]:
    """For each length the first ranks, ascending, of its blocks and each block's (first sequence, first offset, pieces a sequence)."""
    out: dict[int, tuple[list[int], list[tuple[int, int, int]]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for p in patterns:
        offset = 0
        for length, each in p.items:
            starts, blocks = out.setdefault(length, ([], []))
            starts.append(used.get(length, 0))
            blocks.append((sequence, offset, each))
            used[length] = used.get(length, 0) + p.count * each
            offset += length * each
        sequence += p.count
    return out


def cut(ids: bytes, capacity: int) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's packed ids; of a longer one, the first piece takes the remainder."""
    n = len(ids) // 4
    first = n if n <= capacity else n % capacity or capacity
    start, length = 0, first
    piece = 0
    while start < n:
        yield piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])
        start, length, piece = start + length, capacity, piece + 1


def pieces(docs: DataFrame, path: str, ranks: str | None = None, pattern: str | None = None, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32[, ids]) of all documents, each ended by id 0."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, which, kept = [], [], []
            for i, ids in enumerate(tokens.packed_ids(batch.column(1), path, ranks, pattern)):
                ids += SEPARATOR
                for row in cut(ids, capacity):
                    rows.append(row)
                    which.append(i)
                    if with_ids:
                        kept.append(memoryview(ids)[4 * row[1] : 4 * (row[1] + row[2])].cast("I").tolist())
            if rows:
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
                columns = [batch.column(0).take(pa.array(which, pa.int64())), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))]
                yield pa.record_batch(columns + [pa.array(kept, pa.list_(pa.int32()))] * with_ids, names)

    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    kind = read.schema["doc_id"].dataType.simpleString()
    return read.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def pack(docs: DataFrame, path: str, ranks: str | None = None, pattern: str | None = None, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """pieces() with each piece's place: sequence_id and offset, gapless from 0 within a sequence."""
    cut_up = written(pieces(docs, path, ranks, pattern, capacity, id_col, text_col, with_ids), "pieces")
    histogram = {r["length"]: r["n"] for r in cut_up.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    if not histogram:
        return cut_up.withColumns({"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")})
    found = cut_up.sparkSession.sparkContext.broadcast(places(plan(histogram, capacity)))  # its size follows capacity, not the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = found.value
        for batch in batches:
            sequence, offset = [], []
            for length, rank in zip(batch.column("length").to_pylist(), batch.column("__rank").to_pylist()):
                starts, blocks = table[length]
                k = bisect.bisect_right(starts, rank) - 1
                first, begin, each = blocks[k]
                s, o = divmod(rank - starts[k], each)
                sequence.append(first + s)
                offset.append(begin + o * length)
            keep = [c for c in batch.schema.names if c != "__rank"]
            yield batch.select(keep).append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    order = ["doc_id", "piece", "start", "ids_crc32"]
    placed = ranked(cut_up, ["length"], order, "__rank").select(*cut_up.columns, "__rank")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut_up.schema)
    return placed.mapInArrow(run, f"{schema}, sequence_id long, offset long")
