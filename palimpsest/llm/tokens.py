"""Token counts and ids of whole texts in Arrow functions: texts are split at safe boundaries, each distinct piece of a
group of texts balanced by bytes goes to the library once, and lengths or packed ids alone come back.

Edge cases: a null text counts as empty and has no tokens; equal rows get equal results; an empty table gives an empty
result; columns other than the id and the text are not read; an id may be null. Added tokens inside a text are handled
as the library's default: no boundary falls inside one.
"""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP_BYTES = 1 << 20  # of texts that are split at once; a longer text comes in several parts
BATCH_BYTES = 1 << 18  # of pieces that go to the library at once
KEPT_PIECES, KEPT_BYTES = 200_000, 1 << 10  # pieces that a worker remembers from group to group, and their size

#: Bytes that may follow a space at which a text is cut: no ASCII white space or control, no first byte of a Unicode space.
FOLLOWS = np.array([0x20 < b and b not in (0x7F, 0xC2, 0xE1, 0xE2, 0xE3) for b in range(256)])
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

_encoders: dict[tuple, Encoder] = {}
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** (0 .. n-1) modulo 2 ** 64."""
    if base not in _powers or len(_powers[base]) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return _powers[base][:n]


def safe_starts(data: np.ndarray, rule: str) -> np.ndarray:
    """Where a piece may start. "spaced": at a space that a non-space follows, where byte-level pre-tokenizers start a
    token; "dropped": at any space or line end, for tokenizers that drop white space; "whole": nowhere."""
    if rule == "whole":
        return np.zeros(len(data), bool)
    space = data == 0x20
    if rule == "spaced":
        space[:-1] &= FOLLOWS[data[1:]]
        space[-1:] = False
    else:
        space |= data == 0x0A
    return space


#: Normalisers that treat what stands between white space alike wherever a text begins and ends.
EACH_BY_ITSELF = ("Lowercase", "NFC", "NFD", "NFKC", "NFKD", "StripAccents", "Replace")


class Group:
    """Some texts' bytes cut into pieces, equal pieces found by a polynomial hash and then compared byte by byte.
    offsets: where texts begin and end; the last is the length of data. rule: where they may be cut, see safe_starts()."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, rule: str) -> None:
        space = safe_starts(data, rule)
        if rule == "spaced":
            space[offsets[1:][offsets[1:] > 0] - 1] = False  # what follows is another text
        full = offsets[:-1] < offsets[1:]
        space[offsets[:-1][full]] = True
        starts = np.flatnonzero(space)
        lengths = np.diff(np.append(starts, len(data)))
        self.text_at = np.searchsorted(starts, offsets)  # each text's first piece
        hashes = np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), starts) * powers(INVERSE, len(data))[starts] if len(starts) else np.zeros(0, np.uint64)
        _, first, self.which = np.unique(hashes, return_index=True, return_inverse=True)
        away = starts[first][self.which] - starts
        raw = data.tobytes()
        if (lengths[first][self.which] != lengths).any() or (data != data[np.repeat(away, lengths) + np.arange(len(data))]).any():
            # Different pieces share a hash (some texts are made so that any such hash collides): tell them apart as bytes.
            known: dict[bytes, int] = {}
            ends = (starts + lengths).tolist()
            self.which = np.array([known.setdefault(raw[s:e], len(known)) for s, e in zip(starts.tolist(), ends)], np.int64)
            self.distinct = list(known)
            return
        self.distinct = [raw[s : s + n] for s, n in zip(starts[first].tolist(), lengths[first].tolist())]

    def by_text(self, sizes: np.ndarray) -> np.ndarray:
        """Sums over each text of its pieces' sizes (given for distinct pieces)."""
        total = np.concatenate(([0], np.cumsum(sizes[self.which])))
        return np.diff(total[self.text_at])


class Encoder:
    """A file of the library `tokenizers`. ranks: a tiktoken file of the same vocabulary, which encodes pieces without added tokens faster."""

    def __init__(self, path: str, ranks: str | None, pattern: str | None) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks already use every core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.rule = self.cut_rule()
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, dict[bytes, object]] = {"lengths": {}, "packed": {}}
        self.bpe = None
        if ranks:
            import tiktoken

            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
            self.bpe = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=table, special_tokens={})
            self.widths = np.zeros(max(table.values()) + 1, np.int64)
            for token, rank in table.items():
                self.widths[rank] = len(token)

    def cut_rule(self) -> str:
        """safe_starts()'s rule for this file, from its pre-tokenizer and added tokens; a kind that isn't known is not cut."""
        made = json.loads(self.tokenizer.to_str())
        steps = made.get("pre_tokenizer") or {}
        steps = steps.get("pretokenizers", [steps])
        added = [t["content"] for t in made.get("added_tokens", [])]
        if any(" " in a or "\n" in a for a in added) or any(t.get("lstrip") or t.get("rstrip") for t in made.get("added_tokens", [])):
            return "whole"
        normal = made.get("normalizer") or {}
        if any(n.get("type") not in EACH_BY_ITSELF for n in normal.get("normalizers", [normal] if normal else [])):
            return "whole"
        first = steps[0]
        if first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and r"[^\s" in first["pattern"].get("Regex", ""):
            return "dropped"
        if made.get("normalizer") is None and len(steps) == 1 and first.get("type") == "ByteLevel" and first.get("use_regex") and not first.get("add_prefix_space"):
            return "spaced"
        return "whole"

    def look_up(self, pieces: list[bytes], encode: Callable[[list[bytes]], list]) -> list:
        """Each piece's value. What is new is encoded together; the first KEPT_PIECES stay known."""
        known = self.known[encode.__name__]
        found = list(map(known.get, pieces))
        new = [i for i, v in enumerate(found) if v is None]
        fresh = [pieces[i] for i in new]
        values = encode(fresh)
        for i, v in zip(new, values):
            found[i] = v
        if len(known) < KEPT_PIECES:
            known.update((p, v) for p, v in zip(fresh, values) if len(p) <= KEPT_BYTES)
        return found

    def by_library(self, pieces: list[bytes], value: Callable) -> list:
        found, at, held = [], 0, 0
        for i, piece in enumerate(pieces):
            held += len(piece) + 16
            if held >= BATCH_BYTES or i + 1 == len(pieces):
                found += map(value, self.tokenizer.encode_batch_fast([p.decode() for p in pieces[at : i + 1]], add_special_tokens=False))
                at, held = i + 1, 0
        return found

    def lengths(self, pieces: list[bytes]) -> list[int]:
        return self.by_library(pieces, len)

    def packed(self, pieces: list[bytes]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit numbers. Pieces that start with a space and a non-space are encoded as
        one text and told apart by their bytes; the others go to the library."""
        if not self.bpe:
            return self.by_library(pieces, lambda e: np.array(e.ids, "<u4").tobytes())
        plain = [len(p) > 1 and p[0] == 0x20 and FOLLOWS[p[1]] and not any(a in p for a in self.added) for p in pieces]
        joined = [p for p, is_plain in zip(pieces, plain) if is_plain]
        ids = np.array(self.bpe.encode_ordinary(b"".join(joined).decode()), "<u4")
        cuts = np.searchsorted(np.cumsum(self.widths[ids]), np.cumsum([len(p) for p in joined])) + 1
        raw, cuts = ids.tobytes(), (4 * cuts).tolist()
        quick = iter([raw[a:b] for a, b in zip([0, *cuts[:-1]], cuts)])
        slow = iter(self.by_library([p for p, is_plain in zip(pieces, plain) if not is_plain], lambda e: np.array(e.ids, "<u4").tobytes()))
        return [next(quick) if is_plain else next(slow) for is_plain in plain]


def encoder(path: str, ranks: str | None = None, pattern: str | None = None) -> Encoder:
    """One per worker process; its memory of pieces outlives a task."""
    if (path, ranks) not in _encoders:
        _encoders[path, ranks] = Encoder(path, ranks, pattern)
    return _encoders[path, ranks]


def groups(column: pa.Array, rule: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A binary column's bytes, offsets and each part's row (null: empty), in runs of rows of about GROUP_BYTES. A longer
    row comes in several parts, cut where a piece may start, so that memory doesn't follow the longest text."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + GROUP_BYTES, side="right")) - 1)
        begin, end = int(offsets[at]), int(offsets[to])
        while end - begin > GROUP_BYTES:  # one long row
            cut = next_start(data, begin + GROUP_BYTES, end, rule)
            if cut is None:
                break
            yield data[begin:cut], np.array([0, cut - begin]), np.array([at])
            begin = cut
        rows = np.arange(at, to)
        yield data[begin:end], np.concatenate(([0], offsets[at + 1 : to + 1] - begin)), rows
        at = to


def next_start(data: np.ndarray, begin: int, end: int, rule: str) -> int | None:
    """The first place from begin on where a piece may start, if any before end."""
    while begin < end:
        upto = min(end, begin + (1 << 16))
        hits = np.flatnonzero(safe_starts(data[begin : min(end, upto + 1)], rule)[: upto - begin])
        if len(hits):
            return begin + int(hits[0])
        begin = upto
    return None


def counts(column: pa.Array, path: str) -> np.ndarray:
    """Tokens of each text of a binary column."""
    enc = encoder(path)
    found = np.zeros(len(column), np.int64)
    for data, offsets, rows in groups(column, enc.rule):
        group = Group(data, offsets, enc.rule)
        found[rows] += group.by_text(np.array(enc.look_up(group.distinct, enc.lengths), np.int64))
    return found


def packed_ids(column: pa.Array, path: str, ranks: str | None = None, pattern: str | None = None) -> Iterator[bytes]:
    """Each text's ids, in order, as little-endian unsigned 32-bit numbers."""
    enc = encoder(path, ranks, pattern)
    held, of = [], 0  # parts of a row that are not yet whole
    for data, offsets, rows in groups(column, enc.rule):
        group = Group(data, offsets, enc.rule)
        values = enc.look_up(group.distinct, enc.packed)
        ids, sizes = np.frombuffer(b"".join(values), "<u4"), np.array([len(v) // 4 for v in values], np.int64)
        each = sizes[group.which]
        first = (np.cumsum(sizes) - sizes)[group.which] - (np.cumsum(each) - each)
        raw = ids[np.repeat(first, each) + np.arange(each.sum())].tobytes()
        ends = np.concatenate(([0], np.cumsum(group.by_text(sizes)))) * 4
        for row, a, b in zip(rows.tolist(), ends[:-1].tolist(), ends[1:].tolist()):
            if row != of:
                yield b"".join(held)
                held, of = [], row
            held.append(raw[a:b])
    if len(column):
        yield b"".join(held)


def token_counts(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens, over_limit): UTF-8 bytes and tokens of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(counts(batch.column(1), path))], ["doc_id", "n_bytes", "n_tokens"])

    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    kind = read.schema["doc_id"].dataType.simpleString()
    return read.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
