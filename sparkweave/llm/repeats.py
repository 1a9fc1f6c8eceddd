"""Suffix-array dedup: removal of every byte covered by a 200-byte string that also starts elsewhere.

1. Anchors. Of the 128-byte strings inside a 200-byte string, the one with the least hash is its
   anchor, so equal 200-byte strings have equal anchors. Consecutive starts with one anchor form a
   run; a run's piece is all bytes of its 200-byte strings.
2. Documents are dealt to shards by a hash of their id and text. A shard asks about its anchors: the
   hashes of each anchor and of each different piece around it, once, packed by range of anchors. The
   task that holds a range tells the shards, in the order in which they asked, which pieces occur
   once though their anchor has others (the ends of a repeat), which occur twice or more and so are
   repeated whole, and which of these stand for all their copies where an anchor has other pieces.
3. Those others are dealt by anchor, each content once. Each task builds the Burrows-Wheeler
   transforms of shards of its pieces and merges them in a tree. A merge refines the interleave of
   two transforms, a symbol at a time, up to 200 bytes; blocks of the interleave are the suffixes
   with that long a common prefix, so a block of two or more is a repeated interval. No suffix of a
   shard is sorted again. Equal 200-byte strings start equally far from their anchor, so a symbol can
   be 8 bytes: a piece gives eight strings, one for each distance from the anchor modulo 8. The anchor
   itself, equal in all of them, is left out but for two symbols, so a merge takes 11 rounds.
4. The rare anchors with more different pieces than a task should merge (PIECES) are settled by
   counting the 128-bit hashes of their 200-byte strings, which Spark can split further. No piece is
   left out.
5. The repeated ranges go back to their shards, which join and hash the remaining bytes. The texts are
   exchanged once and read three times.

Edge cases: a null text is empty; nothing is removed from texts under 200 bytes; matches never
cross documents; repeated rows match each other; ties and periodic texts (overlapping matches)
count as any other; a very long text is part of one shard, whole; extra columns are ignored, whatever
they are called; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import _BYTE, U64, _flat, _power_tables, mix, slices

LENGTH, ANCHOR, SYMBOL = 200, 128, 8
#: Zero bytes that stand for the anchor while its pieces are merged.
STAND_IN = 2 * SYMBOL
#: Bytes of text in a shard of documents, about.
PART = 6 << 20
#: Bytes of a shard whose transform is built at once. Two shards have under 65,536 symbols, which NumPy sorts by radix.
SHARD_BYTES = 1 << 15
#: Different pieces of one anchor that one task merges.
PIECES = 4096
_PLACE = (1 << 24) - 1
#: Longer texts are read in overlapping parts.
_LONG = 1 << 22


def runs(data: np.ndarray, offsets: np.ndarray):
    """(start, end, place, anchor, content, text) of the runs: first and last start, the anchor's place in the piece,
    64-bit hashes, index of the text."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, none.view(U64), none.view(U64), none
    powers, inverses = _power_tables(n + 1)
    total = np.zeros(n + 1, U64)
    np.cumsum(_BYTE[data] * powers[:n], out=total[1:])
    grams = mix((total[ANCHOR:] - total[:-ANCHOR]) * inverses[: n - ANCHOR + 1])
    keys = (grams & ~U64(_PLACE)) | np.arange(len(grams), dtype=U64)
    w = LENGTH - ANCHOR + 1
    padded = np.full(-(-len(keys) // w) * w, ~U64(0))
    padded[: len(keys)] = keys
    table = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - LENGTH + 1], ahead[w - 1 : w - 1 + n - LENGTH + 1])
    anchor = (least & U64(_PLACE)).astype(np.int64)
    counts = np.maximum(np.diff(offsets) - LENGTH + 1, 0)
    first = np.concatenate([[0], np.cumsum(counts)])
    starts = np.repeat(offsets[:-1] - first[:-1], counts) + np.arange(first[-1])
    text = np.repeat(np.arange(len(counts)), counts)
    if not len(starts):
        return none, none, none, none.view(U64), none.view(U64), none
    own = anchor[starts]
    fresh = np.flatnonzero((own[1:] != own[:-1]) | (text[1:] != text[:-1])) + 1
    low, high = np.concatenate([[0], fresh]), np.concatenate([fresh - 1, [len(starts) - 1]])
    s, e = starts[low], starts[high]
    content = mix((total[e + LENGTH] - total[s]) * inverses[s]) ^ mix((e - s).astype(U64))
    return s, e, own[low] - s, mix(grams[own[low]]), content, text[low]


def _parts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(first row, offsets, bytes, position of the bytes in the row's text): slices of rows, long texts in parts."""
    for row, offsets, data in slices(column):
        if len(data) <= _LONG:
            yield row, offsets, data, 0
            continue
        for i in range(len(offsets) - 1):
            text = data[offsets[i] : offsets[i + 1]]
            for at in range(0, max(len(text) - LENGTH + 1, 1), _LONG):
                piece = text[at : at + _LONG + LENGTH - 1]
                yield row + i, np.array([0, len(piece)]), piece, at


class Shard:
    """The texts of a shard and their runs: start and end in all bytes, row, place of the anchor, anchor, content.

    g and c are the different (anchor, content) in order, which the place of each run's among them, m their counts.
    """

    def __init__(self, table: pa.Table):
        column = table.column("text").combine_chunks()
        offsets, self.data = _flat(column)
        self.offsets, held = offsets, [[] for _ in range(6)]
        for row, own, data, at in _parts(column):
            s, e, place, g, c, text = runs(data, own)
            text_at = offsets[text + row] - own[text] + at
            for x, y in zip(held, (s + text_at, e + text_at, text + row, place, g, c)):
                x.append(y)
        kinds = (np.int64, np.int64, np.int64, np.int64, U64, U64)
        self.start, self.end, self.row, self.place, g, c = (np.concatenate([np.zeros(0, k), *x]) for x, k in zip(held, kinds))
        order = np.lexsort((c, g))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (c[order][1:] != c[order][:-1]) | (g[order][1:] != g[order][:-1])
        self.which = np.empty(len(order), np.int64)
        self.which[order] = np.cumsum(fresh) - 1
        self.first = order[fresh]
        self.g, self.c, self.m = g[self.first], c[self.first], np.bincount(self.which)

    def flags(self, told: pa.Table, buckets: int) -> np.ndarray:
        """What was told of each different (anchor, content)."""
        out, cuts = np.zeros(len(self.g), np.uint8), _ranges(self.g, buckets)
        for bucket, flags in zip(told.column("bucket").to_pylist(), told.column("flags").to_pylist()):
            if flags is not None:
                here = out[cuts[bucket] : cuts[bucket + 1]]
                here[:] = np.frombuffer(pa.decompress(flags, len(here), "zstd", asbytes=True), np.uint8)
        return out


def _ranges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each range of keys begins among keys (sorted), and their end."""
    bounds = np.array([(i << 64) // buckets for i in range(1, buckets)], U64)
    return np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(columns, schema)], schema=schema)


def _signed(x: np.ndarray) -> list[int]:
    return x.view(np.int64).tolist()


ASKED = "shard int, bucket int, g binary, c binary, m binary"
_ASKED = pa.schema([("shard", pa.int32()), ("bucket", pa.int32()), ("g", pa.binary()), ("c", pa.binary()), ("m", pa.binary())])


def _ask(buckets: int):
    def run(key, table):
        shard = Shard(table)
        cuts, rows = _ranges(shard.g, buckets), []
        for i in np.flatnonzero(np.diff(cuts)).tolist():
            some = slice(cuts[i], cuts[i + 1])
            twice = np.packbits(shard.m[some] > 1).tobytes()
            rows.append((key[0].as_py(), i, shard.g[some].tobytes(), shard.c[some].tobytes(), twice))
        return pa.Table.from_batches([_batch(rows, _ASKED)])

    return run


#: Flags: the piece is repeated whole; its content is to be merged; its repeated starts are to be told; its anchor has too many pieces.
WHOLE, MERGED, OWN, HOT = 1, 2, 4, 8
TOLD = "shard int, bucket int, flags binary"


def verdict(g: np.ndarray, c: np.ndarray, twice: np.ndarray, most: int) -> np.ndarray:
    """Flags of the rows of whole anchors: each shard's different (anchor, content), and whether the shard has it twice."""
    order = np.lexsort((c, g))
    g, c = g[order], c[order]
    new_g, new = np.ones(len(g), bool), np.ones(len(g), bool)
    new_g[1:] = g[1:] != g[:-1]
    new[1:] = new_g[1:] | (c[1:] != c[:-1])
    content, anchor = np.cumsum(new) - 1, np.cumsum(new_g) - 1
    whole = np.bincount(content, weights=1 + twice[order])[content] > 1
    kinds = np.bincount(anchor, weights=new)
    single = np.bincount(anchor, weights=~whole)
    mixed = ((kinds > 1) & (single > 0))[anchor]
    flags = whole * WHOLE + (mixed & new) * MERGED + (mixed & ~whole) * OWN + (mixed & new & (kinds > most)[anchor]) * HOT
    out = np.empty(len(g), np.uint8)
    out[order] = flags
    return out


def _tell(most: int):
    """Rows sorted by bucket."""
    schema = pa.schema([("shard", pa.int32()), ("bucket", pa.int32()), ("flags", pa.binary())])

    def close(bucket, held):
        g, c, twice = (np.concatenate([x[i] for x in held]) for i in (1, 2, 3))
        parts = np.split(verdict(g, c, twice, most), np.cumsum([len(x[1]) for x in held])[:-1])
        return _batch([(x[0], bucket, pa.compress(y.tobytes(), "zstd", asbytes=True)) for x, y in zip(held, parts)], schema)

    def run(batches):
        now, held = None, []
        for batch in batches:
            for shard, bucket, g, c, m in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if bucket != now:
                    if held:
                        yield close(now, held)
                    now, held = bucket, []
                g = np.frombuffer(g, U64)
                held.append((shard, g, np.frombuffer(c, U64), np.unpackbits(np.frombuffer(m, np.uint8), count=len(g))))
        if held:
            yield close(now, held)

    return run


CONTENTS = "g long, c long, shard int, hot boolean, place int, bytes binary"
_CONTENTS = pa.schema(
    [("g", pa.int64()), ("c", pa.int64()), ("shard", pa.int32()), ("hot", pa.bool_()), ("place", pa.int32()), ("bytes", pa.binary())]
)


def _contents(buckets: int):
    """The pieces to merge, without their anchors; shard is -1 where the repeated starts are known."""

    def run(key, table, told):
        shard = Shard(table)
        flags, rows = shard.flags(told, buckets), []
        some = np.flatnonzero(flags & MERGED)
        at = shard.first[some]
        data, of = shard.data, key[0].as_py()
        for g, c, f, a, b, q in zip(
            _signed(shard.g[some]), _signed(shard.c[some]), flags[some].tolist(), shard.start[at].tolist(), shard.end[at].tolist(), shard.place[at].tolist()
        ):
            content = data[a : a + q].tobytes() + data[a + q + ANCHOR : b + LENGTH].tobytes()
            rows.append((g, c, of if f & OWN else -1, bool(f & HOT), q, content))
        return pa.Table.from_batches([_batch(rows, _CONTENTS)])

    return run


class Transform:
    """Burrows-Wheeler transform of strings, with the text position of each sorted suffix.

    Symbols are numbers from 1; 0 ends a string, and all ends differ.
    """

    def __init__(self, symbols: np.ndarray, suffixes: np.ndarray, strings: int, blocks: np.ndarray | None = None):
        self.symbols, self.suffixes, self.strings, self.blocks = symbols, suffixes, strings, blocks

    @classmethod
    def built(cls, text: np.ndarray, at: int) -> Transform:
        """Of text, whose strings each end in 0, by prefix doubling; at is added to the positions."""
        ends = np.flatnonzero(text == 0)
        rank = np.unique(text, return_inverse=True)[1] + len(ends)
        rank[ends] = np.arange(len(ends))
        step, n = 1, len(text)
        while True:
            key = rank * (2 * n + 2)
            key[:-step or None] += rank[step:] + 1
            order = np.argsort(key, kind="stable")
            fresh = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
            rank = np.empty(n, np.int64)
            rank[order] = fresh
            step *= 2
            if fresh[-1] == n - 1 or step >= n:
                break
        return cls(text[order - 1], order + at, len(ends))


def merge(a: Transform, b: Transform, depth: int = LENGTH // SYMBOL) -> Transform:
    """Interleave of two transforms by iterative refinement: after d rounds suffixes are ordered by d symbols.

    A round prepends to each suffix the symbol before it: a stable sort by that symbol takes the
    interleave of the suffixes to that of the longer ones. Neighbours stay in one block while
    their symbols are equal and the suffixes behind them were in one block.
    """
    n, ends = len(a.symbols) + len(b.symbols), a.strings + b.strings
    head = np.arange(ends) >= a.strings
    from_b = np.zeros(n, bool)
    from_b[len(a.symbols) :] = True
    block = np.zeros(n, np.int32)
    symbols = np.empty(n, a.symbols.dtype)
    for _ in range(depth):
        symbols[~from_b], symbols[from_b] = a.symbols, b.symbols
        order = np.argsort(symbols, kind="stable")[ends:]
        ordered, behind = symbols[order], block[order]
        fresh = np.empty(n, bool)
        fresh[:ends] = True
        fresh[ends] = True
        fresh[ends + 1 :] = (ordered[1:] != ordered[:-1]) | (behind[1:] != behind[:-1])
        from_b = np.concatenate([head, from_b[order]])
        block = np.cumsum(fresh, dtype=np.int32)
        if fresh.all():
            depth = 0
            break
    symbols[~from_b], symbols[from_b] = a.symbols, b.symbols
    suffixes = np.empty(n, np.int64)
    suffixes[~from_b], suffixes[from_b] = a.suffixes, b.suffixes
    return Transform(symbols, suffixes, ends, block)


def _symbols(pieces: list[tuple[int, bytes]], groups: list[int] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, piece, position, first string of each piece): ranks of 8-byte words from 1, strings end in 0.

    A piece is (place of the anchor, bytes). Its words are dealt to eight strings by distance from the anchor modulo 8.
    With groups, the first word inside the anchor is a symbol of the group and the distance instead.
    """
    sizes = np.array([len(p) for _, p in pieces])
    data = np.frombuffer(b"".join(p for _, p in pieces), np.uint8).astype(U64)
    word = np.zeros(len(data) - SYMBOL + 1, U64)
    for j in range(SYMBOL):
        word |= data[j : j + len(word)] << U64(8 * j)
    counts = sizes - SYMBOL + 1
    first = np.concatenate([[0], np.cumsum(sizes)])
    piece = np.repeat(np.arange(len(pieces)), counts)
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    distance = at - np.array([q for q, _ in pieces])[piece]
    phase = distance % SYMBOL
    known, rank = np.unique(word[first[piece] + at], return_inverse=True)
    rank, most = rank + 1, len(known)
    if groups is not None:
        anchors = np.flatnonzero((distance >= 0) & (distance < SYMBOL))
        rank[anchors] = most + 1 + np.array(groups)[piece[anchors]] * SYMBOL + phase[anchors]
        most += SYMBOL * (max(groups) + 1)
    ends = np.repeat(np.arange(len(pieces)), SYMBOL)
    string = np.concatenate([piece * SYMBOL + phase, np.arange(len(pieces) * SYMBOL)])
    order = np.argsort(string, kind="stable")
    kind = np.uint16 if most < 65535 else np.uint32
    symbols = np.concatenate([rank, np.zeros(len(ends), np.int64)]).astype(kind)[order]
    piece, at = np.concatenate([piece, ends])[order], np.concatenate([at, np.full(len(ends), -1)])[order]
    return symbols, piece, at, np.concatenate([[0], np.cumsum(counts + SYMBOL)])


def repeated(pieces: list[tuple[int, bytes]], groups: list[int] | None = None) -> list[np.ndarray]:
    """For each piece (place of its anchor, bytes), the positions at which a LENGTH-byte string starts that also starts
    elsewhere in the pieces, equally far from the anchor.

    With groups (a number from 0 for each piece), the pieces of a group share their anchor, every string counted holds
    it whole, and STAND_IN zero bytes are in its place: matches lie within a group, and a string is 88 bytes long.
    """
    symbols, piece, position, first = _symbols(pieces, groups)
    depth = (LENGTH if groups is None else LENGTH - ANCHOR + STAND_IN) // SYMBOL
    shards, at = [], 0
    while at < len(pieces):
        to = max(int(np.searchsorted(first, first[at] + SHARD_BYTES, "right")) - 1, at + 1)
        if at == 0 and to >= len(pieces) > 1:
            to = len(pieces) // 2
        shards.append(Transform.built(symbols[first[at] : first[to]], first[at]))
        at = to
    if len(shards) == 1:
        shards.append(Transform(symbols[:0], first[:0], 0))
    while len(shards) > 1:
        shards = [merge(*shards[i : i + 2], depth) if i + 1 < len(shards) else shards[i] for i in range(0, len(shards), 2)]
    top = shards[0]
    size = np.bincount(top.blocks)
    hits = top.suffixes[size[top.blocks] > 1]
    if groups is not None:
        hits = hits[position[hits] <= np.array([q for q, _ in pieces])[piece[hits]]]
    piece, position = piece[hits], position[hits]
    order = np.lexsort((position, piece))
    return np.split(position[order], np.searchsorted(piece[order], np.arange(1, len(pieces))))


def spans(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of the runs of consecutive starts (increasing)."""
    if not len(starts):
        return starts, starts
    fresh = np.flatnonzero(np.diff(starts) != 1) + 1
    return starts[np.concatenate([[0], fresh])], starts[np.concatenate([fresh - 1, [len(starts) - 1]])]


FOUND = "shard int, c long, low int, high int"
_FOUND = pa.schema([("shard", pa.int32()), ("c", pa.int64()), ("low", pa.int32()), ("high", pa.int32())])


def _merged(batches):
    """Rows sorted by g and c: repeated runs within each piece, groups taken together up to two shards' bytes; hot ones are left out."""
    held, size, last = [], 0, None

    def close():
        groups = {g: i for i, g in enumerate(dict.fromkeys(x[0] for x in held))}
        found = repeated([x[3:] for x in held], [groups[x[0]] for x in held]) if held else ()
        rows = [
            (shard, c, int(low), int(high))
            for (_, c, shard, _, _), starts in zip(held, found) if shard >= 0 for low, high in zip(*spans(starts))
        ]
        return _batch(rows, _FOUND)

    for batch in batches:
        batch = batch.filter(pc.invert(batch.column("hot")))
        for g, c, shard, place, content in zip(*(batch.column(x).to_pylist() for x in ("g", "c", "shard", "place", "bytes"))):
            content = content[:place] + bytes(STAND_IN) + content[place:]
            if g != last and size + len(content) >= 2 * SHARD_BYTES - 4096:
                yield close()
                held, size = [], 0
            held.append((g, c, shard, place, content))
            size, last = size + len(content), g
    yield close()


def _windows(batches):
    """(shard, g, c, at, h1, h2): two 64-bit hashes of each 200-byte string of the hot anchors' pieces, without the anchor."""
    schema = pa.schema([("shard", pa.int32()), *((x, pa.int64()) for x in ("g", "c", "at", "h1", "h2"))])
    for batch in batches:
        batch, rows = batch.filter(batch.column("hot")), []
        for g, c, shard, place, content in zip(*(batch.column(x).to_pylist() for x in ("g", "c", "shard", "place", "bytes"))):
            for at in range(len(content) - (LENGTH - ANCHOR) + 1):
                digest = hashlib.blake2b(content[at : at + LENGTH - ANCHOR], digest_size=16, salt=(place - at).to_bytes(2, "little")).digest()
                rows.append((shard, g, c, at, *(int.from_bytes(digest[i : i + 8], "little", signed=True) for i in (0, 8))))
            if len(rows) > 10_000:
                yield _batch(rows, schema)
                rows = []
        yield _batch(rows, schema)


def _removed(buckets: int, kept_bytes: bool):
    """The rows of a shard without their repeated bytes, from what was told and found of its pieces."""

    def run(key, table, news):
        shard = Shard(table)
        flags = shard.flags(news, buckets)
        whole = np.flatnonzero(flags[shard.which] & WHOLE)
        starts, ends, rows = [shard.start[whole]], [shard.end[whole] + LENGTH], [shard.row[whole]]
        known = news.filter(news.column("c").is_valid())
        own = np.flatnonzero(flags & OWN)
        own = own[np.argsort(shard.c[own])]
        c, low, high = (known.column(x).to_numpy().astype(np.int64) for x in ("c", "low", "high"))
        if len(c):
            run_ = shard.first[own[np.searchsorted(shard.c[own], c.view(U64))]]
            starts.append(shard.start[run_] + low)
            ends.append(shard.start[run_] + high + LENGTH)
            rows.append(shard.row[run_])
        start, end, row = (np.concatenate(x) for x in (starts, ends, rows))
        order = np.argsort(start, kind="stable")
        start, end, row = start[order], np.maximum.accumulate(end[order]) if len(order) else end, row[order]
        fresh = np.ones(len(start), bool)
        fresh[1:] = (start[1:] > end[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(fresh)
        last = np.append(first[1:], len(start)) - 1 if len(first) else first
        begin, stop, of = start[first], end[last], row[first]
        n, offsets, data = len(table), shard.offsets, shard.data
        change = np.zeros(len(data) + 1 + int(offsets[0]), np.int8)
        np.add.at(change, begin, 1)
        np.add.at(change, stop, -1)
        keep = np.cumsum(change[:-1]) == 0
        left = [data[a:b][keep[a:b]].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        out = [
            table.column("doc_id").combine_chunks(), pa.array(np.diff(offsets)), pa.array(np.bincount(of, stop - begin, n).astype(np.int64)),
            pa.array(np.bincount(of, minlength=n)), pa.array([hashlib.sha256(x).hexdigest() for x in left], pa.string()),
        ]
        if kept_bytes:
            out.append(pa.array(left, pa.binary()))
        return pa.Table.from_arrays(out, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(out)])

    return run


def dedup(docs: DataFrame, kept_bytes: bool = True, part: int = PART, pieces: int = PIECES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with kept_bytes, kept: the remaining bytes, which may cut a character.

    part and pieces bound what a task holds, not what is found.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n_bytes = F.octet_length("text").cast("long")
    buckets = int(docs.agg(F.sum(n_bytes)).first()[0] or 0) // part + 1
    dealt = docs.filter(n_bytes >= LENGTH).withColumn("shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("int"))
    asked = dealt.groupBy("shard").applyInArrow(_ask(buckets), ASKED)
    told = asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_tell(pieces), TOLD)
    contents = dealt.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(_contents(buckets), CONTENTS)
    # both readers take all rows of one exchange, which a filter would double
    contents = contents.repartition(F.when(F.col("hot"), F.xxhash64("c")).otherwise(F.col("g")))
    found = contents.sortWithinPartitions("g", "c").mapInArrow(_merged, FOUND)
    strings = contents.mapInArrow(_windows, "shard int, g long, c long, at long, h1 long, h2 long")
    again = strings.groupBy("g", "h1", "h2").agg(F.count("*").alias("m")).filter("m > 1").select("g", "h1", "h2")
    at = F.col("at").cast("int")
    counted = strings.filter("shard >= 0").join(again, ["g", "h1", "h2"], "left_semi").select("shard", "c", at.alias("low"), at.alias("high"))
    news = told.unionByName(found.union(counted), allowMissingColumns=True)
    kinds = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * kept_bytes
    long = dealt.groupBy("shard").cogroup(news.groupBy("shard")).applyInArrow(_removed(buckets, kept_bytes), kinds)
    none = F.lit(0).cast("long")
    short = docs.filter(n_bytes < LENGTH).select(
        "doc_id", n_bytes.alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"),
        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), *[F.col("text").cast("binary").alias("kept")] * kept_bytes,
    )
    return long.union(short)
