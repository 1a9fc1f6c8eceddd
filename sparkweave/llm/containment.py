"""Size-partitioned MinHash search for short texts inside long documents.

The short texts (items) are few or many, but always a stated query set: they are read in blocks
of bounded size, and every block is matched against all documents in one pass without a shuffle.

Items are partitioned by their count of shingles: a partition's items have more than half of, and
at most, `width` shingles. A document is cut, for each partition, into windows of 2 * width
shingles that start every width shingles, so an item's passage of up to width shingles lies whole
within one window. There the Jaccard similarity of item and window is bounded from below by
containment * u / (2 * width + (1 - containment) * u) with u > width / 2, which is
0.8 * 0.5 / 2.1 = 0.19 and more. A band is one MinHash value; BANDS bands miss such a pair with a
chance of at most (1 - 0.19) ** 48 < 5e-5, and an exact copy (0.25) with (0.75) ** 48 < 2e-6.
A window can share a band only with an item whose least shingle it holds, so a table of the items'
least shingles rules out, without loss, most documents and the parts of others before any band is
computed. Every retrieved pair is then verified by the exact share of the item's shingles that the
whole document contains.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .recovery import cut
from .shingles import Words, mix, shingles, windows, words

#: One MinHash value each.
BANDS = 48
#: Bytes of item text in a block: what a task holds of the items is bounded by it.
BLOCK_BYTES = 8_000_000
#: Ids of found documents up to this number are broadcast to filter the documents; more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000
#: Shingles of a document handled at once; pieces overlap by a window.
PIECE = 1 << 15
_SALTS = mix(np.arange(1, BANDS + 1, dtype=np.uint64))


def band_values(hashes: np.ndarray) -> np.ndarray:
    """BANDS x n: each band's own order of the shingles."""
    return (hashes[None, :] ^ _SALTS[:, None]) * np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Items:
    """A block of items, indexed: per width, the sorted MinHash values of all bands and their items."""

    keys: list
    sets: list
    #: By count of words, below the width of a shingle: sorted hashes of whole items and their places in keys.
    short: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    index: dict[int, list[tuple[np.ndarray, np.ndarray]]] = field(default_factory=dict)
    least: np.ndarray | None = None
    table: np.ndarray | None = None
    shift: np.uint64 = np.uint64(0)

    def built(self) -> Items:
        widths: dict[int, list[int]] = {}
        for i, own in enumerate(self.sets):
            if len(own):
                widths.setdefault(1 << (len(own) - 1).bit_length(), []).append(i)
        least = [np.unique(own[band_values(own).argmin(axis=1)]) for own in self.sets if len(own)]
        self.least = least = np.unique(np.concatenate(least)) if least else np.zeros(0, np.uint64)
        bits = min(max(12, (64 * len(least)).bit_length()), 26)
        self.table, self.shift = np.zeros(1 << bits, bool), np.uint64(64 - bits)
        self.table[(least >> self.shift).astype(np.int64)] = True
        for width, members in widths.items():
            least = np.stack([band_values(self.sets[i]).min(axis=1) for i in members], axis=1)
            self.index[width] = []
            for band in least:
                order = np.argsort(band, kind="stable")
                self.index[width].append((band[order], np.array(members)[order]))
        return self

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the shingles that are the least of an item in some band."""
        some = np.flatnonzero(self.table[(hashes >> self.shift).astype(np.int64)])
        if not len(some):
            return some
        at = np.minimum(np.searchsorted(self.least, hashes[some]), len(self.least) - 1)
        return some[self.least[at] == hashes[some]]

    def passages(self, w: Words) -> Iterator[tuple[int, int, int]]:
        """(row, item, first position in the row) of the short items that stand in a row as they are."""
        for n, (own, members) in self.short.items():
            found = windows(w.hashes, n)
            low, high = np.searchsorted(own, found, "left"), np.searchsorted(own, found, "right")
            seen: set[tuple[int, int]] = set()
            at = np.flatnonzero(low < high)
            rows = np.searchsorted(w.first, at, side="right") - 1
            for p, row in zip(at[at + n <= w.first[rows + 1]].tolist(), rows[at + n <= w.first[rows + 1]].tolist()):
                for item in members[low[p] : high[p]].tolist():
                    if (row, item) not in seen:
                        seen.add((row, item))
                        yield row, item, p - int(w.first[row])

    def candidates(self, hashes: np.ndarray, hits: np.ndarray) -> set[int]:
        """Items that share a band with some window of the document that holds one of the hits."""
        found: set[int] = set()
        reach = 2 * max(self.index)
        gaps = np.flatnonzero(np.diff(hits) > 2 * reach) + 1
        for low, high in zip(hits[np.append(0, gaps)], hits[np.append(gaps - 1, len(hits) - 1)]):
            for start in range(max(0, low - reach), high + reach, PIECE):
                found |= self._candidates(hashes[start : min(start + PIECE, high) + reach])
        return found

    def _candidates(self, hashes: np.ndarray) -> set[int]:
        found: set[int] = set()
        values = band_values(hashes)
        for width, bands in self.index.items():
            edges = np.arange(0, len(hashes), width)
            blocks = np.minimum.reduceat(values, edges, axis=1)
            if blocks.shape[1] > 1:
                blocks = np.minimum(blocks[:, :-1], blocks[:, 1:])
            for (keys, members), mins in zip(bands, blocks):
                low = np.searchsorted(keys, mins, "left")
                high = np.searchsorted(keys, mins, "right")
                for a, b in zip(low[low < high], high[low < high]):
                    found.update(members[a:b].tolist())
        return found


def _share(own: np.ndarray, hashes: np.ndarray) -> tuple[float, int]:
    """Share of own (sorted) that the document contains, and the first position of one of them."""
    at = np.minimum(np.searchsorted(own, hashes), len(own) - 1)
    hit = own[at] == hashes
    return len(np.unique(at[hit])) / len(own), int(hit.argmax()) if hit.any() else -1


def item_blocks(items: DataFrame, key: str, text: str, k: int, block_bytes: int = BLOCK_BYTES) -> Iterator[Items]:
    """Items in blocks of at most block_bytes of text (or one item), read one block at a time."""
    rows = items.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    keys, texts, held = [], [], 0

    def block() -> Items:
        sets, short = [], {}
        for w in words(pa.array(texts, pa.string()), punctuation=True):
            hashes, first = shingles(w, k)
            for i, n in enumerate(np.diff(w.first).tolist()):
                if 0 < n < k:
                    short.setdefault(n, []).append((windows(w.hashes[w.first[i] : w.first[i + 1]], n)[0], len(sets)))
                sets.append(np.unique(hashes[first[i] : first[i + 1]]) if n >= k else np.zeros(0, np.uint64))
        items = Items(list(keys), sets)
        for n, held in short.items():
            held.sort()
            items.short[n] = np.array([h for h, _ in held], np.uint64), np.array([i for _, i in held])
        return items.built()

    for r in rows.toLocalIterator():
        if keys and held + len(r["text"]) > block_bytes:
            yield block()
            keys, texts, held = [], [], 0
        keys.append(r["key"])
        texts.append(r["text"])
        held += len(r["text"])
    if keys:
        yield block()


def _searched(block, k: int, threshold: float):
    def run(batches):
        items: Items = block.value
        schema = pa.schema([("doc_id", pa.int64()), ("item", pa.int64()), ("containment", pa.float64()), ("at_word", pa.int64())])
        for batch in batches:
            ids, out = batch.column("doc_id").to_pylist(), [[], [], [], []]
            for w in words(batch.column("text"), punctuation=True):
                for row, item, at in items.passages(w):
                    for held, x in zip(out, (ids[w.row + row], items.keys[item], 1.0, at)):
                        held.append(x)
                hashes, first = shingles(w, k)
                hits = items.hits(hashes)
                cuts = np.searchsorted(hits, first)
                for i in np.flatnonzero(np.diff(cuts)):
                    own = hashes[first[i] : first[i + 1]]
                    for item in sorted(items.candidates(own, hits[cuts[i] : cuts[i + 1]] - first[i])):
                        share, at = _share(items.sets[item], own)
                        if share >= threshold:
                            for held, x in zip(out, (ids[w.row + i], items.keys[item], share, at)):
                                held.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(out, schema)], schema=schema)

    return run


def search(
    docs: DataFrame, items: DataFrame, key: str, text: str = "text", k: int = 5, threshold: float = 0.8,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(doc_id, item, containment, at_word) of the documents that contain `threshold` of an item's shingles.

    docs has doc_id and text; key is an integer column of items. Words are lower-cased (A-Z) and split at white space
    and ASCII punctuation. Edge cases: null and empty texts, on either side, match nothing; an item of fewer than k
    words matches a document that holds the sequence; repeated rows of either side give repeated matches; extra columns
    are ignored; with an empty table on either side the result is empty.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item long, containment double, at_word long"
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = spark.createDataFrame([], schema)
    for block in item_blocks(items.withColumn(key, F.col(key).cast("long")), key, text, k, block_bytes):
        out = out.union(slim.mapInArrow(_searched(spark.sparkContext.broadcast(block), k, threshold), schema))
    return out


def without(docs: DataFrame, items: DataFrame, key: str, **options) -> DataFrame:
    """docs without those that contain an item; rows whose doc_id is null stay."""
    found = cut(search(docs, items, key, **options).select("doc_id").dropna().distinct())
    few = found.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return docs.join(F.broadcast(found) if few else found, "doc_id", "left_anti").select(*docs.columns)
