"""LM scoring by cross-entropy difference.

Two interpolated bigram models, of the target documents (labelled quality 1) and of all documents
as background, share one vocabulary and one way of smoothing. A document's score is the mean over
its tokens of loss under the target model minus loss under the background model: low is like the
target.

Both models hold every word and every bigram of the corpus with its two counts, however many there
are; nothing of them is gathered on the driver or in a task. Documents are dealt to shards by a hash
of their id and text. A shard asks for its distinct words and bigrams, once each, with its own
counts: sorted keys, packed by key range. The task that holds a range of keys adds up what the
shards have and tells each shard what the others have, in the order in which it asked, which a shard
finds again as it depends on its documents alone. The shard then scores its documents. A frequent
word is one entry a shard, so no key is hot; the texts are exchanged once and read twice.

Edge cases: a document without words, null or empty, has n_tokens 0 and null losses; documents
without labels are background only; repeated labels count as target if any is 1; repeated rows
count each time; if nothing is labelled target, both models are the background's and scores are 0;
extra columns are ignored, whatever they are called; an empty table gives an empty result. A very
long text is part of one shard, whole; rows that agree in id and text share a shard.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import Words, windows, words
from .text import SPACE

#: Weight of the bigram estimate, and add-constant of the unigrams.
BIGRAM_WEIGHT, ADD = 0.7, 0.5
#: Tokens of a shard and of a range of keys, about.
PART = 1 << 20
#: Up to this number, the ids of target documents go to every executor; beyond, they are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Distinct words that a task holds, about, before it hands them on.
HELD = 1 << 20


def _followed(w: Words) -> np.ndarray:
    """Positions of the tokens that another of the same row follows."""
    inside = np.ones(len(w.hashes), bool)
    inside[w.first[1:][np.diff(w.first) > 0] - 1] = False
    return np.flatnonzero(inside)


def _owners(w: Words) -> np.ndarray:
    return np.repeat(np.arange(len(w)), np.diff(w.first))


def _flags(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(bool)


def _tally(keys: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the place of each key among them, and their (target, all) counts."""
    found, which, n = np.unique(keys, return_inverse=True, return_counts=True)
    return found, which.astype(np.int32), np.bincount(which, weights=target, minlength=len(found)).astype(np.int64), n


def _vocabulary(batches):
    """(key, n, n_target): the distinct words of a task, a bounded number at a time, one of them with the counts of all tokens."""
    known, fresh, size, n, n_target = np.zeros(0, np.uint64), [], 0, 0, 0

    def rows():
        counts = np.zeros((2, len(known)), np.int64)
        counts[:, :1] = [[n], [n_target]]
        return pa.RecordBatch.from_arrays([pa.array(known.view(np.int64)), *map(pa.array, counts)], names=["key", "n", "n_target"])

    for batch in batches:
        target = _flags(batch.column("target"))
        for w in words(batch.column("text")):
            found = np.unique(w.hashes)
            fresh.append(found)
            size, n = size + len(found), n + len(w.hashes)
            n_target += int(np.diff(w.first)[target[w.row : w.row + len(w)]].sum())
            if size > HELD // 2:
                known, fresh, size = np.unique(np.concatenate([known, *fresh])), [], 0
                if len(known) > HELD:
                    yield rows()
                    known, n, n_target = known[:0], 0, 0
    known = np.unique(np.concatenate([known, *fresh]))
    yield rows()


class Shard:
    """The words and bigrams of a shard's rows: distinct keys of each kind, and the tokens as places among them."""

    def __init__(self, table: pa.Table):
        text, target = table.column("text").combine_chunks(), _flags(table.column("target").combine_chunks())
        singles, pairs, owners, ahead, self.counts = [], [], [], [], np.zeros(len(text), np.int64)
        at = 0
        for w in words(text):
            follow = _followed(w)
            singles.append(w.hashes)
            pairs.append(windows(w.hashes, 2)[follow])
            owners.append((w.row + _owners(w)).astype(np.int32))
            ahead.append((at + follow).astype(np.int32))
            at += len(w.hashes)
            self.counts[w.row : w.row + len(w)] = np.diff(w.first)

        def join(parts, kind):
            whole = np.concatenate([np.zeros(0, kind), *parts])
            parts.clear()
            return whole

        self.owner, self.ahead = join(owners, np.int32), join(ahead, np.int32)
        mine = target[self.owner]
        self.words = _tally(join(singles, np.uint64), mine)
        self.bigrams = _tally(join(pairs, np.uint64), mine[self.ahead])

    def kinds(self):
        return (0, self.words), (1, self.bigrams)


def _ranges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each range of keys begins among keys (sorted), and their end."""
    bounds = np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]])


def _planes(keys: np.ndarray) -> bytes:
    """Bytes of sorted keys, those of one place together: the first places compress."""
    return np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8).T).tobytes()


def _packed(counts: np.ndarray) -> bytes:
    """Counts as 64-bit numbers, most of them small, compressed."""
    return pa.compress(counts.astype(np.int64).tobytes(), "zstd", asbytes=True)


def _counts(packed: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(packed, 8 * n, "zstd", asbytes=True), np.int64)


def _keys(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


ASKED = "shard int, kind int, bucket int, keys binary, n binary, n_target binary"
TOLD = "shard int, kind int, bucket int, n binary, n_target binary"


def _ask(buckets: int):
    def run(key, table):
        out = [[], [], [], [], [], []]
        for kind, (keys, _, n_target, n) in Shard(table).kinds():
            cuts = _ranges(keys, buckets)
            for i in np.flatnonzero(np.diff(cuts)):
                a, b = cuts[i], cuts[i + 1]
                row = (key[0].as_py(), kind, int(i), _planes(keys[a:b]), _packed(n[a:b]), _packed(n_target[a:b]))
                for column, x in zip(out, row):
                    column.append(x)
        schema = pa.schema([(x, pa.int32()) for x in ("shard", "kind", "bucket")] + [(x, pa.binary()) for x in ("keys", "n", "n_target")])
        return pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(out, schema)], schema=schema)

    return run


def _tell(batches):
    """What the other shards have of each shard's keys, from rows sorted by kind and bucket."""
    schema = pa.schema([(x, pa.int32()) for x in ("shard", "kind", "bucket")] + [(x, pa.binary()) for x in ("n", "n_target")])
    now, held = None, []

    def close():
        keys = np.concatenate([x[1] for x in held])
        which = np.unique(keys, return_inverse=True)[1]
        out, cuts = [[], [], [], [], []], np.cumsum([len(x[1]) for x in held])[:-1]
        rest = []
        for i in (2, 3):
            own = np.concatenate([x[i] for x in held])
            total = np.bincount(which, weights=own).astype(np.int64)  # exact below 2^53
            rest.append(np.split(total[which] - own, cuts))
        for (shard, *_), n, n_target in zip(held, *rest):
            for column, x in zip(out, (shard, *now, _packed(n), _packed(n_target))):
                column.append(x)
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(out, schema)], schema=schema)

    for batch in batches:
        for shard, kind, bucket, keys, n, n_target in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if (kind, bucket) != now:
                if held:
                    yield close()
                now, held = (kind, bucket), []
            held.append((shard, _keys(keys), *(_counts(x, len(keys) // 8) for x in (n, n_target))))
    if held:
        yield close()


def _answer(buckets: int, total: np.ndarray, size: int):
    """The rows of a shard with their losses; total has the counts of all tokens, size is that of the vocabulary."""

    def alone(n: np.ndarray) -> np.ndarray:
        return (n + ADD) / (total + ADD * size)

    def run(key, table, told):
        shard, counts = Shard(table), []
        rows = list(zip(*(told.column(x).to_pylist() for x in ("kind", "bucket", "n", "n_target"))))
        for kind, (keys, which, n_target, n) in shard.kinds():
            every, cuts = np.stack([n_target, n], axis=1).astype(np.int64), _ranges(keys, buckets)
            for of, bucket, more, more_target in rows:
                if of == kind:
                    here = every[cuts[bucket] : cuts[bucket + 1]]
                    here += np.stack([_counts(x, len(here)) for x in (more_target, more)], axis=1)
            counts.append(every[which])
        single, pairs = counts
        ahead, begins = shard.ahead, np.ones(len(single), bool)
        begins[ahead + 1] = False
        loss = np.empty(single.shape)
        loss[begins] = -np.log(alone(single[begins]))
        both = BIGRAM_WEIGHT * pairs / np.maximum(single[ahead], 1) + (1 - BIGRAM_WEIGHT) * alone(single[ahead + 1])
        loss[ahead + 1] = -np.log(both)
        means = [np.bincount(shard.owner, weights=loss[:, i], minlength=len(shard.counts)) / np.maximum(shard.counts, 1) for i in (0, 1)]
        ids = table.column("doc_id").combine_chunks()
        names = ["doc_id", "n_tokens", "target_loss", "background_loss"]
        return pa.Table.from_arrays([ids, pa.array(shard.counts), *map(pa.array, means)], names=names)

    return run


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text) with `target`: whether a label of quality 1 is theirs."""
    good = labels.filter("quality = 1").select(F.col("doc_id").cast("long")).dropna().distinct()
    good = good.withColumn("_good", F.lit(True))
    few = good.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.join(F.broadcast(good) if few else good, "doc_id", "left").select(
        "doc_id", "text", F.coalesce("_good", F.lit(False)).alias("target")
    )


def score(docs: DataFrame, labels: DataFrame, part: int = PART) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score), one row per document.

    part bounds what a task holds, not what the models hold.
    """
    docs = labelled(docs, labels)
    counts = docs.mapInArrow(_vocabulary, "key long, n long, n_target long").groupBy("key")
    counts = counts.agg(F.sum("n").alias("n"), F.sum("n_target").alias("n_target"))
    size, n, n_target = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("n_target"), F.lit(0))).first()
    if not n_target:
        docs, n_target = docs.withColumn("target", F.lit(True)), n
    parts = n // part + 1
    said = F.coalesce(F.col("text").rlike(f"[^{SPACE}]"), F.lit(False))
    dealt = docs.filter(said).withColumn("shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int"))
    asked = dealt.groupBy("shard").applyInArrow(_ask(parts), ASKED)
    told = asked.repartition("kind", "bucket").sortWithinPartitions("kind", "bucket").mapInArrow(_tell, TOLD)
    answer = _answer(parts, np.array([n_target, n]), size + 1)
    out = dealt.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(
        answer, "doc_id long, n_tokens long, target_loss double, background_loss double"
    )
    none = F.lit(None).cast("double")
    silent = docs.filter(~said).select("doc_id", F.lit(0).cast("long").alias("n_tokens"), none.alias("target_loss"), none.alias("background_loss"))
    return out.union(silent).withColumn("score", F.col("target_loss") - F.col("background_loss"))
