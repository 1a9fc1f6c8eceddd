"""N-gram Jaccard join: groups of documents whose word shingle sets are alike.

1. Every document's shingle set gets a fingerprint; documents with equal sets form one class.
2. One global order of shingles: those found in many documents last, by their counts, the others by hash. Two sets
   with Jaccard similarity t or more share an entry among the first n - ceil(t n) + 1 of each, so
   only classes that share such an entry are compared. The entries travel as packed arrays, a row
   for each batch of documents and bucket of shingles; a task that holds a bucket keeps those of
   two classes or more, and equal groups of classes once. At the first shared entry of a pair, what
   follows in either set bounds the overlap; pairs for which it is too little at an entry are not
   compared for that entry's sake. As rare shingles come first, an edited copy of a common text has
   used up its allowance before its common shingles begin.
3. The class of a group that has the entry earliest, so the one with the fewest rare shingles, is
   compared with the others. If classes of the group are then in different components, up to 16, then
   256, then ... of them are compared with all others unless a component already holds both, until
   each group's remaining classes lie in one component. No pair is skipped that could join two
   components, and a group of near copies costs a number of comparisons that grows with its size.
4. A leader's candidates are walked as a prefix tree of sets in the global order: candidates in
   lexicographic order share the overlap counted along their common path, and a path ends when
   the entries that remain cannot reach the overlap that the threshold needs. The tree is walked
   in two parts: its top, the rarer shingles in the first quarter of the hash range at half their
   bits, rules out nearly all that are not alike; only the others send their whole sets.
5. Components of the verified links, by alternating stars.

Sets are compared by 63-bit shingle hashes; a collision within a pair has a chance below 1e-12.

Edge cases: null, empty and blank texts have an empty set and link with nothing (their component
is their own id); a text shorter than a shingle has one shingle, the whole sequence; repeated rows
and rows that share a doc_id have equal components if their sets are equal; a null doc_id gets the
least id of its component, or null; extra columns are ignored, whatever they are called; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import links
from .frequent import most_frequent
from .recovery import cut, drop_written, written
from .shingles import mix, shingles, words

#: Shingles found in more documents than this come last in the global order, at most LATE of them.
COMMON, LATE = 8, 1 << 21
#: Leaders of a group in its second round; each further round has as many times more.
LEADERS = 16
#: Candidates in one prefix tree.
TREE = 512
#: Order keys: one bit for late shingles, before their places, or 63 of the hash. The tree's top ends at TOP and leaves out LOW bits.
LAST, TOP, LOW = np.uint64(1 << 63), np.uint64(1 << 61), np.uint64(29)
#: Entries that one task takes at once, about.
BUCKET = 1 << 19
#: Keys up to this number are broadcast to filter a scan; beyond it, a shuffle join does the same.
BROADCAST_KEYS = 1_000_000
#: Rows whose entries a task holds at once.
ROWS = 2048
#: Classes that a task remembers to have sent; what is sent again is only redundant.
SEEN = 50_000


def _sets(batches: Iterator[pa.RecordBatch], k: int):
    """(batch, row, its distinct shingle hashes in increasing order) for every row."""
    for batch in batches:
        for w in words(batch.column("text")):
            hashes, first = shingles(w, k)
            hashes = hashes >> np.uint64(1)
            for i in range(len(w)):
                yield batch, w.row + i, np.unique(hashes[first[i] : first[i + 1]])


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _prefix(n: int, top: int, bottom: int) -> int:
    return n + (-top * n) // bottom + 1 if n else 0


def _class_of(own: np.ndarray, seed: int) -> tuple[int, int]:
    x = mix(own ^ mix(np.uint64([seed]))[0])
    return int(x.sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(mix(x + np.uint64(1))).view(np.int64))


def _emit(columns: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)


def _fingerprints(k: int, seed: int):
    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("c", pa.int64()), ("c2", pa.int64())])
        for batch in batches:
            ids, out = batch.column("doc_id").to_pylist(), [[], [], [], []]
            for _, row, own in _sets([batch], k):
                for held, x in zip(out, (ids[row], len(own), *_class_of(own, seed))):
                    held.append(x)
            yield _emit(out, schema)

    return run


def _counted(k: int, top: int, bottom: int, seed: int, late=None):
    """Shingles in the first places of the hash order, half as many again as a prefix has, counted by class within a batch.

    With late, all shingles of those documents of whose first ones a third or more are late: in the global order they
    reach further.
    """

    def run(batches):
        seen: set[int] = set()
        for batch in _split(batches):
            held = [np.zeros(0, np.uint64)]
            for _, _, own in _sets([batch], k):
                low = own[: 3 * _prefix(len(own), top, bottom) // 2]
                if late is not None and 3 * _member(late.value, low).sum() < max(len(low), 1):
                    continue
                c, _ = _class_of(own, seed)
                if c in seen:
                    continue
                if len(seen) < SEEN:
                    seen.add(c)
                held.append(low if late is None else own)
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(counts)], names=["token", "n"])

    return run


def _member(known: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Whether entries of own are in known (sorted)."""
    if not len(known):
        return np.zeros(len(own), bool)
    return known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own


def _common(docs: DataFrame, k: int, top: int, bottom: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The late shingles, sorted, and the place of each among them, the most common last."""
    sc, found = docs.sparkSession.sparkContext, None
    for _ in range(2):
        late = found and sc.broadcast(np.sort(found.select("token").toPandas()["token"].to_numpy(np.int64).view(np.uint64)))
        counts = docs.mapInArrow(_counted(k, top, bottom, seed, late), "token long, n long")
        counts = cut(counts.groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") > COMMON))
        if found is not None:
            counts, last = cut(counts.union(found).groupBy("token").agg(F.max("n").alias("n"))), (counts, found)
            drop_written(*last)
        found = most_frequent(counts, LATE)
    rows = found.toPandas()
    drop_written(counts)
    tokens, n = rows["token"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64)
    rank = np.empty(len(tokens), np.uint64)
    rank[np.lexsort((tokens, n))] = np.arange(len(tokens), dtype=np.uint64)
    order = np.argsort(tokens)
    return tokens[order], rank[order]


def _ordered(own: np.ndarray, late: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Order keys of own (increasing), in the global order."""
    known, rank = late
    last = _member(known, own)
    return np.concatenate([own[~last], np.sort(rank[np.searchsorted(known, own[last])] | LAST)])


def _entries(k: int, top: int, bottom: int, seed: int, late, buckets: int):
    """Packed prefix entries: a row per batch, bucket of shingles and kind, with arrays of keys, classes, set sizes and places in the sets."""

    def run(batches):
        seen: set[int] = set()
        schema = pa.schema([("bucket", pa.int32()), ("late", pa.bool_()), *((x, pa.binary()) for x in ("keys", "classes", "sizes", "places"))])
        for batch in _split(batches):
            keys, found = [np.zeros(0, np.uint64)], []
            for _, _, own in _sets([batch], k):
                c, _ = _class_of(own, seed)
                if c in seen or not len(own):
                    continue
                if len(seen) < SEEN:
                    seen.add(c)
                keys.append(_ordered(own, late.value)[: _prefix(len(own), top, bottom)])
                found.append((c, len(own), len(keys[-1])))
            keys = np.concatenate(keys)
            classes, sizes, lengths = (np.array(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
            at = (np.arange(len(keys)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
            classes, sizes = np.repeat(classes, lengths), np.repeat(sizes, lengths).astype(np.int32)
            last = keys >= LAST
            place = (mix(keys) % np.uint64(buckets)).astype(np.int64)
            place[last] = buckets + mix(classes[last].view(np.uint64)).astype(np.int64) % buckets
            order = np.argsort(place, kind="stable")
            cuts = np.flatnonzero(np.diff(place[order], prepend=-1, append=-1))
            out = [[], [], [], [], [], []]
            for a, b in zip(cuts[:-1], cuts[1:]) if len(order) else ():
                own, kind = order[a:b], int(place[order[a]])
                for held, x in zip(out, (kind % buckets, kind >= buckets, keys[own].tobytes(), classes[own].tobytes(), sizes[own].tobytes(), at[own].tobytes())):
                    held.append(x)
            yield _emit(out, schema)

    return run


def _alike(n, at, n2, at2, top: int, bottom: int):
    """Whether sets of these sizes, whose first shared entry has these places, can be similar enough; arrays or Columns."""
    need = top * (n + n2)
    return ((n - at) * (top + bottom) >= need) & ((n2 - at2) * (top + bottom) >= need)


FOUND = "kind int, h long, c long, n long, at long"
#: Kinds of rows: a pair of classes to compare (h, c); a class c of the group h whose leader has its pairs; one of a late shingle h.
PAIR, MEMBER, LOOSE = 0, 1, 2


def _distinct(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of one of every different (a, b), ordered by both."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    fresh = np.ones(len(a), bool)
    fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order[fresh]


def groups_of(keys: np.ndarray, classes: np.ndarray, sizes: np.ndarray, places: np.ndarray, top: int, bottom: int):
    """(pairs to compare, (group, class, size, place) of the classes that may have to be compared further) of whole buckets."""
    some = _distinct(keys, classes)
    keys, classes, sizes, places = keys[some], classes[some], sizes[some].astype(np.int64), places[some].astype(np.int64)
    order = np.lexsort((places, keys))
    keys, classes, sizes, places = keys[order], classes[order], sizes[order], places[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    m = np.diff(np.append(first, len(keys)))
    first, m = first[m > 1], m[m > 1]
    at = np.repeat(first - np.cumsum(m) + m, m) + np.arange(m.sum())
    begins = np.cumsum(m) - m
    named = np.add.reduceat(mix(classes[at].view(np.uint64)), begins) if len(begins) else np.zeros(0, np.uint64)
    once = np.unique(named, return_index=True)[1]  # of equal groups the first in the global order, where places are least
    first, m, named = first[once], m[once], named[once].view(np.int64)
    rest = np.repeat(first + 1 - np.cumsum(m - 1) + m - 1, m - 1) + np.arange((m - 1).sum())
    leader = np.repeat(first, m - 1)
    near = _alike(sizes[leader], places[leader], sizes[rest], places[rest], top, bottom)
    pairs = np.sort(np.stack([classes[leader[near]], classes[rest[near]]]), axis=0)
    pairs = pairs[:, _distinct(*pairs)]
    more = np.repeat(m > 2, m - 1)
    return pairs, (np.repeat(named, m - 1)[more], *(x[rest[more]] for x in (classes, sizes, places)))


def _shared(top: int, bottom: int):
    """Rows sorted by bucket: what the entries of each bucket, and of late shingles, give."""
    names = [x.split()[0] for x in FOUND.split(", ")]

    def rows(kind: int, h, c, n, at):
        columns = [np.full(len(h), kind, np.int32), np.asarray(h).view(np.int64), c, np.asarray(n, np.int64), np.asarray(at, np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=names)

    def close(held):
        if held:
            pairs, members = groups_of(*(np.concatenate(x) for x in zip(*held)), top, bottom)
            none = np.zeros(pairs.shape[1])
            yield rows(PAIR, pairs[0], pairs[1], none, none)
            yield rows(MEMBER, *members)

    def run(batches):
        now, held = None, []
        for batch in batches:
            for bucket, late, *packed in zip(*(batch.column(i).to_pylist() for i in range(6))):
                keys, classes, sizes, places = (np.frombuffer(x, t) for x, t in zip(packed, (np.uint64, np.int64, np.int32, np.int32)))
                if late:
                    yield rows(LOOSE, keys, classes, sizes, places)
                    continue
                if bucket != now:
                    yield from close(held)
                    now, held = bucket, []
                held.append((keys, classes, sizes, places))
        yield from close(held)

    return run


def _ordered_sets(k: int, seed: int, late, whole: bool):
    """Sets in the global order: whole, or the top of the tree at half the bits."""

    def run(batches):
        schema = pa.schema([("c", pa.int64()), ("n", pa.int64()), ("entries", pa.binary())])
        seen: set[int] = set()
        for batch in batches:
            out = [[], [], []]
            for _, _, own in _sets([batch], k):
                c, keys = _class_of(own, seed)[0], _ordered(own, late.value)
                if c in seen:
                    continue
                if len(seen) < SEEN:
                    seen.add(c)
                entries = keys if whole else (keys[: np.searchsorted(keys, TOP)] >> LOW).astype(np.uint32)
                for held, x in zip(out, (c, len(own), entries.tobytes())):
                    held.append(x)
            yield _emit(out, schema)

    return run


def walk_tree(
    leader: np.ndarray, size: int, candidates: list[tuple[int, int, np.ndarray]], top: int, bottom: int
) -> list[int]:
    """Keys of the candidates (key, size, path) that may have a Jaccard similarity of top / bottom or more with leader.

    leader and paths are sets in increasing order, or both cut at one value; size is that of the whole
    set. Whole sets give an exact answer, cut ones an answer without misses. Candidates in
    lexicographic order continue the path of the one before from their common prefix, with the
    overlap counted so far, and stop once the entries left cannot lift it to what both sizes need.
    """
    found = []
    last, total = np.zeros(0, leader.dtype), np.zeros(1, np.int64)
    for key, n, path in sorted(candidates, key=lambda x: x[2].astype(">u8").tobytes()):
        shared = min(len(last), len(path), len(total) - 1)
        apart = np.flatnonzero(last[:shared] != path[:shared])
        depth = int(apart[0]) if len(apart) else shared
        total = total[: depth + 1]
        need = -(-top * (size + n) // (top + bottom))
        while depth < len(path) and len(leader) and total[-1] + n - depth >= need:
            step = path[depth : depth + 256]
            at = np.minimum(np.searchsorted(leader, step), len(leader) - 1)
            total = np.concatenate([total, total[-1] + np.cumsum(leader[at] == step)])
            depth += len(step)
        if (depth == len(path) or not len(leader)) and total[-1] + min(size - len(leader), n - len(path)) >= need:
            found.append(key)
        last = path
    return found


def _walked(top: int, bottom: int, kind):
    """Rows sorted by (leader, part, role): first the leader's own set, then its candidates'."""

    def run(batches):
        schema = pa.schema([("leader", pa.int64()), ("c", pa.int64())])
        now, own, size, held = None, None, 0, []
        out: list[list] = [[], []]

        def close():
            for c in walk_tree(own, size, held, top, bottom) if held else ():
                out[0].append(now[0])
                out[1].append(c)

        for batch in batches:
            cols = [batch.column(x).to_pylist() for x in ("leader", "part", "c", "n", "entries")]
            for leader, part, c, n, entries in zip(*cols):
                path = np.frombuffer(entries, kind)
                if (leader, part) != now:
                    close()
                    now, own, size, held = (leader, part), path, n, []
                else:
                    held.append((c, n, path))
            yield _emit(out, schema)
            out = [[], []]
        close()
        yield _emit(out, schema)

    return run


def _walk(pairs: DataFrame, sets: DataFrame, top: int, bottom: int, kind) -> DataFrame:
    """The pairs (leader, c) that the tree walk over sets (c, n, entries) doesn't rule out."""
    parts = pairs.groupBy("leader").agg(F.ceil(F.count("*") / TREE).alias("parts"))
    dealt = pairs.join(parts, "leader").withColumn("part", F.pmod(F.xxhash64("c"), F.col("parts")))
    members = dealt.join(sets, "c").select("leader", "part", F.lit(1).alias("role"), "c", "n", "entries")
    heads = dealt.select("leader", "part").distinct()
    heads = heads.join(sets.withColumnRenamed("c", "leader"), "leader").select(
        "leader", "part", F.lit(0).alias("role"), F.col("leader").alias("c"), "n", "entries"
    )
    rows = heads.union(members).repartition("leader", "part").sortWithinPartitions("leader", "part", "role", "c")
    return written(rows.mapInArrow(_walked(top, bottom, kind), "leader long, c long"), "walked")


def _only(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows of df whose key is in keys; keys go to every executor only up to BROADCAST_KEYS of them."""
    few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return df.join(F.broadcast(keys) if few else keys, on, "left_semi")


def _sets_of(docs: DataFrame, slim: DataFrame, pairs: DataFrame, build) -> DataFrame:
    """(c, n, entries) of the classes in pairs, each from its documents of least id."""
    named = pairs.select(F.col("leader").alias("c")).union(pairs.select("c")).distinct()
    ids = written(slim.join(named, "c").groupBy("c").agg(F.min("doc_id").alias("doc_id")), "ids")
    kinds = "c long, n long, entries binary"
    sets = _only(docs, ids.select("doc_id").dropna(), "doc_id").mapInArrow(build, kinds)
    nameless = ids.filter("doc_id is null").select("c")
    if not nameless.isEmpty():
        texts = docs.filter("doc_id is null").dropDuplicates(["text"])
        sets = sets.union(_only(texts.mapInArrow(build, kinds), nameless, "c").dropDuplicates(["c"]))
    sets = written(sets, "sets")
    drop_written(ids)
    return sets


def _linked(docs: DataFrame, slim: DataFrame, pairs: DataFrame, k: int, seed: int, late, top: int, bottom: int) -> DataFrame:
    """The pairs (leader, c) that are similar, as edges."""
    pairs = written(pairs, "pairs")
    tops = _sets_of(docs, slim, pairs, _ordered_sets(k, seed, late, False))
    likely = _walk(pairs, tops, top, bottom, np.uint32)
    drop_written(pairs, tops)
    sets = _sets_of(docs, slim, likely, _ordered_sets(k, seed, late, True))
    edges = _walk(likely, sets, top, bottom, np.uint64)
    drop_written(likely, sets)
    return edges.select(F.col("leader").alias("u"), F.col("c").alias("v"))


def _relabelled(labels: DataFrame | None, found: DataFrame) -> DataFrame:
    """(c, root) of all linked classes, with the links found between classes joined in."""
    if labels is None:
        return cut(links.components(found).select(F.col("node").alias("c"), "root"))
    root = lambda x: labels.select(F.col("c").alias(x), F.col("root").alias(f"{x}_root"))
    found = found.join(root("u"), "u", "left").join(root("v"), "v", "left").select(
        F.coalesce("u_root", "u").alias("u"), F.coalesce("v_root", "v").alias("v")
    )
    roots = links.components(found)
    moved = labels.join(roots.withColumnRenamed("root", "top"), labels["root"] == roots["node"], "left")
    moved = moved.select("c", F.coalesce("top", "root").alias("root"))
    fresh = roots.select(F.col("node").alias("c"), "root").join(labels.select("c"), "c", "left_anti")
    return cut(moved.union(fresh))


def _rooted(docs: DataFrame, k: int, top: int, bottom: int) -> tuple[DataFrame, int]:
    """(doc_id, n, c, root) of every document, with one root for each group of linked documents, and the seed of c."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for seed in range(99):
        slim = written(docs.mapInArrow(_fingerprints(k, seed), "doc_id long, n long, c long, c2 long"), "slim")
        clash = slim.groupBy("c").agg((F.min("c2") < F.max("c2")).alias("clash"), F.count("*")).filter("clash")
        if clash.isEmpty():
            break
        drop_written(slim)
    late = spark.sparkContext.broadcast(_common(docs, k, top, bottom, seed))
    many = slim.groupBy("c").agg(F.first("n").alias("n")).agg(F.sum(F.col("n") * (bottom - top) / bottom + 1)).first()[0]
    buckets = int((many or 0) // BUCKET) + 1
    found = docs.mapInArrow(
        _entries(k, top, bottom, seed, late, buckets), "bucket int, late boolean, keys binary, classes binary, sizes binary, places binary"
    )
    found = found.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    found = written(found.mapInArrow(_shared(top, bottom), FOUND), "found")
    pairs = found.filter(F.col("kind") == PAIR).select(F.col("h").alias("leader"), "c")
    lead = [F.col("a.c").alias("leader"), F.col("a.n").alias("n2"), F.col("a.at").alias("at2")]
    loose = found.filter(F.col("kind") == LOOSE).select("h", "c", "n", "at").distinct()
    leaders = loose.groupBy("h").agg(F.min(F.struct("at", "c", "n")).alias("a"), F.min("c").alias("low"), F.max("c").alias("high"))
    leaders = written(leaders.filter("low < high").select("h", *lead), "leaders")
    loose = written(loose.join(leaders, "h").filter("c <> leader"), "loose")
    near = _alike(F.col("n"), F.col("at"), F.col("n2"), F.col("at2"), top, bottom)
    pair = [F.least("leader", "c").alias("leader"), F.greatest("leader", "c").alias("c")]
    pairs = pairs.union(loose.filter(near).select(*pair)).distinct()
    labels = _relabelled(None, _linked(docs, slim, pairs, k, seed, late, top, bottom))
    group = written(found.filter(F.col("kind") == MEMBER).select("h", "c", "n", "at").union(loose.select("h", "c", "n", "at")), "group")
    drop_written(found, leaders, loose)
    size = LEADERS
    while True:
        held = group.join(labels, "c", "left").select("h", "c", "n", "at", F.coalesce("root", "c").alias("part"))
        stats = held.groupBy("h", "part").agg(F.count("*").alias("m")).groupBy("h").agg(
            F.max(F.struct("m", "part"))["part"].alias("most"), F.count("*").alias("parts"), F.sum("m").alias("all")
        )
        held = written(held.join(stats.filter("parts > 1").drop("parts"), "h"), "held")
        salt = F.when(F.col("all") <= size, F.col("c")).otherwise(F.pmod(F.xxhash64("c"), F.lit(size)))
        leaders = held.filter(F.col("part") != F.col("most")).groupBy("h", salt.alias("salt"))
        leaders = leaders.agg(F.min(F.struct("at", "c", "n", "part")).alias("a"))
        leaders = written(leaders.select("h", *lead, F.col("a.part").alias("part2")), "leaders")
        drop_written(group)
        if leaders.isEmpty():
            break
        pairs = held.join(leaders, "h").filter(near & (F.col("part") != F.col("part2"))).select(*pair).distinct()
        last, labels = labels, _relabelled(labels, _linked(docs, slim, pairs, k, seed, late, top, bottom))
        group = written(
            held.select("h", "c", "n", "at").join(leaders.select("h", F.col("leader").alias("c")), ["h", "c"], "left_anti"), "group"
        )
        drop_written(last, held, leaders)
        size *= LEADERS
    drop_written(held, leaders)
    out = cut(slim.join(labels, "c", "left").select("doc_id", "n", "c", F.coalesce("root", "c").alias("root")))
    drop_written(slim, labels)
    return out, seed


def components(docs: DataFrame, k: int = 4, top: int = 85, bottom: int = 100) -> DataFrame:
    """One row per document: doc_id, n_shingles and component_id, the least doc_id reachable by links.

    Documents link when bottom * |A and B| >= top * |A or B| for their sets of k-word shingles.
    """
    rooted, _ = _rooted(docs, k, top, bottom)
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    linked = rooted.filter("n > 0").join(least, "root").select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id"
    )
    alone = rooted.filter("n = 0").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")
    )
    return linked.union(alone)


def _classed(k: int, seed: int):
    """Rows with the class of their text."""

    def run(batches):
        for batch in batches:
            classes = [0] * batch.num_rows
            for _, row, own in _sets([batch], k):
                classes[row] = _class_of(own, seed)[0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(classes, pa.int64())], names=[*batch.schema.names, "_class"])

    return run


def keep_one(docs: DataFrame, k: int = 4, top: int = 85, bottom: int = 100) -> DataFrame:
    """docs with one document, that of the least id, of each group of linked documents.

    An id decides which row stays, never what is a duplicate: unlinked rows that share a doc_id all stay, and of equal
    ones one. Rows whose doc_id is null are compared with one another only; those without words all stay.
    """
    rooted, seed = _rooted(docs, k, top, bottom)
    least = rooted.filter("n > 0").groupBy("root", F.col("doc_id").isNull().alias("nameless"))
    kept = least.agg(F.min(F.struct("doc_id", "c")).alias("row")).select("row.*")
    kept = cut(kept.union(rooted.filter("n = 0 and doc_id is not null").select("doc_id", "c").distinct()))
    shared = cut(rooted.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1").select("doc_id"))
    named = kept.filter("doc_id is not null")
    classed = lambda df: df.mapInArrow(_classed(k, seed), df.select("*", F.lit(0).cast("long").alias("_class")).schema)
    if shared.isEmpty():
        out = _only(docs, named.select("doc_id"), "doc_id")
    else:
        out = _only(docs, named.join(shared, "doc_id", "left_anti").select("doc_id"), "doc_id")
        again = classed(_only(docs, shared, "doc_id")).join(named.withColumnRenamed("c", "_class"), ["doc_id", "_class"], "left_semi")
        out = out.unionByName(again.dropDuplicates(["doc_id", "_class"]).drop("_class"))
    if rooted.filter("doc_id is null").isEmpty():
        return out.select(*docs.columns)
    nameless = classed(docs.filter("doc_id is null"))
    some = _only(nameless, kept.filter("doc_id is null").select(F.col("c").alias("_class")), "_class").dropDuplicates(["_class"])
    empty = nameless.join(F.broadcast(rooted.filter("n = 0").select(F.col("c").alias("_class")).distinct()), "_class", "left_semi")
    return out.unionByName(some.unionByName(empty).drop("_class")).select(*docs.columns)
