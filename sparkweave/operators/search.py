"""Vector, full-text and hybrid search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: BM25 parameters and the rank constant of reciprocal rank fusion.
K1, B, RRF_K = 1.2, 0.75, 60


def _pairs(a: Column, b: Column, f) -> Column:
    return F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda acc, x: acc + x)


def _d(x: Column) -> Column:
    return x.cast("double")


def distance(a: Column, b: Column, metric: str) -> Column:
    """l2 (squared), cosine, inner_product (negative), manhattan, chebyshev, hamming, jaccard or pearson."""
    dot = lambda x, y: _pairs(x, y, lambda p, q: _d(p) * _d(q))
    if metric == "l2":
        return _pairs(a, b, lambda p, q: (_d(p) - _d(q)) * (_d(p) - _d(q)))
    if metric == "inner_product":
        return -dot(a, b)
    if metric == "cosine":
        norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
        return F.when(norm == 0, F.lit(1.0)).otherwise(1 - dot(a, b) / norm)
    if metric == "manhattan":
        return _pairs(a, b, lambda p, q: F.abs(_d(p) - _d(q)))
    if metric == "chebyshev":
        return F.array_max(F.zip_with(a, b, lambda p, q: F.abs(_d(p) - _d(q))))
    if metric == "hamming":
        return _pairs(a, b, lambda p, q: F.when((p != 0) != (q != 0), 1.0).otherwise(0.0))
    if metric == "jaccard":
        both = _pairs(a, b, lambda p, q: F.when((p != 0) & (q != 0), 1.0).otherwise(0.0))
        any_ = _pairs(a, b, lambda p, q: F.when((p != 0) | (q != 0), 1.0).otherwise(0.0))
        return F.when(any_ == 0, F.lit(0.0)).otherwise(1 - both / any_)
    if metric == "pearson":
        mean = lambda x: F.aggregate(x, F.lit(0.0), lambda acc, v: acc + _d(v)) / F.size(x)
        shift = lambda x: F.transform(x, lambda v: _d(v) - mean(x))
        return distance(shift(a), shift(b), "cosine")
    raise ValueError(metric)


def top_k(df: DataFrame, vector: str, query: list[float], k: int, key: str, metric: str = "l2", where: Column | None = None) -> DataFrame:
    """Exact k nearest: filters apply before the ranking."""
    df = df if where is None else df.filter(where)
    d = distance(F.col(vector), F.array(*[F.lit(float(x)) for x in query]), metric)
    return df.withColumn("distance", d).orderBy("distance", key).limit(k)


def truncated_top_k(df: DataFrame, vector: str, query: list[float], k: int, key: str, dims: int, oversample: int = 4) -> DataFrame:
    """k nearest by a prefix of the dimensions, then rescored by all of them."""
    near = top_k(df.withColumn("_head", F.slice(vector, 1, dims)), "_head", query[:dims], k * oversample, key)
    return top_k(near.drop("_head", "distance"), vector, query, k, key)


def tokens(text: Column) -> Column:
    """Lower-case words of two characters or more, split where neither letter nor digit stands."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: F.length(x) > 1)


def bm25(df: DataFrame, key: str, text: str, query: list[str], mode: str = "and") -> DataFrame:
    """(key, score) of the documents that hold all (and) or any (or) of the query's terms.

    Only the query's terms leave a row; lengths and document counts are one aggregate of one row.
    """
    terms = F.array(*[F.lit(t) for t in dict.fromkeys(query)])
    # the tokens are split once: explode_outer with one element keeps Catalyst from repeating them
    split = df.select(key, F.explode(F.array(tokens(F.col(text)))).alias("_t"))
    sized = split.select(
        key, F.size("_t").alias("len"),
        F.transform(terms, lambda t: F.struct(t.alias("term"), F.size(F.filter("_t", lambda x: x == t)).alias("tf"))).alias("hits"),
    )
    hits = F.filter("hits", lambda h: h["tf"] > 0)
    need = len(set(query)) if mode == "and" else 1
    total = sized.agg(
        F.count("*").alias("n"), F.avg("len").alias("mean"),
        *[F.sum((F.col("hits")[i]["tf"] > 0).cast("int")).alias(f"df{i}") for i in range(len(set(query)))],
    )
    found = sized.withColumn("hits", hits).filter(F.size("hits") >= need).join(F.broadcast(total))
    dfs = F.map_from_arrays(terms, F.array(*[F.col(f"df{i}") for i in range(len(set(query)))]))
    part = lambda h: (
        F.log((F.col("n") - dfs[h["term"]] + 0.5) / (dfs[h["term"]] + 0.5) + 1)
        * h["tf"] * (K1 + 1) / (h["tf"] + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    )
    return found.select(key, F.aggregate("hits", F.lit(0.0), lambda acc, h: acc + part(h)).alias("score"))


def ranked(df: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    """(key, place) of the first k rows, place from 0."""
    top = df.orderBy(*order, key).limit(k)
    return top.select(key, (F.row_number().over(W.orderBy(*order, key)) - 1).alias("place"))


def rrf(lists: list[DataFrame], key: str, weights: list[float] | None = None, k: float = RRF_K) -> DataFrame:
    """Fused scores: sum of 1 / (k / weight + place + 1) over ranked lists (key, place)."""
    weights = weights or [1.0] * len(lists)
    parts = [r.select(key, (1.0 / (k / w + F.col("place") + 1)).alias("s")) for r, w in zip(lists, weights)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(key).agg(F.sum("s").alias("score"))


def fuzzy_terms(terms: DataFrame, query: str) -> DataFrame:
    """(term, edits) of a term table within the edits that the query's length allows: 0 to 3 characters 0, to 6 1, beyond 2."""
    edits = 0 if len(query) <= 3 else 1 if len(query) <= 6 else 2
    near = terms.filter(F.abs(F.length("term") - len(query)) <= edits)
    return near.withColumn("edits", F.levenshtein("term", F.lit(query))).filter(F.col("edits") <= edits)


def chunks(df: DataFrame, key: str, text: str, size: int, overlap: int) -> DataFrame:
    """(key, chunk, start, piece): character chunks of `size` that overlap."""
    n = F.length(text)
    starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(size - overlap)))
    out = df.select(key, text, F.posexplode(starts).alias("chunk", "start"))
    return out.select(key, "chunk", "start", F.substring(F.col(text), F.col("start") + 1, F.lit(size)).alias("piece"))


def max_similarity(df: DataFrame, key: str, vectors: str, query: list[list[float]], how: str = "max") -> DataFrame:
    """Multi-vector score: over the query's vectors the sum of the best (max), mean (avg) or total (sum) dot product."""
    score = F.lit(0.0)
    for q in query:
        sims = F.transform(vectors, lambda v: -distance(v, F.array(*[F.lit(float(x)) for x in q]), "inner_product"))  # noqa: B023
        total = F.aggregate(sims, F.lit(0.0), lambda a, x: a + x)
        score = score + {"max": F.array_max(sims), "avg": total / F.size(sims), "sum": total}[how]
    return df.select(key, score.alias("score"))


def analyze(text: Column, stop: list[str] = (), synonyms: dict[str, str] | None = None) -> Column:
    """Tokens without stop words, each replaced by the head of its synonym group where it has one."""
    kept = F.filter(tokens(text), lambda x: ~x.isin(list(stop))) if stop else tokens(text)
    if not synonyms:
        return kept
    heads = F.create_map(*[F.lit(v) for pair in synonyms.items() for v in pair])
    return F.transform(kept, lambda x: F.coalesce(heads[x], x))


def char_ngrams(df: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """(key, gram, count): character n-grams inside the tokens of a text."""
    terms = df.select(key, F.explode(tokens(F.col(text))).alias("_t")).filter(F.length("_t") >= n)
    grams = F.transform(F.sequence(F.lit(1), F.length("_t") - n + 1), lambda i: F.substring(F.col("_t"), i, F.lit(n)))
    return terms.select(key, F.explode(grams).alias("gram")).groupBy(key, "gram").agg(F.count("*").alias("count"))


def field_scores(parts: list[tuple[DataFrame, float]], key: str) -> DataFrame:
    """(key, score): the weighted sum of one score table (key, score) per field."""
    out = None
    for df, weight in parts:
        one = df.select(key, (F.col("score") * weight).alias("score"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy(key).agg(F.sum("score").alias("score"))
