"""Vector, full-text and hybrid search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register, table
from ..operators import search as op

_Q = "q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 3)"
_X = "list_transform(e.embedding, lambda x: x::DOUBLE)"
_Y = "list_transform(q.v, lambda x: x::DOUBLE)"
_METRICS = {
    "l2": f"list_sum(list_transform(list_zip({_X}, {_Y}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))",
    "cosine": f"1 - list_dot_product({_X}, {_Y}) / (sqrt(list_dot_product({_X}, {_X})) * sqrt(list_dot_product({_Y}, {_Y})))",
    "inner_product": f"-list_dot_product({_X}, {_Y})",
    "manhattan": f"list_sum(list_transform(list_zip({_X}, {_Y}), lambda p: abs(p[1] - p[2])))",
    "chebyshev": f"list_max(list_transform(list_zip({_X}, {_Y}), lambda p: abs(p[1] - p[2])))",
}


def _query(spark, d):
    return table(spark, d, "embeddings").filter("vec_id = 3").first()["embedding"]


for _m, _sql in _METRICS.items():

    @register(f"vector_topk_{_m}", f"WITH {_Q} SELECT vec_id, round(d, 5) AS distance FROM (SELECT e.vec_id, {_sql} AS d FROM embeddings e, q) ORDER BY d, vec_id LIMIT 10")
    def _top(spark, d, m=_m):
        out = op.top_k(table(spark, d, "embeddings"), "embedding", _query(spark, d), 10, "vec_id", m)
        return out.select("vec_id", F.round("distance", 5).alias("distance"))


@register("vector_topk_filtered", f"WITH {_Q} SELECT vec_id FROM (SELECT e.vec_id, {_METRICS['l2']} AS d FROM embeddings e, q WHERE label % 2 = 0) ORDER BY d, vec_id LIMIT 10")
def _filtered(spark, d):
    return op.top_k(table(spark, d, "embeddings"), "embedding", _query(spark, d), 10, "vec_id", where=F.col("label") % 2 == 0).select("vec_id")


@register("vector_sparse_dot", """WITH s AS (SELECT vec_id, unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS w FROM embeddings),
  q AS (SELECT dim, w FROM s WHERE vec_id = 3 AND w > 0) SELECT s.vec_id, round(sum(s.w * q.w), 5) AS score FROM s JOIN q USING (dim) WHERE s.w > 0 GROUP BY s.vec_id""")
def _sparse(spark, d):
    s = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("dim", "w")).filter("w > 0")
    s = s.withColumn("w", F.col("w").cast("double"))
    q = s.filter("vec_id = 3").select("dim", F.col("w").alias("q"))
    return s.join(F.broadcast(q), "dim").groupBy("vec_id").agg(F.round(F.sum(F.col("w") * F.col("q")), 5).alias("score"))


_T = """t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: length(x) > 1) AS t FROM documents),
  n AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM t),
  h AS (SELECT doc_id, len(t) AS len, q.term, len(list_filter(t, lambda x: x = q.term)) AS tf FROM t, (SELECT unnest(['the', 'thre']) AS term) q),
  f AS (SELECT term, count(*) FILTER (WHERE tf > 0) AS df FROM h GROUP BY term),
  s AS (SELECT doc_id, sum(CASE WHEN tf > 0 THEN ln((n.n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / n.mean)) ELSE 0 END) AS score,
    count(*) FILTER (WHERE tf > 0) AS met FROM h JOIN f USING (term), n GROUP BY doc_id)"""


@register("text_bm25_and", f"WITH {_T} SELECT doc_id, round(score, 6) AS score FROM s WHERE met = 2")
def _bm25(spark, d):
    return op.bm25(table(spark, d, "documents"), "doc_id", "text", ["the", "thre"]).withColumn("score", F.round("score", 6))


@register("text_bm25_or", f"WITH {_T} SELECT doc_id, round(score, 6) AS score FROM s WHERE met >= 1")
def _bm25_or(spark, d):
    return op.bm25(table(spark, d, "documents"), "doc_id", "text", ["the", "thre"], "or").withColumn("score", F.round("score", 6))


@register("text_match_all", """SELECT doc_id FROM documents WHERE list_has_all(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), ['the', 'and', 'with'])""")
def _match(spark, d):
    t = op.tokens(F.col("text"))
    return table(spark, d, "documents").filter(F.size(F.array_except(F.array(F.lit("the"), F.lit("and"), F.lit("with")), t)) == 0).select("doc_id")


@register("text_fuzzy", """SELECT term, levenshtein(term, 'customer')::INT AS edits FROM (SELECT DISTINCT lower(c_mktsegment) AS term FROM customer UNION SELECT 'customers' UNION SELECT 'costumer')
  WHERE abs(length(term) - 8) <= 2 AND levenshtein(term, 'customer') <= 2""")
def _fuzzy(spark, d):
    terms = table(spark, d, "customer").select(F.lower("c_mktsegment").alias("term")).distinct()
    more = spark.range(2).select(F.when(F.col("id") == 0, "customers").otherwise("costumer").alias("term"))
    return op.fuzzy_terms(terms.union(more), "customer")


@register("hybrid_rrf", f"""WITH {_T}, {_Q}, b AS (SELECT doc_id AS id, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) AS p FROM s WHERE met = 2 QUALIFY p <= 30),
  v AS (SELECT id, row_number() OVER (ORDER BY round(d, 5), id) AS p FROM (SELECT e.vec_id AS id, {_METRICS['l2']} AS d FROM embeddings e, q) QUALIFY p <= 30)
  SELECT id, round(sum(x), 9) AS score FROM (SELECT id, 1.0 / (60 / 1.0 + p) AS x FROM b UNION ALL SELECT id, 1.0 / (60 / 2.0 + p) FROM v) GROUP BY id""")
def _hybrid(spark, d):
    text = op.bm25(table(spark, d, "documents"), "doc_id", "text", ["the", "thre"]).select(F.col("doc_id").alias("id"), F.round("score", 6).alias("s"))
    e = table(spark, d, "embeddings")
    q = F.array(*[F.lit(float(x)) for x in _query(spark, d)])
    vec = e.select(F.col("vec_id").alias("id"), F.round(op.distance(F.col("embedding"), q, "l2"), 5).alias("s"))
    lists = [op.ranked(text, "id", [F.desc("s")], 30), op.ranked(vec, "id", [F.asc("s")], 30)]
    return op.rrf(lists, "id", [1.0, 2.0]).withColumn("score", F.round("score", 9))


@register("text_chunk", """SELECT item_id, (i // 80)::INT AS chunk, i::INT AS start, substr(text, i + 1, 100) AS piece
  FROM (SELECT item_id, text, unnest(range(0, greatest(length(text) - 20, 1), 80)) AS i FROM benchmark WHERE length(text) > 0)""")
def _chunk(spark, d):
    return op.chunks(table(spark, d, "benchmark"), "item_id", "text", 100, 20)


@register("text_phrase", "SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '\\bof the\\b')")
def _phrase(spark, d):
    return table(spark, d, "documents").filter(F.lower("text").rlike(r"\bof the\b")).select("doc_id")


@register("text_highlight", "SELECT item_id, regexp_replace(text, '(?i)\\b(the)\\b', '<b>\\1</b>', 'g') AS marked FROM benchmark")
def _highlight(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.regexp_replace("text", r"(?i)\b(the)\b", "<b>$1</b>").alias("marked"))


_W = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: length(x) > 1)"


@register("text_analyzer", f"""SELECT item_id, array_to_string(list_transform(list_filter({_W}, lambda x: x NOT IN ('the', 'and', 'of')),
    lambda x: CASE WHEN x IN ('big', 'huge') THEN 'large' ELSE x END), ' ') AS terms FROM benchmark""")
def _analyzer(spark, d):
    terms = op.analyze(F.col("text"), ["the", "and", "of"], {"big": "large", "huge": "large"})
    return table(spark, d, "benchmark").select("item_id", F.array_join(terms, " ").alias("terms"))


@register("text_char_ngrams", f"""SELECT item_id, gram, count(*) AS count FROM (SELECT item_id, substr(t, unnest(range(1, length(t) - 1)), 3) AS gram
    FROM (SELECT item_id, unnest({_W}) AS t FROM benchmark) WHERE length(t) >= 3) GROUP BY ALL""")
def _char_ngrams(spark, d):
    return op.char_ngrams(table(spark, d, "benchmark"), "item_id", "text", 3)


_B = """t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower({field}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: length(x) > 1) AS t FROM documents),
  n AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM t), h AS (SELECT doc_id, len(t) AS len, len(list_filter(t, lambda x: x = '{term}')) AS tf FROM t),
  f AS (SELECT count(*) FILTER (WHERE tf > 0) AS df FROM h)
  SELECT doc_id, ln((n.n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / n.mean)) AS s FROM h, f, n WHERE tf > 0"""


@register("text_field_weighted", f"""SELECT doc_id, round(sum(s), 6) AS score FROM (SELECT doc_id, 2.0 * s AS s FROM (WITH {_B.format(field='source', term='web')})
  UNION ALL SELECT doc_id, s FROM (WITH {_B.format(field='text', term='the')})) GROUP BY doc_id""")
def _field_weighted(spark, d):
    docs = table(spark, d, "documents")
    parts = [(op.bm25(docs, "doc_id", "source", ["web"], "or"), 2.0), (op.bm25(docs, "doc_id", "text", ["the"], "or"), 1.0)]
    return op.field_scores(parts, "doc_id").withColumn("score", F.round("score", 6))
