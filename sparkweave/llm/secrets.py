"""Secret scans: patterns for known shapes, character Markov models for the rest; built-in functions only.

Two order-1 character models share one alphabet: one of random strings, one of ordinary
identifiers. A token's log-likelihood ratio per transition is the mean of
ln p_random(b|a) - ln p_ordinary(b|a); tokens above a threshold are reported as kind `random`.

Training rows are labelled samples of bounded size (documented parameters): `n_random` generated
digests, hexadecimal and base 64, and the values that the patterns find are labelled random;
letter words of at most `n_docs` documents (the lowest hashes of doc_id) and the path-like words
in IDENTIFIERS are labelled ordinary. Everything else covers every character of every document.

Edge cases: null and empty texts give no spans; very long texts stay in their row; repeated rows
give repeated results; an empty table still trains on the generated samples and IDENTIFIERS.
"""

from __future__ import annotations

import json
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import whole

#: Kind, pattern, group whose length counts (0: all), least length; in the order that breaks ties.
BASE = (
    (
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
    ),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: Runs that the models score; possessive, so a short run is read once.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}+"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
IDENTIFIERS = (
    "get_user_name set_default_value read_parquet_file max_partition_bytes shuffle_partitions "
    "HttpServerRequest createOrReplaceTempView getElementById application/octet-stream "
    "content-type user-agent accept-encoding index/main/archive/2019/articles /usr/local/share/doc "
    "internationalization configuration-management test_case_number_one static/images/header"
).split()


def pattern_spans(text: Column, kind: str, pattern: str, group: int, least: int, rank: int) -> Column:
    """Array of struct(start, rank, end, kind, value) of the leftmost, non-overlapping matches that are long enough.

    Matches and the pieces between them alternate, so running lengths give the code point offsets.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = found if group == 0 else F.transform(found, lambda m: F.regexp_extract(m, pattern, group))
    rows = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("hit"), counted.alias("counted"))
    span = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"
    walk = F.aggregate(
        F.filter(rows, lambda r: r["hit"].isNotNull()),
        F.struct(F.lit(0).alias("at"), F.array().cast(span).alias("spans")),
        lambda acc, r: F.struct(
            (acc["at"] + F.length(r["gap"]) + F.length(r["hit"])).alias("at"),
            F.when(
                F.length(r["counted"]) >= least,
                F.concat(
                    acc["spans"],
                    F.array(
                        F.struct(
                            (acc["at"] + F.length(r["gap"])).alias("start"),
                            F.lit(rank).alias("rank"),
                            (acc["at"] + F.length(r["gap"]) + F.length(r["hit"])).alias("end"),
                            F.lit(kind).alias("kind"),
                            r["counted"].alias("value"),
                        )
                    ).cast(span),
                ),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return F.when(text.rlike(pattern), walk).otherwise(F.array().cast(span))


def base_spans(text: Column) -> Column:
    return F.concat(*[pattern_spans(text, *rule, rank) for rank, rule in enumerate(BASE)])


def samples(docs: DataFrame, n_random: int = 4096, n_docs: int = 2000) -> DataFrame:
    """Labelled rows (label, token): label 1 random, 0 ordinary."""
    spark = docs.sparkSession
    digest = F.sha2(F.col("id").cast("string"), 256)
    made = spark.range(n_random).select(
        F.lit(1).alias("label"),
        F.explode(
            F.array(
                F.substring(digest, 1, 40),
                F.substring(F.base64(F.unhex(digest)), 1, 40),
                F.upper(F.substring(F.translate(F.base64(F.unhex(digest)), "+/=", "7Q2"), 1, 20)),
            )
        ).alias("token"),
    )
    plain = spark.range(1).select(
        F.lit(0).alias("label"), F.explode(F.array(*[F.lit(x) for x in IDENTIFIERS])).alias("token")
    )
    ids = (
        docs.select("doc_id").dropna().distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n_docs)
    )
    some = docs.join(F.broadcast(ids), "doc_id", "left_semi").select(whole(F.col("text")).alias("text"))
    seen = some.select(F.explode(base_spans(F.col("text"))).alias("s")).select(
        F.lit(1).alias("label"), F.col("s.value").alias("token")
    )
    words = some.select(
        F.lit(0).alias("label"),
        F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{4,}"), F.lit(0))).alias("token"),
    )
    return made.unionByName(plain).unionByName(seen).unionByName(words)


def fit(docs: DataFrame, smoothing: float = 0.5, backoff: float = 8.0) -> list[float]:
    """Log ratio of each transition, at index code(a) * size + code(b): size squared numbers, whatever the input."""
    size = len(ALPHABET)
    token = F.col("token")
    pairs = samples(docs).filter(F.length("token") >= 2).select(
        "label",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.length(token) - 1),
                lambda i: F.substring(token, i, F.lit(2)),
            )
        ).alias("pair"),
    )
    counts = {
        (r["label"], r["pair"]): r["n"]
        for r in pairs.groupBy("label", "pair").agg(F.count("*").alias("n")).collect()
    }
    def logs(label: int) -> dict[str, float]:
        """Transitions backed off to the second character's own frequency."""
        seen = {(a, b): counts.get((label, a + b), 0) for a in ALPHABET for b in ALPHABET}
        every = sum(seen.values()) + smoothing * size
        single = {b: (sum(seen[a, b] for a in ALPHABET) + smoothing) / every for b in ALPHABET}
        row = {a: sum(seen[a, b] for b in ALPHABET) for a in ALPHABET}
        return {a + b: log((n + backoff * single[b]) / (row[a] + backoff)) for (a, b), n in seen.items()}

    random, ordinary = logs(1), logs(0)
    return [random[a + b] - ordinary[a + b] for a in ALPHABET for b in ALPHABET]


def _code(token: Column, i: Column) -> Column:
    return F.instr(F.lit(ALPHABET), F.substring(token, i, F.lit(1))) - 1


def log_ratio(token: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio per transition."""
    table = F.from_json(F.lit(json.dumps(model)), "array<double>")
    size = len(ALPHABET)
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(token) - 1),
        F.lit(0.0),
        lambda acc, i: acc + F.get(table, _code(token, i) * size + _code(token, i + 1)),
    )
    return total / (F.length(token) - 1)


def model_spans(text: Column, base: Column, model: list[float], threshold: float) -> Column:
    """Spans of kind `random`: tokens that the models call random and that touch no base span."""
    found = pattern_spans(text, "random", TOKEN, 0, 2, len(BASE))
    apart = lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    return F.filter(found, lambda s: apart(s) & (log_ratio(s["value"], model) > threshold))


def scan(docs: DataFrame, model: list[float] | None = None, threshold: float = 0.5) -> DataFrame:
    """docs with `secret_spans`: all spans by start, then kind. The text is read whole.

    Extra columns pass through, whatever they are called, but for one of the name secret_spans, which is replaced.
    """
    model = fit(docs) if model is None else model
    df = docs.select(F.struct("*").alias("row"), whole(F.col("text")).alias("text"))
    df = df.withColumn("base", base_spans(F.col("text")))
    df = df.withColumn("more", model_spans(F.col("text"), F.col("base"), model, threshold))
    own = [F.col("row").getField(c).alias(c) for c in docs.columns if c != "secret_spans"]
    return df.select(*own, F.sort_array(F.concat("base", "more")).alias("secret_spans"))


def redact(docs: DataFrame, mask: str = "[SECRET]", **options) -> DataFrame:
    """docs with every found span of text replaced by mask; overlapping spans are masked once."""
    df = scan(docs, **options)
    text = F.col("text")
    done = F.aggregate(
        "secret_spans",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(
            F.struct(
                s["end"].alias("at"),
                F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask)).alias("out"),
            )
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    return df.withColumn("text", F.when(text.isNotNull(), done))


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, counts by base kind, the base spans' hash and all spans as text."""
    spans = F.col("secret_spans")
    base = F.filter(spans, lambda s: s["rank"] < len(BASE))
    joined = lambda x: F.array_join(
        F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    return scanned.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k, *_ in BASE],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
    )
