"""Mix sources to target weights (problem 9).

Method: Poisson replication.  A document of a source is used ``min(k, max_repeats)`` times, k
being the inverse of the Poisson distribution at a uniform number hashed from (seed, doc_id);
the Poisson mean is solved so that the mean of the capped count is the source's target rate
``target_weight * T / tokens(source)``.  Rates of ``max_repeats`` and above use every document
``max_repeats`` times.  Copies are shuffled globally by a hash.

Edge cases: null and unlisted sources count in T and are not mixed; null and empty texts have 0
tokens; names that differ in case, outer spaces or separators are one source; repeated target
rows of one source: the first by weight; empty tables give no rows.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, lookup

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
SEED = 42


def clean_source(col: Column) -> Column:
    """Lower case, no outer spaces, one kind of separator."""
    return F.regexp_replace(F.regexp_replace(F.lower(col), r"[\s\p{Z}\p{C}_\-./‐-―]+", "_"), r"^_+|_+$", "")


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str | None):
    """The vocabulary file ``path`` with the ``pattern`` that parts texts before merging; without
    one, that of the package the vocabularies come in."""
    import tiktoken

    if pattern is None:
        from public_tokenizers import PATTERN as pattern

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("parameter", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, text: str, tokenizer: str = TOKENIZER, pattern: str | None = None) -> DataFrame:
    """``df`` with ``text`` replaced by ``tokens``, its size in tokens; texts are counted whole,
    in pieces of at most 100,000 characters cut at white space where there is any."""
    others = [f for f in df.schema.fields if f.name != text]

    def count(t: str | None) -> int:
        if not t:
            return 0
        enc, n, at = _encoding(tokenizer, pattern), 0, 0
        while at < len(t):
            end = at + 100_000
            if end < len(t) and (space := t.rfind(" ", at + 1, end)) > at:
                end = space
            n += len(enc.encode_ordinary(t[at:end]))
            at = end
        return n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens = pa.array([count(x) for x in b.column(text).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in others), tokens], names=[*(f.name for f in others), "tokens"])

    return df.mapInArrow(run, T.StructType([*others, T.StructField("tokens", T.LongType())]))


def capped_mean(lam: float, cap: int) -> float:
    """Mean of min(k, cap) of a Poisson count k."""
    p, total, mass = math.exp(-lam), 0.0, 0.0
    for k in range(cap):
        total += k * p
        mass += p
        p *= lam / (k + 1)
    return total + cap * max(0.0, 1 - mass)


def poisson_mean(rate: float, cap: int) -> float | None:
    """The Poisson mean whose capped count has the mean ``rate``; None if out of reach."""
    if rate >= cap:
        return None
    lo, hi = 0.0, 700.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if capped_mean(mid, cap) < rate else (lo, mid)
    return hi


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _thresholds(rate: pd.Series, cap: pd.Series) -> pd.Series:
    """Cumulative Poisson probabilities up to the cap; empty where every copy is used."""

    def one(r: float, c: int) -> list[float]:
        if r is None or r != r or c is None or c != c or r <= 0 or c <= 0:
            return [1.0]
        lam = poisson_mean(r, int(c))
        if lam is None:
            return [0.0] * int(c)
        p, mass, out = math.exp(-lam), 0.0, []
        for k in range(int(c)):
            mass += p
            out.append(mass)
            p *= lam / (k + 1)
        return out

    return pd.Series([one(r, c) for r, c in zip(rate, cap)])


def sized(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens), written to the shared folder as both passes read it."""
    return cut(token_counts(documents.select("doc_id", clean_source(F.col("source")).alias("source"), "text"), "text", tokenizer))


def plan(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """A row per listed source: its tokens, target tokens, rate, cap and count thresholds.
    The total is one number brought to the driver."""
    total = sizes.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    listed = targets.select(clean_source(F.col("source")).alias("source"), "target_weight", "max_repeats").filter("source is not null").groupBy("source").agg(F.max("target_weight").alias("target_weight"), F.max_by("max_repeats", "target_weight").alias("max_repeats"))
    own = sizes.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents"))
    p = listed.join(own, "source", "left").fillna(0, ["tokens", "documents"]).withColumn("target_tokens", F.col("target_weight") * F.lit(float(total)))
    p = p.withColumn("rate", F.when(F.col("tokens") > 0, F.col("target_tokens") / F.col("tokens")))
    return p.withColumn("thresholds", _thresholds("rate", F.col("max_repeats").cast("int")))


def copies(sizes: DataFrame, planned: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, source, copy, tokens): each document as often as its count says."""
    u = (F.xxhash64(F.lit(seed), "doc_id") / F.lit(2.0**64)) + 0.5
    used = lookup(sizes.filter("source is not null"), cut(planned.select("source", "thresholds")), ["source"], "inner").withColumn("_u", u).withColumn("_k", F.size(F.filter("thresholds", lambda c: F.col("_u") >= c)))
    return used.filter("_k > 0").select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("_k"))).alias("copy"), "tokens")


def shuffled(rows: DataFrame, seed: int = SEED) -> DataFrame:
    return rows.orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "copy"), "doc_id", "copy")


def short_sources(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, seed: int = SEED) -> DataFrame:
    """Sources that stay under their target with every document used max_repeats times: those
    whose copies in the mixture do not reach it and, exactly, could not."""
    sizes = sized(documents, tokenizer)
    p = plan(sizes, targets)
    reached = copies(sizes, p, seed).groupBy("source").agg(F.sum("tokens").alias("_reached"))
    p = p.join(reached, "source", "left").fillna(0, ["_reached"])
    return p.filter((F.col("_reached") < F.col("target_tokens")) & (F.col("max_repeats") * F.col("tokens") < F.col("target_tokens"))).select("source")


def mixture(documents: DataFrame, targets: DataFrame, seed: int = SEED, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, copy, tokens) in shuffled order; ``written`` has the texts as well."""
    sizes = sized(documents, tokenizer)
    return shuffled(copies(sizes, plan(sizes, targets), seed), seed)


def written(documents: DataFrame, targets: DataFrame, seed: int = SEED, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, copy, tokens, text) in shuffled order, texts joined by doc_id."""
    sizes = sized(documents, tokenizer)
    texts = documents.select("doc_id", "text").filter("doc_id is not null")
    return shuffled(copies(sizes, plan(sizes, targets), seed).join(texts, "doc_id"), seed)


def shares(documents: DataFrame, targets: DataFrame, seed: int = SEED, tokenizer: str = TOKENIZER) -> DataFrame:
    """(source, target_weight, copies, tokens, share): what the mixture reaches."""
    m = mixture(documents, targets, seed, tokenizer).groupBy("source").agg(F.count("*").alias("copies"), F.sum("tokens").alias("tokens"))
    listed = targets.select(clean_source(F.col("source")).alias("source"), "target_weight").filter("source is not null").groupBy("source").agg(F.max("target_weight").alias("target_weight"))
    s = cut(listed.join(m, "source", "left").fillna(0, ["copies", "tokens"]))
    total = s.agg(F.sum("tokens")).first()[0]
    return s.withColumn("share", F.when(F.lit(total or 0) > 0, F.col("tokens") / F.lit(float(total or 1))).otherwise(0.0))
