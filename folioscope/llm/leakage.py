"""Evaluation texts leaking into training text (problem 8).

Method: rare n-gram seeds join training passages to test items, then Smith-Waterman alignment
over words scores the passages; the score decides what is reported.

1. Texts are reduced to words: markup, accents, case, punctuation and white space dropped.  Words
   are compared by a 64-bit hash.
2. One pass over all documents tests every gram against a filter of ``BITS`` bits set by the
   items' grams, whatever their number.  A document is kept with its words if it may hold a
   passage: grams of ``WINDOW`` words in a row, or, with edited copies, ``LEAST`` grams within
   ``NEAR`` words.  Only these documents are written or shuffled.
3. The document frequency of the item grams is counted over the kept documents.  For passages in
   one piece the seed of every window of item words is its rarest gram; for edited copies all
   but the ``LEAST`` - 1 most frequent grams of an item seed, of which a copy that shares
   ``LEAST`` grams has one.  Nothing is lost by seeding in either case.
4. Seeds are joined by hash; documents and items that share one (``LEAST`` for edited copies) are
   aligned around the shared grams, as far as an alignment with a positive score can reach.

Edge cases: null and empty texts match nothing; items of fewer words than a passage can't be
contained by that rule; equal items are reported each; repeated documents are reported by id;
items with repeated ids: the first by text.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import BROADCAST_BYTES, cut, lookup

SEED, EDITED_SEED, WINDOW, LEAST, NEAR, BITS = 5, 3, 10, 4, 96, 26
MATCH, MISMATCH, GAP = 2, -1, -1
#: The least score that is reported: that of ``WINDOW`` words in a row.
SCORE = MATCH * WINDOW

_TAG = regex.compile(r"</?[a-zA-Z][^<>]*>|<!--.*?-->|\]\([^()\s]*\)|!\[|[­​-‏⁠﻿]", regex.S)
_BLOCK = ("<p", "</p", "<br", "<li", "</li", "<div", "</div", "<td", "<tr", "<h", "</h")
_APOSTROPHE = regex.compile(r"(?<=\p{L})['’ʼ`´](?=\p{L})")
_MARK = regex.compile(r"\p{M}+")
_WORD = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]|[^\W_\p{Han}\p{Hiragana}\p{Katakana}]+")
_PLAIN_WORD = re.compile(r"[a-z0-9]+")
_PLAIN_APOSTROPHE = re.compile(r"(?<=[A-Za-z])['`](?=[A-Za-z])")


def words(text: str | None) -> list[str]:
    """The words of ``text`` as they are compared."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    plain = text.isascii()
    if not plain or "<" in text or "](" in text or "![" in text:
        text = _TAG.sub(lambda m: " " if m[0][0] == "<" and m[0].lower().startswith(_BLOCK) else "", text)
    if plain:
        if "'" in text or "`" in text:
            text = _PLAIN_APOSTROPHE.sub("", text)
        return _PLAIN_WORD.findall(text.lower())
    text = _MARK.sub("", unicodedata.normalize("NFKD", _APOSTROPHE.sub("", text))).casefold()
    return _WORD.findall(text)


class Codes(dict):
    """64-bit numbers of words, forgotten when there are too many."""

    def __missing__(self, w: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[w] = n = xxhash.xxh3_64_intdigest(w.encode("utf-8", "replace"))
        return n

    def __reduce__(self):
        return Codes, ()


def coded(texts: list[str | None], codes: Codes) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of all words, where each text ends among them)."""
    flat: list[int] = []
    ends = []
    for t in texts:
        flat += [codes[w] for w in words(t)]
        ends.append(len(flat))
    return np.array(flat, np.uint64).view(np.int64), np.array(ends, np.int64)


def grams(seq: np.ndarray, n: int) -> np.ndarray:
    """Numbers of all runs of ``n`` words."""
    if len(seq) < n:
        return np.zeros(0, np.int64)
    s = seq.view(np.uint64)
    h = np.full(len(s) - n + 1, n, np.uint64)
    for j in range(n):
        h = (h ^ s[j : len(s) - n + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def align_many(docs: list[np.ndarray], item: np.ndarray) -> np.ndarray:
    """Rows (Smith-Waterman score, item words that occur in the passage, longest exact run), one
    for each of ``docs``; the tables of all passages are filled at once.

    Rows run over the item; gaps along the document are a prefix maximum.
    """
    n, own = max(map(len, docs)), set(item.tolist())
    none = next(k for k in range(len(own) + 1) if k not in own)
    x = np.full((len(docs), n), none, np.int64)
    for k, d in enumerate(docs):
        x[k, : len(d)] = d
    above, runs = np.zeros((len(docs), n + 1), np.int32), np.zeros((len(docs), n + 1), np.int32)
    ramp = np.arange(n + 1, dtype=np.int32) * -GAP
    out = np.zeros((len(docs), 3), np.int64)
    for w in item:
        same = x == w
        row = np.zeros_like(above)
        row[:, 1:] = np.maximum(above[:, :-1] + np.where(same, MATCH, MISMATCH), above[:, 1:] + GAP)
        np.maximum(row, 0, out=row)
        row = np.maximum.accumulate(row + ramp, axis=1) - ramp
        new = np.zeros_like(runs)
        new[:, 1:] = np.where(same, runs[:, :-1] + 1, 0)
        above, runs = row, new
        np.maximum(out[:, 0], row.max(axis=1), out=out[:, 0])
        out[:, 1] += same.any(axis=1)
        np.maximum(out[:, 2], new.max(axis=1), out=out[:, 2])
    return out


def align(doc: np.ndarray, item: np.ndarray) -> tuple[int, int, int]:
    """``align_many`` of one passage."""
    return tuple(align_many([np.asarray(doc, np.int64)], np.asarray(item, np.int64))[0].tolist()) if len(doc) else (0, 0, 0)


def _slots(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    slot = h & ((1 << BITS) - 1)
    return slot >> 3, (slot & 7).astype(np.uint8)


def gram_filter(items: DataFrame, seed: int) -> np.ndarray:
    """Bits of the grams of ``items`` (item_id, seq): a fixed size for any number of items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << (BITS - 3), np.uint8)
        for b in batches:
            for seq in b.column(0):
                at, bit = _slots(grams(np.array(seq.as_py(), np.int64), seed))
                np.bitwise_or.at(bits, at, np.uint8(1) << bit)
        at = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(bits[at].astype(np.int16))], names=["at", "bits"])

    bits = np.zeros(1 << (BITS - 3), np.uint8)
    for r in items.select("seq").mapInArrow(run, "at int, bits short").groupBy("at").agg(F.bit_or("bits").alias("bits")).toLocalIterator():
        bits[r[0]] = r[1]
    return bits


_SEQ = T.StructType([T.StructField("id", T.LongType()), T.StructField("seq", T.ArrayType(T.LongType()))])
_HITS = T.StructType([*_SEQ.fields, T.StructField("grams", T.ArrayType(T.LongType()))])
_PAIRS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.IntegerType()), *(T.StructField(n, t) for n, t in (("score", T.IntegerType()), ("coverage", T.DoubleType()), ("matched", T.IntegerType()), ("run", T.IntegerType())))])


def _lists(parts: list[np.ndarray]) -> pa.Array:
    """A list column from arrays of numbers."""
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64()))


def sequences(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, seq) of every row with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for b in batches:
            flat, ends = coded(b.column(1).to_pylist(), codes)
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(np.split(flat, ends[:-1]) if len(ends) else [])], names=_SEQ.names)

    return df.select(F.col(key).cast("long"), F.col(text)).filter(F.col(key).isNotNull() & F.col(text).isNotNull()).mapInArrow(run, _SEQ)


def possible(documents: DataFrame, bits: np.ndarray, seed: int, edited: bool) -> DataFrame:
    """(id, seq, grams) of the documents that may hold a passage; ``grams`` are those that pass
    the filter, each once."""
    shared = documents.sparkSession.sparkContext.broadcast(bits)  # 2^BITS bits
    need, span = (LEAST, NEAR) if edited else (WINDOW - seed + 1, WINDOW - seed + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for b in batches:
            flat, ends = coded(b.column(1).to_pylist(), codes)
            h = grams(flat, seed)
            at, bit = _slots(h)
            hit = (shared.value[at] >> bit & 1).astype(bool)
            starts = np.concatenate([[0], ends[:-1]])
            # grams over the end of a text are none
            for e in range(1, seed):
                over = ends - e
                hit[over[(over >= 0) & (over < len(hit))]] = False
            total = np.concatenate([[0], np.cumsum(hit)])
            keep: list[int] = []
            seqs, found = [], []
            for i in np.flatnonzero(total[np.minimum(ends, len(hit))] - total[np.minimum(starts, len(hit))] >= need):
                lo, hi = starts[i], min(ends[i], len(hit))
                own = np.flatnonzero(hit[lo:hi])
                if (own[need - 1 :] - own[: len(own) - need + 1] < span).any():
                    keep.append(i)
                    seqs.append(flat[lo : ends[i]])
                    found.append(np.unique(h[lo:hi][own]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), _lists(seqs), _lists(found)], names=_HITS.names)

    return documents.select(F.col("doc_id").cast("long"), "text").filter("doc_id is not null and text is not null").mapInArrow(run, _HITS)


def item_seeds(items: DataFrame, frequency: DataFrame, seed: int, edited: bool) -> DataFrame:
    """(gram, item_id): the seeds of every item, from the grams' document frequency."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [grams(np.array(s, np.int64), seed) for s in b.column(1).to_pylist()]
            ids = np.repeat(np.array(b.column(0).to_pylist(), np.int64), [len(g) for g in own])
            at = np.concatenate([np.arange(len(g)) for g in own]) if own else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(at, pa.int32()), pa.array(np.concatenate(own) if own else np.zeros(0, np.int64), pa.int64())], names=["item_id", "at", "gram"])

    places = items.mapInArrow(split, "item_id long, at int, gram long").join(frequency, "gram", "left").fillna(0, ["n"])
    span = WINDOW - seed + 1
    own = places.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("at", "n", "gram"))).alias("g"))  # of one item's length
    if edited:
        met = F.filter(F.array_sort(F.array_distinct(F.transform("g", lambda x: F.struct(x["n"], x["gram"])))), lambda x: x["n"] > 0)
        chosen = F.transform(F.slice(met, F.lit(1), F.greatest(F.size(met) - (LEAST - 1), F.lit(0))), lambda x: x["gram"])
    else:
        windows = F.when(F.size("g") >= span, F.transform(F.sequence(F.lit(1), F.size("g") - (span - 1)), lambda k: F.array_min(F.transform(F.slice("g", k, span), lambda x: F.struct(x["n"], x["gram"])))))
        chosen = F.transform(F.filter(windows, lambda x: x["n"] > 0), lambda x: x["gram"])
    return own.select("item_id", F.explode(F.array_distinct(chosen)).alias("gram"))


def _aligned(pairs: DataFrame, items: DataFrame, seed: int, need: int) -> DataFrame:
    """Scores of (doc_id, item_id, seq) pairs that share ``need`` grams; the items' words are
    broadcast if their counted size allows it, else joined."""
    size = 8 * (items.agg(F.sum(F.size("words"))).first()[0] or 0)
    rows = pairs.join(F.broadcast(items) if size <= BROADCAST_BYTES else items, "item_id").select("doc_id", "item_id", "seq", "words")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, docs, own = b.column(1).to_pylist(), b.column(2), b.column(3)
            best = np.zeros((len(b), 3), np.int64)
            sizes = np.ones(len(b))
            by: dict[int, list[int]] = {}
            for k, i in enumerate(ids):
                by.setdefault(i, []).append(k)
            for rows_of in by.values():
                item = own[rows_of[0]].values.to_numpy()
                known, reach = np.unique(grams(item, seed)), 3 * len(item)  # no alignment of a positive score is longer
                parts: list[tuple[int, np.ndarray]] = []
                for k in rows_of:
                    sizes[k] = MATCH * len(item)
                    doc = docs[k].values.to_numpy()
                    g = grams(doc, seed)
                    at = np.flatnonzero(np.isin(g, known))
                    if len(np.unique(g[at])) >= need:
                        parts += [(k, doc[max(0, p[0] - reach) : p[-1] + seed + reach]) for p in np.split(at, np.flatnonzero(np.diff(at) > 2 * reach) + 1)]
                parts.sort(key=lambda p: len(p[1]))
                lo = 0
                while lo < len(parts):
                    hi = lo + 1
                    while hi < len(parts) and (hi + 1 - lo) * len(parts[hi][1]) <= 40_000:
                        hi += 1
                    got = align_many([d for _, d in parts[lo:hi]], item)
                    for (k, _), row in zip(parts[lo:hi], got):
                        np.maximum(best[k], row, out=best[k])
                    lo = hi
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.int32()), pa.array(best[:, 0], pa.int32()), pa.array(best[:, 0] / sizes), pa.array(best[:, 1], pa.int32()), pa.array(best[:, 2], pa.int32())], names=_PAIRS.names)

    return rows.mapInArrow(score, _PAIRS)


def leaks(documents: DataFrame, items: DataFrame, edited: bool = True, least: int = SCORE) -> DataFrame:
    """(doc_id, item_id, score, coverage, matched, run) of the pairs that align with a score of
    at least ``least``; without ``edited`` those that share a window of ``WINDOW`` words."""
    seed = EDITED_SEED if edited else SEED
    own = items.select(F.col("item_id").cast("long"), "text").filter("item_id is not null and text is not null").groupBy("item_id").agg(F.min("text").alias("text"))
    rows = cut(sequences(own, "item_id", "text").filter(F.size("seq") >= seed).toDF("item_id", "seq"))
    hits = cut(possible(documents, gram_filter(rows, seed), seed, edited))
    met = hits.select("id", F.explode("grams").alias("gram"))
    frequency = met.groupBy("gram").agg(F.count("*").alias("n"))
    seeds = cut(item_seeds(rows, frequency, seed, edited))
    shared = lookup(met, seeds, ["gram"], "inner").select("id", "item_id").distinct()
    pairs = shared.join(hits.select("id", "seq"), "id").withColumnRenamed("id", "doc_id")
    return _aligned(pairs, rows.withColumnRenamed("seq", "words"), seed, LEAST if edited else 1).filter(F.col("score") >= least).dropDuplicates(["doc_id", "item_id"])


def contained(documents: DataFrame, items: DataFrame, run: int = WINDOW) -> DataFrame:
    """(doc_id, item_id) where the document holds at least ``run`` consecutive item words: pairs
    whose alignment scores as much, of which an exact check keeps those with such a run."""
    return leaks(documents, items, run < WINDOW, min(SCORE, MATCH * run)).filter(F.col("run") >= run).select("doc_id", "item_id")
