"""Abusive, hateful and sexual content (problem 10).

Method: cumulative-link ordinal regression.  Each category has one weight vector over sparse
features shared by the ordered thresholds 1..3, and gives the expected severity 0..3.  Sentences
are scored; a document's severity is its worst sentence's, and a document is a case from
``CASE`` on.

Features are words, word pairs and the inner 4-grams of words after undoing disguises: look-alike
letters and digits, hidden characters, parted or repeated letters; a word with masked letters
gives the letters left.  The model is fitted on

* sentences made by the grammar of ``severity_pools``, plain and disguised;
* a bounded sample of reviewed documents (``SAMPLE`` in the order of a hash of their id, of at
  most ``SAMPLE_CHARS`` characters).  All sentences of those reviewed as harmless get grade 0.  In
  each of the others one sentence is the witness of its review and gets grade 2: the one the
  model finds worst and whose word pairs are most frequent in documents so reviewed against all
  others.  A document without a clear witness (reviewers err) is left out;
* ``BACKGROUND`` other documents as harmless, but for sentences the model is sure of, and common
  words in any order.

Edge cases: null and empty texts score 0; repeated documents score alike; conflicting reviews
of a document make it no training row; a null source is a source of its own in the rates.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import hash_sample
from . import language
from . import severity_pools as pools
from .mixing import clean_source

CATEGORIES = ("abusive", "hateful", "sexual")
GRADES, CASE = 3, 1.35
SAMPLE, BACKGROUND, SAMPLE_CHARS, SEED = 3000, 2000, 20_000, 5
#: Few features weigh no more than this many.
LEAST = 8
#: At most so many harmless sentences (the most frequent), parts of them, and rows of common words in
#: any order; label of documents nobody reviewed.
SENTENCES, PARTS, SALADS, UNREAD = 9000, 3000, 1200, "unread"
#: How many times more frequent in documents of its category than in others a witness must be.
ENRICHED = 5

#: Letters that look like Latin ones, and signs that stand for letters.
_ALIKE = str.maketrans("аеорсухіјѕһԁԛԝɡıοαεικνρτυ", "aeopcyxijshdqwgioaeikvptu")
_SIGNS = str.maketrans("@$€!0134578", "aseioieastb")
_HIDDEN = re.compile("[­​-‏⁠-⁤﻿︀-️]")
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s+|(?<=[。！？])|[\r\n]+|(?<=:)\s+|\s\|\s")
_PARTED = re.compile(r"(?<![^\W_])(?<![@$€*])(?:[^\W\d_][ ._*\-]){2,}[^\W\d_](?![^\W_])")
_HAN_PARTED = re.compile(r"(?<=[一-鿿])[ ._*\-](?=[一-鿿])")
_TOKEN = re.compile(r"[一-鿿]|[a-zà-öø-ÿœß@$€!0-9][a-zà-öø-ÿœß@$€!*0-9'’]*")
_REPEAT = re.compile(r"(.)\1+")
_VOWELS = re.compile(r"[aeiouyà-æè-ïò-öø-üœ*]")
_DISGUISE = re.compile(r"[@$€!*0-9]")
_LETTER = re.compile(r"[a-zà-öø-ÿœß]")
_BOLD = re.compile(r"(?<!\w)\*\*|\*\*(?!\w)")
_FOREIGN = re.compile("[ɐ-\u052f]")


def plain(text: str) -> str:
    """Text in lower case with its disguises by signs undone; line ends and sentence marks stay."""
    if not text.isascii():
        # sentence marks must outlast the folding of wide letters
        text = _HIDDEN.sub("", unicodedata.normalize("NFKC", text.replace("！", "。").replace("？", "。")))
    text = text.lower()
    if not text.isascii():
        if _FOREIGN.search(text) or "ı" in text:
            text = text.translate(_ALIKE)
        text = _HAN_PARTED.sub("", text)
    if "**" in text:
        text = _BOLD.sub("", text)
    return _PARTED.sub(_joined, text)


def _joined(m: re.Match) -> str:
    """Parted letters as a word; letters parted by * without a vowel are a word masked so."""
    w = re.sub(r"[ ._*\-]", "", m[0])
    return m[0] if "*" in m[0] and not _VOWELS.search(w) else w


def _meant(w: str) -> str:
    """A token as it is meant, empty if it says nothing."""
    if "一" <= w[0] <= "鿿":
        return w
    w = w.strip("'’")
    if _DISGUISE.search(w):
        if not _LETTER.search(w):
            w = w.strip("!*")
            if not re.search(r"[@$€]", w):
                return "0" if w else ""
        w = w.rstrip("!") if w.count("!") == 1 and w.endswith("!") else w
        w = w.translate(_SIGNS)
        if "*" in w and len(w) > 2:
            return "m:" + _REPEAT.sub(r"\1", _VOWELS.sub("", w))
    return _REPEAT.sub(r"\1", w)


def tokens(sentence: str) -> list[str]:
    """Words as they are meant; Han characters one by one."""
    return [m for w in _TOKEN.findall(plain(sentence)) if (m := _meant(w))]


def features(ws: Sequence[str]) -> list[str]:
    out = [*ws, *(f"{a} {b}" for a, b in zip(ws, ws[1:])), *(f"{a} _ {b}" for a, b in zip(ws, ws[2:]))]
    for w in ws:
        if len(w) > 4 and w[1] != ":":
            out += [f"#{w[i : i + 4]}" for i in range(len(w) - 3)]
    return out


def sentences(text: str) -> list[str]:
    return [s for s in _SENTENCE.split(text) if s and not s.isspace()]


class Ordinal:
    """P(severity >= g) = 1 / (1 + exp(theta_g - w x)), one w for all g."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.w = np.zeros((0, len(CATEGORIES)))
        self.theta = np.zeros((GRADES, len(CATEGORIES)))
        self._prepare()

    def fit(self, rows: Sequence[tuple[Sequence[str], Sequence[int]]], steps: int = 130, rate: float = 0.06, decay: float = 2e-5, least: int = 3) -> Ordinal:
        """``rows``: (features, grade of each category)."""
        seen: dict[str, int] = {}
        for x, _ in rows:
            for f in set(x):
                seen[f] = seen.get(f, 0) + 1
        self.index = {f: i for i, f in enumerate(sorted(f for f, c in seen.items() if c >= least))}
        r, c = [], []
        for i, (x, _) in enumerate(rows):
            ids = [self.index[f] for f in x if f in self.index]
            r += [i] * len(ids)
            c += ids
        r, c = np.array(r), np.array(c)
        grade = np.array([g for _, g in rows])
        n, f, k = len(rows), len(self.index), len(CATEGORIES)
        scale = 1 / np.sqrt(LEAST + np.bincount(r, minlength=n))[:, None]
        by_col = np.argsort(c, kind="stable")
        rc, starts = r[by_col], np.searchsorted(c[by_col], np.arange(f))
        bounds, filled = np.searchsorted(r, np.arange(n)), np.bincount(r, minlength=n) > 0
        w = np.zeros((f, k))
        th = np.tile(np.array([2.0, 3.0, 5.0])[:, None], (1, k))
        importance = np.where(grade.max(axis=1) > 0, 3.0, 1.0)[:, None]
        importance = importance / importance.sum()
        state = [[np.zeros_like(v), np.zeros_like(v)] for v in (w, th)]
        cols = np.arange(k)
        for step in range(1, steps + 1):
            eta = np.where(filled[:, None], np.add.reduceat(w[c], np.minimum(bounds, len(c) - 1), axis=0), 0) * scale
            p = 1 / (1 + np.exp(np.clip(th[None] - eta[:, None, :], -30, 30)))  # (n, grade, category)
            p = np.concatenate([np.ones((n, 1, k)), p, np.zeros((n, 1, k))], axis=1)
            a = np.take_along_axis(p, grade[:, None, :], 1)[:, 0]
            b = np.take_along_axis(p, grade[:, None, :] + 1, 1)[:, 0]
            mass = np.maximum(a - b, 1e-9)
            d = (1 - a - b) * importance
            gt = np.zeros_like(th)
            for g in range(GRADES):
                gt[g] = ((grade == g) * b * (1 - b) / mass * importance - (grade == g + 1) * a * (1 - a) / mass * importance)[:, cols].sum(axis=0)
            gw = np.add.reduceat((d * scale)[rc], starts, axis=0) - decay * w
            for v, g, (s1, s2), speed in zip((w, th), (gw, gt), state, (rate * 4, rate)):
                s1 += 0.1 * (g - s1)
                s2 += 0.01 * (g * g - s2)
                v += speed * (s1 / (1 - 0.9**step)) / (np.sqrt(s2 / (1 - 0.99**step)) + 1e-7)
            th.sort(axis=0)
        self.w, self.theta = w, th
        self._prepare()
        return self

    def _prepare(self) -> None:
        """Weights summed by word, and by pairs of word numbers, so that a sentence's score is a
        few array sums; features count as often as they occur, as in the fit."""
        self.raw: dict[str, int] = {}
        self.meant: dict[str, int] = {}
        self.sums = np.zeros((1 << 15, len(CATEGORIES)))
        self.sizes = np.zeros(1 << 15)
        known: tuple[list, list] = ([], [])
        for f, i in self.index.items():
            if " " in f:
                x, _, y = f.partition(" _ ") if " _ " in f else f.partition(" ")
                known[" _ " in f].append(((self._word(x) << 32) | self._word(y), i))
        self.pairs = []
        for rows in known:
            rows.sort()
            self.pairs.append((np.array([c for c, _ in rows], np.int64), self.w[[i for _, i in rows]] if rows else np.zeros((0, len(CATEGORIES)))))
        self.fixed = len(self.meant)  # words of pairs keep their numbers

    def _word(self, w: str) -> int:
        k = self.meant.get(w)
        if k is None:
            k = self.meant[w] = len(self.meant)
            if k == len(self.sizes):
                self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
                self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
            ids = [i for f in features([w]) if (i := self.index.get(f)) is not None]
            self.sums[k] = self.w[ids].sum(axis=0) if ids else 0
            self.sizes[k] = len(ids)
        return k

    def _number(self, raw: str) -> int:
        """The number of a token, -1 if it says nothing."""
        m = _meant(raw)
        k = self.raw[raw] = self._word(m) if m else -1
        return k

    def _forget(self) -> None:
        """Words met since the fit are forgotten when there are too many."""
        if len(self.meant) > self.fixed + 500_000:
            self.meant = {w: k for w, k in self.meant.items() if k < self.fixed}
            self.raw.clear()

    def _expected(self, parts: Sequence[str]) -> np.ndarray:
        """Expected severity of each sentence of plain text."""
        out = np.zeros((len(parts), len(CATEGORIES)))
        flat: list[int] = []
        at, starts = [], []
        find, get, number = _TOKEN.findall, self.raw.get, self._number
        for i, s in enumerate(parts):
            ids = [k for t in find(s) if (k := j if (j := get(t)) is not None else number(t)) >= 0]
            if ids:
                at.append(i)
                starts.append(len(flat))
                flat += ids
        if flat:
            w = np.array(flat, np.int64)
            e, n = self.sums[w], self.sizes[w]
            sentence = np.zeros(len(w), np.int64)
            sentence[starts[1:]] = 1
            sentence = np.cumsum(sentence)
            for gap, (codes, weights) in zip((1, 2), self.pairs):
                if len(codes) and len(w) > gap:
                    own = (w[:-gap] << 32) | w[gap:]
                    place = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
                    hit = np.flatnonzero((codes[place] == own) & (sentence[:-gap] == sentence[gap:]))
                    e[hit] += weights[place[hit]]
                    n[hit] += 1
            n = np.add.reduceat(n, starts)
            eta = np.add.reduceat(e, starts, axis=0) / np.sqrt(LEAST + n)[:, None]
            got = (1 / (1 + np.exp(np.clip(self.theta[None] - eta[:, None, :], -30, 30)))).sum(axis=1)
            out[at] = np.where((n > 0)[:, None], got, 0)
        return out

    def expected(self, texts: Sequence[str]) -> np.ndarray:
        """Expected severity of each sentence and category."""
        return self._expected([plain(t) for t in texts])

    def documents(self, texts: Sequence[str | None]) -> np.ndarray:
        """Expected severity of each document: that of its worst sentence."""
        out = np.zeros((len(texts), len(CATEGORIES)))
        for lo in range(0, len(texts), 256):
            self._forget()
            parts: list[str] = []
            owner: list[int] = []
            for i, t in enumerate(texts[lo : lo + 256], lo):
                if t:
                    own = sentences(plain(t))
                    parts += own
                    owner += [i] * len(own)
            if parts:
                np.maximum.at(out, owner, self._expected(parts))
        return out

    def document(self, text: str | None) -> np.ndarray:
        return self.documents([text])[0]


def disguise(word: str, rng: random.Random) -> str:
    """One of the ways in which such words are hidden."""
    kind = rng.randrange(7)
    if kind == 0:
        return re.sub(r"[aeiouáéíóúäöüèê]", "*", word)
    if kind == 1:
        return re.sub(r"[aeiouáéíóúäöüèê]", "*", word, count=1)
    if kind == 2:
        return word.translate(str.maketrans("aeios", "@€!0$"))
    if kind == 3:
        return rng.choice(" .-_*").join(word)
    if kind == 4:
        k = rng.randrange(len(word))
        return word[:k] + word[k] * rng.randint(2, 4) + word[k + 1 :]
    if kind == 5:
        return word.translate(str.maketrans("aeopc", "аеорс"))
    return word.upper()


_CHOICE = re.compile(r"\[([^\[\]]*)\]")
_BETWEEN_HAN = re.compile(r"(?<=[一-鿿，]) +(?=[一-鿿，])")
_MADE_UP = {"": ("{}ians", "the {} people", "{}er folk", "those {}s"), "es_": ("los {}anos", "la gente de {}"), "de_": ("{}er", "die Leute aus {}"), "fr_": ("les {}iens", "ces {}ais")}


def made_up(language: str, rng: random.Random) -> str:
    """The name of a group that doesn't exist."""
    if language == "zh_":
        return "".join(rng.choice("阿巴卡達法加伊拉馬納帕羅薩塔烏瓦") for _ in range(rng.randint(2, 3))) + rng.choice(("人", "族"))
    name = "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randint(1, 2))) + rng.choice("dklmnrtv")
    return rng.choice(_MADE_UP[language]).format(name.capitalize())


def pool(seed: int = SEED, copies: int = 14) -> list[tuple[list[str], list[int]]]:
    """Training rows from the grammar of graded sentences, some words disguised."""
    rng = random.Random(seed)
    out = []
    for category, lines in enumerate((pools.ABUSIVE, pools.HATEFUL, pools.SEXUAL, f"{pools.HARMLESS}\n{pools.ORDINARY}")):
        for line in lines.split("\n"):
            grade, sentence = line.split("|", 1)

            def word(m: re.Match) -> str:
                name = m[1]
                if name.endswith("people"):
                    k = name[:-6]
                    return rng.choice(pools.SLOTS[f"{k}group"]).replace("_", " ") if rng.random() < 0.5 else made_up(k, rng)
                w = rng.choice(pools.SLOTS[name]).replace("_", " ")
                if category < 3 and rng.random() < 0.4:
                    w = " ".join(disguise(x, rng) if x.isalpha() and len(x) > 2 else x for x in w.split())
                return w

            for _ in range(copies):
                s = _CHOICE.sub(lambda m: rng.choice(m[1].split("|")), sentence)
                s = _BETWEEN_HAN.sub("", " ".join(re.sub(r"\{(\w+)\}", word, s).split()))
                if category < 3 and rng.random() < 0.2:
                    ws = s.split()
                    k = rng.randrange(len(ws))
                    if ws[k].isalpha() and len(ws[k]) > 3:
                        ws[k] = disguise(ws[k], rng)
                    s = " ".join(ws)
                if rng.random() < 0.08:
                    s = s.upper()
                grades = [int(grade)] * 3 if category == 3 else [int(grade) if category == k else 0 for k in range(3)]
                out.append((features(tokens(s)), grades))
    return out


def _pairs(ws: Sequence[str]) -> set[str]:
    return {*ws, *(f"{a} {b}" for a, b in zip(ws, ws[1:]))}


class Witnesses:
    """The sentences of reviewed documents and how typical their words are of each category."""

    def __init__(self, reviewed: Sequence[tuple[str, str]]):
        self.docs = [(CATEGORIES.index(label), sentences(t)) for label, t in reviewed if label in CATEGORIES]
        others = [sentences(t) for label, t in reviewed if label not in CATEGORIES]
        self.words = {s: _pairs(tokens(s)) for _, parts in self.docs for s in parts}
        n = [sum(k == c for c, _ in self.docs) for k in range(len(CATEGORIES))]
        seen: list[dict[str, int]] = [{} for _ in range(len(CATEGORIES) + 1)]
        for k, parts in [*self.docs, *((len(CATEGORIES), p) for p in others)]:
            for x in set().union(*(self.words[s] if s in self.words else _pairs(tokens(s)) for s in parts)) if parts else ():
                seen[k][x] = seen[k].get(x, 0) + 1
        total = max(1, len(others))
        self.typical = []
        for k in range(len(CATEGORIES)):
            odds = {x: np.log((c + 0.5) / max(1, n[k]) * total / (seen[-1].get(x, 0) + 5)) for x, c in seen[k].items()}
            self.typical.append({x: float(min(1.0, max(0.0, v / 3))) for x, v in odds.items()})
        # a sentence that other documents hold nearly as often is no witness
        whole: list[dict[tuple[str, ...], int]] = [{} for _ in range(len(CATEGORIES) + 1)]
        for k, parts in [*self.docs, *((len(CATEGORIES), p) for p in others)]:
            for x in {tuple(tokens(s)) for s in parts}:
                whole[k][x] = whole[k].get(x, 0) + 1
        self.common = [{x for x, c in whole[k].items() if ENRICHED * (whole[-1].get(x, 0) + 1) * max(1, n[k]) >= c * total} for k in range(len(CATEGORIES))]

    def pick(self, model: Ordinal, clear: float = 0.9) -> list[tuple[list[str], list[int]]]:
        """One training row for each document with a clear witness."""
        out = []
        for k, parts in self.docs:
            if not parts:
                continue
            typical = np.array([np.mean([self.typical[k].get(x, 0.0) for x in self.words[s]]) if self.words[s] else 0.0 for s in parts])
            own = [tuple(tokens(s)) for s in parts]
            possible = np.array([len("".join(x)) >= 4 and x not in self.common[k] for x in own])
            score = np.where(possible, model.expected(parts)[:, k] + 2 * typical, 0.0)
            best = int(score.argmax())
            if score[best] >= clear:
                out.append((features(tokens(parts[best])), [2 if c == k else 0 for c in range(len(CATEGORIES))]))
        return out


def fit(reviewed: Sequence[tuple[str, str]], seed: int = SEED) -> Ordinal:
    """A model from (label, text) rows: reviewed documents, ``none`` if harmless, and ``UNREAD``."""
    rows = pool(seed)
    rng = random.Random(seed)
    zero = [0] * len(CATEGORIES)
    kinds: dict[str, bool] = {}
    uses: dict[str, int] = {}
    for label, t in reviewed:
        if label not in CATEGORIES:
            for s in set(sentences(t)):
                kinds[s] = kinds.get(s, False) or label != UNREAD
                uses[s] = uses.get(s, 0) + 1
    harmless = sorted(kinds)
    rng.shuffle(harmless)
    harmless.sort(key=lambda s: -uses[s])
    harmless = harmless[:SENTENCES]
    read = np.array([kinds[s] for s in harmless], bool)
    plain = [(features(tokens(s)), zero) for s in harmless]
    parts = []
    for s in rng.sample(harmless, min(PARTS, len(harmless))):  # parts of sentences are as harmless
        ws = s.split()
        if len(ws) > 4:
            k = rng.randrange(len(ws) - 2)
            parts.append((features(tokens(" ".join(ws[k : k + rng.randint(2, 6)]))), zero))
    # common words in any order, alone and among words of harmless sentences, say nothing
    used = sorted({w for s in harmless for w in s.split()})
    for k in range(min(SALADS, len(harmless))):
        own = language.COMMON[language.LANGS[k % len(language.LANGS)]].split()
        ws = [rng.choice(own) if not used or rng.random() < 0.7 else rng.choice(used) for _ in range(rng.randint(3, 12))]
        parts.append((features(tokens(" ".join(ws))), zero))
    model = Ordinal().fit(rows + plain + parts, steps=60)
    if not harmless:
        return model
    keep = lambda m, limit: [p for p, s, r in zip(plain, m.expected(harmless).max(axis=1), read) if r or s <= limit]
    witnesses = Witnesses(reviewed)
    if witnesses.docs:
        model = Ordinal().fit(rows + keep(model, 1.2) + parts + witnesses.pick(model), steps=60)
    return Ordinal().fit(rows + keep(model, 1.0) + parts + witnesses.pick(model))


def sample(documents: DataFrame, labels: DataFrame, limit: int = SAMPLE, background: int = BACKGROUND) -> list[tuple[str, str]]:
    """(label, text) of reviewed documents whose reviews agree, and of any ``background`` ones
    as ``UNREAD``."""
    agreed = labels.filter("label is not null").groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("_m")).filter("label = _m")
    first = hash_sample(agreed, "doc_id", limit, labels.count())
    got = documents.select("doc_id", "text").filter(F.length("text") <= SAMPLE_CHARS).join(F.broadcast(first), "doc_id")  # at most ``limit`` short rows
    plain = hash_sample(documents.select("doc_id", "text").filter(F.length("text") <= SAMPLE_CHARS), "doc_id", background, documents.count())
    return sorted((r[0], r[1]) for r in got.select("label", "text").collect()) + sorted((UNREAD, r[1]) for r in plain.collect())


_SCORES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("source", T.StringType()), *(T.StructField(c, T.DoubleType()) for c in CATEGORIES)])


def scores(documents: DataFrame, model: Ordinal) -> DataFrame:
    """(doc_id, source, abusive, hateful, sexual): expected severity of every document."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            got = np.concatenate([m.documents(c.column(2).to_pylist()) for c in (b.slice(k, 256) for k in range(0, max(1, len(b)), 256))])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(got[:, k], pa.float64()) for k in range(len(CATEGORIES)))], names=_SCORES.names)

    return documents.select(F.col("doc_id").cast("long"), clean_source(F.col("source")).alias("source"), "text").mapInArrow(run, _SCORES)


def cases(scored: DataFrame, case: float = CASE) -> DataFrame:
    """(doc_id, category) of the documents that reach ``case``."""
    each = F.array(*(F.when(F.col(c) >= case, F.lit(c)) for c in CATEGORIES))
    return scored.select("doc_id", F.explode(each).alias("category")).filter("category is not null").distinct()


def rates(scored: DataFrame, case: float = CASE) -> DataFrame:
    """(source, documents, and the share of cases of each category)."""
    return scored.groupBy("source").agg(F.count("*").alias("documents"), *(F.avg((F.col(c) >= case).cast("double")).alias(f"{c}_rate") for c in CATEGORIES))
