"""Broken prompt and response pairs (problem 7).

Method: a conditional random field tags the clauses of a response as answer, courtesy, refusal,
echo, foreign or unfinished; the coverage of the tags gives the pair's defect.  Features are the
clause's words and word pairs, its overlap with the message, its language against the message's,
and how it ends: by a mark, inside an open bracket or fence, or with words that end sentences
elsewhere.

The tagger is fitted at the start on ``FITTED`` of ``SAMPLE`` rows in the order of a hash of
their id (each of at most ``SAMPLE_CHARS`` characters): complete responses as they are, cut at
random, paired with messages of another language, replaced by their message; and on refusals,
courtesies and short answers from ``pools``.

How the last words of open replies end clauses elsewhere is counted over all replies, rows stored
twice twice.  A filter of fixed size, set where a gram stands at an open end, drops most other
grams before they are shuffled; what it lets through is joined by gram, exactly.

Edge cases: a blank message is no pair; a blank reply is ``empty_answer`` unless the next row of
the session in time holds a reply alone; rows without session or time have no next row; repeated
rows of one id count once; a reply that is only a courtesy is an answer; emoji, links, paths and
closed code blocks end a reply as a full stop does.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.blank import BLANK
from ..operators.ordered import HOT_ROWS, any_hot, with_neighbours
from ..session import cut, hash_sample
from . import language, pools
from .crf import CRF

SAMPLE, FITTED, SAMPLE_CHARS, SEED = 6000, 1500, 4000, 7
#: Lengths of the last words of a clause whose use elsewhere tells whether it ends there.
ORDERS = (1, 2, 3, 5)
#: Bits, as a power of two, of the filter of grams that stand at an open end.
BITS = 24
#: Characters of the rows tagged at once.
STEP = 1 << 21
TAGS = ("answer", "courtesy", "refusal", "echo", "foreign", "unfinished")

_BLANK = regex.compile(BLANK)
#: Line ends, or a mark, which stays with its clause, and what parts it from the next one.  It
#: begins with one set of characters, for which Python searches fast.
_CLAUSE = re.compile(r"[.!?。！？\r\n](?:(?<=[\r\n])[\r\n]*|(?<=[.!?。！？])[)\"'»”’」]*\s+|(?<=[。！？])(?=[^\s」』”）)]))")
_WORD = re.compile(r"[一-鿿㐀-䶿]|[^\W\d_一-鿿㐀-䶿]+(?:['’][^\W\d_]+)*|\d+")
_BULLET = re.compile(r"^\s*(?:\d+[.)]|[-*•→>])\s+")
_FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)
_HAN_END = re.compile(r"[一-鿿]")
_END = re.compile(r"(?:[.!?。！？…][)\"'»”’」』\]*_]*|:\)|;\)|:-\)|[\U0001F300-\U0001FAFF☀-➿️]|[」』”\"])\s*$")
_LINK = re.compile(r"https?://\S+$|[\w./-]+\s*[>→]\s*\S+$|\]\([^)\s]+\)$|```$|\|$")
_OPEN = re.compile(r"\[[^\]]*$|\]\([^)]*$|[(（「『][^)）」』]*$|https?://[^\s/]*$")
_ASKED = {k: re.compile(v) for k, v in pools.LANGUAGE_NAMES.items()}


def _split(text: str) -> list[str]:
    """The clauses of a text, as they stand."""
    out, at = [], 0
    for m in _CLAUSE.finditer(text):
        i, to = m.span()
        out.append(text[at : i if text[i] in "\r\n" else i + 1])
        at = to
    out.append(text[at:])
    return out


def _ended(c: str) -> bool:
    """``_END``; the last character tells it of most clauses."""
    last = c.rstrip()[-1:]
    if not last or last.isalpha():
        return False
    return last in ".!?。！？…" or bool(_END.search(c))


class Codes(dict):
    """Numbers of words: in lower case; numbers and rare capitalised words (names) by their kind."""

    def __init__(self, common: set[str]):
        self.common = common

    def __missing__(self, w: str) -> int:
        if len(self) > 500_000:
            self.clear()
        token = "#" if w[0].isdigit() else "@" if w[0].isupper() and w.lower() not in self.common else w.lower()
        self[w] = n = int.from_bytes(hashlib.blake2b(token.encode("utf-8", "replace"), digest_size=8).digest(), "big")
        return n

    def __reduce__(self):
        return Codes, (self.common,)


def _grams(codes: np.ndarray, n: int) -> np.ndarray:
    """Numbers of all runs of ``n`` codes."""
    h = np.full(len(codes) - n + 1, n, np.uint64)
    for j in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[j : len(codes) - n + 1 + j]
    return (h ^ (h >> np.uint64(32))).view(np.int64)


class Ends:
    """How often the last words of clauses end one, among all their places: ``counts`` has
    (ends, places) of each gram."""

    def __init__(self, texts: list[str] = (), common: set[str] | None = None):
        if common is None:
            seen = Counter(w.lower() for t in texts for w in _WORD.findall(t))
            common = {w for w, n in seen.items() if n >= least(len(texts))}
        self.codes, self.counts = Codes(common), {}
        h, places, finals = self.count(texts)
        self.counts = {g: (f, k) for g, k, f in zip(h.tolist(), places.tolist(), finals.tolist())}

    def grams(self, clause: str) -> list[int]:
        """The clause's last words, as a number for each length it has."""
        w = np.array([self.codes[x] for x in _WORD.findall(clause)[-max(ORDERS) :]], np.uint64)
        return [int(_grams(w[-n:], n)[0]) for n in ORDERS if len(w) >= n]

    def count(self, texts: list[str], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(grams, places, ends) over all clauses; ``wanted`` is a filter by bit."""
        codes, code, sizes, marks, times = [], self.codes, [], [], []
        # each distinct clause once, for all its uses
        for c, uses in Counter(c for t in texts for c in _split(t)).items():
            if w := _WORD.findall(c):
                codes += [code[x] for x in w]
                sizes.append(len(w))
                marks.append(_ended(c))
                times.append(uses)
        flat, size = np.array(codes, np.uint64), np.array(sizes, np.int64)
        clause, last = np.repeat(np.arange(len(size)), size), np.cumsum(size) - 1
        mark = np.zeros(len(flat), bool)
        mark[last] = np.array(marks, bool)
        used = np.repeat(np.array(times, np.int64), size)
        found, ends, uses = [], [], []
        for n in ORDERS:
            if len(flat) < n:
                continue
            h = _grams(flat, n)
            keep = clause[: len(h)] == clause[n - 1 :]
            if wanted is not None:
                slot = h & ((1 << BITS) - 1)
                keep &= (wanted[slot >> 3] >> (slot & 7) & 1).astype(bool)
            found.append(h[keep])
            ends.append(mark[n - 1 :][keep])
            uses.append(used[n - 1 :][keep])
        h, at = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_inverse=True)
        if not len(h):
            return h, h, h
        weight = np.concatenate(uses)  # whole numbers far below 2^53, so their sums are exact
        return h, np.bincount(at, weight, len(h)).astype(np.int64), np.bincount(at, weight * np.concatenate(ends), len(h)).astype(np.int64)

    def features(self, grams: list[int], counts: dict[int, tuple[int, int]] | None = None) -> list[str]:
        out, counts = [], self.counts if counts is None else counts
        for n, g in zip(ORDERS, [*grams, *[None] * len(ORDERS)]):
            f, k = counts.get(g, (0, 0))
            r = f / k if k else -1
            out.append(f"end{n}=" + ("?" if r < 0 else "0" if r == 0 else "a" if r < 0.15 else "b" if r < 0.5 else "c" if r < 0.85 else "d"))
        return [*out, "ends=" + "".join(x[-1] for x in out)]


def least(rows: int) -> float:
    """The uses from which a capitalised word is no name: 12 in ``SAMPLE`` replies."""
    return 12 * max(1.0, rows / SAMPLE)


class Clause:
    """What a clause is by itself, whatever stands beside it."""

    __slots__ = ("bullet", "emission", "mark", "padded", "score", "tail", "words")

    def __init__(self, c: str):
        low = c.lower()
        self.words = _WORD.findall(low)
        self.padded = f" {' '.join(self.words)} "
        tail = " ".join(_WORD.findall(low.partition(": ")[2])) if ": " in c else ""
        self.tail = f" {tail} " if tail else ""
        self.mark, self.bullet = _ended(c), bool(_BULLET.match(c))
        self.score: list[float] = []
        self.emission: list[float] | None = None

    def own(self) -> list[str]:
        return ["bias", *(f"w={a}" for a in self.words), *(f"b={a} {b}" for a, b in zip(self.words, self.words[1:]))]

    def echo(self, padded: str, bag: set[str]) -> int:
        """How much of it stands in a message, as a place in ``ECHO``."""
        n = len(self.words)
        if not n:
            return 4
        same = sum(map(bag.__contains__, self.words))
        if same == n and (n >= 2 and self.padded in padded or self.padded == padded) or n >= 2 and self.tail and self.tail in padded:
            return 0
        return 1 if n >= 4 and same / n >= 0.85 else 2 if same / n >= 0.5 else 3


ECHO, ALIEN = ("echo=whole", "echo=most", "echo=half", "echo=no", ""), ("none", "0", "1", "2", "3")


class Message(NamedTuple):
    #: Its words between blanks, the set of them, and whether it is in each language.
    padded: str
    bag: set[str]
    spoken: list[bool]


class Placed(NamedTuple):
    """The clauses of many pairs by their places, one pair after another."""

    clauses: list[Clause]  # each distinct one once
    which: np.ndarray  # of each place, its clause
    sizes: np.ndarray  # of each pair, its places
    echo: np.ndarray  # of each place, in ECHO
    alien: np.ndarray  # of each place, in ALIEN
    whole: np.ndarray  # of each pair, in ALIEN
    endings: list[list[str]]  # of each pair


class Words:
    """The field's weights of words and word pairs, found by numbers."""

    def __init__(self, crf: CRF):
        rows = {f[2:]: i for f, i in crf.feature.items() if f.startswith("w=")}
        both = {tuple(f[2:].split(" ")): i for f, i in crf.feature.items() if f.startswith("b=")}
        self.number = {w: i for i, w in enumerate(sorted({*rows, *(w for b in both for w in b)}))}
        self.bias, self.weights = crf.feature.get("bias", -1), crf.weights
        self.rows = np.array([*(rows.get(w, -1) for w in self.number), -1])  # the last one: no known word
        codes = np.array([self.number[a] * len(self.rows) + self.number[b] for a, b in both] or [-1])
        order = np.argsort(codes)
        self.codes, self.pairs = codes[order], np.array([*both.values()] or [-1])[order]

    def emissions(self, clauses: list[Clause]) -> np.ndarray:
        """``CRF.emission`` of what each clause is by itself; scores are added in the same order."""
        n, get = len(clauses), self.number.get
        ids = np.array([get(w, -1) for c in clauses for w in c.words], np.int64)
        owner = np.repeat(np.arange(n), [len(c.words) for c in clauses])
        a, b = ids[:-1], ids[1:]
        both = (owner[:-1] == owner[1:]) & (a >= 0) & (b >= 0)
        code, at = a[both] * len(self.rows) + b[both], owner[:-1][both]
        k = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        rows = np.concatenate([np.full(n, self.bias), self.rows[ids], np.where(self.codes[k] == code, self.pairs[k], -1)])
        owners = np.concatenate([np.arange(n), owner, at])[rows >= 0]
        found = self.weights[rows[rows >= 0]]
        return np.stack([np.bincount(owners, w, n) for w in found.T], axis=1)


class Tagger:
    #: Clauses, and messages, kept for later and forgotten when there are too many; longer ones
    #: hardly come again.
    KEPT, KEPT_CHARS = 40_000, 400

    def __init__(self, lid: language.Model, ends: Ends):
        self.lid, self.ends, self.crf = lid, ends, CRF(TAGS)
        self.forget()

    def forget(self) -> None:
        """Drop all that is kept; needed after the field was fitted."""
        self.seen: dict[str, Clause] = {}
        self.asked: dict[str, Message] = {}
        self.rows: dict[str, np.ndarray] = {}
        self.words: Words | None = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "seen": {}, "asked": {}, "rows": {}, "words": None}

    def _keep(self, kept: dict, text: str, made: object) -> None:
        if len(text) <= self.KEPT_CHARS:
            if len(kept) >= self.KEPT:
                kept.clear()
            kept[text] = made

    def _clauses(self, texts: list[str]) -> list[Clause]:
        got = [self.seen.get(c) for c in texts]
        if new := [i for i, c in enumerate(got) if c is None]:
            made = [Clause(texts[i]) for i in new]
            # each scored alone; language.Model drops parts without letters
            lettered = [k for k, c in enumerate(made) if any(not w[0].isdecimal() for w in c.words)]
            scores = np.zeros((len(made), len(language.LANGS)))
            if lettered:
                scores[lettered] = self.lid.scores([texts[new[k]] for k in lettered])[0]
            for i, c, score in zip(new, made, scores.tolist()):
                c.score, got[i] = score, c
                self._keep(self.seen, texts[i], c)
        return got

    def _messages(self, texts: list[str]) -> list[Message]:
        """The words of messages, and their languages: those of which each holds some words together."""
        got = [self.asked.get(q) for q in texts]
        if new := [i for i, m in enumerate(got) if m is None]:
            spoken, parts, owner = np.zeros((len(new), len(language.LANGS)), bool), [], []
            for k, i in enumerate(new):
                for f in language.fragments(texts[i]):
                    parts.append(f)
                    if language._TOKEN.search(f.lower()):
                        owner.append(k)
            own = self.lid.scores(parts)[0]
            if len(own):
                total, top, at = np.zeros(spoken.shape, own.dtype), np.sort(own, axis=1), np.array(owner)
                np.add.at(total, at, own)
                held = np.unique(at)
                spoken[held, total[held].argmax(axis=1)] = True
                sure = top[:, -1] - top[:, -2] > 3
                spoken[at[sure], own.argmax(axis=1)[sure]] = True
            for i, said in zip(new, spoken.tolist()):
                low = texts[i].lower()
                asked = _WORD.findall(low)
                for k, p in _ASKED.items():
                    if p.search(low):
                        said[language.LANGS.index(k)] = True
                got[i] = made = Message(f" {' '.join(asked)} ", set(asked), said)
                self._keep(self.asked, texts[i], made)
        return got

    def clauses(self, reply: str) -> tuple[list[str], bool]:
        """(clauses, whether a code fence or bold text stays open); code is one clause with its mark."""
        fence = reply.count("```") % 2 == 1 or reply.count("**") % 2 == 1
        text = _FENCE.sub(" ``` ", reply) if "```" in reply else reply
        return [c for c in (x.strip() for x in _split(text)) if c and c != ">"], fence

    def _placed(self, rows: list[tuple[str, list[str], bool]], counts: list[dict] | None = None) -> Placed:
        """The clauses of (message, clauses, fence) by their places; every row has clauses."""
        number: dict[str, int] = {}
        which = [number.setdefault(c, len(number)) for _, parts, _ in rows for c in parts]
        clauses = self._clauses(list(number))
        asked: dict[str, int] = {}
        mine = [asked.setdefault(q, len(asked)) for q, _, _ in rows]
        messages = self._messages(list(asked))
        echo, endings, at = [], [], 0
        for i, (k, (_, parts, fence)) in enumerate(zip(mine, rows)):
            own = [clauses[j] for j in which[at : at + len(parts)]]
            at += len(parts)
            padded, bag, _ = messages[k]
            echo += [c.echo(padded, bag) for c in own]
            last = own[-1]
            bare = last.bullet and any(c.bullet and not c.mark for c in own[:-1])
            endings.append(self._ending(parts[-1], last.mark, last.bullet, bare, fence, counts[i] if counts else None))
        places, sizes = np.array(which), np.array([len(parts) for _, parts, _ in rows])
        scores, spoken = np.array([c.score for c in clauses])[places], np.array([m.spoken for m in messages])[mine]
        owner = np.repeat(np.arange(len(rows)), sizes)
        sums = np.stack([np.bincount(owner, s, len(rows)) for s in scores.T], axis=1)
        return Placed(clauses, places, sizes, np.array(echo), self._foreign(scores, spoken[owner]), self._foreign(sums, spoken), endings)

    def feature_lists(self, pairs: list[tuple[str, str]]) -> list[list[list[str]]]:
        """The features of each clause of each (message, reply)."""
        parsed = [(q, *self.clauses(a)) for q, a in pairs]
        out: list[list[list[str]]] = [[] for _ in parsed]
        if at := [i for i, (_, parts, _) in enumerate(parsed) if parts]:
            p = self._placed([parsed[i] for i in at])
            k = 0
            for i, n, whole, ending in zip(at, p.sizes.tolist(), p.whole.tolist(), p.endings):
                for j in range(k, k + n):
                    x = p.clauses[p.which[j]].own()
                    if ECHO[p.echo[j]]:
                        x.append(ECHO[p.echo[j]])
                    out[i].append([*x, f"alien={ALIEN[p.alien[j]]}", f"aliens={ALIEN[whole]}"])
                out[i][-1] += ending
                k += n
        return out

    def features(self, message: str, reply: str) -> tuple[list[list[str]], list[int]]:
        """Features and words of each clause of the reply."""
        return self.feature_lists([(message, reply)])[0], [len(c.words) for c in self._clauses(self.clauses(reply)[0])]

    def _row(self, feature: str) -> np.ndarray:
        row = self.rows.get(feature)
        if row is None:
            row = self.rows[feature] = self.crf.emission([feature])
        return row

    def _tagged(self, p: Placed) -> tuple[np.ndarray, np.ndarray]:
        """The tag, as a number, and the words of each place: the field on the features, whose
        words' scores are added up once for each clause."""
        if new := [c for c in p.clauses if c.emission is None]:
            self.words = self.words or Words(self.crf)
            for c, e in zip(new, self.words.emissions(new).tolist()):
                c.emission = e
        e = np.array([c.emission for c in p.clauses])[p.which]
        e += np.array([self._row(x) for x in ECHO])[p.echo]
        e += np.array([self._row(f"alien={x}") for x in ALIEN])[p.alien]
        e += np.repeat(np.array([self._row(f"aliens={x}") for x in ALIEN])[p.whole], p.sizes, axis=0)
        last = np.cumsum(p.sizes) - 1
        e[last] += np.array([self._row(x[0]) for x in p.endings])
        for i, x in zip(last.tolist(), p.endings):
            for f in x[1:]:
                e[i] += self._row(f)
        return self.crf.best_of(e, p.sizes), np.array([len(c.words) for c in p.clauses])[p.which]

    def tags(self, message: str, reply: str) -> tuple[list[str], list[int]]:
        """The tag and the words of each clause."""
        parts, fence = self.clauses(reply)
        if not parts:
            return [], []
        tags, sizes = self._tagged(self._placed([(message, parts, fence)]))
        return [TAGS[k] for k in tags], sizes.tolist()

    @staticmethod
    def _foreign(scores: np.ndarray, spoken: np.ndarray) -> np.ndarray:
        """How far texts are from the languages ``spoken``, as places in ``ALIEN``."""
        odds = scores.max(axis=1) - np.where(spoken, scores, -np.inf).max(axis=1)
        return np.where(spoken.any(axis=1) & scores.any(axis=1), 1 + (odds > 0) + (odds >= 3) + (odds >= 8), 0)

    @staticmethod
    def _closed(c: str, mark: bool, fence: bool) -> str | None:
        """How the last clause ends, None if only its words can tell."""
        if fence:
            return "last=fence"
        if not mark and _OPEN.search(c):
            return "last=open"
        if mark or _LINK.search(c):
            return "last=mark"
        return "last=comma" if c[-1] in ",;:，；：、-–—(（/" else None

    def open_grams(self, parts: list[str], fence: bool) -> list[int]:
        """``end_grams`` of a reply in clauses."""
        if not parts or self._closed(parts[-1], _ended(parts[-1]), fence):
            return []
        return self.ends.grams(parts[-1])

    def end_grams(self, reply: str) -> list[int]:
        """The grams at the end of a reply of which only the words tell whether it ends there."""
        return self.open_grams(*self.clauses(reply))

    def _ending(self, c: str, mark: bool, bullet: bool, bare: bool, fence: bool, counts: dict | None = None) -> list[str]:
        if closed := self._closed(c, mark, fence):
            return [closed]
        style = "last=bare" if bullet and bare else "last=bullet" if bullet else "last=no"
        return [style, *(f"{style},{f}" for f in self.ends.features(self.ends.grams(c), counts))]

    def defects(self, rows: list[tuple[str, list[str], bool]], counts: list[dict] | None = None) -> list[str | None]:
        """The defects of (message, the reply's clauses, fence), no side blank; ``counts`` has the
        counts of each row's own end grams."""
        out: list[str | None] = [None] * len(rows)
        at = [i for i, (_, parts, _) in enumerate(rows) if parts]
        if not at:
            return out
        p = self._placed([rows[i] for i in at], [counts[i] for i in at] if counts else None)
        tags, sizes = self._tagged(p)
        k, last = len(TAGS), np.cumsum(p.sizes) - 1
        said = np.bincount(np.repeat(np.arange(len(at)), p.sizes) * k + tags, np.maximum(1, sizes), len(at) * k).astype(np.int64).reshape(-1, k)
        # pairs of answers and courtesies alone have no defect
        for j in np.flatnonzero(said[:, [TAGS.index(x) for x in ("refusal", "echo", "foreign", "unfinished")]].any(axis=1)).tolist():
            out[at[j]] = self._verdict(rows[at[j]][0], dict(zip(TAGS, said[j].tolist())), TAGS[tags[last[j]]], int(sizes[last[j]]))
        return out

    @staticmethod
    def _verdict(message: str, said: dict[str, int], last: str, size: int) -> str | None:
        """The defect by the words of each tag and the last clause's tag and words."""
        told = sum(n for t, n in said.items() if t != "courtesy")
        if not told:
            return None
        if said["echo"] == told and said["echo"] >= 0.5 * len(_WORD.findall(message)):
            return "copies_question"
        if said["refusal"] and said["refusal"] + said["foreign"] + (said["unfinished"] if size <= 2 else 0) >= told:
            return "refusal"
        if said["foreign"] > 0.6 * (told - said["unfinished"]) and said["foreign"]:
            return "other_language"
        return "truncated" if last == "unfinished" else None

    def defect(self, message: str, reply: str) -> str | None:
        """The defect of a pair whose two sides are not blank."""
        return self.defects([(message, *self.clauses(reply))])[0]


_CHOICE = re.compile(r"\[([^\[\]]*)\]")
_BETWEEN_HAN = re.compile(r"(?<=[一-鿿，。]) +(?=[一-鿿，。？])")


def _made(lines: str, rng: random.Random, subject: str = "") -> str:
    """A sentence of a grammar of ``pools``."""
    s = _CHOICE.sub(lambda m: rng.choice(m[1].split("|")), rng.choice(lines.split("\n")).replace("{}", subject))
    s = re.sub(r" {2,}", " ", _BETWEEN_HAN.sub("", s))
    return re.sub(r"\s+([.,])", r"\1", s)


def _sentence(s: str) -> str:
    return s[:1].upper() + s[1:]


def _refusals(rng: random.Random, k: str, subject: str) -> str:
    core = _made(pools.REFUSALS[k], rng, subject).strip()
    lead = _made(pools.OPENERS[k], rng)
    s = _sentence(lead + core + _made(pools.CLOSERS[k], rng)) + ("。" if k == "zh" else ".")
    return s.upper() if rng.random() < 0.08 else s


def fit(rows: list[tuple[str, str]], lid: language.Model, seed: int = SEED, ends: Ends | None = None, count: Callable[[Tagger, set[int]], dict[int, tuple[int, int]]] | None = None) -> Tagger:
    """A tagger from (message, reply) rows, none of them blank.  ``count`` gives the counts of the
    grams at the open ends of the examples; without it they are counted on the rows."""
    rng = random.Random(seed)
    tagger = Tagger(lid, ends or Ends([a for _, a in rows]))
    by: dict[str, list[tuple[str, str]]] = {k: [] for k in language.LANGS}
    for q, a in rows[:FITTED]:
        found, other = language.decide(lid, q), language.decide(lid, a)
        if len(found) == 1 and len(other) == 1 and found[0][0] == other[0][0]:
            by[found[0][0]].append((q, a))
    made: list[tuple[str, str, Callable[[int], list[str]]]] = []

    def add(q: str, a: str, tags: Callable[[int], list[str]]) -> None:
        made.append((q, a, tags))

    full = [(k, q, a) for k, own in by.items() for q, a in own if _END.search(a) and len(tagger.clauses(a)[0]) >= 3 and _WORD.findall(q.lower())[:4] != _WORD.findall(a.lower())[:4]]
    some = [k for k in language.LANGS if by[k]] or ["en"]
    questions = {k: [q for q, _ in by[k]] or ["?"] for k in language.LANGS}
    for k, q, a in full:
        add(q, a, lambda n: ["answer"] * n)
        at = rng.randrange(min(10, len(a) - 1), len(a))
        cut = a[:at].rstrip()
        if cut and not _END.search(cut):
            add(q, cut, lambda n: ["answer"] * (n - 1) + ["unfinished"])
        if _BULLET.search(a.split("\n")[-1]):
            bare = re.sub(r"[.。]$", "", re.sub(r"[.。](?=\n)", "", a))
            for _ in range(5):  # complete ends far outnumber broken ones
                add(q, bare, lambda n: ["answer"] * n)
            if cut and not _END.search(cut) and rng.random() < 0.5:
                add(q, re.sub(r"[.。](?=\n)", "", cut), lambda n: ["answer"] * (n - 1) + ["unfinished"])
        if rng.random() < 0.6:
            word = rng.choice(_WORD.findall(q) or ["x"])
            opened, closed = rng.choice(((f"```\n{word} = https://host.example", "/a1\n```"), (f"[{word}](https://host.example/a1", "b2)"), (f"({word} {word}, https://host.example", ")"), (f"(https://host.example/{word}", ")"), (f"[{word} {word}", "](https://host.example/x)"), ("https://host", ".example/help"), (f"**{word} {word}", "**"), (f"**{word} https://host.example", "/x**")))
            add(q, f"{a}\n\n{opened}", lambda n: ["answer"] * (n - 1) + ["unfinished"])
            add(q, f"{a}\n\n{opened}{closed}", lambda n: ["answer"] * n)
        if rng.random() < 0.15:
            other = rng.choice([x for x in some if x != k] or [k])
            if other != k:
                add(rng.choice(questions[other]), a, lambda n: ["foreign"] * n)
        if rng.random() < 0.1:
            add(q, q.rstrip() + rng.choice([" ", "\n\n"]) + a, lambda n, m=len(tagger.clauses(a)[0]): ["echo"] * (n - m) + ["answer"] * m if n >= m else ["answer"] * n)
    for k in some:
        for _ in range(300):
            q = rng.choice(questions[k])
            parts, tags = [_refusals(rng, k, rng.choice(["gradebook", "calendar", "Kalender", "calendrier", "資源庫", "export dialog"]))], ["refusal"]
            if rng.random() < 0.4:
                parts.append(_sentence(_made(pools.COURTESIES[k], rng).strip()))
                tags.append("courtesy")
            if rng.random() < 0.3:
                parts.insert(0, _sentence(_made(pools.COURTESIES[k], rng).strip()))
                tags.insert(0, "courtesy")
            add(q, ("" if k == "zh" else " ").join(parts), lambda n, t=tags: t if n == len(t) else ["refusal"] * n)
        for _ in range(60):
            add(rng.choice(questions[k]), _sentence(_made(pools.ANSWERS[k], rng).strip()), lambda n: ["answer"] * n)
        for _ in range(60):
            q = rng.choice(questions[k])
            e = rng.choice([q, q, q.upper(), q.rstrip("?.!。？ "), "  ".join(q.split(" ")), q.lower()])
            lead = rng.choice(pools.ECHO_LEADS)
            add(q, lead + e + {"「": "」", '"': '"'}.get(lead, ""), lambda n: ["echo"] * n)
    if count:
        tagger.ends.counts = count(tagger, {g for _, a, _ in made for g in tagger.end_grams(a)})
    data = [(xs, tags(len(xs))) for xs, (_, _, tags) in zip(tagger.feature_lists([(q, a) for q, a, _ in made]), made) if xs]
    if data:
        tagger.crf.fit(data)
    tagger.forget()
    return tagger


def sample(history: DataFrame, limit: int = SAMPLE) -> list[tuple[str, str]]:
    """The rows to fit on, in the order of a hash of their id."""
    rows = history.select("id", "user_message", "bot_response").filter(f"length(user_message) <= {SAMPLE_CHARS} and length(bot_response) between 1 and {SAMPLE_CHARS}")
    got = hash_sample(rows, "id", limit, history.count()).collect()
    return [(q, a) for q, a in {r[0]: (r[1], r[2]) for r in got}.values() if not _BLANK.match(q) and not _BLANK.match(a)]


def _said(text: str | None) -> bool:
    return text is not None and not _BLANK.match(text)


def _mapped(df: DataFrame, ddl: str, f: Callable[[list], tuple]) -> DataFrame:
    """``f`` over the values of the last column of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in f([x for x in b.column(0).to_pylist() if _said(x)])], names=[n.split()[0] for n in ddl.split(", ")])

    return df.mapInArrow(run, ddl)


def common_words(replies: DataFrame) -> set[str]:
    """The words used often enough to be no names, over all replies.  They are few: each has a
    share of the words that does not fall with the number of replies."""

    def words(texts: list[str]) -> tuple:
        seen, found = Counter(), Counter()
        for t in texts:
            found.update(_WORD.findall(t))
        for w, n in found.items():
            seen[w.lower()] += n
        return pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())

    n = replies.agg(F.count("bot_response")).first()[0]
    seen = _mapped(replies, "w string, n long", words).groupBy("w").agg(F.sum("n").alias("n"))
    return {r[0] for r in seen.filter(F.col("n") >= least(n)).select("w").collect()}


def end_counts(history: DataFrame, tagger: Tagger, examples: set[int]) -> tuple[DataFrame, dict[int, tuple[int, int]]]:
    """((key, grams[(g, ends, places)]) of the open ends of all replies, counts of ``examples``),
    counted over all replies; the key is an end's longest gram."""
    spark, replies = history.sparkSession, history.select("bot_response")
    shared = spark.sparkContext.broadcast(tagger)

    def open_ends(texts: list[str]) -> tuple:
        got = {g[-1]: g for t in texts if (g := shared.value.end_grams(t))}
        return pa.array(got.keys(), pa.int64()), pa.array(got.values(), pa.list_(pa.int64()))

    ends = cut(_mapped(replies, "key long, gs array<long>", open_ends).dropDuplicates(["key"]).select("key", F.explode("gs").alias("g")))
    bits = np.zeros(1 << (BITS - 3), np.uint8)
    mask = (1 << BITS) - 1
    # at most one number for each bit of the filter comes to the driver
    for slot in [*(r[0] for r in ends.select((F.col("g").bitwiseAND(F.lit(mask))).cast("int").alias("s")).distinct().toLocalIterator()), *(g & mask for g in examples)]:
        bits[slot >> 3] |= 1 << (slot & 7)
    wanted = spark.sparkContext.broadcast(bits)
    counts = cut(_mapped(replies, "g long, k long, f long", lambda texts: shared.value.ends.count(texts, wanted.value)).groupBy("g").agg(F.sum("f").alias("f"), F.sum("k").alias("k")))
    own = spark.createDataFrame([(g,) for g in sorted(examples)], "g long")
    found = {r.g: (r.f, r.k) for r in counts.join(F.broadcast(own), "g").collect()}
    return ends.join(counts, "g").groupBy("key").agg(F.collect_list(F.struct("g", "f", "k")).alias("grams")), found


_MARKED = T.StructType([T.StructField(n, t) for n, t in (("id", T.StringType()), ("session_id", T.StringType()), ("created_at", T.TimestampNTZType()), ("asks", T.BooleanType()), ("answers", T.BooleanType()), ("defect", T.StringType()))])
_OPENED = T.StructType([*_MARKED.fields, *(T.StructField(n, t) for n, t in (("key", T.LongType()), ("user_message", T.StringType()), ("bot_response", T.StringType())))])


def _steps(*columns: list[str | None]) -> Iterator[range]:
    """Ranges of the rows of a batch of which each has ``STEP`` characters, or one row more."""
    lo = size = 0
    for i, texts in enumerate(zip(*columns)):
        size += sum(len(x) for x in texts if x)
        if size >= STEP:
            yield range(lo, i + 1)
            lo, size = i + 1, 0
    yield range(lo, len(columns[0]))


def marked(history: DataFrame, tagger: Tagger, ends: DataFrame | None = None) -> DataFrame:
    """Every row without its texts: whether each side says anything, and the pair's defect.  With
    ``ends``, the open ends are joined to their counts, else the tagger has them."""
    shared = history.sparkSession.sparkContext.broadcast(tagger)  # bounded by the sample
    names, joined = [f.name for f in _MARKED], ends is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for b in batches:
            asked, told = b.column(3).to_pylist(), b.column(4).to_pylist()
            asks, answers = [_said(q) for q in asked], [_said(a) for a in told]
            made: list[str | None] = ["empty_answer" if q and not a else None for q, a in zip(asks, answers)]
            keys: list[int | None] = [None] * len(made)
            for step in _steps(asked, told):
                at, rows = [], []
                for i in step:
                    if asks[i] and answers[i]:
                        parts, fence = t.clauses(told[i])
                        if grams := t.open_grams(parts, fence) if joined else []:
                            keys[i] = grams[-1]
                        else:
                            at.append(i)
                            rows.append((asked[i], parts, fence))
                for i, defect in zip(at, t.defects(rows)):
                    made[i] = defect
            opened = [[x if k is not None else None for x, k in zip(texts, keys)] for texts in (asked, told)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in (0, 1, 2)), *(pa.array(x, kind) for x, kind in zip((asks, answers, made, keys, *opened), (pa.bool_(), pa.bool_(), pa.string(), pa.int64(), pa.string(), pa.string())))], names=_OPENED.names)

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for b in batches:
            made = b.column("defect").to_pylist()
            asked, told, grams = (b.column(n).to_pylist() for n in ("user_message", "bot_response", "grams"))
            for step in _steps(asked, told):
                at = [i for i in step if told[i] is not None]
                counts = [{x["g"]: (x["f"], x["k"]) for x in grams[i] or ()} for i in at]
                for i, defect in zip(at, t.defects([(asked[i], *t.clauses(told[i])) for i in at], counts)):
                    made[i] = defect
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names[:-1]), pa.array(made, pa.string())], names=names)

    rows = history.select("id", F.coalesce("session_id", F.concat(F.lit("#"), "id")).alias("session_id"), F.col("created_at").cast("timestamp_ntz"), "user_message", "bot_response").mapInArrow(run, _OPENED)
    if ends is None:
        return rows.select(names)
    # rows without an open end are spread by their id and find nothing
    return rows.withColumn("key", F.coalesce("key", F.xxhash64("id", "session_id"))).join(ends, "key", "left").mapInArrow(rest, _MARKED)


def defects(history: DataFrame, tagger: Tagger | None = None, lid: language.Model | None = None, limit: int = HOT_ROWS) -> DataFrame:
    """(id, defect) of the defective pairs."""
    ends = None
    if tagger is None:

        def count(t: Tagger, examples: set[int]) -> dict[int, tuple[int, int]]:
            nonlocal ends
            ends, counts = end_counts(history, t, examples)
            return counts

        tagger = fit(sample(history), lid or language.fit([]), ends=Ends(common=common_words(history.select("bot_response"))), count=count)
    hot = any_hot(history.select("session_id").filter("session_id is not null"), "session_id", limit)
    rows = marked(history, tagger, ends)
    rows = rows.dropDuplicates(["session_id", "id"]) if hot else rows.repartition("session_id").dropDuplicates(["session_id", "id"])
    n = with_neighbours(rows, "session_id", "created_at", "id", ["asks", "answers"], hot, limit)
    later = F.col("created_at").isNotNull() & F.coalesce(F.col("_next.answers") & ~F.col("_next.asks"), F.lit(False))
    return n.filter(F.col("defect").isNotNull() & ~((F.col("defect") == "empty_answer") & later)).select("id", "defect")
