"""Noise in text from scanned pages (problem 2).

Method: candidates for a misread word come from an inverted join of character q-grams with the
known words; gradient-boosted trees rank them; line-pair classifiers decide whether a hyphen at
a line end parts a word, whether an edge line is furniture or a page number, and whether a line
goes on with the paragraph of the line before it.

1. A file is scanned if half of its chunks look like pages: lines broken by their width, in any
   script and case, or a printed number at an edge.  Every page of a scanned file is read.
2. Known words are counted over all chunks of other files, with their hyphenated compounds.  The
   ``LEXICON`` most frequent (of at least ``KNOWN``) go to all tasks and drop most words of a
   page; the rest is joined to the whole table.
3. Edge lines are counted per file on distinct pages under a key in which confusable letters
   are one, with their variants.  A line is running if it stands on ``PAGES`` pages and the
   classifier does not take it for body text; the more pages it is on, the less that counts.
4. Every distinct unknown word is joined by its rarest q-grams to known words and ranked; one
   that is ranked over ``SURE`` is misread, and its words are marked on all pages.
5. Repaired pages are joined into paragraphs over page ends (``continuous``).

The boosted trees are trained on known words spoilt by the confusions below and on unlike pairs;
the hyphen classifier on known words and compounds cut in two; the furniture classifier on
edge lines that stand on several pages of a file against inner lines; the page-number classifier
on edge parts whose value keeps its distance to ``page_number``; the classifier of line pairs on
born-digital texts broken at random widths.

Edge cases: null and empty content and null titles (each such chunk its own file) give no header;
repeated pages of equal content count as one page; pages of one line have one edge line at both
edges; a hot file is only ever aggregated, never collected; Han text has no misread words, as it
has no spaces, but all other noise; without born-digital files no word is known and none misread.
"""

from __future__ import annotations

import math
import random
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordered import HOT_ROWS, any_hot, with_neighbours, with_running_total
from ..session import cut, hash_sample, lookup
from .boost import Boosted, Logistic

LEXICON, KNOWN, SURE, Q, RAREST, PAGES, LIKE, SEED = 200_000, 2, 0.5, 3, 6, 3, 0.3, 3
#: Bounds of what is fitted on, of the gram order, of keys compared letter by letter, and pages
#: of a long paragraph that are joined at once.
SAMPLE, PER_FILE, SAMPLE_CHARS, GRAMS, LONG_KEY, STRETCH = 400, 16, 20_000, 200_000, 400, 64

#: What scanners read (left) for what is printed (right).
CONFUSIONS = (
    ("c", "e"), ("e", "c"), ("@", "a"), ("0", "o"), ("o", "0"), ("f", "t"), ("t", "f"), ("l", "i"), ("i", "l"), ("1", "l"), ("l", "1"), ("1", "i"), ("|", "l"), ("!", "i"),
    ("ri", "n"), ("n", "ri"), ("5", "s"), ("$", "s"), ("ii", "u"), ("u", "ii"), ("b", "h"), ("h", "b"), ("cl", "d"), ("d", "cl"), ("9", "g"), ("q", "g"), ("rn", "m"), ("m", "rn"),
    ("vv", "w"), ("w", "vv"), ("6", "é"), ("6", "ó"), ("6", "b"), ("8", "b"), ("3", "e"), ("a¨", "ä"), ("o¨", "ö"), ("u¨", "ü"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("li", "h"), ("tl", "d"), ("o", "a"), ("a", "o"), ("ß", "b"), ("b", "ß"), ("z", "2"), ("2", "z"),
)
_MARKS = "¬\u00ad‐‑-"
_PARTED = re.compile(rf"([^\W\d_@][^\s{_MARKS}]*(?:-[^\s{_MARKS}]+)*)[{_MARKS}][ \t]*\r?\n[ \t]*([^\W_][^\s.,;:!?()\[\]\"“”]*)")
_INSIDE = r"[^\s.,;:?()\[\]\"“”«»·|/–—_‹›<>=#*`{}~\\、。，！？：；「」一-鿿㐀-䶿-]"
_MARKED_END = re.compile(rf"[{_MARKS}][ \t]*\r?\n")
_TOKEN = re.compile(rf"(?:(?=[^_一-鿿㐀-䶿])\w|[@$])(?:{_INSIDE}*(?:(?=[^_一-鿿㐀-䶿])\w|[@$¨]))?")
_COMPOUND = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)+")
_N = r"(?:[0-9]|(?<![^\W_])[lIO](?=[0-9])|(?<=[0-9])[lIOoSB]){1,5}|(?<![^\W_])[lI](?![^\W_])"
_NUMBER = re.compile(rf"^[^\w]*(?:page|seite|página|pagina|pág|pag|pg|p|s|f)?\.?\s*(?:{_N})(?:\s*(?:of|de|von|sur|/|out of)\s*(?:{_N}|[0-9lIO]+))?[^\w]*$", re.I)
_DIGIT = re.compile(r"[0-9]|(?<![^\W_])[lI](?![^\W_])")
_STOPS = tuple(".!?:。！？：")
_ITEM = re.compile(r"\s*(?:[-*•·>|#]|\d+[.)]\s|[a-z][)]\s)")
_HAN = re.compile(r"[一-鿿㐀-䶿]")
_BASE = re.compile(r"['’]s$|^[ldjnmcst]['’]|^qu['’]")
#: Text to learn line pairs from where no born-digital text is at hand.
_FALLBACK = ["\n".join(["A long paragraph about nothing in particular runs over several lines of a page until it ends here."] * 3 + ["A short one."] + ["Another paragraph that goes on and on, with commas, names such as Anna or Rome, and numbers like 12 or 300."] * 3)] * 6
_GAP = re.compile(r"\s{2,}|\t+")
_CODED = re.compile(r"^\d+$|^v\d+$|^[a-z]?\d+[a-z]?$|^\d+(?:st|nd|rd|th|er|e|º|ª)$", re.I)
_MIXED_NUMBER = re.compile(r"^(?=.*\d)[\dOlIoSB]+$")

_DIGRAPHS = re.compile("rn|ri|ci|vv|[aou]¨")
_PAIRS = {"rn": "m", "ri": "n", "ci": "d", "vv": "w", "a¨": "ä", "o¨": "ö", "u¨": "ü"}
_ONE = str.maketrans({"e": "c", "é": "c", "3": "c", "6": "c", "@": "a", "0": "o", "ó": "o", "f": "t", "l": "i", "1": "i", "|": "i", "!": "i", "5": "s", "$": "s", "b": "h", "8": "h", "9": "g", "q": "g"})


def canonical(word: str) -> str:
    """One spelling for all that scanners confuse."""
    word = word.lower().replace("ﬁ", "fi").replace("ﬂ", "fl").translate(_ONE)
    return _DIGRAPHS.sub(lambda m: _PAIRS[m[0]], word.replace("ii", "u"))


def shapes_of(word: str) -> set[str]:
    """Both spellings that come of letters which overlap in two confusions."""
    w = word.lower().replace("ﬁ", "fi").replace("ﬂ", "fl").translate(_ONE)
    return {canonical(word), _DIGRAPHS.sub(lambda m: _PAIRS[m[0]], w).replace("ii", "u")}


def edit_cost(read: str, true: str) -> float:
    """Edit distance in which a confusion costs 0.25."""
    n, m = len(read), len(true)
    d = [[1e9] * (m + 1) for _ in range(n + 1)]
    d[0][0] = 0.0
    for i in range(n + 1):
        for j in range(m + 1):
            here = d[i][j]
            if here > 4:
                continue
            if i < n and j < m:
                d[i + 1][j + 1] = min(d[i + 1][j + 1], here + (read[i] != true[j]))
            if i < n:
                d[i + 1][j] = min(d[i + 1][j], here + 1)
            if j < m:
                d[i][j + 1] = min(d[i][j + 1], here + 1)
            for a, b in _BY_FIRST.get(read[i] if i < n else "", ()):
                if read.startswith(a, i) and true.startswith(b, j):
                    d[i + len(a)][j + len(b)] = min(d[i + len(a)][j + len(b)], here + 0.25)
    return min(d[n][m], 9.0)


_BY_FIRST: dict[str, list[tuple[str, str]]] = {}
for _a, _b in CONFUSIONS:
    _BY_FIRST.setdefault(_a[0], []).append((_a, _b))


def spoil(word: str, rng: random.Random, times: int = 1) -> str:
    """``word`` as a scanner might read it."""
    for _ in range(times):
        at = [(i, a, b) for a, b in CONFUSIONS for i in range(len(word)) if word.startswith(b, i)]
        if at:
            i, a, b = rng.choice(at)
            word = word[:i] + a + word[i + len(b) :]
    return word


def laid_out(text: str) -> bool:
    """Whether lines are broken by their width: in two line pairs at least, a line about as long
    as the long ones doesn't end a sentence and the next one is no list item.  The letters'
    case and script and the width don't matter."""
    if text.count("\n") < 2:
        return False
    lines = [x.rstrip() for x in text.split("\n")]
    sizes = sorted(len(x) for x in lines if x)
    if len(sizes) < 3:
        return False
    full = max(9.0, 0.75 * sizes[int(0.8 * (len(sizes) - 1))])
    return sum(1 for a, b in zip(lines, lines[1:]) if len(a) >= full and b and a[-1] not in _STOPS and not _ITEM.match(b)) >= 2


def page_like(text: str) -> bool:
    """Whether a chunk looks like a page as a scanner reads it: laid out lines, or a printed
    number at an edge."""
    if laid_out(text):
        return True
    t = text.strip("\ufeff \t\r\n")
    lo, hi = t.find("\n"), t.rfind("\n")
    return lo >= 0 and any(len(x) <= 40 and _NUMBER.match(x.strip()) for x in (t[:lo], t[hi + 1 :]))


def fold(word: str) -> str:
    """``word`` with joined letters, detached marks and look-alikes of digits put right."""
    low = word.lower().replace("ﬁ", "fi").replace("ﬂ", "fl").replace("a¨", "ä").replace("o¨", "ö").replace("u¨", "ü")
    if low == "@":
        return "a"
    return "".join({"o": "0", "l": "1", "i": "1", "s": "5", "b": "8"}.get(c, c) for c in low) if _MIXED_NUMBER.match(word) else low


def pair_features(read: str, true: str, count: int) -> list[float]:
    """Features of a pair (word as read, known word)."""
    low = read.lower()
    cost = edit_cost(low, true)
    odd = sum(not c.isalpha() for c in low)
    return [cost, float(abs(len(low) - len(true))), float(len(true)), math.log1p(count), float(odd), float(odd > 0 and not low[-1:].isdigit()), float(read[:1].isupper() and true[:1].islower()), float(canonical(low) == canonical(true)), float(low[:1] == true[:1]), cost / max(1, len(true)), float(true.isdigit()), float(any(c in "ﬁﬂ¨" for c in low))]


def fit_ranker(lexicon: dict[str, int], seed: int = SEED) -> Boosted:
    """Spoilt known words against their word; unlike pairs and unspoilt changes against it."""
    rng = random.Random(seed)
    words = [w for w in sorted(lexicon) if 3 <= len(w) <= 20 and w.isalpha()]
    if not words:
        words = ["page", "paper", "line", "chapter", "letter", "reader", "word"]
    some = words if len(words) <= 700 else rng.sample(words, 700)
    letters = "abcdefghijklmnopqrstuvwxyz"
    x, y = [], []
    for w in some:
        for times in (1, 1, 2):
            s = spoil(w, rng, times)
            if s != w and s.lower() not in lexicon:
                x.append(pair_features(s if rng.random() < 0.85 else s.capitalize(), w, lexicon.get(w, 1)))
                y.append(1.0)
                v = rng.choice(words)
                x.append(pair_features(s, v, lexicon.get(v, 1)))
                y.append(0.0)
        # a word or name that differs by letters nobody confuses
        for _ in range(3):
            k = rng.randrange(len(w))
            c = rng.choice(letters)
            s = w[:k] + c + w[k + 1 :] if rng.random() < 0.6 else w[:k] + w[k + 1 :] if rng.random() < 0.5 else w[:k] + c + w[k:]
            if s and s != w and edit_cost(s, w) >= 1:
                x.append(pair_features(s.capitalize() if rng.random() < 0.6 else s, w, lexicon.get(w, 1)))
                y.append(0.0)
    # numbers with letters in them and joined letters, against codes that are meant so
    for _ in range(150):
        n = str(rng.randrange(10, 10 ** rng.randint(2, 5)))
        at = [i for i, c in enumerate(n) if c in "0158"]
        if at:
            k = rng.choice(at)
            read = n[:k] + {"0": rng.choice("Oo"), "1": rng.choice("lI"), "5": "S", "8": "B"}[n[k]] + n[k + 1 :]
            x.append(pair_features(read, n, 0))
            y.append(1.0)
        c = rng.choice(letters) + str(rng.randrange(1, 9)) + rng.choice(letters)
        x.append(pair_features(c, fold(c), 0))
        y.append(0.0)
        w = rng.choice(words)
        k = rng.randrange(len(w))
        c = w[:k] + str(rng.randrange(2, 9)) + w[k + 1 :]
        if canonical(c) != canonical(w):
            x.append(pair_features(c, c, 0))
            y.append(0.0)
    for a, b in [("ﬁ", "fi"), ("ﬂ", "fl"), ("a¨", "ä"), ("o¨", "ö"), ("u¨", "ü")] * 8:
        w = rng.choice(words)
        k = rng.randrange(len(w))
        x.append(pair_features(w[:k] + a + w[k:], w[:k] + b + w[k:], 0))
        y.append(1.0)
    x += [pair_features("@", "a", 0)] * 20
    y += [1.0] * 20
    return Boosted().fit(np.array(x), np.array(y))


def hyphen_features(left: str, mark: str, right: str, lexicon: dict[str, int], compounds: dict[str, int], shapes: set[str]) -> list[float]:
    a, b = left.lower(), right.lower().rstrip("'’")
    tail = a.split("-")[-1]
    glued = a + b
    hyphen = compounds.get(f"{a}-{b}", 0) + compounds.get(f"{tail}-{b.split('-')[0]}", 0)
    known = lexicon.get(tail + b.split("-")[0], 0) + lexicon.get(glued, 0)
    return [math.log1p(known), math.log1p(hyphen), float(tail in lexicon), float(b in lexicon), float(mark != "-"), float(canonical(tail + b) in shapes), float(right[:1].isupper()), float(canonical(f"{tail}-{b}") in shapes)]


def fit_hyphens(lexicon: dict[str, int], compounds: dict[str, int], shapes: set[str], seed: int = SEED) -> Logistic:
    rng = random.Random(seed)
    words = [w for w in sorted(lexicon) if len(w) >= 5 and w.isalpha()]
    x, y = [], []
    for w in words if len(words) <= 1500 else rng.sample(words, 1500):
        k = rng.randrange(2, len(w) - 1)
        mark = rng.choice("---¬­")
        x.append(hyphen_features(w[:k], mark, w[k:] if rng.random() < 0.8 else spoil(w[k:], rng), lexicon, compounds, shapes))
        y.append(1.0)
    pairs = sorted(compounds) or ["read-only", "co-author", "step-by-step"]
    for _ in range(max(1, len(x) // max(1, len(pairs)))):
        for c in pairs[:1500]:
            at = [i for i, ch in enumerate(c) if ch == "-"]
            k = rng.choice(at)
            r = c[k + 1 :] if rng.random() < 0.8 else spoil(c[k + 1 :], rng)
            if r:
                x.append(hyphen_features(c[:k], "-", r, lexicon, {**compounds, c: compounds.get(c, 1)} if c not in compounds else compounds, shapes))
                y.append(0.0)
    return Logistic().fit(np.array(x), np.array(y))


def _alike_number(fragment: str, neighbour: str | None, width: float, alone: bool) -> bool:
    return bool(_NUMBER.match(fragment))


def edges(text: str, number=_alike_number) -> dict:
    """The edge lines of a page without printed numbers, the lines inside of them, and where
    numbers stand.  ``number`` decides on a part of an edge line and the line next to it."""
    lines = [x.strip("﻿ \t\r") for x in text.split("\n")]
    lines = [x for x in lines if x]
    width = float(np.median([len(x) for x in lines])) if lines else 1.0
    out = {"first": None, "last": None, "beside_first": None, "beside_last": None, "number_first": False, "number_last": False, "inner": lines, "width": width}

    def take(side: int, name: str) -> None:
        """Drop a lone number at the edge, or cut one from the edge line."""
        beside = (lambda: lines[1 if side == 0 else -2] if len(lines) > 1 else None)
        if lines and number(lines[side], beside(), width, True):
            out[f"number_{name}"] = True
            lines.pop(side)
        if not lines:
            return
        line = lines[side]
        out[f"beside_{name}"] = beside()
        parts = _GAP.split(line)
        if len(parts) > 1:
            for k, rest in ((0, parts[1:]), (-1, parts[:-1])):
                if number(parts[k], "  ".join(rest), width, False):
                    out[f"number_{name}"] = True
                    line = "  ".join(rest)
                    break
        out[name] = line

    take(0, "first")
    take(-1, "last")
    return out


def line_key(line: str) -> str:
    """Key of a running line: confusable letters are one, only letters and digits count.  Keys
    of more than ``LONG_KEY`` characters are hashed whole, so such lines are compared exactly."""
    key = re.sub(r"[^\w]", "", canonical(unicodedata.normalize("NFC", line)))
    return key if len(key) <= LONG_KEY else f"#{xxhash.xxh3_128_hexdigest(key)}"


def furniture_features(line: str, beside: str | None, title: str | None, width: float, top: bool) -> list[float]:
    """Features of the pair of an edge line and the line next to it on its page."""
    ws = [canonical(w) for w in _TOKEN.findall(line)]
    named = {canonical(w) for w in _TOKEN.findall((title or "").replace("_", " "))} - {"pdt", "pdf", canonical("pdf")}
    letters = [c for c in line if c.isalpha()]
    upper, lower = (line, beside or "") if top else (beside or "", line)
    return [
        sum(w in named for w in ws) / max(1, len(ws)),
        float(line[:1].islower()),
        float(line[-1:] in ".!?,;。，；"),
        sum(c.isupper() for c in letters) / max(1, len(letters)),
        min(3.0, len(line) / max(1.0, width)),
        float(any(c in line for c in "|·(")),
        float(line[-1:].isdigit()),
        float(lower[:1].islower()),
        float(upper[-1:] in _STOPS),
        float(len(upper) + 1 + len(lower.split(" ", 1)[0]) <= width),
        float(beside is None),
    ]


def number_features(fragment: str, beside: str | None, width: float, alone: bool) -> list[float]:
    """Features of the pair of a possible page number and the line, or rest of it, beside it."""
    n = max(1, len(fragment))
    return [
        float(bool(_NUMBER.match(fragment))),
        sum(c.isdigit() for c in fragment) / n,
        min(3.0, sum(c.isalpha() for c in fragment) / 10),
        min(2.0, n / max(1.0, width)),
        float(alone),
        float((beside or "")[-1:] in _STOPS),
        float(fragment[-1:] in ".!?,;。"),
    ]


def join_features(a: str, b: str, width: float) -> list[float]:
    """Features of a line pair inside a page, of which the second may go on with the first."""
    word = b.split(" ", 1)[0]
    return [
        min(2.0, len(a) / max(1.0, width)),
        float(a[-1:] in _STOPS),
        float(a[-1:] in ",;，；、-"),
        float(b[:1].islower()),
        float(bool(_ITEM.match(b))),
        float(b[:1].isupper()),
        float(len(a) + 1 + len(word) <= width),
        float(bool(_HAN.match(a[-1:] or " ")) and bool(_HAN.match(b[:1] or " "))),
        float(bool(_ITEM.match(a))),
        min(2.0, len(b) / max(1.0, width)),
    ]


def number_value(fragment: str) -> int | None:
    m = re.search(r"[0-9lIOoSB]*[0-9][0-9lIOoSB]*", fragment)
    return int(m[0].translate(str.maketrans("lIOoSB", "110058"))) if m and len(m[0]) < 8 else None


def fit_numbers(pages: dict[str, list[tuple[int | None, str]]], seed: int = SEED) -> Logistic:
    """The page-number classifier.  In the sampled ``pages`` of a file, an edge part whose value
    keeps a constant distance to the page's place is a number, other edge parts and inner lines
    are none; made-up ones are added, so that there are always some."""
    rng = random.Random(seed)
    x, y = [], []
    for own in pages.values():
        seen, inner = [], []
        for place, text in own:
            lines = [z for z in (w.strip("﻿ \t\r") for w in text.split("\n")) if z]
            if not lines:
                continue
            width = float(np.median([len(z) for z in lines]))
            for side in (0, -1):
                beside = lines[1 if side == 0 else -2] if len(lines) > 1 else None
                parts = _GAP.split(lines[side])
                for part, by, alone in [(lines[side], beside, True), *((z, None, False) for z in parts[:1] + parts[1:][-1:] if len(parts) > 1)]:
                    v = number_value(part)
                    seen.append((None if v is None or place is None else v - place, number_features(part, by, width, alone), len(part)))
            inner += [number_features(z, n, width, True) for z, n in zip(lines[2:-2], lines[3:])][:4]
        offset, n = Counter(o for o, _, _ in seen if o is not None).most_common(1)[0] if any(o is not None for o, _, _ in seen) else (None, 0)
        for o, f, size in seen:
            if n >= PAGES and o == offset and size <= 40 or o is None:
                x.append(f)
                y.append(float(o is not None))
        x += inner
        y += [0.0] * len(inner)
    for _ in range(60):
        k, m = rng.randrange(1, 400), rng.randrange(400, 900)
        for form in ("{}", "- {} -", "Page {}", "p. {}", "{} / {}", "Seite {} von {}", "Página {}", "[{}]", "Page {} of {}"):
            s = form.format(k, m)
            if rng.random() < 0.1:
                s = s.replace("1", "l", 1)
            x.append(number_features(s, rng.choice(["It ends here.", "and goes on with", None]), 50.0, rng.random() < 0.7))
            y.append(1.0)
        for form in ("Step {}", "Chapter {}", "{} MB.", "in {} days", "Version {}.{}", "Room {}b and {}", "until {}, when it", "It ends with {}."):
            x.append(number_features(form.format(k, m), rng.choice(["It ends here.", "and goes on with", None]), 50.0, rng.random() < 0.7))
            y.append(0.0)
    return Logistic().fit(np.array(x), np.array(y))


def fit_joins(texts: list[str], seed: int = SEED) -> Logistic:
    """The classifier of line pairs, from born-digital texts broken at random widths."""
    rng = random.Random(seed)
    x, y = [], []
    for t in texts or _FALLBACK:
        width = rng.randrange(28, 100)
        before: str | None = None
        for p in (z.strip() for z in re.split(r"[\r\n]+", t[:SAMPLE_CHARS])):
            if not p:
                continue
            lines, cur = [], ""
            for w in p.split() if " " in p else [p[i : i + width // 2] for i in range(0, len(p), max(1, width // 2))]:
                if cur and len(cur) + len(w) + 1 > width:
                    lines.append(cur)
                    cur = w
                else:
                    cur = f"{cur} {w}".strip()
            lines.append(cur)
            pairs = [(a, b, 1.0) for a, b in zip(lines, lines[1:])] + ([(before, lines[0], 0.0)] if before else [])
            x += [join_features(a, b, float(width)) for a, b, _ in pairs]
            y += [k for _, _, k in pairs]
            before = lines[-1]
    return Logistic().fit(np.array(x), np.array(y)) if 0 < sum(y) < len(y) else (Logistic() if not texts else fit_joins([], seed))


class Scanner:
    """All that was learnt before pages are read."""

    def __init__(self, lexicon: dict[str, int], compounds: dict[str, int], texts: list[str] = ()):
        self.lexicon, self.compounds = lexicon, compounds
        self.shapes = {canonical(w) for w in lexicon} | {canonical(c) for c in compounds}
        self.hyphens = fit_hyphens(lexicon, compounds, self.shapes)
        self.furniture, self.numbers, self.lines = Logistic(), fit_numbers({}), fit_joins(list(texts))

    def number(self, fragment: str, beside: str | None, width: float, alone: bool) -> bool:
        if len(fragment) > 60 or not _DIGIT.search(fragment):
            return False
        return bool(self.numbers.predict(np.array([number_features(fragment, beside, width, alone)]))[0] >= 0.5)

    def joins(self, text: str) -> list[tuple[int, int, str, bool]]:
        """(begin, end, glued, whether the mark parts a word) of the marks at line ends."""
        if not _MARKED_END.search(text):
            return []
        found = [(m.start(1), m.end(2), m[1], text[m.end(1)], m[2]) for m in _PARTED.finditer(text)]
        if not found:
            return []
        x = np.array([hyphen_features(a, k, b, self.lexicon, self.compounds, self.shapes) for _, _, a, k, b in found])
        p = self.hyphens.predict(x)
        return [(lo, hi, a + b if q >= 0.5 else f"{a}-{b}", bool(q >= 0.5)) for (lo, hi, a, _, b), q in zip(found, p)]

    def glue(self, text: str) -> tuple[str, bool]:
        """Text with parted words in one piece; whether there was one."""
        out, at, any_ = [], 0, False
        for lo, hi, glued, parts in self.joins(text):
            if lo < at:
                continue
            out += [text[at:lo], glued]
            at, any_ = hi, any_ or parts
        return "".join([*out, text[at:]]), any_

    def unknown(self, line: str) -> list[str]:
        out = []
        for w in _TOKEN.findall(line):
            low = w.lower()
            if w == "@":
                out.append(w)
            if low in self.lexicon or len(low) < 2 or _CODED.match(w):
                continue
            if not any(c.isalpha() for c in low) and "@" not in low and "$" not in low:
                continue
            base = _BASE.sub("", low)
            if base in self.lexicon or len(base) < 2:
                continue
            out.append(w)
        return out

    def goes_on(self, pairs: list[tuple[str, str]], width: float) -> list[bool]:
        """Whether the second line of each pair goes on with the paragraph of the first."""
        if not pairs:
            return []
        return [bool(p >= 0.5) for p in self.lines.predict(np.array([join_features(a, b, width) for a, b in pairs]))]


def _file(chunks: DataFrame) -> DataFrame:
    return chunks.select("id", F.coalesce(F.concat(F.lit("t"), "document_title"), F.concat(F.lit("i"), "id")).alias("file"), F.col("page_number").cast("long"), "content").filter("id is not null and content is not null")


def scanned_files(chunks: DataFrame) -> DataFrame:
    """(file, pages) of the files of which at least half of the chunks look like pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total: dict[str, list[int]] = {}
            for f, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n = total.setdefault(f, [0, 0])
                n[0] += 1
                n[1] += page_like(t)
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), *(pa.array([n[k] for n in total.values()], pa.int64()) for k in (0, 1))], names=["file", "pages", "like"])

    counts = _file(chunks).select("file", "content").mapInArrow(run, "file string, pages long, like long")
    return cut(counts.groupBy("file").agg(F.sum("pages").alias("pages"), F.sum("like").alias("like")).filter("2 * like >= pages").select("file", "pages"))


def known_words(chunks: DataFrame, files: DataFrame, limit: int = LEXICON, least: int = KNOWN) -> tuple[dict[str, int], dict[str, int], DataFrame]:
    """(frequent words, frequent hyphenated compounds, all words (word, n)) of the chunks outside
    the scanned ``files``.  At most ``limit`` of them come to the driver; the table has all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
        for b in batches:
            for t in b.column(0).to_pylist():
                low = t.lower()
                total.update(_TOKEN.findall(low))
                if "-" in low:
                    total.update("=" + c for c in _COMPOUND.findall(low))
            if len(total) > 500_000:
                yield batch()
                total.clear()
        yield batch()

    born = lookup(_file(chunks).select("file", "content"), files.select("file"), ["file"], "left_anti").select("content")
    counts = cut(born.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least))
    # the least count at which at most ``limit`` words are left, from a histogram of counts
    words = 0
    for n, k in sorted(((r[0], r[1]) for r in counts.groupBy(F.least("n", F.lit(4096)).alias("n")).count().collect()), reverse=True):
        words += k
        if words > limit:
            least = n + 1
            break
    rows = counts.filter(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(limit).collect()
    return {r[0]: r[1] for r in rows if r[0][0] != "="}, {r[0][1:]: r[1] for r in rows if r[0][0] == "="}, counts.filter("word not like '=%'")


_PAGE = T.StructType(
    [T.StructField(n, t) for n, t in (("id", T.StringType()), ("file", T.StringType()), ("page", T.LongType()), ("hyphenation", T.BooleanType()), ("number", T.BooleanType()), ("first", T.StringType()), ("last", T.StringType()), ("like_first", T.DoubleType()), ("like_last", T.DoubleType()))]
    + [T.StructField(n, T.ArrayType(T.StringType())) for n in ("odd", "odd_first", "odd_last")]
)
_PAGE_TYPES = [pa.string(), pa.string(), pa.int64(), *[pa.bool_()] * 2, *[pa.string()] * 2, *[pa.float64()] * 2, *[pa.list_(pa.string())] * 3]


def _page(s: Scanner, key: str, file: str, text: str) -> tuple:
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    e = edges(text, s.number)
    lines = e["inner"]
    glued, parted = s.glue(text)
    first, last = e["first"], e["last"]
    body = [x.strip() for x in glued.split("\n")]
    body = [x for x in body if x and not _NUMBER.match(x)]
    like = [1.0, 1.0]  # without a classifier the count of pages decides alone
    if len(s.furniture.w) and (some := [n for n in ("first", "last") if e[n]]):
        p = s.furniture.predict(np.array([furniture_features(e[n], e[f"beside_{n}"], file[1:], e["width"], n == "first") for n in some]))
        for n, q in zip(some, p):
            like[n == "last"] = float(q)
    odd_first = s.unknown(body[0]) if body else []
    odd_last = s.unknown(body[-1]) if len(body) > 1 else []
    odd = [w for x in body[1:-1] for w in s.unknown(x)]
    return (key, file, xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) >> 1, parted, e["number_first"] or e["number_last"], line_key(first) if first else None, line_key(last) if last and len(lines) > 1 else None, like[0], like[1], sorted(set(odd)), sorted(set(odd_first)), sorted(set(odd_last)))


def pages(chunks: DataFrame, files: DataFrame, scanner: Scanner) -> DataFrame:
    """What every page of the scanned ``files`` shows; its text stays behind."""
    shared = chunks.sparkSession.sparkContext.broadcast(scanner)  # bounded by LEXICON

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [_page(shared.value, key, file, text) for key, file, text in zip(*(c.to_pylist() for c in b.columns))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(_PAGE_TYPES)], names=_PAGE.names)

    return lookup(_file(chunks).select("id", "file", "content"), files.select("file"), ["file"], "left_semi").mapInArrow(run, _PAGE)


def running_lines(scanned: DataFrame) -> DataFrame:
    """(file, edge, key) of the running lines, variants by misread characters included.

    A key's variants are those near the most frequent key of a block of equal beginnings or
    ends, so every key is compared with two others at most.  The pages of all variants count."""
    e = F.inline(F.array(F.struct(F.lit("first").alias("edge"), F.col("first").alias("key"), F.col("like_first").alias("like")), F.struct(F.lit("last").alias("edge"), F.col("last").alias("key"), F.col("like_last").alias("like"))))
    lines = scanned.select("file", "page", e).filter("key is not null and key != ''")
    # distinct pages by a set aggregation of page hashes: partial counts first
    keys = cut(lines.groupBy("file", "edge", "key", "page").agg(F.avg("like").alias("like")).groupBy("file", "edge", "key").agg(F.count("*").alias("n"), F.avg("like").alias("like")))
    blocks = keys.withColumn("block", F.explode(F.array_distinct(F.array(F.concat(F.lit("<"), F.substring("key", 1, 6)), F.concat(F.lit(">"), F.expr("right(key, 6)"))))))
    anchors = cut(blocks.groupBy("file", "edge", "block").agg(F.max_by("key", F.struct("n", "key")).alias("anchor")))
    bound = F.greatest(F.least(F.lit(2), F.floor(F.length("anchor") / 3)), F.floor(0.12 * F.length("anchor")))
    apart = F.levenshtein("key", "anchor", LONG_KEY // 8)
    near = lookup(blocks, anchors, ["file", "edge", "block"], "inner").filter((apart >= 0) & (apart <= bound)).select("file", "edge", "key", "anchor", "n", "like")
    near = near.unionByName(keys.withColumn("anchor", F.col("key")).select(near.columns)).distinct()
    sums = near.groupBy("file", "edge", "anchor").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("like")) / F.sum("n")).alias("like"))
    # the more pages a line stands on, the less it must look like furniture
    enough = F.col("like") * (F.col("n") - PAGES + 1) * (F.col("n") - PAGES + 1) >= LIKE
    strong = cut(sums.filter((F.col("n") >= PAGES) & enough).select("file", "edge", "anchor"))
    return lookup(near.select("file", "edge", "key", "anchor"), strong, ["file", "edge", "anchor"], "left_semi").select("file", "edge", "key").distinct()


def unknown_words(words: DataFrame, known: DataFrame) -> DataFrame:
    """The ``words`` that aren't in the whole table of known words, alone or without an elision."""
    low = F.lower("word")
    w = words.select("word", low.alias("_low"), F.regexp_replace(low, _BASE.pattern, "").alias("_base"))
    for c in ("_low", "_base"):
        w = w.join(known.select(F.col("word").alias(c)), c, "left_anti")
    return w.select("word")


def misread_words(words: DataFrame, scanner: Scanner, known: DataFrame | None = None) -> DataFrame:
    """(word, correction) of the distinct ``words`` that are misread.

    A word and its correction differ by one edit at most once confusable letters are one, which
    spoils ``Q`` grams; so one of the word's ``RAREST`` > ``Q`` rarest grams is the correction's,
    whose grams are all indexed.  The order of grams need only be the same for all words: it
    is their frequency, taken from the ``GRAMS`` most frequent; others count as rarest."""
    spark = words.sparkSession
    if known is None:
        known = spark.createDataFrame(list(scanner.lexicon.items()), "word string, n long")
    known = known.filter(r"length(word) >= 2 and word rlike '^\\p{L}'").select(F.col("word").alias("known"), F.col("n").alias("count"))
    grams = lambda w: sorted({f"^{c}$"[i : i + Q] for c in shapes_of(w) for i in range(max(1, len(c) + 3 - Q))})

    def split(frequency, more: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                gs, at = [], []
                for i, w in enumerate(b.column(0).to_pylist()):
                    g = grams(w)
                    if frequency is not None:
                        g = sorted(g, key=lambda x: (frequency.value.get(x, 0), x))[:RAREST]
                    gs += g
                    at += [i] * len(g)
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at, pa.int64())) for c in b.columns), pa.array(gs, pa.string())], names=[*b.schema.names, "gram"])

        return run

    right = cut(known.mapInArrow(split(None, ["count"]), "known string, count long, gram string"))
    top = right.groupBy("gram").count().orderBy(F.desc("count"), "gram").limit(GRAMS).collect()  # bounded by GRAMS
    frequency = spark.sparkContext.broadcast({r[0]: r[1] for r in top})
    left = words.select(F.col("word").alias("w")).mapInArrow(split(frequency, []), "w string, gram string")
    short = F.abs(F.length("w") - F.length("known")) <= 4
    pairs = left.join(right, "gram").filter(short).select("w", "known", "count").distinct().filter(F.levenshtein(F.lower("w"), F.col("known"), 6) >= 0)
    ranker = spark.sparkContext.broadcast(fit_ranker(scanner.lexicon))

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(w, f) for w in b.column(0).to_pylist() if (f := fold(w)) != w.lower()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([0] * len(rows), pa.int64())], names=["w", "known", "count"])

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for r in zip(*(c.to_pylist() for c in b.columns)) if edit_cost(r[0].lower(), r[1]) <= 1.25]
            p = ranker.value.predict(np.array([pair_features(*r) for r in rows])) if rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array(p, pa.float64())], names=["word", "known", "p"])

    own = words.select(F.col("word").alias("w")).mapInArrow(folded, "w string, known string, count long")
    ranked = pairs.unionByName(own).mapInArrow(rank, "word string, known string, p double")
    best = ranked.groupBy("word").agg(F.max_by("known", F.struct("p", "known")).alias("correction"), F.max("p").alias("p"))
    return best.filter(F.col("p") >= SURE).select("word", "correction")


def _fit_furniture(by: dict[str, list[str]], number) -> Logistic:
    x, y = [], []
    for f, texts in by.items():
        got = [edges(t, number) for t in dict.fromkeys(texts)]
        for side in ("first", "last"):
            counts = Counter(line_key(e[side]) for e in got if e[side])
            for e in got:
                if e[side]:
                    n = counts[line_key(e[side])]
                    if n >= PAGES or n == 1 and len(got) >= 2 * PAGES:
                        x.append(furniture_features(e[side], e[f"beside_{side}"], f[1:], e["width"], side == "first"))
                        y.append(float(n >= PAGES))
        for e in got:
            lines = e["inner"]
            for k in range(1, min(5, len(lines) - 2)):
                top = bool(k % 2)
                x.append(furniture_features(lines[k], lines[k + 1 if top else k - 1], f[1:], e["width"], top))
                y.append(0.0)
    return Logistic().fit(np.array(x), np.array(y)) if 0 < sum(y) < len(y) else Logistic()


def learn(chunks: DataFrame, files: DataFrame | None = None) -> tuple[Scanner, DataFrame]:
    """(what is learnt, all known words).  The classifiers of edge lines are fitted on
    ``PER_FILE`` pages of each of ``SAMPLE`` scanned files, those of line pairs on ``SAMPLE``
    born-digital texts; of pages and texts up to ``SAMPLE_CHARS`` characters."""
    files = scanned_files(chunks) if files is None else files
    lexicon, compounds, known = known_words(chunks, files)
    count, total = files.agg(F.count("*"), F.coalesce(F.sum("pages"), F.lit(0))).first()
    rows = _file(chunks).filter(F.length("content") <= SAMPLE_CHARS)
    born = lookup(rows.select("id", "file", "content"), files.select("file"), ["file"], "left_anti").filter(F.length("content") >= 200)
    texts = [r[0] for r in hash_sample(born.select("id", "content"), "id", SAMPLE, max(1, chunks.count() - total)).select("content").collect()]
    scanner = Scanner(lexicon, compounds, texts)
    chosen = cut(hash_sample(files.filter("file like 't%'"), "file", SAMPLE, count))
    order = Window.partitionBy("file").orderBy(F.xxhash64("content"), "id")
    head = rows.join(F.broadcast(chosen.select("file")), "file", "left_semi").withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= PER_FILE)  # pruned before the shuffle
    by: dict[str, list[tuple[int | None, str]]] = {}
    for f, place, t in head.select("file", "page_number", "content").orderBy("file", "_r").collect():
        by.setdefault(f, []).append((place, t.replace("\r\n", "\n").replace("\r", "\n")))
    scanner.numbers = fit_numbers(by)
    scanner.furniture = _fit_furniture({f: [t for _, t in own] for f, own in by.items()}, scanner.number)
    return scanner, known


def read(chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, Scanner]:
    """(scanned pages, running lines, misread words, what was learnt)."""
    files = scanned_files(chunks)
    scanner, known = learn(chunks, files)
    scanned = cut(pages(chunks, files, scanner))
    words = unknown_words(scanned.select(F.explode(F.concat("odd", "odd_first", "odd_last")).alias("word")).distinct(), known)
    return scanned, cut(running_lines(scanned)), cut(misread_words(words, scanner, known)), scanner


def _with_flags(scanned: DataFrame, running: DataFrame) -> DataFrame:
    """``scanned`` with whether its first and last lines run."""
    for edge in ("first", "last"):
        flag = running.filter(F.col("edge") == edge).select("file", F.col("key").alias(edge), F.lit(True).alias(f"runs_{edge}"))
        scanned = lookup(scanned, flag, ["file", edge]).withColumn(f"runs_{edge}", F.coalesce(f"runs_{edge}", F.lit(False)))
    return scanned


def noises(chunks: DataFrame) -> DataFrame:
    """(id, noise) of every scanned page."""
    scanned, running, misread, _ = read(chunks)
    s = _with_flags(scanned, running)
    none = F.array().cast("array<string>")
    body = F.concat("odd", F.when(F.col("runs_first"), none).otherwise(F.col("odd_first")), F.when(F.col("runs_last"), none).otherwise(F.col("odd_last")))
    s = s.select("id", "hyphenation", "number", (F.col("runs_first") | F.col("runs_last")).alias("header"), body.alias("words"))
    flags = F.array(*(F.when(F.col(c), F.lit(n)) for c, n in (("hyphenation", "hyphenation"), ("number", "page_number"), ("header", "header"))))
    plain = s.select("id", F.explode(flags).alias("noise")).filter("noise is not null")
    spoilt = lookup(s.select("id", F.explode("words").alias("word")), misread.select("word"), ["word"], "left_semi")
    return plain.unionByName(spoilt.select("id", F.lit("misread").alias("noise"))).distinct()


def _repair(s: Scanner, text: str, first: bool, last: bool, fixes: dict[str, str]) -> tuple[list[str], str, str, float]:
    """(paragraphs, first line, last line, width) of a page without its furniture."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    lines = [x.strip("﻿ \t") for x in text.split("\n")]
    while lines and not lines[0]:
        lines.pop(0)
    while lines and not lines[-1]:
        lines.pop()
    width = float(np.median([len(x) for x in lines if x])) if lines else 1.0
    longest = float(max(map(len, lines))) if lines else 1.0
    for side, runs in ((0, first), (-1, last)):
        beside = lambda: lines[1 if side == 0 else -2] if len(lines) > 1 else None  # noqa: B023, E731
        for drop in (lambda: s.number(lines[side], beside(), width, True), lambda: runs, lambda: s.number(lines[side], beside(), width, True)):  # noqa: B023
            if lines and drop():
                lines.pop(side)
                while lines and not lines[side]:
                    lines.pop(side)
        if lines and not runs and len(parts := _GAP.split(lines[side])) > 1:
            for k, rest in ((0, parts[1:]), (-1, parts[:-1])):
                if s.number(parts[k], "  ".join(rest), width, False):
                    lines[side] = "  ".join(rest)
                    break
    kept = [x for x in lines if x]
    if not kept:
        return [], "", "", longest
    lines = s.glue("\n".join(lines))[0].split("\n")
    out: list[str] = []
    pairs = [(a, b) for a, b in zip(lines, lines[1:]) if a and b]
    on = iter(s.goes_on(pairs, longest))
    before = ""
    for line in lines:
        if line and before and next(on):
            out[-1] += line if _HAN.match(line[:1]) and _HAN.match(out[-1][-1:]) else f" {line}"
        elif line:
            out.append(line)
        before = line

    def fix(m: re.Match) -> str:
        c = fixes.get(m[0])
        if c is None:
            return m[0]
        return c.upper() if m[0].isupper() and len(m[0]) > 1 else c[0].upper() + c[1:] if m[0][0].isupper() else c

    return [_TOKEN.sub(fix, x) if fixes else x for x in out], kept[0], kept[-1], longest


_REPAIRED = T.StructType([T.StructField(n, t) for n, t in (("id", T.StringType()), ("document_title", T.StringType()), ("page_number", T.IntegerType()), ("paragraphs", T.ArrayType(T.StringType())), ("first_line", T.StringType()), ("last_line", T.StringType()), ("width", T.DoubleType()))])


def repaired(chunks: DataFrame) -> tuple[DataFrame, Scanner]:
    """(id, document_title, page_number, paragraphs[], first_line, last_line, width) of every
    scanned page."""
    scanned, running, misread, scanner = read(chunks)
    s = _with_flags(scanned, running)
    fixed = lookup(s.select("id", F.explode(F.concat("odd", "odd_first", "odd_last")).alias("word")), misread, ["word"], "inner").groupBy("id").agg(F.collect_set(F.struct("word", "correction")).alias("fixes"))  # a page's words
    slim = s.select("id", "runs_first", "runs_last").join(fixed, "id", "left")
    shared = chunks.sparkSession.sparkContext.broadcast(scanner)
    types = (pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.string(), pa.string(), pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [_repair(shared.value, t, f, la, {w["word"]: w["correction"] for w in x or ()}) for t, f, la, x in zip(*(b.column(k).to_pylist() for k in (3, 4, 5, 6)))]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in (0, 1, 2)), *(pa.array([m[k] for m in made], types[3 + k]) for k in range(4))], names=_REPAIRED.names)

    rows = chunks.select("id", "document_title", F.col("page_number").cast("int"), "content").join(slim, "id")
    return rows.select("id", "document_title", "page_number", "content", "runs_first", "runs_last", "fixes").mapInArrow(run, _REPAIRED), scanner


def paragraphs(chunks: DataFrame) -> DataFrame:
    """(id, document_title, page_number, text, goes_on): scanned pages as readable paragraphs,
    parted by blank lines; ``goes_on`` if the last one does not end on its page."""
    rows, _ = repaired(chunks)
    return rows.select("id", "document_title", "page_number", F.array_join("paragraphs", "\n\n").alias("text"), ((F.size("paragraphs") > 0) & ~F.substring("last_line", -1, 1).isin(*_STOPS)).alias("goes_on"))


def _joined(pieces: DataFrame, *by: str) -> DataFrame:
    """The pieces of each paragraph (and of each value of ``by``) as one, under its first page."""
    names = ("place", "id", "document_title", "page_number")
    p = F.array_sort(F.collect_list(F.struct(*names, "_text"))).alias("_p")
    return pieces.groupBy("file", "paragraph", *by).agg(p, F.sum("pages").alias("pages")).select("file", "paragraph", *by, *(F.col("_p")[0][n].alias(n) for n in names), "pages", F.array_join(F.transform("_p", lambda x: x["_text"]), " ").alias("_text"))


def continuous(chunks: DataFrame, most: int | None = None, limit: int = HOT_ROWS, stretch: int = STRETCH) -> DataFrame:
    """(document_title, paragraph, id, page_number, pages, text): the paragraphs of every scanned
    file in order, those that run over page ends in one piece, under the page they begin on.

    The line pair of two pages' last and first lines is classified as any other.  A paragraph
    that runs into another ``stretch`` of a file's pages is joined stretch by stretch, in tasks of
    their own, before it is joined whole; it is one row, however many pages it is on.  With
    ``most`` paragraphs are cut at every ``most``-th page of a file; no text is lost.  Pages
    without place come last, by id."""
    rows, scanner = repaired(chunks)
    rows = cut(rows.withColumn("file", F.coalesce(F.concat(F.lit("t"), "document_title"), F.concat(F.lit("i"), "id"))).withColumn("place", F.coalesce("page_number", F.lit(2**31 - 1))).filter("size(paragraphs) > 0"))
    hot = any_hot(rows.select("file"), "file", limit)
    shared = chunks.sparkSession.sparkContext.broadcast(scanner)
    slim = rows.select("file", "id", "place", F.size("paragraphs").alias("_size"), "first_line", "last_line", "width")
    slim = with_neighbours(slim, "file", "place", "id", ["last_line", "width"], hot, limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [bool(a) and shared.value.goes_on([(a, f)], w)[0] for f, a, w in zip(*(b.column(k).to_pylist() for k in (4, 5, 6)))]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in (0, 1, 2, 3)), pa.array(ok, pa.bool_())], names=["file", "id", "place", "_size", "on"])

    on = slim.select("file", "id", "place", "_size", "first_line", F.col("_prev.last_line"), F.col("_prev.width")).mapInArrow(run, "file string, id string, place int, _size int, on boolean")
    one = with_running_total(on.withColumn("_one", F.lit(1).cast("long")), "file", ["place", "id"], "_one", "_place", hot, limit)
    if most:
        one = one.withColumn("on", F.col("on") & (F.col("_place") % most != 0))
    new = one.select("file", "id", "place", "on", "_place", (F.col("_size") - F.col("on").cast("int")).cast("long").alias("_new"))
    at = cut(with_running_total(new, "file", ["place", "id"], "_new", "_first", hot, limit).select("file", "id", "place", "on", "_place", "_first"))
    t = rows.select("id", "document_title", "page_number", "paragraphs").join(at, "id")
    pieces = t.select("file", "document_title", "id", "page_number", "place", "_place", "_first", "on", F.posexplode("paragraphs").alias("_k", "_text"))
    pieces = pieces.withColumns({"paragraph": (F.col("_first") + F.col("_k") - F.col("on").cast("int")).cast("long"), "pages": F.lit(1)})
    long = cut(at.filter(F.col("on") & (F.col("_place") % stretch == 0)).select("file", (F.col("_first") - 1).alias("paragraph")).distinct())
    if long.isEmpty():
        whole = _joined(pieces)
    else:
        parted = lookup(pieces, long, ["file", "paragraph"], "left_semi").withColumn("_stretch", F.floor(F.col("_place") / stretch))
        whole = _joined(lookup(pieces, long, ["file", "paragraph"], "left_anti")).unionByName(_joined(_joined(parted, "_stretch")))
    han = r"(?<=[一-鿿]) (?=[一-鿿])"
    return whole.select("document_title", "paragraph", "id", "page_number", F.col("pages").cast("int").alias("pages"), F.regexp_replace("_text", han, "").alias("text"))
