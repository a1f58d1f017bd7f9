"""Text functions as column expressions; all of them run inside the JVM.

White space is Unicode white space, spelt out so that any engine can use the same class.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space besides the line feed, for a regex class.
SPACE = r" \t\r\x{0B}\f\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: Line ends as text editors know them.
LINE_END = r"\r\n|[\n\r\x{0B}\f\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"
#: The CJK ranges that count as Chinese.
CJK = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{F900}-\x{FAFF}"
#: Words that tell a manual's readers.
TEACHER, STUDENT = ("teacher", "教師", "老師", "教員"), ("student", "學生", "學員")
LINK = r"https://[^\s]+\.notion\.[^\s]+"
WORD = r"[A-Za-z0-9][A-Za-z0-9'-]*"


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, rf"^[\n{SPACE}]+|[\n{SPACE}]+$", "")


def lines(c: Column) -> Column:
    return F.split(c, LINE_END)


def bare_lines(c: Column) -> Column:
    """Stripped lines, blank ones left out."""
    return F.filter(F.transform(lines(c), strip), lambda x: x != "")


def clean_text(c: Column, headers: Column | None = None) -> Column:
    """STR-01: no blank, header, digit or "Page n" lines; runs of blanks are one."""
    keep = F.filter(bare_lines(c), lambda x: ~x.rlike(r"^\d+$") & ~x.rlike(r"(?i)^page\s+\d+"))
    if headers is not None:
        keep = F.filter(keep, lambda x: ~F.array_contains(F.coalesce(headers, F.array().cast("array<string>")), x))
    return strip(F.regexp_replace(F.array_join(keep, "\n"), r"[ \t]+", " "))


def heading(c: Column) -> Column:
    """STR-02: the first line that is marked with # or all in capitals with under ten words."""
    capital = lambda x: (F.upper(x) == x) & (F.lower(x) != x) & (F.size(F.split(x, rf"[{SPACE}]+")) < 10)
    first = F.get(F.filter(bare_lines(c), lambda x: x.startswith("#") | capital(x)), F.lit(0))
    return F.when(first.startswith("#"), strip(F.regexp_replace(first, r"^[# ]+", ""))).otherwise(first)


def sentences(c: Column) -> Column:
    """STR-03: cut at white space after a full stop, exclamation or question mark."""
    return F.filter(F.split(c, rf"(?<=[.?!])[\n{SPACE}]+"), lambda x: x != "")


def has_cjk(c: Column) -> Column:
    """STR-09."""
    return c.rlike(f"[{CJK}]")


def cjk_terms(c: Column) -> Column:
    """STR-10: each Chinese character, repeats included."""
    return F.regexp_extract_all(c, F.lit(f"([{CJK}])"), 1)


def word_terms(c: Column) -> Column:
    """STR-11: words of three letters and more, possessive and plural endings dropped, each once."""
    found = F.regexp_extract_all(F.lower(c), F.lit(f"({WORD})"), 1)
    owner = F.transform(found, lambda t: F.regexp_replace(t, "'s$", ""))
    single = F.transform(owner, lambda t: F.when(F.length(t) > 4, F.regexp_replace(t, "s$", "")).otherwise(t))
    return F.array_distinct(F.filter(single, lambda t: F.length(t) >= 3))


def query_terms(c: Column) -> Column:
    """STR-12: Chinese terms, then words."""
    return F.when(has_cjk(c), F.concat(cjk_terms(F.lower(c)), word_terms(c))).otherwise(word_terms(c))


def phrases(terms: Column, most: int = 3, joiner: str = " ") -> Column:
    """STR-13: runs of 2..``most`` terms, each once, shorter ones first."""
    def run(n: int) -> Column:
        at = F.sequence(F.lit(1), F.size(terms) - (n - 1))
        return F.when(F.size(terms) >= n, F.transform(at, lambda i: F.array_join(F.slice(terms, i, n), joiner))).otherwise(F.array().cast("array<string>"))

    sizes = [run(n) for n in range(2, most + 1)]
    return F.array_distinct(F.concat(*sizes))


def source_url(c: Column) -> Column:
    """STR-08: an https link, or nothing."""
    s = F.regexp_replace(strip(c), r"""^[()\[\]<>{}.,;"']+|[()\[\]<>{}.,;"']+$""", "")
    s = F.when(s.startswith("www."), F.concat(F.lit("https://"), s)).otherwise(s)
    s = F.regexp_replace(s, "^http://", "https://")
    return F.when(s.startswith("https://"), s).otherwise("")


def first_link(c: Column) -> Column:
    """STR-07: the first link to the manuals, or nothing."""
    return F.regexp_extract(c, LINK, 0)


def manual_type(*signs: Column) -> Column:
    """STR-06: the first of ``signs`` that names readers decides, teachers before students."""
    out = F
    for c in signs:
        low = F.coalesce(F.lower(c), F.lit(""))
        for kind, words in (("teacher", TEACHER), ("student", STUDENT)):
            hit = low.rlike("|".join(words))
            out = out.when(hit, kind)
    return out.otherwise("")


def session_title(message: Column) -> Column:
    """STR-15: the first fifty characters."""
    return F.concat(F.substring(message, 1, 50), F.when(F.length(message) > 50, "...").otherwise(""))


def prefixed(message: Column) -> tuple[Column, Column]:
    """FLT-10: (manual type, message) of a message led by ``teacher:`` or ``student:``."""
    low = F.lower(message)
    kind = F.when(low.startswith("teacher:"), "teacher").when(low.startswith("student:"), "student")
    return kind, strip(F.when(kind.isNotNull(), message.substr(F.lit(9), F.length(message))).otherwise(message))


def terms_of(question: str) -> tuple[list[str], bool]:
    """Terms of one question, as ``query_terms`` gives them for a column."""
    cjk = re.findall("[一-鿿㐀-䶿豈-﫿\U00020000-\U0002a6df]", question.lower())
    words: dict[str, None] = {}
    for w in re.findall(WORD, question.lower()):
        w = w.removesuffix("'s")
        w = w.removesuffix("s") if len(w) > 4 else w
        if len(w) > 2:
            words.setdefault(w)
    return [*cjk, *words], bool(cjk)


def phrases_of(terms: list[str], most: int, joiner: str) -> list[str]:
    return list(dict.fromkeys(joiner.join(terms[i : i + n]) for n in range(2, most + 1) for i in range(len(terms) - n + 1)))
