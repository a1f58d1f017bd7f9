"""Language of documents and of the parts of mixed documents (problem 3).

Method: word-first backoff.  A known word scores by its per-language log frequency; an unseen
word falls back to its character 5-grams, then 4-, 3-, 2- and 1-grams, the longest order of
which any gram is known.  A text is cut into fragments at sentence ends, line ends and changes
of script, and each language that holds a whole sentence of its own is one of the text's.
``spans`` smooths the fragments' scores along the text (a change of language costs ``CHANGE``)
and gives each part's language, begin and end; its confidence is calibrated on pieces of the
sample.  Parts of which less than ``FAMILIAR`` of the words are known, or in another script, are
``other``.

The model is fitted on a bounded sample of labelled rows (``SAMPLE`` rows in the order of a hash
of their key, each of at most ``SAMPLE_CHARS`` characters) besides the common words below, and
refitted once on its own decisions, as labels are dirty.  Everything else covers all rows and
whole texts.

Edge cases: null texts and texts without letters have no language and give no row; a label that
is null, blank or stands for "unknown" names none; labels of regions, scripts and other
spellings are the language itself; repeated label rows count once.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import hash_sample
from .boost import Logistic

LANGS = ("en", "zh", "es", "de", "fr")
SAMPLE, SAMPLE_CHARS = 2000, 20_000
#: A whole sentence has at least so many words, or Han characters: (with an end mark, without).
MIN_WORDS, MIN_HAN = (3, 5), (5, 7)
#: Log odds that a segment must have against the text's main language.
MIN_ODDS = 7.0
#: Log odds a change of language along a text must gain, and least share of known words.
CHANGE, FAMILIAR = 5.0, 0.15

#: Common words of each language, to start from where labelled rows are few.
COMMON = {
    "en": "the of and to in is that it for was on are as with his they be at one have this from or had by not but what all were we when your can said there use an each which she do how their if will up other about out many then them these so some her would make like him into time has look two more write go see no way could people my than been call who its now find long down day did get come made may part over new sound take only work know place year back me give most very after thing our just name good sentence man think say great where help through much before line right too means old any same tell boy follow came want show also around form three small set put end does another well large must big even such because turn here why asked went men read need land different home us move try kind hand picture again change off play spell air away animal house point page letter answer please hello thanks thank you worked nobody anybody until while every once already keep",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está mi porque qué sólo han yo hay vez puede todos así nos ni parte tiene él uno donde bien tiempo mismo ese ahora cada e vida otro después te otros aunque esa eso hace otra gobierno tan durante siempre día tanto ella tres sí dijo sido gran país según menos mundo año antes estado quiero mientras caso nada hacer general estaba poco estos presente mayor ante unos les algo hacia casa ellos ayer hecho primera mucho además quien momento millones esto hola buenos gracias cómo dónde cuándo cuál puedo pueden días funciona ayuda favor quién",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei kann gegen vom können schon wenn habe seine mark ihre dann unter wir soll ich eines jahr zwei jahren diese dieser wieder keine uhr seiner worden will zwischen immer millionen was sagte gibt alle diesem seit muss wurden beim doch jetzt drei neue damit ihr ihm bereits da ab ohne sondern selbst ersten nun etwa bin hallo danke warum wo wer wie welche bitte guten tag vielen dank mein meine dir mir uns euch ihnen kein sehr geht klappt finde wozu jeder jede jedes während einfach",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son ou aux mais comme on sa ses cette tout été leur ont nous fait deux elle aussi entre si même bien ces sans peut tous après ainsi autres donc avant encore être avoir dont où quand depuis quelques très lors peu moins notre votre vous je tu mon ma mes ton ta tes nos vos leurs c'est n'est qu'il d'un d'une l'on j'ai bonjour merci beaucoup pourquoi comment combien quel quelle quels quelles faut faire dit sous vers chez contre pendant lorsque puis alors toujours jamais rien personne chaque plusieurs aucun ici là oui non marche aide s'il plaît puis-je ça cela celui y a-t-il",
    "zh": "的 是 不 我 有 在 人 了 他 這 这 個 个 們 们 中 來 来 上 大 為 为 和 國 国 地 到 以 說 说 時 时 要 就 出 會 会 可 也 你 對 对 生 能 而 子 那 得 於 于 著 着 下 自 之 年 過 过 發 发 後 后 作 里 裡 用 道 行 所 然 家 種 种 事 成 方 多 經 经 麼 么 去 法 學 学 如 都 同 現 现 當 当 沒 没 動 动 面 起 看 定 天 分 還 还 進 进 好 小 部 其 些 主 樣 样 理 心 她 本 前 開 开 但 因 只 從 从 想 實 实 謝 谢 請 请 問 问 嗎 吗 哪",
}
#: Other ways to write a label; the key is what is left of it in lower case before any region.
NAMES = {
    "en": "en eng english anglais inglés ingles englisch 英文 英語 英语",
    "zh": "zh zho chi cmn yue chinese mandarin cn zhs zht chinois chino chinesisch 中文 漢語 汉语 華語",
    "es": "es spa esp spanish castilian español espanol castellano spanisch espagnol 西班牙文",
    "de": "de deu ger german deutsch allemand alemán aleman 德文",
    "fr": "fr fra fre french français francais französisch francés frances 法文",
}
UNKNOWN = "n/a na und unknown unk none null mul mis zxx xx undefined undetermined unspecified other ? - ??".split()

_TOKEN = re.compile(r"[一-鿿㐀-䶿]|[^\W\d_一-鿿㐀-䶿]+(?:['’][^\W\d_]+)*")
_LETTER = regex.compile(r"\p{L}")
_KNOWN_SCRIPT = regex.compile(r"[\p{Latin}\p{Han}]")
_STOPS = frozenset(".!?。！？")
_HAN = re.compile(r"[一-鿿㐀-䶿]")
_LATIN_RUN = re.compile(r"[A-Za-z'’]+[ ,]+[A-Za-z'’]+[ ,]+[A-Za-z]")
_CUT = re.compile(r"[\r\n]+|(?<=[.!?…:;])[)\"'»”’]*\s+|(?<=[。！？；])")
_SCRIPT = regex.compile(r"(?<=\p{Han}[^\p{L}]{0,4})(?=(?:[\p{Latin}'’]+[ ,]+){2,}[\p{Latin}'’]+)|(?<=(?:\p{Latin}+[ ,]+){2,}\p{Latin}+[^\p{L}]{0,4})(?=\p{Han})")
#: Addresses, handles, tags and code have no language; a hyphen at a line end parts a word.
#: Each rule is tried only on texts that hold one of its marks.
_RULES = (
    (("-\n", "¬\n", "­\n", "‐\n", "-\r", "¬\r"), re.compile(r"(?<=[^\W\d_])[-¬­‐]\r?\n\s*(?=[^\W\d_])"), ""),
    (("://", "www."), re.compile(r"https?://\S+|www\.\S+"), " "),
    (("=", "{", "}", "@", "\\"), re.compile(r"(?<!\S)[^\s={}@\\]*[={}@\\]\S*"), " "),
    ((" /", "\n/"), re.compile(r"(?<!\S)/\S+"), " "),
    (("_",), re.compile(r"\w*_\w*"), " "),
    (("#",), re.compile(r"#\w+"), " "),
    (("&",), re.compile(r"&[a-z]+;"), " "),
    (("<",), re.compile(r"</?\w+[^<>]*>"), " "),
)


def without_code(text: str) -> str:
    for marks, rule, to in _RULES:
        for m in marks:
            if m in text:
                text = rule.sub(to, text)
                break
    return text


def label_language(col: Column) -> Column:
    """The language a delivered label names: one of ``LANGS``, ``other``, or null for none."""
    base = F.lower(F.regexp_replace(F.regexp_replace(col, r"^[\s\p{Z}\p{C}]+|[\s\p{Z}\p{C}]+$", ""), r"(?<=^[A-Za-z]{2,3})[-_].*$", ""))
    out = F.when(base.isNull() | (base == "") | base.isin(*UNKNOWN), F.lit(None).cast("string"))
    for lang, names in NAMES.items():
        out = out.when(base.isin(*names.split()), lang)
    return out.otherwise("other")


def fragments(text: str) -> Iterator[str]:
    for part in _CUT.split(without_code(text)):
        if part:
            if _LATIN_RUN.search(part) and _HAN.search(part):
                yield from (x for x in _SCRIPT.split(part) if x)
            else:
                yield part


class Model:
    """Log frequencies of words and character grams; one column per language."""

    ORDERS = (5, 4, 3, 2, 1)

    def __init__(self, counts: list[Counter[str]]):
        self.words = self._table(counts, 0.5)
        self.grams = []
        for n in self.ORDERS:
            grams = [Counter() for _ in LANGS]
            for c, own in zip(counts, grams):
                for w, k in c.items():
                    for g in self._grams(w, n):
                        own[g] += min(k, 20)
            self.grams.append(self._table(grams, 0.5))
        self.index: dict[str, int] = {}
        self.rows = np.zeros((4096, len(LANGS)), np.float32)
        self.calibration = (0.0, 3.0)

    def confidence(self, scores: np.ndarray, k: int) -> float:
        """Probability that language ``k`` is right, from the log scores of a text."""
        odds = float(scores[k] - np.delete(scores, k).max())
        a, b = self.calibration
        return 1 / (1 + math.exp(-min(40.0, max(-40.0, a + b * math.copysign(math.log1p(abs(odds)), odds)))))

    def calibrate(self, texts: list[str]) -> None:
        """Fit the confidence on pieces of 1 to 8 words of ``texts``: whether the language of a
        piece is that of its text."""
        x, y = [], []
        for t in texts:
            words = _TOKEN.findall(without_code(t).lower())
            if len(words) < 12:
                continue
            whole = int(self.scores([" ".join(words)])[0][0].argmax())
            for n in (1, 2, 4, 8):
                for at in range(n, len(words) - n, 1 + len(words) // 8):
                    s = self.scores([" ".join(words[at : at + n])])[0]
                    if len(s):
                        top = np.sort(s[0])
                        x.append([math.log1p(float(top[-1] - top[-2]))])
                        y.append(float(s[0].argmax() == whole))
        if len(y) >= 50 and 0 < sum(y) < len(y):
            w = Logistic(ridge=1.0).fit(np.array(x), np.array(y)).w
            if w[1] > 0:
                self.calibration = (float(w[0]), float(w[1]))

    @staticmethod
    def _table(counts: list[Counter[str]], add: float) -> dict[str, np.ndarray]:
        keys = sorted(set().union(*counts))
        n = np.array([[c.get(k, 0) for c in counts] for k in keys], np.float64).reshape(-1, len(LANGS))
        p = np.log(n + add) - np.log(n.sum(axis=0) + add * max(1, len(keys)))
        p -= p.max(axis=1, keepdims=True) if len(keys) else 0
        return dict(zip(keys, np.maximum(p, -6.0)))

    @staticmethod
    def _grams(word: str, n: int) -> list[str]:
        w = f"^{word}$"
        return [w[i : i + n] for i in range(len(w) - n + 1)] if n > 1 else list(word)

    def word(self, w: str) -> np.ndarray:
        """Log odds of a word against its best language, at most 0 each."""
        got = self.words.get(w)
        if got is not None:
            return got
        for n, table in zip(self.ORDERS, self.grams):
            known = [table[g] for g in self._grams(w, n) if g in table]
            if known:
                got = np.sum(known, axis=0) * (0.15 * n)
                return np.maximum(got - got.max(), -1.5)
        return np.zeros(len(LANGS))

    def number(self, w: str) -> int:
        """The row of a word's scores, kept for later; forgotten when there are too many."""
        k = len(self.index)
        if k == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[k] = self.word(w)
        self.index[w] = k
        return k

    def scores(self, parts: Iterable[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bool]]:
        """Of each part that has letters: log score per language, words, Han characters, and
        whether it ends as a sentence."""
        if len(self.index) > 400_000:
            self.index.clear()
        ids: list[int] = []
        starts, words, hans, ends = [], [], [], []
        find, get, number = _TOKEN.findall, self.index.get, self.number
        for part in parts:
            tokens = find(part.lower())
            if tokens:
                starts.append(len(ids))
                ends.append(part.rstrip(" )\"'»”’」")[-1:] in _STOPS)
                han = len(_HAN.findall(part)) if part > "一" or _HAN.search(part) else 0
                hans.append(han)
                words.append(len(tokens) - han)
                ids += [k if (k := get(w)) is not None else number(w) for w in tokens]
        if not ids:
            return np.zeros((0, len(LANGS))), np.zeros(0), np.zeros(0), []
        return np.add.reduceat(self.rows[ids], starts, axis=0), np.array(words), np.array(hans), ends


def decide(model: Model, text: str | None) -> list[tuple[str, float, int]]:
    """(language, confidence, share in fragments) of a text: one entry, or one for each language
    of a mixed text; none without letters."""
    if not text:
        return []
    scores, words, hans, ends = model.scores(fragments(text))
    if not len(scores):
        return []
    size = words + hans / 1.5
    total = scores.sum(axis=0)
    # the main language: most words in fragments that are its own
    own = scores.argmax(axis=1)
    mass = np.bincount(own, weights=size * (scores.max(axis=1) - np.sort(scores, axis=1)[:, -2] > 1.0), minlength=len(LANGS))
    main = int(mass.argmax()) if mass.max() > 0 else int(total.argmax())
    segments: dict[int, float] = {}
    for i in np.flatnonzero(own != main):
        k, s, n, han = int(own[i]), scores[i], words[i], hans[i]
        odds = float(s[k] - s[main])
        whole = (han >= MIN_HAN[not ends[i]]) if LANGS[k] == "zh" else n >= MIN_WORDS[not ends[i]]
        if whole and odds >= MIN_ODDS:
            segments[k] = max(segments.get(k, 0.0), odds)
    out = []
    for k in [main, *sorted(segments)]:
        mine = [i for i, j in enumerate(own) if j == k] if segments else list(range(len(scores)))
        sub = scores[mine].sum(axis=0) if mine else total
        out.append((LANGS[k], model.confidence(sub, k), len(mine)))
    return out


def _places(text: str) -> Iterator[tuple[int, str]]:
    """(begin, fragment) of the fragments with letters; addresses and code are blanked in place."""
    for marks, rule, _ in _RULES[1:]:
        if any(m in text for m in marks):
            text = rule.sub(lambda m: " " * len(m[0]), text)
    at = 0
    for m in [*_CUT.finditer(text), None]:
        part = text[at : m.start() if m else len(text)]
        inner = _SCRIPT.split(part) if _LATIN_RUN.search(part) and _HAN.search(part) else [part]
        for x in inner:
            if _LETTER.search(x):
                yield at, x
            at += len(x)
        at = m.end() if m else at


def spans(model: Model, text: str | None) -> list[tuple[str, float, int, int]]:
    """(language, confidence, begin, end) of the parts of a text in order; positions are code
    points of the text as it is.  One part for a text in one language, none without letters."""
    places = list(_places(text)) if text else []
    if not places:
        return []
    langs = [LANGS.index(k) for k, _, _ in decide(model, text)]
    tokens = [_TOKEN.findall(p.lower()) for _, p in places]
    scores = np.zeros((len(places), len(LANGS)))
    own = [i for i, t in enumerate(tokens) if t]
    if own:
        scores[own] = model.scores(places[i][1] for i in own)[0]
    foreign = [not t or len(_KNOWN_SCRIPT.findall(p)) * 2 < len(_LETTER.findall(p)) for (_, p), t in zip(places, tokens)]
    path = [0] * len(places)
    if len(langs) > 1:
        best, back = scores[0, langs], []
        for s in scores[1:, langs]:
            stay, move = best, best.max() - CHANGE
            back.append(np.where(stay >= move, np.arange(len(langs)), best.argmax()))
            best = np.maximum(stay, move) + s
        path[-1] = int(best.argmax())
        for i in range(len(back) - 1, -1, -1):
            path[i] = int(back[i][path[i + 1]])
    out: list[tuple[str, float, int, int]] = []
    lo = 0
    for i in range(1, len(places) + 1):
        if i < len(places) and (path[i], foreign[i]) == (path[lo], foreign[lo]):
            continue
        begin, end = places[lo][0] + len(places[lo][1]) - len(places[lo][1].lstrip()), places[i - 1][0] + len(places[i - 1][1].rstrip())
        words = [w for t in tokens[lo:i] for w in t]
        known = sum(w in model.words for w in words) / len(words) if words else 0.0
        if foreign[lo] or not langs or known < FAMILIAR:
            out.append(("other", 1 - known, begin, end))
        else:
            k = langs[path[lo]]
            out.append((LANGS[k], model.confidence(scores[lo:i].sum(axis=0), k), begin, end))
        lo = i
    return out


def fit(rows: Iterable[tuple[str, str | None]], rounds: int = 1) -> Model:
    """A model from (language, text) rows, refitted ``rounds`` times on its own decisions."""
    base = [Counter({w: 30 for w in COMMON[k].split()}) for k in LANGS]
    rows = [(k, t) for k, t in rows if t and k in LANGS]

    def count(pairs: Iterable[tuple[str, str]]) -> Model:
        counts = [Counter(b) for b in base]
        for k, t in pairs:
            counts[LANGS.index(k)].update(w.lower() for w in _TOKEN.findall(without_code(t)))
        return Model([Counter({w: n for w, n in c.items() if n >= 2}) for c in counts])

    model = Model(base) if rounds else count(rows)
    for _ in range(rounds + 1 if rounds else 0):
        pairs = []
        for _, t in rows:
            parts = [f for f in fragments(t) if _TOKEN.search(f.lower())]
            for f, s, n, han, _ in zip(parts, *model.scores(parts)):
                if n + han >= 4 and np.diff(np.sort(s)[-2:])[0] > 2.0:
                    pairs.append((LANGS[int(s.argmax())], f))
        model = count(pairs)
    model.calibrate([t for _, t in rows[:400]])
    return model


def sample(documents: DataFrame, limit: int = SAMPLE) -> list[tuple[str, str]]:
    """The labelled rows to fit on: at most ``limit``, in the order of a hash of doc_id."""
    labelled = documents.select("doc_id", "text", label_language(F.col("lang")).alias("k")).filter(F.col("k").isin(*LANGS) & (F.length("text") <= SAMPLE_CHARS))
    return [(r["k"], r["text"]) for r in hash_sample(labelled, "doc_id", limit, documents.count()).collect()]


_SEGMENTS = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("fragments", T.IntegerType())]))


def languages(df: DataFrame, key: str, text: str, model: Model) -> DataFrame:
    """(record_id, segments[]) of every row, null texts included; no shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    schema = T.StructType([T.StructField("record_id", T.StringType()), T.StructField("segments", _SEGMENTS)])
    arrow = pa.list_(pa.struct([("lang", pa.string()), ("confidence", pa.float64()), ("fragments", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            found = [[{"lang": k, "confidence": c, "fragments": n} for k, c, n in decide(m, t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, arrow)], names=schema.names)

    return df.select(F.col(key).cast("string"), F.col(text)).mapInArrow(run, schema)


_SPANS = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def language_spans(df: DataFrame, key: str, text: str, model: Model) -> DataFrame:
    """``languages`` with the text's parts: (record_id, segments[lang, confidence, begin, end])."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    schema = T.StructType([T.StructField("record_id", T.StringType()), T.StructField("segments", _SPANS)])
    arrow = pa.list_(pa.struct([("lang", pa.string()), ("confidence", pa.float64()), ("begin", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            found = [[{"lang": k, "confidence": c, "begin": lo, "end": hi} for k, c, lo, hi in spans(m, t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, arrow)], names=schema.names)

    return df.select(F.col(key).cast("string"), F.col(text)).mapInArrow(run, schema)


def all_records(documents: DataFrame, chunks: DataFrame, history: DataFrame, labels: DataFrame, model: Model | None = None, read=languages) -> DataFrame:
    """(record_table, record_id, label, segments) over documents and the labelled chunks and
    messages; long texts are read where they lie and only their languages are joined."""
    model = model or fit(sample(documents))
    named = documents.withColumn("_key", F.concat_ws("\x1f", F.col("doc_id").cast("string"), "lang"))
    docs = read(named, "_key", "text", model).select(F.lit("documents").alias("record_table"), F.substring_index("record_id", "\x1f", 1).alias("record_id"), F.when(F.col("record_id").contains("\x1f"), F.substring_index("record_id", "\x1f", -1)).alias("label"), "segments")
    keys = labels.select("record_table", "record_id", F.col("lang").alias("label")).distinct()
    parts = [docs]
    own = lambda name: keys.filter(F.col("record_table") == name)
    got = read(chunks.filter("content is not null"), "id", "content", model)
    parts.append(own("chunks").join(got, "record_id").select("record_table", "record_id", "label", "segments"))
    # few messages are labelled: those that are not needn't be read by the model
    listed = history.select(F.col("id").alias("record_id"), "user_message").filter("user_message is not null").join(own("chat_history").select("record_id").distinct(), "record_id", "left_semi")
    got = read(listed, "record_id", "user_message", model)
    parts.append(own("chat_history").join(got, "record_id").select("record_table", "record_id", "label", "segments"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def issues(records: DataFrame) -> DataFrame:
    """(record_table, record_id, issue, lang) of missing and wrong labels and mixed texts."""
    r = records.select("*", label_language(F.col("label")).alias("named"), F.size("segments").alias("n"))
    lang = F.col("segments")[0]["lang"]
    one = r.filter("n = 1").select("record_table", "record_id", F.when(F.col("named").isNull(), "missing").when(F.col("named") != lang, "wrong").alias("issue"), lang.alias("lang")).filter("issue is not null")
    mixed = r.filter("n > 1").select("record_table", "record_id", F.lit("mixed").alias("issue"), F.explode("segments.lang").alias("lang"))
    return one.unionByName(mixed).distinct()
