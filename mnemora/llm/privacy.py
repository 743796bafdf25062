"""Personal information inside free text.

Method: bootstrapped contextual extraction. Seed entities of an unmistakable form (an e-mail address, a number
with a country code, a social security number, a street with a postcode, the name in an e-mail address) induce
lexical patterns: the words before them, the shape of what is written, the words a street begins and ends with.
Spark scores the graph of patterns and instances iteratively, each pattern by the share of its instances that
are known, each instance by its patterns. Patterns of high confidence then find what has no such form: a phone
number without a country code after "ring", a street without a postcode after "I live at" or of a kind that
other streets are of, a name after "my name is", and from those the name wherever else it stands.

Every message is read whole, twice: once to observe the graph's edges, once to find what was learned (texts with
ideographs once more between). The graph stays distributed; what is broadcast is the confident patterns and the
names, and more than MOST_PATTERNS or MOST_NAMES of them are refused, never dropped.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.llm.common import batch
from mnemora.session import cut

#: Rounds of scoring, least score of a pattern or instance, least distinct instances of a pattern.
ROUNDS, CONFIDENT, SUPPORT = 3, 0.6, 3
#: Share of an instance's occurrences that must tell it for a seed.
SEEDED = 0.05
#: Score from which a pattern alone tells a name.
CERTAIN = 0.95
#: Bounds of what is broadcast (some 200 bytes each in a worker); more is refused before it is gathered.
MOST_PATTERNS, MOST_NAMES = 500_000, 1_000_000

KINDS = ("email", "phone", "id_number", "address", "name")
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID]", "address": "[ADDRESS]", "name": "[NAME]"}

# -- folding -----------------------------------------------------------------------------------------


def _fold_table() -> dict[int, str]:
    """One character for each: without accents, full-width forms as plain ones. Texts keep their length."""
    t: dict[int, str] = {}
    for c in [*range(0xC0, 0x250), *range(0xFF01, 0xFF5F), *range(0x1E00, 0x1F00)]:
        x = [y for y in unicodedata.normalize("NFKD", chr(c)) if unicodedata.category(y) != "Mn"]
        if len(x) == 1 and x[0] != chr(c):
            t[c] = x[0]
    return t | {0x3000: " ", 0xA0: " ", 0x2010: "-", 0x2011: "-", 0x2012: "-", 0x2013: "-", 0xDF: "s"}


_FOLD = _fold_table()
_BY_CHAR = {chr(c): x for c, x in _FOLD.items()}
_FOLDED = re.compile("[" + re.escape("".join(map(chr, _FOLD))) + "]")


def fold(text: str) -> str:
    return text if text.isascii() else _FOLDED.sub(lambda m: _BY_CHAR[m.group()], text)


# -- forms (fixed values) ----------------------------------------------------------------------------

_AT = r"(?:@|\s?[\[(]\s?at\s?[\])]\s?|\sat\s)"
_DOT = r"(?:\.|\s?[\[(]\s?dot\s?[\])]\s?|\sdot\s)"
EMAIL = re.compile(rf"(?i)(?<![a-z0-9])([a-z0-9](?:[a-z0-9_+\-]|\.(?=[a-z0-9]))*){_AT}[a-z0-9][a-z0-9\-]*(?:{_DOT}[a-z0-9\-]*[a-z0-9])*{_DOT}[a-z]{{2,}}(?![a-z0-9])")
_MAY_HOLD = re.compile(r"@|(?i:[\[(] ?at| dot )")
#: A plain " at " is an address only with a spelled-out dot.
_WORDED = re.compile(r"(?i)\sat\s")
_SPELLED = re.compile(r"(?i)\sdot\s|[\[(]\s?dot\s?[\])]")
NUMBER = re.compile(r"(?<![A-Za-z0-9_.,=/#@+\-])(?:\(?\+\s?)?\(?\d(?:[ .\-/()]{0,2}\d){6,17}[xX]?(?![A-Za-z0-9_])")
CODE = re.compile(r"(?<![A-Za-z0-9_\-])(?:[A-Z]{1,2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|[A-Z]{1,2}\d{6,9}|[A-Z]\d[A-Z0-9]{7}\d|\d{8} ?-?[A-Z]|[XYZ]-?\d{7}-?[A-Z])(?![A-Za-z0-9_\-])")
#: What every number above holds: six digits or capitals, little apart.
_DIGITS = re.compile(r"\d(?:[ .\-/()]{0,2}[\dA-Z]){5}")
_DIGIT = re.compile(r"\d")
PHONE_SEED = re.compile(r"^(?:\(?\+\)?\(?\s?\d[\d ().\-/]{8,}|\(?\d{3}\)?[ .\-]\d{3}[ .\-]\d{4}|07\d{3} ?\d{6}|1[3-9]\d-?\d{4}-?\d{4}|0[1-9](?:[ .]\d\d){4}|00\d\d[ \-][\d \-]{8,})$")
ID_SEED = re.compile(
    r"^(?:\d{3}-\d{2}-\d{4}|\d{3}\.\d{3}\.\d{3}-\d{2}|\d{6} ?(?:19|20)\d{6} ?\d{3}[\dxX]|[12] \d\d \d\d \d\d \d{3} \d{3} \d\d|[12]\d{14}|\d\d \d{3} \d{3} \d{3}"
    r"|[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D]|[A-Z]{2}\d{7}|[A-Z]\d[A-Z]\d\d[A-Z]\d{4}|\d{8}-?[A-Z]|[XYZ]-?\d{7}-?[A-Z])$"
)
#: Postcodes of several countries, which make a street before them a seed; words that link those of a street's name (fixed values).
_POSTCODE = r"(?:[A-Z]{1,2}\d{1,2}[A-Z]? ?\d[A-Z]{2}\b|[A-Z]{2} \d{5}\b|\d{5,6}(?:-\d{3})? (?=[A-ZΑ-ΩА-ЯЁ]))"
_LINK = r"(?:(?:de la|de las|de los|de|del|la|le|les|las|los|da|do|das|dos|du|des|der|den|dem|zum|zur|of|the|van|von|di|della|delle|dei|y|e|и) |[dl]['’] ?)"
_CAP = r"[A-ZΑ-ΩА-ЯЁ][\w'’\-]*"
#: A house number that stands for itself.
HOUSE = re.compile(r"\d(?<![\w.,/:+#@=\-]\d)\d{0,4}[a-zA-Z]?(?: (?:bis|ter))?(?![\w:/%@=])(?!\.\d)")
#: The street after a number: words with a capital, the first may be small.
_STREET_AFTER = re.compile(rf",? ((?:{_CAP}|[^\W\d_]{{2,}})(?: {_LINK}?{_CAP}){{1,4}})")
#: The street before a number, and what may stand between them.
_STREET_BEFORE = re.compile(rf"(?<![\w'’])((?:[CRcr]/|{_CAP}\.?)(?: {_LINK}?{_CAP}\.?){{0,4}})(,? ?(?:n\.? ?[ºo°]\.? ?|№ ?|numero |дом |д\. ?)?)$")
_LINKS = re.compile(rf"(?<!\w){_LINK}+$")
_HEAD = re.compile(r"(?<!\w)[^\W\d_]{3,5}\.? \d{1,4}[a-zA-Z]?, ?$")
_GOES_ON = re.compile(rf",? ?(?!{_POSTCODE})\d{{1,5}}[a-zA-Z]? {_CAP}")
_TAIL = re.compile(
    rf"(?:(?:,? |, ?| ?- ?)[^\W\d_]{{3,5}}\.? \d{{1,4}}(?:[ºª]|\b)(?![.\-]?\d))?(?:(?:,\s?|[,.]?\n){_POSTCODE}(?: ?{_CAP})?|(?:,\s?|\.?\n){_CAP}(?:,? {_POSTCODE})?|,? {_POSTCODE})?"
)
_SIGN = re.compile(r"[ºo°№мд]\.?$")
_HAN_HOUSE = re.compile(r"((?:[A-Za-z]{2,12}(?=[市区县]))?[一-鿿]{2,14})(\d{1,5})(?:号|號|弄|番地|番|丁目)(?:\d{1,4}(?:号|番|栋|室|楼|层|单元|の))*(?:\d{1,4}(?:号|室)?)?")
_HAN_NUMBER = re.compile(r"[一-鿿]\d{1,5}(?:号|號|弄|番|丁目)")
_CODED = re.compile(_POSTCODE)
_HAN_UNIT = re.compile(r"(?:栋|室|单元|弄|丁目|番地)|[市区县區縣都府]")


@dataclass(frozen=True)
class Street:
    """A place where an address may stand: its range, where a street after its number begins (else -1), what it is called, its patterns, and whether a postcode tells it."""

    start: int
    words_at: int
    end: int
    name: str
    patterns: tuple[str, ...]
    seed: bool


def streets(folded: str) -> Iterator[Street]:
    """What is written like a number and a street, or a street and a number, in any language; without judging whether it is one."""
    for m in HOUSE.finditer(folded):
        a, b = m.span()
        after = _STREET_AFTER.match(folded, b)
        if after and after.end() - b < 60:
            words = after.group(1).lower().split(" ")
            tail = _TAIL.match(folded, after.end())
            head = _HEAD.search(folded, max(0, a - 14), a)
            start = head.start() if head else a
            marks = ("E:" + words[-1], "F:" + words[0], before(folded, start))
            yield Street(start, after.start(1), tail.end(), " ".join(words), marks, bool(_CODED.search(tail.group())))
        window = folded[max(0, a - 48) : a].rsplit("\n", 1)[-1]
        near = window.rstrip(" ,")
        last = near.rsplit(" ", 1)[-1]
        ahead = _STREET_BEFORE.search(window) if last[:1].isupper() or last[:2].lower() == "c/" or _SIGN.search(near) else None
        if ahead and not _GOES_ON.match(folded, b):
            start = a - len(window) + ahead.start()
            words = ahead.group(1).lower().split(" ")
            tail = _TAIL.match(folded, b)
            marks = ["F:" + words[0], before(folded, start)]
            links = _LINKS.search(folded, max(0, start - 12), start)
            if links:
                marks.append(before(folded, links.start()))
            if len(words) > 1:
                marks.append("E:" + words[-1])
            if len(words[-1]) >= 7:
                marks += ["X:" + words[-1][-3:], "X:" + words[-1][-5:]]
            marked = words[0] == "c/" or len(words) > 1 and ahead.group(2).strip(" ,") != ""  # a sign for a street, or for its number
            yield Street(start, -1, tail.end(), " ".join(words), tuple(marks), marked or bool(_CODED.search(tail.group())))
    for m in _HAN_HOUSE.finditer(folded) if _HAN_NUMBER.search(folded) else ():
        run = m.group(1)
        led = () if run[0].isascii() else ("H:" + run[:2], "H:" + run[:3])
        yield Street(m.start(), -1, m.end(), run[-3:], ("Z:" + run[-1], *led), bool(_HAN_UNIT.search(m.group())))


#: Chinese double surnames, the seeds of names written without blanks (fixed values).
DOUBLE_SURNAMES = "欧阳 司徒 尉迟 钟离 闻人 上官 诸葛 东方 皇甫 令狐 慕容 宇文 公孙 司马 夏侯 端木 轩辕 赫连 澹台 申屠 太史 南宫".split()
_HAN_SEED = re.compile("(?:" + "|".join(DOUBLE_SURNAMES) + ")[一-鿿]{1,2}")
_HAN = re.compile("[一-鿿]+")
_WORD = re.compile(r"[^\W\d_]+")
_BEFORE = re.compile(r"[^\W\d_]+|[:(#,.!?\n]")
_LOCAL = re.compile(r"[a-z]{3,}")
#: Words with a capital, in alphabets that have capitals.
_CAPITAL = re.compile(r"[A-ZΑ-ΩА-ЯЁ](?<![^\W\d_].)[a-zα-ωа-яё]{2,}(?![^\W\d_])")
_UPPER = re.compile(r"[A-ZΑ-ΩА-ЯЁ](?<![^\W\d_].)[A-ZΑ-ΩА-ЯЁ]{2,}(?![^\W\d_])")
_LOWER = re.compile(r"[a-zα-ωа-яё](?<![^\W\d_].)[a-zα-ωа-яё]{2,}(?![^\W\d_])")
#: Names before an e-mail address in brackets.
_SENDER = re.compile(rf"({_CAP}(?: {_CAP}){{0,2}}) ?[<(]$")


def shape(text: str) -> str:
    """The form of a number: digits after the first as 9, capitals as A."""
    return "S:" + re.sub(r"[A-Z]", "A", re.sub(r"(?<=\d)(\D*)\d", r"\g<1>9", text))


def before(text: str, at: int) -> str:
    """The last two words or marks before a place, as a pattern."""
    return "L:" + " ".join(_BEFORE.findall(text[max(0, at - 28) : at].lower())[-2:])


@dataclass
class Lexicon:
    """What was learned: score of each (pattern, kind), names by word, parts of names written without blanks."""

    patterns: dict[str, dict[str, float]] = field(default_factory=dict)
    names: set[str] = field(default_factory=set)
    places: set[str] = field(default_factory=set)  # patterns that only names follow
    surnames: set[str] = field(default_factory=set)
    given: set[str] = field(default_factory=set)
    _last: set[str] = field(default_factory=set)  # the last words of places
    _han: re.Pattern | None = None
    _automaton: object = None

    def ready(self) -> Lexicon:
        import ahocorasick

        self._last = {x.removeprefix("L:").split(" ")[-1] for x in self.places}
        if self.surnames and self.given:
            some = "".join(sorted(self.given))
            self._han = re.compile("(?:" + "|".join(sorted(map(re.escape, self.surnames), key=len, reverse=True)) + f")[{re.escape(some)}]{{1,2}}")
        if self.names:
            self._automaton = ahocorasick.Automaton()
            for w in self.names:
                self._automaton.add_word(w, len(w))
            self._automaton.make_automaton()
        return self


def emails(folded: str) -> list[tuple[int, int, str]]:
    """(start, end, local part) of e-mail addresses, also spelled out."""
    if not _MAY_HOLD.search(folded):
        return []
    out = []
    for m in EMAIL.finditer(folded):
        whole = m.group()
        if _WORDED.search(whole) and "@" not in whole and not _SPELLED.search(whole):
            continue
        out.append((m.start(), m.end(), m.group(1)))
    return out


def numbers(folded: str) -> list[tuple[int, int, str]]:
    """(start, end, seed kind or '') of what could be a phone or identity number."""
    out: list[tuple[int, int, str]] = []
    if not _DIGITS.search(folded):
        return out
    for m in CODE.finditer(folded):
        out.append((m.start(), m.end(), "id_number" if ID_SEED.match(m.group()) else ""))
    for m in NUMBER.finditer(folded):
        a, b = m.span()
        text = m.group()
        while text and text[0] == "(" and ")" not in text:
            a, text = a + 1, text[1:]
        if any(x < b and a < y for x, y, _ in out):
            continue
        seed = "id_number" if ID_SEED.match(text) else "phone" if PHONE_SEED.match(text) else ""
        out.append((a, b, seed))
    return out


def _words_in(folded: str, automaton: object) -> Iterator[tuple[int, int]]:
    """Whole-word occurrences of the automaton's words."""
    low = folded.lower()
    if len(low) != len(folded):
        low = folded
    for last, n in automaton.iter(low):
        a, b = last - n + 1, last + 1
        if (a and (low[a - 1].isalnum() and low[a - 1] < "\u2e80" or low[a - 1] in "@_+")) or (b < len(low) and (low[b].isalnum() and low[b] < "\u2e80" or low[b] in "@_")):
            continue
        yield a, b


# -- the graph ---------------------------------------------------------------------------------------

_EDGE = pa.schema([("family", pa.string()), ("instance", pa.string()), ("pattern", pa.string()), ("seed", pa.string()), ("n", pa.int64())])
_EDGE_DDL = "family string, instance string, pattern string, seed string, n long"

Edge = tuple[str, str, str, str]


def _counted(each: Callable[[str], Iterator[Edge]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A map over texts that gives each row once in a batch, with its number of occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            rows: dict[Edge, int] = {}
            for text in rb.column(0).to_pylist():
                for row in each(text):
                    rows[row] = rows.get(row, 0) + 1
            if rows:
                yield batch(_EDGE, n=list(rows.values()), **dict(zip(_EDGE.names[:4], zip(*rows, strict=True), strict=True)))

    return run


def _observe(text: str) -> Iterator[Edge]:
    """All edges of a text: numbers, streets, seed names, every word with a capital and what stands before it, and the small forms of words."""
    folded = fold(text)
    taken = emails(folded)
    for a, _, local in taken:
        for w in _LOCAL.findall(local.lower()):
            yield "name", w, "in an address", "name"
        sender = _SENDER.search(folded, max(0, a - 60), a)
        for w in _CAPITAL.findall(sender.group(1)) if sender else ():
            yield "name", w.lower(), "before an address", "name"
    if _DIGIT.search(folded):
        for a, b, seed in numbers(folded):
            if not any(x < b and a < y for x, y, _ in taken):
                number = folded[a:b]
                yield "number", number, shape(number), seed
                yield "number", number, before(folded, a), seed
        for x in streets(folded):
            for pattern in {y for y in x.patterns if y[-1] not in ".!?\n" or y[0] != "L"}:  # where a line or sentence begins any number may stand
                yield "street", x.name, pattern, "address" if x.seed else ""
    for a, b, _ in reversed(taken):  # names within addresses don't count
        folded = folded[:a] + "\x00" * (b - a) + folded[b:]
    for m in _CAPITAL.finditer(folded):
        yield "word", m.group().lower(), before(folded, m.start()), "capital"
    for w in _UPPER.findall(folded):
        yield "word", w.lower(), "", "capital"
    for w in _LOWER.findall(folded):
        yield "word", w, "", "small"
    for m in _HAN_SEED.finditer(folded):
        run = _HAN.search(folded, m.start())
        left = folded[max(0, m.start() - 6) : m.start()]
        if run.end() <= m.end() and left:  # nothing but the name up to the next mark
            yield "han", m.group(), "H:" + re.split(r"[^一-鿿：:]", left)[-1], "name"


def score(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Scores of patterns by kind: family, pattern, kind, score, n (distinct instances).

    edges: family, instance, pattern, seed (empty where unknown), n. An instance is a seed where SEEDED of its
    occurrences tell it, so that one that is told by accident is none. A pattern scores the mean of its instances;
    an instance that is no seed scores as likely as any of its patterns makes it. Seeds stay at 1.
    """
    own = F.sum(F.when(F.col("seed") != "", F.col("n")).otherwise(0)) >= SEEDED * F.sum("n")
    told = edges.groupBy("family", "instance").agg(F.when(own, F.max("seed")).otherwise("").alias("seed"))
    e = cut(edges.select("family", "instance", "pattern").distinct().join(told, ["family", "instance"]))
    sizes = e.groupBy("family", "pattern").agg(F.count("*").alias("n")).where(F.col("n") >= SUPPORT)
    links = e.join(sizes, ["family", "pattern"])
    known = links.where("seed <> ''").select("family", "instance", F.col("seed").alias("kind"), F.lit(1.0).alias("s")).distinct()
    scores = known
    patterns = None
    for _ in range(rounds):
        patterns = (
            links.join(scores, ["family", "instance"])
            .groupBy("family", "pattern", "kind")
            .agg((F.sum("s") / (F.first("n") + F.lit(1.0))).alias("score"), F.first("n").alias("n"))
        )
        told = (
            links.where("seed = ''")
            .join(patterns.where(F.col("score") >= 0.3).drop("n"), ["family", "pattern"])
            .groupBy("family", "instance", "kind")
            .agg((1 - F.exp(F.sum(F.log1p(-F.least("score", F.lit(0.999)))))).alias("s"))
        )
        scores = cut(known.unionByName(told))
    return patterns


def _gathered(df: DataFrame, most: int, what: str) -> list:
    """The rows of a small table; more than `most` are refused before they are gathered."""
    df = cut(df)
    if (n := df.count()) > most:
        raise ValueError(f"{n} {what} were learned; at most {most} are broadcast")
    return df.collect()


def learn(texts: DataFrame) -> Lexicon:
    """The lexicon of a column of texts. Texts without any seed give an empty one."""
    seen = cut(texts.select("text").mapInArrow(_counted(_observe), _EDGE_DDL).groupBy("family", "instance", "pattern", "seed").agg(F.sum("n").alias("n")))
    scored = score(seen.where("family IN ('number', 'street')"))
    found = Lexicon()
    for r in _gathered(scored.where(F.col("score") >= 0.2), MOST_PATTERNS, "patterns"):
        found.patterns.setdefault(r["pattern"], {})[r["kind"]] = r["score"]
    _names(seen, found)
    _han_names(texts, seen, found)
    return found.ready()


def _names(seen: DataFrame, found: Lexicon) -> None:
    """Learn names: from seeds to the patterns around them, from confident patterns to further names."""
    words = seen.where("family = 'word'")
    # A word that is mostly written small is no name, whatever addresses hold it.
    capital = F.sum(F.when(F.col("seed") == "capital", F.col("n")).otherwise(0))
    case = words.groupBy("instance").agg(capital.alias("c"), F.sum("n").alias("n")).where("c >= 0.5 * n").select("instance")
    seeds = seen.where("family = 'name'").select("instance").distinct()
    names = cut(seeds.join(case, "instance"))
    places = words.where("pattern <> ''").select("instance", "pattern", "n")
    # Where a sentence or line begins any word is written with a capital, so such places tell nothing.
    around = places.where((F.length("pattern") > 4) & ~F.col("pattern").rlike(r"[.!?\n]$")).join(seeds, "instance")
    induced = around.groupBy("pattern").agg(F.countDistinct("instance").alias("k")).where(F.col("k") >= SUPPORT)
    # After a name stands another, or whatever follows an unfinished line.
    last = F.regexp_replace(F.element_at(F.split("pattern", " "), -1), "^L:", "")
    induced = induced.join(names.select(F.col("instance").alias("last")), last == F.col("last"), "left_anti").select("pattern")
    # Weighed by occurrences: a place where sentences begin holds few words, but those often.
    # Scored in rounds: what confident patterns tell counts as a name when the patterns are scored again.
    graph = cut(places.join(induced, "pattern"))
    known = cut(graph.join(names, "instance", "left_semi").select("instance").distinct())
    told = sure = None
    for _ in range(ROUNDS):
        marked = graph.join(known.withColumn("known", F.lit(True)), "instance", "left")
        scored = cut(marked.groupBy("pattern").agg((F.sum(F.when(F.col("known"), F.col("n")).otherwise(0)) / F.sum("n")).alias("score"), F.count("*").alias("k")))
        sure = scored.where((F.col("score") >= 0.85) & (F.col("k") >= SUPPORT))
        told = graph.join(names, "instance", "left_anti").join(sure.select("pattern"), "pattern").groupBy("instance").agg(F.countDistinct("pattern").alias("k")).where("k >= 2").select("instance")
        known = cut(known.unionByName(told).distinct())
    found.names = {r["instance"] for r in _gathered(names.unionByName(told).distinct(), MOST_NAMES, "names")}
    found.places = {r["pattern"] for r in _gathered(sure.where(F.col("score") >= CERTAIN).select("pattern"), MOST_PATTERNS, "patterns of names")}


def _han_names(texts: DataFrame, seen: DataFrame, found: Lexicon) -> None:
    """Names without blanks: contexts of double surnames tell where a name stands alone up to the next mark."""
    han = seen.where("family = 'han'").groupBy("pattern").agg(F.countDistinct("instance").alias("k")).where((F.col("k") >= SUPPORT) & (F.length("pattern") > 3))
    contexts = sorted(r["pattern"][2:] for r in _gathered(han.select("pattern"), MOST_PATTERNS, "contexts"))
    if not contexts:
        return
    shared = texts.sparkSession.sparkContext.broadcast(contexts)
    compiled: list[re.Pattern] = []  # pickled empty, so each task compiles its own once

    def alone(text: str) -> Iterator[Edge]:
        if not compiled:
            compiled.append(re.compile("(" + "|".join(sorted(map(re.escape, shared.value), key=len, reverse=True)) + ")([一-鿿]{2,4})(?![一-鿿])"))
        for m in compiled[0].finditer(fold(text)):
            yield "han", m.group(2), m.group(1), "name" if _HAN_SEED.fullmatch(m.group(2)) else ""

    graph = cut(texts.where(F.col("text").rlike("[一-鿿]")).select("text").mapInArrow(_counted(alone), _EDGE_DDL).select("instance", "pattern", "seed").distinct())
    sure = graph.groupBy("pattern").agg(F.countDistinct("instance").alias("n"), F.countDistinct(F.when(F.col("seed") == "name", F.col("instance"))).alias("k")).where("k >= 3 AND k >= 0.15 * n")
    full = graph.join(sure.select("pattern"), "pattern").select("instance").distinct()
    double = F.left("instance", F.lit(2)).isin(*DOUBLE_SURNAMES)
    head = F.when(double, F.left("instance", F.lit(2))).otherwise(F.left("instance", F.lit(1)))
    parts = full.select(head.alias("head"), F.substr("instance", F.char_length(head) + 1).alias("tail")).where(F.char_length("tail").between(1, 2))
    found.surnames = {r["head"] for r in _gathered(parts.groupBy("head").count().where("count >= 2"), MOST_NAMES, "surnames")}
    # What only ever ends a name is the next word.
    ends = parts.select(F.posexplode(F.split("tail", "")).alias("at", "c")).where("c <> ''").groupBy("c").agg(F.count("*").alias("n"), F.count_if(F.col("at") == 0).alias("begins"))
    found.given = {r["c"] for r in _gathered(ends.where("n >= 2 AND begins >= 2").select("c"), MOST_NAMES, "parts of names")}


# -- extraction --------------------------------------------------------------------------------------


def find(text: str, lexicon: Lexicon) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every item, in order and without overlaps."""
    folded = fold(text)
    spans: list[tuple[int, int, str]] = [(a, b, "email") for a, b, _ in emails(folded)]

    def add(a: int, b: int, kind: str) -> None:
        if not any(x < b and a < y for x, y, _ in spans):
            spans.append((a, b, kind))

    found = numbers(folded) if _DIGIT.search(folded) else []
    for a, b, seed in found:
        kind = seed or _kind_of(folded, a, b, lexicon)
        if kind:
            add(a, b, kind)
    if found or _DIGIT.search(folded):
        for a, b in sorted(_addresses(folded, lexicon), key=lambda x: (x[0] - x[1], x)):  # the longest first
            add(a, b, "address")
    if lexicon.places:
        for m in _CAPITAL.finditer(folded):
            a = m.start()
            if (folded[a - 1 : a] != " " or folded[folded.rfind(" ", max(0, a - 28), a - 1) + 1 : a - 1].lower() in lexicon._last or not folded[a - 2 : a - 1].isalpha()) and before(folded, a) in lexicon.places:
                add(*_whole_name(folded, *m.span()), "name")
    if lexicon._automaton is not None:
        for a, b in _words_in(folded, lexicon._automaton):
            add(*_whole_name(folded, a, b), "name")
    if lexicon._han is not None:
        for m in lexicon._han.finditer(folded):
            add(m.start(), m.end(), "name")
    return sorted(spans)


def _kind_of(folded: str, a: int, b: int, lexicon: Lexicon) -> str:
    number = folded[a:b]
    miss = dict.fromkeys(("phone", "id_number"), 1.0)
    for pattern in (shape(number), before(folded, a)):
        for kind, s in lexicon.patterns.get(pattern, {}).items():
            if kind in miss:  # the same words may stand before a street
                miss[kind] *= 1 - min(s, 0.999)
    kind = min(miss, key=lambda k: (miss[k], k))
    return kind if 1 - miss[kind] >= CONFIDENT else ""


#: A number and small words, of which one may be a street's last.
_SMALL_STREET = re.compile(r"((?: [a-z][\w'’]*){2,4})")


def _addresses(folded: str, lexicon: Lexicon) -> Iterator[tuple[int, int]]:
    """(start, end) of the streets that their patterns tell, or a postcode."""

    def told(patterns: tuple[str, ...]) -> float:
        miss = 1.0
        for p in patterns:
            miss *= 1 - min(lexicon.patterns.get(p, {}).get("address", 0.0), 0.999)
        return 1 - miss

    for x in streets(folded):
        if not x.seed and told(x.patterns) < CONFIDENT:
            continue
        start = x.start
        for h in (p for p in x.patterns[:0:-1] if p.startswith("H:")):  # without the words that lead to it
            if told((h,)) >= CONFIDENT:
                start += len(h) - 2
                break
        end = x.end
        if x.words_at >= 0:
            words = x.name.split(" ")
            last = next((i for i in range(1, len(words)) if told(("E:" + words[i],)) >= 0.8), len(words) - 1)
            core = x.words_at + len(" ".join(words[: last + 1]))
            if last < len(words) - 1:  # the words run on into the next sentence
                end = _TAIL.match(folded, core).end()
            yield start, core  # where what follows is something else
        yield start, end
    for m in HOUSE.finditer(folded):
        small = _SMALL_STREET.match(folded, m.end())
        if small:
            words = small.group(1).split(" ")[1:]
            for i in range(1, len(words)):
                if told(("E:" + words[i],)) >= 0.8:
                    yield m.start(), m.end() + sum(len(w) + 1 for w in words[: i + 1])
                    break


_AFTER = re.compile(r"(?:[ ](?:[A-Z]\.[ ])?[A-Z][a-z]+(?:-[A-Z][a-z]+)*)?")


def _whole_name(folded: str, a: int, b: int) -> tuple[int, int]:
    """A known name with the capitalised surname after it."""
    m = _AFTER.match(folded, b)
    return (a, m.end()) if folded[a].isupper() and m else (a, b)


def _masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], PLACEHOLDER[kind]]
        at = b
    return "".join([*out, text[at:]])


_FOUND = pa.schema([("message_id", pa.string()), ("kinds", pa.list_(pa.string())), ("text", pa.string())])
_FOUND_DDL = "message_id string, kinds array<string>, text string"


def masked(messages: DataFrame) -> DataFrame:
    """Messages that hold personal information: message_id, kinds, text (each item replaced by a placeholder of its kind).

    messages: id, content (further columns are ignored). Null and empty contents hold none; redelivered rows
    give one row; everything outside the items stays as it is.
    """
    texts = messages.where("id IS NOT NULL AND content IS NOT NULL").select(F.col("id").alias("message_id"), F.col("content").alias("text"))
    shared = messages.sparkSession.sparkContext.broadcast({k: v for k, v in learn(texts.select("text")).__dict__.items() if not k.startswith("_")})

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(**shared.value).ready()
        for rb in batches:
            rows = []
            for key, text in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True):
                spans = find(text, lexicon)
                if spans:
                    rows.append((key, sorted({k for _, _, k in spans}), _masked(text, spans)))
            if rows:
                yield batch(_FOUND, **dict(zip(_FOUND.names, zip(*rows, strict=True), strict=True)))

    return texts.mapInArrow(extract, _FOUND_DDL).distinct()
