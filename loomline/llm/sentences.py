"""Sentence boundaries across languages and scripts (problem 10): document-centred disambiguation with corpus fallback."""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.chunks import in_chunks, with_lookup
from loomline.session import figure, stage
from loomline.sources import tables

# Abbreviations of the languages, used where neither the document nor the corpus tells.
#: Titles and other abbreviations that stand before a name, so that a capital after them says nothing.
TITLES = frozenset("mr mrs ms dr prof st hr fr frau mme mlle sr sra srta dra don lic ing г гг к κ κκ डॉ प्रो श्री د أ".split())
#: Abbreviations that stand before a number.
NUMBERED = frozenset("no nos nr nrn vol ch sec fig figs p pp art par app eq ca approx max min bldg ticket jan feb mar apr jun jul aug sep sept oct nov dec kap s abs bd env núm pág págs aprox стр рис гл п ок табл см σελ κεφ αρ ص पृ सं vgl cf véase v vs n".split())
#: Abbreviations that may end a sentence as well as stand in it.
OTHERS = frozenset("etc inc ltd co corp jr esp incl usw bzw ggf std mo di mi do sa so ex av ej ee uu s.a a.m p.m e.g i.e u.s u.k e.u ph.d мин тыс млн млрд янв февр авг сент окт нояб дек д е т т.д т.п т.е βλ δηλ π.χ κ.ά".split())
#: Those that may end a sentence even if a number follows.
FINAL = frozenset("etc inc ltd co corp jr usw a.m p.m u.s u.k e.u ph.d s.a uu std".split())
#: Words that mostly start sentences where they are capitalised.
STARTERS = frozenset(
    "the a an this that these those it its we you he she they i there here all some no not in on at after before then if when while as for from with by to but and or so set please who what which why how "
    "der die das ein eine es wir sie er ich nach vor im in am an auf bei wenn bitte wer was welche warum vgl siehe "
    "le la les un une des ce cette il elle nous vous ils on après avant dans si quand qui quels quelle pourquoi voir "
    "el los las un una este esta nosotros tras antes en si cuando quién qué cuál véase "
    "в на после до если когда кто что какие почему не мы он она они это все см "
    "ο η το οι τα μετά πριν αν όταν ποιος ποιες γιατί".split()
)
KNOWN = TITLES | NUMBERED | OTHERS

#: Letters that an abbreviation outside the lists may have.
LONGEST = 6

#: Verbs of saying that close the clause after a quotation, in scripts without capitals.
SAYING = ("问道", "说道", "答道", "喊道", "写道", "回答说", "물었다", "말했다", "답했다", "썼다", "पूछा", "कहा", "बताया", "लिखा")

OPEN = {"“": "”", "«": "»", "„": "“”", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "【": "】", "《": "》", "‹": "›", "»": "«"}
CLOSERS = "”“»」』)）]】》›\"'’"
_QUOTES = regex.compile(r"[“”«»„「」『』()（）\[\]【】《》‹›\"]")
_LINE = r"(?>\r\n|[\n\r ])"
_BLANK = regex.compile(rf"{_LINE}[^\S\n\r ]*(?:{_LINE}[^\S\n\r ]*)+| ")
_ITEM = regex.compile(r"(?:^|(?<=[\n\r ]))[^\S\n\r ]*(?:[-*•‣–—]|\d{1,3}[.)]|\(?[a-zA-Z]\))[^\S\n\r ]+(?=\S)")
_MARKS = regex.compile(r"[.!?…。！？｡؟۔।॥‽]+(?:[^\S\n\r]?[!?…！？]+)*|[;;]")
_STRONG_CJK = set("。！？｡।॥۔؟")
_TOKEN = regex.compile(r"(?r)[^\s“”«»„「」『』()（）\[\]【】\"'’`,;:!?…。！？]+")
_RUN = regex.compile(r"(?r)\p{L}+")
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}_]+(?:['’.\-][\p{L}\p{M}\p{N}_]+)*")
_CASELESS = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}\p{Devanagari}\p{Arabic}\p{Thai}\p{Hebrew}]")
_CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
_GREEK = regex.compile(r"\p{Greek}")
_THAI = regex.compile(r"\p{Thai}")
_SPACE = regex.compile(r"\s+")
_SPACED_CLOSER = regex.compile(r"[^\S\n\r]*[»›]")
_IDENTIFIER = regex.compile(r"[_\p{Nd}]")
_LETTERS = regex.compile(r"[\p{L}\p{M}]+(?:\.[\p{L}\p{M}]+)*")

_IN = r"[\p{L}\p{M}\p{N}_]"
#: Full stops that stand alone, and the short word before one, read backwards.
_STOP = regex.compile(r"(?<=[\p{L}\p{M}])\.(?![.\p{L}\p{M}\p{N}_])")
_STOPPED = regex.compile(r"(?r)(?<!%(w)s)(?<!%(w)s['’.\-])[\p{L}\p{M}]{1,%(n)d}" % {"w": _IN, "n": LONGEST})
#: Capitalised words with what lies between them and the word before.
_CAPITAL = regex.compile(r"(?:^|(?<=%(w)s))([^\p{L}\p{M}\p{N}_]*+)(?<!%(w)s)(\p{Lu}%(w)s*+(?:['’.\-]%(w)s++)*+)" % {"w": _IN})
_JOINTS = frozenset("'’.-")

Counts = Callable[[str], tuple[int, int]]


def _first(text: str, at: int, end: int) -> tuple[int, str]:
    """The next place that is neither white space nor an opening mark, and its character."""
    while at < end and (text[at].isspace() or text[at] in "“«»›„「『(（[【\"'‘¿¡`"):
        at += 1
    return at, text[at] if at < end else ""


def _word_at(text: str, at: int) -> str:
    m = _WORD.match(text, at)
    return m.group() if m else ""


def _before(text: str, start: int, at: int) -> str:
    """The token that ends at `at`; for a stop with white space behind it, so that each token is read once."""
    m = _TOKEN.match(text, start, at)
    return m.group() if m else ""


def _letters_before(text: str, start: int, at: int) -> str:
    """The token that ends at `at` if it is nothing but letters. Reads the letters only, so a long token with many stops in it is not read for each."""
    m = _RUN.match(text, start, at)
    return m.group() if m and not (m.start() > start and _TOKEN.match(text, m.start() - 1, m.start())) else ""


def _identifier(word: str) -> bool:
    return _IDENTIFIER.search(word) is not None


def evidence(text: str) -> Counter:
    """Unambiguous occurrences in one document: ('a', x) x. is an abbreviation, ('w', x) x is a word, ('s', X) X starts sentences, ('n', X) X is
    capitalised within a sentence. Of listed abbreviations also ('p', x): the full stops behind x that may be either. Words that are too long to be asked for as
    abbreviations are left out."""
    out: Counter = Counter()
    for w, n in Counter(_WORD.findall(text)).items():
        if len(w) <= LONGEST and w[-1].isalpha() and (w.isascii() or not _CASELESS.search(w)) and not _identifier(w):
            out["w", w.lower()] += n
    for m in _STOP.finditer(text):
        b = m.start()
        before = _STOPPED.match(text, 0, b)
        if not before:
            continue
        w = before.group()
        if not w.isascii() and _CASELESS.search(w):
            continue
        w = w.lower()
        if w[-1].isalpha():
            out["w", w] -= 1
        after = text[b + 1 : b + 4]
        follow = after.lstrip()
        if (after and after[0] in ",;:") or (after[:1].isspace() and "\n" not in after and follow[:1].islower() and not _identifier(_word_at(text, b + 1 + len(after) - len(follow)))):
            out["a", w] += 1
        elif not after.strip() and (b + 1 >= len(text) or _BLANK.match(text, b + 1)):
            out["w", w] += 1  # at the end of a paragraph
        elif w in KNOWN:
            out["p", w] += 1
        if not out["w", w]:
            del out["w", w]
    for m in _CAPITAL.finditer(text):
        gap, w = m.groups()
        if m.start() and gap in _JOINTS:
            continue
        if len(w) == 1 and text[m.end() : m.end() + 1] != " ":
            continue
        if _identifier(w):
            continue
        if not m.start() and not gap:
            out["s", w] += 1
            continue
        if m.start() and gap in (" ", ", "):
            opened = False
        else:
            marks = gap.strip(" \t\xa0\"“«„'")
            opened = True if m.start() == 0 or (marks and marks[-1] in "!?。！？।؟") or _BLANK.search(gap) else None if any(c in gap for c in ".…;\n") else False
        if opened:
            out["s", w] += 1
        elif opened is False and not w.isupper():
            out["n", w] += 1
    return out


class Judge:
    """Says of words of a document what they are: from the document, else from the corpus, else from the lists and the form. asked: what the corpus was asked for;
    used: what the document said, and would have said of the words that may have to be judged next."""

    def __init__(self, text: str, corpus: Counts, here: Counter | None = None):
        self.text, self.corpus, self.asked, self.used = text, corpus, set(), {}
        if here is not None:
            self.here = here

    @cached_property
    def here(self) -> Counter:
        return evidence(self.text)

    def _say(self, kind: str, word: str) -> int:
        n = self.here[kind, word]
        if n:
            self.used[kind + word] = n
        return n

    def _ask(self, key: str) -> tuple[int, int]:
        self.asked.add(key)
        return self.corpus(key)

    def abbreviation(self, word: str, follower: str) -> bool:
        """follower: the word behind it, which may have to be judged next."""
        w = word.lower()
        if len(w) == 1 or "." in w:
            return True
        yes, no = self._say("a", w), self._say("w", w)
        known = w in KNOWN
        stops = self._say("p", w) if known else 0
        if not yes and not no and (known or len(w) <= LONGEST):
            yes, no = self._ask("a" + w)
            if follower[:1].isupper() and self._say("s", follower) <= self._say("n", follower):
                self.asked.add("s" + follower)
            stops = self._ask("p" + w)[0] if known else 0
        if known:  # written with a full stop at least as often as without
            return yes + stops >= no
        return yes > 2 * no and yes >= 2 and len(w) <= LONGEST

    def starter(self, word: str) -> bool:
        yes, no = self._say("s", word), self._say("n", word)
        if yes <= no:
            y, n = self._ask("s" + word)
            yes, no = yes + y, no + n
        if not yes and not no:
            return word.lower() in STARTERS
        return yes > no


def _pairs(text: str, a: int, b: int) -> tuple[list[int], list[int]]:
    """Matched quotations and brackets of a segment: their openings and closings, outermost only."""
    stack: list[tuple[str, int]] = []
    found: list[tuple[int, int]] = []
    for m in _QUOTES.finditer(text, a, b):
        c, i = m.group(), m.start()
        if c == "»" and (i == a or text[i - 1].isspace()) and i + 1 < b and not text[i + 1].isspace() and text[i + 1] not in ",.;:!?":
            stack.append((c, i))  # »German«
            continue
        top = next((k for k in range(len(stack) - 1, -1, -1) if c in OPEN.get(stack[k][0], stack[k][0])), None)
        if top is not None and (c != '"' or stack[top][0] == '"'):
            found.append((stack[top][1], i))
            del stack[top:]
        elif c in OPEN or c == '"':
            stack.append((c, i))
    found.sort()
    opens, closes = [], []
    for o, c in found:
        if not closes or o > closes[-1]:
            opens.append(o)
            closes.append(c)
    return opens, closes


def _says_on(text: str, at: int, end: int, cjk: bool) -> bool:
    """After a quotation: does the sentence go on? cjk: it is in a script without capitals, so a small letter says nothing."""
    i = at
    while i < end and text[i].isspace():
        i += 1
    if i >= end:
        return False
    c = text[i]
    if c in ",，、;—–-:：،)" or (c.islower() and not cjk and not _identifier(_word_at(text, i))):
        return True
    if c == "と" or text.startswith(("하고", "라고", "이라고"), i):
        return True
    if _CASELESS.match(c):
        m = _MARKS.search(text, i, end)
        return bool(m) and text[i : m.start()].rstrip().endswith(SAYING)
    return False


def _period_ends(text: str, start: int, at: int, after: int, end: int, judge: Judge, closed: bool) -> bool:
    """Does the single full stop at `at` end the sentence that begins at start? after: behind it and its closing marks."""
    gap = after < end and text[after].isspace()
    nxt, c = _first(text, after, end)
    if not c:
        return True
    if not gap:
        if not c.isupper() or at == start:
            return False
        if _CASELESS.match(text[at - 1]):
            return True
        if not text[at - 1].islower():
            return False
        prev, word = _letters_before(text, start, at), _word_at(text, nxt)
        return len(prev) > 1 and len(word) > 1 and not _identifier(word) and not judge.abbreviation(prev, word)
    word = _word_at(text, nxt)
    prev = _before(text, start, at)
    core = prev.strip(".")
    letters = _LETTERS.fullmatch(core) is not None
    if not prev or closed:
        return not c.islower() or _identifier(word)
    short = letters and judge.abbreviation(core, word)
    if _CASELESS.match(prev[-1]) and not (short and core.lower() in KNOWN):
        return not (len(core) == 1)
    low = core.lower()
    if c.islower():
        return not short and _identifier(word) and not (letters and len(core) == 1)
    if c.isdigit():
        if short or (letters and low in NUMBERED):  # how the word is used elsewhere says nothing of the place before a number
            return low in FINAL
        return not core.isdigit() or len(core) > 2
    if core.isdigit() and len(core) <= 2 and c.isupper():
        return judge.starter(word)
    if not short:
        return True
    if low in TITLES or (low in NUMBERED and len(low) > 1 and not judge.starter(word)):
        return False
    if c.isupper():
        if len(word) == 1 and text[nxt + 1 : nxt + 2] == ".":  # an initial follows
            return low in ("a.m", "p.m", "etc", "usw")
        return judge.starter(word)
    if _CASELESS.match(c):
        return low in OTHERS
    return low in FINAL


def _segment(text: str, a: int, b: int, judge: Judge) -> Iterator[tuple[int, int]]:
    """Sentences of a stretch without blank lines and list markers inside."""
    m = _ITEM.match(text, a, b)
    start, body = a, m.end() if m else a
    opens, closes = _pairs(text, body, b)
    marks = [(x.start(), x.end(), x.group()) for x in _MARKS.finditer(text, body, b)]
    if _THAI.search(text, a, b):
        marks += [(x.start(), x.end(), " ") for x in _SPACE.finditer(text, body, b)]
        marks.sort()
    for i, j, s in marks:
        if i < start:
            continue
        while start < b and text[start].isspace():
            start += 1
        if s == " ":
            p = text[i - 1 : i]
            here = _THAI.search(text, start, i) is not None
            follows = j < b and (_THAI.match(text[j]) or (_THAI.match(p) and not text[j] in ",.;"))
            if here and follows and p not in ",(" and not _inside(opens, closes, i):
                yield start, i
                start = j
            continue
        if s in ";\u037e":
            if len(_GREEK.findall(text, start, i)) < 3 or (j < b and not (text[j].isspace() or text[j] in CLOSERS)):
                continue
        k = _inside(opens, closes, i)
        closed = False
        after = j
        if k:
            c = closes[k - 1]
            if text[j:c].strip() or c < i:
                continue  # within a quotation, and not at its end
            after, closed = c + 1, True
        while after < b and text[after] in CLOSERS and (text[after] not in "\"“" or closed is False and text[after : after + 1] == "”"):
            if text[after] == "'" and not (after + 1 >= b or text[after + 1].isspace()):
                break
            after += 1
            closed = True
        if closed and _says_on(text, after, b, i > start and _CJK.match(text[i - 1]) is not None):
            continue
        if not closed and s[-1] in "!?…" and (m2 := _SPACED_CLOSER.match(text, after, b)) and k:
            after = m2.end()
        strong = any(x in _STRONG_CJK for x in s)
        if strong:
            ends = True
        elif s == ".":
            ends = _period_ends(text, start, i, after, b, judge, closed)
        elif set(s) <= {".", "…"}:
            nxt, c = _first(text, after, b)
            cjk = i > start and _CJK.match(text[i - 1]) is not None
            ends = not c or cjk or ((after >= b or text[after].isspace()) and not c.islower())
        else:
            ends = after >= b or text[after].isspace() or _CASELESS.match(text[after]) is not None or (text[after].isupper() and s[-1] in "!?" and bool(_letters_before(text, start, i))) or s[0] in ";\u037e"
        if ends:
            yield start, after
            start = after
    if start < b:
        yield start, b


def _inside(opens: list[int], closes: list[int], i: int) -> int:
    """One more than the place of the pair that holds i, or 0."""
    k = bisect_right(opens, i)
    return k if k and closes[k - 1] >= i else 0


def split(text: str, corpus: Counts = lambda _: (0, 0)) -> list[tuple[int, int]]:
    """Sentences of a text as (start, end) in code points, without white space at the ends."""
    return cut(text, Judge(text, corpus))


def cut(text: str, judge: Judge) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    at = 0
    blocks = []
    for m in _BLANK.finditer(text):
        blocks.append((at, m.start()))
        at = m.end()
    blocks.append((at, len(text)))
    for a, b in blocks:
        items = [m.start() for m in _ITEM.finditer(text, a, b)]
        cuts = [a, *[i for i in items if i > a], b]
        for x, y in zip(cuts, cuts[1:], strict=False):
            for s, e in _segment(text, x, y, judge):
                while s < e and text[s].isspace():
                    s += 1
                while e > s and text[e - 1].isspace():
                    e -= 1
                if e > s:
                    out.append((s, e))
    return out


#: Rows of the first pass: sentences of documents that need no corpus, counts of the corpus, documents that need it.
FIRST = "kind int, doc_id string, s_start long, s_end long, key string, yes long, no long, text string, asked array<string>, used array<string>, times array<long>"
SENTENCE, COUNT, WAITING = 0, 1, 2


def _rows(kind: int, n: int, **cols) -> pd.DataFrame:
    blank = {"doc_id": None, "s_start": 0, "s_end": 0, "key": None, "yes": 0, "no": 0, "text": None, "asked": None, "used": None, "times": None}
    return pd.DataFrame({"kind": kind} | blank | cols, index=range(n))


def _spans(ids: list, found: list[list[tuple[int, int]]]) -> dict[str, np.ndarray]:
    ends = np.array([x for f in found for x in f], dtype=np.int64).reshape(-1, 2)
    return {"doc_id": np.repeat(np.array(ids, dtype=object), [len(f) for f in found]), "s_start": ends[:, 0], "s_end": ends[:, 1]}


def _first_pass(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts the evidence of each document for the corpus and cuts it. If that needed no word of the corpus the sentences are final; else the document comes
    out with its questions. A question about an abbreviation also asks for the word behind it, so that the second pass finds all it may ask for; what
    the document itself says of these words goes along."""
    for pdf in batches:
        yes: Counter = Counter()
        no: Counter = Counter()
        done, spans, ids, texts, asked, used, times = [], [], [], [], [], [], []
        for d, t in zip(pdf["doc_id"], pdf["text"], strict=True):
            here = evidence(t)
            for (kind, w), n in here.items():
                (no if kind in "wn" else yes)[_KEY[kind] + w] += n
            judge = Judge(t, lambda _: (0, 0), here)
            found = cut(t, judge)
            if judge.asked:
                ids.append(d)
                texts.append(t)
                asked.append(sorted(judge.asked))
                used.append(list(judge.used))
                times.append(list(judge.used.values()))
            else:
                done.append(d)
                spans.append(found)
        sentences = _spans(done, spans)
        yield _rows(SENTENCE, len(sentences["doc_id"]), **sentences)
        keys = list(yes.keys() | no.keys())
        yield _rows(COUNT, len(keys), key=pd.Series(keys, dtype="object"), yes=[yes[k] for k in keys], no=[no[k] for k in keys])
        if ids:
            yield _rows(WAITING, len(ids), doc_id=ids, text=texts, asked=pd.Series(asked), used=pd.Series(used), times=pd.Series(times))


_KEY = {"a": "a", "w": "a", "p": "p", "s": "s", "n": "s"}


def sentences(docs: DataFrame) -> DataFrame:
    """doc_id, s_start, s_end: one row per sentence of docs (doc_id, text).

    Abbreviations and proper names are told from unambiguous occurrences in the document; where it has none, from those of the whole corpus, and only then
    from lists. Terminators follow the script. Null, empty and blank texts give no rows, repeated rows give repeated rows, texts of any length are whole.
    """
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").filter("text is not null and text <> ''")  # ids as text, since pandas has no null integers
    first = stage(texts.mapInPandas(_first_pass, FIRST), chars=F.length("text"))
    at = [F.col("doc_id").cast("long").alias("doc_id"), "s_start", "s_end"]
    final = first.filter(F.col("kind") == SENTENCE).select(*at)
    chars = figure(first, "chars")
    if not chars:
        return final
    counts = first.filter(F.col("kind") == COUNT).groupBy("key").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    waiting = first.filter(F.col("kind") == WAITING)
    todo = in_chunks(waiting.select("doc_id", "text", "used", "times"), chars)
    needed = in_chunks(waiting.select("doc_id", "text", "asked"), chars).select("chunk", F.explode("asked").alias("key")).distinct().join(counts, "key")

    def second(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        known = {k: (int(y), int(n)) for k, y, n in zip(right["key"], right["yes"], right["no"], strict=True)}
        found = []
        for text, used, times in zip(left["text"], left["used"], left["times"], strict=True):
            here = Counter({(u[0], u[1:]): int(n) for u, n in zip(used, times, strict=True)})
            found.append(cut(text, Judge(text, lambda k: known.get(k, (0, 0)), here)))
        return pd.DataFrame(_spans(left["doc_id"].tolist(), found))

    return final.unionByName(with_lookup(todo, needed, second, "s_start long, s_end long").select(*at))


def p10_found(spark: SparkSession, base: str) -> DataFrame:
    return sentences(tables.read(spark, base, "documents"))
