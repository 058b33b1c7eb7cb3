"""Sentence boundaries across languages and scripts (problem 6).

A pushdown automaton reads each text once over its few structural characters. Opening quotations and brackets push a
frame, closing ones pop theirs; the boundaries seen since the push are kept in the frame, given up when it is popped
(what is inside a running sentence does not end it) and released at the end of the text if it never closes. A second
stack holds the list levels (indent, marker style, number), which tell a list marker from a number with a period.
Terminators, line breaks and the gaps of scripts without marks are decided from the abbreviation trie and what follows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Abbreviations that never end a sentence, and those that may (lower case, without the last period).
NEVER = """
dr mr mrs ms mx prof rev hon st mt ft gen col lt sgt capt cmdr adm maj gov sen rep pres supt jan feb apr jun jul aug sept sep oct nov dec
mon tue tues wed thu thur thurs fri nr vols cf vs v viz approx incl excl esp resp eds
e.g i.e p.o ph.d dept univ apt bldg tel pt
hr hrn fr frl dipl ing bzw ca evtl ggf inkl exkl sog vgl ust mwst zzgl abs bspw geb gest hl jh mio mrd od tgl usf zb z.b d.h u.a z.t i.d.r o.ä med phil jur
m mm mme mlle mgr bd boul env p.ex c.-à-d fasc tél
sr sra srta srs sres d dña dra dto lic ing arq excmo excma ud uds vd vds avda av pza c/ núm nº n.º tel aprox p.ej ee
dres eng exmo exma sto sta prof profa
ул пр пер д стр корп кв тел им проф акад гр тов т.е напр св см рис табл т.н
""".split()  # fmt: skip
MAY = """
etc u.s u.s.a u.k u.n e.u a.m p.m a.d b.c d.c jr sr. inc ltd co corp bros ave blvd rd ln str yrs yr hrs hr min mins kg km cm lb lbs oz ft in
usw u.s.w u.a.m gmbh ag uu ee.uu cía s.a ltda et.al al руб коп г гг в вв т.д т.п др пр. см. тыс млн млрд чел мин сек
""".split()  # fmt: skip
#: Abbreviations only before a number.
NUMBERED = "no nos vol p pp fig figs eq sec ch chap art ext n núm max av ste ap кв д".split()
#: Abbreviations of several words, as (words before the last period, class).
PHRASES = {"z. b": "never", "d. h": "never", "u. a": "never", "o. ä": "never", "i. d. r": "never", "p. ej": "never", "p. ex": "never", "т. е": "never", "т. к": "never", "т. н": "never", "т. д": "may", "т. п": "may", "и т. д": "may", "и др": "may", "ee. uu": "may", "u. s": "may", "a. m": "may", "p. m": "may", "et al": "may", "p. o": "never"}
MONTHS = set("januar februar märz april mai juni juli august september oktober november dezember jänner".split())
#: Words after which a line cannot end a sentence.
OPEN_ENDED = set(
    """a an the my your his her its our their this that these those of to in on at by for from with into near past between and or but so because if when while until than then as who which
    der die das den dem des ein eine einen einem einer mein meine meinen meinem meiner unser unsere im am zum zur in an auf bei mit nach von vor aus und oder aber denn dass weil wenn für über
    le la les un une des du de au aux mon ma mes notre nos et ou mais que qui dans sur avec pour par chez en à el los las una unos del al mi mis su sus y o pero que en con por para sin
    o os um uma do da dos das no na nos nas meu minha seu sua e mas em com por в на с к у о от до из за и но а что мой моя мои наш""".split()
)

_PAIRS = {"“": "”", "„": "“”", "«": "»", "‹": "›", "「": "」", "『": "』", "《": "》", "(": ")", "（": "）", "[": "]", "{": "}", "【": "】", "‘": "’", '"': '"', "<": ">"}
_BRACKETS = "([{<（【"
_POPS = {c for closers in _PAIRS.values() for c in closers}
_CLOSERS = "\"”»›’'」』》)）]}】"
_QUOTES = "\"”“»›’'」』"
_STAMP = r"\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d{1,3}|-\d{1,2})?"
_MARK = rf"[\[(<#]\s*{_STAMP}\s*[\])>#]|(?<=\n){_STAMP}(?=\s)"
_NOTE = r"\(\([^()\n]{0,60}\)\)|\[[^\W\d][^\]\n@]{0,40}\]|\{[^\W\d][^}\n@]{0,40}\}|\*[^\W\d][^*\n@]{0,40}\*|<[^\W\d][^>\n@]{0,40}>|\((?:laugh|cough|cry|sigh|inaudible|pause)[^)\n]{0,30}\)"
_LABELS = r"(?:THE INTERVIEWE[RE]|The Interviewe[re]|INTERVIEWE[RE]|Interviewe[re]|RESPONDENT|Respondent|PARTICIPANT|Participant|ANSWER|Answer|(?:FE)?MALE SPEAKER|INT|Int|Resp|I|R|Q|A)\.?(?: ?\d)?\s?[:：]"
#: Spaces, marks and notes between two sentences; group 1 is a speaker label.
SKIP = re.compile(rf"(?:\s+|{_MARK}|{_NOTE}|(?<=[\])>#\d\s])[-–—](?=\s))*({_LABELS})?\s*")
_EVENTS = r"""[“”„«»‹›「」『』《》()（）\[\]{}【】‘"<>%s]|[.!?。！？｡।॥؟۔…‽]+|\n|ã[€\x80][‚\x82]|ï¼[\x81Ÿ\x9f]|à¥¤|(?<=[฀-๿ຠ-ໟက-႟ក-៿])\s+(?=[฀-๿ຠ-ໟက-႟ក-៿#<(\[A-Z])"""
#: The structural characters; the apostrophe is one only where a text holds a quotation mark that it closes.
EVENT, EVENT_SINGLE = re.compile(_EVENTS % ""), re.compile(_EVENTS % "’")
_TERMINATORS = ".!?。！？｡।॥؟۔…‽"
#: A list marker at the start of a line: number, letter or bullet.
MARKER = re.compile(r"([ \t]*)(?:\(?(\d{1,2}|[a-z])([.)])|([•·▪◦]))[ \t]+(?=\S)")
DAY = re.compile(r"\b[Aa]m \d{1,2}$")
WORD = re.compile(r"[\w’'\-]+")
_NO_GAP = set("。！？｡।॥؟۔")


def _build_trie() -> dict:
    """Reversed trie of all abbreviations; key ``""`` holds the class of a full one."""
    root: dict = {}
    for cls, words in (("number", NUMBERED), ("may", MAY), ("never", NEVER), *((c, [w]) for w, c in PHRASES.items())):
        for w in words:
            at = root
            for ch in reversed(w.rstrip(".")):
                at = at.setdefault(ch, {})
            at[""] = cls
    return root


TRIE = _build_trie()


def abbreviation(text: str, dot: int) -> str | None:
    """Class (``never``/``may``) of the longest abbreviation that ends at the period ``text[dot]``, else None."""
    at, i, found = TRIE, dot - 1, None
    while i >= 0:
        ch = text[i].lower()
        if ch in "\n\xa0":
            ch = " "
        at = at.get(ch)
        if at is None:
            break
        if "" in at and (i == 0 or text[i - 1].isspace() or text[i - 1] in "([„“«\"'’/-–—"):
            found = at[""]
        i -= 1
    if found:
        return found
    # an initial: one letter on its own ("J. Korenvik", "W. Harbour Ave.")
    if dot >= 1 and text[dot - 1].isalpha() and text[dot - 1] != "I" and (dot == 1 or text[dot - 2].isspace() or text[dot - 2] in "(.„“«\"") and ord(text[dot - 1]) < 0x530:
        return "never"
    return None


#: Garbled opening marks, which stand for what follows them: misread “ ‘ « ¿ ¡ —.
GARBLED_OPEN = re.compile("â(?:€|\x80)(?:œ|˜|”|“|\x9c|\x98|\x93|\x94)\\s?|Â[«¿¡]\\s?|‚Ä[úòîì]\\s?|ΓÇ[£ÿö]\\s?|вЂ[њ\x98”]\\s?")


def _cased(c: str) -> bool:
    return c.lower() != c.upper()


def _starts(text: str, at: int) -> str:
    """What stands at ``at``: upper, lower, digit, other (a letter without case), open, mark."""
    c = text[at]
    if c in "âÂ‚Γв":
        m = GARBLED_OPEN.match(text, at)
        if m and m.end() < len(text):
            at = m.end()
            c = text[at]
        elif c == "Â":
            return "mark"
    if c.isdigit():
        return "digit"
    if c.isalpha():
        if not _cased(c):
            return "other"
        if c.isupper() or c.istitle():
            return "upper"
        stop = text.find(" ", at)
        word = text[at : stop if stop > 0 else len(text)]
        return "upper" if "@" in word or any(ch.isdigit() for ch in word) else "lower"
    if c in _PAIRS or c in "¿¡—–-+•*":
        return "open"
    return "mark"


def _after_opening(text: str, at: int) -> str:
    n = len(text)
    kind = _starts(text, at)
    while kind == "open" and at + 1 < n:
        at += 1
        while at < n and text[at] == " ":
            at += 1
        if at >= n:
            return "open"
        kind = _starts(text, at)
    return kind


def _ends_here(text: str, i: int, j: int, k: int) -> bool:
    """Whether the terminators ``text[i:j]`` with closers up to ``k`` end a sentence; text goes on after ``k``."""
    n = len(text)
    m = SKIP.match(text, k)
    if m[1]:
        return True
    at = m.end()
    if at >= n:
        return True
    gap = text[k].isspace() or at > k
    run = text[i:j]
    quoted = any(c in _QUOTES for c in text[j:k])
    kind = _starts(text, at)
    opens = kind == "open"
    if kind == "mark":
        return text[at] not in ",;:，、；：،؛)" and gap and "\n" in text[k:at]
    if opens:
        dash = text[at] in "—–-"
        kind = _after_opening(text, at)
        if dash and (kind == "lower" or quoted or not _cased(text[at - 1] if at else "a")):
            return kind == "upper" and not quoted
        if not gap and run[-1] not in _NO_GAP:
            return False
    if kind == "lower":
        return False
    if "…" in run or "..." in run:
        return kind == "upper" or (kind == "digit" and gap) or "\n" in text[k:at]
    if quoted and kind == "other":
        return opens or "\n" in text[k:at]
    if not gap:
        return run[-1] in _NO_GAP
    if run == ".":
        cls = abbreviation(text, i)
        if cls == "never":
            return False
        if cls == "number":
            return kind != "digit"
        if cls == "may":
            return kind in ("upper", "other") or opens
        if text[i - 1 : i].isdigit() and kind == "upper":
            if DAY.search(text, max(0, i - 6), i):
                return False
            w = WORD.match(text, at)
            if w and w[0].lower() in MONTHS:
                return False
    return True


def _line_ends(text: str, i: int) -> bool:
    """Whether the line break ``text[i]`` after no terminator ends a sentence."""
    m = SKIP.match(text, i)
    at = m.end()
    if m[1]:
        return True
    if at >= len(text):
        return False
    if text.find("\n", i + 1, at) > 0 and not text[i + 1 : text.find("\n", i + 1, at)].strip():
        return True
    before = text[:i].rstrip()[-24:]
    last = before[-1:]
    if last in ",;:-–—(&/،、，" or not last:
        return False
    kind = _after_opening(text, at)
    if kind != "upper" or not (text[at].isupper() or text[at] in "¿¡“„«\"—‘"):
        return False
    w = before.split()
    return not (w and w[-1].lower().lstrip("(“„«\"'") in OPEN_ENDED)


def _list_item(text: str, at: int, levels: list[tuple[int, str, int]]) -> int:
    """End of the list marker at the line start ``at``, or -1; ``levels`` is brought to the item's level.

    A marker goes on with a level (the levels inside it end) or opens one: a bullet, the first number or letter, or
    any number where no level is open.
    """
    m = MARKER.match(text, at)
    if m is None:
        return -1
    indent = len(m[1])
    style = m[4] or ("1" if m[2].isdigit() else "a") + m[3]
    number = 0 if m[4] else int(m[2]) if m[2].isdigit() else ord(m[2]) - 96
    for k in range(len(levels) - 1, -1, -1):
        _, own, last = levels[k]
        if own == style and number == (0 if m[4] else last + 1):
            del levels[k:]
            levels.append((indent, style, number))
            return m.end()
    if number <= 1 or (not levels and style[0] == "1"):
        w = WORD.match(text, m.end())
        if w and w[0].lower() in MONTHS:
            return -1  # a day of a month
        while levels and levels[-1][0] > indent:
            levels.pop()
        levels.append((indent, style, number))
        return m.end()
    return -1


class _Stack:
    """Frames (closing characters, opening character, its place, boundaries since); the lowest one is the text itself."""

    def __init__(self):
        self.frames: list[tuple[str, str, int, list[int]]] = [("", "", 0, [])]
        self.awaited: dict[str, int] = {}

    def push(self, c: str, at: int) -> None:
        self.frames.append((_PAIRS[c], c, at, []))
        for x in _PAIRS[c]:
            self.awaited[x] = self.awaited.get(x, 0) + 1

    def pop(self, c: str) -> tuple | None:
        """The frame that ``c`` closes, popped with the frames above it that never closed; None if there is none."""
        if not self.awaited.get(c):
            return None
        while True:
            frame = self.frames.pop()
            for x in frame[0]:
                self.awaited[x] -= 1
            if c in frame[0]:
                return frame

    def opens(self, text: str, i: int) -> bool:
        """Whether the straight quotation mark ``text[i]`` opens: by the characters beside it, else by what is open."""
        before, after = text[i - 1 : i], text[i + 1 : i + 2]
        left = not before or before.isspace() or before in "([{<«“„‘—–-/:¿¡"
        right = not after or after.isspace() or after in ".,;:!?)]}>»”…—–-"
        return left if left != right else not self.awaited.get('"')


def sentence_ends(text: str) -> list[int]:
    """Ends of the sentences: characters from the start of the text through each sentence's last non-space character."""
    n = len(text.rstrip())
    if n == 0:
        return []
    start = len(text) - len(text.lstrip())
    stack = _Stack()
    levels: list[tuple[int, str, int]] = []
    pos = max(start, _list_item(text, start - len(text[:start].rpartition("\n")[2]), levels))
    search = (EVENT_SINGLE if "‘" in text else EVENT).search
    while True:
        m = search(text, pos, n)
        if m is None:
            break
        i, j = m.span()
        c = text[i]
        pos = j
        if c in _PAIRS or c in _POPS:
            if i and text[i - 1] == "€" and c in "“”‘’":
                continue  # a part of a garbled mark
            frame = None
            if c == "’" and text[j : j + 1].isalnum():
                continue
            if c in _POPS and (c != '"' or not stack.opens(text, i)):
                frame = stack.pop(c)
            if frame is None:
                if c in _PAIRS and not (c == "‘" and i and text[i - 1].isalnum()) and (c != '"' or stack.opens(text, i)):
                    stack.push(c, i)
                continue
            b = i
            while b > frame[2] + 1 and text[b - 1] in _TERMINATORS:
                b -= 1
            if b < i and frame[1] not in _BRACKETS and j < n and _ends_here(text, b, i, j):
                stack.frames[-1][3].append(j)
            continue
        ends = stack.frames[-1][3]
        if c == "\n":
            marker = _list_item(text, j, levels)
            if marker > 0:
                pos = marker
                if text[start:i].strip():
                    ends.append(len(text[:i].rstrip()))
            elif i > start and not (ends and not text[ends[-1] : i].strip()) and _line_ends(text, i):
                ends.append(len(text[:i].rstrip()))
            continue
        if c.isspace():  # a gap in a script without marks
            if SKIP.match(text, i)[1] or not ("A" <= text[j] <= "Z" and text[j - 1] != "\n"):
                ends.append(i)
            continue
        if c in "ãïà":  # a garbled full stop of a script without spaces
            if j < n:
                ends.append(j)
            continue
        k, closed = j, None
        while k < n and text[k] in _CLOSERS:
            if text[k] in _POPS:
                if text[k] == '"' and stack.opens(text, k):
                    break
                frame = stack.pop(text[k])
                closed = closed or (frame and frame[1])
                if frame and frame[1] not in _BRACKETS:
                    k += 1
                    break
            k += 1
        pos = k
        if k >= n:
            break
        if not (closed and closed in _BRACKETS) and _ends_here(text, i, j, k):
            stack.frames[-1][3].append(k)
    ends = [e for frame in stack.frames for e in frame[3]]
    # what follows the last boundary is a sentence only if it holds a letter or digit
    if ends:
        tail = SKIP.sub("", text[ends[-1] : n]) if ends[-1] < n else ""
        if ends[-1] < n and not any(ch.isalnum() for ch in tail):
            ends[-1] = n
        elif ends[-1] < n:
            ends.append(n)
    else:
        ends.append(n)
    out: list[int] = []
    begun = 0
    for e in ends:
        # a stretch without any letter or digit belongs to the sentence after it
        if e > begun and (e == n or any(ch.isalnum() for ch in text[begun:e])):
            out.append(e)
            begun = e
    return out


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def sentence_ends_udf(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in it:
        yield pd.Series([None if t is None else sentence_ends(t) for t in texts], dtype=object)


def sentence_offsets(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(rec_id, ends)``: one row a record with the ends of its sentences in order.

    Null ids and null texts give no row, blank texts none either; a text without any boundary is one sentence.
    A record repeated under its id counts once (of different texts, the one with the greatest array of ends).
    Only offsets are shuffled, never texts. Other columns are ignored.
    """
    rows = df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("rec_id"), sentence_ends_udf(F.col(text_col)).alias("ends"))
    # filtered after the grouping: a filter on the offsets would be pushed down and read every text twice
    return rows.groupBy("rec_id").agg(F.max("ends").alias("ends")).where(F.size("ends") > 0)


def sentences(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Sentence units ``(rec_id, sent_no, sent_end, sentence)`` in order, of one row an id (the greatest text, if they differ)."""
    one = df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).groupBy(F.col(id_col).alias("rec_id")).agg(F.max(text_col).alias("text"))
    ends = one.withColumn("ends", sentence_ends_udf("text"))
    at = F.when(F.col("sent_no") == 0, 0).otherwise(F.element_at("ends", F.col("sent_no")))
    flat = ends.select("rec_id", "text", "ends", F.posexplode("ends").alias("sent_no", "sent_end"))
    return flat.select("rec_id", "sent_no", "sent_end", F.trim(F.substring("text", at + 1, F.col("sent_end") - at)).alias("sentence"))
