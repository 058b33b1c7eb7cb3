"""Garbled text from wrong character encoding (problem 3).

A multinomial classifier on hashed byte bigrams, trained on synthetically garbled records, predicts the encoding
chain of every sentence that some chain could invert, from each of its runs beyond ASCII and from all of them. "Clean"
is one of its classes: only chains it finds likelier than that are inverted, likeliest first, and the first whose
inversion decodes strictly and gives plausible characters restores the sentence. Bytes that were lost (U+FFFD) can't
be restored and are only reported.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cache, lru_cache, wraps

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Chains, in words "right encoding > encoding it was read with"; a chain may be applied twice.
SINGLE_BYTE = ["cp1252", "latin-1", "cp1250", "cp1251", "cp1253", "cp1254", "cp1257", "mac-roman", "cp437", "cp850", "koi8-r", "cp866", "iso8859-15", "iso8859-2"]
MULTI_BYTE = ["gb18030", "cp932", "big5", "cp949"]
#: Text in these one-byte encodings read with another one.
LEGACY = [("cp1251", "cp1252"), ("koi8-r", "cp1252"), ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp866", "cp1251"), ("cp1251", "latin-1"), ("koi8-r", "latin-1"), ("cp1252", "mac-roman"), ("mac-roman", "cp1252"), ("cp1252", "cp437"), ("cp437", "cp1252"), ("cp1252", "cp1251"), ("cp1252", "cp1250")]
CYRILLIC = ("cp1251", "koi8-r", "cp866")
CHAINS = ["clean", "lost", *(f"utf-8>{e}" for e in SINGLE_BYTE + MULTI_BYTE), "utf-8>cp1252 x2", "utf-8>latin-1 x2", *(f"{a}>{b}" for a, b in LEGACY)]
LATIN_CHAINS = {f"{a}>{b}" for a, b in LEGACY if a not in CYRILLIC}
#: Records the classifier is fitted on at most; they are the ones of smallest text hash.
TRAIN_ROWS = 600
#: Size of the hashed bigram space.
BUCKETS = 1 << 13


#: Runs up to this length recur, so what becomes of them is kept; longer ones would only fill the memory.
SHORT = 64


def _kept(function: Callable) -> Callable:
    """The function of a run, with its results for short runs kept."""
    known = lru_cache(1 << 15)(function)
    return wraps(function)(lambda run, *args: (known if len(run) <= SHORT else function)(run, *args))


@cache
def _table(enc: str) -> str:
    """The 256 characters of a one-byte encoding; bytes it leaves undefined stand for the C1 controls, as readers do it."""
    return "".join(bytes([b]).decode(enc, "replace").replace("�", chr(b)) for b in range(256))


@cache
def _bytes_of(enc: str) -> dict[str, int]:
    return {c: b for b, c in reversed(list(enumerate(_table(enc))))}


def _misread(raw: bytes, enc: str) -> str:
    if enc in MULTI_BYTE:
        return raw.decode(enc, "replace")
    t = _table(enc)
    return "".join([t[b] for b in raw])


def garble(text: str, chain: str) -> str:
    """The text as the chain would have left it."""
    if chain == "clean":
        return text
    if chain == "lost":
        return text.encode("cp1252", "replace").decode("utf-8", "replace")
    right, _, wrong = chain.partition(">")
    wrong, _, times = wrong.partition(" x")
    for _ in range(int(times or 1)):
        text = _misread(text.encode(right, "ignore"), wrong)
    return text


# Characters that a restored run may hold: letters and marks of living scripts and common typography.
_PLAUSIBLE = re.compile(
    r"[\x09\x0a\x0d\x20-\x7e\xa0¡£§©«®°±²³´µ·º»¼½¾¿ªÀ-ÖØ-öø-ſ–—‘’‚“”„†•…‰‹›€™−×÷№"
    r"А-яЁёЄєІіЇїҐґЎўЂђЈјЉљЊњЋћЏџΑ-Ωα-ωάέήίόύώ"
    r"ء-يً-ْ٠-٩،؛؟پچژکگیۀ-ۄऀ-ॿ০-৯ঀ-৿฀-๿ა-ჰ가-힣぀-ヿ一-鿿㐀-䶿　-〃々〆「-】！-～가-힣​-‏﻿]+"
)


@cache
def _runs(enc: str) -> re.Pattern:
    """Runs of characters that the encoding makes of UTF-8 sequences."""
    t = _table(enc)
    cls = lambda lo, hi: "[" + "".join(re.escape(t[b]) for b in range(lo, hi + 1)) + "]"
    cont = cls(0x80, 0xBF)
    seq = f"(?:{cls(0xC2, 0xDF)}{cont}|{cls(0xE0, 0xEF)}{cont}{{2}}|{cls(0xF0, 0xF4)}{cont}{{3}})"
    return re.compile(f"{seq}+")


_WIDE = re.compile(r"[^\x00-\x7f]+")
_HIGH = re.compile(r"[^\x00-\x7f�]+")
_CYR_TEXT = re.compile(r"[А-яЁёІіЇїЄєҐґÀ-ÿ–—‘’“”«»…€£°½ \xa0]+")


def _fits(run: str, out: str, text: str, start: int, end: int, enc: str) -> bool:
    """Whether a restored run is plausible where it stands."""
    if out == run or not _PLAUSIBLE.fullmatch(out):
        return False
    if any("\x80" <= c <= "\x9f" for c in out):
        return False
    if enc in ("cp866", "koi8-r") and not _CYR_TEXT.fullmatch(out):
        return False
    # a clean word that happens to decode goes on with letters of its own script
    if enc in ("cp1251", "koi8-r", "cp866", "cp1253"):
        own = _bytes_of(enc)
        for c in (text[start - 1 : start], text[end : end + 1]):
            if c and c.isalpha() and own.get(c, 0) >= 0xC0:
                return False
    return not (len(out) == 1 and len(run) == 2 and run[1] in "”“’»…–—" and run[0] in "ÃÂãâéèêàçñóáíúöüäß" and not (start and text[start - 1].islower() and out.islower()))


def _decode_run(run: str, enc: str, times: int) -> str | None:
    """A run of UTF-8 read with ``enc`` (``times`` over), restored; None if it doesn't decode strictly."""
    own = _bytes_of(enc)
    try:
        new = bytes([own[c] for c in run]).decode("utf-8")
    except (UnicodeDecodeError, KeyError):
        return None
    if times > 1:
        return _runs(enc).sub(lambda m: _decode_run(m[0], enc, times - 1) or m[0], new)
    return new


def _invert_utf8(text: str, enc: str, times: int = 1) -> tuple[str, int]:
    """Text with the runs that are UTF-8 read with ``enc`` restored, and how many they were."""
    n = 0
    out, at = [], 0
    wide = enc in MULTI_BYTE
    for m in (_WIDE if wide else _runs(enc)).finditer(text):
        new = _invert_wide(m[0], enc) if wide else _decode_run(m[0], enc, times)
        if new and (wide or _fits(m[0], new, text, m.start(), m.end(), enc)):
            out += [text[at : m.start()], new]
            at = m.end()
            n += 1
    return ("".join(out) + text[at:], n) if n else (text, 0)


#: Two-byte sequences that pass for UTF-8 by chance give odd letters; these blocks are what wide text is expected to give.
_WIDE_OK = re.compile(r"[\x09\x0a\x20-\x7e£§©°·º»«¿¡½ªÀ-ÖØ-öø-ÿŒœ–—‘’“”„…€А-яЁё،؟ء-يऀ-ॿ฀-๿぀-ヿ一-鿿　-】！-～]+")


@_kept
def _invert_wide(run: str, enc: str) -> str | None:
    if "�" in run:
        # bytes were lost: restore what still decodes between the marks of loss
        pieces = []
        for piece in run.split("�"):
            try:
                pieces.append(piece.encode(enc).decode("utf-8", "replace"))
            except UnicodeEncodeError:
                return None
        new = re.sub("�+", "�", "�".join(pieces))
        return new if new.count("�") * 3 <= len(new) and _WIDE_OK.fullmatch(new.replace("�", " ")) else None
    try:
        new = run.encode(enc).decode("utf-8")
    except UnicodeError:
        return None
    return new if _WIDE_OK.fullmatch(new) and new != run else None


_CYR_WORD = re.compile(r"[А-яЁёІіЇїЄєҐґ]+")
_SENTENCE = re.compile(r"([.!?\n]+)")


def _natural_case(text: str) -> float:
    """Share of Cyrillic words written as words are: small, or with one capital in front, or all capitals."""
    words = [w for w in _CYR_WORD.findall(text) if len(w) > 1]
    return sum(w[1:].islower() or (w.isupper() and len(w) < 5) for w in words) / len(words) if words else 0.0


def _mixed(text: str, start: int, end: int, new: str) -> bool:
    """Whether a restored run would make a word of Latin and Cyrillic letters: the Latin letters with accents were right."""
    before, after = text[start - 1 : start], text[end : end + 1]
    return bool((before.isascii() and before.isalpha() and _CYR_WORD.match(new[0])) or (after.isascii() and after.isalpha() and _CYR_WORD.match(new[-1])))


@_kept
def _legacy_run(run: str, right: str, wrong: str) -> str | None:
    """A run of a one-byte encoding read with another one, restored; None if that gives no plausible text with Cyrillic."""
    own = _bytes_of(wrong)
    if not all(c in own for c in run):
        return None
    new = bytes([own[c] for c in run]).decode(right, "replace")
    return new if _PLAUSIBLE.fullmatch(new) and _CYR_WORD.search(new) else None


def _invert_legacy(text: str, right: str, wrong: str) -> tuple[str, int]:
    """Text of a one-byte encoding read with another one; taken whole, if it gives Cyrillic words in natural case."""
    total = 0
    pieces = _SENTENCE.split(text)
    for i, piece in enumerate(pieces):
        if piece.isascii():
            continue
        n, out, at = 0, [], 0
        for m in _HIGH.finditer(piece):
            new = _legacy_run(m[0], right, wrong)
            if new and not _mixed(piece, m.start(), m.end(), new):
                out += [piece[at : m.start()], new]
                at = m.end()
                n += len(m[0])
        if n < 4:
            continue
        new = "".join(out) + piece[at:]
        if _natural_case(new) > 0.8 and _natural_case(new) > _natural_case(piece) + 0.5:
            pieces[i] = new
            total += n
    return ("".join(pieces), total) if total else (text, 0)


# A character beyond ASCII beside a Latin letter.
_BESIDE_LATIN = re.compile(r"[^\x00-\x7f](?:(?=[A-Za-z])|(?<=[A-Za-z].))")


def grams(text: str) -> list[str]:
    """Each character beyond ASCII with its two neighbours, if a Latin letter is one of them; other ASCII counts as a space."""
    t = f" {text} "
    return [_neutral(t[m.start() - 1 : m.end() + 1]) for m in _BESIDE_LATIN.finditer(t)]


@lru_cache(1 << 15)
def _neutral(gram: str) -> str:
    return "".join([" " if c.isascii() and not c.isalpha() else c for c in gram])


def _invert_latin(text: str, right: str, wrong: str, seen: frozenset[str]) -> tuple[str, int]:
    """Latin text of a one-byte encoding read with another one, restored sentence by sentence where it decodes strictly
    and turns character neighbourhoods that clean records don't hold into ones they hold, and none the other way."""
    own = _bytes_of(wrong)
    total = 0
    pieces = _SENTENCE.split(text)
    for i, piece in enumerate(pieces):
        if piece.isascii():
            continue
        before = grams(piece)
        if all(g in seen for g in before):
            continue
        try:
            new = _HIGH.sub(lambda m: bytes([own[c] for c in m[0]]).decode(right), piece)
        except (UnicodeDecodeError, KeyError):
            continue
        if not _PLAUSIBLE.fullmatch(new):
            continue
        after = grams(new)
        good = sum(b in seen and a not in seen for a, b in zip(before, after, strict=False))
        bad = sum(a in seen and b not in seen for a, b in zip(before, after, strict=False))
        if len(after) == len(before) and good and not bad and 4 * sum(b not in seen for b in after) <= good:
            pieces[i] = new
            total += good
    return ("".join(pieces), total) if total else (text, 0)


def invert(text: str, chain: str, seen: frozenset[str] = frozenset()) -> tuple[str, int]:
    """Text with what the chain did undone, and the number of runs restored; (text, 0) if nothing decodes strictly."""
    if chain in ("clean", "lost"):
        return text, 0
    right, _, wrong = chain.partition(">")
    wrong, _, times = wrong.partition(" x")
    if right == "utf-8":
        return _invert_utf8(text, wrong, int(times or 1))
    return _invert_legacy(text, right, wrong) if right in CYRILLIC else _invert_latin(text, right, wrong, seen)


@cache
def _sequences() -> re.Pattern:
    """The runs of every chain that begins with UTF-8 read as a one-byte encoding; two characters beyond ASCII at least."""
    return re.compile("(?=[^\\x00-\\x7f]{2})(?:" + "|".join(_runs(e).pattern for e in SINGLE_BYTE) + ")")


@cache
def _wide_alone() -> re.Pattern:
    """Runs that a multi-byte chain may invert: longer than a character, or one of the characters that invert by themselves."""
    alone = {c for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x10000)]) if any(_invert_wide(c, e) for e in MULTI_BYTE)}
    return re.compile("[^\\x00-\\x7f]{2,}|[" + "".join(map(re.escape, sorted(alone))) + "]")


# Runs beyond ASCII that are not a single character beside a Latin letter (which no Cyrillic chain takes, see _mixed).
_OWN_RUN = re.compile(r"[^\x00-\x7f�]{2,}|(?<![A-Za-z])[^\x00-\x7f�](?![A-Za-z])")


def invertible(text: str, seen: frozenset[str] = frozenset()) -> bool:
    """Whether some chain can invert a place of the text, or bytes were lost; derived from the chains, it misses none."""
    if "�" in text or _sequences().search(text):
        return True
    if any(_invert_wide(m[0], e) for m in _wide_alone().finditer(text) for e in MULTI_BYTE):
        return True
    runs = _OWN_RUN.findall(text)
    if sum(map(len, runs)) >= 4 and any(_invert_legacy(text, a, b)[1] for a, b in LEGACY if a in CYRILLIC):
        return True
    # one-byte Latin text shows by what clean records don't hold
    return not all(g in seen for g in grams(text)) and any(_invert_latin(text, a, b, seen)[1] for a, b in LEGACY if a not in CYRILLIC)


def _hashed(raw: bytes) -> np.ndarray:
    a = np.frombuffer(raw, dtype=np.uint8).astype(np.uint32)
    return ((a[:-1] * np.uint32(256) + a[1:]) * np.uint32(2654435761) >> np.uint32(19)).astype(np.int64) % BUCKETS


def _around(text: str) -> list[str]:
    """Each run beyond ASCII, with one character around it."""
    return [text[max(0, m.start() - 1) : m.end() + 1] for m in _WIDE.finditer(text)]


def run_bigrams(text: str) -> list[np.ndarray]:
    """Hashed byte bigrams of each run beyond ASCII, with one character around it."""
    return [_hashed(run.encode("utf-8", "replace")) for run in _around(text)]


#: Short runs whose likelihoods a process keeps.
KEPT_RUNS = 1 << 14


@dataclass(frozen=True)
class Model:
    """Log-likelihoods (chain x bucket) of the multinomial classifier and the character neighbourhoods of clean records."""

    weights: np.ndarray
    seen: frozenset[str]
    kept: dict[str, np.ndarray] = field(default_factory=dict, compare=False, repr=False)

    def of_run(self, run: str) -> np.ndarray:
        """Log-likelihood of the run for each chain."""
        out = self.kept.get(run)
        if out is None:
            out = self.weights[:, _hashed(run.encode("utf-8", "replace"))].sum(axis=1)
            if len(run) <= SHORT:
                if len(self.kept) >= KEPT_RUNS:
                    self.kept.clear()
                self.kept[run] = out
        return out

    def likelier(self, text: str) -> list[int]:
        """Chains likelier than "clean" for one of the text's runs or for all of them, the likeliest of the whole first."""
        runs = _around(text)
        if not runs:
            return []
        each = np.array([self.of_run(run) for run in runs])
        total = each.sum(axis=0)
        named = (each > each[:, :1]).any(axis=0) | (total > total[0])
        return [k for k in np.argsort(-total, kind="stable").tolist() if named[k]]


#: Characters that records of any kind may hold: every chain is trained on each of them, between letters and alone.
INVENTORY = "".join(map(chr, [*range(0xA1, 0x180), *range(0x391, 0x3CA), *range(0x401, 0x460), 0x2013, 0x2014, 0x2018, 0x2019, 0x201C, 0x201D, 0x201E, 0x2020, 0x2022, 0x2026, 0x2030, 0x2039, 0x203A, 0x20AC, 0x2122]))
#: Weight of the inventory against the records.
INVENTORY_WEIGHT = 0.1


def train(clean: list[str]) -> Model:
    """The model, from clean records garbled by each chain."""
    counts = np.full((len(CHAINS), BUCKETS), 0.05)
    alone = [f"a{c}e {c} {c}n s{c}" for c in INVENTORY if c.isprintable()]
    for k, chain in enumerate(CHAINS):
        for texts, weight in ((clean, 1.0), (alone, INVENTORY_WEIGHT)):
            for text in texts:
                g = garble(text, chain)
                if chain == "clean" or g != text:
                    for b in run_bigrams(g):
                        np.add.at(counts[k], b, weight)
    weights = np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)
    return Model(weights, frozenset(g for text in clean for g in grams(text)))


def _restore(piece: str, model: Model) -> tuple[str, list[str]]:
    """A sentence with what the predicted chains did undone, and those chains; every step makes it shorter or is the first."""
    used: list[str] = []
    while True:
        # the one-byte Latin chains come last: any other one says more about a place that it decodes
        for k in sorted(model.likelier(piece), key=lambda k: CHAINS[k] in LATIN_CHAINS):
            chain = CHAINS[k]
            if used and (not chain.startswith("utf-8>") or chain[6:12] in ("cp866", "cp1251", "koi8-r", "cp1253")):
                continue  # what is restored must not be taken for Cyrillic read wrongly again
            new, n = invert(piece, chain, model.seen)
            if n:
                used.append(chain)
                piece = new
                break
        else:
            return piece, used


def diagnose(text: str, model: Model) -> tuple[str, str] | None:
    """``(chains, restored text)`` of a garbled record, or None for a clean one; chains may differ by place."""
    if not invertible(text, model.seen):
        return None
    used: list[str] = []
    pieces = _SENTENCE.split(text)
    for i, piece in enumerate(pieces):
        if not piece.isascii():
            pieces[i], chains = _restore(piece, model)
            used += chains
    if "�" in text:
        used.append("lost")
    return ("; ".join(dict.fromkeys(used)), "".join(pieces)) if used else None


def fit(df: DataFrame, text_col: str, rows: int = TRAIN_ROWS) -> Model:
    """Train on at most ``rows`` of the ``2 * rows`` non-ASCII records of smallest text hash that no chain can invert (a bounded sample of all records)."""
    t = F.col(text_col)
    sample = df.where(t.rlike("[^\\x00-\\x7F]")).select(t.alias("text")).orderBy(F.xxhash64(t), t).limit(2 * rows)
    return train([r.text for r in sample.collect() if not invertible(r.text)][:rows])


RESULT = T.StructType([T.StructField("chain", T.StringType()), T.StructField("restored", T.StringType())])


def garbled(df: DataFrame, id_col: str, text_col: str, rows: int = TRAIN_ROWS) -> DataFrame:
    """``(rec_id, chain, restored)`` of every record with garbled characters, once an id.

    ``restored`` keeps U+FFFD where bytes were lost. Null ids and null or clean texts give no row, an empty table
    none. The model (chains x buckets floats and the neighbourhoods of at most ``rows`` records) is sent to the executors. Other columns are ignored.
    """
    t = F.col(text_col)
    model = df.sparkSession.sparkContext.broadcast(fit(df, text_col, rows))

    @F.pandas_udf(RESULT)
    def run(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in it:
            found = [diagnose(x, model.value) or (None, None) for x in texts]
            yield pd.DataFrame(found, columns=["chain", "restored"], dtype=object)

    # every chain leaves a character beyond ASCII, so only records without one are passed over
    rows_ = df.where(F.col(id_col).isNotNull() & t.rlike("[^\\x00-\\x7F]")).select(F.col(id_col).alias("rec_id"), run.asNondeterministic()(t).alias("r"))
    return rows_.where("r.chain is not null").groupBy("rec_id").agg(F.max("r").alias("r")).select("rec_id", "r.chain", "r.restored")
