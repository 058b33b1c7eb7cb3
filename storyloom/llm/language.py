"""Missing or wrong document language labels (problem 9), by multilingual mixture inference.

Character n-gram likelihoods of every sentence; expectation-maximisation of the document's language proportions;
the language set is grown while the penalised likelihood rises. Sentences get the language of greatest posterior.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.llm.sentences import sentence_ends

# Two-letter code, then other codes and names of the language.
LANGUAGES = """
en eng english anglais englisch inglés inglês
de deu ger german deutsch allemand alemán
fr fra fre french français französisch francés
es spa spanish español castellano castilian
pt por portuguese português
it ita italian italiano
nl nld dut dutch nederlands flemish
ru rus russian русский
uk ukr ukrainian українська
be bel belarusian
bg bul bulgarian
sr srp serbian
hr hrv croatian
pl pol polish polski
cs ces cze czech čeština
sk slk slo slovak
sl slv slovenian slovene
ro ron rum romanian română
hu hun hungarian magyar
tr tur turkish türkçe
sv swe swedish svenska
no nor norwegian norsk nb nob nn nno
da dan danish dansk
fi fin finnish suomi
et est estonian
lv lav latvian
lt lit lithuanian
el ell gre greek ελληνικά
he heb hebrew עברית
ar ara arabic العربية
fa fas per persian farsi فارسی
ur urd urdu
hi hin hindi हिन्दी हिंदी
bn ben bengali bangla
ta tam tamil
te tel telugu
mr mar marathi
th tha thai ไทย
vi vie vietnamese
id ind indonesian
ms msa may malay
ja jpn japanese 日本語
ko kor korean 한국어
zh zho chi chinese mandarin cmn 中文 汉语 漢語
ca cat catalan català
eu eus baq basque
gl glg galician
la lat latin
sw swa swahili
""".strip().split("\n")
_CODE = {alias: line.split()[0] for line in LANGUAGES for alias in line.split()}

#: Labelled documents of each language the models are fitted on (in expectation; chosen by hash of the id).
FIT_DOCS = 250
#: n-grams seen less often are left out of the models.
MIN_COUNT = 2
#: Likelihoods of overlapping n-grams are tempered by this factor.
TEMPER = 0.5
#: Log-likelihood a further language must add (penalty for its proportion and for the choice among the languages).
PENALTY = 14.0
#: Letters a sentence needs to speak for a language of its own (characters of scripts without spaces count three).
LEAST_LETTERS = 12

_DROP = re.compile(r"\S*@\S*|[\[(<#]\s*[\d:.,\-]{4,}\s*[\])>#]|\(\([^()\n]*\)\)|\[[^\]\n]{0,40}\]|\((?:laugh|cough|cry|sigh|inaudible|pause)[^)\n]{0,30}\)|<[a-z ]{1,20}>|\*[a-z ]{1,24}\*|\{[^}\n]{0,40}\}|(?:^|(?<=\n))\s*(?:[A-Z]|Int|Resp|INT|INTERVIEWER|RESPONDENT|PARTICIPANT|ANSWER|THE INTERVIEWER|Interviewer|Respondent|Participant)\.?(?: \d)?[:：]|[\d_]+")
_GAPS = re.compile(r"[^\w’']+")
_DENSE = re.compile(r"[぀-ヿ㐀-䶿一-鿿가-힯฀-๿]")


def label_code(c: Column) -> Column:
    """Two-letter code of a language label in any spelling (code, locale, name), else null."""
    head = F.element_at(F.split(F.lower(F.trim(c)), r"[-_ (/;,]"), 1)
    pairs = F.create_map(*[F.lit(x) for kv in sorted(_CODE.items()) for x in kv])
    return F.coalesce(F.try_element_at(pairs, F.lower(F.trim(c))), F.try_element_at(pairs, head))


def normal(text: str) -> str:
    """Lower-case words between single spaces, without marks, notes, speaker labels, addresses and digits."""
    return f" {_GAPS.sub(' ', _DROP.sub(' ', text)).strip().lower()} "


#: Hash buckets of the 1-, 2- and 3-grams.
BUCKETS = (1 << 13, 1 << 16, 1 << 17)
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def hashed(text: str) -> list[np.ndarray]:
    """Bucket of the n-gram at each position, an array an order; 0 stands for grams over a line break and for single spaces."""
    a = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
    stop = a == 10
    out = []
    h, dead = np.zeros(len(a), np.uint64), np.zeros(len(a), bool)
    for n, size in enumerate(BUCKETS):
        m = len(a) - n
        if m <= 0:
            out.append(np.zeros(0, np.int64))
            continue
        h = (h[:m] + a[n:]) * _MIX[n]
        dead = dead[:m] | stop[n:]
        i = 1 + ((h ^ (h >> np.uint64(29))) * _MIX[0] >> np.uint64(40)).astype(np.int64) % (size - 1)
        i[dead | (a == 32) if n == 0 else dead] = 0
        out.append(i)
    return out


class Models:
    """n-gram log-likelihoods: a table an order of n-grams, a row a hash bucket and a column a language."""

    def __init__(self, labelled: list[tuple[str, list[str]]], rounds: int = 2):
        """``labelled`` holds (language, sentences of a document).

        Labels are partly wrong: ``rounds`` times the documents that a fit puts elsewhere as a whole are left out of
        the next one, at last also the single sentences.
        """
        self.langs = sorted({lang for lang, _ in labelled})
        col = {lang: i for i, lang in enumerate(self.langs)}
        docs = [(col[lang], [x for t in texts if len(x := normal(t)) > 6]) for lang, texts in labelled]
        for r in range(rounds + 2):
            self._fit(docs)
            if r > rounds:
                break
            kept = []
            for k, d in docs:
                if d:
                    s = self.score(d)
                    kept.append((k, d if int(s.sum(axis=0).argmax()) == k else []) if r < rounds else (k, [x for x, row in zip(d, s, strict=True) if int(row.argmax()) == k]))
            if len({k for k, d in kept if d}) == len(self.langs):
                docs = kept

    def _fit(self, docs: list[tuple[int, list[str]]]) -> None:
        counts = [np.zeros((size, len(self.langs))) for size in BUCKETS]
        for k in range(len(self.langs)):
            for c, i in zip(counts, hashed("\n".join(x for j, d in docs if j == k for x in d)), strict=True):
                c[:, k] += np.bincount(i, minlength=len(c))
        self.tables = []
        for c in counts:
            c[0] = 0
            seen = c.sum(axis=1) >= MIN_COUNT
            p = (c + 0.3) / ((c * seen[:, None]).sum(axis=0) + 0.3 * max(1, seen.sum()))
            # what is not seen in any language tells nothing
            self.tables.append(np.where(seen[:, None], np.log(p) * TEMPER, 0).astype(np.float32))

    def score(self, normals: list[str]) -> np.ndarray:
        """Log-likelihood of each normalised sentence (a row) in every language (a column)."""
        starts = np.cumsum([0, *[len(x) + 1 for x in normals[:-1]]])
        out = np.zeros((len(normals), len(self.langs)))
        for t, i in zip(self.tables, hashed("\n".join(normals)), strict=True):
            if len(i):
                out += np.add.reduceat(t[i], np.minimum(starts, len(i) - 1), axis=0)
        return out


def weight(t: str) -> int:
    """Letters of a normalised sentence, those of dense scripts three times."""
    return sum(c.isalpha() for c in t) + 2 * len(_DENSE.findall(t))


def mixture(ll: np.ndarray, steps: int = 30) -> tuple[np.ndarray, np.ndarray, float]:
    """Proportions, posteriors and log-likelihood of sentences under a mixture of the languages of the columns (EM)."""
    p = np.full(ll.shape[1], 1 / ll.shape[1])
    top = ll.max(axis=1, keepdims=True)
    like = np.exp(ll - top)
    for _ in range(steps):
        joint = like * p
        r = joint / joint.sum(axis=1, keepdims=True)
        new = r.mean(axis=0)
        if np.abs(new - p).max() < 1e-4:
            p = new
            break
        p = np.maximum(new, 1e-9)
    return p, r, float((np.log(joint.sum(axis=1)) + top[:, 0]).sum())


def select(ll: np.ndarray, strong: np.ndarray, penalty: float = PENALTY) -> list[int]:
    """Columns of the language set: grown by the language of greatest gain while that exceeds the penalty.

    Only ``strong`` sentences (enough letters) may bring in a language.
    """
    basis = ll[strong] if strong.any() else ll
    chosen = [int(basis.sum(axis=0).argmax())] if len(basis) == 1 else []
    if not chosen:
        # start from the language that most sentences prefer
        votes = np.bincount(basis.argmax(axis=1), minlength=ll.shape[1])
        chosen = [int(votes.argmax())]
    now = mixture(basis[:, chosen])[2]
    while len(chosen) < ll.shape[1]:
        best = basis[:, chosen].max(axis=1)
        gains = np.maximum(basis - best[:, None], 0).sum(axis=0)
        gains[chosen] = -1
        k = int(gains.argmax())
        if gains[k] <= penalty:
            break
        after = mixture(basis[:, [*chosen, k]])[2]
        if after - now <= penalty:
            break
        chosen.append(k)
        now = after
    return chosen


def analyse(text: str, models: Models) -> tuple[list[tuple[str, float, float]], list[tuple[int, int, str, float]]] | None:
    """Languages ``(code, share of sentences, confidence)`` and segments ``(start, end, code, confidence)``; None without words."""
    parts, at = [], 0
    for e in sentence_ends(text):
        t = normal(text[at:e])
        if len(t) > 2:
            parts.append((at, e, t))
        at = e
    if not parts:
        return None
    ll = models.score([p[2] for p in parts])
    strong = np.array([weight(p[2]) >= LEAST_LETTERS for p in parts])
    chosen = select(ll, strong)
    share, post, _ = mixture(ll[:, chosen])
    pick = post.argmax(axis=1)
    # a language needs a whole sentence that is its own
    own = [c for k, c in enumerate(chosen) if ((pick == k) & strong).any() or len(chosen) == 1]
    if own and len(own) < len(chosen):
        chosen = own
        share, post, _ = mixture(ll[:, chosen])
        pick = post.argmax(axis=1)
    # confidence: posterior against all languages, uniform prior, on the sentences of the language
    full = np.exp(ll - ll.max(axis=1, keepdims=True))
    full /= full.sum(axis=1, keepdims=True)
    langs = [(models.langs[c], float(share[k]), float(full[pick == k, c].mean()) if (pick == k).any() else 0.0) for k, c in enumerate(chosen)]
    segments: list[tuple[int, int, str, float]] = []
    for (a, b, _), k, f in zip(parts, pick, full, strict=True):
        code, conf = models.langs[chosen[k]], float(f[chosen[k]])
        if segments and segments[-1][2] == code:
            a0, _, _, c0 = segments[-1]
            segments[-1] = (a0, b, code, min(c0, conf))
        else:
            segments.append((a, b, code, conf))
    return langs, segments


RESULT = T.StructType(
    [
        T.StructField("langs", T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("share", T.DoubleType()), T.StructField("confidence", T.DoubleType())]))),
        T.StructField("segments", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType()), T.StructField("confidence", T.DoubleType())]))),
    ]
)


def fit(documents: DataFrame, docs: int = FIT_DOCS) -> Models | None:
    """Models from about ``docs`` labelled documents a language, chosen by hash of the id over all documents."""
    rows = documents.where("doc_id is not null and text is not null").select("doc_id", "text", label_code(F.col("lang")).alias("code")).where("code is not null")
    counts = {r.code: r["count"] for r in rows.groupBy("code").count().collect()}
    if not counts:
        return None
    share = F.element_at(F.create_map(*[F.lit(x) for c, n in sorted(counts.items()) for x in (c, min(1.0, docs / n))]), F.col("code"))
    sample = rows.where(F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    labelled = []
    for r in sample.select("code", "text").collect():
        cuts = [0, *sentence_ends(r.text)]
        labelled.append((r.code, [r.text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]))
    return Models(labelled) if labelled else None


def languages(documents: DataFrame, docs: int = FIT_DOCS) -> DataFrame:
    """``(doc_id, label, langs, segments)`` of every document with words.

    ``label`` is the two-letter code its label names or null; ``langs`` the languages found with share of sentences and
    confidence; ``segments`` the stretches of one language (offsets in characters). Null ids, null texts and texts
    without letters give no row; an empty table, or one without any usable label, gives none. A document repeated
    under its id with other texts gives the greatest result. The models (a few MB, bounded by ``docs``) go to the executors.
    """
    rows = _analysed(documents, docs).groupBy("doc_id").agg(F.max(F.struct("r", "label")).alias("d"))
    return rows.select("doc_id", "d.label", "d.r.langs", "d.r.segments")


def _analysed(documents: DataFrame, docs: int) -> DataFrame:
    """``(doc_id, label, r)`` of every row with words. Texts are analysed where they are read; only results are shuffled later."""
    known = fit(documents, docs)
    rows = documents.where("doc_id is not null and text is not null").select("doc_id", label_code(F.col("lang")).alias("label"), "text")
    if known is None:
        return rows.where("false").select("doc_id", "label", F.lit(None).cast(RESULT).alias("r"))
    models = documents.sparkSession.sparkContext.broadcast(known)

    @F.pandas_udf(RESULT)
    def run(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in it:
            yield pd.DataFrame([analyse(t, models.value) or (None, None) for t in texts], columns=["langs", "segments"], dtype=object)

    return rows.select("doc_id", "label", run.asNondeterministic()("text").alias("r")).where("r.langs is not null")


def relabelled(documents: DataFrame) -> DataFrame:
    """``(doc_id, lang)`` for the documents whose label is missing, no language, or not the one and only language."""
    found = _analysed(documents, FIT_DOCS).select("doc_id", "label", F.transform("r.langs", lambda x: x.lang).alias("langs"))
    case = F.col("label").isNull() | (F.size("langs") > 1) | ~F.array_contains("langs", F.coalesce("label", F.lit("")))
    return found.where(case).select("doc_id", F.explode("langs").alias("lang")).distinct()
