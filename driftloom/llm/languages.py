"""The language of a text: dictionaries of frequent words label what they are sure of, and byte trigrams learn the rest from it.

The model is a table of trigram counts by language, trained over all given texts: those whose language the dictionaries tell with a clear lead count for
it. Its size is fixed (languages x BUCKETS), so it may reach the driver and be sent to the executors. Languages with a script of their own are
told by the script.

Defined cases: texts without enough letters or without a clear lead have no language (None); quotations and code do not count unless nothing
else is there; with no texts to learn from, the dictionaries alone are the model.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.session import cut

# Frequent words by language.
STOPWORDS = {
    "en": "the and is of to that with for you not it be this are was on have from they but what how when which would should if there can my your we",
    "de": "der die das und ist nicht mit ein eine den dem auf für sich wenn noch man auch bei zu es im oder aber wie wird dass ich sie oft mehr nach",
    "fr": "le la les des est pas que une du il pour dans sur plus avec qui ce ne et au on cela avant mais ou je vous nous sont l d qu n c",
    "es": "el los las que una del por con para se es lo no más y como antes si su pero muchas siempre cuando hay yo al esto está",
    "pt": "o os as que uma do da não em por com para se é mais e como antes ao mas quando sempre isso um nem eu dos das no na",
    "it": "il lo gli che una di per non è più con si del della da in sono come ma anche prima questo quando sempre nel sia cosa ha",
    "nl": "de het een en van is niet dat op te met voor zijn men nog als ook maar aan bij wat er wordt deze dit om je ik",
}
LANGUAGES = tuple(STOPWORDS)
BUCKETS = 8192
#: What a word of a dictionary weighs beside the trigrams, as log-odds; the share of smoothing; the lead from which a text trains the model.
VOTE, SMOOTH, SURE = 6.0, 0.2, 25.0
_LANGS_OF: dict[str, tuple[int, ...]] = {}
for _i, _words in enumerate(STOPWORDS.values()):
    for _w in dict.fromkeys(_words.split()):
        _LANGS_OF[_w] = (*_LANGS_OF.get(_w, ()), _i)
_OTHER = re.compile(r"[^\w¿¡]|[\d_]")  # ¿ and ¡ tell a language as letters do
_QUOTED = re.compile(r"[\"“„«「『][^\"”“»」』\n]*[\"”“»」』]")
_CODE = re.compile(r"(?s)```.*?(?:```|$)")
# Scripts as ranges of code points.
_SCRIPTS = (("ru", "Ѐ", "ӿ"), ("ko", "가", "힣"), ("el", "Ͱ", "Ͽ"), ("ar", "؀", "ۿ"), ("he", "֐", "׿"), ("hi", "ऀ", "ॿ"), ("th", "฀", "๿"))


def script_of(text: str) -> str | None:
    """The language whose script most letters of a text are in."""
    if text.isascii() or max(text) < "Ͱ":
        return None
    letters = sum(c.isalpha() for c in text)
    kana = sum("぀" <= c <= "ヿ" for c in text)
    found = [("ja" if kana else "zh", kana + sum("一" <= c <= "鿿" for c in text)), *((k, sum(a <= c <= b for c in text)) for k, a, b in _SCRIPTS)]
    best = max(found, key=lambda x: x[1])
    return best[0] if best[1] >= 2 and best[1] * 2 > letters else None


def prose(text: str) -> str:
    """A text without code and quotations, unless too little is left."""
    bare = _CODE.sub(" ", text) if "```" in text else text
    if any(q in bare for q in "\"“„«「『"):
        bare = _QUOTED.sub(" ", bare)
    return bare if bare is text or sum(map(str.isalpha, bare)) >= 12 else text


class _Spaced(dict):
    """What stands for each code point: itself, or a blank for what is no letter."""

    def __missing__(self, code: int) -> int:
        self[code] = 32 if _OTHER.match(chr(code)) else code
        return self[code]


_SPACED = _Spaced()


def _letters(text: str) -> str:
    return " " + " ".join(text.lower().translate(_SPACED).split()) + " "


def trigrams(letters: str) -> np.ndarray:
    b = np.frombuffer(letters.encode(), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64)
    return ((((b[:-2] << 16) | (b[1:-1] << 8) | b[2:]) * np.uint32(2654435761)) >> np.uint32(19)).astype(np.int64)


def _votes(words: list[str]) -> list[int]:
    """How many of the words each language's dictionary has."""
    votes = [0] * len(LANGUAGES)
    for w in words:
        for i in _LANGS_OF.get(w, ()):
            votes[i] += 1
    return votes


def voted(letters: str) -> str | None:
    """The language the dictionaries are sure of."""
    words = letters.split()
    if len(words) < 3:
        return None
    scores = sorted(zip(_votes(words), LANGUAGES), reverse=True)
    return scores[0][1] if scores[0][0] >= 3 and scores[0][0] >= 2 * scores[1][0] else None


def seed_counts() -> np.ndarray:
    """Counts from the dictionaries themselves."""
    counts = np.zeros((len(LANGUAGES), BUCKETS))
    for i, words in enumerate(STOPWORDS.values()):
        counts[i] += np.bincount(trigrams(f" {words} "), minlength=BUCKETS)
    return counts


def to_model(counts: np.ndarray) -> np.ndarray:
    """Log-probabilities, smoothed in the same proportion with the mean of all languages, so that a language with much more text than
    the others does not own the trigrams that they have not shown yet."""
    own = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1.0)
    mean = 0.9 * own.mean(axis=0, keepdims=True) + 0.1 / BUCKETS
    return np.log((1 - SMOOTH) * own + SMOOTH * mean).astype(np.float32)


def train(df: DataFrame, texts: list[Column], prepare: Sequence[Callable[[str], str]], most: int | None = None) -> np.ndarray:
    """The model of all texts in the given columns, in two rounds: of the texts the dictionaries are sure of, then of those the first model is.

    ``prepare`` takes from a text of each column the part that is in one language. A caller that wants a rough model may have it fitted on at most
    ``most`` texts, those of least hash."""
    columns = [f"t{i}" for i in range(len(texts))]
    rows = df.select(*(t.alias(c) for t, c in zip(texts, columns)))
    if most is not None:
        rows = cut(rows.orderBy(F.xxhash64(*columns), *columns).limit(-(-most // len(texts))))  # each task sends no more than these
    return _round(rows, prepare, _round(rows, prepare, None))


def _round(rows: DataFrame, prepare: Sequence[Callable[[str], str]], model: np.ndarray | None) -> np.ndarray:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros((len(LANGUAGES), BUCKETS), np.int64)
        for pdf in frames:
            parts = Counter(part(t) for c, part in zip(pdf.columns, prepare) for t in pdf[c] if t is not None)
            found: dict[str, list[tuple[str, int]]] = {}
            for t, n in parts.items():  # what is said again is looked at once
                letters = _letters(prose(t)) if model is None else _spelled(t)
                lang = voted(letters) if model is None else letters and _told(letters, trigrams(letters), model, SURE)
                if lang:
                    found.setdefault(lang, []).append((letters, n))
            for lang, own in found.items():
                grams = [trigrams(x) for x, _ in own]
                times = np.repeat([n for _, n in own], [len(x) for x in grams])
                counts[LANGUAGES.index(lang)] += np.bincount(np.concatenate(grams), times, BUCKETS).astype(np.int64)
        lang, bucket = np.nonzero(counts)
        yield pd.DataFrame({"lang": lang, "bucket": bucket, "n": counts[lang, bucket]})

    found = rows.mapInPandas(run, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # languages x BUCKETS at most
    counts = np.zeros((len(LANGUAGES), BUCKETS))
    counts[found["lang"], found["bucket"]] = found["n"]
    return to_model(counts + seed_counts())


def _spelled(text: str) -> str | None:
    """The letters of a text that no script tells, if they are enough."""
    bare = prose(text)
    letters = "" if script_of(bare) else _letters(bare)
    return letters if len(letters) >= 14 else None


def _told(letters: str, grams: np.ndarray, model: np.ndarray, lead: float) -> str | None:
    scores = model.take(grams, axis=1).sum(axis=1) + VOTE * np.array(_votes(letters.split()))
    best, second = np.argsort(scores)[::-1][:2]
    return LANGUAGES[best] if scores[best] - scores[second] >= lead else None


def language_of(text: str, model: np.ndarray, lead: float = 4.0) -> str | None:
    bare = prose(text)
    script = script_of(bare)
    if script:
        return script
    letters = _letters(bare)
    return _told(letters, trigrams(letters), model, lead) if len(letters) >= 14 else None
