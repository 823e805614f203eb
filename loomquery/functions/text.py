"""Text analysis as column expressions, and a Porter2 stemmer for English; other languages' are in ``snowball``."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomquery.functions.snowball import stemmer

STOPWORDS = frozenset("there these their such with will then into your this that they and the are for was not but you be if of an in on no to or as is at it by a".split())
_LETTER = r"[^\P{L}\p{%sHan}\p{%sHiragana}]"
#: Unicode word segmentation (UAX 29) of words that hold a letter or number, in Java's syntax: letters are joined by an
#: inner apostrophe, full stop or colon (can't), numbers by a comma or full stop (3.5), and each Han or Hiragana character
#: is a word. Possessive, so that no text overflows the matcher's stack.
WORD = r"_*[a-z0-9\p{N}LETTER][a-z0-9_\p{M}\p{N}LETTER]*+(?:(?<=[a-z\p{M}LETTER])['’.:·](?=LETTER)[a-z0-9_\p{M}\p{N}LETTER]*+|(?<=\p{N})['’.,;](?=\p{N})[a-z0-9_\p{M}\p{N}LETTER]*+)*+|[\p{IsHan}\p{IsHiragana}]\p{M}*".replace("LETTER", _LETTER % ("Is", "Is"))
#: The same without looking around, for RE2 (DuckDB) and Python's regex.
PORTABLE_WORD = r"_*(?:LETTER[\p{M}LETTER]*(?:['’.:·]LETTER[\p{M}LETTER]*)*|\p{N}+(?:['’.,;]\p{N}+)*)(?:LETTER[\p{M}LETTER]*(?:['’.:·]LETTER[\p{M}LETTER]*)*|\p{N}+(?:['’.,;]\p{N}+)*|[_\p{M}]+)*|[\p{Han}\p{Hiragana}]\p{M}*"
for _inner in (r"[\p{M}LETTER]",):  # a negated class can't stand in a class there
    PORTABLE_WORD = PORTABLE_WORD.replace(_inner, r"(?:LETTER|\p{M})")
PORTABLE_WORD = PORTABLE_WORD.replace("LETTER", _LETTER % ("", ""))


@dataclass(frozen=True)
class Tokenizer:
    """Lower-cased Unicode words, or those of another pattern (in Java's syntax), by bytes of length, without stop words
    (compared after stemming)."""

    pattern: str = WORD
    least: int = 2
    most: int = 32
    stopwords: frozenset = STOPWORDS
    stem: bool = False
    language: str = "english"

    def words(self, text: Column) -> Column:
        """All words, before stemming and filters."""
        return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(self.pattern), F.lit(0))

    def keep(self, word: Column) -> Column:
        ok = F.octet_length(word).between(self.least, self.most)
        return ok & ~word.isin(sorted(self.stopwords)) if self.stopwords else ok

    def tokens(self, text: Column) -> Column:
        """The tokens of a text in order; a tokenizer that stems works through ``stemmed`` instead."""
        return F.filter(self.words(text), self.keep)

    def query(self, text: str) -> list[str]:
        """The tokens of a query, on the driver, by the same rules."""
        pattern = PORTABLE_WORD if self.pattern == WORD else self.pattern
        out = []
        for w in regex.findall(pattern, text.lower()):
            w = stem_word(w, self.language) if self.stem else w
            if self.least <= len(w.encode()) <= self.most and w not in self.stopwords:
                out.append(w)
        return out


def stemmed(words: DataFrame, column: str, tokenizer: Tokenizer) -> DataFrame:
    """words with column replaced by its stem and filtered. Only the different words go to Python, and come back by a join."""
    if not tokenizer.stem:
        return words.where(tokenizer.keep(F.col(column)))
    language = tokenizer.language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(0)
            yield pa.RecordBatch.from_arrays([raw, pa.array([stem_word(w, language) for w in raw.to_pylist()], pa.string())], ["raw_word", "stem_word"])

    vocabulary = words.select(column).distinct().mapInArrow(run, "raw_word string, stem_word string")
    joined = words.join(vocabulary, words[column] == vocabulary["raw_word"])
    return joined.withColumn(column, F.col("stem_word")).drop("raw_word", "stem_word").where(tokenizer.keep(F.col(column)))


_VOWELS = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_SPECIAL = {"skis": "ski", "skies": "sky", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes", "dying": "die", "lying": "lie", "tying": "tie"}
_KEPT = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_STEP2 = (("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""))
_STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")


def _regions(w: str) -> tuple[int, int]:
    def after(start: int) -> int:
        for i in range(start + 1, len(w)):
            if w[i] not in _VOWELS and w[i - 1] in _VOWELS:
                return i + 1
        return len(w)

    for prefix in ("gener", "commun", "arsen"):
        if w.startswith(prefix):
            return len(prefix), after(len(prefix))
    r1 = after(0)
    return r1, after(r1)


def _short_end(w: str) -> bool:
    if len(w) == 2:
        return w[0] in _VOWELS and w[1] not in _VOWELS
    return len(w) > 2 and w[-3] not in _VOWELS and w[-2] in _VOWELS and w[-1] not in _VOWELS + "wxY"


@lru_cache(1 << 16)
def stem_word(word: str, language: str = "english") -> str:
    """By the Snowball stemmer of the language (name or code); a language that isn't known counts as English."""
    other = stemmer(language)
    if other is not None:
        return other(word)
    w = word
    if len(w) < 3:
        return w
    if w in _SPECIAL:
        return _SPECIAL[w]
    w = w.removeprefix("'")
    w = ("Y" + w[1:]) if w.startswith("y") else w
    w = re.sub(r"(?<=[aeiouy])y", "Y", w)
    r1, r2 = _regions(w)
    w = re.sub(r"'s'$|'s$|'$", "", w)
    # 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(r"[aeiouy].", w[:-1]):
        w = w[:-1]
    if w in _KEPT:
        return w.lower()
    # 1b
    for suffix in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if w.endswith(suffix):
            if suffix in ("eed", "eedly"):
                if len(w) - len(suffix) >= r1:
                    w = w[: -len(suffix)] + "ee"
            elif re.search(r"[aeiouy]", w[: -len(suffix)]):
                w = w[: -len(suffix)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif w.endswith(_DOUBLES):
                    w = w[:-1]
                elif _short_end(w) and r1 >= len(w):
                    w += "e"
            break
    # 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWELS:
        w = w[:-1] + "i"
    # 2
    for suffix, to in _STEP2:
        if w.endswith(suffix):
            if len(w) - len(suffix) >= r1:
                if suffix == "ogi":
                    w = w[:-1] if w.endswith("logi") else w
                elif suffix == "li":
                    w = w[:-2] if w[-3:-2] and w[-3] in "cdeghkmnrt" else w
                else:
                    w = w[: -len(suffix)] + to
            break
    # 3
    for suffix, to in _STEP3:
        if w.endswith(suffix):
            if len(w) - len(suffix) >= (r2 if suffix == "ative" else r1):
                w = w[: -len(suffix)] + to
            break
    # 4
    for suffix in _STEP4:
        if w.endswith(suffix):
            if len(w) - len(suffix) >= r2 and (suffix != "ion" or w[:-3].endswith(("s", "t"))):
                w = w[: -len(suffix)]
            break
    # 5
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()
