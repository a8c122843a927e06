"""Text normalizers: cores in Python, vectorized functions for Spark.

normalize_basic and normalize_english prepare transcripts for scoring;
english_lite is the weaker form that keeps diacritics.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .numbers import normalize_english_numbers, normalize_numbers_lite

# fixed values: rewrites of the English normalizer, applied in this order
CONTRACTIONS = (
    ("won't", "will not"), ("can't", "can not"), ("let's", "let us"), ("ain't", "aint"), ("y'all", "you all"), ("wanna", "want to"), ("gotta", "got to"), ("gonna", "going to"),
    ("i'ma", "i am going to"), ("imma", "i am going to"), ("woulda", "would have"), ("coulda", "could have"), ("shoulda", "should have"), ("ma'am", "madam"),
)
TITLES = (
    ("mr", "mister"), ("mrs", "missus"), ("st", "saint"), ("dr", "doctor"), ("prof", "professor"), ("capt", "captain"), ("gov", "governor"), ("ald", "alderman"), ("gen", "general"), ("sen", "senator"),
    ("rep", "representative"), ("pres", "president"), ("rev", "reverend"), ("hon", "honorable"), ("asst", "assistant"), ("assoc", "associate"), ("lt", "lieutenant"), ("col", "colonel"), ("jr", "junior"),
    ("sr", "senior"), ("esq", "esquire"),
)
PERFECTS = (("'d been", "had been"), ("'s been", "has been"), ("'d gone", "had gone"), ("'s gone", "has gone"), ("'d done", "had done"), ("'s got", "has got"))
ENDINGS = (("n't", "not"), ("'re", "are"), ("'s", "is"), ("'d", "would"), ("'ll", "will"), ("'t", "not"), ("'ve", "have"), ("'m", "am"))
FILLERS = "hmm mm mhm mmm uh um".split()
# fixed values: letters that no decomposition turns into plain ones
FOLDINGS = {"œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "æ": "ae", "Æ": "AE", "ß": "ss", "ẞ": "SS", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "þ": "th", "Þ": "th", "ł": "l", "Ł": "L"}
KEPT_SYMBOLS = ".%$¢€£"
# fixed values: the weaker normalizer's rewrites
LITE_CONTRACTIONS = (("won't", "will not"), ("can't", "can not"), ("let's", "let us"), ("ain't", "aint"), ("y'all", "you all"), ("wanna", "want to"), ("gonna", "going to"), ("gotta", "got to"), ("'cause", "because"))
LITE_TITLES = ("mr", "mrs", "st", "dr", "prof", "capt", "gov", "ald", "gen", "sen", "rep", "pres", "rev", "hon", "esq")
LITE_ENDINGS = ("n't", "'re", "'ve", "'ll", "'m")
#: American spellings; only entries with evidence. Inject a larger table where one is at hand.
SPELLINGS = {"mobilisation": "mobilization", "cancelation": "cancellation"}

_BRACKETS, _PARENS = re.compile(r"[<\[][^>\]]*[>\]]"), re.compile(r"\(([^)]+?)\)")
_REWRITES = [(re.compile(rf"\b{a}\b"), b) for a, b in CONTRACTIONS] + [(re.compile(rf"\b{a}\b"), b + " ") for a, b in TITLES] + [(re.compile(rf"{a}\b"), " " + b) for a, b in (*PERFECTS, *ENDINGS)]
#: Words without an apostrophe that are rewritten; a text with neither needs no rewrite.
_BARE = re.compile(rf"\b({'|'.join(a for a, _ in (*CONTRACTIONS, *TITLES) if chr(39) not in a)})\b")
_FILLERS = re.compile(rf"\b({'|'.join(FILLERS)})\b")


def _asides_removed(s: str) -> str:
    return _PARENS.sub("", _BRACKETS.sub("", s))


class _Letters(dict):
    """A translation table that looks a character up once."""

    def __init__(self, keep: str = "", drop_marks: bool = False):
        super().__init__()
        self.keep, self.drop_marks = keep, drop_marks

    def __missing__(self, code: int) -> str:
        c = chr(code)
        kind = unicodedata.category(c)
        if c in self.keep:
            to = c
        elif self.drop_marks and c in FOLDINGS:
            to = FOLDINGS[c]
        elif self.drop_marks and kind == "Mn":
            to = ""
        else:
            to = " " if kind[0] in "MSP" else c
        self[code] = to
        return to


_SPACED, _PLAIN = _Letters(), {}


def symbols_to_spaces(s: str) -> str:
    """Marks, symbols and punctuation as spaces, after compatibility composition."""
    return unicodedata.normalize("NFKC", s).translate(_SPACED)


def remove_symbols_and_diacritics(s: str, keep: str = "") -> str:
    """Diacritics dropped, other symbols as spaces, except those to keep."""
    if keep not in _PLAIN:
        _PLAIN[keep] = _Letters(keep, True)
    return unicodedata.normalize("NFKD", s).translate(_PLAIN[keep])


def normalize_basic(s: str) -> str:
    """Any language: lower case, without asides and symbols."""
    return " ".join(symbols_to_spaces(_asides_removed(s.lower())).lower().split())


def normalize_spelling(s: str, spellings: dict[str, str] = SPELLINGS) -> str:
    return " ".join(spellings.get(w, w) for w in s.split())


def normalize_english(s: str, spellings: dict[str, str] = SPELLINGS) -> str:
    """English: contractions and titles spelled out, numbers as digits, one spelling."""
    s = _FILLERS.sub("", _asides_removed(s.lower()))
    s = re.sub(r"\s+'", "'", s)
    if "'" in s or _BARE.search(s):
        for pattern, to in _REWRITES:
            s = pattern.sub(to, s)
    s = re.sub(r"(\d),(\d)", r"\1\2", s)
    s = re.sub(r"\.([^0-9]|\Z)", r" \1", s)
    s = normalize_english_numbers(remove_symbols_and_diacritics(s, KEPT_SYMBOLS))
    s = normalize_spelling(s, spellings)
    s = re.sub(r"[.$¢€£]([^0-9])", r" \1", s)
    s = re.sub(r"([^0-9])%", r"\1 ", s)
    return " ".join(s.split())


def english_lite(s: str, spellings: dict[str, str] = SPELLINGS) -> str:
    """The weaker English normalizer: titles only before a full stop, plain integers, diacritics kept."""
    s = _asides_removed(s.lower())
    for a, b in LITE_CONTRACTIONS:
        s = s.replace(a, b)
    titles = dict(TITLES)
    s = re.sub(rf"\b({'|'.join(LITE_TITLES)})\.", lambda m: titles[m[1]], s)
    endings = dict(ENDINGS)
    for a in LITE_ENDINGS:
        s = re.sub(rf"{a}\b", " " + endings[a], s)
    s = normalize_numbers_lite(symbols_to_spaces(s))
    return normalize_spelling(s, spellings)


def _vectorized(core):
    @F.pandas_udf(StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: None if t is None or t != t else core(t))

    return run


basic = _vectorized(normalize_basic)
english = _vectorized(normalize_english)
lite = _vectorized(english_lite)
numbers = _vectorized(normalize_english_numbers)
diacritics = _vectorized(lambda s: remove_symbols_and_diacritics(s, KEPT_SYMBOLS))


def basic_ascii(c: Column) -> Column:
    """normalize_basic in column expressions; equal to it on composed text without compatibility forms."""
    s = F.regexp_replace(F.regexp_replace(F.lower(c), r"[<\[][^>\]]*[>\]]", ""), r"\(([^)]+?)\)", "")
    s = F.regexp_replace(s, r"[\p{M}\p{S}\p{P}]", " ")
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def spelling(c: Column, spellings: dict[str, str] = SPELLINGS) -> Column:
    """Known words replaced, in column expressions: a map lookup for each word."""
    known = F.create_map(*[F.lit(x) for pair in spellings.items() for x in pair])
    words = F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.element_at(known, w), w)), " ")


def is_numeric(c: Column) -> Column:
    """ASCII digits with an optional fraction; no sign, no trailing point."""
    return c.rlike(r"\A[0-9]+(\.[0-9]+)?\z")
