"""English number words to digits.

Every word has a class in LEXICON. A Reading takes classified words one at a
time; it holds the number read so far, either as an integer (still open to
addition and multiplication) or as digits (open to more digits only), and what
it has written. A class has one method.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# fixed values: number words and what they stand for
UNITS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
DECADES = "twenty thirty forty fifty sixty seventy eighty ninety".split()
POWERS = {"hundred": 2, "thousand": 3, "million": 6, "billion": 9, "trillion": 12, "quadrillion": 15, "quintillion": 18, "sextillion": 21, "septillion": 24, "octillion": 27, "nonillion": 30, "decillion": 33}
ORDINALS = {"zeroth": (0, "th"), "first": (1, "st"), "second": (2, "nd"), "third": (3, "rd"), "fifth": (5, "th"), "twelfth": (12, "th")}
SIGNS = {"minus": "-", "negative": "-", "plus": "+", "positive": "+"}
CURRENCIES = {"pound": "£", "pounds": "£", "euro": "€", "euros": "€", "dollar": "$", "dollars": "$", "cent": "¢", "cents": "¢"}

NUMERIC = re.compile(r"[0-9]+(?:\.[0-9]+)?\Z")
MARKED = re.compile(r"([-+£€$¢]?)([0-9]+(?:\.[0-9]+)?)\Z")


@dataclass(frozen=True)
class Word:
    """kind: zero, unit, decade, power, sign, currency, per, and, repeat, point."""

    kind: str
    value: object = None
    suffix: str = ""


def _lexicon() -> dict[str, Word]:
    words = {w: Word("zero") for w in ("o", "oh", "zero")}
    for n, name in enumerate(UNITS, 1):
        words[name] = Word("unit", n)
        words["sixes" if name == "six" else name + "s"] = Word("unit", n, "s")
        if n > 3 and n not in (5, 12):
            words[name + ("h" if name.endswith("t") else "th")] = Word("unit", n, "th")
    words |= {w: Word("unit", n, suffix) for w, (n, suffix) in ORDINALS.items()}
    for n, name in enumerate(DECADES, 2):
        words |= {name: Word("decade", 10 * n), name[:-1] + "ies": Word("decade", 10 * n, "s"), name[:-1] + "ieth": Word("decade", 10 * n, "th")}
    for name, zeros in POWERS.items():
        words |= {name + suffix: Word("power", 10**zeros, suffix) for suffix in ("", "s", "th")}
    words |= {w: Word("sign", s) for w, s in SIGNS.items()} | {w: Word("currency", s) for w, s in CURRENCIES.items()}
    return words | {"per": Word("per"), "percent": Word("per"), "and": Word("and"), "double": Word("repeat", 2), "triple": Word("repeat", 3), "point": Word("point")}


LEXICON = _lexicon()


def _is(word: str | None, *kinds: str, suffixed: bool = False) -> bool:
    found = LEXICON.get(word) if word is not None else None
    return found is not None and (not kinds or found.kind in kinds) and (suffixed or not found.suffix)


def _scaled(digits: str, power: int) -> int | None:
    """A decimal in digits times a power of ten, where that is whole."""
    whole, _, rest = digits.partition(".")
    if not (whole + rest) or not (whole + rest).isascii() or not (whole + rest).isdigit():
        return None
    n, left = divmod(int(whole + rest) * power, 10 ** len(rest))
    return None if left else n


@dataclass
class Reading:
    out: list[str] = field(default_factory=list)
    held: int | str | None = None
    mark: str = ""

    def write(self, text: str) -> None:
        self.out.append(self.mark + text)
        self.mark, self.held = "", None

    def flush(self) -> None:
        if self.held is not None:
            self.write(str(self.held))

    def settle(self, number: int | str, suffix: str) -> None:
        """A number to go on with, or, with a suffix, one that is done."""
        if suffix:
            self.write(f"{number}{suffix}")
        else:
            self.held = number

    def digits(self) -> str:
        return "" if self.held in (None, 0) else str(self.held)

    def literal(self, mark: str, text: str, whole: str) -> None:
        if isinstance(self.held, str) and self.held.endswith("."):
            self.held += whole
            return
        self.flush()
        self.mark = mark or self.mark
        self.held = text if "." in text else int(text)

    def zero(self, word, before, after) -> None:
        self.held = self.digits() + "0"

    def unit(self, word, before, after) -> None:
        n, held = word.value, self.held
        if held is None:
            number = n
        elif isinstance(held, str):
            number = held[:-1] + str(n) if n < 10 and _is(before, "decade") else held + str(n)
        elif not _is(before, "unit") and held % (10 if n < 10 else 100) == 0:
            number = held + n
        else:
            number = f"{held}{n}"
        self.settle(number, word.suffix)

    def decade(self, word, before, after) -> None:
        held = self.held
        if held is None:
            number = word.value
        elif isinstance(held, int) and held % 100 == 0:
            number = held + word.value
        else:
            number = f"{held}{word.value}"
        self.settle(number, word.suffix)

    def power(self, word, before, after) -> None:
        held = self.held
        if held is None:
            number = word.value
        elif isinstance(held, str):
            number = _scaled(held, word.value)
            if number is None:
                self.flush()
                number = word.value
        else:  # only what is under a thousand is multiplied
            number = held - held % 1000 + held % 1000 * word.value
        self.settle(number, word.suffix)

    def sign(self, word, before, after, text) -> None:
        self.flush()
        if _is(after, suffixed=True) or (after and NUMERIC.match(after)):
            self.mark = word.value
        else:
            self.write(text)

    def currency(self, word, before, after, text) -> None:
        if self.held is None:
            self.write(text)
        else:
            self.mark = word.value
            self.flush()

    def per(self, word, before, after, text) -> bool:
        if self.held is None:
            self.write(text)
        elif text == "percent" or after == "cent":
            self.write(f"{self.held}%")
            return text == "per"
        else:
            self.flush()
            self.write(text)
        return False

    def joiner(self, word, before, after, text) -> bool:
        """and, double, triple, point; whether the next word is used up."""
        literal = bool(after and NUMERIC.match(after))
        plain = False
        if not literal and not _is(after, suffixed=True):
            plain = True
        elif word.kind == "and":
            plain = not _is(before, "power")
        elif word.kind == "repeat":
            if _is(after, "zero") or _is(after, "unit"):
                self.held = self.digits() + str(LEXICON[after].value or 0) * word.value
                return True
            plain = True
        elif literal or _is(after, "unit", "decade", "zero"):
            self.held = self.digits() + "."
        if plain:
            self.flush()
            self.write(text)
        return False


def read_words(words: list[str]) -> list[str]:
    r, skip = Reading(), False
    for before, text, after in zip([None, *words], words, [*words[1:], None]):
        if skip:
            skip = False
            continue
        if literal := MARKED.match(text):
            r.literal(literal[1], literal[2], text)
            continue
        word = LEXICON.get(text)
        if word is None:
            r.flush()
            r.write(text)
        elif word.kind in ("zero", "unit", "decade", "power"):
            getattr(r, word.kind)(word, before, after)
        elif word.kind in ("sign", "currency"):
            getattr(r, word.kind)(word, before, after, text)
        elif word.kind == "per":
            skip = r.per(word, before, after, text)
        else:
            skip = r.joiner(word, before, after, text)
    r.flush()
    return r.out


_HALF = re.compile(r"\band\s+a\s+half\b")


def _halves(text: str) -> str:
    """"and a half" after a number word reads "point five"."""
    *parts, last = _HALF.split(text)
    out = []
    for part in parts:
        if part.strip():
            number = _is(part.split()[-1], "unit", "decade", "zero", "power")
            out += [part, "point five" if number else "and a half"]
    return " ".join([*out, last] if last.strip() else out)


def normalize_english_numbers(text: str) -> str:
    """Number words as digits, with signs, currencies, ordinals and percents.

    Integers of any size are kept exact; a lone 1 is written "one".
    """
    s = re.sub(r"([a-z])([0-9])", r"\1 \2", _halves(text))
    s = re.sub(r"([0-9])([a-z])", r"\1 \2", s)
    s = re.sub(r"([0-9])\s+(st|nd|rd|th|s)\b", r"\1\2", s)
    s = " ".join(read_words(s.split()))
    s = re.sub(r"([€£$])([0-9]+) (?:and )?¢([0-9]{1,2})\b", lambda m: f"{m[1]}{m[2]}.{int(m[3]):02d}", s)
    s = re.sub(r"[€£$]0.([0-9]{1,2})\b", lambda m: f"¢{int(m[1])}", s)
    return re.sub(r"\b1(s?)\b", r"one\1", s)


# fixed values: the plainer normalizer knows these words only
LITE_POWERS = {"thousand": 10**3, "million": 10**6, "billion": 10**9, "trillion": 10**12}


def _lite_value(run: list[str]) -> int | None:
    """A run of number words as one integer; None if it isn't one."""
    total, now, any_number = 0, 0, False
    for w in run:
        word = LEXICON.get(w)
        if w in LITE_POWERS:
            total, now, any_number = total + max(now, 1) * LITE_POWERS[w], 0, True
        elif w == "hundred":
            if not now:
                return None
            now *= 100
        elif w != "and":
            now, any_number = now + (word.value or 0), True
    return total + now if any_number else None


def normalize_numbers_lite(text: str) -> str:
    """Longest runs of number words (and "and") as integers; a run that is no
    number gives up its first word and the rest is tried again."""
    known = {*UNITS, *DECADES, *LITE_POWERS, "zero", "hundred", "and"}
    words, out, i = text.split(), [], 0
    while i < len(words):
        j = i
        while j < len(words) and words[j] in known:
            j += 1
        n = _lite_value(words[i:j]) if j > i else None
        out.append(words[i] if n is None else str(n))
        i = i + 1 if n is None else j
    return " ".join(out)
