"""Decoding evidence: softmax, argmax, sampling, timestamp rules, gates, segments."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# fixed values: thresholds of the decoder
NO_SPEECH, LOW_LOGPROB, REPETITIVE, MAX_INITIAL = 0.6, -1.0, 2.4, 50
TEMPERATURES = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)
MIN_ADVANCE, MAX_ADVANCE = 8_000, 480_000


def _let(value: Column, body) -> Column:
    """body of a value that is computed once for a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def softmax(logits: Column) -> Column:
    """Probabilities of an array, largest taken off first; time in proportion to its length."""
    exps = _let(F.struct(logits.alias("z"), F.array_max(logits).alias("top")), lambda s: F.transform(s["z"], lambda x: F.exp((x - s["top"]).cast("double"))))
    total = lambda e: F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    sums = _let(exps, lambda e: F.struct(e.alias("e"), total(e).alias("total")))
    return _let(sums, lambda s: F.transform(s["e"], lambda e: e / s["total"]))


def argmax_last(values: Column) -> Column:
    """Index of the largest value, the last among equals."""
    n = F.size(values)
    return n - F.array_position(F.reverse(values), F.array_max(values)).cast("int")


def argmax_first(values: Column) -> Column:
    return F.array_position(values, F.array_max(values)).cast("int") - 1


def avg_logprob(chosen: Column) -> Column:
    """Mean log probability of tokens and end token (the last entry); as many summands as entries."""
    return F.aggregate(chosen, F.lit(0.0), lambda a, p: a + F.log(F.greatest(p, F.lit(1.17549435e-38)))) / F.size(chosen)


def is_silence(no_speech: Column, logprob: Column) -> Column:
    return (no_speech > NO_SPEECH) & (logprob < LOW_LOGPROB)


def compression_ratio_of(text: str) -> float:
    raw = text.encode()
    return len(raw) / len(zlib.compress(raw)) if raw else 0.0


@F.pandas_udf(DoubleType())
def compression_ratio(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda t: compression_ratio_of(t or ""))


@dataclass
class XorShift:
    """xorshift64* with 24-bit floats."""

    state: int

    def __post_init__(self):
        self.state |= 1

    def next(self) -> float:
        x = self.state
        for shift in (-12, 25, -27):
            x ^= (x >> -shift if shift < 0 else x << shift) & (2**64 - 1)
        self.state = x
        return ((x * 0x2545F4914F6CDD1D) % 2**64 >> 40) / 2**24


def sample(logits: np.ndarray, temperature: float, rng: XorShift) -> int:
    """Inverse of the cumulative softmax at one draw; the largest where rounding leaves none."""
    z = np.asarray(logits, np.float64) / temperature
    p = np.exp(z - z.max())
    run = np.cumsum(p / p.sum())
    at = int(np.searchsorted(run, rng.next(), "right"))
    return at if at < len(run) else int(len(p) - 1 - np.argmax(p[::-1]))


@dataclass(frozen=True)
class Specials:
    eot: int
    sot: int
    timestamp_begin: int


def timestamp_rules(logits: np.ndarray, sampled: list[int], sp: Specials, research: bool = False) -> np.ndarray:
    """Logits with what the timestamp grammar forbids set to -inf.

    Default: control tokens are out; after a lone timestamp only a timestamp or
    the end may follow, after two none; with one token so far, the one before it
    counts as a timestamp; stamps never fall and repeat only to close; the first
    token is a stamp of at most a second. `research`: the missing second-to-last
    token counts as text, stamps may always repeat, the first token may be text
    but not the end, and control tokens stay.
    """
    out, begin = np.array(logits, np.float64), sp.timestamp_begin
    stamp = lambda t: t >= begin
    last = bool(sampled) and stamp(sampled[-1])
    before = stamp(sampled[-2]) if len(sampled) > 1 else not research
    ids = np.arange(len(out))
    if not research:
        out[(ids >= sp.sot) & (ids < begin) & (ids != sp.eot)] = -np.inf
    if last and before:
        out[begin:] = -np.inf
    elif last:
        out[(ids < sp.eot) if research else (ids < begin) & (ids != sp.eot)] = -np.inf
    stamps = [t for t in sampled if stamp(t)]
    if stamps and research:
        out[begin : stamps[-1]] = -np.inf
    elif stamps:
        out[begin : max(stamps) + (not (last and not before))] = -np.inf
    if not sampled and research:
        out[sp.eot] = -np.inf
        out[begin + MAX_INITIAL + 1 :] = -np.inf
    elif not sampled:
        out[(ids < begin) | (ids > begin + MAX_INITIAL)] = -np.inf
    return out


def choose(logits: np.ndarray, sp: Specials, temperature: float = 0.0, rng: XorShift | None = None) -> int:
    """Among timestamps if they weigh more together than the best text token, else among text."""
    z = np.asarray(logits, np.float64)
    p = np.exp(z - z.max())
    begin = sp.timestamp_begin
    stamps = p[begin:].sum() > p[:begin].max()
    part = z[begin:] if stamps else z[:begin]
    at = sample(part, temperature, rng) if temperature > 0 else int(len(part) - 1 - np.argmax(part[::-1]))
    return at + begin * stamps


def ladder(attempts: DataFrame, key: str) -> DataFrame:
    """One row a key from attempts (key, attempt, logprob, ratio, no_speech): the
    rungs up to the first that needs no other or is silence; of these the best
    log probability that isn't repetitive, the earlier among equals; else the last."""
    order = Window.partitionBy(key).orderBy("attempt")
    repetitive = F.col("ratio") > REPETITIVE
    stop = ~(repetitive | (F.col("logprob") < LOW_LOGPROB)) | is_silence(F.col("no_speech"), F.col("logprob"))
    before = F.coalesce(F.max(stop.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tried = attempts.withColumns({"__b": before, "__r": repetitive}).where("__b = 0")
    rank = Window.partitionBy(key).orderBy(F.col("__r"), F.when(~F.col("__r"), -F.col("logprob")), F.when(~F.col("__r"), F.col("attempt")).otherwise(-F.col("attempt")))
    return tried.withColumn("__k", F.row_number().over(rank)).where("__k = 1").drop("__b", "__r", "__k")


def segments(tokens: DataFrame, key: str, begin: int, tick: float = 0.02) -> DataFrame:
    """(key, segment, start, end, ids) from rows (key, pos, token, window_seconds, offset).

    A stamp with text before it closes a segment, other stamps set its start; text
    at the end closes with the window. Times are cut to the window.
    """
    by = Window.partitionBy(key).orderBy("pos")
    stamp = F.col("token") >= begin
    seconds = F.least((F.col("token") - begin) * tick, F.col("window_seconds"))
    rows = tokens.withColumns({"__s": F.when(stamp, seconds), "__t": ~stamp})
    # an island of text: the stamps so far number it
    rows = rows.withColumn("__i", F.sum(stamp.cast("int")).over(by))
    rows = rows.withColumn("__from", F.last("__s", ignorenulls=True).over(by))
    rows = rows.withColumn("__to", F.first("__s", ignorenulls=True).over(by.rowsBetween(1, Window.unboundedFollowing)))
    text = rows.where("__t").groupBy(key, "__i").agg(
        F.first("__from").alias("f"), F.first("__to").alias("t"), F.first("window_seconds").alias("w"), F.first("offset").alias("o"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]).alias("ids"),
    )
    number = F.row_number().over(Window.partitionBy(key).orderBy("__i"))
    return text.select(key, number.alias("segment"), (F.col("o") + F.coalesce("f", F.lit(0.0))).alias("start"), (F.col("o") + F.coalesce("t", "w")).alias("end"), "ids")


def paired_segments(tokens: list[int], begin: int, eot: int, window: float, tick: float = 0.02) -> list[tuple[float, float, list[int]]]:
    """The research form: stamps two by two, an unpaired tail dropped; with fewer than two, one segment of all text."""
    at = [i for i, t in enumerate(tokens) if t >= begin]
    if len(at) < 2:
        return [(0.0, window, [t for t in tokens if t < eot])]
    seconds = lambda i: min((tokens[i] - begin) * tick, window)
    return [(seconds(a), seconds(b), [t for t in tokens[a + 1 : b] if t < eot]) for a, b in zip(at[::2], at[1::2])]


def advance(last_stamp: Column, rate: int = 16_000) -> Column:
    """Samples to the next window: to the last stamp, within bounds; a whole window without one."""
    to = F.when(last_stamp > 0, F.least((last_stamp * rate).cast("long"), F.lit(MAX_ADVANCE))).otherwise(F.lit(MAX_ADVANCE))
    return F.greatest(to, F.lit(MIN_ADVANCE))


def advance_of(last_stamp: float, rate: int = 16_000) -> int:
    """As advance, of one number."""
    to = min(int(last_stamp * rate), MAX_ADVANCE) if last_stamp > 0 else MAX_ADVANCE
    return max(to, MIN_ADVANCE)


def windows_of(n_samples: int, advance_at) -> Iterator[int]:
    """Starts of the windows of a recording; advance_at decodes the window at a start
    and says how many samples on the next begins."""
    at = 0
    while at < n_samples:
        yield at
        at += max(advance_at(at), 1)


def evidence_report(segs: DataFrame) -> DataFrame:
    """One row over segments (avg_logprob, temperature, language)."""
    return segs.agg(
        F.count("*").alias("segments"), F.avg("avg_logprob").alias("avg_logprob_mean"), F.min("avg_logprob").alias("avg_logprob_min"), F.count_if(F.col("temperature") > 0).alias("fallback_segments"),
        F.count_if(F.col("avg_logprob") < LOW_LOGPROB).alias("low_confidence_segments"), F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"),
    )


@dataclass
class Greedy:
    """A greedy decoding loop over a function from (prefix, tokens) to logits."""

    step: object
    specials: Specials
    longest: int = 224
    trail: list[float] = field(default_factory=list)

    def run(self, prefix: list[int], temperature: float = 0.0, seed: int = 0) -> tuple[list[int], float]:
        tokens, total, rng = [], 0.0, XorShift(seed)
        while len(prefix) + len(tokens) < self.longest:
            z = timestamp_rules(self.step(prefix, tokens), tokens, self.specials)
            t = choose(z, self.specials, temperature, rng)
            p = np.exp(z - z.max())
            total += float(np.log(max(p[t] / p.sum(), 1.17549435e-38)))
            if t == self.specials.eot:
                break
            tokens.append(t)
        return tokens, total / (len(tokens) + 1)
