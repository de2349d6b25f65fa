"""Array expressions: encoding, decoding, classification and schedules."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once: a lambda's variable, where an expression would be computed again for every
    element of an inner lambda that names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def encode(chars: Column, vocab: Column, unknown: int) -> Column:
    """Ids of an array of characters under a map column; the space is the vocabulary's '|'."""
    return F.transform(
        chars,
        lambda c: F.coalesce(F.try_element_at(vocab, F.when(c == " ", "|").otherwise(c)), F.lit(unknown)),
    )


def ctc_decode(ids: Column, chars: Column, blank: int, space: int) -> Column:
    """Greedy decoding: of equal neighbours the first stays, blanks go, ids outside the map spell nothing."""
    kept = bound(ids, lambda v: F.filter(v, lambda x, i: ((i == 0) | (x != F.get(v, i - 1))) & (x != blank)))
    spelled = F.transform(kept, lambda x: F.when(x == space, " ").otherwise(F.coalesce(F.try_element_at(chars, x), F.lit(""))))
    return F.trim(F.array_join(spelled, ""))


def pad(ids: Column, size: Column, value: int = 0) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(value), (size - F.size(ids)).cast("int")))


def softmax(logits: Column) -> Column:
    powers = bound(F.array_max(logits), lambda top: F.transform(logits, lambda x: F.exp(x - top)))
    return bound(powers, lambda p: bound(F.aggregate(p, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(p, lambda x: x / total)))


def argmax(values: Column) -> Column:
    """Position from 0 of the largest value, the first among equals."""
    return F.array_position(values, F.array_max(values)) - 1


def cosine_rate(step: Column, warmup: int, total: int) -> Column:
    """Linear warm-up, then half a cosine down to zero."""
    progress = F.least((step - warmup) / max(total - warmup, 1), F.lit(1.0))
    return F.when(step < warmup, step / max(warmup, 1)).otherwise(0.5 * (1 + F.cos(F.pi() * progress)))


def largest_difference(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def filter_phases(up: int, down: int, zeros: int = 8) -> list[list[float]]:
    """Taps of the low-pass filter between rates up and down, for each phase of an output sample between two input ones:
    a sinc of `zeros` zero crossings a side under a raised cosine, each phase's taps of sum 1."""
    reach = zeros * max(up, down)
    side = reach // up + 1
    out = []
    for phase in range(up):
        taps = []
        for j in range(-side, side + 1):
            at = phase + j * up
            x = at / max(up, down)
            inside = abs(at) < reach
            taps.append((math.sin(math.pi * x) / (math.pi * x) if at else 1.0) * (0.5 + 0.5 * math.cos(math.pi * at / reach)) if inside else 0.0)
        total = sum(taps)
        out.append([t / total for t in taps])
    return out


def resample(samples: Column, rate: int, wanted: int, zeros: int = 8) -> Column:
    """Samples at `rate` as ceil(n wanted / rate) samples at `wanted`, by a polyphase filter; beyond its ends a signal is
    silent. Equal rates leave it alone."""
    shared = math.gcd(rate, wanted)
    up, down = wanted // shared, rate // shared
    if up == down:
        return samples
    phases = filter_phases(up, down, zeros)
    side = len(phases[0]) // 2
    table = F.array(*[F.array(*[F.lit(t) for t in taps]) for taps in phases])
    size = F.ceil(F.size(samples) * up / down).cast("int")

    def at(m: Column) -> Column:
        place, phase = F.floor(m * down / up).cast("int"), (m * down % up).cast("int")
        add = lambda total, j: total + F.coalesce(F.get(samples, place - j), F.lit(0.0)) * F.get(F.get(table, phase), j + side)
        return F.aggregate(F.sequence(F.lit(-side), F.lit(side)), F.lit(0.0), add)

    return F.when(size > 0, F.transform(F.sequence(F.lit(0), size - 1), at)).otherwise(F.array().cast("array<double>"))


#: The code points that stand for words: all planes above the first, two of which no text needs.
_FIRST_CODE, _CODES = 0x10000, 0x100000


def mono(samples: Column, channels: Column) -> Column:
    """Interleaved samples as their channels' means, scaled down to one where 16-bit values were given."""
    frames = F.floor(F.size(samples) / channels).cast("int")
    at = lambda i: F.slice(samples, (i * channels + 1).cast("int"), channels.cast("int"))
    mean = F.transform(F.sequence(F.lit(0), frames - 1), lambda i: F.aggregate(at(i), F.lit(0.0), lambda a, x: a + x) / channels)
    mean = F.when(frames > 0, mean).otherwise(F.array().cast("array<double>"))
    loud = F.array_max(F.transform(mean, lambda x: F.abs(x))) > 1
    return F.when(loud, F.transform(mean, lambda x: x / 32768)).otherwise(mean)


def word_edits(a: Column, b: Column) -> Column:
    """Edit distance of two arrays of words: every distinct word of the pair becomes one character. A pair of more than
    a million distinct words is an error, never a row that sums leave out."""

    def spelled(words: Column, known: Column) -> Column:
        code = lambda w: F.lpad(F.hex(F.array_position(known, w) + (_FIRST_CODE - 1)), 8, "0")
        return F.decode(F.unhex(F.array_join(F.transform(words, code), "")), "UTF-32")

    def edits(known: Column) -> Column:
        told = F.levenshtein(spelled(a, known), spelled(b, known))
        return F.when(F.size(known) <= _CODES, told).otherwise(F.raise_error(F.lit("a pair of texts has over a million distinct words")).cast("int"))

    return bound(F.array_distinct(F.concat(a, b)), edits)
