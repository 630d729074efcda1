"""Column functions for vectors, intervals, rates and frames."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The audio frames that all budgets are counted in.
SAMPLE_RATE, HOP = 24000, 256
RATE_STEP, RATE_CLASSES = 0.25, 32

# Pruned sampling steps in 32nds, by number of steps.
PRUNED_STEPS = {
    5: (0, 2, 4, 8, 16, 32),
    6: (0, 2, 4, 6, 8, 16, 32),
    7: (0, 2, 4, 6, 8, 16, 24, 32),
    10: (0, 2, 4, 6, 8, 12, 16, 20, 24, 28, 32),
    12: (0, 2, 4, 6, 8, 10, 12, 14, 16, 20, 24, 28, 32),
    16: (0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16, 20, 24, 28, 32),
}

# Polynomials that map raw quality scores, highest power first.
QUALITY = {"signal": (-0.08397278, 1.22083953, 0.0052439), "background": (-0.13166888, 1.60915514, -0.39604546), "overall": (-0.06766283, 1.11546468, 0.04602535)}


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def polynomial(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(0.0)
    for c in coefficients:
        out = out * x + F.lit(c)
    return out


def frames(seconds: Column) -> Column:
    """Whole frames of a duration."""
    return F.floor(seconds * SAMPLE_RATE / HOP)


def rate_bucket(rate: Column) -> Column:
    """The nearest multiple of the step, halves to even."""
    return F.bround(rate / RATE_STEP) * RATE_STEP


def rate_class(rate: Column) -> Column:
    return F.least(F.floor(F.greatest(rate, F.lit(RATE_STEP)) / RATE_STEP - 1), F.lit(RATE_CLASSES - 1)).cast("int")


def soft_labels(centre: Column, sigma: float = 1.0, classes: int = RATE_CLASSES) -> Column:
    """Gaussian weights of all classes around one, summing to 1."""
    raw = F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: F.exp(-F.pow(i - centre, F.lit(2.0)) / (2 * sigma * sigma)))
    total = F.aggregate(raw, F.lit(0.0), lambda s, v: s + v)
    return F.transform(raw, lambda v: v / total)


def overlap(a_start: Column, a_stop: Column, b_start: Column, b_stop: Column) -> Column:
    return F.greatest(F.least(a_stop, b_stop) - F.greatest(a_start, b_start), F.lit(0.0))


def box_overlap(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union of boxes (left, top, right, bottom)."""
    area = lambda l, t, r, d: F.greatest(r - l, F.lit(0.0)) * F.greatest(d - t, F.lit(0.0))  # noqa: E731, E741
    both = area(F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3]))
    return both / (area(*a) + area(*b) - both + F.lit(1e-5))


def spread_tokens(count: Column, length: Column) -> Column:
    """Indices of ``count`` tokens stretched evenly over ``length`` frames; the extra ones go to the last tokens."""
    each, more = F.floor(length / count).cast("int"), F.pmod(length, count)
    index = lambda j: F.array_repeat(j, each + F.when(j >= count - more, 1).otherwise(0))
    return F.when((count > 0) & (length > 0), F.flatten(F.transform(F.sequence(F.lit(0), count - 1), index))).otherwise(F.array().cast("array<int>"))


def prefix_length(prompt: Column, total: Column, tokens: Column) -> Column:
    """Padding tokens before a text so that they last as long as the prompt; halves to even."""
    return F.when((prompt > 0) & (tokens > 0), F.bround(prompt / (total - prompt) * tokens)).otherwise(F.lit(0.0)).cast("int")


def mask(start: Column, stop: Column, length: Column) -> Column:
    """1 within [start, stop) of ``length`` places, else 0."""
    return F.transform(F.sequence(F.lit(0), length - 1), lambda i: ((i >= start) & (i < stop)).cast("int"))


def sub_starts(start: Column, stop: Column, size: float, shift: float) -> Column:
    """Windows of ``size`` every ``shift``, while they end before ``stop``, then one that ends there."""
    fits = F.greatest(F.ceil((stop - start - size) / shift), F.lit(0))
    regular = F.when(fits > 0, F.transform(F.sequence(F.lit(0).cast("long"), fits - 1), lambda k: F.struct(F.round(start + k * shift, 2).alias("start"), F.round(start + k * shift + size, 2).alias("stop"))))
    after = start + fits * shift
    tail = F.struct(F.round(F.greatest(F.least(stop - size, after), start), 2).alias("start"), F.round(stop, 2).alias("stop"))
    none = F.array().cast("array<struct<start:double,stop:double>>")
    return F.concat(F.coalesce(regular, none), F.when(after < stop, F.array(tail)).otherwise(none))


def class_rate(index: Column) -> Column:
    """The rate that a class stands for: where ``rate_class`` starts to give it."""
    return (index + 1) * RATE_STEP


def clipped(x: Column) -> Column:
    return F.greatest(F.least(x, F.lit(1.0)), F.lit(-1.0))


def limited(x: Column, knee: float = 0.8) -> Column:
    """Samples up to the knee as they are, louder ones bent below 1 by a hyperbolic tangent."""
    over = (F.abs(x) - knee) / (1 - knee)
    return F.when(F.abs(x) <= knee, x).otherwise(F.signum(x) * (knee + (1 - knee) * F.tanh(over)))


def spoken_frames(units: Column, rate: Column, speed: Column) -> Column:
    """Frames of a text of so many units: under four of them are spoken at half speed at most, and a second is the least."""
    slowed = F.when(units < 4, F.least(speed, F.lit(0.5))).otherwise(speed)
    return frames(F.greatest(F.lit(1.0), units / F.greatest(rate, F.lit(0.1)) / slowed))


def prefixed(tokens: Column, prompt: Column, total: Column, prefix: Column, anchors: Column) -> Column:
    """A text's tokens after as many prefix tokens as its prompt's share of the time asks for, and the anchors; no prefix, no anchors."""
    n = prefix_length(prompt, total, F.size(tokens))
    return F.when(n > 0, F.concat(F.array_repeat(prefix, n), anchors, tokens)).otherwise(tokens)


def seconds(milliseconds: Column) -> Column:
    """Whole milliseconds in seconds of two places, halves up."""
    return F.floor((milliseconds + 5) / 10) / 100
