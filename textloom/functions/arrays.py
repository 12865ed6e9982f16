"""Array arithmetic on model outputs and token ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a label position that is not supervised.
IGNORE = -100


def _longs(column: Column) -> Column:
    return column.cast("array<bigint>")


def repeat_long(value: int, times: Column) -> Column:
    """``times`` copies of an integer; none when ``times`` is not positive."""
    return F.array_repeat(F.lit(value).cast("bigint"), F.greatest(times, F.lit(0)).cast("int"))


def take(array: Column, n: Column) -> Column:
    """The first n elements."""
    return F.slice(array, F.lit(1), F.greatest(n, F.lit(0)).cast("int"))


def drop(array: Column, n: Column) -> Column:
    """All but the first n elements."""
    start = F.greatest(n, F.lit(0)).cast("int")
    return F.slice(array, start + 1, F.greatest(F.size(array) - start, F.lit(0)))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once.

    Inside a lambda Spark evaluates a captured expression anew per element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda acc, x: acc + x)


def softmax(logits: Column) -> Column:
    """Softmax over one array, shifted by its maximum."""
    logits = logits.cast("array<double>")
    exps = let(F.array_max(logits), lambda peak: F.transform(logits, lambda x: F.exp(x - peak)))
    return let(exps, lambda e: let(total(e), lambda z: F.transform(e, lambda x: x / z)))


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def class_prob(probs: Column, class_idx: Column) -> Column:
    """Probability at a 0-based class index; null when the class is unknown."""
    return F.get(probs, class_idx)


def group_prob(probs: Column, member: Column) -> Column:
    """Sum of the probabilities whose class is a member (array of booleans)."""
    return total(F.zip_with(probs, member, lambda p, m: F.when(m, p).otherwise(0.0)))


def mask_labels(input_ids: Column, prompt_len: Column) -> Column:
    """Labels of a row: the prompt part is not supervised, the rest is."""
    cut = F.least(prompt_len.cast("int"), F.size(input_ids))
    return F.concat(repeat_long(IGNORE, cut), _longs(drop(input_ids, cut)))


def first_supervised(labels: Column) -> Column:
    """Number of positions before the first supervised one."""
    found = F.array_position(F.transform(labels, lambda x: x != IGNORE), True)
    return F.when(found > 0, found - 1).otherwise(F.size(labels))


def split_at_mask(input_ids: Column, labels: Column) -> tuple[Column, Column]:
    """Prompt ids and reference ids of a masked row."""
    cut = first_supervised(labels)
    return take(input_ids, cut), F.filter(labels, lambda x: x != IGNORE)


def ensure_suffix(ids: Column, suffix: list[int]) -> Column:
    """Append the suffix unless the ids end with it already."""
    tail = F.array(*[F.lit(x).cast("bigint") for x in suffix])
    if not suffix:
        return ids
    ends = (F.size(ids) >= len(suffix)) & (drop(ids, F.size(ids) - len(suffix)) == tail)
    return F.when(ends, ids).otherwise(F.concat(ids, tail))


def masked_logprob(logp: Column, prompt_len: Column) -> tuple[Column, Column]:
    """Sum and count of the token log-probabilities behind the prompt.

    ``logp[i]`` belongs to token i.  A prompt that fills the row gives (0.0, 0).
    """
    kept = drop(logp, prompt_len)
    return total(kept), F.size(kept).cast("bigint")


def length_norm_score(logp_sum: Column, token_count: Column, length_norm: bool = True) -> Column:
    """Sum, or mean per token with minus infinity for no token."""
    if not length_norm:
        return logp_sum
    return F.when(token_count > 0, logp_sum / token_count).otherwise(F.lit(float("-inf")))


def supervised_share(labels: Column) -> Column:
    """Share of the positions that are supervised."""
    kept = F.size(F.filter(labels, lambda x: x != IGNORE))
    return kept / F.greatest(F.lit(1), F.size(labels))


def pad_right(ids: Column, width: Column, value: int) -> Column:
    """Fill up to ``width``, or cut to it."""
    return F.concat(_longs(take(ids, width)), repeat_long(value, width - F.size(ids)))
