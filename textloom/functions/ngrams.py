"""n-gram overlap of two texts, the base of chrF++ and BLEU.

The counts of a (hypothesis, reference) pair need nothing outside its row, so
they are computed where the row is: no gram is ever shuffled.  One Arrow batch
is counted at a time with integer codes instead of gram strings.
"""

from __future__ import annotations

import string
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHAR_ORDER = 6
WORD_ORDER = 2
BLEU_ORDER = 4
CHRF_ORDERS = CHAR_ORDER + WORD_ORDER
BETA = 2.0

_PUNCTUATION = frozenset(string.punctuation)
_CODE_LIMIT = 1 << 62
_COUNTS = T.ArrayType(T.LongType())
# Characters counted together; bounds the memory of a batch of long texts.
_CHUNK_CHARS = 1 << 21
# Tokens counted together.
_CHUNK_TOKENS = 1 << 18


def chrf_words(text: str) -> list[str]:
    """Words with one trailing, or else one leading, ASCII mark split off."""
    out: list[str] = []
    for word in text.split():
        if len(word) > 1 and word[-1] in _PUNCTUATION:
            out += (word[:-1], word[-1])
        elif len(word) > 1 and word[0] in _PUNCTUATION:
            out += (word[0], word[1:])
        else:
            out.append(word)
    return out


class Symbols:
    """Token sequences as dense integers, one after another."""

    def __init__(self, codes: np.ndarray, lengths: np.ndarray):
        present = np.zeros(int(codes.max()) + 1 if len(codes) else 1, dtype=bool)
        present[codes] = True
        self.ids = (np.cumsum(present) - 1)[codes].astype(np.int64)
        self.size = max(1, int(present.sum()))
        self.owner = np.repeat(np.arange(len(lengths)), lengths)
        self.n_owners = len(lengths)

    @classmethod
    def of_chars(cls, texts: Sequence[str]) -> "Symbols":
        """Code points, white space left out."""
        bare = ["".join(t.split()) for t in texts]
        codes = np.frombuffer("".join(bare).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        return cls(codes, np.fromiter(map(len, bare), np.int64, len(bare)))

    @classmethod
    def of_tokens(cls, sequences: Sequence[Sequence[str]]) -> "Symbols":
        flat = np.array([t for seq in sequences for t in seq], dtype=object)
        codes = pd.factorize(flat)[0] if len(flat) else np.zeros(0, dtype=np.int64)
        return cls(codes, np.fromiter(map(len, sequences), np.int64, len(sequences)))

    @classmethod
    def of_pairs(cls, hyps: pa.ListArray, refs: pa.ListArray) -> "Symbols":
        """Tokens of two list columns, hypothesis and reference in turn; no token becomes a Python string."""
        sizes = np.stack([pc.list_value_length(side).to_numpy(zero_copy_only=False) for side in (hyps, refs)], axis=1).astype(np.int64)
        tokens = pa.concat_arrays([hyps.flatten(), refs.flatten()]).dictionary_encode("encode")
        pairs = 2 * np.arange(len(sizes))
        owner = np.concatenate([np.repeat(pairs, sizes[:, 0]), np.repeat(pairs + 1, sizes[:, 1])])
        codes = tokens.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        return cls(codes[np.argsort(owner, kind="stable")], sizes.ravel())

    def grams(self, max_order: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """Per order: owner and exact code of each gram, and the code bound."""
        ids, bound = self.ids, self.size
        for n in range(1, max_order + 1):
            if n > 1:
                if bound * self.size * max(1, self.n_owners) >= _CODE_LIMIT:
                    seen, ids = np.unique(ids, return_inverse=True)
                    bound = max(1, len(seen))
                ids = ids[:-1] * self.size + self.ids[n - 1:]
                bound *= self.size
            first = self.owner[: len(ids)]
            inside = first == self.owner[n - 1:] if len(ids) else np.zeros(0, dtype=bool)
            yield first[inside], ids[inside], bound


def pair_overlap(symbols: Symbols, max_order: int) -> np.ndarray:
    """Counts of consecutive (hypothesis, reference) sequences.

    Shape ``(pairs, orders, 3)``: hypothesis grams, reference grams, clipped
    matches.
    """
    n_pairs = symbols.n_owners // 2
    out = np.zeros((n_pairs, max_order, 3), dtype=np.int64)
    for order, (owner, code, bound) in enumerate(symbols.grams(max_order)):
        pair, is_ref = owner >> 1, owner & 1
        for side in (0, 1):
            out[:, order, side] = np.bincount(pair[is_ref == side], minlength=n_pairs)
        # With the side as the last bit, a gram both sides have gives two
        # neighbouring keys.
        keys, counts = np.unique(2 * (pair * bound + code) + is_ref, return_counts=True)
        shared = np.flatnonzero(((keys[:-1] & 1) == 0) & (keys[:-1] + 1 == keys[1:]))
        matched = np.minimum(counts[shared], counts[shared + 1])
        out[:, order, 2] = np.bincount((keys[shared] >> 1) // bound, weights=matched, minlength=n_pairs)
    return out


def _chunks(lengths: np.ndarray, size: int = _CHUNK_CHARS) -> Iterator[slice]:
    """Consecutive rows of about ``size`` characters or tokens."""
    if len(lengths) == 0:
        return
    bucket = np.cumsum(lengths) // size
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    for lo, hi in zip(starts, np.r_[starts[1:], len(lengths)]):
        yield slice(int(lo), int(hi))


@F.pandas_udf(_COUNTS)
def _chrf_counts(hyp: pd.Series, ref: pd.Series) -> pd.Series:
    rows: list[np.ndarray] = []
    for part in _chunks((hyp.str.len() + ref.str.len()).to_numpy()):
        texts = [t for pair in zip(hyp[part], ref[part]) for t in pair]
        chars = pair_overlap(Symbols.of_chars(texts), CHAR_ORDER)
        tokens = pair_overlap(Symbols.of_tokens([chrf_words(t) for t in texts]), WORD_ORDER)
        counts = np.concatenate([chars, tokens], axis=1)
        # An order the reference lacks does not count against the hypothesis.
        counts[:, :, 0] *= counts[:, :, 1] > 0
        rows += list(counts.reshape(len(counts), -1))
    return pd.Series(rows, index=hyp.index, dtype=object)


@F.arrow_udf(_COUNTS)
def _token_counts(hyp: pa.Array, ref: pa.Array) -> pa.Array:
    lengths = [pc.list_value_length(side).to_numpy(zero_copy_only=False).astype(np.int64) for side in (hyp, ref)]
    out = np.zeros((len(hyp), BLEU_ORDER * 3), dtype=np.int64)
    for part in _chunks(lengths[0] + lengths[1], _CHUNK_TOKENS):
        size = part.stop - part.start
        symbols = Symbols.of_pairs(hyp.slice(part.start, size), ref.slice(part.start, size))
        out[part] = pair_overlap(symbols, BLEU_ORDER).reshape(size, -1)
    return pa.ListArray.from_arrays(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1], out.ravel())


def chrf_counts(hyp: Column, ref: Column) -> Column:
    """24 counts: per order (6 character, 2 word) hypothesis, reference, matches."""
    return _chrf_counts(F.coalesce(hyp, F.lit("")), F.coalesce(ref, F.lit("")))


def token_counts(hyp: Column, ref: Column) -> Column:
    """12 counts: per order 1..4 hypothesis, reference, matches over token arrays."""
    none = F.array().cast("array<string>")
    as_text = [F.coalesce(side.cast("array<string>"), none) for side in (hyp, ref)]
    return _token_counts(*as_text)


def _order(counts: Sequence[Column], order: int) -> tuple[Column, Column, Column]:
    return counts[3 * order], counts[3 * order + 1], counts[3 * order + 2]


def _sum(columns: Sequence[Column]) -> Column:
    out = columns[0]
    for column in columns[1:]:
        out = out + column
    return out


def chrf_score(counts: Sequence[Column], beta: float = BETA) -> Column:
    """chrF in 0..1 from hypothesis, reference and match counts per order."""
    usable, precisions, recalls = [], [], []
    for order in range(len(counts) // 3):
        h, r, m = _order(counts, order)
        ok = (h > 0) & (r > 0)
        usable.append(F.when(ok, 1).otherwise(0))
        precisions.append(F.when(ok, m / h).otherwise(0.0))
        recalls.append(F.when(ok, m / r).otherwise(0.0))
    n = _sum(usable)
    p, r = _sum(precisions) / n, _sum(recalls) / n
    weight = beta * beta
    return F.when((n > 0) & (p + r > 0), (1 + weight) * p * r / (weight * p + r)).otherwise(0.0)


def bleu_score(counts: Sequence[Column]) -> Column:
    """Corpus BLEU in 0..100 with exponential smoothing, from summed counts."""
    orders = [_order(counts, order) for order in range(len(counts) // 3)]
    log_sum, halvings = F.lit(0.0), F.lit(0)
    for h, _, m in orders:
        missed = (h > 0) & (m == 0)
        halvings = halvings + F.when(missed, 1).otherwise(0)
        smoothed = 1.0 / (F.pow(F.lit(2.0), halvings) * h)
        log_sum = log_sum + F.when(missed, F.log(smoothed)).when(h > 0, F.log(m / h)).otherwise(F.lit(float("-inf")))
    sys_len, ref_len = orders[0][0], orders[0][1]
    brevity = F.when(sys_len < ref_len, F.exp(1 - ref_len / sys_len)).otherwise(1.0)
    any_match = _sum([m for _, _, m in orders]) > 0
    return F.when(any_match, 100.0 * brevity * F.exp(log_sum / len(orders))).otherwise(0.0)


def _match_matrices(symbols: Symbols, n_hyps: int, max_order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per order: hypothesis totals, reference totals and clipped matches of all pairs.

    The first ``n_hyps`` sequences are hypotheses, the others references.
    """
    n_refs = symbols.n_owners - n_hyps
    for owner, code, bound in symbols.grams(max_order):
        key, counts = np.unique(owner * bound + code, return_counts=True)
        owner = key // bound
        seen, grams = np.unique(key % bound, return_inverse=True)
        totals = np.bincount(owner, weights=counts, minlength=symbols.n_owners)
        starts = np.searchsorted(owner, np.arange(n_hyps + 1))
        refs = slice(starts[n_hyps], None)
        matches = np.zeros((n_hyps, n_refs))
        for i in range(n_hyps):
            mine = slice(starts[i], starts[i + 1])
            dense = np.zeros(len(seen), dtype=np.int64)
            dense[grams[mine]] = counts[mine]
            common = np.minimum(dense[grams[refs]], counts[refs])
            matches[i] = np.bincount(owner[refs] - n_hyps, weights=common, minlength=n_refs)
        yield totals[:n_hyps, None], totals[None, n_hyps:], matches


def chrf_matrix(
    hyps: Sequence[str], refs: Sequence[str],
    beta: float = BETA, char_order: int = CHAR_ORDER, word_order: int = WORD_ORDER,
) -> np.ndarray:
    """chrF in 0..1 of every hypothesis against every reference."""
    texts = [*hyps, *refs]
    usable = np.zeros((len(hyps), len(refs)))
    precision, recall = np.zeros_like(usable), np.zeros_like(usable)
    for symbols, order in (
        (Symbols.of_chars(texts), char_order),
        (Symbols.of_tokens([chrf_words(t) for t in texts]), word_order),
    ):
        for h, r, matches in _match_matrices(symbols, len(hyps), order):
            ok = (h > 0) & (r > 0)
            usable += ok
            precision += np.where(ok, matches / np.maximum(h, 1), 0.0)
            recall += np.where(ok, matches / np.maximum(r, 1), 0.0)
    p, r = precision / np.maximum(usable, 1), recall / np.maximum(usable, 1)
    weight = beta * beta
    return np.where(p + r > 0, (1 + weight) * p * r / np.where(p + r > 0, weight * p + r, 1), 0.0)


def bleu_matrix(hyps: Sequence[str], refs: Sequence[str]) -> np.ndarray:
    """Smoothed sentence BLEU in 0..1 over the orders a hypothesis has."""
    symbols = Symbols.of_tokens([t.split() for t in (*hyps, *refs)])
    shape = (len(hyps), len(refs))
    log_sum, orders, halvings, hits = np.zeros(shape), np.zeros(shape), np.zeros(shape), np.zeros(shape)
    brevity = np.ones(shape)
    for n, (h, r, matches) in enumerate(_match_matrices(symbols, len(hyps), BLEU_ORDER)):
        if n == 0:
            brevity = np.where(h < r, np.exp(1 - r / np.maximum(h, 1)), 1.0)
        missed = (matches == 0) & (h > 0)
        halvings += missed
        share = np.where(missed, 0.5 ** halvings, np.maximum(matches, 1)) / np.maximum(h, 1)
        log_sum += np.where(h > 0, np.log(share), 0.0)
        orders += h > 0
        hits += matches
    return np.where(hits > 0, brevity * np.exp(log_sum / np.maximum(orders, 1)), 0.0)


def exact_match_matrix(hyps: Sequence[str], refs: Sequence[str]) -> np.ndarray:
    """1 where the texts are equal, else 0."""
    return (np.array(hyps, dtype=object)[:, None] == np.array(refs, dtype=object)[None, :]).astype(float)
