"""Fuzzy text functions that have no built-in expression: Python kernels, and Arrow UDFs over them.

The kernels work on plain strings; the UDFs get whole Arrow batches and score each distinct input of a batch once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import functions as F

_WORD = re.compile(r"\w+")


# ---- strings --------------------------------------------------------------------------------------------------


def to_ascii(text: str) -> str:
    """Compatibility decomposition without combining marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def to_nfc(text: str) -> str:
    return unicodedata.normalize("NFC", text)


def sorted_tokens(text: str) -> str:
    return " ".join(sorted(_WORD.findall(text.lower())))


def _places(a: str) -> dict[str, int]:
    """The places of each character as the bits of an integer."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    return where


def _common(hits: Iterable[int], full: int) -> int:
    """A row of the table of common subsequences as the bits of one integer: a zero bit at place i says that the row's
    value grows there; each character, given as its places, updates all places at once."""
    row = full
    for where in hits:
        hit = row & where
        row = (row + hit | row - hit) & full
    return row


def lcs_length(a: str, b: str) -> int:
    """The length of the longest common subsequence."""
    where = _places(a)
    return len(a) - _common([where[c] for c in b if c in where], (1 << len(a)) - 1).bit_count()


def best_stretch(a: str, b: str) -> tuple[int, int]:
    """(length, start): the longest common subsequence of ``a`` with a stretch of ``b`` of its length, which mustn't be
    longer than ``b``, and the first such stretch.

    A stretch that starts k places later has at most k more in common, so those that can't be better are passed over.
    """
    n, full, where = len(a), (1 << len(a)) - 1, _places(a)
    hits = [where.get(c, 0) for c in b]
    best, start, i = -1, 0, 0
    while i <= len(b) - n and best < n:
        common = n - _common(hits[i : i + n], full).bit_count()
        if common > best:
            best, start = common, i
        i += best - common + 1
    return best, start


def ratio(a: str, b: str) -> float:
    """Twice the common subsequence by both lengths: 0 to 1, and 1 for two empty strings."""
    total = len(a) + len(b)
    return 2 * lcs_length(a, b) / total if total else 1.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with a stretch of the longer: stretches of its length, and shorter ones
    at both ends."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 1.0 if not b else 0.0
    n = len(a)
    best = best_stretch(a, b)[0] / n
    for x, y in ((a, b[: n - 1]), (a[::-1], b[::-1][: n - 1])):
        # One pass gives all stretches that begin at this end.
        where, full = _places(x), (1 << n) - 1
        row = full
        for i, c in enumerate(y):
            hit = row & where.get(c, 0)
            row = (row + hit | row - hit) & full
            best = max(best, 2 * (n - row.bit_count()) / (n + i + 1))
    return best


def fuzz_score(a: str, b: str) -> float:
    return ratio(sorted_tokens(a), sorted_tokens(b))


#: The score of names whose initials contradict each other, and the score from which names count as equal.
CONFLICT, EQUAL = 0.05, 0.96


def initial_score(a: str, b: str) -> float:
    """``fuzz_score`` for names, with one-letter tokens as initials.

    Names whose tokens can all be paired (equal, or an initial with a name that begins with it), anchored at a full
    token that both have, score 1.  Contradicting initials score ``CONFLICT``.
    """
    plain = fuzz_score(a, b)
    if plain >= EQUAL:
        return plain
    one, two = (sorted(_WORD.findall(x.lower()), key=lambda t: -len(t)) for x in (a, b))
    if not one or not two:
        return plain
    if all(len(t) == 1 for t in one[1:] + two[1:]):
        initials = [{t for t in x if len(t) == 1} for x in (one, two)]
        return CONFLICT if all(initials) and not initials[0] & initials[1] else plain
    few, many = (one, two) if len(one) <= len(two) else (two, one)
    full = [t for t in few if len(t) > 1]
    anchor = next((t for t in full if t in many), None)
    if anchor is None:
        return plain
    free = list(many)
    free.remove(anchor)
    for token in few:
        if token == anchor:
            continue
        fits = next((t for t in free if t == token or len(t) == 1 and token.startswith(t) or len(token) == 1 and t.startswith(token)), None)
        if fits is None:
            return CONFLICT if len(token) == 1 and any(len(t) == 1 for t in free) else plain
        free.remove(fits)
    return 1.0


# ---- Arrow UDFs -----------------------------------------------------------------------------------------------


def _pairwise(kernel: Callable[[str, str], float]) -> Callable:
    """A UDF over two string columns; null where one is null.  Equal pairs of a batch are scored once."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict[tuple[str, str], float] = {}
        out = []
        for pair in zip(a, b, strict=True):
            if pair[0] is None or pair[1] is None:
                out.append(None)
                continue
            if pair not in known:
                known[pair] = kernel(*pair)
            out.append(known[pair])
        return pd.Series(out, dtype="float64")

    return lambda a, b: F.pandas_udf(run, "double")(a, b)


def _each(kernel: Callable[[str], str], kind: str = "string") -> Callable:
    def run(a: pd.Series) -> pd.Series:
        return a.map(lambda x: None if x is None else kernel(x))

    return lambda a: F.pandas_udf(run, kind)(a)


fuzz_score_udf = _pairwise(fuzz_score)
initial_score_udf = _pairwise(initial_score)
partial_ratio_udf = _pairwise(lambda a, b: partial_ratio(a.lower(), b.lower()))
sorted_tokens_udf = _each(sorted_tokens)
to_ascii_udf = _each(to_ascii)
to_nfc_udf = _each(to_nfc)
