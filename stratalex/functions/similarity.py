"""String similarity and stemming that Spark lacks, over Arrow batches.

token_set_ratio follows the published definition: the normalised Indel similarity of the sorted words shared by two
texts and of each text's sorted words, the best of three comparisons.  Not compared with any library here.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def indel_ratio(a: str, b: str) -> float:
    """100 * 2 * LCS / (len(a) + len(b)), by bit-parallel rows."""
    if not a and not b:
        return 100.0
    if not a or not b:
        return 0.0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & where.get(c, 0)
        s = (s + u | s - u) & full
    common = len(a) - s.bit_count()
    return 200.0 * common / (len(a) + len(b))


def token_set_ratio(a: str | None, b: str | None) -> float:
    left, right = set((a or "").split()), set((b or "").split())
    if not left or not right:
        return 0.0
    both, only_a, only_b = sorted(left & right), sorted(left - right), sorted(right - left)
    if both and (not only_a or not only_b):
        return 100.0
    shared, x, y = " ".join(both), " ".join(only_a), " ".join(only_b)
    with_a, with_b = f"{shared} {x}".strip(), f"{shared} {y}".strip()
    best = indel_ratio(with_a, with_b)
    if both:
        best = max(best, indel_ratio(shared, with_a), indel_ratio(shared, with_b))
    return best


#: Pairs whose tables of bits are held at a time.
BATCH = 512


def indel_ratios(left: list[str], right: list[str]) -> np.ndarray:
    """indel_ratio() of many pairs at once: pairs of like length are one block of numpy, a column of letters at a time."""
    out = np.zeros(len(left))
    la, lb = (np.array([len(x) for x in side], np.int64) for side in (left, right))
    out[(la == 0) & (lb == 0)] = 100.0
    todo = np.flatnonzero((la > 0) & (lb > 0))
    todo = todo[np.lexsort((lb[todo], la[todo]))]
    for at in range(0, len(todo), BATCH):
        k = todo[at : at + BATCH]
        a, b = _codes([left[i] for i in k], 0xFFFFFFFF), _codes([right[i] for i in k], 0xFFFFFFFE)
        words = -(-a.shape[1] // 64)
        full = _bits(np.arange(a.shape[1]) < la[k][:, None], words)
        s = full.copy()
        for j in range(b.shape[1]):
            u = s & _bits(a == b[:, j : j + 1], words)
            t = s + u
            if words > 1:
                carry = t < s
                for w in range(1, words):
                    t[:, w] += carry[:, w - 1]
                    carry[:, w] |= carry[:, w - 1] & (t[:, w] == 0)
            s = (t | (s - u)) & full
        out[k] = 200.0 * (la[k] - np.bitwise_count(s).sum(axis=1)) / (la[k] + lb[k])
    return out


def _codes(texts: list[str], none: int) -> np.ndarray:
    """Code points, a row for each text, filled up with what no text holds."""
    out = np.full((len(texts), max(map(len, texts))), none, np.uint32)
    for row, t in zip(out, texts):
        row[: len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
    return out


def _bits(flags: np.ndarray, words: int) -> np.ndarray:
    """Rows of flags as 64-bit words, the first flag lowest."""
    packed = np.zeros((len(flags), 8 * words), np.uint8)
    got = np.packbits(flags, axis=1, bitorder="little")
    packed[:, : got.shape[1]] = got
    return packed.view("<u8")


def token_set_ratios(left: list[str | None], right: list[str | None]) -> np.ndarray:
    """token_set_ratio() of many pairs; equal comparisons are made once."""
    out, asked, of = np.zeros(len(left)), {}, []
    for i, (a, b) in enumerate(zip(left, right)):
        x, y = set((a or "").split()), set((b or "").split())
        if not x or not y:
            continue
        both, only_x, only_y = sorted(x & y), sorted(x - y), sorted(y - x)
        if both and (not only_x or not only_y):
            out[i] = 100.0
            continue
        shared = " ".join(both)
        with_x, with_y = f"{shared} {' '.join(only_x)}".strip(), f"{shared} {' '.join(only_y)}".strip()
        if both:  # what they share begins both, so it is its own longest common part
            n = len(shared)
            out[i] = 200.0 * n / (n + min(len(with_x), len(with_y)))
        of.append((i, asked.setdefault((with_x, with_y), len(asked))))
    if of:
        ratios = indel_ratios([p[0] for p in asked], [p[1] for p in asked])
        at, which = np.array(of).T
        np.maximum.at(out, at, ratios[which])
    return out


@F.pandas_udf(T.DoubleType())
def token_set_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(token_set_ratios(a.tolist(), b.tolist()))


# Porter's published rules: (suffix, replacement) by step; a suffix counts only if what is before it has measure > 0 (or > 1).
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _shape(word: str) -> str:
    out = ""
    for i, c in enumerate(word):
        out += "v" if c in "aeiou" or c == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(word: str) -> int:
    return _shape(word).count("vc")


def porter(word: str) -> str:
    """Porter's stem of a lower-case word."""
    if len(word) <= 2:
        return word
    vowel = lambda w: "v" in _shape(w)
    double = lambda w: len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c"
    cvc = lambda w: _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) else word
    else:
        for end in ("ed", "ing"):
            if word.endswith(end) and vowel(word[: -len(end)]):
                word = word[: -len(end)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif double(word) and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and cvc(word):
                    word += "e"
                break
    if word.endswith("y") and vowel(word[:-1]):
        word = word[:-1] + "i"
    for rules in (_STEP2, _STEP3):
        end = max((r for r in rules if word.endswith(r)), key=len, default=None)
        if end and _measure(word[: -len(end)]):
            word = word[: -len(end)] + rules[end]
    end = max((r for r in _STEP4 if word.endswith(r)), key=len, default=None)
    if end and _measure(word[: -len(end)]) > 1 and (end != "ion" or word[: -len(end)].endswith(("s", "t"))):
        word = word[: -len(end)]
    if word.endswith("e") and (_measure(word[:-1]) > 1 or _measure(word[:-1]) == 1 and not cvc(word[:-1])):
        word = word[:-1]
    if _measure(word) > 1 and double(word) and word.endswith("l"):
        word = word[:-1]
    return word


@F.pandas_udf(T.ArrayType(T.StringType()))
def porter_udf(tokens: pd.Series) -> pd.Series:
    known: dict[str, str] = {}
    return pd.Series([[known.get(t) or known.setdefault(t, porter(t)) for t in ts] if ts is not None else None for ts in tokens])
