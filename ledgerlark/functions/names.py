"""Vectorised name helpers: folding to ASCII and the fuzzy name score.

``match_score`` and ``jaro_winkler`` state the score for one pair; ``match_scores`` gives the same doubles for many pairs in
array operations: names and tokens are coded once, the characters of all pairs are matched place by place in bit masks,
each distinct pair of tokens is compared once, and whole names are compared only where the rest leaves a chance.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

# Titles that names are compared without.
NOISE = {"mr", "mrs", "ms", "dr", "prof", "sir"}


def fold(name: str | None) -> str:
    """Decomposed, ASCII only, lower case, punctuation as spaces, titles dropped, single spaces."""
    if not name:
        return ""
    plain = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode().lower()
    return " ".join(t for t in re.sub(r"[^\w\s]", " ", plain).split() if t not in NOISE)


@F.pandas_udf(StringType())
def folded(names: pd.Series) -> pd.Series:
    known = {n: fold(n) for n in names.unique()}
    return names.map(known)


@lru_cache(maxsize=200_000)
def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity, raised by a tenth of the rest for each of up to four equal first letters if above 0.7."""
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken = [False] * len(b)
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, t in zip(b, taken, strict=True) if t]
    m, moved = len(left), sum(x != y for x, y in zip(left, right, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    if jaro <= 0.7:
        return jaro
    same = 0
    while same < min(4, len(a), len(b)) and a[same] == b[same]:
        same += 1
    return jaro + same * 0.1 * (1 - jaro)


def match_score(query: str, candidate: str) -> float:
    """0 to 100 for two folded names: 100 if all query tokens stand in the candidate, else mostly how well each query
    token's best counterpart fits, at most 99.9."""
    if not query or not candidate:
        return 0.0
    q, c = set(query.split()), set(candidate.split())
    if query == candidate or q <= c:
        return 100.0
    best = sum(max(jaro_winkler(x, y) for y in c) for x in sorted(q)) / len(q)
    whole = 60.0 * best + 25.0 * jaro_winkler(query, candidate) + 15.0 * (len(q & c) / len(q | c))
    return float(int(min(whole, 99.9) * 100 + 0.5 + 1e-9)) / 100


#: Longer names, and names of more tokens, are scored one by one.
MOST_LETTERS, MOST_TOKENS = 64, 16
#: Pairs that are matched at once, so that they stay in a core's cache, and pairs of tokens that a table may have.
SLICE, TABLE = 1 << 14, 1 << 25


def _coded(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of names in rows, 0 beyond their ends, and their lengths."""
    sizes = np.array([len(n) for n in names], np.int64)
    codes = np.zeros((len(names), max(1, int(sizes.max(initial=1)))), np.int32)
    if len(names):
        codes[np.arange(codes.shape[1]) < sizes[:, None]] = np.frombuffer("".join(names).encode("utf-32-le"), np.int32)
    return codes, sizes


def jaro_winkler_many(left: list[str], right: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``jaro_winkler(left[i], right[j])`` for all pairs of places; names have at most ``MOST_LETTERS`` letters."""
    a, la = _coded(left)
    b, lb = _coded(right)
    letters = np.unique(np.concatenate([[0], a.ravel(), b.ravel()]))
    a, b = np.searchsorted(letters, a), np.searchsorted(letters, b)
    one = np.uint64(1)
    # Of each right name and letter the places where it stands, as bits.
    places = np.zeros((len(right), len(letters)), np.uint64)
    for k in range(b.shape[1]):
        places[np.arange(len(right)), b[:, k]] |= one << np.uint64(k)
    places[:, 0] = 0
    out = np.empty(len(i))
    for at in range(0, len(i), SLICE):
        out[at : at + SLICE] = _jaro_slice(a, la, b, lb, places, i[at : at + SLICE], j[at : at + SLICE])
    return out


def _jaro_slice(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray, places: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    one, full = np.uint64(1), ~np.uint64(0)
    na, nb, n = la[i], lb[j], len(i)
    reach = np.maximum(0, np.maximum(na, nb) // 2 - 1)
    upto = lambda k: np.where(k >= 64, full, (one << np.minimum(k, 63).astype(np.uint64)) - one)
    taken, m, rows = np.zeros(n, np.uint64), np.zeros(n, np.int64), np.arange(n)
    first = np.zeros((n, a.shape[1]), a.dtype)
    for k in range(int(na.max(initial=0))):
        letter = a[i, k]
        free = places[j, letter] & upto(np.minimum(nb, k + reach + 1)) & ~upto(np.maximum(0, k - reach)) & ~taken
        bit = free & (~free + one)
        taken |= bit
        hit = np.flatnonzero(bit)
        first[hit, m[hit]] = letter[hit]
        m[hit] += 1
    second, at = np.zeros_like(first), np.zeros(n, np.int64)
    for k in range(int(nb.max(initial=0))):
        hit = np.flatnonzero(taken >> np.uint64(k) & one)
        second[hit, at[hit]] = b[j[hit], k]
        at[hit] += 1
    moved = (first != second).sum(axis=1) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = np.where(m > 0, (m / na + m / nb + (m - moved) / m) / 3, 0.0)
    same, going = np.zeros(n, np.int64), np.ones(n, bool)
    for k in range(min(4, a.shape[1], b.shape[1])):
        going &= (a[i, k] == b[j, k]) & (k < na) & (k < nb)
        same += going
    return np.where(jaro > 0.7, jaro + same * 0.1 * (1 - jaro), jaro)


def match_scores(queries: list[str], candidates: list[str], least: float = 0.0) -> np.ndarray:
    """``match_score`` of each pair; NaN where it cannot reach ``least``: not even with as many letters of the whole names
    in common as the shorter one has, in their order."""
    q_names, i = np.unique(np.array([q or "" for q in queries], object), return_inverse=True) if len(queries) else (np.array([], object), np.array([], np.int64))
    c_names, j = np.unique(np.array([c or "" for c in candidates], object), return_inverse=True) if len(candidates) else (np.array([], object), np.array([], np.int64))
    return match_pairs(q_names, c_names, i, j, least)


def match_pairs(queries: np.ndarray, candidates: np.ndarray, i: np.ndarray, j: np.ndarray, least: float = 0.0) -> np.ndarray:
    """``match_scores`` of ``queries[i]`` and ``candidates[j]``, which are arrays of different names."""
    (q_names, i), (c_names, j) = _used(queries, i), _used(candidates, j)
    q_tokens, c_tokens = ([sorted(set(n.split())) for n in names] for names in (q_names, c_names))
    fits = lambda names, tokens: np.array([len(n) <= MOST_LETTERS and len(t) <= MOST_TOKENS for n, t in zip(names, tokens, strict=True)], bool)
    q_fits, c_fits = fits(q_names, q_tokens), fits(c_names, c_tokens)
    out = np.zeros(len(i))
    alone = ~(q_fits[i] & c_fits[j])
    for k in np.flatnonzero(alone):
        out[k] = match_score(q_names[i[k]], c_names[j[k]])
    rest = np.flatnonzero(~alone & np.array([bool(n) for n in q_names], bool)[i] & np.array([bool(n) for n in c_names], bool)[j])
    if not len(rest):
        return out
    i, j = i[rest], j[rest]
    q_words, c_words = (sorted({t for ts, f in zip(tokens, fit, strict=True) if f for t in ts}) for tokens, fit in ((q_tokens, q_fits), (c_tokens, c_fits)))
    q_number, c_number = ({t: k for k, t in enumerate(words)} for words in (q_words, c_words))
    q_table, c_table = _table(q_tokens, q_fits, q_number), _table(c_tokens, c_fits, c_number)
    alike = np.array([c_number.get(t, -2) for t in q_words] or [-2])
    q_size, c_size = (np.array([len(t) for t in tokens]) for tokens in (q_tokens, c_tokens))
    # Pairs of as many tokens together: tables of tokens have no empty places then.
    kind = q_size[i] * (MOST_TOKENS + 1) + c_size[j]
    by = np.argsort(kind, kind="stable")
    alike_sized = np.split(by, np.flatnonzero(np.diff(kind[by])) + 1)

    def keys(of: np.ndarray) -> np.ndarray:
        qt, ct = q_table[i[of], : q_size[i[of[0]]]], c_table[j[of], : c_size[j[of[0]]]]
        return qt[:, :, None] * len(c_words) + ct[:, None, :]

    size = len(q_words) * len(c_words)
    if size <= TABLE:
        there = np.zeros(size, bool)
        for of in alike_sized:
            there[keys(of)] = True
        known = np.flatnonzero(there)
        place = np.zeros(size, np.int32)
        place[known] = np.arange(len(known), dtype=np.int32)
    else:
        known, place = np.unique(np.concatenate([np.unique(keys(of)) for of in alike_sized])), None
    known_score = jaro_winkler_many(q_words, c_words, known // len(c_words), known % len(c_words))
    tokens, common = np.zeros(len(i)), np.zeros(len(i), np.int64)
    for of in alike_sized:
        at = keys(of)
        best = known_score[np.searchsorted(known, at) if place is None else place[at]].max(axis=2)
        total = np.zeros(len(of))
        for k in range(best.shape[1]):  # token by token, as in the definition
            total += best[:, k]
        tokens[of] = total / best.shape[1]
        common[of] = (alike[at // len(c_words)] == at % len(c_words)).any(axis=2).sum(axis=1)
    shared = common / (q_size[i] + c_size[j] - common)
    inside = common == q_size[i]
    score = np.full(len(i), 100.0)
    qa, ca = (np.array([len(n) for n in names]) for names in (q_names, c_names))
    short = np.minimum(qa[i], ca[j])
    jaro = (short / qa[i] + short / ca[j] + 1) / 3
    bound = 60.0 * tokens + 25.0 * (jaro + 0.4 * (1 - jaro)) + 15.0 * shared
    hopeless = ~inside & (bound + 0.01 < least)
    score[hopeless] = np.nan
    todo = np.flatnonzero(~inside & ~hopeless)
    q_short, c_short = ([n if f else "" for n, f in zip(names, fit, strict=True)] for names, fit in ((q_names, q_fits), (c_names, c_fits)))
    whole = 60.0 * tokens[todo] + 25.0 * jaro_winkler_many(q_short, c_short, i[todo], j[todo]) + 15.0 * shared[todo]
    score[todo] = np.floor(np.minimum(whole, 99.9) * 100 + 0.5 + 1e-9) / 100
    out[rest] = score
    return out


def _used(names: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The names at the given places, each once, and the places among them."""
    there = np.zeros(len(names), bool)
    there[places] = True
    return names[there], (np.cumsum(there) - 1)[places]


def jaro_bounds(left: list[str], right: list[str], most: int) -> np.ndarray:
    """``jaro_winkler`` of no left and right name is above these: as if all letters that both hold, as often as both hold
    them, were matched in order. ``most`` copies of a letter are told apart; names with more count as matched whole."""
    a, la = _coded(left)
    b, lb = _coded(right)
    letters = np.unique(np.concatenate([[0], a.ravel(), b.ravel()]))

    def held(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        flat = np.arange(len(codes))[:, None] * len(letters) + np.searchsorted(letters, codes)
        counts = np.bincount(flat.ravel(), minlength=len(codes) * len(letters)).reshape(len(codes), -1)[:, 1:]
        return (counts[:, :, None] > np.arange(most)).reshape(len(codes), -1).astype(np.float32), (counts > most).any(axis=1)

    (ha, odd_a), (hb, odd_b) = held(a), held(b)
    m = ha @ hb.T
    if odd_a.any():
        m[odd_a] = np.minimum(la[odd_a, None], lb)
    if odd_b.any():
        m[:, odd_b] = np.minimum(la[:, None], lb[odd_b])
    jaro = m * (1 / np.maximum(la, 1)).astype(np.float32)[:, None]
    jaro += m * (1 / np.maximum(lb, 1)).astype(np.float32)
    jaro += 1
    jaro /= 3
    jaro[m == 0] = 0
    going, same = np.ones(m.shape, bool), np.zeros(m.shape, np.float32)
    for k in range(min(4, a.shape[1], b.shape[1])):
        going &= (a[:, None, k] == b[:, k]) & (a[:, None, k] > 0)
        same += going
    return np.where(jaro > 0.6999, jaro + same * np.float32(0.1) * (1 - jaro), jaro)  # floats of half the precision, so a little below 0.7


def score_bounds(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """No ``match_score`` of a query (row) and a candidate (column) is above these."""
    q_tokens, c_tokens = ([sorted(set(n.split())) for n in names] for names in (queries, candidates))
    out = np.zeros((len(queries), len(candidates)), np.float32)
    rows, cols = (np.flatnonzero([len(t) > 0 for t in tokens]) for tokens in (q_tokens, c_tokens))
    if not len(rows) or not len(cols):
        return out
    q_tokens, c_tokens = [q_tokens[k] for k in rows], [c_tokens[k] for k in cols]
    q_words, c_words = (sorted({t for ts in tokens for t in ts}) for tokens in (q_tokens, c_tokens))
    q_at, c_at = ({t: k for k, t in enumerate(words)} for words in (q_words, c_words))
    q_size, c_size = (np.array([len(t) for t in tokens]) for tokens in (q_tokens, c_tokens))
    q_flat, c_flat = np.array([q_at[t] for ts in q_tokens for t in ts]), np.array([c_at[t] for ts in c_tokens for t in ts])
    q_start, c_start = np.cumsum(q_size) - q_size, np.cumsum(c_size) - c_size
    best = np.maximum.reduceat(jaro_bounds(q_words, c_words, 3)[:, c_flat], c_start, axis=1)
    equal = np.zeros(best.shape, np.float32)
    found = [(q_at[t], k) for k, ts in enumerate(c_tokens) for t in ts if t in q_at]
    if found:
        equal[tuple(np.array(found).T)] = 1
    size = q_size.astype(np.float32)[:, None]
    tokens = np.add.reduceat(best[q_flat], q_start, axis=0) / size
    common = np.add.reduceat(equal[q_flat], q_start, axis=0)
    bound = 60 * tokens + 25 * jaro_bounds([queries[k] for k in rows], [candidates[k] for k in cols], 6) + 15 * (common / (size + c_size.astype(np.float32) - common))
    out[np.ix_(rows, cols)] = np.where(common == size, np.float32(100), bound) + np.float32(0.05)
    return out


def _table(tokens: list[list[str]], fit: np.ndarray, number: dict[str, int]) -> np.ndarray:
    """Numbers of each name's tokens in rows, -1 beyond their ends."""
    table = np.full((len(tokens), max([1, *(len(t) for t, f in zip(tokens, fit, strict=True) if f)])), -1, np.int64)
    for row, (ts, f) in enumerate(zip(tokens, fit, strict=True)):
        if f:
            table[row, : len(ts)] = [number[t] for t in ts]
    return table


@F.pandas_udf(DoubleType())
def name_match_score(queries: pd.Series, candidates: pd.Series) -> pd.Series:
    return pd.Series(match_scores(queries.tolist(), candidates.tolist()))


def name_match_from(least: float):
    """``name_match_score``, or null where the score cannot reach ``least``."""

    @F.pandas_udf(DoubleType())
    def score(queries: pd.Series, candidates: pd.Series) -> pd.Series:
        found = match_scores(queries.tolist(), candidates.tolist(), least)
        return pd.Series(found).astype(object).where(~np.isnan(found), None)

    return score
