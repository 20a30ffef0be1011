"""Periodic runs of words, found from Lyndon roots.

A run is a maximal stretch of words with smallest period q that is at least twice as long as q. By the runs theorem every
run holds, under one of two opposite orders of the words, the longest Lyndon word that starts at some place and is as long
as the period. These Lyndon words come from the first phase of Baier's suffix sorter: it groups places by a prefix that
grows to the longest Lyndon word there, and never sorts the suffixes themselves. Each word and the copy that would follow
it are then extended to both sides by longest common extensions.

Only words of runs of 12 or more are grouped: of such a run every word stands in a sequence of six words that the text
holds twice, so that the rest of the text is left out before (exactly, whatever the text).
"""

from __future__ import annotations

from hashlib import sha256
from itertools import compress

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import map_texts

MIN_LENGTH = 12
PRIMES = ((1 << 31) - 1, (1 << 31) - 19)
BASES = (911382323, 972663749)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def lyndon_lengths(letters: list[int]) -> np.ndarray:
    """Length of the longest Lyndon word that starts at each place; a prefix is smaller than the whole.

    Groups of places with one prefix each stand in ascending order. The greatest group not yet seen is taken off: the
    prefix of its members is final. The nearest place left of a member that is not taken yet has a smaller prefix that
    ends where members stand in a row, ``times`` of them: its prefix grows by all of these, and it moves to a group
    right above its old one, the higher the more they are. Every place is taken once and moves once per place taken.
    """
    n = len(letters)
    alphabet = sorted(set(letters))
    rank = {letter: k for k, letter in enumerate(alphabet)}
    group = [rank[x] for x in letters]
    members: list[list[int]] = [[] for _ in alphabet]
    for i, g in enumerate(group):
        members[g].append(i)
    width, below, above = [1] * len(alphabet), list(range(-1, len(alphabet) - 1)), [*range(1, len(alphabet)), -1]
    before, after = list(range(-1, n)), [*range(1, n + 1), 0]  # places not taken, linked; the last cell is no place
    lengths = [0] * n
    now = len(alphabet) - 1
    while now >= 0:
        size, grown = width[now], {}
        left, times = -1, 0
        for i in members[now]:
            if group[i] != now:
                continue  # it has moved up
            lengths[i] = size
            j, k = before[i], after[i]
            before[k], after[j] = j, k
            if j == left:
                times += 1
                continue
            if left >= 0:
                grown.setdefault((group[left], times), []).append(left)
            left, times = j, 1
        if left >= 0:
            grown.setdefault((group[left], times), []).append(left)
        members[now] = []
        for old, times in sorted(grown, reverse=True):
            places, new = grown[old, times], len(width)
            for j in places:
                group[j] = new
            members.append(places)
            width.append(width[old] + times * size)
            below.append(old)
            above.append(above[old])
            if above[old] >= 0:
                below[above[old]] = new
            above[old] = new
        now = below[now]
    return np.array(lengths, dtype=np.int64)


class Extensions:
    """Longest common extensions of pairs of places, many at a time, by sums of powers modulo two primes."""

    def __init__(self, letters: np.ndarray):
        self.n = len(letters)
        mixed = letters.astype(np.uint64) * _MIX
        mixed ^= mixed >> np.uint64(29)
        self.sums = []
        for prime, base in zip(PRIMES, BASES, strict=True):
            power = np.ones(self.n + 1, dtype=np.int64)
            have = 1
            while have <= self.n:
                more = min(have, self.n + 1 - have)
                power[have : have + more] = power[:more] * (power[have - 1] * base % prime) % prime
                have += more
            terms = (mixed % np.uint64(prime)).astype(np.int64) * power[:-1] % prime
            self.sums.append((prime, power, np.concatenate([[0], np.cumsum(terms)])))

    def equal(self, i: np.ndarray, j: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the ``length`` letters from i and from j > i are the same."""
        same = np.ones(len(i), dtype=bool)
        for prime, power, total in self.sums:
            same &= (total[i + length] - total[i]) % prime * power[j - i] % prime == (total[j + length] - total[j]) % prime
        return same

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many letters from i on equal those from j > i on."""
        out = np.zeros(len(i), dtype=np.int64)
        for step in self._steps():
            at = np.flatnonzero(j + out + step <= self.n)
            out[at[self.equal(i[at] + out[at], j[at] + out[at], step)]] += step
        return out

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many letters before i equal those before j > i."""
        out = np.zeros(len(i), dtype=np.int64)
        for step in self._steps():
            at = np.flatnonzero(i - out - step >= 0)
            out[at[self.equal(i[at] - out[at] - step, j[at] - out[at] - step, step)]] += step
        return out

    def _steps(self):
        return (1 << k for k in range(self.n.bit_length() - 1, -1, -1))


def runs_of(letters: np.ndarray, min_length: int = MIN_LENGTH) -> np.ndarray:
    """Rows (start, length, period), by start and period, of all runs of ``letters`` of ``min_length`` or more."""
    n, found = len(letters), []
    if n < 2:
        return np.zeros((0, 3), dtype=np.int64)
    reach = Extensions(letters)
    for ordered in (letters, -letters):
        period = lyndon_lengths(ordered.tolist())
        i = np.arange(n)
        start = i - reach.backward(i, i + period)
        end = i + period + reach.forward(i, i + period)
        good = (end - start >= 2 * period) & (end - start >= min_length)
        found.append(np.stack([start, end - start, period], axis=1)[good])
    runs = np.unique(np.concatenate(found), axis=0)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    for start, length, period in runs.tolist():  # sums may agree by chance, letters don't
        end = start + length
        if not (np.array_equal(letters[start : end - period], letters[start + period : end]) and (start == 0 or letters[start - 1] != letters[start + period - 1]) and (end == n or letters[end] != letters[end - period])):
            raise ArithmeticError("two different sequences of words have the same sums")
    return runs


def twice_seen(letters: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Which letters stand in a sequence of ``size`` that occurs twice or more in its text (texts begin at ``starts``)."""
    n = len(letters)
    held = np.zeros(n + 1, dtype=np.int64)
    if n >= size:
        text = np.zeros(n, dtype=np.int64)
        text[starts[starts < n]] = 1
        text = np.cumsum(text)
        mixed = (letters.astype(np.uint64) + np.uint64(1)) * _MIX
        mixed ^= mixed >> np.uint64(32)
        value = text[: n - size + 1].astype(np.uint64)
        for k in range(size):
            value = (value ^ mixed[k : n - size + 1 + k]) * _MIX
            value ^= value >> np.uint64(31)
        at = np.flatnonzero(text[: n - size + 1] == text[size - 1 :])  # within one text
        order = at[np.argsort(value[at], kind="stable")]
        same = value[order[1:]] == value[order[:-1]]
        twice = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
        held[twice] += 1
        held[twice + size] -= 1
    return np.cumsum(held)[:n] > 0


def runs_of_texts(texts: list[np.ndarray], min_length: int = MIN_LENGTH) -> list[np.ndarray]:
    """``runs_of`` each text, all at once: what occurs twice is laid end to end with a letter of its own between."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    letters = np.concatenate(texts) if texts else np.zeros(0, dtype=np.int64)
    out = [np.zeros((0, 3), dtype=np.int64)] * len(texts)
    at = np.flatnonzero(twice_seen(letters, starts[sizes > 0], max(1, min_length // 2)))
    if not len(at):
        return out
    of = np.searchsorted(starts, at, side="right") - 1
    cut = np.concatenate([[0], np.cumsum((np.diff(at) > 1) | (np.diff(of) > 0))])  # number of stretches before
    slot = np.arange(len(at)) + cut
    laid = int(letters.max()) + 1 + np.arange(slot[-1] + 1)  # a letter of its own wherever no word goes
    laid[slot] = letters[at]
    place = np.zeros(len(laid), dtype=np.int64)
    place[slot] = at
    runs = runs_of(laid, min_length)
    runs[:, 0] = place[runs[:, 0]]
    owner = np.searchsorted(starts, runs[:, 0], side="right") - 1
    runs[:, 0] -= starts[owner]
    for k, (low, high) in {k: (np.searchsorted(owner, k), np.searchsorted(owner, k, side="right")) for k in np.unique(owner)}.items():
        out[k] = runs[low:high]
    return out


def _numbered(texts: list) -> tuple[list[list[bytes]], list[np.ndarray]]:
    """Each text's words, and the words as numbers that all texts share."""
    known: dict[bytes, int] = {}
    words = [(t or b"").split() for t in texts]
    return words, [np.array([known.setdefault(w, len(known)) for w in ws], dtype=np.int64) for ws in words]


def _summary(words: list[bytes], runs: np.ndarray) -> tuple:
    """n_runs, the longest run (start, length, period, exponent_milli), runs_sha256, collapsed_sha256."""
    start, length, period = runs.T
    keep = np.ones(len(words), dtype=bool)
    for s, n, q in runs.tolist():
        keep[s + q : s + n] = False
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs.tolist())
    best = runs[np.lexsort((period, start, -length))[0]].tolist() if len(runs) else [None] * 3
    exponent = 1000 * best[1] // best[2] if len(runs) else None
    kept = words if keep.all() else compress(words, keep.tolist())
    return len(runs), *best, exponent, sha256(lines.encode()).hexdigest(), sha256(b" ".join(kept)).hexdigest()


SUMMARY = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def period_changes(hashes: list, texts: list[np.ndarray]) -> list[np.ndarray | None]:
    """For each text the places its words are taken from, or None: a tenth of the texts repeat a part of themselves.

    With hash h, g = h // 10 and n words: if h % 10 is 0, word i >= a becomes word a + (i - a) % p, where a = g % n and
    p = 1 + (n - a) // (3 + g % 8).
    """
    out: list[np.ndarray | None] = []
    for h, text in zip(hashes, texts, strict=True):
        g, n = h // 10, len(text)
        if h % 10 or not n:
            out.append(None)
            continue
        a = g % n
        out.append(np.concatenate([np.arange(a), a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8))]))
    return out


def summarise_runs(docs: DataFrame, changed_by: Column | None = None, min_length: int = MIN_LENGTH) -> DataFrame:
    """One row per document: doc_id and its runs of ``min_length`` words or more.

    n_runs; start, length, period and exponent_milli of the longest run (ties: the first, then the shortest period; null
    without runs); runs_sha256 of the lines ``start,length,period`` of all runs; collapsed_sha256 of the words without
    those that repeat a run's first period, joined by a space. ``changed_by`` is a hash by which ``period_changes`` alters
    the texts before. Null and empty texts have no words and no runs. Repeated rows each get their row, ids of any type
    pass as they are, an empty table gives no rows, further columns are ignored. Texts of any length are read whole;
    memory is linear in a text.
    """
    given = F.struct(F.col("text").cast("binary").alias("text"), (F.lit(1) if changed_by is None else changed_by).cast("long").alias("hash")).alias("given")

    def compute(values: list) -> list:
        words, numbers = _numbered([v["text"] for v in values])
        for k, places in enumerate(period_changes([v["hash"] for v in values], numbers)):
            if places is not None:
                numbers[k], own = numbers[k][places], words[k]
                words[k] = [own[i] for i in places.tolist()]
        rows = [_summary(w, r) for w, r in zip(words, runs_of_texts(numbers, min_length), strict=True)]
        return [list(column) for column in zip(*rows, strict=True)] if rows else [[]] * 7

    return map_texts(docs.select("doc_id", given), SUMMARY, compute, column="given")


def collapse_runs(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """``docs`` with each text's runs cut down to one period; texts without runs stay as they are, to the byte.

    Null and empty texts, other columns and rows pass untouched.
    """
    names = docs.columns
    renamed = docs.toDF(*[f"c{k}" for k in range(len(names))])
    text = f"c{names.index('text')}"

    def compute(values: list) -> list:
        words, numbers = _numbered([None if v is None else v.encode() for v in values])
        out = []
        for value, ws, runs in zip(values, words, runs_of_texts(numbers, min_length), strict=True):
            keep = np.ones(len(ws), dtype=bool)
            for s, n, q in runs.tolist():
                keep[s + q : s + n] = False
            out.append(value if keep.all() else b" ".join(compress(ws, keep.tolist())).decode())
        return [out]

    done = map_texts(renamed, "collapsed string", compute, column=text)
    return done.select(*[F.col("collapsed" if f"c{k}" == text else f"c{k}").alias(name) for k, name in enumerate(names)])
