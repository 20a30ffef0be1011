"""Statistics of one document's text, computed on its UTF-8 bytes inside Arrow batches."""

from __future__ import annotations

import numpy as np

#: UTF-8 bytes of the characters that count as symbols.
SYMBOLS = np.frombuffer(b"#*$%&|<>", dtype=np.uint8)
SPACES = np.frombuffer(b" \t\n\x0b\x0c\r", dtype=np.uint8)
STOPS = np.frombuffer(b".,;:", dtype=np.uint8)

#: Names of the entries of ``features``.
FEATURES = (
    "log_words",
    "mean_word_chars",
    "max_word_bytes",
    "symbols_per_word",
    "bars_per_word",
    "shouts_per_word",
    "upper_share",
    "digit_share",
    "stops_per_word",
    "lines_per_word",
    "distinct_words",
    "top_word_share",
    "repeat_share",
    "dup_line_share",
    "short_word_share",
    "long_word_share",
    "odd_end_share",
    "wide_share",
    "byte_entropy",
)


def repeated_words(ids: np.ndarray) -> np.ndarray:
    """Mask of the words inside a 3-word window that occurs twice or more; ``ids`` number the distinct words."""
    covered = np.zeros(len(ids), dtype=bool)
    if len(ids) < 4:
        return covered
    _, pair = np.unique(ids[:-1] * np.int64(len(ids)) + ids[1:], return_inverse=True)
    _, window, times = np.unique(pair[:-1] * np.int64(len(ids)) + ids[2:], return_inverse=True, return_counts=True)
    twice = times[window] > 1
    for k in range(3):
        covered[k : len(ids) - 2 + k] |= twice
    return covered


def statistics(text: bytes | None) -> tuple[dict, np.ndarray]:
    """Counts (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the vector of ``FEATURES``.

    Null counts as empty; an empty text has all counts 0 and a zero vector.
    """
    text = text or b""
    codes = np.frombuffer(text, dtype=np.uint8)
    by_byte = np.bincount(codes, minlength=256)
    words = text.split()  # splits at ASCII white space only
    n = len(words)
    chars = len(codes) - int(by_byte[0x80:0xC0].sum())
    spaces = int(by_byte[SPACES].sum())
    seen: set[bytes] = set()
    lines = dup_lines = 0
    for line in text.split(b"\n"):
        if line.strip():
            lines += 1
            if line in seen:
                dup_lines += 1
            else:
                seen.add(line)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=n)
    repeats = int(repeated_words(ids).sum())
    counts = {"n_words": n, "word_chars": chars - spaces, "n_symbols": int(by_byte[SYMBOLS].sum()), "n_dup_lines": dup_lines, "n_repeat_words": repeats}
    if not n:
        return counts, np.zeros(len(FEATURES))
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    last = np.fromiter((w[-1] for w in words), dtype=np.uint8, count=n)
    odd_end = np.isin(last, SYMBOLS).sum() + (last == 0x21).sum()
    upper, lower = int(by_byte[0x41:0x5B].sum()), int(by_byte[0x61:0x7B].sum())
    share = by_byte[by_byte > 0] / len(codes)
    features = np.array([
        np.log1p(n),
        counts["word_chars"] / n,
        min(int(lengths.max()), 200),
        counts["n_symbols"] / n,
        by_byte[0x7C] / n,
        by_byte[0x21] / n,
        upper / max(1, upper + lower),
        int(by_byte[0x30:0x3A].sum()) / max(1, chars),
        int(by_byte[STOPS].sum()) / n,
        lines / n,
        np.log(len(number)) / np.log(n) if n > 1 else 1.0,
        np.bincount(ids).max() / n,
        repeats / n,
        dup_lines / lines,
        (lengths <= 3).sum() / n,
        (lengths > 12).sum() / n,
        odd_end / n,
        int(by_byte[0xC0:].sum()) / max(1, chars),
        float(-(share * np.log2(share)).sum()),
    ], dtype=float)
    return counts, features

