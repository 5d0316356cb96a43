"""Measures of texts and of their lines, for whole batches at once: base rules, and the features of the line field."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .encoding import chunked

# Fixed values of the base rules.
SYMBOLS, WHITE, WINDOW = b"#*$%&|<>", b" \t\n\x0b\x0c\r", 5
ENDS = (".", "!", "?", ":", '"', "…", "»", "”")
#: Upper bounds of the values of each of a line's measures; the number of the first bound not exceeded is a feature.
BOUNDS = {
    "words": (1, 2, 4, 9, 19, 49), "word length": (1, 2, 3.5, 6, 9, 14), "symbols": (0, 0.01, 0.03, 0.1), "marks": (0, 0.02, 0.05, 0.1, 0.2),
    "upper": (0, 0.02, 0.05, 0.1, 0.3, 0.7), "digits": (0, 0.02, 0.1, 0.3), "distinct": (0.1, 0.3, 0.5, 0.7, 0.85, 0.99), "repeated pairs": (0, 0.05, 0.2, 0.5), "longest run": (1, 2, 4),
}
_FIRST = np.cumsum([0, *(len(x) + 1 for x in BOUNDS.values())])
#: After them: always there, ends like a sentence, equal to an earlier line. A last number stands for none.
FEATURES = int(_FIRST[-1]) + 3
NONE, WIDTH = FEATURES, len(BOUNDS) + 3


def _kinds() -> np.ndarray:
    """By byte: begins a code point of a word, symbol, mark, digit."""
    codes = np.arange(256)
    white = np.isin(codes, list(WHITE))
    mark = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])
    return np.stack([((codes & 0xC0) != 0x80) & ~white, np.isin(codes, list(SYMBOLS)), mark, (codes >= 48) & (codes <= 57)])


_KINDS = _kinds()


def ranked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each pair of non-negative numbers, equal for equal pairs, as small as can be."""
    return np.unique(a.astype(np.int64) * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1]


def _again(keys: np.ndarray) -> np.ndarray:
    """Which of the keys came before."""
    out = np.ones(len(keys), bool)
    out[np.unique(keys, return_index=True)[1]] = False
    return out


def _repeated(codes: np.ndarray, text: np.ndarray, n_texts: int) -> np.ndarray:
    """By text: words in windows of WINDOW words that the text holds twice or more."""
    out = np.zeros(n_texts, np.int64)
    if len(codes) <= WINDOW:
        return out
    inside = text[: -WINDOW + 1] == text[WINDOW - 1 :]
    mixed = text[: -WINDOW + 1].astype(np.uint64)
    for k in range(WINDOW):
        mixed = (mixed ^ codes[k : len(codes) - WINDOW + 1 + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    # only texts in which some window's hash comes twice are looked at exactly
    which = np.unique(text[: -WINDOW + 1][inside][_again(mixed[inside])])
    keep = np.isin(text, which)
    codes, text = codes[keep], text[keep]
    if len(codes) <= WINDOW:
        return out
    inside = text[: -WINDOW + 1] == text[WINDOW - 1 :]
    n = len(codes) - WINDOW + 1
    two = ranked(codes[:-1], codes[1:])
    four = ranked(two[:-2], two[2:])
    window = ranked(text[:n], ranked(four[:n], codes[WINDOW - 1 :]))
    twice = (np.bincount(window[inside], minlength=int(window.max()) + 1)[window] > 1) & inside
    cover = np.zeros(len(codes) + 1, np.int64)
    np.add.at(cover, np.flatnonzero(twice), 1)
    np.add.at(cover, np.flatnonzero(twice) + WINDOW, -1)
    np.add.at(out, text[np.cumsum(cover)[:-1] > 0], 1)
    return out


@dataclass
class Measured:
    """By text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and where its lines begin (one more than texts). By line with a word: words, features."""

    base: np.ndarray
    starts: np.ndarray
    words: np.ndarray
    features: np.ndarray


def measured(texts: pa.Array) -> Measured:
    """Of texts without nulls. Lines are \\n-split; those without a word are left out."""
    n_texts = len(texts)
    lists = pc.split_pattern(texts, "\n")
    lines = lists.flatten()
    line_text = np.repeat(np.arange(n_texts), np.diff(lists.offsets.to_numpy()))
    strings, codes, bounds = chunked(lines)
    n = np.diff(bounds)
    has = n > 0
    # sums over bytes: code points in words, symbols, marks, digits, capitals, small letters
    offsets = np.frombuffer(lines.buffers()[1], np.int32)[lines.offset : lines.offset + len(lines) + 1]
    b = np.frombuffer(lines.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    upper, lower = (b >= 65) & (b <= 90), (b >= 97) & (b <= 122)
    two = b[:-1] == 0xC3
    upper[:-1] |= two & (b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[1:] != 0x97)
    lower[:-1] |= two & (b[1:] >= 0x9F) & (b[1:] <= 0xBF) & (b[1:] != 0xB7)
    by_line = lambda x: np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.int32)])[offsets - offsets[0]])
    chars, symbols, marks, digits, upper, lower = (by_line(x) for x in (*(k[b] for k in _KINDS), upper, lower))
    word_text = np.repeat(line_text, n)
    total = lambda x: np.bincount(line_text, x, n_texts).astype(np.int64)
    texts_of, size = line_text[has], np.maximum(1, np.diff(offsets))[has]
    line_codes = lines.filter(pa.array(has)).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    again = _again(ranked(texts_of, line_codes))
    dup = np.bincount(texts_of, again, n_texts).astype(np.int64)
    base = np.stack([total(n), total(chars), total(symbols), dup, _repeated(codes, word_text, n_texts)], 1)
    starts = np.concatenate([[0], np.cumsum(np.bincount(texts_of, minlength=n_texts))])
    n, line = n[has], np.repeat(np.arange(has.sum()), n[has])
    if not len(n):
        return Measured(base, starts, n, np.zeros((0, WIDTH), np.uint8))
    pairs = line * (int(codes.max()) + 1) + codes
    distinct = np.bincount(np.unique(pairs) // (int(codes.max()) + 1), minlength=len(n))
    same = line[:-1] == line[1:]
    both, at = ranked(codes[:-1], codes[1:])[same], line[:-1][same]
    kinds = np.unique(at * (int(both.max(initial=0)) + 1) + both) // (int(both.max(initial=0)) + 1)
    repeats = np.where(n > 1, 1 - np.bincount(kinds, minlength=len(n)) / np.maximum(1, n - 1), 0)
    begins = np.flatnonzero(np.concatenate([[True], ~(same & (codes[:-1] == codes[1:]))]))
    longest = np.zeros(len(n), np.int64)
    np.maximum.at(longest, line[begins], np.diff(np.append(begins, len(line))))
    last = codes[np.cumsum(n) - 1]
    ends = np.zeros(len(strings), bool)
    for c in np.unique(last).tolist():
        ends[c] = strings[c].endswith(ENDS)
    values = (n, chars[has] / n, symbols[has] / size, marks[has] / size, upper[has] / np.maximum(1, upper + lower)[has], digits[has] / size, distinct / n, repeats, longest)
    found = [first + np.searchsorted(bound, value, "left") for first, value, bound in zip(_FIRST.tolist(), values, BOUNDS.values(), strict=False)]
    extra = [np.full(len(n), FEATURES - 3), np.where(ends[last], FEATURES - 2, NONE), np.where(again, FEATURES - 1, NONE)]
    return Measured(base, starts, n, np.stack([*found, *extra], 1).astype(np.uint8))
