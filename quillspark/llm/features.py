"""Dense features of raw texts, computed for whole Arrow batches at once."""

from __future__ import annotations

import numpy as np

from .work import SPACE, Powers, span_sums, word_hashes, words_of

NAMES = (
    "log_words", "log_bytes", "mean_word", "upper", "digits", "bang", "symbols", "pipes", "stops", "commas",
    "newlines", "wide", "same_next", "distinct", "distinct_threes", "capitals", "one_letter", "same_lines", "log_lines", "odd_ends",
)
_NEWLINE = np.zeros(256, bool)
_NEWLINE[0x0A] = True
_CLASSES = [range(0x41, 0x5B), range(0x30, 0x3A), b"!", b"#$%&*@^~<>{}\\=+", b"|", b".", b",", b"\n", range(0x80, 0x100)]
_POWERS, _THREES = Powers(0x9E3779B97F4A7C15), Powers(0xD6E8FEB86659FD93)


def _share(counts: np.ndarray, of: np.ndarray) -> np.ndarray:
    return counts / np.maximum(of, 1)


def _distinct(doc: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Distinct values of each document."""
    order = np.lexsort((values, doc))
    d, v = doc[order], values[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (v[1:] != v[:-1])
    return np.bincount(d[new], minlength=n)


def features(body: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A row of NAMES for each text; an empty text has zeros."""
    n = len(starts) - 1
    size = np.diff(starts)
    out = np.zeros((n, len(NAMES)))
    if not n:
        return out
    upto = np.zeros(len(body) + 1, np.int64)
    share = []
    for members in _CLASSES:
        table = np.zeros(256, np.int64)
        table[list(members)] = 1
        np.cumsum(table[body], out=upto[1:])
        share.append(_share(upto[starts[1:]] - upto[starts[:-1]], size))
    upper, digits, bang, symbols, pipes, stops, commas, newlines, wide = share
    begin, end, first = words_of(body, starts, SPACE)
    words = np.diff(first)
    doc = np.repeat(np.arange(n), words)
    hashes = word_hashes(body, begin, end, _POWERS)
    length = end - begin
    same = np.zeros(len(doc), np.int64)
    same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    head, tail = (body[begin], body[end - 1]) if len(begin) else (np.zeros(0, np.uint8),) * 2
    letter = ((tail | 0x20) >= 0x61) & ((tail | 0x20) <= 0x7A) | (tail >= 0x80)
    per_doc = lambda x: np.bincount(doc, weights=x, minlength=n)
    threes = np.zeros(n, np.int64)
    distinct_threes = np.zeros(n)
    if len(hashes) >= 3:
        sums = span_sums(hashes, _THREES)
        _, down = _THREES.get(len(hashes) + 1)
        at = np.arange(len(hashes) - 2)
        at = at[doc[at] == doc[at + 2]]
        threes = np.bincount(doc[at], minlength=n)
        distinct_threes = _distinct(doc[at], (sums[at + 3] - sums[at]) * down[at], n)
    lb, le, lf = words_of(body, starts, _NEWLINE)
    lines = np.diff(lf)
    line_doc = np.repeat(np.arange(n), lines)
    distinct_lines = _distinct(line_doc, word_hashes(body, lb, le, _POWERS), n)
    out[:] = np.stack([
        np.log1p(words), np.log1p(size), _share(per_doc(length), words), upper, digits, bang, symbols, pipes, stops, commas,
        newlines, wide, _share(per_doc(same), words), _share(_distinct(doc, hashes, n), words), np.where(threes > 0, distinct_threes / np.maximum(threes, 1), 1.0) * (size > 0),
        _share(per_doc((head >= 0x41) & (head <= 0x5A)), words), _share(per_doc(length == 1), words), _share(lines - distinct_lines, lines), np.log1p(lines), _share(per_doc(~letter & (tail != 0x2E) & (tail != 0x2C)), words),
    ], axis=1)
    return out
