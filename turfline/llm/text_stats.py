"""Word-level statistics of one text, shared by the quality rules.

Everything here works on one text at a time with NumPy, so the cost is linear in
the text (plus one sort of its 3-word windows) and no state outlives the call.
"""

from __future__ import annotations

import re

import numpy as np

#: Words are runs of anything but the six ASCII white-space characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
_WORD = re.compile(WORD_PATTERN)
#: Symbols that mark junk when there are many of them.
SYMBOLS = "#*$%&|<>"
_DROP_SYMBOLS = str.maketrans("", "", SYMBOLS)
#: str.split() knows more white space than the six characters; texts holding any take the regex.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text) if _OTHER_SPACE.search(text) else text.split()


def repeated_window_words(words: list[str], width: int = 3) -> int:
    """How many words lie in a window of `width` words that occurs twice or more."""
    n = len(words)
    if n <= width:
        return 0
    codes: dict[str, int] = {}
    ids = np.fromiter((codes.setdefault(w, len(codes)) for w in words), dtype=np.int64, count=n)
    if len(codes) == n:
        return 0
    size = len(codes)
    windows = ids[: n - width + 1].copy()
    top = size
    for k in range(1, width):  # dense codes where the product would overflow: never a collision
        if top > (2**62) // size:
            values, windows = np.unique(windows, return_inverse=True)
            top = len(values)
        windows = windows * size + ids[k : n - width + 1 + k]
        top *= size
    ordered = np.sort(windows)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(windows, twice)
    covered = np.zeros(n, dtype=bool)
    for k in range(width):
        covered[k : n - width + 1 + k] |= hit
    return int(covered.sum())


def text_stats(text: str | None) -> tuple[int, int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words); null is the empty text.

    Lines are what split("\\n") gives and count only when they hold a word.
    """
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = words_of(text)
    lines = [x for x in text.split("\n") if _WORD.search(x)]
    return (
        len(words),
        sum(map(len, words)),
        len(text) - len(text.translate(_DROP_SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_window_words(words),
    )
