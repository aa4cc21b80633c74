"""Words of many texts at once, for the models that read letters."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import batched

import numpy as np

#: Letters of a word at most: of a longer run each so many are a word.
LONGEST = 40
#: Words that are numbered together.
WORDS = 1 << 16
WORD = re.compile(rf"\S{{1,{LONGEST}}}")


def word_lists(text: str) -> Iterator[list[str]]:
    """The words of a text after lower-casing (runs without white space), in lists of bounded length."""
    text = text.lower()
    if len(text) <= WORDS:
        yield WORD.findall(text)
    else:
        for found in batched(WORD.finditer(text), WORDS):
            yield [m.group() for m in found]


def numbered(texts: Iterable[str]) -> Iterator[tuple[list[str], np.ndarray, list[int], list[int]]]:
    """Different words, the number of each word in the order of the texts, and for each run of words that are of one text
    the text's position and the run's length. A long text has several runs, in order."""
    words: list[str] = []
    of: list[int] = []
    sizes: list[int] = []

    def group() -> tuple[list[str], np.ndarray, list[int], list[int]]:
        index: defaultdict[str, int] = defaultdict()
        index.default_factory = index.__len__
        numbers = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
        return list(index), numbers, of, sizes

    for k, text in enumerate(texts):
        for found in word_lists(text):
            if found:
                words.extend(found)
                of.append(k)
                sizes.append(len(found))
            if len(words) >= WORDS:
                yield group()
                words, of, sizes = [], [], []
    if words:
        yield group()
