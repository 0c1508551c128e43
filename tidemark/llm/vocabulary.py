"""Splitting texts into words that a word-level BPE encodes one by one.

The tokenizer drops white space, lower-cases, and never merges across its word
pattern, so a text's ids are those of its words in turn. For characters below
U+0250 (all letters of which are stable under NFC) the words are found here; any
other stretch between ASCII white space, and any that may hold a special token,
is handed to the tokenizers library whole, as one word.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

# The word pattern of the vocabulary file, for characters below
# U+0250 and the letters that they become in lower case.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ʯⱥⱦ"
NUMBERS = "0-9²³¹¼½¾"
SPACES = "\t-\r \u0085 "


def _pattern(letters: str, numbers: str, spaces: str) -> str:
    """Words of letters first, as most are; no word that may come before them begins with one."""
    return f"[{letters}]+|'(?:s|t|re|ve|m|ll|d)|[{numbers}]|[^{spaces}{letters}{numbers}]+"


PATTERN = _pattern(LETTERS, NUMBERS, SPACES)
_words = re.compile(PATTERN).findall
# for texts of Latin-1, which lower case does not leave: classes below U+0100 are looked up in one table
_latin_words = re.compile(_pattern(*("".join(re.escape(c) for c in map(chr, range(256)) if re.match(f"[{x}]", c)) for x in (LETTERS, NUMBERS, SPACES)))).findall
_foreign = re.compile("[^\u0000-ɏ]").search
_chunks = re.compile("[^\t-\r ]+").findall
#: How the special tokens of the public vocabulary files begin.
SPECIAL = "<|"


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _simple(text: str) -> bool:
    return SPECIAL not in text and (text.isascii() or not _foreign(text))


def split_words(text: str) -> list[str]:
    """The words of ``text`` in order; words that start with a space are raw stretches."""
    if SPECIAL not in text and _latin(text):
        return _latin_words(text.lower())
    if _simple(text):
        return _words(text.lower())
    found: list[str] = []
    for chunk in _chunks(text):
        if _simple(chunk):
            found += _words(chunk.lower())
        else:
            found.append(" " + chunk)
    return found


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    loaded.no_truncation()
    loaded.no_padding()
    return loaded


def encode_words(path: str, words: list[str]) -> list[bytes]:
    """Each word's ids as little-endian unsigned 32-bit integers."""
    import numpy as np

    found = tokenizer(path).encode_batch_fast(words, add_special_tokens=False)
    return [np.array(e.ids, "<u4").tobytes() for e in found]


class WordIds(dict):
    """Word to ids, encoded when first met; holds ``most`` words at a time."""

    def __init__(self, path: str, most: int = 1_000_000):
        super().__init__()
        self.path, self.most = path, most

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        ids = self[word] = encode_words(self.path, [word])[0]
        return ids


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
