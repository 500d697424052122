"""Token ids of whole texts by a public tokenizer file, with a cache of words.

The vocabulary ``word_bpe_49k.json`` splits a text into words before it merges, so a word's ids depend on the word
alone. Texts within Latin letters (code points under 0x250, where composing changes nothing and lower case is one rule)
are cut at white space, and the ids of a word's parts come from the vocabulary's merges, or from a cache; all other texts
go to the tokenizer whole. Both ways give the same ids.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np

TOKENIZER = "word_bpe_49k.json"
#: Entries in a cache, of which a worker has two; how many times as many may pass it by before it starts afresh.
REMEMBER, AFRESH = 150_000, 40

_LATIN = [chr(c) for c in range(0x250)]
_LETTERS = "".join(re.escape(c) for c in _LATIN if unicodedata.category(c)[0] == "L")
_NUMBERS = "".join(re.escape(c) for c in _LATIN if unicodedata.category(c)[0] == "N")
_PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_LETTERS}{_NUMBERS}]+")
#: Beyond Latin; a letter whose lower case is two characters; separators that Python alone takes for white space.
_OTHER = re.compile("[^\x00-\u024f]|[\u0130\x1c-\x1f]")


def _plain(text: str) -> bool:
    """Whether a text is within Latin and without odd separators; most texts show it by being ASCII or Latin-1."""
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return not _OTHER.search(text)
    return not any(c in text for c in "\x1c\x1d\x1e\x1f")


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself where it prints, else the next one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_BYTE_LETTERS = _byte_letters()


def path_of(tokenizer: str) -> str:
    """The file itself, or the installed public file of that name."""
    if os.path.sep in tokenizer:
        return tokenizer
    import public_tokenizers

    return public_tokenizers.path(tokenizer)


class _Cache(dict):
    """Ids by string, as packed numbers; ``make`` gives those that are new.

    The strings that come first are kept, as frequent ones do; once very many others have come, it starts afresh.
    """

    def __init__(self, make: Callable[[str], bytes]) -> None:
        self.make, self.room, self.passed = make, REMEMBER, 0

    def __missing__(self, key: str) -> bytes:
        found = self.make(key)
        if self.room:
            self.room -= 1
            self[key] = found
        else:
            self.passed += 1
            if self.passed > AFRESH * REMEMBER:
                self.clear()
                self.room, self.passed = REMEMBER, 0
        return found


class WordTokenizer:
    """ids(texts) for the tokenizer file; one for each worker process."""

    def __init__(self, tokenizer: str = TOKENIZER) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path_of(tokenizer))
        self.model = self.full.model
        size = 1 + max(self.full.get_vocab(with_added_tokens=True).values())
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.special = [t.content for t in self.full.get_added_tokens_decoder().values()]
        self.parts = _Cache(self._part)
        self.words = _Cache(self._word)

    def whole(self, text: str) -> list[int]:
        """The ids as the tokenizer gives them."""
        return self.full.encode(text, add_special_tokens=False).ids

    def _part(self, part: str) -> bytes:
        if not (part.isascii() and part.isprintable()):
            part = part.encode().decode("latin-1").translate(_BYTE_LETTERS)
        ids = [t.id for t in self.model.tokenize(part)]
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def _word(self, word: str) -> bytes:
        if word.isalpha():  # letters alone are one part
            return self.parts[word]
        if word[:-1].isalpha() and not word[-1].isalnum():
            return self.parts[word[:-1]] + self.parts[word[-1]]
        return b"".join([self.parts[p] for p in _PARTS.findall(word)])

    def ids(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        word = self.words.__getitem__
        for text in texts:
            if not _plain(text) or any(s in text for s in self.special):
                yield np.array(self.whole(text), dtype=self.dtype)
            else:
                yield np.frombuffer(b"".join(map(word, text.lower().split())), dtype=self.dtype)


_CONTROL = re.compile("[\x1c-\x1f]")
_open: dict[str, WordTokenizer] = {}


def tokenizer_for(tokenizer: str) -> WordTokenizer:
    """The worker's own tokenizer, loaded once."""
    if tokenizer not in _open:
        _open[tokenizer] = WordTokenizer(tokenizer)
    return _open[tokenizer]
