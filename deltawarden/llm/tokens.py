"""Token ids of whole texts, one space-separated word at a time.

The tokenizer cuts words at white space before it merges anything, so the ids of a text are those of its words in
order. Prose repeats words, so each worker keeps the ids of recent words in a table of bounded size.
"""

from __future__ import annotations

import os
import unicodedata
from functools import lru_cache

import numpy as np

# Marks that the tokenizer cuts off a letter or digit before them; an apostrophe may belong to a contraction.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def _signs() -> dict[int, str]:
    """Byte-level vocabularies spell bytes as letters: printable ones as themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_SIGNS = _signs()
# Words that no step of a tokenizer before the merges should change.
_PROBES = ("a", "the", "walking", "don", "zzqx", "\u00e9t\u00e9", "stra\u00dfe", "\u0142\u00f3d\u017a", "\u00e6ther")


def _plain(word: str) -> bool:
    """Lower-case Latin letters alone, in composed form: nothing to normalise and no place to cut."""
    return word.isalpha() and word.islower() and (word.isascii() or max(word) < "\u0250" and word.lower() == word
                                                  and unicodedata.is_normalized("NFC", word))


def _direct(model):
    """Ids of a plain word straight from the merges, without normalising and cutting; None where a tokenizer gives
    other ids that way."""
    def ids(word: str) -> list[int]:
        spelled = word if word.isascii() else "".join(map(_SIGNS.__getitem__, word.encode()))
        return [token.id for token in merges.tokenize(spelled)]

    merges = model.model
    same = all(ids(w) == model.encode(w, add_special_tokens=False).ids for w in _PROBES)
    return ids if same else None


class WordIds(dict):
    """Word to little-endian unsigned 32-bit ids. Two generations: words not seen for a generation are forgotten.

    A new word is looked up without the marks around it and in lower case (the tokenizer lower-cases) before it is
    given to the tokenizer.
    """

    def __init__(self, encode, limit: int, longest: int, direct=None):
        super().__init__()
        self.encode, self.limit, self.longest, self.old, self.direct = encode, limit, longest, {}, direct

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None and self.direct and _plain(word):
            ids = np.array(self.direct(word), "<u4").tobytes()
        if ids is None:
            ids = self._of_parts(word) or np.array(self.encode(word), "<u4").tobytes()
        if len(word) <= self.longest:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


    def _of_parts(self, word: str) -> bytes | None:
        """The ids from those of simpler words, if the word is made of such; strings of special tokens are not."""
        if "<|" in word:
            return None
        stem = word.rstrip(MARKS)
        if stem and stem != word and stem[-1].isascii() and stem[-1].isalnum():
            return self[stem] + self[word[len(stem):]]
        stem = word.lstrip(MARKS)
        if stem and stem != word and stem[0].isascii() and stem[0].isalnum():
            return self[word[:len(word) - len(stem)]] + self[stem]
        lower = word.encode().lower().decode()  # of bytes: A-Z only
        return self[lower] if lower != word else None


@lru_cache(maxsize=4)
def word_ids(tokenizer: str, plain_specials: bool = False, limit: int = 500_000, longest: int = 64) -> WordIds:
    """tokenizer: path of a tokenizer file on the executors, or the name of an installed public one.

    plain_specials: the strings of special tokens in a text are ordinary text.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import public_tokenizers
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer if os.path.isabs(tokenizer) else public_tokenizers.path(tokenizer))
    model.encode_special_tokens = plain_specials
    return WordIds(lambda word: model.encode(word, add_special_tokens=False).ids, limit, longest, _direct(model))


def text_ids(text: str, table: WordIds) -> bytes:
    """All ids of the text, 4 bytes each."""
    return b"".join(map(table.__getitem__, text.replace("\n", " ").split(" ")))
