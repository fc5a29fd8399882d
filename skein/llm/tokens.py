"""Exact token ids of whole texts, unit by unit.

Both vocabularies cut a text at white space before they merge, so a unit between two spaces has ids
of its own. Units repeat: their ids are kept in a bounded table in each Python worker, and only new
units go through the tokenizers library. A text in which that cut isn't certain is encoded whole.
"""

from __future__ import annotations

import re
import string
from array import array

import numpy as np

from skein.llm.caches import only

#: Units kept in a worker at most (about 200 bytes each).
KEPT_UNITS = 400_000
_OTHER_SPACE = re.compile(r"[^\S \n]")


class UnitEncoder(dict):
    """ids of texts as little-endian uint16 or uint32 bytes (``dtype``), without special tokens.

    The mapping itself holds the ids of units already seen.
    """

    def __init__(self, path: str, kept: int = KEPT_UNITS):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.normalizer = self.tokenizer.model, self.tokenizer.normalizer
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.kept, self.tails = kept, {}
        # A vocabulary that drops white space has no ids for it.
        self.drops_space = not self.tokenizer.encode(" \n", add_special_tokens=False).ids
        # Byte-level vocabularies write bytes as letters: those that print stand for themselves, the
        # others follow in order from code point 256.
        own = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = [b for b in range(256) if b not in own]
        self.letters = {b: chr(256 + i) for i, b in enumerate(others)}
        self.space = "" if self.drops_space else self.letters[32]
        self.line = self.whole("\n")

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype).tobytes()

    def _word(self, word: str, space: str) -> bytes | None:
        """ids of letters alone after an optional space; None if normalising leaves other signs."""
        if word.isascii():
            spelled = word.lower() if self.drops_space else word
        else:
            if self.drops_space:
                word = self.normalizer.normalize_str(word)
                if not word.isalpha():
                    return None
            spelled = word.encode().decode("latin-1").translate(self.letters)
        return array(self.code, [t.id for t in self.model.tokenize(space + spelled)]).tobytes()

    def __missing__(self, unit: str) -> bytes:
        """A unit of letters and then punctuation is two words to the vocabulary, a line break before
        letters stands alone; other units go whole."""
        word = unit.rstrip(string.punctuation)
        tail = unit[len(word) :]
        line = word[:1] == "\n"
        if line:
            word = word[1:]
        done = None
        if word.isalpha():
            done = self[word] if tail and not line else self._word(word, "" if line else self.space)
        if done is None:
            done = self.whole(unit if self.drops_space or line else f" {unit}")
        else:
            if tail:
                if tail not in self.tails:
                    if len(self.tails) > 10_000:
                        self.tails.clear()
                    self.tails[tail] = self.whole(tail)
                done += self.tails[tail]
            if line:
                done = self.line + done
        if len(self) < self.kept:
            self[unit] = done
        return done

    def text(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.drops_space:
            return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0] in " \n" or _OTHER_SPACE.search(text):
            return self.whole(text)
        units = f"\n{text}".replace("\n", " \n").split(" ")
        return b"".join(map(self.__getitem__, units[1:]))[self.dtype.itemsize :]  # without the first line break

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        return [self.text(t) for t in texts]


def encoder(path: str, kept: int = KEPT_UNITS) -> UnitEncoder:
    """One for each worker process."""
    return only(f"units {path} {kept}", lambda: UnitEncoder(path, kept))


def slices(batches, most_bytes: int = 4_000_000, column: str = "text"):
    """Arrow record batches cut into pieces of about ``most_bytes`` of text at most (one text at least)."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).cumsum()
        start = 0
        while start < batch.num_rows:
            base = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, base + most_bytes, "right")))
            yield batch.slice(start, end - start)
            start = end
