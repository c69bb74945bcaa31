"""Token ids of whole texts with a word cache around a lower-casing word BPE.

The tokenizer never joins anything across white space, so a text's ids are the ids of its words in a
row. Words are looked up by their bytes, with ASCII letters lowered and a trailing run of . , ; : ! ?
taken apart; only words not met before in this process are encoded by the library. A test holds the
result against encoding whole texts. White space here is 0x20 and 0x09-0x0D.
"""

from __future__ import annotations

import os
import unicodedata
from array import array

import numpy as np
import pyarrow as pa

from .common import flat

CACHE_BYTES = 72 << 20  # of the cached words of a process, about; beyond, the less used half of them goes
WORD_BYTES = 120  # of the objects that hold one word
TAKE_BYTES = 1 << 21

_TAIL = b".,;:!?"
_encoders: dict[tuple[str, bool], WordEncoder] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoder(path: str, literal: bool = False) -> WordEncoder:
    """The process's encoder of a tokenizer file. ``literal``: special strings are ordinary text."""
    if (path, literal) not in _encoders:
        _encoders[path, literal] = WordEncoder(path, literal)
    return _encoders[path, literal]


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in printable}
    for i, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + i)
    return letters


class _Codes(dict):
    """word -> code; an unknown word gets the next code and is queued. ``size``: about the bytes of the words learnt."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []
        self.size = 0

    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self)
        self.new.append(word)
        return code


class WordEncoder:
    def __init__(self, path: str, literal: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = literal
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.clear()

    def clear(self) -> None:
        self.codes, self.ids, self.starts, self.sizes = _Codes(), array("I"), array("q"), array("q")
        self.uses = np.zeros(0, np.int64)

    def _forget(self) -> None:
        """Drop the less used half of the words."""
        kept = np.sort(np.argsort(-self.uses, kind="stable")[: len(self.uses) // 2])
        words, ids, starts, sizes, uses = list(self.codes), np.array(self.ids), np.array(self.starts), np.array(self.sizes), self.uses
        self.clear()
        for code, at in enumerate(kept.tolist()):
            self.codes[words[at]] = code
            self.codes.size += WORD_BYTES + len(words[at])
        if self.codes.size > CACHE_BYTES // 4 * 3:  # long words
            return self.clear()
        sizes = sizes[kept]
        ends = np.cumsum(sizes)
        self.ids.frombytes(ids[np.repeat(starts[kept] - ends + sizes, sizes) + np.arange(sizes.sum())].tobytes())
        self.starts.frombytes((ends - sizes).tobytes())
        self.sizes.frombytes(sizes.tobytes())
        self.uses = uses[kept] // 2

    def _stem(self, stem: bytes) -> list[int]:
        """Ids of one word."""
        text = stem.decode()
        if text.isalpha() and (text.isascii() or unicodedata.is_normalized("NFC", text) and not {"Σ", "İ"} & set(text)):
            low = text.lower().encode()  # one run of letters: what the pre-tokenizer would hand to the model
            return [t.id for t in self.model.tokenize("".join(map(self.letters.__getitem__, low)))]
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _learn(self) -> None:
        """Ids of the queued words. A word with a trailing run has those of its two parts, which are words of their own."""
        new, parts = self.codes.new, {}
        for word in new:  # parts not met before are queued meanwhile
            stem = word.rstrip(_TAIL)
            if stem and len(stem) < len(word) and (chr(stem[-1]).isalnum() if stem[-1] < 128 else stem.decode()[-1].isalpha()):
                parts[word] = [self.codes[stem], self.codes[word[len(stem):]]]
        first = len(self.starts)
        self.starts.frombytes(bytes(8 * len(new)))
        self.sizes.frombytes(bytes(8 * len(new)))
        for composed in (False, True):
            for code, word in enumerate(new, first):
                if (word in parts) == composed:
                    self.starts[code] = len(self.ids)
                    for part in parts.get(word, ()):
                        self.ids.extend(self.ids[self.starts[part]: self.starts[part] + self.sizes[part]])
                    if not composed:
                        self.ids.extend(self._stem(word))
                    self.sizes[code] = len(self.ids) - self.starts[code]
        self.codes.size += WORD_BYTES * len(new) + sum(map(len, new))
        self.codes.new = []

    def rows(self, column: pa.Array):
        """(first row, ids of several rows as uint32, their offsets), until all rows of ``column`` are done."""
        data, offsets = flat(column)
        whole, lo, n = data.tobytes(), 0, len(offsets) - 1
        while lo < n:
            if self.codes.size > CACHE_BYTES:
                self._forget()
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + TAKE_BYTES, "right")) - 1)
            codes, counts = [], np.zeros(hi - lo + 1, np.int64)
            for i in range(lo, hi):
                text = whole[offsets[i]: offsets[i + 1]]
                words = (text if b"<|" in text else text.lower()).split()
                codes.extend(map(self.codes.__getitem__, words))
                counts[i - lo + 1] = len(codes)
            self._learn()
            code = np.array(codes, np.int64)
            starts, sizes, known = np.array(self.starts), np.array(self.sizes), np.array(self.ids)
            self.uses = np.bincount(code, minlength=len(sizes)) + np.append(self.uses, np.zeros(len(sizes) - len(self.uses), np.int64))
            lengths = sizes[code]
            total = np.concatenate([[0], np.cumsum(lengths)])
            at = np.repeat(starts[code] - total[:-1], lengths) + np.arange(total[-1])
            ids = known[at] if len(at) else np.empty(0, np.uint32)
            yield lo, ids, total[counts]
            lo = hi
