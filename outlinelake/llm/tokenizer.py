"""Exact token ids of whole texts, with a bounded memory of words.

The vocabulary's pre-tokenizer never joins text across ASCII white space, so a text's ids are those of its words in
order. A word seen before is looked up. An unseen run of letters goes to the library's model, punctuation after it is
looked up apart, and any other word goes through the library's whole pipeline.
"""

from __future__ import annotations

import os
import sys
import types
import unicodedata

import numpy as np

#: Words remembered by one worker process; the memory starts afresh beyond.
WORDS = 500_000
_TAIL = b"!#$%&()*+,-./:;=?@]_|\""


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, int]:
    """Byte-level BPE's letter for each byte: printable ones stand for themselves, the others for those from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return dict(zip(plain, plain, strict=True)) | {b: 256 + i for i, b in enumerate(rest)}


class WordIds(dict):
    """From a word's UTF-8 bytes to its ids as packed little-endian unsigned 16-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        if self.library.get_vocab_size(with_added_tokens=True) > 1 << 16:
            raise ValueError("ids of this vocabulary do not fit 16 bits")
        self.model = self.library.model
        self.letters = _byte_letters()
        # runs of letters may skip the pipeline only if it does to them what _letters() does
        probe = ["Thing", "\u00c9t\u00e9s", "Stra\u00dfe", "\u03a3\u03c4\u03a3"]
        self.direct = all(self._whole(w.encode()) == self._letters(w) for w in probe)

    def _whole(self, word: bytes) -> bytes:
        return np.array(self.library.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids, dtype="<u2").tobytes()

    def _letters(self, text: str) -> bytes | None:
        """Ids of a run of letters; None if the pipeline might treat it otherwise."""
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                return None
            text = "".join(map(str.lower, text))
            if not text.isalpha():
                return None
            return self._tokenized(text.encode().decode("latin-1").translate(self.letters))
        return self._tokenized(text.lower())

    def _tokenized(self, text: str) -> bytes:
        return b"".join([t.id.to_bytes(2, "little") for t in self.model.tokenize(text)])

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= WORDS:
            self.clear()
        ids = None
        if self.direct:
            core = word.rstrip(_TAIL)
            text = core.decode("utf-8", "replace")
            if text.isalpha():
                ids = self._letters(text)
                if ids is not None and len(core) < len(word):
                    ids += self[word[len(core) :]]
        if ids is None:
            ids = self._whole(word)
        self[word] = ids
        return ids

    def packed(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; null counts as empty."""
        return [b"".join(map(self.__getitem__, (t or "").encode("utf-8", "surrogatepass").split())) for t in texts]


def word_ids(path: str) -> WordIds:
    """One memory for each worker process and vocabulary."""
    if "_outlinelake_words" not in sys.modules:
        sys.modules["_outlinelake_words"] = types.ModuleType("_outlinelake_words")
        sys.modules["_outlinelake_words"].by_path = {}
    kept = sys.modules["_outlinelake_words"]
    if path not in kept.by_path:
        kept.by_path[path] = WordIds(path)
    return kept.by_path[path]
