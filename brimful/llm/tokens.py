"""Token ids of whole texts with a public tokenizer.

The tokenizer drops white space and no token crosses it, so a text's ids are the ids of its words in
order. Words are split and numbered by Arrow, so that each distinct word of a batch is looked up once, in
a bounded cache that lives as long as the Python worker. A word that is not there is looked up again in
lower case and without the marks after its last letter or digit, which the tokenizer parts from it anyway.
What is still unknown in a batch is encoded together: words of small Latin letters, which the tokenizer's
normalizer and word pattern leave whole, many to a call and parted again at the tokens that end a word; the
rest one by one. The ids then come from one flat array.
"""

from __future__ import annotations

import os
import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

CACHE_WORDS = 800_000
#: ASCII marks that never join a letter or digit in one token. Apostrophes do, and angle and upright bars may spell special tokens.
MARKS = b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
#: Small letters of ASCII and Latin-1 in UTF-8.
LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch
CALL_WORDS = 200


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _parts(word: bytes) -> tuple[bytes, bytes]:
    """(stem, marks) whose ids in a row are the word's ids."""
    if LETTERS(word):
        return word, b""
    if b"<|" in word:  # may hold a special token
        return word, b""
    stem = word.rstrip(MARKS)
    if stem and len(stem) < len(word) and stem[-1:].isalnum():
        return stem.lower(), word[len(stem) :]
    return word.lower(), b""


class WordIds:
    """Ids of words; a word's number leads to its place in a flat array of ids."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.ends_word: np.ndarray | None = None
        suffix = self.tokenizer.model.end_of_word_suffix
        if suffix and "ByteLevel" in repr(self.tokenizer.pre_tokenizer):
            from tokenizers import pre_tokenizers

            self.letters = Tokenizer(self.tokenizer.model)
            self.letters.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            vocab = self.tokenizer.get_vocab()
            self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
            self.ends_word[[i for token, i in vocab.items() if token.endswith(suffix)]] = True
            alphabet = {bytes([b]): pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(b))[0][0][-1] for b in range(0x80, 0xC0)}
            self.shown = {ord(b): c for b, c in alphabet.items()}
        self._clear()

    def _clear(self) -> None:
        self.number: dict[bytes, int] = {b"": 0}
        self.first, self.size, self.flat = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _learn(self, words: list[bytes]) -> None:
        """Numbers for new words."""
        parts = list(map(_parts, words))
        known = self.number
        new = [w for w in dict.fromkeys(chain.from_iterable(parts)) if w not in known]
        letters = sorted(filter(LETTERS, new), key=bytes.isascii) if self.ends_word is not None else []
        if letters:
            latin = next((i for i, w in enumerate(letters) if w.isascii()), len(letters))
            shown = b" ".join(letters[:latin]).decode("latin-1").translate(self.shown).split() + b" ".join(letters[latin:]).decode().split()
            ids = self._encoded(self.letters, [" ".join(shown[i : i + CALL_WORDS]) for i in range(0, len(shown), CALL_WORDS)])[1]
            self._append(letters, np.diff(np.flatnonzero(self.ends_word[ids]), prepend=-1), ids)
            new = [w for w in new if w not in known]
        self._append(new, *self._encoded(self.tokenizer, [w.decode("utf-8", "replace") for w in new]))
        rest = [(word, pair) for word, pair in zip(words, parts, strict=True) if word not in known]
        pairs = np.array([(known[stem], known[marks]) for _, (stem, marks) in rest], np.int64).reshape(-1)
        sizes = self.size[pairs]
        self._append([word for word, _ in rest], sizes[::2] + sizes[1::2], self._ids(pairs))

    @staticmethod
    def _encoded(tokenizer: Tokenizer, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of ids, ids in a row) of the texts."""
        found = [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(map(len, found), np.int64, len(texts)), np.fromiter(chain.from_iterable(found), np.uint32)

    def _append(self, words: list[bytes], sizes: np.ndarray, ids: np.ndarray) -> None:
        self.number.update(zip(words, range(len(self.first), len(self.first) + len(words)), strict=True))
        self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.flat = np.concatenate([self.flat, ids])

    def _ids(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of words in a row."""
        sizes = self.size[numbers]
        at = np.repeat(self.first[numbers] - np.cumsum(sizes) + sizes, sizes)
        at += np.arange(len(at))
        return self.flat[at]

    def texts(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ends, ids): the ids of all texts in a row, each with the end id; those of text i are ids[ends[i]:ends[i + 1]]."""
        if len(self.number) > CACHE_WORDS:
            self._clear()
        rows = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        coded = rows.values.dictionary_encode()
        words = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        number = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(number < 0)
        if len(new):
            self._learn([words[i] for i in new.tolist()])
            number[new] = [self.number[words[i]] for i in new.tolist()]
        numbers = number[coded.indices.to_numpy()]
        bare = np.append(0, np.cumsum(self.size[numbers]))[rows.offsets.to_numpy()]
        ids = np.insert(self._ids(numbers), bare[1:], end_id)
        return bare + np.arange(len(bare)), ids


_open: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _open:
        _open[path] = WordIds(path)
    return _open[path]
