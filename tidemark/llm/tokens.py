"""Encoding with a public tokenizer, fast enough for whole corpora.

``word_bpe_49k.json`` drops white space and never merges across it, its normalizer keeps white space
apart from its neighbours (a space composes with nothing under NFC), and its special tokens contain
none.  So a text's ids are the ids of its white-space separated words, one after the other.
`WordEncoder` asks the tokenizers library for each distinct word and remembers the answer in a bounded
table.  A word of plain letters, perhaps with plain punctuation behind it, needs neither normalizer nor
splitting: lower-cased and spelt in the byte alphabet it goes to the library's BPE model at once.  Columns
of texts are split and put together in Arrow, each distinct word of a batch is looked up once, and words
that are not remembered are encoded one after the other, which keeps the model in the processor's cache.  All
give the library's own ids at several times its speed; tests compare them on whole texts.  A vocabulary
that gives white space ids of its own is refused.
"""

from __future__ import annotations

import os
import re
from array import array
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .remembered import remembered

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: The file that the queries use, by name; see `vocabulary`.
WORD_BPE = "word_bpe_49k.json"
#: Letters that are one code point in any normal form, with one lower-case letter each; then punctuation.
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?#*$%&|]*)")
MARKS = b".,;:!?#*$%&|"
#: Texts whose ids tell whether a vocabulary drops white space and keeps to words.
SPACED = ("a b", " ab  cd\nef\t", "the cat\r\nsat. 12 34", "\n\n", "x\fy\vz")
PROBES = ("abc", "Élan", "thé,", "straße", "x##$", "ÿ!", "a***", "ÞÆØ|", "Zeitung.", "e&&&")


def vocabulary(name: str = WORD_BPE) -> str:
    """Path of a public vocabulary file that is installed beside the libraries."""
    import public_tokenizers

    return public_tokenizers.path(name)


_id = attrgetter("id")


def ids(library, text: str) -> list[int]:
    return library.encode(text, add_special_tokens=False).ids


class WordEncoder(dict):
    """Ids of texts as little-endian unsigned 32-bit bytes; as a mapping, word to ids.

    Words of at most ``memory_bytes`` bytes are remembered, the last ``memory_words`` new ones or up to
    twice as many (and those of the last two batches); others are encoded again, with the same ids.
    """

    def __init__(self, path: str, memory_words: int = 180_000, memory_bytes: int = 64):
        from tokenizers import Tokenizer

        super().__init__()
        library = Tokenizer.from_file(path)
        self.size = library.get_vocab_size()
        if any(ids(library, text) != [i for word in text.split() for i in ids(library, word)] for text in SPACED):
            raise ValueError(f"{path} does not encode a text as the words between its white space")
        self._encode, self._model = library.encode, library.model.tokenize
        self._memory_words, self._memory_bytes, self._older = memory_words, memory_bytes, {}
        letters = (chr(c) for c in (*range(0x61, 0x7B), *range(0xDF, 0x100)) if c != 0xF7)
        self._spelling = {ord(c): library.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in letters}
        self._match, self._tails = PLAIN.fullmatch, {b"": b""}
        self._bytewise = all(self._spelling[c] == chr(c) for c in range(0x61, 0x7B))
        if any(self._plain(self._match(w)) != self._whole(w) for w in PROBES):
            self._match, self._bytewise = lambda word: None, False  # a vocabulary that works otherwise

    def _whole(self, word: str) -> bytes:
        return array("I", self._encode(word, add_special_tokens=False).ids).tobytes()

    def _plain(self, found: re.Match) -> bytes:
        stem, tail = found.groups()
        ids = [t.id for t in self._model(stem.lower().translate(self._spelling))]
        if tail:
            ids += [t.id for t in self._model(tail)]
        return array("I", ids).tobytes()

    def _new(self, word: bytes) -> bytes:
        """Ids of a word that is not remembered; what `_plain` does is done on bytes where all letters are ASCII."""
        stem = word.rstrip(MARKS)
        if not (self._bytewise and stem.isalpha()):
            text = word.decode("utf-8", "replace")
            return self._plain(found) if (found := self._match(text)) else self._whole(text)
        lower = stem.lower()
        ids = None if lower == word else self.get(lower)
        if ids is None:
            ids = array("I", map(_id, self._model(lower.decode()))).tobytes()
        if len(stem) == len(word):
            return ids
        tail = word[len(stem) :]
        if (last := self._tails.get(tail)) is None:
            last = array("I", map(_id, self._model(tail.decode()))).tobytes()
            if len(tail) <= 4:
                self._tails[tail] = last
        return ids + last

    def _make_room(self) -> None:
        if len(self) >= self._memory_words:
            self._older = dict(self)
            self.clear()

    def __missing__(self, word: bytes) -> bytes:
        ids = self._older.get(word)
        if ids is None:
            ids = self._new(word)
        if len(word) <= self._memory_bytes:
            self._make_room()
            self[word] = ids
        return ids

    def ids(self, raw: bytes) -> bytes:
        return b"".join(map(self.__getitem__, raw.split()))

    def each(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words; those that are not remembered are encoded after all others are looked up."""
        self._make_room()
        found = [*map(self.get, words)]
        missing = [k for k, ids in enumerate(found) if ids is None]
        for k in missing:
            found[k] = self._older.get(words[k])
        for k in missing:
            word, ids = words[k], found[k]
            if ids is None:
                ids = found[k] = self._new(word)
            if len(word) <= self._memory_bytes:
                self[word] = ids
        return found

    def column(self, texts: pa.Array, width: str | np.dtype = "<u4", end: bytes = b"") -> pa.Array:
        """Ids of each text (null: empty) and then ``end``, which is given as `ids` gives ids, as integers of ``width``."""
        lists = pc.ascii_split_whitespace(texts.fill_null(""))
        words = lists.flatten().dictionary_encode()
        found = self.each(words.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()) + [end]
        data = np.frombuffer(b"".join(found), "<u4").astype(width)
        places = np.concatenate(([0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found))))) // 4 * data.itemsize
        kinds = pa.Array.from_buffers(pa.large_binary(), len(found), [None, pa.py_buffer(places), pa.py_buffer(data)])
        stops = np.cumsum(lists.value_lengths().to_numpy(), dtype=np.int64)
        flat = kinds.take(pa.array(np.insert(words.indices.to_numpy(), stops, len(found) - 1)))
        starts = np.concatenate(([0], stops + np.arange(1, len(stops) + 1)))
        bounds = np.frombuffer(flat.buffers()[1], np.int64, len(flat) + 1)[starts]
        if bounds[-1] >= 1 << 31:
            raise ValueError("the ids of a batch of texts take 2 GB or more")
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(bounds.astype(np.int32)), flat.buffers()[2]])


def encoder(path: str, **memory: int) -> WordEncoder:
    """This worker's encoder for a vocabulary file; workers are used for many tasks."""
    return remembered(("encoder", path, *memory.items()), lambda: WordEncoder(path, **memory))
