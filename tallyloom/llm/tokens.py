"""Token ids of whole texts through a table of distinct words.

The tokenizer drops white space, lower-cases, and cuts text where letters, digits and
punctuation meet, so the ids of a text are the ids of its white-space separated words one
after the other. Arrow splits a batch of texts and numbers its distinct words; each distinct
word goes through the tokenizers library once per task (while it stays in a bounded cache),
and numpy joins the ids back by position. A full cache keeps what the next texts need.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import common

VOCABULARY = "word_bpe_49k.json"
#: ASCII punctuation but the apostrophe, which can begin a contraction.
_MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Words of ASCII and Latin-1 letters: one piece each, as they stand.
_WORD = re.compile(rb"(?:[a-z]|\xC3[\x80-\x96\x98-\xB6\xB8-\xBF])+")
_BETWEEN = "<|startoftext|>"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Ids as little-endian unsigned 32-bit integers. limit: words kept in the cache."""

    def __init__(self, path: str, limit: int = 250_000):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.between = self.tokenizer.token_to_id(_BETWEEN)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.limit = limit
        self.known: dict[bytes, bytes] = {}

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def words(self, words: list[bytes], at_once: int = 4000) -> list[bytes]:
        """Ids of each word, none of which holds '<|'."""
        out: list[bytes] = []
        for i in range(0, len(words), at_once):
            joined = _BETWEEN.join(w.decode("utf-8", "replace") for w in words[i : i + at_once])
            out += self._cut(joined, None)
        return out

    def letters(self, words: list[bytes], at_once: int = 4000) -> list[bytes]:
        """The same for words of Latin letters only: each ends with the one id that ends a word."""
        out: list[bytes] = []
        for i in range(0, len(words), at_once):
            out += self._cut(b" ".join(words[i : i + at_once]).decode(), self.ends)
        return out

    def _cut(self, joined: str, ends: np.ndarray | None) -> list[bytes]:
        ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
        data = ids.tobytes()
        if ends is None:
            cuts = np.flatnonzero(ids == self.between)
            starts, stops = [0, *(4 * cuts + 4).tolist()], [*(4 * cuts).tolist(), len(data)]
        else:
            stops = (4 * np.flatnonzero(ends[ids]) + 4).tolist()
            starts = [0, *stops[:-1]]
        return [data[a:b] for a, b in zip(starts, stops)]

    def learn(self, missing: list[bytes]) -> None:
        plain, other = [], []
        for w in missing:
            (plain if _WORD.fullmatch(w) else other).append(w)
        self.known.update(zip(plain, self.letters(plain) if plain else ()))
        self.known.update(zip(other, self.words(other) if other else ()))

    def distinct(self, words: list[bytes]) -> list[bytes]:
        """Ids of each of some distinct lower-case words. A run of marks after a letter or digit is apart."""
        cut = {}
        for w in words:
            if w and w[-1] in _MARKS:
                stem = w.rstrip(_MARKS)
                if stem and (stem[-1:].isalnum() or _WORD.fullmatch(stem)):
                    cut[w] = stem, w[len(stem) :]
        needed = {w for w in words if w not in cut}.union(*cut.values()) if cut else set(words)
        missing = [w for w in needed if w not in self.known]
        if len(self.known) + len(missing) > self.limit:
            self.make_room(needed)
        self.learn(missing)
        known = self.known
        return [known[cut[w][0]] + known[cut[w][1]] if w in cut else known[w] for w in words]

    def make_room(self, needed: set[bytes]) -> None:
        """Keeps the known words that are needed now, and of the others the newest that the limit leaves room for."""
        known, room = self.known, max(0, self.limit - len(needed))
        others = [w for w in known if w not in needed]
        kept = {w: known[w] for w in others[max(0, len(others) - room) :]}
        self.known = kept | {w: known[w] for w in needed if w in known}

    def encode(self, texts: pa.Array, at_once: int = 8 << 20):
        """Yields the ids of each text of a string array in turn, about at_once bytes of text at a time."""
        for at, to in common.slices(texts, at_once):
            yield from self._encode(texts[at:to])

    def _encode(self, texts: pa.Array):
        texts = pc.fill_null(texts, "")
        special = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(special), "", texts) if special.any() else texts
        ids, ends = self.split(plain)
        for i in range(len(texts)):
            yield self.whole(texts[i].as_py()) if special[i] else ids[ends[i] : ends[i + 1]]

    def split(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts, and where each text's ids begin and end."""
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        coded = pc.dictionary_encode(lists.flatten())
        words = coded.dictionary.cast(pa.binary()).to_pylist()
        ids = self.distinct(words)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, starts = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes) - sizes
        at = coded.indices.to_numpy(zero_copy_only=False)
        lengths = sizes[at]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        out = flat[np.repeat(starts[at] - ends[:-1], lengths) + np.arange(ends[-1])]
        offsets = lists.offsets.to_numpy(zero_copy_only=False)
        return out, ends[offsets - offsets[0]]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per Python worker, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
