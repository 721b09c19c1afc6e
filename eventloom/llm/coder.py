"""Token ids of texts from a public tokenizer, with each different word tokenised once per batch at most.

The tokenizer's pre-tokenisation never joins characters across white space, and its normalisation neither looks nor reaches
across a space, so a text's ids are those of its words in a row. Words are told apart by 64-bit hashes of their bytes and kept in
a bounded cache; only new words meet the tokenizer. Ids equal those of the whole text, which the tests check.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np

from eventloom.llm.words import _LOWER_SPACES, _SPACES, word_hashes

#: Words kept before the cache starts anew (about 50 bytes each), and words given to the tokenizer in one string.
CACHE_WORDS, TOGETHER = 2_000_000, 500


class Coder:
    """Encodes batches of texts; made in the task from the path of the tokenizer's file."""

    def __init__(self, path: str, end_id: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end_id = end_id
        self.reset()

    def reset(self) -> None:
        self.keys, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # sorted by key
        self.words, self.begin, self.count = 0, np.zeros(1024, np.int32), np.zeros(1024, np.int32)
        self.flat, self.used = np.zeros(1 << 14, np.uint32), 0

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of known words among sorted keys, and which are known."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int32), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.place[at], self.keys[at] == keys

    def learn(self, keys: np.ndarray, words: list[str]) -> None:
        """Tokenise new words, many in one string, and part the ids by where they stand."""
        for at in range(0, len(words), TOGETHER):
            some = words[at : at + TOGETHER]
            starts = np.cumsum([0] + [len(w) + 1 for w in some])
            coded = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            ids = np.array(coded.ids, np.uint32)
            owner = np.searchsorted(starts, np.array([o[0] for o in coded.offsets], np.int64), "right") - 1
            n = np.bincount(owner, minlength=len(some))[: len(some)] if len(ids) else np.zeros(len(some), np.int64)
            first = self.words
            while first + len(some) > len(self.begin):
                self.begin, self.count = np.concatenate((self.begin, self.begin * 0)), np.concatenate((self.count, self.count * 0))
            while self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
            self.flat[self.used : self.used + len(ids)] = ids
            self.begin[first : first + len(some)] = self.used + np.cumsum(n) - n
            self.count[first : first + len(some)] = n
            self.used += len(ids)
            self.words += len(some)
        both = np.concatenate((self.keys, keys))
        order = np.argsort(both, kind="stable")
        self.keys = both[order]
        self.place = np.concatenate((self.place, np.arange(self.words - len(words), self.words, dtype=np.int32)))[order]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, and the end id."""
        hashes, sizes, raws, spans = [], [], [], []
        for text in texts:
            text = text or ""
            plain = "<|" not in text  # special tokens are met as they are written: no lower case there
            h, s, e = word_hashes(text, lower=plain)
            hashes.append(h)
            sizes.append(len(h))
            raws.append(text.encode("utf-8", "surrogatepass").translate(_LOWER_SPACES if plain else _SPACES))
            spans.append((s, e))
        flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        keys, first, inverse = np.unique(flat, return_index=True, return_inverse=True)
        if self.words + len(keys) > CACHE_WORDS:
            self.reset()
        missing = np.flatnonzero(~self.find(keys)[1])
        if len(missing):
            ends = np.cumsum(sizes)
            owner = np.searchsorted(ends, first[missing], "right")
            words = []
            for doc, at in zip(owner, first[missing]):
                k = at - (ends[doc] - sizes[doc])
                words.append(raws[doc][spans[doc][0][k] : spans[doc][1][k]].decode("utf-8", "surrogatepass"))
            self.learn(keys[missing], words)
        place = self.find(keys)[0][inverse]
        n = self.count[place]
        past = np.cumsum(n, dtype=np.int64)
        ids = self.flat[np.repeat(self.begin[place] - past + n, n) + np.arange(past[-1] if len(past) else 0)]
        upto = np.concatenate(([0], past))[np.cumsum([0] + sizes)]
        end = np.array([self.end_id], np.uint32)
        return [np.concatenate((ids[a:b], end)) for a, b in zip(upto[:-1], upto[1:])]


@lru_cache(maxsize=1)
def coder(path: str, end_id: int) -> Coder:
    """The coder of this Python worker, with the words that its earlier tasks met."""
    return Coder(path, end_id)
