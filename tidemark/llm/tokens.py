"""Token ids of whole texts by a public tokenizer file."""

from __future__ import annotations

import sys
import types
from array import array
from string import punctuation

import numpy as np
import pyarrow as pa

from tidemark.llm.common import ship, split_words

ship(__name__)

END_ID = 1
MOST_CACHED = 500_000  # words whose ids a Python worker keeps, some 150 bytes each


class Encoder:
    """Ids of texts, equal to those of the whole text at once.

    The tokenizer drops white space and never merges over it, so the ids of a text are those of its words
    (cut at ASCII spaces) one after the other. Frequent words are encoded once a worker.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.dtype = np.dtype("<u4" if wide else "<u2")
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        for piece, i in self.tokenizer.get_vocab().items():
            self.ends[i] = piece.endswith("</w>")
        # Ids of the words met so far, one after the other; the end id comes first, so that it is a run like any other.
        self.known: dict[str, int] = {}
        self.flat = np.full(1 << 16, END_ID, dtype=self.dtype)
        self.starts, self.sizes = array("q", [0]), array("q", [1])

    def _of_words(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The words in another order, their ids one after the other, and how many each has.

        Words of letters alone go in long strings: each gives exactly one piece that ends a word.
        """
        order, flat, sizes = [], [np.empty(0, dtype=self.dtype)], [np.empty(0, dtype=np.int64)]
        plain, rest = [], []
        for w in words:
            (plain if w.isalpha() else rest).append(w)
        for at in range(0, len(plain), 100):
            some = plain[at : at + 100]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, dtype=self.dtype)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(some) and len(ids) == cuts[-1]:
                order += some
                flat.append(ids)
                sizes.append(np.diff(cuts, prepend=0))
            else:
                rest += some
        if rest:
            got = [e.ids for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]
            order += rest
            flat += [np.array(ids, dtype=self.dtype) for ids in got]
            sizes.append(np.array([len(ids) for ids in got], dtype=np.int64))
        return order, np.concatenate(flat), np.concatenate(sizes)

    def _add(self, words: list[str]) -> dict[str, int]:
        """Places of further words in the store."""
        order, new, sizes = self._of_words(words)
        at, first = self.starts[-1] + self.sizes[-1], len(self.starts)
        if at + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat[:at], np.empty(max(len(self.flat), len(new)), dtype=self.dtype)])
        self.flat[at : at + len(new)] = new
        self.starts.frombytes((at + np.cumsum(sizes) - sizes).astype(np.int64).tobytes())
        self.sizes.frombytes(sizes.astype(np.int64).tobytes())
        return dict(zip(order, range(first, len(self.starts)), strict=True))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of every text, and all ids in order. Each text ends with END_ID; null is empty."""
        counts, words = split_words(texts)
        ends = np.cumsum(counts)
        kept = len(self.starts)
        which = mark = np.zeros(0, dtype=np.int64)
        if len(words):
            coded = words.dictionary_encode()
            distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
            # Marks at the end of letters are split off by the tokenizer: a run beside that of the letters. It lower-cases A-Z.
            n, marked = len(distinct), []
            for i in range(n):
                w = distinct[i]
                stem = w.rstrip(punctuation)
                if len(stem) < len(w) and stem.isalpha():
                    marked.append(i)
                    distinct.append(w[len(stem) :])
                    w = stem
                distinct[i] = w.lower() if w.isascii() else w
            known = self.known
            place = np.fromiter((known.get(w, -1) for w in distinct), dtype=np.int64, count=len(distinct))
            fresh = np.flatnonzero(place < 0).tolist()
            if fresh:
                new = [distinct[i] for i in fresh]
                got = self._add(list(dict.fromkeys(new)))
                place[fresh] = np.fromiter((got[w] for w in new), dtype=np.int64, count=len(new))
                if len(known) + len(got) <= MOST_CACHED:
                    known.update(got)
                    kept = len(self.starts)
            index = coded.indices.to_numpy()
            marks = np.zeros(n, dtype=np.int64)
            marks[marked] = place[n:]
            which, mark = place[index], marks[index]
        # Words, their marks and text ends in one list of runs, then one gather.
        upto = np.concatenate([[0], np.cumsum(mark > 0)])
        first = np.arange(len(which)) + upto[:-1] + np.repeat(np.arange(len(counts)), counts)
        last = ends + upto[ends] + np.arange(len(counts))
        runs = np.zeros(len(which) + int(upto[-1]) + len(counts), dtype=np.int64)
        runs[first] = which
        runs[first[mark > 0] + 1] = mark[mark > 0]
        sizes = np.frombuffer(self.sizes, dtype=np.int64)[runs]
        begin = np.frombuffer(self.starts, dtype=np.int64)[runs]
        upto = np.cumsum(sizes)
        ids = self.flat[np.arange(int(upto[-1]) if len(upto) else 0) + np.repeat(begin - (upto - sizes), sizes)]
        stop = upto[last]
        del self.starts[kept:], self.sizes[kept:]  # what is not kept
        return np.diff(stop, prepend=0), ids


def encoder(path: str) -> Encoder:
    """One encoder for each file and Python worker, so a task finds the words of earlier ones."""
    store = sys.modules.setdefault("_encoders_of_worker", types.ModuleType("_encoders_of_worker")).__dict__
    if path not in store:
        store[path] = Encoder(path)
    return store[path]
