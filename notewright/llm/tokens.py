"""Ids of whole texts by files of the tokenizers library, with each different chunk encoded once.

A chunk is a piece of text at whose ends the tokenizer's own pre-tokenizer always cuts, so the ids of a
text are those of its chunks one after the other. Texts for which that can't be told (rare white space)
go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from itertools import islice

import numpy as np

#: White space that only some regular expression engines know as such.
ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Texts with none of these can be lower-cased before the tokenizer's normalizer does it.
NOT_PLAIN = re.compile("[\u0130\u0300-\U0010ffff]")
_LETTERS = "[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]++"
_SPACE = "[\x20\x09-\x0d]"
#: A word of letters without a single mark at its end; that mark; anything else up to white space.
BY_WORD = re.compile(rf"{_LETTERS}(?=[.,]?(?:{_SPACE}|\Z))|[^\x20\x09-\x0d]+")
#: The same where a word has the space before it and other white space stands alone.
BY_SPACE = re.compile(rf"\x20?{_LETTERS}(?=[.,]?(?:{_SPACE}|\Z))|\x20?[^\x20\x09-\x0d]+|{_SPACE}+(?![^\x20\x09-\x0d])|{_SPACE}+")
#: For a known file: its chunks, and whether it lower-cases.
CHUNKS = {"word_bpe_49k.json": (BY_WORD, True), "byte_bpe_50k.json": (BY_SPACE, False)}
#: Chunks that are encoded many at a time: in files that mark a word's end, or the space before it.
SIMPLE, SPACED = re.compile("[a-z\xdf-\xf6\xf8-\xff]++"), re.compile(rf"\x20{_LETTERS}")


def byte_letters() -> dict[int, str]:
    """What byte-level files write for each byte: itself if it can be seen, else the next letter from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in seen)}


_LETTER_OF = byte_letters()
#: The same for characters of two bytes at most (Latin-1), as str.translate takes it.
_WORD_BYTES = {c: "".join(_LETTER_OF[b] for b in chr(c).encode()) for c in range(256) if c != 10}


def plain_tokenizer(path: str):
    """The file's own merges without what finds words, for words that are told apart already: the library's byte-level
    pre-tokenizer and its cache take more time than the merges. They are joined by line feeds, in byte_letters()."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    options = {k: model[k] for k in ("unk_token", "continuing_subword_prefix", "end_of_word_suffix") if model.get(k)}
    out = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges, cache_capacity=0, **options))
    out.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
    return out


class _Memo(dict):
    def __init__(self):
        super().__init__()
        self.new = []

    def __missing__(self, chunk):
        n = self[chunk] = len(self)
        self.new.append(chunk)
        return n


class Encoder:
    """encode(texts) gives all ids as one array, each text's ids followed by end_id, and the texts' bounds in it.

    keep bounds the number of remembered chunks, and so the memory. tokenizer: the path of the file.
    """

    def __init__(self, tokenizer: str, chunks: re.Pattern | None, end_id: int, lower: bool = False, keep: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(tokenizer)
        self.tok.encode_special_tokens = True  # their strings in a text are ordinary text
        self.chunks, self.end_id, self.lower, self.keep = chunks, end_id, lower, keep
        self.simple = SIMPLE if lower else SPACED
        #: Ids that a word ends in, or (with the space before it) begins with.
        self.bound = np.zeros(self.tok.get_vocab_size(with_added_tokens=True), bool)
        if chunks:
            self.plain = plain_tokenizer(tokenizer)
            self.bound[[i for t, i in self.tok.get_vocab(with_added_tokens=False).items() if (t.endswith("</w>") if lower else t.startswith(_LETTER_OF[32]))]] = True
        self._reset()

    def _reset(self) -> None:
        self.memo = _Memo()
        self.flat, self.at, self.n = np.array([self.end_id], np.uint32), np.zeros(1, np.int64), np.ones(1, np.int64)
        self.memo[None] = 0

    def _shrink(self, n: int) -> None:
        """Forgets all but the first n chunks; most frequent ones come early."""
        old = self.memo
        self.memo = _Memo()
        self.memo.update(islice(old.items(), n))
        at, self.n = self.at[:n], self.n[:n]
        self.flat = self.flat[np.repeat(at - (np.cumsum(self.n) - self.n), self.n) + np.arange(int(self.n.sum()))]
        self.at = np.cumsum(self.n) - self.n

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words of letters, and how many each has: many are encoded at once, and told apart by the ids at their bounds."""
        ids_of, n_of = [], []
        for a in range(0, len(words), 65_536):
            joined = ["\n".join(words[k : k + 512]) for k in range(a, min(a + 65_536, len(words)), 512)]
            joined = [x.replace(" ", _LETTER_OF[32]) if x.isascii() else x.translate(_WORD_BYTES) for x in joined]
            for k, e in enumerate(self.plain.encode_batch_fast(joined, add_special_tokens=False)):
                group, ids = words[a + 512 * k : a + 512 * (k + 1)], np.array(e.ids, np.uint32)
                at = np.flatnonzero(self.bound[ids])
                n = np.diff(at, prepend=-1) if self.lower else np.diff(at, append=len(ids))
                if len(n) != len(group):
                    one_by_one = [x.ids for x in self.tok.encode_batch_fast(group, add_special_tokens=False)]
                    ids, n = np.array([i for x in one_by_one for i in x], np.uint32), np.array(list(map(len, one_by_one)))
                ids_of.append(ids)
                n_of.append(n)
        return np.concatenate([np.empty(0, np.uint32), *ids_of]), np.concatenate([np.empty(0, np.int64), *n_of])

    def _learn(self) -> None:
        """Ids of the new chunks."""
        new, self.memo.new = self.memo.new, []
        if not new:
            return
        kind = [self.simple.fullmatch(c) is not None for c in new] if self.chunks else [False] * len(new)
        some = np.array([k for k, x in enumerate(kind) if x], np.int64)
        plain = np.array([new[k].isascii() for k in some.tolist()], bool)
        some = np.concatenate([some[plain], some[~plain]]) if len(some) else some  # words of plain letters stand together
        others = np.array([k for k, x in enumerate(kind) if not x], np.int64)
        ids, n_some = self._ids([new[k] for k in some.tolist()])
        rest = [e.ids for e in self.tok.encode_batch_fast([new[k] for k in others.tolist()], add_special_tokens=False)]
        n_rest = np.fromiter(map(len, rest), np.int64, len(rest))
        n, at = np.empty(len(new), np.int64), np.empty(len(new), np.int64)
        n[some], n[others] = n_some, n_rest
        at[some], at[others] = len(self.flat) + np.cumsum(n_some) - n_some, len(self.flat) + len(ids) + np.cumsum(n_rest) - n_rest
        self.at, self.n, self.flat = np.concatenate([self.at, at]), np.concatenate([self.n, n]), np.concatenate([self.flat, ids, np.array([i for x in rest for i in x], np.uint32)])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.memo) > self.keep:
            self._shrink(self.keep // 5)
        get, find, index, ends = self.memo.__getitem__, self.chunks.findall if self.chunks else None, [], []
        for t in texts:
            if t:
                if find is None or ODD.search(t):
                    index.append(get(t))
                else:
                    index.extend(map(get, find(t.lower() if self.lower and not NOT_PLAIN.search(t) else t)))
            index.append(0)
            ends.append(len(index))
        self._learn()
        index = np.array(index, np.int64)
        n = self.n[index]
        after = np.cumsum(n)
        ids = self.flat[np.repeat(self.at[index] - (after - n), n) + np.arange(after[-1] if len(after) else 0)]
        return ids, np.concatenate([[0], after[np.array(ends, np.int64) - 1]]) if ends else np.zeros(1, np.int64)


#: Encoders of this process: the next task of a worker goes on with what the last one learned.
_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(tokenizer: str, end_id: int) -> Encoder:
    """For a known file its chunks; any other file encodes each text whole. One for each process."""
    if (tokenizer, end_id) not in _ENCODERS:
        chunks, lower = CHUNKS.get(os.path.basename(tokenizer), (None, False))
        _ENCODERS[tokenizer, end_id] = Encoder(tokenizer, chunks, end_id, lower)
    return _ENCODERS[tokenizer, end_id]
