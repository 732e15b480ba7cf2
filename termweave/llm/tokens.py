"""Texts to ids of a public tokenizer, fast over many texts: each distinct word is encoded once per worker."""

from __future__ import annotations

import hashlib
import os
import re
from functools import lru_cache

import numpy as np

from ._words import prefix_sums, span_hashes, word_spans

#: Words whose ids a worker remembers, and their parts, before it forgets them all.
MEMO_WORDS, MEMO_PIECES = 3_000_000, 500_000
#: Bytes from which on a word's hash is a cryptographic one.
LONG_WORD = 256
#: Words of letters, then punctuation: one pre-token for each part. No apostrophes (contractions) and no < > (special tokens).
_PLAIN = re.compile(r"([^\W\d_]*)([!\"#$%&()*+,\-./:;=?@\[\\\]^`{|}~]*)")


#: Below it, Python's and the library's lower case agree letter by letter.
_LATIN_END = "\u0250"


class Encoder:
    """Ids of whole texts as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them.

    Exact for vocabularies that drop white space and mark word ends with ``</w>``: no pre-token reaches over white
    space there, so the ids of a text are those of its words in a row. Letters and punctuation of a word are encoded by
    the library, many at a time, and told apart by their word ends; where the ends don't fit, one at a time.
    """

    def __init__(self, vocabulary: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.pieces: dict[str, bytes] = {}
        self.pool = np.empty(1 << 16, np.uint32)
        self.used = 0
        # hashes of known words, sorted, with where each one's ids lie in the pool
        self.known = np.empty(0, np.uint64)
        self.start = np.empty(0, np.int64)
        self.length = np.empty(0, np.int64)

    def _keep(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Puts the ids of words in a row into the pool; where each word's ids start."""
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        start = self.used + np.cumsum(counts) - counts
        self.used += len(ids)
        return start

    def _learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of new words start in the pool, and how many there are."""
        plain: list[int] = []
        parts: list[str] = []
        halves: list[int] = []
        odd: list[int] = []
        for i, word in enumerate(words):
            text = word.decode("utf-8", "replace")
            # the lower case of U+0130 has two code points, one of them no letter
            if "\u0130" not in text and (m := _PLAIN.fullmatch(text)):
                plain.append(i)
                letters, marks = m.groups()
                if letters:
                    parts.append(letters.lower() if max(letters) < _LATIN_END else letters)
                if marks:
                    parts.append(marks)
                halves.append(bool(letters) + bool(marks))
            else:
                odd.append(i)
        fresh = list(dict.fromkeys(p for p in parts if p not in self.pieces))
        for i in range(0, len(fresh), 4096):
            self._learn_pieces(fresh[i : i + 4096])
        start, length = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        if plain:
            got = [self.pieces[p] for p in parts]
            sizes = np.fromiter(map(len, got), np.int64, len(got)) // 4
            length[plain] = np.add.reduceat(sizes, np.cumsum(halves) - halves)
            start[plain] = self._keep(np.frombuffer(b"".join(got), np.uint32), length[plain])
        for i in range(0, len(odd), 4096):
            part = odd[i : i + 4096]
            got = [e.ids for e in self.tokenizer.encode_batch_fast([words[w].decode("utf-8", "replace") for w in part], add_special_tokens=False)]
            length[part] = [len(ids) for ids in got]
            start[part] = self._keep(np.array([x for ids in got for x in ids], np.uint32), length[part])
        return start, length

    def _learn_pieces(self, pieces: list[str]) -> None:
        ids = np.array(self.tokenizer.encode(" ".join(pieces), add_special_tokens=False).ids, np.uint32)
        at = np.flatnonzero(self.ends[ids]) + 1
        if len(at) == len(pieces) and at[-1] == len(ids):
            raw = ids.tobytes()
            self.pieces.update(zip(pieces, (raw[4 * a : 4 * b] for a, b in zip([0, *at[:-1].tolist()], at.tolist(), strict=True)), strict=True))
        else:
            for piece in pieces:
                self.pieces[piece] = np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, np.uint32).tobytes()

    def __call__(self, texts: list[bytes], end: int | None = 1) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts in a row, and how many each has; ``end`` follows each.

        Words are told apart by 64-bit hashes of their bytes.
        """
        if len(self.known) > MEMO_WORDS:
            self._forget()
        if len(self.pieces) > MEMO_PIECES:
            self.pieces = {}
        buf, first, last, counts = word_spans(texts)
        hashes = span_hashes(prefix_sums(buf), first, last)
        for i in np.flatnonzero(last - first > LONG_WORD).tolist():  # polynomial hashes of long words can be made to meet
            hashes[i] = int.from_bytes(hashlib.blake2b(buf[first[i] : last[i]].tobytes(), digest_size=8).digest(), "little")
        order = np.argsort(hashes, kind="stable")
        edge = np.ones(len(order), bool)
        np.not_equal(hashes[order[1:]], hashes[order[:-1]], out=edge[1:])
        own = hashes[order[edge]]
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(edge) - 1
        place = np.searchsorted(self.known, own)
        new = np.ones(len(own), bool)
        inside = place < len(self.known)
        new[inside] = self.known[place[inside]] != own[inside]
        if new.any():
            start, size = self._learn([buf[first[i] : last[i]].tobytes() for i in order[edge][new].tolist()])
            self.known, self.start, self.length = (np.insert(x, place[new], y) for x, y in ((self.known, own[new]), (self.start, start), (self.length, size)))
            place = np.searchsorted(self.known, own)
        at = place[which]
        length = self.length[at]
        offset = np.zeros(len(at) + 1, np.int64)
        np.cumsum(length, out=offset[1:])
        ids = self.pool[np.repeat(self.start[at] - offset[:-1], length) + np.arange(offset[-1])]
        bounds = np.zeros(len(counts) + 1, np.int64)
        np.cumsum(counts, out=bounds[1:])
        sizes = np.diff(offset[bounds])
        if end is None:
            return ids, sizes
        sizes = sizes + 1
        out = np.empty(len(ids) + len(sizes), np.uint32)
        last = np.cumsum(sizes) - 1
        inner = np.ones(len(out), bool)
        inner[last] = False
        out[inner] = ids
        out[last] = end
        return out, sizes


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> Encoder:
    """One encoder for each worker and vocabulary file."""
    return Encoder(vocabulary)


def default_vocabulary() -> str:
    """The installed public vocabulary of this library's queries."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
