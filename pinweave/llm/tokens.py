"""Exact, memoised encoding of many texts with the tokenizers library.

A pre-tokeniser never joins characters over a blank that stands between two
visible characters, so a text may be cut there: the library's ids of the cuts,
put together, are its ids of the text. Cuts repeat far more often than texts.
Arrow splits a block of texts and numbers its distinct cuts; each of these is
looked up once, and only what the memo doesn't know goes to the library.
Texts with any other white space go to the library whole.

Null and empty texts have no ids. Nothing is cut by length.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pinweave.llm.tables import give_back

#: Longer pieces are not kept in the memo, as they hardly repeat.
LONGEST_KEPT = 32
#: Longer runs of marks are not kept.
LONGEST_MARK = 4
#: Pieces in one of the memo's two generations.
GENERATION = 150_000
#: Pieces that the memo keeps from one task to the next, some 8 MB.
KEPT = 40_000
#: Bytes of text that are split at once; a longer text makes a block of its own.
BLOCK_BYTES = 16 << 20
#: Pieces whose ids are put in place at once.
STRETCH = 1 << 18

#: One pre-token under every vocabulary here: normal form and lower case change each letter alone.
_PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Marks behind a letter, which no vocabulary here joins to letters; none of them is part of a special string.
_MARKS = ".,;:!?#*$%&"
#: A plain word, and marks behind it, for Arrow.
_LETTERS = "".join(map(chr, (*range(65, 91), *range(97, 123), *range(192, 215), *range(216, 247), *range(248, 256))))
_MARKED = rf"\A[{_LETTERS}]+[{re.escape(_MARKS)}]*\z"


def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet: visible Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = (b for b in range(256) if b not in visible)
    return {b: 256 + i for i, b in enumerate(hidden)}


_BYTE_LETTERS = _byte_letters()
_BYTES = pa.large_binary()
_SPACE = chr(_BYTE_LETTERS[32])
#: The letter of each byte, all of them: a table without gaps is what ``translate`` is fast with.
_LETTER_OF = "".join(chr(_BYTE_LETTERS.get(b, b)) for b in range(256))


def vocabulary_path(name: str) -> str:
    """Where the public vocabulary file ``name`` lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _cuts(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Where each text begins among all pieces, the distinct pieces, and which of them each piece is."""
    # \r marks the first piece of a text: no space stands before it
    mark, end = pa.scalar("\r", pa.large_string()), pa.scalar("", pa.large_string())
    lists = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise(mark, texts, end), "\n", " \n"), " ")
    begins = lists.offsets.to_numpy()
    words = lists.values.slice(begins[0], begins[-1] - begins[0]).dictionary_encode()
    return begins - begins[0], words.dictionary, words.indices.to_numpy(zero_copy_only=False)


class Encoder:
    """Ids of texts under one vocabulary file.

    ``keeps_blanks`` tells whether blanks become part of tokens (byte-level
    vocabularies) or only separate them (word vocabularies).
    """

    def __init__(self, file: str, keeps_blanks: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(file)
        self.tokenize = self.library.model.tokenize
        small = self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16
        self.code = "H" if small else "I"
        self.dtype = np.dtype("<u2" if small else "<u4")
        self.keeps_blanks, self.blank, self.space = keeps_blanks, *((" ", _SPACE) if keeps_blanks else ("", ""))
        self.marks: dict[str, bytes] = {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def blocks(self, texts: pa.Array, most_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, number of ids of each row, all ids) for runs of rows of ``most_bytes``, or of one longer text."""
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            most = (sizes[at - 1] if at else 0) + most_bytes
            to = max(at + 1, int(np.searchsorted(sizes, most, side="right")))
            yield at, *self._block(texts.slice(at, to - at))
            at = to

    def rest(self) -> None:
        """Give most of the memo's memory back at the end of a task; the pieces that were met first are the most frequent ones, and stay."""
        self.young, self.old = dict(islice(self.young.items(), KEPT)), {}
        give_back()

    def _age(self) -> None:
        if len(self.young) > GENERATION:
            self.old, self.young = self.young, {}

    def _block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        begins, pieces, which = _cuts(texts)
        plain = pc.match_substring_regex(pieces, _MARKED).to_numpy(zero_copy_only=False)
        words, marks = (x.dictionary_encode() for x in self._parts(pieces.filter(pa.array(plain))))
        word_ids, mark_ids = pa.array(self._words(words.dictionary.to_pylist()), _BYTES), pa.array(map(self._mark, marks.dictionary.to_pylist()), _BYTES)
        marked = pc.binary_join_element_wise(word_ids.take(words.indices), mark_ids.take(marks.indices), pa.scalar(b"", _BYTES))
        rest, odd = [], np.zeros(len(pieces), bool)
        for nth, (i, x) in enumerate(zip(np.flatnonzero(~plain).tolist(), pieces.filter(pa.array(~plain)).to_pylist(), strict=True)):
            if not nth & 4095:
                self._age()
            if known := self.young.get(x) or self.old.get(x):
                rest.append(known)
            elif (core := x[1:] if x and x[0] in "\r\n" else x).split() == [core]:
                rest.append(self._piece(x))
            else:
                rest.append(b"")
                odd[i] = True
        place = np.argsort(np.argsort(~plain, kind="stable"), kind="stable")
        coded = pa.concat_arrays([marked, pa.array(rest, _BYTES)]).take(pa.array(place))
        self._age()
        width = self.dtype.itemsize
        ends = np.concatenate(([0], np.cumsum(pc.binary_length(coded).to_numpy()[which] // width)))
        ids = np.empty(ends[-1], self.dtype)
        for a in range(0, len(which), STRETCH):
            own = coded.take(pa.array(which[a : a + STRETCH])).buffers()[2]
            at, to = ends[a], ends[min(a + STRETCH, len(which))]
            ids[at:to] = np.frombuffer(own or b"", self.dtype, to - at)
        counts = ends[begins[1:]] - ends[begins[:-1]]
        returns = pc.match_substring(texts, "\r").to_numpy(zero_copy_only=False)
        whole = np.flatnonzero(returns | (np.add.reduceat(odd[which], begins[:-1]) > 0))
        if len(whole):
            runs = np.split(ids, np.cumsum(counts)[:-1])
            for i in whole:
                runs[i] = np.array(self.library.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, self.dtype)
            counts, ids = np.array([len(x) for x in runs], np.int64), np.concatenate(runs)
        return counts, ids

    @staticmethod
    def _parts(pieces: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Plain words, and the marks behind them."""
        return pc.utf8_rtrim(pieces, _MARKS), pc.utf8_ltrim(pieces, _LETTERS)

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of distinct plain words, from the memo where it has them."""
        out = list(map(self.young.get, words))
        for nth, i in enumerate([i for i, known in enumerate(out) if known is None]):
            x = words[i]
            if not nth & 4095:
                self._age()
            out[i] = known = self.old.get(x) or self._plain(x)
            if len(x) <= LONGEST_KEPT:
                self.young[x] = known
        return out

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece, from the memo where it has them."""
        known = self.young.get(piece) or self.old.get(piece) or self._parted(piece)
        if len(piece) <= LONGEST_KEPT and piece[0] != "\r":
            self.young[piece] = known
        return known

    def _parted(self, piece: str) -> bytes:
        """A line end before a word, and marks after a letter, are tokens of their own."""
        if piece[-1] in _MARKS and (word := piece.rstrip(_MARKS)) and word[-1].isalpha():
            return self._piece(word) + self._mark(piece[len(word) :])
        if piece[0] not in "\r\n":
            return self._encoded(piece, self.blank)
        if piece[0] == "\r" or not self.keeps_blanks:
            return self._encoded(piece[1:], "")
        return self._mark("\n") + self._encoded(piece[1:], "")

    def _mark(self, mark: str) -> bytes:
        if not mark:
            return b""
        if (known := self.marks.get(mark)) is None:
            known = self._encoded(mark, "")
            if len(mark) <= LONGEST_MARK:
                self.marks[mark] = known
        return known

    def _encoded(self, word: str, before: str) -> bytes:
        """The library's ids."""
        if _PLAIN.fullmatch(word):
            return self._plain(word, _SPACE if before else "")
        return array(self.code, self.library.encode(before + word, add_special_tokens=False).ids).tobytes()

    def _plain(self, word: str, before: str | None = None) -> bytes:
        """Ids of a plain word, behind a blank where those are kept: it is one pre-token and goes straight to the library's model."""
        if not self.keeps_blanks:
            word = word.lower()
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(_LETTER_OF)
        return array(self.code, [t.id for t in self.tokenize((self.space if before is None else before) + word)]).tobytes()


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(file: str, keeps_blanks: bool) -> Encoder:
    """This process's encoder for a file; the vocabulary stays loaded while the worker lives."""
    key = (file, keeps_blanks)
    if key not in _encoders:
        _encoders[key] = Encoder(file, keeps_blanks)
    return _encoders[key]
