"""Encoding with a tokenizers file, one word at a time, so that a word met before costs a lookup.

A text is cut at single spaces between other characters. Both public pre-tokenisers split there, whatever
stands on either side, so the ids of the whole text are those of its words in turn.
"""

from __future__ import annotations

import json
import os
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute
import regex

#: A cut that holds beside runs of white space too.
_CUT = regex.compile(r"(?<=\S) (?=\S)")
#: Beyond Latin letters the library itself normalises and splits, as its Unicode tables may be of another version.
_BEYOND_LATIN = regex.compile(r"[^\u0000-ɏ]")
#: Four bytes, least first, on the machines Spark runs on.
_UINT32 = "I"
#: Signs behind a word that both files keep as one piece; an apostrophe begins another only before letters.
_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _byte_characters() -> dict[int, int]:
    """The printable stand-ins for bytes in byte-level vocabularies: printable Latin-1 as is, the rest from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: b for b in plain} | {b: 256 + k for k, b in enumerate(others)}


class WordCodec:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    spaced: a word's piece has its leading space (byte-level files); else white space and case are dropped by the file.
    plain: the file's special tokens in a text are ordinary text; else they are their ids, as the library has it.
    limit: words kept; beyond it the cache starts anew.
    """

    _held: dict[tuple[str, bool, int], WordCodec] = {}

    def __init__(self, path: str, plain: bool = False, limit: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = plain
        self.model = self.library.model
        spec = json.load(open(path, encoding="utf-8"))
        steps = spec["pre_tokenizer"].get("pretokenizers", [])
        patterns = [s["pattern"]["Regex"] for s in steps if s["type"] == "Split"]
        self.spaced = not patterns
        self.split = regex.compile(patterns[0] if patterns else public_tokenizers.PATTERN).findall
        self.lower = bool(patterns)
        added = [] if plain else [t["content"] for t in spec.get("added_tokens", [])]
        #: Finds texts that may hold an added token; the library takes those whole.
        self.added = regex.compile("|".join(map(regex.escape, added)), regex.IGNORECASE).search if added else None
        #: What such a text holds: the tokens' first characters, which is quicker to see; a letter has two cases.
        self.probes = ["" if t[0].isalpha() else t[0] for t in added]
        self.table = _byte_characters()
        self.limit, self.words, self.pieces = limit, {}, {}

    @classmethod
    def of(cls, path: str, plain: bool = False, limit: int = 1_000_000) -> WordCodec:
        """One for each file and Python worker. A worker that is reused holds its words until it ends."""
        if (path, plain, limit) not in cls._held:
            cls._held[path, plain, limit] = cls(path, plain, limit)
        return cls._held[path, plain, limit]

    def _piece(self, piece: str) -> bytes:
        known = self.pieces.get(piece)
        if known is None:
            shown = piece if piece.isalpha() and piece.isascii() else piece.encode().decode("latin-1").translate(self.table)
            known = array(_UINT32, [t.id for t in self.model.tokenize(shown)]).tobytes()
            if len(piece) <= 48:
                self.pieces[piece] = known
        return known

    def _word(self, word: str) -> bytes:
        """Ids of a word, split as the file says; the file's model merges the pieces."""
        if not word.isascii() and (_BEYOND_LATIN.search(word) or self.lower and not unicodedata.is_normalized("NFC", word)):
            return array(_UINT32, self.library.encode(word, add_special_tokens=False).ids).tobytes()
        if self.lower:
            word = word.lower()
        head = word.rstrip(_SIGNS)
        if head.isalpha() or self.spaced and head[1:].isalpha() and head[0] == " ":
            return self._piece(head) if len(head) == len(word) else self._piece(head) + self._piece(word[len(head) :])
        return b"".join(map(self._piece, self.split(word)))

    def encode(self, text: str) -> bytes:
        if self.added and any(p in text for p in self.probes) and self.added(text):
            return array(_UINT32, self.library.encode(text, add_special_tokens=False).ids).tobytes()
        if self.lower and "Σ" not in text:  # its lower case depends on the letters around it
            text = text.lower()
        words = _CUT.split(text) if "  " in text else text.split(" ")
        head, lead, known = b"", "", self.words
        if self.spaced:  # the first word has no space before it
            head, lead, words = self._word(words[0]), " ", words[1:]
        if len(known) > self.limit:
            known.clear()
        if len(self.pieces) > self.limit:
            self.pieces.clear()
        found, at = list(map(known.get, words)), -1
        for _ in range(found.count(None)):
            at = found.index(None, at + 1)
            word = words[at]
            ids = known.get(word)  # met earlier in this text
            if ids is None:
                ids = self._word(lead + word)
                if len(word) <= 48:
                    known[word] = ids
            found[at] = ids
        return head + b"".join(found)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        return list(map(self.encode, texts))


def text_groups(batches: Iterable[pa.RecordBatch], column: int, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each has about ``most`` bytes of text in a column at most, or one row."""
    for batch in batches:
        sizes = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), dtype=np.int64))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop
