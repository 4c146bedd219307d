"""Token ids of whole texts with a public ``tokenizers`` file, an Arrow column at a time.

The tokenizer splits at white space before anything else, so a text's ids are
its words' ids one after the other. Words are split and told apart by Arrow;
only words not met before are encoded. For words of plain Latin letters the
tokenizer's normalisation (lower case; such words are in NFC already) and its
split pattern are applied here and the model is asked for each piece, which
avoids its per-string overhead; any other word goes through the tokenizer as
a whole. Both give the tokenizer's own ids, which the tests compare.
"""

from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# What a worker remembers of words and their pieces, in bytes; beyond it the
# memory is emptied and filled anew, within a column of texts as well.
CACHE_BYTES = 80 << 20
ENTRY = 240  # of an entry besides its letters and ids: two objects and its place in the table
# Bytes of texts whose words are held at a time.
SLICE_BYTES = 6 << 20


def _byte_symbols() -> list[str]:
    """The usual byte-level alphabet: printable Latin-1 bytes stand for
    themselves, the others for the code points from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class WordTokenizer:
    """Ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        assert array("I").itemsize == 4
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import json

        import regex
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        # the split step alone: the whole file, parsed, would stay in the worker's memory
        told = json.loads(self.tok.pre_tokenizer.__getstate__())
        self.pieces = regex.compile(told["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.model = self.tok.model
        self.specials = [a.content for a in self.tok.get_added_tokens_decoder().values()]
        self.symbols = _byte_symbols()
        # Latin letters whose lower case is one letter, digits and ASCII signs
        self.plain = regex.compile("[\\x21-\\x7E\\u00C0-\\u00D6\\u00D8-\\u00F6\\u00F8-\\u012F\\u0131-\\u0148\\u014A-\\u017E]+").fullmatch
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.held = 0  # bytes remembered

    def _part(self, piece: str) -> bytes:
        # printable ASCII stands for itself in the byte-level alphabet
        symbols = piece if piece.isascii() else "".join([self.symbols[b] for b in piece.encode()])
        got = self.parts[piece] = array("I", [t.id for t in self.model.tokenize(symbols)]).tobytes()
        self.held += ENTRY + 4 * len(piece) + len(got)
        return got

    def _new(self, word: str) -> bytes:
        parts = self.parts
        if word.isascii() and word.isalpha():
            low = word.lower()
            got = parts.get(low) or self._part(low)
        elif self.plain(word):
            got = b"".join([parts.get(p) or self._part(p) for p in self.pieces(word.lower())])
        else:
            got = array("I", self.tok.encode(word, add_special_tokens=False).ids).tobytes()
        self.known[word] = got
        self.held += ENTRY + 4 * len(word) + len(got)
        if self.held > CACHE_BYTES:
            # whole words first; pieces are met again more often
            self.known.clear()
            self.held = sum(map(len, self.parts.values())) + ENTRY * len(self.parts)
            if self.held > CACHE_BYTES // 2:
                self.parts.clear()
                self.held = 0
        return got

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): text i has ids[offsets[i]:offsets[i + 1]]; null is empty."""
        size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        if not len(size) or size[-1] <= SLICE_BYTES:
            return self._encoded(texts)
        ids, counts, at = [], [], 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE_BYTES, side="right")))
            some, offsets = self._encoded(texts.slice(at, to - at))
            ids.append(some)
            counts.append(np.diff(offsets))
            at = to
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(counts))])

    def _encoded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = texts.cast(pa.large_string()).fill_null("").take(pa.array(np.arange(len(texts))))  # a copy, not a slice
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        known, new = self.known.get, self._new
        found = [new(w) if (got := known(w)) is None else got for w in coded.dictionary.to_pylist()]
        ids = pa.array(found, pa.large_binary()).take(coded.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1, ids.offset * 8) if len(ids) else np.zeros(1, np.int64)
        data = ids.buffers()[2] if len(ids) else None
        flat = np.frombuffer(data, "<u4") if data is not None and data.size else np.zeros(0, "<u4")
        flat = flat[ends[0] // 4:ends[-1] // 4]
        offsets = (ends[words.offsets.to_numpy() - words.offsets[0].as_py()] - ends[0]) // 4 if len(texts) else np.zeros(1, np.int64)
        special = pc.any(pc.match_substring_regex(texts, "|".join(map(_quoted, self.specials)))).as_py() if self.specials else False
        if not special:
            return flat, offsets
        # special tokens are taken out of a text before it is split into words
        parts = [np.array(self.tok.encode(t, add_special_tokens=False).ids, "<u4") if any(s in t for s in self.specials)
                 else flat[offsets[i]:offsets[i + 1]] for i, t in enumerate(texts.to_pylist())]
        return np.concatenate(parts), np.cumsum([0, *map(len, parts)])


def _quoted(s: str) -> str:
    return "".join("\\" + c if not c.isalnum() else c for c in s)


_open: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One per worker process; the file is read on the executor from ``path``."""
    if path not in _open:
        _open[path] = WordTokenizer(path)
    return _open[path]


def public_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)
