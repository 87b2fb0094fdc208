"""Words of a text as a word-BPE tokenizer file sees them, found in whole arrays of text at once.

The file normalises (NFC, white space to a space, lower case) and then splits into contractions, runs of letters, single
digits and runs of signs. Texts of plain Latin letters are split by array operations on bytes; a text with any other
character, or with a special token in it, is normalised and split by the tokenizer's own parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from flowlab.llm.common import blocks, utf8

_LETTER, _DIGIT, _SIGN, _BLANK = 1, 2, 3, 0
_KIND = np.full(256, _SIGN, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = _BLANK
_KIND[48:58] = _DIGIT
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _LETTER

#: Texts for the array path: ASCII, and the letters from code point 0xC0 to 0x17F but for the multiplication and division
#: signs and capital I with dot, whose lower case is two characters.
_PLAIN = r"^[\x{00}-\x{7F}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{17F}]*$"
_TWO = np.zeros(256, bool)
_TWO[list(b"stmd")] = True


class Splitter:
    """Splits texts for one tokenizer file."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self._special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in printable]
        self.letter_of = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(other)}
        self._byte_of = {c: b for b, c in self.letter_of.items()}

    def _slow(self, text: str) -> list[bytes]:
        """Words of one text; a special token is itself, preceded by a zero byte and a mark."""
        out, at = [], 0
        for m in [*(self._special.finditer(text) if self._special else ()), None]:
            piece = text[at : m.start() if m else len(text)]
            if piece:
                plain = self.tokenizer.normalizer.normalize_str(piece)
                out += [bytes(self._byte_of[c] for c in w) for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(plain)]
            if m:
                out.append(SPECIAL + m.group().encode())
                at = m.end()
        return out

    def words(self, texts: pa.Array, block: int = 1 << 21) -> Iterator[tuple[int, int, pa.Array, np.ndarray]]:
        """(from row, to row, distinct words, word number per word, offsets): blocks of whole rows in order."""
        texts = texts.fill_null("")
        plain = pc.match_substring_regex(texts, _PLAIN)
        for mark in self.special:
            plain = pc.and_not(plain, pc.match_substring(texts, mark))
        plain = plain.to_numpy(zero_copy_only=False)
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        for a, b in blocks(sizes, block):
            part = texts.slice(a, b - a)
            ok = plain[a:b]
            data, offsets = utf8(pc.utf8_lower(pc.if_else(pa.array(ok), part, "") if not ok.all() else part))
            buffer, lengths, at = _split(data, offsets)
            counts = np.diff(at)
            fast = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.py_buffer(buffer)])
            if ok.all():
                coded = fast.dictionary_encode()
                yield a, b, coded.dictionary, coded.indices.to_numpy(), at
                continue
            pieces, starts = [], at
            for k in range(b - a):
                if ok[k]:
                    pieces.append(fast.slice(starts[k], starts[k + 1] - starts[k]))
                else:
                    own = self._slow(part[k].as_py())
                    counts[k] = len(own)
                    pieces.append(pa.array(own, pa.binary()))
            coded = pa.concat_arrays(pieces).dictionary_encode()
            yield a, b, coded.dictionary, coded.indices.to_numpy(), np.concatenate([[0], np.cumsum(counts)])


#: Begins the entry of a special token among words; no word does, a zero byte being a sign that never joins a letter.
SPECIAL = b"\x00s"


def _split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all words, length of each, word offsets per row) of lower-case plain texts."""
    n = len(data)
    if not n:
        return data, np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    kind = _KIND[data]
    start = np.empty(n, bool)
    start[0] = True
    start[1:] = kind[1:] != kind[:-1]
    start |= kind == _DIGIT
    first = offsets[:-1][np.diff(offsets) > 0]
    start[first] = True
    mark = np.flatnonzero((data == 39) & start)  # an apostrophe that begins a run of signs may begin a contraction
    if len(mark):
        edge = np.zeros(n + 4, bool)
        edge[first] = True
        edge[n:] = True
        wide = np.concatenate([data, np.zeros(4, np.uint8)])
        c1, c2 = wide[mark + 1], wide[mark + 2]
        in1 = ~edge[mark + 1]
        in2 = in1 & ~edge[mark + 2]
        two = in1 & _TWO[c1]
        three = in2 & (((c1 == 114) & (c2 == 101)) | ((c1 == 118) & (c2 == 101)) | ((c1 == 108) & (c2 == 108)))
        for at, long in ((mark[two], 2), (mark[three], 3)):
            start[at + 1] = False
            nxt = at + long
            nxt = nxt[nxt < n]
            start[nxt] = True  # the letters that follow are a word of their own
    filled = kind != _BLANK
    begins = np.flatnonzero(start & filled)
    kept = np.cumsum(filled)
    place = kept[begins] - 1
    total = int(kept[-1])
    lengths = np.diff(np.append(place, total))
    return np.ascontiguousarray(data[filled]), lengths, np.searchsorted(begins, offsets)
