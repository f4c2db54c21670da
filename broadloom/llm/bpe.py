"""Byte-level BPE ids of whole texts, each distinct piece between single blanks of a batch encoded once.

The merges never cross a single blank between two non-blanks: the blank opens the next piece. So texts whose blanks
(U+0020) all stand alone are cut there, and the distinct pieces of a batch are encoded in one call; token lengths tell
where each piece ends. Texts with any other use of white space, or with a special token's string, go to the tokenizer whole.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The pre-tokenisation pattern of this family of vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space other than the blank and the line feed, in UTF-8.
OTHER_SPACE = re.compile(rb"[\t\x0b\x0c\r\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
RARE_BYTES = b"\t\x0b\x0c\r\x1c\x1d\x1e\x1f\xe1\xe2\xe3"


def _byte_of_symbol() -> dict[str, int]:
    """Vocabulary files write each byte as one printable character: itself, or the next free one from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Ids below 65536 of texts in UTF-8."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.whole = Tokenizer.from_file(path)
        special = {t["content"] for t in spec.get("added_tokens") or []}
        symbol = _byte_of_symbol()
        ranks = {bytes(symbol[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        if max(ranks.values()) > 0xFFFF or max([0, *(t["id"] for t in spec.get("added_tokens") or [])]) > 0xFFFF:
            raise ValueError("ids above 65535 do not fit")
        self.special = [t.encode() for t in special]
        self.fast = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.width = np.zeros(1 << 16, np.int64)  # bytes of each token
        self.width[list(ranks.values())] = [len(token) for token in ranks]

    def _single_blanks(self, text: bytes) -> bool:
        return not (b"  " in text or b" \n" in text or b"\n " in text or text[:1] == b" " or text[-1:] == b" " or b"\xc2\x85" in text
                    or b"\xc2\xa0" in text or (len(text.translate(None, RARE_BYTES)) < len(text) and OTHER_SPACE.search(text))
                    or any(s in text for s in self.special))

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, each with a blank before it, one after the other, and how many each has."""
        if not len(pieces):
            return np.zeros(0, np.uint16), np.zeros(0, np.int64)
        opened = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), pieces, pa.scalar("", pa.large_string()))
        _, ends, text = opened.buffers()
        ends = np.frombuffer(ends, np.int64)[opened.offset + 1:opened.offset + len(opened) + 1]
        ids = np.array(self.fast.encode_ordinary(str(memoryview(text)[:ends[-1]], "utf-8")), np.uint16)
        last = np.searchsorted(reached := np.cumsum(self.width[ids]), ends)
        if not np.array_equal(reached[last], ends):
            raise ValueError("a token crosses a blank: the vocabulary is not of this family")
        return ids, np.diff(last + 1, prepend=0)

    def encode(self, texts: list[bytes | None], end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, each followed by ``end``, and where in them each text stops."""
        if not texts:
            return np.zeros(0, np.uint16), np.zeros(0, np.int64)
        plain = [t.decode("utf-8", "replace") if t and self._single_blanks(t) else "" for t in texts]
        cut = pc.split_pattern(pa.array(plain, pa.large_string()), " ")
        pieces, start = cut.flatten(), np.asarray(cut.offsets)[:-1]
        blank_before = np.ones(len(pieces), bool)
        blank_before[start] = False
        coded = pieces.filter(pa.array(blank_before)).dictionary_encode()
        entries, count = self._pieces(coded.dictionary)
        # A text's first piece has no blank before it: an entry of its own, as is a text that is not cut.
        alone = [self.fast.encode_ordinary(p.split(" ", 1)[0]) if p or not t else
                 self.whole.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids for p, t in zip(plain, texts)]
        at = np.empty(len(pieces), np.int64)
        at[blank_before] = coded.indices
        at[start] = len(count) + np.arange(len(texts))
        after = np.append(start[1:], len(at))
        at = np.insert(at, after, len(count) + len(texts))
        entries = np.concatenate([entries, *(np.array(a, np.uint16) for a in alone), np.array([end], np.uint16)])
        count = np.concatenate([count, [*map(len, alone), 1]]).astype(np.int64)
        n = count[at]
        stop = np.cumsum(n)
        source = np.repeat((np.cumsum(count) - count)[at] - stop + n, n)
        source += np.arange(len(source))
        return entries[source], stop[after + np.arange(len(texts))]
