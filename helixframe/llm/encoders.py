"""Encoders of two public vocabularies, equal to the tokenizers library and several times faster.

Both let tiktoken do the merges. Texts that hold a special token, or characters whose class differs
between Unicode versions (so that two pattern engines may cut them differently), take the library's own path.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import regex

from helixframe.llm.common import held

#: The patterns that split text before the merges (fixed values of the vocabularies).
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WORD_END_PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+""")
#: What marks the end of a word in a name of the vocabulary, and in the text that tiktoken sees; and what stands between two texts.
WORD_END, MARK, GAP = "</w>", "\x01", "\x02"


def _byte_of_symbol() -> dict[str, int]:
    """The printable symbols that stand for bytes in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out, extra = {chr(b): b for b in plain}, 0
    for b in range(256):
        if b not in plain:
            out[chr(256 + extra)] = b
            extra += 1
    return out


def _is_firm(char: str) -> bool:
    """Whether all Unicode versions since 3.2 take a character for the same: letter, number, space or other."""
    old, new = unicodedata.ucd_3_2_0.category(char), unicodedata.category(char)
    kind = lambda c: c[0] if c[0] in "LNZ" else ""
    return new != "Cn" and kind(old) == kind(new)


class _Firm:
    """Remembers which characters are firm; there are few in a corpus."""

    def __init__(self, odd: str = ""):
        self.firm, self.odd = set(map(chr, range(128))) - set(odd), set(odd)

    def holds(self, text: str) -> bool:
        new = set(text) - self.firm
        if not new:
            return True
        if new & self.odd:
            return False
        for c in new:
            (self.firm if _is_firm(c) else self.odd).add(c)
        return not new & self.odd


class ByteEncoder:
    """Byte-level BPE ids of texts."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols = _byte_of_symbol()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(symbols[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.inner = tiktoken.Encoding("bytes", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special, self.firm = tuple(special), _Firm()
        self.token_bytes = np.zeros(max([*ranks.values(), *special.values()]) + 1, np.int64)
        for token, i in ranks.items():
            self.token_bytes[i] = len(token)
        for token, i in special.items():
            self.token_bytes[i] = len(token.encode())

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text, as little-endian unsigned 32-bit integers."""
        if any(s in text for s in self.special) or not self.firm.holds(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(self.inner.encode_ordinary(text), "<u4")


class WordEndEncoder:
    """Ids of a BPE vocabulary that marks word ends and drops white space, and the names that decoding joins.

    A byte of its own marks the ends of words for tiktoken, and one letter with a mark ranks before every merge. As
    each name of the vocabulary is what the merges below it make of its own letters (a test checks all),
    merging by ranks gives what merging by the list of pairs does.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = tuple(t["content"] for t in spec["added_tokens"])
        names = self.library.get_vocab(with_added_tokens=True)
        self.token = [b""] * (max(names.values()) + 1)
        self.is_end = np.zeros(len(self.token), bool)
        for name, i in names.items():
            self.token[i] = name.encode()
            self.is_end[i] = name.endswith(WORD_END)
        symbols = _byte_of_symbol()
        ranks, ids = {bytes([b]): b for b in range(256)}, []
        for name, i in sorted(spec["model"]["vocab"].items(), key=lambda x: x[1]):
            if name not in self.special:
                stem = name.removesuffix(WORD_END)
                token = bytes(symbols[c] for c in stem) + MARK.encode() * (stem != name)
                ids.append((ranks.setdefault(token, len(ranks)), i))
        self.ids = np.zeros(len(ranks), "<u4")
        for rank, i in ids:
            self.ids[rank] = i
        self.inner = tiktoken.Encoding("words", pat_str=f"[^{MARK}]+{MARK}", mergeable_ranks=ranks, special_tokens={})
        # Control characters that two engines may or may not take for white space, and the marks, are left to the library.
        self.firm = _Firm("".join(map(chr, [*range(9), *range(14, 32), 127])))

    def plain(self, text: str) -> bool:
        """Whether a text may be cut at spaces and encoded in parts: no special token, and only firm characters."""
        return not any(s in text for s in self.special) and self.firm.holds(text)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of plain texts, in one call for all."""
        if not texts:
            return []
        words = [WORD_END_PATTERN.findall(t) for t in self.library.normalizer.normalize_str(GAP.join(texts)).split(GAP)]
        flat = MARK.join([MARK.join(w) for w in words if w])
        ids = self.ids[np.array(self.inner.encode_ordinary(flat + MARK) if flat else [], np.int64)]
        ends = np.concatenate([[0], np.flatnonzero(self.is_end[ids]) + 1])
        cuts = ends[np.cumsum([0, *map(len, words)])].tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def words(self, text: str) -> int:
        """How many words a plain text has for the vocabulary."""
        return len(WORD_END_PATTERN.findall(self.library.normalizer.normalize_str(text)))

    def decoded(self, ids: np.ndarray) -> bytes:
        """What decoding gives: the names with one space between two."""
        token = self.token
        return b" ".join([token[i] for i in ids.tolist()])


def byte_encoder(path: str) -> ByteEncoder:
    return held(("bytes", path), lambda: ByteEncoder(path))


def word_end_encoder(path: str) -> WordEndEncoder:
    return held(("words", path), lambda: WordEndEncoder(path))
