"""Token ids of whole texts with a public byte-level BPE of the tokenizers library.

A text is cut where the pre-tokenizer's pattern has a boundary whatever stands around it: before white space that
follows other characters, and between a letter or digit and the punctuation that
ends a word. The pieces are encoded once each and
kept, so that common words cost a look-up. Ids are the same as for the whole text; a text with white space other than
space and line feed, or with the string of a special token, is encoded as a whole.

Empty text: no ids; callers give null texts as empty. Very long texts: pieces keep the work and the memory linear.
"""
from __future__ import annotations

import gc
import os
import re
from array import array
from string import punctuation

_PIECES = re.compile(r"[ \n]*[^ \n]+|[ \n]+$")
#: White space other than space and line feed, and what begins a special token's string.
_ODD = ("\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0", "\u1680", "\u180e", *map(chr, range(0x2000, 0x200B)), "\u2028", "\u2029", "\u202f", "\u205f", "\u3000", "<|")
#: Pieces in a generation: a worker keeps two, and what it looks up in the older one moves to the younger.
KEEP = 360_000
_encoders: dict[str, Encoder] = {}


class _Pieces(dict):
    """Ids of pieces, as bytes, by piece; `lead` stands before each. A piece that is not yet known is encoded."""

    def __init__(self, lead: str, tokenizer) -> None:
        super().__init__()
        self.lead, self.tokenizer, self.model = lead, tokenizer, tokenizer.model
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {**{b: b for b in plain}, **{b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(plain)))}}
        self.shown = "".join(chr(shown[b]) for b in range(256))  # how byte-level vocabularies write bytes
        self.shown_lead = lead.translate(self.shown)
        self.tails: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= KEEP:
            self.older = dict(self)
            self.clear()
        if (found := self.older.get(piece)) is not None:
            pass
        elif piece.isalpha():  # one word for the pre-tokenizer: straight to the merges
            seen = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.shown)
            found = array("I", [t.id for t in self.model.tokenize(self.shown_lead + seen)]).tobytes()
        elif (stem := piece.rstrip(punctuation)) != piece and stem and stem[-1].isalnum():
            tail = piece[len(stem) :]
            if tail not in self.tails:
                self.tails[tail] = self.whole(tail)
            found = self[stem] + self.tails[tail]
        else:
            found = self.whole(self.lead + piece)
        self[piece] = found
        return found


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.first, self.later = _Pieces("", self.tokenizer), _Pieces(" ", self.tokenizer)
        self.feed = self.first.whole("\n")

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if any(map(text.__contains__, _ODD)):
            return self.first.whole(text)
        first = self.first.__getitem__
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[-1:] in (" ", "\n") or text[:1] in (" ", "\n"):
            return b"".join(map(first, _PIECES.findall(text)))
        later, feed, out = self.later.__getitem__, self.feed, []
        for line in text.split("\n"):
            words = line.split(" ")
            out.append(first(words[0]))
            if len(words) > 1:
                del words[0]
                out.extend(map(later, words))
            out.append(feed)
        out.pop()
        return b"".join(out)


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file; it outlives a task."""
    if path not in _encoders:
        gc.set_threshold(100_000, 50, 1000)  # what a worker keeps is free of cycles; walking it all often costs time
        _encoders[path] = Encoder(path)
    return _encoders[path]


def vocabulary(path: str) -> int:
    """One more than the greatest id that the tokenizer of a file gives."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values()) + 1
