"""Ids of texts under a lower-casing tokenizer with word ends, with words that recur encoded once.

Such a tokenizer drops white space and never merges over it, so the ids of a text are those of its words one after
another. A word of ASCII and Latin-1 letters, digits and ASCII signs is cut into letters, single digits and signs here,
and only pieces not met before go to the library's merges, many at once: each piece's last id is one with the mark of a word
end. All other words, and those with a special string, are encoded by the whole tokenizer.
"""

from __future__ import annotations

import re

import numpy as np

from columnscope.llm.storage import per_worker

# A worker process keeps the ids of so many words at most, none longer than so many bytes.
_MOST_WORDS, _LONG_WORD = 500_000, 100
_END = "</w>"
# ASCII from ! to ~ and U+00C0 to U+00FF but for the two signs among them, as bytes of UTF-8
_PLAIN = re.compile(rb"(?:[!-~]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
_PIECES = re.compile("\n|'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\na-z0-9ß-öø-ÿ]+")
_BREAK = b"\xff" * 4


class WordEncoder:
    """Ids of whole texts, little-endian of four bytes each, exactly as the tokenizers library gives them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        # the same merges over pieces that are cut already
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        ])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(_END)]] = True
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.long: list[str] = []

    @staticmethod
    def of(path: str) -> WordEncoder:
        return per_worker("word encoder", path, lambda: WordEncoder(path))

    def _whole(self, words: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _merged(self, pieces: list[str]) -> None:
        for at in range(0, len(pieces), 4096):
            part = pieces[at:at + 4096]
            ids = np.array(self.merges.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(part):
                raise ValueError("the tokenizer does not mark the ends of words")
            self.long.extend(p for p in part if len(p) > _LONG_WORD)
            data, last = ids.tobytes(), 0
            for piece, cut in zip(part, (4 * cuts).tolist()):
                self.pieces[piece] = data[last:cut]
                last = cut

    def _learn(self, words: list[bytes]) -> list[bytes]:
        """Ids of words without white space."""
        plain = [_PLAIN.fullmatch(w) is not None and not (b"<" in w and any(s in w for s in self.special)) for w in words]
        other = iter(self._whole([w for w, p in zip(words, plain) if not p]) if not all(plain) else ())
        pieces = _PIECES.findall(b"\n".join([w for w, p in zip(words, plain) if p]).decode().lower())
        self._merged(list(set(pieces).difference(self.pieces, "\n")))
        self.pieces["\n"] = _BREAK
        data = b"".join(map(self.pieces.__getitem__, pieces)) + _BREAK
        cuts = (4 * np.flatnonzero(np.frombuffer(data, "<u4") == 0xFFFFFFFF)).tolist()
        starts = iter(zip([0, *(c + 4 for c in cuts)], cuts))
        return [data[slice(*next(starts))] if p else next(other) for p in plain]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each UTF-8 text."""
        split = [t.split() for t in texts]
        if len(self.words) > _MOST_WORDS:
            self.words.clear()
        if len(self.pieces) > _MOST_WORDS:
            self.pieces.clear()
        new = list(set().union(*split).difference(self.words))
        self.words.update(zip(new, self._learn(new)))
        found = [b"".join(map(self.words.__getitem__, s)) for s in split]
        for w in [w for w in new if len(w) > _LONG_WORD]:
            del self.words[w]
        while self.long:
            del self.pieces[self.long.pop()]
        return found
