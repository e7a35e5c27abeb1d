"""Ids of whole texts by the tokenizers library, with a memo of the parts that recur.

Both kinds of vocabulary used here split a text at white space before any merge, so the ids of a
text are those of its parts in order. Parts are looked up. A new part that is one word of letters
goes to the library's model in the form that its normalizer and pre-tokenizer give it, and so does, where
blanks are kept, each piece of any other part of ASCII; what remains
goes to the library's encode, as do whole texts whose white space makes the parts unsure.

Where blanks are kept, the new parts of many texts go to the library's model in long rows, with letters
between them that no merge takes; they merge as each would alone, and there are fewer calls.
"""

from __future__ import annotations

import array
import json
import os
import re
import sys
import unicodedata

import numpy as np

from .common import claim

#: White space other than blanks and line feeds.
_ASCII_SPACE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
_WIDE_SPACE = "\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(chr(c) for c in range(0x2000, 0x200B))

#: Letters up to here are lowered one by one, whatever their neighbours.
_LATIN = "ɏ"


def _byte_letters() -> list[str]:
    """The letters by which byte-level vocabularies spell bytes: printable Latin-1 itself, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


_SPELL = _byte_letters()
_SPELL_ASCII = dict(enumerate(_SPELL[:128]))

#: How the pre-tokenizer of byte-level vocabularies cuts ASCII without white space but a first blank.
_PIECES = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^A-Za-z0-9 ]+")

#: Parts in a row for the library's model.
_ROW = 200

#: Letters of texts whose new parts are learnt together: few enough to stay near the processor.
_TOGETHER = 250_000

#: Between parts, and between the pieces of one, before rows are spelled.
_BETWEEN, _WITHIN = "\0", "\1"

#: Behind letters these are a part of their own.
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_MARK_BYTES = _MARKS.encode()

#: Pieces of ASCII of up to so many letters are remembered; there are few.
_SHORT = 2


class _Rows:
    """Ids of many parts by the library's model, a row of them at a time, for byte-level vocabularies that do not mark where words end."""

    def __init__(self, path: str, model):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            config = json.load(file)["model"]
        taken = {x for m in config["merges"] for x in (m.split(" ") if isinstance(m, str) else m)}
        plain = config["type"] == "BPE" and not any(config.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        self.usable = plain and all(_SPELL[ord(x)] in config["vocab"] and _SPELL[ord(x)] not in taken for x in _BETWEEN + _WITHIN)
        if self.usable:
            self.tokenizer, self.letters = Tokenizer(model), np.array([ord(x) for x in _SPELL], "<u2")
            self.between, self.within = (config["vocab"][_SPELL[ord(x)]] for x in (_BETWEEN, _WITHIN))

    def __call__(self, parts: list[str], width: int) -> list[bytes]:
        """parts: as they are, their pieces apart by _WITHIN, so that these do not merge with each other."""
        if not parts:
            return []
        raw = np.frombuffer(_BETWEEN.join([*parts, ""]).encode(), np.uint8)
        letters, ends = self.letters[raw], np.flatnonzero(raw == 0)
        text, cuts = letters.tobytes().decode("utf-16-le"), [0, *(ends[_ROW - 1 :: _ROW] + 1).tolist(), len(letters)]
        found = self.tokenizer.encode_batch_fast([text[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True) if a < b], add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, "<u4") for e in found])
        ids = ids[ids != self.within]
        ends = np.flatnonzero(ids == self.between)
        if len(ends) != len(parts):
            raise AssertionError("parts and their ids do not agree")
        raw = ids.astype(f"<u{width}").tobytes()
        return [raw[a:b] for a, b in zip((np.r_[0, ends[:-1] + 1] * width).tolist(), (ends * width).tolist(), strict=True)]


def _spelled(word: str) -> str:
    return word if word.isascii() else "".join([_SPELL[b] for b in word.encode()])


class _Memo(dict):
    """Ids of parts. What is not there is looked for in the memo before this one, then learnt."""

    def __init__(self, learn, old: dict | None = None):
        super().__init__()
        self.learn, self.old = learn, old or {}

    def __missing__(self, part):
        ids = self.old.get(part)
        self[part] = ids = self.learn(part) if ids is None else ids
        return ids

    def turn(self) -> _Memo:
        """A new memo before which lies this one, without the one before it: parts that recur stay, others go."""
        self.old = {}
        return _Memo(self.learn, self)


class Encoder:
    """ids as little-endian bytes, `width` bytes an id. blank: the vocabulary keeps case and blanks, each before its word."""

    def __init__(self, path: str, blank: bool, width: int, memo_size: int = 100_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.blank, self.width, self.memo_size = blank, width, memo_size
        if width == 2 and self.tokenizer.get_vocab_size() > 65536:
            raise ValueError("two bytes hold no id of this vocabulary")
        if sys.byteorder != "little":
            raise ValueError("ids are written as they lie in memory")
        self.kind = {2: "H", 4: "I"}[width]
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.short = _Memo(self._piece)
        self.rows = _Rows(path, self.model) if blank else None
        self._forget()

    def _forget(self) -> None:
        self.first = _Memo(self._unspaced if self.blank else self._word)
        self.spaced = _Memo(self._after_blank)

    def _turn(self) -> None:
        self.first, self.spaced = self.first.turn(), self.spaced.turn()

    def _foresee(self, memo: _Memo, parts: set, form) -> None:
        """Learn the parts that the memo lacks together. form(part): what goes to the model for it, or None; those are learnt one by one when
        they are met, as are letters with marks behind them, once the letters are learnt."""
        old, fresh, letters = memo.old, [], set()
        for part in parts:
            if part not in memo:
                if (ids := old.get(part)) is not None:
                    memo[part] = ids
                elif not part.isalpha() and (base := part.rstrip(_MARKS)) != part and base.isalpha():
                    letters.add(base)
                else:
                    fresh.append(part)
        for part in letters:
            if part not in memo and part not in parts:
                if (ids := old.get(part)) is not None:
                    memo[part] = ids
                else:
                    fresh.append(part)
        forms = list(map(form, fresh))
        if None in forms:
            fresh = [p for p, x in zip(fresh, forms, strict=True) if x is not None]
            forms = [x for x in forms if x is not None]
        memo.update(zip(fresh, self.rows(forms, self.width), strict=True))

    def _spaced_form(self, part: str) -> str | None:
        return " " + part if part.isalpha() else self._cut_form(" " + part)

    def _first_form(self, part: str) -> str | None:
        return part if part.isalpha() else self._cut_form(part)

    def _cut_form(self, part: str) -> str | None:
        if not part.isascii() or not part.isprintable() or any(x in part for x in self.added):
            return None
        return _WITHIN.join(_PIECES.findall(part)) or None

    def _bytes(self, ids) -> bytes:
        return array.array(self.kind, ids).tobytes()

    def _library(self, texts: list[str]) -> list[bytes]:
        return [self._bytes(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain(self, part: str) -> bytes:
        return self._library([part])[0]

    def _after_blank(self, part: str) -> bytes:
        if part.isalpha():
            return array.array(self.kind, [t.id for t in self.model.tokenize(_SPELL[32] + (part if part.isascii() else _spelled(part)))]).tobytes()
        base = part.rstrip(_MARKS)
        if base != part and base.isalpha():
            return self.spaced[base] + self.first[part[len(base) :]]
        return self._cut(" " + part)

    def _unspaced(self, part: str) -> bytes:
        return self._bytes([t.id for t in self.model.tokenize(_spelled(part))]) if part.isalpha() else self._cut(part)

    def _cut(self, part: str) -> bytes:
        """ids of a part with or without its blank, piece by piece where all is ASCII and no added token is in it."""
        if not part.isascii() or part == "\n" or any(x in part for x in self.added):
            return self._plain(part)
        return b"".join([self.short[p] if len(p) <= _SHORT else self._piece(p) for p in _PIECES.findall(part)])

    def _piece(self, piece: str) -> bytes:
        return self._bytes([t.id for t in self.model.tokenize(piece.translate(_SPELL_ASCII))])

    def _word(self, part: bytes) -> bytes:
        if part.isalpha():  # a to z alone, which nothing changes
            return self._bytes([t.id for t in self.model.tokenize(part.decode())])
        word = part.decode()
        if word.isalpha() and max(word) <= _LATIN:
            low = word if word.isascii() else "".join([c.lower() for c in unicodedata.normalize("NFC", word)])
            if low.isalpha():
                return self._bytes([t.id for t in self.model.tokenize(_spelled(low))])
        base = part.rstrip(_MARK_BYTES)
        if base != part and base.decode().isalpha() and "İ" not in word:  # its dot becomes a mark
            return self.first[base] + self.first[part[len(base) :]]
        return self._plain(word)

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.first) + len(self.spaced) > self.memo_size:
            self._turn()
        if not self.blank:
            first = self.first.__getitem__
            return [b"".join(map(first, t.encode().lower().split())) for t in texts]
        out, some, size = [], [], 0
        for t in texts:
            some.append(t)
            size += len(t)
            if size > _TOGETHER:
                out += self._kept(some)
                some, size = [], 0
        return out + self._kept(some)

    def _kept(self, texts: list[str]) -> list[bytes]:
        """ids of texts where blanks are kept."""
        split = [self._split(t) for t in texts]
        if self.rows.usable:
            heads, rest = set(), set()
            for lines in split:
                for line in lines or ():
                    heads.add(line[0])
                    rest.update(line[1:])
            self._foresee(self.spaced, rest, self._spaced_form)
            self._foresee(self.first, heads, self._first_form)
        return [self._plain(t) if lines is None else self._joined(lines) for t, lines in zip(texts, split, strict=True)]

    def words(self, parts: list[bytes]) -> list[bytes]:
        """ids of each part of a text that was cut at ASCII's white space, A to Z lowered; for a vocabulary without blanks."""
        if len(self.first) > self.memo_size:
            self._turn()
        return list(map(self.first.__getitem__, parts))

    def _split(self, text: str) -> list[list[str]] | None:
        """The parts of each line, or None where they are not sure."""
        if not text:
            return []
        if text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
            return None
        if any(c in text for c in _ASCII_SPACE) or not text.isascii() and any(c in text for c in _WIDE_SPACE):
            return None
        return [line.split(" ") for line in text.split("\n")]

    def _joined(self, lines: list[list[str]]) -> bytes:
        first, spaced = self.first, self.spaced.__getitem__
        return first["\n"].join([first[head] + b"".join(map(spaced, rest)) for head, *rest in lines]) if lines else b""


_ENCODERS: dict = {}


def encoder(path: str, blank: bool, width: int) -> Encoder:
    """One encoder a worker process and vocabulary; it goes when another memo is in use."""
    key = (path, blank, width)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    found = _ENCODERS[key]

    def drop() -> None:
        _ENCODERS.pop(key, None)
        found._forget()

    claim(found, drop)
    return found


def batches(it, rows: int = 2000, chars: int = 4 << 20):
    """Arrow batches cut into lists of at most so many rows and, but for a single text, so many characters: (batch, first, last, texts)."""
    for batch in it:
        texts = batch.column("text")
        first, size, held = 0, 0, []
        for i in range(batch.num_rows):
            t = texts[i].as_py() or ""
            if held and (len(held) >= rows or size + len(t) > chars):
                yield batch, first, i, held
                first, size, held = i, 0, []
            held.append(t)
            size += len(t)
        if held:
            yield batch, first, batch.num_rows, held
