"""Token ids of whole texts, with each word, and each part of a word, merged once.

The vocabulary ``word_bpe`` drops white space, lowers letters and cuts a text into letter runs, single digits, runs of
marks and a few endings behind an apostrophe; no token reaches across such a part. So a text has the ids of its
words one after the other, and a word those of its parts. The texts of a batch are cut into words together, each
different word is looked at once, and its letters and what follows them are looked up. A worker remembers ``REMEMBERED`` of these
parts, of ``LONGEST`` characters at most; when they are full the older half goes.

The cut is made here for the characters below U+0250 that are letters, digits, marks or plain white space
and that neither composition nor lowering turns into something longer. A word with any other character, or with
what may be a special token, is handed to the tokenizer as it is.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from itertools import islice
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

REMEMBERED = 200_000
LONGEST = 64
STRETCH = 8 << 20  # bytes of text that are cut together
FIRST_ODD = 0x250
APART = b"\xff" * 4  # no id

_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Fixed: how byte-level vocabularies show bytes; those that cannot be printed are shown from 256 on.
AS_SHOWN = {b: chr(b) for b in _PLAIN} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_PLAIN)))}
#: Fixed: the endings that this vocabulary keeps together with their apostrophe.
ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"


def _kinds() -> dict[str, list[str]]:
    """Characters by the first letter of their category: letters (small ones), numbers, marks; and ``known``, all that is cut here."""
    kinds: dict[str, list[str]] = {"L": [], "N": [], "mark": [], "known": [" "]}
    for char in map(chr, range(33, FIRST_ODD)):
        low, kind = char.lower(), unicodedata.category(char)[0]
        if len(low) > 1 or ord(low) >= FIRST_ODD or kind in "CZ" or unicodedata.normalize("NFC", char) != char:
            continue
        kinds["known"].append(char)
        if low == char:
            kinds[kind if kind in "LN" else "mark"].append(char)
    return kinds


def _one_of(chars: list[str]) -> str:
    return "".join(map(re.escape, chars))


_KINDS = _kinds()
PART = re.compile(f" |{ENDINGS}|[{_one_of(_KINDS['L'])}]+|[{_one_of(_KINDS['N'])}]|[{_one_of(_KINDS['mark'])}]+")
ODD = re.compile(rf"[^{_one_of(_KINDS['known'])}]|<\|")


LETTERS = "".join(_KINDS["L"])
OTHERS = "".join([*_KINDS["N"], *_KINDS["mark"]])


class TokenIds:
    """Ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.bytes_of = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.known: dict[str, bytes] = {}  # parts, and small words of several parts

    def of(self, text: str) -> bytes:
        return next(self.of_all(pa.array([text])))

    def of_all(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text; null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        pool = pa.default_memory_pool()
        while at < len(texts):
            pool.release_unused()  # what one stretch took is not kept for the next
            stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STRETCH, side="right"))
            if stop > at:
                yield from self._of_rows(texts.slice(at, stop - at))
                at = stop
            else:  # up to a blank, so that the words of a very long text are not all held at once
                yield b"".join([ids for part in _stretches(texts[at].as_py()) for ids in self._of_rows(part)])
                at += 1

    def _of_rows(self, texts: pa.Array) -> list[bytes]:
        rows = pc.ascii_split_whitespace(texts)
        words = rows.flatten().dictionary_encode()
        if not len(words):
            return [b""] * len(texts)
        found = self._of_words(words.dictionary).take(words.indices)
        places = np.frombuffer(found.buffers()[1], np.int64, len(found) + 1, 8 * found.offset)
        starts = rows.offsets.to_numpy()
        bounds = places[starts - starts[0]].tolist()
        data = memoryview(found.buffers()[2] or b"")
        return [data[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]

    def _of_words(self, words: pa.StringArray) -> pa.Array:
        """The ids of different words."""
        odd: dict[int, str] = {}
        ends = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, 4 * words.offset)
        if ODD.search(words.buffers()[2][ends[0] : ends[-1]].to_pybytes().decode()) is not None:
            odd = {i: w for i, w in enumerate(words.to_pylist()) if ODD.search(w) is not None}
            clean = np.ones(len(words), bool)
            clean[list(odd)] = False
            words = pc.if_else(pa.array(clean), words, "")
        low = pc.utf8_lower(words)
        # letters and then other characters: cut where these begin
        front, back = pc.utf8_rtrim(low, OTHERS), pc.utf8_ltrim(low, LETTERS)
        plain = pc.equal(pc.add(pc.binary_length(front), pc.binary_length(back)), pc.binary_length(low))
        found = [self._of_parts(pc.if_else(plain, part, "").dictionary_encode(), cut) for part, cut in ((front, False), (back, True))]
        joined = pc.binary_join_element_wise(*found, pa.scalar(b"", pa.large_binary()))
        own = ~plain.to_numpy(zero_copy_only=False)
        mixed = np.flatnonzero(own)
        ids = dict(zip(mixed.tolist(), self._look_up(low.take(pa.array(mixed)).to_pylist(), True)))
        for i, word in odd.items():
            ids[i] = b"".join([self.bytes_of[t] for t in self.tokenizer.encode(word, add_special_tokens=False).ids])
        own[list(odd)] = True
        return pc.replace_with_mask(joined, pa.array(own), pa.array([ids[i] for i in sorted(ids)], pa.large_binary()))

    def _of_parts(self, parts: pa.DictionaryArray, cut: bool) -> pa.Array:
        return pa.array(self._look_up(parts.dictionary.to_pylist(), cut), pa.large_binary()).take(parts.indices)

    def _look_up(self, strings: list[str], cut: bool) -> list[bytes]:
        """Ids of different strings; if they need not be ``cut``, each is a run of letters, or empty."""
        found = list(map(self.known.get, strings))
        if None not in found:
            return found
        gaps = [i for i, f in enumerate(found) if f is None]
        new = [strings[i] for i in gaps]
        learnt = self._cut(new) if cut else self._merged(new)
        for i, ids in zip(gaps, learnt):
            found[i] = ids
        short = dict(islice(((s, i) for s, i in zip(new, learnt) if len(s) <= LONGEST), REMEMBERED // 2))
        if len(self.known) + len(short) > REMEMBERED:
            for old in list(islice(self.known, REMEMBERED // 2)):
                del self.known[old]
        self.known.update(short)
        return found

    def _merged(self, parts: list[str]) -> list[bytes]:
        if not parts:
            return []
        # the byte of a blank is shown as some other character, which no part holds
        shown = " ".join(parts).encode().decode("latin-1").translate(AS_SHOWN).split(AS_SHOWN[ord(" ")])
        merge, bytes_of = self.merge, self.bytes_of
        return [b"".join([bytes_of[t.id] for t in merge(s)]) if s else b"" for s in shown]

    def _cut(self, words: list[str]) -> list[bytes]:
        """Ids of small words of several parts."""
        parts = PART.findall(" ".join(words))
        different = [p for p in dict.fromkeys(parts) if p != " "]
        ids = dict(zip(different, self._merged(different))) | {" ": APART}
        return b"".join(map(ids.__getitem__, parts)).split(APART)


def _stretches(text: str) -> Iterator[pa.Array]:
    at = 0
    while at < len(text):
        end = text.find(" ", at + STRETCH)
        end = len(text) if end < 0 else end
        yield pa.array([text[at:end]], pa.string())
        at = end


def token_ids(path: str) -> TokenIds:
    """One for all tasks of a worker process: words seen in one partition come again in the next."""
    kept = sys.modules.setdefault("lotbook_token_ids", ModuleType("lotbook_token_ids"))
    if path not in vars(kept):
        vars(kept)[path] = TokenIds(path)
    return vars(kept)[path]
