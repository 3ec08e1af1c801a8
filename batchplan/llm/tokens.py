"""Exact token ids of whole texts from cached white-space units.

Encoding a text with a BPE vocabulary is dominated by merging, and most units of a text were merged
before. A unit is a stretch of text whose tokens cannot depend on what stands beside it: for a
vocabulary that drops white space, what stands between white space; for a byte-level one, a non-space
run with the white space before it. Each worker keeps a bounded table of the units it has met and merges only new
ones; texts that this reasoning does not cover (special strings, unusual separators) go to the library whole.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array

import numpy as np

from batchplan.llm.spark_io import handed_on

#: Below this code point letters, numbers, case and composed forms are the same in every Unicode version.
_LATIN_END = "ɐ"
_LATIN = [chr(c) for c in range(ord(_LATIN_END))]
_L = "".join(re.escape(c) for c in _LATIN if unicodedata.category(c)[0] == "L")
_N = "".join(re.escape(c) for c in _LATIN if unicodedata.category(c)[0] == "N")
_WORD_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
_WORD_UNITS = re.compile(rf"{_CONTRACTIONS}|[{_L}]+|[{_N}]|[^\s{_L}{_N}]+")
_BYTE_UNITS = re.compile(rf"{_CONTRACTIONS}| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")
_SPACED = re.compile(r"\s*\S+|\s+")
#: str.split() and re's \s take these for white space, the vocabularies' patterns do not.
_SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")

#: In a text without these, words stand behind single blanks or line ends.
_UNEVEN = ("  ", "\n\n", " \n", "\n ", *(c for c in map(chr, range(0x110000)) if c.isspace() and c not in (" ", "\n", *_SEPARATORS)))


def _byte_letters() -> list[str]:
    """The printable letter of each byte in a byte-level vocabulary: itself if printable, else the next free one from 256."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, free = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b], free = chr(free), free + 1
    return [letters[b] for b in range(256)]


class _Table(dict):
    """Unit -> code; a missing unit is taken from the table before or encoded, and stored. Only strings, bytes and numbers are kept, which the garbage collector need not walk."""

    def __init__(self, encode, before=None):
        super().__init__()
        self.encode, self.before = encode, before
        self.ids, self.starts, self.lens = array("I"), array("q"), array("i")

    def __missing__(self, unit):
        known = None if self.before is None else self.before.get(unit)
        code = self[unit] = self.add(self.encode(unit) if known is None else self.before.of(known))
        return code

    def of(self, code: int) -> bytes:
        start = self.starts[code]
        return self.ids[start : start + self.lens[code]].tobytes()

    def add(self, ids: bytes) -> int:
        self.starts.append(len(self.ids))
        self.lens.append(len(ids) >> 2)
        self.ids.frombytes(ids)
        return len(self.lens) - 1


class TextEncoder:
    """Ids of texts, as the library's encode(text, add_special_tokens=False).

    path: a file of the tokenizers library. max_units: bound of the table kept by a worker; beyond it the
    table starts again, which costs time and changes no result. For a byte-level vocabulary the last table stays
    to be looked up, as its pre-tokens of letters are units themselves and not kept beside them.
    """

    def __init__(self, path: str, max_units: int = 600_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.tokenize = self.library.model.tokenize
        self.max_units = max_units
        spec = json.load(open(path, encoding="utf-8"))
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.kind = self._kind(spec)
        self.letters = _byte_letters()
        self.whole: dict[str, int] = self._whole_tokens(spec) if self.kind == "words" else {}
        self.table = None
        self._reset()

    @staticmethod
    def _kind(spec: dict) -> str:
        pre, norm = spec["pre_tokenizer"] or {}, spec["normalizer"] or {}
        if spec["model"]["type"] != "BPE" or spec["post_processor"] or any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            return "library"
        if not norm and pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]:
            return "bytes"
        steps = [x["type"] for x in norm.get("normalizers", [])]
        parts = pre.get("pretokenizers", [])
        if steps == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in parts] == ["Split", "ByteLevel"] and parts[0]["pattern"].get("Regex") == _WORD_RULE and parts[0]["invert"] and not parts[1]["use_regex"]:
            return "words"
        return "library"

    def _whole_tokens(self, spec: dict) -> dict[str, int]:
        """The offline proof: vocabulary strings that, encoded alone, are one pre-token and come out as that one token."""
        suffix = spec["model"]["end_of_word_suffix"] or ""
        back = {c: b for b, c in enumerate(self.letters)}
        proven = {}
        for string, i in spec["model"]["vocab"].items():
            body = string.removesuffix(suffix)
            if suffix and body == string or not all(c in back for c in body):
                continue
            try:
                word = bytes(back[c] for c in body).decode()
            except UnicodeDecodeError:
                continue
            if word and max(word) < _LATIN_END and _WORD_UNITS.findall(word) == [word] and word == word.lower() and [t.id for t in self.tokenize(body)] == [i]:
                proven[word] = i
        return proven

    def _reset(self) -> None:
        self.pretokens: dict[str, bytes] = {w: array("I", (i,)).tobytes() for w, i in self.whole.items()}
        if self.kind == "words":
            self.table = _Table(self._word_unit)
        else:
            if self.table is not None:
                self.table.before = None
            self.table = _Table(self._byte_unit, self.table)

    def _merge(self, pretoken: str) -> bytes:
        ids = self.pretokens.get(pretoken)
        if ids is None:
            letters = self.letters
            ids = array("I", [t.id for t in self.tokenize("".join([letters[b] for b in pretoken.encode()]))]).tobytes()
            if len(pretoken) < 64:
                self.pretokens[pretoken] = ids
        return ids

    def _whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _word_unit(self, unit: str) -> bytes:
        if not unit.isascii() and max(unit) >= _LATIN_END:
            return self._whole(unit)
        return b"".join([self._merge(p) for p in _WORD_UNITS.findall(unit.lower())])

    def _byte_unit(self, key: str) -> bytes:
        """key: a unit after one space; after "\\r" a unit as it stands; with "\\n" first, itself."""
        ascii_only = key.isascii()
        if not ascii_only and max(key) >= _LATIN_END:
            return self._whole(key[1:] if key[0] == "\r" else key if key[0] == "\n" else f" {key}")
        if key.isalpha():  # with its space one pre-token
            return array("I", [t.id for t in self.tokenize(self.letters[32] + (key if ascii_only else "".join([self.letters[b] for b in key.encode()])))]).tobytes()
        if key[-1] in ",." and key[:-1].isalpha():
            return self._ids(key[:-1]) + self._merge(key[-1])
        parts = _BYTE_UNITS.findall(key[1:] if key[0] == "\r" else key if key[0] == "\n" else f" {key}")
        return b"".join([self._ids(p[1:]) if p[0] == " " and p[1:].isalpha() else self._merge(p) for p in parts])

    def _ids(self, unit: str) -> bytes:
        return self.table.of(self.table[unit])

    def units(self, text: str) -> list[str] | None:
        """The text's units, None if only the library can encode it."""
        if self.kind == "library" or any(s in text for s in self.specials) or any(s in text for s in _SEPARATORS):
            return None
        if self.kind == "words":
            return text.split()
        if not text:
            return []
        if text[0] not in " \n" and text[-1] not in " \n" and not any(s in text for s in _UNEVEN):  # single separators only
            units = text.replace("\n", " \n").split(" ")
            units[0] = f"\r{units[0]}"
            return units
        return [f"\r{u}" for u in _SPACED.findall(text)]

    def encode_many(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and each text's count. Null counts as empty."""
        if len(self.table) > self.max_units or len(self.pretokens) > self.max_units:
            self._reset()
        codes, table = array("q"), self.table
        look = table.__getitem__
        ends = np.zeros(len(texts) + 1, np.int64)
        for k, text in enumerate(texts):
            units = self.units(text) if text else []
            if units is None:  # under a code of its own, not kept as a unit
                codes.append(table.add(self._whole(text)))
            else:
                codes.extend(map(look, units))
            ends[k + 1] = len(codes)
        code = np.frombuffer(codes, np.int64) if codes else np.empty(0, np.int64)
        lens = np.frombuffer(table.lens, np.int32)[code].astype(np.int64) if len(code) else np.empty(0, np.int64)
        before = np.concatenate(([0], np.cumsum(lens)))
        counts = before[ends[1:]] - before[ends[:-1]]
        if not before[-1]:
            return np.empty(0, np.uint32), counts
        at = np.repeat(np.frombuffer(table.starts, np.int64)[code] - before[:-1], lens)
        at += np.arange(before[-1])
        return np.frombuffer(table.ids, np.uint32)[at], counts

    def count(self, text: str | None) -> int:
        """Tokens of one text, without building its ids."""
        if not text:
            return 0
        units = self.units(text)
        if units is None:
            return len(self.library.encode(text, add_special_tokens=False).ids)
        if len(self.table) > self.max_units or len(self.pretokens) > self.max_units:
            self._reset()
        lens = self.table.lens
        return sum(map(lens.__getitem__, map(self.table.__getitem__, units)))


_loaded: dict[str, TextEncoder] = {}
handed_on.append(_loaded.clear)


def encoder(path: str) -> TextEncoder:
    """This worker's encoder of a file, loaded once."""
    if path not in _loaded:
        _loaded[path] = TextEncoder(path)
    return _loaded[path]


def vocabulary(name: str) -> str:
    """Where the installed public vocabulary of this name lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def in_blocks(texts: list[str | None], limit: int = 2_000_000):
    """(first, end) of stretches of texts with about limit characters, so that working memory is bounded by the longest text."""
    first = size = 0
    for k, text in enumerate(texts):
        size += len(text or "")
        if size >= limit:
            yield first, k + 1
            first, size = k + 1, 0
    if first < len(texts):
        yield first, len(texts)
