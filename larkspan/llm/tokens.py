"""Token ids of whole texts with a public tokenizer; each distinct piece of text is encoded once.

The ids are those that the library gives for the whole text. A text is cut only at places over which neither normalizer
nor pre-tokenizer can reach, which is known for two kinds of tokenizers (see `_kind`); any other gets whole texts.

Cutting. `classes` gives characters a class: letter, number, other or white. Only characters count whose class is the
same in Unicode 3.2 and now (so that the library's tables agree), that NFC leaves alone next to any neighbour, and whose
lower case is one character of the same class. In a text of such characters a pre-token ends wherever the class changes,
except next to an apostrophe (contractions), and one space goes with what follows it. All other texts are cut only
before a single space between two such characters that are not white. Texts that hold the name of a special token go
to the library as they are.

Encoding. Pieces that are one pre-token of Latin characters get their byte-level form here and go to the tokenizer's model
in groups, with a piece of one known id between; all others go to the library one by one.
"""

from __future__ import annotations

import codecs
import json
import os
import re
import unicodedata
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import common as C

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

BAD, LETTER, NUMBER, OTHER, WHITE = range(5)
#: Pieces kept and their ids; beyond, those that were not met again are dropped. Pieces of a group.
_MOST, _MOST_IDS, _GROUP = 400_000, 8 << 20, 1000
#: Characters up to here may be encoded in groups.
_LATIN = 0x250
#: Fixed value: the pattern by which the word tokenizer's file splits.
_WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer's file; an absolute path is taken as it is."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of each character of the basic plane."""
    old, new, kinds = unicodedata.ucd_3_2_0.category, unicodedata.category, {"L": LETTER, "N": NUMBER, "P": OTHER, "S": OTHER}
    table = np.zeros(1 << 16, np.uint8)
    seconds = set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3))
    for i in range(1 << 16):
        c = chr(i)
        if (parts := unicodedata.decomposition(c).split()) and len(parts) == 2 and parts[0][0] != "<":
            seconds.add(int(parts[1], 16))
        kind = kinds.get(new(c)[0], BAD)
        if kind and kind == kinds.get(old(c)[0]) and not unicodedata.combining(c) and unicodedata.is_normalized("NFC", c):
            low = c.lower()
            if len(low) == 1 and kinds.get(new(low)[0]) == kind:
                table[i] = kind
    table[[i for i in seconds if i < 1 << 16]] = BAD
    table[[9, 10, 13, 32]] = WHITE
    return table


def _members(kinds: tuple[int, ...], below: int = 1 << 16, without: str = "") -> str:
    """The characters of these classes, as ranges for a set of a pattern."""
    inside = np.isin(classes()[:below], kinds)
    inside[[ord(c) for c in without]] = False
    edge = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
    return "".join(f"\\u{a:04x}-\\u{b - 1:04x}" for a, b in edge.reshape(-1, 2).tolist())


def byte_classes(raw: np.ndarray) -> np.ndarray:
    """The class of each byte's character in UTF-8 text."""
    table = classes()
    kind = np.concatenate([table[:128], np.zeros(128, np.uint8)])[raw]
    lead = np.flatnonzero(raw >= 0xC0)
    if len(lead):
        first = raw[lead]
        for least, end, n in ((0xC0, 0xE0, 2), (0xE0, 0xF0, 3)):
            at = lead[(first >= least) & (first < end)]
            code = raw[at].astype(np.int64) & (0x1F if n == 2 else 0x0F)
            for k in range(1, n):
                code = code << 6 | raw[at + k] & 0x3F
            for k in range(n):
                kind[at + k] = table[code]
    return kind


def cuts(raw: np.ndarray, at: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where pieces start in texts of known classes; pieces lie next to each other and no text starts within one."""
    n = len(raw)
    first = np.zeros(n + 1, bool)
    first[1:n] = kind[1:] != kind[:-1]
    quote = np.flatnonzero(raw == 39)
    first[quote] = first[quote + 1] = False
    heads = at[:-1]
    white = kind == WHITE
    # Of white space before a character the last is apart, and one piece with the character if it is a space.
    after = np.flatnonzero(white[:-1] & ~white[1:]) + 1
    is_head = np.zeros(n + 1, bool)
    is_head[heads] = True
    after = after[~is_head[after]]
    first[after - 1] = True
    first[after] = raw[after - 1] != 32
    start = quote[quote < n - 1]
    first[(start + 1)[white[start + 1]]] = True
    first |= is_head
    return np.flatnonzero(first[:n])


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.inner = Tokenizer.from_file(path)
        self.kind = self._kind()
        marks = [re.escape(t.content) for t in self.inner.get_added_tokens_decoder().values() if t.content]
        self.marks = "(?i)" + "|".join(marks) if marks else None
        self.direct = None
        if self.kind:
            # A byte's character in the byte-level alphabet; between pieces stand line ends and the byte 0.
            own = [*range(33, 127), *range(161, 173), *range(174, 256)]
            table = {**{b: chr(b) for b in own}, **{b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(own))}}
            self.alphabet = "".join(" " if b == 10 or (b == 32 and self.kind == "word") else table[b] for b in range(256))
            number = f"[{_members((NUMBER,), _LATIN)}]" + ("" if self.kind == "word" else "+")
            self.easy = re.compile(f" ?(?:[{_members((LETTER,), _LATIN)}]+|[{_members((OTHER,), _LATIN, chr(39))}]+|{number})").fullmatch
            safe = _members((LETTER, NUMBER, OTHER))
            self.cut = re.compile(f"(?<=[{safe}])(?= [{safe}])")
            direct = Tokenizer.from_file(path)
            direct.normalizer, direct.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
            direct.model._resize_cache(0)  # pieces come once
            mark = direct.encode(self.alphabet[0], add_special_tokens=False).ids
            if len(mark) == 1:
                self.direct, self.mark = direct, mark[0]
        self._clear()

    def _kind(self) -> str | None:
        """Whether the file has one of the two pre-tokenizers for which the cuts hold."""
        state = json.loads(self.inner.to_str())
        if state["model"].get("dropout") or state.get("truncation") or state.get("padding"):
            return None
        split, steps = state["pre_tokenizer"] or {}, state["normalizer"]
        if steps is None and split.get("type") == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]:
            return "byte"
        if steps is not None and [x["type"] for x in steps.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and steps["normalizers"][1]["pattern"] == {"Regex": "\\s+"} and split.get("type") == "Sequence":
            a, b = (*split["pretokenizers"], {}, {})[:2]
            if a.get("type") == "Split" and a["pattern"] == {"Regex": _WORD_SPLIT} and b.get("type") == "ByteLevel" and not b["use_regex"] and not b["add_prefix_space"]:
                return "word"
        return None

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.flat, self.start, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.again = np.zeros(0, bool)

    def _shrink(self) -> None:
        """Keep the pieces that were met again, if they are few enough."""
        kept = np.flatnonzero(self.again)
        size, start = self.size[kept], self.start[kept]
        if 2 * len(kept) > _MOST or 2 * int(size.sum()) > _MOST_IDS:
            return self._clear()
        names = list(self.number)  # in order of number
        names = [names[i] for i in kept.tolist()]
        to = np.cumsum(size) - size
        self.flat = self.flat[np.repeat(start - to, size) + np.arange(int(size.sum()))]
        self.start, self.size, self.again = to, size, np.zeros(len(kept), bool)
        self.number = dict(zip(names, range(len(names)), strict=True))

    def _each(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists: list[list[int]] = []
        for i in range(0, len(names), 20_000):
            lists += [e.ids for e in self.inner.encode_batch_fast(names[i : i + 20_000], add_special_tokens=False)]
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(chain.from_iterable(lists), np.uint32, int(size.sum())), size

    def _grouped(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of one pre-token each. A group in which the known id is not found just between the pieces goes one by one."""
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for i in range(0, len(names), 20 * _GROUP):
            some = [names[k : k + _GROUP] for k in range(i, min(i + 20 * _GROUP, len(names)), _GROUP)]
            lines = ["\n\0\n".join(x) for x in some]
            if self.kind == "word":
                lines = [x.lower() for x in lines]
            lines = [codecs.charmap_decode(x.encode(), "strict", self.alphabet)[0] for x in lines]
            for part, e in zip(some, self.direct.encode_batch_fast(lines, add_special_tokens=False), strict=True):
                found = np.array(e.ids, np.uint32)
                cut = np.flatnonzero(found == self.mark)
                if len(cut) == len(part) - 1:
                    ids.append(np.delete(found, cut))
                    sizes.append(np.diff(np.concatenate([[-1], cut, [len(found)]])) - 1)
                else:
                    found, size = self._each(part)
                    ids.append(found)
                    sizes.append(size)
        return np.concatenate(ids), np.concatenate(sizes)

    def _look(self, names: list[str]) -> np.ndarray:
        """The numbers of distinct pieces, whose ids are in flat from start on; encodes those that are new."""
        found = np.fromiter(map(self.number.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(found < 0)
        self.again[found[found >= 0]] = True
        if not len(new):
            return found
        if self.number and (len(self.number) + len(new) > _MOST or len(self.flat) > _MOST_IDS):
            self._shrink()
            if len(self.number) + len(new) > _MOST:
                self._clear()
            found = np.fromiter(map(self.number.get, names, repeat(-1)), np.int64, len(names))
            new = np.flatnonzero(found < 0)
        fresh = [names[i] for i in new.tolist()]
        if self.direct is not None:
            easy = np.array(list(map(self.easy, fresh)), object).astype(bool)
            new = np.concatenate([new[easy], new[~easy]])
            fresh = [names[i] for i in new.tolist()]
            k = int(easy.sum())
            (a, s), (b, t) = self._grouped(fresh[:k]), self._each(fresh[k:])
            ids, size = np.concatenate([a, b]), np.concatenate([s, t])
        else:
            ids, size = self._each(fresh)
        first = len(self.size)
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.flat = np.concatenate([self.flat, ids])
        self.size, self.again = np.concatenate([self.size, size]), np.concatenate([self.again, np.zeros(len(size), bool)])
        found[new] = np.arange(first, first + len(new))
        self.number.update(zip(fresh, range(first, first + len(new)), strict=True))
        return found

    def _gather(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces one after another, and where each piece's begin."""
        each = self.size[number]
        ends = np.concatenate([[0], np.cumsum(each)])
        return self.flat[np.repeat(self.start[number] - ends[:-1], each) + np.arange(ends[-1])], ends

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; none for a null."""
        n = len(texts)
        if n == 0:
            return []
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        if not self.kind:
            return [np.array(self.inner.encode(x.as_py(), add_special_tokens=False).ids, np.uint32) for x in texts]
        marked = np.zeros(n, bool)
        if self.marks is not None:
            marked = pc.match_substring_regex(texts, self.marks).to_numpy(zero_copy_only=False)
        raw, at = C.string_bytes(texts)
        if self.kind == "word":
            raw = C.LOWER[raw]
        kind = byte_classes(raw)
        start = cuts(raw, at, kind)
        pieces = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(np.append(start, len(raw))), pa.py_buffer(np.ascontiguousarray(raw))])
        coded = pieces.dictionary_encode()
        odd = np.zeros(n, bool)
        odd[np.searchsorted(at, np.flatnonzero(kind == BAD), side="right") - 1] = True
        whole = np.searchsorted(start, at)
        code, names = coded.indices.to_numpy(), coded.dictionary
        if odd.any() or marked.any():
            # Pieces of these texts alone are not looked up.
            used = np.zeros(len(names), bool)
            used[code[np.repeat(~(odd | marked), np.diff(whole))]] = True
            number = np.zeros(len(names), np.int64)
            number[used] = self._look(_strings(names.filter(pa.array(used))))
            if not len(self.size):
                self._look([""])
        else:
            number = self._look(_strings(names))
        ids, ends = self._gather(number[code]) if len(code) else (np.zeros(0, np.uint32), np.zeros(1, np.int64))
        bounds = ends[whole]
        out = [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        for k in np.flatnonzero(odd & ~marked).tolist():
            chunks = self.cut.split(texts[k].as_py())
            names = list(dict.fromkeys(chunks))
            number = dict(zip(names, self._look(names).tolist(), strict=True))
            out[k] = self._gather(np.fromiter(map(number.get, chunks), np.int64, len(chunks)))[0]
        for k in np.flatnonzero(marked).tolist():
            out[k] = np.array(self.inner.encode(texts[k].as_py(), add_special_tokens=False).ids, np.uint32)
        return out


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)
