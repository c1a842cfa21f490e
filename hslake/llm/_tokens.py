"""Token ids of texts through the tokenizer's own library, which is asked once for every distinct unit of a task and not for every text.

A unit ends where no token can cross: for byte-level splits and sentence pieces at a single space between two characters that aren't white space, for
tokenizers that drop white space at every run of ASCII white space. The ids of a text are those of its units one after the other; tests hold them
against the library's ids of whole texts. Files of another kind have one unit, the text. A long text is split in slices of ``SLICE`` characters.

Byte-level files are asked for less: their split is cut in bulk on the bytes (``tiles_of``), and only a chunk's distinct tiles are looked up, of which there are
fewer than units.

Counts alone need less: a file that splits units into runs of letters, digits and other signs (``RUNS``) is asked for the lowered runs, of
which there are fewer than units. The texts are cut to them in bulk, and only a chunk's distinct ones are looked up.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa

from ._text import WORD_BREAKS

#: How many units (by tokenizer) a worker remembers, and how many ids they may have together, before it begins anew.
UNITS, POOL, SLICE, JOINED = 600_000, 1 << 22, 1 << 20, 4000
SAFE = re.compile(r"(?<=\S) (?=\S)")
RARE = re.compile(r"[^\S \n]")
#: Marks a unit that no space comes before; no text holds it.
BARE = "\ud800"
#: The pre-tokenizer of byte-level files whose tokens hold white space only in front, and the bytes that stand for themselves in their vocabulary.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: A fixed value too: a split into runs of letters, single digits and runs of other signs, which all end in tokens of one suffix.
RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Of each byte of a piece: white, letter, digit, other sign, first byte of U+00C0 to U+00FF; the rest, and apostrophes, belong to whole units only.
WHITE, LETTER, DIGIT, SIGN, LATIN, WHOLE = range(6)
BYTE_KINDS = np.full(256, WHOLE, np.uint8)
BYTE_KINDS[33:127] = SIGN
BYTE_KINDS[[*range(65, 91), *range(97, 123)]] = LETTER
BYTE_KINDS[48:58] = DIGIT
BYTE_KINDS[0xC3], BYTE_KINDS[39] = LATIN, WHOLE
BYTE_KINDS[WORD_BREAKS] = WHITE
#: How many pieces are asked for together.
PIECES = 200
#: A text that holds one of these isn't cut into tiles: control characters, white space beyond ASCII, what libraries disagree on, the begin of an added token.
UNTILED = re.compile("[\\x00-\\x08\\x0e-\\x1f\\x7f\\u180e\\u200b\\ufeff]|[^\\S\\t-\\r ]|<\\|")


def units_at_spaces(text: str) -> list[str]:
    """The units that single spaces part; with those spaces between them they are the text."""
    beside = "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " " or RARE.search(text)
    return SAFE.split(text) if beside else text.split(" ")


def units_of_pieces(text: str) -> list[str]:
    """As ``units_at_spaces``; sentence pieces can't tell U+2581 from a space, so a text that holds it is one unit."""
    return [text] if "\u2581" in text else units_at_spaces(text)


def units_at_white(text: str) -> list[bytes]:
    return text.encode().split()


@dataclass
class Kind:
    """How a tokenizer file is run: ``ask`` gives the ids of strings, ``ask_after`` those of units that a space comes before (white space
    that is dropped counts as one), ``units`` splits a text (None: never), ``tokens`` gives the bytes of every id, ``ask_pieces`` how many ids
    each of some pieces has (None: units aren't split further); ``tiled``: the split is that of ``tiles_of``."""

    ask: Callable[[list], list]
    ask_after: Callable[[list], tuple]
    units: Callable[[str], list] | None
    drops_white: bool
    tokens: Callable[[], list[bytes]]
    ask_pieces: Callable[[list[bytes]], list[int]] | None = None
    tiled: bool = False


def asked_together(units: list, begins: np.ndarray, ask: Callable[[list], list], lead: str, alone: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of units that a space comes before, and how many each has: joined in one string, whose ids part where one ``begins`` with a space.

    Units that hold a space themselves, or a character of ``alone``, are asked one by one.
    """
    odd = re.compile(f"[ {alone}]")
    out = []
    single = {i for i, u in enumerate(units) if not u or odd.search(u)} if "" in units or odd.search("".join(units)) else set()
    plain = [i for i in range(len(units)) if i not in single]
    for k in range(0, len(plain), JOINED):
        some = [units[i] for i in plain[k : k + JOINED]]
        own = np.array(ask([lead + " ".join(some)])[0], np.uint32)
        at = np.flatnonzero(begins[own])
        if len(at) != len(some):
            raise ValueError("a token crosses a space")
        out.append((own, np.diff(at, append=len(own))))
    if not single:
        return np.concatenate([np.zeros(0, np.uint32), *[o[0] for o in out]]), np.concatenate([np.zeros(0, np.int64), *[o[1] for o in out]])
    parts: list = [None] * len(units)
    for i, p in zip(plain, (p for own, n in out for p in np.split(own, np.cumsum(n)[:-1]))):
        parts[i] = p
    for i, p in zip(sorted(single), ask([lead + units[i] for i in sorted(single)])):
        parts[i] = np.array(p, np.uint32)
    return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)


def asked_alone(units: list, ask: Callable[[list], list]) -> tuple[np.ndarray, np.ndarray]:
    found = ask(list(units))
    return np.array([i for f in found for i in f], np.uint32), np.array([len(f) for f in found], np.int64)


def _plain_added(spec: dict) -> bool:
    return not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or re.search(r"\s", t["content"]) for t in spec.get("added_tokens", []))


def _drops_white(spec: dict) -> bool:
    """White space becomes one space, and a split that keeps no white space removes it."""
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    joined = any(s.get("type") == "Replace" and s.get("pattern") == {"Regex": "\\s+"} and s.get("content") == " " for s in steps) and all(s["type"] in ("NFC", "Replace", "Lowercase") for s in steps)
    kept = len(splits) == 2 and splits[0].get("behavior") == "Removed" and splits[0].get("invert") and splits[1]["type"] == "ByteLevel" and not splits[1].get("use_regex") and not splits[1].get("add_prefix_space")
    return bool(joined and kept and not re.search(r"(?<!\^)\\s| ", splits[0]["pattern"].get("Regex", " ")))


def _in_runs(spec: dict) -> bool:
    """The normaliser lowers, the split is ``RUNS``, and the last token of each run, only that, ends with a suffix."""
    steps, first = spec["normalizer"]["normalizers"], spec["pre_tokenizer"]["pretokenizers"][0]
    added = {t["content"] for t in spec.get("added_tokens", [])}
    return [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"] and first["pattern"] == {"Regex": RUNS} and spec["model"].get("end_of_word_suffix") == "</w>" and all(a.startswith("<|") for a in added)


def kinds_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kind of each byte, never ``LATIN``, and the first bytes of the letters among U+00C0 to U+00FF."""
    kind = BYTE_KINDS[data]
    latin = np.flatnonzero(kind == LATIN)
    if len(latin):
        after = data[latin + 1]
        letter = (after != 0x97) & (after != 0xB7)
        kind[latin] = kind[latin + 1] = np.where(letter, LETTER, WHOLE)
        latin = latin[letter]
    if len(data) > 1:
        kind[:-1][(data[:-1] == 60) & (data[1:] == 124)] = WHOLE
    return kind, latin


def whole_units(kind: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs without white space, none across a byte of ``first``, and the numbers of those that hold a ``WHOLE`` byte."""
    inside = kind != WHITE
    begin = inside & first[:-1]
    begin[1:] |= inside[1:] & ~inside[:-1]
    starts = np.flatnonzero(begin)
    stop = inside & first[1:]
    stop[:-1] |= inside[:-1] & ~inside[1:]
    return starts, np.flatnonzero(stop) + 1, np.unique(np.searchsorted(starts, np.flatnonzero(kind == WHOLE), "right") - 1)


def tiles_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the tiles begin that a byte-level split (``BYTE_LEVEL``) cuts the texts into, and which texts must be split by the library.

    A tile is a run of letters, digits or other signs with the space before it, or white space: all of it at the end of a text, else its last
    character, unless that is such a space, and what stands before it. A run without white space that holds another character than ASCII's printed ones and
    the letters among U+00C0 to U+00FF, or an apostrophe (contractions), is one tile.
    """
    kind, _ = kinds_of(data)
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    untiled = np.zeros(len(offsets) - 1, bool)
    odd = kind == WHOLE
    if odd.any():
        for row in np.unique(np.searchsorted(offsets, np.flatnonzero(odd & (data != 39)), "right") - 1).tolist():
            untiled[row] = bool(UNTILED.search(data[offsets[row] : offsets[row + 1]].tobytes().decode()))
        starts, ends, held = whole_units(kind, first)
        flag = np.zeros(len(starts), bool)
        flag[held] = True
        inside = kind != WHITE
        kind[inside] = np.where(np.repeat(flag, ends - starts), WHOLE, kind[inside])
    white = kind == WHITE
    begin = first[:-1].copy()
    begin[1:] |= (kind[1:] != kind[:-1]) & (data[:-1] != 32)
    begin[1:] |= white[1:] & ~white[:-1]
    begin[:-1] |= white[:-1] & ~white[1:] & ~first[1:-1]
    return np.flatnonzero(begin), untiled


def pieces_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, list[tuple[int, bytes]]]:
    """The pieces, with A-Z and U+00C0 to U+00DE lowered, the row of each, and (row, unit) of the units that are asked for whole.

    A unit is whole if it holds another character than ASCII's printed ones and the letters among U+00C0 to U+00FF, an apostrophe (contractions) or
    the begin of an added token.
    """
    kind, latin = kinds_of(data)
    low = data.copy()
    low[(data >= 65) & (data <= 90)] += 32
    low[latin[data[latin + 1] <= 0x9E] + 1] += 32
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    inside, whole = kind != WHITE, []
    if (kind == WHOLE).any():
        starts, ends, odd = whole_units(kind, first)
        rows = np.searchsorted(offsets, starts[odd], "right") - 1
        for row, a, b in zip(rows.tolist(), starts[odd].tolist(), ends[odd].tolist()):
            whole.append((row, data[a:b].tobytes()))
            inside[a:b] = False
            kind[a:b] = WHITE
    begin = inside & (first[:-1] | (kind == DIGIT))
    begin[1:] |= inside[1:] & (kind[1:] != kind[:-1])
    starts, packed = np.flatnonzero(begin), low[inside]
    at = np.append(np.cumsum(inside)[starts] - 1, len(packed)).astype(np.int32)
    pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(packed)])
    return pieces, np.searchsorted(offsets, starts, "right") - 1, whole


def byte_level_tokens(vocab: dict[str, int]) -> list[bytes]:
    """The bytes of every id of a byte-level vocabulary."""
    hidden = [b for b in range(256) if b not in set(PRINTED)]
    byte_of = {chr(b): b for b in PRINTED} | {chr(256 + i): b for i, b in enumerate(hidden)}
    out = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        out[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
    return out


def piece_bytes(piece: str) -> bytes:
    """A sentence piece in UTF-8: U+2581 is a space, <0xHH> the byte HH."""
    if re.fullmatch(r"<0x[0-9A-F]{2}>", piece):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


def open_kind(path: str, special_as_text: bool = False) -> Kind:
    """The tokenizer of ``path``: ``tokenizers`` for .json, ``sentencepiece`` for .model. Without begin, end or added special tokens, truncation or padding."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        begins = np.array([p.startswith("▁") for p in pieces])
        crossing = any(re.search("[^▁]▁", p) for p in pieces)

        def run(texts: list) -> list:
            return model.encode(texts, num_threads=1)

        return Kind(run, lambda units: asked_together(units, begins, run, "", "\u2581"), None if crossing else units_of_pieces, False, lambda: [piece_bytes(p) for p in pieces])
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    spec = json.loads(Path(path).read_text())
    own = Tokenizer.from_file(path)
    own.no_truncation()
    own.no_padding()
    own.encode_special_tokens = special_as_text
    split = {k: v for k, v in (spec.get("pre_tokenizer") or {}).items() if k in BYTE_LEVEL}
    white = _plain_added(spec) and _drops_white(spec)
    spaces = _plain_added(spec) and spec.get("normalizer") is None and split == BYTE_LEVEL

    def run(texts: list) -> list:
        return [e.ids for e in own.encode_batch_fast([t.decode() if isinstance(t, bytes) else t for t in texts], add_special_tokens=False)]

    def run_white(units: list) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes = [], []
        for k in range(0, len(units), JOINED):
            some = [u.decode() for u in units[k : k + JOINED]]
            found = own.encode_batch([" ".join(some)], add_special_tokens=False)[0]
            at = np.array(found.offsets, np.int64).reshape(-1, 2)[:, 0]
            ends = np.searchsorted(at, np.cumsum([len(u) + 1 for u in some]))
            ids.append(np.array(found.ids, np.uint32))
            sizes.append(np.diff(ends, prepend=0))
        return np.concatenate([np.zeros(0, np.uint32), *ids]), np.concatenate([np.zeros(0, np.int64), *sizes])

    def tokens() -> list[bytes]:
        return byte_level_tokens(own.get_vocab())

    last = np.zeros(own.get_vocab_size(), bool)

    def run_pieces(pieces: list[bytes]) -> list[int]:
        if not last.any():
            last[[i for t, i in own.get_vocab().items() if t.endswith("</w>")]] = True
        groups = [pieces[k : k + PIECES] for k in range(0, len(pieces), PIECES)]
        counts = []
        for some, ids in zip(groups, run([b" ".join(g) for g in groups])):
            ends = np.flatnonzero(last[ids])
            counts += np.diff(ends, prepend=-1).tolist() if len(ends) == len(some) else map(len, run(some))
        return counts

    if white:
        return Kind(run, run_white, units_at_white, True, tokens, run_pieces if _in_runs(spec) else None)
    if not spaces:
        return Kind(run, lambda units: asked_alone([" " + u for u in units], run), None, False, tokens)
    begins = np.array([t.startswith(b" ") for t in tokens()])
    added = "".join(re.escape(t["content"][0]) for t in spec.get("added_tokens", []) if not special_as_text)
    tiled = all(t["content"].startswith("<|") for t in spec.get("added_tokens", []))
    return Kind(run, lambda units: asked_together(units, begins, run, " ", added), units_at_spaces, False, tokens, tiled=tiled)


def version(path: str) -> str:
    """Digest of the tokenizer file and of its library's version: counts of other versions are other counts."""
    from importlib.metadata import version as installed

    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    return hashlib.sha256(f"{library} {installed(library)}\n".encode() + Path(path).read_bytes()).hexdigest()


def slices(text: str) -> list[str]:
    """A long text in slices that single spaces part: those spaces, put back between the slices, give the text. With U+2581 (see ``units_of_pieces``) whole."""
    out, at = [], 0
    while len(text) - at > SLICE and "\u2581" not in text and (m := SAFE.search(text, at + SLICE)):
        out.append(text[at : m.start()])
        at = m.end()
    return [*out, text[at:]]


@dataclass
class Encoder:
    """Ids of texts by one or more tokenizers, whose units are those of the last. ``spaced``: every unit, the first one too, is asked for with a space before it, so the
    ids are those of space+text (sentence pieces add that space themselves). ``checked``: a text holds if the bytes of the last tokenizer's tokens are space+text.
    """

    kinds: list[Kind]
    spaced: bool = False
    checked: bool = False

    def __post_init__(self) -> None:
        self.units = self.kinds[-1].units
        self.drops_white = self.kinds[-1].drops_white
        self.table = self.kinds[-1].tokens() if self.checked else []
        self.known: dict = {}
        self.pieces: dict[bytes, int] = {}
        self._clear()

    def _clear(self) -> None:
        self.known.clear()
        n = len(self.kinds)
        self.pools, self.starts, self.counts = ([np.zeros(0, t) for _ in range(n)] for t in (np.uint32, np.int64, np.int64))
        self.fine = np.zeros(0, bool)

    def _forget(self) -> None:
        if len(self.fine) * len(self.kinds) > UNITS or max(map(len, self.pools)) > POOL:
            self._clear()

    def _flat(self, k: int, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of coded units by tokenizer ``k``, one after the other, and where each unit's end."""
        n = self.counts[k][codes]
        at = np.cumsum(n)
        return self.pools[k][np.repeat(self.starts[k][codes] - at + n, n) + np.arange(at[-1] if len(at) else 0)], at

    def _learn(self, first: list, later: list, names: list[bytes] | None = None) -> None:
        """Ids of units without and with a space before them; they are known by ``names``, or by themselves."""
        at = len(self.fine)
        self.known.update(zip(names or [*(BARE + u for u in first), *later], range(at, at + len(first) + len(later))))
        for k, kind in enumerate(self.kinds):
            found = [asked_alone(first, kind.ask), kind.ask_after(later)]
            ids, sizes = (np.concatenate([f[i] for f in found]) for i in (0, 1))
            self.starts[k] = np.concatenate([self.starts[k], len(self.pools[k]) + np.cumsum(sizes) - sizes])
            self.counts[k] = np.concatenate([self.counts[k], sizes])
            self.pools[k] = np.concatenate([self.pools[k], ids])
        fine = np.ones(len(sizes), bool)
        if self.checked:
            shown = list(map(self.table.__getitem__, ids.tolist()))
            if b"".join(shown) != b"".join([b" " + u.encode() for u in (*first, *later)]):
                ends = np.cumsum(sizes).tolist()
                fine = np.array([b"".join(shown[e - n : e]) == b" " + u.encode() for u, e, n in zip((*first, *later), ends, sizes.tolist())], bool)
        self.fine = np.concatenate([self.fine, fine])

    def _codes(self, texts: list[str], after_space: bool) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all units, and how many each text has; ``after_space``: a space comes before the texts."""
        self._forget()
        units = [self.units(t) if self.units else [t] for t in texts]
        if not (self.spaced or self.drops_white or after_space):
            for us in units:
                us[0] = BARE + us[0]
        fresh = set(chain.from_iterable(units)).difference(self.known)
        if fresh:
            first = [u[1:] for u in fresh if not self.drops_white and u[:1] == BARE]
            self._learn(first, [u for u in fresh if u[:1] != BARE] if first else list(fresh))
        return np.array(list(map(self.known.__getitem__, chain.from_iterable(units))), np.int64), np.array([len(us) for us in units], np.int64)

    def counts_of(self, texts: list[str]) -> np.ndarray:
        """How many ids each text has by the first tokenizer."""
        out = np.zeros(len(texts), np.int64)
        for which, codes, sizes in self._parts(texts):
            ends = np.cumsum(sizes)
            sums = np.concatenate([[0], np.cumsum(self.counts[0][codes])])
            np.add.at(out, which, sums[ends] - sums[ends - sizes])
        return out

    def counts_in(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """How many ids each of the texts that lie next to each other in ``data`` has by the first tokenizer; by pieces if it has them."""
        ask = self.kinds[0].ask_pieces
        n = len(offsets) - 1
        if not ask:
            return self.counts_of([data[a:b].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:])])
        pieces, rows, whole = pieces_of(data, offsets)
        coded = pieces.dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.pieces) > UNITS:
            self.pieces.clear()
        fresh = [w for w in words if w not in self.pieces]
        self.pieces.update(zip(fresh, ask(fresh)))
        counts = np.array(list(map(self.pieces.__getitem__, words)), np.int64)
        out = np.bincount(rows, weights=counts[coded.indices.to_numpy()], minlength=n).astype(np.int64) if len(rows) else np.zeros(n, np.int64)
        if whole:
            np.add.at(out, [row for row, _ in whole], self.counts_of([unit.decode() for _, unit in whole]))
        return out

    def ids(self, texts: list[str]) -> list[tuple]:
        """The ids of each text by each tokenizer, and whether it holds."""
        parts: list[list[list[np.ndarray]]] = [[[] for _ in self.kinds] for _ in texts]
        fine = np.ones(len(texts), bool)
        for which, codes, sizes in self._parts(texts):
            ends = np.cumsum(sizes)
            bad = np.concatenate([[0], np.cumsum(~self.fine[codes])])
            fine[which] &= bad[ends] == bad[ends - sizes]
            for k in range(len(self.kinds)):
                flat, at = self._flat(k, codes)
                cuts = np.concatenate([[0], at])[ends].tolist()
                for w, a, b in zip(which.tolist(), [0, *cuts[:-1]], cuts):
                    parts[w][k].append(flat[a:b])
        return [(*(p[0] if len(p) == 1 else np.concatenate(p) for p in own), bool(f)) for own, f in zip(parts, fine)]

    def ids_in(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The ids of each of the texts that lie next to each other in ``data`` by the first tokenizer; by tiles if it has them."""
        text = lambda i: data[offsets[i] : offsets[i + 1]].tobytes().decode()
        n = len(offsets) - 1
        if not self.kinds[0].tiled or self.spaced or not len(data):
            return [found[0] for found in self.ids([text(i) for i in range(n)])]
        if n == 1 and len(data) > SLICE and len(some := slices(text(0))) > 1:
            cut = [np.frombuffer((" " * (k > 0) + s).encode(), np.uint8) for k, s in enumerate(some)]
            return [np.concatenate([self.ids_in(d, np.array([0, len(d)]))[0] for d in cut])]
        begins, untiled = tiles_of(data, offsets)
        if untiled.any():
            size, good = np.diff(offsets), np.flatnonzero(~untiled)
            some = self.ids_in(data[np.repeat(~untiled, size)], np.concatenate([[0], np.cumsum(size[good])]))
            bad = np.flatnonzero(untiled)
            out = dict(zip(bad.tolist(), (found[0] for found in self.ids([text(i) for i in bad])))) | dict(zip(good.tolist(), some))
            return [out[i] for i in range(n)]
        at = np.append(begins, len(data)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        _, edges, body = coded.dictionary.buffers()
        edges, body = np.frombuffer(edges, np.int32)[: len(coded.dictionary) + 1].tolist(), body.to_pybytes()
        tiles = [body[a:b] for a, b in zip(edges, edges[1:])]
        self._forget()
        found = list(map(self.known.get, tiles))
        fresh = [t for t, code in zip(tiles, found) if code is None]
        if fresh:
            spaced = [t for t in fresh if t[0] == 32 and len(t) > 1 and not WORD_BREAKS[t[1]]]
            bare = [t for t in fresh if t[0] != 32 or len(t) == 1 or WORD_BREAKS[t[1]]]
            self._learn([t.decode() for t in bare], [t[1:].decode() for t in spaced], bare + spaced)
            found = [self.known[t] if code is None else code for t, code in zip(tiles, found)]
        codes = np.array(found, np.int64)[coded.indices.to_numpy()]
        flat, ends = self._flat(0, codes)
        cuts = np.concatenate([[0], ends])[np.searchsorted(begins, offsets)].tolist()
        return [flat[a:b] for a, b in zip(cuts, cuts[1:])]

    def _parts(self, texts: list[str]):
        """(text numbers, codes, units each) of groups of whole short texts, or of the slices of a long one."""
        short = [i for i, t in enumerate(texts) if len(t) <= SLICE or not self.units]
        if short:
            yield (np.array(short), *self._codes([texts[i] for i in short], False))
        for i in (i for i, t in enumerate(texts) if len(t) > SLICE and self.units):
            for k, s in enumerate(slices(texts[i])):
                yield (np.array([i]), *self._codes([s], k > 0))


@lru_cache(maxsize=2)
def encoder(paths: tuple[str, ...], spaced: bool = False, special_as_text: bool = False, checked: bool = False) -> Encoder:
    """The encoder of a Python worker, which keeps what it has learned from task to task."""
    return Encoder([open_kind(p, special_as_text) for p in paths], spaced, checked)
