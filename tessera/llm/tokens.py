"""Byte-level BPE encoding through the ``tokenizers`` library with a piece cache.

The pre-tokeniser of a byte-level vocabulary never lets a token run from a
non-space into a following space.  A text may therefore be cut before every run
of white space, each piece ("␠word,") encoded once by the library, and the ids
joined: the result is the library's own for the whole text.  Texts holding
U+001C-U+001F (white space to Python, not to the library) go to it whole, as do
those that hold the string of an added token, which the library gives its own id.

Pieces are told apart by Arrow and hashed by numpy; the cache is a few sorted
arrays, so that it takes some 40 bytes a piece and a block of texts is looked up at
once.  Only pieces never seen before meet Python.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .bytes_np import U64, _power_tables, mix

_PIECE = re.compile(r"\s*\S+|\s+")
_ODD = re.compile("[\x1c-\x1f]")
#: Two tables of byte codes, and what marks a piece without a space before it.
_CODES = [mix(np.arange(1, 257, dtype=U64) * U64(k)) for k in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)]
_BARE = U64(0xA0761D6478BD642F)
#: Texts that are not words between single spaces and line ends: other white space (to Python), two in a row, some at an end, a zero.
_UNEVEN = r"[\x00\x09\x0b-\x0d\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n][ \n]|^[ \n]|[ \n]$|^$"


def _hashes(words: pa.Array, bare: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit hashes of each piece's bytes and whether it is bare."""
    out = [np.zeros(len(words), U64) for _ in _CODES]
    if not len(words):
        return out
    at = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at -= at[0]
    up, down = _power_tables(len(data) + 1)
    run, size = np.zeros(len(data) + 1, U64), np.diff(at).astype(U64)
    for k, codes in enumerate(_CODES):
        np.cumsum(codes[data] * up[: len(data)], out=run[1:])
        out[k] = mix((run[at[1:]] - run[at[:-1]]) * down[at[:-1]] + size + np.where(bare, _BARE, U64(0)))
    return out


class Known:
    """Ids of pieces by their two hashes: arrays sorted by the first, and all ids in one."""

    def __init__(self):
        self.h1, self.h2, self.start, self.size, self.ids = np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(1 << 12, "<u4")
        self.used = 0

    def find(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Places of pieces, -1 for unknown ones."""
        if not len(self.h1):
            return np.full(len(h1), -1)
        order = np.argsort(h1)
        at = np.empty(len(h1), np.int64)
        at[order] = np.minimum(np.searchsorted(self.h1, h1[order]), len(self.h1) - 1)
        return np.where((self.h1[at] == h1) & (self.h2[at] == h2), at, -1)

    def add(self, h1: np.ndarray, h2: np.ndarray, pieces: list[bytes]) -> None:
        size = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
        flat = np.frombuffer(b"".join(pieces), "<u4")
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(len(flat) + self.used // 2 + 1024, "<u4")])
        self.ids[self.used : self.used + len(flat)] = flat
        start = self.used + np.cumsum(size) - size
        self.used += len(flat)
        order = np.argsort(h1)
        at = np.searchsorted(self.h1, h1[order])
        self.h1, self.h2 = np.insert(self.h1, at, h1[order]), np.insert(self.h2, at, h2[order])
        self.start, self.size = np.insert(self.start, at, start[order]), np.insert(self.size, at, size[order])


class Encoder:
    """Texts to little-endian uint32 ids.  The cache is emptied when it holds more than ``limit`` pieces, or eight times as many ids.

    A piece's key is the piece without its leading space; "\n..." stands for itself
    and "\0..." for what follows the zero.
    """

    def __init__(self, path: str, limit: int = 1_500_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.limit, self.known = limit, Known()
        vocabulary = self.library.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token)  # a character of a byte-level token is a byte
        self.marks = {m: self._whole([m])[0].tobytes() for m in ".,!?;:"}

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _ask(self, keys: list[str]) -> dict[str, bytes]:
        """Ids of pieces.  Those that begin with white space (and so end without) are asked for many at once."""
        alone = [k for k in keys if k[0] == "\0"]
        found = {k: v.tobytes() for k, v in zip(alone, self._whole([k[1:] for k in alone]), strict=True)}
        many = [k for k in keys if k[0] != "\0"] if alone else keys
        raw = [k if k[0] == "\n" else " " + k for k in many]
        size = pc.binary_length(pa.array(raw, pa.string())).to_numpy()
        step = 64
        for i, ids in zip(range(0, len(many), step), self._whole(["".join(raw[i : i + step]) for i in range(0, len(many), step)]), strict=True):
            at = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum(size[i : i + step]), side="left") + 1
            data, ends = ids.tobytes(), (4 * at).tolist()
            found.update(zip(many[i : i + step], map(data.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))
        return found

    def _keys(self, text: str) -> list[str] | None:
        if any(a in text for a in self.added):
            return None
        words = text.split()
        lined = "\n" in text
        if words and (text.replace("\n", " ") if lined else text) == " ".join(words) and "\0" not in text:
            # single spaces and newlines only, none at the ends
            keys = text.replace("\n", " \n").split(" ") if lined else words
            keys[0] = "\0" + keys[0]
            return keys
        if _ODD.search(text):
            return None
        return [p[1:] if p[0] == " " and len(p) > 1 and not p[1].isspace() and p[1] != "\0" else "\0" + p for p in _PIECE.findall(text)]

    def _new(self, keys: list[str]) -> list[bytes]:
        """Ids of keys never seen before."""
        # Letters, then a mark: two tokens' worth, told apart by the pre-tokeniser.
        built = [k for k in keys if k[-1] in self.marks and k[:-1].isalpha()]
        ask, cores, have = set(keys).difference(built), {k[:-1] for k in built}, {}
        cores = list(cores.difference(ask))
        if cores:
            at = self.known.find(*_hashes(pa.array(cores, pa.string()), np.zeros(len(cores), bool)))
            for c, p in zip(cores, at.tolist(), strict=True):
                if p < 0:
                    ask.add(c)
                else:
                    have[c] = self.known.ids[self.known.start[p] : self.known.start[p] + self.known.size[p]].tobytes()
        found = self._ask(list(ask)) if ask else {}
        have.update(found)
        found.update([(k, have[k[:-1]] + self.marks[k[-1]]) for k in built])
        return [found[k] for k in keys]

    def _pieces(self, words: pa.Array, bare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in a row, number of each piece's ids)."""
        known = self.known
        if len(known.h1) > self.limit or known.used > 8 * self.limit:
            known = self.known = Known()
        h1, h2 = _hashes(words, bare)
        coded = pa.array(h1.view(np.int64)).dictionary_encode()
        code, u1 = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_numpy().view(U64)
        first = np.zeros(len(u1), np.int64)
        first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
        u2 = h2[first]
        if not np.array_equal(u2[code], h2):
            raise ArithmeticError("two pieces of a block share a 64-bit hash")  # once in some 10^9 blocks; nothing wrong is written
        at = known.find(u1, u2)
        lost = np.flatnonzero(at < 0)
        if len(lost):
            keys = [f"\0{w}" if b else w for w, b in zip(words.take(pa.array(first[lost])).to_pylist(), bare[first[lost]].tolist(), strict=True)]
            known.add(u1[lost], u2[lost], self._new(keys))
            at = known.find(u1, u2)
        taken = known.size[at][code].astype(np.int64)
        ends = np.cumsum(taken)
        kind = np.int32 if max(known.used, int(ends[-1])) < 2**31 else np.int64
        return known.ids[np.repeat((known.start[at][code] - (ends - taken)).astype(kind), taken) + np.arange(int(ends[-1]), dtype=kind)], taken

    def encode_block(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of a string array, each text with ``end_id`` behind it; a null is an empty text."""
        texts = pc.fill_null(texts, "")
        uneven = pc.match_substring_regex(texts, _UNEVEN)
        for a in self.added:
            uneven = pc.or_(uneven, pc.match_substring(texts, a))
        uneven = uneven.to_numpy(zero_copy_only=False)
        plain, rest = np.flatnonzero(~uneven), np.flatnonzero(uneven).tolist()
        split = pc.split_pattern(pc.replace_substring(texts.take(pa.array(plain)), "\n", " \n"), " ")
        words, bounds = split.flatten(), split.offsets.to_numpy().astype(np.int64)
        bounds = bounds - bounds[0]
        bare = np.zeros(len(words), bool)
        bare[bounds[:-1]] = True  # no space before a text's first word
        keys = {i: self._keys(t) for i, t in zip(rest, texts.take(pa.array(rest, pa.int64())).to_pylist(), strict=True)}
        whole = {i: self._whole([texts[i].as_py()])[0] for i, k in keys.items() if k is None}
        cut = [i for i in rest if i not in whole]
        more = [k for i in cut for k in keys[i]]
        if more:
            zero = np.array([k[0] == "\0" for k in more], bool)
            words = pa.concat_arrays([words, pa.array([k[1:] if z else k for k, z in zip(more, zero.tolist(), strict=True)], pa.string())])
            bare = np.concatenate([bare, zero])
        bounds = np.concatenate([bounds, bounds[-1] + np.cumsum([len(keys[i]) for i in cut], dtype=np.int64)])
        order = np.concatenate([plain, np.array(cut, np.int64)])
        ids, taken = self._pieces(words, bare) if len(words) else (np.zeros(0, "<u4"), np.zeros(0, np.int64))
        at = np.concatenate([[0], np.cumsum(taken)])[bounds]
        counts = np.zeros(len(texts), np.int64)
        counts[order] = np.diff(at)
        for i, own in whole.items():
            counts[i] = len(own)
        offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(counts + 1, out=offsets[1:])
        out = np.full(int(offsets[-1]), end_id, "<u4")
        for k, i in enumerate(order.tolist()):
            out[offsets[i] : offsets[i] + counts[i]] = ids[at[k] : at[k + 1]]
        for i, own in whole.items():
            out[offsets[i] : offsets[i] + counts[i]] = own
        return out, offsets

    def encode_many(self, texts: list[str]) -> list[bytes]:
        ids, offsets = self.encode_block(pa.array(texts, pa.string()), 0)
        return [ids[a : b - 1].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


#: Bytes of text that are encoded at a time.
BLOCK_BYTES = 900_000


def blocks_of(texts: pa.Array):
    """(first, last) ranges of about BLOCK_BYTES of text each."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    first, n = 0, 0
    for i, s in enumerate(size.tolist()):
        n += s
        if n >= BLOCK_BYTES:
            yield first, i + 1
            first, n = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def public_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
