"""Token ids of whole texts by public tokenizer files, with a word memo in front of the library.

A byte-pair tokenizer first cuts the text into pre-tokens and encodes each on its own. Both files
used here never join what stands on two sides of a lone space between non-spaces, so texts are cut
there, and each distinct chunk goes to the library's model once while a worker remembers it. Chunks
are found, hashed and looked up by array operations, not one by one. A hash only proposes an entry: its
bytes are compared with the chunk's, and a chunk that differs goes to the library. The ids are
those of encoding the whole text by the library with its defaults (a special token's name in a text is that
token); tests compare them.
"""

from __future__ import annotations

import os
import re

import numpy as np

#: Chunks that a worker remembers; beyond it, those seen once go first. Bounds its memory, changes no result.
MEMO = 1_400_000
#: The end of a document.
END = 2

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
#: White space beyond ASCII beside a space.
_WIDE = re.compile(rb"(?:\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2[\x80\x81][\x80-\xaf]|\xe3\x80\x80) | (?:\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2[\x80\x81][\x80-\xaf]|\xe3\x80\x80)")
#: Bytes that every such place holds.
_WIDE_HINTS = (b" \xc2\x85", b" \xc2\xa0", b"\xc2\x85 ", b"\xc2\xa0 ", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81", b"\xe3\x80\x80")
_WEIGHT = np.random.default_rng(4096).integers(1, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Marks that both files keep apart from the letters before them.
_MARKS = frozenset((b".", b",", b";", b":", b"!", b"?"))
_LATIN = re.compile("[\x21-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]+")


def _shown() -> dict[str, str]:
    """Byte-level models see bytes as printable characters: those that print as themselves, the others from code point 256 on."""
    plain = {b for r in ((33, 127), (161, 173), (174, 256)) for b in range(*r)}
    rest = (b for b in range(256) if b not in plain)
    return str.maketrans({chr(b): chr(256 + k) for k, b in enumerate(rest)})


_SHOWN = _shown()


class Encoder:
    """Ids of many texts at once. ``path``: a tokenizer file; its kind (byte-level or with word ends) decides where to cut."""

    def __init__(self, path: str, memo: int = MEMO) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        if self.library.get_vocab_size() > 1 << 16:
            raise ValueError("ids are kept in 16 bits")
        special = {t.content.encode(): i for i, t in self.library.get_added_tokens_decoder().items()}
        self.special = special
        self._special = re.compile(b"|".join(re.escape(t) for t in sorted(special, key=len, reverse=True))) if special else None
        self.drops_space = self.library.normalizer is not None
        self.memo = memo
        self.pieces: dict[bytes, list[int]] = {}  # of single marks
        self.model = self.library.model
        self._pattern = None
        self._reset()

    def _reset(self) -> None:
        self.size = 1 << max(10, (2 * self.memo).bit_length())
        self.keys, self.slots = np.zeros(self.size, np.uint64), np.zeros(self.size, np.int32)
        self.begin, self.length, self.seen = (np.zeros(1024, np.int32) for _ in range(3))
        self.hashes, self.known = np.zeros(1024, np.uint64), 0
        self.flat, self.used = np.zeros(4096, np.uint16), 0
        # each entry's chunk: 1 if it was a text's first, then its bytes
        self.text, self.text_used = np.zeros(16384, np.uint8), 0
        self.text_at, self.text_size = np.zeros(1024, np.int32), np.zeros(1024, np.int32)

    def parts(self, text: bytes) -> list[bytes | int]:
        """The text cut at names of special tokens, which are ids here."""
        out, at = [], 0
        for m in self._special.finditer(text):
            out += [text[at : m.start()], self.special[m.group()]]
            at = m.end()
        return [*out, text[at:]]

    # -- cutting -----------------------------------------------------------
    def _cut(self, buf: np.ndarray, doc_at: np.ndarray, doc_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, first of its text?) of the chunks; texts are parted by one space."""
        space = _WHITE[buf]
        if self.drops_space:
            starts = np.flatnonzero(~space & np.r_[True, space[:-1]])
            return starts, np.flatnonzero(~space & np.r_[space[1:], True]) + 1, np.zeros(len(starts), bool)
        inner = np.flatnonzero((buf[1:-1] == 32) & ~space[:-2] & ~space[2:]) + 1
        gaps = np.searchsorted(doc_end, inner)  # not the spaces that part texts
        inner = inner[doc_end[np.minimum(gaps, len(doc_end) - 1)] != inner]
        starts = np.concatenate([doc_at, inner + 1])
        order = np.argsort(starts, kind="stable")
        starts, first = starts[order], order < len(doc_at)
        ends = np.r_[starts[1:] - 1, doc_end[-1]]
        return starts, ends, first

    # -- the library -------------------------------------------------------
    def _pre_tokens(self, text: str) -> list[str]:
        """What the tokenizer's own pattern cuts a chunk into; a text that its normal form could change stays whole."""
        first = "" if self.drops_space else " " * text.startswith(" ")
        bare = text[len(first) :]
        if not self.drops_space or _LATIN.fullmatch(bare):
            bare = bare.lower() if self.drops_space else bare
            if bare.isalpha():
                return [first + bare]
            if bare[:-1].isalpha() and bare[-1] in ".,;:!?":
                return [first + bare[:-1], bare[-1]]
            if self._pattern is None:
                import regex

                words = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
                kept = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
                self._pattern = regex.compile(words if self.drops_space else kept)
            return self._pattern.findall(first + bare)
        return [text]

    def _ids(self, piece: str) -> list[int]:
        """One pre-token by the library's model, or one whole chunk by its full encoding."""
        if self.drops_space and not _LATIN.fullmatch(piece):
            return self.library.encode(piece, add_special_tokens=False).ids
        if not (piece.isascii() and piece.isalnum()):
            piece = piece.encode().decode("latin-1").translate(_SHOWN)
        return [t.id for t in self.model.tokenize(piece)]

    def _learn(self, chunks: list[bytes], firsts: list[bool]) -> list[list[int]]:
        """Ids of chunks that the memo lacks. A word with a mark behind it is encoded without it."""
        out, stems, parts = [], {}, {}
        kept, model, marks = not self.drops_space, self.model.tokenize, self.pieces
        for c, first in zip(chunks, firsts, strict=True):
            mark = c[-1:]
            stem = c[:-1] if mark in _MARKS and len(c) > 1 else c
            if not first and stem.isalpha():  # ASCII letters: one pre-token, shown as itself
                ids = stems.get(stem)
                if ids is None:
                    word = stem.decode()
                    ids = stems[stem] = [t.id for t in model("\u0120" + word if kept else word.lower())]
                if stem is not c:
                    got = marks.get(mark)
                    if got is None:
                        got = marks[mark] = self._ids(mark.decode())
                    ids = ids + got
            else:
                text = c.decode() if first or not kept else " " + c.decode()
                ids = []
                for p in self._pre_tokens(text):
                    got = parts.get(p)
                    if got is None:
                        got = parts[p] = self._ids(p)
                    ids += got
            out.append(ids)
        return out

    # -- memo --------------------------------------------------------------
    def _find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the entries with these hashes, -1 where there is none; linear probing for all at once."""
        out = np.full(len(h), -1, np.int32)
        slot = (h >> np.uint64(64 - self.size.bit_length() + 1)).astype(np.int64)
        rest = None
        while True:
            k = self.keys[slot]
            hit = k == (h if rest is None else h[rest])
            open_ = ~hit & (k != 0)
            if rest is None:
                out[hit] = self.slots[slot[hit]]
                rest = np.flatnonzero(open_)
            else:
                out[rest[hit]] = self.slots[slot[hit]]
                rest = rest[open_]
            if not len(rest):
                return out
            slot = (slot[open_] + 1) & (self.size - 1)

    def _insert(self, h: np.ndarray, numbers: np.ndarray) -> None:
        slot = (h >> np.uint64(64 - self.size.bit_length() + 1)).astype(np.int64)
        while len(h):
            free = self.keys[slot] == 0
            self.keys[slot[free]], self.slots[slot[free]] = h[free], numbers[free]
            lost = self.keys[slot] != h
            h, numbers, slot = h[lost], numbers[lost], (slot[lost] + 1) & (self.size - 1)

    def _store(self, h: np.ndarray, sizes: np.ndarray, ids: np.ndarray, text_sizes: np.ndarray, text: np.ndarray) -> None:
        n, k = self.known, len(h)
        while n + k > len(self.begin):
            self.begin, self.length, self.seen, self.hashes, self.text_at, self.text_size = (
                np.concatenate([a, np.zeros_like(a)]) for a in (self.begin, self.length, self.seen, self.hashes, self.text_at, self.text_size)
            )
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.text_used + len(text) > len(self.text):
            self.text = np.concatenate([self.text, np.zeros_like(self.text)])
        self.text[self.text_used : self.text_used + len(text)] = text
        self.text_at[n : n + k] = self.text_used + np.cumsum(text_sizes) - text_sizes
        self.text_size[n : n + k] = text_sizes
        self.text_used += len(text)
        self.flat[self.used : self.used + len(ids)] = ids
        self.begin[n : n + k] = self.used + np.cumsum(sizes) - sizes
        self.length[n : n + k], self.hashes[n : n + k] = sizes, h
        self.used, self.known = self.used + len(ids), n + k
        self._insert(h, np.arange(n, n + k, dtype=np.int32))

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of these entries, ends of each)."""
        sizes = self.length[at]
        return self.flat[_places(self.begin[at], sizes)], np.cumsum(sizes, dtype=np.int64)

    def _trim(self, more: int) -> None:
        """Make room: keep what was seen again since it was learnt, or nothing if that is most."""
        again = np.flatnonzero(self.seen[: self.known] > 1)
        if len(again) + more > self.memo:
            again = again[:0]
        h, sizes, text_sizes = self.hashes[again], self.length[again].astype(np.int64), self.text_size[again].astype(np.int64)
        ids, _ = self._gather(again)
        text = self.text[_places(self.text_at[again], text_sizes)]
        self._reset()
        self._store(h, sizes, ids, text_sizes, text)

    def _differs(self, at: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Numbers of the chunks that are not the text of the entries which their hashes found."""
        sizes = ends - starts
        wrong = (self.text_size[at] != sizes + 1) | (self.text[self.text_at[at]] != first)
        if wrong.any():
            same = np.flatnonzero(~wrong)
            at, starts, sizes = at[same], starts[same], sizes[same]
        else:
            same = None
        if len(at):
            own = np.zeros(len(buf) + 1, np.int8)
            own[starts] = 1
            own[starts[1:][starts[1:] == (starts + sizes)[:-1]]] = 0  # a chunk that begins where the last one ends
            own[starts + sizes] -= 1
            unlike = self.text[_places(self.text_at[at] + 1, sizes)] != buf[np.cumsum(own[:-1], dtype=np.int8).view(bool)]
            if unlike.any():
                bad = np.unique(np.searchsorted(np.cumsum(sizes), np.flatnonzero(unlike), "right"))
                wrong[bad if same is None else same[bad]] = True
        return np.flatnonzero(wrong)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in one uint16 array, number of ids of each text).

        Names of special tokens in a text are those tokens, as the library takes them; what lies between is encoded on its own.
        """
        joined = b" ".join(texts)
        if not any(t in joined for t in self.special):
            return self._encode(texts, joined)
        plan = [self.parts(t) for t in texts]
        plain = [p for x in plan for p in x if isinstance(p, bytes)]
        ids, counts = self._encode(plain, b" ".join(plain))
        plain = iter(np.split(ids, np.cumsum(counts)[:-1]))
        whole = [np.concatenate([next(plain) if isinstance(p, bytes) else np.array([p], np.uint16) for p in x]) for x in plan]
        return np.concatenate(whole), np.fromiter(map(len, whole), np.int64, len(whole))

    def _encode(self, texts: list[bytes], joined: bytes) -> tuple[np.ndarray, np.ndarray]:
        if not self.drops_space and not joined.isascii() and any(x in joined for x in _WIDE_HINTS) and any(map(_WIDE.search, texts)):  # rare white space that bytes alone don't show
            got = [np.array(self.library.encode(t.decode(), add_special_tokens=False).ids, np.uint16) for t in texts]
            return np.concatenate(got), np.fromiter(map(len, got), np.int64, len(got))
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        doc_at = np.cumsum(sizes + 1) - sizes - 1
        doc_end = doc_at + sizes
        if not joined:
            return np.zeros(0, np.uint16), np.zeros(len(texts), np.int64)
        buf = np.frombuffer(joined, np.uint8)
        starts, ends, first = self._cut(buf, doc_at, doc_end)
        full = ends > starts
        starts, ends, first = starts[full], ends[full], first[full]
        h = _hashes(buf, starts, ends, first)
        at = self._find(h)
        miss = np.flatnonzero(at < 0)
        if len(miss):
            new, where = np.unique(h[miss], return_index=True)
            if self.known + len(new) > self.memo:
                self._trim(len(new))
                at = self._find(h)
                miss = np.flatnonzero(at < 0)
                new, where = np.unique(h[miss], return_index=True)
            where = miss[where]
            chunks = [joined[b:e] for b, e in zip(starts[where].tolist(), ends[where].tolist(), strict=True)]
            got = self._learn(chunks, first[where].tolist())
            counts = np.fromiter(map(len, got), np.int64, len(got))
            self._make_room(len(new))
            text = np.frombuffer(b"".join(b"\1" + c if f else b"\0" + c for c, f in zip(chunks, first[where].tolist(), strict=True)), np.uint8)
            self._store(new, counts, np.fromiter((i for x in got for i in x), np.uint16, int(counts.sum())), ends[where] - starts[where] + 1, text)
            at[miss] = self._find(h[miss])
        self.seen[: self.known] += np.bincount(at, minlength=self.known).astype(np.int32)
        ids, upto = self._gather(at)
        wrong = self._differs(at, buf, starts, ends, first)
        if len(wrong):  # hashes met: these chunks go to the library and stay out of the memo
            own = self._learn([joined[b:e] for b, e in zip(starts[wrong].tolist(), ends[wrong].tolist(), strict=True)], first[wrong].tolist())
            parts = np.split(ids, upto[:-1])
            for i, x in zip(wrong.tolist(), own, strict=True):
                parts[i] = np.array(x, np.uint16)
            ids, upto = np.concatenate(parts), np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        bounds = np.concatenate([[0], upto])[np.searchsorted(starts, doc_end)]
        if self.known > 2 * self.memo or max(self.used, self.text_used) > 16 * self.memo:  # one batch alone was larger
            self._reset()
        return ids, np.diff(bounds, prepend=0)

    def _make_room(self, more: int) -> None:
        """A larger table if one batch needs it."""
        if 2 * (self.known + more) > self.size:
            while 2 * (self.known + more) > self.size:
                self.size *= 2
            self.keys, self.slots = np.zeros(self.size, np.uint64), np.zeros(self.size, np.int32)
            self._insert(self.hashes[: self.known], np.arange(self.known, dtype=np.int32))


def _places(at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """at[i], at[i] + 1, .. for sizes[i] steps of each i, one after another."""
    ends = np.cumsum(sizes, dtype=np.int64)
    where = np.repeat((at - (ends - sizes)).astype(np.int32), sizes)
    where += np.arange(len(where), dtype=np.int32)
    return where


def _hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each chunk, its length and whether it is a text's first; never 0.

    Differences of running sums over bytes, each weighted by its place in the chunk.
    """
    place = np.arange(len(buf), dtype=np.int32)
    place -= np.repeat(np.r_[0, starts].astype(np.int32), np.diff(np.r_[0, starts, len(buf)]))
    turn = (place >> 12).astype(np.uint64) if len(buf) > 4096 and place.max() > 4095 else None
    place &= 4095
    total = np.zeros(len(buf) + 1, np.uint64)
    mixed = _WEIGHT[place]
    if turn is not None:
        mixed += (mixed >> np.uint64(32)) * turn * np.uint64(0x9E3779B97F4A7C15)
    mixed *= buf
    np.cumsum(mixed, out=total[1:])
    h = total[ends] - total[starts]
    h += (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= first.astype(np.uint64) << np.uint64(40)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return np.where(h == 0, np.uint64(1), h)


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, memo: int | None = None) -> Encoder:
    """This worker's encoder for a tokenizer file."""
    key = (path, memo or MEMO)
    if key not in _encoders:
        _encoders.clear()  # one at a time
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def forget() -> None:
    """Free this worker's memos."""
    _encoders.clear()


def texts_of(column) -> list[bytes]:
    """An Arrow string column as bytes; null: empty."""
    import pyarrow as pa

    return [b"" if t is None else t for t in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


#: Text that one call of the encoder sees; longer texts are cut at lone spaces, and their ids joined again.
SLICE = 1 << 21
_CUT = re.compile(rb"(?<=[!-~]) (?=[!-~])")


def segments(text: bytes, size: int = SLICE) -> list[bytes]:
    """A long text cut before lone spaces, so that joining the parts' ids gives the text's ids."""
    out, at = [], 0
    while len(text) - at > size:
        m = _CUT.search(text, at + size)
        if not m:
            break
        out.append(text[at : m.start()])
        at = m.start()
    out.append(text[at:])
    return out


def encode_docs(path: str, texts: list[bytes], memo: int | None = None):
    """Yield the ids of each text in turn, as uint16 arrays without the end id."""
    enc, at = encoder(path, memo), 0
    while at < len(texts):
        upto, total = at, 0
        while upto < len(texts) and (upto == at or total + len(texts[upto]) <= SLICE):
            total += len(texts[upto])
            upto += 1
        if upto - at == 1 and total > SLICE:
            yield np.concatenate([enc.encode([s])[0] for s in segments(texts[at])])
        else:
            ids, counts = enc.encode(texts[at:upto])
            ends = np.cumsum(counts)
            for b, e in zip((ends - counts).tolist(), ends.tolist(), strict=True):
                yield ids[b:e]
        at = upto
