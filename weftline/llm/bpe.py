"""A byte-level BPE vocabulary as a lazily determinised transducer.

The encoding of every prefix of a piece ends in exactly one token: the one
that starts where a prefix ends whose own last token is *compatible* with it,
that is, which BPE would not have merged across the seam. So a finite state
suffices: the longest suffix of the input that still begins some token, and
the last tokens of the prefixes inside that suffix. A transition reads one
byte; tokens that all possible continuations share are emitted at once, which
bounds the lookahead by the longest token. States and transitions are made
when first met and kept.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterable, Iterator

import regex

#: Fixed value: the pattern that the public byte-level vocabularies were made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where a public vocabulary lies on this machine."""
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return f"/opt/tokenizers/{name}"


class Transducer:
    """Encodes text by the content of a rank file; results equal greedy lowest-rank merging."""

    def __init__(self, vocabulary: bytes, max_states: int = 400_000, max_memo: int = 400_000):
        self.ranks = {base64.b64decode(a): int(r) for a, r in (line.split() for line in vocabulary.splitlines() if line.strip())}
        self.bytes_of = {r: b for b, r in self.ranks.items()}
        self.starts = {b[:k] for b in self.ranks for k in range(1, len(b) + 1)}
        self.max_states, self.max_memo = max_states, max_memo
        self._parts: dict[int, tuple[int, int] | None] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        self._find = regex.compile(PATTERN).findall
        self.memo: dict[str, tuple[int, ...]] = {}
        self._reset()

    # -- merges ---------------------------------------------------------------

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte."""
        if token not in self._parts:
            word = self.bytes_of[token]
            seq = [word[i : i + 1] for i in range(len(word))]
            while len(seq) > 2:
                at = min(range(len(seq) - 1), key=lambda i: self.ranks.get(seq[i] + seq[i + 1], 1 << 30))
                seq[at : at + 2] = [seq[at] + seq[at + 1]]
            self._parts[token] = (self.ranks[seq[0]], self.ranks[seq[1]]) if len(seq) == 2 else None
        return self._parts[token]

    def fits(self, a: int, b: int) -> bool:
        """Whether a and b, side by side, stay two tokens.

        Both merges are undone from the latest to the earliest. At each step the
        two tokens at the seam would have merged if their pair has a rank below
        that of the merge undone last, because then it comes first.
        """
        key = (a, b)
        known = self._fits.get(key)
        if known is None:
            known = self._fits[key] = self._apart(a, b)
        return known

    def _apart(self, a: int, b: int) -> bool:
        bound = 1 << 30
        while True:
            merged = self.ranks.get(self.bytes_of[a] + self.bytes_of[b])
            if merged is not None and merged < bound and self._joins(a, b, merged):
                return False
            left, right = self.parts(a), self.parts(b)
            if left is None and right is None:
                return True
            # of two equal ranks the left one is merged first, so undone last
            if right is None or (left is not None and a > b):
                bound, a = a, left[1]
            else:
                bound, b = b + 1, right[0]

    def _joins(self, a: int, b: int, merged: int) -> bool:
        return self.parts(merged) == (a, b)

    # -- automaton ------------------------------------------------------------

    def _reset(self) -> None:
        start = (b"", -1, 0, ())
        self._ids = {start: 0}
        self._states = [start]
        self._next: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]
        self._ends: list[tuple[int, ...] | None] = [None]

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        suffix, last, root, chain = self._states[state]
        suffix += bytes((byte,))
        while suffix not in self.starts:
            suffix = suffix[1:]
        root -= 1
        ends = {e - 1: t for e, t in chain}
        for k in range(len(suffix)):
            token = self.ranks.get(suffix[k:])
            if token is None:
                continue
            start = k - len(suffix)
            before = last if start == root else ends.get(start)
            if before is None:
                continue
            if before < 0 or self.fits(before, token):
                ends[0] = token
                break
        # keep what a later token may follow, and the way back from there
        keep: set[int] = set()
        for e in ends:
            if e >= -len(suffix):
                while e != root and e not in keep:
                    keep.add(e)
                    e -= len(self.bytes_of[ends[e]])
        out = []
        while root < -len(suffix):
            first = [e for e in keep if e - len(self.bytes_of[ends[e]]) == root]
            if len(first) != 1:
                break
            root = first[0]
            last = ends[root]
            out.append(last)
            keep.discard(root)
        key = (suffix, last, root, tuple(sorted((e, ends[e]) for e in keep)))
        new = self._ids.get(key)
        if new is None:
            new = self._ids[key] = len(self._states)
            self._states.append(key)
            self._next.append({})
            self._ends.append(None)
        done = self._next[state][byte] = (new, tuple(out))
        return done

    def _flush(self, state: int) -> tuple[int, ...]:
        known = self._ends[state]
        if known is None:
            _, _, root, chain = self._states[state]
            ends, at, back = dict(chain), 0, []
            while at != root:
                back.append(ends[at])
                at -= len(self.bytes_of[ends[at]])
            known = self._ends[state] = tuple(reversed(back))
        return known

    def piece(self, data: bytes) -> tuple[int, ...]:
        """The tokens of one piece of text, read byte by byte."""
        if len(self._states) > self.max_states:
            self._reset()
        state, out, table = 0, [], self._next
        for byte in data:
            move = table[state].get(byte) or self._step(state, byte)
            state = move[0]
            if move[1]:
                out += move[1]
        return (*out, *self._flush(state))

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text, without special tokens."""
        memo, out = self.memo, []
        for piece in self._find(text):
            ids = memo.get(piece)
            if ids is None:
                ids = self.piece(piece.encode("utf-8", "replace"))
                if len(piece) <= 48:
                    if len(memo) >= self.max_memo:
                        memo.clear()
                    memo[piece] = ids
            out += ids
        return out

    # -- decoding -------------------------------------------------------------

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.decode_stream(ids))

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """The text of each id as far as its characters are complete."""
        machine = Utf8()
        for i in ids:
            if text := machine.feed(self.bytes_of[i]):
                yield text
        if text := machine.end():
            yield text


class Utf8:
    """An incremental UTF-8 decoder; each ill-formed sequence gives one U+FFFD."""

    def __init__(self) -> None:
        self.need, self.code, self.low, self.high = 0, 0, 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        if not self.need and data.isascii():
            return data.decode("ascii")
        out: list[str] = []
        for b in data:
            if self.need:
                if self.low <= b <= self.high:
                    self.low, self.high = 0x80, 0xBF
                    self.code = self.code << 6 | b & 0x3F
                    self.need -= 1
                    if not self.need:
                        out.append(chr(self.code))
                    continue
                out.append("�")
                self.need, self.low, self.high = 0, 0x80, 0xBF
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xDF:
                self.need, self.code = 1, b & 0x1F
            elif 0xE0 <= b <= 0xEF:
                self.need, self.code = 2, b & 0x0F
                self.low = 0xA0 if b == 0xE0 else 0x80
                self.high = 0x9F if b == 0xED else 0xBF
            elif 0xF0 <= b <= 0xF4:
                self.need, self.code = 3, b & 0x07
                self.low = 0x90 if b == 0xF0 else 0x80
                self.high = 0x8F if b == 0xF4 else 0xBF
            else:
                out.append("�")
        return "".join(out)

    def end(self) -> str:
        left, self.need = self.need, 0
        return "�" if left else ""


def read_vocabulary(path: str) -> bytes:
    """A rank file, read where the driver runs; executors get it by broadcast."""
    with open(path, "rb") as f:
        return f.read()


_LOADED: dict[int, Transducer] = {}


def transducer(vocabulary: bytes) -> Transducer:
    """One transducer for each vocabulary and worker."""
    key = zlib.crc32(vocabulary)
    if key not in _LOADED:
        _LOADED[key] = Transducer(vocabulary)
    return _LOADED[key]
