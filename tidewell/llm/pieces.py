"""SentencePiece encoding and decoding by a max-plus parallel scan over chunks of a text.

The model's segmentation (byte-pair merges by piece score) is unique, and a sequence of pieces is the segmentation of its
text exactly if each neighbouring pair is that of the pair's text. So encoding is a best path: a piece costs nothing, a pair that the model
would segment otherwise is forbidden (minus infinity). Blanks start words, no piece reaches over a word's start from before it, so
words are independent: short ones are merged as the model does, all new ones of some texts side by side in arrays, and remembered, with their bytes, by
hash; the pieces of long ones are found along the path.

A text of `CHUNK` characters or more is cut at multiples of it, words or not; one that many rows have is encoded once and joined back by its SHA-256. The state at a cut is the piece that lies over
it or ends at it. A chunk yields a transfer matrix from the states at its left cut to those at its right cut, together with
the ids of its pieces; every piece belongs to the chunk in which it starts. The matrices of a text are combined by an associative max-plus
product in a tree, up to the whole and down again, which gives each chunk its entry and exit state; then each chunk
picks its ids independently. Chunks are spread over the cluster; a group of one text's chunks holds its ids and small
matrices only, which the length of a text bounds. Texts of one chunk are encoded where they are read.

Defined results: a null text has null ids, an empty one has none; characters outside the vocabulary become byte pieces;
U+2581 is a blank; repeated rows stay; rows with a null id are encoded like others.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat
from operator import add
from struct import pack
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

CHUNK = 1 << 16
BLANK = "▁"
NEVER = -np.inf
#: Of two parts that no piece has side by side.
APART = -1
#: Words remembered by a worker before it starts anew, and their bytes, on average; pairs remembered.
MEMORY, WIDTH, PAIRS = 240_000, 32, 400_000
#: Parts of fewer than KEEP characters are merged, others found along the path; BLOCK side by side in one array, fewer than FEW one by one.
KEEP, BLOCK, FEW = 48, 4096, 64
#: Bytes of texts that are encoded at a time; a text is not cut for it.
TOGETHER = 1 << 18
#: Characters that a chunk is shown beyond its cuts: at least the longest piece.
MARGIN = 64
ONE = (1,)
START = re.compile(f"(?<=[^{BLANK}])(?={BLANK})")


class Ways(NamedTuple):
    """Packed ids of a chunk by way: from an entry to the first word's start, from there to the last one's, from there to an exit; or direct."""

    heads: dict[tuple, bytes]
    middle: bytes
    tails: dict[tuple, bytes]
    direct: dict[tuple, bytes]

    def matrix(self) -> dict[tuple, float]:
        return {(e, x): 0.0 for e in self.heads for x in self.tails} | dict.fromkeys(self.direct, 0.0)

    def ids(self, entry: tuple, leave: tuple) -> bytes:
        found = self.direct.get((entry, leave))
        return self.heads[entry] + self.middle + self.tails[leave] if found is None else found


class Slots:
    """Distinct numbers by keys of 64 bits, each at the first free slot from its key's hash on; -1 for keys that are not there."""

    def __init__(self, size: int):
        bits = (2 * size).bit_length()
        self.size, self.shift, self.mask = 0, np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.zeros(1 << bits, dtype=np.int64), np.full(1 << bits, -1, dtype=np.int64)

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add distinct keys that are not there."""
        if 2 * (self.size + len(keys)) > len(self.values):
            held = np.flatnonzero(self.values != -1)
            keys, values = np.append(self.keys[held], keys), np.append(self.values[held], values)
            self.__init__(len(keys))
        self.size += len(keys)
        at = self._hash(keys)
        while len(keys):
            free = np.flatnonzero(self.values[at] == -1)
            self.values[at[free]] = values[free]
            placed = free[self.values[at[free]] == values[free]]
            self.keys[at[placed]] = keys[placed]
            left = np.ones(len(keys), dtype=bool)
            left[placed] = False
            keys, values, at = keys[left], values[left], at[left] + 1 & self.mask

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._hash(keys)
        found = self.values[at]
        other = np.flatnonzero((found != -1) & (self.keys[at] != keys))
        while len(other):
            at[other] = at[other] + 1 & self.mask
            found[other] = now = self.values[at[other]]
            other = other[(now != -1) & (self.keys[at[other]] != keys[other])]
        return found


class Rows:
    """Arrays of any lengths, one after the other."""

    def __init__(self, kind: str):
        self.values, self.starts, self.size = np.zeros(1 << 16, dtype=kind), np.zeros(1 << 12, dtype=np.int64), 0

    def add(self, rows: list[bytes]) -> None:
        values = np.frombuffer(b"".join(rows), dtype=self.values.dtype)
        ends = self.starts[self.size] + np.cumsum(np.fromiter(map(len, rows), np.int64, len(rows))) // self.values.itemsize
        self.values = self._room(self.values, ends[-1])
        self.values[ends[-1] - len(values) : ends[-1]] = values
        self.starts = self._room(self.starts, self.size + len(rows) + 1)
        self.starts[self.size + 1 : self.size + len(rows) + 1] = ends
        self.size += len(rows)

    @staticmethod
    def _room(held: np.ndarray, size: int) -> np.ndarray:
        return held if size <= len(held) else np.append(held, np.zeros(max(len(held), size - len(held)), dtype=held.dtype))

    def lengths(self, at: np.ndarray) -> np.ndarray:
        return self.starts[at + 1] - self.starts[at]

    def joined(self, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """So many values from the start of each row, one after the other."""
        ends = np.cumsum(lengths)
        return self.values.take(np.repeat(self.starts[at] - ends + lengths, lengths) + np.arange(ends[-1]), mode="clip")


class Pieces:
    """A byte-pair SentencePiece model with byte fallback."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        normal, byte = 1, 6
        if model.trainer_spec.model_type != 2 or model.normalizer_spec.name != "identity" or not model.trainer_spec.byte_fallback:
            raise ValueError("a byte-pair model with byte fallback and no normalisation is needed")
        self.prefix = model.normalizer_spec.add_dummy_prefix
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == normal}
        self.scores = {p.piece: p.score for p in model.pieces if p.type == normal}
        bytes_at = [i for i, p in enumerate(model.pieces) if p.type == byte]
        self.byte_ids = {int(model.pieces[i].piece[3:5], 16): i for i in bytes_at}
        if any(BLANK in p.lstrip(BLANK) for p in self.ids):
            raise ValueError("a piece reaches over a word's start")
        self.longest = max(map(len, self.ids))
        raw = [b""] * len(model.pieces)
        for i, p in enumerate(model.pieces):
            raw[i] = p.piece.replace(BLANK, " ").encode() if p.type == normal else b""
        for value, i in self.byte_ids.items():
            raw[i] = bytes([value])
        #: Bytes of all pieces, one after the other.
        self.bytes, self.sizes = np.frombuffer(b"".join(raw), dtype=np.uint8), np.array([len(r) for r in raw])
        self.offsets = np.cumsum(self.sizes) - self.sizes
        random = np.random.default_rng(1)
        #: For the hash of a word's bytes: a number for each byte, powers of an odd number and those of its inverse.
        self.mixed, self.powers = random.integers(0, 1 << 64, 256, dtype=np.uint64), [np.ones(1, dtype=np.uint64)] * 2
        self._forget()
        self.pairs: dict[tuple[str, str], bool] = {}
        self._spines()
        self._table()
        beside = [(p[i], p[i + 1]) for p in self.ids for i in range(len(p) - 1)]
        #: Characters that no piece has behind a letter or digit; whether a line's end is a piece by itself.
        self.marks = "".join({c for p in self.ids for c in p if not c.isalnum()} - {b for a, b in beside if a.isalnum()} - {BLANK})
        self.lines = not any("\n" in pair for pair in beside)
        self.processor = SentencePieceProcessor(model_file=path)

    # --- pieces ---

    def is_piece(self, part: str) -> bool:
        return part in self.ids or len(part) == 1

    def ids_of(self, part: str) -> list[int]:
        found = self.ids.get(part)
        return [found] if found is not None else [self.byte_ids[b] for b in part.encode()]

    def packed(self, parts: list[str]) -> bytes:
        ids = self.ids
        try:
            found = [ids[p] for p in parts]
        except KeyError:
            found = [i for p in parts for i in self.ids_of(p)]
        return pack(f"<{len(found)}i", *found)

    def merge(self, text: str, steps: list | None = None) -> list[str]:
        """Pieces of a short text by merging the best pair, leftmost first, until none is left."""
        parts, score = list(text), self.scores.get
        ranks = list(map(score, map(add, parts, parts[1:]), repeat(NEVER)))
        while ranks and (best := max(ranks)) != NEVER:
            i = ranks.index(best)
            if steps is not None:
                steps.append((parts[i], parts[i + 1]))
            parts[i] += parts.pop(i + 1)
            del ranks[i]
            if i < len(ranks):
                ranks[i] = score(parts[i] + parts[i + 1], NEVER)
            if i:
                ranks[i - 1] = score(parts[i - 1] + parts[i], NEVER)
        return parts

    def _table(self) -> None:
        """Numbers for the parts that merging goes through (0: none), and all pairs of parts that can be merged, by hash.

        A pair's value has its rank above and its number below, with room for a place between them. Pairs of characters that a piece has side by
        side, but that are not merged by themselves, have values below APART; others are not in the table.
        """
        parts = dict.fromkeys([*self.scores, *(c for p in self.scores for c in p), *map(chr, range(128))])
        number = {p: n for n, p in enumerate(parts, 1)}
        keys, scores, made = array("q"), array("d"), array("i")
        for p, score in self.scores.items():
            for i in range(1, len(p)):
                left, right = number.get(p[:i]), number.get(p[i:])
                if left and right:
                    keys.append(left << 32 | right)
                    scores.append(score)
                    made.append(number[p])
        ranks = np.unique(np.frombuffer(scores), return_inverse=True)[1]
        self.pair_parts, self.pair_bits = np.frombuffer(made, dtype=np.int32), len(made).bit_length()
        self.place_bits = 63 - self.pair_bits - int(ranks.max(initial=0)).bit_length()
        values = ranks << self.pair_bits + self.place_bits | np.arange(len(made))
        beside = {number[a] << 32 | number[b] for p in self.scores for a, b in zip(p, p[1:])}.difference(keys)
        self.pair_values = Slots(2 * (len(keys) + len(beside)))
        self.pair_values.put(np.frombuffer(keys, dtype=np.int64), values)
        self.pair_values.put(np.array(list(beside), dtype=np.int64), APART - 1 - np.arange(len(beside)))
        single = {ord(p): n for p, n in number.items() if len(p) == 1}
        self.char_parts = np.zeros(max(single) + 2, dtype=np.int32)  # the last one: characters beyond
        self.char_parts[list(single)] = list(single.values())
        # A character of one byte is that byte's piece, if it has no own; others without a piece have -1.
        self.part_ids = np.array([-1, *(self.ids.get(p, self.byte_ids[ord(p)] if p < "\x80" and len(p) == 1 else -1) for p in parts)], dtype="<i4")

    def _pairs_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Values of pairs of parts."""
        return self.pair_values.get(left.astype(np.int64) << 32 | right)

    def merge_all(self, texts: list[str]) -> list[bytes | None]:
        """Packed ids of short texts, merged as `merge` does, a step of all texts of a block at a time; None where a character is several byte pieces."""
        return [ids for a in range(0, len(texts), BLOCK) for ids in self._merge_block(texts[a : a + BLOCK])]

    def _merge_block(self, texts: list[str]) -> list[bytes | None]:
        """Each step merges the best pair of each run of parts, the leftmost of equals; runs end where no piece has both neighbours."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        bounds = np.append(0, np.cumsum(sizes))
        points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4")
        #: The part that starts at each character; -1 where none starts any more.
        starting = self.char_parts[np.minimum(points, len(self.char_parts) - 1)]
        pairs = np.append(self._pairs_of(starting[:-1], starting[1:]), APART)[: len(points)]
        pairs[bounds[1:][sizes > 0] - 1] = APART
        counts = np.diff(np.flatnonzero(pairs == APART) + 1, prepend=0)
        parts, place = starting.copy(), np.arange(len(points))
        leftmost = np.arange(len(points), 0, -1) << self.pair_bits
        while len(counts):
            first = np.cumsum(counts) - counts
            best = np.maximum.reduceat(pairs | leftmost[: len(pairs)], first)
            go = best >= 0
            keep = np.repeat(go, counts)
            best, first, counts = best[go], first[go], counts[go] - 1
            at = len(points) - (best >> self.pair_bits & (1 << self.place_bits) - 1)
            # The best pair becomes one part; what lies behind moves up, and the pairs beside it are looked up again.
            parts[at] = starting[place[at]] = self.pair_parts[best & (1 << self.pair_bits) - 1]
            starting[place[at + 1]] = -1
            keep[at + 1] = False
            parts, place, pairs = parts[keep], place[keep], pairs[keep]
            inside, at = at - first, at - first + np.cumsum(counts) - counts
            pairs[at] = APART
            beside = np.concatenate((at[inside > 0] - 1, at[inside < counts - 1]))
            pairs[beside] = self._pairs_of(parts[beside], parts[beside + 1])
        left = starting >= 0
        ids = self.part_ids[starting[left]]
        stops = np.append(0, np.cumsum(left))[bounds]
        raw, cuts = ids.tobytes(), (4 * stops).tolist()
        out: list[bytes | None] = [raw[a:b] for a, b in zip(cuts, cuts[1:])]
        for n in set((np.searchsorted(stops, np.flatnonzero(ids < 0), side="right") - 1).tolist()):
            out[n] = None
        return out

    def _merged(self, words: list[str]) -> list[bytes]:
        """Packed ids of distinct words with their blanks, merged side by side; long ones by their parts."""
        cut = {w: self.split(w) for w in words if len(w) >= KEEP}
        parts = list({*chain.from_iterable(cut.values())})
        short = [p if len(p) < KEEP else "" for p in (*words, *parts)]
        made = self.merge_all(short) if len(short) >= FEW else [None] * len(short)
        found = {p: ids or self.short(p) for p, ids in zip(parts, made[len(words) :])}
        return [ids or (b"".join([found[p] for p in cut[w]]) if w in cut else self.short(w)) for w, ids in zip(words, made)]

    # --- remembered words ---

    def _forget(self) -> None:
        self.known, self.word_bytes, self.word_ids = Slots(1 << 12), Rows("u1"), Rows("<i4")

    def _add(self, words: list[bytes]) -> np.ndarray:
        size = self.word_bytes.size
        self.word_ids.add(self._merged([w.decode().replace(" ", BLANK) for w in words]))
        self.word_bytes.add(words)
        return np.arange(size, size + len(words))

    def _powers(self, size: int) -> list[np.ndarray]:
        if size > len(self.powers[0]):
            odd = 0x9E3779B97F4A7C15
            self.powers = [np.cumprod(np.append(np.uint64(1), np.full(2 * size - 1, n, dtype=np.uint64))) for n in (odd, pow(odd, -1, 1 << 64))]
        return self.powers

    def together(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of texts (UTF-8, blanks as spaces) that start and end at words' starts.

        All words, each with the blanks before it, are looked up by hash and compared byte by byte; new ones are merged side by side.
        """
        if self.known.size >= MEMORY or self.word_bytes.starts[self.word_bytes.size] >= WIDTH * MEMORY:
            self._forget()
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends, whole = np.cumsum(sizes), b"".join(texts)
        if not whole:
            return [np.zeros(0, dtype="<i4") for _ in texts]
        raw = np.frombuffer(whole, dtype=np.uint8)
        blank = raw == 32
        starts = blank & ~np.append(False, blank[:-1])
        starts[(ends - sizes)[sizes > 0]] = True
        first = np.flatnonzero(starts)
        lengths = np.diff(first, append=len(raw))
        up, down = self._powers(len(raw))
        sums = np.append(np.uint64(0), np.cumsum(self.mixed[raw] * up[: len(raw)]))
        keys = ((sums[first + lengths] - sums[first]) * down[first]).view(np.int64)
        at = self.known.get(keys)
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh, where = np.unique(keys[new], return_index=True)
            self.known.put(fresh, self._add([whole[a:b] for a, b in zip(first[new[where]].tolist(), (first + lengths)[new[where]].tolist())]))
            at[new] = self.known.get(keys[new])
        # Words of one hash: all but the first are not remembered.
        other = self.word_bytes.lengths(at) != lengths
        other[np.searchsorted(first, np.flatnonzero(self.word_bytes.joined(at, lengths) != raw), side="right") - 1] = True
        for n in np.flatnonzero(other).tolist():
            at[n] = self._add([whole[first[n] : first[n] + lengths[n]]])[0]
        counts = self.word_ids.lengths(at)
        ids = self.word_ids.joined(at, counts)
        stops = np.append(0, np.cumsum(counts))[np.searchsorted(first, np.append(0, ends))].tolist()
        return [ids[a:b] for a, b in zip(stops, stops[1:])]

    def learn(self, texts: list[str]) -> None:
        """Remember the words of prepared texts."""
        self.together([t.replace(BLANK, " ").encode() for t in texts])

    def _spines(self) -> None:
        """How each piece grows at its left and at its right edge: the edge's part after each merge that changes it, with the merge's score.

        Pieces that merging does not make of their own text are never used; they are left out of `ids`.
        """
        self.left: dict[str, list[tuple[float, str]]] = {}
        self.right: dict[str, list[tuple[float, str]]] = {}
        for piece in sorted(self.ids, key=len):
            steps: list = []
            if self.merge(piece, steps) != [piece]:
                del self.ids[piece]
                continue
            if len(piece) > 1:
                a, b = steps[-1]
                self.left[piece] = [*self.left.get(a, []), (self.scores[piece], piece)]
                self.right[piece] = [*self.right.get(b, []), (self.scores[piece], piece)]
        heads: dict[str, set[int]] = {}
        tails: dict[str, set[int]] = {}
        for piece in self.ids:
            tails.setdefault(piece[-2:], {1}).add(len(piece))
            heads.setdefault(piece[:3], {1}).add(len(piece))
        for head in heads:
            if head[:2] in self.ids:
                heads[head].add(min(2, len(head)))
        #: Lengths of the pieces that start with the next three (at a text's end: fewer) characters, and that end with two, longest first.
        self.heads, self.tails = ({k: sorted(v, reverse=True) for k, v in x.items()} for x in (heads, tails))

    def agree(self, left: str, right: str) -> bool:
        """Whether the model segments the text of two pieces into these two."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            blanks = BLANK * 2 in left + right  # pieces of blanks share a score
            known = self.pairs[left, right] = self.merge(left + right) == [left, right] if blanks else self._apart(left, right)
        return known

    def _apart(self, left: str, right: str) -> bool:
        """Whether no merge over the border comes before the merges that make the two pieces.

        The parts at the border change in the order of the scores; a merge over the border wins against later changes, against
        an equal one only on its right.
        """
        scores = self.scores
        ours, theirs = self.right.get(left, ()), self.left.get(right, ())
        i = j = 0
        a, b = left[-1], right[0]
        while True:
            next_a = ours[i][0] if i < len(ours) else NEVER
            next_b = theirs[j][0] if j < len(theirs) else NEVER
            over = scores.get(a + b)
            if over is not None and over > next_a and over >= next_b:
                return False
            if next_a == next_b == NEVER:
                return True
            if next_a >= next_b:
                a, i = ours[i][1], i + 1
            else:
                b, j = theirs[j][1], j + 1

    # --- best paths ---

    def paths(self, text: str, begin: int, end: int, last: str | None) -> dict[int, str]:
        """For each place in begin..end that a path from `begin`, entered by the piece `last`, can reach: its last piece."""
        reached: dict[int, str] = {begin: last or ""}
        ids, tails, agree = self.ids, self.tails, self.agree
        for at in range(begin + 1, end + 1):
            for size in tails.get(text[at - 2 : at], ONE) if at - begin > 1 else ONE:
                before = reached.get(at - size)
                if before is not None:
                    part = text[at - size : at]
                    if size == 1 or part in ids:
                        if not before or agree(before, part):
                            reached[at] = part
                            break
        return reached

    @staticmethod
    def back(reached: dict[int, str], begin: int, end: int) -> list[str]:
        parts = []
        while end > begin:
            parts.append(reached[end])
            end -= len(parts[-1])
        return parts[::-1]

    def path(self, text: str) -> list[str]:
        """The one path through a text: pieces from the left, the longest first, back from dead ends."""
        ids, heads, pairs, agree = self.ids, self.heads, self.pairs, self.agree
        parts: list[str] = []
        at, size, dead, before = 0, len(text), set(), ""
        options: list = []
        ways = iter(heads.get(text[:3]) or heads.get(text[:2], ONE))
        while at < size:
            for step in ways:
                part = text[at : at + step]
                if part not in ids and step > 1 or len(part) < step:
                    continue
                if before:
                    fits = pairs.get((before, part))
                    if not (agree(before, part) if fits is None else fits):
                        continue
                if dead and (at + step, part) in dead:
                    continue
                parts.append(part)
                options.append(ways)
                at += step
                before = part
                head = text[at : at + 3]
                ways = iter(heads.get(head) or heads.get(head[:2], ONE))
                break
            else:
                if not parts:
                    raise ValueError("no path leads through a text")
                dead.add((at, before))
                ways = options.pop()
                at -= len(parts.pop())
                before = parts[-1] if parts else ""
        return parts

    def short(self, text: str) -> bytes:
        """Packed ids of a text without word starts inside: short ones merged as the model does, long ones along the path."""
        return self.packed(self.merge(text) if len(text) < KEEP else self.path(text))

    def split(self, text: str) -> list[str]:
        """Lines' ends, and what lies between them: letters apart from the marks behind them, where no piece reaches over either."""
        if not self.lines:
            return [text]
        out = []
        for n, line in enumerate(text.split("\n")):
            if n:
                out.append("\n")
            core = line.rstrip(self.marks)
            if core != line and core[-1:].isalnum():
                out += [core, line[len(core) :]]
            elif line:
                out.append(line)
        return out

    def whole(self, text: str) -> bytes:
        """Packed ids of a text (blanks as U+2581) that starts and ends at word starts."""
        return self.together([text.replace(BLANK, " ").encode()])[0].tobytes()

    def straddling(self, text: str, cut: int) -> list[tuple[int, int]]:
        """Pieces (start, end) of the text that lie over the cut or end at it."""
        found = []
        for start in range(max(0, cut - self.longest), cut):
            for end in range(cut, min(len(text), start + self.longest) + 1):
                if self.is_piece(text[start:end]):
                    found.append((start, end))
        return found

    def chunk(self, text: str, left: int, right: int, first: bool, final: bool) -> Ways:
        """The ways through text[left:right]: its transfer matrix, and the ids of the pieces that start in the chunk.

        `text` reaches beyond both cuts by the longest piece, if the text does. States are (start, end) relative to
        the cut; () is the text's start or end. Ways that no path takes are missing: minus infinity.
        """
        inside = [m.start() for m in START.finditer(text, left, right)]
        entries = [((), left, "")] if first else [((s - left, e - left), e, text[s:e]) for s, e in self.straddling(text, left)]
        if inside:  # all ways meet at the first word's start and part at the last one's
            heads = {}
            for entry, at, piece in entries:
                reached = self.paths(text, at, inside[0], piece or None) if at <= inside[0] else {}
                if inside[0] in reached:
                    heads[entry] = self.packed(self.back(reached, at, inside[0]))
            return Ways(heads, self.whole(text[inside[0] : inside[-1]]), self._tail(text, inside[-1], right, "", final), {})
        direct = {}
        for entry, at, piece in entries:
            ways = self._tail(text, at, right, piece, final) if at <= right else {(at - len(piece) - right, at - right): b""}
            direct |= {(entry, leave): ids for leave, ids in ways.items()}
        return Ways({}, b"", {}, direct)

    def _tail(self, text: str, begin: int, right: int, piece: str, final: bool) -> dict[tuple, bytes]:
        """States at the right cut that paths from `begin` reach, with the ids on the way, those of the state's own piece included."""
        reached = self.paths(text, begin, right, piece or None)
        if final:
            return {(): self.packed(self.back(reached, begin, right))} if right in reached else {}
        ways = {}
        if begin == right:  # the entry piece ends at this cut as well
            return {(-len(piece), 0): b""}
        for start, end in self.straddling(text, right):
            if start < begin or start not in reached:
                continue
            part, before = text[start:end], reached[start]
            if not before or self.agree(before, part):
                ways[start - right, end - right] = self.packed([*self.back(reached, begin, start), part])
        return ways

    # --- whole texts ---

    def prepared(self, text: str) -> str:
        return ((BLANK if self.prefix else "") + text.replace(" ", BLANK)) if text else ""

    def encode(self, text: str, chunk: int = CHUNK) -> np.ndarray:
        """Ids of a text; the same steps as on the cluster, in one place."""
        text = self.prepared(text)
        cuts = [*range(0, len(text), chunk), len(text)] if text else [0]
        parts = list(zip(cuts, cuts[1:]))
        if len(parts) < 2:
            return np.frombuffer(self.whole(text), dtype="<i4")
        return np.frombuffer(resolve([self.window(text, a, b) for a, b in parts]), dtype="<i4")

    def window(self, text: str, left: int, right: int) -> Ways:
        low, high = max(0, left - self.longest), min(len(text), right + self.longest)
        return self.chunk(text[low:high], left - low, right - low, left == 0, right == len(text))

    def decode(self, ids: np.ndarray) -> str:
        first, sizes = self.offsets[ids], self.sizes[ids]
        raw = self.bytes[np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())].tobytes()
        return raw.decode(errors="replace")[1 if self.prefix and raw[:1] == b" " else 0 :]


def product(a: dict, b: dict) -> dict:
    """Max-plus product of two transfer matrices {(entry, exit): weight}; associative."""
    by_entry: dict = {}
    for (entry, leave), weight in b.items():
        by_entry.setdefault(entry, []).append((leave, weight))
    out: dict = {}
    for (entry, middle), weight in a.items():
        for leave, more in by_entry.get(middle, ()):
            if weight + more > out.get((entry, leave), NEVER):
                out[entry, leave] = weight + more
    return out


def states(matrices: list[dict]) -> list[tuple]:
    """(entry, exit) of each matrix on the best path through all: products up a tree, choices down again."""
    levels = [matrices]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([product(*low[i : i + 2]) if i + 1 < len(low) else low[i] for i in range(0, len(low), 2)])
    if not levels[-1][0]:
        raise ValueError("no path leads through a text")
    chosen = [max(levels[-1][0], key=levels[-1][0].get)]
    for low in reversed(levels[:-1]):
        spread = []
        for k, (entry, leave) in enumerate(chosen):
            pair = low[2 * k : 2 * k + 2]
            if len(pair) == 1:
                spread.append((entry, leave))
                continue
            first, second = pair
            ways = [(w + second[m, leave], m) for (e, m), w in first.items() if e == entry and (m, leave) in second]
            middle = max(ways)[1]
            spread += [(entry, middle), (middle, leave)]
        chosen = spread
    return chosen


def resolve(ways: list[Ways]) -> bytes:
    """Packed ids of a text from its chunks' ways."""
    return b"".join(w.ids(*s) for w, s in zip(ways, states([w.matrix() for w in ways])))


@lru_cache(maxsize=2)
def loaded(path: str) -> Pieces:
    return Pieces(path)


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """`id`, `ids` (array of int) for each row; `path` names the model file, found on every machine."""
    import pickle

    small_batches(docs.sparkSession)
    path = path or model_path()
    if chunk < MARGIN:
        raise ValueError(f"a chunk has at least {MARGIN} characters")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    length = F.length("text")

    @F.pandas_udf("array<int>")
    def short(texts: pd.Series) -> pd.Series:
        model = loaded(path)
        found: list = [None] * len(texts)
        group, size = [], 0
        for n, text in enumerate(texts):
            if text is not None:
                group.append((n, model.prepared(text).replace(BLANK, " ").encode()))
                size += len(group[-1][1])
            if group and (size >= TOGETHER or n == len(texts) - 1):
                for (row, _), ids in zip(group, model.together([raw for _, raw in group])):
                    found[row] = ids
                group, size = [], 0
        return pd.Series(found, dtype=object)

    near = rows.where(length.isNull() | (length < chunk)).select("id", "text", short("text").alias("ids"))

    far = rows.where(length >= chunk)
    mark = F.sha2(F.col("text").cast("binary"), 256).alias("mark")
    # Cut once, from front to back; a chunk gets the ends of its neighbours.
    cut = far.select(mark, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{chunk}}}"), 0).alias("parts"))
    windows = F.transform(
        "parts",
        lambda part, at: F.struct(
            F.coalesce(F.right(F.get("parts", at - 1), F.lit(MARGIN)), F.lit("")).alias("before"), part.alias("part"),
            F.coalesce(F.left(F.get("parts", at + 1), F.lit(MARGIN)), F.lit("")).alias("after"), (at == F.size("parts") - 1).alias("final"),
        ),
    )
    # A text that many rows have is encoded once.
    chunks = cut.select("mark", F.posexplode(windows).alias("at", "window")).dropDuplicates(["mark", "at"]).select("mark", "at", "window.*")

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = loaded(path)
        if model.longest > MARGIN:
            raise ValueError(f"a piece of {model.longest} characters reaches beyond a margin of {MARGIN}")
        for batch in batches:
            out = []
            for at, before, part, after, final in zip(*(batch[c] for c in ("at", "before", "part", "after", "final"))):
                before = BLANK if at == 0 and model.prefix else before.replace(" ", BLANK)
                left = 0 if at == 0 else len(before)
                text = before + part.replace(" ", BLANK) + after.replace(" ", BLANK)
                out.append(pickle.dumps(tuple(model.chunk(text, left, len(before) + len(part), at == 0, final))))
            yield pd.DataFrame({"mark": batch["mark"], "at": batch["at"], "ways": out})

    measured = chunks.mapInPandas(measure, "mark string, at int, ways binary")

    def join(group: pd.DataFrame) -> pd.DataFrame:
        ways = [Ways(*pickle.loads(w)) for w in group.sort_values("at")["ways"]]
        return pd.DataFrame({"mark": group["mark"].iat[0], "ids": [np.frombuffer(resolve(ways), dtype="<i4")]})

    joined = measured.groupBy("mark").applyInPandas(join, "mark string, ids array<int>")
    return near.select("id", "ids").unionAll(far.select("id", mark).join(joined, "mark").select("id", "ids"))


def decoded(ids_col: str = "ids", path: str | None = None) -> Column:
    """The text of an array of ids."""
    path = path or model_path()

    @F.pandas_udf("string")
    def run(ids: pd.Series) -> pd.Series:
        model = loaded(path)
        return pd.Series([None if i is None else model.decode(np.asarray(i)) for i in ids], dtype=object)

    return run(F.col(ids_col))
