"""Token ids of many texts, each distinct piece encoded once by the tokenizers library.

A byte-level BPE tokenizer never joins what its pre-tokenizer has cut. Texts are cut here only where it always cuts: a
run of non-spaces starts a piece (together with one space before it), such a run is cut once more between a Latin letter
and the first ASCII digit or sign in it, and white space apart from that is pieces of its own. So the ids of the pieces
side by side are those of the whole text. Pieces are found with numpy in the UTF-8 bytes of a block of texts, known by
two independent 64-bit hashes of their bytes, and looked up in an open-addressing table of bounded size; only pieces
not met before reach the library. A text with a space beyond ASCII, or with the string of an added token (which the
library cuts out before all else), is given to the library as a whole, and so is every text if the tokenizer file names
another pre-tokenizer, a normalizer or a model with options (``cuts_as_assumed``).
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa

from .shingles import mix64, text_blocks

CAPACITY = 1 << 19
JOINED_WORDS = 2_000
BLOCK_BYTES = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = True
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_SIGN = np.zeros(256, bool)
_SIGN[0x21:0x7F] = True
_SIGN &= ~_LETTER
_LATIN_TAIL = np.zeros(256, bool)  # second byte of a two-byte Latin letter after 0xC3
_LATIN_TAIL[0x80:0xC0] = True
_LATIN_TAIL[[0x97, 0xB7]] = False
_SPACE_LEAD = np.zeros(256, bool)
_SPACE_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True
#: Unicode's spaces beyond ASCII, as UTF-8.
_FAR_SPACES = {chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)}
#: A piece that the pre-tokenizer keeps as one word wherever it stands, as it begins with its own space.
_WORD = re.compile(r" [A-Za-zÀ-ÖØ-öø-ÿ]+\Z")

_RNG = np.random.Generator(np.random.PCG64(77))
_VALUES = _RNG.integers(1, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    for inverse in (False, True):
        have = _POWERS.get((base, inverse), np.ones(1, np.uint64))
        step = pow(base, -1, 1 << 64) if inverse else base
        while len(have) < n:
            have = np.concatenate([have, have * np.uint64(pow(step, len(have), 1 << 64))])
        _POWERS[base, inverse] = have
    return _POWERS[base, False], _POWERS[base, True]


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First bytes of all pieces of the texts that lie end to end in ``data``."""
    n = len(data)
    space = _SPACE[data]
    head = np.zeros(n, bool)  # first byte of a text
    head[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    after_space = np.zeros(n, bool)
    after_space[1:] = space[:-1]
    after_space &= ~head
    run = ~space & (after_space | head)  # first byte of a run of non-spaces
    mark = head | (space & ~after_space)
    runs = np.flatnonzero(run)
    behind = runs[after_space[runs]]
    mark[behind - 1] = True
    mark[behind[data[behind - 1] != 0x20]] = True
    signs = np.flatnonzero(_SIGN[data])
    if len(signs) and len(runs):
        of = np.searchsorted(runs, signs, "right") - 1
        first = signs[np.concatenate([[True], of[1:] != of[:-1]])]
        first = first[~run[first]]
        before = data[first - 1]
        latin = _LETTER[before] | (_LATIN_TAIL[before] & (data[np.maximum(first - 2, 0)] == 0xC3))
        mark[first[latin]] = True
    return np.flatnonzero(mark)


def far_spaces(data: np.ndarray) -> np.ndarray:
    """Positions of spaces beyond ASCII."""
    leads = np.flatnonzero(_SPACE_LEAD[data])
    return np.array([k for k in leads.tolist() if data[k : k + 2].tobytes() in _FAR_SPACES or data[k : k + 3].tobytes() in _FAR_SPACES], np.int64) if len(leads) else leads


def cuts_as_assumed(path: str) -> bool:
    """Whether a tokenizer file is plain byte-level BPE with the pre-tokenizer that the cuts above rely on."""
    with open(path, encoding="utf-8") as file:
        made = json.load(file)
    cut, model = made.get("pre_tokenizer") or {}, made.get("model") or {}
    plain = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True) and not made.get("normalizer") and not made.get("truncation") and not made.get("padding")
    return plain and model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))


class PieceEncoder:
    """Encodes blocks of texts with a tokenizers file."""

    def __init__(self, path: str, capacity: int = CAPACITY):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are parallel already, and threads hold memory of their own
        from tokenizers import Tokenizer

        self.tokenizer, self.by_pieces = Tokenizer.from_file(path), cuts_as_assumed(path)
        self.added = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content)
        self.added_bytes = re.compile(b"|".join(re.escape(t.encode()) for t in self.added)) if self.added else None
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.capacity, self.slots = capacity, 1 << (2 * capacity - 1).bit_length()
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(self.slots, np.uint64)
        self.checks = np.zeros(self.slots, np.uint64)
        self.begin = np.zeros(self.slots, np.int64)
        self.size = np.zeros(self.slots, np.int32)
        self.pool = np.zeros(1 << 16, f"<u{self.width}")
        self.used = self.count = 0

    def whole_text(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, f"<u{self.width}")

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """Ids of each text; null counts as empty."""
        out: list[np.ndarray] = []
        if not self.by_pieces:
            return [self.whole_text(text.as_py() or "") for text in column]
        for _, _, data, offsets in text_blocks(column, BLOCK_BYTES):
            out += self._block(data, offsets)
        return out

    def _block(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        texts = len(offsets) - 1
        if not len(data):
            return [self.pool[:0]] * texts
        starts = piece_starts(data, offsets)
        edges = np.unique(np.searchsorted(starts, np.arange(0, len(data), BLOCK_BYTES)))  # of a very long text, parts
        edges = [*edges[edges < len(starts)].tolist(), len(starts)]
        parts = []
        for a, b in zip(edges, edges[1:], strict=False):
            low, high = int(starts[a]), int(starts[b]) if b < len(starts) else len(data)
            parts.append(self._pieces(data[low:high], starts[a:b] - low))
        ids, size, known = (np.concatenate(column) for column in zip(*parts, strict=True))
        total = np.concatenate([[0], np.cumsum(size)])
        cut = total[np.searchsorted(starts, offsets)]
        made = [ids[cut[k] : cut[k + 1]] for k in range(texts)]
        # Texts that the table can't answer for go to the library as a whole.
        odd = np.concatenate([starts[~known], far_spaces(data), self._added_tokens(data)])
        for k in np.unique(np.searchsorted(offsets, odd, "right") - 1).tolist():
            made[k] = self.whole_text(data[offsets[k] : offsets[k + 1]].tobytes().decode())
        return made

    def _added_tokens(self, data: np.ndarray) -> np.ndarray:
        """Where strings of added tokens begin; one that runs on into the next text does no harm."""
        return np.array([m.start() for m in self.added_bytes.finditer(data)] if self.added_bytes else [], np.int64)

    def _pieces(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of pieces side by side, the number of each piece's ids, and whether the table knows it."""
        ends = np.append(starts[1:], len(data))
        keys, checks = self._hashes(data, starts)
        slot = self._find(keys, checks)
        missing = np.flatnonzero(slot < 0)
        if len(missing):
            _, first = np.unique(keys[missing], return_index=True)
            new = missing[first]
            if self.count + len(new) > self.capacity:
                self._forget()
                _, new = np.unique(keys, return_index=True)
                new = new[: self.capacity]
            self._learn(data, starts[new], ends[new], keys[new], checks[new])
            slot = self._find(keys, checks)
        size = np.where(slot < 0, 0, self.size[slot])
        before = np.cumsum(size) - size
        return self.pool[np.repeat(self.begin[slot] - before, size) + np.arange(size.sum())], size, slot >= 0

    def _hashes(self, data: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
        out = []
        for values, base in zip(_VALUES, _BASES, strict=True):
            up, down = _powers(base, len(data))
            out.append(mix64(np.add.reduceat(values[data] * up[: len(data)], starts) * down[starts]) | np.uint64(1))
        return out

    def _find(self, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """Slot of each piece; -1 where it is unknown, or where another piece has its key."""
        mask = np.uint64(self.slots - 1)
        slot = ((keys >> np.uint64(20)) & mask).astype(np.int64)
        found = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            there = self.keys[slot]
            hit = there == keys[todo]
            good = hit & (self.checks[slot] == checks[todo])
            found[todo[good]] = slot[good]
            on = ~hit & (there != 0)
            todo, slot = todo[on], (slot[on] + 1) & (self.slots - 1)
        return found

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray, checks: np.ndarray) -> None:
        raw = data.tobytes()
        pieces = [raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        order, sizes, parts = [], [], []
        words = [k for k, piece in enumerate(pieces) if _WORD.match(piece)]
        for j in range(0, len(words), JOINED_WORDS):
            some = words[j : j + JOINED_WORDS]
            joined = "".join([pieces[k] for k in some])
            if any(t in joined for t in self.added):
                continue
            made = self.tokenizer.encode(joined, add_special_tokens=False)
            cuts = np.flatnonzero(np.diff(np.array(made.word_ids))) + 1
            if len(cuts) + 1 == len(some):
                order += some
                parts.append(np.array(made.ids, self.pool.dtype))
                sizes.append(np.diff(np.concatenate([[0], cuts, [len(made.ids)]])))
        known = set(order)
        rest = [k for k in range(len(pieces)) if k not in known]
        for k, made in zip(rest, self.tokenizer.encode_batch_fast([pieces[k] for k in rest], add_special_tokens=False), strict=True):
            order.append(k)
            parts.append(np.array(made.ids, self.pool.dtype))
            sizes.append([len(made.ids)])
        sizes, flat = np.concatenate(sizes), np.concatenate(parts)
        keys, checks = keys[order], checks[order]
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(flat)] = flat
        begin = self.used + np.concatenate([[0], np.cumsum(sizes[:-1])])
        self.used += len(flat)
        self.count += len(pieces)
        mask = self.slots - 1
        slot, todo = ((keys >> np.uint64(20)) & np.uint64(mask)).astype(np.int64), np.arange(len(keys))
        while len(todo):
            free = np.flatnonzero(self.keys[slot] == 0)
            _, one = np.unique(slot[free], return_index=True)
            placed = free[one]
            to, who = slot[placed], todo[placed]
            self.keys[to], self.checks[to], self.begin[to], self.size[to] = keys[who], checks[who], begin[who], sizes[who]
            left = np.ones(len(todo), bool)
            left[placed] = False
            todo, slot = todo[left], (slot[left] + 1) & mask
