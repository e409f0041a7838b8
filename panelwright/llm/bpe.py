"""Byte-level BPE in numpy: pre-tokens, and rank-synchronous merging of ragged batches of them."""

from __future__ import annotations

import json
from collections.abc import Iterable
from functools import lru_cache
from pathlib import Path

import numpy as np
import regex

# The public byte-level pre-token pattern, with white space as the tokenizers library
# counts it (Python's classes also take the four ASCII separators).
_SPACE = r"\t\n\x0B\f\r\x20\x85\p{Z}"
PATTERN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\x20?\p{{L}}+|\x20?\p{{N}}+|\x20?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")

_NONE = np.iinfo(np.int32).max


def byte_characters() -> list[str]:
    """The public byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class ByteBPE:
    """The vocabulary and merges of a tokenizers file of kind byte-level BPE.

    ``merge`` needs each merge to make a token that no other merge makes, as trained vocabularies
    have it; then a pair that a merge brings about ranks behind that merge, and all occurrences of
    a sequence's lowest pair can be merged in one step. The constructor checks it.
    """

    def __init__(self, path: str, merges: int | None = None):
        """``merges``: how many of the file's merges count, the first ones; ids of tokens they don't make stay unused."""
        data = json.loads(Path(path).read_text())
        vocab, merges = data["model"]["vocab"], data["model"]["merges"][:merges]
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.size = 1 + max([*vocab.values(), *self.special.values()])
        self.token_bytes = [b""] * self.size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.byte_ids = np.array([vocab[c] for c in byte_characters()], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        if len(np.unique(made)) != len(made) or np.isin(made, self.byte_ids).any():
            raise ValueError("two merges make the same token")
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks, self.made = keys[order], order.astype(np.int32), made
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], _NONE)

    def merge(self, pretokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pre-tokens one after another, and the offsets at which each begins (one more at the end).

        All sequences lie in one ragged array. In each round every sequence's lowest-ranked pair is
        merged at all its places; sequences without a pair leave the array.
        """
        lengths = np.fromiter(map(len, pretokens), np.int64, len(pretokens))
        ids = self.byte_ids[np.frombuffer(b"".join(pretokens), np.uint8)]
        owner = np.repeat(np.arange(len(pretokens), dtype=np.int32), lengths)
        rank = np.full(len(ids), _NONE, np.int32)
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        rank[inner] = self._ranks(ids[inner], ids[inner + 1])
        done_ids, done_owner = [], []
        while len(ids):
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            low = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(ids))))
            over = low == _NONE
            if over.any():
                done_ids.append(ids[over])
                done_owner.append(owner[over])
                live = ~over
                ids, owner, rank, low = ids[live], owner[live], rank[live], low[live]
                if not len(ids):
                    break
            at = np.flatnonzero(rank == low)
            # Overlapping places (a a a) merge from the left, every other one of a run.
            follows = np.concatenate([[False], (np.diff(at) == 1) & (owner[at[1:]] == owner[at[:-1]])])
            if follows.any():
                nth = np.arange(len(at))
                head = np.maximum.accumulate(np.where(follows, 0, nth))
                at = at[(nth - head) % 2 == 0]
            ids[at] = self.made[rank[at]]
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            ids, owner, rank = ids[stay], owner[stay], rank[stay]
            at = at - np.arange(len(at))
            near = np.zeros(len(ids), bool)
            near[at], near[at[at > 0] - 1] = True, True
            touched = np.flatnonzero(near)
            last = touched + 1 >= len(ids)
            follow = np.where(last, 0, touched + 1)
            pair = ~last & (owner[touched] == owner[follow])
            rank[touched] = np.where(pair, self._ranks(ids[touched], ids[follow]), _NONE)
        if done_ids:
            ids, owner = np.concatenate(done_ids), np.concatenate(done_owner)
            order = np.argsort(owner, kind="stable")
            ids, owner = ids[order], owner[order]
        counts = np.bincount(owner, minlength=len(pretokens))
        return ids, np.concatenate([[0], np.cumsum(counts)])


@lru_cache(maxsize=2)
def load_part(path: str, merges: int) -> ByteBPE:
    """The smaller vocabulary that the file's first merges make: bytes are ids below 256, merge k makes 256 + k."""
    model = ByteBPE(path, merges)
    place = np.full(model.size, -1, np.int64)
    place[model.byte_ids], place[model.made] = np.arange(256), 256 + np.arange(len(model.made))
    left, right = np.divmod(model.pair_keys, model.size)
    model.pair_keys = place[left] * model.size + place[right]
    order = np.argsort(model.pair_keys)
    model.pair_keys, model.pair_ranks = model.pair_keys[order], model.pair_ranks[order]
    model.byte_ids, model.made = place[model.byte_ids].astype(np.int32), place[model.made].astype(np.int32)
    return model


@lru_cache(maxsize=2)
def load(path: str) -> ByteBPE:
    return ByteBPE(path)


def chunks(text: str) -> list[str]:
    """The text cut before single blanks between visible characters; no pre-token spans such a cut.

    A chunk's leading blank is left out: all but the first have one.
    """
    pieces = text.split(" ")
    if all(pieces) and not any(p[0].isspace() or p[-1].isspace() for p in pieces):
        return pieces
    whole = [pieces[0]]
    for piece in pieces[1:]:
        last = whole[-1]
        if last and piece and not last[-1].isspace() and not piece[0].isspace():
            whole.append(piece)
        else:
            whole[-1] = f"{last} {piece}"
    return whole


def parts(model: ByteBPE, text: str) -> Iterable[tuple[str, bool]]:
    """The text between special tokens, and these: ``(string, special)``, empty strings left out."""
    if model.special_pattern is None or not model.special_pattern.search(text):
        if text:
            yield text, False
        return
    end = 0
    for match in model.special_pattern.finditer(text):
        if match.start() > end:
            yield text[end : match.start()], False
        yield match[0], True
        end = match.end()
    if end < len(text):
        yield text[end:], False
