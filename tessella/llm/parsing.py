"""Corpus order of texts by prefix-free parsing.

Positions where a rolling hash of GRAM bytes hits a trigger cut each text into phrases; a phrase
runs from one trigger to the end of the next, so no suffix of a phrase that is longer than a trigger
is the beginning of another. The dictionary holds each distinct phrase once, the parse the rank of
the phrase at each place. The suffix array of the dictionary ranks what is left of a place's own
phrase, the suffix array of the parse ranks all phrases after it, and both together are the order
of the texts' suffixes, the end of a text before any byte.

Ranks take four bytes, and what is needed once goes before the next sort, so that ordering holds
about 30 bytes for each byte of the texts at most.
"""

from __future__ import annotations

import numpy as np

#: Bytes of a trigger; one gram in so many is one (a power of two).
GRAM, EVERY = 8, 32
#: Grams that are hashed at once.
HASHED = 1 << 18
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _dense(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks from 1 of the keys, equal keys alike, and how many there are. The keys are overwritten."""
    rank = np.zeros(len(keys), np.uint32)
    if not len(keys):
        return rank, 0
    order = np.argsort(keys)
    keys[:] = keys[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    rank[order] = np.cumsum(new, dtype=np.uint32)
    return rank, int(np.count_nonzero(new))


def _doubled(rank: np.ndarray, kinds: int, left: np.ndarray, depth: int, most: int) -> np.ndarray:
    """Ranks of suffixes from the ranks of their first `depth` symbols. left: symbols from each
    place to its end, beyond which there is nothing; ranks look `most` symbols far at least."""
    while depth < most and kinds < len(rank):
        keys = rank.astype(np.uint64)
        keys <<= np.uint64(32)
        keys[: len(rank) - depth] |= np.where(left[: len(rank) - depth] > depth, rank[depth:], np.uint32(0))
        before, (rank, kinds) = kinds, _dense(keys)
        if kinds == before:  # no class was split, so none ever will be
            break
        depth *= 2
    return rank


def _ends(offsets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the text of each place ends."""
    return offsets[np.searchsorted(offsets, at, "right")]


def _triggers(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    found = [np.zeros(0, np.int64)]
    for at in range(0, len(data) - GRAM + 1, HASHED):
        part = data[at : at + HASHED + GRAM - 1]
        h = np.zeros(len(part) - GRAM + 1, np.uint64)
        for k in range(GRAM):
            h = h * _MULTIPLIER + (part[k : k + len(h)].astype(np.uint64) + np.uint64(1))
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        found.append(np.flatnonzero((h >> np.uint64(40)) & np.uint64(EVERY - 1) == 0) + at)
    hit = np.concatenate(found)
    return hit[hit + GRAM <= _ends(offsets, hit)]


def _dictionary_ranks(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Where each word starts in their concatenation, and the rank of each suffix within its word."""
    sizes = np.array([len(w) for w in words], np.int64)
    starts = np.cumsum(sizes) - sizes
    raw = np.frombuffer(b"".join(words), np.uint8)
    left = np.repeat((starts + sizes).astype(np.int32), sizes)
    left -= np.arange(len(raw), dtype=np.int32)
    key = np.zeros(len(raw), np.uint64)
    for k in range(7):  # nine bits a symbol
        key <<= np.uint64(9)
        n = max(0, len(raw) - k)
        key[:n] |= np.where(left[:n] > k, raw[k : k + n] + np.uint16(1), np.uint16(0))
    rank, kinds = _dense(key)
    del key, raw
    return starts, _doubled(rank, kinds, left, 7, int(sizes.max(initial=0)))


def corpus_order(data: np.ndarray, offsets: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The places (positions in data) in the order of the suffixes of their texts that begin there.

    Text i is data[offsets[i] : offsets[i + 1]]. Suffixes that are equal may come in any order.
    """
    if not len(places):
        return np.zeros(0, np.int64)
    begin = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], _triggers(data, offsets)]))
    follows, ends = np.append(begin[1:], len(data)), _ends(offsets, begin)
    last = follows >= ends
    end, raw = np.where(last, ends, follows + GRAM), data.data
    number: dict[bytes, int] = {}
    parse = np.array([number.setdefault(bytes(raw[a:b]), len(number)) for a, b in zip(begin.tolist(), end.tolist())], np.int64)
    words = list(number)
    del number
    rank = np.empty(len(words), np.uint32)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(1, len(words) + 1, dtype=np.uint32)
    closing = np.flatnonzero(last)
    left = closing[np.searchsorted(closing, np.arange(len(begin)))] - np.arange(len(begin)) + 1
    ordered = _doubled(rank[parse], len(words), left, 1, int(left.max()))
    own = np.searchsorted(begin, places, "right") - 1
    used, which = np.unique(parse[own], return_inverse=True)
    starts, suffix = _dictionary_ranks([words[i] for i in used.tolist()])
    keys = suffix[starts[which] + places - begin[own]].astype(np.uint64)
    del which, suffix
    keys <<= np.uint64(32)
    keys |= np.where(last[own], np.uint32(0), ordered[np.minimum(own + 1, len(begin) - 1)])
    del own
    return places[np.argsort(keys, kind="stable")]


def _same(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether `length` bytes at a and b are the same, byte for byte."""
    out, open_ = np.zeros(len(a), bool), np.arange(len(a))
    if length < 8:
        for k in range(length):
            open_ = open_[data[a[open_] + k] == data[b[open_] + k]]
    else:
        eight = np.ndarray(max(0, len(data) - 7), np.uint64, data, strides=(1,))  # the eight bytes at each place, where they lie
        for k in [*range(0, length - 8, 8), length - 8]:
            open_ = open_[eight[a[open_] + k] == eight[b[open_] + k]]
    out[open_] = True
    return out


def repeated_places(data: np.ndarray, offsets: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """Those of the places, in order, at which `length` bytes begin that also begin at another one.

    Each place has so many bytes left in its text. Equal strings are neighbours in corpus order, so
    each place is compared with the one before and the one after.
    """
    order = corpus_order(data, offsets, places)
    same = _same(data, order[:-1], order[1:], length)
    hit = np.zeros(len(order), bool)
    hit[:-1] |= same
    hit[1:] |= same
    return np.sort(order[hit])
