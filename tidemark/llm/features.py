"""Hashed text features in numpy, many texts at a time."""

from __future__ import annotations

import numpy as np

from tidemark.llm.common import Prefix, mixed

# byte classes: 0 white space, 1 letter or any byte beyond ASCII, 2 digit, 3 sign
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(0x80, 0x100)]] = 1
_CLASS[[*range(ord("0"), ord("9") + 1)]] = 2


def joined(texts: list[bytes], gap: bytes = b"\n") -> tuple[np.ndarray, np.ndarray]:
    """All texts in one byte array, one separator after each, and their starts."""
    sizes = np.fromiter((len(t) + len(gap) for t in texts), np.int64, len(texts))
    data = np.frombuffer(gap.join(texts) + gap, np.uint8) if texts else np.zeros(0, np.uint8)
    return data, np.concatenate(([0], np.cumsum(sizes)))


def word_tokens(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of one byte class, white space left out."""
    kinds = _CLASS[data]
    edge = np.flatnonzero(np.diff(kinds)) + 1
    starts = np.concatenate(([0], edge)) if len(data) else np.zeros(0, np.int64)
    ends = np.concatenate((edge, [len(data)])) if len(data) else np.zeros(0, np.int64)
    keep = kinds[starts] != 0 if len(data) else slice(0)
    return starts[keep], ends[keep]


def lowered(data: np.ndarray) -> np.ndarray:
    upper = (data >= 65) & (data <= 90)
    return data + (upper.astype(np.uint8) << 5)


def word_ngrams(texts: list[bytes], bits: int, longest: int = 2
                ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (text number, slot, weight) of hashed word n-grams.

    Words are runs of letters, digits or signs of the original case; each word also counts under
    its shape (kind, case and length class), so unseen words still tell something.  The weight
    of a slot is 1 + log(count), and the weights of a text have length one.
    """
    data, offsets = joined(texts)
    starts, ends = word_tokens(data)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0)
    of = np.searchsorted(offsets, starts, "right") - 1
    words = Prefix(data).ranges(starts, ends)
    first = data[starts]
    upper = np.concatenate(([0], np.cumsum((data >= 65) & (data <= 90))))
    capitals = upper[ends] - upper[starts]
    size = ends - starts
    case = np.where(capitals == 0, 0, np.where(capitals == size, 1, np.where(capitals > 2, 2, 3)))
    shape = mixed((_CLASS[first].astype(np.uint64) << np.uint64(8))
                  | (case.astype(np.uint64) << np.uint64(4))
                  | np.minimum(size, 12).astype(np.uint64) // np.uint64(4))
    rows, slots = [], []
    mask = np.uint64((1 << bits) - 1)
    for salt, series in ((1, words), (2, shape)):
        run = series + np.uint64(salt)
        for n in range(1, longest + 1):
            if n > 1:
                if len(series) < n:
                    break
                run = mixed(run[:-1] * np.uint64(0x9E3779B97F4A7C15)
                            + series[n - 1:] + np.uint64(n * 16 + salt))
                same = of[:len(run)] == of[n - 1:]
            else:
                same = np.ones(len(run), bool)
            value = mixed(run)
            rows.append(of[:len(run)][same])
            slots.append((value & mask)[same].astype(np.int64))
    # the same word twice in a row
    again = (words[1:] == words[:-1]) & (of[1:] == of[:-1])
    rows.append(of[1:][again])
    slots.append(np.full(int(again.sum()), 7, np.int64))
    key, count = np.unique((np.concatenate(rows) << bits) | np.concatenate(slots),
                           return_counts=True)
    row, slot = key >> bits, key & ((1 << bits) - 1)
    weight = 1.0 + np.log(count)
    norm = np.sqrt(np.bincount(row, weight * weight, len(texts)))
    return row, slot, weight / norm[row]


def subword_slots(texts: list[bytes], bits: int, sizes: tuple[int, ...] = (2, 3, 4)
                  ) -> tuple[np.ndarray, np.ndarray]:
    """(text number, slot) of every hashed byte n-gram inside a word, word ends included.

    Only letters count: any other byte is a word end.
    """
    data, offsets = joined(texts, b"  ")
    data = np.where(_CLASS[data] == 1, lowered(data), np.uint8(32))
    of = np.repeat(np.arange(len(texts)), np.diff(offsets))
    wide = data.astype(np.uint64)
    letter = data != 32
    rows, slots = [], []
    run = wide
    for n in range(2, max(sizes) + 1):
        if len(wide) < n:
            break
        run = (run[:-1] << np.uint64(8)) | wide[n - 1:]
        if n not in sizes:
            continue
        count = len(run)
        inside = letter[:count] | letter[n - 1:]
        for k in range(1, n - 1):
            inside &= letter[k:k + count]
        inside &= of[:count] == of[n - 1:]
        rows.append(of[:count][inside])
        slots.append((mixed(run[inside] + np.uint64(n)) >> np.uint64(64 - bits)).astype(np.int64))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row, slot = np.concatenate(rows), np.concatenate(slots)
    order = np.argsort(row, kind="stable")
    return row[order], slot[order]
