"""Bytes of texts as 64 letter classes, and windows of classes as numbers."""

from __future__ import annotations

import numpy as np

from .arrays import Texts

CLASSES = 64
START = 0  # before a text
CLASS = np.full(256, 60, np.int32)  # other ASCII
CLASS[97:123] = np.arange(1, 27)
CLASS[65:91] = np.arange(27, 53)
CLASS[48:58] = 53
CLASS[[0x20, 0x09]] = 54
CLASS[[0x0A, 0x0B, 0x0C, 0x0D]] = 55
CLASS[[ord(c) for c in ".,;:"]] = 56
CLASS[[ord(c) for c in "!?"]] = 57
CLASS[[ord(c) for c in "'\"()[]-_"]] = 58
CLASS[[ord(c) for c in "#*$%&|<>"]] = 59
CLASS[192:] = 61  # first bytes of other letters
CLASS[128:192:2] = 62  # their further bytes
CLASS[129:192:2] = 63


def windows(texts: Texts, order: int) -> np.ndarray:
    """For each byte the number of the window of ``order`` classes that ends there, in its own text."""
    data, at = texts.data, texts.at
    pad = order - 1
    place = np.arange(len(data)) + pad * (np.repeat(np.arange(len(texts)), np.diff(at)) + 1)
    classes = np.full(len(data) + pad * len(texts), START, np.int32)
    classes[place] = CLASS[data]
    out = np.zeros(len(data), np.int32)
    for k in range(order):
        out <<= 6
        out |= classes[place - (pad - k)]
    return out


def sums(values: np.ndarray, texts: Texts) -> np.ndarray:
    """Sum of a value per byte over each text."""
    out = np.zeros(len(texts))
    full = np.flatnonzero(np.diff(texts.at))
    if len(full):
        out[full] = np.add.reduceat(values, texts.at[full])
    return out
