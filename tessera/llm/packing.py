"""Hashes dealt to buckets as packed arrays: how large packets and buckets are, and runs.

A packet is what a task packs together, a bucket a range of the hashes. A packet's entries
for one bucket are one row. Packets and buckets both grow with the square root of the
input once rows would have fewer than ``ROW_ENTRIES`` entries, so that rows stay long and
their number stays below the input's size over that many entries, whatever the input.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

#: Entries of a packet in one bucket, at least, on average.
ROW_ENTRIES = 64
_HALF = np.uint64(32)


def packing(size: int, packet: int, bucket_bytes: int, least: int) -> tuple[int, int]:
    """Entries of a packet and number of buckets for so many bytes of text."""
    grow = max(1.0, math.sqrt(ROW_ENTRIES * size / (packet * bucket_bytes)))
    return int(packet * grow), max(least, math.ceil(size / (bucket_bytes * grow)))


def bucket_runs(hashes: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """Bucket, first and past-the-end place of each bucket's run in ascending 64-bit hashes."""
    if len(hashes):
        of = ((hashes >> _HALF) * np.uint64(buckets)) >> _HALF
        cuts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        yield from zip(of[cuts].tolist(), cuts.tolist(), np.append(cuts[1:], len(of)).tolist(), strict=True)
