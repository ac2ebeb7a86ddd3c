"""Merging Burrows-Wheeler transforms of string shards by interleave refinement.

Each shard's suffixes (cyclic in their string, ended by an END byte that no UTF-8 text holds) are sorted to a fixed
depth on their own; what is kept of a shard is its transform: the two bytes before each suffix, and the step to the
slot of the suffix two bytes earlier. The merge never compares suffixes of
different shards: it interleaves the shards' slots and refines the interleave from depth k to k + 2 by a stable
counting sort on the transforms. Neighbours whose block (equal prefix of k bytes) or bytes differ fall into different
blocks, which gives the common prefixes. Settled slots, alone in their block, take no further part, and a slot starts
only if its string reaches back far enough; at the final depth every block is a repeated interval.
"""

from __future__ import annotations

import numpy as np

END = 0xFF


def collection(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(octets with an END after each string, starts, lengths with it)."""
    lengths = np.array([len(s) + 1 for s in strings], np.int64)
    octets = np.frombuffer(b"\xff".join(strings) + b"\xff", np.uint8)
    return octets, np.cumsum(lengths) - lengths, lengths


def _round(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per byte: the first place of its string, its offset, its string's length."""
    first = np.repeat(starts, lengths)
    return first, np.arange(int(lengths.sum())) + starts[0] - first, np.repeat(lengths, lengths)


def shard_order(octets: np.ndarray, starts: np.ndarray, lengths: np.ndarray, depth: int) -> np.ndarray:
    """The shard's suffixes in the order of their first depth bytes, by doubling the compared length."""
    first, offset, length = _round(starts, lengths)

    def ahead(by: int) -> np.ndarray:
        return first + (offset + by) % length

    grams = octets.astype(np.uint64)
    for step in (1, 2, 4):
        grams = grams << np.uint64(8 * step) | grams[ahead(step)]
    order = np.argsort(grams, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], grams[order][1:] != grams[order][:-1]]))
    reach = 8
    while reach < depth and rank[order[-1]] < len(order) - 1:
        pair = rank * len(order) + rank[ahead(min(reach, depth - reach))]
        order = np.argsort(pair, kind="stable")
        rank[order] = np.cumsum(np.concatenate([[0], pair[order][1:] != pair[order][:-1]]))
        reach = min(2 * reach, depth)
    return order


def repeated_blocks(octets: np.ndarray, starts: np.ndarray, lengths: np.ndarray, depth: int, shards: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(places in octets in merged order, block number of each) of all suffixes whose first depth bytes occur again:
    blocks are sets of two or more suffixes equal in depth bytes within their strings. depth must be even. Strings are
    dealt to shards in runs."""
    if depth % 2:
        raise ValueError("depth must be even")
    cuts = np.linspace(0, len(starts), min(shards, len(starts)) + 1).astype(int)
    first, offset, length = _round(starts, lengths)
    orders = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        low = int(starts[a])
        high = int(starts[b - 1] + lengths[b - 1])
        orders.append(low + shard_order(octets[low:high], starts[a:b] - low, lengths[a:b], depth))
    place = np.concatenate(orders)  # the shards' transforms, one after another
    one = octets[first[place] + (offset[place] - 1) % length[place]].astype(np.uint16)
    two = octets[first[place] + (offset[place] - 2) % length[place]].astype(np.uint16)
    before = two << 8 | one
    slot_of = np.empty(len(place), np.int32)
    slot_of[place] = np.arange(len(place), dtype=np.int32)
    step = slot_of[first[place] + (offset[place] - 2) % length[place]]
    slot = np.flatnonzero(offset[place] >= depth).astype(np.int32)
    block = np.zeros(len(slot), np.int32)
    for _ in range(depth // 2):
        if not len(slot):
            break
        symbol = before[slot]
        order = np.argsort(symbol, kind="stable")
        slot, symbol, block = step[slot[order]], symbol[order], block[order]
        fresh = np.ones(len(slot) + 1, bool)
        fresh[1:-1] = (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])
        shared = ~(fresh[:-1] & fresh[1:])
        slot, block = slot[shared], np.cumsum(fresh[:-1], dtype=np.int32)[shared]
    return place[slot], block
