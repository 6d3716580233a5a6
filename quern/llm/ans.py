"""The rANS coder: numbers in independent interleaved blocks that share a frequency table.

A block of BLOCK_IDS numbers is coded in LANES streams and depends on nothing but the table. Blocks of a group are
coded in lockstep with numpy. State: 64 bits, renormalised by 32-bit words; frequencies add up to 2**SCALE.
A segment of more than 2**SCALE different numbers has no table; its blocks hold the numbers plainly.
"""

from __future__ import annotations

import zlib

import numpy as np

from quern.llm import blocks

SCALE = 20
LOW = np.uint64(1 << 31)
LANES = 64
BLOCK_IDS = 1 << 16
#: Blocks coded in lockstep.
GROUP = 64


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts as frequencies of at least 1 that add up to 2**SCALE."""
    total, size = int(counts.sum()), 1 << SCALE
    if len(counts) > size:
        raise ValueError("more symbols than the table has room for")
    out = np.maximum(1, counts.astype(np.float64) * size / total).astype(np.int64)
    over = int(out.sum()) - size
    for i in np.argsort(-out, kind="stable"):  # the largest take what rounding left
        if over == 0:
            break
        step = min(over, int(out[i]) - 1) if over > 0 else over
        out[i] -= step
        over -= step
    return out


class Table:
    """Frequencies and starts of the symbols that occur, numbered in ascending order."""

    def __init__(self, symbols: np.ndarray, freq: np.ndarray):
        self.symbols = symbols
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self._slots = None

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._slots


def _shape(n: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(ids of each block, block of each lane, steps) of a run of n ids."""
    sizes = np.full(-(-n // BLOCK_IDS), BLOCK_IDS)
    if n % BLOCK_IDS:
        sizes[-1] = n % BLOCK_IDS
    return sizes, np.repeat(np.arange(len(sizes)), LANES), -(-int(sizes.max()) // LANES)


def encode_group(numbers: np.ndarray, table: Table) -> list[tuple[int, bytes, bytes]]:
    """(ids, states, words) of each block of a run of symbol numbers."""
    sizes, lane_block, steps = _shape(len(numbers))
    base = np.concatenate(([0], np.cumsum(sizes)[:-1]))[lane_block] + np.tile(np.arange(LANES), len(sizes))
    last = np.cumsum(sizes)[lane_block]
    x = np.full(len(base), LOW, np.uint64)
    shift, half = np.uint64(63 - SCALE), np.uint64(32)
    full = sizes[-1] == BLOCK_IDS
    words, owners = [], []
    for t in range(steps - 1, -1, -1):
        at = base + t * LANES
        live = slice(None) if full else np.flatnonzero(at < last)
        s = numbers[at[live]]
        f, y = table.freq[s], x[live]
        out = np.flatnonzero(y >= f << shift)
        if len(out):
            w = y[out]
            words.append(w.astype(np.uint32))
            owners.append(lane_block[live][out])
            y[out] = w >> half
        q = y // f
        x[live] = (q << np.uint64(SCALE)) + (y - q * f) + table.start[s]
    stream = np.concatenate(words[::-1]) if words else np.empty(0, np.uint32)
    owner = np.concatenate(owners[::-1]) if owners else np.empty(0, np.int64)
    order = np.argsort(owner.astype(np.uint16), kind="stable")
    pieces = np.split(stream[order], np.cumsum(np.bincount(owner, minlength=len(sizes)))[:-1])
    return [(int(n), x[i * LANES : (i + 1) * LANES].tobytes(), p.tobytes()) for i, (n, p) in enumerate(zip(sizes, pieces, strict=True))]


def decode_group(coded: list[tuple[int, bytes, bytes]], table: Table) -> np.ndarray:
    """The symbol numbers of several blocks, all but the last of which are full."""
    sizes, lane_block, steps = _shape(sum(n for n, _, _ in coded))
    base = np.concatenate(([0], np.cumsum(sizes)[:-1]))[lane_block] + np.tile(np.arange(LANES), len(sizes))
    last = np.cumsum(sizes)[lane_block]
    x = np.concatenate([np.frombuffer(s, np.uint64) for _, s, _ in coded])
    stream = np.concatenate([np.frombuffer(w, np.uint32) for _, _, w in coded]).astype(np.uint64)
    lengths = np.array([len(w) // 4 for _, _, w in coded])
    next_word = np.cumsum(lengths) - lengths
    out = np.empty(int(sizes.sum()), np.uint32)
    mask, scale, half = np.uint64((1 << SCALE) - 1), np.uint64(SCALE), np.uint64(32)
    slots, full = table.slots, sizes[-1] == BLOCK_IDS
    for t in range(steps):
        at = base + t * LANES
        live = slice(None) if full else np.flatnonzero(at < last)
        y = x[live]
        slot = y & mask
        s = slots[slot]
        out[at[live]] = s
        y = table.freq[s] * (y >> scale) + slot - table.start[s]
        short = np.flatnonzero(y < LOW)
        if len(short):
            owner = lane_block[live][short]
            counts = np.bincount(owner, minlength=len(sizes))
            rank = np.arange(len(short)) - (np.cumsum(counts) - counts)[owner]
            y[short] = y[short] << half | stream[next_word[owner] + rank]
            next_word = next_word + counts
        x[live] = y
    return out


def pack_segment(ids: np.ndarray) -> dict:
    """Table and blocks of a run of ids; ids should be small, as token ids and word numbers are."""
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    crc = [zlib.crc32(ids[i : i + BLOCK_IDS].astype("<u4").tobytes()) for i in range(0, len(ids), BLOCK_IDS)]
    if len(symbols) > 1 << SCALE:
        runs = [ids[i : i + BLOCK_IDS] for i in range(0, len(ids), BLOCK_IDS)]
        none = blocks.pack(np.empty(0, np.uint32))
        return {"symbols": none, "frequencies": none, "blocks": [{"n": len(r), "states": b"", "words": blocks.pack(r.astype(np.uint32)), "crc32": c} for r, c in zip(runs, crc, strict=True)]}
    counts, place = counts[symbols], np.empty(len(counts), np.uint32)
    place[symbols] = np.arange(len(symbols), dtype=np.uint32)
    numbers = place[ids]
    freq = frequencies(counts)
    table, coded = Table(symbols, freq), []
    for i in range(0, len(numbers), GROUP * BLOCK_IDS):
        coded += encode_group(numbers[i : i + GROUP * BLOCK_IDS], table)
    return {"symbols": blocks.pack(symbols.astype(np.uint32)), "frequencies": blocks.pack(freq.astype(np.uint32)), "blocks": [{"n": n, "states": s, "words": w, "crc32": c} for (n, s, w), c in zip(coded, crc, strict=True)]}


def unpack_segment(symbols: bytes, freq: bytes, coded: list) -> np.ndarray:
    """The ids of a segment; a block that does not match its checksum raises."""
    table = Table(blocks.unpack(symbols, np.uint32), blocks.unpack(freq, np.uint32).astype(np.int64))
    out = []
    for i in range(0, len(coded), GROUP):
        group = coded[i : i + GROUP]
        if len(table.symbols):
            ids = table.symbols[decode_group([(b["n"], b["states"], b["words"]) for b in group], table)]
        else:
            ids = np.concatenate([blocks.unpack(b["words"], np.uint32) for b in group])
        for k, b in enumerate(group):
            if zlib.crc32(ids[k * BLOCK_IDS : k * BLOCK_IDS + b["n"]].astype("<u4").tobytes()) != b["crc32"]:
                raise ValueError("a block's checksum does not match")
        out.append(ids)
    return np.concatenate(out)
