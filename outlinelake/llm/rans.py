"""Static range asymmetric numeral system over token ids, vectorised across interleaved lanes.

Lane t % lanes of a block codes its token t. Each lane has a 64-bit state that is refilled by 32-bit words from one
shared stream. A checkpoint holds every lane's state and the place in the stream, so that decoding can start there.
"""

from __future__ import annotations

import zlib

import numpy as np

#: log2 of the sum of frequencies; the table of slots has so many entries.
BITS = 18
LANES = 2048
#: Steps (of one token a lane) between checkpoints.
CHECKPOINT = 256

_U = np.uint64
_LOW = _U(1 << 31)


def quantised(counts: np.ndarray) -> np.ndarray:
    """Frequencies that add up to 2**BITS, at least 1 for every id that occurs."""
    total = int(counts.sum())
    if not total:
        return np.zeros(len(counts), dtype=np.int64)
    scale = 1 << BITS
    freq = np.where(counts > 0, np.maximum(1, (counts.astype(np.float64) * scale / total).astype(np.int64)), 0)
    gap = scale - int(freq.sum())
    order = np.lexsort((np.arange(len(freq)), -freq))
    if gap > 0:
        freq[order[0]] += gap
    while gap < 0:
        for i in order:
            if gap == 0:
                break
            if freq[i] > 1:
                cut = min(int(freq[i]) - 1, max(1, int(freq[i]) // 8), -gap)
                freq[i] -= cut
                gap += cut
    return freq


class Tables:
    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(_U)
        self.start = (np.cumsum(freq) - freq).astype(_U)
        self.slot = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)


def encode(ids: np.ndarray, tables: Tables, lanes: int = LANES) -> tuple[bytes, np.ndarray, np.ndarray, int]:
    """Payload, the checkpoints' states (a row each) and places in the payload's words, and the lanes used."""
    lanes = max(1, min(lanes, len(ids)))
    steps = -(-len(ids) // lanes)
    state = np.full(lanes, _LOW, dtype=_U)
    words: list[np.ndarray] = []
    states, behind, written = [], [], 0
    for s in range(steps - 1, -1, -1):
        sym = ids[s * lanes : (s + 1) * lanes]
        n = len(sym)
        freq, x = tables.freq[sym], state[:n]
        full = x >= freq << _U(63 - BITS)
        if full.any():
            words.append(x[full].astype(np.uint32))
            written += len(words[-1])
            x = np.where(full, x >> _U(32), x)
        quotient = x // freq
        state[:n] = (quotient << _U(BITS)) + (x - quotient * freq) + tables.start[sym]
        if s % CHECKPOINT == 0:
            states.append(state.copy())
            behind.append(written)
    payload = np.concatenate(words[::-1]) if words else np.empty(0, np.uint32)
    places = written - np.array(behind[::-1], dtype=np.int64)
    return payload.astype("<u4").tobytes(), np.array(states[::-1], dtype="<u8").reshape(-1, lanes), places, lanes


def decode(payload: bytes, states: np.ndarray, places: np.ndarray, n: int, tables: Tables, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of the checkpoints first to last (exclusive; all by default)."""
    lanes = states.shape[1]
    words = np.frombuffer(payload, dtype="<u4").astype(_U)
    last = len(states) if last is None else last
    begin, end = first * CHECKPOINT * lanes, min(n, last * CHECKPOINT * lanes)
    out = np.empty(max(0, end - begin), dtype=np.uint16)
    if not len(out):
        return out
    state, at = states[first].astype(_U), int(places[first])
    mask = _U((1 << BITS) - 1)
    for lo in range(begin, end, lanes):
        x = state[: min(lanes, end - lo)]
        slot = x & mask
        sym = tables.slot[slot]
        out[lo - begin : lo - begin + len(sym)] = sym
        x = tables.freq[sym] * (x >> _U(BITS)) + slot - tables.start[sym]
        low = np.flatnonzero(x < _LOW)
        x[low] = x[low] << _U(32) | words[at : at + len(low)]
        at += len(low)
        state[: len(x)] = x
    return out


_MAGIC = b"OLRANS01"


def pack_block(doc_ids: np.ndarray, known: np.ndarray, sizes: np.ndarray, ids: np.ndarray, tables: Tables) -> bytes:
    """One self-contained block: documents, checkpoints, payload and a checksum of all that follows the magic and itself."""
    payload, states, places, lanes = encode(ids, tables)
    head = np.array([len(doc_ids), len(ids), lanes, len(states), len(payload)], dtype="<i8").tobytes()
    body = b"".join((head, doc_ids.astype("<i8").tobytes(), known.astype(np.uint8).tobytes(), sizes.astype("<i8").tobytes(), states.tobytes(), places.astype("<i8").tobytes(), payload))
    return _MAGIC + zlib.crc32(body).to_bytes(4, "little") + body


def unpack_block(block: bytes, tables: Tables) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, which of them are known (not null), sizes, and all token ids; raises ValueError on damage."""
    if block[:8] != _MAGIC or int.from_bytes(block[8:12], "little") != zlib.crc32(block[12:]):
        raise ValueError("damaged block")
    n_docs, n, lanes, n_marks, n_payload = np.frombuffer(block, "<i8", 5, 12).tolist()
    at = 52
    doc_ids = np.frombuffer(block, "<i8", n_docs, at)
    known = np.frombuffer(block, np.uint8, n_docs, at + 8 * n_docs)
    sizes = np.frombuffer(block, "<i8", n_docs, at + 9 * n_docs)
    at += 17 * n_docs
    states = np.frombuffer(block, "<u8", n_marks * lanes, at).reshape(-1, lanes)
    at += 8 * n_marks * lanes
    places = np.frombuffer(block, "<i8", n_marks, at)
    payload = block[at + 8 * n_marks : at + 8 * n_marks + n_payload]
    return doc_ids, known.astype(bool), sizes, decode(payload, states, places, n, tables)
