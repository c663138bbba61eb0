"""Words of whole texts, taken a batch at a time.

A word is a run of characters other than space and U+0009 to U+000D, the same
class in every operator of this subpackage.  The helpers work on the Arrow
batches Spark hands to a task: the words of a batch come back as codes into the
batch's own small dictionary, so anything that costs per string (hashing,
counting code points, cutting into pieces) is done once per distinct word.

A null text has no words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

WORD = r"[^\x20\x09-\x0D]+"
"""The word pattern, for Spark, Python and DuckDB alike."""

_UPPER_TO_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def lower_ascii(text: str) -> str:
    """Lower-case A-Z alone, leaving every other character as it is."""
    return text.encode("utf-8", "surrogatepass").translate(_UPPER_TO_LOWER).decode("utf-8", "surrogatepass")


def split_words(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """``(offsets, codes, dictionary)``: text i holds codes[offsets[i]:offsets[i + 1]].

    Texts longer than Arrow's 32-bit offsets allow in one array are handled by
    the 64-bit string type.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    if not full.all():
        kept = np.concatenate(([0], np.cumsum(full)))
        offsets = kept[offsets]
        flat = flat.filter(pa.array(full))
    coded = flat.dictionary_encode()
    return offsets, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def rolling(ids: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` consecutive uint64 ids (wraps)."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    step = np.uint64(0x9E3779B97F4A7C15)
    for i in range(width):
        out = out * step + ids[i : i + n]
        out ^= out >> np.uint64(29)
    return mixed(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread uint64 values over all 64 bits (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batch: pa.RecordBatch, column: str, most: int = 8 << 20):
    """Parts of a batch of at most ``most`` bytes of text each, or one text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right"))
        stop = max(at + 1, stop)
        yield batch.slice(at, stop - at)
        at = stop


def owners(offsets: np.ndarray) -> np.ndarray:
    """Which text each word belongs to."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def window_starts(offsets: np.ndarray, width: int) -> np.ndarray:
    """Positions at which ``width`` words of one text follow."""
    n = int(offsets[-1])
    if n < width:
        return np.zeros(0, np.int64)
    of = owners(offsets)
    return np.flatnonzero(of[: n - width + 1] == of[width - 1 :])


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Mask of the n positions that some window beginning at ``starts`` covers."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + width, n), -1)
    return np.cumsum(step[:n]) > 0


def planes(a: np.ndarray) -> bytes:
    """Compressed integers, byte planes apart."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes())


def unplaned(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def pack(**arrays: np.ndarray) -> bytes:
    """Integer arrays in one blob, in the order given."""
    parts = [planes(a) for a in arrays.values()]
    return b"".join([len(p).to_bytes(4, "little") + p for p in parts])


def unpack(data: bytes, kinds: list[type]) -> list[np.ndarray]:
    """The first arrays of a blob."""
    out, at = [], 0
    for kind in kinds:
        n = int.from_bytes(data[at : at + 4], "little")
        out.append(unplaned(data[at + 4 : at + 4 + n], kind) if n else np.zeros(0, kind))
        at += 4 + n
    return out


def roomy() -> None:
    """Keep freed blocks of up to 32 MB for the next array: work in many short-lived arrays
    of some hundred kB spends half its time on fresh pages otherwise."""
    import ctypes

    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 32 << 20)  # from which size blocks are mapped apart
        libc.mallopt(-1, 128 << 20)  # how much may stay free at the top
    except AttributeError:  # not glibc
        pass


def release() -> None:
    """Give freed memory back to the system, so an idle worker keeps little."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass
