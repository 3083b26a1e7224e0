"""Words of a batch of texts as one Arrow array, found by a table of bytes (used inside tasks)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32  # A-Z only; bytes of other letters are 0x80 and above

#: a-z and everything outside ASCII, after A-Z are lower-cased.
LETTERS = np.zeros(256, bool)
LETTERS[0x61:0x7B] = LETTERS[0x80:] = True
#: Digits too.
ALNUM = LETTERS.copy()
ALNUM[0x30:0x3A] = True


def split_terms(texts: pa.Array, inside: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Maximal runs of ``inside`` bytes of all texts, and their number per text.

    A-Z are lower-cased; a null text has none. The bytes of a character
    outside ASCII are all inside, so characters stay whole.
    """
    data = b"\n".join(t.as_py().encode("utf-8", "replace") if t.is_valid else b"" for t in texts) + b"\n"
    raw = np.frombuffer(data, np.uint8)
    buf = _LOWER[raw]
    keep = inside[buf]
    edge = np.flatnonzero(keep[1:] != keep[:-1]) + 1
    if keep[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]  # the data end outside a run
    offsets = np.concatenate([[0], np.cumsum(end - start)])
    if offsets[-1] < 2**31:
        found = pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(buf[keep]))
    else:
        found = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(buf[keep]))
    size = np.fromiter((len(t.as_buffer()) + 1 if t.is_valid else 1 for t in texts), np.int64, len(texts))
    return found, np.diff(np.concatenate([[0], np.searchsorted(start, np.cumsum(size))]))
