"""Sets of word shingles as sorted 52-bit fingerprints, for many documents at once."""

from __future__ import annotations

import numpy as np

from .textbytes import Slice, mix, owners, windows

KEY_BITS = 52  # a document's number in its slice (12 bits) and a fingerprint fit one 64-bit value


def shingle_sets(s: Slice, width: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """All documents' distinct shingles of ``width`` words, sorted, and where each document's begin (n + 1 numbers).

    A document with fewer words has its whole sequence as one shingle, one without words has none.
    """
    starts, ends, first = s.words()
    words = s.fingerprints(starts, ends, lower=lower)
    key, at = windows(words, first, width)
    doc = owners(first)
    found, found_doc = [key], [doc[at]]
    n_words = np.diff(first)
    for m in range(1, width):
        if (few := n_words == m).any():
            key, at = windows(words, first, m)
            chosen = few[doc[at]]
            found.append(mix(key[chosen] + np.uint64(m)))
            found_doc.append(doc[at][chosen])
    packed = (np.concatenate(found_doc).astype(np.uint64) << np.uint64(KEY_BITS)) | (np.concatenate(found) >> np.uint64(64 - KEY_BITS))
    packed.sort()
    packed = packed[np.append(True, packed[1:] != packed[:-1])] if len(packed) else packed
    first_of = np.searchsorted(packed, np.arange(s.n + 1, dtype=np.uint64) << np.uint64(KEY_BITS)) if s.n < 1 << (64 - KEY_BITS) else None
    if first_of is None:  # the last document's bound does not fit 64 bits
        first_of = np.append(np.searchsorted(packed, np.arange(s.n, dtype=np.uint64) << np.uint64(KEY_BITS)), len(packed))
    return packed & np.uint64((1 << KEY_BITS) - 1), first_of
