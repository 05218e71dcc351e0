"""A bounded memory of computed values for the worker process of a task."""

from __future__ import annotations

import gc
from collections.abc import Callable, Hashable, Iterator

import numpy as np
import pyarrow as pa


_HELD: dict[Hashable, object] = {}


def held(key: Hashable, make: Callable[[], object]):
    """The one object a worker process keeps between its tasks; another key drops it.

    Workers serve one job after another, so what an earlier operator remembers must not add to the next one's.
    """
    if key not in _HELD:
        release()
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    """Forgets what is held and gives Arrow's unused memory back, for a worker that may idle while others work."""
    _HELD.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()


class Recent:
    """Values of the words met lately, at most about twice ``most`` of them.

    When the younger half is full it becomes the older one, and words still in use move over.
    """

    def __init__(self, most: int) -> None:
        self.most, self.young, self.older = most, {}, {}

    def know(self, wanted: set, compute: Callable[[list], list]) -> dict:
        """A dictionary that holds a value for all ``wanted``; the unknown ones are computed together."""
        new = wanted - self.young.keys()
        if len(self.young) + len(new) > self.most:
            self.older, self.young, new = self.young, {}, wanted
        met = new & self.older.keys()
        self.young.update((w, self.older[w]) for w in met)
        missing = sorted(new - met, key=len)
        if missing:
            self.young.update(zip(missing, compute(missing), strict=True))
        return self.young


def portions(texts: pa.Array, most: int) -> Iterator[list[str]]:
    """Texts in portions of about ``most`` characters, null as empty; a longer text is a portion of its own."""
    held, size = [], 0
    for t in texts:
        value = t.as_py() or ""
        if held and size + len(value) > most:
            yield held
            held, size = [], 0
        held.append(value)
        size += len(value)
    if held:
        yield held


def numbered(lists: pa.ListArray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words of lists of words, the number of each word in order, and where each list begins and the last ends."""
    coded = lists.flatten().dictionary_encode()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), offsets - offsets[0]


def gathered(values: list[bytes], number: np.ndarray, offsets: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The values (arrays of ``kind`` as bytes) of the numbered words on end, and where each list's begin and the last end."""
    width = np.dtype(kind).itemsize
    lengths = np.array([len(v) // width for v in values], np.int64)
    flat, starts = np.frombuffer(b"".join(values), kind), np.cumsum(lengths) - lengths
    counts = lengths[number]
    ends = np.r_[0, np.cumsum(counts)]
    places = np.repeat(starts[number] - ends[:-1], counts) + np.arange(ends[-1])
    return flat[places], ends[offsets]
