"""Equal rows are worked out once: what a task remembers of results, as long as there is room.

Results are kept as one Arrow array and taken from it by place, so a repeated row costs a look-up and a copy. What is kept is bounded
in bytes; a full memory starts anew. Nothing depends on it but time.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable

import pyarrow as pa

#: Bytes of results and keys that a memory keeps, and the bytes of a key beyond which a batch isn't kept.
ROOM, LONGEST = 96 << 20, 65536


class Memory:
    """Results of ``one``, a function whose results are records of the Arrow type ``kind`` and depend on nothing but a row's key."""

    def __init__(self, one: Callable[..., dict], kind: pa.StructType, room: int = ROOM) -> None:
        self.one, self.kind, self.room = one, kind, room
        self._forget()

    def _forget(self) -> None:
        self.places: dict[Hashable, int] = {}
        self.kept, self.size = pa.array([], self.kind), 0

    def __call__(self, keys: list[tuple], inputs: Callable[[list[int]], list[tuple]]) -> pa.StructArray:
        """One result for each key, in order; ``inputs`` gives the arguments of rows by their places."""
        if self.size > self.room:
            self._forget()
        new: dict[tuple, int] = {}
        first: list[int] = []
        at = []
        for row, key in enumerate(keys):
            place = self.places.get(key)
            if place is None and (place := new.get(key)) is None:
                place = new[key] = len(self.places) + len(first)
                first.append(row)
            at.append(place)
        results = self.kept
        if first:
            fresh = pa.array([self.one(*x) for x in inputs(first)], self.kind)
            results = pa.concat_arrays([results, fresh]) if self.places else fresh
            lengths = [sum(len(x) if isinstance(x, str) else 8 for x in key) for key in new]
            if max(lengths) <= LONGEST:
                self.places.update(new)
                self.kept, self.size = results, self.size + fresh.nbytes + sum(lengths)
        return results.take(pa.array(at, pa.int64()))
