"""What a Python worker remembers of the chunks of text it has met; workers outlive their tasks and steps."""

from __future__ import annotations

#: Longer chunks are worked out each time they are met: they seldom come again, and would have no bound in memory.
LONGEST = 64


class Remembered(dict):
    """Packed numbers by chunk, from ``fresh``, in two generations of at most ``limit`` chunks each.

    Chunks not met in a whole generation are forgotten.
    """

    limit: int

    def __init__(self):
        super().__init__()
        self.older: dict[str, bytes] = {}

    def fresh(self, chunk: str) -> bytes:
        raise NotImplementedError

    def __missing__(self, chunk: str) -> bytes:
        if len(chunk) > LONGEST:
            return self.fresh(chunk)
        found = self.older.get(chunk)
        if found is None:
            found = self.fresh(chunk)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[chunk] = found
        return found
