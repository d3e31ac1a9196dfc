"""Bounded tables of results, one per Python worker."""

from __future__ import annotations


class Recent(dict):
    """Results of ``found(key)``, kept for the keys met lately.

    Two generations: when the newer one holds ``keep`` keys it becomes the older one, whose keys come back when they are
    met again. So frequent keys are never lost, and at most ``2 * keep`` are held.
    """

    def __init__(self, keep: int):
        super().__init__()
        self.keep = keep
        self.older: dict = {}

    def found(self, key):
        raise NotImplementedError

    def worth_keeping(self, key) -> bool:
        return True

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.found(key)
            if not self.worth_keeping(key):
                return value
        if len(self) >= self.keep:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value
