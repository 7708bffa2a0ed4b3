"""Execution events as JSON lines: a table of fields says what an event may hold."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Row

#: How a step may end.
STATUSES = frozenset({"started", "completed", "failed", "conflicted", "noop", "recovered", "quarantined"})

_name = lambda v: isinstance(v, str) and v != ""
_count = lambda v: type(v) is int and v >= 0
_text = lambda v: v is None or isinstance(v, str)
_NEEDED = object()
#: field: (what it is if not given, what it must be).
FIELDS: dict[str, tuple[object, Callable[[object], bool]]] = {
    "component": (_NEEDED, _name),
    "action": (_NEEDED, _name),
    "run_identity": (_NEEDED, _name),
    "status": (_NEEDED, STATUSES.__contains__),
    "source_id": ("unknown", _name),
    "source_entity": ("unknown", _name),
    "record_count": (0, _count),
    "rejected_count": (0, _count),
    "duration_ms": (0, _count),
    "error_code": (None, _text),
    "manifest_ref": (None, _text),
}


def event(at: datetime, **given) -> Row:
    """An event at a time with an offset from UTC; anything that does not fit is a ``ValueError``."""
    if at.utcoffset() is None:
        raise ValueError("at: no offset from UTC")
    told = {name: given.pop(name, default) for name, (default, _) in FIELDS.items()}
    wrong = sorted(given) + [name for name, (_, fits) in FIELDS.items() if told[name] is _NEEDED or not fits(told[name])]
    if wrong:
        raise ValueError(f"not an event: {', '.join(wrong)}")
    return Row(at=f"{at.astimezone(timezone.utc).replace(tzinfo=None).isoformat()}Z", **told)


class Emitter:
    """Hands each event to ``sink`` as a line of JSON, and returns it."""

    def __init__(self, sink: Callable[[str], None] = print, clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc)):
        self.sink, self.clock = sink, clock

    def __call__(self, **fields) -> Row:
        made = event(self.clock(), **fields)
        self.sink(json.dumps(made.asDict(), sort_keys=True, separators=(",", ":")))
        return made
