"""Suggestions as a state machine keyed by ticket, on a stream of scans and votes.

A scan brings the best candidate of a ticket (null: none), whether synthesis had to be
put off, and whether the run only previews.  A vote confirms or rejects what was
suggested; a rejection brings the next best candidate.  Only tickets that were told
that nothing matches, or were never told anything, are looked at again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = "ticket long, seq long, kind string, candidate string, deferred boolean, preview boolean"
STATE = "status string, candidate string, commented boolean, rejected string, seq long"
RESULT = "ticket long, seq long, status string, action string, candidate string, rejected string"
#: What a ticket has before its first event.
NEW = ("new", None, False, "", -1)


def step(state: tuple, event) -> tuple[tuple, str]:
    """The state after an event, and what is done: post, edit, preview, defer, record or skip."""
    status, held, commented, rejected, last = state
    if event.seq <= last:
        return state, "skip"  # an event that was seen already
    gone = [x for x in rejected.split(",") if x]
    found = event.candidate if isinstance(event.candidate, str) and event.candidate not in gone else None
    if event.kind == "up":
        return ("accepted", held, commented, rejected, event.seq), "record"
    if event.kind == "down":
        gone = list(dict.fromkeys([*gone, *([held] if held else [])]))
        found = found if found not in gone else None
        return ("improved" if found else "exhausted", found, commented, ",".join(gone), event.seq), "edit" if commented else "record"
    if commented and status != "awaiting_match" or event.preview and status in ("previewed", "previewed_no_match"):
        return (status, held, commented, rejected, event.seq), "skip"
    if event.deferred:
        return ("deferred", found, commented, rejected, event.seq), "defer"
    if found is None:
        if commented:
            return (status, held, commented, rejected, event.seq), "skip"
        after = "previewed_no_match" if event.preview else "awaiting_match"
        return (after, None, not event.preview, rejected, event.seq), "preview" if event.preview else "post"
    if event.preview:
        return ("previewed", found, commented, rejected, event.seq), "preview"
    return ("posted", found, True, rejected, event.seq), "edit" if commented else "post"


def advance(key: tuple, batches: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
    """Events of one ticket in a batch, in order, against its stored state; one row for each that does something."""
    state = group.get if group.exists else NEW
    events = pd.concat(list(batches), ignore_index=True).sort_values(["seq", "kind"])
    out = []
    for e in events.itertuples():
        state, action = step(state, e)
        if action != "skip":
            out.append((key[0], e.seq, state[0], action, state[1], state[3]))
    group.update(state)
    yield pd.DataFrame(out, columns=["ticket", "seq", "status", "action", "candidate", "rejected"])


def suggestions(events: DataFrame) -> DataFrame:
    """What is done for each event of a stream, exactly once per ticket and sequence number."""
    return events.groupBy("ticket").applyInPandasWithState(advance, RESULT, STATE, "append", GroupStateTimeout.NoTimeout)
