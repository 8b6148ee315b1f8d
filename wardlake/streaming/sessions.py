"""L1: chat session state, turn by turn, as a stateful stream.

Routing and signal features are plain column expressions evaluated before
the stateful step; the per-session step is a small state machine run by
``applyInPandasWithState`` (one state row per session, kept in the state
store, so sessions can span any number of micro-batches).  The state holds the
signals of the session's turns; a turn that arrives after later ones is put in
its place, and the turns that it changes are given out again with a higher
``revision``.  The last revision of each turn equals the batch replay
``wardlake.operators.chat.session_states``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wardlake.operators.chat import STATES, message_features

OUTPUT_SCHEMA = "session_id long, turn long, state string, revision long"
STATE_SCHEMA = "turns string, revision long"


def next_state(state: str, is_health: bool, is_list: bool, has_signal: bool, hospital: str | None) -> str:
    general, ask_symptoms, ask_hospital, ask_appointment = STATES
    if state == general:
        if not is_health:
            return general
        # the healthcare agent takes over this very message
        return ask_hospital if (not is_list and has_signal) else ask_symptoms
    if state == ask_symptoms:
        return ask_symptoms if is_list else ask_hospital
    if state == ask_hospital:
        return ask_appointment if (not is_list and hospital is not None) else ask_hospital
    return state


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Merge the new turns with those known, replay, and give the turns whose
    state is new or has changed, with the number of this revision."""
    known, revision = (json.loads(state.get[0]), state.get[1]) if state.exists else ({}, 0)
    for pdf in batches:
        for row in pdf.itertuples(index=False):
            hospital = None if pd.isna(row.hospital_name) else row.hospital_name
            known.setdefault(str(row.turn), [bool(row.is_health), bool(row.is_list), bool(row.has_signal), hospital, None])
    current, revision, changed = STATES[0], revision + 1, []
    for turn in sorted(map(int, known)):
        *signals, was = known[str(turn)]
        current = next_state(current, *signals)
        if current != was:
            known[str(turn)][-1] = current
            changed.append((turn, current))
    state.update((json.dumps(known), revision))
    yield pd.DataFrame({"session_id": [key[0]] * len(changed), "turn": [t for t, _ in changed],
                        "state": [s for _, s in changed], "revision": [revision] * len(changed)})


def session_state_stream(messages: DataFrame) -> DataFrame:
    f = message_features(messages).select("session_id", "turn", "is_health", "is_list", "has_signal", "hospital_name")
    return f.groupBy("session_id").applyInPandasWithState(
        _step, OUTPUT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)
