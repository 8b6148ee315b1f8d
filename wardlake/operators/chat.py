"""Chat routing, session replay and chat-log rows.

Session replay (K2) is closed-form: with
  hc = first turn routed to healthcare,
  s  = first turn >= hc that is not a hospital-list request and either comes
       after hc or carries a symptom signal,
  h  = first turn > s that is not a list request and names a known hospital,
the state after turn t is general (t < hc), ask_symptoms (hc <= t < s),
ask_hospital (s <= t < h) or ask_appointment (t >= h).  The messages are read
once; four flags a turn are written to the shared folder and the rest works on
those.  Each marker is a per-session ``min`` joined to the turns of its session:
one row a session on that side, so a task streams a hot session's turns (a few
bytes each) and never holds them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlake.functions import clinical as C
from wardlake.session import write_table

STATES = ("general", "ask_symptoms", "ask_hospital", "ask_appointment")


def message_features(messages: DataFrame, text: str = "message") -> DataFrame:
    m = F.col(text)
    return messages.select(
        "*", (C.route_message(m) == "healthcare").alias("is_health"), C.is_list_request(m).alias("is_list"),
        C.has_symptom_signal(m).alias("has_signal"), C.resolve_hospital_name(m).alias("hospital_name"))


def session_states(messages: DataFrame, session: str = "session_id", turn: str = "turn",
                   text: str = "message") -> DataFrame:
    f = write_table(message_features(messages, text).select(
        session, turn, "is_health", "is_list", "has_signal",
        F.col("hospital_name").isNotNull().alias("names_hospital")), "session-turns")
    t = F.col(turn)
    turn_on = lambda marks, cond, name: f.join(marks, session).groupBy(session, *marks.columns[1:]).agg(
        F.min(F.when(cond & ~F.col("is_list"), t)).alias(name))
    marks = f.groupBy(session).agg(F.min(F.when(F.col("is_health"), t)).alias("hc"))
    marks = turn_on(marks, (t > F.col("hc")) | ((t == F.col("hc")) & F.col("has_signal")), "s")
    marks = turn_on(marks, (t > F.col("s")) & F.col("names_hospital"), "h")
    f = f.join(marks, session)
    state = (F.when(F.col("hc").isNull() | (t < F.col("hc")), STATES[0])
             .when(F.col("s").isNull() | (t < F.col("s")), STATES[1])
             .when(F.col("h").isNull() | (t < F.col("h")), STATES[2])
             .otherwise(STATES[3]))
    return f.select(session, turn, state.alias("state"))


def chat_log_rows(conversations: DataFrame, agent: str = "Healthcare Agent") -> DataFrame:
    """One stored row per user turn that has a session: the message and
    the reply (the next assistant turn), or when there is no reply text the
    JSON of the remaining response fields."""
    c = conversations.filter(F.col("conv_id").isNotNull())
    user = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("message"))
    nxt = c.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    j = user.join(nxt, ["conv_id", "turn"], "left")
    payload = F.to_json(F.struct(F.col("conv_id").alias("session_id"), F.lit(agent).alias("agent"),
                                 F.col("turn").alias("turn")))
    return j.select(F.col("conv_id").alias("session_id"), "turn", "message",
                    F.coalesce(C.nonblank(F.col("answer")), payload).alias("reply"))
