"""Chat queries: session replay and chat-log rows."""

from __future__ import annotations

from wardlake.functions import clinical as C
from wardlake.operators import chat as CH
from wardlake.plans.registry import register
from wardlake.sources import fixtures as V
from wardlake.sources.tables import table


def _sessions_sql() -> tuple[str, dict]:
    return ("""SELECT session_id, turn,
        CASE WHEN hc IS NULL OR turn < hc THEN 'general' WHEN s IS NULL OR turn < s THEN 'ask_symptoms'
             WHEN h IS NULL OR turn < h THEN 'ask_hospital' ELSE 'ask_appointment' END AS state
        FROM m3""", {
        "mf": f"""SELECT session_id, turn, {C.sql_route_message('message')} = 'healthcare' AS is_health,
            {C.sql_is_list_request('message')} AS is_list, {C.sql_has_symptom_signal('message')} AS has_signal,
            {C.sql_resolve_hospital_name('message')} AS hospital_name FROM messages_v""",
        "m1": "SELECT *, min(CASE WHEN is_health THEN turn END) OVER (PARTITION BY session_id) AS hc FROM mf",
        "m2": """SELECT *, min(CASE WHEN turn >= hc AND NOT is_list AND (turn > hc OR has_signal) THEN turn END)
            OVER (PARTITION BY session_id) AS s FROM m1""",
        "m3": """SELECT *, min(CASE WHEN turn > s AND NOT is_list AND hospital_name IS NOT NULL THEN turn END)
            OVER (PARTITION BY session_id) AS h FROM m2""",
    })


@register("session_states", _sessions_sql)
def session_states(spark, sf):
    return CH.session_states(V.messages_v(spark, sf))


@register("chat_log_rows", """SELECT u.conv_id AS session_id, u.turn, u.text AS message,
    coalesce(nullif(a.text, ''), to_json({'session_id': u.conv_id, 'agent': 'Healthcare Agent', 'turn': u.turn})::VARCHAR)
      AS reply
    FROM conversations u LEFT JOIN conversations a
      ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
    WHERE u.role = 'user' AND u.conv_id IS NOT NULL""")
def chat_log_rows(spark, sf):
    return CH.chat_log_rows(table(spark, sf, "conversations"))
