"""Adapter views: clinical tables derived from the driver's test tables.

The test tables carry no clinical text, so cases, doctors, slots, booking
requests, appointments, patients, chat turns, model votes/replies and image
metrics are derived from ``events``, ``orders``, ``lineitem``, ``supplier``,
``customer`` and ``nation``.  Every view reads its whole base table(s); the
modulo expressions below only pick categorical values, they never filter rows.

Each view exists twice: a DataFrame builder (what the Spark queries read) and
SQL text for DuckDB (``VIEW_SQL``, used only by the oracle).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake.functions import clinical as C
from wardlake.sources.tables import parts_for, table


def _case(key: Column, mapping: list[tuple[int, str | None]], default: str | None) -> Column:
    expr = None
    for k, v in mapping:
        expr = F.when(key == k, F.lit(v)) if expr is None else expr.when(key == k, F.lit(v))
    return expr.otherwise(F.lit(default))


_HOSP6 = [(0, "Texas Health Frisco"), (1, "Baylor Scott & White Plano"), (2, "Medical City Plano"),
          (3, "Texas Health Plano"), (4, "Children's Medical Center Plano")]
_SPEC7 = [(0, "Cardiology"), (1, "Neurology"), (2, "Endocrinology"), (3, "Pulmonology"),
          (4, "Dermatology"), (5, "Gastroenterology")]
_SLOT_TIMES = [(1, "09:30 AM"), (2, "10:00 AM"), (3, "10:30 AM"), (4, "11:30 AM"), (5, "01:00 PM"), (6, "2:00 PM")]
_MODELS = [("phi", 1), ("qwen", 2), ("deepseek", 3)]


def cases_v(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events")
    u, e, et, v = F.col("user_id"), F.col("event_id"), F.col("event_type"), F.col("value")
    symptoms = (F.when((et == "error") & (v > 50), "Chest pain, shortness of breath, diabetes")
                .when(et == "error", "chest pain, diabetes")
                .when(et == "click", "headache, dizziness")
                .when(et == "view", "Fever, cough")
                .when(et == "signup", "frequent urination, fatigue")
                .when(v > 50, "stomach pain, nausea").otherwise("skin rash, itching"))
    return ev.select(
        e.alias("case_id"), u.alias("patient_id"),
        _case(u % 6, _HOSP6, None).alias("hospital"),
        symptoms.alias("symptoms"),
        _case(u % 4, [(0, "diabetes"), (1, "hypertension"), (2, "high blood pressure, diabetes")], "").alias("history"),
        (20 + u % 61).alias("age"), (100 + e % 71).alias("bp"), (60 + e % 51).alias("heart_rate"),
        (150 + e % 111).alias("cholesterol"),
        F.when(e % 97 == 0, F.lit(None).cast("string")).when(e % 89 == 0, F.lit(""))
         .otherwise(F.col("ts").cast("date").cast("string")).alias("generated_at"),
        F.col("ts").alias("reported_at"),
    )


def reports_v(spark: SparkSession, sf: str) -> DataFrame:
    """Saved reports: case + rule risk, priority, specialty and inferred disease."""
    c = cases_v(spark, sf)
    spec = C.choose_specialty(F.col("symptoms"))
    score = C.risk_score(F.col("symptoms"), F.col("age"))
    return c.select(
        "case_id", "patient_id", "hospital", "symptoms", "history", "age", "generated_at",
        spec.alias("specialty"), score.alias("risk_score"),
        C.risk_priority(score).alias("priority"),
        C.infer_disease(F.col("symptoms"), spec).alias("disease"),
    )


def doctors_v(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    return s.select(
        k.alias("id"), F.col("s_name").alias("name"),
        _case(k % 5, _HOSP6[:4], "Children's Medical Center Plano").alias("hospital"),
        _case(k % 7, _SPEC7, "General Physician").alias("specialty"),
        (F.col("s_nationkey") + 1).alias("experience"),
        (k % 4 != 0).alias("available"),
    )


def _slot_key(l: DataFrame | None = None) -> Column:
    return (F.col("l_suppkey") * 100000 + (F.year("l_shipdate") - 1990) * 120
            + F.month("l_shipdate") * 10 + F.col("l_linenumber")).cast("bigint")


def slots_v(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    g = li.groupBy(
        F.col("l_suppkey"), F.year("l_shipdate").alias("y"), F.month("l_shipdate").alias("m"), F.col("l_linenumber"),
    ).agg(
        F.min("l_shipdate").alias("first_ship"),
        F.max(F.when(F.col("l_returnflag") == "A", 1).otherwise(0)).alias("available"),
    )
    return g.select(
        (F.col("l_suppkey") * 100000 + (F.col("y") - 1990) * 120 + F.col("m") * 10 + F.col("l_linenumber"))
        .cast("bigint").alias("id"),
        F.col("l_suppkey").alias("doctor_id"),
        F.col("first_ship").cast("date").cast("string").alias("date"),
        _case(F.col("l_linenumber"), _SLOT_TIMES, "03:00 PM").alias("time"),
        F.col("available").cast("int").alias("available"),
    )


def requests_v(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_shipdate", "l_linenumber")
    n = parts_for(li)
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    found = li.repartition(n, "l_orderkey").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("patient_id"),
        F.col("o_orderdate").alias("requested_at"), _slot_key().alias("slot_id"),
    )
    # dealt by the columns that bookings compare requests by: equal rows meet there too
    return found.repartition(n, "slot_id", "request_id").distinct()


def appointments_v(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    s = table(spark, sf, "supplier").select("s_suppkey", "s_name")
    # every order keeps its row, also where its doctor's number has no supplier
    ok, sk = F.col("o_orderkey"), F.col("o_custkey") % F.lit(max(1, s.count()))
    return o.join(s, F.col("s_suppkey") == sk, "left").select(
        ok.alias("id"), F.col("o_custkey").alias("patient_id"),
        F.when(ok % 53 == 0, F.lit(None).cast("string")).otherwise(F.col("s_name")).alias("doctor_name"),
        _case(sk % 7, _SPEC7, "General Physician").alias("specialty"),
        F.when(ok % 47 == 0, F.lit(None).cast("string")).otherwise(
            _case(sk % 5, _HOSP6[:4], "Children's Medical Center Plano")).alias("hospital"),
        _case(F.col("o_orderpriority"), [("1-URGENT", "Emergency"), ("2-HIGH", "Urgent"), ("3-MEDIUM", "Soon")],
              "Routine").alias("urgency"),
    )


def patients_v(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("n_name").alias("location"),
        F.when(F.col("c_custkey") % 4 == 0, F.lit("diabetes")).alias("medical_history"),
    )


def patient_updates_v(spark: SparkSession, sf: str) -> DataFrame:
    """Every customer is re-sent (half with a blank location, which must not
    overwrite) and every supplier name arrives as a new patient."""
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    s = table(spark, sf, "supplier").select("s_name")
    k = F.col("c_custkey")
    old = c.select(
        F.col("c_name").alias("name"),
        F.when(k % 2 == 0, F.lit("Plano")).otherwise(F.lit("")).alias("location"),
        F.when(k % 5 == 0, F.lit("hypertension")).alias("medical_history"),
    )
    new = s.select(F.concat(F.lit("New#"), F.col("s_name")).alias("name"), F.lit("Frisco").alias("location"),
                   F.lit(None).cast("string").alias("medical_history"))
    return old.unionByName(new)


def messages_v(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    ev = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type")
    day = F.dayofmonth("ts")
    w = Window.partitionBy("user_id", "day").orderBy("ts", "event_id")
    et = F.col("event_type")
    return ev.withColumn("day", day).select(
        (F.col("user_id") * 100 + F.col("day")).cast("bigint").alias("session_id"),
        F.row_number().over(w).cast("bigint").alias("turn"),
        F.when(et == "error", "I have chest pain and diabetes")
         .when(et == "click", "can you give the list of hospital in Plano")
         .when(et == "view", " Texas Health Frisco ")
         .when(et == "signup", "hello there").otherwise("I need a doctor").alias("message"),
    )


def _with_models(df: DataFrame) -> DataFrame:
    """One row per (row, model): a generator over a literal array, not a join."""
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(o).alias("model_ord")) for m, o in _MODELS])
    return df.withColumn("_m", F.explode(models)).select("*", "_m.model", "_m.model_ord").drop("_m")


def votes_v(spark: SparkSession, sf: str) -> DataFrame:
    ev = _with_models(table(spark, sf, "events").select("event_id"))
    e, mo = F.col("event_id"), F.col("model_ord")
    u = (e + mo * (e % 3)) % 4
    sp = (e + F.when(e % 2 == 0, mo).otherwise(mo * mo) * (e % 5)) % 5
    return ev.select(
        e.alias("case_id"), "model", "model_ord",
        _case(u, [(0, "Emergency"), (1, "Urgent"), (2, "Soon")], "Routine").alias("urgency"),
        _case(sp, [(0, "Cardiology"), (1, "Pulmonology"), (2, "Neurology"), (3, "Endocrinology")],
              "General Physician").alias("specialty"),
        F.when((e + mo) % 4 == 0, F.lit("live")).otherwise(F.lit("simulated")).alias("mode"),
    )


def replies_v(spark: SparkSession, sf: str) -> DataFrame:
    ev = _with_models(table(spark, sf, "events").select("event_id"))
    e, mo = F.col("event_id"), F.col("model_ord")
    urg = _case((e + mo) % 4, [(0, "Emergency"), (1, "Urgent"), (2, "Soon")], "Routine")
    spec = _case((e + mo) % 3, [(0, "Cardiology"), (1, "Neurology")], "General Physician")
    x = ev.select(e.alias("case_id"), "model", "model_ord", urg.alias("urgency"), spec.alias("specialty"))
    nl = F.lit("\n")
    u, s, cid = F.col("urgency"), F.col("specialty"), F.col("case_id")
    raw = (F.when(cid % 4 == 0, F.concat(F.lit("<think>why</think>"), nl, F.lit("Urgency: "), u, nl,
                                         F.lit("Specialty: "), s, nl, F.lit("Explanation:"), nl,
                                         F.lit("Please rest and seek care.")))
           .when(cid % 4 == 1, F.concat(F.lit("urgency: "), F.upper(u), F.lit("!"), nl, F.lit("specialty: "),
                                        F.lower(s), nl, F.lit("short")))
           .when(cid % 4 == 2, F.concat(F.lit("This looks "), F.lower(u), F.lit("; refer to "), F.lower(s),
                                        F.lit(" please.")))
           .when(cid % 8 == 3, F.lit("<think>\n so many signs </think>\u00a0Urgency: sOON.\n\u00a0\u2003specialty: 3d imaging & x-ray's unit\n"
                                     "Please see them in the next days."))
           .otherwise(F.lit("No idea what this is.")))
    return x.select("case_id", "model", "model_ord", raw.alias("raw_text"))


def image_metrics_v(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf, "events").select(
        e.alias("image_id"),
        _case(e % 5, [(0, "xray"), (1, " MRI "), (2, "ct"), (3, "skin")], "ultrasound").alias("modality"),
        (e % 256).alias("brightness"), ((e * 7) % 120).alias("contrast"),
        ((e * 13) % 800).alias("normal_milli"), (100 + (e * 5) % 100).alias("abnormal_milli"),
    )


# --- SQL text of the same views (DuckDB) ---------------------------------------

_H6 = ("CASE {k} WHEN 0 THEN 'Texas Health Frisco' WHEN 1 THEN 'Baylor Scott & White Plano' "
       "WHEN 2 THEN 'Medical City Plano' WHEN 3 THEN 'Texas Health Plano' "
       "WHEN 4 THEN 'Children''s Medical Center Plano' ELSE {d} END")
_S7 = ("CASE {k} WHEN 0 THEN 'Cardiology' WHEN 1 THEN 'Neurology' WHEN 2 THEN 'Endocrinology' "
       "WHEN 3 THEN 'Pulmonology' WHEN 4 THEN 'Dermatology' WHEN 5 THEN 'Gastroenterology' "
       "ELSE 'General Physician' END")
_SLOT_ID = ("l_suppkey * 100000 + (EXTRACT(YEAR FROM l_shipdate) - 1990) * 120 "
            "+ EXTRACT(MONTH FROM l_shipdate) * 10 + l_linenumber")
_MODELS_SQL = "(SELECT 'phi' AS model, 1 AS model_ord UNION ALL SELECT 'qwen', 2 UNION ALL SELECT 'deepseek', 3)"


def _reports_sql() -> str:
    spec = C.sql_choose_specialty("symptoms")
    score = C.sql_risk_score("symptoms", "age")
    return (f"SELECT case_id, patient_id, hospital, symptoms, history, age, generated_at, specialty, risk_score, "
            f"{C.sql_risk_priority('risk_score')} AS priority, {C.sql_infer_disease('symptoms', 'specialty')} AS disease "
            f"FROM (SELECT *, {spec} AS specialty, {score} AS risk_score FROM cases_v) r")


VIEW_SQL: dict[str, str] = {
    "cases_v": f"""
SELECT event_id AS case_id, user_id AS patient_id, {_H6.format(k='user_id % 6', d='NULL')} AS hospital,
       CASE WHEN event_type = 'error' AND value > 50 THEN 'Chest pain, shortness of breath, diabetes'
            WHEN event_type = 'error' THEN 'chest pain, diabetes'
            WHEN event_type = 'click' THEN 'headache, dizziness'
            WHEN event_type = 'view' THEN 'Fever, cough'
            WHEN event_type = 'signup' THEN 'frequent urination, fatigue'
            WHEN value > 50 THEN 'stomach pain, nausea' ELSE 'skin rash, itching' END AS symptoms,
       CASE user_id % 4 WHEN 0 THEN 'diabetes' WHEN 1 THEN 'hypertension'
            WHEN 2 THEN 'high blood pressure, diabetes' ELSE '' END AS history,
       20 + user_id % 61 AS age, 100 + event_id % 71 AS bp, 60 + event_id % 51 AS heart_rate,
       150 + event_id % 111 AS cholesterol,
       CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 89 = 0 THEN ''
            ELSE CAST(CAST(ts AS DATE) AS VARCHAR) END AS generated_at,
       ts AS reported_at
FROM events""",
    "reports_v": _reports_sql(),
    "doctors_v": f"""
SELECT s_suppkey AS id, s_name AS name,
       {_H6.format(k='s_suppkey % 5', d="'Children''s Medical Center Plano'")} AS hospital,
       {_S7.format(k='s_suppkey % 7')} AS specialty,
       s_nationkey + 1 AS experience, s_suppkey % 4 <> 0 AS available
FROM supplier""",
    "slots_v": f"""
SELECT CAST({_SLOT_ID} AS BIGINT) AS id,
       l_suppkey AS doctor_id, CAST(CAST(MIN(l_shipdate) AS DATE) AS VARCHAR) AS date,
       CASE l_linenumber WHEN 1 THEN '09:30 AM' WHEN 2 THEN '10:00 AM' WHEN 3 THEN '10:30 AM'
            WHEN 4 THEN '11:30 AM' WHEN 5 THEN '01:00 PM' WHEN 6 THEN '2:00 PM' ELSE '03:00 PM' END AS time,
       CAST(MAX(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS INTEGER) AS available
FROM lineitem
GROUP BY l_suppkey, EXTRACT(YEAR FROM l_shipdate), EXTRACT(MONTH FROM l_shipdate), l_linenumber""",
    "requests_v": f"""
SELECT DISTINCT o_orderkey AS request_id, o_custkey AS patient_id, o_orderdate AS requested_at,
       CAST({_SLOT_ID} AS BIGINT) AS slot_id
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "appointments_v": f"""
SELECT o_orderkey AS id, o_custkey AS patient_id,
       CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE s_name END AS doctor_name,
       {_S7.format(k='o_custkey % n % 7')} AS specialty,
       CASE WHEN o_orderkey % 47 = 0 THEN NULL
            ELSE {_H6.format(k='o_custkey % n % 5', d="'Children''s Medical Center Plano'")} END AS hospital,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'Emergency' WHEN '2-HIGH' THEN 'Urgent'
            WHEN '3-MEDIUM' THEN 'Soon' ELSE 'Routine' END AS urgency
FROM orders CROSS JOIN (SELECT greatest(count(*), 1) AS n FROM supplier) LEFT JOIN supplier ON s_suppkey = o_custkey % n""",
    "patients_v": """
SELECT c_custkey AS id, c_name AS name, n_name AS location,
       CASE WHEN c_custkey % 4 = 0 THEN 'diabetes' ELSE NULL END AS medical_history
FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "patient_updates_v": """
SELECT c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'Plano' ELSE '' END AS location,
       CASE WHEN c_custkey % 5 = 0 THEN 'hypertension' ELSE NULL END AS medical_history
FROM customer
UNION ALL
SELECT concat('New#', s_name) AS name, 'Frisco' AS location, CAST(NULL AS VARCHAR) AS medical_history FROM supplier""",
    "messages_v": """
SELECT CAST(user_id * 100 + EXTRACT(DAY FROM ts) AS BIGINT) AS session_id,
       CAST(ROW_NUMBER() OVER (PARTITION BY user_id, EXTRACT(DAY FROM ts) ORDER BY ts, event_id) AS BIGINT) AS turn,
       CASE event_type WHEN 'error' THEN 'I have chest pain and diabetes'
            WHEN 'click' THEN 'can you give the list of hospital in Plano'
            WHEN 'view' THEN ' Texas Health Frisco ' WHEN 'signup' THEN 'hello there'
            ELSE 'I need a doctor' END AS message
FROM events""",
    "votes_v": f"""
SELECT event_id AS case_id, model, model_ord,
       CASE (event_id + model_ord * (event_id % 3)) % 4 WHEN 0 THEN 'Emergency' WHEN 1 THEN 'Urgent'
            WHEN 2 THEN 'Soon' ELSE 'Routine' END AS urgency,
       CASE (event_id + (CASE WHEN event_id % 2 = 0 THEN model_ord ELSE model_ord * model_ord END) * (event_id % 5)) % 5
            WHEN 0 THEN 'Cardiology' WHEN 1 THEN 'Pulmonology'
            WHEN 2 THEN 'Neurology' WHEN 3 THEN 'Endocrinology' ELSE 'General Physician' END AS specialty,
       CASE WHEN (event_id + model_ord) % 4 = 0 THEN 'live' ELSE 'simulated' END AS mode
FROM events CROSS JOIN {_MODELS_SQL} m""",
    "replies_v": f"""
SELECT case_id, model, model_ord,
       CASE case_id % 4
            WHEN 0 THEN concat('<think>', 'why', '</think>', chr(10), 'Urgency: ', urgency, chr(10), 'Specialty: ', specialty, chr(10), 'Explanation:', chr(10), 'Please rest and seek care.')
            WHEN 1 THEN concat('urgency: ', upper(urgency), '!', chr(10), 'specialty: ', lower(specialty), chr(10), 'short')
            WHEN 2 THEN concat('This looks ', lower(urgency), '; refer to ', lower(specialty), ' please.')
            ELSE CASE WHEN case_id % 8 = 3 THEN concat('<think>', chr(10), ' so many signs </think>', chr(160), 'Urgency: sOON.', chr(10), chr(160), chr(8195),
                   'specialty: 3d imaging & x-ray''s unit', chr(10), 'Please see them in the next days.')
                 ELSE 'No idea what this is.' END END AS raw_text
FROM (SELECT event_id AS case_id, model, model_ord,
             CASE (event_id + model_ord) % 4 WHEN 0 THEN 'Emergency' WHEN 1 THEN 'Urgent' WHEN 2 THEN 'Soon' ELSE 'Routine' END AS urgency,
             CASE (event_id + model_ord) % 3 WHEN 0 THEN 'Cardiology' WHEN 1 THEN 'Neurology' ELSE 'General Physician' END AS specialty
      FROM events CROSS JOIN {_MODELS_SQL} m) x""",
    "image_metrics_v": """
SELECT event_id AS image_id, CASE event_id % 5 WHEN 0 THEN 'xray' WHEN 1 THEN ' MRI ' WHEN 2 THEN 'ct'
            WHEN 3 THEN 'skin' ELSE 'ultrasound' END AS modality,
       event_id % 256 AS brightness, (event_id * 7) % 120 AS contrast,
       (event_id * 13) % 800 AS normal_milli, 100 + (event_id * 5) % 100 AS abnormal_milli
FROM events""",
}

VIEW_ORDER = list(VIEW_SQL)


def with_views(sql: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``sql`` with the CTEs of every adapter view it (transitively) uses."""
    import re

    defs = dict(VIEW_SQL)
    if extra:
        defs.update(extra)
    order = VIEW_ORDER + [k for k in (extra or {}) if k not in VIEW_SQL]
    needed: set[str] = set()
    frontier = [sql]
    while frontier:
        text = frontier.pop()
        for name in order:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                frontier.append(defs[name])
    ctes = [f"{n} AS ({defs[n]})" for n in order if n in needed]
    return ("WITH RECURSIVE " + ",\n".join(ctes) + "\n" + sql) if ctes else sql
