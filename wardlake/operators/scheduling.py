"""Doctors, open slots, hospital recommendation and booking (B11, C1-C4,
E3, E5, F5-F9, K1, K8).

Join strategy: slots is the large side.  Doctor tables and the small
per-specialty / per-(hospital, specialty) lookups derived here are joined
without a hint; with AQE on, Spark measures the materialised size of each
side at runtime and turns the join into a broadcast only when that side is
under ``spark.sql.adaptive.autoBroadcastJoinThreshold``; otherwise it keeps
the shuffle join.  So a broadcast never rests on a guess about data size.

"First"/"best" picks are ``min``/``max`` of a struct whose leading fields
are the ordering key: a hash aggregate with map-side partial aggregation, so
a hot key (one slot wanted by a third of all requests) is reduced to one row
per map task before the shuffle and before it meets a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlake import constants as K
from wardlake.session import write_table


def _ilike(col: Column, pattern: str | None) -> Column:
    return F.lit(True) if pattern is None else col.ilike(pattern)


def open_slots(slots: DataFrame, doctors: DataFrame, hospital: str | None = None,
               specialty: str | None = None) -> DataFrame:
    """Open slots joined to their doctor; optional case-insensitive LIKE
    filters on hospital and specialty (the pattern is the user's value, so
    % and _ act as wildcards, as in the booking service)."""
    d = doctors.select(F.col("id").alias("doctor_id"), F.col("name").alias("doctor_name"), "hospital", "specialty")
    d = d.filter(_ilike(F.col("hospital"), hospital) & _ilike(F.col("specialty"), specialty))
    s = slots.filter(F.col("available") == 1).select(F.col("id").alias("slot_id"), "doctor_id", "date", "time")
    return s.join(d, "doctor_id").select("slot_id", "doctor_name", "hospital", "specialty", "date", "time")


def hospitals_with_specialty(slots: DataFrame, doctors: DataFrame, specialty: str | None = None) -> DataFrame:
    """Distinct (specialty, hospital) that have an open slot."""
    return open_slots(slots, doctors, None, specialty).select("specialty", "hospital").distinct()


def top_slots(slots: DataFrame, doctors: DataFrame, k: int = 3) -> DataFrame:
    """The first ``k`` open slots of each specialty, by slot id."""
    o = open_slots(slots, doctors)
    w = Window.partitionBy("specialty").orderBy("slot_id")
    return o.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def slots_by_specialty(slots: DataFrame, doctors: DataFrame, k: int = 3) -> DataFrame:
    """The first ``k`` open slots of each specialty (whatever its case) in one row: ``s`` (lower case), ``offers``
    (array of structs in slot order)."""
    o = open_slots(slots, doctors).withColumn("s", F.lower("specialty"))
    w = Window.partitionBy("s").orderBy("slot_id")
    top = o.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return top.groupBy("s").agg(F.array_sort(F.collect_list(F.struct(
        "slot_id", "doctor_name", "specialty", "hospital", "date", "time"))).alias("offers"))


def available_doctors(doctors: DataFrame, specialty: str | None = None) -> DataFrame:
    """Doctors of exactly ``specialty`` that are available."""
    d = doctors.filter(F.col("available"))
    if specialty is not None:
        d = d.filter(F.col("specialty") == specialty)
    times = ["available_time"] if "available_time" in doctors.columns else []
    return d.select("id", "name", "hospital", "specialty", "experience", *times)


def best_doctor(doctors: DataFrame) -> DataFrame:
    """per specialty, the most experienced available doctor; ties keep
    the first doctor (lowest id), like a stable sort by experience desc."""
    d = doctors.filter(F.col("available"))
    best = F.max(F.struct(F.col("experience").alias("e"), (-F.col("id")).alias("neg_id"), F.col("name").alias("n")))
    return (d.groupBy("specialty").agg(best.alias("b"))
            .select("specialty", (-F.col("b.neg_id")).alias("doctor_id"), F.col("b.n").alias("doctor_name"),
                    F.col("b.e").alias("experience")))


def first_doctor(cases: DataFrame, doctors: DataFrame, specialty_col: str = "specialty") -> DataFrame:
    """per case, the first available doctor (lowest id) of exactly the
    case's specialty, or doctor_found=false with the fallback message."""
    d = doctors.filter(F.col("available"))
    first = (d.groupBy("specialty")
             .agg(F.min(F.struct(F.col("id").alias("i"), F.col("name").alias("n"), F.col("experience").alias("e")))
                  .alias("f"))
             .select(F.col("specialty").alias(specialty_col), F.col("f.i").alias("doctor_id"),
                     F.col("f.n").alias("doctor_name"), F.col("f.e").alias("experience")))
    j = cases.join(first, specialty_col, "left")
    found = F.col("doctor_id").isNotNull()
    return j.select(
        "*", found.alias("doctor_found"),
        F.when(~found, F.concat(F.lit("No available "), F.col(specialty_col),
                                F.lit(" found. Recommending General Physician."))).alias("message"),
    )


def first_slot_with_fallback(cases: DataFrame, slots: DataFrame, doctors: DataFrame,
                             fallback: str = "General Physician") -> DataFrame:
    """Per case, the first open slot (by id) at the case's hospital in its
    specialty, else the first General Physician slot there, else none."""
    o = open_slots(slots, doctors)
    first = (o.groupBy(F.lower("hospital").alias("h"), F.lower("specialty").alias("s"))
             .agg(F.min(F.struct("slot_id", "doctor_name", "specialty", "date", "time")).alias("f")))
    main = first.select("h", "s", F.col("f").alias("main"))
    fb = first.filter(F.col("s") == fallback.lower()).select("h", F.col("f").alias("fb"))
    c = cases.withColumn("h", F.lower("hospital")).withColumn("s", F.lower("specialty"))
    j = c.join(main, ["h", "s"], "left").join(fb, "h", "left")
    pick = F.coalesce(F.col("main"), F.col("fb"))
    is_fb = F.col("main").isNull() & F.col("fb").isNotNull()
    text = (F.when(F.col("main").isNotNull(), F.format_string("%s (%s) at %s (%s)", F.col("main.doctor_name"),
                                                              F.col("main.specialty"), F.col("main.time"),
                                                              F.col("main.date")))
            .when(F.col("fb").isNotNull(), F.format_string("%s (General Physician - Fallback) at %s (%s)",
                                                           F.col("fb.doctor_name"), F.col("fb.time"), F.col("fb.date")))
            .otherwise(F.lit("No doctors available at this time.")))
    return j.select(*cases.columns, pick["slot_id"].alias("slot_id"), is_fb.alias("is_fallback"), text.alias("doctor"))


def recommend_hospitals(keys: DataFrame, slots: DataFrame, doctors: DataFrame, k: int = 3,
                        exclude_col: str | None = None) -> DataFrame:
    """up to ``k`` hospitals per (specialty, location) key.

    Ranking: hospitals preferred for the location that have an open slot in
    the specialty, then the other hospitals with one, then the rest of the
    known hospitals.  When no hospital has an open slot, all known ones count
    as available.  An unknown location has no preference list (global order).
    With ``exclude_col`` the hospital named there is removed (case-insensitive).
    """
    # written once (a row per hospital and specialty) and read by both joins below
    avail = write_table(hospitals_with_specialty(slots, doctors).withColumn("avail", F.lit(True)), "open-specialties")
    known = F.array(*[F.struct(F.lit(h).alias("hospital"), F.lit(i).alias("hord")) for i, h in enumerate(K.HOSPITALS)])
    key_cols = ["specialty", "location"] + ([exclude_col] if exclude_col else [])
    ks = keys.select(*key_cols).distinct()
    # candidates: known hospitals for every key, plus any other hospital with an open slot
    cand_known = ks.select(*key_cols, F.explode(known).alias("h")).select(*key_cols, "h.hospital", "h.hord")
    cand_other = ks.join(avail.select("specialty", "hospital"), "specialty").select(
        *key_cols, "hospital", F.lit(len(K.HOSPITALS)).alias("hord"))
    cand = (cand_known.unionByName(cand_other)
            .groupBy(*key_cols, "hospital").agg(F.min("hord").alias("hord")))
    cand = cand.join(avail.select("specialty", "hospital", "avail"), ["specialty", "hospital"], "left")
    any_avail = F.max(F.coalesce(F.col("avail"), F.lit(False))).over(Window.partitionBy(*key_cols))
    is_avail = F.coalesce(F.col("avail"), F.lit(False)) | ~any_avail
    pref_idx = None
    loc = F.lower(F.coalesce(F.col("location"), F.lit("")))
    for location, hs in K.LOCATION_HOSPITALS.items():
        for i, h in enumerate(hs):
            cond = (loc == location) & (F.col("hospital") == h)
            pref_idx = F.when(cond, F.lit(i)) if pref_idx is None else pref_idx.when(cond, F.lit(i))
    # unknown location: preferred list is every known hospital in global order
    known_loc = loc.isin(*K.LOCATION_HOSPITALS.keys())
    pref = F.when(known_loc, pref_idx).otherwise(F.when(F.col("hord") < len(K.HOSPITALS), F.col("hord")))
    tier = (F.when(pref.isNotNull() & is_avail, F.lit(1)).when(is_avail, F.lit(2)).otherwise(F.lit(3)))
    order_in_tier = F.when(tier == 1, pref).otherwise(F.col("hord"))
    ranked = cand.select(*key_cols, "hospital", tier.alias("tier"), order_in_tier.alias("o"))
    w = Window.partitionBy(*key_cols).orderBy("tier", "o", "hospital")
    ranked = ranked.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    if exclude_col:
        ranked = ranked.filter(F.lower("hospital") != F.lower(F.coalesce(F.col(exclude_col), F.lit(""))))
        w2 = Window.partitionBy(*key_cols).orderBy("rank")
        ranked = ranked.withColumn("rank", F.row_number().over(w2))
    return ranked.select(*key_cols, "rank", "hospital")


def book(requests: DataFrame, slots: DataFrame, doctors: DataFrame) -> dict[str, DataFrame]:
    """K1: resolve a batch of booking requests against open slots.

    The earliest request (requested_at, then request_id) for an open slot
    wins it; every other request (a loser, or one for a closed or unknown
    slot) is rejected.  Returns ``accepted``, ``rejected`` and ``slots_after``
    (the slot table with won slots closed).

    Requests are reduced to the earliest of each slot before any join (partial
    aggregation, so a hot slot leaves a map task as one row).  ``rejected``
    compares requests with winners on (slot, request), which no slot makes hot.
    """
    first = (requests.filter(F.col("slot_id").isNotNull()).groupBy("slot_id")
             .agg(F.min(F.struct("requested_at", "request_id", "patient_id")).alias("w")))
    staff = doctors.select(F.col("id").alias("doctor_id"), F.col("name").alias("doctor_name"), "hospital", "specialty")
    wanted = slots.filter(F.col("available") == 1).join(first.withColumnRenamed("slot_id", "id"), "id")
    accepted = wanted.join(staff, "doctor_id").select(
        F.col("w.request_id").alias("request_id"), F.col("id").alias("slot_id"), F.col("w.patient_id").alias("patient_id"),
        "doctor_id", "doctor_name", "hospital", "specialty",
        F.col("date").alias("appointment_date"), F.col("time").alias("appointment_time"),
        F.lit("Scheduled").alias("urgency"), F.lit("Confirmed").alias("status"),
        F.col("w.requested_at").alias("created_at"))
    rejected = (requests.join(accepted.select("slot_id", "request_id"), ["slot_id", "request_id"], "left_anti")
                .select("request_id", "slot_id", F.lit("failed").alias("status"),
                        F.lit("Slot not available or does not exist").alias("message")))
    taken = (slots.join(first.select(F.col("slot_id").alias("id"), F.lit(True).alias("_wanted")), "id", "left")
             .join(doctors.select(F.col("id").alias("doctor_id"), F.lit(True).alias("_known")).distinct(), "doctor_id", "left"))
    won = (F.col("available") == 1) & F.col("_wanted") & F.col("_known")
    slots_after = taken.select(*[F.when(won, F.lit(0)).otherwise(F.col("available")).cast("int").alias("available")
                                 if c == "available" else F.col(c) for c in slots.columns])
    return {"accepted": accepted, "rejected": rejected, "slots_after": slots_after}


def triage_with_doctor(triaged: DataFrame, doctors: DataFrame) -> DataFrame:
    """K8: triage result joined to the best doctor of its specialty;
    'No doctor available' when there is none."""
    b = best_doctor(doctors)
    j = triaged.join(b, "specialty", "left")
    return j.select("*", F.when(F.col("doctor_id").isNull(), F.lit("No doctor available"))
                    .otherwise(F.lit("Booked")).alias("booking_status"))
