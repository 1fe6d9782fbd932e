"""DuckDB SQL for the queries of ``plans.queries``: written from the definitions, apart from the plans."""

from __future__ import annotations

from pulsegrid.config import FEATURES, RAW_COLUMNS, Z_COLUMNS
from pulsegrid.sources.tables import FRAMES_SQL

FRAMES = FRAMES_SQL.replace("{events}", "events")


def with_(*parts: tuple[str, str], select: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in parts) + "\n" + select


def r(expr: str, name: str, digits: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE), {digits}) AS {name}"


def rs(*names: str, digits: int = 6) -> str:
    return ", ".join(r(n, n, digits) for n in names)


F = ("frames", FRAMES)
MAN = (
    "man",
    """SELECT DISTINCT video_id, fold, part, subject_id, score_label,
       CASE score_label WHEN '0' THEN 'normal' WHEN '5' THEN 'drowsy' ELSE 'sleepy' END AS label,
       CAST(CASE score_label WHEN '0' THEN 0 WHEN '5' THEN 1 ELSE 2 END AS INT) AS label_id,
       CASE score_label WHEN '0' THEN 'Alert' WHEN '5' THEN 'Low Vigilant' ELSE 'Drowsy' END AS original_label FROM frames""",
)
CHOSEN = ("chosen", "SELECT subject_id, min(video_id) AS video_id FROM man WHERE score_label = '0' GROUP BY 1")
USED = (
    "used",
    f"""SELECT * FROM (SELECT c.subject_id AS sid, f.*, row_number() OVER (PARTITION BY f.video_id ORDER BY processed_idx) AS rn, count(*) OVER (PARTITION BY f.video_id) AS nn
       FROM frames f JOIN chosen c ON f.video_id = c.video_id WHERE face_detected = 1 AND {" AND ".join(f"{c} IS NOT NULL" for c in RAW_COLUMNS)})
       WHERE rn <= greatest(1, floor(nn * (CAST(1 AS DOUBLE) / 3)))""",
)
VALUES = (
    "vals",
    "SELECT sid, count(*) AS n, " + ", ".join(f"CAST(avg({c}) AS FLOAT) AS mean_{c}, CAST(stddev_pop({c}) AS FLOAT) AS s_{c}" for c in RAW_COLUMNS) + " FROM used GROUP BY 1",
)


def stats(least: int) -> tuple[str, str]:
    ok = f"n >= {least}"
    cols = ", ".join(
        f"CASE WHEN {ok} THEN mean_{c} END AS mean_{c}, CASE WHEN {ok} THEN CASE WHEN s_{c} < 1e-8 THEN CAST(1 AS FLOAT) ELSE s_{c} END END AS std_{c}" for c in RAW_COLUMNS
    )
    return (
        "stats",
        f"""SELECT s.subject_id, c.video_id AS calib_video_id, coalesce(n, 0) AS num, {cols},
        CASE WHEN c.video_id IS NULL THEN 'no_normal_video' WHEN coalesce(n, 0) < {least} THEN 'too_few_calibration_frames' ELSE 'ok' END AS status
        FROM (SELECT DISTINCT subject_id FROM man) s LEFT JOIN chosen c ON s.subject_id = c.subject_id LEFT JOIN vals v ON v.sid = s.subject_id""",
    )


Z = (
    "z",
    "SELECT f.*, " + ", ".join(f"CAST(({c} - CAST(mean_{c} AS DOUBLE)) / CAST(std_{c} AS DOUBLE) AS FLOAT) AS {z}" for c, z in zip(RAW_COLUMNS, Z_COLUMNS))
    + " FROM frames f JOIN stats s ON f.subject_id = s.subject_id AND s.status = 'ok'",
)


def filled(source: str, name: str, columns: tuple[str, ...]) -> list[tuple[str, str]]:
    order = "PARTITION BY video_id ORDER BY timestamp ROWS BETWEEN"
    back, ahead = f"({order} UNBOUNDED PRECEDING AND CURRENT ROW)", f"({order} CURRENT ROW AND UNBOUNDED FOLLOWING)"
    look = ", ".join(
        f"last_value(CASE WHEN {c} IS NOT NULL THEN processed_idx END IGNORE NULLS) OVER {back} AS bi_{c}, last_value(CAST({c} AS DOUBLE) IGNORE NULLS) OVER {back} AS by_{c}, "
        f"first_value(CASE WHEN {c} IS NOT NULL THEN processed_idx END IGNORE NULLS) OVER {ahead} AS ai_{c}, first_value(CAST({c} AS DOUBLE) IGNORE NULLS) OVER {ahead} AS ay_{c}"
        for c in columns
    )
    i = "processed_idx"
    fill = ", ".join(
        f"""CASE WHEN {c} IS NOT NULL THEN CAST({c} AS DOUBLE)
        WHEN bi_{c} IS NOT NULL AND ai_{c} IS NOT NULL AND ({i} - bi_{c} <= 5 OR ai_{c} - {i} <= 5) THEN (ay_{c} - by_{c}) / (ai_{c} - bi_{c}) * ({i} - bi_{c}) + by_{c}
        WHEN ai_{c} IS NULL AND {i} - bi_{c} <= 5 THEN by_{c} WHEN bi_{c} IS NULL AND ai_{c} - {i} <= 5 THEN ay_{c} END AS {c}"""
        for c in columns
    )
    return [(f"{name}_look", f"SELECT *, {look} FROM {source}"), (name, f"SELECT * EXCLUDE ({', '.join(columns)}), {fill} FROM {name}_look")]


SIGNALS = (*Z_COLUMNS, "p_closed")
NORM = [
    F, MAN, CHOSEN, USED, VALUES, stats(8), Z, *filled("z", "gaps", SIGNALS),
    ("clean", f"SELECT * EXCLUDE ({', '.join(SIGNALS)}), " + ", ".join(f"CAST(coalesce({z}, 0) AS FLOAT) AS {z}" for z in Z_COLUMNS)
     + ", CAST(greatest(0::DOUBLE, least(1::DOUBLE, coalesce(p_closed, 0))) AS FLOAT) AS p_closed FROM gaps"),
    ("norm", "SELECT *, CAST(greatest(0::DOUBLE, least(1::DOUBLE, avg(CAST(p_closed AS DOUBLE)) OVER (PARTITION BY video_id ORDER BY timestamp ROWS 4 PRECEDING))) AS FLOAT) AS p_closed_smooth FROM clean"),
]
V = "PARTITION BY video_id ORDER BY timestamp"
STATE = [
    ("st0", f"SELECT *, coalesce(last_value(CASE WHEN CAST(p_closed_smooth AS DOUBLE) >= 0.7::DOUBLE THEN 1 WHEN CAST(p_closed_smooth AS DOUBLE) <= 0.3::DOUBLE THEN 0 END IGNORE NULLS) OVER ({V} ROWS UNBOUNDED PRECEDING), 0) AS closed_state FROM norm"),
    ("st1", f"SELECT *, coalesce(lag(closed_state) OVER ({V}), 0) AS before FROM st0"),
    ("st2", f"SELECT *, sum(CASE WHEN closed_state = 1 AND before = 0 THEN 1 ELSE 0 END) OVER ({V} ROWS UNBOUNDED PRECEDING) AS run_id, last_value(CASE WHEN closed_state = 1 AND before = 0 THEN timestamp END IGNORE NULLS) OVER ({V} ROWS UNBOUNDED PRECEDING) AS since FROM st1"),
    ("st", "SELECT *, CAST(CASE WHEN closed_state = 1 THEN timestamp - since ELSE 0 END AS FLOAT) AS current_closed_duration FROM st2"),
]
EVENTS = [
    ("ev0", """SELECT video_id, run_id, min(processed_idx) AS start_idx, max(processed_idx) AS end_idx, min(frame_idx) AS start_frame, max(frame_idx) AS end_frame,
      min(timestamp) AS start_time, max(timestamp) AS end_time, min(struct_pack(e := CAST(ear_z AS DOUBLE), i := processed_idx, t := timestamp)) AS m,
      CAST(max(p_closed_smooth) AS DOUBLE) AS p_closed_max, min(closed_state) AS last_state,
      arg_min(CAST(ear_z AS DOUBLE), processed_idx) AS ear_z_start, arg_max(CAST(ear_z AS DOUBLE), processed_idx) AS ear_z_end
      FROM st WHERE closed_state = 1 OR before = 1 GROUP BY 1, 2"""),
    ("ev1", """SELECT *, m.e AS ear_z_min, m.i AS min_idx, m.t AS min_time, end_time - start_time AS duration_sec, (ear_z_start + ear_z_end) / 2 - m.e AS amplitude,
      end_frame - start_frame + 1 AS duration, (ear_z_end - m.e) / greatest(end_time - m.t, 1e-6::DOUBLE) AS opening_velocity FROM ev0"""),
    ("ev", """SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY end_time) AS blink_id FROM ev1
      WHERE last_state = 0 AND duration_sec BETWEEN 0.05::DOUBLE AND 2.0::DOUBLE AND amplitude >= 0.1::DOUBLE"""),
]


def rolled(seconds: float) -> list[tuple[str, str]]:
    w = f"({V} RANGE BETWEEN {seconds}::DOUBLE PRECEDING AND CURRENT ROW)"
    return [
        ("joined", "SELECT st.*, ev.end_time AS e_end, ev.duration_sec AS e_d, ev.amplitude AS e_a, ev.opening_velocity AS e_v FROM st LEFT JOIN ev ON st.video_id = ev.video_id AND st.processed_idx = ev.end_idx"),
        ("roll", f"""SELECT *, CAST(avg(closed_state) OVER {w} AS FLOAT) AS perclos_10s, CAST(coalesce(avg(e_d) OVER {w}, 0) AS FLOAT) AS avg_blink_duration_10s,
          CAST(coalesce(avg(e_a) OVER {w}, 0) AS FLOAT) AS avg_blink_amplitude_10s, CAST(coalesce(avg(e_v) OVER {w}, 0) AS FLOAT) AS avg_opening_velocity_10s,
          CAST(count(e_end) OVER {w} / {seconds}::DOUBLE AS FLOAT) AS blink_frequency_10s,
          CAST(coalesce(least(timestamp - last_value(e_end IGNORE NULLS) OVER ({V} ROWS UNBOUNDED PRECEDING), 10), 10) AS FLOAT) AS time_since_last_blink FROM joined"""),
    ]


def slid(source: str) -> list[tuple[str, str]]:
    return [
        ("placed", f"SELECT *, row_number() OVER ({V}) - 1 AS ri, count(*) OVER (PARTITION BY video_id) AS rn FROM {source}"),
        ("starts", "SELECT video_id, unnest(generate_series(0, (max(rn) - 30) // 15)) AS seq_idx FROM placed WHERE rn >= 30 GROUP BY 1"),
        ("win", "SELECT s.seq_idx, s.seq_idx * 15 AS start_row, p.* FROM placed p JOIN starts s ON p.video_id = s.video_id AND p.ri BETWEEN s.seq_idx * 15 AND s.seq_idx * 15 + 29"),
    ]


def c01(x: str) -> str:
    return f"greatest(0::DOUBLE, least(1::DOUBLE, {x}))"


SEQ = [
    *NORM, *STATE, *EVENTS, *rolled(10.0), *slid("roll"),
    ("sq0", """SELECT w.video_id, w.seq_idx, w.start_row, any_value(w.fold) AS fold, any_value(w.subject_id) AS subject_id, any_value(m.label) AS label, any_value(m.label_id) AS label_id,
      avg(face_detected) AS face_detection_rate, min(frame_idx) AS start_frame, max(frame_idx) AS end_frame, min(timestamp) AS start_time, max(timestamp) AS end_time,
      avg(CAST(perclos_10s AS DOUBLE)) AS mean_perclos, CAST(max(current_closed_duration) AS DOUBLE) AS max_closed_duration, avg(CAST(p_closed AS DOUBLE)) AS mean_p_closed,
      greatest(CAST(max(mar_z) AS DOUBLE), 0) AS max_mar_z, CAST(max(abs(pitch_z)) AS DOUBLE) AS max_abs_pitch_z, avg(CAST(avg_blink_duration_10s AS DOUBLE)) AS mean_blink_duration,
      avg(CAST(blink_frequency_10s AS DOUBLE)) AS mean_blink_frequency, CAST(max(current_closed_duration) AS FLOAT) AS max_closed, max(mar_z) AS max_mar,
      arg_max(current_closed_duration, w.processed_idx) AS last_closed, arg_max(perclos_10s, w.processed_idx) AS last_perclos, arg_max(p_closed, w.processed_idx) AS last_p,
      arg_max(pitch_z, w.processed_idx) AS last_pitch, arg_max(yaw_z, w.processed_idx) AS last_yaw, arg_max(roll_z, w.processed_idx) AS last_roll
      FROM win w JOIN man m ON w.video_id = m.video_id GROUP BY 1, 2, 3 HAVING avg(face_detected) >= 0.5"""),
    ("sq1", f"""SELECT *, concat(video_id, '_seq', format('{{:05d}}', seq_idx)) AS sequence_id, max_abs_pitch_z AS max_head_down_z,
      {c01("mean_perclos / 0.6::DOUBLE")} AS s_perclos, {c01("max_closed_duration / 2::DOUBLE")} AS s_closed, {c01("mean_p_closed / 0.8::DOUBLE")} AS s_p,
      {c01("max_mar_z / 3::DOUBLE")} AS s_yawn, {c01("max_abs_pitch_z / 3::DOUBLE")} AS s_head, {c01("mean_blink_duration / 0.6::DOUBLE")} AS s_blink FROM sq0"""),
    ("sq2", f"""SELECT *, {c01("0.4::DOUBLE * s_perclos + 0.35::DOUBLE * s_closed + 0.2::DOUBLE * s_p + 0.05::DOUBLE * s_blink")} AS eye_sleep_score,
      {c01("0.2::DOUBLE * s_perclos + 0.15::DOUBLE * s_p + 0.3::DOUBLE * s_yawn + 0.2::DOUBLE * s_head + 0.15::DOUBLE * s_blink")} AS drowsy_score, s_head AS head_down_score FROM sq1"""),
    ("sq3", """SELECT *, greatest(eye_sleep_score, head_down_score) AS sleepy_score, greatest(eye_sleep_score, head_down_score, drowsy_score) AS confidence_score,
      concat_ws('+', CASE WHEN max_closed_duration >= 2 THEN 'long_eye_closed' END, CASE WHEN mean_perclos >= 0.7::DOUBLE AND mean_p_closed >= 0.75::DOUBLE THEN 'high_perclos_and_p_closed' END,
        CASE WHEN eye_sleep_score >= 0.55::DOUBLE THEN 'high_eye_sleep_score' END, CASE WHEN head_down_score >= 0.75::DOUBLE THEN 'head_down' END) AS why,
      eye_sleep_score <= 0.15::DOUBLE AND drowsy_score <= 0.25::DOUBLE AND head_down_score <= 0.3::DOUBLE AS ok_n,
      drowsy_score BETWEEN 0.25::DOUBLE AND 0.7::DOUBLE AND eye_sleep_score < 0.55::DOUBLE AND max_closed_duration < 2 AND head_down_score < 0.7::DOUBLE AS ok_d FROM sq2"""),
    ("seq", """SELECT *, CASE label WHEN 'normal' THEN CASE WHEN ok_n THEN 'normal_low_eye_drowsy_head_scores' ELSE 'normal_confidence_rejected' END
      WHEN 'drowsy' THEN CASE WHEN ok_d THEN 'drowsy_mid_drowsy_score_not_sleepy' ELSE 'drowsy_confidence_rejected' END
      WHEN 'sleepy' THEN CASE WHEN why <> '' THEN concat('sleepy_', why) ELSE 'sleepy_confidence_rejected' END ELSE 'unknown_label' END AS filter_reason,
      CAST(CASE label WHEN 'normal' THEN ok_n WHEN 'drowsy' THEN ok_d ELSE why <> '' END AS INT) AS is_high_confidence FROM sq3"""),
]
PROBS = [
    *SEQ,
    ("pr0", "SELECT *, 1 + drowsy_score + sleepy_score AS dd FROM seq"),
    ("pr", """SELECT *, CASE WHEN seq_idx % 7 = 0 THEN 0.96::DOUBLE ELSE 1 / dd END AS prob_0, CASE WHEN seq_idx % 7 = 0 THEN 0.02::DOUBLE ELSE drowsy_score / dd END AS prob_1,
      CASE WHEN seq_idx % 7 = 0 THEN 0.02::DOUBLE ELSE sleepy_score / dd END AS prob_2 FROM pr0"""),
]


def first_largest(a: str, b: str, c: str) -> str:
    return f"CAST(CASE WHEN {a} >= {b} AND {a} >= {c} THEN 0 WHEN {b} >= {c} THEN 1 ELSE 2 END AS INT)"


VIDEOS = [
    *PROBS,
    ("vv", f"SELECT *, {first_largest('prob_0', 'prob_1', 'prob_2')} AS own FROM pr"),
    ("votes", "SELECT video_id, own, count(*) AS n, min(seq_idx) AS f FROM vv GROUP BY 1, 2"),
    ("best", "SELECT video_id, own AS pred_label_id FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY n DESC, f) AS k FROM votes) WHERE k = 1"),
    ("vid", "SELECT v.video_id, count(*) AS num_sequences, any_value(label_id) AS true_label_id, any_value(b.pred_label_id) AS pred_label_id, avg(prob_0) AS prob_mean_0, avg(prob_1) AS prob_mean_1, avg(prob_2) AS prob_mean_2 FROM vv v JOIN best b ON v.video_id = b.video_id GROUP BY 1"),
]


def metrics(source: str, t: str, p: str, keys: str = "") -> list[tuple[str, str]]:
    """Counts, then the summary by ``keys`` as table ``met``."""
    per = ", ".join(f"count(*) FILTER ({t} = {k} AND {p} = {k}) AS tp{k}, count(*) FILTER ({t} = {k}) AS t{k}, count(*) FILTER ({p} = {k}) AS p{k}" for k in range(3))
    f1 = " + ".join(f"CASE WHEN t{k} + p{k} > 0 THEN 2.0::DOUBLE * tp{k} / (t{k} + p{k}) ELSE 0 END" for k in range(3))
    seen = " + ".join(f"CASE WHEN t{k} + p{k} > 0 THEN 1 ELSE 0 END" for k in range(3))
    rec = ", ".join(f"CASE WHEN t{k} > 0 THEN tp{k}::DOUBLE / t{k} END AS recall_{k}" for k in range(3))
    group = f" GROUP BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    return [
        ("cnt", f"SELECT {lead}count(*) AS n, avg(CASE WHEN {t} = {p} THEN 1.0 ELSE 0.0 END) AS accuracy, {per} FROM {source}{group}"),
        ("met", f"SELECT {lead}n, accuracy, ({f1}) / ({seen}) AS macro_f1, {rec}, CASE WHEN t0 > 0 THEN 1 - tp0::DOUBLE / t0 END AS normal_false_alarm_rate FROM cnt"),
    ]


TRUTH = ("tp", "SELECT doc_id, CAST(quality + toxic AS INT) AS t, CAST(doc_id % 3 AS INT) AS p, CAST(doc_id % 4 AS INT) AS fold FROM labels")
META = ("meta", "SELECT doc_id, source AS subject_id, concat('Fold', CAST(doc_id % 4 + 1 AS VARCHAR)) AS fold, CAST(n_chars % 3 AS INT) AS label_id FROM documents")
REPORT = [
    TRUTH,
    ("k", "SELECT unnest([0, 1, 2]) AS class_id"),
    ("c", "SELECT CAST(class_id AS INT) AS class_id, count(*) FILTER (t = class_id AND p = class_id) AS tp, count(*) FILTER (t = class_id) AS support, count(*) FILTER (p = class_id) AS predicted FROM k, tp GROUP BY 1"),
    ("pr", "SELECT *, CASE WHEN predicted > 0 THEN tp::DOUBLE / predicted ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp::DOUBLE / support ELSE 0 END AS recall FROM c"),
    ("rep", "SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM pr"),
]
NAMES = ("accuracy", "macro_f1", "recall_0", "recall_1", "recall_2", "normal_false_alarm_rate")
LOGITS = ("lg", "SELECT vec_id, embedding[1]::DOUBLE AS a0, embedding[2]::DOUBLE AS a1, embedding[3]::DOUBLE AS s0, embedding[4]::DOUBLE AS s1, label % 3 AS y FROM embeddings")
VALS = ("ev", "SELECT vec_id, unnest(embedding)::DOUBLE AS value, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS feature FROM embeddings")
STD = ("sd", "SELECT feature, avg(value) AS mean, CASE WHEN stddev_pop(value) < 1e-6 THEN 1 ELSE stddev_pop(value) END AS std FROM ev WHERE vec_id % 5 <> 0 GROUP BY 1")


def blink_columns() -> str:
    return ", ".join(
        ["video_id, CAST(ev.blink_id - 1 AS INT) AS blink_id, start_idx, end_idx, min_idx, duration", rs("start_time", "end_time", "min_time", "duration_sec", "p_closed_max"),
         r("ev.blink_id / greatest(end_time, 1e-6::DOUBLE)", "frequency"), rs("amplitude", "opening_velocity", "ear_z_start", "ear_z_min", "ear_z_end", digits=3)]
    )


def rolled_query(seconds: float) -> str:
    cols = rs("avg_blink_duration_10s", "blink_frequency_10s", "time_since_last_blink") + ", " + rs("avg_blink_amplitude_10s", "avg_opening_velocity_10s", digits=3)
    return with_(*NORM, *STATE, *EVENTS, *rolled(seconds), select=f"SELECT video_id, processed_idx, {cols} FROM roll")


def perclos_query(seconds: float) -> str:
    return with_(*NORM, *STATE, *EVENTS, *rolled(seconds), select=f"SELECT video_id, processed_idx, {rs('perclos_10s')} FROM roll")


def rule(force: bool) -> str:
    f = lambda c, x: f"{c} >= CAST({x} AS FLOAT)"
    eyes = f"({f('last_closed', 2.0)} OR {f('max_closed', 3.0)} OR {f('last_perclos', 0.7)} OR ({f('last_p', 0.5)} AND {f('last_perclos', 0.4)}))"
    if force:
        eyes = f"({eyes} OR ({f('max_mar', 2.5)} AND ({eyes} OR {f('last_p', 0.6)})))"
    head = " OR ".join(f(f"abs({c})", 2.8) for c in ("last_pitch", "last_yaw", "last_roll"))
    mask = f"({eyes} OR {head}) AND (NOT prob_0 >= 0.95::DOUBLE OR {f('max_closed', 2.0)})"
    if force:
        hit, new = "m", ("0", "0", "1")
    else:
        hit = "m AND prob_2 < 0.65::DOUBLE"
        rest = "prob_0 + prob_1"
        new = (f"CASE WHEN {rest} > 1e-8 THEN prob_0 / ({rest}) * 0.35::DOUBLE ELSE 0 END", f"CASE WHEN {rest} > 1e-8 THEN prob_1 / ({rest}) * 0.35::DOUBLE ELSE 0.35::DOUBLE END", "0.65::DOUBLE")
    q = ", ".join(f"CASE WHEN {hit} THEN {n} ELSE prob_{c} END AS x{c}" for c, n in enumerate(new))
    return with_(
        *PROBS, ("mk", f"SELECT *, {mask} AS m FROM pr"), ("xs", f"SELECT *, {q} FROM mk"),
        ("ys", "SELECT *, " + ", ".join(f"x{c} / greatest(x0 + x1 + x2, 1e-8::DOUBLE) AS y{c}" for c in range(3)) + " FROM xs"),
        select=f"SELECT sequence_id, CAST(m AS INT) AS rule_mask, {first_largest('y0', 'y1', 'y2')} AS pred_rule, " + ", ".join(r(f"CAST(y{c} AS FLOAT)", f"prob_rule_{c}", 4) for c in range(3)) + " FROM ys",
    )


STREAM = [
    ("sm", "SELECT *, " + ", ".join(f"avg(prob_{c}) OVER w AS smooth_prob_{c}" for c in range(3)) + ", row_number() OVER o AS k FROM pr WINDOW w AS (PARTITION BY video_id ORDER BY start_time, end_time, start_frame, sequence_id ROWS 2 PRECEDING), o AS (PARTITION BY video_id ORDER BY start_time, end_time, start_frame, sequence_id)"),
    ("so", f"SELECT *, {first_largest('smooth_prob_0', 'smooth_prob_1', 'smooth_prob_2')} AS pred_label_id FROM sm"),
]


def ce(a: str, b: str, target: str) -> str:
    norm = f"(greatest({a}, {b}) + ln(exp({a} - greatest({a}, {b})) + exp({b} - greatest({a}, {b}))))"
    return f"(0.97::DOUBLE * ({norm} - CASE WHEN {target} = 0 THEN {a} ELSE {b} END) + 0.015::DOUBLE * (2 * {norm} - {a} - {b}))"


def weighted_ce(a: str, b: str, target: str, w0: str, w1: str) -> str:
    norm = f"(greatest({a}, {b}) + ln(exp({a} - greatest({a}, {b})) + exp({b} - greatest({a}, {b}))))"
    parts = f"{w0}::DOUBLE * ({norm} - {a})", f"{w1}::DOUBLE * ({norm} - {b})"
    return f"sum(0.97::DOUBLE * CASE WHEN {target} = 0 THEN {parts[0]} ELSE {parts[1]} END + 0.015::DOUBLE * ({parts[0]} + {parts[1]})) / sum(CASE WHEN {target} = 0 THEN {w0}::DOUBLE ELSE {w1}::DOUBLE END)"


def runs_union(name: str, t: str, p: str) -> str:
    long = " UNION ALL ".join(f"SELECT '{n}' AS metric, {n}::DOUBLE AS v FROM met" for n in ("accuracy", "macro_f1"))
    return with_(TRUTH, *metrics("tp", t, p, "fold"), ("lo", long), select=f"SELECT '{name}' AS run, metric, {r('avg(v)', 'mean')}, {r('stddev_pop(v)', 'std')}, {r('min(v)', 'min')}, {r('max(v)', 'max')} FROM lo GROUP BY 2")


def eye(e: str = "e") -> str:
    d = lambda i, j: f"sqrt(power(({e}[{i}] - {e}[{j}]) * 640, 2) + power(({e}[{i + 6}] - {e}[{j + 6}]) * 480, 2))"
    return (
        f"CASE WHEN {d(1, 4)} > 1e-6 THEN ({d(2, 6)} + {d(3, 5)}) / (2 * {d(1, 4)}) END AS ear, "
        f"CASE WHEN {d(3, 4)} > 1e-6 THEN {d(1, 2)} / {d(3, 4)} END AS mar"
    )


def folded(start: str, step: str, select: str) -> str:
    """A fold over the epochs of each series: state f begins as ``start`` at epoch 0."""
    return f"""WITH RECURSIVE days AS (SELECT event_type, CAST(ts AS DATE) AS day, round(avg(value), 6) AS v FROM events GROUP BY 1, 2),
        e AS (SELECT event_type AS series, CAST(row_number() OVER (PARTITION BY event_type ORDER BY day) AS INT) AS epoch, v FROM days),
        f AS (SELECT DISTINCT series, 0 AS epoch, {start} FROM e UNION ALL {step}) {select}"""


_clamp = lambda x, most: f"CAST(greatest(0, least({most}, round_even({x}, 0))) AS INT)"
_step = "CASE WHEN part = 'part1' THEN 29.97::DOUBLE WHEN fold = 'Fold1' THEN 37.5::DOUBLE ELSE 30::DOUBLE END"

ORACLES: dict[str, str] = {
    "q_manifest_map": with_(F, MAN, select="SELECT video_id, fold, part, subject_id, score_label, label, label_id, original_label FROM man"),
    "q_unique_ids": """WITH n AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents)
        SELECT doc_id, source AS video_id_original, CASE WHEN k > 1 THEN concat(source, '_dup', CAST(k AS VARCHAR)) ELSE source END AS video_id FROM n""",
    "q_safe_name": """SELECT page_id, regexp_replace(url, '[^A-Za-z0-9_.-]+', '_', 'g') AS safe_name,
        concat(regexp_replace(url, '[^A-Za-z0-9_.-]+', '_', 'g'), '_seq', format('{:05d}', page_id)) AS sequence_id FROM pages""",
    "q_frame_sampling": with_(
        F, ("s", f"SELECT *, {_step} AS fps, CAST(greatest(1, round_even(({_step}) / 15, 0)) AS INT) AS frame_step FROM frames"),
        select=f"SELECT video_id, frame_idx, frame_step, {r('frame_idx / fps', 'timestamp')}, {r('fps / frame_step', 'effective_fps')} FROM s WHERE frame_idx % frame_step = 0"),
    "q_processing_log": with_(F, select=f"SELECT video_id, count(*) AS processed_frames, CAST(sum(face_detected) AS BIGINT) AS face_detected_frames, {r('sum(face_detected) / count(*)', 'face_detection_rate')} FROM frames GROUP BY 1"),
    "q_calibration_stats": with_(F, MAN, CHOSEN, USED, VALUES, stats(8), select="SELECT subject_id, calib_video_id, status, CAST(CASE WHEN status <> 'no_normal_video' THEN num END AS BIGINT) AS num_calibration_frames, "
        + ", ".join(rs(f"mean_{c}", f"std_{c}", digits=5) for c in RAW_COLUMNS) + " FROM stats"),
    "q_calibration_status": with_(F, MAN, CHOSEN, USED, VALUES, stats(30), select="SELECT status, count(*) AS n FROM stats GROUP BY 1"),
    "q_zscore": with_(F, MAN, CHOSEN, USED, VALUES, stats(8), Z, select=f"SELECT video_id, processed_idx, {rs(*Z_COLUMNS, digits=4)} FROM z"),
    "q_interpolate": with_(F, *filled("frames", "g", ("mar", "p_closed")), select=f"SELECT video_id, processed_idx, {rs('mar', 'p_closed')} FROM g"),
    "q_smooth": with_(*NORM, select=f"SELECT video_id, processed_idx, {rs('p_closed', 'p_closed_smooth')} FROM norm"),
    "q_closed_state": with_(*NORM, *STATE, select=f"SELECT video_id, processed_idx, CAST(closed_state AS INT) AS closed_state, {rs('current_closed_duration')} FROM st"),
    "q_perclos": perclos_query(10.0),
    "q_perclos_short": perclos_query(2.5),
    "q_blink_events": with_(*NORM, *STATE, *EVENTS, select=f"SELECT {blink_columns()} FROM ev"),
    "q_blink_rolling": rolled_query(10.0),
    "q_blink_rolling_short": rolled_query(2.5),
    "q_sequences": with_(F, *slid("frames"), select="SELECT video_id, seq_idx, start_row, count(*) AS n, min(processed_idx) AS lo, max(processed_idx) AS hi FROM win GROUP BY 1, 2, 3"),
    "q_sequence_meta": with_(*SEQ, select=f"""SELECT sequence_id, video_id, fold, subject_id, label, CAST(start_row AS BIGINT) AS start_row, CAST(start_row + 29 AS BIGINT) AS end_row, start_frame, end_frame,
        CAST(30 AS BIGINT) AS num_frames, CAST(13 AS BIGINT) AS feature_dim, {rs('start_time', 'end_time', 'face_detection_rate', 'mean_blink_frequency')} FROM seq"""),
    "q_scores": with_(*SEQ, select="SELECT sequence_id, " + rs("confidence_score", "eye_sleep_score", "drowsy_score", "sleepy_score", "head_down_score", "mean_perclos", "max_closed_duration", "mean_p_closed", "max_mar_z", "max_abs_pitch_z", "max_head_down_z", "mean_blink_duration", digits=4) + " FROM seq"),
    "q_high_confidence": with_(*SEQ, select="SELECT sequence_id, label, is_high_confidence, filter_reason FROM seq"),
    "q_filter_reasons": with_(*SEQ, select="SELECT label, filter_reason, count(*) AS n FROM seq GROUP BY 1, 2"),
    "q_video_summary": with_(*SEQ, select=f"""SELECT m.video_id, m.subject_id, m.label, f.n AS num_frames, coalesce(b.n, 0) AS num_blinks, coalesce(s.n, 0) AS num_all_sequences,
        CAST(coalesce(s.h, 0) AS BIGINT) AS num_high_conf_sequences, CASE WHEN t.status = 'ok' THEN 'ok' ELSE 'no_subject_calibration' END AS status, {r('f.q', 'face_detection_rate')}
        FROM man m JOIN (SELECT video_id, count(*) AS n, avg(face_detected) AS q FROM frames GROUP BY 1) f ON m.video_id = f.video_id JOIN stats t ON m.subject_id = t.subject_id
        LEFT JOIN (SELECT video_id, count(*) AS n FROM ev GROUP BY 1) b ON m.video_id = b.video_id LEFT JOIN (SELECT video_id, count(*) AS n, sum(is_high_confidence) AS h FROM seq GROUP BY 1) s ON m.video_id = s.video_id"""),
    "q_keep_ratio": with_(*SEQ, select=f"SELECT label_id, label AS class_name, count(*) AS before_count, CAST(sum(is_high_confidence) AS BIGINT) AS after_count, {r('sum(is_high_confidence) / count(*)', 'keep_ratio')} FROM seq GROUP BY 1, 2"),
    "q_dummy_all": with_(*SEQ, select="SELECT sequence_id, 'dummy_all_mirrors_high_confidence' AS label_source, CAST(1 AS INT) AS is_dummy_all FROM seq WHERE is_high_confidence = 1"),
    "q_sequence_tensor": with_(
        *NORM, *STATE, *EVENTS, *rolled(10.0), *slid("roll"),
        ("tens", f"SELECT video_id, seq_idx, ri - start_row AS step, {', '.join(FEATURES)} FROM win UNION ALL SELECT video_id, seq_idx, 30 + k, {', '.join('0' for _ in FEATURES)} FROM starts, (SELECT unnest([0, 1]) AS k)"),
        select=f"SELECT video_id, seq_idx, CAST(step // 8 AS INT) AS chunk, CAST(step % 8 AS INT) AS place, {rs(*FEATURES, digits=3)} FROM tens"),
    "q_fold_split": with_(META, select="SELECT doc_id, fold, CASE WHEN fold = 'Fold2' THEN 'test' ELSE 'trainval' END AS split FROM meta"),
    "q_fold_order": with_(META, select="SELECT DISTINCT subject_id, regexp_extract(subject_id, '^([^0-9]*)', 1) AS k0, CAST(regexp_extract(subject_id, '([0-9]+)', 1) AS INT) AS k1, subject_id AS k2 FROM meta"),
    "q_group_class_counts": with_(META, select="SELECT subject_id, " + ", ".join(f"count(*) FILTER (label_id = {c}) AS n_{c}" for c in range(3)) + " FROM meta GROUP BY 1"),
    "q_stratified_split": with_(META, ("c", "SELECT doc_id, label_id, count(*) OVER (PARTITION BY label_id) AS n, row_number() OVER (PARTITION BY label_id ORDER BY substr(md5(concat('42:', doc_id)), 1, 15), doc_id) AS k FROM meta"),
        select="SELECT doc_id, label_id, CASE WHEN n > 1 AND k <= greatest(1, round_even(n * 0.2::DOUBLE, 0)) THEN 'val' ELSE 'train' END AS split FROM c"),
    "q_split_meta": with_(META, select="SELECT doc_id, lower(fold) AS split, fold, subject_id, label_id FROM meta WHERE fold <> 'Fold4'"),
    "q_standardizer": with_(VALS, STD, select=f"SELECT feature, {rs('mean', 'std')} FROM sd"),
    "q_standardized": with_(VALS, STD, select=f"SELECT vec_id, ev.feature, {r('(value - mean) / std', 'z', 5)} FROM ev JOIN sd ON ev.feature = sd.feature"),
    "q_hier_probs": with_(LOGITS, ("e", "SELECT *, exp(a1) / (exp(a0) + exp(a1)) AS h, exp(s1) / (exp(s0) + exp(s1)) AS g FROM lg"), ("p", "SELECT *, 1 - h AS prob_0, h * (1 - g) AS prob_1, h * g AS prob_2 FROM e"),
        select=f"SELECT vec_id, {rs('prob_0', 'prob_1', 'prob_2')}, {first_largest('prob_0', 'prob_1', 'prob_2')} AS pred, {r('1 / (1 + exp(-a0))', 'sig')} FROM p"),
    "q_hier_loss": with_(LOGITS, ("l", f"SELECT avg({ce('a0', 'a1', 'CASE WHEN y > 0 THEN 1 ELSE 0 END')}) AS abnormal_loss, coalesce(avg({ce('s0', 's1', '(y - 1)')}) FILTER (y > 0), 0) AS stage_loss FROM lg"),
        select=f"SELECT {rs('abnormal_loss', 'stage_loss')}, {r('abnormal_loss + stage_loss', 'loss')} FROM l"),
    "q_hier_loss_weighted": with_(LOGITS,
        ("a", f"SELECT {weighted_ce('a0', 'a1', 'CASE WHEN y > 0 THEN 1 ELSE 0 END', '1.5', '0.75')} AS abnormal_loss FROM lg"),
        ("s", f"SELECT {weighted_ce('s0', 's1', '(y - 1)', '0.6', '3.0')} AS stage_loss FROM lg WHERE y > 0"),
        select=f"SELECT {rs('abnormal_loss', 'stage_loss')}, {r('abnormal_loss + stage_loss', 'loss')} FROM a, s"),
    "q_rule_off": with_(*PROBS, select=f"SELECT sequence_id, CAST(0 AS INT) AS rule_mask, {first_largest('prob_0', 'prob_1', 'prob_2')} AS pred_rule, " + ", ".join(r(f"CAST(prob_{c} AS FLOAT)", f"prob_rule_{c}", 4) for c in range(3)) + " FROM pr"),
    "q_predictions_meta": f"SELECT a.sequence_id, a.pred_rule, b.video_id, b.fold, b.label_id FROM ({rule(False)}) a JOIN ({with_(*PROBS, select='SELECT sequence_id, video_id, fold, label_id FROM pr')}) b ON a.sequence_id = b.sequence_id",
    "q_cv_runs": f"SELECT * FROM ({runs_union('plain', 't', 'p')}) UNION ALL SELECT * FROM ({runs_union('swapped', 'p', 't')})",
    "q_first_videos": with_(F, MAN, select="SELECT video_id, label FROM man ORDER BY video_id LIMIT 10"),
    "q_log_rows": with_(F,
        ("c", "SELECT video_id, count(*) AS n, CAST(sum(face_detected) AS BIGINT) AS d FROM frames GROUP BY 1"),
        ("g", "SELECT *, right(video_id, 1) AS g FROM c"),
        ("s", "SELECT *, CASE WHEN g = '3' THEN 'error' WHEN g >= '5' THEN 'ok' WHEN g < '3' THEN 'skipped_exists' ELSE 'no_frames' END AS status FROM g"),
        select=f"SELECT video_id, status, CASE WHEN status IN ('ok', 'skipped_exists') THEN n ELSE 0 END AS processed_frames, CASE WHEN status IN ('ok', 'skipped_exists') THEN d ELSE 0 END AS face_detected_frames, {r("CASE WHEN status IN ('ok', 'skipped_exists') THEN d / n ELSE 0 END", 'face_detection_rate')}, CASE WHEN status = 'error' THEN 'no stream' END AS error FROM s"),
    "q_sleepy_boost": rule(False),
    "q_sleepy_force": rule(True),
    "q_confusion": with_(TRUTH, ("g", "SELECT CAST(a AS INT) AS t, CAST(b AS INT) AS p FROM (SELECT unnest([0, 1, 2]) AS a), (SELECT unnest([0, 1, 2]) AS b)"), ("c", "SELECT g.t, g.p, count(tp.doc_id) AS n FROM g LEFT JOIN tp ON g.t = tp.t AND g.p = tp.p GROUP BY 1, 2"),
        select=f"SELECT t, p, n, {r('n / greatest(sum(n) OVER (PARTITION BY t), 1)', 'share')} FROM c"),
    "q_report": with_(*REPORT, select=f"SELECT class_id, support, predicted, {rs('precision', 'recall', 'f1')} FROM rep"),
    "q_report_averages": with_(*REPORT, select="SELECT CAST(sum(support) AS BIGINT) AS support, " + ", ".join([r(f"avg({c})", f"macro_{c}") for c in ("precision", "recall", "f1")] + [r(f"sum({c} * support) / sum(support)", f"weighted_{c}") for c in ("precision", "recall", "f1")]) + " FROM rep WHERE support + predicted > 0"),
    "q_seq_metrics": with_(TRUTH, *metrics("tp", "t", "p"), select=f"SELECT n, {rs(*NAMES)} FROM met"),
    "q_cv_summary": with_(TRUTH, *metrics("tp", "t", "p", "fold"), ("lo", " UNION ALL ".join(f"SELECT '{n}' AS metric, {n}::DOUBLE AS v FROM met" for n in NAMES)),
        select=f"SELECT metric, {r('avg(v)', 'mean')}, {r('stddev_pop(v)', 'std')}, {r('min(v)', 'min')}, {r('max(v)', 'max')} FROM lo GROUP BY 1"),
    "q_running_mean": with_(TRUTH, *metrics("tp", "t", "p", "fold"), select=f"SELECT {r('sum(accuracy * n) / sum(n)', 'accuracy')} FROM met"),
    "q_class_weights": f"SELECT quality AS class_id, {r('(SELECT count(*) FROM labels) / (2.0::DOUBLE * count(*))', 'weight')} FROM labels GROUP BY 1",
    "q_video_vote": with_(*VIDEOS, select=f"SELECT video_id, num_sequences, true_label_id, pred_label_id, {rs('prob_mean_0', 'prob_mean_1', 'prob_mean_2', digits=4)} FROM vid"),
    "q_video_prob_mean": with_(*VIDEOS, select=f"SELECT video_id, true_label_id, {first_largest('prob_mean_0', 'prob_mean_1', 'prob_mean_2')} AS pred_label_id FROM vid"),
    "q_video_metrics": with_(*VIDEOS, *metrics("vid", "true_label_id", "pred_label_id"), select=f"SELECT n, {rs(*NAMES)} FROM met"),
    "q_video_logloss": with_(*VIDEOS, select="SELECT round(avg(-ln(greatest(2.220446049250313e-16::DOUBLE, CASE true_label_id WHEN 0 THEN prob_mean_0 WHEN 1 THEN prob_mean_1 ELSE prob_mean_2 END / (prob_mean_0 + prob_mean_1 + prob_mean_2)))), 4) AS log_loss FROM vid"),
    "q_stream_smooth": with_(*PROBS, *STREAM, select=f"SELECT sequence_id, pred_label_id, {rs('smooth_prob_0', 'smooth_prob_1', 'smooth_prob_2', digits=4)} FROM so WHERE k > 1"),
    "q_change_rate": with_(*PROBS, *STREAM, ("lg", "SELECT *, lag(pred_label_id) OVER (PARTITION BY video_id ORDER BY k) AS b FROM so"), ("pv", "SELECT video_id, avg(CASE WHEN b <> pred_label_id THEN 1.0 ELSE 0.0 END) AS q FROM lg WHERE b IS NOT NULL GROUP BY 1"),
        select=f"SELECT {r('coalesce(avg(q), 0)', 'prediction_change_rate')} FROM pv"),
    "q_ear_geometry": with_(("v", "SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings"), ("g", f"SELECT vec_id, {eye()} FROM v"),
        select=f"SELECT vec_id, {rs('ear', 'mar')}, {r('coalesce((ear + mar) / 2, ear, mar)', 'mean_any')}, {r('(ear + mar) / 2', 'mean_both')} FROM g"),
    "q_crop_box": with_(
        ("v", "SELECT vec_id, list_transform(embedding[1:6], lambda x: 320 + x::DOUBLE * 320) AS x, list_transform(embedding[7:12], lambda x: 240 + x::DOUBLE * 240) AS y FROM embeddings"),
        ("b", "SELECT vec_id, (list_min(x) + list_max(x)) / 2 AS cx, (list_min(y) + list_max(y)) / 2 AS cy, greatest(list_max(x) - list_min(x), list_max(y) - list_min(y)) * 1.65::DOUBLE AS s FROM v"),
        ("q", f"SELECT vec_id, s, {_clamp('cx - s / 2', 640)} AS x0, {_clamp('cy - s / 2', 480)} AS y0, {_clamp('cx + s / 2', 640)} AS x1, {_clamp('cy + s / 2', 480)} AS y1 FROM b"),
        select="SELECT vec_id, " + ", ".join(f"CASE WHEN s > 2 AND x1 > x0 AND y1 > y0 THEN {c} END AS {c}" for c in ("x0", "y0", "x1", "y1"))
        + ", CAST(least(vec_id * 7 + 100, 960) AS INT) AS fit_w, CAST(CASE WHEN vec_id * 7 + 100 <= 960 THEN vec_id + 90 ELSE round_even((vec_id + 90) * (960::DOUBLE / (vec_id * 7 + 100)), 0) END AS INT) AS fit_h FROM q"),
    "q_resume": with_(F, select="SELECT DISTINCT video_id, subject_id FROM frames WHERE video_id NOT IN (SELECT video_id FROM frames WHERE face_detected = 0 AND processed_idx < 3)"),
    "q_image_classes": "SELECT lang AS class_name, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INT) AS class_id, count(*) AS n FROM documents GROUP BY lang",
    "q_best_epoch": folded(
        "0 AS best_epoch, '-inf'::DOUBLE AS best_value, 0 AS waited, 0 AS stopped_at",
        """SELECT series, epoch, CASE WHEN better THEN epoch ELSE best_epoch END, CASE WHEN better THEN v ELSE best_value END, w, CASE WHEN w >= 12 THEN epoch ELSE 0 END
           FROM (SELECT *, CASE WHEN better THEN 0 ELSE waited + 1 END AS w FROM (SELECT f.*, e.epoch AS epoch, v, v > best_value + 1e-4::DOUBLE AS better FROM (SELECT * EXCLUDE (epoch), epoch AS was FROM f) f JOIN e ON e.series = f.series AND e.epoch = was + 1 WHERE stopped_at = 0))""",
        "SELECT series, CAST(best_epoch AS INT) AS best_epoch, best_value, CAST(stopped_at AS INT) AS stopped_at FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY epoch DESC) AS k FROM f) WHERE k = 1"),
    "q_plateau": folded(
        "'inf'::DOUBLE AS best, 0 AS bad, 0.001::DOUBLE AS rate",
        """SELECT series, epoch, CASE WHEN better THEN v ELSE best END, CASE WHEN w > 4 THEN 0 ELSE w END, CASE WHEN w > 4 THEN rate * 0.5::DOUBLE ELSE rate END
           FROM (SELECT *, CASE WHEN better THEN 0 ELSE bad + 1 END AS w FROM (SELECT f.*, e.epoch AS epoch, v, v < best * (1 - 1e-4::DOUBLE) AS better FROM (SELECT * EXCLUDE (epoch), epoch AS was FROM f) f JOIN e ON e.series = f.series AND e.epoch = was + 1))""",
        "SELECT series, CAST(epoch AS INT) AS epoch, rate FROM f WHERE epoch > 0"),
    "q_pixels": f"SELECT vec_id, {r('CAST(embedding[1]::DOUBLE * 640 AS FLOAT)', 'x', 4)}, {r('CAST(embedding[7]::DOUBLE * 480 AS FLOAT)', 'y', 4)} FROM embeddings",
    "q_nan_to_num": with_(VALS, select=f"SELECT vec_id, feature, {r('CASE WHEN abs(value) <= 0.1::DOUBLE THEN value ELSE 0 END', 'v')} FROM ev"),
    "q_safe_float": """SELECT event_id, CASE event_id % 6 WHEN 0 THEN CAST(k AS DOUBLE) WHEN 2 THEN -10 * (CAST(k AS DOUBLE) + 0.5) ELSE -1 END AS v
        FROM (SELECT event_id, regexp_extract(props, '([0-9]+)', 1) AS k FROM events)""",
    "q_eligible": with_(*SEQ, select="SELECT sequence_id, label_id FROM seq WHERE is_high_confidence = 1"),
    "q_distinct_subjects": with_(F, MAN, select="SELECT fold, count(DISTINCT subject_id) AS n_groups FROM man GROUP BY 1"),
    "q_scatter_sides": with_(F, ("s", "SELECT video_id, frame_idx, CASE WHEN processed_idx % 3 <> 0 THEN p_closed END AS p_left, CASE WHEN processed_idx % 2 = 0 THEN 1 - p_closed / 4 END AS p_right FROM frames"),
        select="SELECT *, coalesce((p_left + p_right) / 2, p_left, p_right) AS p_closed FROM s"),
    "q_checked_arrays": f"SELECT vec_id, CAST(label % 3 AS INT) AS label_id, concat('Fold', vec_id % 4 + 1) AS fold, {r('embedding[1]', 'first')} FROM embeddings ORDER BY vec_id LIMIT 50",
}
