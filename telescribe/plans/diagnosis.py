"""Queries of anomaly rules, incidents, chains, packets and missions, with their SQL; see registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from telescribe.operators import chains as C
from telescribe.operators import diagnose as D
from telescribe.operators import incidents as I
from telescribe.operators import logs as L
from telescribe.operators import packets as P
from telescribe.operators import relational as R
from telescribe.operators import validate as X
from telescribe.operators import values as V
from telescribe.functions import text
from telescribe.plans import rules
from telescribe.plans.adapters import EVENTS_SQL, LOGS_SQL, SIGNALS_SQL, START_US, events, logs, signals
from telescribe.plans.registry import ANOMALIES, CLASSED, QUERIES, REACH_US, SEVERITY, SQL, VERDICTS, WINDOW_US, anomalies, packet_verdict, prints, query
from telescribe.sinks import layouts

#: Rates of the stand-in are messages an hour.
BIN_US, MARGIN_US, UNIT_US = 3_600_000_000, 10_000_000, 3_600_000_000
names = lambda xs: ", ".join(f"'{x}'" for x in xs)
KEYS, LIDARS, IRS = names(rules.KEY_TOPICS), names(rules.LIDAR_TOPICS), names(rules.IR_TOPICS)
ZEROS = "(" + " OR ".join(f"topic = '{t}' AND field IN ({names(fs)})" for t, fs in rules.EXPECTED_ZERO.items()) + ")"
STATS = "count(value) AS n, round(avg(value) + 1e-9, 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std, min(value) AS low, max(value) AS high"
SIGNED = f"""{EVENTS_SQL}, {SIGNALS_SQL}, bs AS (SELECT bag, min(ts_us) AS s, max(ts_us) AS e FROM sg GROUP BY bag), fs AS (SELECT bag, topic, field, {STATS} FROM sg GROUP BY ALL),
ix AS (SELECT sg.*, s, greatest(ceil((ts_us - s) / {WINDOW_US}) - 1, 0)::BIGINT AS w FROM sg JOIN bs USING (bag)),
ws AS (SELECT bag, topic, field, w, min(s) + w * {WINDOW_US} AS at_us, {STATS} FROM ix GROUP BY bag, topic, field, w),
ms AS (SELECT DISTINCT bag, topic, seq, ts_us FROM sg),
tf AS (SELECT bag, topic, min(ts_us) AS t0, greatest(1, ceil((max(ts_us) - min(ts_us)) / {BIN_US}))::BIGINT AS bins FROM ms GROUP BY bag, topic),
bc AS (SELECT bag, topic, least((ts_us - t0) // {BIN_US}, bins - 1) AS bin, round(count(*) / {BIN_US / UNIT_US} + 1e-9, 2) AS hz FROM ms JOIN tf USING (bag, topic) GROUP BY bag, topic, bins, bin),
hz AS (SELECT bag, topic, any_value(t0) AS t0, any_value(bins) AS bins, round(sum(hz) / any_value(bins) + 1e-9, 2) AS mean_hz, round(sqrt(greatest(sum(hz * hz) / any_value(bins) - (sum(hz) / any_value(bins)) ** 2, 0)) + 1e-9, 2) AS std_hz FROM bc JOIN tf USING (bag, topic) GROUP BY bag, topic),
dr AS (SELECT x.bag, x.topic, t0 + x.bin * {BIN_US} AS at_us, coalesce(bc.hz, 0.0) AS hz, mean_hz FROM (SELECT bag, topic, t0, mean_hz, unnest(range(bins)) AS bin FROM hz WHERE mean_hz > 0) x LEFT JOIN bc ON bc.bag = x.bag AND bc.topic = x.topic AND bc.bin = x.bin WHERE coalesce(bc.hz, 0.0) < 0.3 * mean_hz)"""


def rule(severity: str, category: str, source: str, value: str = "mean", expected: str = "NULL", topic: str = "topic", field: str = "field", at: str = "NULL") -> str:
    category = category if category.startswith("CASE") else f"'{category}'"
    return f"SELECT bag, '{severity}' AS severity, {category} AS category, {topic} AS topic, {field}::VARCHAR AS field, {at}::BIGINT AS ts_us, ({value})::DOUBLE AS value, ({expected})::DOUBLE AS expected FROM {source}"


STILL = f"fs WHERE topic IN ({KEYS}) AND std < 1e-6 AND n > 10 AND NOT {ZEROS}"
FREEZE = f"(SELECT *, lag(std) OVER v AS p_std, lag(mean) OVER v AS p_mean, min(w) OVER (PARTITION BY bag, topic, field) AS fw FROM ws WHERE topic IN ({KEYS}) AND NOT {ZEROS} WINDOW v AS (PARTITION BY bag, topic, field ORDER BY w)) x WHERE fw = 0"
FLAGS = f"topic = '/device/health_status' AND field IN ({names(rules.HEALTH_FLAGS)})"
TURN = f"(SELECT *, lag(mean) OVER (PARTITION BY bag, topic, field ORDER BY w) AS p FROM ws WHERE {FLAGS}) x"
VELOCITY = "(SELECT bag, coalesce(max(high) FILTER (topic = '/chassis_cmd_vel' AND field = 'linear_x'), 0) AS cmd, coalesce(max(high) FILTER (topic = '/odom' AND field = 'twist_linear_x'), 0) AS odom FROM fs GROUP BY bag HAVING bool_or(topic = '/chassis_cmd_vel') AND bool_or(topic = '/odom')) x"
STALLS = "(SELECT c.bag, c.at_us, c.mean FROM ws c LEFT JOIN (SELECT * FROM ws WHERE topic = '/odom' AND field = 'twist_linear_x') o USING (bag, w) WHERE c.topic = '/chassis_cmd_vel' AND c.field = 'linear_x' AND c.mean > 0.05 AND coalesce(o.std, 0) < 1e-6 AND c.bag IN (SELECT bag FROM fs WHERE topic = '/odom')) x"
POSE = "topic = '/localization/current_pose' AND field"
PLACE = f"(SELECT bag, max(std) FILTER ({POSE} = 'position_x') AS x, max(std) FILTER ({POSE} = 'position_y') AS y, max(high - low) FILTER ({POSE} = 'position_x') AS r, max(high - low) FILTER (topic = '/odom' AND field = 'position_x') AS o FROM fs GROUP BY bag) x"
DENSE = f"""(SELECT bag, topic, field, at_us, mean, lag(mean) OVER (PARTITION BY bag, topic ORDER BY w) AS p FROM (SELECT v.bag, v.topic, v.field, v.w, s + v.w * {WINDOW_US} AS at_us, coalesce(ws.mean, 0.0) AS mean FROM
 (SELECT bag, topic, field, s, unnest(range(0, greatest(ceil((e - s) / {WINDOW_US}) - 1, 0)::BIGINT + 1)) AS w FROM fs JOIN bs USING (bag) WHERE topic IN ({LIDARS}) AND field = 'num_valid_points') v
 LEFT JOIN ws ON ws.bag = v.bag AND ws.topic = v.topic AND ws.field = v.field AND ws.w = v.w)) x"""
RULES = {
    "frozen_fields": (rule("WARNING", "ZERO_FIELD", f"{STILL} AND mean = 0"), rule("CRITICAL", "FROZEN_SENSOR", f"{STILL} AND mean <> 0")),
    "freeze_rules": (rule("WARNING", "FREEZE_ONSET", f"{FREEZE} AND p_std > 0.001 AND std < 1e-6", at="at_us"), rule("INFO", "SENSOR_RESUME", f"{FREEZE} AND p_std < 1e-6 AND std > 0.001 AND p_mean <> 0", at="at_us")),
    "freq_dropout": (rule("CRITICAL", f"CASE WHEN topic IN ({LIDARS}) THEN 'LIDAR_FREQ_DROPOUT' ELSE 'FREQUENCY_DROPOUT' END", f"dr JOIN bs USING (bag) WHERE topic IN ({KEYS}, {LIDARS}) AND at_us < e - {MARGIN_US}", "hz", "mean_hz", field="NULL", at="at_us"),),
    "unstable_freq": (rule("WARNING", "UNSTABLE_FREQUENCY", f"hz WHERE topic IN ({KEYS}) AND mean_hz > 0 AND std_hz > 0.2 * mean_hz", "std_hz", "mean_hz", field="NULL"),),
    "cmd_odom_mismatch": (
        rule("CRITICAL", "CMD_ODOM_MISMATCH", f"{VELOCITY} WHERE cmd > 0.01 AND odom < 0.001", "odom", "cmd", "'/odom'", "NULL"), rule("WARNING", "UNEXPECTED_MOTION", f"{VELOCITY} WHERE cmd < 0.001 AND odom > 0.1", "odom", "cmd", "'/odom'", "NULL"),
        rule("WARNING", "STALL_DETECTED", STALLS, topic="'/chassis_cmd_vel'", field="NULL", at="at_us"),
    ),
    "imu_rules": (rule("CRITICAL", "IMU_FROZEN", "fs WHERE topic = '/unbiased_imu_PRY' AND field IN ('x', 'y', 'z') AND std < 1e-6 AND n > 10"), rule("WARNING", "IMU_HIGH_VARIANCE", "fs WHERE topic = '/unbiased_imu_PRY' AND field = 'z' AND std > 100", "std")),
    "localization_rules": (
        rule("WARNING", "LOCALIZATION_STUCK", f"{PLACE} WHERE x < 0.001 AND y < 0.001", "x", topic="'/localization/current_pose'", field="NULL"),
        rule("WARNING", "ODOM_LOC_DIVERGENCE", f"{PLACE} WHERE r > 0.5 AND o > 0.5 AND abs(r / o - 1) > 0.5", "r", "o", "'/localization/current_pose'", "NULL"),
    ),
    "hw_fault": (
        rule("CRITICAL", "HW_FAULT", f"fs WHERE {FLAGS} AND mean < 0.5 AND n > 5"), rule("CRITICAL", "HW_FAULT_ONSET", f"{TURN} WHERE p > 0.5 AND mean < 0.5", at="at_us"), rule("INFO", "HW_FAULT_RECOVERED", f"{TURN} WHERE p < 0.5 AND mean > 0.5", at="at_us"),
        rule("WARNING", "ODOM_HW_ERROR", "fs WHERE topic = '/device/odom_status' AND (field LIKE '%\\_error' ESCAPE '\\' OR field = 'is_gliding') AND low < 0.5"),
        rule("INFO", "IMU_HW_FIELD_ZERO", "fs WHERE topic = '/device/imu_data' AND std < 1e-6 AND n > 10 AND mean = 0 AND field LIKE 'magnetic%'"), rule("WARNING", "IMU_HW_FROZEN", "fs WHERE topic = '/device/imu_data' AND std < 1e-6 AND n > 10 AND mean <> 0"),
    ),
    "point_drop": (rule("WARNING", "LIDAR_POINT_DROP", f"fs WHERE topic IN ({LIDARS}) AND field = 'num_valid_points' AND mean > 50 AND low < 0.3 * mean", "low", "mean"), rule("WARNING", "LIDAR_DEGRADATION", f"{DENSE} WHERE p > 50 AND mean < 0.3 * p", "mean", "p", at="at_us")),
    "equipment_rules": (
        rule("WARNING", "SCRUBBER_NO_WATER", "fs WHERE topic = '/device/scrubber_status' AND field = 'water_level' AND low = 0", "low"),
        rule("WARNING", "IR_SENSOR_DEAD", f"fs WHERE topic IN ({IRS}) AND field = 'data' AND std < 1e-6 AND mean = 0 AND n > 10"),
        rule("WARNING", "PROTECTOR_TRIGGERED", "(SELECT bag, count(*) AS every, count(*) FILTER (k::VARCHAR LIKE '%1%') AS hits FROM (SELECT *, row_number() OVER (PARTITION BY bag ORDER BY ts_us, seq) AS r FROM ev WHERE topic = '/click') WHERE r <= 50 GROUP BY bag) x WHERE hits > 0", "hits", "every", "'/protector'", "NULL"),
    ),
}
KINDS = {
    "frozen_fields": ("ZERO_FIELD", "FROZEN_SENSOR"), "freeze_rules": ("FREEZE_ONSET", "SENSOR_RESUME"), "freq_dropout": ("FREQUENCY_DROPOUT", "LIDAR_FREQ_DROPOUT"), "unstable_freq": ("UNSTABLE_FREQUENCY",),
    "cmd_odom_mismatch": ("CMD_ODOM_MISMATCH", "UNEXPECTED_MOTION", "STALL_DETECTED"), "imu_rules": ("IMU_FROZEN", "IMU_HIGH_VARIANCE"), "localization_rules": ("LOCALIZATION_STUCK", "ODOM_LOC_DIVERGENCE"),
    "hw_fault": ("HW_FAULT", "HW_FAULT_ONSET", "HW_FAULT_RECOVERED", "ODOM_HW_ERROR", "IMU_HW_FIELD_ZERO", "IMU_HW_FROZEN"), "point_drop": ("LIDAR_POINT_DROP", "LIDAR_DEGRADATION"), "equipment_rules": ("SCRUBBER_NO_WATER", "IR_SENSOR_DEAD", "PROTECTOR_TRIGGERED"),
}


def statistics(spark, sf_dir):
    return D.Statistics(signals(spark, sf_dir), WINDOW_US, BIN_US, MARGIN_US, UNIT_US)


def protector(spark, sf_dir):
    """Stand-in for a protector's text messages."""
    return events(spark, sf_dir).where("topic = '/click'").select("bag", F.lit("/protector").alias("topic"), "ts_us", "seq", F.col("k").cast("string").alias("text"))


def part(name: str):
    def run(spark, sf_dir):
        return D.findings(statistics(spark, sf_dir), protector(spark, sf_dir), KINDS[name])

    run.__name__ = name
    return run


for _name, _sql in RULES.items():
    query(f"WITH {SIGNED} " + " UNION ALL ".join(_sql))(part(_name))

EVERY_RULE = " UNION ALL ".join(x for parts in RULES.values() for x in parts)


@query(f"WITH {SIGNED}, every AS ({EVERY_RULE}) SELECT category, severity, count(*) AS n, count(DISTINCT bag) AS bags, count(ts_us) AS timed FROM every GROUP BY ALL")
def anomaly_rules(spark, sf_dir):
    rows = D.findings(statistics(spark, sf_dir), protector(spark, sf_dir))
    return rows.groupBy("category", "severity").agg(F.count("*").alias("n"), F.countDistinct("bag").alias("bags"), F.count("ts_us").alias("timed"))


PROFILED = " UNION ALL ".join([
    *RULES["frozen_fields"], RULES["freeze_rules"][0], RULES["cmd_odom_mismatch"][0], RULES["hw_fault"][0], RULES["hw_fault"][5], RULES["point_drop"][0], RULES["equipment_rules"][1],
    rule("CRITICAL", "FREQ_DROPOUT", f"dr JOIN bs USING (bag) WHERE topic IN ({KEYS}) AND at_us < e - {MARGIN_US}", "hz", "mean_hz", field="NULL", at="at_us"), rule("WARNING", "UNSTABLE_FREQ", f"hz WHERE topic IN ({KEYS}) AND mean_hz > 0 AND std_hz > 0.3 * mean_hz", "std_hz", "mean_hz", field="NULL"),
])
CRITICALS = names(rules.PROFILER_CRITICAL)


@query(f"""WITH {SIGNED}, pf AS ({PROFILED}), ty AS (SELECT bag, category, count(*) AS n FROM pf GROUP BY ALL), lo AS (SELECT bag, count(*) AS logs FROM ev WHERE topic = '/error' AND value > 95 GROUP BY bag),
su AS (SELECT bs.bag, coalesce((SELECT sum(n) FROM ty WHERE ty.bag = bs.bag AND category IN ({CRITICALS})), 0)::BIGINT AS critical, coalesce((SELECT sum(n) FROM ty WHERE ty.bag = bs.bag AND category NOT IN ({CRITICALS})), 0)::BIGINT AS warnings, coalesce(logs, 0) AS logs,
 coalesce((SELECT string_agg(category || ':' || n, ', ' ORDER BY category || ':' || n) FROM ty WHERE ty.bag = bs.bag), '') AS types FROM bs LEFT JOIN lo ON lo.bag = bs.bag)
SELECT *, CASE WHEN critical > 0 OR logs > 20 THEN 'PROBLEMATIC' WHEN warnings > 3 OR logs > 5 THEN 'DEGRADED' WHEN warnings > 0 OR logs > 0 THEN 'MARGINAL' ELSE 'HEALTHY' END AS health FROM su""")
def profiler_summary(spark, sf_dir):
    st = statistics(spark, sf_dir)
    return D.profiler_summary(D.profile(st), st.bags, events(spark, sf_dir).where("topic = '/error' and value > 95"))


@query(f"""WITH {SIGNED} SELECT bag, 'frozen_sensor' AS type, topic, field, NULL::BIGINT AS ts_us, mean AS value FROM fs WHERE std < 1e-6 AND n > 10
 UNION ALL SELECT bag, 'frozen_window', topic, field, at_us, mean FROM ws WHERE std < 1e-6 AND n > 5 AND field NOT IN ({names(rules.WINDOW_MAY_FREEZE)}) UNION ALL SELECT bag, 'frequency_dropout', topic, NULL, at_us, hz FROM dr""")
def validation(spark, sf_dir):
    return D.validation(statistics(spark, sf_dir))


@query(f"""WITH {SIGNED} SELECT bag, 'FROZEN' AS kind, topic, field, NULL::BIGINT AS ts_us, mean AS value FROM fs WHERE std < 1e-6 AND n > 10
 UNION ALL SELECT bag, 'FREQUENCY DROP', topic, NULL, at_us, hz FROM dr UNION ALL SELECT bag, 'UNSTABLE FREQUENCY', topic, NULL, NULL, std_hz FROM hz WHERE std_hz > 0.3 * mean_hz""")
def agent_evidence(spark, sf_dir):
    return D.evidence(statistics(spark, sf_dir))


# incidents: the stand-in anomalies, some without a time, as fields of a robot
FOUND = f"""an AS (SELECT seq, CASE WHEN seq % 11 = 0 THEN NULL ELSE ts_us END AS ts_us, bag, {SEVERITY} AS severity,
 CASE topic WHEN '/click' THEN 'STALL_DETECTED' WHEN '/purchase' THEN 'LIDAR_DEGRADATION' WHEN '/view' THEN 'FREQUENCY_DROPOUT' WHEN '/error' THEN 'FREEZE_ONSET' ELSE 'LOCALIZATION_STUCK' END AS category,
 CASE topic WHEN '/error' THEN '/odom' WHEN '/signup' THEN '/cmd_vel' ELSE topic END AS topic, CASE WHEN topic = '/error' THEN 'twist_linear_x' WHEN topic = '/signup' AND seq % 2 = 0 THEN 'linear_x' ELSE 'value' END AS field FROM ev WHERE value > 60)"""


def found(spark, sf_dir):
    at = F.when(F.col("seq") % 11 != 0, F.col("ts_us"))
    kind = F.expr("CASE topic WHEN '/click' THEN 'STALL_DETECTED' WHEN '/purchase' THEN 'LIDAR_DEGRADATION' WHEN '/view' THEN 'FREQUENCY_DROPOUT' WHEN '/error' THEN 'FREEZE_ONSET' ELSE 'LOCALIZATION_STUCK' END")
    topic = F.expr("CASE topic WHEN '/error' THEN '/odom' WHEN '/signup' THEN '/cmd_vel' ELSE topic END")
    field = F.expr("CASE WHEN topic = '/error' THEN 'twist_linear_x' WHEN topic = '/signup' AND seq % 2 = 0 THEN 'linear_x' ELSE 'value' END")
    rows = events(spark, sf_dir).where("value > 60").select("seq", at.alias("ts_us"), "bag", F.expr(SEVERITY).alias("severity"), kind.alias("category"), topic.alias("topic"), field.alias("field"))
    return D.described(rows)


BAG_CHANGES = f"""{CLASSED}, st AS (SELECT bag, seq, ts_us, CASE log_event {' '.join(f"WHEN '{e}' THEN '{k}.{f}'" for _, e, k, f, _ in rules.PATTERNS if k)} END AS state, matched AS new_value FROM cl),
ch AS (SELECT * FROM (SELECT *, coalesce(lag(new_value) OVER (PARTITION BY bag, state ORDER BY ts_us, seq), '<unknown>') AS old_value FROM st WHERE state IS NOT NULL AND new_value <> '') WHERE old_value <> new_value)"""
MAY = f"category IN ({names(rules.STILL_CATEGORIES)}) AND topic || ' ' || field IN ({names(f'{t} {f}' for t, f in rules.MOTION_FIELDS)})"
JUDGED = f"""{BAG_CHANGES}, {FOUND}, sf AS (SELECT *, lead(ts_us) OVER (PARTITION BY bag ORDER BY ts_us, seq) AS e FROM ch WHERE state = 'motion_state.still_flag'),
tot AS (SELECT bag, sum(e - ts_us) AS still FROM sf WHERE new_value = '1' AND e IS NOT NULL GROUP BY bag),
timed AS (SELECT an.*, CASE WHEN {MAY} AND an.ts_us <> 0 AND sf.new_value = '1' THEN 'Robot stationary per still_flag=1' END AS reason FROM (SELECT * FROM an WHERE ts_us IS NOT NULL) an ASOF LEFT JOIN sf ON an.bag = sf.bag AND an.ts_us >= sf.ts_us),
jd AS (SELECT * FROM timed UNION ALL SELECT an.*, CASE WHEN {MAY} AND still > 0 THEN 'Robot was stationary for ' || round(still / 1e6)::BIGINT || 's (still_flag=1)' END FROM an LEFT JOIN tot USING (bag) WHERE ts_us IS NULL)"""


@query(f"WITH {JUDGED} SELECT seq, bag, category, reason FROM jd")
def state_suppress(spark, sf_dir):
    return I.suppressed(found(spark, sf_dir), L.state_changes(logs(spark, sf_dir), ("bag",))).select("seq", "bag", "category", "reason")


@query(SQL["state_transitions"].replace("FROM ch", "FROM ch WHERE state LIKE 'nav\\_state.%' ESCAPE '\\' OR state LIKE '%.still\\_flag' ESCAPE '\\'"))
def transitions_filter(spark, sf_dir):
    changes = L.state_changes(logs(spark, sf_dir)).select("seq", "ts_us", "state", "old_value", "new_value")
    return L.transitions(changes, key="nav_state").unionByName(L.transitions(changes, field="still_flag"))


@query(SQL["state_asof"].replace("ch.new_value AS value", "coalesce(ch.new_value = '1', FALSE) AS active"))
def state_active(spark, sf_dir):
    probes = events(spark, sf_dir).where("topic = '/error'").select("seq", "ts_us")
    return L.state_active(probes, L.state_periods(L.state_changes(logs(spark, sf_dir))), "motion_state.still_flag", "1")


CAUSE_ROWS = ", ".join(f"('{e}', '{c}')" for e, cs in rules.CAUSES.items() for c in cs)
quoted = lambda s: "'" + s.replace("'", "''") + "'"
CHAIN_ROWS = ", ".join(f"({quoted(e)}, {quoted(c)}, {quoted(t)}, {quoted(r)})" for e, _, c, t, r, _ in rules.CHAINS)
TITLE_ROWS = ", ".join(f"({quoted(c)}, {quoted(t)})" for c, t in D.TITLES.items())
INCIDENTS = f"""{JUDGED}, ca(log_event, category) AS (VALUES {CAUSE_ROWS}), cx(event, category, title, cause) AS (VALUES {CHAIN_ROWS}), tt(category, title) AS (VALUES {TITLE_ROWS}),
ex AS (SELECT seq, log_seq FROM (SELECT jd.seq, cl.seq AS log_seq, row_number() OVER (PARTITION BY jd.seq ORDER BY cl.ts_us, cl.seq) AS r FROM jd JOIN ca ON ca.category = jd.category JOIN cl ON cl.log_event = ca.log_event AND cl.bag = jd.bag AND abs(cl.ts_us - jd.ts_us) <= {REACH_US}
 WHERE reason IS NULL AND jd.ts_us IS NOT NULL) WHERE r = 1),
fr AS (SELECT jd.* FROM jd LEFT JOIN ex USING (seq) WHERE reason IS NULL AND log_seq IS NULL AND ts_us IS NOT NULL),
se AS (SELECT *, sum(new) OVER (PARTITION BY bag, category ORDER BY ts_us, seq)::BIGINT AS session FROM (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY bag, category ORDER BY ts_us, seq) > {REACH_US} THEN 1 ELSE 0 END AS new FROM fr)),
ev2 AS (SELECT jd.*, 'suppressed' AS kind, 's' || seq AS key FROM jd WHERE reason IS NOT NULL UNION ALL SELECT jd.*, 'chained', 'l' || log_seq FROM jd JOIN ex USING (seq)
 UNION ALL SELECT seq, ts_us, bag, severity, category, topic, field, reason, 'clustered', 'c ' || category || ' ' || session FROM se UNION ALL SELECT jd.*, 'whole', 'w ' || category FROM jd WHERE reason IS NULL AND ts_us IS NULL),
gr AS (SELECT bag, kind, key, arg_max(severity, CASE severity WHEN 'CRITICAL' THEN 3 WHEN 'WARNING' THEN 2 ELSE 1 END) AS severity, min(category) AS category, min(ts_us) AS s, max(ts_us) AS e, count(*) AS anomalies, max(reason) AS reason,
 arg_min(topic || '.' || field, seq) AS place, string_agg(DISTINCT topic, ', ' ORDER BY topic) AS topics FROM ev2 GROUP BY ALL),
jo AS (SELECT gr.*, cl.ts_us AS log_us, cl.log_event AS event, coalesce(cl.ts_us, s) AS at_us FROM gr LEFT JOIN cl ON kind = 'chained' AND cl.bag = gr.bag AND 'l' || cl.seq = key),
lv AS (SELECT jo.bag, jo.key, cl.seq, cl.log_event, row_number() OVER (PARTITION BY jo.bag, jo.key ORDER BY 'l' || cl.seq <> jo.key, cl.ts_us, cl.seq) AS r FROM jo JOIN cl ON cl.bag = jo.bag AND cl.log_event <> 'UNMATCHED' AND abs(cl.ts_us - at_us) <= {REACH_US} WHERE kind <> 'suppressed'),
ln AS (SELECT bag, key, count(*) AS logs, max(CASE WHEN r = 1 THEN log_event END) AS first_event FROM lv GROUP BY ALL),
sc AS (SELECT jo.bag, jo.key, ch.state, arg_max(ch.new_value, (ch.ts_us, ch.seq)) AS v FROM jo JOIN ch ON ch.bag = jo.bag AND ch.ts_us <= at_us GROUP BY ALL), sx AS (SELECT bag, key, string_agg(state || '=' || v, ', ' ORDER BY state) AS states FROM sc GROUP BY ALL),
fu AS (SELECT jo.*, logs, first_event, states, cx.category AS chain_category, cx.title AS chain_title, cx.cause, replace(coalesce(tt.title, jo.category), '{{0}}', place) AS description
 FROM jo LEFT JOIN ln USING (bag, key) LEFT JOIN sx USING (bag, key) LEFT JOIN cx ON cx.event = jo.event LEFT JOIN tt ON tt.category = jo.category),
ic AS (SELECT bag, kind, key, severity, coalesce(chain_category, category) AS category, least(s, log_us) AS start_us, greatest(e, log_us) AS end_us, anomalies,
 CASE kind WHEN 'clustered' THEN least(coalesce(logs, 0), 5) ELSE coalesce(logs, 0) END AS logs, reason,
 CASE kind WHEN 'suppressed' THEN category || ': ' || place WHEN 'chained' THEN chain_title WHEN 'whole' THEN category || ' (bag-wide, ' || anomalies || ' anomalies)' ELSE CASE WHEN anomalies = 1 THEN description[:80] ELSE category || ' on ' || topics || ' (' || anomalies || ' anomalies)' END END AS title,
 CASE kind WHEN 'suppressed' THEN reason WHEN 'chained' THEN cause WHEN 'whole' THEN 'Bag-wide sensor anomaly, no specific timestamp' ELSE CASE WHEN logs > 0 THEN 'Sensor anomaly correlated with log events: ' || first_event WHEN states IS NOT NULL THEN 'Sensor anomaly detected (state: ' || states || ')'
 ELSE 'Sensor anomaly detected, no correlated log events found' END END AS root_cause FROM fu),
nr AS (SELECT *, (row_number() OVER (PARTITION BY bag ORDER BY coalesce(start_us, 0), CASE kind WHEN 'suppressed' THEN 0 WHEN 'chained' THEN 1 ELSE 2 END, category, key))::VARCHAR AS r FROM ic),
nm AS (SELECT * EXCLUDE (r), 'INC-' || CASE WHEN len(r) < 3 THEN lpad(r, 3, '0') ELSE r END AS incident_id FROM nr)"""


def built(spark, sf_dir, lists=True):
    rows = logs(spark, sf_dir)
    return I.incidents(found(spark, sf_dir), L.classified(rows), L.state_changes(rows, ("bag",)), REACH_US, REACH_US, lists)


COLUMNS = ["bag", "incident_id", "kind", "key", "severity", "category", "start_us", "end_us", "anomalies", "logs", "title", "root_cause", "reason"]


@query(f"WITH {INCIDENTS} SELECT {', '.join(COLUMNS)} FROM nm")
def incidents(spark, sf_dir):
    return built(spark, sf_dir, lists=False).withColumn("logs", F.coalesce("logs", F.lit(0).cast("bigint"))).select(*COLUMNS)


@query(f"WITH {INCIDENTS} SELECT bag, key, category, logs, root_cause FROM nm WHERE kind = 'clustered'")
def cluster_evidence(spark, sf_dir):
    return incidents(spark, sf_dir).where("kind = 'clustered'").select("bag", "key", "category", "logs", "root_cause")


@query(f"""WITH {INCIDENTS}, ke AS (SELECT lv.*, kind, category, incident_id FROM lv JOIN nm USING (bag, key))
SELECT bag, incident_id, category, 'incident' AS type, start_us AS timestamp_us, title FROM nm WHERE kind <> 'suppressed' UNION ALL SELECT bag, incident_id, category, 'log_evidence', cl.ts_us, '' FROM (SELECT ke.bag, incident_id, ke.category, ke.seq FROM ke WHERE kind <> 'clustered' OR r <= 5) k JOIN cl USING (bag, seq)
 UNION ALL SELECT bag, incident_id, ev2.category, 'sensor_evidence', NULL, '' FROM ev2 JOIN nm USING (bag, key) WHERE nm.kind <> 'suppressed' UNION ALL SELECT bag, 'SUPPRESSED', category, 'suppressed', start_us, title FROM nm WHERE kind = 'suppressed'""")
def incident_rows(spark, sf_dir):
    return I.incident_rows(built(spark, sf_dir)).select("bag", "incident_id", "category", "type", "timestamp_us", "title")


@query(f"WITH {CLASSED}, {ANOMALIES} SELECT an.seq AS anomaly_seq, cl.seq AS log_seq, cl.log_event FROM an JOIN cl ON cl.bag = an.bag AND cl.log_event <> 'UNMATCHED' AND abs(cl.ts_us - an.ts_us) <= {REACH_US} WHERE an.severity = 'CRITICAL'")
def log_evidence(spark, sf_dir):
    points = anomalies(spark, sf_dir).where("severity = 'CRITICAL'").select("bag", F.col("seq").alias("key"), F.col("ts_us").alias("at_us"))
    return I.log_evidence(points, L.classified(logs(spark, sf_dir)), REACH_US).select(F.col("key").alias("anomaly_seq"), F.col("seq").alias("log_seq"), "log_event")


WEEKS = "(SELECT DISTINCT bag, bag // 7 AS mission FROM ev)"


def weeks(spark, sf_dir):
    """Stand-in missions of seven recordings."""
    return events(spark, sf_dir).select("bag", F.floor(F.col("bag") / 7).alias("mission")).distinct()


def ends(spark, sf_dir):
    return events(spark, sf_dir).groupBy("bag").agg(F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"))


@query(f"""WITH {INCIDENTS}, mi AS {WEEKS}, be AS (SELECT bag, min(ts_us) AS s, max(ts_us) AS e FROM ev GROUP BY bag), ca2 AS (SELECT mission, count(*) AS bags, min(s) AS start_us, max(e) AS end_us FROM be JOIN mi USING (bag) GROUP BY mission),
pi AS (SELECT mission, count(*) FILTER (kind <> 'suppressed') AS incidents, count(*) FILTER (kind <> 'suppressed' AND severity = 'CRITICAL') AS critical, count(*) FILTER (kind <> 'suppressed' AND severity = 'WARNING') AS warning, count(*) FILTER (kind <> 'suppressed' AND severity = 'INFO') AS info, count(*) FILTER (kind = 'suppressed') AS suppressed FROM nm JOIN mi USING (bag) GROUP BY mission)
SELECT mission, bags, start_us, end_us, incidents, critical, warning, info, suppressed, (SELECT count(*) FROM an JOIN mi USING (bag) WHERE mi.mission = ca2.mission) AS anomalies, (SELECT count(*) FROM cl JOIN mi USING (bag) WHERE mi.mission = ca2.mission) AS log_events, (SELECT count(*) FROM ch JOIN mi USING (bag) WHERE mi.mission = ca2.mission) AS state_changes,
 CASE WHEN critical > 0 THEN 'UNHEALTHY' WHEN warning > 3 THEN 'DEGRADED' WHEN warning > 0 THEN 'MARGINAL' ELSE 'HEALTHY' END AS health FROM ca2 JOIN pi USING (mission)""")
def mission_summary(spark, sf_dir):
    rows = logs(spark, sf_dir)
    return I.mission_summary(weeks(spark, sf_dir), ends(spark, sf_dir), built(spark, sf_dir, lists=False), found(spark, sf_dir), rows, L.state_changes(rows, ("bag",)))


@query(f"""WITH {EVENTS_SQL}, {ANOMALIES}, mi AS {WEEKS}, x AS (SELECT bag, user_id FROM an WHERE severity = 'CRITICAL' GROUP BY ALL), cr AS (SELECT a.bag FROM x a JOIN x b ON a.user_id = b.user_id AND a.bag = b.bag + 1),
s AS (SELECT mission, (SELECT count(*) FROM an JOIN mi m USING (bag) WHERE m.mission = mi.mission AND severity = 'CRITICAL') AS critical, (SELECT count(*) FROM an JOIN mi m USING (bag) WHERE m.mission = mi.mission AND severity = 'WARNING') AS warning, (SELECT count(*) FROM cr JOIN mi m USING (bag) WHERE m.mission = mi.mission) AS crossing FROM mi GROUP BY mission)
SELECT *, CASE WHEN critical > 0 OR crossing > 0 THEN 'UNHEALTHY' WHEN warning > 5 THEN 'DEGRADED' WHEN warning > 0 THEN 'MARGINAL' ELSE 'HEALTHY' END AS health FROM s""")
def mission_health(spark, sf_dir):
    rows = anomalies(spark, sf_dir)
    x = rows.where("severity = 'CRITICAL'").select("bag", "user_id").distinct()
    crossing = x.join(x.select((F.col("bag") + 1).alias("bag"), "user_id"), ["bag", "user_id"])
    return I.mission_health(weeks(spark, sf_dir), rows, crossing)


@query(f"""WITH {EVENTS_SQL}, be AS (SELECT bag, min(ts_us) AS s, max(ts_us) AS e FROM ev GROUP BY bag), pi AS ({SQL["persistent_incidents"]})
SELECT category, 'Persistent ' || category || ' across ' || bags || ' consecutive bags' AS title, 'CRITICAL' AS severity, a.s AS start_us, b.e AS end_us, bags FROM pi JOIN be a ON a.bag = first_bag JOIN be b ON b.bag = first_bag + bags - 1""")
def persistent_reports(spark, sf_dir):
    return I.persistent(QUERIES["persistent_incidents"](spark, sf_dir), ends(spark, sf_dir))


# chains: the stand-in anomalies of nodes that subsystems know, in windows of 6 hours
NODES = ("/dl_infer", "/depthcam_fusion", "/chassis")
WINDOWED = f"(ts_us - {START_US}) // {WINDOW_US}"
NOTED = f"""{EVENTS_SQL}, no AS (SELECT seq, {WINDOWED} AS w, CASE topic WHEN '/signup' THEN {START_US} + {WINDOWED} * {WINDOW_US} ELSE ts_us END AS ts, CASE user_id % 3 {' '.join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(NODES))} END AS node, CASE WHEN user_id % 50 = 7 THEN '/rare/' || seq ELSE topic END AS template,
 CASE topic WHEN '/signup' THEN 'regime_transition_appeared' ELSE 'rate_anomaly' END AS kind FROM ev WHERE value > 95)"""
CHAINED = f"""{NOTED}, ty AS (SELECT *, node || chr(31) || template || chr(31) || kind AS type FROM no), ao AS (SELECT seq, 'at ' || ts AS chain, 'transition' AS how FROM ty WHERE kind LIKE 'regime%' AND ts IN (SELECT ts FROM ty WHERE kind LIKE 'regime%' GROUP BY ts HAVING count(*) >= 2)),
re AS (SELECT * FROM ty WHERE seq NOT IN (SELECT seq FROM ao)), ac AS (SELECT DISTINCT w, type, node FROM re), sz AS (SELECT type, any_value(node) AS node, count(*) AS s FROM ac GROUP BY type),
se AS (SELECT DISTINCT w, type FROM (SELECT unnest([w - 1, w, w + 1]) AS w, type FROM ac) WHERE w IN (SELECT w FROM ac)), co AS (SELECT a.type AS a, b.type AS b, count(*) AS n FROM se a JOIN se b ON a.w = b.w AND a.type < b.type GROUP BY ALL),
jc AS (SELECT co.a, co.b, x.s + y.s - n AS u, n / nullif(x.s + y.s - n, 0) AS j, CASE WHEN x.node <> '/chassis' AND y.node <> '/chassis' OR x.node = '/chassis' AND y.node = '/chassis' THEN 0.3 ELSE 0.5 END AS least FROM co JOIN sz x ON x.type = co.a JOIN sz y ON y.type = co.b),
ed AS (SELECT a, b FROM jc WHERE u > 0 AND round(j, 6) >= least), bi AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed), cl2 AS (SELECT type AS a, type AS b FROM sz UNION SELECT cl2.a, bi.b FROM cl2 JOIN bi ON cl2.b = bi.a),
cp AS (SELECT a AS type, min(b) AS component FROM cl2 GROUP BY a), big AS (SELECT component FROM cp GROUP BY component HAVING count(*) >= 2),
mb AS (SELECT seq, chain, how FROM ao UNION ALL SELECT re.seq, 'of ' || component, 'together' FROM re JOIN cp USING (type) WHERE component IN (SELECT component FROM big)),
mm AS (SELECT ty.*, chain, how, CASE node WHEN '/dl_infer' THEN 5 WHEN '/depthcam_fusion' THEN 7 ELSE 3 END AS weight FROM ty JOIN mb USING (seq)), rt AS (SELECT chain, arg_max(seq, (weight, -ts, -seq)) AS root, max(weight) AS weight FROM mm GROUP BY chain),
ow AS (SELECT chain, how, count(DISTINCT type) AS types, count(*) AS members, count(DISTINCT w) AS windows, min(ts) AS first_ts, max(ts) AS last_ts FROM mm GROUP BY ALL),
al AS (SELECT x.chain, sum(CASE WHEN u > 0 THEN j END) AS sum, count(*) FILTER (u <= 0) AS out FROM jc JOIN (SELECT DISTINCT chain, type FROM mm WHERE how = 'together') x ON x.type = jc.a JOIN (SELECT DISTINCT chain, type FROM mm WHERE how = 'together') y ON y.type = jc.b AND x.chain = y.chain GROUP BY x.chain),
ch2 AS (SELECT ow.chain, how, root, round(CASE how WHEN 'transition' THEN weight * members * 2.0 ELSE weight * types * log2(1.0 + windows) END + 1e-9, 2) AS severity, types, members, first_ts, last_ts,
 round(CASE WHEN how = 'transition' THEN 1.0 WHEN types * (types - 1) / 2 - coalesce(out, 0) > 0 THEN coalesce(sum, 0) / (types * (types - 1) / 2 - coalesce(out, 0)) ELSE 0.0 END + 1e-9, 3) AS jaccard FROM ow JOIN rt USING (chain) LEFT JOIN al USING (chain)),
ck AS (SELECT *, (row_number() OVER (ORDER BY severity DESC, first_ts, root) - 1)::INTEGER AS chain_id FROM ch2)"""


def noted(spark, sf_dir):
    w = F.floor((F.col("ts_us") - START_US) / WINDOW_US).cast("bigint")
    node = text.chosen([(F.col("user_id") % 3 == i, F.lit(n)) for i, n in enumerate(NODES)])
    sign = F.col("topic") == "/signup"
    return events(spark, sf_dir).where("value > 95").select("seq", w.alias("w"), F.when(sign, START_US + w * WINDOW_US).otherwise(F.col("ts_us")).alias("ts"), node.alias("node"), F.when(F.col("user_id") % 50 == 7, F.concat(F.lit("/rare/"), F.col("seq").cast("string"))).otherwise(F.col("topic")).alias("template"), F.when(sign, "regime_transition_appeared").otherwise("rate_anomaly").alias("kind"), F.lit(1.0).alias("score"))


@query(f"WITH RECURSIVE {CHAINED} SELECT replace(type, chr(31), ' ') AS node, replace(component, chr(31), ' ') AS component FROM cp")
def components(spark, sf_dir):
    from telescribe.operators.graph import components as of

    rows = noted(spark, sf_dir)
    links = C.chained(rows).where("how = 'transition'")
    rest = rows.join(links, "seq", "left_anti").withColumn("type", C.type_of())
    edges = L.similarity_edges(rest.select("w", "type"), 0.5, 0.3, C.subsystem).select(F.col("type_a").alias("a"), F.col("type_b").alias("b"))
    plain = lambda c: F.replace(c, F.lit(C.MARK), F.lit(" ")).alias(c)
    return of(rest.select(F.col("type").alias("node")), edges).select(plain("node"), plain("component"))


@query(f"WITH RECURSIVE {CHAINED} SELECT replace(chain, chr(31), ' ') AS chain, how, root, severity, types, members, first_ts, last_ts, jaccard, chain_id FROM ck")
def causal_chains(spark, sf_dir):
    return C.causal_chains(noted(spark, sf_dir)).withColumn("chain", F.replace("chain", F.lit(C.MARK), F.lit(" ")))


@query(f"WITH RECURSIVE {CHAINED} SELECT chain_id, root, node, template FROM ck JOIN ty ON ty.seq = ck.root")
def chain_root(spark, sf_dir):
    return causal_chains(spark, sf_dir).select("chain_id", "root").join(noted(spark, sf_dir).select(F.col("seq").alias("root"), "node", "template"), "root")


@query(f"WITH RECURSIVE {CHAINED} SELECT chain_id, severity FROM ck")
def chain_severity(spark, sf_dir):
    return causal_chains(spark, sf_dir).select("chain_id", "severity")


@query(f"WITH RECURSIVE {CHAINED} SELECT seq, node, kind FROM ty WHERE seq NOT IN (SELECT seq FROM mb)")
def isolated_anomalies(spark, sf_dir):
    rows = noted(spark, sf_dir)
    return C.isolated(rows, C.chained(rows)).select("seq", "node", "kind")


VALIDATED = [{"name": "cascade", "root": ["/depthcam_fusion", "x"], "confidence": 0.8}, {"name": "late", "root": ["/dl_infer", "y"], "confidence": 0.5}]


@query(f"""WITH RECURSIVE {CHAINED} SELECT chain_id, round(severity * CASE WHEN bool_or(node = '/depthcam_fusion') THEN 1.8 WHEN bool_or(node = '/dl_infer') THEN 1.5 ELSE 1.0 END, 4) AS severity, CASE WHEN bool_or(node = '/depthcam_fusion') THEN 'cascade' WHEN bool_or(node = '/dl_infer') THEN 'late' END AS rule
FROM ck JOIN mm USING (chain) GROUP BY chain_id, severity""")
def rule_boost(spark, sf_dir):
    rows = noted(spark, sf_dir)
    members = rows.join(C.chained(rows), "seq").select("chain", "node")
    return C.boosted(C.causal_chains(rows), members, VALIDATED).select("chain_id", F.round("severity", 4).alias("severity"), "rule")


@query(f"""WITH RECURSIVE {CHAINED} SELECT ty.seq, ty.ts, rpad(kind, 25, ' ') || ' ' || rpad(node, 35, ' ') || ' [' || rpad(template[:50], 50, ' ') || '] ' || coalesce('CHAIN[' || chain_id || ']', 'ISOLATED') AS line FROM ty LEFT JOIN mb ON mb.seq = ty.seq LEFT JOIN ck ON ck.chain = mb.chain""")
def annotate(spark, sf_dir):
    rows = noted(spark, sf_dir)
    return C.annotated(rows, C.causal_chains(rows), C.chained(rows))


# packets
DENOISED = f"""{VERDICTS}, {CLASSED.removeprefix(LOGS_SQL + ", ")}, ro AS (SELECT cl.*, r.route, r.dedup_key FROM cl JOIN (SELECT seq, route, dedup_key FROM ({SQL["denoise_dedup"].split(" SELECT dedup_key, count(*)")[0].split(", r AS (")[1].rsplit(")", 1)[0]})) r USING (seq)),
dn AS (SELECT *, 1::BIGINT AS dedup_count FROM ro WHERE route NOT IN ('noise', 'dedup') UNION ALL SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY dedup_key) AS dedup_count FROM ro WHERE route = 'dedup' QUALIFY row_number() OVER (PARTITION BY dedup_key ORDER BY ts_us, seq) = 1)),
pk AS (SELECT seq, ts_us, dedup_count, CASE WHEN level >= 8 AND regexp_matches(raw_message, '(?i)fault|disconnect|emergency|critical') THEN 'CRITICAL' WHEN level >= 4 THEN 'WARNING' ELSE 'INFO' END AS sev,
 CASE WHEN log_event <> 'UNMATCHED' THEN upper(log_event) WHEN level >= 8 THEN 'ERROR' WHEN regexp_matches(raw_message, '(?i)fail') THEN 'FAILURE' WHEN regexp_matches(raw_message, '(?i)stuck|deadlock') THEN 'NAVIGATION_STUCK' ELSE 'INFO' END AS cat,
 level >= 8 OR coalesce(regexp_matches(raw_message, '(?i){"|".join(f"(?:{p})" for p, *_ in rules.CHECKS)}'), FALSE) AS wants_sensors FROM dn),
pa AS (SELECT seq, ts_us, dedup_count, wants_sensors, CASE WHEN dedup_count > 50 AND sev = 'INFO' THEN 'WARNING' ELSE sev END AS severity, CASE WHEN dedup_count > 50 AND sev = 'INFO' THEN 'HIGH_FREQUENCY_EVENT' ELSE cat END AS category,
 CASE WHEN wants_sensors THEN coalesce(pv.verdict, 'UNCHECKED') ELSE 'UNCHECKED' END AS verdict, CASE WHEN wants_sensors THEN coalesce(pv.confidence, 0.0) ELSE 0.0 END AS confidence FROM pk LEFT JOIN pv USING (seq))"""


def evidence(spark, sf_dir):
    return P.packets(P.denoised(L.classified(logs(spark, sf_dir))), packet_verdict(spark, sf_dir))


@query(f"WITH {DENOISED} SELECT seq, ts_us, severity, category, dedup_count, verdict, confidence, wants_sensors FROM pa")
def packets(spark, sf_dir):
    return evidence(spark, sf_dir)


@query(f"""WITH {DENOISED}, w AS (SELECT seq, ts_us, CASE WHEN verdict = 'CONTRADICTED' THEN 0 WHEN severity = 'CRITICAL' THEN 1 WHEN verdict = 'CONFIRMED' AND dedup_count > 10 THEN 2 WHEN severity = 'WARNING' THEN 3 END AS why FROM pa)
SELECT (row_number() OVER (ORDER BY why, ts_us, seq))::INTEGER AS place, seq, why FROM w WHERE why IS NOT NULL ORDER BY place LIMIT 50""")
def llm_selection(spark, sf_dir):
    return P.selection(evidence(spark, sf_dir))


@query(f"""WITH {DENOISED}, c AS (SELECT DISTINCT category FROM pa WHERE severity IN ('CRITICAL', 'WARNING') OR verdict IN ('CONFIRMED', 'CONTRADICTED')), m(category, layout) AS (VALUES {", ".join(f"('{c}', '{n}')" for c, n in layouts.BY_CATEGORY.items())})
SELECT DISTINCT layout FROM c JOIN m USING (category)""")
def layout_select(spark, sf_dir):
    return layouts.selected(evidence(spark, sf_dir))


@query(f"WITH {DENOISED} SELECT seq, 'EP-' || lpad(n::VARCHAR, greatest(4, length(n::VARCHAR))::INTEGER, '0') AS packet_id FROM (SELECT seq, row_number() OVER (ORDER BY ts_us, seq) AS n FROM pa)")
def packet_ids(spark, sf_dir):
    rows = R.numbered(P.denoised(L.classified(logs(spark, sf_dir))).select("ts_us", "seq"), ["ts_us", "seq"], "n")
    return rows.select("seq", F.format_string("EP-%04d", F.col("n") + 1).alias("packet_id"))


@query(f"WITH {DENOISED} SELECT seq, ts_us FROM (SELECT seq, ts_us, row_number() OVER (ORDER BY ts_us, seq) AS r FROM pa WHERE wants_sensors) WHERE (r - 1) % 5 = 0")
def sampled_packets(spark, sf_dir):
    return P.every_nth(P.classified(P.denoised(L.classified(logs(spark, sf_dir)))), 5).select("seq", "ts_us")


# claims of log texts and the fields that they look at, rule by rule; windows of a recording's topics, empty ones included
SNAP_TOPICS = names(rules.SNAPSHOT_TOPICS)
ONE = lambda t, f, c: f"max({c}) FILTER (topic = '{t}' AND field = '{f}')"
AXES = ", ".join(f"{ONE(t, a, 'n')} AS {p}{i}_n, {ONE(t, a, 'std')} AS {p}{i}_s" for p, t in (("p", "/unbiased_imu_PRY"), ("d", "/device/imu_data")) for i, a in enumerate(rules.IMU_AXES))
AXIS = lambda p: "CASE " + " ".join(f"WHEN {p}{i}_n >= 2 THEN CASE WHEN {p}{i}_s < 1e-4 THEN 'CONFIRMED' ELSE 'CONTRADICTED' END" for i in range(len(rules.IMU_AXES))) + " ELSE 'NO_SENSOR_DATA' END"
STOPPED = "CASE WHEN lx_n IS NULL THEN 'NO_SENSOR_DATA' WHEN abs(lx_m) < 0.01 AND abs(coalesce(az_m, 0)) < 0.01 THEN 'CONFIRMED' ELSE 'CONTRADICTED' END"
CLAIMED = {
    "(make.*plan.*fail|DijkstraSearch.*fail|MakePlan.*fail)": ("path_planning_failed_check_velocity", STOPPED),
    r"still_flag[:\s=]*1": ("still_flag_check_odom", "CASE WHEN lx_n IS NULL OR lx_n < 2 THEN 'NO_SENSOR_DATA' WHEN lx_s < 1e-4 THEN 'CONFIRMED' ELSE 'CONTRADICTED' END"),
    r"still_flag[:\s=]*0": ("still_flag_moving_check_odom", "CASE WHEN lx_n IS NULL OR lx_n < 2 THEN 'NO_SENSOR_DATA' WHEN lx_s > 1e-4 OR abs(lx_m) > 0.01 THEN 'CONFIRMED' ELSE 'CONTRADICTED' END"),
    r"(is_localized:\s*0|locali[sz]ation.*lost|Tf tranform failed)": ("localization_lost_check_pose", "CASE WHEN px_n IS NULL OR px_n < 2 THEN 'NO_SENSOR_DATA' WHEN px_s < 1e-4 AND coalesce(py_s, 0) < 1e-4 THEN 'CONFIRMED' ELSE 'CONTRADICTED' END"),
    "imu.*calibrat": ("imu_calibrating_check_imu", f"CASE WHEN imu1 THEN {AXIS('p')} WHEN imu2 THEN {AXIS('d')} ELSE 'NO_SENSOR_DATA' END"),
    r"not move time:\s*([\d.]+)": ("not_moving_check_velocity", STOPPED),
    "cmd not safe": ("cmd_not_safe_check_cmd_vel", "CASE WHEN CASE WHEN cmd1 THEN c1_m WHEN cmd2 THEN c2_m END IS NULL THEN 'NO_SENSOR_DATA' WHEN abs(CASE WHEN cmd1 THEN c1_m ELSE c2_m END) < 0.01 THEN 'CONFIRMED' ELSE 'CONTRADICTED' END"),
}


@query(f"""WITH {LOGS_SQL}, {SIGNALS_SQL}, bs AS (SELECT bag, min(ts_us) AS s, max(ts_us) AS e FROM sg WHERE topic IN ({SNAP_TOPICS}) GROUP BY bag),
wn AS (SELECT bag, topic, w, s + w * {WINDOW_US} AS a, least(s + (w + 1) * {WINDOW_US}, e) AS b FROM (SELECT bag, topic, s, e, unnest(range(0, greatest(ceil((e - s) / {WINDOW_US}) - 1, 0)::BIGINT + 1)) AS w FROM (SELECT DISTINCT bag, topic FROM sg WHERE topic IN ({SNAP_TOPICS})) JOIN bs USING (bag))),
fs AS (SELECT bag, topic, greatest(ceil((ts_us - s) / {WINDOW_US}) - 1, 0)::BIGINT AS w, field, {STATS} FROM sg JOIN bs USING (bag) GROUP BY ALL),
nw AS (SELECT seq, bag, topic, w FROM (SELECT lg.seq, wn.bag, wn.topic, wn.w, row_number() OVER (PARTITION BY lg.seq, wn.topic ORDER BY abs(2 * lg.ts_us - a - b), a) AS r FROM lg JOIN wn USING (bag) WHERE abs(2 * lg.ts_us - a - b) < {4 * WINDOW_US}) WHERE r = 1),
one AS (SELECT seq, {ONE('/odom', 'twist_linear_x', 'n')} AS lx_n, {ONE('/odom', 'twist_linear_x', 'mean')} AS lx_m, {ONE('/odom', 'twist_linear_x', 'std')} AS lx_s, {ONE('/odom', 'twist_angular_z', 'mean')} AS az_m,
 {ONE('/localization/current_pose', 'position_x', 'n')} AS px_n, {ONE('/localization/current_pose', 'position_x', 'std')} AS px_s, {ONE('/localization/current_pose', 'position_y', 'std')} AS py_s, {AXES},
 bool_or(topic = '/unbiased_imu_PRY') AS imu1, bool_or(topic = '/device/imu_data') AS imu2, bool_or(topic = '/chassis_cmd_vel') AS cmd1, bool_or(topic = '/cmd_vel') AS cmd2, {ONE('/chassis_cmd_vel', 'linear_x', 'mean')} AS c1_m, {ONE('/cmd_vel', 'linear_x', 'mean')} AS c2_m
 FROM nw JOIN fs USING (bag, topic, w) GROUP BY seq)
""" + " UNION ALL ".join(f"SELECT seq, '{name}' AS rule, {verdict} AS verdict FROM lg LEFT JOIN one USING (seq) WHERE regexp_matches(raw_message, '(?i){pattern}')" for pattern, (name, verdict) in CLAIMED.items()))
def cross_validation(spark, sf_dir):
    rows = logs(spark, sf_dir).select("bag", "seq", "ts_us", "raw_message")
    snaps = X.snapshots(rows, X.windows(signals(spark, sf_dir), WINDOW_US), WINDOW_US)
    return X.checked(rows, snaps).select("seq", F.explode("checks").alias("c")).select("seq", "c.rule", "c.verdict")


FIRST = "(SELECT min(ts_us) FROM ev WHERE topic = '/error' AND value > 90)"
SLICE_US = 7_200_000_000


@query(f"WITH {EVENTS_SQL} SELECT seq, ts_us, topic, value FROM ev WHERE topic IN ('/click', '/view') AND ts_us BETWEEN {FIRST} - {SLICE_US} AND {FIRST} + {SLICE_US}")
def context_slice(spark, sf_dir):
    rows = events(spark, sf_dir)
    first = rows.where("topic = '/error' and value > 90").agg(F.min("ts_us").alias("at"))
    near = rows.where(F.col("topic").isin("/click", "/view")).join(F.broadcast(first)).where(F.abs(F.col("ts_us") - F.col("at")) <= SLICE_US)
    return near.select("seq", "ts_us", "topic", "value")


@query(f"WITH {EVENTS_SQL} SELECT seq, 'k' AS field, k::DOUBLE AS value FROM ev WHERE k IS NOT NULL UNION ALL SELECT seq, 'value', value FROM ev")
def field_explode(spark, sf_dir):
    kv = F.from_json("props", "map<string,string>")
    every = F.map_concat(kv, F.create_map(F.lit("value"), F.col("value").cast("string")))
    return events(spark, sf_dir).select("seq", F.explode(every).alias("field", "text")).select("seq", "field", F.col("text").try_cast("double").alias("value")).where("value is not null")


@query("SELECT vec_id, CASE WHEN len(embedding) > 20 THEN embedding[1:10] ELSE embedding END::DOUBLE[] AS first_10, CASE WHEN len(embedding) > 20 THEN embedding[-10:] END::DOUBLE[] AS last_10, len(embedding) AS length FROM embeddings")
def array_preview(spark, sf_dir):
    e = F.col("embedding").cast("array<double>")
    long = F.size(e) > 20
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.when(long, F.slice(e, 1, 10)).otherwise(e).alias("first_10"), F.when(long, F.slice(e, -10, 10)).alias("last_10"), F.size(e).cast("bigint").alias("length"))


@query(f"WITH pr AS ({SQL['node_profiles']}) SELECT greatest(coalesce(max(median_ms) FILTER (kind = 'periodic' AND median_ms > 0), 1000.0), 1000.0) AS width_ms FROM pr")
def auto_window(spark, sf_dir):
    return L.auto_window_ms(L.node_profiles(logs(spark, sf_dir)))


@query(f"""WITH fp AS ({SQL["fingerprint"]}), pr AS ({SQL["node_profiles"]}), sh AS (SELECT node, template, sum(n) AS t FROM fp GROUP BY ALL), du AS (SELECT sh.node, sh.template, {WINDOW_US / 1000} / median_ms * t / pr.n AS due FROM sh JOIN pr USING (node) WHERE kind <> 'event_driven' AND median_ms > 0)
SELECT w, fp.node, fp.template, fp.n, round(coalesce(fp.n / due, 1.0), 6) AS ratio FROM fp LEFT JOIN du ON du.node = fp.node AND du.template = fp.template""")
def fingerprint_ratios(spark, sf_dir):
    kinds = ("periodic", "semi_periodic")
    return L.normalised(prints(spark, sf_dir), L.node_profiles(logs(spark, sf_dir)), WINDOW_US / 1000, kinds)


def value_anomalies(spark, sf_dir):
    """Values of the log view's templates, regimes of ten days; sequential, so without SQL."""
    m = F.col("raw_message")
    rows = logs(spark, sf_dir).select("seq", "ts_us", "node", text.template(m).alias("template"), F.floor(F.col("bag") / 10).alias("regime"), text.template_values(m).alias("values"))
    extra = events(spark, sf_dir).select("seq", "ts_us", F.lit("/gauge").alias("node"), F.lit("value #").alias("template"), F.floor(F.col("bag") / 10).alias("regime"), F.array(F.when(F.col("seq") % 97 == 0, F.col("value") * 50).otherwise(F.col("value"))).alias("values"))
    return V.value_anomalies(rows.unionByName(extra))


QUERIES["value_anomalies"] = value_anomalies
