"""Log analytics: classification, denoising, robot state over time, incidents, templates and their windows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telescribe.functions.text import any_match, chosen, first_match, settled, template, unstable
from telescribe.operators.relational import SPAN_US, near, neighbour, running_max, sessions
from telescribe.operators.scratch import checkpointed
from telescribe.plans import rules


def classified(logs: DataFrame) -> DataFrame:
    """Adds what the first pattern that a message holds says of it: log_event (UNMATCHED without one), pattern, matched
    (the pattern's value), matched_text and groups."""
    m = F.col("raw_message")
    regex = [f"(?i){p[0]}" for p in rules.PATTERNS]
    hit = chosen([(m.rlike(r), F.struct(F.lit(i).alias("rule"), F.regexp_extract(m, r, p[4]).alias("value"))) for i, (r, p) in enumerate(zip(regex, rules.PATTERNS))])
    rows = settled(logs, _hit=hit)
    name = lambda labels: F.try_element_at(F.array(*map(F.lit, labels)), F.col("_hit.rule") + 1)
    groups = [F.array(*[F.regexp_extract(m, r, g + 1) for g in range(rules.groups_of(r))]) for r in regex]
    return rows.withColumns(
        {
            "log_event": F.coalesce(name([p[1] for p in rules.PATTERNS]), F.lit("UNMATCHED")),
            "pattern": name(rules.PATTERN_NAMES),
            "matched": F.col("_hit.value"),
            "matched_text": chosen([(F.col("_hit.rule") == i, F.regexp_extract(m, r, 0)) for i, r in enumerate(regex)]),
            "groups": chosen([(F.col("_hit.rule") == i, g) for i, g in enumerate(groups)]),
        }
    ).drop("_hit")


def level_name(level: Column) -> Column:
    """The name of a log level, or LVL and its number."""
    return chosen([(level == n, F.lit(label)) for n, label in rules.LEVELS.items()], F.concat(F.lit("LVL"), level.cast("string")))


def event_summary(logs: DataFrame, nodes: int = 10) -> DataFrame:
    """(what, name, n, pct): log rows by type and level, and the nodes with most; pct of all rows."""
    rows = logs.select("log_event", "node", level_name(F.col("level")).alias("level"))
    each = F.explode(F.array(*[F.struct(F.lit(w).alias("what"), F.col(c).alias("name")) for w, c in (("type", "log_event"), ("node", "node"), ("level", "level"))]))
    counts = rows.select(each.alias("x")).groupBy("x.what", "x.name").agg(F.count("*").alias("n"))
    w = Window.partitionBy("what")  # a row a name
    ranked = counts.withColumns({"r": F.row_number().over(w.orderBy(F.desc("n"), "name")), "pct": F.round(100.0 * F.col("n") / F.sum("n").over(w), 1)})
    return ranked.where((F.col("what") != "node") | (F.col("r") <= nodes)).drop("r")


def matched_share(logs: DataFrame) -> DataFrame:
    """(total_events, matched_pct): all rows, and how many in a hundred a pattern matches; 100 of none. logs: classified()."""
    unmatched = F.count_if(F.col("log_event") == "UNMATCHED")
    return logs.agg(F.count("*").alias("total_events"), F.round(100 * (1 - unmatched / F.greatest(F.count("*"), F.lit(1))), 1).alias("matched_pct"))


def routed(logs: DataFrame) -> DataFrame:
    """route: keep (errors), noise, dedup, signal or passthrough, in this order; dedup_key of the third."""
    m = F.col("raw_message")
    rows = settled(logs, _key=first_match(m, rules.DEDUP))
    route = F.when(F.col("level") >= 8, "keep").when(any_match(m, rules.NOISE), "noise").when(F.col("_key").isNotNull(), "dedup").when(any_match(m, rules.SIGNAL), "signal").otherwise("passthrough")
    rows = settled(rows, route=route)
    return rows.withColumn("dedup_key", F.when(F.col("route") == "dedup", F.col("_key"))).drop("_key")


def deduplicated(logs: DataFrame) -> DataFrame:
    """One row for each dedup group: how often, first and last time, and its first row."""
    return routed(logs).where("route = 'dedup'").groupBy("dedup_key").agg(
        F.count("*").alias("n"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.min_by("seq", F.struct("ts_us", "seq")).alias("first_seq")
    )


def state_values(logs: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, seq, ts_us, state, new_value) of the rows that tell a state's (key.field) value."""
    named = {e: f"{k}.{f}" for _, e, k, f, _ in reversed(rules.PATTERNS) if k}
    state = F.try_element_at(F.create_map(*[F.lit(x) for pair in named.items() for x in pair]), F.col("log_event"))
    return classified(logs).select(*keys, "seq", "ts_us", state.alias("state"), F.col("matched").alias("new_value")).where("state is not null and new_value <> ''")


def state_changes(logs: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows at which a state (key.field) takes another value than before; keys: columns that keep states apart."""
    # texts are matched once
    rows = checkpointed(state_values(logs, keys))
    seen = neighbour(rows, [*keys, "state"], "ts_us", "seq", {"old_value": "new_value"})
    return seen.withColumn("old_value", F.coalesce("old_value", F.lit("<unknown>"))).where("old_value <> new_value")


def transitions(changes: DataFrame, key: str | None = None, field: str | None = None) -> DataFrame:
    """Changes of one state (key and field), of all fields of a key, of one field of any key, or of all."""
    parts = F.split("state", r"\.", 2)
    out = changes if key is None else changes.where(parts[0] == key)
    return out if field is None else out.where(parts[1] == field)


def state_active(probes: DataFrame, periods: DataFrame, state: str, value: str) -> DataFrame:
    """Adds active: whether the state had the value at the probe's time. periods: state_periods(), starts included, ends not.

    Probes and periods meet in the hours that both touch.
    """
    hour = 3_600_000_000
    own = periods.where((F.col("state") == state) & (F.col("value") == value))
    last = F.greatest(F.floor(F.coalesce(F.col("end_us") - 1, F.lit(None)) / hour), F.floor(F.col("start_us") / hour))
    closed = own.where("end_us is not null").select("start_us", "end_us", F.explode(F.sequence(F.floor(F.col("start_us") / hour), last)).alias("_hour"))
    hit = probes.select("seq", "ts_us", F.floor(F.col("ts_us") / hour).alias("_hour")).join(closed, "_hour").where("ts_us >= start_us and ts_us < end_us").select("seq").distinct()
    # a state has at most one period without an end
    open_from = own.where("end_us is null").agg(F.min("start_us").alias("_open"))
    out = probes.join(hit.withColumn("_hit", F.lit(True)), "seq", "left").join(F.broadcast(open_from))
    return out.withColumn("active", F.coalesce("_hit", F.lit(False)) | F.coalesce(F.col("ts_us") >= F.col("_open"), F.lit(False))).drop("_hit", "_open")


def state_periods(changes: DataFrame) -> DataFrame:
    rows = neighbour(changes, ["state"], "ts_us", "seq", {"end_us": "ts_us"}, after=True)
    return rows.select("state", F.col("new_value").alias("value"), F.col("ts_us").alias("start_us"), "end_us")


def state_summary(changes: DataFrame) -> DataFrame:
    """(state, value, n, total_us, transitions, current): how often and how long each value held; the last, open time is left out."""
    periods = state_periods(changes)
    out = periods.groupBy("state", "value").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("end_us") - F.col("start_us")), F.lit(0).cast("bigint")).alias("total_us"))
    whole = periods.groupBy("state").agg(F.count("*").alias("transitions"), F.max(F.when(F.col("end_us").isNull(), F.col("value"))).alias("current"))
    return out.join(whole, "state")


def incident_bins(anomalies: DataFrame, gap_us: int) -> DataFrame:
    """Anomalies of a category that follow each other within the gap are one incident.

    Anomalies are joined within each span of time first; what is left, a row an incident of a span, is joined between spans.
    """
    turn = Window.partitionBy("category", "_span").orderBy("ts_us")
    rows = anomalies.select("category", "ts_us", F.floor(F.col("ts_us") / SPAN_US).alias("_span"))
    rows = rows.withColumn("_new", F.coalesce((F.col("ts_us") - F.lag("ts_us").over(turn) > gap_us).cast("int"), F.lit(0))).withColumn("_local", F.sum("_new").over(turn))
    pieces = rows.groupBy("category", "_span", "_local").agg(F.count("*").alias("n"), F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"))
    pieces = checkpointed(pieces.select("category", "n", "start_us", "end_us"))
    s = sessions(pieces, ["category"], "start_us", gap_us, seq="end_us", end="end_us")
    return s.groupBy("category", "session").agg(F.sum("n").alias("n"), F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"))


def caused(logs: DataFrame, anomalies: DataFrame, reach_us: int, causes) -> DataFrame:
    """Each anomaly with the earliest log event in reach that explains its category; one event may explain many."""
    pairs = [F.struct(F.lit(e).alias("log_event"), F.lit(c).alias("category")) for e, cs in causes.items() for c in cs]
    explained = logs.where(F.col("log_event").isin(*causes)).withColumn("x", F.explode(F.filter(F.array(*pairs), lambda p: p["log_event"] == F.col("log_event"))))
    left = explained.select(F.col("seq").alias("log_seq"), F.col("ts_us").alias("log_us"), "log_event", F.col("x.category").alias("category"))
    met = near(left, anomalies.select(F.col("seq").alias("anomaly_seq"), F.col("ts_us").alias("anomaly_us"), "category"), reach_us, "log_us", "anomaly_us", ["category"])
    first = F.row_number().over(Window.partitionBy("anomaly_seq").orderBy("log_us", "log_seq"))
    return met.withColumn("_r", first).where("_r = 1").select("anomaly_seq", "category", "log_seq", "log_event", (F.col("anomaly_us") - F.col("log_us")).alias("delta_us"))


def node_profiles(logs: DataFrame, kinds: tuple[str, str, str] = ("periodic", "semi_periodic", "event_driven"), keys: Sequence[str] = ()) -> DataFrame:
    """Messages, rate, median interval, its variation (infinite without an interval), and the kind of publisher it makes a node."""
    rows = neighbour(logs, [*keys, "node"], "ts_us", "seq", {"_before": "ts_us"})
    gap = F.col("ts_us") - F.col("_before")
    g = F.when(gap > 0, gap / 1000.0)
    p = rows.groupBy(*keys, "node").agg(F.count("*").alias("n"), F.round(F.median(g), 3).alias("median_ms"), (F.stddev_pop(g) / F.avg(g)).alias("cv"), ((F.max("ts_us") - F.min("ts_us")) / 1e6).alias("s"))
    kind = F.when(F.col("n") < 20, kinds[2]).when(F.col("cv") < 0.3, kinds[0]).when(F.col("cv") < 1.0, kinds[1]).otherwise(kinds[2])
    rate = F.when(F.col("s") > 0, F.round(F.col("n") / F.col("s"), 4)).otherwise(0.0)
    return p.select(*keys, "node", "n", "median_ms", F.coalesce(F.round("cv", 4), F.lit(float("inf"))).alias("cv"), rate.alias("rate_hz"), kind.alias("kind"))


def auto_window_ms(profiles: DataFrame, least: float = 1000.0, keys: Sequence[str] = ()) -> DataFrame:
    """width_ms: the longest median interval of a periodic node, or least."""
    return profiles.groupBy(*keys).agg(F.greatest(F.coalesce(F.max(F.when((F.col("kind") == "periodic") & (F.col("median_ms") > 0), F.col("median_ms"))), F.lit(least)), F.lit(least)).alias("width_ms"))


def fingerprints(logs: DataFrame, width_us: int | Column, start: Column, end: Column | None = None, in_order: bool = False, keys: Sequence[str] = ()) -> DataFrame:
    """Templates a node logs in windows that hold their left edge, but for those that are different each time.

    end: the last record's time; windows begin before it, so a record at the edge where one would begin then is left out.
    in_order: records stand in order of seq, and one that lies behind an earlier one counts in that one's window.
    """
    rows = settled(logs, template=template(F.col("raw_message"))).where(~F.coalesce(unstable(F.col("template")), F.lit(False)))
    w = F.floor((F.col("ts_us") - start) / width_us).cast("bigint")
    rows = running_max(rows, [*keys], "seq", w, "w") if in_order else rows.withColumn("w", w)
    rows = rows if end is None else rows.where(F.col("w") < F.ceil((end - start) / width_us))
    return rows.groupBy(*keys, "w", "node", "template").agg(F.count("*").alias("n"))


def normalised(prints: DataFrame, profiles: DataFrame, width_ms: float | Column, regular: tuple[str, ...] = ("periodic", "semi_periodic"), keys: Sequence[str] = ()) -> DataFrame:
    """Adds ratio: a count over the one that the node's interval and the template's share of it lead to expect; 1 for others."""
    share = prints.groupBy(*keys, "node", "template").agg(F.sum("n").alias("_of"))
    width = width_ms if isinstance(width_ms, Column) else F.lit(float(width_ms))
    own = share.join(profiles.select(*keys, "node", F.col("n").alias("_every"), "median_ms", "kind", width.alias("_width")), [*keys, "node"])
    due = own.where(F.col("kind").isin(*regular) & (F.col("median_ms") > 0)).select(*keys, "node", "template", (F.col("_width") / F.col("median_ms") * F.col("_of") / F.col("_every")).alias("_due"))
    return prints.join(due, [*keys, "node", "template"], "left").withColumn("ratio", F.round(F.coalesce(F.col("n") / F.col("_due"), F.lit(1.0)), 6)).drop("_due")


def window_deviation(prints: DataFrame, count: str = "n", keys: Sequence[str] = ()) -> DataFrame:
    """Jaccard distance and count divergence of each window to the one before, from window 1 to the last; two empty ones differ by 1."""
    own = prints.select(*keys, "w", "node", "template", F.col(count).alias("n"))
    old = own.select(*keys, (F.col("w") + 1).alias("w"), "node", "template", F.col("n").alias("m"))
    both = own.join(old, [*keys, "w", "node", "template"], "full")
    n, m = F.coalesce("n", F.lit(0)), F.coalesce("m", F.lit(0))
    out = both.groupBy(*keys, "w").agg(F.sum(((n > 0) & (m > 0)).cast("int")).alias("common"), F.count("*").alias("every"), F.sum((n - m) * (n - m) / (n + m)).alias("divergence"))
    every = prints.groupBy(*keys).agg(F.max("w").alias("last")).where("last > 0").select(*keys, F.explode(F.sequence(F.lit(1).cast("bigint"), "last")).alias("w"))
    distance = F.coalesce(F.round(1 - F.col("common") / F.col("every"), 6), F.lit(1.0))
    return every.join(out, [*keys, "w"], "left").select(*keys, "w", distance.alias("distance"), F.round(F.coalesce("divergence", F.lit(0.0)), 4).alias("divergence"))


def cooccurrence(active: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Pairs of types seen within one window of a window that is active itself, and in how many windows. active: (w, type)."""
    active = active.select(*keys, "w", "type").distinct()
    seen = active.select(*keys, F.explode(F.array(F.col("w") - 1, F.col("w"), F.col("w") + 1)).alias("w"), "type").join(active.select(*keys, "w").distinct(), [*keys, "w"], "left_semi").distinct()
    a, b = seen.select(*keys, "w", F.col("type").alias("type_a")), seen.select(*keys, "w", F.col("type").alias("type_b"))
    return a.join(b, [*keys, "w"]).where("type_a < type_b").groupBy("type_a", "type_b").agg(F.count("*").alias("n"))


def similarity_edges(active: DataFrame, least: float = 0.5, kin: float | None = None, group: Callable[[Column], Column] | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Pairs of types whose windows overlap enough; pairs without a positive union are skipped.

    Pairs of one group (of a type's column, null for none) need only kin. keys: of windows; types are told apart by
    their names alone.
    """
    sizes = active.distinct().groupBy("type").agg(F.count("*").alias("s"))
    pairs = cooccurrence(active, keys).join(sizes.select(F.col("type").alias("type_a"), F.col("s").alias("s_a")), "type_a").join(sizes.select(F.col("type").alias("type_b"), F.col("s").alias("s_b")), "type_b")
    union = F.col("s_a") + F.col("s_b") - F.col("n")
    limit = F.lit(least) if group is None else F.when(group(F.col("type_a")) == group(F.col("type_b")), F.lit(kin)).otherwise(F.lit(least))
    # the division guards itself, as filters may be taken in any order; null passes no limit
    return pairs.select("type_a", "type_b", F.when(union > 0, F.round(F.try_divide("n", union), 6)).alias("jaccard")).where(F.col("jaccard") >= limit)


def numbered_missions(bags: DataFrame, gap_us: int) -> DataFrame:
    """bags with mission: recordings in order of start; one that starts more than the gap after the end of the one before opens a mission."""
    w = Window.orderBy("start_us", "bag")  # recordings are few: one row each
    new = F.coalesce((F.col("start_us") - F.lag("end_us").over(w) > gap_us).cast("int"), F.lit(0))
    return bags.withColumn("_new", new).withColumn("mission", F.sum("_new").over(w)).drop("_new")


def missions(bags: DataFrame, gap_us: int) -> DataFrame:
    """The missions of numbered_missions(), their recordings and ends."""
    return numbered_missions(bags, gap_us).groupBy("mission").agg(F.count("*").alias("bags"), F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"))


def longest_runs(hits: DataFrame, least: int = 3) -> DataFrame:
    """For each category its longest run of consecutive recordings, the first of equals. hits: (category, bag)."""
    h = hits.distinct().withColumn("island", F.col("bag") - F.row_number().over(Window.partitionBy("category").orderBy("bag")))
    runs = h.groupBy("category", "island").agg(F.min("bag").alias("first_bag"), F.count("*").alias("bags")).where(F.col("bags") >= least)
    best = F.row_number().over(Window.partitionBy("category").orderBy(F.col("bags").desc(), "first_bag"))
    return runs.withColumn("r", best).where("r = 1").select("category", "first_bag", "bags")


def verdict(critical: Column, warning: Column, many: int) -> Column:
    return F.when(critical > 0, "UNHEALTHY").when(warning > many, "DEGRADED").when(warning > 0, "MARGINAL").otherwise("HEALTHY")


def health(anomalies: DataFrame, bags: DataFrame, incidents: DataFrame | None = None, many: int = 2) -> DataFrame:
    """Verdict of each recording by its anomalies' severities, or by those of its incidents that are not suppressed, if it has any.

    bags: (bag), all of them; incidents: (bag, severity, suppressed).
    """
    c, w = F.count_if(F.col("severity") == "CRITICAL"), F.count_if(F.col("severity") == "WARNING")
    zero = F.lit(0).cast("bigint")
    out = bags.select("bag").join(anomalies.groupBy("bag").agg(c.alias("critical"), w.alias("warning")), "bag", "left").withColumns({x: F.coalesce(x, zero) for x in ("critical", "warning")})
    if incidents is None:
        return out.withColumn("health", verdict(F.col("critical"), F.col("warning"), many))
    active = ~F.col("suppressed")
    own = incidents.groupBy("bag").agg(F.count_if(active & (F.col("severity") == "CRITICAL")).alias("_c"), F.count_if(active & (F.col("severity") == "WARNING")).alias("_w"))
    out = out.join(own, "bag", "left")
    return out.withColumn("health", verdict(F.coalesce("_c", "critical"), F.coalesce("_w", "warning"), many)).drop("_c", "_w")


def nearest_windows(probes: DataFrame, windows: DataFrame, width_us: int, keys: Sequence[str] = ()) -> DataFrame:
    """To each probe (seq, ts_us) the window of each topic whose middle lies nearest, the earliest of equals.

    Middles two widths away or further do not count. windows: (topic, start_us, end_us, ..). Times are doubled, so that
    middles are whole numbers.
    """
    p = probes.select(*keys, "seq", (2 * F.col("ts_us")).alias("twice"))
    met = near(p, windows.withColumn("middle", F.col("start_us") + F.col("end_us")), 4 * width_us, "twice", "middle", [*keys])
    met = met.withColumn("far", F.abs(F.col("twice") - F.col("middle"))).where(F.col("far") < 4 * width_us)
    first = F.row_number().over(Window.partitionBy(*keys, "seq", "topic").orderBy("far", "start_us"))
    return met.withColumn("_r", first).where("_r = 1").withColumn("distance_us", F.col("far") / 2).drop("_r", "far", "twice", "middle")


def boundary_suppressed(anomalies: DataFrame, bags: DataFrame, margin_us: int, categories: list[str]) -> DataFrame:
    """Adds suppressed: of one of the categories, and within the margin of an inner end of a recording, of the first start
    (after it) or of the last end (before it). A single recording suppresses nothing, nor do anomalies without a time.
    """
    w = Window.orderBy("start_us", "bag")  # recordings are few: one row each
    placed = bags.withColumns({"rank": F.row_number().over(w), "final": F.lead("bag").over(w).isNull()}).where("rank > 1 or not final")
    ends = placed.select(F.col("end_us").alias("centre"), F.lit(margin_us).alias("before"), F.when(F.col("final"), 0).otherwise(margin_us).alias("after"))
    start = placed.where("rank = 1").select(F.col("start_us").alias("centre"), F.lit(0).alias("before"), F.lit(margin_us).alias("after"))
    hit = near(anomalies.where(F.col("category").isin(categories)).select("seq", "ts_us"), ends.unionByName(start), margin_us, "ts_us", "centre")
    hit = hit.where((F.col("ts_us") >= F.col("centre") - F.col("before")) & (F.col("ts_us") <= F.col("centre") + F.col("after"))).select("seq").distinct()
    return anomalies.join(hit.withColumn("suppressed", F.lit(True)), "seq", "left").withColumn("suppressed", F.coalesce("suppressed", F.lit(False)))


def abnormal_events(status: DataFrame, logs: DataFrame) -> DataFrame:
    """Diagnostic status of a level over 0 and log rows of level 4 or more: seq, ts_us, origin, level."""
    pick = lambda df, origin: df.select("seq", "ts_us", F.lit(origin).alias("origin"), F.col("level").cast("bigint").alias("level"))
    return pick(status.where("level > 0"), "status").unionByName(pick(logs.where("level >= 4"), "log"))


def transition_chains(changes: DataFrame, least: int = 2) -> DataFrame:
    """Changes at one time are a chain: its time, how many they are, and their names in order. changes: (at, name)."""
    return changes.groupBy("at").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names")).where(F.col("n") >= least)


def rule_verdicts(logs: DataFrame, windows: DataFrame, width_us: int, topics: dict[str, str]) -> DataFrame:
    """(seq, rule, verdict): each claim of a log text held against the nearest window of its signal's topic.

    windows: (topic, start_us, end_us, n, mean, std). topics: the topic of each signal.
    """
    claims = [F.when(F.col("raw_message").rlike(f"(?i){p}"), F.struct(F.lit(rule).alias("rule"), F.lit(topics[signal]).alias("topic"), F.lit(expect).alias("expect"))) for p, rule, signal, expect in rules.CHECKS]
    claimed = logs.select("seq", "ts_us", F.explode(F.array_compact(F.array(*claims))).alias("x")).select("seq", "ts_us", "x.*")
    seen = nearest_windows(claimed.select("seq", "ts_us").distinct(), windows, width_us).select("seq", "topic", "n", "mean", "std")
    return claimed.join(seen, ["seq", "topic"], "left").select("seq", "rule", F.expr(rules.VERDICT).alias("verdict"))


def packet_verdicts(logs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One verdict and its confidence for each log row: a contradiction decides, then whether all or some are confirmed."""
    confirmed = F.col("verdict") == "CONFIRMED"
    each = verdicts.groupBy("seq").agg(F.bool_or(F.col("verdict") == "CONTRADICTED").alias("against"), F.bool_and(confirmed).alias("every"), F.bool_or(confirmed).alias("some"))
    out = logs.select("seq").join(each, "seq", "left")
    verdict = F.when(F.col("against").isNull(), "UNCHECKED").when(F.col("against"), "CONTRADICTED").when(F.col("some"), "CONFIRMED").otherwise("NO_SENSOR_DATA")
    sure = F.when(F.col("against"), 0.9).when(F.col("every"), 0.8).when(F.col("some"), 0.6).otherwise(0.0)
    return out.select("seq", verdict.alias("verdict"), sure.alias("confidence"))
