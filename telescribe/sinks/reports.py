"""Reports of a run: JSON, CSV, a prompt of bounded size, an annotated log and an HTML page.

Tables are written by Spark; texts are built on the driver from rows that limits bound.
"""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telescribe.plans import rules

#: Characters of a token, and the shares of a prompt's sections.
CHARS, SHARES = 4, {"header": 0.05, "regimes": 0.15, "chains": 0.50, "isolated": 0.15, "baseline": 0.10, "events": 0.05}
#: Most rows that a report shows of a chain's members, lone anomalies, nodes and templates of a node.
MOST_CASCADE, MOST_ISOLATED, MOST_NODES, MOST_TEMPLATES, PROMPT_ISOLATED, PROMPT_TYPES = 20, 50, 10, 3, 15, 10


def write_csv(rows: DataFrame, path: str) -> None:
    """Rows as CSV with a header, in one part as readers of small reports expect; nested columns become JSON."""
    cols = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in rows.dtypes]
    rows.select(*cols).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One small text as a folder of one file, in any store that Spark can write."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(path)


def timeline_rows(anomalies: DataFrame, logs: DataFrame, bags: DataFrame) -> DataFrame:
    """(timestamp_us, bag, type, severity, category, description, details): anomalies, at their recording's start without a time, and logs."""
    a = anomalies.join(bags.select("bag", "start_us"), "bag").select(F.coalesce("ts_us", "start_us").alias("timestamp_us"), "bag", F.lit("anomaly").alias("type"), "severity", "category", "description", F.to_json(F.struct("topic", "field")).alias("details"))
    name = F.col("level_name")
    text = F.concat(F.lit("["), F.col("node"), F.lit("]: "), F.substring("raw_message", 1, 200))
    b = logs.select(F.col("ts_us").alias("timestamp_us"), "bag", F.lit("log").alias("type"), name.alias("severity"), F.concat(F.lit("LOG_"), name).alias("category"), text.alias("description"), F.to_json(F.struct("node", "level")).alias("details"))
    return a.unionByName(b)


def clock(ms: float) -> str:
    """Hours, minutes and seconds, rounded to the millisecond first, so that no field runs over."""
    whole = round(ms)
    return f"{whole // 3_600_000:02d}:{whole // 60_000 % 60:02d}:{whole // 1000 % 60:02d}.{whole % 1000:03d}"


#: The report's version, how many findings of a kind its text shows, and its headings.
VALIDATOR_VERSION = "1.0"
SHOWN = (("CONTRADICTIONS", 10), ("CRITICAL EVENTS", 15), ("HIGH-FREQUENCY CONFIRMED", 10))


def validation_report(packets: DataFrame, routes: DataFrame, states: DataFrame) -> dict:
    """Counts of a cross-validation, what its denoising dropped, and the states' timeline; all bounded by kinds, not by rows.

    The packets themselves are a table of their own.
    """
    by_route = {r["route"]: r["n"] for r in routes.collect()}
    verdicts = {r["verdict"]: r["count"] for r in packets.groupBy("verdict").count().orderBy("verdict").collect()}
    total, pct = sum(by_route.values()), lambda n: round(100.0 * n / total, 1) if total else 0.0
    noise, deduped = by_route.get("noise", 0), by_route.get("dedup", 0)
    timeline: dict[str, dict] = {}
    for r in states.orderBy("state", "value").collect():
        one = timeline.setdefault(r["state"], {"total_transitions": r["transitions"], "current_value": r["current"], "values": []})
        one["values"].append({"value": r["value"], "count": r["n"], "total_duration_sec": round(r["total_us"] / 1e6, 2)})
    return {
        "cross_validator_version": VALIDATOR_VERSION,
        "stats": {"total_bags": packets.select("bag").distinct().count(), "raw_log_events": total, "denoised_events": sum(verdicts.values()), "evidence_packets": sum(verdicts.values()), "verdicts": verdicts},
        "denoise_stats": {"total_input": total, "noise_filtered": noise, "signal_kept": by_route.get("keep", 0) + by_route.get("signal", 0), "deduped": deduped, "passthrough": by_route.get("passthrough", 0), "noise_reduction_pct": pct(noise), "dedup_reduction_pct": pct(deduped)},
        "state_timeline_summary": timeline,
    }


def validation_text(report: dict, packets: DataFrame) -> str:
    """The cross-validation in a few paragraphs: counts, states, and the first findings of each kind in order of time."""
    stats = report["stats"]
    parts = [
        f"Cross-Validation Report: {stats['total_bags']} bags, {stats['raw_log_events']} raw logs -> {stats['denoised_events']} denoised -> {stats['evidence_packets']} evidence packets",
        "Verdicts: " + ", ".join(f"{k}={v}" for k, v in sorted(stats["verdicts"].items())),
    ]
    if report["state_timeline_summary"]:
        parts.append("\n".join(["State Timeline:", *[f"  {k}: {v['total_transitions']} transitions, current={v['current_value']}" for k, v in report["state_timeline_summary"].items()]]))
    against = F.col("verdict") == "CONTRADICTED"
    chosen = (against, (F.col("severity") == "CRITICAL"), (F.col("dedup_count") > 10) & (F.col("verdict") == "CONFIRMED"))
    for (title, most), condition in zip(SHOWN, chosen):
        rows = packets.where(condition)
        n = rows.count()
        # of the critical ones those among the first that no contradiction has told of already
        first = rows.orderBy("ts_us", "packet_id").limit(most).where(~against | F.lit(title == SHOWN[0][0]))
        lines = [f"  [{r['packet_id']}] {r['summary']}" for r in first.orderBy("ts_us", "packet_id").select("packet_id", "summary").collect()]
        if n:
            parts.append("\n\n".join([f"=== {title} ({n}) ===", *lines]) if len(lines) > 1 else "\n".join([f"=== {title} ({n}) ===", *lines]))
    return "\n\n".join(parts)


def fitted(lines: list[str], room: int) -> str:
    """As many whole lines from the first on as fit in."""
    out, left = [], room
    for line in lines:
        if len(line) > left:
            break
        out.append(line)
        left -= len(line) + 1
    return "\n".join(out)


def prompt(report: dict, tokens: int = 3000, context: str = "") -> str:
    """A text of at most so many tokens about a report: metadata, nodes, regimes, chains, isolated and total_anomalies.

    Few anomalies leave more room for the baseline, many more for the chains. A chain that does not fit whole is given
    with three of its types, then by its root alone; the first that does not fit even so ends the section.
    """
    room = tokens * CHARS
    shares, n = dict(SHARES), report["total_anomalies"]
    if n < 5:
        shares["chains"], shares["baseline"] = shares["chains"] - 0.15, shares["baseline"] + 0.15
    elif n > 50:
        shares["chains"], shares["baseline"] = shares["chains"] + 0.10, shares["baseline"] - 0.05
    part = {k: int(room * v) for k, v in shares.items()}
    meta = report["metadata"]
    head = ["=== ROBOT DIAGNOSTIC SUMMARY ===", *([f"Context: {context}"] if context else []), f"Source: {meta.get('source_file', 'unknown')}", f"Duration: {meta.get('duration_ms', 0) / 1000:.1f}s | Lines: {meta.get('total_lines', 0)} | Parsed: {meta.get('parsed_lines', 0)}", f"Nodes: {len(report['nodes'])} | Regimes: {len(report['regimes'])} | Anomalies: {n} | Causal chains: {len(report['chains'])}", ""]
    regimes = ["\n=== REGIME TIMELINE ==="] + [f"  [{clock(r['start_ms'])} - {clock(r['end_ms'])}] regime_{r['regime']} ({(r['end_ms'] - r['start_ms']) / 1000:.1f}s) {r['windows']} windows" for r in report["regimes"]]
    chains, left = ["\n=== CAUSAL CHAINS ==="], part["chains"] - 25
    for c in report["chains"]:
        top = [f"\nCHAIN [{c['severity']:.1f}]: {c['node']} {c['kind']}", f"  Root: {c['node']} [{c['template'][:60]}]", f"    first={clock(c['first_ms'])} last={clock(c['last_ms'])} jaccard={c['jaccard']:.2f} members={c['members']}"]
        types = sorted(c["types"], key=lambda t: -rules.IMPORTANCE.get(t["node"], 0) * t["n"])
        lines = [f"    → {t['node']} {t['kind']}{f' ×{t['n']}' if t['n'] > 1 else ''}: [{t['template'][:50]}]" for t in types]
        forms = [(most, lines[:most] + ([f"    ... +{len(lines) - most} more anomaly types"] if len(lines) > most else [])) for most in (PROMPT_TYPES, 3)]
        blocks = ["\n".join([*top, "  Cascade:", *shown]) for _, shown in forms] + ["\n".join(top)]
        block = next((b for b in blocks if len(b) <= left), None)
        if block is None:
            break
        chains.append(block)
        left -= len(block)
    alone = sorted(report["isolated"], key=lambda a: -a["score"])[:PROMPT_ISOLATED]
    isolated = fitted(["\n=== ISOLATED ANOMALIES ===", *[f"  [{a['score']:.1f}] {a['node']} {a['kind']}: [{a['template'][:50]}] @ {clock(a['ms'])}" for a in alone]], part["isolated"])
    nodes = sorted(report["nodes"], key=lambda x: -rules.IMPORTANCE.get(x["node"], 0))[:MOST_NODES]
    baseline = ["\n=== SENSOR BASELINE ==="] + [f"  {x['node']}: {x['kind']} ({x['rate_hz']}Hz, CV={x['cv']})" for x in nodes]
    events = ["\n=== EVENT-DRIVEN NODES ==="] + [f"  {x['node']} (×{t['n']}): [{t['template'][:60]}]" for x in report["nodes"] if x["kind"] == "event_driven" for t in x.get("templates", [])[:MOST_TEMPLATES]]
    text = "\n".join(["\n".join(head)[: part["header"]], "\n".join(regimes)[: part["regimes"]], "\n".join(chains), isolated, "\n".join(baseline)[: part["baseline"]], "\n".join(events)[: part["events"]]])
    return text if len(text) <= room else text[: room - 20] + "\n... [truncated]"


def bounded_report(metadata: dict, nodes: DataFrame, regimes: DataFrame, chains: DataFrame, types: DataFrame, isolated: DataFrame, total: int) -> dict:
    """A report's rows, each list up to its limit. types: (chain_id, node, kind, template, n) of chains' members but their roots."""
    rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
    own: dict[int, list] = {}
    top = chains.orderBy("chain_id").limit(MOST_ISOLATED)
    for t in rows(types.join(top.select("chain_id"), "chain_id").orderBy("chain_id", F.desc("n"), "node", "kind", "template").limit(MOST_ISOLATED * MOST_CASCADE)):
        own.setdefault(t["chain_id"], []).append(t)
    found = [c | {"types": own.get(c["chain_id"], [])[:MOST_CASCADE]} for c in rows(top)]
    return {"metadata": metadata, "nodes": rows(nodes.limit(1000)), "regimes": rows(regimes.orderBy("regime").limit(1000)), "chains": found, "isolated": rows(isolated.orderBy(F.desc("score"), "seq").limit(MOST_ISOLATED)), "total_anomalies": total}


def as_json(report: dict) -> str:
    return json.dumps(report, indent=2, default=str, ensure_ascii=False)


STYLE = "body{font:14px sans-serif;margin:2em;background:#f8fafc;color:#0f172a}.cards{display:flex;gap:1em;flex-wrap:wrap}.card{background:#fff;border:1px solid #cbd5e1;border-radius:6px;padding:.6em 1em;margin:.4em 0}.CRITICAL{border-left:5px solid #dc2626}.WARNING{border-left:5px solid #d97706}.INFO{border-left:5px solid #2563eb}"
SCRIPT = "function pick(){const s=[...document.querySelectorAll('input[type=checkbox]:checked')].map(x=>x.value),t=document.getElementById('text').value.toLowerCase();document.querySelectorAll('.item').forEach(x=>x.hidden=!(s.includes(x.dataset.severity)&&x.textContent.toLowerCase().includes(t)))}"
LANES = {"CRITICAL": ("#dc2626", 20), "WARNING": ("#d97706", 50), "INFO": ("#2563eb", 80)}


def timeline_svg(items: list[dict], width: int = 900) -> str:
    """One lane a severity; items without a numeric start are left out."""
    timed = [i for i in items if isinstance(i.get("start_us"), (int, float))]
    if not timed:
        return ""
    first, last = min(i["start_us"] for i in timed), max(i["start_us"] for i in timed)
    span = max(1, last - first)
    ticks = min(8, max(2, int(span / 60e6)))
    dots = "".join(f'<circle cx="{20 + (width - 40) * (i["start_us"] - first) / span:.1f}" cy="{LANES[i["severity"]][1]}" r="5" fill="{LANES[i["severity"]][0]}"><title>{html.escape(str(i["title"]))}</title></circle>' for i in timed if i["severity"] in LANES)
    marks = "".join(f'<text x="{20 + (width - 40) * k / ticks:.0f}" y="105" font-size="10">+{span / 1e6 * k / ticks:.0f}s</text>' for k in range(ticks + 1))
    return f'<svg width="{width}" height="110">{dots}{marks}</svg>'


def page(title: str, counts: dict, tabs: dict[str, list[dict]]) -> str:
    """A page of cards by tab, with a filter by severity and text. Items: severity, title, text, start_us. Everything is escaped."""
    esc = lambda x: html.escape(str(x if x is not None else ""))
    card = lambda i: f'<div class="card item {esc(i["severity"])}" data-severity="{esc(i["severity"])}"><b>{esc(i["title"])}</b><div>{esc(i.get("text"))}</div></div>'
    boxes = "".join(f'<label><input type="checkbox" value="{s}" checked onchange="pick()">{s}</label> ' for s in LANES)
    body = "".join(f"<h2>{esc(name)} ({len(items)})</h2>{timeline_svg(items)}{''.join(map(card, items))}" for name, items in tabs.items())
    numbers = "".join(f'<div class="card">{esc(k)}<br><b>{esc(v)}</b></div>' for k, v in counts.items())
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{esc(title)}</title><style>{STYLE}</style></head><body><h1>{esc(title)}</h1><div class="cards">{numbers}</div><p>{boxes}<input id="text" oninput="pick()" placeholder="filter"></p>{body}<script>{SCRIPT}</script></body></html>'


#: Most incidents that a page shows of a severity.
MOST_CARDS = 200


def incident_page(title: str, incidents: DataFrame, missions: DataFrame) -> str:
    """A page of missions' counts and incidents by severity, the first of each; the suppressed ones have a tab of their own."""
    counts = missions.agg(F.count("*").alias("Missions"), F.sum("bags").alias("Recordings"), F.sum("incidents").alias("Incidents"), F.sum("anomalies").alias("Anomalies"), F.sum("suppressed").alias("Suppressed")).first().asDict()
    item = [F.col("severity"), F.concat_ws(" ", "incident_id", "title").alias("title"), F.concat_ws(" ", "bag", "root_cause").alias("text"), "start_us"]
    tabs = {}
    for name, condition in (*((s.title(), (F.col("severity") == s) & ~F.col("suppressed")) for s in LANES), ("Suppressed", F.col("suppressed"))):
        tabs[name] = [r.asDict() for r in incidents.where(condition).orderBy(F.asc_nulls_last("start_us"), "bag", "incident_id").select(*item).limit(MOST_CARDS).collect()]
    return page(title, {k: v or 0 for k, v in counts.items()}, tabs)
