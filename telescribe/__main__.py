"""python -m telescribe diagnose FOLDER OUT | profile FOLDER OUT | validate FOLDER OUT | crossval FOLDER OUT [--sample N] [--no-sensors] | logs PATH OUT [--least LEVEL] [--tokens N]"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from telescribe import analysis
from telescribe.operators import chains, diagnose, incidents
from telescribe.sinks import layouts, reports
from telescribe.sources import catalog, messages, recording


def main() -> None:
    parser = argparse.ArgumentParser(prog="telescribe", description=__doc__)
    parser.add_argument("what", choices=("diagnose", "profile", "validate", "crossval", "logs"))
    parser.add_argument("path")
    parser.add_argument("out")
    parser.add_argument("--least", default="INFO")
    parser.add_argument("--tokens", type=int, default=3000)
    parser.add_argument("--sample", type=int, default=1)
    parser.add_argument("--no-sensors", action="store_true")
    args = parser.parse_args()
    spark = SparkSession.builder.appName("telescribe").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.what == "logs":
        source = catalog.open_logs(spark, args.path, args.least)
        found = analysis.extract(source)
        for name in ("profiles", "regimes", "anomalies", "chains", "isolated"):
            reports.write_json(found[name], f"{args.out}/{name}")
        chains.annotated(found["anomalies"], found["chains"], found["members"].select("seq", "chain")).orderBy("ts", "seq").select("line").write.mode("overwrite").text(f"{args.out}/annotated")
        # a row a file
        for meta in source.metadata().collect():
            name = meta["source_file"]
            if found["ends"].where(found["ends"].source_file == name).limit(1).count():
                report = analysis.summary(found, name, meta.asDict())
                reports.write_text(spark, reports.as_json(report), f"{args.out}/report/{name}")
                reports.write_text(spark, reports.prompt(report, args.tokens), f"{args.out}/prompt/{name}")
    elif args.what == "crossval":
        checked = analysis.validate(spark, args.path, max(1, args.sample), not args.no_sensors)
        report = reports.validation_report(checked.packets, checked.routes, checked.states)
        reports.write_json(checked.packets, f"{args.out}/evidence_packets")
        reports.write_text(spark, json.dumps(report, indent=2, default=str), f"{args.out}/report")
        reports.write_text(spark, reports.validation_text(report, checked.packets), f"{args.out}/summary")
    elif args.what == "diagnose":
        found = analysis.diagnose(spark, args.path)
        for name in ("bags", "anomalies", "incidents", "health", "summary"):
            reports.write_json(found[name], f"{args.out}/{name}")
        reports.write_csv(incidents.incident_rows(found["incidents"]), f"{args.out}/incidents_csv")
        reports.write_text(spark, reports.incident_page("Recordings below " + args.path, found["incidents"], found["summary"]), f"{args.out}/page")
        for name, made in layouts.layouts(found["incidents"].where("not suppressed").select("category", "severity")).items():
            reports.write_text(spark, json.dumps(made, indent=2), f"{args.out}/layouts/{name}")
    else:
        signals = messages.signals(recording.read(spark, args.path))
        reports.write_json((diagnose.profile if args.what == "profile" else diagnose.validation)(diagnose.Statistics(signals)), f"{args.out}/{args.what}")
    spark.stop()


if __name__ == "__main__":
    main()
