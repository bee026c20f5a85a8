"""Jobs for ``spark-submit``.

ingest  LANDING TABLE CHECKPOINT [--archive FOLDER] [--visits STORE]
                                              new documents into the audit table
status  EVENTS LOG CHECKPOINT [--table TABLE] new status events into the log
records LANDING TABLE OUT [--log LOG] [--patient ID] [--status S] [--since DAY] [--until DAY]
                                              the current record view as JSON lines
lab KIND LANDING TABLE CHECKPOINT [--archive FOLDER]
                                              new reports or requests (KIND) into their table
requests REQUESTS REPORTS OUT [--tables]      lab requests still without a report, from
                                              landing folders or, so that a report counts for
                                              ever, from the tables of the lab job
patient REPORTS PATIENT OUT                   a patient's reports from their table
compact TABLE                                 small files of closed batches brought together
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from wardbook.plans.lab_loop import reports_of, request_queue
from wardbook.plans.records_view import current_records
from wardbook.schemas import AUDIT_TABLE
from wardbook.session import ENGINE_CONF, configure
from wardbook.sinks.compaction import compact
from wardbook.sinks.json_rows import write_json
from wardbook.sinks.table import BATCH_COLUMN
from wardbook.sources.documents import LAYOUTS, scan_lab_reports, scan_lab_requests
from wardbook.sources.ledger import ledger_of
from wardbook.streaming.ingest import committed_rows, ingest_folder, quarantined_rows
from wardbook.streaming.lab import ingest_lab, scan_lab
from wardbook.streaming.queue import log_status_events, status_log


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="wardbook.jobs")
    jobs = top.add_subparsers(dest="job", required=True)
    places = {
        "ingest": ("landing", "table", "checkpoint"),
        "status": ("events", "log", "checkpoint"),
        "records": ("landing", "table", "out"),
        "lab": ("kind", "landing", "table", "checkpoint"),
        "requests": ("requests", "reports", "out"),
        "patient": ("reports", "patient", "out"),
        "compact": ("table",),
    }
    options = {
        "ingest": ("archive", "visits"),
        "status": ("table",),
        "lab": ("archive",),
        "records": ("log", "patient", "status", "since", "until"),
    }
    for name, folders in places.items():
        job = jobs.add_parser(name)
        for folder in folders:
            job.add_argument(folder)
        for option in options.get(name, ()):
            job.add_argument(f"--{option}")
        job.add_argument("--layout", choices=LAYOUTS, default="auto")
        if name == "requests":
            job.add_argument("--tables", action="store_true")
    return top


def run(spark: SparkSession, arguments: list[str] | None = None) -> None:
    """Run one job; errors propagate, so that a failed job fails."""
    args = parser().parse_args(arguments)
    if args.job == "ingest":
        query = ingest_folder(
            spark,
            args.landing,
            args.table,
            args.checkpoint,
            args.layout,
            archive=args.archive,
            visits=args.visits,
        )
        query.awaitTermination()
        print(f"{committed_rows(query)} records committed")
        if quarantined_rows(query):
            print(f"{quarantined_rows(query)} documents quarantined")
    elif args.job == "status":
        log_status_events(
            spark, args.events, args.log, args.checkpoint, args.table, args.layout
        ).awaitTermination()
    elif args.job == "lab":
        query = ingest_lab(
            spark,
            args.kind,
            args.landing,
            args.table,
            args.checkpoint,
            layout=args.layout,
            archive=args.archive,
        )
        query.awaitTermination()
        print(f"{committed_rows(query)} {args.kind} committed")
    elif args.job == "requests":
        if args.tables:
            asked, reports = (scan_lab(spark, k, getattr(args, k)) for k in ("requests", "reports"))
        else:
            asked = scan_lab_requests(spark, args.requests, args.layout)
            reports = scan_lab_reports(spark, args.reports, args.layout)
        write_json(request_queue(asked, reports), args.out)
    elif args.job == "patient":
        write_json(reports_of(scan_lab(spark, "reports", args.reports), args.patient), args.out)
    elif args.job == "compact":
        folders = compact(spark, args.table, schema=AUDIT_TABLE)
        compact(spark, ledger_of(args.table), [BATCH_COLUMN])
        print(f"{folders} folders brought together")
    else:
        log = status_log(spark, args.log) if args.log else None
        view = current_records(
            spark,
            args.landing,
            args.table,
            args.layout,
            args.since,
            args.until,
            patient_id=args.patient,
            status=args.status,
            ordered=True,
            log=log,
        )
        write_json(view, args.out)


def main() -> None:
    builder = SparkSession.builder.appName("wardbook")
    for name, value in ENGINE_CONF.items():
        builder = builder.config(name, value)
    spark = configure(builder.getOrCreate())
    try:
        run(spark)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
