"""The batch run: ``python -m tarnlake run --root LAKE --source FOLDER --batch-date D [--start-from STAGE]``.

Nine stages in one session; each writes its layer and the next reads it. A batch is committed at the end, and
later batches compare with committed ones only. The run's log is written beside the layers.
"""

from __future__ import annotations

import argparse
import json
import os
import re
import time
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import assertions, changes, cleaning, history, star, strict, validation
from .plans import marts
from .sources import files, generate
from .sources import snapshot as found
from .sources.storage import Storage

SCHEMAS = {
    "customers": "customer_id string, first_name string, last_name string, email string, phone string, city string, state string, country string, signup_date string, customer_segment string",
    "products": "product_id string, product_name string, category string, brand string, price double, stock_quantity int",
    "orders": "order_id string, customer_id string, order_date string, order_status string, shipping_city string, shipping_state string",
    "order_items": "order_item_id string, order_id string, product_id string, quantity int, unit_price double, discount_percentage double",
    "payments": "payment_id string, order_id string, payment_method string, payment_status string, payment_amount double, payment_date string",
}
NAMES = tuple(SCHEMAS)
DIMENSIONS = ("customers", "products")
TECHNICAL = ["batch_date", "source_file", "ingestion_timestamp", "record_hash"]


class Run:
    def __init__(self, spark: SparkSession, root, source: str | None, batch: str):
        self.spark, self.root, self.source, self.batch = spark, root, source, batch
        self.previous = files.previous_batch(spark, root, batch)

    def read(self, layer: str, name: str, batch: str | None = None):
        return files.read_layer(self.spark, self.root, layer, batch or self.batch, name)

    def write(self, df, layer: str, name: str) -> None:
        files.write_layer(df, self.root, layer, self.batch, name)

    def bronze(self) -> None:
        from pyspark.sql.types import StructType

        for n in NAMES:
            rows = files.read_csv(self.spark, f"{self.source}/{n}.csv", StructType.fromDDL(SCHEMAS[n]))
            self.write(files.bronze(rows, self.batch, [validation.KEYS[n]]), "bronze", n)
            if (came := rows.count()) != (kept := self.read("bronze", n).count()):
                raise ValueError(f"{n}: the source has {came} rows, {kept} were written")

    def validation(self) -> None:
        checked = validation.everything({n: self.read("bronze", n) for n in NAMES})
        for n, rows in checked.items():
            self.write(rows, "checked", n)
            valid, bad = validation.split(self.read("checked", n))
            self.write(valid, "valid", n)
            self.write(bad, "quarantine", n)
        stored = {n: self.read("checked", n) for n in NAMES}
        files.write_audit(validation.report(stored), files.layer_path(self.root, "audit", self.batch, "rules"))
        files.write_audit(validation.report(stored), files.layer_path(self.root, "audit", self.batch, "rules_csv"), "csv")
        files.write_audit(validation.summary(stored), files.layer_path(self.root, "audit", self.batch, "validation"))

    def changes(self) -> None:
        for n in NAMES:
            key = [validation.KEYS[n]]
            cur = self.read("valid", n).drop(*TECHNICAL)
            old = self.read("valid", n, self.previous).drop(*TECHNICAL) if self.previous else None
            self.write(changes.changes(cur, old, key), "changes", n)
            changes.reconciled(self.read("changes", n), cur.count(), old.count() if old is not None else 0)

    def _typed(self, name: str):
        """The change set as typed rows."""
        changed, key = self.read("changes", name), validation.KEYS[name]
        return cleaning.CLEAN[name](changed.drop("change_type")).join(changed.select(key, "change_type"), key)

    def silver(self) -> None:
        for n in NAMES:
            key = [validation.KEYS[n]]
            self.write(self._typed(n), "typed", n)
            typed, changed = self.read("typed", n), self.read("changes", n)
            if (came := changed.count()) != (kept := typed.count()):
                raise ValueError(f"{n}: {came} rows to be typed, {kept} came out")
            if not self.previous:
                self.write(typed.drop("change_type"), "silver", n)
                continue
            previous = self.read("silver", n, self.previous)
            self.write(changes.merged(previous, typed, key), "silver", n)
            changes.merged_soundly(previous, changed, self.read("silver", n), key)

    def history(self) -> None:
        for n in DIMENSIONS:
            key = [validation.KEYS[n]]
            if self.previous:
                old, typed = self.read("history", n, self.previous), self.read("typed", n)
                self.write(history.advanced(old, typed, self.batch, key), "history", n)
                history.assembled(old, typed, self.read("history", n))
            else:
                self.write(history.begun(self.read("silver", n), self.batch), "history", n)
            bad = history.sound(self.read("history", n), key).first()
            if any(bad):
                raise ValueError(f"history of {n}: {bad}")

    def facts(self) -> None:
        orders = star.enriched_orders(self.read("silver", "orders"), self.read("history", "customers"))
        self.write(orders, "enriched", "orders")
        orders = self.read("enriched", "orders")
        self.write(star.enriched_items(self.read("silver", "order_items"), orders, self.read("history", "products")), "enriched", "order_items")
        self.write(star.enriched_payments(self.read("silver", "payments"), orders), "enriched", "payments")
        for n, keys in (("orders", ["customer_sk"]), ("order_items", ["product_sk", "order_sk"]), ("payments", ["order_sk"])):
            history.enriched_soundly(self.read("enriched", n), self.read("silver", n), validation.KEYS[n], keys)

    def gold(self) -> None:
        e = {n: self.read("enriched", n) for n in ("orders", "order_items", "payments")}
        made = {
            "dim_customer": star.dim_customer(self.read("history", "customers")),
            "dim_product": star.dim_product(self.read("history", "products")),
            "dim_date": star.dim_date(e["orders"].select("order_day"), e["payments"].select("payment_day")),
            "fact_sales": star.fact_sales(e["order_items"], e["orders"]),
            "fact_payment": star.fact_payment(e["payments"], e["orders"]),
        }
        stamp = {"_gold_batch_date": F.to_date(F.lit(self.batch)), "_gold_processed_at": F.current_timestamp()}
        for n, df in made.items():
            self.write(df.withColumns(stamp), "gold", n)
            star.gated(self.read("gold", n), star.REQUIRED[n][0], star.REQUIRED[n])

    def quality(self) -> None:
        t = {n: self.read("gold", n) for n in ("dim_customer", "dim_product", "dim_date", "fact_sales", "fact_payment")}
        found = assertions.suite(t, {n: self.read("enriched", n) for n in ("order_items", "payments")})
        path = files.layer_path(self.root, "audit", self.batch, "quality")
        files.write_audit(found, path)  # before the gate
        failed = self.spark.read.json(path).where("status = 'FAIL'").count()
        if failed:
            raise ValueError(f"{failed} checks failed, see {path}")

    def marts(self) -> None:
        t = {n: self.read("gold", n) for n in ("dim_customer", "dim_product", "fact_sales", "fact_payment")}
        s, p = t["fact_sales"], t["fact_payment"]
        made = {
            "daily_sales_summary": marts.daily_sales(s),
            "product_performance": marts.product_performance(s, t["dim_product"]),
            "customer_performance": marts.customer_performance(s, t["dim_customer"]),
            "payment_summary": marts.payment_summary(p),
            "executive_kpis": marts.executive(s, p).withColumn("batch_date", F.to_date(F.lit(self.batch))),
        }
        for n, df in made.items():
            self.write(df, "marts", n)


STAGES = ("bronze", "validation", "changes", "silver", "history", "facts", "gold", "quality", "marts")


# What a failure's text tells.

#: Errors that only carry another one: the bridge to the JVM, a failed process, Spark's words for a failed read.
_WRAPPING = re.compile("Py4JJavaError|CalledProcessError|SystemExit|ExecutionError|MALFORMED_RECORD_IN_PARSING|FAILED_READ_FILE")
_EXCEPTION = re.compile(r"([A-Za-z_][\w.]*(?:Error|Exception))\s*:\s*(.*)")
_SAYS_ERROR = re.compile(r"Caused by:|[\w.]*(?:Error|Exception)\b[:\s]|.*\bERROR\b")
_TASK_LOG = re.compile(r"\d\d/\d\d/\d\d \S+ ERROR (?:FileFormatWriter|Executor|TaskSetManager|Utils):")


def failure(lines: list[str]) -> dict:
    """Of a failure's lines: the last exception's type and message, the root error, and the lines that tell of errors.

    The root error is the innermost cause that doesn't wrap another; without one, the first exception that doesn't.
    """
    here = os.getcwd()
    lines = [re.sub(r"\S*/site-packages/", "site-packages/", x.replace(f"file://{here}/", "").replace(f"{here}/", "")).strip() for x in lines]
    exceptions = [m for m in map(_EXCEPTION.match, lines) if m]
    key_lines = list(dict.fromkeys(x[:400] for x in lines if _SAYS_ERROR.match(x) and not _TASK_LOG.match(x)))
    plain = [x for x in key_lines if not _WRAPPING.search(x)]
    causes = [x.removeprefix("Caused by:").strip() for x in plain if x.startswith("Caused by:")]
    first = [x for x in plain if _EXCEPTION.match(x)]
    kind, message = exceptions[-1].groups() if exceptions else (None, None)
    root = causes[-1] if causes else first[0] if first else message
    return {
        "error_type": kind,
        "error_message": (message or "")[:800] or None,
        "root_error": (root or "")[:400] or None,
        "key_error_lines": key_lines[-10:],
    }


def cause(error: BaseException) -> dict:
    """What :func:`failure` finds in an exception."""
    found = failure([f"{type(error).__name__}: {error}".split("\n")[0], *str(error).split("\n")])
    return {"cause": found["root_error"] or str(error).split("\n")[0][:400], "key_lines": found["key_error_lines"]}


def run(spark: SparkSession, root, source: str | None, batch: str, start: str = STAGES[0], end: str = STAGES[-1], monitoring: bool = True) -> dict:
    """Runs the stages from ``start`` to ``end``; stops at the first that fails. Returns the log, which is written in either case."""
    now = time.time()
    started = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(now))
    log = {
        "run_id": f"run-{batch}-{int(now * 1000)}",
        "batch_date": batch,
        "started_at": started,
        "start_from": start,
        "triggered_by": os.environ.get("PIPELINE_TRIGGERED_BY", "manual"),
        "stages": [],
        "status": "SUCCESS",
    }
    job = Run(spark, root, source, batch)
    for name in STAGES[STAGES.index(start) : STAGES.index(end) + 1]:
        began, entry = time.time(), {"stage": name, "status": "SUCCESS"}
        log["stages"].append(entry)
        try:
            getattr(job, name)()
        except Exception as e:
            entry |= {"status": "FAILED", **cause(e)}
            log["status"] = "FAILED"
        entry["seconds"] = round(time.time() - began, 1)
        if log["status"] == "FAILED":
            break
    log["seconds"] = round(time.time() - now, 1)
    if log["status"] == "SUCCESS" and end == STAGES[-1]:
        files.commit(spark, root, batch)
    if monitoring:
        kept = spark.createDataFrame(
            [(log["run_id"], batch, log["status"], started, json.dumps(log))],
            "run_id string, batch_date string, status string, started_at string, log string",
        )
        files.write_audit(kept, files.layer_path(root, "audit", batch, f"runs/{log['run_id']}"))
    return log


def ingest(spark: SparkSession, root, source: str, pattern: str, batch: str | None, manifest_path: str, scan_only: bool = False) -> dict:
    """Compares the source's files with the manifest; where any is new, changed or failed before, stages and validates the snapshot."""
    known = json.loads(Path(manifest_path).read_text()) if Path(manifest_path).exists() else {}
    manifest = files.scan_files(source, pattern, known)
    files.save_manifest(manifest, manifest_path)
    waiting = [n for n, x in manifest.items() if x["state"] == "PENDING"]
    if scan_only or not waiting:
        return {"waiting": waiting, "status": "SCANNED"}
    if batch is None:
        raise ValueError("a batch date is needed unless files are only scanned")
    for n in waiting:
        files.advance(manifest, n, "PROCESSING")
    files.save_manifest(manifest, manifest_path)
    try:
        staged = files.stage_snapshot(spark, root, source, batch, NAMES, waiting)
    except Exception:
        for n in waiting:
            files.advance(manifest, n, "FAILED")
        files.save_manifest(manifest, manifest_path)
        raise
    log = run(spark, root, staged, batch, "bronze", "validation")
    for n in waiting:
        files.advance(manifest, n, "PROCESSED" if log["status"] == "SUCCESS" else "FAILED")
    files.save_manifest(manifest, manifest_path)
    return log | {"waiting": waiting}


def snapshot(spark: SparkSession, root, source: str, batch: str) -> dict:
    """Facts of the source files and of the layers that are there."""
    from pyspark.sql.types import StructType

    facts = {n: found.source_facts(spark, f"{source}/{n}.csv", StructType.fromDDL(SCHEMAS[n]), validation.KEYS[n]) for n in NAMES}
    return {
        "batch_date": batch,
        "source_files": facts,
        "layers": found.layers_present(spark, root, batch, ("bronze", "valid", "changes", "silver", "history", "enriched", "gold", "marts")),
    }


def strict_batch(spark: SparkSession, root, source: str, batch: str) -> None:
    """The standalone profile over a source's files: valid and rejected rows and an audit."""
    from pyspark.sql.types import StructType

    tables = {n: files.read_csv(spark, f"{source}/{n}.csv", StructType.fromDDL(SCHEMAS[n])) for n in NAMES}
    for n, rows in strict.everything(tables).items():
        files.write_layer(rows, root, "checked", batch, f"strict_{n}")
    kept = {n: files.read_layer(spark, root, "checked", batch, f"strict_{n}") for n in NAMES}
    for n, rows in kept.items():
        good, bad = strict.split(rows)
        files.write_layer(good, root, "processed", batch, n)
        files.write_layer(bad, root, "quarantine", batch, f"strict_{n}")
    files.write_audit(strict.audit(kept), files.layer_path(root, "audit", batch, "strict"))


COMMANDS = ("run", *STAGES, "ingest", "strict", "snapshot", "generate", "simulate", "dirty")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("command", choices=COMMANDS, help="the whole batch, one of its stages, or a tool beside it")
    p.add_argument("--root", help="the lake; without it STORAGE_MODE and its kin say where the layers lie")
    p.add_argument("--source", "--source-root", help="folder of the five CSV files")
    p.add_argument("--target", help="folder that made-up batches are written to")
    p.add_argument("--batch-date")
    p.add_argument("--start-from", choices=STAGES, default=STAGES[0])
    p.add_argument("--no-monitoring", action="store_true")
    p.add_argument("--file-pattern", default="*.csv")
    p.add_argument("--scan-only", action="store_true")
    p.add_argument("--manifest", default="file_manifest.json")
    p.add_argument("--seed", type=int, default=7)
    a = p.parse_args(argv)
    root = a.root or Storage.from_env()
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command in ("generate", "simulate", "dirty"):
        from pyspark.sql.types import StructType

        day = generate.clean(spark, seed=a.seed) if a.command == "generate" else {
            n: files.read_csv(spark, f"{a.source}/{n}.csv", StructType.fromDDL(SCHEMAS[n])) for n in NAMES
        }
        generate.write(
            generate.next_day(day, a.batch_date, a.seed) if a.command == "simulate" else generate.dirty(day, a.seed) if a.command == "dirty" else day,
            a.target,
        )
        return 0
    if a.command == "ingest":
        log = ingest(spark, root, a.source, a.file_pattern, a.batch_date, a.manifest, a.scan_only)
    elif a.command == "snapshot":
        log = snapshot(spark, root, a.source, a.batch_date)
    elif a.command == "strict":
        log = strict_batch(spark, root, a.source, a.batch_date) or {}
    elif a.command == "run":
        log = run(spark, root, a.source, a.batch_date, a.start_from, monitoring=not a.no_monitoring)
    else:
        log = run(spark, root, a.source, a.batch_date, a.command, a.command, not a.no_monitoring)
    print(json.dumps(log))
    return int(log.get("status") == "FAILED")


if __name__ == "__main__":
    raise SystemExit(main())
