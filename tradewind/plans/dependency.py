"""Models in the order of their inputs, rebuilt only where an input has changed.

A model declares the tables it reads. What a table holds is told by the names of its files:
Spark never reuses one, so equal names are equal data. A model is built when the names of its
inputs' files, or the parameters of the run, are others than when it was built last. A model
whose input failed is skipped and says so; models that do not depend on it go on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from contextvars import copy_context
from graphlib import TopologicalSorter

from pyspark.sql import SparkSession

from tradewind.functions.columns import utc_now
from tradewind.operators.dedup import latest_per_key
from tradewind.plans.pipeline import Model, Options, models, run_model
from tradewind.rules import TableNames
from tradewind.session import staging_scope
from tradewind.sources import ops

STATE = "MODEL_STATE"
BUILT, UNCHANGED, SKIPPED, FAILED = "SUCCESS", "UNCHANGED", "SKIPPED", "FAILED"


def fingerprint(spark: SparkSession, table: str) -> str | None:
    """What ``table`` holds, as a short text; nothing if there is no such table."""
    if not spark.catalog.tableExists(table):
        return None
    names = "\n".join(sorted(spark.table(table).inputFiles()))
    return hashlib.sha256(names.encode()).hexdigest()


def _built_from(spark: SparkSession) -> dict[str, str]:
    """By model: what it was built from last."""
    ops.create_if_missing(spark, STATE, ops.MODEL_STATE)
    newest = latest_per_key(spark.table(STATE), ["table_name"], "built_at")
    return {r["table_name"]: r["built_from"] for r in newest.collect()}


def run(
    spark: SparkSession, planned: Sequence[Model], parameters: str = "", parallel: int = 4
) -> list[dict]:
    """Bring ``planned`` up to date; one outcome per model, in the order they were reached.

    ``parameters`` stands for whatever else decides the results, such as the date of the run.
    Models that do not depend on each other are built ``parallel`` at a time.
    """
    by_name = {m.table.upper(): m for m in planned}
    order = TopologicalSorter({n: {i.upper() for i in m.inputs} for n, m in by_name.items()})
    order.prepare()  # raises on a cycle
    before, outcomes = _built_from(spark), {}

    def bring_up_to_date(name: str) -> dict:
        model = by_name[name]
        outcome = {"table": model.table, "layer": model.layer}
        down = [i for i in model.inputs if outcomes.get(i.upper(), {}).get("status") in (FAILED, SKIPPED)]
        if down:
            return outcome | {"status": SKIPPED, "reason": f"no new {', '.join(down)}"}
        prints = {i: fingerprint(spark, i) for i in model.inputs}
        missing = [i for i, p in prints.items() if p is None]
        if missing:
            return outcome | {"status": FAILED, "error": f"no table {', '.join(missing)}"}
        text = "\n".join([parameters, *(f"{i} {p}" for i, p in prints.items())])
        built_from = hashlib.sha256(text.encode()).hexdigest()
        if before.get(model.table) == built_from and spark.catalog.tableExists(model.table):
            return outcome | {"status": UNCHANGED}
        return run_model(model) | {"built_from": built_from}

    with staging_scope(spark), ThreadPoolExecutor(parallel) as submit:
        while order.is_active():
            ready = order.get_ready()
            running = {
                n: submit.submit(copy_context().run, bring_up_to_date, n) for n in ready if n in by_name
            }
            for name, result in running.items():
                outcomes[name] = result.result()
            # here, not where models are built: appends to one table must not overlap
            fresh = [outcomes[n] for n in running if outcomes[n]["status"] == BUILT]
            if fresh:
                ops.append_rows(
                    spark, STATE, [(o["table"], o["built_from"], utc_now()) for o in fresh])
            order.done(*ready)
    return list(outcomes.values())


def run_all(
    spark: SparkSession, as_of=None, names: TableNames = TableNames(), parallel: int = 4,
    options: Options = Options(),
) -> list[dict]:
    """All models, as far as their inputs or ``options`` have changed. Without ``as_of`` every
    run is a new one."""
    parameters = str(as_of if as_of is not None else utc_now())
    if options != Options():
        parameters += f"\n{options}"
    return run(spark, models(spark, as_of, names, options), parameters, parallel)
