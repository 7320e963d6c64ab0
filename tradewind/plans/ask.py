"""SQL over the catalog, shaped for display and logged."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tradewind import rules
from tradewind.functions.columns import utc_now
from tradewind.operators.audit import as_text
from tradewind.session import stage, staging_scope
from tradewind.sources import ops


PLACE = "_place_in_result"


def run_query(
    spark: SparkSession, sql: str, question: str = "", limit: int | None = None
) -> dict:
    """Run ``sql`` once; return the first rows as text, the number of all rows and the time taken.

    The result is staged with each row's place, so that the count is of the whole result, its
    order holds, and only the rows shown reach the driver. ``limit`` cuts the result itself.
    """
    query_id, asked = uuid.uuid4().hex[:8], utc_now()
    try:
        result = spark.sql(sql)
        if limit is not None:
            result = result.limit(limit)
        start = time.monotonic()
        placed = as_text(result).select("*", F.monotonically_increasing_id().alias(PLACE))
        with staging_scope(spark):
            kept, total = stage(placed, "answer")
            shown = kept.orderBy(PLACE).limit(rules.RESULT_SHOWN).drop(PLACE)
            rows = [r.asDict() for r in shown.collect()]
        took = int((time.monotonic() - start) * 1000)
    except Exception as failure:  # a question that cannot be answered is an outcome
        return {"status": "error", "query_id": query_id, "question": question,
                "message": str(failure), "generated_sql": sql}
    ops.append_rows(spark, "QUERY_HISTORY", [(query_id, question, sql, took, total, asked)])
    return {
        "status": "success", "query_id": query_id, "question": question, "generated_sql": sql,
        "columns": result.columns, "results": rows, "total_rows": total,
        "execution_time_ms": took, "chart_data": rows[: rules.CHART_ROWS],
    }
