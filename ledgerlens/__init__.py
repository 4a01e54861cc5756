"""ledgerlens: working-capital analytics expressed as Spark DataFrame jobs.

Layers
------
sources/    journal adapter, literal dimensions, sinks
functions/  Column helpers (portable bucket, calendar, filters, measures)
operators/  reusable distributed building blocks (dense index, interval
            balances by event deltas, hot-key split join)
plans/      the curated tables and every query built on them
streaming/  incremental refresh with Structured Streaming
oracle/     DuckDB SQL used as an independent correctness oracle
llm/        training-data operators; nothing else imports them
"""

from ledgerlens.config import Params, TEST_PARAMS

__all__ = ["Params", "TEST_PARAMS"]
