"""Declared schemas of the canonical tables and of the small dimension files."""

from __future__ import annotations

TOKEN_FIELDS = (
    "input_tokens",
    "cached_input_tokens",
    "output_tokens",
    "reasoning_output_tokens",
    "total_tokens",
)
TOKENS = ", ".join(f"{f} BIGINT" for f in TOKEN_FIELDS)

RATE_LIMITS = (
    "ARRAY<STRUCT<plan_type: STRING, limit_id: STRING, window: STRING, window_minutes: BIGINT, resets_at: TIMESTAMP>>"
)

LINES = "file_path STRING, block BIGINT, line_no BIGINT, value STRING"

USAGE = (
    "timestamp TIMESTAMP, session_id STRING, model STRING, fast BOOLEAN, reasoning_effort STRING, cwd STRING, "
    f"account_id STRING, file_path STRING, line_no BIGINT, rate_limits {RATE_LIMITS}, {TOKENS}"
)

SAMPLES = (
    "timestamp TIMESTAMP, session_id STRING, account_id STRING, plan_type STRING, limit_id STRING, window STRING, "
    "window_minutes BIGINT, used_percent DOUBLE, remaining_percent DOUBLE, resets_at TIMESTAMP, "
    "source_path STRING, source_line BIGINT"
)

ACCOUNT_HISTORY = (
    "version INT, "
    "defaultAccount STRUCT<accountId: STRING, observedAt: STRING, source: STRING, name: STRING, email: STRING, planType: STRING>, "
    "switches ARRAY<STRUCT<timestamp: STRING, fromAccountId: STRING, toAccountId: STRING, source: STRING>>"
)

MODE_HISTORY = (
    "version INT, defaultMode STRUCT<fast: BOOLEAN, observedAt: STRING, source: STRING>, "
    "switches ARRAY<STRUCT<timestamp: STRING, fast: BOOLEAN, source: STRING>>"
)

RATE_CARD = (
    "source STRUCT<name: STRING, checked_at: STRING, credit_to_usd: STRING>, "
    "models ARRAY<STRUCT<key: STRING, label: STRING, input_credits_per_million: DOUBLE, "
    "cached_input_credits_per_million: DOUBLE, output_credits_per_million: DOUBLE, "
    "fast_credit_multiplier: DOUBLE, note: STRING>>, "
    "knownUnpriced ARRAY<STRUCT<key: STRING, label: STRING, note: STRING>>"
)

ACCOUNT_SWITCHES = "ts TIMESTAMP, account_id STRING, from_account_id STRING, source STRING, pos BIGINT"
MODE_SWITCHES = "ts TIMESTAMP, fast BOOLEAN, source STRING, pos BIGINT"
