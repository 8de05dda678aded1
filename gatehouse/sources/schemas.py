"""Explicit schemas, so that no reader infers one from the data."""

TASK = "task_id STRING, prompt STRING"
RESULT = "task_id STRING, answer STRING"
GOLDEN = "task_id STRING, prompt STRING, expected STRING, validate STRING, category STRING, source STRING"
PROBE = ("ID STRING, Cat STRING, Answer STRING, Via STRING, Reason STRING, Pass BOOLEAN, "
         "GenTokens BIGINT, GenMS BIGINT")
CHAT = "messages ARRAY<STRUCT<role: STRING, content: STRING>>, family STRING"
TRACE = "index INT, code STRING, stdout STRING, json STRING, error STRING"
CALL = ("turn INT, timestamp TIMESTAMP, latency_ms BIGINT, prompt_tokens BIGINT, completion_tokens BIGINT, "
        "total_tokens BIGINT, cached_tokens BIGINT, reasoning_tokens BIGINT, batch_size INT, "
        "output_chars BIGINT, task_ids ARRAY<STRING>, model STRING, effort STRING, max_tokens BIGINT, "
        "messages VARIANT, assistant_message STRING, reasoning_content STRING, "
        f"tool_traces ARRAY<STRUCT<{TRACE}>>, error STRING")
UPLOAD = (
    "tasks ARRAY<STRUCT<task_id: STRING, prompt: STRING>>, "
    "results ARRAY<STRUCT<task_id: STRING, answer: STRING>>, "
    f"metrics STRUCT<model: STRING, calls: BIGINT, total_tokens: BIGINT, call_records: ARRAY<STRUCT<{CALL}>>>, label STRING")
EVENT = "run STRING, seq BIGINT, type STRING, timestamp TIMESTAMP, data VARIANT"
