"""Canonical tables."""

from __future__ import annotations

_MESSAGES = "array<struct<role:string,content:string>>"

TASKS = (
    f"prompt_id bigint, source string, split string, prompt string, messages {_MESSAGES}, solution string, "
    "target double, nums array<bigint>, image binary"
)
ROLLOUTS = (
    "rollout_id bigint, group_id bigint, gen_idx bigint, batch_id bigint, step bigint, mode string, prompt_id bigint, "
    "completion string"
)
TOKENS = (
    "rollout_id bigint, group_id bigint, step bigint, prompt_ids array<bigint>, completion_ids array<bigint>, "
    "logps array<double>, old_logps array<double>, ref_logps array<double>"
)
METRICS = "mode string, step bigint, metric string, value double"
