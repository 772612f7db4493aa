"""Record schemas and fixed value sets of the evaluation logs."""

from __future__ import annotations

from pyspark.sql import types as T

# Condition names and their short spellings.
CONDITIONS = (
    "no_context",
    "with_public_agent_skill",
    "with_agent_skill",
    "with_legacy_skill",
    "with_skill",
    "with_sanitized_skill",
    "with_gene",
    "with_gene_gemini",
    "with_gene_opus",
)
CONDITION_ALIASES = {
    "agent_skill": "with_agent_skill",
    "public_agent_skill": "with_public_agent_skill",
    "legacy_skill": "with_legacy_skill",
    "skill": "with_skill",
    "gene": "with_gene",
    "gene_gemini": "with_gene_gemini",
    "gene_opus": "with_gene_opus",
}
LEGACY_PROTOCOL = "legacy-v1"
TAIL_CHARS = 1800
KEY_SEPARATOR = "::"

_s, _l, _d, _b = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


TRIAL = _struct(
    task_id=_s, legacy_task_id=_s, source=_s, family=_s, execution_mode=_s, model=_s, condition=_s, trial_key=_s
)
EVAL = _struct(
    mode=_s, passed=_b, n_pass=_l, n_fail=_l, n_total=_l, pass_rate=_d, agg_score=_d,
    scores=T.MapType(_s, _d), error_type=_s, returncode=_l, stdout_tail=_s, stderr_tail=_s,
)
TOKENS = _struct(input=_l, output=_l, thoughts=_l, system_chars=_l, user_chars=_l)
RESULT = _struct(
    schema_version=_s, prompt_protocol=_s, scoring_protocol=_s, runtime_protocol=_s, run_fingerprint=_s,
    manifest_sha256=_s, model_id=_s, prompt_sha256=_struct(system=_s, user=_s), trial=TRIAL, eval=EVAL,
    tokens=TOKENS, cost_usd=_d, cumulative_cost_usd=_d, elapsed_s=_d,
)
CASE = _struct(
    schema_version=_s, runtime_protocol=_s, run_fingerprint=_s, trial_key=_s, task_id=_s, raw_response=_s,
    extracted_code=_s,
)
BUDGET = _struct(
    schema_version=_s, runtime_protocol=_s, run_fingerprint=_s, trial_key=_s, model_id=_s, input_tokens=_l,
    output_tokens=_l, thoughts_tokens=_l, cost_usd=_d, cumulative_cost_usd=_d,
)
RUN_EVENT = _struct(schema_version=_s, timestamp=_s, event=_s, runtime_protocol=_s, run_fingerprint=_s)
TASK = _struct(
    task_id=_s, family=_s, execution_mode=_s, source=_s, orig_id=_s, answer_format=_s, legacy_task_id=_s,
    rel_dir=_s, files=T.MapType(_s, _s),
    calibration=_struct(anchor=_s, n_pass=_l, n_trials=_l, verdict=_s),
)
CALL = _struct(
    step=_l, rollout=_l, kind=_s, ok=_b, api_call=_b, input_tokens=_l, output_tokens=_l, thoughts_tokens=_l,
    total_tokens=_l,
)
PAYLOAD = _struct(
    type=_s, summary=_s, category=_s, signals_match=T.ArrayType(_s), strategy=T.ArrayType(_s),
    preconditions=T.ArrayType(_s),
    constraints=_struct(max_files=_l, forbidden_paths=T.ArrayType(_s)), validation=T.ArrayType(_s),
)
ASSET = _struct(
    asset_id=_s, domain=_s, short_title=_s, model_name=_s, generation_source=_s, created_at=_s, payload=PAYLOAD,
    evolve=_struct(
        source=_s, solved=_b, n_iters=_l, success_rate=_d, mutation_log=T.ArrayType(_s), calls=T.ArrayType(CALL)
    ),
)
# Column order of the per-task metrics file.
METRICS = _struct(
    release_id=_s, task_id=_s, family=_s, source=_s, execution_mode=_s, model_alias=_s, model_display_name=_s,
    requested_model_id=_s, provider=_s, condition=_s, passed=_l, input_tokens=_l, output_tokens=_l,
    thoughts_tokens=_l, total_tokens=_l, opus_gene_source=_s, subset=_s, subset_memberships=_s, source_run_id=_s,
    source_segment=_s, protocol=_s, runner_seed=_l, provider_sampling_seed=_s, trial_count=_l, manifest_sha256=_s,
    skill_asset_set_sha256=_s, opus_gene_asset_set_sha256=_s, gemini_gene_asset_set_sha256=_s,
)
