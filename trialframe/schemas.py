"""Schemas of the records that are read and written; readers never infer them."""

from __future__ import annotations

TASK = "task_id string, prompt string, hidden_tests string, visible_tests string, canonical_solution string, entry_point string"
EVALPLUS = "task_id string, prompt string, entry_point string, canonical_solution string, base_input string, plus_input string, atol double"
APPS = "problem_id string, difficulty string, prompt string, starter_code string, canonical_solution string, inputs string, outputs string"
OUTCOME = "task_id string, states array<string>, initial_category string, unmapped_as_c array<boolean>, iterations_run int, stop_reason string, empty_visible_suite boolean"
USAGE = "struct<prompt_tokens:int,completion_tokens:int,phase:string>"
CACHE_ENTRY = f"struct<task_id:string,prompt:string,raw_response:string,code:string,had_code_block:boolean,usage:{USAGE},hidden:struct<passed:boolean,state:string>>"
CACHE = f"schema string, dataset_path string, dataset_sha256 string, model string, llm_mode string, decoding struct<temperature:double,top_p:double,max_tokens:int>, generation_prompt_style string, taxonomy_version string, created_at string, entries array<{CACHE_ENTRY}>"
FINDING = "technique string, severity string, signal string, message string, evidence string, exception string, location struct<file:string,line:int>, test_id string, occurrences int, values array<struct<input:string,actual:string,expected:string>>, category string, rule_id string, confidence double"
EXPERIMENT_RUNS = "run_id string, created_at string, model string, mode string, iterations int, seed int, config_json string"
PROBLEM_RUNS = "problem_run_id string, run_id string, benchmark string, problem_id string, sub_tier string, passed int, passed_round int, initial_bug_primary string, initial_bug_sub string, final_bug_primary string, final_bug_sub string, total_duration_ms bigint, completed_at string"
PROBLEM_ROUNDS = "round_id string, problem_run_id string, round_number int, prompt string, response string, code_snapshot string, passed int, bug_primary string, bug_sub string, compiler_feedback string, token_count int, duration_ms bigint, created_at string"
MANIFEST = "schema string, run_id string, dataset_path string, dataset_sha256 string, task_count int, repair_mode string, k int, model string, sample_size int, seed int, llm_mode string, taxonomy_version string, start_time string, end_time string, completed boolean, termination string, error string"
PROGRESS = "schema string, run_id string, phase string, completed int, total int, updated_at string"
TRAJECTORY = "schema string, run_id string, task_id string, iteration int, prompt string, raw_response string, code string, hidden string"
EXPORT = "run_id string, model string, date string, benchmark string, problem_id string, sub_tier string, category string, notes string, duration_ms bigint"
