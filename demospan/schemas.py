"""Fixed row shapes. Readers apply them explicitly; nothing is inferred."""

from __future__ import annotations

TASKS = "task_index bigint, task string"
EPISODES = "episode_index bigint, task_index bigint, length bigint, tasks array<string>, task string"
SEGMENT = (
    "struct<start_step:bigint,end_step:bigint,instruction:string,plan:string,skill:string,updated_skill:string,"
    "content:string,updated_content:string,updated_content_w_instruction:string,"
    "state:array<double>,action:array<double>>"
)
ANNOTATION = (
    "episode_index bigint, task_index bigint, task_name string, raw_instruction string, instruction string, "
    "num_steps bigint, fps bigint, plan string, "
    f"segments array<{SEGMENT}>, model string, prompt_version string, source_repo_id string, dataset_root string, "
    "created_at string"
)
MODEL_RESPONSE = "struct<plan:string,steps:array<struct<skill:string,end_step:string>>>"
POINT_RESPONSE = "struct<status:string,reasoning:string,object_id:string,label:string,point_2d:array<string>>"
TRACE_RESPONSE = (
    "struct<status:string,reasoning:string,contact_start_step:string,"
    "points:array<struct<frame_index:string,point_2d:array<string>,label:string>>>"
)
POINT = "struct<object_id:string,label:string,point:array<double>>"
CONTACT_TRACE = (
    "struct<contact_start_step:bigint,frame_indices:array<bigint>,trace:array<array<double>>,model_trace:array<array<double>>>"
)
DENSE_TRACE = (
    "struct<trace:array<array<double>>,raw_trace:array<array<double>>,projection_depth:array<double>,"
    "source_world_positions:array<array<double>>,in_bounds:array<boolean>,frame_indices:array<bigint>,"
    "out_of_bounds_count:bigint,out_of_bounds_fraction:double,"
    "reprojection_checks:struct<exact_max_error_meters:double,rounded_in_bounds_max_error_meters:double>>"
)
TRACE_ENTRY = (
    "struct<skill_index:bigint,skill:string,start_step:bigint,end_step:bigint,sampled_frame_indices:array<bigint>,"
    f"semantic_target:{POINT},contact_prediction:{POINT},prediction_trace:{CONTACT_TRACE},"
    f"extraction_trace:{CONTACT_TRACE},end_effector_trace:{DENSE_TRACE}>"
)
TRACE_ANNOTATION = (
    "episode_index bigint, task_index bigint, instruction string, num_steps bigint, fps bigint, plan string, "
    "segments array<struct<start_step:bigint,end_step:bigint,skill:string>>, "
    f"target_traces array<{TRACE_ENTRY}>, image_key string, image_width bigint, image_height bigint, "
    "query_image_width bigint, query_image_height bigint, model_coordinate_width bigint, "
    "model_coordinate_height bigint, trace_frame_count bigint, semantic_target_enabled boolean, "
    "contact_prediction_enabled boolean, contact_extraction_enabled boolean, "
    "contact_prediction_only_enabled boolean, end_effector_trace_enabled boolean"
)
TARGET = "struct<type:string,id:string,appearance:string,location:string,image_point:array<double>>"
ROLLOUT = "task_id bigint, episode_idx bigint, success boolean, task_prompt string, plan string"
ROLLOUT_FILE = (
    "task_suite string, model_name string, "
    f"completed_episodes array<struct<{', '.join(f.split()[0] + ':' + f.split()[1] for f in ROLLOUT.split(', '))}>>"
)
VIOLATION = "source string, episode bigint, position bigint, rule string"
