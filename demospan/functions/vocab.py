"""The words, codes and numbers that give the dataset rules their meaning."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# --- fixed values: verb -> number of arguments, per dataset kind -------------------------------
ARITY = {
    "libero": {
        "PLACE_ON": 2,
        "PLACE_IN": 2,
        "PICKUP_FROM": 2,
        "OPEN": 1,
        "CLOSE": 1,
        "TURN_ON": 1,
        "TURN_OFF": 1,
    },
    "calvin": {
        "PLACE_ON": 1,
        "PLACE_IN": 1,
        "PICKUP_FROM": 2,
        "OPEN": 1,
        "CLOSE": 1,
        "TURN_ON": 1,
        "TURN_OFF": 1,
        "MOVE_SLIDER": 1,
        "PUSH": 3,
        "PUSH_INTO": 2,
        "TURN_OBJECT": 2,
    },
    "table": {
        "PLACE_ON": 2,
        "PLACE_IN": 2,
        "PICKUP_FROM": 2,
    },
}

# --- fixed values: structured (plan / done / now) texts use a grammar of their own -------------
COT_ARITY = {"PICK": 1, "PLACE": 3, "OPEN": 1, "CLOSE": 1, "ROTATE": 1, "GRASP": 1, "RELEASE": 1}
INSTRUCTION_MARKER = "Instruction:"
PLAN_MARKER = "Plan:"
DONE_MARKER = "What I have done:"
NOW_MARKER = "Now I need to do:"
TIME_FIELDS = [
    "start_step",
    "end_step",
    "reference_start_step",
    "reference_end_step",
    "outdated_reference_start_step",
    "outdated_reference_end_step",
]

# --- fixed values: argument words of the richer grammar ----------------------------------------
DIRECTIONS = ["left", "right"]
PUSH_MODES = ["slide", "sweep_off"]
DIRECTION_ARGUMENTS = {"MOVE_SLIDER": [0], "PUSH": [1], "TURN_OBJECT": [1]}
PUSH_MODE_ARGUMENTS = {"PUSH": [2]}
OBJECT_ALIASES = {
    "table surface": "table",
    "cabinet drawer": "drawer",
    "green light": "led light",
    "led": "led light",
    "green lamp": "led light",
    "led lamp": "led light",
    "yellow lamp": "light bulb",
    "yellow light": "light bulb",
}

# --- fixed values: verb groups ------------------------------------------------------------------
PICK_VERBS = ["PICKUP_FROM"]
PLACE_VERBS = ["PLACE_ON", "PLACE_IN"]
FREE_GRIPPER_VERBS = [
    "PICKUP_FROM",
    "OPEN",
    "CLOSE",
    "TURN_ON",
    "TURN_OFF",
    "MOVE_SLIDER",
    "PUSH",
    "PUSH_INTO",
]
EXPERT_OF_VERB = {
    "PICKUP_FROM": 0,
    "PLACE_ON": 1,
    "PLACE_IN": 1,
    "OPEN": 2,
    "CLOSE": 3,
    "TURN_ON": 4,
    "TURN_OFF": 4,
}

# --- fixed values: camera conventions and image streams ------------------------------------------
NO_TRANSFORM = "robosuite_agentview_opengl"
HORIZONTAL_FLIP = "robosuite_agentview_horizontal_flip"
ROTATED_180 = "sim_agentview_rotated_180_degrees"
IMAGE_STREAMS = {
    "top": "observation.images.top",
    "wrist": "observation.images.wrist",
    "observation.images.top": "observation.images.top",
    "observation.images.wrist": "observation.images.wrist",
}
CAMERA_OF_STREAM = {"image": "agentview", "wrist_image": "robot0_eye_in_hand"}
SUITE_RANK = {"libero_10": 0, "libero_90": 1, "libero_goal": 2, "libero_object": 3, "libero_spatial": 4}

# --- fixed values: defaults and tolerances --------------------------------------------------------
MODEL_GRID = 1024
END_SNAP_STEPS = 2
MAX_SAMPLED_FRAMES = 50
MAX_STEP_DELTA_PIXELS = 80.0
MAX_OUT_OF_BOUNDS_FRACTION = 1.0
MAX_EXACT_REPROJECTION_METERS = 1e-6
MAX_ROUNDED_REPROJECTION_METERS = 0.02
MIN_DEPTH = 1e-6
BOUNDARY_WINDOW = 10
TRACE_HORIZON = 20
MAX_ANCHOR_AGE = 15
SCENE_DROPOUT = 0.15
STEP_TIMEOUT = 200
OVERLAP_RATIO = 0.9
MIN_BOX_TOP = 0.2
DETECTOR_WEIGHT = 0.65
TEXT_IMAGE_WEIGHT = 0.35
CALVIN_STATE_SIZE = 15
ACTION_SIZE = 7
FPS = {"libero": 10, "calvin": 10, "table": 30}


def literal_map(values: dict) -> Column:
    """A constant map column; lookups of absent keys give null."""
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def literal_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])
