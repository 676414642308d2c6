"""Schemas of the engine's tables; nothing is inferred."""

from __future__ import annotations

POINT = "struct<x:double,y:double>"
PATHS = f"drawing_id bigint, path_id bigint, points array<{POINT}>"
COMMANDS = "session_id bigint, seq bigint, cmd string, x double, y double, speed double"
ACTIONS = "session_id bigint, seq bigint, op string, value double"
COMPONENTS = "image_id bigint, label bigint, min_x bigint, min_y bigint, width bigint, height bigint, area bigint"
LABELLED = "image_id bigint, y bigint, x bigint, label bigint"
PAIR = "stem string, image string, mask string"
MANIFEST = f"split string, seed int, pair_count int, pairs array<struct<{PAIR.replace(' string', ':string')}>>"
COMMAND_JSON = "cmd string, x double, y double, speed double"
EXPERIMENT = (
    "image string, vision_mode string, path_ordering string, mask_path string, mask_precision double, mask_recall double, mask_dice double, mask_iou double, num_paths bigint, num_commands bigint, "
    "cleanup_input_points bigint, cleanup_output_points bigint, draw_distance_mm double, pen_up_distance_mm double, total_distance_mm double, output_dir string"
)
HISTORY = "run_id string, epoch int, train_loss double, val_loss double, is_best_checkpoint boolean"
