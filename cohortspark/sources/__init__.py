"""Readers and writers: trial logs, survey exports, keys, stimuli, manifests, stages."""

from .exports import (
    discover,
    file_ranks,
    ordinal_columns,
    read_key,
    read_stimuli,
    read_survey,
    read_trials,
    survey_keys,
)
from .manifest import changed_inputs, input_manifest
from .stages import read_parts, read_stage, write_csv, write_parts, write_stage

__all__ = [
    "changed_inputs", "discover", "file_ranks", "input_manifest", "ordinal_columns", "read_key",
    "read_parts", "read_stage", "read_stimuli", "read_survey", "read_trials", "survey_keys",
    "write_csv", "write_parts", "write_stage",
]
