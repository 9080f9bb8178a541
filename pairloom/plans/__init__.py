"""End-to-end jobs composed of operators."""

from pairloom.plans.alignment import alignment_examples, alignment_rows
from pairloom.plans.completion_export import export_completions
from pairloom.plans.evaluation import evaluate_sets
from pairloom.plans.hindsight import hindsight_batches
from pairloom.plans.preparation import preparation_manifest, prepare_and_save, prepare_pairs, split_pairs
from pairloom.plans.supervised import supervised_texts

__all__ = [name for name in dir() if not name.startswith("_")]
