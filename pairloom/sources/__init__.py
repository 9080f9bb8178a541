"""Reading, writing and staging tables."""

from pairloom.sources.readers import MissingColumns, WrongCount, canonical_names, read_examples, read_split, require_columns, spread
from pairloom.sources.saved import BadDataset, read_saved, write_saved, write_saved_splits
from pairloom.sources.staging import staged, staging_dir, staging_path
from pairloom.sources.writers import schema_json, split_manifest, write_completions, write_sized_splits, write_splits

__all__ = [name for name in dir() if not name.startswith("_")]
