from .files import load_config, load_env, read_csv_table, read_jsonl, read_jsonl_strict, write_csv_table, write_jsonl  # noqa: F401
from .tables import table  # noqa: F401
