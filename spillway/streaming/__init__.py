from .runs import merge_runs, write_runs

__all__ = ["merge_runs", "write_runs"]
