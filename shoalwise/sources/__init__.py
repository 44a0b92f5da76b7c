from shoalwise.sources.files import normalise_names, read_table, snake_case, write_table
from shoalwise.sources.stages import Stage, UnfinishedStage, open_stage, write_stage

__all__ = ["Stage", "UnfinishedStage", "normalise_names", "open_stage", "read_table", "snake_case", "write_stage", "write_table"]
