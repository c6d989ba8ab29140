"""Source tables (readers and the test-fixture mapping) and stage tables."""

from tillroll.sources.stage import StageStore, checkpoint_root, write_stage  # noqa: F401
from tillroll.sources.tables import RetailTables, fixture_tables, read_retail_tables  # noqa: F401
