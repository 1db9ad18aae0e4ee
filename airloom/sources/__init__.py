from airloom.sources.tables import SCHEMAS, load_table, load_tables, stream_table

__all__ = ["SCHEMAS", "load_table", "load_tables", "stream_table"]
