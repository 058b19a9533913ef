from playstat.sources.schemas import Bundle, RESULT_SCHEMA
from playstat.sources.loader import load_bundle, read_table, optional_table
from playstat.sources.adapters import events_bundle, lineitem_bundle

__all__ = ["Bundle", "RESULT_SCHEMA", "load_bundle", "read_table", "optional_table",
           "events_bundle", "lineitem_bundle"]
