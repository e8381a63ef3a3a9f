from . import connectors, history, manifest, sync_events, tables
