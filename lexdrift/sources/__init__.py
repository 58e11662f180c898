from lexdrift.sources import columnar, dump
from lexdrift.sources.audit import audit_parquet, is_parquet, require_parquet
from lexdrift.sources.columnar import read_split

__all__ = ["audit_parquet", "columnar", "dump", "is_parquet", "read_split", "require_parquet"]
