from lexdrift.catalog.oracles import ORACLES
from lexdrift.catalog.queries import QUERIES

__all__ = ["ORACLES", "QUERIES"]
