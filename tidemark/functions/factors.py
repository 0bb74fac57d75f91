"""The built-in factors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import register
from tidemark.operators import series

for _name, _lookback, _skip in (("MOM_1M", 21, 0), ("MOM_3M", 63, 21), ("MOM_6M", 126, 21), ("MOM_12M", 252, 21)):
    register(_name, ("adj_close",), 1, _lookback + _skip)(lambda n=_lookback, k=_skip: series.momentum("adj_close", n, k))
for _n in (20, 60):
    register(f"VOL_{_n}D", ("adj_close",), -1, _n)(lambda n=_n: series.volatility("ret", n))
register("REVERSAL", ("adj_close",), -1, 6)(lambda: series.compounded("ret", 5))
register("TURNOVER", ("volume",), -1, 20)(lambda: series.ratio(F.col("volume"), series.full(F.avg("volume"), "volume", 20)))
