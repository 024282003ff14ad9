"""Functions for SQL text: ``stance_label``, ``optimism``, ``disagreement`` and the table function ``detect_events``."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.detector import Automaton, Params
from .stance import stance


@F.pandas_udf(T.StringType())
def stance_label(text: pd.Series) -> pd.Series:
    return text.map(lambda t: stance(None if pd.isna(t) else t)[0])


def _detector(p: Params):
    class DetectEvents:
        """Events of one partition of a table (symbol, step, n, mu, sigma, z), fed in step order."""

        def __init__(self):
            self.machine, self.symbol = Automaton(p), None

        def eval(self, row: Row):
            self.symbol = row["symbol"]
            mu, sigma, z = (float("nan") if row[c] is None else float(row[c]) for c in ("mu", "sigma", "z"))
            if found := self.machine.feed(row["step"], row["n"], mu, sigma, z):
                yield (self.symbol, *found)

        def terminate(self):
            if self.symbol is not None and (found := self.machine.close()):
                yield (self.symbol, *found)

    return F.udtf(DetectEvents, returnType="symbol string, start bigint, end bigint, censored boolean, mu0 double, sigma0 double, z0 double")


def register(spark: SparkSession, p: Params) -> None:
    """Make the functions callable from ``spark.sql``."""
    spark.udf.register("stance_label", stance_label)
    spark.udtf.register("detect_events", _detector(p))
    spark.sql("create or replace temporary function optimism(bull double, bear double) returns double return ln((1 + bull) / (1 + bear))")
    spark.sql("create or replace temporary function disagreement(bull double, bear double) returns double return 1 - try_divide(abs(bull - bear), bull + bear)")
