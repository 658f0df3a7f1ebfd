"""The functions that SQL can call: scalar ones as SQL functions, which the optimizer opens up, and one that gives rows."""

from __future__ import annotations

from collections.abc import Iterator
import re

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from .text import BARS, QUALIFIER

#: Name, arguments, result and body of each SQL function.
SCALARS = (
    ("bare_title", "title STRING", "STRING", "trim(regexp_replace(title, r'{}', ''))".format(QUALIFIER)),
    ("edition_of", "project STRING", "STRING", r"regexp_replace(lower(trim(project)), '[.]org$', '')"),
    ("percent_change", "before DOUBLE, after DOUBLE", "DOUBLE", "CASE WHEN before > 0 THEN (after / before - 1) * 100 END"),
    ("per_million", "part DOUBLE, whole DOUBLE", "DOUBLE", "CASE WHEN whole > 0 THEN part / whole * 1e6 END"),
    ("damped", "v DOUBLE", "DOUBLE", "ln(1 + greatest(coalesce(v, 0), 0))"),
    ("array_middle", "a ARRAY<DOUBLE>", "DOUBLE", "(SELECT median(x) FROM explode(a) AS t(x))"),
    ("spark_line", "a ARRAY<DOUBLE>", "STRING", f"CASE WHEN array_max(a) IS NULL THEN '' WHEN array_max(a) <= 0 THEN repeat('{BARS[0]}', size(a)) ELSE array_join(transform(a, v -> CASE WHEN v IS NULL THEN ' ' ELSE "
     f"substring('{BARS}', cast(greatest(0, least(7, floor(v / array_max(a) * 7 + 0.5))) AS INT) + 1, 1) END), '') END"),
)


@udtf(returnType="position int, sentence string")
class Sentences:
    def eval(self, text: str) -> Iterator[Row]:
        marked = text or ""
        for pattern, left in ((r"([.!?;:])\s+", r"\1"), (r"\n+", ""), (r"(?:^|\s)[-*•]\s+", "")):
            marked = re.sub(pattern, left + "\x1e", marked, flags=re.ASCII)
        for k, s in enumerate(x.strip(" ") for x in marked.split("\x1e") if x.strip(" ")):
            yield Row(position=k, sentence=s)


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to SQL of this session and gives their names."""
    for name, args, result, body in SCALARS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {result} RETURN {body}")
    spark.udtf.register("sentences_of", Sentences)
    return [*(x[0] for x in SCALARS), "sentences_of"]
