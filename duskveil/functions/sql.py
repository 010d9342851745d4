"""The engine's functions for SQL: a table function that scans, and scalar helpers."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..operators import entropy
from ..operators.rules import DEFAULT_RULES, Rule, check_rules


def register(spark: SparkSession, rules: list[Rule] | None = None) -> None:
    """Registers ``scan_text(text)`` (rows ``flag, start, end, value`` before constraints) and ``text_entropy(text)``.

    For large tables use ``operators.scan.scan``, which stays in the JVM; the table function is for
    single texts and lateral joins.
    """
    from ..operators.scan import python_spans

    checked = check_rules(rules or DEFAULT_RULES)
    cards = next((i for i, r in enumerate(checked) if "payment-card" in r.validators), None)

    @udtf(returnType="flag string, start int, `end` int, value string")
    class ScanText:
        def eval(self, text: str):
            if text:
                for rule, _, start, end, value, _ in python_spans(text, checked, cards, len(checked), entropy.DEFAULT_THRESHOLD, True):
                    yield checked[rule].flag if rule < len(checked) else entropy.FLAG, start, end, value

    spark.udtf.register("scan_text", ScanText)
    spark.udf.register("text_entropy", F.pandas_udf(lambda s: s.map(lambda t: None if t is None else entropy.entropy(t)), "double"))
