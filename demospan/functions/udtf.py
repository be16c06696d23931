"""Table function for SQL users: the items of a plan text."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession, functions as F


@F.udtf(returnType="position int, skill string", useArrow=True)
class PlanItems:
    """``SELECT * FROM plans, LATERAL plan_items(plan)``: raw items in order, from position 1.

    DataFrame users take ``posexplode(parse_plan_raw(plan))``, which stays on the JVM.
    """

    def eval(self, plan: str):
        text = re.sub(r"^Plan:", "", " ".join((plan or "").split())).strip()
        marks = list(re.finditer(r"\d+\.\s*", text))
        ends = [m.start() for m in marks[1:]] + [len(text)]
        bodies = [text[m.end() : e].strip() for m, e in zip(marks, ends)] or [text]
        for position, skill in enumerate([b for b in bodies if b], 1):
            yield position, skill


def register(spark: SparkSession) -> None:
    spark.udtf.register("plan_items", PlanItems)
