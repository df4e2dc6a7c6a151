"""``op2_decontamination``: documents that hold items of ``benchmark``."""

from lotwise.llm.decontamination import matches
from lotwise.llm.registry import query, table


@query("op2_decontamination")
def op2_decontamination(spark, sf):
    return matches(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
