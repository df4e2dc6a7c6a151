"""``op6_near_duplicates``: class of every document among near copies of 0.8 and more."""

from lotwise.llm.near_duplicates import near_duplicates
from lotwise.llm.registry import query, table


@query("op6_near_duplicates")
def op6_near_duplicates(spark, sf):
    return near_duplicates(table(spark, sf, "documents"))
