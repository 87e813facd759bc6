"""The read-only tools: each one's results as a temporary view, and as a SQL table function of the argument that an agent passes."""

from __future__ import annotations

from pyspark.sql import SparkSession

from corpuslake.plans import registry

#: Tool, the registered query behind it, and the column that its argument is compared with.
TOOLS = {
    "search_corpus": ("x5_search_corpus", "query_id"), "graph_neighbors": ("j7_neighbourhood", "entity"), "classify_formulation": ("u10_classify_formulation", "case_id"), "abs_check": ("u11_abs_route", None),
    "lookup_material_ipr": ("x6_lookup_material", None), "treaty_membership": ("j12_treaty_check", None), "registry_pointer": ("j9_registry_pointers", None),
}


def register_tools(spark: SparkSession, sf_dir: str) -> list[str]:
    """Creates the view ``<tool>`` and, as ``<tool>_of(argument)``, a table function of its rows for one argument, the view's first column unless one is named. Only the stored corpus of the search is
    built at once; the argument is a filter, pushed as far down as the query lets it. Returns the tools' names."""
    known = registry.queries()
    for tool, (name, column) in TOOLS.items():
        df = known[name](spark, sf_dir)
        df.createOrReplaceTempView(tool)
        by = column or df.columns[0]
        columns = ", ".join(f"`{c}` {kind}" for c, kind in df.dtypes)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {tool}_of(argument {dict(df.dtypes)[by]}) RETURNS TABLE ({columns}) RETURN SELECT {', '.join(f'`{c}`' for c in df.columns)} FROM {tool} WHERE `{by}` = {tool}_of.argument")
    return list(TOOLS)
