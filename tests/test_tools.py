"""Tools called with an argument from SQL."""

from corpuslake.plans.tools import TOOLS, register_tools


def test_tools_take_an_argument(spark):
    assert register_tools(spark, "/root/testdata/sf0.001") == list(TOOLS)
    for tool, column in (("graph_neighbors", "entity"), ("classify_formulation", "case_id")):
        some = spark.table(tool).orderBy(column).first()[column]
        value = f"'{some}'" if isinstance(some, str) else str(some)
        got = [tuple(r) for r in spark.sql(f"SELECT * FROM {tool}_of({value})").collect()]
        assert got and sorted(got, key=str) == sorted((tuple(r) for r in spark.table(tool).where(f"{column} = {value}").collect()), key=str)
    assert spark.sql("SELECT count(*) FROM graph_neighbors_of('nobody')").first()[0] == 0
