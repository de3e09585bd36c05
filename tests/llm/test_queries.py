from placeloom.llm.queries import QUERIES, SQL


def test_every_problem_has_queries():
    assert {q.split("_")[0] for q in QUERIES} == {"p1", "p2", "p3", "p4", "p5", "p7", "p8", "p9"}
    assert set(SQL) <= set(QUERIES)
