"""The labelled feature table makes its components once."""
from twinraster.plans import model_queries as MQ
from twinraster.plans import scoring_queries as Q


def test_components_are_labelled_once(spark, monkeypatch):
    calls, labelled, cut, written = [], Q.labelled, MQ.cut, []
    monkeypatch.setattr(Q, "labelled", lambda *a: calls.append(a) or labelled(*a))
    monkeypatch.setattr(MQ, "cut", lambda df: written.append(df.columns) or cut(df))
    rows = MQ.labelled_table(spark, "/root/testdata/sf0.001").collect()
    assert rows and len(calls) == 1
    assert written == [["pair_id", "class_name", "component_id", "y", "x0", "x1"]]
