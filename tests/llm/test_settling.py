import pytest

from tieout.llm.survivor import survivors


def test_trust_that_has_not_settled_is_an_error(spark):
    rows = spark.createDataFrame([(g, s, "1", v) for g in range(6) for s, v in (("a", "x"), ("b", "x"), ("c", f"y{g}"))], "g int, s string, l string, v string")
    with pytest.raises(RuntimeError):
        survivors(rows, {"v": "plain"}, group="g", source="s", last="l", rounds=1, settled=0.0)
    assert {r.v for r in survivors(rows, {"v": "plain"}, group="g", source="s", last="l").collect()} == {"x"}
