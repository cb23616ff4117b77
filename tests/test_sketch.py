import random
import statistics

import pytest

from millrace.table import Col


def test_numbers(spark):
    rng = random.Random(2)
    values = [rng.gauss(0, 10) for _ in range(5000)] + [None] * 7
    s = Col.of(spark, values, float).sketch_summary()
    real = sorted(v for v in values if v is not None)
    assert (s.size(), s.num_undefined(), s.min(), s.max()) == (5007, 7, real[0], real[-1])
    assert abs(s.mean() - statistics.mean(real)) < 1e-9 and abs(s.std() - statistics.pstdev(real)) < 1e-9 and abs(s.sum() - sum(real)) < 1e-6
    assert abs(s.num_unique() - 5000) < 0.02 * 5000
    for q in (0, 0.1, 0.5, 0.99, 1):
        rank = sum(v <= s.quantile(q) for v in real) / len(real)
        assert abs(rank - q) < 0.005
    with pytest.raises(ValueError):
        s.quantile(2)


def test_items(spark):
    values = ["a"] * 50 + ["b"] * 30 + [f"x{i}" for i in range(100)] + [None]
    s = Col.of(spark, values).sketch_summary()
    assert list(s.frequent_items().items())[:2] == [("a", 50), ("b", 30)] and s.frequency_count("a") == 50 and s.frequency_count("zz") == 0
    with pytest.raises(RuntimeError):
        s.mean()


def test_cells(spark):
    lists = Col.of(spark, [[1.0, 2.0], [3.0], None, []]).sketch_summary()
    assert lists.element_length_summary().max() == 2 and lists.element_summary().sum() == 6.0 and lists.element_sub_sketch([0])[0].sum() == 4.0
    dicts = Col.of(spark, [{"a": 1, "b": 2}, {"a": 5}, None]).sketch_summary(sub_sketch_keys=["a"])
    assert dicts.dict_key_summary().frequency_count("a") == 2 and dicts.dict_value_summary().max() == 5 and dicts.element_sub_sketch()["a"].sum() == 6


def test_background(spark):
    s = Col.from_sequence(spark, 1000).sketch_summary(background=True)
    assert s.max() == 999 and s.sketch_ready() and s.num_elements_processed() == 1000
    t = Col.from_sequence(spark, 10).sketch_summary(background=True)
    t.cancel()
