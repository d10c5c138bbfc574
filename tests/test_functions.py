import random
import struct

import pytest
from pyspark.sql import functions as F

from plurigrade.functions import scalars
from plurigrade.settings import Settings, usable_cores


def test_labels_at_the_edges(spark):
    df = spark.createDataFrame([(0, 0.0), (1, 1 / 6), (2, 0.7), (3, 1.0), (4, None), (5, -0.1), (6, 1.1), (7, float("nan"))], "i int, s double")
    got = {r[0]: (r[1], r[2]) for r in df.select("i", scalars.category_label(F.col("s")), scalars.category_index(F.col("s"))).collect()}
    assert got == {0: ("Differentiated", 0), 1: ("Differentiated", 0), 2: ("Pluripotent", 4), 3: ("Totipotent", 5), 4: (None, -1), 5: (None, 0), 6: (None, -1), 7: (None, -1)}


def test_number_text_is_repr(spark):
    r = random.Random(3)
    values = [0.0, -0.0, 1.0, 0.1, 1e-4, 9.9e-5, 1e16, 1e15, 123456789.25, 5e-324, 1.7e308, -2.5e-9, float("inf"), float("-inf"), 1e7, 12345678.0, 0.001]
    values += [r.uniform(-1, 1) * 10 ** r.randint(-12, 20) for _ in range(300)]
    values += [x for x in (struct.unpack("<d", struct.pack("<Q", r.getrandbits(64)))[0] for _ in range(200)) if x == x]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x double")
    got = dict(rows.select("i", scalars.number_text(F.col("x"))).collect())
    assert {i: got[i] for i in got if got[i] != repr(values[i])} == {}
    assert spark.createDataFrame([(None,), (float("nan"),)], "x double").select(scalars.number_text(F.col("x"))).collect() == [("",), ("",)]


@pytest.mark.parametrize(("token", "value"), [("1.5", 1.5), ("-2", -2.0), ("+3.", 3.0), (".5\r", 0.5), ("1e-3", 1e-3), ("1d", None), (" 1", None), ("", None), (".", None), ("1.2.3", None), ("inf", float("inf"))])
def test_number_tokens(spark, token, value):
    assert spark.createDataFrame([(token,)], "t string").select(scalars.parsed_number(F.col("t"))).first()[0] == value


def test_softmax_order_and_argmax(spark):
    row = spark.createDataFrame([([0.0, 0.0, 1000.0, 1000.0, 0.0, 0.0],)], "z array<double>").select(scalars.softmax(F.col("z")).alias("p"))
    p, order, first = row.select("p", scalars.order_score(F.col("p")), scalars.first_largest(F.col("p"))).first()
    assert p == [0, 0, 0.5, 0.5, 0, 0] and order == pytest.approx(0.5) and first == 2


def test_settings():
    for bad in ({"species": "cat"}, {"seed": -1}, {"seed": 2**32}, {"max_cores": 0}, {"batch_size": 0}):
        with pytest.raises(ValueError):
            Settings(**bad)
    assert [usable_cores(*x) for x in ((None, 8), (3, 8), (99, 8), (1, 8))] == [8, 3, 8, 1]
