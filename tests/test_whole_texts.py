"""Queries that compare texts compare the whole of them."""

import random

import pytest
from pagewright.functions import locate
from pagewright.plans import registry

SAME = "The same opening of a text, longer than any prefix once was, "


@pytest.fixture
def tables(spark, tmp_path):
    turns = [(1, 0, "user", SAME + "A"), (1, 1, "user", SAME + "B"), (1, 2, "user", SAME.replace("opening", "open-\ning") + "A"), (1, 3, "user", None), (2, 4, "user", SAME + "C"), (2, 5, "user", SAME.replace(" ", "\n") + "C")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    docs = [(0, SAME + "x"), (1, SAME + "y"), (2, SAME + "z"), (3, SAME + "Z")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_texts_with_one_opening_differ(spark, tables):
    rows = registry.recurrence_index(spark, tables).collect()
    assert sorted(r.ordinals for r in rows) == ["0,2", "4,5"]
    assert all(r.norm.endswith(("was, A", "was, C")) for r in rows)
    carried = {r.turn: r.carried for r in registry.carry_forward(spark, tables).collect()}
    assert carried == {0: False, 1: False, 2: True, 3: True, 4: False, 5: True}
    assert [tuple(r) for r in registry.heading_nth_match(spark, tables).collect()] == [(2, 3)]


def test_fast_normal_text_is_that_of_normal():
    r = random.Random(5)
    symbols = "ab1 - \n\r\t —’ﬁ­​\x00⑴－¨éé\x1c"
    for _ in range(20000):
        t = "".join(r.choices(symbols, k=r.randint(0, 12)))
        assert locate.normal_text(t) == locate.normal(t)[0], ascii(t)
