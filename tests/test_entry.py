"""The driver's contract: the flagship query and names that fit together."""

import hashlib

import __spark_entry__
from skein.operators import retrieve
from skein.sources.projection import star_graph


def test_entry_is_the_flagship_answer(spark):
    rows = __spark_entry__.entry(spark).orderBy("at").collect()
    text = "".join(r.line for r in rows)
    assert len(text.encode()) == 3878 and hashlib.md5(text.encode()).hexdigest() == "c374d8fe0a8753c6ba5fa9255afd68b0"


def test_a_small_budget(spark, sf):
    text = retrieve.answer(star_graph(spark, sf), "asia customer", 2, 300).first().text
    assert len(text.encode()) == 323 and hashlib.md5(text.encode()).hexdigest() == "41fea0f04e683ba79c305130a563e461"


def test_oracles_belong_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
