import __spark_entry__
from panelloom import registry


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert len(registry.queries()) >= 140


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 208
