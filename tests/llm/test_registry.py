import re

from umbra.llm import registry


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in registry.QUERIES) == list(range(1, 14))
    assert set(registry.SQL) <= set(registry.QUERIES)
