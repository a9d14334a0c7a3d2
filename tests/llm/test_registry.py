from rulelake.llm.queries import ORACLE_SQL, QUERIES


def test_ten_queries_and_plain_sql():
    assert [name.split("_")[0] for name in QUERIES] == [f"op{n}" for n in range(1, 11)]
    assert set(ORACLE_SQL) <= set(QUERIES) and all(isinstance(sql, str) for sql in ORACLE_SQL.values())
