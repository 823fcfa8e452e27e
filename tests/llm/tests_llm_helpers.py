"""Plain versions that several tests share."""

import duckdb

from pairweave.llm.mixing import OP3_SQL


def near_duplicate_roots(texts, width):
    from test_neardup import brute

    ids = sorted(texts)
    return {i: ids[root] for i, (_, root, _) in zip(ids, brute([texts[i] for i in ids], width), strict=True)}


def mixed_counts(rows):
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    return {r[0]: r[4] // r[1] if r[1] else 0 for r in con.sql(f"SELECT doc_id, size, source_size, target, taken FROM ({OP3_SQL})").fetchall()}
