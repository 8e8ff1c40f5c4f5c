"""A stand-in for the request service: answers its parameters from a Parquet table, for trials without a network."""

from __future__ import annotations

#: Requests as the service has them, of an orders table.
ORDERS = """SELECT lpad(o_orderkey::VARCHAR, 12, '0') AS unique_key, o_orderdate AS created_date, NULL::TIMESTAMP AS closed_date, 'A' || o_custkey % 7 AS agency,
    NULL::VARCHAR AS agency_name, o_orderpriority AS complaint_type, CASE WHEN o_orderkey % 5 > 0 THEN 'd''' || o_orderkey % 3 END AS descriptor, o_orderstatus AS status,
    'BRONX' AS borough, lpad((o_custkey % 12 + 1)::VARCHAR, 2, '0') || ' BRONX' AS community_board, 'ONLINE' AS open_data_channel_type, 'private' AS address FROM '{path}'"""
#: The stand-in answers inside the process that asks, most often one of a task with one core: each thread more, and what is
#: read ahead for it, would hold row groups there, the more the larger the table, up to the machine's cores.
CONFIG = {"threads": 1, "async_threads": 0}


class TableService:
    """A transport; the service does what its parameters say, as a remote one would, and sends texts."""

    retried = (OSError,)

    def __init__(self, path: str, view: str = ORDERS) -> None:
        self.view = view.format(path=path)

    def __call__(self, params: dict[str, str]) -> list[dict]:
        import duckdb

        sql = f"SELECT {params.get('$select', '*')} FROM ({self.view})"
        for name, word in (("$where", "WHERE"), ("$group", "GROUP BY"), ("$order", "ORDER BY"), ("$limit", "LIMIT"), ("$offset", "OFFSET")):
            sql += f" {word} {params[name]}" if name in params else ""
        con = duckdb.connect(config=CONFIG)
        found = con.sql(sql)
        names = list(found.columns)
        return [{n: str(v) for n, v in zip(names, row, strict=True) if v is not None} for row in found.fetchall()]
