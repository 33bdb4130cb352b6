"""What queries share: registration, rounding, the fixed target and candidates, and the common part of their SQL oracles."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import patches, search
from ..sources import grid

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Patch radius and target of the scalar grid; of the three-channel grid; candidates that second stages look at.
R, TX, TY = 4, 19, 110
R3, TX3, TY3 = 2, 7, 105
K = 20


def query(name: str, sql: str | None = None, common: bool = True):
    """Registers a query, and its oracle with those of the common tables before it that it names."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            # ordered as a whole: under a row limit, the database may wait for ever for a join that ends in the limit itself
            ORACLES[name] = f"SELECT * FROM (\n{with_tables(sql) if common else sql}\n) ORDER BY ALL"
        return f

    return add


def rd(c: Column | str, digits: int = 6) -> Column:
    """Rounded, and never a negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def target(px: DataFrame) -> DataFrame:
    return patches.target_values(px, TX, TY, R)


def scores(px: DataFrame) -> DataFrame:
    return patches.differences(px, target(px), R, patches.ssd(["v"]))


def scores3(px: DataFrame) -> DataFrame:
    return patches.differences(px, patches.target_values(px, TX3, TY3, R3), R3, patches.ssd(["c0", "c1", "c2"]))


def candidates(px: DataFrame, k: int = K) -> DataFrame:
    return search.top(scores(px), k, ["cy", "cx"])


def candidates3(px: DataFrame, k: int = K) -> DataFrame:
    return search.top(scores3(px), k, ["cy", "cx"])


def grid_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.pixels(spark, sf_dir)


#: Tables that several SQL oracles name, each in terms of those before it.
TABLES = {
    "px": """(SELECT i - 1 AS x, vec_id AS y, CAST(embedding[i] AS DOUBLE) AS v, (i - 1 BETWEEN 20 AND 29 AND vec_id BETWEEN 100 AND 119) AS hole FROM embeddings, generate_series(1, 64) g(i))""",
    "o4": """(SELECT a.i AS dx, b.i AS dy FROM generate_series(-4, 4) a(i), generate_series(-4, 4) b(i))""",
    "o1": """(SELECT dx, dy FROM o4 WHERE abs(dx) <= 1 AND abs(dy) <= 1)""",
    "ext": """(SELECT max(y) AS my FROM px)""",
    "src": """(SELECT x AS cx, y AS cy FROM px, ext WHERE x BETWEEN 4 AND 59 AND y BETWEEN 4 AND my - 4 AND NOT (x + 4 >= 20 AND x - 4 <= 29 AND y + 4 >= 100 AND y - 4 <= 119))""",
    "tp": """(SELECT x - 19 AS dx, y - 110 AS dy, v, hole FROM px WHERE x BETWEEN 15 AND 23 AND y BETWEEN 106 AND 114)""",
    "sc": """(SELECT cx, cy, avg((p.v - t.v) * (p.v - t.v)) AS d, avg(abs(p.v - t.v)) AS a, count(*) AS n FROM src, tp t, px p WHERE NOT t.hole AND p.x = cx + dx AND p.y = cy + dy GROUP BY cx, cy)""",
    "top": """(SELECT *, row_number() OVER (ORDER BY d, cy, cx) AS rn FROM sc QUALIFY rn <= 20)""",
    "co": """(SELECT cx, cy, rn, d, dx, dy, t.hole AS thole, t.v AS tv, p.v AS sv FROM top, tp t, px p WHERE p.x = cx + dx AND p.y = cy + dy)""",
    "p3": """(SELECT i AS x, vec_id AS y, CAST(embedding[3 * i + 1] AS DOUBLE) AS c0, CAST(embedding[3 * i + 2] AS DOUBLE) AS c1, CAST(embedding[3 * i + 3] AS DOUBLE) AS c2, (i BETWEEN 8 AND 11 AND vec_id BETWEEN 100 AND 109) AS hole FROM embeddings, generate_series(0, 20) g(i))""",
    "s3": """(SELECT x AS cx, y AS cy FROM p3, ext WHERE x BETWEEN 2 AND 18 AND y BETWEEN 2 AND my - 2 AND NOT (x + 2 >= 8 AND x - 2 <= 11 AND y + 2 >= 100 AND y - 2 <= 109))""",
    "t3": """(SELECT x - 7 AS dx, y - 105 AS dy, c0, c1, c2, hole FROM p3 WHERE x BETWEEN 5 AND 9 AND y BETWEEN 103 AND 107)""",
    "sc3": """(SELECT cx, cy, avg((p.c0 - t.c0) ** 2 + (p.c1 - t.c1) ** 2 + (p.c2 - t.c2) ** 2) AS d FROM s3, t3 t, p3 p WHERE NOT t.hole AND p.x = cx + dx AND p.y = cy + dy GROUP BY cx, cy)""",
    "top3": """(SELECT *, row_number() OVER (ORDER BY d, cy, cx) AS rn FROM sc3 QUALIFY rn <= 20)""",
    "ab": """(SELECT a.vec_id AS id, CAST(a.embedding AS DOUBLE[]) AS a, CAST(b.embedding AS DOUBLE[]) AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)""",
}


def with_tables(sql: str) -> str:
    """An oracle's SQL, which begins with `SELECT` or with `, name AS (...)`, after those of TABLES that it names, themselves or through others."""
    need: set[str] = set()
    for name, body in reversed(TABLES.items()):
        if re.search(rf"\b{name}\b", sql) or any(re.search(rf"\b{name}\b", TABLES[n]) for n in need):
            need.add(name)
    first = ", ".join(f"{n} AS NOT MATERIALIZED {b}" for n, b in TABLES.items() if n in need)
    return f"WITH RECURSIVE {first}\n{sql}" if first else f"WITH RECURSIVE {sql[1:]}" if sql.startswith(",") else sql
