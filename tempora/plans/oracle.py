"""SQL counterpart of each registered query.

The queries use window and sweep kernels; the SQL here takes another road.
Period results are formed by listing days, doing ordinary set algebra on them,
and numbering consecutive days into islands.  Only the row-wise tables at the
bottom of ``BASE`` are shared by both sides.
"""

from __future__ import annotations

from tempora.plans.statements import CATEGORY_TOTALS, ITEM_TOTALS
from tempora.sources import derived

BRAND, PRICE, MORE_THAN = derived.BRAND, derived.PRICE, derived.MORE_THAN
OPEN_END, EPOCH = derived.OPEN_END, derived.EPOCH

BASE = {
    "ev": """
        SELECT l_partkey AS item_id, CAST(l_shipdate AS DATE) AS day,
               MIN(l_suppkey) AS cat_id, MIN(l_linenumber) AS brand_id,
               MIN(CAST(l_extendedprice AS DECIMAL(12,2))) AS price, MIN(l_returnflag) AS flag
        FROM lineitem GROUP BY 1, 2""",
    "versions": f"""
        SELECT item_id, day AS from_d, nxt AS to_d, cat_id, brand_id, price
        FROM (SELECT *, COALESCE(LEAD(day) OVER (PARTITION BY item_id ORDER BY day),
                                 DATE '{OPEN_END}') AS nxt FROM ev)
        WHERE flag <> 'R'""",
    "scd": """
        SELECT *, item_id * 100000 + n AS item_sk,
               concat('item ', item_id, ' v', n) AS item_desc,
               concat('brand ', brand_id) AS brand,
               concat('category ', cat_id) AS category
        FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY from_d) AS n
              FROM versions)""",
    "sales": f"""
        SELECT l_partkey AS item_id, d AS sold_d, CAST(l_extendedprice AS DECIMAL(12,2)) AS net_paid
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        JOIN calendar ON date_sk = CAST(CAST(o_orderdate AS DATE) - DATE '{EPOCH}' AS INTEGER)""",
    "sales_keys": f"""
        SELECT l_partkey * 100000 + 1 + l_orderkey % 30 AS item_sk,
               CAST(CAST(o_orderdate AS DATE) - DATE '{EPOCH}' AS INTEGER) AS date_sk,
               l_orderkey AS ticket, l_linenumber AS line, l_partkey AS part,
               CAST(l_extendedprice AS DECIMAL(12,2)) AS net_paid
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "calendar": f"""
        SELECT CAST(x - DATE '{EPOCH}' AS INTEGER) AS date_sk, x AS d
        FROM (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS x
              FROM (SELECT LEAST((SELECT MIN(o_orderdate) FROM orders),
                                 (SELECT MIN(l_shipdate) FROM lineitem)) AS lo,
                           GREATEST((SELECT MAX(o_orderdate) FROM orders),
                                    (SELECT MAX(l_shipdate) FROM lineitem)) AS hi))""",
    "runlog": f"""
        SELECT event_type AS query_id, CAST(1 + event_id % 6 AS INTEGER) AS run_id,
               ts AS start_time, CAST(value AS DECIMAL(12,2)) AS seconds,
               CASE WHEN user_id % 2 = 0 THEN 'algebra' ELSE 'olap' END AS side,
               CAST(event_id % 7 AS DOUBLE) AS planning_ms,
               CAST(CAST(value AS DECIMAL(12,2)) AS DOUBLE) AS execution_ms,
               CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS number_rows
        FROM events
        WHERE NOT (user_id % 2 = 0 AND event_type = '{derived.LOG_ONLY_OLAP}')""",
}

# Tables a base table is built from.
NEEDS = {"versions": ["ev"], "scd": ["ev", "versions"], "sales": ["calendar"]}


def coarse(sql: str) -> str:
    """Suppliers as items, line numbers as their categories."""
    sql = sql.replace("MIN(l_suppkey) AS cat_id", "MIN(l_linenumber) AS cat_id")
    return sql.replace("l_partkey AS item_id", "l_suppkey AS item_id")


def days(rows: str, keys: str) -> str:
    """Every day of every period."""
    return (
        f"SELECT {keys}, CAST(unnest(generate_series(from_d, to_d - 1, INTERVAL 1 DAY)) AS DATE)"
        f" AS d FROM ({rows}) WHERE from_d < to_d"
    )


def islands(day_rows: str, keys: str) -> str:
    """Runs of consecutive days."""
    return f"""
        SELECT {keys}, MIN(d) AS from_d, MAX(d) + 1 AS to_d
        FROM (SELECT {keys}, d, d - CAST(ROW_NUMBER() OVER (PARTITION BY {keys} ORDER BY d)
                     AS INTEGER) AS run
              FROM (SELECT DISTINCT {keys}, d FROM ({day_rows})))
        GROUP BY {keys}, run"""


def text_set(periods: str, keys: str) -> str:
    """Periods of a key as one text."""
    return f"""
        SELECT {keys}, concat('{{', string_agg(concat('[', CAST(from_d AS VARCHAR), ', ',
               CAST(to_d AS VARCHAR), ')'), ', ' ORDER BY from_d), '}}') AS vt
        FROM ({periods}) GROUP BY {keys}"""


def with_(body: str, *tables: str, **extra: str) -> str:
    """Prefix the base tables that are used, and further named ones."""
    names: list[str] = []
    for t in tables:
        names += [n for n in NEEDS.get(t, []) + [t] if n not in names]
    ctes = [f"{n} AS ({BASE[n]})" for n in names] + [f"{n} AS ({q})" for n, q in extra.items()]
    return f"WITH {', '.join(ctes)} {body}"


V = "SELECT * FROM versions"
IS_BRAND = f"SELECT * FROM versions WHERE brand_id = {BRAND}"
IS_DEAR = f"SELECT * FROM versions WHERE price > {PRICE}"

B_DAYS, P_DAYS = days(IS_BRAND, "item_id"), days(IS_DEAR, "item_id")
ATTR = {
    "item_brand": islands(days(V, "item_id, brand_id"), "item_id, brand_id"),
    "item_category": islands(days(V, "item_id, cat_id"), "item_id, cat_id"),
    "item_price": islands(days(V, "item_id, price"), "item_id, price"),
}

SELECTION = islands(B_DAYS, "item_id")
PROJECTION = islands(days(V, "item_id"), "item_id")
JOIN = islands(f"{B_DAYS} INTERSECT {P_DAYS}", "item_id")
UNION = islands(f"{B_DAYS} UNION {P_DAYS}", "item_id")
DIFF_ALL = islands(f"{B_DAYS} EXCEPT {P_DAYS}", "item_id")
DIFF = f"SELECT * FROM ({DIFF_ALL}) WHERE item_id IN (SELECT item_id FROM ({IS_DEAR}))"

# A day of the brand stays unless each of the item's dear prices covers it.
DIFF_PAIRWISE = islands(
    f"""
    SELECT b.item_id, b.d
    FROM (SELECT DISTINCT * FROM ({B_DAYS})) b
    JOIN (SELECT item_id, COUNT(DISTINCT price) AS n FROM ({IS_DEAR}) GROUP BY item_id) t
      ON b.item_id = t.item_id
    LEFT JOIN (SELECT item_id, d, COUNT(DISTINCT price) AS c
               FROM ({days(IS_DEAR, "item_id, price")}) GROUP BY item_id, d) x
      ON b.item_id = x.item_id AND b.d = x.d
    WHERE COALESCE(x.c, 0) < t.n""",
    "item_id",
)


def _cases(guarded: bool) -> str:
    """Three unclipped cases, by nearest starts and ends of dear periods."""
    at_start = at_end = "TRUE"
    if guarded:
        at_start = """b.item_id || ':' || b.from_d NOT IN (
            SELECT b.item_id || ':' || b.from_d FROM bp b JOIN pp p
            ON p.item_id = b.item_id AND p.from_d <= b.from_d AND p.to_d > b.from_d)"""
        at_end = """b.item_id || ':' || b.to_d NOT IN (
            SELECT b.item_id || ':' || b.to_d FROM bp b JOIN pp p
            ON p.item_id = b.item_id AND p.from_d < b.to_d AND p.to_d >= b.to_d)"""
    rows = f"""
        SELECT b.item_id, b.from_d, MIN(p.from_d) AS to_d
        FROM bp b JOIN pp p ON p.item_id = b.item_id AND p.from_d > b.from_d
        WHERE {at_start} GROUP BY b.item_id, b.from_d
        UNION ALL
        SELECT b.item_id, MAX(p.to_d) AS from_d, b.to_d
        FROM bp b JOIN pp p ON p.item_id = b.item_id AND p.to_d < b.to_d
        WHERE {at_end} GROUP BY b.item_id, b.to_d
        UNION ALL
        SELECT a.item_id, a.to_d AS from_d, MIN(z.from_d) AS to_d
        FROM pp a JOIN pp z ON a.item_id = z.item_id AND z.from_d > a.to_d
        WHERE a.item_id IN (SELECT item_id FROM bp)
        GROUP BY a.item_id, a.to_d"""
    return islands(days(rows, "item_id"), "item_id")


CASES_TABLES = {"bp": SELECTION, "pp": islands(P_DAYS, "item_id")}
CASES, CASES_GUARDED = _cases(False), _cases(True)


def _busy(at_least: int) -> str:
    """Days on which a category has so many items."""
    return islands(
        f"""SELECT cat_id, d FROM ({days(V, "item_id, cat_id")})
            GROUP BY cat_id, d HAVING COUNT(DISTINCT item_id) >= {at_least}""",
        "cat_id",
    )


MORE, AT_LEAST = _busy(MORE_THAN + 1), _busy(MORE_THAN)

# Islands of the whole table, given to keys that start and end with them.
GLOBAL = """
    SELECT from_d, to_d FROM (
        SELECT MIN(d) AS from_d, MAX(d) + 1 AS to_d FROM (
            SELECT d, d - CAST(ROW_NUMBER() OVER (ORDER BY d) AS INTEGER) AS run FROM (
                SELECT DISTINCT CAST(unnest(generate_series(from_d, to_d - 1, INTERVAL 1 DAY))
                       AS DATE) AS d
                FROM versions WHERE from_d < to_d))
        GROUP BY run)"""


def _blocks(keys: str) -> str:
    same = " AND ".join(f"v.{k.strip()} = e.{k.strip()}" for k in keys.split(","))
    mine = ", ".join(f"v.{k.strip()}" for k in keys.split(","))
    return f"""
        SELECT DISTINCT {mine}, g.from_d, g.to_d
        FROM ({GLOBAL}) g
        JOIN (SELECT DISTINCT {keys}, from_d FROM versions) v ON v.from_d = g.from_d
        JOIN (SELECT DISTINCT {keys}, to_d FROM versions) e ON e.to_d = g.to_d AND {same}"""


BLOCKS_BUSY = islands(
    f"""SELECT cat_id, d FROM ({days(_blocks("item_id, cat_id"), "item_id, cat_id")})
        GROUP BY cat_id, d HAVING COUNT(DISTINCT item_id) >= {derived.COARSE_MORE_THAN}""",
    "cat_id",
)

DESIGNS = ("ss", "tdw", "scd")
RELATIONS = {
    **{f"a1_selection_{d}": SELECTION for d in DESIGNS},
    **{f"a2_projection_{d}": PROJECTION for d in DESIGNS},
    **{f"a3_join_{d}": JOIN for d in DESIGNS},
    **{f"a4_union_{d}": UNION for d in DESIGNS},
    "a5_difference": DIFF,
    "a5_difference_all": DIFF_ALL,
    "a5_difference_ss": DIFF_PAIRWISE,
    "a5_difference_tdw": CASES,
    "a5_difference_scd": CASES_GUARDED,
    "a6_aggregation": MORE,
    "a6_aggregation_ss": MORE,
    "a6_aggregation_tdw": AT_LEAST,
}


def _relations(bodies: dict[str, str]) -> str:
    """Rows of all relations, each under its name; the selection of sets is not coalesced."""

    def rows(name: str, body: str) -> str:
        if name == "a1_selection_ss":
            body = f"SELECT * FROM ({ATTR['item_brand']}) WHERE brand_id = {BRAND}"
        key = "cat_id" if name.startswith("a6") else "item_id"
        return f"SELECT '{name}' AS relation, {key} AS id, from_d, to_d FROM ({body})"

    return " UNION ALL ".join(rows(name, body) for name, body in bodies.items())


COUNT_PER_DAY = f"""
    SELECT cat_id, d, COUNT(DISTINCT item_id) AS n FROM ({days(V, "item_id, cat_id")})
    GROUP BY cat_id, d"""

MONEY = "CAST(SUM(net_paid) AS DECIMAL(18,2)) AS total_sales"


def _rows_total(periods: str) -> str:
    return f"""
        SELECT q.item_id, q.from_d, q.to_d, {MONEY}
        FROM ({periods}) q JOIN sales s
          ON s.item_id = q.item_id AND s.sold_d >= q.from_d AND s.sold_d < q.to_d
        GROUP BY ALL"""


def _set_total(periods: str, day_test: bool = True) -> str:
    on = "s.item_id = q.item_id"
    if day_test:
        on += " AND s.sold_d >= q.from_d AND s.sold_d < q.to_d"
    sums = f"""
        SELECT item_id, CAST(SUM(net_paid) AS DECIMAL(18,2)) AS total_sales FROM (
            SELECT DISTINCT s.* FROM
                (SELECT ROW_NUMBER() OVER () AS r, * FROM sales) s JOIN ({periods}) q ON {on})
        GROUP BY item_id"""
    return f"""
        SELECT t.item_id, t.vt, a.total_sales
        FROM ({text_set(periods, "item_id")}) t JOIN ({sums}) a ON t.item_id = a.item_id"""


def _category_total(q: str, intended: bool) -> str:
    day = "s.sold_d >= q.from_d AND s.sold_d < q.to_d"
    group = "q.cat_id, ic.from_d, ic.to_d, q.from_d, q.to_d"
    if intended:
        day += " AND s.sold_d >= ic.from_d AND s.sold_d < ic.to_d"
        group = "q.cat_id, GREATEST(ic.from_d, q.from_d), LEAST(ic.to_d, q.to_d)"
    return f"""
        SELECT q.cat_id, GREATEST(ic.from_d, q.from_d) AS from_d,
               LEAST(ic.to_d, q.to_d) AS to_d, {MONEY}
        FROM ({q}) q
        JOIN ({ATTR["item_category"]}) ic
          ON ic.cat_id = q.cat_id AND ic.from_d < q.to_d AND q.from_d < ic.to_d
        JOIN (SELECT item_id, sold_d, SUM(net_paid) AS net_paid FROM sales GROUP BY ALL) s
          ON s.item_id = ic.item_id AND {day}
        GROUP BY {group}"""


# Common days of an item's set and its category's set, as text; and the sales
# of the item on any day of the category's set.
CATEGORY_SETS = f"""
    SELECT t.cat_id, t.vt, CAST(SUM(a.paid) AS DECIMAL(18,2)) AS total_sales
    FROM ({text_set(islands(
        f'''SELECT i.item_id, i.cat_id, i.d FROM ({days(V, "item_id, cat_id")}) i
            JOIN ({days(MORE, "cat_id")}) c ON i.cat_id = c.cat_id AND i.d = c.d''',
        "item_id, cat_id"), "item_id, cat_id")}) t
    JOIN (SELECT s.item_id, c.cat_id, SUM(s.net_paid) AS paid
          FROM sales s JOIN ({days(MORE, "cat_id")}) c ON s.sold_d = c.d
          JOIN (SELECT DISTINCT item_id, cat_id FROM versions) m
            ON m.item_id = s.item_id AND m.cat_id = c.cat_id
          GROUP BY s.item_id, c.cat_id) a
      ON a.item_id = t.item_id AND a.cat_id = t.cat_id
    GROUP BY t.cat_id, t.vt"""


def _newest(key: str, name: str, first: str) -> str:
    """Name of the row of a key that no other row of the key precedes."""
    return f"""
        SELECT {key}, {name} FROM scd s WHERE NOT EXISTS (
            SELECT 1 FROM scd o WHERE o.{key} = s.{key} AND {first})"""


ITEM = _newest("item_id", "item_desc", "o.from_d > s.from_d")
# The smallest item id of the key, and the newest of its versions there.
_REP = """
    SELECT s.{key}, s.{name} FROM scd s
    JOIN (SELECT {key}, MIN(item_id) AS item_id FROM scd GROUP BY {key}) i
      ON s.{key} = i.{key} AND s.item_id = i.item_id
    JOIN (SELECT {key}, item_id, MAX(from_d) AS from_d FROM scd GROUP BY {key}, item_id) d
      ON d.{key} = s.{key} AND d.item_id = s.item_id AND d.from_d = s.from_d"""
BRANDS = _REP.format(key="brand_id", name="brand")
CATEGORIES = _REP.format(key="cat_id", name="category")


def _life(key: str) -> str:
    return islands(days(V, key), key)


def _unique(table: str, source: str, cols: str) -> str:
    return f"""
        SELECT '{table}' AS table_name, '{cols}' AS key_columns, COUNT(*) AS repeated_keys,
               CAST(COALESCE(SUM(n - 1), 0) AS BIGINT) AS surplus_rows
        FROM (SELECT COUNT(*) AS n FROM ({source}) GROUP BY {cols} HAVING COUNT(*) > 1)"""


def _fk(name: str, child: str, fk: str, parent: str, pk: str) -> str:
    return f"""
        SELECT '{name}' AS reference, COUNT(DISTINCT {fk}) AS orphan_keys,
               COUNT(*) AS orphan_rows
        FROM ({child}) c
        WHERE {fk} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ({parent}) p WHERE p.{pk} = c.{fk})"""


def _nulls(table: str, source: str, cols: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{table}' AS table_name, '{c}' AS column_name,
                   CAST(COUNT(*) - COUNT({c}) AS BIGINT) AS nulls FROM ({source})"""
        for c in cols
    )


SCD, FACTS, CAL = "SELECT * FROM scd", "SELECT * FROM sales_keys", "SELECT * FROM calendar"
DENORM = """
    SELECT f.* EXCLUDE (part), v.item_id FROM sales_keys f LEFT JOIN (SELECT item_sk, item_id FROM scd) v
    ON f.item_sk = v.item_sk"""

ATTR_SS = {
    "item_category": text_set(ATTR["item_category"], "item_id, cat_id"),
    "item_brand": text_set(ATTR["item_brand"], "item_id, brand_id"),
    "item_price": text_set(ATTR["item_price"], "item_id, price"),
}
CHK_UNIQUE = " UNION ALL ".join(
    [
        _unique("scd_item", SCD, "item_sk"),
        _unique("scd_item", SCD, "item_id, from_d"),
        _unique("item", ITEM, "item_id"),
        _unique("item_ss", text_set(PROJECTION, "item_id"), "item_id"),
        _unique("brand_ss", text_set(_life("brand_id"), "brand_id"), "brand_id"),
        _unique("category_ss", text_set(_life("cat_id"), "cat_id"), "cat_id"),
        _unique("item_ls", PROJECTION, "item_id, from_d"),
        _unique("brand", BRANDS, "brand_id"),
        _unique("category", CATEGORIES, "cat_id"),
        _unique("item_category", ATTR["item_category"], "item_id, cat_id, from_d"),
        _unique("item_brand", ATTR["item_brand"], "item_id, brand_id, from_d"),
        _unique("item_price", ATTR["item_price"], "item_id, price, from_d, to_d"),
        _unique("item_category_ss", text_set(ATTR["item_category"], "item_id, cat_id"), "item_id, cat_id"),
        _unique("item_brand_ss", text_set(ATTR["item_brand"], "item_id, brand_id"), "item_id, brand_id"),
        _unique("item_price_ss", text_set(ATTR["item_price"], "item_id, price"), "item_id, price"),
        _unique("date_dim", CAL, "date_sk"),
        _unique("store_sales", FACTS, "item_sk, date_sk, ticket"),
        _unique("lines", FACTS, "ticket, line"),
    ]
)
CHK_FK = " UNION ALL ".join(
    [
        _fk("item_ls -> item", PROJECTION, "item_id", ITEM, "item_id"),
        _fk("item_category -> item", ATTR["item_category"], "item_id", ITEM, "item_id"),
        _fk("item_category -> category", ATTR["item_category"], "cat_id", CATEGORIES, "cat_id"),
        _fk("item_brand -> item", ATTR["item_brand"], "item_id", ITEM, "item_id"),
        _fk("item_brand -> brand", ATTR["item_brand"], "brand_id", BRANDS, "brand_id"),
        _fk("item_price -> item", ATTR["item_price"], "item_id", ITEM, "item_id"),
        _fk("store_sales -> date_dim", FACTS, "date_sk", CAL, "date_sk"),
        _fk("store_sales -> scd_item", FACTS, "item_sk", SCD, "item_sk"),
        _fk("store_sales -> item", FACTS, "part", ITEM, "item_id"),
        _fk("item_category_ss -> item_ss", ATTR_SS["item_category"], "item_id", ITEM, "item_id"),
        _fk("item_category_ss -> category_ss", ATTR_SS["item_category"], "cat_id", CATEGORIES, "cat_id"),
        _fk("item_brand_ss -> item_ss", ATTR_SS["item_brand"], "item_id", ITEM, "item_id"),
        _fk("item_brand_ss -> brand_ss", ATTR_SS["item_brand"], "brand_id", BRANDS, "brand_id"),
        _fk("item_price_ss -> item", ATTR_SS["item_price"], "item_id", ITEM, "item_id"),
    ]
)
CHK_NOT_NULL = " UNION ALL ".join(
    [
        _nulls("scd_item", SCD, ["item_sk", "item_id"]),
        _nulls("item", ITEM, ["item_id"]),
        _nulls("item_ss", ITEM, ["item_id"]),
        _nulls("brand", BRANDS, ["brand_id"]),
        _nulls("brand_ss", BRANDS, ["brand_id"]),
        _nulls("category", CATEGORIES, ["cat_id"]),
        _nulls("category_ss", CATEGORIES, ["cat_id"]),
        _nulls("item_category_ss", ATTR_SS["item_category"], ["item_id", "cat_id"]),
        _nulls("item_brand_ss", ATTR_SS["item_brand"], ["item_id", "brand_id"]),
        _nulls("item_price_ss", ATTR_SS["item_price"], ["item_id", "price"]),
        _nulls("date_dim", "SELECT date_sk, lpad(CAST(date_sk AS VARCHAR), 16, '0') AS d_date_id FROM calendar", ["date_sk", "d_date_id"]),
        _nulls("item_ls", PROJECTION, ["item_id", "from_d", "to_d"]),
        _nulls("item_category", ATTR["item_category"], ["item_id", "cat_id", "from_d"]),
        _nulls("item_brand", ATTR["item_brand"], ["item_id", "brand_id", "from_d"]),
        _nulls("item_price", ATTR["item_price"], ["item_id", "price", "from_d", "to_d"]),
        _nulls("store_sales", DENORM, ["date_sk", "ticket", "item_id"]),
    ]
)

TABLES = {
    "store_sales": "SELECT * FROM sales",
    "date_dim": CAL,
    "scd_item": SCD,
    "item": ITEM,
    "item_ls": PROJECTION,
    "item_price": ATTR["item_price"],
    "brand": BRANDS,
    "category": CATEGORIES,
    "item_brand": ATTR["item_brand"],
    "item_category": ATTR["item_category"],
    "item_ss": "SELECT DISTINCT item_id FROM versions",
    "item_price_ss": "SELECT DISTINCT item_id, price FROM versions",
    "brand_ss": "SELECT DISTINCT brand_id FROM versions",
    "category_ss": "SELECT DISTINCT cat_id FROM versions",
    "item_brand_ss": "SELECT DISTINCT item_id, brand_id FROM versions",
    "item_category_ss": "SELECT DISTINCT item_id, cat_id FROM versions",
}
PROFILE = " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, COUNT(*) AS rows FROM ({q})" for name, q in TABLES.items()
)

PRETTY_SIZE = f"""
    SELECT DISTINCT n, CASE WHEN n < 10240 THEN n || ' bytes'
           {" ".join(
               f"WHEN n < 10239.5 * power(1024, {k}) THEN CAST(floor(n / power(1024, {k}) + 0.5) AS BIGINT) || ' {u}'"
               for k, u in enumerate(("kB", "MB", "GB", "TB"), 1)
           )} END AS size
    FROM (SELECT CAST(l_orderkey AS BIGINT) * CAST(power(32, l_linenumber - 1) AS BIGINT) AS n FROM lineitem)"""

# Starts no row reaches, ends no row passes; each start takes its nearest end.
ANTIJOIN = """
    SELECT s.item_id, s.from_d, MIN(e.to_d) AS to_d
    FROM (SELECT DISTINCT item_id, from_d FROM versions a WHERE NOT EXISTS (
              SELECT 1 FROM versions o WHERE o.item_id = a.item_id
              AND o.from_d < a.from_d AND o.to_d >= a.from_d)) s
    JOIN (SELECT DISTINCT item_id, to_d FROM versions a WHERE NOT EXISTS (
              SELECT 1 FROM versions o WHERE o.item_id = a.item_id
              AND o.from_d <= a.to_d AND o.to_d > a.to_d)) e
      ON e.item_id = s.item_id AND e.to_d > s.from_d
    GROUP BY s.item_id, s.from_d"""

STAR = f"""
    SELECT q.item_id, q.from_d, q.to_d, {MONEY}
    FROM ({SELECTION}) q JOIN ({DENORM}) f ON f.item_id = q.item_id
    JOIN calendar c ON c.date_sk = f.date_sk AND c.d >= q.from_d AND c.d < q.to_d
    GROUP BY ALL"""


def _mean(where: str) -> str:
    return f"""
        SELECT query_id, CAST(ROUND(SUM(seconds) / COUNT(seconds), 6) AS DECIMAL(17,6)) AS m
        FROM runlog WHERE {where} GROUP BY query_id"""


def _sums(side: str) -> str:
    return f"""
        SELECT query_id, run_id, CAST(SUM(seconds) AS DECIMAL(18,2)) AS s
        FROM runlog WHERE side = '{side}' GROUP BY ALL"""


ONLY_OLAP = """side = 'olap' AND query_id NOT IN (
    SELECT query_id FROM runlog WHERE side = 'algebra')"""
REP_FULL = f"""
    SELECT a.query_id, a.m AS algebra, o.m AS olap
    FROM ({_mean("side = 'algebra'")}) a LEFT JOIN ({_mean("side = 'olap'")}) o
      ON a.query_id = o.query_id
    UNION ALL
    SELECT query_id, NULL, m FROM ({_mean(ONLY_OLAP)})
    UNION ALL
    SELECT NULL, NULL, CAST(ROUND(SUM(seconds) / COUNT(seconds), 6) AS DECIMAL(17,6))
    FROM runlog WHERE {ONLY_OLAP} HAVING COUNT(*) > 0"""


def oracle_sql() -> dict[str, str]:
    def v(body: str, **extra: str) -> str:
        return with_(body, "versions", **extra)

    def vs(body: str, **extra: str) -> str:
        return with_(body, "versions", "sales", **extra)

    all_tables = ("scd", "sales", "sales_keys", "calendar")
    out = {
        "src_scd_item_csv": with_(
            """SELECT item_sk, CAST(item_id AS VARCHAR) AS item_id, from_d, to_d,
                      item_desc || '  ' AS item_desc, price, brand_id, brand, cat_id, category FROM scd""",
            "scd",
        ),
        "src_date_dim_csv": with_(
            """SELECT date_sk AS d_date_sk, lpad(CAST(date_sk AS VARCHAR), 16, '0') AS d_date_id,
                      d AS d_date, CAST(year(d) AS INTEGER) AS d_year,
                      CAST(month(d) AS INTEGER) AS d_moy, CAST(day(d) AS INTEGER) AS d_dom,
                      CAST(NULL AS VARCHAR) AS d_holiday FROM calendar""",
            "calendar",
        ),
        "src_store_sales_csv": with_(
            """SELECT item_sk AS ss_item_sk, date_sk AS ss_sold_date_sk,
                      ticket AS ss_ticket_number, line AS ss_quantity,
                      net_paid AS ss_net_paid, CAST(NULL AS INTEGER) AS ss_store_sk
               FROM sales_keys""",
            "sales_keys",
        ),
        "src_bad_fields": with_(
            """SELECT 'ss_sold_date_sk' AS column_name, 'soon' AS value, 'not int' AS problem, COUNT(*) AS n_rows
               FROM sales_keys WHERE ticket % 97 = 5 HAVING COUNT(*) > 0
               UNION ALL SELECT 'ss_quantity', '7x', 'not int', COUNT(*) FROM sales_keys WHERE line = 7 HAVING COUNT(*) > 0""",
            "sales_keys",
        ),
        "src_multi_line_csv": with_(
            """SELECT item_sk AS i_item_sk, 'say "' || item_desc || '",' || chr(10) || brand AS i_item_desc,
                      price AS i_current_price, category AS i_category FROM scd""",
            "scd",
        ),
        "src_bad_records": with_(
            """SELECT 'i_current_price' AS column_name, 'dear' AS value, 'not decimal(12,2)' AS problem,
                      CAST(0 AS BIGINT) AS odd_line, COUNT(*) AS n_rows
               FROM scd WHERE item_sk % 50 = 7 HAVING COUNT(*) > 0""",
            "scd",
        ),
        "load_scaled": v(f"SELECT * REPLACE (CAST(item_id AS VARCHAR) AS item_id) FROM ({ATTR['item_brand']})"),
        "load_profile": with_(PROFILE, *all_tables),
        "sink_replace": v(ATTR["item_brand"]),
        "sink_append": with_(
            """SELECT query_id, run_id, COUNT(*) AS n, CAST(SUM(number_rows) AS BIGINT) AS number_rows
               FROM runlog GROUP BY query_id, run_id""",
            "runlog",
        ),
        "view_sql": v(
            f"""SELECT item_id, COUNT(*) AS n_periods,
                       CAST(SUM(to_d - from_d) AS BIGINT) AS n_days
                FROM ({PROJECTION}) WHERE item_id IN (SELECT item_id FROM ({IS_BRAND}))
                GROUP BY item_id"""
        ),
        "views_stored": v(_relations(RELATIONS), **CASES_TABLES),
        "views_stored_coarse": coarse(v(_relations({"a6_aggregation_scd": BLOCKS_BUSY}))),
        "hist_item": with_(ITEM, "scd"),
        "hist_item_vt": v(text_set(PROJECTION, "item_id")),
        "hist_tdw_item": with_(ITEM, "scd"),
        "hist_item_ls": v(PROJECTION),
        "hist_brand": with_(BRANDS, "scd"),
        "hist_brand_vt": v(text_set(_life("brand_id"), "brand_id")),
        "hist_tdw_brand": with_(BRANDS, "scd"),
        "hist_category": with_(CATEGORIES, "scd"),
        "hist_category_vt": v(text_set(_life("cat_id"), "cat_id")),
        "hist_tdw_category": with_(CATEGORIES, "scd"),
        "dim_calendar": with_("SELECT date_sk, d, d AS from_d, d + 1 AS to_d FROM calendar", "calendar"),
        "fact_denorm": with_(DENORM, "scd", "sales_keys"),
        "fact_denorm_shuffled": with_(DENORM, "scd", "sales_keys"),
        "chk_unique": with_(CHK_UNIQUE, *all_tables),
        "chk_fk": with_(CHK_FK, *all_tables),
        "chk_not_null": with_(CHK_NOT_NULL, *all_tables),
        "span_days": v(
            """SELECT item_id, from_d AS lo, to_d AS hi, from_d AS day_lo, from_d + 1 AS day_hi
               FROM versions"""
        ),
        "coalesce": v(_life("cat_id")),
        "coalesce_antijoin": v(ANTIJOIN),
        "unpack": v(ATTR["item_brand"]),
        "pack": v(text_set(PROJECTION, "item_id")),
        "intersect": v(
            text_set(
                islands(
                    f"""SELECT p.item_id, p.price, p.d FROM ({days(IS_DEAR, "item_id, price")}) p
                        JOIN ({B_DAYS}) b ON b.item_id = p.item_id AND b.d = p.d""",
                    "item_id, price",
                ),
                "item_id, price",
            )
        ),
        "overlaps": v(
            f"""SELECT DISTINCT b.item_id, b.brand_id, c.cat_id
                FROM ({days(V, "item_id, brand_id")}) b JOIN ({days(V, "item_id, cat_id")}) c
                  ON b.item_id = c.item_id AND b.d = c.d"""
        ),
        "spans_union": v(text_set(UNION, "item_id")),
        "spans_minus": v(text_set(DIFF_ALL, "item_id")),
        "difference": v(islands(f"{P_DAYS} EXCEPT {B_DAYS}", "item_id")),
        "contains_day": vs(
            f"""SELECT b.brand_id, COUNT(*) AS n_sales, {MONEY}
                FROM sales s JOIN ({days(V, "item_id, brand_id")}) b
                  ON s.item_id = b.item_id AND s.sold_d = b.d
                GROUP BY b.brand_id"""
        ),
        # A version carries both attributes, so common days are its own days.
        "intersect_rows": v(
            islands(days(V, "item_id, brand_id, cat_id"), "item_id, brand_id, cat_id")
        ),
        "tcount": v(islands(COUNT_PER_DAY, "cat_id, n")),
        "tcount_timestamps": v(islands(COUNT_PER_DAY, "cat_id, n")),
        "tcount_when": v(
            islands(f"SELECT cat_id, d FROM ({COUNT_PER_DAY}) WHERE n BETWEEN 2 AND {MORE_THAN}", "cat_id")
        ),
        "split_timeline": v(
            f"""SELECT c.cat_id, c.t AS from_d,
                       (SELECT MIN(n.t) FROM cuts n WHERE n.cat_id = c.cat_id AND n.t > c.t) AS to_d
                FROM cuts c
                WHERE c.t < (SELECT MAX(m.t) FROM cuts m WHERE m.cat_id = c.cat_id)""",
            cuts=f"""SELECT cat_id, from_d AS t FROM ({ATTR["item_category"]})
                     UNION SELECT cat_id, to_d FROM ({ATTR["item_category"]})""",
        ),
        "global_blocks": v(_blocks("brand_id")),
        "a5_difference": v(DIFF),
        "a5_difference_all": v(DIFF_ALL),
        "a5_difference_ss": v(text_set(DIFF_PAIRWISE, "item_id")),
        "a5_difference_tdw": v(CASES, **CASES_TABLES),
        "a5_difference_scd": v(CASES_GUARDED, **CASES_TABLES),
        "a6_aggregation": v(MORE),
        "a6_aggregation_ss": v(text_set(MORE, "cat_id")),
        "a6_aggregation_tdw": v(AT_LEAST),
        "a6_aggregation_scd": coarse(v(BLOCKS_BUSY)),
        "o5_ss": vs(_set_total(DIFF_PAIRWISE, day_test=False)),
        "o5_tdw": vs(_rows_total(CASES), **CASES_TABLES),
        "o5_scd": vs(_rows_total(CASES_GUARDED), **CASES_TABLES),
        "o5": vs(_rows_total(DIFF)),
        "o6_ss": vs(CATEGORY_SETS),
        "o6_tdw": vs(_category_total(AT_LEAST, intended=False)),
        "o6_scd": coarse(vs(_category_total(BLOCKS_BUSY, intended=False))),
        "o6": vs(_category_total(MORE, intended=True)),
        "olap_star": with_(STAR, *all_tables),
        "olap_loaded": with_(
            f"SELECT * REPLACE (CAST(item_id AS VARCHAR) AS item_id) FROM ({STAR})", *all_tables
        ),
        "rep_pair": with_(
            f"""SELECT a.query_id, a.run_id, a.s AS algebra, o.s AS olap
                FROM ({_sums('algebra')}) a JOIN ({_sums('olap')}) o
                  ON a.query_id = o.query_id AND a.run_id = o.run_id""",
            "runlog",
        ),
        "rep_avg_warm": with_(
            f"""SELECT a.query_id, a.m AS algebra, o.m AS olap
                FROM ({_mean("side = 'algebra' AND run_id > 1")}) a
                JOIN ({_mean("side = 'olap' AND run_id > 1")}) o ON a.query_id = o.query_id""",
            "runlog",
        ),
        "rep_full": with_(REP_FULL, "runlog"),
        "rep_profile": with_(PROFILE, *all_tables),
        "rep_profile_size": with_(f"SELECT *, true AS sized FROM ({PROFILE})", *all_tables),
        "rep_pretty_size": PRETTY_SIZE,
        "rep_runlog": with_(
            """SELECT query_id, run_id, start_time, planning_ms, execution_ms,
                      ROUND((planning_ms + execution_ms) / 1000, 6) AS seconds, number_rows,
                      strftime(TIMESTAMP '1970-01-01' + to_microseconds(
                          CAST(ROUND((planning_ms + execution_ms) * 1000) AS BIGINT)), '%H:%M:%S.%f') AS duration
               FROM runlog""",
            "runlog",
        ),
    }
    for name, periods in ATTR.items():
        keys = {"item_brand": "item_id, brand_id", "item_category": "item_id, cat_id",
                "item_price": "item_id, price"}[name]
        out[f"hist_{name}"] = v(periods)
        out[f"hist_{name}_ss"] = v(text_set(periods, keys))
    for key, name, periods in (
        ("1", "selection", SELECTION),
        ("2", "projection", PROJECTION),
        ("3", "join", JOIN),
        ("4", "union", UNION),
    ):
        out[f"a{key}_{name}_ss"] = v(text_set(periods, "item_id"))
        out[f"o{key}_ss"] = vs(_set_total(periods))
        for design in ("tdw", "scd"):
            out[f"a{key}_{name}_{design}"] = v(periods)
            out[f"o{key}_{design}"] = vs(_rows_total(periods))
    out["olap_reopened"] = out["o2_tdw"]
    for name in (*ITEM_TOTALS, *CATEGORY_TOTALS):
        out[f"{name}_shuffled"] = out[name]
    return out
