"""Trade tables derived from the driver's tables; the only module that knows their names.

Each entry of SQL runs unchanged in Spark and in DuckDB, so the same text feeds queries and oracles; for the two of SPARK_SQL, Spark joins in another order.
`{name}` stands for a base table or another entry.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborline.sources import sinks

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
ENVELOPE = ("N02", "N07", "N12", "N17", "N22")
SINGLE_PARTNER = "N02"
UK = "N24"
TOTAL = "000TOTAL"
GROUPS = [
    (1, "alpha", "Alpha goods", "seed", ("11",)),
    (2, "beta", None, "hidden:seed", ("12",)),
    (3, "gamma", "Gamma, mixed", "seed", ("13", "15")),
    (4, "delta", None, "seed", ("14",)),
    (5, "epsilon", "Epsilon (all)", "draft:seed", ("16",)),
    (6, "alpha_plus", None, "seed", ("11", "1301")),
    (7, "alpha_narrow", None, "seed", ("1101",)),
]

_values = lambda rows: ", ".join("(" + ", ".join("NULL" if x is None else str(x) if isinstance(x, (int, float)) else f"'{x}'" for x in r) + ")" for r in rows)

SQL: dict[str, str] = {
    "facts": """
        SELECT CAST(date_trunc('month', l.l_shipdate) AS DATE) AS period,
               CAST(year(l.l_shipdate) * 12 + month(l.l_shipdate) - 1 AS INT) AS month_idx,
               concat('N', lpad(CAST(c.c_nationkey AS STRING), 2, '0')) AS reporter,
               concat('N', lpad(CAST(s.s_nationkey AS STRING), 2, '0')) AS partner,
               concat(CASE p.p_type WHEN 'ECONOMY' THEN '11' WHEN 'LARGE' THEN '12' WHEN 'MEDIUM' THEN '13'
                                    WHEN 'PROMO' THEN '14' WHEN 'SMALL' THEN '15' ELSE '16' END,
                      lpad(substr(p.p_brand, 7), 2, '0'), lpad(CAST(p.p_size AS STRING), 2, '0'),
                      lpad(CAST(p.p_partkey % 100 AS STRING), 2, '0')) AS product_nc,
               CASE WHEN l.l_linestatus = 'O' THEN 1 ELSE 2 END AS flow,
               CAST(l.l_linenumber AS STRING) AS stat_procedure,
               CAST(l.l_extendedprice AS DECIMAL(18,2)) AS value_eur,
               CASE WHEN p.p_partkey % (CASE WHEN p.p_type = 'PROMO' THEN 3 ELSE 7 END) = 0 THEN NULL
                    ELSE CAST(l.l_quantity AS DECIMAL(20,3)) END AS quantity_kg,
               CASE WHEN l.l_orderkey % 97 = 0 THEN 1 ELSE 0 END AS suppression_index,
               concat(CAST(l.l_orderkey AS STRING), '-', CAST(l.l_linenumber AS STRING), '-', CAST(l.l_partkey AS STRING), '-', CAST(l.l_suppkey AS STRING)) AS raw_id
          FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {customer} c ON o.o_custkey = c.c_custkey
          JOIN {supplier} s ON l.l_suppkey = s.s_suppkey JOIN {part} p ON l.l_partkey = p.p_partkey""",
    # the same with the all-goods rows of the sources that publish them: detail plus what only the total holds
    "facts_full": """
        SELECT period, month_idx, reporter, partner, product_nc, flow, stat_procedure, value_eur, quantity_kg, suppression_index, raw_id FROM {facts}
        UNION ALL
        SELECT period, month_idx, reporter, partner, '000TOTAL', flow, '1', CAST(SUM(value_eur) + 10 * COUNT(*) AS DECIMAL(18,2)), CAST(SUM(quantity_kg) AS DECIMAL(20,3)), 0,
               concat('total-', reporter, '-', partner, '-', CAST(month_idx AS STRING), '-', CAST(flow AS STRING))
          FROM {facts} WHERE reporter <> 'N24' GROUP BY period, month_idx, reporter, partner, flow""",
    # groups that follow from the parts sold: one per type and brand, one per size with a prefix in every heading
    "part_groups": """
        SELECT DISTINCT concat(t, '-', b) AS group_name, CASE WHEN b % 7 = 0 THEN 'hidden:parts' WHEN b % 11 = 0 THEN 'draft:parts' ELSE 'parts' END AS created_by, concat(t, lpad(CAST(b AS STRING), 2, '0')) AS prefix
          FROM (SELECT CASE p_type WHEN 'ECONOMY' THEN '11' WHEN 'LARGE' THEN '12' WHEN 'MEDIUM' THEN '13' WHEN 'PROMO' THEN '14' WHEN 'SMALL' THEN '15' ELSE '16' END AS t, CAST(substr(p_brand, 7) AS INT) AS b FROM {part}) x
        UNION ALL
        SELECT DISTINCT concat('size-', CAST(p_size AS STRING)), 'parts', concat(CASE p_type WHEN 'ECONOMY' THEN '11' WHEN 'LARGE' THEN '12' WHEN 'MEDIUM' THEN '13' WHEN 'PROMO' THEN '14' WHEN 'SMALL' THEN '15' ELSE '16' END,
               lpad(substr(p_brand, 7), 2, '0'), CASE WHEN p_size % 10 = 0 THEN '' ELSE lpad(CAST(p_size AS STRING), 2, '0') END) FROM {part}""",
    "group_patterns": "SELECT * FROM (VALUES " + _values([(i, n, d, by, p) for i, n, d, by, ps in GROUPS for p in ps]) + ") AS t(group_id, group_name, display_name, created_by, prefix)",
    "group_list": "SELECT * FROM (VALUES " + _values([g[:4] for g in GROUPS]) + ") AS t(group_id, group_name, display_name, created_by)",
    # exporter-declared exports to each nation, its bloc and the world, in two editions and up to two versions
    "exports_raw": """
        SELECT n.n_name AS nation, r.r_name AS bloc, n.n_nationkey AS nationkey,
               CAST(year(o.o_orderdate) * 12 + month(o.o_orderdate) - 1 AS INT) AS month_idx,
               CASE WHEN l.l_linestatus = 'O' THEN 'export' ELSE 'import' END AS flow,
               CAST(SUM(CAST(l.l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS eur
          FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {customer} c ON o.o_custkey = c.c_custkey
          JOIN {supplier} s ON l.l_suppkey = s.s_suppkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey
          JOIN {region} r ON n.n_regionkey = r.r_regionkey
         WHERE s.s_nationkey IN (2, 7, 12, 17, 22)
         GROUP BY n.n_name, r.r_name, n.n_nationkey, year(o.o_orderdate) * 12 + month(o.o_orderdate) - 1, CASE WHEN l.l_linestatus = 'O' THEN 'export' ELSE 'import' END""",
    "exports": """
        SELECT label, month_idx, flow, currency, unit, period_kind, version_seen,
               CASE WHEN currency = 'CNY' THEN eur * 0.93e0 / 0.125e0 / 1e8 ELSE eur * 1.05e0 / 1e6 END * CASE WHEN version_seen = 2 THEN 1.02e0 ELSE 1e0 END AS value_amount
          FROM (SELECT nation AS label, month_idx, flow, eur, nationkey AS k FROM {exports_raw}
                UNION ALL SELECT bloc, month_idx, flow, SUM(eur), 1 FROM {exports_raw} GROUP BY bloc, month_idx, flow
                UNION ALL SELECT 'Total', month_idx, flow, SUM(eur), 1 FROM {exports_raw} GROUP BY month_idx, flow) x
          CROSS JOIN (VALUES ('CNY', 'CNY 100 Million', 'monthly'), ('USD', 'USD1 Million', 'monthly')) AS e(currency, unit, period_kind)
          CROSS JOIN (VALUES (1), (2)) AS v(version_seen)
         WHERE version_seen = 1 OR (month_idx + k) % 11 = 0""",
    # published year-to-date rows of the pinned edition
    "exports_ytd": """
        SELECT label, month_idx, flow, currency, unit, 'ytd' AS period_kind, version_seen, SUM(value_amount) OVER (PARTITION BY label, flow, FLOOR(month_idx / 12) ORDER BY month_idx) AS value_amount
          FROM {exports} WHERE currency = 'CNY' AND version_seen = 1""",
    "fx_rates": """
        SELECT 'CNY' AS currency_from, 'EUR' AS currency_to, month_idx AS rate_idx, 0.125e0 + 0.001e0 * (month_idx % 12) AS rate
          FROM (SELECT DISTINCT month_idx FROM {exports_raw}) x WHERE month_idx % 4 <> 3""",
    "aliases": """
        SELECT n_name AS label, concat('N', lpad(CAST(n_nationkey AS STRING), 2, '0')) AS iso, CAST(NULL AS STRING) AS aggregate_kind FROM {nation}
        UNION ALL SELECT r_name, NULL, CASE WHEN r_regionkey = 3 THEN 'eu_bloc' ELSE 'region' END FROM {region}
        UNION ALL SELECT 'Total', NULL, 'world'""",
    "members": """
        SELECT concat('N', lpad(CAST(n_nationkey AS STRING), 2, '0')) AS iso, 'eu_bloc' AS aggregate_kind, CAST(NULL AS INT) AS valid_from,
               CASE WHEN n_nationkey = 23 THEN 1998 * 12 + 11 ELSE NULL END AS valid_to FROM {nation} WHERE n_regionkey = 3""",
    "baselines": "SELECT * FROM (VALUES (NULL, 0.075e0), ('N03', 0.05e0)) AS t(partner, baseline)",
    "hubs": "SELECT * FROM (VALUES ('N03'), ('N08')) AS t(iso)",
    "check_log": """
        SELECT event_type AS source, CAST(ts AS TIMESTAMP) AS checked_at,
               CASE WHEN value < 60 THEN 'new_data' WHEN value < 200 THEN 'no_change' WHEN value < 300 THEN 'not_yet' ELSE 'error' END AS result, event_id
          FROM {events}""",
}


def needs(name: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", SQL[name])))


#: Spark joins the same tables in another order: suppliers first, which may cut lineitem before it is shuffled, and orders with their customers
#: before either meets lineitem, so that lineitem is shuffled by order and by part only.
BUYERS = "(SELECT b.o_orderkey, b.o_orderdate, d.c_nationkey FROM {orders} b JOIN {customer} d ON b.o_custkey = d.c_custkey)"
JOINED = f"FROM {{lineitem}} l JOIN {{supplier}} s ON l.l_suppkey = s.s_suppkey JOIN {BUYERS} {{}} ON l.l_orderkey = {{}}.o_orderkey"


def _from(name: str, clause: str) -> str:
    head, rest = SQL[name].split("FROM {lineitem}", 1)
    return head + clause + (" WHERE " + rest.split("WHERE ", 1)[1] if "WHERE " in rest else "")


#: The text of a raw row's id is made where it is asked for; the written facts have the keys that it names.
RAW_ID = re.search(r"concat\(CAST\(l\.l_orderkey.*? AS raw_id", SQL["facts"])[0]
RAW_KEYS = "l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey"

SPARK_SQL = {
    "facts": _from("facts", JOINED.replace("{}", "c") + " JOIN {part} p ON l.l_partkey = p.p_partkey").replace(RAW_ID, RAW_KEYS),
    "exports_raw": _from("exports_raw", JOINED.replace("{}", "o") + " JOIN {nation} n ON o.c_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey"),
}

#: Derived tables that are joined from the base tables: written once per application for all that is derived from them.
WRITTEN = ("facts", "exports_raw")


def stamp(spark: SparkSession, sf_dir: str, names: list[str]) -> str:
    """Names the state of base tables by the sizes and times of their files, so that a written table is not taken for one of other input."""
    seen = []
    for n in names:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{n}.parquet")
        seen += sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path))
    return hashlib.sha1(repr(seen).encode()).hexdigest()


def frames(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    """Base or derived tables by name; what several of them need is planned once, and the joins with lineitem are written once."""
    made: dict[str, DataFrame] = {}

    def get(name: str) -> DataFrame:
        if name not in made:
            if name in BASE:
                made[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
            elif name in WRITTEN:
                key = f"{name} {sf_dir} {stamp(spark, sf_dir, needs(name))}"
                df = sinks.once(spark, key, lambda: spark.sql(SPARK_SQL[name], **{n: get(n) for n in needs(name)}))
                own = [c for c in df.columns if not c.startswith("l_")]
                made[name] = df if len(own) == len(df.columns) else df.selectExpr(*own, RAW_ID.replace("l.", ""))
            else:
                made[name] = spark.sql(SQL[name], **{n: get(n) for n in needs(name)})
        return made[name]

    return {n: get(n) for n in names}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or a derived one as a DataFrame."""
    return frames(spark, sf_dir, name)[name]


def duck(body: str, *names: str, **ctes: str) -> str:
    """DuckDB text: the derived tables that are named (and what they need) and further CTEs, before body."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n not in BASE and n not in order:
            for m in needs(n):
                visit(m)
            order.append(n)

    for n in names:
        visit(n)
    plain = lambda s: re.sub(r"\{(\w+)\}", r"\1", s)
    parts = [f"{n} AS ({plain(SQL[n])})" for n in order] + [f"{n} AS ({s})" for n, s in ctes.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body
