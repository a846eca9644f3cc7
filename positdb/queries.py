"""Queries over the star-schema tables, shredded into posits, and the same questions in SQL.

Thing ids are a namespace times 10 ** 12 plus the table's key, so both sides give the same ids.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from positdb.engine import Engine
from positdb.functions import certainty, times, values
from positdb.operators import sets
from positdb.sources import ledger
from positdb.sources.store import PositStore, Shred, deduplicated, listing

NS = 10**12


def thing(namespace: int, column: str):
    return F.lit(namespace * NS) + F.col(column)


def shred(spark: SparkSession, sf_dir: str, name: str) -> Shred:
    """One of the shreds by name; only its table is read, and of it only what a query needs."""
    t = lambda x: spark.read.parquet(f"{sf_dir}/{x}.parquet")
    if name == "activity":
        return Shred(t("events"), {"activity": thing(4, "user_id")}, values.STRING, F.col("event_type"), thing(40, "event_id"), F.col("ts"))
    if name == "reading":
        return Shred(t("events").where("event_type in ('purchase', 'view')"), {"reading": thing(4, "user_id")}, values.DECIMAL, F.col("value"), thing(41, "event_id"), F.col("ts"))
    if name == "payload":
        return Shred(t("events"), {"payload": thing(5, "event_id")}, values.JSON, F.col("props"), thing(42, "event_id"), F.col("ts"))
    if name == "order state":
        return Shred(t("orders"), {"order state": thing(1, "o_custkey")}, values.STRING, F.col("o_orderstatus"), thing(50, "o_orderkey"), F.col("o_orderdate"), times.DATE)
    if name == "purchase":
        return Shred(t("orders"), {"purchase": thing(2, "o_orderkey"), "buyer": thing(1, "o_custkey")}, values.DECIMAL, F.col("o_totalprice"), thing(51, "o_orderkey"), F.col("o_orderdate"), times.DATE)
    if name in ("customer name", "segment"):
        role, column, ns = ("name", "c_name", 52) if name == "customer name" else ("segment", "c_mktsegment", 53)
        return Shred(t("customer"), {role: thing(1, "c_custkey")}, values.STRING, F.col(column), thing(ns, "c_custkey"))
    if name == "resident":
        return Shred(t("customer"), {"resident": thing(1, "c_custkey"), "country": thing(3, "c_nationkey")}, values.STRING, F.lit("resident"), thing(54, "c_custkey"))
    if name == "nation name":
        return Shred(t("nation"), {"name": thing(3, "n_nationkey")}, values.STRING, F.col("n_name"), thing(55, "n_nationkey"))
    if name == "member":
        return Shred(t("nation"), {"member": thing(3, "n_nationkey"), "continent": thing(6, "n_regionkey")}, values.STRING, F.lit("member"), thing(56, "n_nationkey"))
    if name == "region name":
        return Shred(t("region"), {"name": thing(6, "r_regionkey")}, values.STRING, F.col("r_name"), thing(57, "r_regionkey"))
    if name in ("size", "price"):
        vt, column, ns = (values.INTEGER, "p_size", 58) if name == "size" else (values.DECIMAL, "p_retailprice", 59)
        return Shred(t("part"), {name: thing(7, "p_partkey")}, vt, F.col(column), thing(ns, "p_partkey"))
    if name == "language":
        return Shred(t("documents"), {"language": thing(8, "doc_id")}, values.STRING, F.col("lang"), thing(60, "doc_id"))
    if name == "assertion":
        day = F.lit("2024-01-01").cast("timestamp_ntz")
        return Shred(t("labels"), {"posit": thing(60, "doc_id"), "ascertains": F.lit(9 * NS + 1)}, values.CERTAINTY, F.expr("if(quality = 1, 100, -100)"), thing(61, "doc_id"), day, times.DATE)
    if name == "review":  # two opinions of every labelled document, the later one of some turned round
        day = F.expr("if(doc_id % 2 = 0, timestamp_ntz '2024-03-01', timestamp_ntz '2024-09-01')")
        return Shred(t("labels"), {"posit": thing(60, "doc_id"), "ascertains": F.lit(9 * NS + 2)}, values.CERTAINTY, F.expr("if(toxic = 1, -80, 80)"), thing(64, "doc_id"), day, times.DATE)
    if name == "ordered":
        return Shred(t("orders"), {"ordered": thing(2, "o_orderkey")}, values.TIME, F.col("o_orderdate"), thing(65, "o_orderkey"), F.col("o_orderdate"), times.DATE)
    if name in ("code", "zone"):
        table, key, ns = ("nation", "n_nationkey", 3) if name == "code" else ("region", "r_regionkey", 6)
        return Shred(t(table), {name: thing(ns, key)}, values.INTEGER, F.col(key), thing(62 if name == "code" else 63, key))
    raise KeyError(name)


def store(spark: SparkSession, sf_dir: str, *names: str) -> PositStore:
    found = PositStore.in_memory(spark)
    for name in names:
        found.shred(shred(spark, sf_dir, name), unique=name != "order state")
    return found


def ask(script: str, *names: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query that runs a script over the named shreds and returns its last search, decimals as doubles."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        typed = Engine(store(spark, sf_dir, *names)).run(script)[-1].typed
        return typed.select(*[F.col(c).cast("double").alias(c) if kind.startswith("decimal") else F.col(c) for c, kind in typed.dtypes])

    return query


def thing_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = store(spark, sf_dir, "customer name", "segment", "resident", "purchase").involving(NS + 7)
    return found.select("posit_id", "role_set", F.col("v_text").alias("text"))


def users(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return Engine(store(spark, sf_dir, "activity")).run(f'search [{{(+u, activity)}}, "{kind}", *] return u;')[0].typed.toDF("thing").distinct()


def set_query(op) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        early = Engine(store(spark, sf_dir, "reading")).run("search [{(+u, reading)}, +v, *] where v > 100 return u;")[0].typed.toDF("thing")
        return op(users(spark, sf_dir, "error"), early)

    return query


def set_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.insert(users(spark, sf_dir, "error"), [4 * NS - 1, 4 * NS - 2])


def row_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display texts of mixed values with the type of each cell."""
    found = Engine(store(spark, sf_dir, "size", "price")).run("search +p [{(+x, *)}, +v, +t] return p, v, t;")[0]
    return found.df.select("p", "p__type", "v", "v__type", "t", "t__type")


def ledger_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain over posits of which two were changed afterwards: those two don't fit, all others do."""
    posits, entries = _chain(spark, sf_dir)
    changed = F.when(F.col("posit_id").isin(55 * NS + 3, 55 * NS + 11), F.concat("v_text", F.lit("!"))).otherwise(F.col("v_text"))
    return ledger.checked(posits.withColumn("v_text", changed), entries).select("posit_id", "ok")


def ledger_relinked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain without its fifth entry: the sixth has no entry before it."""
    posits, entries = _chain(spark, sf_dir)
    return ledger.checked(posits, entries.where("seq != 5")).select("posit_id", "ok")


def certainty_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    script = "search +p [{(+d, language)}, +l, *], [{(p, posit), (*, ascertains)}, +c, *] return l, c;"
    found = Engine(store(spark, sf_dir, "language", "assertion")).run(script)[0].typed
    return certainty.consistent(found, ["l"], "c")


def certainty_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Engine(store(spark, sf_dir, "assertion")).run("search [{(+p, posit), (*, ascertains)}, +c, *] return p, c;")[0].typed
    half = F.lit(-50)
    return found.select("p", certainty.plus(F.col("c"), half).alias("plus_half"), certainty.times(F.col("c"), half).alias("times_half"))


def posit_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(shred(spark, sf_dir, "order state").frame()).select("posit_id")


def posit_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing(store(spark, sf_dir, "nation name", "member").posits())


def _chain(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    posits = store(spark, sf_dir, "nation name").posits()
    rows = [(r.posit_id, r.p) for r in posits.orderBy("posit_id").select("posit_id", ledger.payload_column().alias("p")).collect()]  # one batch of the ledger
    return posits, spark.createDataFrame(ledger.chain(rows), ledger.SCHEMA)


def ledger_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chain(spark, sf_dir)[1]


def ledger_rowhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    posits = store(spark, sf_dir, "customer name").posits()
    return posits.select("posit_id", F.sha2(ledger.payload_column().cast("binary"), 256).alias("hash"))


def ledger_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.checked(*_chain(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "scan_role": ask("search [{(+u, activity)}, +e, +t] return u, e, t;", "activity"),
    "value_literal": ask('search [{(+u, activity)}, "purchase", +t] return u, t;', "activity"),
    "time_slot": ask("search [{(+c, order state)}, +s, '1998-10-03'] return c, s;", "order state"),
    "time_range": ask("search [{(+u, activity)}, +e, +t] where t >= '2024-01-10' and t < '2024-01-20' return u, e, t;", "activity"),
    "time_month": ask("search [{(+c, order state)}, +s, +t] where t >= '1998-03' and t <= '1998-05' return c, s, t;", "order state"),
    "int_where": ask("search [{(+p, size)}, +s, *] where s > 40 return p, s;", "size"),
    "dec_where": ask("search [{(+p, price)}, +v, *] where v >= 1500.50 return p, v;", "price"),
    "string_where": ask('search [{(+c, segment)}, +s, *] where s = "BUILDING" return c;', "segment"),
    "certainty_where": ask("search [{(+p, posit), (*, ascertains)}, +c, *] where c >= 50% return p, c;", "assertion"),
    "identity_join": ask("search [{(+c, name)}, +n, *], [{(c, segment)}, +s, *] return c, n, s;", "customer name", "segment"),
    "graph_three_hop": ask("search [{(+c, resident), (+n, country)}, *, *], [{(n, member), (+r, continent)}, *, *], [{(r, name)}, +x, *] return c, n, x;", "resident", "member", "region name"),
    "superset_roles": ask("search [{(+x, name)}, +n, *] return x, n;", "customer name", "nation name", "region name"),
    "role_wildcard": ask('search [{(+x, *)}, "member", *] return x;', "member", "nation name"),
    "set_wildcard": ask("search +p [*, +n, *] return p, n;", "nation name", "region name"),
    "posit_var": ask("search +p [{(+c, buyer), (+o, purchase)}, +v, *] where v > 100000.0 return p, c, o, v;", "purchase"),
    "meta_join": ask("search +p [{(+d, language)}, +l, *], [{(p, posit), (*, ascertains)}, +c, *] return d, l, c;", "language", "assertion"),
    "snapshot_literal": ask("search [{(+u, activity)}, +e, +t] as of '2024-01-15' return u, e, t;", "activity"),
    "snapshot_ties": ask("search [{(+c, order state)}, +s, +t] as of '2001' return c, s, t;", "order state"),
    "snapshot_then_value": ask('search [{(+u, activity)}, "purchase", +t] as of @NOW return u, t;', "activity"),
    "asof_variable": ask('search [{(+u, activity)}, "signup", +s], [{(u, reading)}, +v, +t] as of s return u, s, v, t;', "activity", "reading"),
    "history_until_var": ask('search [{(+u, activity)}, "signup", +s], [{(u, reading)}, +v, +t] where t <= s return u, s, v, t;', "activity", "reading"),
    "numeric_var_cmp": ask("search [{(+p, size)}, +a, *], [{(+q, size)}, +b, *] where a < 3 and b > 48 and a < b return p, q, a, b;", "size"),
    "int_literal": ask("search [{(+p, size)}, 42, *] return p;", "size"),
    "dec_literal": ask("search [{(+p, price)}, 900.50, *] return p;", "price"),
    "certainty_literal": ask("search [{(+p, posit), (*, ascertains)}, 100%, *] return p;", "assertion"),
    "time_literal": ask("search [{(+o, ordered)}, '1996-09-17 00:00:00', *] return o;", "ordered"),
    "time_value_where": ask("search [{(+o, ordered)}, +d, *] where d >= '1997-08' and d < '1997-09-15' return o, d;", "ordered"),
    "wildcard_constant": ask("search [{(*, segment)}, +s, +t] where t = @BOT return s;", "segment"),
    "shared_posit_var": ask("search +p [{(+c, buyer)}, +v, *], +p [{(+o, purchase)}, *, *] where v >= 200000 return p, c, o;", "purchase"),
    "shared_time_var": ask("search [{(+c, buyer)}, +v, +t], [{(+o, purchase)}, *, +t] where t >= '1998-06' return c, o, v, t;", "purchase"),
    "bitemporal_two_times": ask("search +p [{(+d, language)}, +l, *] as of @NOW, [{(p, posit), (+r, ascertains)}, +c, +at] as of '2024-06' return d, l, r, c, at;", "language", "assertion", "review"),
    "script_scope": ask('search [{(+n, name)}, "FRANCE", *] return n; search [{(+c, resident), (n, country)}, *, *] return c, n;', "resident", "nation name"),
    "numeric_var_eq": ask("search [{(+n, code)}, +a, *], [{(+r, zone)}, +b, *] where a = b return n, r;", "code", "zone"),
    "mixed_number_cmp": ask("search [{(+p, size)}, +s, *], [{(p, price)}, +v, *] where v >= 1000 and s < v return p, s, v;", "size", "price"),
    "value_var_reuse": ask('search [{(+u, activity)}, +v, +t], [{(+w, activity)}, +v, *] where v = "signup" return u, w, t;', "activity"),
    "union_var": ask("search [{(+c, resident), (+n, country)}, *, *], [{(c|n, name)}, +x, *] return c, n, x;", "resident", "customer name", "nation name"),
    "script_var_filter": ask('search [{(+c, segment)}, "BUILDING", *] return c; search [{(c, name)}, +n, *] return c, n;', "segment", "customer name"),
    "limit_ordered": ask("search +p [{(+c, name)}, +n, *] return p, n limit 5;", "customer name"),
    "json_equality": ask('search [{(+e, payload)}, {"k": 69}, +t] return e, t;', "payload"),
    "bitemporal": ask("search +p [{(+d, language)}, +l, *] as of @NOW, [{(p, posit), (+r, ascertains)}, +c, +at] as of '2024-06' return d, l, r, c, at;", "language", "assertion"),
    "thing_lookup": thing_lookup,
    "set_intersect": set_query(sets.intersect),
    "set_union": set_query(sets.union),
    "set_difference": set_query(sets.difference),
    "set_symmetric_difference": set_query(sets.symmetric_difference),
    "certainty_consistent": certainty_consistent,
    "certainty_arithmetic": certainty_arithmetic,
    "posit_dedupe": posit_dedupe,
    "posit_listing": posit_listing,
    "ledger_rowhash": ledger_rowhash,
    "ledger_chain": ledger_chain,
    "ledger_verify": ledger_verify,
    "ledger_broken": ledger_broken,
    "ledger_relinked": ledger_relinked,
    "set_insert": set_insert,
    "row_types": row_types,
}

T = {i: i * NS for i in range(1, 66)}
STATES = f"SELECT DISTINCT o_custkey + {T[1]} AS c, o_orderstatus AS s, o_orderdate AS t FROM orders"
SETS = f"SELECT user_id + {T[4]} AS thing FROM events WHERE event_type = 'error' {{op}} SELECT user_id + {T[4]} FROM events WHERE event_type IN ('purchase', 'view') AND value > 100"
BOTH = f"SELECT s.user_id + {T[4]} AS u, s.ts AS s, r.value AS v, r.ts AS t FROM (SELECT * FROM events WHERE event_type = 'signup') s {{join}} (SELECT * FROM events WHERE event_type IN ('purchase', 'view')) r ON s.user_id = r.user_id AND s.ts >= r.ts"
PAYLOAD = "{id} || '|name=' || {thing} || '|2|' || {text} || '|BOT'"
META = f"SELECT d.doc_id + {T[8]} AS d, d.lang AS l, CASE WHEN quality = 1 THEN 100 ELSE -100 END::INTEGER AS c FROM documents d JOIN labels l USING (doc_id)"

ORACLE: dict[str, str] = {
    "scan_role": f"SELECT user_id + {T[4]} AS u, event_type AS e, ts AS t FROM events",
    "value_literal": f"SELECT user_id + {T[4]} AS u, ts AS t FROM events WHERE event_type = 'purchase'",
    "time_slot": f"SELECT c, s FROM ({STATES}) WHERE t = TIMESTAMP '1998-10-03'",
    "time_range": f"SELECT user_id + {T[4]} AS u, event_type AS e, ts AS t FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'",
    "time_month": f"SELECT * FROM ({STATES}) WHERE t >= TIMESTAMP '1998-03-01' AND t < TIMESTAMP '1998-06-01'",
    "int_where": f"SELECT p_partkey + {T[7]} AS p, p_size::BIGINT AS s FROM part WHERE p_size > 40",
    "dec_where": f"SELECT p_partkey + {T[7]} AS p, p_retailprice AS v FROM part WHERE p_retailprice >= 1500.50",
    "string_where": f"SELECT c_custkey + {T[1]} AS c FROM customer WHERE c_mktsegment = 'BUILDING'",
    "certainty_where": f"SELECT doc_id + {T[60]} AS p, 100::INTEGER AS c FROM labels WHERE quality = 1",
    "identity_join": f"SELECT c_custkey + {T[1]} AS c, c_name AS n, c_mktsegment AS s FROM customer",
    "graph_three_hop": f"SELECT c_custkey + {T[1]} AS c, n_nationkey + {T[3]} AS n, r_name AS x FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "superset_roles": f"SELECT c_custkey + {T[1]} AS x, c_name AS n FROM customer UNION ALL SELECT n_nationkey + {T[3]}, n_name FROM nation UNION ALL SELECT r_regionkey + {T[6]}, r_name FROM region",
    "role_wildcard": f"SELECT n_nationkey + {T[3]} AS x FROM nation UNION ALL SELECT n_regionkey + {T[6]} FROM nation",
    "set_wildcard": f"SELECT n_nationkey + {T[55]} AS p, n_name AS n FROM nation UNION ALL SELECT r_regionkey + {T[57]}, r_name FROM region",
    "posit_var": f"SELECT o_orderkey + {T[51]} AS p, o_custkey + {T[1]} AS c, o_orderkey + {T[2]} AS o, o_totalprice AS v FROM orders WHERE o_totalprice > 100000",
    "meta_join": META,
    "snapshot_literal": f"SELECT user_id + {T[4]} AS u, event_type AS e, ts AS t FROM events WHERE ts < TIMESTAMP '2024-01-16' QUALIFY rank() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1",
    "snapshot_ties": f"SELECT * FROM ({STATES}) WHERE t < TIMESTAMP '2002-01-01' QUALIFY rank() OVER (PARTITION BY c ORDER BY t DESC) = 1",
    "snapshot_then_value": f"SELECT u, t FROM (SELECT user_id + {T[4]} AS u, event_type AS e, ts AS t FROM events QUALIFY rank() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1) WHERE e = 'purchase'",
    "asof_variable": BOTH.format(join="ASOF JOIN"),
    "history_until_var": BOTH.format(join="JOIN"),
    "numeric_var_cmp": f"SELECT x.p_partkey + {T[7]} AS p, y.p_partkey + {T[7]} AS q, x.p_size::BIGINT AS a, y.p_size::BIGINT AS b FROM part x, part y WHERE x.p_size < 3 AND y.p_size > 48",
    "int_literal": f"SELECT p_partkey + {T[7]} AS p FROM part WHERE p_size = 42",
    "dec_literal": f"SELECT p_partkey + {T[7]} AS p FROM part WHERE p_retailprice = 900.5",
    "certainty_literal": f"SELECT doc_id + {T[60]} AS p FROM labels WHERE quality = 1",
    "time_literal": f"SELECT o_orderkey + {T[2]} AS o FROM orders WHERE o_orderdate = TIMESTAMP '1996-09-17'",
    "time_value_where": f"SELECT o_orderkey + {T[2]} AS o, o_orderdate AS d FROM orders WHERE o_orderdate >= TIMESTAMP '1997-08-01' AND o_orderdate < TIMESTAMP '1997-09-15'",
    "wildcard_constant": "SELECT c_mktsegment AS s FROM customer",
    "shared_posit_var": f"SELECT o_orderkey + {T[51]} AS p, o_custkey + {T[1]} AS c, o_orderkey + {T[2]} AS o FROM orders WHERE o_totalprice >= 200000",
    "shared_time_var": f"SELECT o_custkey + {T[1]} AS c, o_orderkey + {T[2]} AS o, o_totalprice AS v, o_orderdate AS t FROM orders WHERE o_orderdate >= TIMESTAMP '1998-06-01'",
    "bitemporal_two_times": f"SELECT d, l, {T[9] + 1} AS r, c, TIMESTAMP '2024-01-01' AS at FROM ({META}) UNION ALL SELECT d.doc_id + {T[8]}, d.lang, {T[9] + 2}, CASE WHEN toxic = 1 THEN -80 ELSE 80 END::INTEGER, TIMESTAMP '2024-03-01' FROM documents d JOIN labels USING (doc_id) WHERE d.doc_id % 2 = 0",
    "script_scope": f"SELECT c_custkey + {T[1]} AS c, c_nationkey + {T[3]} AS n FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_name = 'FRANCE'",
    "ledger_broken": f"SELECT n_nationkey + {T[55]} AS posit_id, n_nationkey NOT IN (3, 11) AS ok FROM nation",
    "ledger_relinked": f"SELECT n_nationkey + {T[55]} AS posit_id, rank() OVER (ORDER BY n_nationkey) <> 6 AS ok FROM nation QUALIFY rank() OVER (ORDER BY n_nationkey) <> 5",
    "set_insert": f"SELECT user_id + {T[4]} AS thing FROM events WHERE event_type = 'error' UNION SELECT unnest([{T[4] - 1}, {T[4] - 2}])",
    "row_types": f"SELECT p_partkey + {T[58]} AS p, 'Thing' AS p__type, p_size::VARCHAR AS v, 'i64' AS v__type, 'BOT' AS t, 'Time' AS t__type FROM part UNION ALL SELECT p_partkey + {T[59]}, 'Thing', rtrim(rtrim(p_retailprice::DECIMAL(18,4)::VARCHAR, '0'), '.'), 'Decimal', 'BOT', 'Time' FROM part",
    "numeric_var_eq": f"SELECT n_nationkey + {T[3]} AS n, r_regionkey + {T[6]} AS r FROM nation JOIN region ON n_nationkey = r_regionkey",
    "mixed_number_cmp": f"SELECT p_partkey + {T[7]} AS p, p_size::BIGINT AS s, p_retailprice AS v FROM part WHERE p_retailprice >= 1000 AND p_size < p_retailprice",
    "value_var_reuse": f"SELECT user_id + {T[4]} AS u, user_id + {T[4]} AS w, ts AS t FROM events WHERE event_type = 'signup'",
    "union_var": f"SELECT c_custkey + {T[1]} AS c, c_nationkey + {T[3]} AS n, x FROM customer, LATERAL (SELECT c_name AS x UNION ALL SELECT n_name FROM nation WHERE n_nationkey = c_nationkey)",
    "script_var_filter": f"SELECT c_custkey + {T[1]} AS c, c_name AS n FROM customer WHERE c_mktsegment = 'BUILDING'",
    "limit_ordered": f"SELECT c_custkey + {T[52]} AS p, c_name AS n FROM customer ORDER BY c_custkey LIMIT 5",
    "json_equality": f"SELECT event_id + {T[5]} AS e, ts AS t FROM events WHERE (props->>'k')::INTEGER = 69",
    "bitemporal": f"SELECT d, l, {T[9] + 1} AS r, c, TIMESTAMP '2024-01-01' AS at FROM ({META})",
    "thing_lookup": f"SELECT {T[52] + 7} AS posit_id, 'name' AS role_set, c_name AS text FROM customer WHERE c_custkey = 7 UNION ALL SELECT {T[53] + 7}, 'segment', c_mktsegment FROM customer WHERE c_custkey = 7 UNION ALL SELECT {T[54] + 7}, 'country|resident', 'resident' FROM customer WHERE c_custkey = 7 UNION ALL SELECT o_orderkey + {T[51]}, 'buyer|purchase', rtrim(rtrim(o_totalprice::DECIMAL(18,2)::VARCHAR, '0'), '.') FROM orders WHERE o_custkey = 7",
    "set_intersect": SETS.format(op="INTERSECT"),
    "set_union": SETS.format(op="UNION"),
    "set_difference": SETS.format(op="EXCEPT"),
    "set_symmetric_difference": f"({SETS.format(op='EXCEPT')}) UNION ((SELECT user_id + {T[4]} AS thing FROM events WHERE event_type IN ('purchase', 'view') AND value > 100) EXCEPT (SELECT user_id + {T[4]} FROM events WHERE event_type = 'error'))",
    "certainty_consistent": f"SELECT l, sum(CASE WHEN c < 0 THEN c + 100 ELSE c END) <= 100 AS consistent FROM ({META}) GROUP BY l",
    "certainty_arithmetic": f"SELECT doc_id + {T[60]} AS p, CASE WHEN quality = 1 THEN 0.5 ELSE -1.5 END::DOUBLE AS plus_half, CASE WHEN quality = 1 THEN -0.5 ELSE 0.5 END::DOUBLE AS times_half FROM labels",
    "posit_dedupe": f"SELECT min(o_orderkey) + {T[50]} AS posit_id FROM orders GROUP BY o_custkey, o_orderstatus, o_orderdate",
    "posit_listing": f"SELECT n_nationkey + {T[55]} AS posit_id, (n_nationkey + {T[55]}) || ' [{{(' || (n_nationkey + {T[3]}) || ', name)}}, ' || n_name || '::<String>, BOT]' AS line FROM nation UNION ALL SELECT n_nationkey + {T[56]}, (n_nationkey + {T[56]}) || ' [{{(' || (n_regionkey + {T[6]}) || ', continent), (' || (n_nationkey + {T[3]}) || ', member)}}, member::<String>, BOT]' FROM nation",
    "ledger_rowhash": f"SELECT c_custkey + {T[52]} AS posit_id, sha256({PAYLOAD.format(id=f'(c_custkey + {T[52]})', thing=f'(c_custkey + {T[1]})', text='c_name')}) AS hash FROM customer",
    "ledger_chain": f"""WITH RECURSIVE p AS (SELECT row_number() OVER (ORDER BY n_nationkey) AS seq, n_nationkey + {T[55]} AS posit_id,
        {PAYLOAD.format(id=f'(n_nationkey + {T[55]})', thing=f'(n_nationkey + {T[3]})', text='n_name')} AS payload FROM nation),
        c AS (SELECT seq, posit_id, repeat('0', 64) AS prev, sha256(payload || '|prev=' || repeat('0', 64)) AS hash FROM p WHERE seq = 1
        UNION ALL SELECT p.seq, p.posit_id, c.hash, sha256(p.payload || '|prev=' || c.hash) FROM c JOIN p ON p.seq = c.seq + 1) SELECT * FROM c""",
    "ledger_verify": f"SELECT row_number() OVER (ORDER BY n_nationkey) AS seq, n_nationkey + {T[55]} AS posit_id, true AS ok FROM nation",
}
