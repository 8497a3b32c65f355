"""TPC-H shaped queries over the fixture's star schema.

Literals are moved into the fixture's date range; queries whose columns the
fixture lacks use the nearest one it has (named ``_variant``).
"""

from __future__ import annotations

from millrace.plans.base import sql_query

REVENUE = "l_extendedprice * (1 - l_discount)"
QUERIES = {
    "tpch_q1": sql_query(["lineitem"], f"""
        SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
               round(sum({REVENUE}), 2) AS sum_disc_price, round(sum({REVENUE} * (1 + l_tax)), 2) AS sum_charge,
               round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
        FROM @lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus"""),
    "tpch_q3": sql_query(["customer", "orders", "lineitem"], f"""
        SELECT l_orderkey, round(sum({REVENUE}), 2) AS revenue, o_orderdate
        FROM @customer JOIN @orders ON c_custkey = o_custkey JOIN @lineitem ON l_orderkey = o_orderkey
        WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15 00:00:00' AND l_shipdate > TIMESTAMP '1998-03-15 00:00:00'
        GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10"""),
    "tpch_q4_variant": sql_query(["orders", "lineitem"], """
        SELECT o_orderpriority, count(*) AS order_count FROM @orders AS o
        WHERE o_orderdate >= TIMESTAMP '1997-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1999-01-01 00:00:00'
          AND EXISTS (SELECT 1 FROM @lineitem AS l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R') GROUP BY o_orderpriority"""),
    "tpch_q5": sql_query(["customer", "orders", "lineitem", "supplier", "nation", "region"], f"""
        SELECT n_name, round(sum({REVENUE}), 2) AS revenue
        FROM @customer JOIN @orders ON c_custkey = o_custkey JOIN @lineitem ON l_orderkey = o_orderkey
             JOIN @supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN @nation ON s_nationkey = n_nationkey JOIN @region ON n_regionkey = r_regionkey
        WHERE r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' GROUP BY n_name"""),
    "tpch_q6": sql_query(["lineitem"], """
        SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM @lineitem
        WHERE l_shipdate >= TIMESTAMP '1997-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1998-01-01 00:00:00' AND l_discount BETWEEN 0.02 AND 0.09 AND l_quantity < 24"""),
    "tpch_q7": sql_query(["supplier", "lineitem", "orders", "customer", "nation"], f"""
        SELECT supp_nation, cust_nation, l_year, round(sum(volume), 2) AS revenue FROM (
          SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(year(l_shipdate) AS BIGINT) AS l_year, {REVENUE} AS volume
          FROM @supplier JOIN @lineitem ON s_suppkey = l_suppkey JOIN @orders ON o_orderkey = l_orderkey JOIN @customer ON c_custkey = o_custkey
               JOIN @nation AS n1 ON s_nationkey = n1.n_nationkey JOIN @nation AS n2 ON c_nationkey = n2.n_nationkey
          WHERE n1.n_nationkey < 8 AND n2.n_nationkey < 8 AND l_shipdate BETWEEN TIMESTAMP '1996-01-01 00:00:00' AND TIMESTAMP '1999-12-31 00:00:00') AS shipping
        GROUP BY supp_nation, cust_nation, l_year"""),
    "tpch_q8": sql_query(["part", "supplier", "lineitem", "orders", "customer", "nation", "region"], f"""
        SELECT o_year, round(sum(CASE WHEN nation = 'NATION_3' THEN volume ELSE 0 END) / sum(volume), 6) AS mkt_share FROM (
          SELECT CAST(year(o_orderdate) AS BIGINT) AS o_year, {REVENUE} AS volume, n2.n_name AS nation
          FROM @part JOIN @lineitem ON p_partkey = l_partkey JOIN @supplier ON s_suppkey = l_suppkey JOIN @orders ON l_orderkey = o_orderkey
               JOIN @customer ON o_custkey = c_custkey JOIN @nation AS n1 ON c_nationkey = n1.n_nationkey JOIN @region ON n1.n_regionkey = r_regionkey
               JOIN @nation AS n2 ON s_nationkey = n2.n_nationkey WHERE p_type <> 'SMALL') AS all_nations GROUP BY o_year"""),
    "tpch_q9_variant": sql_query(["part", "supplier", "lineitem", "orders", "nation"], f"""
        SELECT nation, o_year, round(sum(amount), 2) AS sum_profit FROM (
          SELECT n_name AS nation, CAST(year(o_orderdate) AS BIGINT) AS o_year, {REVENUE} - 0.5 * p_retailprice * l_quantity AS amount
          FROM @part JOIN @lineitem ON p_partkey = l_partkey JOIN @supplier ON s_suppkey = l_suppkey JOIN @orders ON o_orderkey = l_orderkey JOIN @nation ON s_nationkey = n_nationkey
          WHERE p_brand LIKE '%1%') AS profit GROUP BY nation, o_year"""),
    "tpch_q10": sql_query(["customer", "orders", "lineitem", "nation"], f"""
        SELECT c_custkey, c_name, round(sum({REVENUE}), 2) AS revenue, c_acctbal, n_name
        FROM @customer JOIN @orders ON c_custkey = o_custkey JOIN @lineitem ON l_orderkey = o_orderkey JOIN @nation ON c_nationkey = n_nationkey
        WHERE o_orderdate >= TIMESTAMP '1997-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1998-01-01 00:00:00' AND l_returnflag = 'R'
        GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20"""),
    "tpch_q12_variant": sql_query(["orders", "lineitem"], """
        SELECT l_linestatus, sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END)::BIGINT AS high_line_count,
               sum(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END)::BIGINT AS low_line_count
        FROM @orders JOIN @lineitem ON o_orderkey = l_orderkey WHERE l_shipdate > o_orderdate GROUP BY l_linestatus"""),
    "tpch_q13_variant": sql_query(["customer", "orders"], """
        SELECT c_count, count(*) AS custdist FROM (
          SELECT c_custkey, count(o_orderkey) AS c_count FROM @customer LEFT JOIN @orders ON c_custkey = o_custkey AND o_orderstatus <> 'F' GROUP BY c_custkey) AS c_orders
        GROUP BY c_count"""),
    "tpch_q14": sql_query(["lineitem", "part"], f"""
        SELECT round(100.00 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN {REVENUE} ELSE 0 END) / sum({REVENUE}), 6) AS promo_revenue
        FROM @lineitem JOIN @part ON l_partkey = p_partkey WHERE l_shipdate >= TIMESTAMP '1997-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1998-01-01 00:00:00'"""),
    "tpch_q15": sql_query(["lineitem", "supplier"], f"""
        WITH revenue AS (SELECT l_suppkey AS supplier_no, round(sum({REVENUE}), 2) AS total_revenue FROM @lineitem
             WHERE l_shipdate >= TIMESTAMP '1997-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1997-07-01 00:00:00' GROUP BY l_suppkey)
        SELECT s_suppkey, s_name, total_revenue FROM @supplier JOIN revenue ON s_suppkey = supplier_no WHERE total_revenue = (SELECT max(total_revenue) FROM revenue)"""),
    "tpch_q17_variant": sql_query(["lineitem", "part"], """
        SELECT round(sum(l_extendedprice) / 7.0, 2) AS avg_yearly FROM @lineitem AS o JOIN @part ON p_partkey = o.l_partkey
        WHERE p_size < 10 AND l_quantity < (SELECT 0.5 * avg(l_quantity) FROM @lineitem AS i WHERE i.l_partkey = o.l_partkey)"""),
    "tpch_q18": sql_query(["customer", "orders", "lineitem"], """
        SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, round(sum(l_quantity), 2) AS sum_qty
        FROM @customer JOIN @orders ON c_custkey = o_custkey JOIN @lineitem ON o_orderkey = l_orderkey
        WHERE o_orderkey IN (SELECT l_orderkey FROM @lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 250)
        GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice ORDER BY o_totalprice DESC, o_orderkey LIMIT 100"""),
    "tpch_q19_variant": sql_query(["lineitem", "part"], f"""
        SELECT round(sum({REVENUE}), 2) AS revenue FROM @lineitem JOIN @part ON p_partkey = l_partkey
        WHERE (p_brand = 'Brand#1' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 20)
           OR (p_brand = 'Brand#2' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 30)
           OR (p_brand = 'Brand#3' AND l_quantity BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 50)"""),
    "tpch_q21_variant": sql_query(["supplier", "lineitem", "orders"], """
        SELECT s_name, count(*) AS numwait FROM @supplier JOIN @lineitem AS l1 ON s_suppkey = l1.l_suppkey JOIN @orders ON o_orderkey = l1.l_orderkey
        WHERE o_orderstatus = 'F' AND l1.l_returnflag = 'R'
          AND EXISTS (SELECT 1 FROM @lineitem AS l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
          AND NOT EXISTS (SELECT 1 FROM @lineitem AS l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_returnflag = 'R')
        GROUP BY s_name"""),
    "tpch_q22_variant": sql_query(["customer", "orders"], """
        SELECT c_nationkey, count(*) AS numcust, round(sum(c_acctbal), 2) AS totacctbal FROM @customer AS c
        WHERE c_acctbal > (SELECT avg(c_acctbal) FROM @customer WHERE c_acctbal > 0.00)
          AND NOT EXISTS (SELECT 1 FROM @orders AS o WHERE o.o_custkey = c.c_custkey AND o.o_orderdate < TIMESTAMP '1996-01-01 00:00:00') GROUP BY c_nationkey"""),
}
