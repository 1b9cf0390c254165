"""Plain SQL that gives the driver tables the shape of the section tables.

The text runs unchanged in Spark and in DuckDB. Each supplier and each user is
a database, so the number of databases grows with the data. Values are DECIMAL
or whole, so sums are exact in both engines.
"""

from __future__ import annotations

TOP_SQL = """
SELECT concat('DB', cast(l_suppkey as varchar(20))) AS db_id,
 cast(3000 + (year(l_shipdate)-1992)*12 + month(l_shipdate) as bigint) AS SNAP_ID,
 concat('sql', cast(cast(l_quantity as int) as varchar(20))) AS SQL_ID,
 concat('SCH', l_linestatus) AS PARSING_SCHEMA_NAME,
 CASE WHEN l_tax > 0 THEN concat('MOD', cast(l_linenumber as varchar(20))) END AS MODULE,
 CASE l_returnflag WHEN 'R' THEN 'SELECT' WHEN 'A' THEN 'INSERT' ELSE 'UPDATE' END AS COMMAND_NAME,
 concat('plan', cast(CASE WHEN l_partkey % 5 = 0 THEN l_linenumber ELSE 0 END as varchar(20))) AS PLAN_HASH,
 CASE WHEN l_partkey % 5 = 0 AND l_linenumber = 1 THEN 1 ELSE 0 END AS PLAN_CHANGE,
 CASE WHEN l_partkey % 5 = 0 AND l_linenumber = 1 THEN 2 ELSE 1 END AS PLANS,
 l_linenumber AS ELAP_RANK,
 cast(l_quantity as int) AS EXECS, cast(l_quantity as int)*100 AS BUFFER_GETS, cast(l_quantity as int)*3 AS ROWS_PROC,
 cast(cast(l_extendedprice as decimal(12,2)) * 0.0002 as decimal(8,6)) AS ELAP_S,
 cast(cast(l_extendedprice as decimal(12,2)) * 0.0002 * (1 - 6*cast(l_discount as decimal(4,2))) as decimal(8,6)) AS CPU_T_S,
 cast(l_tax as decimal(4,2))*100 AS IO_WAIT, cast(l_quantity as int) AS READ_MB,
 cast(l_tax as decimal(4,2))*5 AS PHY_READ_GB, cast(l_discount as decimal(4,2))*40 AS DIRECT_W_GB,
 l_orderkey, l_partkey
FROM lineitem
"""

MAIN_METRICS = """
SELECT concat('DB', cast(user_id as varchar(20))) AS db_id,
 cast(3000 + (day(ts)-1)*24 + hour(ts) as bigint) AS snap, cast(event_id % 2 + 1 as int) AS inst, 60 AS dur_m,
 date_trunc('hour', ts) + INTERVAL 1 HOUR AS end_ts,
 sum(cast(value as decimal(8,2))) AS os_cpu, max(cast(value as decimal(8,2))) AS os_cpu_max, count(*) AS exec_s
FROM events GROUP BY 1,2,3,4,5
"""

ACTIVE_SESSIONS = """
SELECT concat('DB', cast(user_id as varchar(20))) AS db_id,
 cast(3000 + (day(ts)-1)*24 + hour(ts) as bigint) AS SNAP_ID, event_type AS WAIT_CLASS,
 sum(cast(value as decimal(8,2))) AS AVG_SESS
FROM events GROUP BY 1,2,3
"""

TIMED_EVENTS = """
SELECT concat('DB', cast(user_id as varchar(20))) AS db_id,
 cast(3000 + (day(ts)-1)*24 + hour(ts) as bigint) AS SNAP_ID, concat(event_type, ' u', cast(event_id % 3 as varchar(5))) AS EVENT_NAME,
 event_type AS WAIT_CLASS, count(*) AS PCTDBT, sum(cast(value as decimal(8,2))) AS TOTAL_TIME_S
FROM events GROUP BY 1,2,3,4
"""

# Instances without any event but errors have no memory row.
MEMORY = """
SELECT concat('DB', cast(user_id as varchar(20))) AS db_id,
 cast(3000 + (day(ts)-1)*24 + hour(ts) as bigint) AS SNAP_ID, cast(event_id % 2 + 1 as int) AS INSTANCE_NUMBER,
 cast(count(*) as int) AS SGA, cast(count(distinct event_type) as int) AS PGA,
 cast(count(*) + count(distinct event_type) as int) AS TOTAL
FROM events WHERE event_type <> 'error' GROUP BY 1,2,3
"""

OS_INFO = """
SELECT concat('DB', cast(c_custkey as varchar(20))) AS db_id, 1 AS line_pos, 'DB_NAME' AS STAT_NAME, c_name AS STAT_VALUE FROM customer
UNION ALL SELECT concat('DB', cast(c_custkey as varchar(20))), 2, 'DBID', cast(c_custkey as varchar(20)) FROM customer
UNION ALL SELECT concat('DB', cast(c_custkey as varchar(20))), 3, 'VERSION', c_mktsegment FROM customer
UNION ALL SELECT concat('DB', cast(c_custkey as varchar(20))), 4, 'NUM_CPUS', cast(c_nationkey as varchar(20)) FROM customer
UNION ALL SELECT concat('DB', cast(c_custkey as varchar(20))), 5, '!PLATFORM_NAME', n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT concat('DB', cast(c_custkey as varchar(20))), 6, 'VERSION', concat(c_mktsegment, '.2') FROM customer WHERE c_acctbal > 0
UNION ALL SELECT concat('DB', cast(c_custkey as varchar(20))), 7, 'OTHER', 'unused' FROM customer
"""

VIEWS = {
    "v_top_sql": TOP_SQL,
    "v_main_metrics": MAIN_METRICS,
    "v_aas": ACTIVE_SESSIONS,
    "v_top_wait": TIMED_EVENTS,
    "v_memory": MEMORY,
    "v_os_info": OS_INFO,
}


def with_views(sql: str, *names: str) -> str:
    """A query over some of the views as one self-contained statement."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names) + "\n" + sql
