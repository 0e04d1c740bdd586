"""The same trade tables as SQL, for an independent check of every query."""

_EXPORTS = """
exports AS (
  SELECT CAST(year(l_shipdate) AS BIGINT) AS "year", n_name AS state,
         lpad(CAST(p_size AS VARCHAR), 4, '0') AS "headingCode",
         concat('Heading ', lpad(CAST(p_size AS VARCHAR), 4, '0')) AS heading,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS "metricFOB"
  FROM lineitem
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey
  JOIN part ON l_partkey = p_partkey
)"""

_COUNTRY_PRODUCT = """
cp_f AS (
  SELECT CAST(year(l_shipdate) AS BIGINT) AS yr,
         lpad(CAST(p_size AS VARCHAR), 4, '0') AS code,
         s_nationkey AS ex, c_nationkey AS im,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS v,
         CAST(round(l_discount * 100) AS BIGINT) AS d,
         CAST(round(l_tax * 100) AS BIGINT) AS t,
         CAST(round(p_retailprice * 100) AS BIGINT) AS r
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN part ON l_partkey = p_partkey
),
cp_e AS (SELECT yr, code, ex AS k, sum(v) AS xv, sum(d) AS sd, sum(t) AS st,
                sum(r) AS sr, count(*) AS n FROM cp_f GROUP BY yr, code, ex),
cp_i AS (SELECT yr, code, im AS k, sum(v) AS mv FROM cp_f GROUP BY yr, code, im),
cp_c AS (SELECT yr, k, sum(xv) AS xc FROM cp_e GROUP BY yr, k),
cp_p AS (SELECT yr, code, sum(xv) AS xp FROM cp_e GROUP BY yr, code),
cp_w AS (SELECT yr, sum(xv) AS xw FROM cp_e GROUP BY yr),
country_product AS (
  SELECT e.k AS country_id,
         concat('N', lpad(CAST(e.k AS VARCHAR), 2, '0')) AS country_iso3_code,
         CAST(e.code AS BIGINT) AS product_id, e.code AS product_hs92_code,
         e.yr AS "year", CAST(e.xv AS BIGINT) AS export_value,
         CAST(coalesce(i.mv, 0) AS BIGINT) AS import_value,
         e.xv * 1.0e0 / p.xp AS global_share,
         (e.xv * 1.0e0 / c.xc) / (p.xp * 1.0e0 / w.xw) AS export_rca,
         e.sd * 1.0e0 / e.n / 10 AS distance, e.st * 1.0e0 / e.n / 10 AS cog,
         e.sr * 1.0e0 / e.n / 100000 - 1 AS pci
  FROM cp_e e
  LEFT JOIN cp_i i ON e.yr = i.yr AND e.code = i.code AND e.k = i.k
  JOIN cp_c c ON e.yr = c.yr AND e.k = c.k
  JOIN cp_p p ON e.yr = p.yr AND e.code = p.code
  JOIN cp_w w ON e.yr = w.yr
)"""

_TRADE_RECORDS = """
trade_records AS (
  SELECT 'C' AS "typeCode", 'A' AS "freqCode",
         CAST(year(l_shipdate) AS BIGINT) AS "refYear",
         CAST(month(l_shipdate) AS BIGINT) AS "refMonth",
         CAST(year(l_shipdate) AS BIGINT) AS period,
         CAST(s_nationkey AS VARCHAR) AS "reporterCode",
         concat('N', lpad(CAST(s_nationkey AS VARCHAR), 2, '0')) AS "reporterISO",
         CASE WHEN l_returnflag = 'R' THEN 'M' ELSE 'X' END AS "flowCode",
         CAST(c_nationkey AS VARCHAR) AS "partnerCode",
         CASE WHEN l_linestatus = 'F' THEN 'H4' ELSE 'H5' END AS "classificationCode",
         'HS' AS "classificationSearchCode",
         lpad(CAST(p_size AS VARCHAR), 4, '0') AS "cmdCode", p_type AS "cmdDesc",
         'C00' AS "customsCode", CAST(l_linenumber AS VARCHAR) AS "motCode",
         l_quantity AS qty, l_quantity * 2 AS "netWgt",
         CAST(round(l_extendedprice * 100) AS BIGINT) AS "primaryValue"
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN part ON l_partkey = p_partkey
)"""

_BRIDGE = """
bridge AS (
  SELECT concat(lpad(CAST(p_size AS VARCHAR), 4, '0'),
                lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0'),
                CASE WHEN p_partkey % 3 = 0 THEN '.0' ELSE '' END) AS ncm8_raw,
         p_name AS ncm_descricao,
         CASE WHEN p_partkey % 11 = 0 THEN 'XXXX'
              ELSE concat(lpad(CAST(p_size AS VARCHAR), 4, '0'), '.',
                          CAST(p_partkey % 7 AS VARCHAR), '; ',
                          lpad(replace(p_brand, 'Brand#', ''), 4, '0'), '-1')
         END AS cnae_raw
  FROM part
)"""

_SHIPMENTS = """
shipments AS (
  SELECT CASE WHEN l_returnflag = 'R' THEN 'import' ELSE 'export' END AS flow,
         CAST(year(l_shipdate) AS BIGINT) AS "year",
         CAST(month(l_shipdate) AS BIGINT) AS "month",
         n_name AS state, s_name AS city,
         concat('Heading ', lpad(CAST(p_size AS VARCHAR), 4, '0')) AS heading,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS "metricFOB",
         CAST(l_quantity AS BIGINT) AS "metricKG",
         CAST(round(l_extendedprice * 100) AS BIGINT)
           + CAST(round(l_tax * 100) AS BIGINT) AS "metricCIF"
  FROM lineitem
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey
  JOIN part ON l_partkey = p_partkey
)"""

_VIEWS = {
    "exports": _EXPORTS,
    "country_product": _COUNTRY_PRODUCT,
    "trade_records": _TRADE_RECORDS,
    "bridge": _BRIDGE,
    "shipments": _SHIPMENTS,
}


def over(views: str, query: str, ctes: str = "") -> str:
    """SQL text: the named views (blank-separated), further CTEs, the query."""
    parts = [_VIEWS[name] for name in views.split()]
    if ctes:
        parts.append(ctes.strip().rstrip(","))
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n" + query.strip()
