"""SQL equivalents of the registered queries, written without looking at plans.

Each text runs on its own over the given parquet tables. Computed doubles are
compared at single precision: the engines add up in different orders, and exact
halves, which means of small fractions often are, would then round either way.
Rounding to twelve digits first only turns what should be 0 into 0.
"""

from __future__ import annotations

from verification.oracle_views import over

STATES = "('NATION_3', 'NATION_7', 'NATION_12')"
YEARS = "(1996, 1997, 1998)"

_EXPORT_COLUMNS = '"year", state, "headingCode", heading, "metricFOB"'

_MIXED = """
mixed AS (
  SELECT "year", state, heading, "metricFOB",
         CASE WHEN CAST("headingCode" AS INT) % 10 = 0 THEN '0'
              WHEN CAST("headingCode" AS INT) % 10 = 1 THEN '7'
              WHEN CAST("headingCode" AS INT) % 10 = 2 THEN NULL
              WHEN CAST("headingCode" AS INT) % 10 = 3
                THEN CAST(CAST("headingCode" AS INT) AS VARCHAR)
              ELSE "headingCode" END AS "headingCode"
  FROM exports
)"""


def _rca(source: str = "exports") -> str:
    return f"""
t AS (SELECT sum(CASE WHEN state = 'NATION_3' THEN "metricFOB" END) AS xe,
             sum("metricFOB") AS xw
      FROM {source} WHERE "metricFOB" > 0),
e AS (SELECT "headingCode" AS c, sum("metricFOB") AS v FROM {source}
      WHERE "metricFOB" > 0 AND state = 'NATION_3' AND "headingCode" IS NOT NULL
      GROUP BY 1),
w AS (SELECT "headingCode" AS c, sum("metricFOB") AS v FROM {source}
      WHERE "metricFOB" > 0 AND "headingCode" IS NOT NULL GROUP BY 1),
rca AS (
  SELECT coalesce(e.c, w.c) AS "headingCode",
         (coalesce(e.v, 0) * 1.0e0 / t.xe) / (coalesce(w.v, 0) * 1.0e0 / t.xw)
           AS "VCR_Ceara_Brasil"
  FROM e FULL OUTER JOIN w ON e.c = w.c, t
)"""


def _metrics(code: str = "product_hs92_code") -> str:
    return f"""
metrics AS (
  SELECT {code} AS "headingCode", avg(export_rca) AS "VCR_Brasil_Mundo",
         avg(pci) AS "PCI", avg(distance) AS "Distancia_Parceiros"
  FROM country_product GROUP BY 1
)"""


_NAMES = """
headings AS (SELECT DISTINCT "headingCode", heading FROM exports)"""

_JOINED = (
    _rca()
    + ","
    + _metrics()
    + ","
    + _NAMES
    + """,
joined AS (
  SELECT rca."headingCode", headings.heading, rca."VCR_Ceara_Brasil",
         metrics."VCR_Brasil_Mundo", metrics."PCI", metrics."Distancia_Parceiros"
  FROM rca LEFT JOIN metrics USING ("headingCode")
  LEFT JOIN headings USING ("headingCode")
)"""
)


def _scaled(column: str, source: str) -> str:
    """Min-max normalized column as an expression."""
    low = f"(SELECT min({column}) FROM {source})"
    high = f"(SELECT max({column}) FROM {source})"
    return (
        f"CASE WHEN {high} = {low} THEN 0.0e0 "
        f"ELSE ({column} - {low}) / ({high} - {low}) END"
    )


def _scaled_number(column: str, source: str) -> str:
    """The same with text read as numbers and 0 where there is none."""
    number = f"try_cast({column} AS DOUBLE)"
    low = f"(SELECT min({number}) FROM {source})"
    high = f"(SELECT max({number}) FROM {source})"
    return (
        f"CASE WHEN {high} = {low} OR {low} IS NULL THEN 0.0e0 "
        f"ELSE ({number} - {low}) / ({high} - {low}) END"
    )


_SCENARIO = """
CASE WHEN a >= 1 AND b >= 1 THEN 'Cenário 1'
     WHEN a >= 1 AND b < 1 THEN 'Cenário 2'
     WHEN a < 1 AND b >= 1 THEN 'Cenário 3'
     WHEN a >= 0.5 AND a < 1 AND b >= 0.5 AND b < 1 THEN 'Cenário 4'
     WHEN a >= 0.5 AND a < 1 AND b < 0.5 THEN 'Cenário 5'
     WHEN a < 0.5 AND b > 0 THEN 'Cenário 6'
     ELSE 'Cenário 7' END"""

_SCENARIO_TEXT = """
CASE s WHEN 'Cenário 1' THEN 'Setores com Vantagem Comparativa no Ceará e no Brasil'
       WHEN 'Cenário 2' THEN 'Setores com Vantagem Comparativa apenas no Ceará'
       WHEN 'Cenário 3' THEN 'Setores com Vantagem Comparativa apenas no Brasil'
       WHEN 'Cenário 4' THEN 'Setores com Potencial de Vantagem Comparativa no Ceará e no Brasil'
       WHEN 'Cenário 5' THEN 'Setores com Potencial de Vantagem Comparativa apenas no Ceará'
       WHEN 'Cenário 6' THEN 'Setores com Potencial de Vantagem Comparativa apenas no Brasil'
       WHEN 'Cenário 7' THEN 'Setores sem Vantagem Comparativa ou Potencial de Vantagem'
       END"""

_ROLLUP = """
coded AS (
  SELECT CASE WHEN length(c) < 8 THEN lpad(c, 8, '0') ELSE c END AS ncm8,
         ncm_descricao, cnae_raw
  FROM (SELECT regexp_replace(ncm8_raw, '\\.0$', '') AS c, ncm_descricao, cnae_raw
        FROM bridge)
),
rollup_codes AS (
  SELECT substr(ncm8, 1, 4) AS "headingCode",
         string_agg(DISTINCT ncm8, ', ' ORDER BY ncm8) AS ncm8,
         string_agg(DISTINCT cnae_raw, ', ' ORDER BY cnae_raw) AS cnae_raw
  FROM coded GROUP BY 1
)"""

_PAIRS = (
    _ROLLUP
    + """,
parts AS (
  SELECT ncm8, substr(ncm8, 1, 4) AS sh4, ncm_descricao,
         unnest(string_split(cnae_raw, ';')) AS part
  FROM coded
),
pairs AS (
  SELECT ncm8, sh4, ncm_descricao, cnae7
  FROM (SELECT ncm8, sh4, ncm_descricao,
               trim(regexp_replace(part, '[. -]', '', 'g')) AS cnae7 FROM parts)
  WHERE regexp_matches(cnae7, '^[0-9]+$')
)"""
)

_COMPARISON = (
    _JOINED
    + """,
filled AS (
  SELECT "headingCode", heading, "VCR_Ceara_Brasil",
         coalesce("VCR_Brasil_Mundo", 0) AS "VCR_Brasil_Mundo",
         coalesce("PCI", 0) AS "PCI",
         coalesce("Distancia_Parceiros", 0) AS "Distancia_Parceiros"
  FROM joined
),
normed AS (
  SELECT *,"""
    + ",".join(
        f'\n         {_scaled(chr(34) + c + chr(34), "filled")} AS "{c}_norm"'
        for c in ("VCR_Ceara_Brasil", "VCR_Brasil_Mundo", "PCI", "Distancia_Parceiros")
    )
    + """
  FROM filled
),
comparison AS (
  SELECT *, "X" + "Y" + "Z" + "AA" AS "INDICE_PRIORIDADE_AJUSTADO"
  FROM (SELECT *, """
    + _SCENARIO.replace("a ", '"VCR_Ceara_Brasil" ').replace("b ", '"VCR_Brasil_Mundo" ')
    + """ AS "Cenário ID",
               "VCR_Ceara_Brasil_norm" * 0.4e0 AS "X",
               "VCR_Brasil_Mundo_norm" * 0.3e0 AS "Y",
               "PCI_norm" * 0.3e0 AS "Z",
               "Distancia_Parceiros_norm" * 0.4e0 AS "AA"
        FROM normed)
)"""
)


def _single(*columns: str) -> str:
    """Columns at single precision."""
    return ", ".join(f'CAST(CAST(round("{c}", 12) AS FLOAT) AS DOUBLE) AS "{c}"' for c in columns)


_METRIC_COLUMNS = (
    "VCR_Ceara_Brasil", "VCR_Brasil_Mundo", "PCI", "Distancia_Parceiros",
)


def _legacy(source: str) -> str:
    """Legacy comparison over a given exports view."""
    return (
        _rca(source)
        + ","
        + _metrics("substr(product_hs92_code, 1, 4)")
        + f""",
reference AS (
  SELECT DISTINCT "headingCode", heading FROM {source}
  WHERE "headingCode" IS NOT NULL AND "headingCode" <> '0' AND length("headingCode") > 1
),
base AS (
  SELECT reference."headingCode", reference.heading, rca."VCR_Ceara_Brasil",
         metrics."VCR_Brasil_Mundo", metrics."PCI", metrics."Distancia_Parceiros",
         CASE WHEN coalesce(rca."VCR_Ceara_Brasil", 0) > 1
              THEN (coalesce(rca."VCR_Ceara_Brasil", 0) + coalesce(metrics."PCI", 0)) / 2
              ELSE coalesce(rca."VCR_Ceara_Brasil", 0) END AS "VCR_AJUSTADO"
  FROM reference LEFT JOIN rca USING ("headingCode")
  LEFT JOIN metrics USING ("headingCode")
),
legacy_norm AS (
  SELECT *,"""
        + ",".join(
            f'\n         {_scaled_number(chr(34) + c + chr(34), "base")} AS "{c}_NORM"'
            for c in (*_METRIC_COLUMNS, "VCR_AJUSTADO")
        )
        + """
  FROM base
),
legacy AS (
  SELECT * REPLACE (coalesce("PCI_NORM", 0) AS "PCI_NORM"),
    (coalesce("VCR_Ceara_Brasil_NORM", 0) * 0.4e0
     + coalesce("VCR_Brasil_Mundo_NORM", 0) * 0.3e0
     + coalesce("VCR_AJUSTADO_NORM", 0) * 0.3e0) / (0.4e0 + 0.3e0 + 0.3e0) * (1 / 1.7e0)
    + coalesce("PCI_NORM", 0) * (0.3e0 / 1.7e0)
    + (1 - coalesce("Distancia_Parceiros_NORM", 0)) * (0.4e0 / 1.7e0)
    AS "INDICE_PRIORIDADE_AJUSTADO"
  FROM legacy_norm
)"""
    )


_LEGACY_NUMBERS = (
    "VCR_Ceara_Brasil", "VCR_Ceara_Brasil_NORM", "VCR_Brasil_Mundo",
    "VCR_Brasil_Mundo_NORM", "Distancia_Parceiros", "Distancia_Parceiros_NORM", "PCI",
    "PCI_NORM", "VCR_AJUSTADO", "VCR_AJUSTADO_NORM", "INDICE_PRIORIDADE_AJUSTADO",
)


def _round3(column: str) -> str:
    return f"round_even({column} * 1000.0e0, 0) / 1000.0e0"


def _legacy_select() -> str:
    numeric = ", ".join(f"{_round3(chr(34) + c + chr(34))} AS \"{c}\"" for c in _LEGACY_NUMBERS)
    return f'SELECT "headingCode", heading, {numeric} FROM legacy'


def _selection_rca(selected: str, baseline: str) -> str:
    return f"""
sel AS (SELECT * FROM exports WHERE {selected}),
base AS (SELECT * FROM {baseline}),
bt AS (SELECT sum("metricFOB") AS v FROM base),
bp AS (SELECT "headingCode", sum("metricFOB") AS v FROM base GROUP BY 1),
st AS (SELECT state, sum("metricFOB") AS v FROM sel GROUP BY 1),
sp AS (SELECT state, "headingCode", sum("metricFOB") AS v FROM sel GROUP BY 1, 2),
headings AS (SELECT DISTINCT "headingCode", heading FROM exports),
selrca AS (
  SELECT sp.state, sp."headingCode", headings.heading,
         CAST(sp.v AS BIGINT) AS "metricFOB",
         (sp.v * 1.0e0 / st.v) / (bp.v * 1.0e0 / bt.v) AS "VCR"
  FROM sp JOIN st ON sp.state = st.state
  JOIN bp ON sp."headingCode" = bp."headingCode"
  LEFT JOIN headings ON sp."headingCode" = headings."headingCode", bt
)"""


_SEVERAL = f'state IN {STATES} AND "year" IN {YEARS}'

_SHARES = """
pairs AS (SELECT heading, state, CAST(sum("metricFOB") AS BIGINT) AS "metricFOB"
          FROM chosen GROUP BY 1, 2),
shares AS (SELECT *, "metricFOB" * 1.0e0 / (SELECT sum("metricFOB") FROM pairs) AS percentage
           FROM pairs)"""


def _lumped(threshold: str, percent: str) -> str:
    return f"""
SELECT heading, state, "metricFOB", CAST(CAST(round(percentage, 12) AS FLOAT) AS DOUBLE) AS percentage
FROM shares WHERE percentage >= {threshold}
UNION ALL
SELECT 'Demais/Outros (< {percent}%)', 'Agregado', CAST(sum("metricFOB") AS BIGINT),
       CAST(CAST(round(sum("metricFOB") * 1.0e0 / (SELECT sum("metricFOB") FROM pairs), 12) AS FLOAT) AS DOUBLE)
FROM shares WHERE percentage < {threshold} HAVING count(*) > 0"""


def _money(value: str, prefix: str = "$", tri: str = " Tri", bi: str = " Bi", mi: str = " Mi") -> str:
    def scaled(divisor: str, suffix: str) -> str:
        return f"concat(format('{{:,.2f}}', {value} / {divisor}), '{suffix}')"

    return f"""concat('{prefix}', translate(
    CASE WHEN {value} >= 1e12 THEN {scaled('1e12', tri)}
         WHEN {value} >= 1e9 THEN {scaled('1e9', bi)}
         WHEN {value} >= 1e6 THEN {scaled('1e6', mi)}
         ELSE format('{{:,.2f}}', {value}) END, ',.', '.,'))"""


_AMOUNTS = """
amounts AS (
  SELECT "metricFOB", factor, CAST("metricFOB" AS DOUBLE) * factor AS amount
  FROM exports, (SELECT unnest([0.01e0, 1.0e0, 1000.0e0, 1000000.0e0, -1.0e0]) AS factor)
)"""

_RCA_PAIRS = """
rca_pairs AS (
  SELECT country_iso3_code, product_hs92_code, "year",
         (export_value % 1301) * 1.0e0 / 500 AS a,
         CASE WHEN (import_value % 1201) * 1.0e0 / 500 > 2.3e0 THEN NULL
              WHEN (import_value % 1201) * 1.0e0 / 500 > 2.1e0 THEN 0.0e0
              ELSE (import_value % 1201) * 1.0e0 / 500 END AS b
  FROM country_product
)"""

_RECORDS = """
SELECT {columns} FROM trade_records
WHERE "typeCode" = 'C' AND "freqCode" = 'A' AND "classificationSearchCode" = 'HS'
  AND length("cmdCode") = 4 AND "flowCode" = 'X' AND "customsCode" = 'C00' {more}"""

_SOME_RECORDS = """
  AND period IN (1996, 1997) AND "partnerCode" IN ('1', '2', '3', '4', '5', '6')"""

_ALL_EXPORTS = over("exports", f"SELECT {_EXPORT_COLUMNS} FROM exports")
_LUMP_ONE_STATE = over(
    "exports",
    _lumped("0.02", "2"),
    "chosen AS (SELECT * FROM exports WHERE state = 'NATION_3')," + _SHARES,
)
_ROLLUP_QUERY = over("bridge", "SELECT * FROM rollup_codes", _ROLLUP)


_SPOILED = """spoiled AS (
  SELECT CASE WHEN "metricFOB" % 53 = 0 THEN 'n.d.' ELSE CAST("year" AS VARCHAR) END AS "year",
    state, "headingCode", heading,
    CASE "metricFOB" % 50 WHEN 0 THEN 'abc' WHEN 1 THEN '1e400'
      ELSE CAST("metricFOB" AS VARCHAR) END AS "metricFOB"
  FROM exports)"""

ORACLE_SQL: dict[str, str] = {
    # sources and sinks
    "src1_exports_csv": _ALL_EXPORTS,
    "src2_country_product_csv": over(
        "country_product",
        "SELECT * FROM country_product",
    ),
    "src3_trade_records_csv": over(
        "trade_records",
        """SELECT "typeCode", "refYear", "refMonth", period, "reporterISO", "flowCode",
        "partnerCode", "classificationCode", "cmdCode", "cmdDesc",
        CAST(NULL AS BOOLEAN) AS "isLeaf", qty,
        CAST("primaryValue" AS DOUBLE) AS "primaryValue" FROM trade_records""",
    ),
    "src4_inferred_csv": over(
        "exports",
        """SELECT "year", state, CAST("headingCode" AS BIGINT) AS "headingCode", heading,
        "metricFOB" FROM exports""",
    ),
    "src5_inferred_csv_with_text_codes": over(
        "country_product",
        """SELECT country_iso3_code, product_hs92_code, "year", export_value
        FROM country_product""",
    ),
    "src6_all_tables": over(
        "exports country_product trade_records",
        """SELECT 'exports' AS name, count(*) AS n_rows,
               CAST(sum("metricFOB") AS BIGINT) AS total FROM exports
        UNION ALL SELECT 'country_product', count(*), CAST(sum(export_value) AS BIGINT)
        FROM country_product
        UNION ALL SELECT 'trade_records', count(*), CAST(sum("primaryValue") AS BIGINT)
        FROM trade_records""",
    ),
    "src7_bridge_csv": over("bridge", "SELECT * FROM bridge"),
    "src8_bridge_first_three_columns": over("bridge", "SELECT * FROM bridge"),
    "src9_payload_rows": _ALL_EXPORTS,
    "src10_dataset_folder": over(
        "country_product",
        """SELECT country_iso3_code, product_hs92_code, "year", export_value
        FROM country_product WHERE "year" = (SELECT max("year") FROM country_product)""",
    ),
    "src10_dataset_all_tables": over(
        "exports",
        """SELECT 'exports.csv' AS name, count(*) AS n_rows FROM exports
        UNION ALL SELECT 'states.csv', count(DISTINCT state) FROM exports""",
    ),
    "snk1_csv_written_and_read": over(
        "trade_records",
        """SELECT "refYear", "reporterISO", "classificationCode", "cmdCode",
        CAST("primaryValue" AS DOUBLE) AS "primaryValue"
        FROM trade_records WHERE "classificationCode" = 'H4'""",
    ),
    "snk2_latin1_csv_written_and_read": over(
        "exports",
        """SELECT "year", concat('Ceará ', state) AS state, "headingCode", heading,
        "metricFOB" FROM exports""",
    ),
    # filters
    "flt1_positive_values": over(
        "exports",
        """SELECT "year", state, "headingCode", heading,
        "metricFOB" - 1000000 AS "metricFOB" FROM exports WHERE "metricFOB" > 1000000""",
    ),
    "flt2_one_entity": over(
        "exports", f"SELECT {_EXPORT_COLUMNS} FROM exports WHERE state = 'NATION_3'"
    ),
    "flt3_latest_year": over(
        "country_product",
        """SELECT country_iso3_code, product_hs92_code, "year", export_value
        FROM country_product WHERE "year" = (SELECT max("year") FROM country_product)""",
    ),
    "flt4_classification": over(
        "trade_records",
        """SELECT "reporterISO", "cmdCode", "classificationCode", "primaryValue"
        FROM trade_records WHERE "classificationCode" = 'H4'""",
    ),
    "flt5_membership": over(
        "exports", f"SELECT {_EXPORT_COLUMNS} FROM exports WHERE {_SEVERAL}"
    ),
    "flt6_code_range": over(
        "exports",
        f"""SELECT {_EXPORT_COLUMNS} FROM exports
        WHERE "headingCode" BETWEEN '0010' AND '0020'""",
    ),
    "flt7_valid_headings": over(
        "exports",
        f"""SELECT {_EXPORT_COLUMNS} FROM mixed
        WHERE "headingCode" IS NOT NULL AND "headingCode" <> '0'
          AND length("headingCode") > 1""",
        _MIXED,
    ),
    "flt8_four_digit_codes": over(
        "exports",
        f"""SELECT {_EXPORT_COLUMNS} FROM mixed
        WHERE regexp_matches("headingCode", '^[0-9]{{4}}$')""",
        _MIXED,
    ),
    "flt9_positive_rca": over(
        "exports",
        """SELECT "headingCode", CAST(CAST(round("VCR_Ceara_Brasil", 12) AS FLOAT) AS DOUBLE) AS "VCR_Ceara_Brasil"
        FROM rca WHERE "VCR_Ceara_Brasil" > 0""",
        _rca(),
    ),
    "flt10_client_rows": over(
        "bridge",
        """SELECT ncm8, sh4, ncm_descricao, cnae7 FROM pairs
        WHERE CAST(ncm8 AS BIGINT) % 3 = 0 AND cnae7 LIKE '%1'""",
        _PAIRS,
    ),
    "flt11_record_filter": over(
        "trade_records",
        _RECORDS.format(
            columns='period, "reporterISO", "partnerCode", "cmdCode", "motCode", "primaryValue"',
            more=_SOME_RECORDS,
        ),
    ),
    # projections and option lists
    "prj1_display_names": over(
        "exports",
        """SELECT state AS "Estado", "headingCode" AS "Código HS",
        heading AS "Descrição do Produto", "metricFOB" AS "Valor FOB (US$)" FROM exports""",
    ),
    "prj2_column_subset": over(
        "country_product",
        """SELECT "year", country_iso3_code, product_hs92_code, export_value
        FROM country_product""",
    ),
    "prj3_heading_reference": over(
        "exports",
        """SELECT DISTINCT CASE WHEN length("headingCode") < 4
          THEN lpad("headingCode", 4, '0') ELSE "headingCode" END AS "headingCode", heading
        FROM mixed""",
        _MIXED,
    ),
    "prj4_distinct_options": over(
        "exports", "SELECT DISTINCT state FROM exports ORDER BY 1"
    ),
    "prj4_distinct_years": over(
        "trade_records",
        """SELECT DISTINCT CAST("refYear" AS INT) AS "refYear" FROM trade_records ORDER BY 1""",
    ),
    "prj5_default_option": over(
        "exports",
        """SELECT 'NATION_3' AS state, TRUE AS preferred
        UNION ALL SELECT min(state), FALSE FROM exports""",
    ),
    "prj6_product_options": over(
        "exports",
        f"""SELECT DISTINCT concat("headingCode", ' - ', substr(heading, 1, 50), '...')
        AS "HS_Desc" FROM exports WHERE {_SEVERAL}""",
    ),
    "prj7_code_from_label": over(
        "exports",
        """SELECT DISTINCT concat("headingCode", ' - ', substr(heading, 1, 50), '...')
        AS "HS_Desc", "headingCode" FROM exports""",
    ),
    "prj8_numbers_with_three_digits": over(
        "country_product",
        'SELECT "year", country_iso3_code, product_hs92_code, '
        + ", ".join(
            f"{_round3(c)} AS {c}"
            for c in ("global_share", "export_rca", "distance", "cog", "pci")
        )
        + " FROM country_product",
    ),
    "prj9_missing_as_text": over(
        "exports",
        """SELECT DISTINCT coalesce("headingCode", 'N/A') AS "headingCode" FROM mixed""",
        _MIXED,
    ),
    "prj10_consistent_types": over(
        "exports country_product trade_records",
        """SELECT 'exports' AS source, CASE WHEN "year" % 5 <> 0 THEN "year" END AS "year",
        CAST(try_cast("headingCode" AS BIGINT) AS VARCHAR) AS code, count(*) AS n_rows
        FROM exports GROUP BY 1, 2, 3
        UNION ALL
        SELECT 'country_product', CASE WHEN "year" % 5 <> 0 THEN "year" END,
        product_hs92_code, count(*) FROM country_product GROUP BY 1, 2, 3
        UNION ALL
        SELECT 'trade_records', "refYear", CAST(try_cast("cmdCode" AS BIGINT) AS VARCHAR),
        count(*) FROM trade_records GROUP BY 1, 2, 3""",
    ),
    # joins
    "jn1_entity_and_whole_sums": over(
        "exports",
        """SELECT coalesce(e.c, w.c) AS "headingCode",
        CAST(coalesce(e.v, 0) AS BIGINT) AS entity_value,
        CAST(coalesce(w.v, 0) AS BIGINT) AS whole_value
        FROM e FULL OUTER JOIN w ON e.c = w.c""",
        _rca(),
    ),
    "jn2_rca_joined_to_metrics": over(
        "exports country_product",
        f'SELECT "headingCode", heading, {_single(*_METRIC_COLUMNS)} FROM joined',
        _JOINED,
    ),
    "jn3_reference_joined_to_metrics": over(
        "exports country_product",
        f'SELECT "headingCode", heading, {_single(*_METRIC_COLUMNS)} FROM base',
        _MIXED + "," + _legacy("mixed"),
    ),
    "jn4_attach_codes": over(
        "exports bridge",
        """SELECT e."headingCode", r.ncm8, r.cnae_raw
        FROM (SELECT DISTINCT "headingCode" FROM exports) e
        LEFT JOIN rollup_codes r ON e."headingCode" = r."headingCode" """,
        _ROLLUP,
    ),
    "jn5_local_and_baseline_share": over(
        "exports",
        """SELECT sp.state, sp."headingCode", CAST(sp.v AS BIGINT) AS "metricFOB",
        CAST(CAST(round(sp.v * 1.0e0 / st.v, 12) AS FLOAT) AS DOUBLE) AS local_share,
        CAST(CAST(round(bp.v * 1.0e0 / (SELECT sum("metricFOB") FROM exports), 12) AS FLOAT) AS DOUBLE) AS baseline_share
        FROM (SELECT state, "headingCode", sum("metricFOB") AS v FROM exports GROUP BY 1, 2) sp
        LEFT JOIN (SELECT state, sum("metricFOB") AS v FROM exports GROUP BY 1) st
          ON sp.state = st.state
        LEFT JOIN (SELECT "headingCode", sum("metricFOB") AS v FROM exports GROUP BY 1) bp
          ON sp."headingCode" = bp."headingCode" """,
    ),
    "jn6_attach_descriptions": over(
        "exports",
        """SELECT rca."headingCode", CAST(CAST(round("VCR_Ceara_Brasil", 12) AS FLOAT) AS DOUBLE) AS "VCR_Ceara_Brasil",
        heading FROM rca LEFT JOIN headings ON rca."headingCode" = headings."headingCode" """,
        _rca() + "," + _NAMES,
    ),
    "jn7_three_key_join": over(
        "country_product trade_records",
        """SELECT c.product_hs92_code, c."year", c.country_iso3_code, c.export_value,
        r."flowCode", r."partnerCode", r.qty, r."primaryValue"
        FROM country_product c LEFT JOIN trade_records r
          ON c.product_hs92_code = r."cmdCode" AND c."year" = r."refYear"
         AND c.country_iso3_code = r."reporterISO" """,
    ),
    "jn7_hot_key_join": over(
        "country_product trade_records",
        """SELECT p.code, CAST(p.v AS BIGINT) AS export_value, r."flowCode", r."partnerCode",
        r.qty, r."primaryValue"
        FROM (
          SELECT product_hs92_code AS code, sum(export_value) AS v
          FROM country_product GROUP BY 1
          UNION ALL SELECT '0000', 0 UNION ALL SELECT '9999', 0) p
        LEFT JOIN trade_records r
        ON p.code = CASE WHEN r."refMonth" % 3 = 0 THEN '0000' ELSE r."cmdCode" END """,
    ),
    "src1_rejected_cells": over(
        "exports",
        """SELECT "column", "text", 'unfit' AS reason, record FROM (
          SELECT unnest(["year", "metricFOB"]) AS "text", unnest(['year', 'metricFOB']) AS "column",
            concat("year", ',', state, ',', "headingCode", ',', heading, ',', "metricFOB") AS record
          FROM spoiled)
        WHERE "text" IN ('n.d.', 'abc', '1e400')""",
        _SPOILED,
    ),
    "src1_reject_counts": over(
        "exports",
        """SELECT count(*) AS "rows",
        CAST(count(*) FILTER ("year" = 'n.d.' OR "metricFOB" IN ('abc', '1e400')) AS BIGINT)
          AS rejected_rows,
        CAST(count(*) FILTER ("year" = 'n.d.') + count(*) FILTER ("metricFOB" IN ('abc', '1e400'))
          AS BIGINT) AS rejected_cells
        FROM spoiled""",
        _SPOILED,
    ),
    "src9_unknown_fields": over(
        "exports",
        """SELECT "year", state, CAST(NULL AS VARCHAR) AS "headingCode",
        CAST(NULL AS VARCHAR) AS heading, "metricFOB", heading AS more FROM exports""",
    ),
    "jn8_code_and_year_join": over(
        "exports country_product",
        """SELECT c.product_hs92_code, c."year", c.country_iso3_code, c.export_value,
        CAST(x.v AS BIGINT) AS "total_metricFOB", x.n AS state_records_count
        FROM country_product c LEFT JOIN (
          SELECT "headingCode", "year", sum("metricFOB") AS v, count(*) AS n
          FROM exports GROUP BY 1, 2) x
        ON c.product_hs92_code = x."headingCode" AND c."year" = x."year" """,
    ),
    "jn9_scalar_total": over(
        "exports",
        """SELECT state, CAST(sum("metricFOB") AS BIGINT) AS "metricFOB",
        CAST(CAST(round(sum("metricFOB") * 1.0e0 / (SELECT sum("metricFOB") FROM exports), 12) AS FLOAT) AS DOUBLE) AS share
        FROM exports GROUP BY state""",
    ),
    "jn10_semi_join": over(
        "exports bridge",
        """SELECT "headingCode", "year", state, heading, "metricFOB" FROM exports
        WHERE "headingCode" IN (SELECT substr(ncm8_raw, 1, 4) FROM bridge
                                WHERE ncm_descricao LIKE 'small%')""",
    ),
    # aggregations
    "ag1_sums_per_product": over(
        "exports",
        """SELECT "headingCode", CAST(sum("metricFOB") AS BIGINT) AS "metricFOB"
        FROM exports GROUP BY 1""",
    ),
    "ag2_global_sums": over(
        "exports",
        """SELECT CAST(sum("metricFOB") AS BIGINT) AS total FROM exports
        UNION ALL SELECT CAST(0 AS BIGINT)""",
    ),
    "ag3_sums_per_state_and_product": over(
        "exports",
        """SELECT state, "headingCode", CAST(sum("metricFOB") AS BIGINT) AS "metricFOB"
        FROM exports GROUP BY 1, 2""",
    ),
    "ag4_country_rca": over(
        "country_product",
        f'SELECT "headingCode", {_single("VCR_Brasil_Mundo")} FROM metrics',
        _metrics(),
    ),
    "ag4_country_rca_of_one_country": over(
        "country_product",
        """SELECT substr(product_hs92_code, 1, 4) AS "headingCode",
        CAST(CAST(round(avg(export_rca), 12) AS FLOAT) AS DOUBLE) AS "VCR_Brasil_Mundo"
        FROM country_product WHERE country_iso3_code = 'N03' GROUP BY 1""",
    ),
    "ag5_complexity_and_distance": over(
        "country_product",
        f'SELECT "headingCode", {_single("PCI", "Distancia_Parceiros")} FROM metrics',
        _metrics(),
    ),
    "ag6_country_year_summary": over(
        "country_product",
        """SELECT country_iso3_code, "year",
        CAST(sum(export_value) AS BIGINT) AS export_value,
        CAST(sum(import_value) AS BIGINT) AS import_value,
        CAST(CAST(round(avg(global_share), 12) AS FLOAT) AS DOUBLE) AS global_share, CAST(CAST(round(avg(export_rca), 12) AS FLOAT) AS DOUBLE) AS export_rca,
        CAST(CAST(round(avg(distance), 12) AS FLOAT) AS DOUBLE) AS distance, CAST(CAST(round(avg(cog), 12) AS FLOAT) AS DOUBLE) AS cog,
        CAST(CAST(round(avg(pci), 12) AS FLOAT) AS DOUBLE) AS pci, count(product_id) AS product_id
        FROM country_product GROUP BY 1, 2""",
    ),
    "ag7_ag8_product_exports": over(
        "country_product",
        """SELECT product_hs92_code, CAST(sum(export_value) AS BIGINT) AS total_export,
        CAST(CAST(round(avg(pci), 12) AS FLOAT) AS DOUBLE) AS average_pci,
        CAST(CAST(round(sum(export_value) * 1.0e0 / (SELECT sum(export_value) FROM country_product), 12) AS FLOAT) AS DOUBLE)
          AS proportion
        FROM country_product GROUP BY 1""",
    ),
    "ag9_heading_shares": over(
        "exports",
        """SELECT heading, state, "metricFOB", CAST(CAST(round(percentage, 12) AS FLOAT) AS DOUBLE) AS percentage
        FROM shares""",
        "chosen AS (SELECT * FROM exports)," + _SHARES,
    ),
    "ag10_codes_per_heading": _ROLLUP_QUERY,
    "ag11_value_by_description": over(
        "trade_records",
        """SELECT "cmdDesc", CAST(sum("primaryValue") AS BIGINT) AS "primaryValue",
        CAST(CAST(round(sum("primaryValue") * 1.0e0
              / (SELECT sum("primaryValue") FROM trade_records), 12) AS FLOAT) AS DOUBLE) AS share
        FROM trade_records GROUP BY 1""",
    ),
    "ag12_exports_by_state": over(
        "exports",
        """SELECT state, CAST(sum("metricFOB") AS BIGINT) AS "metricFOB"
        FROM exports GROUP BY 1""",
    ),
    "ag13_trade_by_year": over(
        "country_product",
        """SELECT "year", CAST(sum(export_value) AS BIGINT) AS export_value,
        CAST(sum(import_value) AS BIGINT) AS import_value FROM country_product GROUP BY 1""",
    ),
    "ag14_records_by_year": over(
        "trade_records",
        """SELECT "refYear", CAST(sum("primaryValue") AS BIGINT) AS "primaryValue"
        FROM trade_records GROUP BY 1""",
    ),
    "ag15_exports_by_code_and_year": over(
        "exports",
        """SELECT "headingCode", "year", CAST(sum("metricFOB") AS BIGINT) AS "total_metricFOB",
        count(*) AS state_records_count FROM exports GROUP BY 1, 2""",
    ),
    "ag16_number_of_states": over(
        "exports",
        f"""SELECT states, states = 1 AS one_state FROM (
        SELECT count(DISTINCT coalesce(state, '')) AS states FROM exports WHERE state = 'NATION_3'
        UNION ALL
        SELECT count(DISTINCT coalesce(state, '')) FROM exports WHERE {_SEVERAL}
        UNION ALL
        SELECT count(DISTINCT coalesce(state, '')) FROM exports)""",
    ),
    "ag17_cube": over(
        "shipments",
        f"""SELECT "year", state, heading, CAST(sum("metricFOB") AS BIGINT) AS "metricFOB",
        CAST(sum("metricKG") AS BIGINT) AS "metricKG",
        CAST(sum("metricCIF") AS BIGINT) AS "metricCIF"
        FROM shipments WHERE flow = 'export' AND state IN {STATES}
          AND concat("year", '-', lpad(CAST("month" AS VARCHAR), 2, '0'))
              BETWEEN '1996-03' AND '1998-10'
        GROUP BY 1, 2, 3""",
    ),
    "ag17_cube_by_month": over(
        "shipments",
        """SELECT "year", "month", state, CAST(sum("metricFOB") AS BIGINT) AS "metricFOB"
        FROM shipments WHERE flow = 'import' AND "year" BETWEEN 1995 AND 1999
        GROUP BY 1, 2, 3""",
    ),
    "ag18_cube_by_city": over(
        "shipments",
        """SELECT "year", city, CAST(sum("metricFOB") AS BIGINT) AS "metricFOB",
        CAST(sum("metricKG") AS BIGINT) AS "metricKG",
        CAST(sum("metricCIF") AS BIGINT) AS "metricCIF"
        FROM shipments WHERE flow = 'export' AND state = 'NATION_3' AND "year" = 1997
        GROUP BY 1, 2""",
    ),
    "ag19_count_only": over(
        "trade_records",
        _RECORDS.format(columns='count(*) AS "count"', more=_SOME_RECORDS),
    ),
    "ag20_aggregate_by": over(
        "trade_records",
        _RECORDS.format(
            columns=""""reporterISO", "refYear",
            CAST(sum("primaryValue") AS BIGINT) AS "primaryValue",
            CAST(CAST(round(sum("netWgt"), 12) AS FLOAT) AS DOUBLE) AS "netWgt", CAST(CAST(round(sum(qty), 12) AS FLOAT) AS DOUBLE) AS qty""",
            more='GROUP BY "reporterISO", "refYear"',
        ),
    ),
    # domain operators
    "dom1_entity_rca": over(
        "exports", f'SELECT "headingCode", {_single("VCR_Ceara_Brasil")} FROM rca', _rca()
    ),
    "dom2_selection_rca_one_state": over(
        "exports",
        """SELECT state, "headingCode", heading, "metricFOB", CAST(CAST(round("VCR", 12) AS FLOAT) AS DOUBLE) AS "VCR"
        FROM selrca WHERE "VCR" > 0""",
        _selection_rca("state = 'NATION_3'", "exports"),
    ),
    "dom2_selection_rca_several_states": over(
        "exports",
        """SELECT state, "headingCode", heading, "metricFOB", CAST(CAST(round("VCR", 12) AS FLOAT) AS DOUBLE) AS "VCR"
        FROM selrca WHERE "VCR" > 0""",
        _selection_rca(_SEVERAL, "sel"),
    ),
    "dom3_zero_baseline": over(
        "exports",
        f"""SELECT DISTINCT state, "headingCode", heading, CAST(0 AS BIGINT) AS "metricFOB",
        0.0e0 AS "VCR" FROM exports WHERE {_SEVERAL}""",
    ),
    "dom4_min_max": over(
        "country_product",
        'SELECT "headingCode", '
        + _single("VCR_Brasil_Mundo", "PCI", "Distancia_Parceiros")
        + "".join(
            f', CAST(CAST(round({_scaled(chr(34) + c + chr(34), "metrics")}, 12) AS FLOAT) AS DOUBLE) AS "{c}_norm"'
            for c in ("VCR_Brasil_Mundo", "PCI", "Distancia_Parceiros")
        )
        + " FROM metrics",
        _metrics(),
    ),
    "dom5_min_max_of_text": over(
        "exports",
        'SELECT "headingCode", heading, n_rows'
        + "".join(
            f', CAST(CAST(round({_scaled_number(c, "texts")}, 12) AS FLOAT) AS DOUBLE) AS "{n}_NORM"'
            for c, n in (
                ('"headingCode"', "headingCode"), ("heading", "heading"), ("n_rows", "n_rows"),
            )
        )
        + " FROM texts",
        _MIXED
        + """,
texts AS (
  SELECT CASE WHEN "headingCode" = '7' THEN 'seven' ELSE "headingCode" END AS "headingCode",
         heading, count(*) AS n_rows
  FROM mixed GROUP BY 1, 2
)""",
    ),
    "dom6_scenarios": over(
        "country_product",
        f"""SELECT country_iso3_code, product_hs92_code, "year",
        a AS "VCR_Ceara_Brasil", b AS "VCR_Brasil_Mundo", {_SCENARIO} AS "Cenário ID"
        FROM rca_pairs""",
        _RCA_PAIRS,
    ),
    "dom7_scenario_texts": over(
        "country_product",
        f"""SELECT s AS "Cenário ID", {_SCENARIO_TEXT} AS "Cenário Descrição",
        count(*) AS n_rows
        FROM (SELECT {_SCENARIO} AS s FROM rca_pairs) GROUP BY s""",
        _RCA_PAIRS,
    ),
    "dom8_linear_priority": over(
        "exports country_product",
        'SELECT "headingCode", '
        + _single("X", "Y", "Z", "AA", "INDICE_PRIORIDADE_AJUSTADO")
        + " FROM comparison",
        _COMPARISON,
    ),
    "dom9_nested_priority": over(
        "exports country_product",
        f'SELECT "headingCode", {_single("INDICE_PRIORIDADE_AJUSTADO")} FROM legacy',
        _legacy("exports"),
    ),
    "dom10_nested_priority_two_rcas": over(
        "exports country_product",
        """SELECT "headingCode", CAST(CAST(round(
          ("VCR_Ceara_Brasil_norm" * 0.5e0 + "VCR_Brasil_Mundo_norm" * 0.5e0) * (1 / 1.7e0)
          + "PCI_norm" * (0.3e0 / 1.7e0)
          + (1 - "Distancia_Parceiros_norm") * (0.4e0 / 1.7e0), 12) AS FLOAT) AS DOUBLE)
          AS "INDICE_PRIORIDADE_AJUSTADO" FROM comparison""",
        _COMPARISON,
    ),
    "dom11_adjusted_rca": over(
        "exports country_product",
        f'SELECT "headingCode", {_single("VCR_AJUSTADO", "VCR_AJUSTADO_NORM")} FROM legacy',
        _legacy("exports"),
    ),
    "dom12_comparison_table": over(
        "exports country_product bridge",
        f"""SELECT comparison."headingCode", heading,
        {_single(*_METRIC_COLUMNS, *[c + "_norm" for c in _METRIC_COLUMNS],
                  "X", "Y", "Z", "AA", "INDICE_PRIORIDADE_AJUSTADO")},
        s AS "Cenário ID", {_SCENARIO_TEXT} AS "Cenário Descrição",
        rollup_codes.ncm8, rollup_codes.cnae_raw
        FROM (SELECT *, "Cenário ID" AS s FROM comparison) comparison
        LEFT JOIN rollup_codes ON comparison."headingCode" = rollup_codes."headingCode" """,
        _COMPARISON + "," + _ROLLUP,
    ),
    "dom12_comparison_view": over(
        "exports country_product bridge",
        """SELECT comparison."headingCode" AS "HS4", heading AS "Produto",
        "Cenário ID" AS "Cenário", rollup_codes.ncm8 AS "NCMs",
        rollup_codes.cnae_raw AS "CNAE",
        CAST(CAST(round("INDICE_PRIORIDADE_AJUSTADO", 12) AS FLOAT) AS DOUBLE) AS "Prioridade",
        CAST(CAST(round("VCR_Ceara_Brasil", 12) AS FLOAT) AS DOUBLE) AS "VCR Est", CAST(CAST(round("VCR_Brasil_Mundo", 12) AS FLOAT) AS DOUBLE) AS "VCR Nac"
        FROM comparison
        LEFT JOIN rollup_codes ON comparison."headingCode" = rollup_codes."headingCode"
        WHERE comparison."headingCode" BETWEEN '0005' AND '0045'
          AND "Cenário ID" IN ('Cenário 1', 'Cenário 4')""",
        _COMPARISON + "," + _ROLLUP,
    ),
    "dom13_legacy_comparison_table": over(
        "exports country_product", _legacy_select(), _legacy("exports")
    ),
    "dom14_legacy_comparison_mixed_codes": over(
        "exports country_product", _legacy_select(), _MIXED + "," + _legacy("mixed")
    ),
    "dom15_lump_small_shares": _LUMP_ONE_STATE,
    "dom15_lump_small_shares_all_states": over(
        "exports",
        _lumped("0.0002", "0"),
        "chosen AS (SELECT * FROM exports)," + _SHARES,
    ),
    "dom16_product_activities": over("bridge", "SELECT * FROM pairs", _PAIRS),
    "dom17_bridge_rollup": _ROLLUP_QUERY,
    "dom18_without_bridge": over(
        "exports country_product",
        """SELECT "headingCode", "Cenário ID", 'Não disp.' AS ncm8, 'Não disp.' AS cnae_raw
        FROM comparison""",
        _COMPARISON,
    ),
    "dom19_headline_numbers": over(
        "exports",
        f"""SELECT CAST(s AS BIGINT) AS selected_total, CAST(o AS BIGINT) AS overall_total,
        {_money("s")} AS selected_text, {_money("o")} AS overall_text,
        '$49,71 Tri' AS world_text
        FROM (SELECT CAST(sum(CASE WHEN {_SEVERAL} THEN "metricFOB" END) AS DOUBLE) AS s,
                     CAST(sum("metricFOB") AS DOUBLE) AS o FROM exports)""",
    ),
    "dom20_three_source_table": over(
        "exports country_product trade_records",
        """SELECT c.product_hs92_code, c."year", c.country_iso3_code, c.export_value,
        r."flowCode", r."partnerCode", r."primaryValue",
        CAST(x.v AS BIGINT) AS "total_metricFOB", x.n AS state_records_count
        FROM country_product c LEFT JOIN trade_records r
          ON c.product_hs92_code = r."cmdCode" AND c."year" = r."refYear"
         AND c.country_iso3_code = r."reporterISO"
        LEFT JOIN (SELECT "headingCode", "year", sum("metricFOB") AS v, count(*) AS n
                   FROM exports GROUP BY 1, 2) x
          ON c.product_hs92_code = x."headingCode" AND c."year" = x."year" """,
    ),
    # reports, sorts, limits, sets
    "srt1_ranked_by_priority": over(
        "exports country_product",
        f"""SELECT "headingCode", {_single("INDICE_PRIORIDADE_AJUSTADO")}
        FROM comparison ORDER BY 2 DESC""",
        _COMPARISON,
    ),
    "srt2_legacy_view": over(
        "exports country_product",
        """SELECT "headingCode" AS "Código HS", heading AS "Descrição",
        "PCI" IS NULL AS pci_missing, "VCR_Brasil_Mundo" IS NULL AS rca_missing
        FROM legacy""",
        _MIXED + "," + _legacy("mixed"),
    ),
    "srt3_selection_view": over(
        "exports",
        f"""SELECT state AS "Estado", "headingCode" AS "Código HS",
        heading AS "Descrição do Produto", {_round3('"VCR"')} AS "VCR (Relevância Revelada)",
        {_money('CAST("metricFOB" AS DOUBLE)')} AS "Valor FOB (US$)"
        FROM selrca WHERE "VCR" > 0""",
        _selection_rca(_SEVERAL, "sel"),
    ),
    "srt4_selection_bars": _LUMP_ONE_STATE,
    "top1_top_products": over(
        "country_product",
        """SELECT product_hs92_code, total_export, average_pci, proportion,
        concat(format('{:.2f}', share * 100.0e0), '%') AS proportion_text
        FROM (SELECT product_hs92_code, CAST(sum(export_value) AS BIGINT) AS total_export,
              CAST(CAST(round(avg(pci), 12) AS FLOAT) AS DOUBLE) AS average_pci,
              sum(export_value) * 1.0e0 / (SELECT sum(export_value) FROM country_product) AS share,
              CAST(CAST(round(sum(export_value) * 1.0e0
                    / (SELECT sum(export_value) FROM country_product), 12) AS FLOAT) AS DOUBLE) AS proportion
              FROM country_product GROUP BY 1)
        ORDER BY total_export DESC, product_hs92_code LIMIT 15""",
    ),
    "lim1_first_rows": over(
        "exports",
        f"SELECT {_EXPORT_COLUMNS} FROM exports ORDER BY {_EXPORT_COLUMNS} LIMIT 5",
    ),
    "set1_lumped_row_over_all_states": over(
        "exports",
        _lumped("0.001", "0"),
        "chosen AS (SELECT * FROM exports)," + _SHARES,
    ),
    "set2_distinct_rows": over(
        "trade_records",
        'SELECT DISTINCT "reporterISO", "cmdCode", "cmdDesc" FROM trade_records',
    ),
    "trade_records_report_shares": over(
        "trade_records",
        """SELECT "cmdDesc", CAST(v AS BIGINT) AS "primaryValue",
        CAST(CAST(round(v * 1.0e0 / sum(v) OVER (), 12) AS FLOAT) AS DOUBLE) AS share
        FROM (SELECT "cmdDesc", sum("primaryValue") AS v FROM trade_records
              WHERE "refYear" IN (1996, 1997, 1998)
                AND "cmdCode" IN ('0011', '0023', '0034', '0042', '0105') GROUP BY 1)""",
    ),
    "trade_records_report_table": over(
        "trade_records",
        """SELECT "refYear", "cmdCode", "cmdDesc", "reporterISO", "flowCode", "partnerCode",
        "primaryValue" FROM trade_records WHERE "refYear" IN (1996, 1997, 1998)""",
    ),
    "country_summary_view": over(
        "country_product",
        'SELECT country_iso3_code AS "País (ISO3)", "year" AS "Ano", '
        + ", ".join(
            _money(f"CAST(sum({c}) AS DOUBLE)", "$", "T", "B", "M") + f' AS "{h}"'
            for c, h in (
                ("export_value", "Exportação Total (US$)"),
                ("import_value", "Importação Total (US$)"),
            )
        )
        + ", "
        + ", ".join(
            f'{_round3(f"avg({c})")} AS "{h}"'
            for c, h in (
                ("global_share", "Share Global Médio"), ("export_rca", "VCR Médio"),
                ("distance", "Distância Média"), ("cog", "COG Médio"), ("pci", "PCI Médio"),
            )
        )
        + f""", count(product_id) AS "Qtd. Produtos HS" FROM country_product
        WHERE "year" IN {YEARS} AND country_iso3_code IN ('N03', 'N07') GROUP BY 1, 2""",
    ),
    # scalar functions
    "sc1_money_text": over(
        "exports",
        f'SELECT "metricFOB", factor, {_money("amount")} AS text FROM amounts',
        _AMOUNTS,
    ),
    "sc2_money_text_without_sign": over(
        "exports",
        f'SELECT "metricFOB", factor, {_money("amount", "")} AS text FROM amounts',
        _AMOUNTS,
    ),
    "sc3_money_text_tight": over(
        "exports",
        f"""SELECT "metricFOB", factor, {_money("amount", "$", "T", "B", "M")} AS text
        FROM amounts""",
        _AMOUNTS,
    ),
    "sc4_zero_pad": over(
        "bridge",
        "SELECT ncm8_raw, lpad(substr(ncm8_raw, 3, 3), 8, '0') AS padded, "
        "ncm8_raw AS kept FROM bridge",
    ),
    "sc5_prefix": over("bridge", "SELECT ncm8_raw, substr(ncm8_raw, 1, 4) AS prefix FROM bridge"),
    "sc6_strip_decimals": over(
        "bridge", "SELECT ncm8_raw, regexp_replace(ncm8_raw, '\\.0$', '') AS code FROM bridge"
    ),
    "sc7_strip_marks": over(
        "bridge",
        "SELECT ncm8_raw, regexp_replace(cnae_raw, '[. -]', '', 'g') AS code FROM bridge",
    ),
    "sc8_split_and_explode": over(
        "bridge", "SELECT ncm8_raw, unnest(string_split(cnae_raw, ';')) AS part FROM bridge"
    ),
    "sc9_all_digits": over(
        "bridge",
        "SELECT ncm8_raw, regexp_matches(ncm8_raw, '^[0-9]+$') AS digits FROM bridge",
    ),
    "sc10_length": over("bridge", "SELECT ncm8_raw, length(ncm8_raw) AS size FROM bridge"),
    "sc11_concatenate": over(
        "bridge",
        """SELECT ncm8_raw,
        concat(ncm8_raw, ' - ', substr(ncm_descricao, 1, 50), '...') AS label,
        concat_ws(', ', ncm8_raw, ncm_descricao) AS joined FROM bridge""",
    ),
    "sc12_to_number": over(
        "bridge",
        """SELECT ncm8_raw, try_cast(ncm8_raw AS DOUBLE) AS product,
        try_cast(cnae_raw AS DOUBLE) AS activity,
        CAST(try_cast(ncm8_raw AS DOUBLE) AS BIGINT) AS whole FROM bridge""",
    ),
    "sc13_guarded_division": over(
        "exports",
        """SELECT "metricFOB", CASE WHEN "metricFOB" % 7 = 0 THEN 0.0e0
        ELSE CAST(CAST(round("metricFOB" * 1.0e0 / ("metricFOB" % 7), 12) AS FLOAT) AS DOUBLE) END AS ratio FROM exports""",
    ),
    "sc14_round_and_percent": over(
        "exports",
        f"""SELECT heading, state, {_round3("percentage")} AS rounded,
        concat(format('{{:.2f}}', percentage * 100.0e0), '%') AS text FROM shares""",
        "chosen AS (SELECT * FROM exports)," + _SHARES,
    ),
    "sc15_fill_missing": over(
        "exports",
        """SELECT "metricFOB", coalesce(try_cast("headingCode" AS DOUBLE), 0.0e0) AS number
        FROM mixed""",
        _MIXED,
    ),
    "sc16_year_bounds": over(
        "exports",
        """SELECT DISTINCT "year", concat("year", '-01') AS "first",
        concat("year", '-12') AS "last" FROM exports""",
    ),
}
