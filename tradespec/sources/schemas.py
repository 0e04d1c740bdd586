"""Schemas of the input files.

Codes are strings so that leading zeros survive. Country ids and reference
periods use types wide enough for their values (a YYYYMMDD period needs more
than 16 bits). Column names and order are fixed values.
"""

from __future__ import annotations

EXPORTS = "year BIGINT, state STRING, headingCode STRING, heading STRING, metricFOB BIGINT"

COUNTRY_PRODUCT = """
    country_id INT, country_iso3_code STRING, product_id BIGINT,
    product_hs92_code STRING, year BIGINT, export_value BIGINT,
    import_value BIGINT, global_share DOUBLE, export_rca DOUBLE,
    distance DOUBLE, cog DOUBLE, pci DOUBLE
"""

TRADE_RECORDS = """
    typeCode STRING, freqCode STRING, refPeriodId BIGINT, refYear BIGINT,
    refMonth BIGINT, period BIGINT, reporterCode STRING, reporterISO STRING,
    reporterDesc STRING, flowCode STRING, flowDesc STRING, partnerCode STRING,
    partnerISO STRING, partnerDesc STRING, partner2Code STRING,
    partner2ISO STRING, partner2Desc STRING, classificationCode STRING,
    classificationSearchCode STRING, isOriginalClassification BOOLEAN,
    cmdCode STRING, cmdDesc STRING, aggrLevel INT, isLeaf BOOLEAN,
    customsCode STRING, customsDesc STRING, mosCode STRING, motCode STRING,
    motDesc STRING, qtyUnitCode STRING, qtyUnitAbbr STRING, qty DOUBLE,
    isQtyEstimated BOOLEAN, altQtyUnitCode STRING, altQtyUnitAbbr STRING,
    altQty DOUBLE, isAltQtyEstimated BOOLEAN, netWgt DOUBLE,
    isNetWgtEstimated BOOLEAN, grossWgt DOUBLE, isGrossWgtEstimated BOOLEAN,
    cifvalue DOUBLE, fobvalue DOUBLE, primaryValue DOUBLE,
    legacyEstimationFlag STRING, isReported BOOLEAN, isAggregate BOOLEAN
"""

BRIDGE = "ncm8_raw STRING, ncm_descricao STRING, cnae_raw STRING"
