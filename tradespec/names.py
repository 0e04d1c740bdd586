"""Column names and texts that results must carry.

Fixed values: they are part of the results (table columns, scenario texts,
display headers) and are kept as data, in natural order.
"""

# Input columns of the exports table.
YEAR = "year"
STATE = "state"
CODE = "headingCode"
HEADING = "heading"
FOB = "metricFOB"

# Metric columns of the comparison table.
ENTITY_RCA = "VCR_Ceara_Brasil"
COUNTRY_RCA = "VCR_Brasil_Mundo"
PCI = "PCI"
DISTANCE = "Distancia_Parceiros"
ADJUSTED_RCA = "VCR_AJUSTADO"
PRIORITY = "INDICE_PRIORIDADE_AJUSTADO"
SCENARIO = "Cenário ID"
SCENARIO_TEXT = "Cenário Descrição"

COMPARISON_METRICS = (ENTITY_RCA, COUNTRY_RCA, PCI, DISTANCE)

# Default parameters.
DEFAULT_STATE = "Ceará"
DEFAULT_COUNTRY = "BRA"
SMALL_SHARE = 0.02
TOP_PRODUCTS = 15
WORLD_TOTAL_TEXT = "$49,71 Tri"
NOT_AVAILABLE = "Não disp."
MISSING_TEXT = "N/A"

SCENARIO_TEXTS = {
    "Cenário 1": "Setores com Vantagem Comparativa no Ceará e no Brasil",
    "Cenário 2": "Setores com Vantagem Comparativa apenas no Ceará",
    "Cenário 3": "Setores com Vantagem Comparativa apenas no Brasil",
    "Cenário 4": "Setores com Potencial de Vantagem Comparativa no Ceará e no Brasil",
    "Cenário 5": "Setores com Potencial de Vantagem Comparativa apenas no Ceará",
    "Cenário 6": "Setores com Potencial de Vantagem Comparativa apenas no Brasil",
    "Cenário 7": "Setores sem Vantagem Comparativa ou Potencial de Vantagem",
}

# Display headers, column -> header, in display order.
COMPARISON_HEADERS = {
    "headingCode": "HS4",
    "heading": "Produto",
    "Cenário ID": "Cenário",
    "ncm8": "NCMs",
    "cnae_raw": "CNAE",
    "INDICE_PRIORIDADE_AJUSTADO": "Prioridade",
    "VCR_Ceara_Brasil": "VCR Est.",
    "VCR_Brasil_Mundo": "VCR Nac.",
}

SELECTION_HEADERS = {
    "state": "Estado",
    "headingCode": "Código HS",
    "heading": "Descrição do Produto",
    "VCR": "VCR (Relevância Revelada)",
    "metricFOB": "Valor FOB (US$)",
}

COUNTRY_HEADERS = {
    "country_iso3_code": "País (ISO3)",
    "year": "Ano",
    "export_value": "Exportação Total (US$)",
    "import_value": "Importação Total (US$)",
    "global_share": "Share Global Médio",
    "export_rca": "VCR Médio",
    "distance": "Distância Média",
    "cog": "COG Médio",
    "pci": "PCI Médio",
    "product_id": "Qtd. Produtos HS",
}

LEGACY_HEADERS = {
    "headingCode": "Código HS",
    "heading": "Descrição",
    "VCR_Ceara_Brasil": "VCR estadual (Bruto)",
    "VCR_Ceara_Brasil_NORM": "VCR estadual normalizada",
    "VCR_Brasil_Mundo": "VCR país (Bruto)",
    "VCR_Brasil_Mundo_NORM": "VCR país normalizada",
    "Distancia_Parceiros": "distância entre parceiros (Bruto)",
    "Distancia_Parceiros_NORM": "distância entre parceiros normalizada",
    "PCI": "PCI (Bruto)",
    "PCI_NORM": "PCI normalizado",
    "VCR_AJUSTADO": "VCR Ajustado (Bruto)",
    "VCR_AJUSTADO_NORM": "VCR Ajustado normalizado",
    "INDICE_PRIORIDADE_AJUSTADO": "Índice de Prioridade Ajustado",
}

# The two sets of columns that the older table is shown with.
LEGACY_NORMALIZED = (
    "Código HS",
    "Descrição",
    "VCR estadual normalizada",
    "VCR país normalizada",
    "VCR Ajustado normalizado",
    "PCI normalizado",
    "distância entre parceiros normalizada",
    "Índice de Prioridade Ajustado",
)
LEGACY_RAW = (
    "Código HS",
    "Descrição",
    "VCR estadual (Bruto)",
    "VCR país (Bruto)",
    "VCR Ajustado (Bruto)",
    "PCI (Bruto)",
    "distância entre parceiros (Bruto)",
)
