"""Trade-specialization analytics as PySpark DataFrame operators.

Every operator takes and returns DataFrames and stays lazy: nothing in the
package collects rows, and nothing leaves the JVM for Python.
"""

from tradespec.plans.comparison import comparison_table, legacy_comparison_table
from tradespec.plans.country import country_summary, top_products
from tradespec.plans.selection import selection_report
from tradespec.plans.three_source import three_source_table
from tradespec.sources.tables import TradeTables

__all__ = [
    "TradeTables",
    "comparison_table",
    "country_summary",
    "legacy_comparison_table",
    "selection_report",
    "three_source_table",
    "top_products",
]
