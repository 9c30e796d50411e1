"""Sievework: a Spark-native engine for code-quality and text relations."""

from sievework.operators.analyse import analyse, diagnostics
from sievework.operators.catalog import RULES, Config, config_of

__version__ = "0.2.0"
__all__ = ["RULES", "Config", "analyse", "config_of", "diagnostics"]
