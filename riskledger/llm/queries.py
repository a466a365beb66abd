"""Registered queries of the package: name -> callable, name -> check SQL."""

import importlib

from riskledger.llm import common

MODULES = ("packing", "neighbours", "chat", "mixing", "token_counts", "vector_dedup", "minhash", "binary_output", "url_filter",
           "language", "piece_codec", "spelling", "fill_middle")


def load():
    for module in MODULES:
        importlib.import_module(f"riskledger.llm.{module}")
    return dict(common.QUERIES), dict(common.ORACLE)
