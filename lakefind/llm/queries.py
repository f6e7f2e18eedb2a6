"""Imports every operator of the subpackage, which registers its query."""

from __future__ import annotations

import importlib

OPERATORS = ["line_dedup", "quality", "jaccard_join", "packing", "decontaminate", "language", "fingerprint", "secrets", "chat", "extraction",
             "toxicity", "merkle", "centroids"]

for _name in OPERATORS:
    importlib.import_module(f"lakefind.llm.{_name}")
