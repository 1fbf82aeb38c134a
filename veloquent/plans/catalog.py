"""All queries of the core by name, and their oracles."""

from __future__ import annotations

from veloquent.plans import files, speech, texts, training, usage

QUERIES = {**usage.QUERIES, **texts.QUERIES, **speech.QUERIES, **files.QUERIES, **training.QUERIES}
ORACLES = {**usage.ORACLES, **texts.ORACLES, **speech.ORACLES, **files.ORACLES, **training.ORACLES}
