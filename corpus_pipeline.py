"""The corpus pipeline: its code is in folioloom.llm.pipeline."""

from folioloom.llm.pipeline import ORACLE_SQL, STAGES, run  # noqa: F401
