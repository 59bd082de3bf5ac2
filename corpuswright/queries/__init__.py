"""The registered queries: every operator over the given tables, with a DuckDB twin where SQL can say it."""

from . import (  # noqa: F401
    denoising,
    evaluation,
    files,
    inputs,
    mixing,
    outputs,
    preferences,
    prompts,
    streams,
    tokens,
    losses,
)
from .registry import REGISTRY  # noqa: F401
