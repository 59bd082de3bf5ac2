"""Projections that keep only what a model reads."""

from __future__ import annotations

from ..operators import filters as R
from .fixtures import arr, with_ctes
from .registry import query
from .tokens import ROW_CTES, texts, token_rows


@query(with_ctes("vocab", f"SELECT {arr('ids')} AS input_ids, {arr('mask')} AS attention_mask FROM rows", ROW_CTES))
def select_model_columns(spark, sf):
    return texts(R.select_model_columns(token_rows(spark, sf)))


