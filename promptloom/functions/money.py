"""Cost expressions."""

from __future__ import annotations

from pyspark.sql import Column

PER_MILLION = 1_000_000


def cost_usd(prompt_tokens: Column, output_tokens: Column, input_price: Column, output_price: Column) -> Column:
    """Dollars for a number of tokens at prices per million tokens."""
    return prompt_tokens / PER_MILLION * input_price + output_tokens / PER_MILLION * output_price
