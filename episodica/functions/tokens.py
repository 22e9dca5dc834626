"""Prompts as tokens of a piece model, cut or padded to one length."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodica.functions.text import clean_prompt, is_blank, state_prompt


def prompt_tokens(df: DataFrame, model: str, prompt: str = "prompt", state: Column | None = None, longest: int = 48) -> DataFrame:
    """Replaces the prompt by tokens (array<int>) and token_mask (array<boolean>) of length `longest`.

    With a state the text spells it out; without one a newline's tokens follow the text. Encoding starts with the begin token; padding is 0 and
    masked off; longer prompts are cut. An empty prompt is an error. The model's path must be readable on every worker.
    """
    text = clean_prompt(F.col(prompt)) if state is None else state_prompt(F.col(prompt), state)
    checked = F.when(is_blank(F.col(prompt)), F.raise_error(F.lit("a prompt is empty")).cast("string")).otherwise(text)
    plain = state is None

    @F.pandas_udf("array<int>")
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=model)
        end = own.encode("\n") if plain else []
        for part in parts:
            yield part.map(lambda t: ([own.bos_id(), *own.encode(t), *end])[:longest])

    tokens = df.withColumn("tokens", encode(checked))
    padded = F.concat("tokens", F.array_repeat(F.lit(0), longest - F.size("tokens")))
    mask = F.concat(F.array_repeat(F.lit(True), F.size("tokens")), F.array_repeat(F.lit(False), longest - F.size("tokens")))
    return tokens.withColumn("token_mask", mask).withColumn("tokens", padded).drop(prompt)
