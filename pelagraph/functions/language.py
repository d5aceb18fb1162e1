"""Functions that need an index's tokenizer or the session's embedding provider."""

from __future__ import annotations

from pyspark.sql import Column

from pelagraph.functions import vectors
from pelagraph.functions.registry import Context, register


@register("tokenize")
def tokenize(ctx: Context, text: Column) -> Column:
    from pelagraph.operators.search import tokens

    return tokens(text)


@register("stem")
def stem(ctx: Context, word: Column) -> Column:
    from pelagraph.operators.search import stem as run

    return run(word)


@register("llm_embed", "llm_embed_batch")
def llm_embed(ctx: Context, text: Column) -> Column:
    from pelagraph.operators.providers import embed, need

    return embed(need(ctx.session), text)


@register("llm_similarity")
def llm_similarity(ctx: Context, a: Column, b: Column) -> Column:
    return vectors.cosine_similarity(llm_embed(ctx, a), llm_embed(ctx, b))
