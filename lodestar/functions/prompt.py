"""Prompts and event lines as string expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SYSTEM_PROMPT = "Answer the question from the numbered passages, and say so where they do not answer it."

# The marker strings of the two templates, before and after system text and user text.
TEMPLATES = {
    "chatml": (
        "<|im_start|>system\n",
        "<|im_end|>\n<|im_start|>user\n",
        "<|im_end|>\n<|im_start|>assistant\n",
    ),
    "llama3": (
        "<|begin_of_text|><|start_header_id|>system<|eot_id|>\n",
        "<|eot_id|>\n<|start_header_id|>user<|eot_id|>\n",
        "<|eot_id|>\n<|start_header_id|>assistant<|eot_id|>\n",
    ),
}


def format_context(chunks: Column) -> Column:
    """``Context:`` and numbered chunks, one a line; an empty string without chunks."""
    numbered = F.transform(chunks, lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), c))
    return F.when(F.size(chunks) > 0, F.concat(F.lit("Context:\n"), F.array_join(numbered, "\n"))).otherwise(F.lit(""))


def build_prompt(system: Column, query: Column, chunks: Column, template: str = "chatml") -> Column:
    if template not in TEMPLATES:
        raise ValueError(f"unknown template {template!r}; one of {', '.join(TEMPLATES)}")
    opening, middle, closing = TEMPLATES[template]
    context = format_context(chunks)
    user = F.when(context != "", F.concat(context, F.lit("\n\n"), query)).otherwise(query)
    return F.concat(F.lit(opening), system, F.lit(middle), user, F.lit(closing))


def sse_event(payload: Column) -> Column:
    """One server-sent event with a JSON payload."""
    return F.concat(F.lit("data: "), F.to_json(payload), F.lit("\n\n"))
