"""Chat history, prompt and embedding guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that send a prompt to the tools, bounds of tokens, embedding bytes and dimensions, the system line.
TOOL_WORDS = ("calculate", "emi")
MOST_TOKENS, MOST_BYTES, DIMENSIONS, HISTORY = 512, 8000, 768, 20
SYSTEM = "You are a finance assistant. Use tools for math."


def last_messages(chat: DataFrame, n: int = HISTORY) -> DataFrame:
    """Each session's last n messages. chat: session_id, seq, role, content."""
    order = Window.partitionBy("session_id").orderBy(F.desc("seq"))
    return chat.withColumn("__rn", F.row_number().over(order)).where(F.col("__rn") <= n).drop("__rn")


def chat_prompt(chat: DataFrame, query: Column, n: int = HISTORY, system: str = SYSTEM) -> DataFrame:
    """System line, the last n messages with capitalised roles, and the new query, by session."""
    lines = F.array_sort(F.collect_list(F.struct("seq", F.concat(F.initcap("role"), F.lit(": "), "content").alias("line"))))
    done = last_messages(chat, n).groupBy("session_id").agg(F.transform(lines, lambda x: x["line"]).alias("lines"))  # n entries
    return done.select("session_id", F.concat(F.lit(system + "\n\n"), F.array_join("lines", "\n"), F.lit("\nUser: "), query, F.lit("\n")).alias("prompt"))


def prompt_error(prompt: Column) -> Column:
    """Why a prompt isn't for the language model; null if it is."""
    tools = F.lit(False)
    for w in TOOL_WORDS:
        tools = tools | prompt.contains(w)
    return F.when(prompt.isNull() | (F.trim(F.translate(prompt, "\n\r\t", "   ")) == ""), F.lit("EmptyPrompt")).when(tools, F.lit("UseTool"))


def guarded_prompt(prompt: Column, context: Column | None = None) -> Column:
    whole = prompt if context is None else F.concat_ws("\n\n", context, prompt)
    return F.when(prompt_error(prompt).isNull(), whole)


def embedding_error(text: Column) -> Column:
    """Blank, only digits and white space, or too many bytes."""
    blank = text.isNull() | (F.trim(F.translate(text, "\n\r\t", "   ")) == "")
    return F.when(blank, F.lit("EmptyText")).when(text.rlike(r"^[0-9\s]+$"), F.lit("NumericOnly")).when(F.octet_length(text) > MOST_BYTES, F.lit("TooLong"))


def embedding(text: Column) -> Column:
    """Placeholder vector of zeros for valid texts."""
    return F.when(embedding_error(text).isNull(), F.array_repeat(F.lit(0.0).cast("float"), DIMENSIONS))


def token_limit(asked: Column) -> Column:
    return F.least(asked, F.lit(MOST_TOKENS))
