"""Conversations: rendering with masks, prompts, answers, and small generated tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.columns import occurrences

LETTERS = ("A", "B", "C", "D", "E", "F", "G", "H")
# Ids of special tokens above the bytes, in the byte-level rendering.
BOS, USER, USER_END, ASSISTANT, ASSISTANT_END, PYTHON, PYTHON_END, OUTPUT, OUTPUT_END = range(256, 265)
MOST_TOKENS = 2048


def byte_ids(text: Column) -> Column:
    """UTF-8 bytes of a text as numbers."""
    pairs = F.regexp_extract_all(F.hex(F.encode(F.coalesce(text, F.lit("")), "utf-8")), F.lit("(..)"), 1)
    return F.transform(pairs, lambda x: F.conv(x, 16, 10).cast("int"))


def merged_system(turns: DataFrame) -> DataFrame:
    """Turns without a leading system message, whose text goes before the first user message, a blank line between."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    before = F.lag(F.struct("role", "text")).over(w)
    joined = turns.withColumn("_before", before)
    text = F.when((F.col("_before.role") == "system") & (F.col("role") == "user"), F.concat_ws("\n\n", F.col("_before.text"), F.col("text"))).otherwise(F.col("text"))
    return joined.withColumn("text", text).where("role <> 'system'").drop("_before")


def rendered(turns: DataFrame, most: int = MOST_TOKENS) -> DataFrame:
    """(conv_id, ids, mask): begin token, then each message between its start and end tokens, cut to ``most``.

    What the assistant writes, and its end token, is trained (mask 1); start tokens, users and tool output are not.
    Columns of ``turns``: conv_id, turn, role (user, assistant, python, output, system), text.
    """
    start = F.when(F.col("role") == "user", USER).when(F.col("role") == "assistant", ASSISTANT).when(F.col("role") == "python", PYTHON).otherwise(OUTPUT)
    end = start + 1
    trained = F.col("role").isin("assistant", "python").cast("int")
    body = byte_ids(F.col("text"))
    ids = F.concat(F.array(start), body, F.array(end))
    head = F.when(F.col("role") == "python", 1).otherwise(0)
    mask = F.concat(F.array(head), F.array_repeat(trained, F.size(body)), F.array(trained))
    each = merged_system(turns).select("conv_id", "turn", ids.alias("ids"), mask.alias("mask"))
    whole = each.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "ids", "mask"))).alias("m"))
    flat = lambda f, head: F.slice(F.concat(F.array(F.lit(head)), F.flatten(F.transform("m", lambda x: x[f]))), 1, most)
    return whole.select("conv_id", flat("ids", BOS).alias("ids"), flat("mask", 0).alias("mask"))


def for_completion(turns: DataFrame) -> DataFrame:
    """(conv_id, ids) without the last message, ready for an assistant's; only conversations that end with one."""
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("_last"), F.max_by("role", "turn").alias("_role")).where("_role = 'assistant'")
    rest = turns.join(last, "conv_id").where(F.col("turn") < F.col("_last"))
    return rendered(rest.select("conv_id", "turn", "role", "text")).select("conv_id", F.concat("ids", F.array(F.lit(ASSISTANT))).alias("ids"))


def choice_prompt(question: Column, choices: Column, letters: tuple[str, ...] = LETTERS) -> Column:
    """The question, a line ``- choice=letter`` for each choice, and what to answer with."""
    names = F.array(*map(F.lit, letters))
    lines = F.transform(choices, lambda x, i: F.concat(F.lit("- "), x, F.lit("="), F.element_at(names, i + 1), F.lit("\n")))
    return F.concat(F.lit("Multiple Choice question: "), question, F.lit("\n"), F.array_join(lines, ""), F.lit("\nRespond only with the letter of the correct answer."))


def choice_letter(gold: Column, letters: tuple[str, ...] = LETTERS) -> Column:
    return F.try_element_at(F.array(*map(F.lit, letters)), gold + 1)


def tool_parts(text: Column) -> Column:
    """Parts of an answer with ``<<expression=result>>``: (kind, text) of text, python and output; empty text parts stay."""
    outside = F.split(text, "<<[^>]+>>")
    inside = F.regexp_extract_all(text, F.lit("<<([^>]+)>>"), 1)
    part = lambda kind, x: F.struct(F.lit(kind).alias("kind"), x.alias("text"))
    pattern = r"^(?s)(.*?)(?:=([^=]*))?$"
    tool = lambda x: F.array(part("python", F.regexp_extract(x, pattern, 1)), part("output", F.regexp_extract(x, pattern, 2)))
    each = F.transform(outside, lambda x, i: F.concat(F.array(part("text", x)), F.when(i < F.size(inside), tool(F.get(inside, i))).otherwise(F.slice(tool(F.lit("")), 1, 0))))
    return F.flatten(each)


def answer(text: Column) -> Column:
    """The first number after ``#### ``, commas taken out; null where there is none."""
    return F.replace(F.nullif(F.regexp_extract(text, r"#### (-?[0-9.,]+)", 1), F.lit("")), F.lit(","), F.lit(""))


def same_answer(predicted: Column, expected: Column) -> Column:
    """Two nulls are the same answer."""
    return predicted.eqNullSafe(expected)


def letter_count(word: Column, letter: str) -> Column:
    return occurrences(word, letter)


def counted_aloud(word: Column, letter: str) -> Column:
    """``i:c`` for each letter, with the running count where it is the one looked for."""
    chars = F.split(word, "")
    lines = F.transform(chars, lambda c, i: F.concat((i + 1).cast("string"), F.lit(":"), c, F.when(c == letter, F.concat(F.lit(" hit! count="), F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda x: x == letter)).cast("string"))).otherwise("")))
    return F.array_join(lines, "\n")


def spelled(word: Column) -> Column:
    return F.concat(word, F.lit(":"), F.array_join(F.split(word, ""), ","))


def joined_prompts(shots: Column, last: Column) -> Column:
    """Examples and the last prompt, a blank line between them."""
    return F.concat(F.array_join(F.transform(shots, lambda x: F.concat(x, F.lit("\n\n"))), ""), F.trim(last))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of what two arrays have in common at their beginning."""
    n = F.least(F.size(a), F.size(b))
    differ = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.when((i <= n) & ~F.try_element_at(a, i).eqNullSafe(F.try_element_at(b, i)), i)), lambda x: x.isNotNull())
    return F.when(n == 0, 0).when(F.size(differ) == 0, n).otherwise(F.array_min(differ) - 1)


def common_suffix(a: Column, b: Column) -> Column:
    return common_prefix(F.reverse(a), F.reverse(b))


def is_prefix(short: Column, long: Column) -> Column:
    return F.slice(long, F.lit(1), F.size(short)).eqNullSafe(short)


def code_of(text: Column) -> Column:
    """The first fenced block, else the whole text; no blanks at its ends."""
    block = F.regexp_extract(text, r"(?s)```(?:python)?\s*\n(.*?)\n```", 1)
    return F.trim(F.when(block != "", block).otherwise(text))


def leading_imports(text: Column) -> Column:
    """Import lines before the first other line that isn't blank or a comment."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    other = F.filter(F.transform(lines, lambda x, i: F.when(~(x.startswith("import ") | x.startswith("from ") | x.startswith("#") | (x == "")), i)), lambda i: i.isNotNull())
    head = F.when(F.size(other) > 0, F.slice(lines, F.lit(1), F.array_min(other))).otherwise(lines)
    return F.array_join(F.filter(head, lambda x: x.startswith("import ") | x.startswith("from ")), "\n")


def program(prompt: Column, completion: Column, tests: Column, entry: Column) -> Column:
    """Imports of the prompt, the completion's code, its tests and the call that runs them; running is not this engine's task."""
    return F.concat(leading_imports(prompt), F.lit("\n\n"), code_of(completion), F.lit("\n\n"), tests, F.lit("\ncheck("), entry, F.lit(")"))


def flat_prompt(turns: DataFrame) -> DataFrame:
    """(conv_id, prompt): ``role: text`` lines and the beginning of an answer."""
    held = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    lines = F.transform(held, lambda x: F.concat(x["role"], F.lit(": "), x["text"]))
    return turns.groupBy("conv_id").agg(F.concat(F.array_join(lines, "\n"), F.lit("\nassistant:")).alias("prompt"))


def stopped(text: Column, stops: list[str]) -> Column:
    """The text before the first listed stop sequence that it contains."""
    out = text
    for stop in reversed(stops):
        out = F.when(F.contains(text, F.lit(stop)), F.substring_index(text, stop, 1)).otherwise(out)
    return out


def sessions(commands: DataFrame) -> DataFrame:
    """Adds ``session``: ``clear`` begins a new one; clearing rows are left out. Columns: user, seq, text."""
    clears = F.sum(F.when(F.trim("text") == "clear", 1).otherwise(0)).over(Window.partitionBy("user").orderBy("seq"))
    return commands.withColumn("session", clears).where(F.trim("text") != "clear")


TASKS = {"categorical": "choice", "generative": "sample"}


def evaluator(kind: str) -> str:
    """How tasks of a kind are evaluated; an unknown kind is an error."""
    if kind not in TASKS:
        raise ValueError(f"unknown kind of task: {kind}")
    return TASKS[kind]
