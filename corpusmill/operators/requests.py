"""Generation requests: one row for each task, language and index, with deterministic draws and prompts filled from templates.

A draw is a hash of its tag, the language and the index, so a request never depends on its place. Every
name in a template is a column of the row; the same template filled as SQL gives the same prompt.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.json_schema import FORMS, TOOLS, response_format, schema_of
from corpusmill.functions.text import hash01
from corpusmill.operators import languages

RULES = "Answer with one JSON object that fits the schema. Write natural, correct text in the language asked for."
STYLE = "Language: {english_name} ({endonym}), code {code}.{care}"
CARE = " Keep sentences short and plain, as little text exists in this language."
PERSONA = "The user is {who}, {mood}, who {habit}."
WHO = ["a market trader of 45", "a student of 20", "a nurse on night shift", "a farmer of 60", "a bus driver", "a teacher of 35"]
MOOD = ["in a hurry", "polite and formal", "relaxed", "worried", "curious"]
HABIT = ["writes short lines", "asks for details", "greets first", "writes whole sentences"]
TOPICS = ["a market report", "a family letter", "a radio notice", "a recipe", "an old story", "a school essay", "a health leaflet", "a sports report"]
DEVICE_TOOLS = [t for t in TOOLS if t not in ("search_document", "calculate")]
CODES = [code for code, *_ in languages.LANGUAGES]

#: User prompt and context of each task.
TEMPLATES: dict[str, tuple[str, str]] = {
    "rag": ("{style}\n{persona}\nDocument: {title}\n{document}\nWrite {turns} turns of questions on the document. {answers}", '{"doc_id":{doc_id},"hard":{hard_json}}'),
    "summarization": ("{style}\n{persona}\nWrite {topic} of some length as {variant}, an instruction to sum it up, and the summary.", '{"variant":"{variant}"}'),
    "edge_action": ("{style}\n{persona}\nTools: {tools}. Write an instruction that needs {target}.", '{"target":"{target}","tools":"{tools}"}'),
    "structured_output": ("{style}\n{persona}\nWrite a short text that holds all fields of a {form}, an instruction to extract them, and the fields.", '{"form":"{form}"}'),
    "math_stats": ("{style}\n{persona}\nWrite a problem of level {level} about {topic} with numbers, its steps and its answer.", '{"level":{level}}'),
    "translation": ("{style}\n{persona}\nWrite {topic} in {source_lang}, ask for it in {target_lang}, and translate it.", '{"source_lang":"{source_lang}","target_lang":"{target_lang}"}'),
}
BUILDERS: dict[str, Callable[[SparkSession, DataFrame], DataFrame]] = {}


def draw(tag: str) -> Column:
    return hash01(F.lit(tag), F.col("code"), F.col("i").cast("string"))


def pick(tag: str, options: list[str]) -> Column:
    return F.get(F.array(*map(F.lit, options)), F.floor(draw(tag) * len(options)).cast("int"))


def one_of(tag: str, options: Column) -> Column:
    return F.get(options, F.floor(draw(tag) * F.size(options)).cast("int"))


def pieces(template: str) -> list[tuple[str, bool]]:
    """(text, whether it names a column) of each part of a template."""
    return [(p, k % 2 == 1) for k, p in enumerate(re.split(r"\{([a-z_]+)\}", template)) if p]


def fill(template: str) -> Column:
    return F.concat(*[F.col(p).cast("string") if named else F.lit(p) for p, named in pieces(template)])


def language_pair() -> Column:
    """struct<kind, source_lang, target_lang>: 45 % from English, 30 % to English, 15 % from another language, else two others.

    Where the instruction is in English, English and another language, either way round."""
    codes = F.array(*map(F.lit, CODES))
    others = F.array_remove(codes, F.col("code"))
    third = F.array_remove(others, "eng")
    other, first = one_of("other", others), one_of("first", others)
    second = one_of("second", F.filter(others, lambda c: c != first))
    p = draw("pair")
    made = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("source_lang"), b.alias("target_lang"))
    own, eng = F.col("code"), F.lit("eng")
    english = F.when(draw("way") < 0.5, made("from_english", eng, other)).otherwise(made("to_english", other, eng))
    return F.when(own == "eng", english).when(p < 0.45, made("from_english", eng, own)).when(p < 0.75, made("to_english", own, eng)).when(p < 0.9, made("from_other", one_of("other", third), own)).otherwise(made("unrelated", first, second))


def tool_choice(tools: list[str]) -> DataFrame:
    """struct<hard, target, tools>: hard rows get 2 to 4 tools without the target, others the target and 2 to 5 more, in hash order."""
    target, hard = pick("target", tools), draw("hard") < 0.2
    others = F.array_sort(F.transform(F.filter(F.array(*map(F.lit, tools)), lambda t: t != target), lambda t: F.struct(F.md5(F.concat_ws("|", t, "code", F.col("i").cast("string"))).alias("h"), t.alias("t"))))
    n = 2 + F.floor(draw("n") * F.when(hard, 3).otherwise(4)).cast("int")
    names = F.slice(others, F.lit(1), n)["t"]
    return F.struct(hard.alias("hard"), target.alias("target"), F.array_join(F.when(hard, names).otherwise(F.concat(F.array(target), names)), ",").alias("tools"))


def prepared(grid: DataFrame) -> DataFrame:
    """The grid with all columns that templates name, but for a document's."""
    pair, tools = language_pair(), tool_choice(DEVICE_TOOLS)
    rows = grid.withColumns(
        {
            "care": F.when(F.col("resource_tier") == "low", CARE).otherwise(""), "who": pick("who", WHO), "mood": pick("mood", MOOD), "habit": pick("habit", HABIT), "topic": pick("topic", TOPICS),
            "variant": F.when(F.col("i") % 2 == 0, "doc").otherwise("chat"), "form": pick("form", [*FORMS]), "level": F.floor(draw("level") * 5) + 1, "turns": F.floor(draw("turns") * 3) + 2,
            "is_hard": draw("hard") < 0.2, "pair": pair, "choice": tools,
        }
    )
    rows = rows.select("*", "pair.source_lang", "pair.target_lang", "choice.target", "choice.tools").drop("pair", "choice")
    rows = rows.withColumns({"hard_json": F.col("is_hard").cast("string"), "answers": F.when(F.col("is_hard"), "One of them has no answer in it.").otherwise("All of them have their answer in it.")})
    return rows.withColumn("style", fill(STYLE)).withColumn("persona", fill(PERSONA))


def formats(task: str) -> dict:
    """What the model must return: a list of turns or the task's own fields."""
    text = {"type": "string"}
    fields: dict[str, dict[str, dict]] = {
        "rag": {"turns": {"type": "array", "items": {"type": "object", "properties": {"user_message": text, "search_query": text, "answerable": {"type": "boolean"}, "relevant_chunk_id": {"type": ["integer", "null"]}, "assistant_response": text}}}},
        "summarization": {"user_instruction": text, "summary": text},
        "edge_action": {"user_instruction": text, "reasoning": text, "task_plan": text, "needs_tool_call": {"type": "boolean"}, "tool_name": text, "tool_arguments_json": text, "tool_result_json": text, "final_response": text},
        "structured_output": {"source_text": text, "user_instruction": text, "extracted": {"anyOf": [schema_of(f) for f in FORMS.values()]}},
        "math_stats": {"problem": text, "reasoning": text, "uses_calculator": {"type": "boolean"}, "calculator_expression": text, "calculator_result": text, "answer": text},
        "translation": {"source_text": text, "user_instruction": text, "translated_text": text},
    }
    return response_format(task, {"type": "object", "properties": fields[task]})


def lines(rows: DataFrame, task: str, model: str = "generator", temperature: float = 1.0, max_tokens: int = 2048) -> DataFrame:
    """(custom_id, task, language, line, context): the request as one JSON line, and what the answer is matched with."""
    user, context = TEMPLATES[task]
    custom = F.format_string(f"{task}__%s__%05d", "code", "i")
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)
    after = '}],"response_format":' + json.dumps(formats(task), separators=(",", ":")) + f',"temperature":{temperature},"max_tokens":{max_tokens}}}}}'
    before = '","method":"POST","url":"/v1/chat/completions","body":{"model":' + json.dumps(model) + ',"messages":[{"role":"system","content":' + json.dumps(RULES) + '},{"role":"user","content":'
    line = F.concat(F.lit('{"custom_id":"'), custom, F.lit(before), quoted(fill(user)), F.lit(after))
    return rows.select(custom.alias("custom_id"), F.lit(task).alias("task"), F.col("code").alias("language"), line.alias("line"), fill(context).alias("context"))


def builder(task: str) -> Callable[[SparkSession, DataFrame], DataFrame]:
    def build(spark: SparkSession, documents: DataFrame) -> DataFrame:
        """documents (doc_id, title, document): requests about a text take them in turn."""
        rows = prepared(languages.grid(spark, 40))
        if task == "rag":
            n = max(1, documents.agg(F.max("doc_id") + 1).first()[0] or 1)
            at = (F.floor(draw("document") * n)).cast("long")
            rows = rows.withColumn("wanted", at).join(documents, F.col("wanted") == F.col("doc_id")).drop("wanted")
        return lines(rows, task)

    return build


BUILDERS |= {task: builder(task) for task in TEMPLATES}
