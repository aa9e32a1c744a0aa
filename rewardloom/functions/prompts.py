"""Chat prompts as ``array<struct<role, content>>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# --- fixed values: prompt texts, which must equal the published ones ---------
SYSTEM = (
    "You are a helpful assistant skilled in mathematics, logical reasoning, and programming. "
    "Solve problems step by step, showing your work clearly.\n\n"
    "CRITICAL FORMAT REQUIREMENT:\n"
    "- You MUST end your response with '#### ' followed by your final answer\n"
    "- NEVER use \\boxed{}, $\\boxed{}$, or any LaTeX boxing format\n"
    "- ALWAYS use #### format, even for mathematical expressions\n"
    "- Example: #### 42 or #### x^2 + 1"
)
CODE_SYSTEM = (
    "You are an expert Python programmer. Solve coding problems step by step.\n\n"
    "CRITICAL FORMAT REQUIREMENT:\n"
    "- You MUST end your response with '#### ' followed by your complete code\n"
    "- The code after #### should be in a ```python code block\n"
    "- NEVER output code without the #### marker\n"
    "- Example format:\n"
    "  [your reasoning]\n"
    "  #### \n"
    "  ```python\n"
    "  def solution():\n"
    "      pass\n"
    "  ```"
)
TEMPLATES = {
    "gsm8k": "Solve this math word problem:\n\n{question}\n\nThink step by step, showing your calculations."
             "\n\nWrite your final numerical answer as:\n#### [number]",
    "code": "Task: {question}{tests}\nThink through your approach, then write the Python function.\n\n"
            "REMEMBER: You MUST end with #### followed by your code in a ```python block.",
    "mcq": "Answer this question:\n\nQuestion: {question}\n\n{choices}\n\nAnalyze each option and explain "
           "your reasoning.\n\nWrite your final answer as:\n#### [letter]",
    "passage_qa": "Read the following passage and answer the question.\n\nPassage: {context}\n\nQuestion: "
                  "{question}\n\nProvide a concise answer based on the passage.\n\nWrite your final answer "
                  "as:\n#### [answer]",
    "open_qa": "Answer this question:\n\n{question}\n\nThink through your answer carefully.\n\nWrite your "
               "final answer as:\n#### [answer]",
    "math": "Solve this math problem:\n\n{question}\n\nShow your work step by step.\n\nWrite your final "
            "answer as:\n#### [answer]",
    "math_competition": "Solve this math problem:\n\n{question}\n\nThink step by step, showing your work "
                        "clearly.\n\nWrite your final answer as:\n#### [answer]",
    "mcqa": "Read the following and answer the question:\n\nContext: {context}\n\nQuestion: {question}\n\n"
            "Options:\n{choices}\n\nThink about which option is most appropriate.\n\nWrite your final "
            "answer as:\n#### [letter]",
}
TESTS_HEADER = "\n\nYour code should pass these tests:\n"
DOMAIN_SYSTEM = {
    "code": "You are a Python programmer. Write clean, working code. Put your final code in a python code block.",
    "math": "You are a helpful assistant that solves problems step by step.\n"
            "CRITICAL: End your response with #### followed by just the final answer value.",
    "other": "You are a helpful assistant. Think step by step and end your response with "
             "#### followed by your final answer.",
}
# --- end of fixed values -----------------------------------------------------


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def fill(template: str, **values: Column) -> Column:
    """Puts columns into the slots of a template."""
    parts, rest = [], template
    while "{" in rest and "}" in rest:
        head, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        parts += [F.lit(head), values[name]]
    return F.concat(*parts, F.lit(rest))


def shown_tests(tests: Column) -> Column:
    """Up to three tests under a header; nothing where there are none."""
    listed = F.array_join(F.slice(tests, 1, 3), "\n")
    return F.when(F.size(tests) > 0, F.concat(F.lit(TESTS_HEADER), listed, F.lit("\n"))).otherwise("")


def templated(kind: str, question: Column, **values: Column) -> Column:
    """System and user message of one template."""
    system = CODE_SYSTEM if kind == "code" else SYSTEM
    if kind == "code":
        values = {"tests": shown_tests(values["tests"])}
    user = fill(TEMPLATES[kind], question=question, **values)
    return F.array(message("system", F.lit(system)), message("user", user))


def open_question(question: Column, context: Column) -> Column:
    """Passage form where there is a context, plain form where there is none."""
    return F.when(
        F.coalesce(context, F.lit("")) != "", templated("passage_qa", question, context=context)
    ).otherwise(templated("open_qa", question))


def system_prompt(domain: Column) -> Column:
    return (
        F.when(domain.isin("apps", "humaneval", "mbpp", "code"), DOMAIN_SYSTEM["code"])
        .when(domain.isin("math", "gsm8k"), DOMAIN_SYSTEM["math"])
        .otherwise(DOMAIN_SYSTEM["other"])
    )


def resolved_prompt(prompt: Column, question: Column, domain: Column) -> Column:
    """The prompt where it has messages, else one built from the question."""
    built = F.array(
        F.struct(F.lit("system").alias("role"), system_prompt(domain).alias("content")),
        F.struct(F.lit("user").alias("role"), F.coalesce(question, F.lit("")).alias("content")),
    )
    return F.when(F.size(prompt) > 0, prompt).otherwise(built)


def parsed_prompt(text: Column) -> Column:
    return F.from_json(text, "array<struct<role:string,content:string>>")


def query_text(prompt: Column) -> Column:
    """Content of the last message."""
    return F.try_element_at(prompt, F.lit(-1))["content"]


def first_question(prompt: Column) -> Column:
    """Content of the first user message, or an empty text."""
    first = F.get(F.filter(prompt, lambda m: m["role"] == "user"), 0)
    return F.coalesce(first["content"], F.lit(""))
