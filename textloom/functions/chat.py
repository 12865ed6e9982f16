"""Prompt formats and chat rendering as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.templates import UserTemplate
from textloom.functions.text import null_to_empty, strip


@dataclass(frozen=True)
class ChatTemplate:
    """Text around each message.  ``{role}`` is replaced by the role name."""

    opening: str = "<|{role}|>\n"
    closing: str = "\n"
    generation: str = "<|assistant|>\n"

    def message(self, role: Column, content: Column) -> Column:
        before, after = self.opening.split("{role}")
        return F.concat(F.lit(before), role, F.lit(after), strip(content), F.lit(self.closing))


DEFAULT_TEMPLATE = ChatTemplate()


def chat_messages(prompt: Column, completion: Column | None = None, system: Column | None = None) -> Column:
    """Message array: optional system, user, optional assistant."""

    def one(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    parts = [one("user", prompt)]
    if system is not None:
        parts.insert(0, F.when(null_to_empty(system) != "", one("system", system)))
    if completion is not None:
        parts.append(one("assistant", completion))
    return F.filter(F.array(*parts), lambda m: m.isNotNull())


def render_chat(messages: Column, add_generation: bool = False, template: ChatTemplate | UserTemplate = DEFAULT_TEMPLATE) -> Column:
    """Text of a conversation, optionally opening the assistant's turn."""
    if isinstance(template, UserTemplate):
        return template.render(messages, add_generation)
    rendered = F.array_join(
        F.transform(messages, lambda m: template.message(m["role"], m["content"])), ""
    )
    return F.concat(rendered, F.lit(template.generation)) if add_generation else rendered


def render_pair(
    prompt: Column, completion: Column, system: Column | None = None, template: ChatTemplate | UserTemplate = DEFAULT_TEMPLATE
) -> tuple[Column, Column]:
    """``(full_text, prompt_only_text)`` of a prompt and its completion."""
    return (
        render_chat(chat_messages(prompt, completion, system), template=template),
        render_chat(chat_messages(prompt, system=system), add_generation=True, template=template),
    )


def instruction_pair(prompt: Column, completion: Column) -> tuple[Column, Column]:
    """Fallback form without a chat template."""
    head = F.concat(F.lit("### Instruction:\n"), prompt, F.lit("\n\n### Response:\n"))
    return F.concat(head, completion), head


# The words and marks of the translation prompts below.
def _task_line(source_lang: Column, target_lang: Column) -> Column:
    return F.concat(
        F.lit("Translate the following text from "), source_lang, F.lit(" to "), target_lang, F.lit(".\n\n")
    )


def translation_plain(source_lang: Column, target_lang: Column, source: Column, target: Column) -> Column:
    """Plain translation prompt; without a target it ends where the answer starts."""
    return F.concat(
        _task_line(source_lang, target_lang),
        source_lang, F.lit(":\n"), source, F.lit("\n\n"),
        target_lang, F.lit(":\n"), null_to_empty(target),
    )


def translation_chat(source_lang: Column, target_lang: Column, source: Column, target: Column) -> Column:
    """Marked-up translation prompt with user and assistant marks."""
    return F.concat(
        F.lit("<|begin_of_text|>\n<|user|>\n"),
        _task_line(source_lang, target_lang),
        source_lang, F.lit(":\n"), source, F.lit("\n<|assistant|>\n"), null_to_empty(target),
    )
