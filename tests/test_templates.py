"""User templates: public shapes as written out by hand, and errors that name their place."""

import pytest
from pyspark.sql import functions as F

from textloom.functions.chat import render_chat, render_pair
from textloom.functions.templates import TemplateError, UserTemplate

TALK = [("system", "Be kind."), ("user", " Hi\n"), ("assistant", "Yes"), ("user", None)]

CHATML = """{% for message in messages %}{{'<|im_start|>' + message['role'] + '\\n' + message['content'] + '<|im_end|>' + '\\n'}}{% endfor %}{% if add_generation_prompt %}{{ '<|im_start|>assistant\\n' }}{% endif %}"""
HEADERS = """{% set loop_messages = messages %}{% for message in loop_messages %}{% set content = '<|start_header_id|>' + message['role'] + '<|end_header_id|>\\n\\n'+ message['content'] | trim + '<|eot_id|>' %}{% if loop.index0 == 0 %}{% set content = bos_token + content %}{% endif %}{{ content }}{% endfor %}{% if add_generation_prompt %}{{ '<|start_header_id|>assistant<|end_header_id|>\\n\\n' }}{% endif %}"""
ROLES = """{#- a comment #}
{% for message in messages %}
  {% if message.role == 'user' %}
{{ '<|user|>\\n' + message.content + eos_token }}
  {%- elif message["role"] == "system" %}
{{ '<|system|>\\n' + message['content'] + eos_token }}
{% elif message['role'] == 'assistant' %}
{{ '<|assistant|>\\n'  + message['content'] + eos_token }}
{% else %}
{{ raise_exception('no such role') }}
{% endif %}
{% if loop.last and add_generation_prompt %}
{{ '<|assistant|>' }}
{% endif %}
{% endfor %}
"""


def rendered(spark, template, talk=TALK, generation=False):
    df = spark.createDataFrame([(talk,)], "m array<struct<role:string,content:string>>")
    return df.select(render_chat(F.col("m"), generation, template)).first()[0]


def test_three_public_shapes(spark):
    chatml = "<|im_start|>system\nBe kind.<|im_end|>\n<|im_start|>user\n Hi\n<|im_end|>\n<|im_start|>assistant\nYes<|im_end|>\n<|im_start|>user\n<|im_end|>\n"
    assert rendered(spark, UserTemplate(CHATML)) == chatml
    assert rendered(spark, UserTemplate(CHATML), generation=True) == chatml + "<|im_start|>assistant\n"
    head = "<|start_header_id|>{}<|end_header_id|>\n\n{}<|eot_id|>"
    want = "<s>" + "".join(head.format(r, (c or "").strip()) for r, c in TALK) + "<|start_header_id|>assistant<|end_header_id|>\n\n"
    assert rendered(spark, UserTemplate(HEADERS, {"bos_token": "<s>"}), generation=True) == want
    roles = UserTemplate(ROLES, {"eos_token": "</s>"})
    assert rendered(spark, roles) == "<|system|>\nBe kind.</s>\n<|user|>\n Hi\n</s><|assistant|>\nYes</s>\n<|user|>\n</s>"
    assert rendered(spark, roles, generation=True).endswith("<|user|>\n</s><|assistant|>\n")
    with pytest.raises(Exception, match="no such role"):
        rendered(spark, roles, [("tool", "x")])


def test_expressions(spark):
    def out(source, talk=TALK):
        return rendered(spark, UserTemplate(source, {"a": "x"}), talk)

    assert out("{% if messages[0]['role'] == 'system' and not ('q' in a) %}yes{% endif %}") == "yes"
    assert out("{% for m in messages %}{{ loop.index }}{% if loop.index0 % 2 == 0 or loop.last %},{% endif %}{% endfor %}") == "1,23,4,"
    assert out("a \n {%- if a -%} \n b {% endif %}\nc") == "ab c"
    assert out("{% if a != 'x' %}1{% elif a == \"x\" %}{% set a = 'it\\'s' + a %}{% else %}3{% endif %}{{ a }}") == "it'sx"
    assert out("{{ 'only' }}\n", []) == "only\n"


def test_a_pair_of_full_and_prompt_text(spark):
    df = spark.createDataFrame([("p", "c")], "p string, c string")
    full, head = render_pair(F.col("p"), F.col("c"), template=UserTemplate(CHATML))
    row = df.select(full.alias("f"), head.alias("h")).first()
    assert row.f.startswith(row.h) and row.f == row.h + "c<|im_end|>\n"


@pytest.mark.parametrize("source,said", [
    ("a\n {% macro x() %}", "'macro' is not taken at line 2"), ("{{ messages | tojson }}", "filter 'tojson' on messages is not taken at line 1, column 15"),
    ("{{ nobody }}", "the name 'nobody' is not taken at line 1, column 4"), ("{% for x in y %}{% endfor %}", "a loop over 'y'"),
    ("{% if true %}", "a condition without its end"), ("{% endfor %}", "'endfor' without a beginning"), ("{{ 'a' + 1 }}", "'+' between text and number"),
    ("{{ a", "'{{' without an end"), ("{{ 'a' if b }}", "'if' is not taken"), ("{{ ~ }}", "'~' is not taken at line 1, column 4"),
    ("{% for m in messages %}{{ m.tool_calls }}{% endfor %}", "'tool_calls' of 'm'"), ("{% set x %}", "'set x '"),
])
def test_errors_name_their_place(spark, source, said):
    with pytest.raises(TemplateError) as caught:
        UserTemplate(source).render(F.array().cast("array<struct<role:string,content:string>>"))
    assert said in str(caught.value)
