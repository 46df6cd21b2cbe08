"""Inputs of many megabytes without an end mark take time in proportion to their length."""

import random
import re
import time

import public_tokenizers
import pytest

from passagemill.llm import bpe_automaton, language_id

HIDDEN = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->", re.S | re.I)
TAG = re.compile(r"<[^>]*>|&[#\w]+;")


def test_visible_text_is_what_the_patterns_say():
    pick = random.Random(1)
    parts = ["<script", "<SCRIPT>", "</script", "</Script >", "<style a>", "</style>", "<!--", "-->", "<b>", "<", ">", "&amp;", "&", ";", "text ", "é", "<scripted>", "<!-->"]
    for _ in range(5000):
        markup = "".join(pick.choices(parts, k=pick.randrange(14)))
        assert language_id.visible_text(markup) == TAG.sub(" ", HIDDEN.sub(" ", markup)), markup


@pytest.mark.parametrize("mark", ["<script", "<script>", "<!--", "<", "<style></script>", "&a"])
def test_unclosed_markup(mark):
    began = time.perf_counter()
    language_id.visible_text(mark * (5_000_000 // len(mark)))
    assert time.perf_counter() - began < 20


def test_one_long_word():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        codec = bpe_automaton.Codec(file.read())
    pick = random.Random(2)
    began = time.perf_counter()
    tokens = {}
    for size in (20_000, 2_000_000):
        word = "".join(pick.choices("etaoinshrdlu", k=size))
        start = time.perf_counter()
        tokens[size] = codec.run(word)[0]
        tokens[-size] = time.perf_counter() - start
        if size == 20_000:
            assert codec._encode(word) == codec.tokenizer.encode(word, add_special_tokens=False).ids
    assert time.perf_counter() - began < 60 and tokens[-2_000_000] < 300 * max(tokens[-20_000], 0.02)
