"""Literals of any length, and signs in any column, are found and replaced whole."""

import random
import string
import time

import pytest

from turnlab.llm import secrets

LONG = "".join(random.Random(1).choices(string.ascii_letters + string.digits, k=603))


@pytest.mark.parametrize("line", [
    'private_key = "{}"', "private_key = '{}'", "private_key={}", "private_key            = {}", "signing_key:\t \t        {}",
    "<private_key>{}</private_key>", "--private-key={}", "1private_key={}", "b'private_key': '{}'", "x" * 90 + "_private_key={}",
    "<" + "x" * 90 + "_private_key>{}</" + "x" * 90 + "_private_key>"])
@pytest.mark.parametrize("value", [LONG, LONG[:40]])
def test_whole_literals(line, value):
    text = "of the " + line.format(value) + " and"
    start = text.index(value)
    assert secrets.lexed_spans(text) == [(start, 3, start + len(value))]
    places = secrets.literal_places(text)
    assert secrets.redacted(text, *zip(*places)) == "of the " + line.format("[SECRET]") + " and"


def test_long_references():
    name = "A" * 90
    text = f"{name}={LONG} private_key=${name} "
    assert (text.index(LONG), 3, text.index(LONG) + len(LONG)) in secrets.lexed_spans(text)


@pytest.mark.parametrize("piece", ["a", "a-", "-", "1.", "a ", "a=", "a=\"", "a='b=\"", "\"a", "<a>", "<a>b", "a \t", "=", "$", "a=$"])
def test_time_is_linear(piece):
    text = "= </" + piece * (400_000 // len(piece))
    began = time.process_time()
    secrets.lexed_spans(text)
    assert time.process_time() - began < 10
