"""Short values after credential words: random ones are found, guessable ones not."""

import random
import string

import pytest

from wardline.llm import secrets

RANDOM = {
    "small and digits": string.ascii_lowercase + string.digits,
    "letters": string.ascii_letters,
    "letters and digits": string.ascii_letters + string.digits,
    "printable": string.ascii_letters + string.digits + "#%&*+-_~",
}
GUESSABLE = ["pass1234", "summer19", "welcome1", "Dragon99", "qwertyui", "iloveyou", "12345678", "P@ssw0rd",
             "summer2019"[:9], "letmein12", "Monkey123", "aaaaaaaaa", "20190514x", "password1",
             "summer2019", "Welcome123", "qwertyuiop", "football12", "1234567890", "P4ssw0rd!!", "abcdefghij",
             "Required", "required", "5551234567"]


def found(value: str) -> list:
    text = f"password: {value}"
    return [text[s:e] for k, s, e in secrets.scan(text)[1] if k == "guess"]


def test_the_named_value_is_a_secret():
    assert found("Xk9#mQ2p") == ["Xk9#mQ2p"]


@pytest.mark.parametrize("name", RANDOM)
@pytest.mark.parametrize("length", [8, 9, 10])
def test_random_values_are_found(name, length):
    rng = random.Random(length)
    values = []
    while len(values) < 300:
        v = "".join(rng.choice(RANDOM[name]) for _ in range(length))
        # a random value of one class only is that class's, not the alphabet's
        if len({secrets._class(c) for c in v}) > 1:
            values.append(v)
    assert sum(found(v) == [v] for v in values) >= 0.9 * len(values)


@pytest.mark.parametrize("value", GUESSABLE)
def test_guessable_values_of_these_lengths_are_not(value):
    assert 8 <= len(value) <= 10 and not found(value)


def test_a_long_value_costs_linear_time():
    assert secrets.guess_bits("aB3#é" * 4000) > 1000


def test_eight_signs_are_still_found():
    assert found("#%&*+-_~") == ["#%&*+-_~"]
