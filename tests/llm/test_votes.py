"""Votes on long texts."""

import pytest

from logquarry.llm.toxicity import LEXICONS, TermFinder


@pytest.mark.parametrize("length", [100, 1_999, 3_999, 5_999, 40_000])
def test_shouting_is_a_share_of_the_whole_text(length):
    def shouts(capitals):
        _, votes = TermFinder([], []).terms("A" * capitals + "a" * (length - capitals))
        return bool(votes >> LEXICONS & 1)

    assert not shouts(length // 4 + 100 * (length > 1000)) and not shouts(length // 2) and shouts(length // 2 + 1)


def test_shouting_sees_every_letter():
    _, votes = TermFinder([], []).terms("aAA" * 2_000)
    assert votes >> LEXICONS & 1
