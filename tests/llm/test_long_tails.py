"""Problem 10: unfinished lines of any length."""

from folioquery.llm import truncation as T


def test_tails_that_only_begin_alike_are_not_shared():
    line = "the same boilerplate without any mark " * 8
    a, b, c = (T._ending(f"One line.\n{line}{end}")[1] for end in ("and then", "or else", "and then"))
    assert len(line) > 200 and a != b and a == c
    assert T._ending("x.\nPage 12 of")[1] == T._ending("y.\npage 7 OF")[1]
