"""Tree matching: lists of any length are matched in full."""

from pubsift.llm import wrapper


def fold(page):
    return wrapper.Fold(("#root", ""), [wrapper.parse(page)])


def test_long_lists_that_are_far_apart():
    own = "".join(f"<p>{i} a</p><b>{i}</b>" for i in range(65))
    other = "".join("<i>u</i><u>v</u>" for _ in range(20)) + "".join(f"<p>{i} c</p><b>{i} d</b>" for i in range(65))
    x, y = fold(own), fold(other)
    size, pairs = wrapper._between(x.kids, y.kids)
    assert size == len(pairs) == 130
    assert wrapper.align(x, y)[0] == 131
