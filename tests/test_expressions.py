import pytest
from hypothesis import given
from hypothesis import strategies as st

from wordtide.functions import expressions as ex

A, B, C = ex.Term("a"), ex.Term("b"), ex.Term("c")


@pytest.mark.parametrize(
    ("text", "tree"),
    [
        ("labour", ex.Term("labour")),
        ("a + (b - c)", ex.Op("+", A, ex.Op("-", B, C))),
        ("(a + b) - (c + a)", ex.Op("-", ex.Op("+", A, B), ex.Op("+", C, A))),
        ("a + b - c", ex.Op("-", ex.Op("+", A, B), C)),
        ("(a)", A),
        ("a-b", ex.Op("-", A, B)),
        *((t, None) for t in ("", "+ a", "a +", "(a + b", "a b", "a)", "()", "a ( b )", "(a) b", "a + + b")),
    ],
)
def test_parse(text, tree):
    assert ex.parse(text) == tree


def trees(depth=4):
    leaf = st.sampled_from(["a", "b", "wage", "été"]).map(ex.Term)
    return st.recursive(leaf, lambda x: st.builds(ex.Op, st.sampled_from("+-"), x, x), max_leaves=8)


@given(trees())
def test_serialised_trees_parse_to_themselves(tree):
    assert ex.parse(ex.serialise(tree)) == tree


def test_depth_and_leaves():
    deep = A
    for _ in range(4):
        deep = ex.Op("+", deep, B)
    assert ex.depth(A) == 1 and ex.depth(deep) == 5
    ex.check_depth(deep)
    with pytest.raises(ValueError):
        ex.check_depth(ex.Op("-", deep, C))
    assert ex.leaves(ex.Op("+", ex.Op("-", B, A), B)) == ["b", "a"]


def test_nodes_are_checked():
    for bad in ("", "  "):
        with pytest.raises(ValueError):
            ex.Term(bad)
    with pytest.raises(ValueError):
        ex.Op("*", A, B)
    with pytest.raises(ValueError):
        ex.bare("a + b")
    with pytest.raises(ValueError):
        ex.from_json({"op": "+", "args": [{"term": "a"}]})
    assert ex.from_json({"op": "-", "args": [{"term": "a"}, {"term": "b"}]}) == ex.Op("-", A, B)
    assert ex.Term(" a ").term == " a "
