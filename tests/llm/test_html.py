"""The HTML scanner on broken markup."""

import time

import pytest

from inkwell.llm import style_tree


def text(source):
    def leaves(node):
        return [node.text] if node.tag == "#text" else [x for kid in node.kids for x in leaves(kid)]

    return leaves(style_tree.parse(source))


@pytest.mark.parametrize(
    "source,want",
    [
        ("<p>a<p>b", ["a", "b"]),
        ("<a title='x>y'>in</a>out", ["in", "out"]),
        ("<a title='open>in</a>out", ["in", "out"]),  # a value that isn't closed ends at the next >
        ("a < b <c", ["a < b <c"]),
        ("x<!-- no end", ["x"]),
        ("x<!doctype html>y<script>'<p>'</script>z", ["x", "y", "z"]),
        ("<SCRIPT>a</Script>b", ["b"]),
        ("İ<script>a</script>b", ["İ", "b"]),
        ("<div></x></div>end", ["end"]),
        ("", []),
    ],
)
def test_text_of(source, want):
    assert text(source) == want


@pytest.mark.parametrize("piece", ["<a '", "<a '>'", "<!", "<a \"'>", "<div></x>", "<script>", '<a b="<', "<p class='", "<", "<b></i>"])
def test_time_is_linear(piece):
    began = time.process_time()
    style_tree.parse(piece * 60_000)
    assert time.process_time() - began < 10


def test_many_open_elements_and_ends_of_others():
    began = time.process_time()
    style_tree.parse("<div>" * 60_000 + "</x>" * 60_000)
    assert time.process_time() - began < 10
