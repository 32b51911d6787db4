"""The expression language: terms combined by + and -, with parentheses. Parsed and checked on the driver."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Union

import numpy as np
from pyspark.sql import Column

from . import vectors

MAX_DEPTH = 5
_LEXEME = re.compile(r"[()+-]|[^\s()+-]+")
_BARE = re.compile(r"[^\s()+-]+")


@dataclass(frozen=True)
class Term:
    term: str

    def __post_init__(self) -> None:
        if not self.term.strip():
            raise ValueError("a term must not be blank")


@dataclass(frozen=True)
class Op:
    op: str
    left: "Tree"
    right: "Tree"

    def __post_init__(self) -> None:
        if self.op not in ("+", "-"):
            raise ValueError(f"unknown operator {self.op!r}")


Tree = Union[Term, Op]


def parse(text: str) -> Tree | None:
    """The tree, left-associative; None if the text is no expression."""
    lexemes = _LEXEME.findall(text)
    values: list[Tree] = []
    waiting: list[str] = []
    ready = False  # whether an operand has just ended

    def apply() -> None:
        right, left = values.pop(), values.pop()
        values.append(Op(waiting.pop(), left, right))

    for lexeme in lexemes:
        if lexeme == "(":
            if ready:
                return None
            waiting.append(lexeme)
        elif lexeme == ")":
            if not ready:
                return None
            while waiting and waiting[-1] != "(":
                apply()
            if not waiting:
                return None
            waiting.pop()
        elif lexeme in "+-":
            if not ready:
                return None
            while waiting and waiting[-1] != "(":
                apply()
            waiting.append(lexeme)
            ready = False
        else:
            if ready:
                return None
            values.append(Term(lexeme))
            ready = True
    if not ready or "(" in waiting:
        return None
    while waiting:
        apply()
    return values[0]


def from_json(node: Mapping) -> Tree:
    """A tree of {"term": ...} and {"op": ..., "args": [left, right]}."""
    if "term" in node:
        return Term(node["term"])
    if len(node.get("args", ())) != 2:
        raise ValueError("an operator takes two arguments")
    return Op(node["op"], from_json(node["args"][0]), from_json(node["args"][1]))


def bare(text: str) -> Term:
    if not _BARE.fullmatch(text):
        raise ValueError(f"{text!r} is not a single term")
    return Term(text)


def depth(tree: Tree) -> int:
    level, rank = [tree], 0
    while level:
        rank += 1
        level = [x for node in level if isinstance(node, Op) for x in (node.left, node.right)]
    return rank


def check_depth(tree: Tree) -> Tree:
    if depth(tree) > MAX_DEPTH:
        raise ValueError(f"an expression may be {MAX_DEPTH} deep")
    return tree


def leaves(tree: Tree) -> list[str]:
    """Distinct terms from left to right."""
    if isinstance(tree, Term):
        return [tree.term]
    return list(dict.fromkeys(leaves(tree.left) + leaves(tree.right)))


def serialise(tree: Tree) -> str:
    def full(node: Tree) -> str:
        return node.term if isinstance(node, Term) else f"({full(node.left)} {node.op} {full(node.right)})"

    text = full(tree)
    return text if isinstance(tree, Term) else text[1:-1]


def rewrite(tree: Tree, change: Callable[[str], str]) -> Tree:
    return Term(change(tree.term)) if isinstance(tree, Term) else Op(tree.op, rewrite(tree.left, change), rewrite(tree.right, change))


def compile_tree(tree: Tree, leaf: Callable[[str], Column]) -> Column:
    """The expression over unit vectors of the leaves; every operator's result is brought to length 1 again."""
    if isinstance(tree, Term):
        return leaf(tree.term)
    left, right = compile_tree(tree.left, leaf), compile_tree(tree.right, leaf)
    return vectors.unit(vectors.add(left, right) if tree.op == "+" else vectors.subtract(left, right))


def evaluate(tree: Tree, leaf: Mapping[str, np.ndarray]) -> np.ndarray:
    """The same for arrays whose last axis are the dimensions, such as one vector a seed."""
    if isinstance(tree, Term):
        return leaf[tree.term]
    left, right = evaluate(tree.left, leaf), evaluate(tree.right, leaf)
    v = left + right if tree.op == "+" else left - right
    return v / np.maximum(np.sqrt((v * v).sum(axis=-1, keepdims=True)), vectors.FLOOR)
