"""Fitted trees as column expressions: scoring is part of whole-stage code, with no vectors and no Python."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Leaf:
    value: float


@dataclass(frozen=True)
class Split:
    """``feature`` (its number) at or below ``line``, or among ``values`` where these are given, goes left."""

    feature: int
    left: Leaf | Split
    right: Leaf | Split
    line: float | None = None
    values: frozenset[float] = frozenset()
    #: whether values that the fit has not seen go left
    unseen_left: bool = False
    known: frozenset[float] = frozenset()


Tree = Leaf | Split


def of_model(model: PipelineModel) -> list[tuple[float, Tree]]:
    """(weight, tree) of a fitted pipeline of assembler, indexer and boosted trees, in the values before indexing."""
    maps: dict[int, dict[float, int]] = dict(model.stages[-2].categoryMaps)

    def read(node) -> Tree:
        if node.getClass().getSimpleName() == "LeafNode":
            return Leaf(node.prediction())
        split = node.split()
        feature, left, right = split.featureIndex(), read(node.leftChild()), read(node.rightChild())
        if split.getClass().getSimpleName() == "ContinuousSplit":
            # An indexed feature with a line is one of many levels whose index was split.
            return Split(feature, left, right, line=split.threshold())
        numbers, known, levels = set(split.leftCategories()), maps.get(feature, {}), split.numCategories()
        # An unseen level gets the number after the last; where the fit knew no such number, it goes with the larger side.
        unseen = len(known) in numbers if len(known) < levels else len(numbers) > levels // 2
        return Split(feature, left, right, values=frozenset(v for v, k in known.items() if k in numbers), unseen_left=unseen, known=frozenset(known))

    trees = model.stages[-1]
    return list(zip(trees.treeWeights, [read(t._call_java("rootNode")) for t in trees.trees]))


def _number(x: float) -> str:
    return f"CAST('{float(x)!r}' AS DOUBLE)"


def sql_of(tree: Tree, name: Callable[[int], str]) -> str:
    """The tree as one nested CASE over the SQL of its features, which must not be null."""
    if isinstance(tree, Leaf):
        return _number(tree.value)
    x = name(tree.feature)
    if tree.line is not None:
        goes_left = f"{x} <= {_number(tree.line)}"
    else:
        listed = lambda values: f"{x} IN ({', '.join(map(_number, sorted(values)))})" if values else "false"
        goes_left = listed(tree.values) if not tree.unseen_left else f"({listed(tree.values)} OR NOT {listed(tree.known)})"
    return f"CASE WHEN {goes_left} THEN {sql_of(tree.left, name)} ELSE {sql_of(tree.right, name)} END"


def prediction(forest: list[tuple[float, Tree]], features: tuple[str, ...]) -> Column:
    """The weighted sum of the trees over columns named ``features``, which must not be null."""
    out = F.lit(0.0)
    for weight, tree in forest:
        out = out + F.lit(weight) * F.expr(sql_of(tree, lambda k: f"CAST(`{features[k]}` AS DOUBLE)"))
    return out
