"""Einstein summation: every label is a column, every pairwise step a join on shared labels and a sum."""

from __future__ import annotations

import random
from functools import lru_cache
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.meta import Tensor, TensorError

#: Operands whose orders are searched, those whose subsets are, and blurred paths that are tried.
MOST_SEARCHED, MOST_SUBSETS, TRIES = 10, 20, 32


def parse(equation: str, operands: int) -> tuple[list[str], str]:
    """(labels of each operand, labels of the output) of an explicit equation."""
    equation = equation.replace(" ", "")
    if "->" not in equation or "." in equation:
        raise TensorError("equations are explicit (with ->) and without ellipsis")
    left, _, right = equation.partition("->")
    inputs = left.split(",")
    if len(inputs) != operands:
        raise TensorError(f"{len(inputs)} operands in the equation, {operands} given")
    if len(set(right)) != len(right) or not set(right) <= set("".join(inputs)):
        raise TensorError("output labels must be different and occur in an operand")
    if not all(c.isalpha() for c in "".join(inputs)):
        raise TensorError("labels are letters")
    return inputs, right


def sizes(inputs: list[str], shapes: list[tuple[int, ...]]) -> dict[str, int]:
    out: dict[str, int] = {}
    for labels, shape in zip(inputs, shapes, strict=True):
        if len(labels) != len(shape):
            raise TensorError(f"{labels} names {len(labels)} axes of {len(shape)}")
        for c, n in zip(labels, shape):
            if out.setdefault(c, n) != n:
                raise TensorError(f"label {c} has lengths {out[c]} and {n}")
    return out


class _Network:
    """The operands of an equation as sets of labels, and what contracting some of them leaves and costs."""

    def __init__(self, inputs: list[str], output: str, length: dict[str, int]):
        self.terms, self.output, self.length = [frozenset(x) for x in inputs], frozenset(output), length

    def size(self, labels) -> int:
        return _product(self.length[c] for c in labels)

    def joined(self, parts: list[frozenset], i: int, j: int) -> tuple[frozenset, int, list[frozenset]]:
        """(labels left, products, the parts afterwards) of contracting two parts."""
        rest = [x for k, x in enumerate(parts) if k not in (i, j)]
        both = parts[i] | parts[j]
        left = both & self.output.union(*rest)
        return left, self.size(both), [*rest, left]

    def by_subsets(self) -> list[tuple[int, int]]:
        """The cheapest order without products of parts that share no label: best costs of connected subsets, as bits, by the number of operands.

        Groups of operands without a common label are contracted each, and multiplied in the end, smallest first.
        """
        n = len(self.terms)
        groups, left = [], set(range(n))
        while left:
            group, edge = set(), {min(left)}
            while edge:
                group |= edge
                seen = frozenset().union(*(self.terms[k] for k in group))
                edge = {k for k in left - group if self.terms[k] & seen}
            groups.append(sorted(group))
            left -= group
        trees = [self._best_tree(group) for group in groups]
        trees.sort(key=lambda t: self.size(t[1]))
        tree = trees[0][0]
        for other, _ in trees[1:]:
            tree = (tree, other)
        return _pairs(tree, n)

    def _best_tree(self, group: list[int]):
        bits = {k: 1 << p for p, k in enumerate(group)}
        whole = (1 << len(group)) - 1
        outside = self.output.union(*(t for k, t in enumerate(self.terms) if k not in bits))
        holds: dict[str, int] = {}
        for k in group:
            for c in self.terms[k]:
                holds[c] = holds.get(c, 0) | bits[k]

        @lru_cache(None)
        def labels(mask: int) -> frozenset:
            return frozenset(c for c, m in holds.items() if m & mask and (m & ~mask or c in outside))

        best: dict[int, tuple[int, object]] = {b: (0, k) for k, b in bits.items()}
        by_count: list[list[int]] = [[], list(best)]
        for count in range(2, len(group) + 1):
            made: dict[int, tuple[int, object]] = {}
            for few in range(1, count // 2 + 1):
                for x in by_count[few]:
                    for y in by_count[count - few]:
                        if x & y or (few * 2 == count and x > y):
                            continue
                        one, two = labels(x) if few > 1 else self.terms[best[x][1]], labels(y) if count - few > 1 else self.terms[best[y][1]]
                        if not one & two:
                            continue
                        cost = best[x][0] + best[y][0] + self.size(one | two)
                        if x | y not in made or cost < made[x | y][0]:
                            made[x | y] = cost, (best[x][1], best[y][1])
            best.update(made)
            by_count.append(list(made))
        return best[whole][1], labels(whole)

    def by_branches(self, most: int | None = None) -> list[tuple[int, int]]:
        """Depth first over all pairs, cheapest first; a branch is left where it cannot beat the best path so far, or makes a part of over ``most`` cells."""
        best: list = [None, ()]
        reached: dict[tuple, int] = {}

        def go(parts: list[frozenset], cost: int, path: tuple) -> None:
            if len(parts) < 2:
                if best[0] is None or cost < best[0]:
                    best[:] = cost, path
                return
            state = tuple(sorted("".join(sorted(p)) for p in parts))
            if reached.get(state, cost + 1) <= cost:
                return
            reached[state] = cost
            options = sorted(((*self.joined(parts, i, j), (i, j)) for i, j in combinations(range(len(parts)), 2)), key=lambda o: (o[1], o[3]))
            for left, flops, rest, pair in options:
                if best[0] is not None and cost + flops >= best[0]:
                    break
                if most is None or self.size(left) <= most:
                    go(rest, cost + flops, (*path, pair))

        go(list(self.terms), 0, ())
        if best[0] is None:
            raise TensorError("no order keeps every part within the size")
        return list(best[1])

    def by_search(self) -> list[tuple[int, int]]:
        """All orders of pairs, with the best of each set of parts remembered."""

        @lru_cache(None)
        def search(parts: tuple[frozenset, ...]) -> tuple[int, tuple]:
            if len(parts) < 2:
                return 0, ()
            options = []
            for i, j in combinations(range(len(parts)), 2):
                _, flops, rest = self.joined(list(parts), i, j)
                more, path = search(tuple(rest))
                options.append((flops + more, ((i, j), *path)))
            return min(options)

        return list(search(tuple(self.terms))[1])

    def by_greed(self, blur=lambda: 1.0) -> tuple[int, list[tuple[int, int]]]:
        """(products, path) of taking the cheapest pair at a time, by costs that ``blur`` multiplies."""
        parts, total, taken = list(self.terms), 0, []
        while len(parts) > 1:
            pair = min(combinations(range(len(parts)), 2), key=lambda p: (self.joined(parts, *p)[1] * blur(), p))
            _, flops, parts = self.joined(parts, *pair)
            total += flops
            taken.append(pair)
        return total, taken


def _pairs(tree, n: int) -> list[tuple[int, int]]:
    """Positions of a tree of operands as pairs, where each result goes to the end of the list."""
    alive, out = list(range(n)), []

    def walk(node) -> object:
        if isinstance(node, int):
            return node
        one, two = walk(node[0]), walk(node[1])
        at = sorted((alive.index(one), alive.index(two)))
        out.append(tuple(at))
        alive.pop(at[1])
        alive.pop(at[0])
        alive.append(node)
        return node

    walk(tree)
    return out


def find_path(equation: str, *shapes: tuple[int, ...], strategy: str = "auto", most_cells: int | None = None) -> tuple[list[tuple[int, int]], list[dict]]:
    """(pairs of positions, one record per step) for a contraction; new intermediates go to the end of the list.

    "optimal" searches all orders of up to ``MOST_SEARCHED`` operands; "branch-all" does so depth first with bounds, and with ``most_cells`` keeps every
    part within a size; "dp" finds the best order of connected subsets of up to ``MOST_SUBSETS`` operands; "greedy" takes the cheapest pair at
    a time, "random-greedy" the best of ``TRIES`` such paths whose costs are blurred by a fixed seed, "left" the operands in turn; "auto" searches up to
    six operands, takes subsets up to ``MOST_SUBSETS``, and greed beyond.
    """
    inputs, output = parse(equation, len(shapes))
    net = _Network(inputs, output, sizes(inputs, list(shapes)))
    n = len(net.terms)
    if strategy == "auto":
        strategy = "optimal" if n <= 6 else "dp" if n <= MOST_SUBSETS else "greedy"
    limit = {"optimal": MOST_SEARCHED, "branch-all": MOST_SEARCHED, "dp": MOST_SUBSETS}.get(strategy, n)
    if n > limit:
        raise TensorError(f"strategy {strategy} takes at most {limit} operands; use greedy")
    if strategy == "optimal":
        path = net.by_search()
    elif strategy == "branch-all":
        path = net.by_branches(most_cells)
    elif strategy == "dp":
        path = net.by_subsets()
    elif strategy == "greedy":
        path = net.by_greed()[1]
    elif strategy == "random-greedy":
        rng = random.Random(17)
        path = min([net.by_greed(), *(net.by_greed(lambda: rng.uniform(0.5, 2.0)) for _ in range(TRIES))], key=lambda x: x[0])[1]
    elif strategy == "left":
        path = [(0, 1)] * (n > 1) + [(0, k) for k in range(n - 2, 0, -1)]
    else:
        raise TensorError(f"strategy {strategy}")
    parts, steps = list(net.terms), []
    for k, (i, j) in enumerate(path):
        left, right = parts[i], parts[j]
        result, flops, parts = net.joined(parts, i, j)
        steps.append({"step": k, "left": "".join(sorted(left)), "right": "".join(sorted(right)), "result": "".join(sorted(result)), "flops": flops, "cells": net.size(result)})
    return path, steps


STRATEGIES = ("left", "greedy", "random-greedy", "dp", "branch-all", "optimal")


def compare_strategies(spark, equation: str, *shapes: tuple[int, ...], strategies: tuple[str, ...] = STRATEGIES) -> DataFrame:
    """(strategy, steps, flops, largest): products and largest part of the path of each strategy."""
    rows = []
    for name in strategies:
        steps = find_path(equation, *shapes, strategy=name)[1]
        rows.append((name, len(steps), sum(s["flops"] for s in steps), max((s["cells"] for s in steps), default=0)))
    return spark.createDataFrame(rows, "strategy string, steps long, flops long, largest long")


def _product(numbers) -> int:
    out = 1
    for n in numbers:
        out *= n
    return out


def path_table(spark, equation: str, *shapes: tuple[int, ...], strategy: str = "auto") -> DataFrame:
    """(strategy, step, operands, result, flops) of a contraction path."""
    rows = [(strategy, s["step"], f"{s['left']},{s['right']}", s["result"], s["flops"]) for s in find_path(equation, *shapes, strategy=strategy)[1]]
    return spark.createDataFrame(rows, "strategy string, step long, operands string, result string, flops long")


def _operand(t: Tensor, labels: str, keep: set[str]) -> DataFrame:
    """Columns by label; a label that repeats keeps its diagonal, labels that nothing else needs are summed out."""
    df, seen, columns = t.df, {}, []
    for c, label in zip(t.index, labels):
        if label in seen:
            df = df.where(F.col(c) == F.col(seen[label]))
        else:
            seen[label] = c
            columns.append(F.col(c).alias(label))
    df = df.select(*columns, "v")
    return _summed(df, [x for x in seen if x in keep]) if set(seen) - keep else df


def _summed(df: DataFrame, labels: list[str]) -> DataFrame:
    return df.groupBy(*labels).agg(F.sum("v").alias("v")) if labels else df.agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("v"))


def einsum(equation: str, *tensors: Tensor, path: list[tuple[int, int]] | None = None, strategy: str = "auto") -> Tensor:
    """Any explicit contraction of real tensors, pair by pair along ``path`` (found by ``strategy`` if not given)."""
    inputs, output = parse(equation, len(tensors))
    length = sizes(inputs, [t.shape for t in tensors])
    if any(t.complex for t in tensors):
        raise TensorError("einsum takes real tensors")
    path = find_path(equation, *[t.shape for t in tensors], strategy=strategy)[0] if path is None else path
    needed = lambda k: set(output).union(*(set(x) for n, x in enumerate(inputs) if n != k))
    parts = [(set(x) & needed(k), _operand(t, x, needed(k))) for k, (t, x) in enumerate(zip(tensors, inputs))]
    for i, j in path:
        (left, a), (right, b) = parts[i], parts[j]
        parts = [p for n, p in enumerate(parts) if n not in (i, j)]
        keep = set(output).union(*(p[0] for p in parts))
        a, b = a.withColumnRenamed("v", "x"), b.withColumnRenamed("v", "y")
        both = sorted(left & right)
        # without a shared label the result is the outer product, whose every cell is asked for
        pairs = a.join(b, both) if both else a.crossJoin(b)
        labels = sorted((left | right) & keep)
        df = pairs.select(*labels, (F.col("x") * F.col("y")).alias("v"))
        parts.append((set(labels), _summed(df, labels) if set(labels) != left | right else df))
    if len(parts) != 1:
        raise TensorError("the path leaves more than one operand")
    df = parts[0][1]
    df = _summed(df, list(output)) if parts[0][0] != set(output) else df
    out = df.select(*[F.col(c).alias(f"i{k}") for k, c in enumerate(output)], "v")
    return Tensor(out, tuple(length[c] for c in output), sparse=any(t.sparse for t in tensors))


def expression(equation: str, *shapes: tuple[int, ...], strategy: str = "auto"):
    """A contraction whose path is found once, for tensors of these shapes."""
    path = find_path(equation, *shapes, strategy=strategy)[0]
    return lambda *tensors: einsum(equation, *tensors, path=path)


def tensordot(a: Tensor, b: Tensor, dims: int = 2) -> Tensor:
    """Contract the last ``dims`` axes of a with the first ``dims`` of b."""
    if dims > min(a.rank, b.rank):
        raise TensorError("more axes than the tensors have")
    names = "abcdefghijklmnopqrstuvwxyz"
    left = names[: a.rank]
    right = left[a.rank - dims :] + names[a.rank : a.rank + b.rank - dims]
    return einsum(f"{left},{right}->{left[: a.rank - dims]}{right[dims:]}", a, b)
