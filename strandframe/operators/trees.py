"""Trees with branch lengths: parsing, distances, and subsets of leaves far apart.

Trees have at most a few hundred leaves, so this is driver-side code; edges() makes a table.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Node:
    name: str = ""
    length: float = 0.0
    parent: "Node | None" = None
    children: list["Node"] = field(default_factory=list)

    def leaves(self) -> list["Node"]:
        return [self] if not self.children else [x for c in self.children for x in c.leaves()]


def parse_newick(text: str) -> Node:
    """The root of a Newick tree. Names may stand in single quotes, a doubled quote inside being one; comments in brackets are skipped."""
    root = node = Node()
    name, word, at, text = None, "", 0, text.strip()
    if text.endswith(";"):
        text = text[:-1]

    def close(n: Node) -> None:
        plain, _, length = word.strip().partition(":")
        n.name = name if name is not None else plain
        n.length = float(length) if length else 0.0

    while at < len(text):
        c = text[at]
        at += 1
        if c == "'":
            name, open_ = name or "", True
            while at < len(text):
                if text[at] != "'":
                    name += text[at]
                elif text[at + 1 : at + 2] == "'":
                    name += "'"
                    at += 1
                else:
                    open_ = False
                    at += 1
                    break
                at += 1
            if open_:
                raise ValueError("a quote without its partner")
        elif c == "[":
            at = text.find("]", at) + 1
            if not at:
                raise ValueError("a comment without its end")
        elif c == "(":
            child = Node(parent=node)
            node.children.append(child)
            node = child
        elif c in ",)":
            close(node)
            name, word = None, ""
            node = node.parent
            if node is None:
                raise ValueError("unbalanced tree")
            if c == ",":
                child = Node(parent=node)
                node.children.append(child)
                node = child
        else:
            word += c
    close(node)
    if node is not root:
        raise ValueError("unbalanced tree")
    return root


def newick(node: Node) -> str:
    """The text of a tree; names with signs of the format are quoted."""

    def part(n: Node) -> str:
        plain = all(c.isalnum() or c in "_.-" for c in n.name)
        name = n.name if plain else "'" + n.name.replace("'", "''") + "'"
        inner = "(" + ",".join(part(c) for c in n.children) + ")" if n.children else ""
        return f"{inner}{name}" + (f":{n.length:g}" if n.parent else "")

    return part(node) + ";"


def prune(root: Node, keep: set[str]) -> Node:
    """A new tree of the kept leaves; inner nodes with one child left are joined with it, their lengths added."""

    def copy(n: Node) -> Node | None:
        if not n.children:
            return Node(n.name, n.length) if n.name in keep else None
        below = [c for c in map(copy, n.children) if c is not None]
        if not below:
            return None
        if len(below) == 1:
            below[0].length += n.length
            return below[0]
        out = Node(n.name, n.length, None, below)
        for c in below:
            c.parent = out
        return out

    if missing := keep - {x.name for x in root.leaves()}:
        raise ValueError(f"no such leaves: {sorted(missing)}")
    top = copy(root)
    if top is None:
        raise ValueError("nothing is kept")
    top.parent, top.length = None, 0.0
    return top


def edges(root: Node) -> list[tuple[str, str | None, float]]:
    """(node, parent, branch length) of every node."""
    return [(root.name, root.parent.name if root.parent else None, root.length)] + [e for c in root.children for e in edges(c)]


def path_up(node: Node) -> list[Node]:
    return [node] + (path_up(node.parent) if node.parent else [])


def common_ancestor(a: Node, b: Node) -> Node:
    above = {id(x) for x in path_up(a)}
    return next(x for x in path_up(b) if id(x) in above)


def distance(a: Node, b: Node, topological: bool = False) -> float:
    """Sum of branch lengths (or number of branches) between two nodes."""
    top = common_ancestor(a, b)
    total = 0.0
    for n in (a, b):
        while n is not top:
            total += 1 if topological else n.length
            n = n.parent
    return total


def far_leaves(root: Node, n: int, scores: dict[str, float] | None = None) -> list[str]:
    """n leaf names spread over the tree: the far pair first, then ever the leaf farthest from what is covered.

    Branches on the way to chosen leaves count as covered (length 0). Equal distances go to the
    higher score, then to the earlier leaf.
    """
    all_leaves = root.leaves()
    if len({x.name for x in all_leaves}) < len(all_leaves) or any(not x.name for x in all_leaves):
        raise ValueError("leaf names must be unique and not empty")
    if not 2 <= n <= len(all_leaves):
        raise ValueError("between 2 and all leaves")
    score = scores or {}

    def farthest(measure) -> Node:
        return max(enumerate(all_leaves), key=lambda x: (measure(x[1]), score.get(x[1].name, 0.0), -x[0]))[1]

    a = farthest(lambda x: distance(all_leaves[0], x))
    b = farthest(lambda x: distance(a, x))
    chosen = [a, b]
    top = common_ancestor(a, b)
    covered = {id(top)} | {id(x) for leaf in (a, b) for x in path_up(leaf)[: path_up(leaf).index(top)]}

    def gap(x: Node) -> float:
        if x in chosen:
            return -1.0
        total, up = 0.0, path_up(x)
        for y in up:
            if id(y) in covered:
                return total
            total += y.length
        rest = 0.0  # the covered part lies below an ancestor: climb down to it
        y = top
        while y is not None and id(y) not in {id(z) for z in up}:
            rest += y.length
            y = y.parent
        meet = y
        return sum(z.length for z in up[: up.index(meet)]) + rest

    while len(chosen) < n:
        leaf = farthest(gap)
        chosen.append(leaf)
        meet = common_ancestor(leaf, top)
        for start in (leaf, top):
            y = start
            while y is not meet:
                covered.add(id(y))
                y = y.parent
        covered.add(id(meet))
        top = meet
    return [x.name for x in chosen]
