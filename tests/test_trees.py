import pytest

from strandframe.operators import trees as T


def test_quoted_names_and_comments():
    tree = T.parse_newick("(('a b:1''s':2,b[note]:1)'in,ner':0.5,(c:1e-1,d:3):2)root;")
    assert [x.name for x in tree.leaves()] == ["a b:1's", "b", "c", "d"] and [x.length for x in tree.leaves()] == [2, 1, 0.1, 3]
    assert tree.children[0].name == "in,ner" and tree.name == "root"
    again = T.parse_newick(T.newick(tree))
    assert T.edges(again) == T.edges(tree)
    for bad in ("((a,b);", "(a,b));", "('a,b);", "(a[x,b);"):
        with pytest.raises(ValueError):
            T.parse_newick(bad)


def test_prune_keeps_distances():
    tree = T.parse_newick("((a:1,b:2):1,((c:1,d:1):2,e:5):1)r;")
    left = T.prune(tree, {"a", "c", "e"})
    assert [x.name for x in left.leaves()] == ["a", "c", "e"]
    old, new = ({x.name: x for x in t.leaves()} for t in (tree, left))
    for x, y in (("a", "c"), ("c", "e"), ("a", "e")):
        assert T.distance(old[x], old[y]) == T.distance(new[x], new[y])
    assert all(len(n.children) != 1 for n in T.path_up(new["c"]))
    assert T.newick(T.prune(tree, {"d"})) == "d;"
    with pytest.raises(ValueError):
        T.prune(tree, {"nobody"})


def test_scores_decide_between_equal_distances():
    tree = T.parse_newick("(a:1,b:1,c:1,d:1)r;")
    assert T.far_leaves(tree, 3) == ["b", "a", "c"]
    assert T.far_leaves(tree, 3, {"d": 5.0, "c": 7.0}) == ["c", "d", "a"]
