from hypothesis import given
from hypothesis import strategies as st

from lineagrid.operators.graphs import Node, cycle_message, cycle_path, smallest_order, strong_components
from lineagrid.operators.repair import UNSPLITTABLE, Piece, repair


def node(name, *deps, file=None, index=0):
    return Node(file or f"{name}.sql", index, 0, name, deps)


def names(nodes, order):
    return [nodes[k].name for k in order]


def test_ties_go_by_file_and_index():
    held = [Node("b.sql", 0, 0, "b"), Node("a.sql", 1, 0, "a1"), Node("a.sql", 0, 0, "a0")]
    assert names(held, smallest_order(held)[0]) == ["a0", "a1", "b"]


def test_order_is_not_by_levels():
    held = [node("a", "z"), node("b"), node("c"), node("z")]
    assert names(held, smallest_order(held)[0]) == ["b", "c", "z", "a"]


def test_cycle_path_starts_where_the_loop_is_entered():
    held = [node("a", "c"), node("b", "d"), node("c", "b"), node("d", "c")]
    _, left = smallest_order(held)
    assert cycle_message(held, cycle_path(held, left)).endswith("c.sql:c -> b.sql:b -> d.sql:d -> c.sql:c")


def test_the_last_of_equal_names_is_meant_and_loops_are_ignored():
    held = [node("x", "x", file="a.sql"), node("x", file="b.sql"), node("y", "x", "nowhere", file="0.sql")]
    assert smallest_order(held)[0] == [1, 2, 0]
    assert strong_components(held) == []


@given(st.lists(st.tuples(st.integers(0, 7), st.integers(0, 7)), max_size=20))
def test_components_are_those_of_reachability(pairs):
    held = [node(f"n{k}", *[f"n{b}" for a, b in pairs if a == k]) for k in range(8)]
    reach = {(a, b) for a, b in pairs if a != b}
    while True:
        more = reach | {(a, d) for a, b in reach for c, d in reach if b == c}
        if more == reach:
            break
        reach = more
    groups = {frozenset([a, *[b for b in range(8) if (a, b) in reach and (b, a) in reach]]) for a in range(8)}
    assert strong_components(held) == sorted(sorted(g) for g in groups if len(g) > 1)
    order, left = smallest_order(held)
    assert not left or any((k, k) in reach for k in left)
    for p, k in enumerate(order):
        assert not {b for a, b in pairs if a == k and a != b} - set(order[:p])


def table(name, text, *refs, kind="auto"):
    pairs = tuple((r, kind) for r in refs)
    return Piece(f"{name}.sql", 0, 0, "create_table", name, text, (), pairs, refs)


def test_cycles_of_three_tables_are_split():
    ring = [table(a, f"CREATE TABLE {a} (x int, FOREIGN KEY (x) REFERENCES {b}(x))", b) for a, b in (("a", "b"), ("b", "c"), ("c", "a"))]
    found = repair(ring, "postgres")
    assert not found.error
    kinds = [(found.pieces[k].kind, found.pieces[k].file[0]) for k in found.order]
    # A moved key comes as soon as both of its tables are there.
    assert kinds == [("create_table", "a"), ("create_table", "b"), ("alter_table", "a"), ("create_table", "c"), ("alter_table", "b"), ("alter_table", "c")]


def test_two_keys_to_one_table_both_move():
    a = table("a", "CREATE TABLE a (p int REFERENCES b(x), q int REFERENCES b(x))", "b")
    b = table("b", "CREATE TABLE b (x int REFERENCES a(p))", "a")
    found = repair([a, b], "postgres")
    assert sum(p.synthesized for p in found.pieces) == 3
    assert [p.sub for p in found.pieces if p.synthesized and p.file == "a.sql"] == [1, 2]


def test_sqlite_keeps_texts():
    a, b = table("a", "CREATE TABLE a (x int REFERENCES b(x))", "b"), table("b", "CREATE TABLE b (x int REFERENCES a(x))", "a")
    found = repair([a, b], "sqlite")
    assert [found.pieces[k].text for k in found.order] == [a.text, b.text]


def test_other_edges_stay_errors():
    a, b = table("a", "CREATE TABLE a (x int REFERENCES b(x) HUH)", "b"), table("b", "CREATE TABLE b (x int REFERENCES a(x))", "a")
    assert UNSPLITTABLE in repair([a, b], "postgres").error
    b = table("b", "CREATE TABLE b (x int)", "a", kind="directive")
    assert repair([a, b], "postgres").error == "dependency cycle detected: a.sql:a -> b.sql:b -> a.sql:a"
