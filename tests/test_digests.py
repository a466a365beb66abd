import pytest

from riskledger.operators import digests as DG

FILES = [("s", "/r/a/x", "1"), ("s", "/r/a/y", "2"), ("s", "/r/b/c/z", "3"), ("s", "/top", "4"), ("t", "/r/a/x", "1"), ("s", "rel/q", None)]


@pytest.fixture()
def states(spark):
    return lambda rows: spark.createDataFrame(rows, "scan_id string, path string, state_key string")


def digests(df):
    return {(r.scan_id, r.dir): r for r in DG.directory_digests(df).collect()}


def compared(states, old, new):
    return DG.compare_directories(DG.directory_digests(states(old)), DG.directory_digests(states(new)))


def test_digests_do_not_depend_on_order_or_other_scans(states):
    got = digests(states(FILES))
    again = digests(states(FILES[::-1]).repartition(5))
    assert {k: tuple(r) for k, r in got.items()} == {k: tuple(r) for k, r in again.items()}
    assert set(got) == {("s", d) for d in ("", "/r", "/r/a", "/r/b", "/r/b/c", "rel")} | {("t", d) for d in ("", "/r", "/r/a")}
    assert (got[("s", "")].files, got[("s", "")].tree_files) == (1, 4) and got[("s", "/r/b")].own is None
    assert (got[("s", "/r")].files, got[("s", "/r")].tree_files) == (0, 3) and got[("s", "/r/a")].files == 2
    twice = digests(states(FILES + FILES[:1]))
    assert twice[("s", "/r/a")].own != got[("s", "/r/a")].own and twice[("t", "")].tree == got[("t", "")].tree


def test_one_change_shows_on_its_way_up_only(states):
    new = [("s", "/r/b/c/z", "9") if r[1] == "/r/b/c/z" else r for r in FILES]
    got = compared(states, FILES, new)
    state = {(r.scan_id, r.dir): (r.state, r.own_differs) for r in got.collect()}
    assert {k for k, v in state.items() if v[0] == "changed"} == {("s", d) for d in ("", "/r", "/r/b", "/r/b/c")}
    assert {k for k, v in state.items() if v[1]} == {("s", "/r/b/c")}
    assert {tuple(r) for r in DG.unchanged_roots(got).collect()} == {("s", "/r/a"), ("s", "rel"), ("t", "")}
    assert [tuple(r) for r in DG.changed_files(states(FILES), states(new), got).collect()] == [("s", "/r/b/c/z", "changed")]


def test_new_gone_moved_null_and_empty(states):
    new = [r for r in FILES if r[1] != "/r/a/y" and r[0] != "t"] + [("s", "/r/n/y", "2"), ("s", "rel/p", None), (None, "/x", "1"), ("s", None, "1")]
    got = compared(states, FILES, new)
    state = {(r.scan_id, r.dir): r.state for r in got.collect()}
    assert state[("s", "/r/n")] == "new" and state[("t", "")] == "gone" and state[("s", "/r/b")] == "same"
    files = {tuple(r) for r in DG.changed_files(states(FILES), states(new), got).collect()}
    assert files == {("s", "/r/a/y", "gone"), ("s", "/r/n/y", "new"), ("s", "rel/p", "new"), ("t", "/r/a/x", "gone")}
    assert compared(states, [], []).count() == 0
    assert {r.state for r in compared(states, [], FILES).collect()} == {"new"}


def test_a_hot_directory_in_shares(spark):
    many = spark.range(20000).selectExpr("'s' scan_id", "concat('/h/f', id) path", "cast(id as string) state_key")
    one = DG.directory_digests(many).where("dir = '/h'").first()
    other = DG.directory_digests(many.where("id <> 7")).where("dir = '/h'").first()
    assert one.files == 20000 and other.files == 19999 and one.own != other.own and one.tree != other.tree
