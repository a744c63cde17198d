"""Access control: the service's auth repository cases."""

from pyspark.sql import functions as F

from reelhouse.operators import rbac as R


def test_user_by_key_case_insensitive(spark):
    users = spark.createDataFrame([("u1", "test@test.com", "tester", "h")], "id string, email string, username string, password_hash string")
    keys = spark.createDataFrame([(1, "test@test.com"), (2, "tester"), (3, "TESTER"), (4, "non-existent")],
                                 "key_id long, login string")
    got = {r.key_id: (r.found, r.user_id) for r in R.lookup_users_by_key(keys, users).collect()}
    assert got == {1: (True, "u1"), 2: (True, "u1"), 3: (True, "u1"), 4: (False, None)}


def test_ambiguous_key(spark):
    users = spark.createDataFrame([("u1", "a@x", "Bob", "h"), ("u2", "b@x", "BOB", "h")],
                                  "id string, email string, username string, password_hash string")
    keys = spark.createDataFrame([(1, "bob")], "key_id long, login string")
    r = R.lookup_users_by_key(keys, users).collect()[0]
    assert r.ambiguous and r.n_matches == 2 and r.user_id == "u1"


def _rbac(spark):
    roles = spark.createDataFrame([("r1", "admin"), ("r2", "ghost")], "id string, name string")
    perms = spark.createDataFrame([("p1", "video:delete"), ("p2", "video:upload")], "id string, slug string")
    rp = spark.createDataFrame([("r1", "p1"), ("r1", "p2")], "role_id string, permission_id string")
    return roles, perms, rp


def test_role_permissions(spark):
    roles, perms, rp = _rbac(spark)
    got = {}
    for r in R.permissions_by_role(roles, rp, perms).collect():
        got.setdefault(r.role_name, set()).add(r.slug)
    assert got == {"admin": {"video:delete", "video:upload"}}  # ghost has none


def test_user_permissions_and_empty_user(spark):
    roles, perms, rp = _rbac(spark)
    ur = spark.createDataFrame([("u1", "r1"), ("u1", "r1")], "user_id string, role_id string")
    users = spark.createDataFrame([("u1", "alice"), ("u2", "bob")], "id string, username string")
    pairs = R.permissions_by_user(ur, rp, perms)
    assert pairs.count() == 2  # DISTINCT
    lists = {r.user_id: r.permissions for r in R.permission_lists(users, pairs).collect()}
    assert lists == {"u1": ["video:delete", "video:upload"], "u2": []}


def test_membership(spark):
    lists = spark.createDataFrame([("u1", ["video:upload", "video:delete"]), ("u2", None)],
                                  "user_id string, permissions array<string>")
    got = {(r.user_id, r.slug): r.allowed
           for r in R.permission_checks(lists, ["video:upload", "video:delete", "video:archive", ""]).collect()}
    assert got[("u1", "video:upload")] and got[("u1", "video:delete")]
    assert not got[("u1", "video:archive")] and not got[("u1", "")]
    assert not any(v for (u, _), v in got.items() if u == "u2")  # nil list is false


def test_assign_roles_outcomes(spark):
    roles = spark.createDataFrame([("r-c", "creator")], "id string, name string")
    users = spark.createDataFrame([("u1",), ("u2",)], "id string")
    ur = spark.createDataFrame([("u2", "r-c")], "user_id string, role_id string")
    req = spark.createDataFrame([(1, "u1", "creator"), (2, "ghost", "creator"), (3, "u1", "nope"),
                                 (4, "u2", "creator"), (5, "u1", "creator")], "req_id long, user_id string, role_name string")
    got = {r.req_id: (r.outcome, r.rows_affected) for r in R.assign_roles(req, users, roles, ur).collect()}
    assert got == {1: ("inserted", 1), 2: ("no_user", 0), 3: ("no_role", 0), 4: ("exists", 0), 5: ("exists", 0)}


def test_sync_permissions(spark):
    perms = spark.createDataFrame([], "id string, slug string")
    req = spark.createDataFrame([("video:upload",), ("video:delete",)], "slug string")
    once = R.sync_permissions(perms, req)
    assert sorted(r.slug for r in once.collect()) == ["video:delete", "video:upload"]
    twice = R.sync_permissions(once.drop("inserted"), spark.createDataFrame([("video:upload",)], "slug string"))
    assert twice.count() == 2 and twice.filter("inserted").count() == 0
    empty = R.sync_permissions(perms, spark.createDataFrame([], "slug string"))
    assert empty.count() == 0
    # ids are repeatable (name-based), so a rerun gives the same table
    again = R.sync_permissions(perms, req)
    assert sorted(once.select("id", "slug").collect()) == sorted(again.select("id", "slug").collect())
    assert once.select(F.countDistinct("id")).first()[0] == 2


def test_sync_same_slug_twice_in_one_list(spark):
    perms = spark.createDataFrame([], "id string, slug string")
    req = spark.createDataFrame([("video:upload",), ("video:upload",)], "slug string")
    assert R.sync_permissions(perms, req).count() == 1


def test_assigned_role_permission_visible(spark):
    roles = spark.createDataFrame([("r-c", "creator")], "id string, name string")
    perms = spark.createDataFrame([("p1", "video:upload")], "id string, slug string")
    rp = spark.createDataFrame([("r-c", "p1")], "role_id string, permission_id string")
    users = spark.createDataFrame([("u1",)], "id string")
    ur = spark.createDataFrame([], "user_id string, role_id string")
    req = spark.createDataFrame([(1, "u1", "creator")], "req_id long, user_id string, role_name string")
    new_ur = R.apply_role_assignments(ur, R.assign_roles(req, users, roles, ur))
    got = [(r.user_id, r.slug) for r in R.permissions_by_user(new_ur, rp, perms).collect()]
    assert got == [("u1", "video:upload")]


def test_sync_of_lists_that_repeat_are_empty_or_hold_nulls(spark):
    perms = spark.createDataFrame([("p1", "a")], "id string, slug string")
    req = spark.createDataFrame([(1, ["a", "b", "b"]), (2, ["c", None]), (3, []), (4, None), (5, ["b", "d"]), (6, [None])], "req_id int, slugs array<string>")
    table, out = R.sync_permission_lists(perms, req)
    assert sorted((r.slug, r.inserted) for r in table.collect()) == [("a", False), ("b", True), ("d", True)]
    no = "slug cannot be null"
    assert sorted((r.req_id, r.accepted, r.error, r.n_slugs) for r in out.collect()) == [
        (1, True, None, 2), (2, False, no, 1), (3, True, None, 0), (4, True, None, 0), (5, True, None, 2), (6, False, no, 0)]
