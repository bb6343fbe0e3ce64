import random
import re

from conftest import as_set
from pyspark.sql import functions as F

from fleetlens.operators import selection
from fleetlens.operators.selection import LITERAL_RULES, as_rules, select_items

ITEMS = "database_name string, database_type string, availability_group boolean"


def _items(rows):
    return rows(
        ITEMS, ("master", "S", False), ("Sales_1", "U", True), ("SalesX1", "U", False),
        ("archive", "U", False), ("a[b", "U", False), ("x]y", "U", None), ("HR", "U", True),
    )


def _pick(items, rules):
    picked = select_items(items, rules, ["database_name"])
    return {r.database_name: r.start_position for r in picked.filter("selected").collect()}


def test_split_list(rows):
    df = rows("t string", (" a , b\r\n,,-c ",), (None,))
    assert as_set(selection.split_list(df, "t")) == [("", 5), ("-c", 6), ("a", 1), ("b", 3)]
    df = rows("t string", ("a | b",))
    assert as_set(selection.split_list(df, "t", "|")) == [("a", 1), ("b", 3)]


def test_keywords_and_wildcards(spark, rows):
    items = _items(rows)
    assert set(_pick(items, as_rules(spark, "SYSTEM_DATABASES"))) == {"master"}
    assert set(_pick(items, as_rules(spark, "AVAILABILITY_GROUP_DATABASES"))) == {"Sales_1", "HR"}
    assert "x]y" in _pick(items, as_rules(spark, "user_databases, -%archive%"))
    assert _pick(items, as_rules(spark, "sales_1")) == {"Sales_1": 1}
    assert _pick(items, as_rules(spark, "[x]]y],hr")) == {"x]y": 1, "HR": 8}
    assert _pick(items, as_rules(spark, "nothing")) == {}


def test_excludes_win_whatever_the_order(spark, rows):
    items = _items(rows)
    one = _pick(items, as_rules(spark, "-Sales%,ALL_DATABASES"))
    two = _pick(items, as_rules(spark, "ALL_DATABASES,-Sales%"))
    assert set(one) == set(two) == {"master", "archive", "a[b", "x]y", "HR"}


def test_null_list_selects_everything(spark, rows):
    assert select_items(_items(rows), None, ["database_name"]).filter("selected").count() == 7
    assert _pick(_items(rows), as_rules(spark, None)) == {}


def _two_pass(names, rules):
    """Selection as two sequential updates."""
    out = {}
    for name in names:
        def hit(p):
            return re.fullmatch(re.escape(p).replace("%", ".*"), name, re.I | re.S)
        inc = [pos for p, pos, sel in rules if sel and hit(p)]
        exc = [pos for p, pos, sel in rules if not sel and hit(p)]
        out[name] = (bool(inc) and not exc, min(inc) if inc else None)
    return out


def test_all_paths_agree_with_two_passes(spark):
    random.seed(2)
    names = [f"{random.choice('abcd')}{random.choice('xyz')}_{i}" for i in range(60)]
    parts = [random.choice(["a%", "%x%", "b%", "-%_1%", "-cz%", random.choice(names), "-" + random.choice(names)])
             for _ in range(25)]
    parts += [f"filler{i}" for i in range(LITERAL_RULES + 5)]
    items = spark.createDataFrame([("s", n) for n in names], "server string, name string")
    rules = as_rules(spark, ",".join(parts)).select(
        F.col("database_name").alias("name"), "start_position", "selected")
    want = _two_pass(names, [(r.name, r.start_position, r.selected) for r in rules.collect()])

    def verdict(df):
        return {r["name"]: (r.selected, r.start_position) for r in df.collect()}

    short = rules.filter("name not like 'filler%'")
    assert verdict(select_items(items, short, ["name"])) == want
    assert verdict(select_items(items, rules, ["name"])) == want
    keyed = short.withColumn("server", F.lit("s"))
    assert verdict(select_items(items, keyed, ["name"], ["server"])) == want


def test_order_modes_put_never_checked_first(rows):
    items = rows("name string, selected boolean, start_position int, last_good_check date, database_size int",
                 ("b", True, 2, None, 5), ("a", True, 2, None, 5), ("c", True, 1, None, 9), ("d", False, 0, None, 1))
    items = items.withColumn("last_good_check", F.when(F.col("name") == "a", F.lit("2024-01-01").cast("date")))

    def order(mode):
        return [r.name for r in selection.order_items(items, mode).orderBy("item_order").collect()]

    assert order(None) == ["c", "a", "b"]
    assert order("DATABASE_LAST_GOOD_CHECK_ASC") == ["b", "c", "a"]
    assert order("DATABASE_LAST_GOOD_CHECK_DESC") == ["a", "b", "c"]
    assert order("DATABASE_SIZE_DESC") == ["c", "a", "b"]
    assert order("DATABASE_NAME_DESC") == ["c", "b", "a"]


def test_sync_is_idempotent(rows):
    queue = rows("database_name string, item_order int, started boolean", ("a", 1, True), ("b", 2, False))
    items = rows("database_name string, item_order int, selected boolean", ("b", 7, True), ("c", 8, True), ("a", 9, False))
    synced = selection.sync_worklist(queue, items, ["database_name"])
    assert as_set(synced.select("database_name", "item_order", "action")) == [
        ("a", 1, "DELETE"), ("b", 7, "UPDATE"), ("c", 8, "INSERT")]
    once = selection.apply_sync(synced)
    twice = selection.apply_sync(selection.sync_worklist(once, items, ["database_name"]))
    assert sorted(map(str, twice.collect())) == sorted(map(str, once.collect()))


def test_mark_done_then_pending(rows):
    work = rows("id int, completed boolean, item_order int", (1, None, 3), (2, False, 1), (3, True, 2))
    done = selection.mark_done(work, rows("id int", (2,), (2,)), ["id"])
    assert [r.id for r in selection.pending(done).collect()] == [1]


def test_conflicts(rows):
    items = rows("name string, selected boolean", ("a/b", True), ("AB ", False), ("?*", True), ("c:", False), ("C", False))
    assert as_set(selection.fs_name_conflicts(items)) == [
        ("?*", "", "EMPTY"), ("AB ", "AB", "DUPLICATE"), ("a/b", "ab", "DUPLICATE")]


def test_no_missing_names_gives_no_row(spark, rows):
    assert selection.missing_items(as_rules(spark, "HR,%x%"), _items(rows)).count() == 0


def test_validate(rows):
    values = rows("a string", ("X",), ("X",), ("Y",), (None,), ("BAD",))
    assert as_set(selection.validate_choices(values, "a", ["X", "Y"])) == [
        ("BAD", "NOT_ALLOWED", 1), ("X", "DUPLICATE", 2)]


def test_many_patterns_per_key_meet_their_items(spark):
    """Patterns of all shapes, with classes, anchors and letters of other alphabets, per server and as one list."""
    rng = random.Random(6)
    letters = "abAB_1é.ß-"
    names = sorted({"".join(rng.choices(letters, k=rng.randrange(1, 9))) for _ in range(150)})
    patterns = []
    for i in range(900):
        base = "".join(rng.choices(letters, k=rng.randrange(0, 4)))
        shape = rng.choice(["%{}%", "{}%", "%{}", "{}%{}", "[ab]{}%", "{}[^a]%", "%", "{}", "%[_]{}", "%{}%[1é]%"])
        patterns.append((shape.format(base, base[::-1]) or "x", i + 1, rng.random() < 0.9))
    servers = ["s1", "s2", "none"]
    items = spark.createDataFrame([(s, n) for s in servers for n in names], "server string, name string")
    ruled = [(rng.choice(servers[:2]), *p) for p in patterns] + [("s1", None, 1, True)]
    rules = spark.createDataFrame(ruled, "server string, name string, start_position int, selected boolean")
    per_server = select_items(items, rules, ["name"], keys=["server"])
    found = {(r.server, r.name): (r.selected, r.start_position) for r in per_server.collect()}
    assert len(found) == items.count()
    for server in servers:
        own = rules.filter(F.col("server") == server).drop("server")
        short = select_items(items.filter(F.col("server") == server).drop("server"), own, ["name"])
        want = {(server, r.name): (r.selected, r.start_position) for r in short.collect()}
        assert {k: v for k, v in found.items() if k[0] == server} == want
        assert own.count() <= LITERAL_RULES
    long = rules.drop("server")
    one = {r.name: (r.selected, r.start_position) for r in select_items(items.filter("server = 's1'").drop("server"), long, ["name"]).collect()}
    both = {}
    for name in names:
        hits = [found["s1", name], found["s2", name]]
        places = [p for _, p in hits if p is not None]
        both[name] = min(places, default=None)
    assert {n: p for n, (_, p) in one.items()} == both
