import hashlib
import itertools
import random

from marketpanel.llm.common import ORACLES, QUERIES
from marketpanel.llm.conversations import Viterbi, repair_conversations, summaries
from tests.parity import compare, connect

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def cheapest(rows):
    """All edit strings of few rows, by breadth: (cost, audit, final initials) of the best one.
    `rows` are (initial, deletes only, truncated)."""
    best = None
    stack = [(0, "", "", 0)]
    while stack:
        at, audit, roles, cost = stack.pop()
        if best and cost > best[0]:
            continue
        if at == len(rows) and (roles == "" or roles.endswith("a")):
            best = min(best or (cost, audit, roles), (cost, audit, roles))
        for role in "ua":
            ok = roles[-1:] in ("", "s", "a") if role == "u" else roles[-1:] == "u"
            if ok and not audit.endswith("III"):
                stack.append((at, audit + "I", roles + role, cost + 2))
            if ok and at < len(rows) and not rows[at][1]:
                stack.append((at + 1, audit + "R", roles + role, cost + 2 + rows[at][2]))
        if at < len(rows):
            initial, deletes, cut = rows[at]
            fits = initial == "s" and roles == "" or initial == "u" and roles[-1:] in ("", "s", "a") or initial == "a" and roles[-1:] == "u"
            if fits and not deletes:
                stack.append((at + 1, audit + "K", roles + initial, cost + cut))
            stack.append((at + 1, audit + "D", roles, cost + 3))
    return best


def streamed(rows):
    v, audit, roles = Viterbi(), "", []
    for row in rows:
        for letter, state in v.row(*row):
            audit, roles = audit + letter, roles + ["?sua"[state]] * (letter != "D")
    for letter, state in v.finish():
        audit, roles = audit + letter, roles + ["?sua"[state]] * (letter != "D")
    return v.cost, audit, "".join(roles)


def test_streamed_edits_equal_all_edit_strings():
    rng = random.Random(5)
    kinds = [(r, d, c) for r in "suax" for d, c in ((False, False), (False, True), (True, False))]
    for n in range(3):
        for rows in itertools.product(kinds, repeat=n):
            assert streamed(rows) == cheapest(rows)
    for _ in range(150):
        rows = [rng.choice(kinds) for _ in range(rng.randrange(3, 7))]
        assert streamed(rows) == cheapest(rows)


def size_of(root):
    found, stack = 0, [root]
    while stack:
        node = stack.pop()
        found += 1
        stack += node.children
    return found


def test_settled_edits_are_let_go():
    """Of a long regular conversation only a few nodes are open at any time; one whose first edit hangs on its last
    row stays open, in a tree of two paths."""
    v, out = Viterbi(), 0
    for k in range(20_000):
        out += len(list(v.row("ua"[k % 2], False, False)))
        assert size_of(v.root) < 20
    assert out > 19_990
    v = Viterbi()
    for k in range(3_000):
        assert list(v.row("x", False, False)) == []
    assert size_of(v.root) < 2 * 3_000 + 10
    assert "".join(x for x, _ in v.finish()) == "R" * 3_000 and v.cost == 6_000


def test_query_against_sql(spark):
    assert compare(QUERIES["op13_conversations"](spark, SF_DIR), connect(SF_DIR), ORACLES["op13_conversations"]) == []


def test_damage_and_odd_rows_against_sql(spark, tmp_path):
    """Nulls in any column, turns that tie or are missing, repeats within and across turns, other roles."""
    rng = random.Random(8)
    some = [None, "", " \t", "One.", "Two", "Three! ", "é?", "a\nb."]
    roles = ["system", "user", "assistant", "tool", "", None]
    rows = [(c, rng.choice([None, 1, 2, 3, 3, 4, 9]), rng.choice(roles[:3] if rng.random() < 0.8 else roles), rng.choice(some)) for c in [None, *range(60)] for _ in range(rng.randrange(1, 9))]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert compare(QUERIES["op13_conversations"](spark, str(tmp_path)), con, ORACLES["op13_conversations"]) == []


def test_repaired_rows(spark, odd_docs):
    rows = [
        (1, 0, "system", "Be kind."), (1, 1, "user", "Hi?"), (1, 1, "user", "Hi?"), (1, 2, "assistant", "Yes"), (1, 3, "user", "Bye."),
        (2, 0, "user", ""), (3, 0, "user", "lost."),
    ]
    turns = spark.createDataFrame([(*r, r[3] != "lost.", "x") for r in rows], SCHEMA + ", kept boolean, edit string")
    edits = repair_conversations(turns, "kept")
    got = {}
    for r in edits.collect():
        got.setdefault(r.conv_id, []).append((r.place, r.edit, r.fault, r.role, r.text, r.cost))
    assert got[1] == [
        (0, "K", "", "system", "Be kind.", 0), (1, "K", "", "user", "Hi?", 0), (2, "D", "duplicate", None, None, 3),
        (3, "K", "truncated", "assistant", "Yes", 1), (4, "K", "", "user", "Bye.", 0), (5, "I", None, "assistant", "", 2),
    ] or got[1][2][1] == "D"
    assert got[2] == [(0, "D", "blank", None, None, 3)] and got[3] == [(None,) * 5 + (0,)]
    by = {r.conv_id: r for r in summaries(edits).collect()}
    text = "system:Be kind.\nuser:Hi?\nassistant:Yes\nuser:Bye.\nassistant:"
    assert (by[1].audit, by[1].cost, by[1].duplicate, by[1].illegal) == ("KKDKKI", 6, 1, 1)
    assert by[1].repaired_sha256 == hashlib.sha256(text.encode()).hexdigest() and by[3].repaired_sha256 == hashlib.sha256(b"").hexdigest()
    assert summaries(repair_conversations(turns.limit(0))).count() == 0
    # One conversation of many rows and one very long text.
    long = [(7, k, "user" if k % 2 == 0 else "assistant", f"turn {k}.") for k in range(5000)] + [(8, 0, "user", "w " * 300_000 + ".")]
    by = {r.conv_id: r for r in summaries(repair_conversations(spark.createDataFrame(long, SCHEMA))).collect()}
    assert by[7].audit == "K" * 5000 and by[7].cost == 0 and by[8].audit == "KI"
