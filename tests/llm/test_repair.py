"""Conversation repair against a brute-force search of edits, and its SQL, on odd tables."""

import hashlib
import random
import zlib
from functools import lru_cache

import duckdb
import pytest

from checking import rows_of
from clausegrid.llm import repair as R

BLANKS = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def after_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        f = zlib.crc32(key.encode()) % 20
        mine = out.setdefault(conv, [])
        if f == 1:
            text = ""
        if f == 2:
            text = text.replace(".", "").replace("!", "").replace("?", "")
        if f == 4:
            role = "user"
        if f:
            mine += [(turn, role, text)] * (2 if f == 3 else 1)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())
    return {c: sorted(v, key=order) for c, v in out.items()}


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(BLANKS)
        out.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else ".")
        seen.add((role, text))
    return out


def edits(rows, faults):
    """The least (cost, audit) and its lines over all edits, by trying every one from every state."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}

    @lru_cache(maxsize=None)
    def best(i, state, inserted):
        options = [(0, "", ())] if i == len(rows) and state in (0, 3) else []
        if inserted < 2:
            for r, name in (("u", "user"), ("a", "assistant")):
                if (state, r) in step:
                    c, a, x = best(i, step[state, r], inserted + 1)
                    options.append((c + 5, "I" + a, (f"{name}:",) + x))
        if i < len(rows):
            _, role, text = rows[i]
            c, a, x = best(i + 1, state, 0)
            options.append((c + 2, "D" + a, x))
            if faults[i] in "t.":
                more = 5 * (faults[i] == "t")
                for edit, cost, r, name in (("K", 0, role[:1], role), ("R", 1, "u", "user"), ("R", 1, "a", "assistant")):
                    if (state, r) in step:
                        c, a, x = best(i + 1, step[state, r], 0)
                        options.append((c + cost + more, edit + a, (f"{name}:{text}",) + x))
        return min(options, key=lambda o: o[:2]) if options else (10**9, "", ())

    return best(0, 0, 0)


def brute(rows):
    out, after = [], after_damage(rows)
    for conv in {r[0] for r in rows}:
        mine = after.get(conv, [])
        faults = faults_of(mine)
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit, lines = edits(mine, tuple(faults))
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, *(faults.count(f) for f in "bdt"), illegal, cost, audit, sha))
    return sorted(out, key=repr)


def conversations(seed, n=300):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "and then", "", " \n", None, "Fine. ", "é. \t", "a.b"]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", None, "", "User", "agent"]
    rows = []
    for conv in range(n):
        for turn in range(rng.randrange(9)):
            rows.append((rng.choice([conv, conv, conv, None]) if conv % 50 == 0 else conv, turn if rng.random() < 0.9 else rng.choice([None, 3]), rng.choice(roles), rng.choice(texts)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force_and_sql(spark, seed):
    rows = conversations(seed)
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], SCHEMA + ", identity string, kind int").repartition(7)
    got = R.repair_report(df)
    want = brute(rows)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    cur = con.execute(R.check_sql())
    assert rows_of([d[0] for d in cur.description], cur.fetchall())[1] == rows_of(got.columns, want)[1]


def test_long_conversation_over_many_tasks(spark):
    rng = random.Random(5)
    rows = [(1, i, rng.choice(["user", "assistant", "assistant", "tool"]), rng.choice([f"t{i}.", f"t{i}", "again."])) for i in range(3000)]
    rows += [(c, i, "user" if i % 2 == 0 else "assistant", "a" * 2000 + f"{i}.") for c in (2, 3) for i in range(6)]
    df = spark.createDataFrame(rows, SCHEMA)
    plan = R.repair_plan(df)
    after = {c: sorted((r[1:] for r in rows if r[0] == c), key=lambda r: r[0]) for c in (1, 2, 3)}
    got = {r.conv_id: r for r in plan.collect()}
    # The same by walking over the rows with the best of each state.
    for conv, mine in after.items():
        cells = R._parsed([(r[1][0] if r[1][0] in "sua" else "x") + f for r, f in zip(mine, faults_of(mine))])
        assert (got[conv].cost, got[conv].audit) == R.cheapest(cells)
    lines = R.repaired(df, plan).where("conv_id = 1").orderBy("position").collect()
    assert [r.position for r in lines] == list(range(len(lines)))
    initials = "".join(r.role[0] for r in lines)
    assert initials == "ua" * (len(lines) // 2)
    digest = {r.conv_id: r.repaired_sha256 for r in R.repaired_digest(df, plan).collect()}
    assert digest[1] == hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in lines).encode()).hexdigest()
    assert sum(r.edit == "I" for r in lines) == got[1].audit.count("I")


def test_spans_combine_as_one(spark):
    rng = random.Random(2)
    kinds = [rng.choice("suax") + rng.choice("bdt...") for _ in range(40)]
    whole = R._parsed(kinds)
    for cut in range(41):
        assert R._joined(R._parsed(kinds[:cut]), R._parsed(kinds[cut:])) == whole


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert R.repair_report(df).count() == 0
    assert R.repaired(df, R.repair_plan(df)).count() == 0
