import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from basalt.llm import conversation_repair as cr

BEST = re.compile("(s?(ua)+)?")


def enumerate_edits(rows):
    """Every (cost, audit, result) of rows (initial, must, truncated) with at most two insertions at a place."""

    def some(k):
        for n in range(3):
            for new in itertools.product("ua", repeat=n):
                head = (2 * n, "I" * n, "".join(new))
                if k == len(rows):
                    yield head
                    continue
                initial, must, more = rows[k]
                options = [(3, "D", "")]
                if not must:
                    options += [(more, "K", initial), (2 + more, "R", "u"), (2 + more, "R", "a")]
                for (c, e, r), (c2, a2, r2) in itertools.product(options, after[k + 1]):
                    yield head[0] + c + c2, head[1] + e + a2, head[2] + r + r2

    after = {}
    for k in range(len(rows), -1, -1):
        after[k] = list(some(k))
    return after[0]


def code(initial, must, more):
    return (cr.INITIALS.find(initial) if initial in "sua" else 3) | must * cr.MUST_GO | more * cr.CUT_OFF


def test_parse_against_all_edits():
    rng = random.Random(5)
    for n in [0, 1, 1, 2, 2, 2, 3, 3, 3, 3]:
        rows = [(rng.choice("suax"), m := rng.random() < 0.2, not m and rng.random() < 0.3) for _ in range(n)]
        want = min((c, a) for c, a, r in enumerate_edits(rows) if BEST.fullmatch(r))
        assert cr.parse(bytes(code(*r) for r in rows)) == want


def by_strings(rows):
    """The same by whole audits of suffixes, for rows of any number."""
    best = {"e": (0, ""), "u": (2, "I"), "t": (4, "II"), "s": None}
    for initial, must, more in reversed(rows):
        new = {k: v and (v[0] + 3, "D" + v[1]) for k, v in best.items()}
        take = lambda to, of, by: new.update({to: min(x for x in (new[to], best[of] and not must and ((best[of][0] + more, "K" + best[of][1]) if initial == by else (best[of][0] + 2 + more, "R" + best[of][1]) if by != "s" else None)) if x)} if any((new[to], best[of] and not must)) else {})
        take("u", "e", "a")
        take("u", "t", "a")
        take("t", "u", "u")
        if initial == "s" and not must and best["t"]:
            new["s"] = min(x for x in (new["s"], (best["t"][0] + more, "K" + best["t"][1])) if x)
        for to, of in (("u", "e"), ("u", "t"), ("t", "u")):
            new[to] = min(new[to], (new[of][0] + 2, "I" + new[of][1]))
        best = new
    return min(v for k, v in best.items() if k != "u" and v)


def test_parse_long():
    rng = random.Random(6)
    for n in (5, 12, 40, 400, 2000):
        rows = [(rng.choice("suauaua?"), m := rng.random() < 0.1, not m and rng.random() < 0.2) for _ in range(n)]
        assert cr.parse(bytes(code(*r) for r in rows)) == by_strings(rows)


def expected(rows):
    """assess_conversations from the definition, of (turn, role, text)."""
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    rows = sorted(((t, r or " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], md5(r[2])))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\f\r")
        faults.append("B" if not bare else "D" if (role, text) in seen else "T" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[1][:1] for r in rows]
    cost, audit = by_strings([(i if i in ("s", "u", "a") else "?", f in ("B", "D"), f == "T") for i, f in zip(initials, faults, strict=True)])
    turns = [r[0] for r in rows if r[0] is not None]
    lines, k = [], 0
    roles = iter(cr.roles_after(audit))
    for e in audit:
        role = next(roles)
        if e != "D":
            lines.append((rows[k][1] if e == "K" else role) + ":" + ("" if e == "I" else rows[k][2]))
        k += e != "I"
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in "BDT"), sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)),
        cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def test_assessment_and_turns(spark):
    rng = random.Random(7)
    talks = {}
    for c in [None, *range(120)]:
        n = rng.choice([0, 1, 2, 3, 5, 8, 30])
        talks[c] = [(rng.choice([None, *range(8)]), rng.choice(["user", "assistant", "system", "tool", "", None, "ux"]), rng.choice(["Yes.", "No", "", " \t", None, "Ha! ", "é?\n", "x" * 50_000 + "."])) for _ in range(n)]
    rows = [(c, *r, True) for c, t in talks.items() for r in t] + [(c, 1, "user", "gone", False) for c in talks]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, there boolean").withColumn("mark", F.lit(1)).withColumn("kind", F.lit("clash")).withColumn("conv", F.lit(None)).repartition(6)
    got = {r.conv_id: tuple(r)[1:] for r in cr.assess_conversations(df, there=F.col("there")).collect()}
    assert set(got) == set(talks)
    for c, t in talks.items():
        assert got[c] == expected(t), (c, t)
    turns = {}
    for r in cr.repair_conversations(df, there=F.col("there")).orderBy("conv_id", "position").collect():
        turns.setdefault(r.conv_id, []).append(r)
    for c in talks:
        mine = turns.get(c, [])
        assert [r.position for r in mine] == list(range(len(mine))) and BEST.fullmatch("".join(r.role[:1] for r in mine))
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in mine).encode()).hexdigest() == got[c][-1]
        assert "".join(r.edit for r in mine) == got[c][-2].replace("D", "")


def test_long_conversation_and_hot_text(spark):
    rows = [("one", i, "user" if i % 2 == 0 else "assistant", "Same text." if i % 3 == 0 else f"Text {i}.") for i in range(4000)]
    rows += [(f"c{i}", 0, "user", "Same text.") for i in range(2000)]
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string").repartition(8)
    got = {r.conv_id: tuple(r)[1:] for r in cr.assess_conversations(df).collect()}
    assert len(got) == 2001 and got["one"] == expected([r[1:] for r in rows[:4000]])
    assert all(v == expected([(0, "user", "Same text.")]) for k, v in got.items() if k != "one")


def test_empty_table_and_damage(spark):
    kind = "conv_id long, turn long, role string, text string"
    assert cr.assess_conversations(spark.createDataFrame([], kind)).count() == 0
    rows = [(c, t, r, x) for c in [None, *range(40)] for t, r, x in [(None, None, None), (1, "user", "A. B? C!"), (2, "assistant", "Well.")]]
    out = cr.damage(spark.createDataFrame(rows, kind)).collect()
    want = []
    for c, t, r, x in rows:
        n = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = (" " if v is None else v for v in (r, x))
        x = "" if n == 1 else re.sub("[.!?]", "", x) if n == 2 else x
        want += [(c, t, "user" if n == 4 else r, x, n != 0)] * (2 if n == 3 else 1)
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in out)


@pytest.mark.parametrize("audit", ["", "KK", "KKK", "DKRI", "KIRD"])
def test_roles_after(audit):
    roles = [r for r in cr.roles_after(audit) if r]
    assert BEST.fullmatch("".join(r[0] for r in roles)) and len(roles) == len(audit.replace("D", ""))
