"""Turn repair: all edits tried one by one, grammars against single rows, both ways of the operator."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from conftest import tuples
from hypothesis import given, settings
from hypothesis import strategies as st

from tablewarden.llm import edit_grammar as eg
from tablewarden.llm import turn_repair

SCHEMA = "conv_id long, turn long, role string, text string"
WELL = re.compile("(s?(ua)+)?")


def symbols_cost(symbols, audit):
    """The cost of an audit, or None if its result is not well formed; roles are those of the result."""
    cost, out, at = 0, "", 0
    for edit in audit:
        if edit == "I":
            cost, out = cost + 2, out + ("a" if out.endswith("u") else "u")
            continue
        x = symbols[at]
        at += 1
        if edit == "D":
            cost += 3
            continue
        if x == "x":
            return None
        cost += x.isupper()
        if edit == "R":
            cost, out = cost + 2, out + ("a" if out.endswith("u") else "u")
        elif x.lower() == "o":
            return None
        else:
            out += x.lower()
    return cost if WELL.fullmatch(out) else None


def tried(symbols):
    """The least (cost, audit) of all audits with up to two inserts in a row."""
    best = None
    gaps = ["", "I", "II"]
    for edits in itertools.product("KRD", repeat=len(symbols)):
        for fill in itertools.product(gaps, repeat=len(symbols) + 1):
            audit = "".join(f + e for f, e in zip(fill, [*edits, ""], strict=True))
            cost = symbols_cost(symbols, audit)
            if cost is not None and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_cheapest_edits_of_all(n):
    tool = eg.Grammar(("ua", chr(eg.FIRST_RULE) * 2, "su", "xx"))
    for symbols in itertools.product("suaoSUAOx", repeat=n):
        assert tool.solve("".join(symbols)) == tried(symbols)


@settings(max_examples=25, deadline=None)
@given(st.text("suaoSUAOx", min_size=4, max_size=4))
def test_cheapest_edits_of_four(symbols):
    assert eg.Grammar().solve(symbols) == tried(symbols)


def row_by_row(symbols):
    """The usual dynamic programme over rows, with audits as plain text."""
    moves = {0: "u", 1: "u", 2: "a", 3: "u"}
    after = {"u": 2, "a": 3}
    far = (10**9, "~")

    def inserts(best):
        for _ in range(3):
            for state, role in moves.items():
                cost, audit = best.get(state, far)
                to = after[role]
                best[to] = min(best.get(to, far), (cost + 2, audit + "I"))
        return best

    best = {0: (0, "")}
    for x in symbols:
        now = {}
        for state, (cost, audit) in inserts(dict(best)).items():
            ways = [(state, 3, "D")]
            if x != "x":
                cut = x.isupper()
                ways.append((after[moves[state]], 2 + cut, "R"))
                if x.lower() == moves[state]:
                    ways.append((after[moves[state]], cut, "K"))
                if x.lower() == "s" and state == 0:
                    ways.append((1, cut, "K"))
            for to, more, edit in ways:
                now[to] = min(now.get(to, far), (cost + more, audit + edit))
        best = now
    best = inserts(dict(best))
    return min(best[0] if 0 in best else far, best.get(3, far))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("suaoSUAOx", min_size=1, max_size=60), min_size=1, max_size=8), st.integers(0, 40))
def test_rules_change_nothing(texts, most):
    tool = eg.Grammar(eg.learn_rules([(t, 1 + i % 3) for i, t in enumerate(texts)], most))
    for t in texts:
        assert tool.solve(t) == row_by_row(t)


def test_long_sequences_go_through_halved_products():
    rng = random.Random(2)
    text = "s" + "".join(rng.choice(["ua", "ua", "ua", "u", "a", "x", "U", "o", "ss"]) for _ in range(4000))
    assert eg.Grammar(eg.learn_rules([("uauaua", 5)])).solve(text) == row_by_row(text)
    assert eg.Grammar().solve("ou" * 3000) == row_by_row("ou" * 3000)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab", max_size=30), max_size=6), st.lists(st.text("ab", max_size=30), max_size=6))
def test_ropes_compare_as_texts(a, b):
    x, y = eg.Rope.of(""), eg.Rope.of("")
    for t in a:
        x = x + eg.Rope.of(t)
    for t in reversed(b):
        y = eg.Rope.of(t) + y
    assert str(x) == "".join(a) and x.before(y) == (str(x) < str(y)) and x.same(y) == (str(x) == str(y))


def hurt(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        m = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if m == 4:
            role = "user"
        if m == 1:
            text = ""
        if m == 2:
            text = re.sub("[.!?]", "", text)
        out += [(conv, turn, role, text, m != 0)] * (2 if m == 3 else 1)
    return out


def repaired(rows):
    """Plain version of :func:`turn_repair.repair`; rows have a last field that says whether they are there."""
    convs = {}
    for conv, turn, role, text, here in rows:
        found = convs.setdefault(conv, [])
        if here:
            role, text = (" " if v is None else v for v in (role, text))
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            found.append((turn is not None, turn or 0, role, digest, turn, text))
    out = []
    for conv, found in convs.items():
        found.sort(key=lambda r: r[:4])
        seen, symbols, counts = set(), "", [0, 0, 0]
        for *_, role, digest, _, text in found:
            body = text.rstrip(" \t\n\x0b\f\r")
            faults = [not body, digest in seen, bool(body) and body[-1] not in ".!?"]
            seen.add(digest)
            first = faults.index(True) if any(faults) else None
            if first is not None:
                counts[first] += 1
            kind = role[0] if role[:1] in ("s", "u", "a") else "o"
            symbols += "x" if first in (0, 1) else kind.upper() if first == 2 else kind
        turns = {r[4] for r in found} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(found, found[1:], strict=False)]
        cost, audit = row_by_row(symbols)
        lines, at, state = [], 0, ""
        for edit in audit:
            if edit in "IR":
                state = "assistant" if state == "u" else "user"
                lines.append(f"{state}:{'' if edit == 'I' else found[at][5]}")
                state = state[0]
            elif edit == "K":
                lines.append(f"{found[at][2]}:{found[at][5]}")
                state = found[at][2][0]
            at += edit != "I"
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, *counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha))
    return out


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def talk(seed=3, n=60):
    rng = random.Random(seed)
    words = "one two three four".split()
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, 12)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"])
            text = rng.choice([" ".join(rng.choices(words, k=4)) + rng.choice([".", "!", "?", "", " \n", ". "]), "", " \t", None, "Same."])
            rows.append((c if c else None, None if rng.random() < 0.05 else t // rng.choice([1, 1, 2]), role, text))
    rows += [(500, t, "user" if t % 2 == 0 else "assistant", f"Line {t}.") for t in range(700)]
    rows += [(501, None, "user", "x" * 200_000 + "."), (501, None, "assistant", "Ends?"), (502, None, None, None)]
    rng.shuffle(rows)
    return rows


def framed(spark, rows, schema=SCHEMA, parts=4):
    extra = "_conv string, _text string, audit string, gaps long, present string"
    full = [(*r, None, "x", "y", 1, None) for r in rows]
    return spark.createDataFrame(full, f"{schema}, {extra}").repartition(parts)


@pytest.mark.parametrize("limits", [{}, {"long_rows": 0}, {"long_rows": 8}, {"long_bytes": 100}])
def test_both_ways_against_a_plain_version(spark, limits):
    rows = talk()
    got = turn_repair.repair(turn_repair.damaged(framed(spark, rows)), present="present", **limits)
    assert tuples(got, *COLUMNS) == sorted(repaired(hurt(rows)), key=repr)


def test_without_damage_and_with_short_stretches(spark, monkeypatch):
    monkeypatch.setattr(turn_repair, "STRETCH", 7)
    rows = talk(4, 30)
    expected = sorted(repaired([(*r, True) for r in rows]), key=repr)
    assert tuples(turn_repair.repair(framed(spark, rows)), *COLUMNS) == expected
    assert tuples(turn_repair.repair(framed(spark, rows), long_rows=3), *COLUMNS) == expected


def test_damage(spark):
    rows = talk(5, 40)
    got = turn_repair.damaged(framed(spark, rows)).select("conv_id", "turn", "role", "text", "present")
    dropped = [r for r in hurt(rows) if not r[4]]
    assert dropped and tuples(got, *got.columns) == sorted(hurt(rows), key=repr)


def test_empty_table_and_conversations_without_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert turn_repair.repair(turn_repair.damaged(none), present="present").collect() == []
    gone = spark.createDataFrame([(1, 0, "user", "A.", False), (2, 0, "user", "B.", None)], f"{SCHEMA}, present boolean")
    nothing = hashlib.sha256(b"").hexdigest()
    for limits in ({}, {"long_rows": 0}):
        got = turn_repair.repair(gone, present="present", **limits)
        assert tuples(got, *COLUMNS) == [(c, 0, 0, 0, 0, 0, 0, "", nothing) for c in (1, 2)]


def test_a_hot_conversation_is_spread(spark, apart):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"Text number {t}.") for t in range(6_000)]
    rows += [(c, 0, "user", "Hi.") for c in range(2, 300)]
    given = turn_repair.prepared(spark.createDataFrame(rows, SCHEMA).repartition(6), "conv_id", "turn", "role", "text", None)
    dealt = given.repartitionByRange(*turn_repair.in_order()).where("_conv = 1").selectExpr("spark_partition_id() p")
    assert dealt.groupBy("p").count().agg({"count": "max"}).first()[0] < 3_000
