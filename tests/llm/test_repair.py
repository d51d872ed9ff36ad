"""Repair of conversations against a search over all edits."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from cuesheet.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"
BLANK = " \t\n\v\f\r"


def broken(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def expected(rows):
    """The result of one conversation's rows."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    faults, seen = [], set()
    for _, _, role, text in rows:
        solid = text.strip(BLANK)
        faults.append(
            "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
        )
        seen.add((role, text))
    turns = {r[1] for r in rows if r[1] is not None}
    pairs = zip(rows, rows[1:])

    def follow(state, initial):
        """The next state of the pattern: '' start, s, u, a."""
        return initial if initial in {"": "su", "s": "u", "u": "a", "a": "u"}[state] and initial else None

    @lru_cache(maxsize=None)
    def best(i, state, inserted):
        found = []
        if i == len(rows):
            if state in ("", "a"):
                found.append((0, "", ()))
        else:
            bad = faults[i] in ("blank", "duplicate")
            late = faults[i] == "truncated"
            c, audit, said = best(i + 1, state, 0)
            found.append((c + 3, "D" + audit, said))
            if not bad:
                role, text = rows[i][2], rows[i][3]
                if follow(state, role[:1]):
                    c, audit, said = best(i + 1, role[:1], 0)
                    found.append((c + late, "K" + audit, (f"{role}:{text}", *said)))
                for name in ("user", "assistant"):
                    if follow(state, name[0]):
                        c, audit, said = best(i + 1, name[0], 0)
                        found.append((c + 2 + late, "R" + audit, (f"{name}:{text}", *said)))
        if inserted < 3:
            for name in ("user", "assistant"):
                if follow(state, name[0]):
                    c, audit, said = best(i, name[0], inserted + 1)
                    found.append((c + 2, "I" + audit, (f"{name}:", *said)))
        return min(found, key=lambda x: x[:2]) if found else (10**9, "", ())

    cost, audit, said = best(0, "", 0)
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in pairs),
        cost,
        audit,
        hashlib.sha256("\n".join(said).encode()).hexdigest(),
    )


def some_rows(seed):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", "unknown", "Assistant", None]
    texts = ["a.", "b", "c!  ", "", " \t", "Really?\n", "dé", None, " ", "x. \U0001f600"]
    rows = []
    for conv in range(120):
        alternate = rng.random() < 0.5
        for turn in range(rng.randrange(0, 14)):
            at = rng.choice([turn, turn, turn, turn * 3, None, -turn])
            role = ("user", "assistant")[turn % 2] if alternate and rng.random() < 0.8 else rng.choice(roles)
            rows.append((None if conv == 7 else conv, at, role, rng.choice(texts) if rng.random() < 0.5 else f"text {turn}."))
    return rows


@pytest.mark.parametrize("damage,piece_rows", [(True, repair.PIECE_ROWS), (True, 2), (False, 3)])
def test_against_search(spark, damage, piece_rows):
    rows = some_rows(piece_rows)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", copies int, fault string")
    made = repair.damaged(df) if damage else repair.undamaged(df)
    got = repair.repair_conversations(made, piece_rows).collect()
    groups = {r[0]: [] for r in rows}
    whole = broken(rows) if damage else [(c, t, *(" " if x is None else x for x in (r, v))) for c, t, r, v in rows]
    for row in whole:
        groups[row[0]].append(row)
    assert {r.conv_id: tuple(r)[1:] for r in got} == {conv: expected(own) for conv, own in groups.items()}
    assert len(got) == len(groups)


def test_runs_take_powers():
    for symbol in range(9):
        matrix = repair.IDENTITY
        for length in range(70):
            assert repair.run_matrix(symbol, length) == matrix
            matrix = repair._times(matrix, repair.transition(symbol))
    assert repair.run_matrix(repair._GONE, 10**12)[0][0] == 3 * 10**12


def test_hot_conversation(spark):
    """One conversation over many pieces and ranges, with a text that half of its turns repeat."""
    rows = [(5, t, ("user", "assistant")[t % 2], f"t {t}." if t % 3 else "again and again.") for t in range(40_000)]
    rows += [(6, 1, "user", "x" * 300_000), (6, 2, "assistant", "y."), (8, None, "user", "dropped?")]
    made = repair.undamaged(spark.createDataFrame(rows, SCHEMA))
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair_conversations(made, 500).collect()}
    seen, state, left = set(), "", []
    for _, _, role, text in rows[:40_000]:
        left += [role[0]] * ((role, text) not in seen)
        seen.add((role, text))
    duplicates = 40_000 - len(left)
    assert got[5][0:5] == (0, 0, duplicates, 0, 0)
    assert len(got[5][6].replace("I", "")) == 40_000 and got[5][6].count("D") >= duplicates
    whole = {r.conv_id: tuple(r)[1:] for r in repair.repair_conversations(made, 10**9).collect()}
    assert whole == got and got[6] == expected(rows[40_000:40_002])


def test_many_equal_rows_and_none(spark):
    rows = [(1, 3, "user", "same.")] * 3_000
    made = repair.undamaged(spark.createDataFrame(rows, SCHEMA))
    (row,) = repair.repair_conversations(made).collect()
    assert (row.duplicate, row.illegal, row.cost, row.audit) == (2_999, 2_999, 2_999 * 3 + 2, "K" + "D" * 2_999 + "I")
    empty = spark.createDataFrame([], SCHEMA)
    assert repair.repair_conversations(repair.damaged(empty)).collect() == []
    gone = next(t for t in range(1000) if zlib.crc32(f"9:{t}".encode()) % 20 == 0)
    (row,) = repair.repair_conversations(repair.damaged(spark.createDataFrame([(9, gone, "user", "a")], SCHEMA))).collect()
    assert tuple(row) == (9, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
