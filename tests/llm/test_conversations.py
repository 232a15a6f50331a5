import hashlib
import itertools
import random
import zlib
from functools import cache

import pytest
from strandline.llm import conversations as cv

SPACE = " \t\n\x0b\f\r"
ROWS = "conv_id long, turn long, role string, text string, at string, chunk int"


def damaged(rows):
    out = []
    for c, t, r, x in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = ("user" if k == 4 else " " if r is None else r), (" " if x is None else x)
        x = "" if k == 1 else x.translate({46: None, 33: None, 63: None}) if k == 2 else x
        out += [(c, t, r, x)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, r, x in rows:
        solid = x.rstrip(SPACE)
        out.append(2 if not solid else 3 if (r, x) in seen else 1 if solid[-1] not in ".!?" else 0)
        seen.add((r, x))
    return out


def cheapest(kinds, roles):
    """Cost and edits by trying every edit at every row, from the last to the first."""
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}

    @cache
    def best(i, last):
        ends = []
        if i == len(kinds):
            ends.append((0, "")) if last in ("", "a") else None
        else:
            ends.append(plus(2, "D", best(i + 1, last)))
            if kinds[i] < 2:
                more = 5 * kinds[i]
                ends += [plus(more, "K", best(i + 1, r)) for r in follow[last] if r == roles[i]]
                ends += [plus(1 + more, "R", best(i + 1, r)) for r in follow[last] if r != "s"]
        return min(ends, default=(10**9, ""))

    def plus(c, op, rest):
        return rest[0] + c, op + rest[1]

    def with_inserts(kinds_, roles_):
        # up to three inserts before each row and after the last, tried as rows of their own
        found = (10**9, "")
        n = len(kinds_)
        for at in itertools.product(range(3), repeat=n + 1):
            if sum(at) > 3:
                continue
            found = min(found, solve(kinds_, roles_, at))
        return found

    def solve(kinds_, roles_, at):
        @cache
        def go(i, k, last):
            if k < at[i]:
                return min((plus(5, "I", go(i, k + 1, r)) for r in follow[last] if r != "s"), default=(10**9, ""))
            if i == len(kinds_):
                return (0, "") if last in ("", "a") else (10**9, "")
            ends = [plus(2, "D", go(i + 1, 0, last))]
            if kinds_[i] < 2:
                more = 5 * kinds_[i]
                ends += [plus(more, "K", go(i + 1, 0, r)) for r in follow[last] if r == roles_[i]]
                ends += [plus(1 + more, "R", go(i + 1, 0, r)) for r in follow[last] if r != "s"]
            return min(ends)

        return go(0, 0, "")

    return with_inserts(kinds, roles)


def first(role):
    return role[:1] if role[:1] in tuple("sua") else "x"


def brute(rows, solver):
    out = {}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in damaged(rows) if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        turns = {r[1] for r in own if r[1] is not None}
        kinds, roles = faults(own), [first(r[2]) for r in own]
        cost, audit = solver(tuple(kinds), tuple(roles))
        lines, last, i = [], "", 0
        for op in audit:
            if op == "D":
                i += 1
                continue
            role = {"": "user", "s": "user", "u": "assistant", "a": "user"}[last]
            if op == "K":
                role = own[i][2]
            lines.append(f"{role}:{'' if op == 'I' else own[i][3]}")
            last, i = role[0], i + (op != "I")
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(roles))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[c] = (gaps, kinds.count(2), kinds.count(3), kinds.count(1), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def run(spark, rows, chunk=cv.CHUNK):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], ROWS)
    got = cv.report(df.select("conv_id"), cv.repair(cv.damaged(df), chunk))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return {r.conv_id: tuple(r)[1:] for r in got.collect()}


def made(rnd, convs, longest):
    texts = ["Hi.", "Why?", "no end", "", " \n", None, "Yes! ", "so ", "x." * 3000]
    rows = []
    for c in [None, *range(convs)]:
        for t in range(rnd.randrange(longest)):
            rows.append((c, rnd.choice([t, t, t, t + 3, None]), rnd.choice(["user", "assistant", "system", "user", "assistant", "tool", None, ""]), rnd.choice(texts)))
    return rows + rows[:3]


def test_equals_trying_all_edits(spark):
    rows = made(random.Random(4), 60, 7)
    assert run(spark, rows) == brute(rows, cheapest)


def with_steps(kinds, roles):
    """The same cost and edits, row by row from the last."""
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, ""), "s": (10, "II"), "u": (5, "I"), "a": (0, "")}
    for k, role in zip(reversed(kinds), reversed(roles)):
        now = {}
        for last in follow:
            ends = [(best[last][0] + 2, "D" + best[last][1])]
            if k < 2:
                ends += [(best[r][0] + 5 * k, "K" + best[r][1]) for r in follow[last] if r == role]
                ends += [(best[r][0] + 5 * k + 1, "R" + best[r][1]) for r in follow[last] if r != "s"]
            now[last] = min(ends)
        for _ in range(3):
            now = {s: min([now[s]] + [(now[r][0] + 5, "I" + now[r][1]) for r in follow[s] if r != "s"]) for s in follow}
        best = now
    return best[""]


@pytest.mark.parametrize("chunk", [1, 3])
def test_long_conversations_in_chunks(spark, chunk):
    rnd = random.Random(6)
    rows = made(rnd, 12, 60) + [(77, t, "user" if t % 2 else "assistant", f"t{t % 400}.") for t in range(3000)]
    assert run(spark, rows, chunk) == brute(rows, with_steps)


def test_signatures_of_all_small_sizes():
    memo = {}
    for n in range(1, 4):
        for sig in itertools.product("0123456789abcdef", repeat=n):
            kinds, roles = tuple(int(x, 16) // 4 for x in sig), tuple("suax"[int(x, 16) % 4] for x in sig)
            whole = cv.Run()
            whole.add(cv.solve("".join(sig), memo))
            cost, pieces = whole.end()
            assert (cost, "".join(pieces)) == with_steps(kinds, roles)
            if n == 2:
                assert (cost, "".join(pieces)) == cheapest(kinds, roles)


def test_no_conversations(spark):
    assert run(spark, []) == {}


def test_repaired_rows_follow_the_pattern(spark):
    rows = made(random.Random(11), 30, 9)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], ROWS)
    got = {}
    for r in sorted(cv.repair(cv.damaged(df)).rows.collect(), key=lambda r: (str(r.conv_id), r.pos)):
        got[r.conv_id] = got.get(r.conv_id, "") + r.role[0]
    import re

    assert got and all(re.fullmatch("s?(ua)+", x) for x in got.values())
