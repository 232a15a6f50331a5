"""Conversations repaired by the cheapest edits, solved once for each distinct signature.

A conversation's signature has one hex digit for each row: four times its first fault (none, truncated,
blank, duplicate) plus the class of its role (s, u, a, other).  Rows are put in order over all tasks and
cut into chunks of ``CHUNK`` rows, so that no task holds a long conversation; the chunks' signatures are
made distinct, and each distinct one is solved by a recursion over its halves, memoised by substring.  A
solution is a table of the cheapest edits from every state to every other (nothing written yet, after the
system row, after a user row, after an assistant row), so the chunks of a long conversation are
combined one after the other, and most conversations have one.  The edits are joined back and replayed
over the rows, as a stream in the order of the conversation.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Bits of the number of rows in a chunk.
CHUNK = 12

#: What edits cost; a truncated row that stays costs ``TRUNCATED`` more.
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5

SPACES = " \t\n\x0b\f\r"
FAULTS, ROLES = ("", "truncated", "blank", "duplicate"), "sua"

#: Of each state, what may be written next and the state then.  0: nothing yet, 1: system, 2: user, 3: assistant (the only end besides 0).
_NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}

Edits = tuple[int, str]
Table = dict[tuple[int, int], Edits]


def damaged(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)`` with every row damaged by the checksum of its id and turn, nulls in all strings being one space.

    The checksum modulo 20: 0 drops the row, 1 empties its text, 2 takes ``.!?`` out of it, 3 repeats it, 4 makes its role ``user``.
    A repeated row is damaged like the first; other columns are not read.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    flat = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), part("role").alias("role"), part("text").alias("text"), kind.alias("_k"))
    text = F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("_k") == 0, 0).when(F.col("_k") == 3, 2).otherwise(1)
    return flat.select("conv_id", "turn", F.when(F.col("_k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("_")).drop("_")


def _row(digit: str) -> Table:
    """The cheapest edits of one row, inserts before it included, between states; rows that must go have one edit."""
    fault, role = divmod(int(digit, 16), 4)
    more = TRUNCATED if FAULTS[fault] == "truncated" else 0
    out: Table = {}
    for start in _NEXT:
        before, state, entered = "", start, {start}
        while True:
            cost = INSERT * len(before)
            edits = [(DELETE, "D", state)]
            if FAULTS[fault] not in ("blank", "duplicate"):
                edits += [(REROLE + more, "R", to) for out_role, to in _NEXT[state].items() if out_role != "s"]
                edits += [(more, "K", to) for out_role, to in _NEXT[state].items() if ROLES[role : role + 1] == out_role]
            for c, op, to in edits:
                key, new = (start, to), (cost + c, before + op)
                out[key] = min(out.get(key, new), new)
            state = next(to for out_role, to in _NEXT[state].items() if out_role != "s")
            if state in entered:  # more inserts lead to no other state
                break
            entered.add(state)
            before += "I"
    return out


def _joined(left: Table, right: Table) -> Table:
    """Edits of one part after those of another: the cheapest, of these the first in ASCII order.

    No edits of a part are the beginning of others as cheap, so the first of a whole is the first of its parts.
    """
    out: Table = {}
    for (a, b), (c, x) in left.items():
        for (b2, d), (e, y) in right.items():
            if b == b2:
                new = (c + e, x + y)
                out[a, d] = min(out.get((a, d), new), new)
    return out


def solve(signature: str, memo: dict[str, Table]) -> Table:
    """The cheapest edits of a signature between all states, by halves; ``memo`` keeps the solution of every part."""
    if signature not in memo:
        half = len(signature) // 2
        memo[signature] = _row(signature) if half == 0 else _joined(solve(signature[:half], memo), solve(signature[half:], memo))
    return memo[signature]


#: Inserts after the last row, by state.
_ENDS = {0: "", 1: "II", 2: "I", 3: ""}


class Run:
    """The cheapest edits of a conversation, its chunks added one after the other.

    Kept for each state: the cost, its place in the ASCII order of the states' edits, and the chunks' edits as a chain.
    """

    def __init__(self) -> None:
        self.best: dict[int, tuple[int, int, tuple | None]] = {0: (0, 0, None)}

    def add(self, table: Table) -> None:
        found: dict[int, tuple[int, int, str, int]] = {}
        for (a, b), (cost, edits) in table.items():
            if a in self.best:
                new = (self.best[a][0] + cost, self.best[a][1], edits, a)
                found[b] = min(found.get(b, new), new)
        order = sorted(found, key=lambda b: found[b][1:3])
        self.best = {b: (found[b][0], k, (self.best[found[b][3]][2], found[b][2])) for k, b in enumerate(order)}

    def end(self) -> tuple[int, list[str]]:
        """Cost and edits of each chunk; those after the last row are with the last chunk."""
        cost, _, chain, tail = min((c + INSERT * len(_ENDS[s]), k, chain, _ENDS[s]) for s, (c, k, chain) in self.best.items())
        pieces = []
        while chain is not None:
            chain, piece = chain[0], chain[1]
            pieces.append(piece)
        pieces.reverse()
        pieces[-1] += tail
        return cost, pieces


_TABLE = "from_state array<tinyint>, to_state array<tinyint>, costs array<long>, edits array<string>"


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 2000))
    memo: dict[str, Table] = {}
    held = 0
    for batch in batches:
        rows = []
        for s in batch.column("signature").to_pylist():
            held += len(s)
            if held > 1 << 20:  # what is remembered stays within some hundred MB
                memo, held = {}, len(s)
            t = solve(s, memo)
            rows.append({"signature": s, "from_state": [a for a, _ in t], "to_state": [b for _, b in t], "costs": [c for c, _ in t.values()], "edits": [e for _, e in t.values()]})
        kind = pa.schema([("signature", pa.string()), ("from_state", pa.list_(pa.int8())), ("to_state", pa.list_(pa.int8())), ("costs", pa.list_(pa.int64())), ("edits", pa.list_(pa.string()))])
        yield pa.RecordBatch.from_pylist(rows, kind)


def _legal(a: str, b: str) -> bool:
    role = lambda x: (ROLES + "x")[int(x, 16) % 4]
    return role(a) + role(b) in ("su", "ua", "au")


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of whole conversations in order, with their tables, to the chunks' edits; the conversation's sums stand with its last chunk."""
    schema = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), ("audit", pa.string()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64())])
    run: Run | None = None
    conv: int | None = None
    chunks: list[int] = []
    faults, illegal, last = [0] * 4, 0, ""
    out: list[tuple] = []

    def close() -> None:
        if run is not None:
            cost, pieces = run.end()
            out.extend((conv, c, p, None, None, None, None, None) for c, p in zip(chunks[:-1], pieces[:-1]))
            out.append((conv, chunks[-1], pieces[-1], faults[2], faults[3], faults[1], illegal, cost))

    def taken() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)
        out.clear()
        return made

    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("conv_id", "chunk", "signature", "from_state", "to_state", "costs", "edits")]
        for c, chunk, sig, a, b, cost, edits in zip(*cols):
            if run is None or c != conv:
                close()
                run, conv, chunks, faults, illegal, last = Run(), c, [], [0] * 4, 0, ""
            run.add({(x, y): (n, e) for x, y, n, e in zip(a, b, cost, edits)})
            chunks.append(chunk)
            for x in sig:
                faults[int(x, 16) // 4] += 1
                illegal += bool(last) and not _legal(last, x)
                last = x
        if len(out) >= 4096:
            yield taken()
    close()
    if out:
        yield taken()


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, the edits of each chunk before its rows, to the repaired rows: kept, given another role, or put in."""
    edits, at, body, state, conv, pos = "", 0, 0, 0, object(), 0
    schema = pa.schema([("conv_id", pa.int64()), ("pos", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
    for batch in batches:
        out: list[tuple] = []

        def write(op: str, role: str | None, text: str) -> None:
            nonlocal state, pos
            if op == "K":
                state = _NEXT[state][role[0]]  # type: ignore[index]
            else:
                role, state = next((r, to) for r, to in _NEXT[state].items() if r != "s")
                role = {"u": "user", "a": "assistant"}[role]
            out.append((conv, pos, op, role, text))
            pos += 1

        for c, audit, role, text in zip(*[batch.column(x).to_pylist() for x in ("conv_id", "audit", "role", "text")]):
            if c != conv:
                conv, state, pos = c, 0, 0
            if audit is not None:
                edits, at, body = audit, 0, len(audit.rstrip("I"))
                continue
            while edits[at] == "I":
                write("I", None, "")
                at += 1
            if edits[at] != "D":
                write(edits[at], role, text)
            at += 1
            if at == body:  # what comes after the last row
                for _ in edits[body:]:
                    write("I", None, "")
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each conversation, of its lines in order, without holding them."""
    conv, h, out = None, None, []
    for batch in batches:
        for c, role, text in zip(*[batch.column(x).to_pylist() for x in ("conv_id", "role", "text")]):
            if h is None or c != conv:
                if h is not None:
                    out.append((conv, h.hexdigest()))
                conv, h = c, hashlib.sha256()
            else:
                h.update(b"\n")
            h.update(f"{role}:{text}".encode())
    if h is not None:
        out.append((conv, h.hexdigest()))
    yield pa.record_batch({"conv_id": pa.array([x[0] for x in out], pa.int64()), "repaired_sha256": pa.array([x[1] for x in out], pa.string())})


class Repair:
    """What ``repair`` found: ``rows`` (conv_id, pos, edit, role, text) are the repaired conversations; ``audits`` has one row for each conversation.

    The rows of a conversation stand together and in order, as they were replayed: a digest takes them as they come.
    """

    def __init__(self, rows: DataFrame, audits: DataFrame) -> None:
        self.rows, self.audits = rows, audits

    def digests(self) -> DataFrame:
        return self.rows.select("conv_id", "role", "text").mapInArrow(_hashed, "conv_id long, repaired_sha256 string")


def _fault(text: Column) -> Column:
    """Number of a text's own fault: blank, truncated or none."""
    solid = F.rtrim(text, F.lit(SPACES))
    return F.when(solid == "", 2).when(~F.right(solid, F.lit(1)).isin(".", "!", "?"), 1).otherwise(0)


def repair(rows: DataFrame, chunk: int = CHUNK, name: str = "conversations") -> Repair:
    """Conversations ``(conv_id, turn, role, text)``, none of them null but ids and turns, repaired to ``(s?(ua)+)?`` at the least cost.

    Rows of a conversation go by turn (null first), role and text.  A row is blank without a character other than white
    space, else a duplicate if its role and text were seen earlier in the conversation, else truncated if its
    last such character is none of ``.!?``.  Edits: K keeps a row, R makes its role user or assistant (1), D deletes
    it (2, required for blank and duplicate rows), I puts in an empty row of user or assistant (5); a truncated row that
    stays costs 5 more.  Of edits that cost the same the first in ASCII order counts.

    A null id is a conversation like others.  Repeated rows are duplicates.  An empty table gives an empty one.
    Texts are of any length; a conversation's edits are one string, and the digest of a conversation is read by one task
    as a stream, because a digest has no parts.
    """
    scratch = Scratch(rows.sparkSession, name)
    rows = rows.select("conv_id", "turn", "role", "text")
    # 64 characters of the text only say in which task a row stands; the order is that of whole texts
    ordered = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv_id", "turn", "role", "text")
    ordered = scratch.save(ordered.withColumn("at", F.monotonically_increasing_id()))

    text = [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")]
    role = F.left("role", F.lit(1))
    light = scratch.save(ordered.select("conv_id", "turn", "at", "role", *text, _fault(F.col("text")).alias("fault"), F.when(role == "s", 0).when(role == "u", 1).when(role == "a", 2).otherwise(3).alias("class")))
    keys = ["conv_id", "role", "h1", "h2"]
    again = light.where("fault <> 2").groupBy(*keys).agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n").withColumnsRenamed({k: f"_{k}" for k in keys})
    marked = light.join(again, (F.col("conv_id").eqNullSafe(F.col("_conv_id"))) & (F.col("role") == F.col("_role")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")), "left")
    fault = F.when((F.col("fault") != 2) & (F.col("at") > F.col("first")), 3).otherwise(F.col("fault"))
    coded = marked.select("conv_id", F.shiftright("at", chunk).alias("chunk"), F.struct("at", F.lower(F.hex(fault * 4 + F.col("class"))).alias("x")).alias("c"))
    chunks = coded.groupBy("conv_id", "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["x"]), "").alias("signature"))
    chunks = scratch.save(chunks)

    solved = chunks.select("signature").distinct().mapInArrow(_solved, "signature string, " + _TABLE)
    joined = chunks.join(solved, "signature").repartition("conv_id").sortWithinPartitions("conv_id", "chunk")
    audits = scratch.save(joined.mapInArrow(_combined, "conv_id long, chunk long, audit string, blank long, duplicate long, truncated long, illegal long, cost long"))

    edits = audits.select("conv_id", "chunk", F.lit(-1).cast("long").alias("at"), "audit", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    lines = ordered.select("conv_id", F.shiftright("at", chunk).alias("chunk"), "at", F.lit(None).cast("string").alias("audit"), "role", "text")
    replayed = edits.unionByName(lines).repartition("conv_id").sortWithinPartitions("conv_id", "chunk", "at").mapInArrow(_replayed, "conv_id long, pos long, edit string, role string, text string")

    sums = audits.groupBy("conv_id").agg(
        *[F.max(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "audit"))), lambda c: c["audit"]), "").alias("audit"),
    )
    turns = light.where("turn is not null").groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    sums = sums.join(turns.withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    return Repair(replayed, sums.withColumn("gaps", F.coalesce("gaps", F.lit(0).cast("long"))))


def report(ids: DataFrame, found: Repair) -> DataFrame:
    """What was found for every id of ``ids``: zeros, no edits and the digest of nothing for those without a row."""
    sums = found.audits.withColumnRenamed("conv_id", "_a").join(found.digests().withColumnRenamed("conv_id", "_b"), F.col("_a").eqNullSafe(F.col("_b")), "left")
    all_ = ids.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().join(sums, F.col("conv_id").eqNullSafe(F.col("_a")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    none = hashlib.sha256().hexdigest()
    return all_.select("conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(none)).alias("repaired_sha256"))


_FIRST = "CASE WHEN starts_with(role, 's') THEN 's' WHEN starts_with(role, 'u') THEN 'u' WHEN starts_with(role, 'a') THEN 'a' ELSE 'x' END"


def _step(start: int) -> str:
    """DuckDB's SQL for the best end of a conversation from row ``i`` on in a state: ten digits of cost, then the edits; v0 to v3 are those of the next row."""
    plus = lambda cost, op, to: f"CASE WHEN v{to} IS NOT NULL THEN lpad((substr(v{to}, 1, 10)::BIGINT + {cost})::VARCHAR, 10, '0') || '{op}' || substr(v{to}, 11) END"
    options = [plus("2", "D", start)]
    for role, to in _NEXT[start].items():
        options.append(f"CASE WHEN fault IN ('', 'truncated') AND c = '{role}' THEN {plus('more', 'K', to)} END")
        if role != "s":
            options.append(f"CASE WHEN fault IN ('', 'truncated') THEN {plus('1 + more', 'R', to)} END")
    return f"least({', '.join(options)})"


def _inserted(prefix: str) -> str:
    """The same with inserts before the row: from each state, w0 to w3 being the values without them."""
    plus = lambda w, k: f"lpad((substr({w}, 1, 10)::BIGINT + {5 * k})::VARCHAR, 10, '0') || '{'I' * k}' || substr({w}, 11)"
    ways = {0: ("w0", plus("w2", 1), plus("w3", 2)), 1: ("w1", plus("w2", 1), plus("w3", 2)), 2: ("w2", plus("w3", 1)), 3: ("w3", plus("w2", 1))}
    return ", ".join(f"least({', '.join(x)}) AS {prefix}{s}" for s, x in ways.items())


# The same in DuckDB's SQL, over conversations: the checksum bit by bit, the edits from the last row to the first.
ORACLE = f"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce(range(8), lambda c, x: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) ORDER BY n) AS t FROM range(256) r(n)),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(range(1, length(k) + 1), lambda x: ascii(substr(k, x, 1))::BIGINT) AS bytes
  FROM (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations)),
dealt AS (SELECT *, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295), 4294967295) % 20 AS kind FROM keyed, crc_table),
rows_ AS MATERIALIZED (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM dealt),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, count(*) OVER (PARTITION BY conv_id) AS n, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS solid FROM rows_),
told AS MATERIALIZED (
  SELECT *, {_FIRST} AS c, lag({_FIRST}) OVER (PARTITION BY conv_id ORDER BY i) AS c0,
    CASE WHEN solid = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM placed),
back AS (
  SELECT conv_id, n + 1 AS i, '0000000000' AS v0, '0000000010II' AS v1, '0000000005I' AS v2, '0000000000' AS v3 FROM told WHERE i = 1
  UNION ALL
  SELECT conv_id, i, {_inserted("v")} FROM (
    SELECT conv_id, i, {", ".join(f"{_step(s)} AS w{s}" for s in range(4))}
    FROM (SELECT t.conv_id, t.i, t.c, t.fault, CASE WHEN t.fault = 'truncated' THEN 5 ELSE 0 END AS more, v0, v1, v2, v3 FROM back JOIN told t ON t.conv_id IS NOT DISTINCT FROM back.conv_id AND t.i = back.i - 1))),
audit AS (SELECT conv_id, substr(v0, 1, 10)::BIGINT AS cost, substr(v0, 11) AS audit FROM back WHERE i = 1),
letters AS (SELECT conv_id, k, substr(audit, k, 1) AS op, 1 + length(replace(substr(audit, 1, k - 1), 'I', '')) AS i FROM audit, unnest(range(1, length(audit) + 1)) u(k)),
written AS (SELECT l.conv_id, l.k, l.op, t.role, CASE WHEN op = 'I' THEN '' ELSE t.text END AS text FROM letters l LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM l.conv_id AND t.i = l.i AND l.op <> 'I' WHERE l.op <> 'D'),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY k) - CASE WHEN bool_or(op = 'K' AND starts_with(role, 's')) OVER (PARTITION BY conv_id) THEN 2 ELSE 1 END AS pos FROM written),
hashed AS (SELECT conv_id, sha256(string_agg(CASE WHEN op = 'K' THEN role WHEN pos % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY k)) AS h FROM numbered GROUP BY conv_id),
sums AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (c0 || c NOT IN ('su', 'ua', 'au')) AS illegal FROM told GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM o.conv_id
  LEFT JOIN audit a ON a.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN hashed h ON h.conv_id IS NOT DISTINCT FROM o.conv_id
"""
