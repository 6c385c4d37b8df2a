"""Operator 12: conversations made well-formed at least cost.

A repaired conversation's role initials read ``(s?(ua)+)?``. Costs to go are found backward over turns and the grammar's
states; a forward walk then takes, among the edits that keep to them, the one of the least letter (D, I, K, R). From a
state each letter leads to one state only, so that walk gives the least string of all cheapest ones.

Rows are dealt to partitions by range of conversation and turn, and a partition's conversations are repaired in a stream.
One that may go on in a neighbouring partition is taken in pieces, one a partition: a piece gives the least cost and
the least string from every state to every state, its last letter being one of a row, so that no string of a piece begins
another one. Pieces are chained by costs first and letters second, as rows are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folium.llm.common import scratch

SPACE = " \t\n\x0b\x0c\r"
#: Costs of edits, and what an undeleted truncated row adds.
DELETE, INSERT, REROLE, CUT = 3, 2, 2, 1
#: States: 0 nothing yet, 1 after s, 2 after u, 3 after a. What an inserted or reroled turn leads to from each, and the
#: states that keeping a role of some initial leads to.
WANTED = (2, 2, 3, 2)
KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ROLE = {2: "user", 3: "assistant"}
#: Cost to go and edits after the last row, by state.
END, TAIL = (0, 2 * INSERT, INSERT, 0), ("", "II", "I", "")
NEVER = 1 << 60
LEGAL = {"su", "ua", "au"}
#: Rows that a task hands on at once, and bytes of repaired text that travel in one row.
ROWS, CHUNK = 2_000, 1 << 20

Turn = tuple[str, bool, bool]  # a role's initial, whether the row must go, whether it is truncated


def costs_to_go(turns: list[Turn], end: tuple[int, ...] = END) -> list[tuple[int, ...]]:
    """For every place before, between and after the turns, the least cost from each state to the end."""
    table = [end]
    for initial, must_go, truncated in reversed(turns):
        after, own = table[-1], []
        for state in range(4):
            best = DELETE + after[state]
            if not must_go:
                best = min(best, REROLE + truncated * CUT + after[WANTED[state]])
                if initial in KEPT[state]:
                    best = min(best, truncated * CUT + after[KEPT[state][initial]])
            own.append(best)
        once = [INSERT + own[WANTED[s]] for s in range(4)]
        twice = [INSERT + once[WANTED[s]] for s in range(4)]  # a third insert is back at a state that was left
        table.append(tuple(map(min, own, once, twice)))
    table.reverse()
    return table


def walk(turns: list[Turn], table: list[tuple[int, ...]], state: int = 0) -> tuple[str, int]:
    """The least letters of a cheapest way through the turns, and the state after it; inserts after the last turn are left out."""
    letters, at = [], 0
    while at < len(turns):
        initial, must_go, truncated = turns[at]
        left, after, more = table[at][state], table[at + 1], truncated * CUT
        if DELETE + after[state] == left:
            letters.append("D")
        elif INSERT + table[at][WANTED[state]] == left:
            letters.append("I")
            state = WANTED[state]
            continue
        elif initial in KEPT[state] and more + after[KEPT[state][initial]] == left:
            letters.append("K")
            state = KEPT[state][initial]
        else:
            letters.append("R")
            state = WANTED[state]
        at += 1
    return "".join(letters), state


def rebuilt(audit: str, rows: Iterable[tuple[str, str]], state: int = 0) -> Iterator[tuple[str, str]]:
    """The repaired ``(role, text)`` of rows under an audit that begins in a state."""
    rows = iter(rows)
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        if letter == "K":
            state = KEPT[state][role[:1]]
        else:
            state = WANTED[state]
            role = ROLE[state]
        yield role, text


def fault(text: str) -> tuple[bool, bool]:
    """Whether a text is blank, and whether it is truncated."""
    inner = text.strip(SPACE)
    return not inner, bool(inner) and inner[-1] not in ".!?"


class Counted:
    """Faults of rows that come in order."""

    def __init__(self, earlier: Iterable = ()) -> None:
        self.seen = set(earlier)
        self.turns: list[Turn] = []
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.first = self.last = self.least = self.most = None

    def add(self, turn: int | None, initial: str, key: object, blank: bool, truncated: bool) -> None:
        repeated = not blank and key in self.seen
        self.seen.add(key)
        self.turns.append((initial, blank or repeated, truncated and not repeated))
        self.blank += blank
        self.duplicate += repeated
        self.truncated += truncated and not repeated
        if self.last is None:
            self.first = initial
        elif self.last + initial not in LEGAL:
            self.illegal += 1
        self.last = initial
        if turn is not None:
            self.distinct += turn != self.most
            self.least = turn if self.least is None else self.least
            self.most = turn


RESULT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _whole(rows: list[tuple]) -> tuple[list[int], str, list[tuple[str, str]]]:
    """The results, the audit and the repaired turns of a conversation's rows ``(turn, role, text, gone)`` in order."""
    found = Counted()
    kept = [(turn, role, text) for turn, role, text, gone in rows if not gone]
    for turn, role, text in kept:
        found.add(turn, role[:1], (role, text), *fault(text))
    table = costs_to_go(found.turns)
    audit, state = walk(found.turns, table)
    audit += TAIL[state]
    gaps = 0 if found.least is None else found.most - found.least + 1 - found.distinct
    numbers = [gaps, found.blank, found.duplicate, found.truncated, found.illegal, table[0][0]]
    return numbers, audit, list(rebuilt(audit, ((r, x) for _, r, x in kept)))


def _line(role: str, text: str) -> bytes:
    return f"\n{role}:{text}".encode()


def _sha(turns: list[tuple[str, str]]) -> str:
    return hashlib.sha256(b"".join(_line(*t) for t in turns)[1:]).hexdigest()


_TURNS = "array<struct<role:string,text:string>>"
_TURNS_ARROW = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_NUMBERS = ", ".join(f"{c} long" for c in RESULT)
_RAW = "piece int, seq long, t long, r string, x string, gone boolean, initial string, is_blank boolean, is_cut boolean, h binary"
_RAW_ARROW = (pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.bool_(), pa.bool_(), pa.binary())


def _dealt(rows: DataFrame) -> DataFrame:
    """``c, t, r, x, gone`` in order within partitions that follow each other by conversation and turn; equal rows, however many, can be parted."""
    d = rows.select(
        F.col("conv_id").alias("c"),
        F.col("turn").cast("long").alias("t"),
        F.coalesce("role", F.lit(" ")).alias("r"),
        F.coalesce("text", F.lit(" ")).alias("x"),
        F.col("gone") if "gone" in rows.columns else F.lit(False).alias("gone"),
        F.col("_copy") if "_copy" in rows.columns else F.lit(1).alias("_copy"),
        F.monotonically_increasing_id().alias("_row"),
    )
    keys = ["c", "t", "r", "_md5", "_row", "_copy"]
    d = d.withColumn("_md5", F.unhex(F.md5("x")))
    return d.repartitionByRange(*keys).sortWithinPartitions(*keys).select("c", "t", "r", "x", "gone")


def _first_pass(rows: DataFrame, turns: bool) -> DataFrame:
    """A row with results for every conversation inside one partition; the rows of others, by piece. Written as a table,
    so that both are read from the same partitions, however often tasks run."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = f"c {kind}, done boolean, {_NUMBERS}, audit string, sha string, turns {_TURNS}, {_RAW}"
    names = [part.split()[0] for part in f"c {kind}, done boolean, {_NUMBERS}, audit string, sha string, turns {_TURNS}, {_RAW}".replace(_TURNS, "x").split(", ")]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, c_type, nothing = TaskContext.get().partitionId(), None, object()
        current, first, seq, buffer = nothing, True, 0, []
        results: list[tuple] = []

        def batch_of(columns: list[pa.Array]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(columns, names=names)

        def solved() -> pa.RecordBatch:
            cols = list(zip(*results, strict=True))
            n = len(results)
            out = [pa.array(cols[0], c_type), pa.array([True] * n), *[pa.array([v[k] for v in cols[1]], pa.int64()) for k in range(6)]]
            out += [pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string()), pa.array(cols[4], _TURNS_ARROW)]
            results.clear()
            return batch_of([*out, *[pa.nulls(n, k) for k in _RAW_ARROW]])

        def raw() -> Iterator[pa.RecordBatch]:
            nonlocal seq
            for a in range(0, len(buffer), ROWS):
                part = buffer[a : a + ROWS]
                n = len(part)
                flags = [fault(x) for _, _, x, _ in part]
                keys = [hashlib.md5(f"{len(r)}:{r}{x}".encode()).digest() for _, r, x, _ in part]
                values = [[piece] * n, range(seq, seq + n), *zip(*part, strict=True), [r[:1] for _, r, _, _ in part], *zip(*flags, strict=True), keys]
                out = [pa.array([current] * n, c_type), pa.array([False] * n), *[pa.nulls(n, pa.int64())] * 6, pa.nulls(n, pa.string()), pa.nulls(n, pa.string()), pa.nulls(n, _TURNS_ARROW)]
                yield batch_of([*out, *[pa.array(list(v), k) for v, k in zip(values, _RAW_ARROW, strict=True)]])
                seq += n
            buffer.clear()

        for batch in batches:
            c_type = batch.column(0).type
            for a in range(0, batch.num_rows, ROWS):
                for c, *row in zip(*(col.to_pylist() for col in batch.slice(a, ROWS).columns), strict=True):
                    if current is nothing:
                        current = c
                    elif c != current:
                        if first:  # it may have begun in the partition before
                            yield from raw()
                        else:
                            numbers, audit, made = _whole(buffer)
                            results.append((current, numbers, audit, _sha(made), [{"role": r, "text": x} for r, x in made] if turns else None))
                            buffer.clear()
                        current, first, seq = c, False, 0
                    buffer.append(tuple(row))
                if first and current is not nothing:
                    yield from raw()
                if results:
                    yield solved()
        if current is not nothing:
            yield from raw()  # it may go on in the next partition

    path = scratch(rows.sparkSession, "conversations")
    _dealt(rows).mapInArrow(task, schema).write.parquet(path)
    return rows.sparkSession.read.schema(schema).parquet(path)


def _pieces(edge: DataFrame, kind: str) -> DataFrame:
    """A row of results, costs and strings by (state before, state after) for every piece of a conversation."""
    seen = edge.where("NOT gone AND NOT is_blank").select(F.col("c").alias("c0"), F.col("piece").alias("piece0"), F.col("h").alias("h0")).distinct()
    first = seen.groupBy(F.col("c0").alias("c1"), F.col("h0").alias("h1")).agg(F.min("piece0").alias("first"), F.max("piece0").alias("last")).where("first < last")
    earlier = seen.join(first, F.col("c0").eqNullSafe(F.col("c1")) & (F.col("h0") == F.col("h1"))).where("piece0 > first").select("c0", "piece0", "h0")
    out = "blank long, duplicate long, truncated long, illegal long, distinct long, least long, most long, first string, last string"
    schema = f"c {kind}, piece int, {out}, costs array<long>, audits array<string>"

    def summary(rows: pa.Table, before: pa.Table) -> pa.Table:
        found = Counted(before.column("h0").to_pylist())
        for _, t, initial, is_blank, is_cut, h, gone in sorted(zip(*(rows.column(c).to_pylist() for c in ("seq", "t", "initial", "is_blank", "is_cut", "h", "gone")), strict=True), key=lambda r: r[0]):
            if not gone:
                found.add(t, initial, h, is_blank, is_cut)
        costs, audits = [[NEVER] * 4 for _ in range(4)], [[""] * 4 for _ in range(4)]
        for end in range(4):
            table = costs_to_go(found.turns, tuple(0 if s == end else NEVER for s in range(4)))
            for start in range(4):
                if table[0][start] < NEVER:
                    costs[start][end], audits[start][end] = table[0][start], walk(found.turns, table, start)[0]
        made = {k.split()[0]: pa.array([getattr(found, k.split()[0])], pa.int64() if k.endswith("long") else pa.string()) for k in out.split(", ")}
        flat = {"costs": pa.array([sum(costs, [])], pa.list_(pa.int64())), "audits": pa.array([sum(audits, [])], pa.list_(pa.string()))}
        return pa.table({"c": rows.column("c")[:1], "piece": rows.column("piece")[:1]} | made | flat)

    slim = edge.select("c", "piece", "seq", "t", "initial", "is_blank", "is_cut", "h", "gone")
    return slim.groupBy("c", "piece").cogroup(earlier.groupBy("c0", "piece0")).applyInArrow(summary, schema)


def _chained(pieces: DataFrame, kind: str) -> DataFrame:
    """The way through each piece, ``state`` before it, ``letters`` and number of turns before it; with the results of
    the conversation at its first piece. A conversation has a piece a partition at most."""
    schema = f"c {kind}, piece int, state int, letters string, before long, {_NUMBERS}, audit string"

    def chain(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["piece"])
        ahead = [END]
        for row in reversed(rows):
            own = [min(min(row["costs"][4 * s + e] + ahead[-1][e] for e in range(4)), NEVER) for s in range(4)]
            ahead.append(tuple(own))
        ahead.reverse()
        # inserts between pieces are the next piece's first letters; it begins in any state, so costs hold them
        state, ways, before = 0, [], 0
        for row, own, after in zip(rows, ahead[:-1], ahead[1:], strict=True):
            letters, end = min((row["audits"][4 * state + e], e) for e in range(4) if row["costs"][4 * state + e] + after[e] == own[state])
            ways.append((state, letters, before))
            before += len(letters) - letters.count("D")
            state = end
        ways[-1] = (ways[-1][0], ways[-1][1] + TAIL[state], ways[-1][2])
        full = [r for r in rows if r["first"] is not None]
        met = [r for r in rows if r["least"] is not None]
        gaps = met[-1]["most"] - met[0]["least"] + 1 - sum(r["distinct"] for r in met) + sum(a["most"] == b["least"] for a, b in zip(met, met[1:])) if met else 0
        illegal = sum(r["illegal"] for r in rows) + sum(a["last"] + b["first"] not in LEGAL for a, b in zip(full, full[1:]))
        numbers = [gaps, *(sum(r[k] for r in rows) for k in ("blank", "duplicate", "truncated")), illegal, ahead[0][0]]
        n = len(rows)
        own = {k: pa.array([v] + [None] * (n - 1), pa.int64()) for k, v in zip(RESULT, numbers, strict=True)}
        own["audit"] = pa.array(["".join(w for _, w, _ in ways)] + [None] * (n - 1), pa.string())
        states, letters, places = zip(*ways, strict=True)
        c = pa.array([r["c"] for r in rows], group.schema.field("c").type)
        return pa.table({"c": c, "piece": pa.array([r["piece"] for r in rows], pa.int32()), "state": pa.array(states, pa.int32()), "letters": pa.array(letters, pa.string()), "before": pa.array(places, pa.int64())} | own)

    return pieces.groupBy("c").applyInArrow(chain, schema)


def _rebuilt(edge: DataFrame, ways: DataFrame, schema: str, rows_of) -> DataFrame:
    """``rows_of(c as an array of one, piece, turns before it, its repaired turns)`` for every piece."""

    def task(rows: pa.Table, way: pa.Table) -> pa.Table:
        kept = [(r, x) for _, r, x, gone in sorted(zip(*(rows.column(c).to_pylist() for c in ("seq", "r", "x", "gone")), strict=True), key=lambda r: r[0]) if not gone]
        own = way.to_pylist()[0]
        return rows_of(rows.column("c"), own["piece"], own["before"], rebuilt(own["letters"], kept, own["state"]))

    own = edge.select("c", "piece", "seq", "r", "x", "gone").groupBy("c", "piece")
    return own.cogroup(ways.select("c", "piece", "state", "letters", "before").groupBy("c", "piece")).applyInArrow(task, schema)


def _hashes(edge: DataFrame, ways: DataFrame, kind: str) -> DataFrame:
    """``c, sha`` of conversations in pieces. A hash is taken over a conversation's text from first to last, so that
    its last step runs in one task; only chunks of finished text get there, and they are streamed."""

    def chunks(c: pa.ChunkedArray, piece: int, before: int, turns: Iterator[tuple[str, str]]) -> pa.Table:
        parts, size, made = [], 0, []
        for turn in turns:
            parts.append(_line(*turn))
            size += len(parts[-1])
            if size >= CHUNK:
                made.append(b"".join(parts))
                parts, size = [], 0
        made.append(b"".join(parts))
        n = len(made)
        key = pa.array([c[0].as_py()] * n, c.type)
        return pa.table({"c": key, "piece": pa.array([piece] * n, pa.int32()), "chunk": pa.array(range(n), pa.int32()), "bytes": pa.array(made, pa.binary())})

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = object()
        current, running, begun, c_type = nothing, hashlib.sha256(), False, None
        for batch in batches:
            c_type, done = batch.column(0).type, []
            for c, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if current is not nothing and c != current:
                    done.append((current, running.hexdigest()))
                    running, begun = hashlib.sha256(), False
                current, data = c, data.as_py()
                running.update(data if begun else data[1:])
                begun = begun or bool(data)
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], c_type), pa.array([s for _, s in done], pa.string())], names=["c", "sha"])
        if current is not nothing:
            yield pa.RecordBatch.from_arrays([pa.array([current], c_type), pa.array([running.hexdigest()])], names=["c", "sha"])

    made = _rebuilt(edge, ways, f"c {kind}, piece int, chunk int, bytes binary", chunks)
    return made.repartition("c").sortWithinPartitions("c", "piece", "chunk").select("c", "bytes").mapInArrow(digest, f"c {kind}, sha string")


def repair(rows: DataFrame) -> DataFrame:
    """One row a conversation of ``rows (conv_id, turn, role, text)``: ``conv_id``, its faults, the edits' cost, the
    ``audit`` of their initials and the hash of the repaired turns, which :func:`repaired` has.

    Null roles and texts are one space; null turns come first; rows of one turn are ordered by role, then the text's
    md5. Null conversation ids are one conversation. Rows with a true ``gone`` column count as not there, but for their
    conversation's row. Turns of any number, and texts of any length, are taken whole; repeated rows are duplicates; an
    empty table gives none. Other columns are not read.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    first = _first_pass(rows, turns=False)
    edge = first.where("NOT done")
    done = first.where("done").select("c", *RESULT, "audit", "sha")
    ways = _written(_chained(_pieces(edge, kind), kind))
    hashes = _hashes(edge, ways, kind).select(F.col("c").alias("c1"), "sha")
    rest = ways.where("audit IS NOT NULL").join(hashes, F.col("c").eqNullSafe(F.col("c1"))).select("c", *RESULT, "audit", "sha")
    return done.unionByName(rest).select(F.col("c").alias("conv_id"), *RESULT, "audit", F.col("sha").alias("repaired_sha256"))


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired turns of all conversations of ``rows``, as :func:`repair` takes them: ``conv_id, position, role,
    text``, positions from 0. A conversation of which nothing is left has none."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    first = _first_pass(rows, turns=True)
    edge = first.where("NOT done")
    schema = f"conv_id {kind}, position long, role string, text string"

    def turns(c: pa.ChunkedArray, piece: int, before: int, made: Iterator[tuple[str, str]]) -> pa.Table:
        pairs = list(made)
        key = pa.array([c[0].as_py()] * len(pairs), c.type)
        return pa.table({"conv_id": key, "position": pa.array(range(before, before + len(pairs)), pa.int64()), "role": pa.array([r for r, _ in pairs], pa.string()), "text": pa.array([x for _, x in pairs], pa.string())})

    done = first.where("done").select("c", F.posexplode("turns").alias("position", "turn"))
    done = done.select(F.col("c").alias("conv_id"), F.col("position").cast("long").alias("position"), "turn.role", "turn.text")
    return done.unionByName(_rebuilt(edge, _written(_chained(_pieces(edge, kind), kind)), schema, turns))


def _written(df: DataFrame) -> DataFrame:
    """A table in the shared folder, so that the work before it is done once."""
    path = scratch(df.sparkSession, "ways")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` as the contract damages them, by the crc32 of ``conv_id:turn`` modulo 20; dropped rows are ``gone``."""
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate: Column = F.col("_fate")
    d = rows.select("conv_id", "turn", value("role").alias("role"), value("text").alias("text"), (F.crc32(F.concat(value("conv_id"), F.lit(":"), value("turn")).cast("binary")) % 20).alias("_fate"))
    text = F.when(fate.isin(0, 1), "").when(fate == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(fate == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(fate == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return d.select("conv_id", "turn", role.alias("role"), text.alias("text"), (fate == 0).alias("gone"), copies.alias("_copy"))


ORACLE = r"""
WITH RECURSIVE keyed AS (SELECT conv_id c, turn t, coalesce(role, ' ') r, coalesce(text, ' ') x, encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')) k FROM conversations),
fated AS (SELECT c, t, r, x, xor(list_reduce(list_concat([4294967295], list_transform(range(1, 2 * octet_length(k), 2), lambda i: ('0x' || substr(hex(k), i, 2))::BIGINT)),
    lambda crc, b: list_reduce(list_concat([xor(crc, b)], range(8)), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 20 f FROM keyed),
dam AS (SELECT c, t, CASE WHEN f = 4 THEN 'user' ELSE r END r, CASE f WHEN 1 THEN '' WHEN 2 THEN translate(x, '.!?', '') ELSE x END x, unnest(range(CASE f WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) copy FROM fated),
placed AS (SELECT c, t, r, x, substr(r, 1, 1) ini, row_number() OVER (PARTITION BY c ORDER BY t NULLS FIRST, r, md5(x)) i, NOT regexp_matches(x, '[^\x20\x09-\x0D]') blank FROM dam),
twice AS (SELECT *, NOT blank AND row_number() OVER (PARTITION BY c, r, x ORDER BY i) > 1 dup, lag(ini) OVER (PARTITION BY c ORDER BY i) before FROM placed),
turns AS (SELECT *, NOT blank AND NOT dup AND NOT regexp_matches(x, '[.!?][\x20\x09-\x0D]*$') late FROM twice),
ins(q, q2, paid, letters, lines) AS (VALUES (0, 0, 0, '', ''), (0, 2, 2, 'I', chr(10) || 'user:'), (0, 3, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
  (1, 1, 0, '', ''), (1, 2, 2, 'I', chr(10) || 'user:'), (1, 3, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
  (2, 2, 0, '', ''), (2, 3, 2, 'I', chr(10) || 'assistant:'), (2, 2, 4, 'II', chr(10) || 'assistant:' || chr(10) || 'user:'),
  (3, 3, 0, '', ''), (3, 2, 2, 'I', chr(10) || 'user:'), (3, 3, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')),
moves(q2, q3, letter, ini) AS (VALUES (0, 0, 'D', NULL), (1, 1, 'D', NULL), (2, 2, 'D', NULL), (3, 3, 'D', NULL), (0, 2, 'R', NULL), (1, 2, 'R', NULL), (2, 3, 'R', NULL), (3, 2, 'R', NULL),
  (0, 1, 'K', 's'), (0, 2, 'K', 'u'), (1, 2, 'K', 'u'), (2, 3, 'K', 'a'), (3, 2, 'K', 'u')),
best AS (SELECT DISTINCT c, 0::BIGINT i, 0 q, {'cost': 0, 'audit': '', 'lines': ''} v FROM keyed
  UNION ALL
  SELECT b.c, t.i, m.q3, min({'cost': b.v.cost + ins.paid + CASE m.letter WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + CASE WHEN m.letter <> 'D' AND t.late THEN 1 ELSE 0 END, 'audit': b.v.audit || ins.letters || m.letter,
    'lines': b.v.lines || ins.lines || CASE m.letter WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || t.r || ':' || t.x ELSE chr(10) || CASE m.q3 WHEN 2 THEN 'user:' ELSE 'assistant:' END || t.x END})
  FROM best b JOIN turns t ON t.c IS NOT DISTINCT FROM b.c AND t.i = b.i + 1 JOIN ins ON ins.q = b.q JOIN moves m ON m.q2 = ins.q2
  WHERE m.letter = 'D' OR NOT (t.blank OR t.dup) AND (m.ini IS NULL OR m.ini = t.ini) GROUP BY b.c, t.i, m.q3),
sums AS (SELECT c, count(*) n, coalesce(max(t) - min(t) + 1 - count(DISTINCT t), 0) gaps, count(*) FILTER (WHERE blank) blank, count(*) FILTER (WHERE dup) duplicate, count(*) FILTER (WHERE late) truncated,
  count(*) FILTER (WHERE before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) illegal FROM turns GROUP BY c),
ended AS (SELECT b.c, min({'cost': b.v.cost + CASE q WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 0 END, 'audit': b.v.audit || CASE q WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END,
  'lines': b.v.lines || CASE q WHEN 1 THEN chr(10) || 'user:' || chr(10) || 'assistant:' WHEN 2 THEN chr(10) || 'assistant:' ELSE '' END}) v
  FROM best b LEFT JOIN sums s ON s.c IS NOT DISTINCT FROM b.c WHERE b.i = coalesce(s.n, 0) GROUP BY b.c)
SELECT e.c conv_id, coalesce(gaps, 0) gaps, coalesce(blank, 0) blank, coalesce(duplicate, 0) duplicate, coalesce(truncated, 0) truncated, coalesce(illegal, 0) illegal, e.v.cost::BIGINT cost, e.v.audit audit, sha256(substr(e.v.lines, 2)) repaired_sha256
FROM ended e LEFT JOIN sums s ON s.c IS NOT DISTINCT FROM e.c
"""
