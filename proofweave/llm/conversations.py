"""Repair of conversation structure: the cheapest edits by an auction for shortest paths.

Rows of a conversation are kept (0), given another role (3), deleted (4) or joined by inserted empty rows (3), so that the
initials of the roles read ``(s?(ua)+)?``; a truncated row that stays adds 3, a blank or repeated row must go. Nodes of the
cost lattice are (rows read, state), with four states: nothing yet, after the system row, after a user, after an assistant.

**Auction.** Every node has a price, at first a lower bound of its distance to the end. A path is extended along the arc
with the least cost plus price as long as its last node's price equals that sum; where the price is lower it is raised to
it and the path contracted by that node. A path that meets a converged node converges all its nodes. Origins are taken
from the last row backwards and prices are kept from one to the next, so a row costs a constant number of steps. Converged
prices expose the tight arcs (price = cost + price of the end), and following the arc with the least letter from the first
node spells the ASCII-least of all cheapest edits.

**Long conversations.** Rows are range-partitioned by (conversation, turn, ...) and cut into chunks of at most
``CHUNK_ROWS`` rows and about ``CHUNK_BYTES``, so a conversation that holds a third of all rows lies in many chunks and
tasks. Its chunks agree on repeated rows by one aggregation of row keys; each chunk's prices towards each exit state are arcs
of a coarser lattice, whose prices run backwards over the chunks (four numbers at a time); then each chunk traces its edits
from each entry state by itself. One streaming pass over the chunks in order, which holds one Arrow batch, picks the traces
and feeds the digest; SHA-256 of a text is sequential by nature, so that pass alone is not split.

Rows that tie in turn are taken by role, first 64 characters and XXH64 of the text; null roles and texts are one space, a
null turn comes first and does not count as a turn, a null conv_id is a conversation. A conversation without rows has costs
of zero, an empty audit and the digest of the empty string. Empty table: no rows.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, settle

CHUNK_ROWS = 256
CHUNK_BYTES = 1 << 20
DELETE, ANEW, TRUNCATED = 4, 3, 3
#: states a kept row leads to, by initial; state and role of a reroled or inserted row
_KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_TURN = (2, 2, 3, 2)
_ROLE = ("user", "user", "assistant", "user")
_FAR = 1 << 60
_END = (0, _FAR, _FAR, 0)
_BLANK, _REPEATED = "0", "="
_CUT = {"s": "S", "u": "U", "a": "A", "-": "_"}
_SPACE = " \t\n\x0b\x0c\r"
_LEGAL = {"su", "ua", "au"}


def code(role: str, text: str) -> str:
    """One character for a row: its fault if it must go, else its initial, as a capital if it is truncated."""
    seen = text.rstrip(_SPACE)
    if not seen:
        return _BLANK
    initial = role[:1] if role[:1] in ("s", "u", "a") else "-"
    return initial if seen[-1] in ".!?" else _CUT[initial]


def arcs(shape: str, place: int, state: int, last: bool) -> list[tuple[str, int, int, int]]:
    """(letter, cost, place, state) of each edit at a node, by letter. Inserts at the end of a chunk belong to the next one."""
    out = []
    inside = place < len(shape)
    if inside:
        out.append(("D", DELETE, place + 1, state))
    if inside or last:
        out.append(("I", ANEW, place, _TURN[state]))
    if inside and shape[place] not in (_BLANK, _REPEATED):
        row = shape[place]
        extra = TRUNCATED if row in _CUT.values() else 0
        kept = _KEPT[state].get(row.lower())
        if kept is not None:
            out.append(("K", extra, place + 1, kept))
        out.append(("R", ANEW + extra, place + 1, _TURN[state]))
    return out


def prices(shape: str, ends: tuple[int, ...] = _END, last: bool = True) -> list[list[int]]:
    """Converged prices of all nodes; ``ends``: the price behind the last row, by state."""
    size = len(shape)
    value = [[_FAR] * 4 for _ in range(size + 1)]
    for place in range(size, -1, -1):
        own, beyond = value[place], ends if place == size else value[place + 1]
        if place == size and not last:
            own[:] = ends
            continue
        own[:] = [min(beyond)] * 4
        converged = set()
        if min(beyond[2:]) >= _FAR:  # neither state can leave this row
            own[2:] = [_FAR, _FAR]
            converged |= {2, 3}
        for origin in (3, 2, 1, 0):
            path = [origin]
            while not converged.issuperset(path):
                node = path[-1]
                # the end itself is place size + 1
                steps = [(cost + value[p][s], p, s) for _, cost, p, s in arcs(shape, place, node, last)]
                if place == size:
                    steps.append((ends[node], size + 1, node))
                best, p, s = min(steps)
                if own[node] < best:
                    own[node] = best
                    if len(path) > 1:
                        path.pop()
                elif p > place or s in converged:
                    converged.update(path)
                else:
                    path.append(s)
    return value


def trace(shape: str, value: list[list[int]], state: int, last: bool) -> tuple[str, int]:
    """The least letters along tight arcs from a state before the first row, and the state after them."""
    place, letters = 0, []
    while place < len(shape) or (last and value[place][state]):
        letter, _, place, state = next(a for a in arcs(shape, place, state, last) if a[1] + value[a[2]][a[3]] == value[place][state])
        letters.append(letter)
    return "".join(letters), state


@lru_cache(1 << 16)
def solved(shape: str) -> tuple[int, str]:
    """Cost and audit of a whole conversation; short ones share few shapes."""
    value = prices(shape)
    return value[0][0], trace(shape, value, 0, True)[0]


def repaired(roles: list[str], texts: list[str], audit: str, state: int):
    """Lines ``role:text`` that the edits leave."""
    at = 0
    for letter in audit:
        if letter == "K":
            yield f"{roles[at]}:{texts[at]}"
            state = _KEPT[state][roles[at][:1]]
        elif letter != "D":
            yield f"{_ROLE[state]}:{texts[at] if letter == 'R' else ''}"
            state = _TURN[state]
        at += letter != "I"


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, dropped: rows damaged by the checksum of ``conv_id:turn``; dropped rows stay, marked."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    marked = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("damage"))
    text = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("damage") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(1), F.when(F.col("damage") == 3, 2).otherwise(1))).alias("copies")
    return marked.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("damage") == 0).alias("dropped"), copies).drop("copies")


class _Rows:
    """Result rows, given out in batches."""

    def __init__(self, schema: pa.Schema, bytes_: int = 1 << 20):
        self.schema, self.held, self.size, self.most = schema, [], 0, bytes_

    def add(self, row: tuple, size: int = 64):
        self.held.append(row)
        self.size += size
        if self.size >= self.most:
            yield from self.rest()

    def rest(self):
        if self.held:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in self.held], f.type) for i, f in enumerate(self.schema)], schema=self.schema)
        self.held, self.size = [], 0


_CHUNK = "part long, seq long, whole boolean, turns array<long>, roles array<string>, texts array<string>, shape string"


def _schemas(key, columns: str):
    """The Spark and Arrow schema of ``conv_id`` and ``columns``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType().add("conv_id", key)
    for field in StructType.fromDDL(columns).fields:
        schema = schema.add(field)
    return schema, to_arrow_schema(schema)


def chunks(rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Chunks of neighbouring rows of one conversation, ordered by (part, seq); ``whole``: certainly all of it.

    ``shape`` knows repeated rows within the chunk only.
    """
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", F.substring("text", 1, 64), F.xxhash64("text"), "row"]
    placed = rows.withColumn("row", F.monotonically_increasing_id())
    placed = placed.repartitionByRange(*order).sortWithinPartitions(*order).drop("row")
    schema, arrow = _schemas(rows.schema["conv_id"].dataType, _CHUNK)

    def run(batches):
        from pyspark import TaskContext

        part, seq, out = TaskContext.get().partitionId(), 0, _Rows(arrow)
        held: list[tuple] = []
        key, size, began, edge = None, 0, True, True  # edge: the conversation may have begun in an earlier partition

        def chunk(whole: bool):
            nonlocal seq, held, size
            live = [(t, r, x) for t, r, x, gone in held if not gone]
            shape, seen = [], set()
            for _, role, text in live:
                c = code(role, text)
                shape.append(_REPEATED if c != _BLANK and (role, text) in seen else c)
                seen.add((role, text))
            row = (key, part, seq, whole, *([r[i] for r in live] for i in range(3)), "".join(shape))
            seq, held, size = seq + 1, [], 0
            return out.add(row, 64 + sum(len(r[2]) for r in live))

        for batch in batches:
            for conv, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (held or not began) and conv != key:
                    yield from chunk(whole=began and not edge)
                    began, edge = True, False
                elif held and (len(held) >= chunk_rows or size >= CHUNK_BYTES):
                    yield from chunk(whole=False)
                    began = False
                key = conv
                held.append(row)
                size += len(row[2])
        if held:
            yield from chunk(whole=False)
        yield from out.rest()
        settle()

    return cut(placed.select("conv_id", "turn", "role", "text", "dropped").mapInArrow(run, schema))


def _agreed(parts: DataFrame) -> DataFrame:
    """``parts`` with shapes in which rows are repeated if they stand anywhere earlier in the conversation."""
    schema, arrow = _schemas(parts.schema["conv_id"].dataType, "part long, seq long, row int, same binary")

    def keys(batches):
        out = _Rows(arrow)
        for batch in batches:
            for conv, part, seq, roles, texts, shape in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "part", "seq", "roles", "texts", "shape")), strict=True):
                for row, (role, text, c) in enumerate(zip(roles, texts, shape, strict=True)):
                    if c not in (_BLANK, _REPEATED):
                        same = hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
                        yield from out.add((conv, part, seq, row, same))
        yield from out.rest()

    first = parts.mapInArrow(keys, schema).groupBy("conv_id", "same").agg(F.min(F.struct("part", "seq", "row")).alias("at"))
    # at most one entry a row of the chunk
    fresh = first.groupBy(F.col("at.part").alias("part"), F.col("at.seq").alias("seq")).agg(F.collect_list("at.row").alias("fresh"))
    joined = parts.join(fresh, ["part", "seq"], "left").select("conv_id", "part", "seq", "turns", "roles", "texts", "shape", "fresh")
    schema, arrow = _schemas(parts.schema["conv_id"].dataType, "part long, seq long, turns array<long>, roles array<string>, texts array<string>, shape string, matrix array<long>, final array<long>")

    def shapes(batches):
        out = _Rows(arrow)
        for batch in batches:
            for conv, part, seq, turns, roles, texts, shape, fresh in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                known = set(fresh or ())
                shape = "".join(c if c == _BLANK or row in known else _REPEATED for row, c in enumerate(shape))
                matrix = [x for s in range(4) for x in prices(shape, tuple(0 if s == t else _FAR for t in range(4)), False)[0]]
                yield from out.add((conv, part, seq, turns, roles, texts, shape, matrix, prices(shape)[0]), 64 + sum(map(len, texts)))
        yield from out.rest()
        settle()

    return cut(joined.mapInArrow(shapes, schema))


def _traced(parts: DataFrame) -> DataFrame:
    """``parts`` with the price of the whole rest, and edits and exit state for each entry state."""
    key = parts.schema["conv_id"].dataType
    schema, arrow = _schemas(key, "part long, seq long, ends array<long>")

    def backwards(batches):
        """Prices behind each chunk of a conversation, from its last chunk to its first; none behind the last."""
        out, conv, price = _Rows(arrow), None, None
        for batch in batches:
            for own, part, seq, matrix, final in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ends = price if price and own == conv else None
                yield from out.add((own, part, seq, ends))
                conv = own
                price = final if ends is None else [min(_FAR, min(matrix[4 * t + s] + ends[t] for t in range(4))) for s in range(4)]
        yield from out.rest()

    order = ["conv_id", F.desc("part"), F.desc("seq")]
    ends = parts.select("conv_id", "part", "seq", "matrix", "final").repartition("conv_id").sortWithinPartitions(*order).mapInArrow(backwards, schema)
    joined = parts.drop("matrix", "final").join(ends.drop("conv_id"), ["part", "seq"])
    schema, arrow = _schemas(key, "part long, seq long, turns array<long>, roles array<string>, texts array<string>, shape string, price long, audits array<string>, exits array<int>")

    def run(batches):
        out = _Rows(arrow)
        for batch in batches:
            for conv, part, seq, turns, roles, texts, shape, ends in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "part", "seq", "turns", "roles", "texts", "shape", "ends")), strict=True):
                value = prices(shape, _END if ends is None else tuple(ends), ends is None)
                found = [trace(shape, value, s, ends is None) for s in range(4)]
                yield from out.add((conv, part, seq, turns, roles, texts, shape, value[0][0], [a for a, _ in found], [s for _, s in found]), 64 + sum(map(len, texts)))
        yield from out.rest()
        settle()

    return joined.mapInArrow(run, schema)


class _Report:
    """What is known of a conversation after some of its chunks."""

    def __init__(self, conv, cost: int):
        self.conv, self.cost, self.state, self.audit = conv, cost, 0, []
        self.low = self.turn = None
        self.turns = self.blank = self.repeated = self.truncated = self.illegal = 0
        self.role, self.digest, self.lines = None, hashlib.sha256(), 0

    def add(self, turns, roles, texts, shape: str, audit: str, state: int) -> None:
        self.blank += shape.count(_BLANK)
        self.repeated += shape.count(_REPEATED)
        self.truncated += sum(c in "SUA_" for c in shape)
        for turn in turns:
            if turn is not None and turn != self.turn:
                self.low = turn if self.low is None else self.low
                self.turn, self.turns = turn, self.turns + 1
        for role in roles:
            self.illegal += self.role is not None and self.role + role[:1] not in _LEGAL
            self.role = role[:1]
        for line in repaired(roles, texts, audit, self.state):
            self.digest.update((("\n" if self.lines else "") + line).encode("utf-8", "surrogatepass"))
            self.lines += 1
        self.audit.append(audit)
        self.state = state

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.turn - self.low + 1 - self.turns
        return self.conv, gaps, self.blank, self.repeated, self.truncated, self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest()


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repairs(rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text, dropped): faults, cost, edits, digest of the result."""
    bounded_batches(rows.sparkSession)
    parts = chunks(rows, chunk_rows)
    schema, arrow = _schemas(rows.schema["conv_id"].dataType, RESULT)

    def short(batches):
        out = _Rows(arrow)
        for batch in batches:
            for conv, turns, roles, texts, shape in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                cost, audit = solved(shape)
                report = _Report(conv, cost)
                report.add(turns, roles, texts, shape, audit, 0)
                yield from out.add(report.row(), 256)
        yield from out.rest()
        settle()

    def long(batches):
        out, now = _Rows(arrow), None
        for batch in batches:
            for conv, turns, roles, texts, shape, price, audits, exits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now.conv != conv:
                    if now:
                        yield from out.add(now.row(), 256)
                    now = _Report(conv, price)
                now.add(turns, roles, texts, shape, audits[now.state], exits[now.state])
        if now:
            yield from out.add(now.row(), 256)
        yield from out.rest()
        settle()

    whole = parts.where("whole").select("conv_id", "turns", "roles", "texts", "shape").mapInArrow(short, schema)
    cut_up = _traced(_agreed(parts.where("NOT whole"))).repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    return whole.union(cut_up.select("conv_id", "turns", "roles", "texts", "shape", "price", "audits", "exits").mapInArrow(long, schema))
