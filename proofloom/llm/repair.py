"""Repair of damaged conversations at the smallest cost, by Viterbi chunks that run in parallel.

Faults. Rows of a conversation stand by turn (nulls first), rows of one turn by
role and checksum of the text. The first that fits counts: blank (no character
but white space), duplicate (role and text seen in an earlier row), truncated
(the last character that is no white space ends no sentence).

Edits. K keeps a row, R (2) gives it the role that is due, D (3) deletes it,
which blank and duplicate rows require, I (2) inserts an empty text of the role
that is due. A truncated row that stays costs 1 more. The initials of the roles
must read (s?(ua)+)? in the end. Four states tell what was read: nothing, s, u
or a; the due role follows from the state, so the edits' initials (the audit)
say everything. Of the cheapest audits the least in ASCII order is taken.

Backward costs. Rows become codes of one byte, ordered by range over all
conversations and cut into chunks. Every chunk runs backwards from a vector of
the costs that the four states have at its end; only the last chunk of a
conversation knows it, the others start from a speculative one. Two vectors
that differ by a constant lead to the same edits, so vectors are kept without
their smallest value. A fix-up pass compares the vector that a chunk started
from with the one that the next chunk has found, and runs it again where they
differ. Pass k walks through up to 2^k neighbours in one task, so a wrong guess
that never converges is corrected in a logarithmic number of passes. Sums of
the constants that were taken off give the costs.

Tracing goes forward with the stitched costs; the state at a chunk's start is
settled by the same passes. Nothing but the closing text of a conversation is
put together in one task: a checksum has to read it in order. There, rows pass
one by one.

Null roles and texts are one space; an empty role has no initial and can not be
kept. Conversations of a null id are one conversation. Repeated rows are
duplicates. An empty table has an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

#: Rows of a chunk.
CHUNK = 65_536
#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1

NOTHING, S, U, A = range(4)
#: The state after the role that is due.
DUE = (U, U, A, U)
ROLES = {U: "user", A: "assistant"}
#: Costs after the last row: what is still to be inserted.
CLOSING = (0, 2 * INSERT, INSERT, 0)
#: Row codes: 3 * kind of the initial (s, u, a, another) + fault (none, truncated, to be deleted).
FINE, CUT, GONE = range(3)
_KEPT = {0: S, 1: U, 2: A}

_BLANKS = r"\x20\x09-\x0D"


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the damage that the checksum of `conv_id:turn` modulo 20 decides.

    0 drops a row, 1 empties its text, 2 removes its sentence ends, 3 repeats it, 4 makes it the user's.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(part("text"), "[.!?]", "")).otherwise(part("text"))
    return (turns.where(kind != 0)
            .select("conv_id", "turn", F.when(kind == 4, "user").otherwise(part("role")).alias("role"), text.alias("text"),
                    F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
            .drop("copy"))


def _plain(rows: DataFrame) -> DataFrame:
    """Rows without nulls in role and text, and the digest that orders rows of a turn."""
    return rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")
                       ).withColumn("digest", F.unhex(F.sha2("text", 256)))


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, uid, blank, duplicate, truncated) of each row, written once; texts stay behind."""
    text = F.col("text")
    marked = cut_lineage(_plain(rows).select(
        "conv_id", "turn", "role", "digest",
        (~text.rlike(f"[^{_BLANKS}]")).alias("blank"),
        (~text.rlike(rf"[.!?][{_BLANKS}]*\z")).alias("unended"),
        F.monotonically_increasing_id().alias("uid")), "faults")
    firsts = (marked.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn", "uid")).alias("first"))
              .select(F.col("first.uid").alias("uid"), F.lit(True).alias("first")))
    again = F.col("first").isNull()
    return marked.join(firsts, "uid", "left").select(
        "conv_id", "turn", "role", "digest", "uid", "blank", (~F.col("blank") & again).alias("duplicate"),
        (~F.col("blank") & ~again & F.col("unended")).alias("truncated"))


def row_code(role: Column, gone: Column, truncated: Column) -> Column:
    first = F.substring(role, 1, 1)
    kind = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    return (3 * kind + F.when(gone, GONE).when(truncated, CUT).otherwise(FINE)).cast("int")


def chunks(marked: DataFrame, rows: int = CHUNK) -> DataFrame:
    """(number, conv_id, codes, opens, closes): the conversations' codes in order; chunk numbers have no gaps."""
    kind = marked.schema["conv_id"].dataType

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, held, codes = TaskContext.get().partitionId(), 0, None, bytearray()
        columns = ["part", "place", "conv_id", "codes"]

        def out(found):
            ids = pa.array([x[0] for x in found], batch.schema.field(0).type)
            return pa.RecordBatch.from_arrays(
                [pa.array([part] * len(found), pa.int32()), pa.array(range(place, place + len(found)), pa.int64()), ids,
                 pa.array([bytes(x[1]) for x in found], pa.binary())], columns)

        for batch in batches:
            found = []
            at = 0
            for conv, run in groupby(batch.column(0).to_pylist()):
                n = len(list(run))
                own = bytes(batch.column(1).slice(at, n).to_pylist())
                at += n
                if codes and conv != held:
                    found.append((held, codes))
                    codes = bytearray()
                held = conv
                codes += own
                while len(codes) > rows:
                    found.append((held, codes[:rows]))
                    codes = codes[rows:]
            if found:
                yield out(found)
                place += len(found)
        if codes:
            yield out([(held, codes)])

    ordered = marked.select("conv_id", "turn", "role", "digest", "uid",
                            row_code(F.col("role"), F.col("blank") | F.col("duplicate"), F.col("truncated")).alias("code"))
    keys = ["conv_id", "turn", "role", "digest", "uid"]
    schema = T.StructType().add("part", "integer").add("place", "long").add("conv_id", kind).add("codes", "binary")
    found = cut_lineage(ordered.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv_id", "code")
                        .mapInArrow(cut, schema), "chunks")
    # One row for each shuffle partition.
    sizes = sorted((r["part"], r["n"]) for r in found.groupBy("part").agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for part, n in sizes:
        starts.append((part, total))
        total += n
    offsets = found.sparkSession.createDataFrame(starts, "part int, start long")
    numbered = found.join(F.broadcast(offsets), "part").select((F.col("start") + F.col("place")).alias("number"), "conv_id", "codes")
    narrow = numbered.select("number", F.col("conv_id").alias("other"), F.lit(True).alias("met"))
    before = narrow.select((F.col("number") + 1).alias("number"), F.col("other").alias("earlier"), F.col("met").alias("has_earlier"))
    after = narrow.select((F.col("number") - 1).alias("number"), F.col("other").alias("later"), F.col("met").alias("has_later"))
    own = numbered.join(before, "number", "left").join(after, "number", "left")
    same = lambda has, other: F.coalesce(F.col(has) & F.col("conv_id").eqNullSafe(F.col(other)), F.lit(False))
    return cut_lineage(own.select("number", "conv_id", "codes", (~same("has_earlier", "earlier")).alias("opens"),
                                  (~same("has_later", "later")).alias("closes")), "numbered")


def _levelled(costs: list[int]) -> tuple[tuple[int, ...], int]:
    least = min(costs)
    return tuple(c - least for c in costs), least


@lru_cache(65_536)
def step(code: int, after: tuple[int, ...]) -> tuple[tuple[int, ...], int, tuple[tuple[str, int], ...]]:
    """Costs of the states before a row, without their least, the least, and for each state the edits and the state after the row."""
    kind, fault = divmod(code, 3)
    more = TRUNCATED if fault == CUT else 0

    def choices(state):
        yield DELETE + after[state], "D", state
        if fault != GONE:
            kept = _KEPT.get(kind)
            if kept is not None and (kept == DUE[state] or (kept, state) == (S, NOTHING)):
                yield more + after[kept], "K", kept
            yield REROLE + more + after[DUE[state]], "R", DUE[state]

    best = [min(choices(state)) for state in range(4)]
    costs = [b[0] for b in best]
    for _ in range(2):  # the due roles alternate after two inserts
        costs = [min(c, INSERT + costs[DUE[state]]) for state, c in enumerate(costs)]

    def edits(state):
        if best[state][0] == costs[state] and best[state][1] == "D":
            return "D", state
        if INSERT + costs[DUE[state]] == costs[state]:
            rest, end = edits(DUE[state])
            return "I" + rest, end
        return best[state][1:]

    return *_levelled(costs), tuple(edits(state) for state in range(4))


def backward(codes: bytes, extra, after: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    """The levelled costs before a chunk, and the sum that was taken off."""
    total = 0
    for code in reversed(codes):
        after, least, _ = step(code, after)
        total += least
    return after, total


def _moves(codes: bytes, after: tuple[int, ...]) -> list[tuple[tuple[str, int], ...]]:
    out = []
    for code in reversed(codes):
        after, _, moves = step(code, after)
        out.append(moves)
    return out[::-1]


def forward(codes: bytes, after: tuple[int, ...], entry: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    """The state after a chunk."""
    state = entry[0]
    for moves in _moves(codes, after):
        state = moves[state][1]
    return (state,), 0


def audit(codes: bytes, after: tuple[int, ...], state: int, closes: bool) -> str:
    """The edits of a chunk that is entered in a state."""
    out = []
    for moves in _moves(codes, after):
        edits, state = moves[state]
        out.append(edits)
    if closes:
        out.append("I" * (CLOSING[state] // INSERT))
    return "".join(out)


_RUN = "number long, given array<int>, found array<int>, least long"
_RUN_NAMES = ["number", "given", "found", "least"]


def _ran(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], _RUN_NAMES)


def converge(cut: DataFrame, run: Callable, edge: str, first: tuple[int, ...], guess: tuple[int, ...], back: bool) -> DataFrame:
    """(number, given, found, least) of every chunk: what it started from, and what it found at its other end.

    cut(number, codes, extra, opens, closes). `edge` names the column of the chunks that know what to start from.
    """
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for number, codes, extra, known in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                given = first if known else guess
                rows.append((number, given, *run(codes, extra and tuple(extra), given)))
            if rows:
                yield _ran(rows)

    found = cut_lineage(cut.select("number", "codes", "extra", edge).mapInArrow(whole, _RUN), "run")
    if cut.where(~F.col(edge)).isEmpty():
        return found

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = carried = None
        for batch in batches:
            rows = []
            for own, number, codes, extra, given, old, least, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                # The first of a group takes what its neighbour outside had found; the others what was found just now.
                want = wanted if own != group or wanted is None else carried
                given = tuple(given)
                if want is None or given == tuple(want):
                    carried = tuple(old)
                else:
                    given = tuple(want)
                    carried, least = run(codes, extra and tuple(extra), given)
                group = own
                rows.append((number, given, carried, least))
            if rows:
                yield _ran(rows)

    beside, k = -1 if back else 1, 0
    while True:
        k += 1
        inner = cut.where(~F.col(edge)).select("number")
        near = found.select((F.col("number") + beside).alias("number"), F.col("found").alias("wanted"))
        wanted = near.join(inner, "number", "left_semi")
        group = F.floor(F.col("number") / 2**k)
        open_groups = (found.join(wanted, "number").where(F.col("given") != F.col("wanted"))
                       .select(group.alias("own")).distinct())
        open_groups = cut_lineage(open_groups, "open")
        if open_groups.isEmpty():
            return found
        asked = found.withColumn("own", group).join(open_groups, "own", "left_semi")
        order = F.col("number").desc() if back else F.col("number").asc()
        again = (asked.join(cut.select("number", "codes", "extra"), "number").join(wanted, "number", "left")
                 .select("own", "number", "codes", "extra", "given", "found", "least", "wanted")
                 .repartition("own").sortWithinPartitions("own", order).mapInArrow(walk, _RUN))
        rest = found.withColumn("own", group).join(open_groups, "own", "left_anti").select(*_RUN_NAMES)
        found = cut_lineage(rest.unionByName(again), "run")


def audits(marked: DataFrame, rows: int = CHUNK) -> DataFrame:
    """(number, conv_id, cost, audit): the edits of each chunk and its part of the cost."""
    cut = chunks(marked, rows)
    costs = converge(cut.withColumn("extra", F.lit(None).cast("array<int>")), backward, "closes", CLOSING, CLOSING, True)
    told = cut.join(costs.select("number", F.col("given").alias("extra"), "found", "least"), "number")
    told = cut_lineage(told, "costs")
    states = converge(told.select("number", "codes", "extra", "opens", "closes"), forward, "opens", (NOTHING,), (A,), False)

    @F.arrow_udf("string")
    def edits(codes: pa.Array, after: pa.Array, state: pa.Array, closes: pa.Array) -> pa.Array:
        columns = (codes.to_pylist(), after.to_pylist(), state.to_pylist(), closes.to_pylist())
        return pa.array([audit(c, tuple(v), s, end) for c, v, s, end in zip(*columns, strict=True)], pa.string())

    opening = F.when(F.col("opens"), F.element_at("found", NOTHING + 1)).otherwise(0)
    return told.join(states.select("number", F.element_at("given", 1).alias("state")), "number").select(
        "number", "conv_id", (F.col("least") + opening).alias("cost"), edits("codes", "extra", "state", "closes").alias("audit"))


def _mended(edits: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """(role, text) of the repaired conversation, one by one. All rows are taken, also after the last edit."""
    state = NOTHING
    for edit in edits:
        if edit == "I":
            state = DUE[state]
            yield ROLES[state], ""
            continue
        role, text = next(rows)
        if edit == "K":
            state = {"s": S, "u": U, "a": A}[role[0]]
            yield role, text
        elif edit == "R":
            state = DUE[state]
            yield ROLES[state], text


_FIELDS = ["conv_id", "kind", "number", "turn", "role", "digest", "text"]


def _stream(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Edits and rows of each conversation together, edits first, both in order."""
    kinds = {f.name: f.dataType for f in rows.schema}
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    texts = _plain(rows).select("conv_id", F.lit(1).alias("kind"), none("number", "long"), "turn", "role", "digest", "text")
    edits = found.select("conv_id", F.lit(0).alias("kind"), "number", none("turn", kinds["turn"]), none("role", "string"),
                         none("digest", "binary"), F.col("audit").alias("text"))
    return edits.unionByName(texts).repartition("conv_id").sortWithinPartitions(*_FIELDS[:-1])


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, edits, iterator of its rows) for each conversation of sorted batches."""
    def rows():
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "kind", "role", "text")), strict=True)

    for conv, own in groupby(rows(), lambda r: r[0]):
        edits, first = [], None
        for r in own:
            if r[1]:
                first = r
                break
            edits.append(r[3])

        def rest(first=first, own=own):
            if first is not None:
                yield first[2:]
            yield from (r[2:] for r in own)

        yield conv, "".join(edits), rest()


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, position, role, text): the repaired conversations. found: as from `audits`."""
    kind = rows.schema["conv_id"].dataType
    schema = T.StructType().add("conv_id", kind).add("position", "long").add("role", "string").add("text", "string")

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        to = pa.schema([("conv_id", _arrow(kind)), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string())])

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*out, strict=True), to, strict=True)], schema=to)

        for conv, edits, own in _conversations(batches):
            for position, (role, text) in enumerate(_mended(edits, own)):
                out.append((conv, position, role, text))
                size += len(text)
                if len(out) >= 10_000 or size > 4_000_000:
                    yield batch()
                    out, size = [], 0
        if out:
            yield batch()

    return _stream(rows, found).mapInArrow(mend, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, illegal, audit, repaired_sha256): adjacent roles that the grammar forbids, all edits, and a checksum of the repaired lines."""
    kind = rows.schema["conv_id"].dataType
    schema = T.StructType().add("conv_id", kind).add("illegal", "long").add("audit", "string").add("repaired_sha256", "string")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = pa.schema([("conv_id", _arrow(kind)), ("illegal", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])
        out: list[tuple] = []
        for conv, edits, own in _conversations(batches):
            illegal, last = 0, None

            def counted(own=own):
                nonlocal illegal, last
                for role, text in own:
                    if last is not None and last + role[:1] not in ("su", "ua", "au"):
                        illegal += 1
                    last = role[:1]
                    yield role, text

            sha, lead = hashlib.sha256(), ""
            for role, text in _mended(edits, counted()):
                sha.update(f"{lead}{role}:{text}".encode())
                lead = "\n"
            out.append((conv, illegal, edits, sha.hexdigest()))
            if len(out) >= 5000:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*out, strict=True), to, strict=True)], schema=to)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*out, strict=True), to, strict=True)], schema=to)

    return _stream(rows, found).mapInArrow(digest, schema)


def report(turns: DataFrame, rows: int = CHUNK) -> DataFrame:
    """One row for each conversation of `turns`, after damage: counts of faults, cost, audit and checksum of the repair."""
    own = damaged(turns)
    marked = cut_lineage(faults(own), "marked")
    found = cut_lineage(audits(marked, rows), "audits")
    counts = marked.groupBy("conv_id").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"),
        *[F.sum(F.col(c).cast("long")).alias(c) for c in ("blank", "duplicate", "truncated")])
    costs = found.groupBy("conv_id").agg(F.sum("cost").alias("cost"))
    ids = turns.select(F.col("conv_id").alias("id")).distinct()
    out = ids
    for part in (counts, costs, digests(own, found)):
        out = out.join(part, F.col("id").eqNullSafe(part["conv_id"]), "left").drop(part["conv_id"])
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select(F.col("id").alias("conv_id"), *[number(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
