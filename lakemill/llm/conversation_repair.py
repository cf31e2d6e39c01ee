"""Repair of the structure of conversations by rank-convergence parallel Viterbi.

Edits are Keep (0), Rerole to user or assistant (2), Delete (3, a must for blank and duplicate rows) and Insert of an
empty user or assistant text (2); a truncated row that stays adds 1. The cheapest edits whose role initials read
``(s?(ua)+)?`` are taken, of equally cheap ones those whose initials D, I, K, R read first.

Rows are dealt by ranges of (conversation, turn), so a conversation of any size is cut into many partitions and each
partition's share into chunks of CHUNK rows. A chunk is a string with one letter a row. The grammar has four states
(nothing yet, after s, after u, after a), so the costs from a place to the end are a vector of four. Every chunk starts
from a speculative vector, the one at the end of a conversation, and works back to its first row. Then come fix-up
passes: a chunk takes the vector that its successor has found and, if it differs from the one it used by more than a
constant, runs again. The vectors soon converge to rank one, so that few chunks run twice. When none has to, each
chunk holds the right costs up to a constant, and traces its edits from them for each of the four states in which it
may be entered; these maps are composed along the conversation by doubling, and each chunk is traced from its own
state. Chunks that hold only rows which must go change no state and are left out of this.

A last shuffle by conversation streams rows and edits in order to give the repaired turns. Reports are made in the
same tasks: a SHA-256 is one pass over its text in order, so one task reads one conversation there, row by row, and
holds its edits but not its texts. Only conversations at the borders of partitions need their duplicates looked up
across partitions; there are fewer of them than partitions, and the list is broadcast.

Defined results: rows of a conversation stand by turn, role and text, nulls first. A role counts by its first letter;
a null or empty role, or another letter, fits nowhere and is reroled or deleted. A null text is blank. Rows without a
conversation id form one conversation. A row that repeats role and text of an earlier row of its conversation is a
duplicate, whatever its turn. A conversation that has no rows has a report of zeros, no edits and the hash of nothing.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lakemill.functions.lineage import settle, shared_folder
from lakemill.sources.tables import read_table

CHUNK = 1024
WHITE = " \t\n\x0b\x0c\r"
KEEP_TRUNCATED, REROLE, INSERT, DELETE = 1, 2, 2, 3
#: States: nothing yet, after s, after u, after a. The state after an inserted or reroled row, and its role.
FOLLOWING, ROLE = (2, 2, 3, 2), ("user", "user", "assistant", "user")
#: The state after a kept row, by state and initial.
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: Costs at the end: ``ua`` may have to be completed.
END = (0, 2 * INSERT, INSERT, 0)


@lru_cache(maxsize=100_000)
def costs_before(letter: str, after: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    """Costs before a row from those after it, less their smallest, and the smallest.

    Letters: D for a row that must go, else s, u, a or o (other), in capitals where the row is truncated.
    """
    costs = []
    for state in range(4):
        cost = DELETE + after[state]
        if letter != "D":
            more = KEEP_TRUNCATED * letter.isupper()
            cost = min(cost, REROLE + more + after[FOLLOWING[state]])
            if (kept := KEPT.get((state, letter.lower()))) is not None:
                cost = min(cost, more + after[kept])
        costs.append(cost)
    for _ in range(3):
        costs = [min(c, INSERT + costs[FOLLOWING[state]]) for state, c in enumerate(costs)]
    least = min(costs)
    return tuple(c - least for c in costs), least


@lru_cache(maxsize=100_000)
def edits_at(letter: str, state: int, after: tuple[int, ...]) -> tuple[str, int]:
    """The first in ASCII of the cheapest edits of a row and of inserts before it, and the state after it."""
    before, least = costs_before(letter, after)
    edits = ""
    while True:
        rest = before[state] + least
        if DELETE + after[state] == rest:
            return edits + "D", state
        if INSERT + before[FOLLOWING[state]] + least == rest:
            edits, state = edits + "I", FOLLOWING[state]
            continue
        kept = KEPT.get((state, letter.lower()))
        if kept is not None and KEEP_TRUNCATED * letter.isupper() + after[kept] == rest:
            return edits + "K", kept
        return edits + "R", FOLLOWING[state]


def backward(letters: str, end: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Cost vectors, each less its smallest, before each letter and at the end."""
    out = [end]
    for letter in reversed(letters):
        out.append(costs_before(letter, out[-1])[0])
    return out[::-1]


def trace(letters: str, vectors: list[tuple[int, ...]], state: int) -> tuple[str, int]:
    edits = []
    for letter, after in zip(letters, vectors[1:]):
        more, state = edits_at(letter, state, after)
        edits.append(more)
    return "".join(edits), state


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def vector_before(letters: pa.Array, end: pa.Array) -> pa.Array:
    return pa.array([backward(s, tuple(e))[0] for s, e in zip(letters.to_pylist(), end.to_pylist())], pa.list_(pa.int32()))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def states_after(letters: pa.Array, end: pa.Array) -> pa.Array:
    out = []
    for s, e in zip(letters.to_pylist(), end.to_pylist()):
        vectors = backward(s, tuple(e))
        out.append([trace(s, vectors, state)[1] for state in range(4)])
    return pa.array(out, pa.list_(pa.int32()))


@F.arrow_udf(T.StringType())
def traced(letters: pa.Array, end: pa.Array, state: pa.Array) -> pa.Array:
    return pa.array([trace(s, backward(s, tuple(e)), q)[0] for s, e, q in zip(letters.to_pylist(), end.to_pylist(), state.to_pylist())], pa.string())


def mark(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    """Numbers rows and chunks of one partition and finds repeats within it. Holds 16 bytes a row of the current conversation."""
    row, part, held, current, seen = 0, -1, 0, (), set()
    for batch in batches:
        parts, rows, repeats, digests = [], [], [], []
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "text"))):
            if current != (conv,) or held == chunk:
                part, held = part + 1, 0
                if current != (conv,):
                    current, seen = (conv,), set()
            key = hashlib.blake2b(f"{role is None}:{role}:{text is None}:{text}".encode(), digest_size=16).digest()
            repeats.append(key in seen)
            seen.add(key)
            digests.append(key)
            parts.append(part)
            rows.append(row)
            row, held = row + 1, held + 1
        more = {"chunk": pa.array(parts, pa.int64()), "row": pa.array(rows, pa.int64()), "repeat": pa.array(repeats, pa.bool_()), "digest": pa.array(digests, pa.binary())}
        yield pa.RecordBatch.from_arrays([*batch.columns, *more.values()], [*batch.schema.names, *more])


def fault_columns(rows: DataFrame) -> DataFrame:
    tail = F.rtrim(F.coalesce("text", F.lit("")), F.lit(WHITE))
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    whole = F.right(tail, F.lit(1)).isin(".", "!", "?")
    return rows.select("*", (tail == "").alias("blank"), F.when(whole, letter).otherwise(F.upper(letter)).alias("letter"))


def placed(rows: DataFrame, chunk: int) -> DataFrame:
    """Rows (conv, turn, role, text) in order: with part, chunk and row, written to the shared folder."""
    spark = rows.sparkSession
    order = ["conv", "turn", "role", "text", "tie"]
    #: Equal rows can be dealt to several partitions.
    dealt = fault_columns(rows).withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = dealt.drop("tie").withColumn("part", F.spark_partition_id())
    path = f"{shared_folder(spark)}/conversations-{uuid.uuid4().hex}"
    schema = T.StructType([*dealt.schema.fields, *[T.StructField(c, T.LongType()) for c in ("chunk", "row")], T.StructField("repeat", T.BooleanType()), T.StructField("digest", T.BinaryType())])
    dealt.mapInArrow(lambda batches: mark(batches, chunk), schema).write.parquet(path)
    return spark.read.parquet(path)


def late_duplicates(rows: DataFrame) -> DataFrame:
    """(late_part, late_row) of the first rows of their partition that repeat a row of an earlier partition."""
    across = rows.groupBy(F.col("conv").alias("at")).agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low < high").select("at")
    #: A conversation over two partitions holds the border between them: fewer rows than partitions.
    firsts = rows.filter("NOT repeat AND NOT blank").join(F.broadcast(across), F.col("conv").eqNullSafe(F.col("at"))).select("conv", "digest", "part", "row")
    least = firsts.groupBy(F.col("conv").alias("c"), F.col("digest").alias("d")).agg(F.min("part").alias("least"))
    late = firsts.join(least, F.col("conv").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d"))).filter("part > least")
    return late.select(F.col("part").alias("late_part"), F.col("row").alias("late_row"))


def chunks_of(rows: DataFrame) -> DataFrame:
    """(conv, part, chunk, letters), one row for each chunk."""
    late = late_duplicates(rows)
    known = rows.select("conv", "part", "chunk", "row", "blank", "repeat", "letter").join(late, (F.col("part") == F.col("late_part")) & (F.col("row") == F.col("late_row")), "left")
    must = F.col("blank") | F.col("repeat") | F.col("late_row").isNotNull()
    letters = known.select("conv", "part", "chunk", "row", F.when(must, F.lit("D")).otherwise(F.col("letter")).alias("letter"))
    sorted_letters = F.array_sort(F.collect_list(F.struct("row", "letter")))
    return letters.groupBy("conv", "part", "chunk").agg(F.array_join(F.transform(sorted_letters, lambda x: x["letter"]), "").alias("letters"))


def same(name: str, other: str) -> Column:
    return F.col(name).eqNullSafe(F.col(other))


def linked(chunks: DataFrame) -> DataFrame:
    """Chunks with rows that may stay, numbered along their conversation: with seq (from 1) and of (how many).

    Numbers within a partition come from a window over that partition's chunks of the conversation, and the numbers
    before it from a window over one row for each of its partitions.
    """
    live = chunks.filter(F.translate("letters", "D", "") != "")
    counts = live.groupBy(F.col("conv").alias("c"), F.col("part").alias("p")).agg(F.count(F.lit(1)).alias("here"))
    along = F.sum("here").over(Window.partitionBy("c").orderBy("p").rowsBetween(Window.unboundedPreceding, 0))
    counts = counts.select("c", "p", (along - F.col("here")).alias("earlier"), F.sum("here").over(Window.partitionBy("c")).alias("of"))
    inner = F.row_number().over(Window.partitionBy("conv", "part").orderBy("chunk"))
    numbered = live.withColumn("inner", inner).join(counts, same("conv", "c") & (F.col("part") == F.col("p")))
    return numbered.select("conv", "part", "chunk", "letters", (F.col("inner") + F.col("earlier")).alias("seq"), "of")


def converged(chunks: DataFrame) -> DataFrame:
    """Chunks (of conversations with several) with ``end``, the right costs after them up to a constant."""
    end = F.array(*[F.lit(c).cast("int") for c in END])
    now = settle(chunks.withColumn("end", end).withColumn("before", vector_before.asNondeterministic()(F.col("letters"), F.col("end"))).withColumn("again", F.lit(True)))
    while True:
        following = now.select(F.col("conv").alias("c"), (F.col("seq") - 1).alias("s"), F.col("before").alias("found"))
        right = now.join(following, same("conv", "c") & (F.col("seq") == F.col("s")), "left").withColumn("right", F.coalesce("found", F.lit(end)))
        #: Vectors stand less their smallest cost, so those that differ by a constant are equal.
        checked = right.select(*chunks.columns, "end", "before", "right", (F.col("right") != F.col("end")).alias("again"))
        again = checked.filter("again").select(*chunks.columns, F.col("right").alias("end"), "again").withColumn("before", vector_before(F.col("letters"), F.col("end")))
        after = settle(checked.filter("NOT again").select(*now.columns).unionByName(again.select(*now.columns)))
        if not after.filter("again").limit(1).count():
            return after.select(*chunks.columns, "end")
        now = after


def entered(chunks: DataFrame) -> DataFrame:
    """Chunks with the state in which each is entered: maps of states, composed along the conversation by doubling."""
    maps = settle(chunks.withColumn("map", states_after.asNondeterministic()(F.col("letters"), F.col("end"))))
    most = maps.agg(F.max("seq")).first()[0] or 1
    step, along = 1, maps.select("conv", "seq", "map")
    while step < most:
        earlier = along.select(F.col("conv").alias("c"), (F.col("seq") + step).alias("s"), F.col("map").alias("first"))
        both = along.join(earlier, same("conv", "c") & (F.col("seq") == F.col("s")), "left")
        composed = F.transform("first", lambda state: F.element_at("map", state + 1))
        along = settle(both.select("conv", "seq", F.when(F.col("first").isNull(), F.col("map")).otherwise(composed).alias("map")))
        step *= 2
    before = along.select(F.col("conv").alias("c"), (F.col("seq") + 1).alias("s"), F.element_at("map", 1).alias("state"))
    return maps.drop("map").join(before, same("conv", "c") & (F.col("seq") == F.col("s")), "left").drop("c", "s").withColumn("state", F.coalesce("state", F.lit(0)))


def edits_of(chunks: DataFrame) -> DataFrame:
    """(conv, part, chunk, letters, edits): the initials of a chunk's edits; inserts at the very end are not in them."""
    live = settle(linked(chunks))
    end = F.array(*[F.lit(c).cast("int") for c in END])
    alone = live.filter("of = 1").withColumn("end", end).withColumn("state", F.lit(0))
    several = entered(converged(live.filter("of > 1")))
    worked = alone.unionByName(several).withColumn("edits", traced(F.col("letters"), F.col("end"), F.col("state")))
    gone = chunks.filter(F.translate("letters", "D", "") == "").withColumn("edits", F.col("letters"))
    return worked.select(*gone.columns).unionByName(gone)


def repaired(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Turns of whole conversations from their rows and, before the rows of each chunk, its letters and edits."""
    current, state, place, letters, edits, at, turn_at = None, 0, 0, "", "", 0, 0
    out: dict[str, list] = {}

    def put(conv, edit, role, text, turn, was, fault) -> None:
        nonlocal place
        for name, value in zip(schema.names, (conv, place, edit, role, text, turn, was, fault)):
            out[name].append(value)
        place += 1

    def insert(conv) -> None:
        nonlocal state
        put(conv, "I", ROLE[state], "", None, None, None)
        state = FOLLOWING[state]

    def finish() -> None:
        while current is not None and state in (1, 2):
            insert(current[0])

    def flush() -> pa.RecordBatch:
        batch = pa.record_batch([pa.array(out[f.name], f.type) for f in schema], schema=schema)
        out.update({n: [] for n in schema.names})
        return batch

    out.update({n: [] for n in schema.names})
    for batch in batches:
        for conv, turn, role, text, blank, new_letters, new_edits in zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "blank", "letters", "edits"))):
            if current != (conv,):
                finish()
                current, state, place = (conv,), 0, 0
            if new_letters is not None:
                letters, edits, at, turn_at = new_letters, new_edits, 0, 0
                continue
            while edits[at] == "I":
                insert(conv)
                at += 1
            edit, letter = edits[at], letters[turn_at]
            at, turn_at = at + 1, turn_at + 1
            fault = ("blank" if blank else "duplicate") if letter == "D" else "truncated" if letter.isupper() else None
            put(conv, edit, ROLE[state] if edit == "R" else role, text, turn, role, fault)
            if edit != "D":
                state = FOLLOWING[state] if edit == "R" else KEPT[state, letter.lower()]
        yield flush()
    finish()
    yield flush()


def repair(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """The turns of the repaired conversations, in order in each partition: conv_id, place (from 0), edit (its initial), role,
    text, turn and was (turn and role of the row, null for an insert) and fault. Deleted rows are among them, with edit D."""
    rows = placed(conversations.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")), chunk)
    kind = rows.schema["conv"].dataType
    heads = edits_of(chunks_of(rows)).withColumn("row", F.lit(-1).cast("long"))
    together = rows.select("conv", "part", "chunk", "row", "turn", "role", "text", "blank").unionByName(heads, allowMissingColumns=True)
    streamed = together.repartition("conv").sortWithinPartitions("conv", "part", "chunk", "row")
    fields = [("conv_id", kind), ("place", T.LongType()), ("edit", T.StringType()), ("role", T.StringType()), ("text", T.StringType()), ("turn", T.LongType()), ("was", T.StringType()), ("fault", T.StringType())]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])
    arrow = to_arrow_schema(schema)
    return streamed.mapInArrow(lambda batches: repaired(batches, arrow), schema)


REPORT = [("gaps", "long"), ("blank", "long"), ("duplicate", "long"), ("truncated", "long"), ("illegal", "long"), ("cost", "long"), ("audit", "string"), ("repaired_sha256", "string")]


class Report:
    """What is counted of one conversation, turn by turn."""

    def __init__(self) -> None:
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.low = self.high = self.last = None
        self.turns = self.illegal = self.cost = 0
        self.previous, self.audit, self.sha, self.lines = None, [], hashlib.sha256(), 0

    def add(self, edit: str, role: str | None, text: str | None, turn: int | None, was: str | None, fault: str | None) -> None:
        self.audit.append(edit)
        self.cost += {"K": 0, "R": REROLE, "I": INSERT, "D": DELETE}[edit]
        if edit != "I":
            initial = (was or "")[:1]
            self.illegal += self.previous is not None and self.previous + initial not in ("su", "ua", "au")
            self.previous = initial
            if fault:
                self.faults[fault] += 1
                self.cost += KEEP_TRUNCATED * (fault == "truncated" and edit != "D")
            if turn is not None and turn != self.last:
                self.turns, self.low, self.high, self.last = self.turns + 1, turn if self.low is None else self.low, turn, turn
        if edit != "D":
            self.sha.update(b"\n" * (self.lines > 0) + f"{role}:{text}".encode())
            self.lines += 1

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest())


def reports(turns: DataFrame) -> DataFrame:
    """One row for each conversation of ``repair``'s turns, made in the tasks that made these."""
    schema = T.StructType([turns.schema["conv_id"], *[T.StructField(n, T.LongType() if t == "long" else T.StringType()) for n, t in REPORT]])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, current, report = to_arrow_schema(schema), None, None
        for batch in batches:
            done = []
            for conv, *turn in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "edit", "role", "text", "turn", "was", "fault"))):
                if current != (conv,):
                    if current is not None:
                        done.append((*current, *report.row()))
                    current, report = (conv,), Report()
                report.add(*turn)
            yield pa.record_batch([pa.array([d[i] for d in done], f.type) for i, f in enumerate(arrow)], schema=arrow)
        if current is not None:
            yield pa.record_batch([pa.array([x], f.type) for x, f in zip((*current, *report.row()), arrow)], schema=arrow)

    return turns.mapInArrow(count, schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with planted faults, by a checksum of conversation and turn."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.pmod(F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")), F.lit(20))
    rows = conversations.select("conv_id", "turn", "role", "text", fault.alias("fault")).filter("fault <> 0")
    text = F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies).drop("copy")


def with_empty(conversations: DataFrame, found: DataFrame) -> DataFrame:
    """A report for every conversation of ``conversations``, zeros where nothing is left of it."""
    ids = conversations.select(F.col("conv_id").alias("c")).distinct()
    none = lambda n, t: F.lit(0).cast("long") if t == "long" else F.lit(hashlib.sha256().hexdigest() if n == "repaired_sha256" else "")
    joined = ids.join(found, same("c", "conv_id"), "left")
    return joined.select(F.col("c").alias("conv_id"), *[F.coalesce(n, none(n, t)).alias(n) for n, t in REPORT])


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return with_empty(conversations, reports(repair(damaged(conversations))))
