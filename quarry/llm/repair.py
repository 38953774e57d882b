"""Repair of damaged conversations: the cheapest edits that give `(s?(ua)+)?`, by a time-major dynamic programme.

Rows are deleted (2), given another role (1) or kept (0; what is kept but cut off
costs 5 more), and empty rows are inserted (5). Blank rows and repeats have to
go. Four states (nothing yet, system, user, assistant) say what may follow.

Conversations are put in buckets by their length. For all conversations of a
bucket at once, costs of each state are updated turn by turn, from the last to
the first, and stored; then the edits are traced from the first to the last,
with ties to the least letter (D, I, K, R). As every letter leads from a state to
one other, and no cheapest list of edits starts another, that gives the least
string.

A conversation that doesn't fit a task (see `turns`) is cut into blocks. A block
is a matrix of costs between states, which the same updates give when they start
from each state alone. The matrices, few and small, are passed in order from the
end to the beginning, which gives the costs after each block; each block is then
traced from all four states, and the states at its start are passed on from the
beginning. So no task holds such a conversation's rows.

Defined cases: null roles and texts are one space, which is blank and no known
role; conversations of null id are one conversation; null turns come first, and
rows of equal turn in the order of role, then text; repeated rows are repeats;
an empty conversation needs no edit; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut, plain, prepare
from quarry.llm.turns import BYTES, ROWS, by_conversation, in_order

START, SYSTEM, USER, ASSISTANT = range(4)
OTHER = 3  # as a role; 0 to 2 are system, user, assistant by their initials
DELETE, ROLE, INSERT, CUT_OFF = 2, 1, 5, 5
FAR = 1 << 40
#: The state after a user or assistant turn is put in, by the state before it.
NEXT = np.array([USER, USER, ASSISTANT, USER])
#: The state after a turn of each role is kept, by the state before it; -1: it may not follow.
KEEP = np.array([[SYSTEM, USER, -1, -1], [-1, USER, -1, -1], [-1, -1, ASSISTANT, -1], [-1, USER, -1, -1]])
#: What it costs to come to an end from each state: insertions of what is missing.
END = np.array([0, 2 * INSERT, INSERT, 0], np.int64)
NAMES = {USER: "user", ASSISTANT: "assistant"}
BLOCK = 4096
SPACE = " \t\n\x0b\x0c\r"


def backward(roles: np.ndarray, bad: np.ndarray, cut_off: np.ndarray, real: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Costs from each turn on, by turn, state and conversation; arrays are turns x conversations, `end` states x conversations."""
    turns, n = roles.shape
    cost = np.empty((turns + 1, 4, n), np.int64)
    cost[turns] = end
    for t in range(turns - 1, -1, -1):
        after = cost[t + 1]
        best = after + DELETE
        stay = np.where(bad[t], FAR, CUT_OFF * cut_off[t])
        padded = np.concatenate([after, np.full((1, n), FAR)])  # row -1: not allowed
        for s in range(4):
            kept = padded[KEEP[s][roles[t]], np.arange(n)]
            best[s] = np.minimum(best[s], stay + np.minimum(kept, ROLE + after[NEXT[s]]))
        for _ in range(3):
            best = np.minimum(best, INSERT + best[NEXT])
        cost[t] = np.where(real[t], best, after)
    return cost


def trace(cost: np.ndarray, roles: np.ndarray, bad: np.ndarray, cut_off: np.ndarray, real: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From the states at the start: each turn's insertions before it, its edit (D, K or R), the state before both, and the states at the end."""
    turns, n = roles.shape
    inserted, edit, before = np.zeros((turns, n), np.int8), np.zeros((turns, n), np.uint8), np.zeros((turns, n), np.int8)
    each, state = np.arange(n), state.copy()
    for t in range(turns):
        before[t] = state
        after, here = cost[t + 1], cost[t]
        stay = np.where(bad[t], FAR, CUT_OFF * cut_off[t])
        for _ in range(3):
            now = here[state, each]
            drop = now == after[state, each] + DELETE
            put = real[t] & ~drop & (now == here[NEXT[state], each] + INSERT)
            inserted[t] += put
            state = np.where(put, NEXT[state], state)
        now = here[state, each]
        drop = now == after[state, each] + DELETE
        to = KEEP[state, roles[t]]
        keep = (to >= 0) & (now == stay + after[np.maximum(to, 0), each])
        edit[t] = np.where(real[t], np.where(drop, ord("D"), np.where(keep, ord("K"), ord("R"))), 0)
        state = np.where(~real[t] | drop, state, np.where(keep, to, NEXT[state]))
    return inserted, edit, before, state


def faults(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which texts are blank, and which don't end with a full stop, exclamation or question mark."""
    bare = pc.utf8_rtrim(text, characters=SPACE)
    blank = pc.equal(pc.binary_length(bare), 0).to_numpy(zero_copy_only=False)
    ends = [pc.ends_with(bare, pattern=p).to_numpy(zero_copy_only=False) for p in ".!?"]
    return blank, ~(blank | ends[0] | ends[1] | ends[2])


def initials(role: pa.Array) -> np.ndarray:
    """0, 1, 2 for roles that start with s, u, a; 3 for others."""
    first = pc.utf8_slice_codeunits(role, 0, 1)
    return pc.fill_null(pc.index_in(first, pa.array(["s", "u", "a"])), OTHER).to_numpy(zero_copy_only=False).astype(np.int64)


def _pairs_wrong(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ~(((a == 0) & (b == 1)) | ((a == 1) & (b == 2)) | ((a == 2) & (b == 1)))


def _put(names: list[str], count: int, state: int) -> int:
    """Appends the roles of so many insertions; the state after them."""
    for _ in range(count):
        state = int(NEXT[state])
        names.append(NAMES[state])
    return state


def _turn(inserted: int, edit: str, state: int, role: str, text: str) -> tuple[list[dict], str]:
    """The turns and the letters that stand for one row."""
    names: list[str] = []
    state = _put(names, inserted, state)
    out = [{"role": r, "text": ""} for r in names]
    if edit == "K":
        out.append({"role": role, "text": text})
    elif edit == "R":
        out.append({"role": NAMES[int(NEXT[state])], "text": text})
    return out, "I" * inserted + edit


def _closing(state: int) -> list[dict]:
    names: list[str] = []
    _put(names, int(END[state]) // INSERT, state)
    return [{"role": r, "text": ""} for r in names]


TURNS = "array<struct<role:string,text:string>>"
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_MIXED = pa.schema(
    [("whole", pa.bool_()), ("conv_id", pa.int64()), ("part", pa.int32()), ("pos", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]
    + [(c, pa.int64()) for c in COUNTS]
    + [("audit", pa.string()), ("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))]
)
MIXED = f"whole boolean, conv_id long, part int, pos long, turn long, role string, text string, {', '.join(f'{c} long' for c in COUNTS)}, audit string, turns {TURNS}"


def _solve(table: pa.Table) -> pa.RecordBatch:
    """One row for each of the table's conversations."""
    ids, turn = table.column("conv_id").combine_chunks(), table.column("turn").combine_chunks()
    role, text = table.column("role").combine_chunks(), table.column("text").combine_chunks()
    n = len(ids)
    value, known = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), pc.is_valid(ids).to_numpy(zero_copy_only=False)
    first = np.concatenate([[True], (value[1:] != value[:-1]) | (known[1:] != known[:-1])])
    start = np.flatnonzero(first)
    conv = np.cumsum(first) - 1
    length = np.diff([*start, n])
    codes, (blank, cut_off) = initials(role), faults(text)
    # Repeats: equal (conversation, role, text), but the first.
    key = np.stack([conv, role.dictionary_encode().indices.to_numpy(zero_copy_only=False), text.dictionary_encode().indices.to_numpy(zero_copy_only=False)])
    order = np.lexsort((np.arange(n), *key))
    same = np.concatenate([[False], (key[:, order[1:]] == key[:, order[:-1]]).all(0)])
    repeat = np.zeros(n, bool)
    repeat[order] = same
    repeat &= ~blank
    cut_off &= ~repeat
    bad = blank | repeat
    wrong = np.concatenate([[False], _pairs_wrong(codes[:-1], codes[1:])]) & ~first

    def per(flag: np.ndarray) -> np.ndarray:
        return np.add.reduceat(flag.astype(np.int64), start)

    number, there = pc.fill_null(turn, 0).to_numpy(zero_copy_only=False), pc.is_valid(turn).to_numpy(zero_copy_only=False)
    other = np.concatenate([[True], (number[1:] != number[:-1]) | ~there[:-1]]) | first
    most = np.maximum.reduceat(np.where(there, number, np.iinfo(np.int64).min), start)
    least = np.minimum.reduceat(np.where(there, number, np.iinfo(np.int64).max), start)
    gaps = np.where(per(there) > 0, most - least + 1 - per(there & other), 0)
    cost, inserted, edit, before, state = np.zeros(len(start), np.int64), np.zeros(n, np.int8), np.zeros(n, np.uint8), np.zeros(n, np.int8), np.zeros(len(start), np.int64)
    bucket = np.ceil(np.log2(length)).astype(int)
    for b in np.unique(bucket).tolist():
        mine = np.flatnonzero(bucket == b)
        at = start[mine] + np.arange(length[mine].max())[:, None]  # turns x conversations
        real = np.arange(len(at))[:, None] < length[mine]
        at = np.where(real, at, start[mine])
        given = codes[at], bad[at], cut_off[at], real
        found = backward(*given, np.repeat(END[:, None], len(mine), 1))
        cost[mine] = found[0, START]
        put, how, was, state[mine] = trace(found, *given, np.full(len(mine), START))
        inserted[at[real]], edit[at[real]], before[at[real]] = put[real], how[real], was[real]
    roles, texts = role.to_pylist(), text.to_pylist()
    audits, lists = [], []
    for c, (s, k) in enumerate(zip(start.tolist(), length.tolist(), strict=True)):
        turns, letters = [], []
        for i in range(s, s + k):
            a, b = _turn(int(inserted[i]), chr(edit[i]), int(before[i]), roles[i], texts[i])
            turns += a
            letters.append(b)
        closing = _closing(int(state[c]))
        audits.append("".join(letters) + "I" * len(closing))
        lists.append(turns + closing)
    m = len(start)
    none = [None] * m
    return pa.RecordBatch.from_pydict(
        {"whole": [True] * m, "conv_id": ids.take(pa.array(start)), "part": none, "pos": none, "turn": none, "role": none, "text": none,
         "gaps": gaps, "blank": per(blank), "duplicate": per(repeat), "truncated": per(cut_off), "illegal": per(wrong), "cost": cost, "audit": audits, "turns": lists},
        schema=_MIXED,
    )


def _mixed(turns: DataFrame) -> DataFrame:
    """Conversations that fit a task, repaired, one a row; and the rows of those that don't, numbered in order."""
    whole_rows = plain(turns, "conv_id", "turn", "role", "text").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for whole, at, table in by_conversation(batches, ROWS, BYTES):
            if whole:
                yield _solve(table)
                continue
            n = table.num_rows
            columns = {c: table.column(c).combine_chunks() for c in ("conv_id", "turn", "role", "text")}
            fill = {f.name: pa.nulls(n, f.type) for f in _MIXED if f.name not in columns}
            fill |= {"whole": pa.array([False] * n), "part": pa.array([part] * n, pa.int32()), "pos": pa.array(np.arange(at, at + n))} | columns
            yield pa.RecordBatch.from_arrays([fill[f.name].cast(f.type) for f in _MIXED], schema=_MIXED)

    return in_order(whole_rows).mapInArrow(work, MIXED)


KEYS = ("conv_id", "part", "block")


def _blocks(rows: DataFrame) -> DataFrame:
    """Blocks of long conversations: their rows' codes (role, bad, cut off, as bits) in order, and counts of faults."""
    bare = F.rtrim(F.translate("text", SPACE, " " * len(SPACE)))
    coded = rows.select(
        "conv_id", "part", "pos", F.sha2(F.concat(F.length("role"), F.lit(":"), "role", "text"), 256).alias("digest"),
        F.coalesce(F.array_position(F.array(*map(F.lit, "sua")), F.left("role", F.lit(1))), F.lit(0)).cast("int").alias("initial"),
        (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("open"),
    )
    first = coded.groupBy("conv_id", "digest").agg(F.min(F.struct("part", "pos")).alias("f")).select(F.col("conv_id").alias("c"), F.col("f.part").alias("p"), F.col("f.pos").alias("at"))
    coded = coded.join(first, coded.conv_id.eqNullSafe(first.c) & (coded.part == first.p) & (coded.pos == first["at"]), "left")
    repeat = F.col("at").isNull() & ~F.col("blank")
    cut_off = F.col("open") & ~F.col("blank") & ~repeat
    role = F.when(F.col("initial") == 0, OTHER).otherwise(F.col("initial") - 1)
    code = role + F.when(F.col("blank") | repeat, 4).otherwise(0) + F.when(cut_off, 8).otherwise(0)
    coded = coded.select("conv_id", "part", (F.col("pos") / BLOCK).cast("long").alias("block"), "pos", code.alias("code"), "blank", repeat.alias("repeat"), cut_off.alias("cut"))
    return coded.groupBy(*KEYS).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "code"))), lambda x: x["code"]).alias("codes"), F.min("pos").alias("pos"),
        F.count_if("blank").alias("blank"), F.count_if("repeat").alias("duplicate"), F.count_if("cut").alias("truncated"),
    )


def _arrays(codes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block as four columns, one for each state that it can start or end in."""
    c = np.repeat(np.array(codes, np.int64)[:, None], 4, 1)
    return c & 3, (c & 4) > 0, ((c & 8) > 0).astype(np.int64), np.ones(c.shape, bool)


def _append(batch: pa.RecordBatch, **more: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *more.values()], [*batch.schema.names, *more])


def _long(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For rows of long conversations: what stands for each row (conv_id, part, pos, letters, turns), and counts, audit and closing turns by conversation."""
    listed = pa.list_(pa.int64())

    def matrices(batches):
        for b in batches:
            out = []
            for codes in b.column("codes").to_pylist():
                ends = np.where(np.eye(4, dtype=bool), 0, FAR)  # column j: only state j may follow
                out.append(backward(*_arrays(codes), ends)[0].ravel().tolist())
            yield _append(b, matrix=pa.array(out, listed))

    blocks = _blocks(rows)
    blocks = cut(blocks.mapInArrow(matrices, f"{_ddl(blocks)}, matrix array<long>"))

    def ordered(df: DataFrame, back: bool) -> DataFrame:
        by = [F.col(c).desc() if back else F.col(c) for c in ("part", "block")]
        return df.repartition("conv_id").sortWithinPartitions("conv_id", *by)

    def costs(batches):  # from a conversation's last block to its first
        last, after = (), END
        for b in batches:
            out = []
            for conv, m in zip(b.column("conv_id").to_pylist(), b.column("matrix").to_pylist(), strict=True):
                if (conv,) != last:
                    last, after = (conv,), END
                out.append(after.tolist())
                after = (np.array(m).reshape(4, 4) + after).min(1)
            yield _append(b.select(list(KEYS)), after=pa.array(out, listed))

    after = ordered(blocks.select(*KEYS, "matrix"), True).mapInArrow(costs, "conv_id long, part int, block long, after array<long>")
    after = after.select(*[F.col(k).alias(f"a_{k}") for k in KEYS], "after")
    both = blocks.drop("matrix").join(after, blocks.conv_id.eqNullSafe(F.col("a_conv_id")) & (F.col("part") == F.col("a_part")) & (F.col("block") == F.col("a_block")))
    both = both.drop("a_conv_id", "a_part", "a_block")

    def traces(batches):
        for b in batches:
            cost, put, how, was, to = [], [], [], [], []
            for codes, end in zip(b.column("codes").to_pylist(), b.column("after").to_pylist(), strict=True):
                given = _arrays(codes)
                found = backward(*given, np.repeat(np.array(end)[:, None], 4, 1))
                a, e, s, t = trace(found, *given, np.arange(4))
                cost.append(found[0, :, 0].tolist())
                put.append([x.astype(np.uint8).tobytes() for x in a.T])
                how.append([x.tobytes() for x in e.T])
                was.append([x.astype(np.uint8).tobytes() for x in s.T])
                to.append(t.tolist())
            binary = pa.list_(pa.binary())
            yield _append(b, cost=pa.array(cost, listed), put=pa.array(put, binary), how=pa.array(how, binary), was=pa.array(was, binary), to=pa.array(to, listed))

    traced = cut(both.mapInArrow(traces, f"{_ddl(both)}, cost array<long>, put array<binary>, how array<binary>, was array<binary>, to array<long>"))

    def states(batches):  # from a conversation's first block to its last
        last, state, role = (), START, None
        for b in batches:
            out = []
            for conv, to, first, end, inner in zip(*[b.column(c).to_pylist() for c in ("conv_id", "to", "first", "end", "inner")], strict=True):
                fresh = (conv,) != last
                if fresh:
                    last, state, role = (conv,), START, None
                wrong = inner + int(role is not None and bool(_pairs_wrong(np.array(role), np.array(first))))
                out.append((state, to[state], wrong, fresh))
                state, role = to[state], end
            s, e, w, f = zip(*out, strict=True) if out else ((), (), (), ())
            yield _append(b.select(list(KEYS)), state=pa.array(s, pa.int64()), leaves=pa.array(e, pa.int64()), wrong=pa.array(w, pa.int64()), fresh=pa.array(f, pa.bool_()))

    bare = F.transform("codes", lambda c: c.bitwiseAND(3))
    pairs = F.zip_with(F.slice(bare, F.lit(1), F.size(bare) - 1), F.slice(bare, F.lit(2), F.size(bare) - 1), lambda a, b: ~(a * 4 + b).isin(1, 6, 9))
    edges = traced.select(*KEYS, "to", F.element_at(bare, 1).alias("first"), F.element_at(bare, -1).alias("end"), F.size(F.filter(pairs, lambda x: x)).alias("inner"))
    passed = cut(ordered(edges, False).mapInArrow(states, "conv_id long, part int, block long, state long, leaves long, wrong long, fresh boolean"))
    passed = passed.select(*[F.col(k).alias(f"a_{k}") for k in KEYS], "state", "leaves", "wrong", "fresh")
    known = traced.join(passed, traced.conv_id.eqNullSafe(F.col("a_conv_id")) & (F.col("part") == F.col("a_part")) & (F.col("block") == F.col("a_block")))

    def letters(batches):
        for b in batches:
            found = []
            for pos, put, how, was, s in zip(*[b.column(c).to_pylist() for c in ("pos", "put", "how", "was", "state")], strict=True):
                edits = []
                for i, (k, e, w) in enumerate(zip(put[s], how[s].decode(), was[s], strict=True)):
                    names: list[str] = []
                    w = _put(names, k, w)
                    edits.append({"pos": pos + i, "letters": "I" * k + e, "before": names, "role": NAMES[int(NEXT[w])] if e == "R" else None})
                found.append(edits)
            yield _append(b.drop_columns(["put", "how", "was", "codes"]), edits=pa.array(found, EDITS))

    kept = known.select(*KEYS, "pos", "codes", "put", "how", "was", "state", "leaves", "wrong", "fresh", "blank", "duplicate", "truncated", F.element_at("cost", START + 1).alias("cost"))
    rest = kept.drop("put", "how", "was", "codes")
    edited = cut(kept.mapInArrow(letters, f"{_ddl(rest)}, edits {EDIT_TYPE}"))
    by_row = edited.select(F.col("conv_id").alias("e_conv_id"), F.col("part").alias("e_part"), F.explode("edits").alias("e")).select("e_conv_id", "e_part", "e.*")
    counts = edited.groupBy("conv_id").agg(
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")], F.sum("wrong").alias("illegal"), F.max(F.when(F.col("fresh"), F.col("cost"))).alias("cost"),
        F.max_by("leaves", F.struct("part", "block")).alias("leaves"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "block", F.array_join("edits.letters", "").alias("a")))), lambda x: x["a"]), "").alias("audit"),
    )
    closing = {s: F.array(*[F.struct(F.lit(t["role"]).alias("role"), F.lit("").alias("text")) for t in _closing(s)]) for s in (SYSTEM, USER)}
    counts = counts.withColumn("closing", F.when(F.col("leaves") == SYSTEM, closing[SYSTEM]).when(F.col("leaves") == USER, closing[USER]).otherwise(F.array().cast(TURNS)))
    counts = counts.withColumn("audit", F.concat("audit", F.repeat(F.lit("I"), F.size("closing"))))
    there = rows.groupBy("conv_id", "turn").agg(F.lit(1)).groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps")).select(F.col("conv_id").alias("g"), F.coalesce("gaps", F.lit(0)).alias("gaps"))
    counts = counts.join(there, counts.conv_id.eqNullSafe(there.g)).select("conv_id", *COUNTS, "audit", "closing")
    own = F.when(F.endswith("letters", F.lit("D")), F.array().cast(TURNS)).otherwise(F.array(F.struct(F.coalesce("e.role", "r.role").alias("role"), F.col("text"))))
    before = F.transform("before", lambda r: F.struct(r.alias("role"), F.lit("").alias("text")))
    on = F.col("r.conv_id").eqNullSafe(F.col("e_conv_id")) & (F.col("r.part") == F.col("e_part")) & (F.col("r.pos") == F.col("e.pos"))
    turns = rows.alias("r").join(by_row.alias("e"), on).select("r.conv_id", "r.part", "r.pos", "letters", F.concat(before, own).alias("turns"))
    return turns, cut(counts)


EDITS = pa.list_(pa.struct([("pos", pa.int64()), ("letters", pa.string()), ("before", pa.list_(pa.string())), ("role", pa.string())]))
EDIT_TYPE = "array<struct<pos:bigint,letters:string,before:array<string>,role:string>>"


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _lines(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")


def repair(turns: DataFrame) -> DataFrame:
    """The repaired conversations, in pieces: conv_id, part, pos (the order of its pieces), letters (its edits), turns.

    A conversation that fits a task is one piece, all others have one for each row.
    """
    mixed = cut(_mixed(turns))
    rows, counts = _long(mixed.where("NOT whole").select("conv_id", "part", "pos", "turn", "role", "text"))
    one = mixed.where("whole").select("conv_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("pos"), F.col("audit").alias("letters"), "turns")
    last = counts.select("conv_id", F.lit((1 << 31) - 1).alias("part"), F.lit(0).cast("long").alias("pos"), F.repeat(F.lit("I"), F.size("closing")).alias("letters"), F.col("closing").alias("turns"))
    return one.unionByName(rows).unionByName(last.where(F.size("turns") > 0))


def digest(turns: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and the SHA-256 of the repaired turns; `every` names conversations that may have no rows left."""
    mixed = _mixed(turns).withColumn("repaired_sha256", F.when(F.col("whole"), F.sha2(_lines(F.col("turns")), 256))).drop("turns")
    mixed = cut(mixed)
    rows, counts = _long(mixed.where("NOT whole").select("conv_id", "part", "pos", "turn", "role", "text"))
    last = counts.select("conv_id", F.lit((1 << 31) - 1).alias("part"), F.lit(0).cast("long").alias("pos"), F.col("closing").alias("turns"))
    lines = rows.select("conv_id", "part", "pos", "turns").unionByName(last).where(F.size("turns") > 0).select("conv_id", "part", "pos", _lines(F.col("turns")).alias("line"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = (), None
        for b in batches:
            out = []
            for conv, line in zip(b.column("conv_id").to_pylist(), b.column("line").to_pylist(), strict=True):
                if (conv,) == last:
                    state.update(b"\n")
                else:
                    if last:
                        out.append((last[0], state.hexdigest()))
                    last, state = (conv,), hashlib.sha256()
                state.update(line.encode())
            yield pa.RecordBatch.from_pydict({"c": [c for c, _ in out], "repaired_sha256": [h for _, h in out]}, schema=SEALED)
        if last:
            yield pa.RecordBatch.from_pydict({"c": [last[0]], "repaired_sha256": [state.hexdigest()]}, schema=SEALED)

    sealed = lines.repartition("conv_id").sortWithinPartitions("conv_id", "part", "pos").mapInArrow(hashed, "c long, repaired_sha256 string")
    long = counts.join(sealed, counts.conv_id.eqNullSafe(sealed.c), "left").select("conv_id", *COUNTS, "audit", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
    found = mixed.where("whole").select("conv_id", *COUNTS, "audit", "repaired_sha256").unionByName(long)
    if every is None:
        return found
    ids = plain(every, "conv_id").select(F.col("conv_id").cast("long").alias("id")).distinct()
    filled = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS]
    return ids.join(found, ids.id.eqNullSafe(found.conv_id), "left").select(F.col("id").alias("conv_id"), *filled, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


SEALED = pa.schema([("c", pa.int64()), ("repaired_sha256", pa.string())])


def damaged(turns: DataFrame) -> DataFrame:
    """Rows damaged by a hash of conversation and turn: of twenty, one goes, one loses its text, one its sentence ends, one comes twice, one says to be a user's."""
    space = F.lit(" ")
    rows = plain(turns, "conv_id", "turn", "role", "text").select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20
    rows = rows.withColumn("kind", kind).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(0))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def check(turns: DataFrame) -> DataFrame:
    """Every conversation of the table, damaged and repaired."""
    prepare(turns.sparkSession)
    return digest(damaged(turns), turns)
