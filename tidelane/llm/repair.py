"""Conversation structure repair: the lightest derivation of a legal conversation, by an agenda of (cost, audit) items."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Hashable, Iterable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Rows of a conversation that are derived together.
BLOCK_BITS = 8
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
BLANK = r"^[\x20\x09-\x0D]*$"
#: States of a legal conversation: nothing yet, after the system turn, after a user turn, after an assistant turn.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
LEGAL = {"su", "ua", "au"}
Key = tuple[int, int, str]


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n): the rows of ``rows`` (conv_id, turn, role, text) after damage, equal ones once with their number.

    crc32 of ``conv_id:turn`` modulo 20 says what happens: 0 drops a row, 1 empties its text, 2 removes its
    sentence ends, 3 repeats it, 4 makes it the user's. Nulls count as one space; turn stays null.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    d = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("f")).where("f <> 0")
    text = F.when(F.col("f") == 1, "").when(F.col("f") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    d = d.select("conv_id", "turn", F.when(F.col("f") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("f") == 3, 2).otherwise(1).alias("n"))
    return d.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))


def counted(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) as they are, equal ones once with their number n; nulls count as one space, turn stays null."""
    return rows.groupBy("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")).agg(F.count("*").alias("n"))


def in_order(rows: DataFrame) -> DataFrame:
    """``rows`` plus seq, a number that rises by conversation, turn (null first), role and text; stored.

    Rows are dealt by ranges of that order, so a conversation of any length is spread over tasks.
    """
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role")]
    dealt = rows.repartitionByRange(*order, F.left("text", F.lit(64))).sortWithinPartitions(*order, "text")
    return stored(dealt.withColumn("seq", F.monotonically_increasing_id()))


def with_faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, seq, n, kind, fault) of ``rows`` (in_order): kind is s, u, a or x by the role's initial, fault the first of b(lank), d(uplicate), t(runcated) or -.

    A row is a duplicate if its role and text are seen earlier in the conversation; its n copies have the same
    fault but, of a row that is no duplicate, all copies but the first are duplicates, too.
    """
    same = F.sha2(F.to_json(F.struct("conv_id", "role", "text"), {"ignoreNullFields": "false"}), 256)
    light = rows.select("conv_id", "turn", "seq", "n", "role", F.col("text").rlike(BLANK).alias("blank"), F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z").alias("ends"), same.alias("same"))
    light = stored(light)
    repeated = stored(light.groupBy(F.col("same").alias("s_")).agg(F.min("seq").alias("first"), F.count("*").alias("k")).where("k > 1").drop("k"))
    fault = F.when(F.col("blank"), "b").when(F.col("seq") > F.col("first"), "d").when(~F.col("ends"), "t").otherwise("-")
    initial = F.left("role", F.lit(1))
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    return light.join(repeated, F.col("same") == F.col("s_"), "left").select("conv_id", "turn", "seq", "n", kind.alias("kind"), fault.alias("fault"))


def lightest(axioms: Iterable[tuple[Key, Hashable]], deductions: Callable[[Hashable, Key], Iterable[tuple[Key, Hashable]]], goals: set) -> dict[Hashable, Key]:
    """The key of the lightest derivation of each item that is final once all ``goals`` are, or nothing is left on the agenda.

    Keys are (cost, span, audit). An edit adds cost or span and appends to the audit, so no conclusion is lighter
    than its premises, and of two derivations of an item, which have one span, the lighter stays lighter whatever
    is appended: audits of equal cost and span are no prefixes of each other, as only an insertion, which
    costs, covers no row. So what is popped first is final.
    """
    agenda, final, open_goals = list(axioms), {}, set(goals)
    heapq.heapify(agenda)
    while agenda and open_goals:
        key, item = heapq.heappop(agenda)
        if item in final:
            continue
        final[item] = key
        open_goals.discard(item)
        for more in deductions(item, key):
            if more[1] not in final:
                heapq.heappush(agenda, more)
    return final


def insertion(state: int) -> int:
    """The state after an inserted turn, which is the user's unless the user has just spoken."""
    return ASSISTANT if state == USER else USER


def edits(state: int, kind: str, fault: str, n: int) -> Iterator[tuple[int, int, str]]:
    """(state after, cost, audit) of each edit of a row with ``n`` copies. All copies but one are deleted, right after it: D sorts before I, so no insertion stands between."""
    yield state, DELETE * n, "D" * n
    if fault in "bd":
        return
    cost, rest = (TRUNCATED if fault == "t" else 0) + DELETE * (n - 1), "D" * (n - 1)
    if kind == "s" and state == EMPTY:
        yield SYSTEM, cost, "K" + rest
    after = insertion(state)
    if kind == ("a" if state == USER else "u"):
        yield after, cost, "K" + rest
    yield after, cost + REROLE, "R" + rest


@lru_cache(maxsize=1 << 14)
def block_items(kinds: str, faults: str, copies: tuple[int, ...]) -> tuple[tuple[int, int, int, str], ...]:
    """(state before, state after, cost, audit): the lightest way through a block's rows between each two states. Short conversations repeat, so a task keeps what it has found."""
    m = len(kinds)

    def deductions(item: tuple[int, int, int], key: Key) -> Iterator[tuple[Key, Hashable]]:
        (before, i, state), (cost, _, audit) = item, key
        yield (cost + INSERT, i, audit + "I"), (before, i, insertion(state))
        if i < m:
            for after, more, letters in edits(state, kinds[i], faults[i], copies[i]):
                yield (cost + more, i + 1, audit + letters), (before, i + 1, after)

    out = []
    for before in range(4):
        ends = range(min(before, USER), ASSISTANT + 1)
        final = lightest([((0, 0, ""), (before, 0, before))], deductions, {(before, m, q) for q in ends})
        out += [(before, q, final[before, m, q][0], final[before, m, q][2]) for q in ends if (before, m, q) in final]
    return tuple(out)


def chain(blocks: Sequence[Sequence[tuple[int, int, int, str]]]) -> tuple[int, str, list[tuple[int, str]]]:
    """(cost, audit, [(state before, audit of the block)]) of the lightest legal conversation over consecutive blocks of items."""
    by = []
    for items in blocks:
        own: dict[int, list] = {}
        for before, after, cost, audit in items:
            own.setdefault(before, []).append((after, cost, audit))
        by.append(own)
    m = len(blocks)
    goal = (m + 1, None)
    # of which state, by which letters, an item with a key was concluded
    came: dict[tuple[Hashable, Key], tuple[int, str]] = {}

    def deductions(item: Hashable, key: Key) -> Iterator[tuple[Key, Hashable]]:
        (k, state), (cost, _, audit) = item, key
        if k >= m:
            if state in (EMPTY, ASSISTANT):
                yield (cost, m + 1, audit), goal
            return
        for after, more, letters in by[k].get(state, ()):
            conclusion = (cost + more, k + 1, audit + letters)
            came.setdefault(((k + 1, after), conclusion), (state, letters))
            yield conclusion, (k + 1, after)

    final = lightest([((0, 0, ""), (0, EMPTY))], deductions, {goal})
    cost, _, audit = final[goal]
    state = min((s for s in (EMPTY, ASSISTANT) if (m, s) in final), key=lambda s: (final[m, s][0], final[m, s][2]))
    pieces = []
    for k in range(m, 0, -1):
        state, letters = came[(k, state), final[k, state]]
        pieces.append((state, letters))
    return cost, audit, pieces[::-1]


def _illegal(kinds: str, copies: list[int]) -> int:
    return sum(n - 1 for n in copies) + sum(a + b not in LEGAL for a, b in zip(kinds, kinds[1:]))


_ITEM = pa.struct([("before", pa.int32()), ("after", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
_PIECE = pa.struct([("blk", pa.int64()), ("state", pa.int32()), ("letters", pa.string())])


def _blocks(faulty: DataFrame) -> DataFrame:
    """(conv_id, blk, seqs, kinds, faults, copies), a row a block of a conversation's rows, 2 ** BLOCK_BITS at most."""
    rows = F.sort_array(F.collect_list(F.struct("seq", "kind", "fault", "n")))
    d = faulty.groupBy("conv_id", F.shiftright("seq", BLOCK_BITS).alias("blk")).agg(rows.alias("r"))
    return d.select("conv_id", "blk", F.col("r.seq").alias("seqs"), F.array_join("r.kind", "").alias("kinds"), F.array_join("r.fault", "").alias("faults"), F.col("r.n").alias("copies"))


def _derive_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        kinds, faults, copies = (b.column(c).to_pylist() for c in ("kinds", "faults", "copies"))
        items = [[dict(zip(("before", "after", "cost", "audit"), x)) for x in block_items(k, f, tuple(n))] for k, f, n in zip(kinds, faults, copies)]
        illegal = [_illegal(k, n) for k, n in zip(kinds, copies)]
        yield pa.record_batch([b.column("conv_id"), b.column("blk"), pa.array([k[0] for k in kinds], pa.string()), pa.array([k[-1] for k in kinds], pa.string()), pa.array(illegal, pa.int64()), pa.array(items, pa.list_(_ITEM))], ["conv_id", "blk", "first", "last", "illegal", "items"])


def _derive_conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        costs, audits, illegals, pieces = [], [], [], []
        for blocks in b.column("blocks").to_pylist():
            cost, audit, path = chain([[tuple(x.values()) for x in k["items"]] for k in blocks])
            between = sum(x["last"] + y["first"] not in LEGAL for x, y in zip(blocks, blocks[1:]))
            costs.append(cost)
            audits.append(audit)
            illegals.append(between + sum(k["illegal"] for k in blocks))
            pieces.append([{"blk": k["blk"], "state": s, "letters": t} for k, (s, t) in zip(blocks, path)])
        yield pa.record_batch([b.column("conv_id"), pa.array(costs, pa.int64()), pa.array(audits, pa.string()), pa.array(illegals, pa.int64()), pa.array(pieces, pa.list_(_PIECE))], ["conv_id", "cost", "audit", "illegal", "pieces"])


def row_edits(state: int, letters: str, kinds: str, copies: list[int]) -> list[tuple[list[str], str, list[str]]]:
    """(roles inserted before, edit, roles inserted after) of each row of a block; the edit is K, D or the new role."""
    names = {USER: "user", ASSISTANT: "assistant"}
    out: list[tuple[list[str], str, list[str]]] = []
    at = 0

    def inserted() -> list[str]:
        nonlocal at, state
        roles = []
        while letters[at : at + 1] == "I":
            state, at = insertion(state), at + 1
            roles.append(names[state])
        return roles

    for kind, n in zip(kinds, copies):
        before, op = inserted(), letters[at]
        if op != "D":
            state = SYSTEM if op == "K" and kind == "s" else insertion(state)
        out.append((before, names[state] if op == "R" else op, []))
        at += n
    out[-1][2].extend(inserted())
    return out


def _edit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        seqs, edit, before, after = [], [], [], []
        for ids, kinds, copies, piece in zip(*(b.column(c).to_pylist() for c in ("seqs", "kinds", "copies", "piece"))):
            for seq, (first, op, last) in zip(ids, row_edits(piece["state"], piece["letters"], kinds, copies)):
                if op != "D" or first or last:
                    seqs.append(seq)
                    edit.append(op)
                    before.append(first)
                    after.append(last)
        texts = pa.list_(pa.string())
        yield pa.record_batch([pa.array(seqs, pa.int64()), pa.array(edit, pa.string()), pa.array(before, texts), pa.array(after, texts)], ["e_", "edit", "before", "after"])


def _hash_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a conversation from its lines in order: only the hash so far is held."""
    now, running = None, None
    for b in batches:
        ids, hashes, out = b.column("conv_id"), [], []
        for i, (c, line) in enumerate(zip(ids.to_pylist(), b.column("line").to_pylist())):
            if running is None or c != now:
                if running is not None:
                    out.append(now)
                    hashes.append(running.hexdigest())
                now, running = c, hashlib.sha256(line.encode("utf-8", "surrogatepass"))
            else:
                running.update(b"\n" + line.encode("utf-8", "surrogatepass"))
        kind = ids.type
        yield pa.record_batch([pa.array(out, kind), pa.array(hashes, pa.string())], ["conv_id", "repaired_sha256"])
    if running is not None:
        yield pa.record_batch([pa.array([now], kind), pa.array([running.hexdigest()], pa.string())], ["conv_id", "repaired_sha256"])


def derive(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(conversations, edited, faults) of ``rows`` (conv_id, turn, role, text, n), equal rows once with their number.

    conversations is (conv_id, cost, audit, illegal) of the cheapest edits; edited (conv_id, seq, turns) holds the
    repaired turns (role, text) by seq, inserted ones beside those of a row; faults is that of ``with_faults``. Blocks of 256 rows are derived by themselves, from each state to each; a conversation's
    blocks are then chained, which holds no more than the items' audits, a few letters a row.
    """
    kept = in_order(rows)
    kind = kept.schema["conv_id"].dataType.simpleString()
    faults = stored(with_faults(kept))
    blocks = stored(_blocks(faults))
    items = "array<struct<before:int,after:int,cost:long,audit:string>>"
    derived = blocks.select("conv_id", "blk", "kinds", "faults", "copies").mapInArrow(_derive_blocks, f"conv_id {kind}, blk long, first string, last string, illegal long, items {items}")
    chained = derived.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("blk", "first", "last", "illegal", "items"))).alias("blocks"))
    chained = stored(chained.mapInArrow(_derive_conversations, f"conv_id {kind}, cost long, audit string, illegal long, pieces array<struct<blk:long,state:int,letters:string>>"))
    # a block may hold rows of several conversations, each by its own part of the path
    pieces = chained.select(F.col("conv_id").alias("c_"), F.explode("pieces").alias("piece"))
    on = (F.col("blk") == F.col("piece.blk")) & F.col("conv_id").eqNullSafe(F.col("c_"))
    edited = blocks.select("conv_id", "blk", "seqs", "kinds", "copies").join(pieces, on).select("seqs", "kinds", "copies", "piece").mapInArrow(_edit_rows, "e_ long, edit string, before array<string>, after array<string>")
    own = F.struct(F.when(F.col("edit") == "K", F.col("role")).otherwise(F.col("edit")).alias("role"), "text")
    turn = lambda role: F.struct(role.alias("role"), F.lit("").alias("text"))
    turns = F.concat(F.transform("before", turn), F.when(F.col("edit") != "D", F.array(own)).otherwise(F.array().cast("array<struct<role:string,text:string>>")), F.transform("after", turn))
    return chained.drop("pieces"), kept.join(edited, F.col("seq") == F.col("e_")).select("conv_id", "seq", turns.alias("turns")), faults


def _counts(faults: DataFrame) -> DataFrame:
    """(c_, gaps, blank, duplicate, truncated) of each conversation."""
    turns = F.count_distinct("turn")
    gaps = F.try_subtract(F.try_add(F.try_subtract(F.max("turn").cast("bigint"), F.min("turn").cast("bigint")), F.lit(1).cast("bigint")), turns)
    extra = F.when(F.col("fault") == "d", F.col("n")).when(F.col("fault") != "b", F.col("n") - 1).otherwise(0)
    return faults.groupBy(F.col("conv_id").alias("c_")).agg(
        F.when(F.count("turn") == 0, 0).otherwise(gaps).cast("bigint").alias("gaps"),
        F.sum(F.when(F.col("fault") == "b", F.col("n")).otherwise(0)).alias("blank"),
        F.sum(extra).alias("duplicate"),
        F.count_if(F.col("fault") == "t").alias("truncated"),
    )


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, role, text, place): the turns of ``rows`` (conv_id, turn, role, text) after the cheapest edits, by place in each conversation."""
    _, edited, _ = derive(counted(rows))
    each = edited.select("conv_id", "seq", F.posexplode("turns").alias("i", "turn_"))
    return each.select("conv_id", "turn_.role", "turn_.text", F.struct("seq", "i").alias("place"))


def audits(conversations: DataFrame, damage: Callable[[DataFrame], DataFrame] = damaged) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), a row for each conv_id of ``conversations`` (conv_id, turn, role, text).

    Rows are damaged first (``counted`` damages nothing). Equal turns go by role, then text. Edits keep a row (K, 0),
    change its role (R, 1), delete it (D, 2) or insert an empty turn (I, 5); undeleted truncated rows cost 5 more;
    blank rows and duplicates must go. The cheapest edits give one system turn or none, then pairs of
    user and assistant, or nothing at all; of equal costs the least audit counts. A null conv_id is a conversation,
    a turn range beyond 64 bits has null gaps, and the empty table gives no rows. The last pass streams each
    conversation's repaired lines through one task in order, as a hash over all of them must.
    """
    chained, edited, faults = derive(damage(conversations))
    lines = edited.select("conv_id", "seq", F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n").alias("line"))
    kind = conversations.schema["conv_id"].dataType.simpleString()
    hashes = lines.repartition("conv_id").sortWithinPartitions("conv_id", "seq").select("conv_id", "line").mapInArrow(_hash_lines, f"conv_id {kind}, repaired_sha256 string")
    out = conversations.select("conv_id").distinct()
    for part in (_counts(faults), chained.withColumnRenamed("conv_id", "c_"), hashes.withColumnRenamed("conv_id", "c_")):
        out = out.join(part, out.conv_id.eqNullSafe(part.c_), "left").drop("c_")
    zeros = [F.when(F.col("cost").isNull(), 0).otherwise(F.col(c)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def sql() -> str:
    """The rows of ``audits`` in DuckDB's SQL: a walk over each conversation's rows with the cheapest way to each state."""

    def ins(x: str, role: str) -> str:
        return f"{{'c': {x}.c + {INSERT}, 'a': {x}.a || 'I', 't': list_append({x}.t, '{role}:')}}"

    def keep(x: str) -> str:
        return f"{{'c': {x}.c + late, 'a': {x}.a || 'K', 't': list_append({x}.t, role || ':' || text)}}"

    def rerole(x: str, role: str) -> str:
        return f"{{'c': {x}.c + {REROLE} + late, 'a': {x}.a || 'R', 't': list_append({x}.t, '{role}:' || text)}}"

    def delete(x: str) -> str:
        return f"{{'c': {x}.c + {DELETE}, 'a': {x}.a || 'D', 't': {x}.t}}"

    def closed(rows: str) -> str:
        """The states with what insertions reach."""
        users = f"select * replace (least(u, {ins('e', 'user')}, {ins('s', 'user')}, {ins('a', 'user')}) as u) from ({rows})"
        return f"select * replace (least(a, {ins('u', 'assistant')}) as a) from ({users})"

    crc = "select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t"
    hashed = "xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(k) + 1), lambda i: ord(k[i])::bigint)), lambda c, b: xor(t[xor(c & 255, b) + 1], c >> 8)), 4294967295)"
    start, none = "{'c': 0::bigint, 'a': '', 't': []::varchar[]}", "{'c': 1000000000::bigint, 'a': '', 't': []::varchar[]}"
    step = closed("select w.*, r.role, r.text, r.c, r.f, r.f not in ('b', 'd') as ok, case when r.f = 't' then 5 else 0 end as late from walk w join judged r on r.conv_id is not distinct from w.conv_id and r.i = w.i + 1")
    return f"""with recursive crc as ({crc}),
keyed as (select *, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations),
hit as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {hashed} % 20 as f from keyed, crc),
rows_ as (select conv_id, turn, case when f = 4 then 'user' else role end as role, case when f = 1 then '' when f = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
 from (select *, unnest(case when f = 3 then range(2) else range(1) end) as copy from hit where f <> 0)),
placed as (select *, left(role, 1) as c, row_number() over w as i from rows_ window w as (partition by conv_id order by turn nulls first, role, text)),
seen_ as (select *, row_number() over (partition by conv_id, role, text order by i) as seen, lag(c) over (partition by conv_id order by i) as p from placed),
judged as materialized (select *, case when not regexp_matches(text, '[^\\x20\\x09-\\x0D]') then 'b' when seen > 1 then 'd' when not regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') then 't' else '-' end as f from seen_),
ids as (select distinct conv_id from conversations),
walk as (select conv_id, 0::bigint as i, {start} as e, {none} as s, {none} as u, {none} as a from ids union all
 select conv_id, i + 1, {delete('e')}, case when ok and c = 's' then least({delete('s')}, {keep('e')}) else {delete('s')} end,
 case when ok and c = 'u' then least({delete('u')}, {keep('e')}, {keep('s')}, {keep('a')}, {rerole('e', 'user')}, {rerole('s', 'user')}, {rerole('a', 'user')})
 when ok then least({delete('u')}, {rerole('e', 'user')}, {rerole('s', 'user')}, {rerole('a', 'user')}) else {delete('u')} end,
 case when ok and c = 'a' then least({delete('a')}, {keep('u')}, {rerole('u', 'assistant')}) when ok then least({delete('a')}, {rerole('u', 'assistant')}) else {delete('a')} end from ({step})),
best as (select conv_id, least(e, a) as b from ({closed("select * from walk w where i = (select coalesce(max(i), 0) from judged j where j.conv_id is not distinct from w.conv_id)")})),
counts as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where f = 'b') as blank, count(*) filter (where f = 'd') as duplicate,
 count(*) filter (where f = 't') as truncated, count(*) filter (where p is not null and p || c not in ('su', 'ua', 'au')) as illegal from judged group by conv_id)
select b.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
 b.b.c as cost, b.b.a as audit, sha256(array_to_string(b.b.t, chr(10))) as repaired_sha256 from best b left join counts k on b.conv_id is not distinct from k.conv_id"""
