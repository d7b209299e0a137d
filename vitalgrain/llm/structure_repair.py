"""Conversation structure repair by signature deduplication.

A conversation's rows become one compact string, its signature: a letter per row for the role's initial
and the row's fault. Each distinct signature is solved once by a memoised recursion for the cheapest
edits that give role initials ``(s?(ua)+)?``; the audits are joined back by signature, and the edits are
replayed over the rows.

Order and bounds. A conversation's rows pass a task as a sorted stream, first without texts (for the
signature), then with texts behind one row that holds the audit (for the replay); neither pass holds more
of a conversation than its signature and audit, a byte per row. Which rows repeat an earlier one is a
window over (conversation, digest of role and text), so no set of seen rows is held either. Signatures
are counted before they are shuffled; conversations are joined with the solved ones by a sort-merge join
whose large keys run-time statistics split, or by a broadcast where run-time sizes allow it.

Edits and costs: Keep 0, Rerole to user or assistant 2, Delete 3 (the only one for blank and duplicate
rows), Insert an empty turn of user or assistant 2; a truncated row that stays adds 1. Of the cheapest
audits the ASCII-least one counts.

Defined results: rows go by (turn, role, SHA-256 of the text), null turns first; a null role or text is
one space (so such a text is blank); a null conversation id is a conversation; a row's first fault of
blank, duplicate (role and text seen earlier), truncated counts; repeated rows are duplicates; a
conversation without rows has zeros, an empty audit and the hash of nothing; an empty table gives no
rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from array import array

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from vitalgrain.llm.common import materialize, small_batches, work_dir

#: Costs, and the roles of inserted or changed turns.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
ROLES = {"u": "user", "a": "assistant"}
#: Where a role's initial leads from each state (start, after s, after u, after a), and where a sequence may end.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
#: The initial that a change or an insertion gives in each state: one is possible everywhere.
GIVEN = ("u", "u", "a", "u")
MOST_INSERTS = 2  # three in a row come back to a state that they have met
SPACE = " \t\n\x0b\x0c\r"
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")
HEADER = "signature string, gaps long, blank long, duplicate long, truncated long, illegal long"


def solve(signature: str) -> tuple[int, str]:
    """(cost, audit) of a signature: s, u, a, o for the initials, upper case where truncated, x where the row has to go."""
    n, wide = len(signature), 4 * (MOST_INSERTS + 1)
    memo = array("q", [-1]) * ((n + 1) * wide)
    never = 1 << 40

    def options(i: int, state: int, inserted: int):
        """(letter, cost so far, next position, state, insertions in a row), in ASCII order of the letters."""
        if i < n:
            yield "D", DELETE, i + 1, state, 0
        if inserted < MOST_INSERTS:
            yield "I", INSERT, i, NEXT[state][GIVEN[state]], inserted + 1
        if i < n and (row := signature[i]) != "x":
            more = TRUNCATED if row.isupper() else 0
            if row.lower() in NEXT[state]:
                yield "K", more, i + 1, NEXT[state][row.lower()], 0
            yield "R", REROLE + more, i + 1, NEXT[state][GIVEN[state]], 0

    def best(i: int, state: int, inserted: int) -> int:
        at = i * wide + state * (MOST_INSERTS + 1) + inserted
        if memo[at] < 0:
            found = 0 if i == n and state in ENDS else never
            for _, cost, j, then, k in options(i, state, inserted):
                found = min(found, cost + best(j, then, k))
            memo[at] = found
        return memo[at]

    for i in range(n, -1, -1):  # from the back, so that no call goes deeper than a row
        for state in range(4):
            best(i, state, 0)
    audit, i, state, inserted = [], 0, 0, 0
    left = total = best(0, 0, 0)
    while not (i == n and state in ENDS and left == 0):
        for letter, cost, j, then, k in options(i, state, inserted):
            if cost + best(j, then, k) == left:
                audit.append(letter)
                i, state, inserted, left = j, then, k, left - cost
                break
    return total, "".join(audit)


class Replay:
    """Applies an audit to rows that come in order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.digest, self.first = audit, 0, 0, hashlib.sha256(), True

    def _say(self, role: str, text: str, initial: str) -> None:
        self.digest.update((("" if self.first else "\n") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.first, self.state = False, NEXT[self.state][initial]

    def insert(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self._say(ROLES[GIVEN[self.state]], "", GIVEN[self.state])

    def row(self, role: str, text: str) -> None:
        self.insert()
        letter, self.at = self.audit[self.at], self.at + 1
        if letter == "K":
            self._say(role, text, role[:1])
        elif letter == "R":
            self._say(ROLES[GIVEN[self.state]], text, GIVEN[self.state])


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, there) after damage by the CRC of ``conv_id:turn`` modulo 20; a dropped row stays as a mark."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said(conv), F.lit(":"), said(turn)).cast("binary")) % 20
    text_col = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(said(text), "[.!?]", "")).otherwise(said(text))
    out = rows.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.when(kind == 4, "user").otherwise(said(role)).alias("role"), text_col.alias("text"), (kind != 0).alias("there"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return out.drop("copy")


def prepared(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, there) of rows as they are, without damage."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), said(role).alias("role"), said(text).alias("text"), F.lit(True).alias("there"))


def _text_digest() -> Column:
    return F.when(F.col("there"), F.sha2("text", 256))


def _stream(df: DataFrame, order: list, columns: list[str], schema: StructType, start, step, finish) -> DataFrame:
    """A row per conversation: its rows, dealt by conversation already, pass a task in order of ``order``."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    small_batches(df.sparkSession)
    arrow = to_arrow_schema(schema)

    def run(batches):
        last, state, made = None, None, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if state is None or row[0] != last:
                    if state is not None:
                        made.append(finish(last, state))
                    last, state = row[0], start(row)
                step(state, row)
            if len(made) >= 1000:
                yield pa.RecordBatch.from_pylist(made, arrow)
                made = []
        if state is not None:
            made.append(finish(last, state))
        if made:
            yield pa.RecordBatch.from_pylist(made, arrow)

    return df.sortWithinPartitions(F.asc_nulls_first("conv_id"), *order).select(*columns).mapInArrow(run, schema)


class _Summary:
    """What the first pass holds of a conversation."""

    __slots__ = ("letters", "low", "high", "last_turn", "turns", "counts", "initial")

    def __init__(self, _row):
        self.letters, self.low, self.high, self.last_turn, self.turns, self.initial = bytearray(), None, None, None, 0, None
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}

    def add(self, row) -> None:
        _, turn, there, initial, fault, again = row
        if not there:
            return
        if turn is not None and turn != self.last_turn:
            self.low, self.high, self.last_turn, self.turns = turn if self.low is None else self.low, turn, turn, self.turns + 1
        fault = fault if fault == "blank" else "duplicate" if again else fault
        if fault:
            self.counts[fault] += 1
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.initial = initial
        letter = initial if initial in ("s", "u", "a") else "o"
        self.letters += (b"x" if fault in ("blank", "duplicate") else (letter.upper() if fault else letter).encode())

    def row(self, conv) -> dict:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return {"conv_id": conv, "signature": self.letters.decode(), "gaps": gaps, **self.counts}


def signatures(rows: DataFrame) -> DataFrame:
    """Per conversation: conv_id, signature, gaps and the counts of faults and illegal steps; ``rows`` by ``prepared`` or ``damaged``."""
    last = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    small = rows.select(
        "conv_id", "turn", "role", "there", _text_digest().alias("digest"), F.substring("role", 1, 1).alias("initial"),
        F.when(last == "", "blank").when(~last.isin(".", "!", "?"), "truncated").alias("fault"),
    ).repartition("conv_id")
    same = Window.partitionBy("conv_id", "there", "role", "digest").orderBy(F.asc_nulls_first("turn"))
    marked = small.withColumn("again", F.row_number().over(same) > 1)
    schema = StructType([StructField("conv_id", rows.schema["conv_id"].dataType), *StructType.fromDDL(HEADER).fields])
    columns = ["conv_id", "turn", "there", "initial", "fault", "again"]
    return _stream(marked, [F.asc_nulls_first("turn"), "role", "digest", "again"], columns, schema, _Summary, _Summary.add, lambda conv, s: s.row(conv))


def solved(found: DataFrame) -> DataFrame:
    """(signature, cost, audit), each distinct signature once."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            said = batch.column("signature").to_pylist()
            costs, audits = zip(*map(solve, said), strict=True) if said else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column("signature"), pa.array(costs, pa.int64()), pa.array(audits, pa.string())], ["signature", "cost", "audit"])

    return found.groupBy("signature").agg(F.count("*").alias("n")).select("signature").mapInArrow(run, "signature string, cost long, audit string")


def repair(rows: DataFrame) -> DataFrame:
    """Per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256; ``rows`` by ``prepared`` or ``damaged``."""
    found = materialize(signatures(rows), f"{work_dir(rows.sparkSession, 'repair')}/signatures")
    audited = found.join(solved(found), "signature").select("conv_id", *COUNTS, "cost", "audit")
    head = audited.select("conv_id", F.struct(*COUNTS, "cost", "audit").alias("head"))
    kind = head.schema["head"].dataType
    texts = rows.where("there").select("conv_id", F.lit(None).cast(kind).alias("head"), "turn", "role", _text_digest().alias("digest"), "text")
    none = [F.lit(None).cast(texts.schema[c].dataType).alias(c) for c in ("turn", "role", "digest", "text")]
    both = texts.union(head.select("conv_id", "head", *none)).repartition("conv_id")
    schema = StructType.fromDDL("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
    schema = StructType([StructField("conv_id", rows.schema["conv_id"].dataType), *schema.fields])

    def step(state, row) -> None:
        if row[1] is None:
            state[1].row(row[2], row[3])

    def finish(conv, state) -> dict:
        state[1].insert()
        return {"conv_id": conv, **state[0], "repaired_sha256": state[1].digest.hexdigest()}

    order = [F.col("head").isNull(), F.asc_nulls_first("turn"), "role", "digest"]  # the audit goes first
    return _stream(both, order, ["conv_id", "head", "role", "text"], schema, lambda row: (row[1], Replay(row[1]["audit"])), step, finish)
