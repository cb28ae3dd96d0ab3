"""Repair of conversations' structure by dynamic programming over a grammar of their fault sequences."""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightgraph.functions.scratch import written
from freightgraph.llm.conversations import BLOCK_ROWS, ordered_blocks

ROLES, FAULTS = "sua", ("clean", "truncated", "blank", "duplicate")  # any other role is a fourth class
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
NAMES = {"u": "user", "a": "assistant"}
MAX_RULES = 64
#: A pair is worth a rule if it makes up one in so many of all pairs.
WORTH = 1000
_SEEN = re.compile("[^\x20\x09-\x0d]")
_BASE = ord("A")

# States of (s?(ua)+)?: nothing yet, after the system turn, after a user turn, after an assistant turn
STATES, ACCEPT = 4, (0, 3)
STEP = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}

# A rope is None, a string of edits, or a pair of ropes; an entry is (cost, rope), a matrix {(from, to): entry}.
Rope = None | str | tuple
Matrix = dict[tuple[int, int], tuple[int, Rope]]


def rope_text(rope: Rope) -> str:
    """The edits of a rope, left to right."""
    out, todo = [], [rope]
    while todo:
        r = todo.pop()
        if isinstance(r, str):
            out.append(r)
        elif r is not None:
            todo += [r[1], r[0]]
    return "".join(out)


def better(a: tuple[int, Rope], b: tuple[int, Rope] | None) -> bool:
    """Cheaper, or as cheap and ASCII-less.

    Two ropes over the same turns that cost the same are never prefixes of each other (what is longer has
    more inserts), so the lesser of two parts always gives the lesser whole.
    """
    return b is None or a[0] < b[0] or (a[0] == b[0] and a[1] is not b[1] and rope_text(a[1]) < rope_text(b[1]))


def times(left: Matrix, right: Matrix) -> Matrix:
    """The min-plus product."""
    out: Matrix = {}
    for (i, k), (c, r) in left.items():
        for (k2, j), (d, s) in right.items():
            if k == k2:
                entry = (c + d, s if r is None else r if s is None else (r, s))
                if better(entry, out.get((i, j))):
                    out[i, j] = entry
    return out


def inserts() -> Matrix:
    """From each state to each other by inserted turns alone."""
    out: Matrix = {(i, i): (0, None) for i in range(STATES)}
    for i in range(STATES):
        at, n = i, 0
        while (at := 3 if at == 2 else 2) != i and (i, at) not in out:
            n += 1
            out[i, at] = (n * INSERT, "I" * n)
    return out


def turn_matrix(symbol: str) -> Matrix:
    """Inserts before a turn, then its own edit."""
    role, fault = divmod(ord(symbol) - _BASE, len(FAULTS))
    edit: Matrix = {(i, i): (DELETE, "D") for i in range(STATES)}
    if FAULTS[fault] in ("clean", "truncated"):
        more = TRUNCATED if FAULTS[fault] == "truncated" else 0
        for (r, i), j in STEP.items():
            if r == ROLES[role : role + 1]:
                edit[i, j] = (more, "K")
            elif r != "s":
                edit[i, j] = (REROLE + more, "R")
    return times(inserts(), edit)


SYMBOLS = [chr(_BASE + k) for k in range((len(ROLES) + 1) * len(FAULTS))]


def pair_grammar(strings: DataFrame, max_rules: int = MAX_RULES) -> list[tuple[str, str]]:
    """Re-Pair rules (pair of symbols, new symbol) in order. strings: seq, n.

    Each round counts all neighbouring pairs of all sequences in Spark and replaces the most frequent
    ones that share no symbol. ``max_rules`` and the least frequency bound the grammar, which changes
    only what a result costs. Only the pairs' counts come to the driver, at most the square of the number of symbols.
    """
    rules: list[tuple[str, str]] = []
    while len(rules) < max_rules:
        pairs = strings.where("length(seq) > 1").select("n", F.explode(F.expr("transform(sequence(1, length(seq) - 1), i -> substring(seq, i, 2))")).alias("pair"))
        counted = pairs.groupBy("pair").agg(F.sum("n").alias("n")).collect()
        total = sum(r["n"] for r in counted)
        chosen: list[str] = []
        for r in sorted(counted, key=lambda r: (-r["n"], r["pair"])):
            if r["n"] < max(2, total / WORTH) or len(rules) + len(chosen) >= max_rules:
                break
            if not set(r["pair"]) & set("".join(chosen)):
                chosen.append(r["pair"])
        if not chosen:
            break
        made = [(p, chr(0x100 + len(rules) + k)) for k, p in enumerate(chosen)]
        rules += made
        seq = F.col("seq")
        for pair, symbol in made:
            seq = F.replace(seq, F.lit(pair), F.lit(symbol))
        strings = written(strings.select(seq.alias("seq"), "n").groupBy("seq").agg(F.sum("n").alias("n")), "sequences")
    return rules


class Evaluator:
    """Matrices of all symbols, each rule's from those of its pair, and products of compressed sequences."""

    def __init__(self, rules: list[tuple[str, str]]):
        self.rules = rules
        self.of = {s: turn_matrix(s) for s in SYMBOLS}
        for pair, symbol in rules:
            self.of[symbol] = times(self.of[pair[0]], self.of[pair[1]])

    @functools.cached_property
    def matrix(self):
        @functools.lru_cache(maxsize=4096)
        def product(sequence: str) -> Matrix:
            for pair, symbol in self.rules:
                sequence = sequence.replace(pair, symbol)
            out: Matrix = {(i, i): (0, None) for i in range(STATES)}
            for s in sequence:
                out = times(out, self.of[s])
            return {k: (c, rope_text(r)) for k, (c, r) in out.items()}

        return product

    def __getstate__(self):
        return {"rules": self.rules, "of": self.of}

    def audit(self, sequences: list[str]) -> tuple[int, list[str]]:
        """Cost and edits of a conversation's blocks: the cheapest, of these the ASCII-least."""
        now: dict[int, tuple[int, Rope]] = {0: (0, None)}
        for sequence in sequences:
            ahead: dict[int, tuple[int, Rope]] = {}
            for (i, j), (c, piece) in self.matrix(sequence).items():
                if i in now:
                    entry = (now[i][0] + c, (now[i][1], piece))
                    if better(entry, ahead.get(j)):
                        ahead[j] = entry
            now = ahead
        best = None
        for (i, j), (c, piece) in inserts().items():
            if i in now and j in ACCEPT:
                entry = (now[i][0] + c, (now[i][1], piece or ""))
                if better(entry, best):
                    best = entry
        cost, rope = best
        pieces: list[str] = []
        while rope is not None:
            rope, piece = rope
            pieces.append(piece)
        tail, *rest = pieces  # the inserts at the end belong to the last block
        rest = rest[::-1]
        rest[-1] += tail
        return cost, rest


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): ``rows`` (conv_id, turn, role, text) damaged by the CRC of "conv_id:turn"; dropped rows stay, marked ``gone``, for their conversation's sake."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20
    marked = rows.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return marked.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), copies.alias("copy")).drop("copy")


def _judged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with their turns' symbols; a turn seen earlier in its own block is a duplicate, the others' digests go on."""
    for batch in batches:
        out = {k: [] for k in ("roles", "texts", "symbols", "turns", "at", "key")}
        for turns, roles, texts, gone in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("turn", "role", "text", "gone")), strict=True):
            keep = [i for i, g in enumerate(gone) if not g]
            seen: set[bytes] = set()
            symbols, at, keys = [], [], []
            for n, i in enumerate(keep):
                role, text = roles[i], texts[i]
                key = xxhash.xxh3_128_digest(f"{len(role)}:{role}{text}".encode())
                body = text.rstrip(" \t\n\x0b\x0c\r")
                if not _SEEN.search(body):
                    fault = 2
                elif key in seen:
                    fault = 3
                else:
                    fault = 0 if body[-1] in ".!?" else 1
                    seen.add(key)
                    at.append(n)
                    keys.append(key)
                where = ROLES.find(role[0]) if role else -1
                symbols.append(chr(_BASE + (where if where >= 0 else len(ROLES)) * len(FAULTS) + fault))
            known = [turns[i] for i in keep if turns[i] is not None]
            out["roles"].append([roles[i] for i in keep])
            out["texts"].append([texts[i] for i in keep])
            out["symbols"].append("".join(symbols))
            out["turns"].append([known[0], known[-1], len(set(known))] if known else None)
            out["at"].append(at)
            out["key"].append(keys)
        kinds = (pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.binary()))
        fixed = [batch.column(batch.schema.get_field_index(c)) for c in ("conv_id", "part", "idx", "whole")]
        yield pa.RecordBatch.from_arrays([*fixed, *[pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)]], ["conv_id", "part", "idx", "whole", *out])


def _late(blocks: DataFrame) -> DataFrame:
    """(part, idx, late): turns of a block that another block of their conversation has earlier. Only conversations in several blocks can have any."""
    turns = blocks.where("not whole").select("conv_id", F.struct("part", "idx").alias("block"), F.explode(F.arrays_zip("at", "key")).alias("t")).select("conv_id", "block", "t.at", "t.key")
    first = turns.groupBy(F.col("conv_id").alias("c"), F.col("key").alias("k")).agg(F.min("block").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = turns.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("key") == F.col("k"))).where("block > first")
    return again.groupBy("block").agg(F.sort_array(F.collect_list("at")).alias("late")).select("block.part", "block.idx", "late")


def _duplicate(symbols: Column, at: Column) -> Column:
    n = len(FAULTS)
    code = F.ascii(F.substring(symbols, at + 1, F.lit(1))) - _BASE
    return F.overlay(symbols, F.char(F.lit(_BASE + n - 1) + (code - code % n)), at + 1)


def groups_of(batches: Iterable[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    """Rows of a sorted stream."""
    for batch in batches:
        yield from zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns), strict=True)


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
AUDIT_BATCH = 1024


def _audited(evaluator: Evaluator):
    """Each block's part of the audit, and the counts with a conversation's first block; conversations come one after another, their blocks in order."""

    def judge(conv: object, held: list[tuple]) -> list[tuple]:
        cost, pieces = evaluator.audit([b[2] for b in held])
        codes = [ord(s) - _BASE for b in held for s in b[2]]
        faults, roles = [c % len(FAULTS) for c in codes], [c // len(FAULTS) for c in codes]
        legal = {(ROLES.index(x), ROLES.index(y)) for x, y in ("su", "ua", "au")}
        known = [b[3] for b in held if b[3]]
        distinct = sum(t[2] for t in known) - sum(a[1] == b[0] for a, b in zip(known, known[1:]))  # noqa: B905
        gaps = known[-1][1] - known[0][0] + 1 - distinct if known else 0
        counts = (gaps, faults.count(2), faults.count(3), faults.count(1), sum(p not in legal for p in zip(roles, roles[1:])), cost)  # noqa: B905
        return [(conv, b[0], b[1], piece, *(counts if k == 0 else (None,) * len(counts))) for k, (b, piece) in enumerate(zip(held, pieces, strict=True))]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "part", "idx", "audit", *COUNTS]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.string(), *[pa.int64()] * len(COUNTS)]
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        conv, held, out = object(), [], []
        for c, *block in groups_of(batches, ["conv_id", "part", "idx", "symbols", "turns"]):
            if c != conv:
                if held:
                    out += judge(conv, held)
                conv, held = c, []
                if len(out) >= AUDIT_BATCH:
                    yield made(out)
                    out = []
            held.append(tuple(block))
        if held:
            out += judge(conv, held)
        if out:
            yield made(out)

    return run


class Reader:
    """Follows a conversation's audit and hashes the lines it leaves."""

    def __init__(self) -> None:
        self.state, self.sha, self.lines, self.audit, self.counts = 0, hashlib.sha256(), 0, [], None

    def line(self, role: str, text: str, initial: str) -> None:
        self.sha.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
        self.lines, self.state = self.lines + 1, STEP[initial, self.state]

    def block(self, audit: str, roles: list[str], texts: list[str]) -> None:
        self.audit.append(audit)
        turns = iter(zip(roles, texts, strict=True))
        for edit in audit:
            due = "a" if self.state == 2 else "u"
            if edit == "I":
                self.line(NAMES[due], "", due)
                continue
            role, text = next(turns)
            if edit == "K":
                self.line(role, text, role[0])
            elif edit == "R":
                self.line(NAMES[due], text, due)


def _repaired(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", *COUNTS, "audit", "repaired_sha256"]
    kinds = [pa.int64()] * (1 + len(COUNTS)) + [pa.string()] * 2
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
    done = lambda c, r: (c, *r.counts, "".join(r.audit), r.sha.hexdigest())
    conv, reader, audit, out = None, None, "", []
    for c, is_text, piece, roles, texts, *counts in groups_of(batches, ["conv_id", "is_text", "audit", "roles", "texts", *COUNTS]):
        if reader is None or c != conv:
            if reader is not None:
                out.append(done(conv, reader))
            conv, reader = c, Reader()
            if len(out) >= AUDIT_BATCH:
                yield made(out)
                out = []
        if is_text:
            reader.block(audit, roles, texts)
        else:
            audit = piece
            reader.counts = reader.counts or (tuple(counts) if counts[0] is not None else None)
    if reader is not None:
        out.append(done(conv, reader))
    if out:
        yield made(out)


def repair_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation in ``rows``.

    rows: conv_id long, turn long, role, text strings, and ``gone`` for rows that only name their
    conversation. Turns go in the order of turn (nulls first), role and a hash of role and text. A
    turn's first fault counts: blank, duplicate (role and text seen earlier in the conversation) or
    truncated. The edits Keep, Rerole, Delete and Insert give role initials (s?(ua)+)? at the least cost;
    of the cheapest audits the ASCII-least is taken.

    Turns become one of 16 symbols by role and fault. Pairs that are frequent over all conversations
    become rules of a grammar; each rule has one 4 × 4 min-plus matrix of costs and ropes of edits, made of
    its two parts' and used for every conversation. A conversation of any length is cut into blocks of 64
    turns, each reduced to a product of rules; its blocks' vector of four states is carried on in one
    narrow stream. The texts are shuffled once to be ordered and once to be hashed. What a conversation's
    digest covers runs through one hash in order, a block in memory at a time.

    A null role or text is an empty string to this function (``damaged`` gives it one space); a role that
    does not begin with s, u or a can not be kept. Rows with a null conv_id are one conversation. Repeated
    rows are duplicates. Long texts are judged whole, an empty table gives an empty result, and further
    columns of any name are ignored.
    """
    gone = F.col("gone") if "gone" in rows.columns else F.lit(False)
    own = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), gone.alias("gone"))
    blocks = ordered_blocks(own.withColumn("tie", F.xxhash64("role", "text")), ["turn", "role", "tie"], ["turn", "role", "text", "gone"], sized="text")
    schema = "conv_id long, part int, idx long, whole boolean, roles array<string>, texts array<string>, symbols string, turns array<long>, at array<int>, key array<binary>"
    blocks = written(blocks.mapInArrow(_judged, schema), "judged")
    symbols = F.aggregate(F.coalesce("late", F.array().cast("array<int>")), F.col("symbols"), _duplicate)
    sequences = written(blocks.join(_late(blocks), ["part", "idx"], "left").select("conv_id", "part", "idx", "turns", symbols.alias("symbols")), "sequences")
    evaluator = Evaluator(pair_grammar(sequences.groupBy(F.col("symbols").alias("seq")).agg(F.count("*").alias("n"))))
    counts = ", ".join(f"{c} long" for c in COUNTS)
    streamed = sequences.repartition("conv_id").sortWithinPartitions("conv_id", "part", "idx")
    audits = streamed.mapInArrow(_audited(evaluator), f"conv_id long, part int, idx long, audit string, {counts}").withColumn("is_text", F.lit(False))
    both = audits.unionByName(blocks.select("conv_id", "part", "idx", "roles", "texts", F.lit(True).alias("is_text")), allowMissingColumns=True)
    laid = both.repartition("conv_id").sortWithinPartitions("conv_id", "part", "idx", "is_text")
    return laid.mapInArrow(_repaired, f"conv_id long, {counts}, audit string, repaired_sha256 string")


__all__ = ["BLOCK_ROWS", "Evaluator", "damaged", "pair_grammar", "repair_conversations"]
