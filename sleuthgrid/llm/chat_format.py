"""Chat formatting: roles of transcript lines by a hidden Markov model.

A state is a role and whether the line opens a turn; a speaker of an unknown name has the role `other` in
the model. A line's observation is its speaker marker and shape features; the model is counted here from
`labelled_transcripts` with add-one smoothing, and lines are decoded by Viterbi over a whole conversation.
A row whose speaker is given by a column is that speaker's: its states are fixed, whatever its text is like, and the
lines around it are decoded with these. Log-likelihoods are whole numbers, so the max-plus products of a
conversation's parts may be formed in any grouping: rows are range-partitioned in the order of the
conversations, a partition sends the product of the conversation that it begins and of the one that it
ends with, these are chained by conversation, and each partition decodes its own lines between the
states fixed at its ends. The number of partitions grows with the text, so a task holds a bounded part of
a conversation, however long it is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, partitions

ROLES = ["system", "user", "assistant", "other"]
OTHER = 3
# What transcripts call their speakers.
NAMES = {
    "system": "system sys instruction instructions context setup",
    "user": "user human customer client question q prompter inst student caller me",
    "assistant": "assistant ai bot agent chatbot answer a model response support helper",
}
_ROLE_OF = {name: ROLES.index(role) for role in NAMES for name in NAMES[role].split()}
_MARK = re.compile(r"\s*(?:(<\|im_start\|>|<\|start_header_id\|>|<\||#{1,4} ?|\*\*|\[)\s*)?([A-Za-z][A-Za-z .]{0,23})(<\|end_header_id\|>|\|>|:?\*\*|\])?(\s*:(?=\s|$))?\s*")
#: Observations: marker (none, of a role, unknown) x first line of a row x line before (other, blank, a marker alone) x ends with a question mark x length class;
#: after these the first and the further lines of a row whose role is given.
MARKERS, SHAPES = 5, 2 * 3 * 2 * 3
FREE = MARKERS * SHAPES
N_OBS = FREE + 2 * len(ROLES)
#: Bytes of text to a partition.
PART_BYTES = 32 << 20
STATES = 2 * len(ROLES)
#: The state before a conversation's first line.
BEGIN = STATES
_NEVER = -(1 << 50)
_SCALE = 1 << 16


def marker(line: str) -> tuple[int, int]:
    """The marker class (0 none, 1 + role, 4 a name that isn't known) that a line begins with, and the marker's length."""
    m = _MARK.match(line)
    if not m:
        return 0, 0
    name = m[2].strip().lower()
    framed = m[1] and (m[1].startswith(("#", "<|im", "<|start")) or m[3])
    if name in _ROLE_OF and (m[4] or framed and (m[4] or m[3] or m.end() == len(line))):
        return 1 + _ROLE_OF[name], m.end()
    if m[4] and not m[1] and len(m[2]) <= 20 and m[2][0].isupper() and m[2].count(" ") <= 1:
        return 4, m.end()
    return 0, 0


def observe(lines: list[str], before: str = "x", role: int | None = None) -> bytes:
    """The observation of each line, a byte each. role: given for all of them, as one turn."""
    if role is not None:
        return bytes([FREE + 2 * role, *[FREE + 2 * role + 1] * (len(lines) - 1)])
    out = bytearray()
    for k, line in enumerate(lines):
        n = len(line)
        size = 0 if n < 60 else 1 if n < 240 else 2
        ahead = 1 if not before.strip() else 2 if k and marker(before) == (marker(before)[0], len(before)) else 0
        out.append((((marker(line)[0] * 2 + (not k)) * 3 + ahead) * 2 + line.rstrip().endswith(("?", "\uff1f"))) * 3 + size)
        before = line
    return bytes(out)


def role_of(speaker: str | None) -> int | None:
    """The role that a speaker's name stands for; None without a name."""
    name = (speaker or "").strip().lower()
    return _ROLE_OF.get(name, OTHER) if name else None


def labelled_transcripts(n: int = 1500, seed: int = 11) -> Iterator[tuple[list[str], list[int]]]:
    """Invented transcripts in several marker dialects, with the state of each line."""
    rng = np.random.default_rng(seed)
    some = lambda p: rng.random() < p
    dialects = [
        {r: f"{{}}{r.title()}: " for r in NAMES}, {r: f"{{}}{r}: " for r in NAMES}, {"system": "System: ", "user": "Human: ", "assistant": "AI: "},
        {"system": "Context: ", "user": "Q: ", "assistant": "A: "}, {r: f"### {r.title()}:\n" for r in NAMES}, {r: f"<|{r}|>\n" for r in NAMES}, {r: f"**{r.title()}:** " for r in NAMES},
    ]

    def sentence(words: int, question: bool) -> str:
        body = " ".join("abcdefghijklmnopqrstuvwxyz"[int(rng.integers(26))] * int(rng.integers(1, 9)) for _ in range(words))
        return body.capitalize() + ("?" if question else ".")

    for _ in range(n):
        dialect = dialects[int(rng.integers(len(dialects)))]
        turns = ([0] if some(0.25) else []) + [1 + t % 2 for t in range(int(rng.integers(1, 9)))]
        if some(0.35):  # a speaker of another name, here and there
            name = "".join("abcdefghijklmnopqrstuvwxyz"[int(rng.integers(26))] for _ in range(int(rng.integers(3, 9)))).capitalize()
            turns = [x for t in turns for x in ([t, OTHER] if t and some(0.4) else [t])]
        lines: list[str] = []
        states: list[int] = []
        for role in turns:
            extra = int(rng.integers(0, (1, 2, 5, 2)[role] + 1))
            own = []
            for i in range(1 + extra):
                if some(0.06):
                    own.append("")
                text = sentence(int(rng.integers(2, (20, 25, 60, 25)[role])), some((0.02, 0.45, 0.05, 0.1)[role]))
                own.append(("Note: " if some(0.005) else "") + text)
            if lines and some(0.25):
                lines.append("")
                states.append(states[-1] | 1)
            head = f"{name}: " if role == OTHER else dialect[ROLES[role]].format("") if not some(0.04) else ""
            own = (head + "\n".join(own)).split("\n")
            lines += own
            states += [2 * role] + [2 * role + 1] * (len(own) - 1)
        yield lines, states


@cache
def model() -> np.ndarray:
    """For each observation the whole-number log-likelihoods (from, to) of a step that ends with it."""
    step = np.ones((STATES + 1, STATES))
    # next to no weight for markers that training didn't show: a known one outweighs what the turns around it suggest
    seen = [np.full((STATES, MARKERS), 1e-3), *(np.ones((STATES, k)) for k in (2, 3, 2, 3))]
    rng = np.random.default_rng(5)
    for n, (lines, states) in enumerate(labelled_transcripts()):
        step[[BEGIN, *states[:-1]], states] += 1
        # every second transcript is one row; the others mostly have a row for each turn
        cuts = [i for i in range(1, len(lines)) if rng.random() < (0.05 if states[i] % 2 else 0.95)] if n % 2 else []
        rows = [lines[a:b] for a, b in zip([0, *cuts], [*cuts, len(lines)], strict=True)]
        rest = np.frombuffer(b"".join(map(observe, rows)), np.uint8).astype(int)
        for counts in reversed(seen):
            rest, value = np.divmod(rest, counts.shape[1])
            np.add.at(counts, (states, value), 1)
    step[BEGIN, 1::2] = 1e-9  # a conversation's first line opens a turn
    log = lambda x: np.log(x / x.sum(axis=1, keepdims=True))
    emit = np.zeros((STATES, 1))
    for counts in seen:
        emit = (emit[:, :, None] + log(counts)[:, None, :]).reshape(STATES, -1)
    out = np.full((N_OBS, STATES + 1, STATES + 1), _NEVER, np.int64)
    out[:FREE, :, :STATES] = np.rint(_SCALE * (log(step)[None] + emit.T[:, None, :])).astype(np.int64)
    for state in range(STATES):  # a given role allows one state
        out[FREE + state, :, state] = np.rint(_SCALE * log(step)[:, state]).astype(np.int64)
    return out


def product(observations: bytes) -> np.ndarray:
    """The best log-likelihood from each state before the lines to each state at the last."""
    steps, out = model(), np.full((STATES + 1, STATES + 1), _NEVER, np.int64)
    np.fill_diagonal(out, 0)
    for o in observations:
        out = np.maximum((out[:, :, None] + steps[o][None]).max(axis=1), _NEVER)
    return out


def viterbi(observations: bytes, entry: int = BEGIN, end: int | None = None) -> list[int]:
    """The likeliest states after `entry`, of equally likely ones the first; `end` fixes the last one."""
    steps, best, back = model(), np.full(STATES + 1, _NEVER, np.int64), []
    best[entry] = 0
    for o in observations:
        ways = best[:, None] + steps[o]
        back.append(ways.argmax(axis=0))
        best = np.maximum(ways.max(axis=0), _NEVER)
    state = int(best.argmax()) if end is None else end
    out = []
    for b in reversed(back):
        out.append(state)
        state = int(b[state])
    return out[::-1]


def chain(products: list[np.ndarray]) -> list[tuple[int, int]]:
    """The states before and at the end of each part of a conversation, from the parts' products in their order."""
    best, ahead = [np.full(STATES + 1, _NEVER, np.int64)], []
    best[0][BEGIN] = 0
    for p in products:
        ahead.append(best[-1][:, None] + p)
        best.append(np.maximum(ahead[-1].max(axis=0), _NEVER))
    state, out = int(best[-1].argmax()), []
    for way in reversed(ahead):
        before = int(way[:, state].argmax())
        out.append((before, state))
        state = before
    return out[::-1]


_SEEN = "part int, seq long, conv_id long, turn long, speaker string, text string, obs binary, edge binary"
_PARSED = "conv_id long, turn long, line long, role string, opens boolean, text string, rendered string"
_KINDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
_SEEN_ARROW, _PARSED_ARROW = (pa.schema([(f.split()[0], _KINDS[f.split()[1]]) for f in ddl.split(", ")]) for ddl in (_SEEN, _PARSED))
#: Which conversation of a partition an edge is of.
_FIRST, _LAST, _ONLY = 0, 1, 2


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, schema.types, strict=True)], schema=schema)


def _look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sorted rows of a partition with their observations, and the products of its first and last conversation."""
    part, seq = TaskContext.get().partitionId(), 0
    runs: list[list] = []  # [conv_id, the product of its lines] of the first and the current conversation
    for b in batches:
        for lo in range(0, b.num_rows, 1000):
            rows, out = b.slice(lo, 1000).to_pylist(), []
            for r in rows:
                own = observe((r["text"] or "").split("\n"), role=role_of(r["speaker"]))
                if not runs or runs[-1][0] != r["conv_id"]:
                    runs[1:] = [[r["conv_id"], bytearray()]]
                runs[-1][1] += own
                out.append((part, seq, r["conv_id"], r["turn"], r["speaker"], r["text"], own, None))
                seq += 1
            yield _batch(out, _SEEN_ARROW)
    which = [_ONLY] if len(runs) == 1 else [_FIRST, _LAST]
    if runs:
        yield _batch([(part, w, conv, None, None, None, None, product(bytes(own)).tobytes()) for w, (conv, own) in zip(which, runs, strict=True)], _SEEN_ARROW)


def _fix(table: pa.Table) -> pa.Table:
    """Of a conversation's edges the states fixed at the ends of its partitions, for those that it has several of."""
    edges = table.sort_by("part").to_pylist()
    fixed = chain([np.frombuffer(e["edge"], np.int64).reshape(STATES + 1, STATES + 1) for e in edges]) if len(edges) > 1 else []
    rows = [(e["part"], e["seq"] - 3, None, None, None, None, None, bytes(ends)) for e, ends in zip(edges, fixed, strict=False)]
    return pa.Table.from_batches([_batch(rows, _SEEN_ARROW)])


def _turns(rows: list[tuple[int | None, int | None, str | None, str | None, bytes]], entry: int, end: int | None) -> Iterator[tuple]:
    """The result's rows of one conversation, or of a partition's part of it."""
    states = viterbi(b"".join(r[4] for r in rows), entry, end)
    at = 0
    for conv, turn, speaker, text, _ in rows:
        lines, name = (text or "").split("\n"), (speaker or "").strip().lower()
        mine = states[at : at + len(lines)]
        at += len(lines)
        given = role_of(speaker) is not None
        cuts = [k for k in range(len(lines)) if not k or mine[k] % 2 == 0 or mine[k] // 2 != mine[k - 1] // 2]
        for a, b in zip(cuts, [*cuts[1:], len(lines)], strict=True):
            opens, first, state = mine[a] % 2 == 0, lines[a], mine[a] // 2
            kind, n = (0, 0) if given else marker(first)
            if opens and not given:
                name = ""
                if kind == 1 + state:
                    if state == OTHER:
                        name = first[:n].strip().rstrip(":").strip().lower()
                    first = first[n:]
            role = ROLES[state] if state != OTHER else name or ROLES[OTHER]
            plain = "\n".join(lines[a + 1 : b]) if kind and n == len(lines[a]) and opens and b > a + 1 and not first else "\n".join([first, *lines[a + 1 : b]])
            yield conv, turn, a, role, opens, plain, (f"<|{role}|>\n" if opens else "") + plain.replace("<|", "< |") + "\n"


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part and seq, the states fixed at a part's ends before them, as turns; holds one conversation's rows in a part."""
    part: int | None = None
    ends: dict[int, tuple[int, int]] = {}
    held: list[tuple] = []
    first = True

    def settle(last: bool) -> list[tuple]:
        of_first = ends.get(_FIRST, ends.get(_ONLY)) if first else None
        of_last = ends.get(_LAST, ends.get(_ONLY)) if last else None
        return list(_turns(held, of_first[0] if of_first else BEGIN, of_last[1] if of_last else of_first[1] if of_first else None))

    for b in batches:
        for lo in range(0, b.num_rows, 1000):
            out: list[tuple] = []
            for r in b.slice(lo, 1000).to_pylist():
                if r["part"] != part:
                    if held:
                        out += settle(True)
                    part, ends, held, first = r["part"], {}, [], True
                if r["seq"] < 0:
                    ends[r["seq"] + 3] = tuple(r["edge"])
                    continue
                if held and held[-1][0] != r["conv_id"]:
                    out += settle(False)
                    held, first = [], False
                held.append((r["conv_id"], r["turn"], r["speaker"], r["text"], r["obs"]))
            yield _batch(out, _PARSED_ARROW)
    if held:
        yield _batch(settle(True), _PARSED_ARROW)


def transcripts(rows: DataFrame, *, conv: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text", bare: int = 10) -> DataFrame:
    """(conv_id, turn, text): rows of known speakers as stretches of transcripts, the speaker written into the text as a marker.

    A conversation's id decides which of five dialects it is written in; one row in `bare` gets no marker, by a hash of id
    and order. Null and blank roles get none. 0 gives every row a marker.
    """
    name = F.trim(F.col(role).cast("string"))
    forms = [F.concat(F.initcap(name), F.lit(": ")), F.concat(F.lower(name), F.lit(": ")), F.concat(F.lit("### "), F.initcap(name), F.lit(":\n")), F.concat(F.lit("<|"), F.lower(name), F.lit("|>\n")), F.concat(F.lit("**"), F.initcap(name), F.lit(":** "))]
    dialect = F.pmod(F.xxhash64(conv), F.lit(len(forms)))
    head = F.lit("")
    for k, form in enumerate(forms):
        head = F.when(dialect == k, form).otherwise(head)
    marked = (F.coalesce(name, F.lit("")) != "") & (F.pmod(F.xxhash64(conv, order), F.lit(bare)) != 0 if bare else F.lit(True))
    return rows.select(F.col(conv).alias("conv_id"), F.col(order).alias("turn"), F.concat(F.when(marked, head).otherwise(""), F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("text"))


def parse_transcripts(rows: DataFrame, *, conv: str = "conv_id", order: str = "turn", text: str = "text", speaker: str | None = None) -> DataFrame:
    """The turns of transcripts: conv_id, turn, line, role, opens, text and rendered.

    rows: stretches of transcripts, in the order of `order`, each one or more \\n-split lines.
    `speaker`: a column that names a row's speaker. A row with one is that speaker's turn as a whole, its text
    as it is; its role is system, user or assistant for the names known for these, else the name itself in lower
    case. All other lines are decoded. A result row is a run of lines of one row and one turn: `turn` its row's
    order, `line` the first line's place in the row, `opens` whether it opens a turn or goes on with the one
    before. Markers are cut off where they open a turn of their role; an unknown speaker's name is the role, and
    `other` where such a turn goes on in a later row. `rendered` is the canonical form: a line <|role|> where a turn
    opens, then the text, in which "<|" is written "< |"; a conversation's rendered rows in the order of turn
    and line, as written, make up its chat.

    Null text: an empty line. Null or blank speaker: not given. Null conv is one conversation; null order
    comes first. Rows of one order are sorted by speaker and text; rows that repeat as a whole each count. An
    empty table gives no rows; further columns are ignored. A row's text is worked on whole.
    """
    spark = rows.sparkSession
    name = F.col(speaker).cast("string") if speaker else F.lit(None).cast("string")
    own = rows.select(F.col(conv).cast("long").alias("conv_id"), F.col(order).cast("long").alias("turn"), name.alias("speaker"), F.col(text).cast("string").alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    keys = ["conv_id", "turn", F.xxhash64("speaker", "text"), "speaker", "text"]
    ranged = own.repartitionByRange(max(partitions(spark), -(-size // PART_BYTES)), *keys[:3]).sortWithinPartitions(*keys)
    seen = materialize(ranged.mapInArrow(_look, _SEEN), "transcripts")
    fixed = seen.where("edge is not null").groupBy("conv_id").applyInArrow(_fix, _SEEN)
    both = seen.where("edge is null").unionByName(fixed)
    return both.repartition(max(partitions(spark), -(-size // PART_BYTES)), "part").sortWithinPartitions("part", "seq").mapInArrow(_decode, _PARSED)
