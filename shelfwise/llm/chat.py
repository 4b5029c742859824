"""Chat formatting by schema fingerprints: heterogeneous records become canonical turns, then marked-up text with a loss mask."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import pick

# The marks of the template, and the escapes of what could be read as a control string.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Every control string in use (also of other templates: <s>, </s>, <<SYS>>, [INST], [/INST]) holds one of these.
ESCAPES = (("\\", "\\\\"), ("<", "\\l"), ("[", "\\b"))
ASSISTANT = "assistant"


@dataclass(frozen=True)
class Layout:
    """A declarative mapping: the field paths a record has or may have, and where its turns come from.

    turns lists (list path or None, role: a path or =literal, text paths joined by a blank line), in order.
    """

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...]
    turns: tuple[tuple[str | None, str, tuple[str, ...]], ...]
    roles: tuple[tuple[str, str], ...] = ()


LAYOUTS = (
    Layout("turn", (), ("role", "text"), ((None, "role", ("text",)),)),
    Layout("messages", ("messages[]",), ("messages[].role", "messages[].content"), (("messages[]", "role", ("content",)),)),
    Layout("shared", ("conversations[]",), ("conversations[].from", "conversations[].value"), (("conversations[]", "from", ("value",)),), (("human", "user"), ("gpt", "assistant"))),
    Layout("instruction", ("instruction",), ("input", "output", "system"), ((None, "=system", ("system",)), (None, "=user", ("instruction", "input")), (None, "=assistant", ("output",)))),
    Layout("prompt", ("prompt",), ("completion", "system"), ((None, "=system", ("system",)), (None, "=user", ("prompt",)), (None, "=assistant", ("completion",)))),
    Layout("prompt-response", ("prompt", "response"), ("system",), ((None, "=system", ("system",)), (None, "=user", ("prompt",)), (None, "=assistant", ("response",)))),
    Layout("question", ("question", "answer"), ("context",), ((None, "=user", ("context", "question")), (None, "=assistant", ("answer",)))),
)


def field_paths(value, prefix: str = "") -> set[str]:
    """Nested field paths that hold a value; a list adds [] and the paths of all its elements, nulls add nothing."""
    if isinstance(value, dict):
        return set().union(*(field_paths(v, f"{prefix}.{k}" if prefix else k) for k, v in value.items()))
    if isinstance(value, list):
        return {f"{prefix}[]"}.union(*(field_paths(v, f"{prefix}[]") for v in value if isinstance(v, (dict, list))))
    return {prefix} if value is not None else set()


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def _index(layouts: tuple[Layout, ...]) -> dict[str, Layout]:
    """Layouts by the fingerprint of each combination of their fields; the first that lists a combination has it.

    A record without any field has no layout.
    """
    out: dict[str, Layout] = {}
    for x in layouts:
        for n in range(len(x.optional) + 1):
            for some in combinations(x.optional, n):
                if x.required or some:
                    out.setdefault(fingerprint({*x.required, *some}), x)
    return out


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def canonical_turns(record, layout: Layout) -> list[tuple[str, str]]:
    """(role, text) of a record in that layout. Of fixed turns, those whose fields are all missing are left out."""
    out, names = [], dict(layout.roles)
    for many, role, texts in layout.turns:
        for item in record.get(many[:-2]) or [] if many else [record]:
            have = [_text(item.get(t)) for t in texts if item.get(t) is not None]
            if role[0] == "=" and not have:
                continue
            own = role[1:] if role[0] == "=" else _text(item.get(role))
            out.append((names.get(own, own), "\n\n".join(have)))
    return out


def escape(text: str) -> str:
    for a, b in ESCAPES:
        text = text.replace(a, b)
    return text


def unescape(text: str) -> str:
    """The inverse of escape()."""
    if "\\" not in text:
        return text
    out, at, back = [], 0, {b[1]: a for a, b in ESCAPES}
    while (k := text.find("\\", at)) >= 0:
        out += [text[at:k], back[text[k + 1]]]
        at = k + 2
    return "".join([*out, text[at:]])


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, and the code points of it that carry loss (an assistant's text; else an empty range)."""
    head = f"{OPEN}{escape(role).replace(chr(10), chr(92) + 'n')}\n"
    body = escape(text)
    end = len(head) + (len(body) if role == ASSISTANT else 0)
    return f"{head}{body}{CLOSE}", len(head), end


def read_turn(piece: str) -> tuple[str, str]:
    """(role, text) read back from a formatted turn."""
    role, _, rest = piece.removeprefix(OPEN).partition("\n")
    parts = role.split("\\\\")
    return "\\".join(unescape(p.replace("\\n", "\n")) for p in parts), unescape(rest.removesuffix(CLOSE))


def format_chats(records: DataFrame, id_col: str, order_col: str, record_col: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Formatted turns of JSON records, one row a turn, so that a conversation of any length is never one value.

    The fingerprint of a record's nested field paths selects its mapping. A record whose fingerprint no layout lists
    (malformed JSON included) gives one row with null piece and its fingerprint in unknown. Rows of a conversation
    are ordered by order_col (null first), then position in the record, then the piece; repeated rows stay.
    Null roles and texts are empty. Empty table: empty.
    Returns conv_id, turn, position, piece, loss_start, loss_end (code points of piece), layout, unknown.
    """
    rows = pick(records, conv_id=id_col, turn=order_col, record=record_col)
    index = _index(layouts)

    names = ["position", "piece", "loss_start", "loss_end", "layout", "unknown"]
    types = [pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, at = [], []
            for i, raw in enumerate(b.column(2).to_pylist()):
                try:
                    record = json.loads(raw) if raw is not None else {}
                except ValueError:
                    record = None
                mark = fingerprint(field_paths(record)) if isinstance(record, dict) else "malformed"
                layout = index.get(mark)
                if layout is None:
                    out.append((0, None, None, None, None, mark))
                    at.append(i)
                    continue
                for k, (role, text) in enumerate(canonical_turns(record, layout)):
                    out.append((k, *format_turn(role, text), layout.name, None))
                    at.append(i)
            owner = pa.array(at, pa.int64())
            columns = [pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * 6, types, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(owner), b.column(1).take(owner), *columns], ["conv_id", "turn", *names])

    kinds = {n: rows.schema[n].dataType.simpleString() for n in ("conv_id", "turn")}
    return rows.mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, position int, piece string, loss_start int, loss_end int, layout string, unknown string")


def chat_digests(pieces: DataFrame) -> DataFrame:
    """Per conversation: digests of the turns and of the text under the loss mask, read back from format_chats() rows.

    A task streams its rows in order and holds the digests of the current conversation only, so a conversation with
    a large share of all rows costs time but no memory. A null conversation id is a conversation of its own. Records
    without a layout have no turn; n_unknown counts them, also where a conversation has no other.
    Returns conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_unknown.
    """
    rows = pieces.select("conv_id", "turn", "position", "piece", "loss_start", "loss_end")
    ordered = rows.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "position", "piece")
    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_unknown"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out, kind = object(), None, [], None

        def close() -> None:
            if state:
                n, turns, chars, loss, total, unknown = state
                out.append((now, n, turns.hexdigest(), chars, loss.hexdigest(), total, unknown))

        def batch() -> pa.RecordBatch:
            conv, *rest = list(zip(*out, strict=True)) or [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(conv, kind), *(pa.array(c, t) for c, t in zip(rest, types, strict=True))], ["conv_id", *names])

        for b in batches:
            kind = b.schema.field(0).type
            for conv, piece, a, z in zip(*(b.column(k).to_pylist() for k in (0, 3, 4, 5)), strict=True):
                if conv != now:
                    close()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                if piece is None:
                    state[5] += 1
                    continue
                role, text = read_turn(piece)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if z > a:
                    learnt = unescape(piece[a:z])
                    state[2] += len(learnt)
                    state[3].update(learnt.encode("utf-8", "surrogatepass"))
                state[4] += len(piece)
            if len(out) >= 5000:
                yield batch()
                out.clear()
        close()
        if kind is not None:
            yield batch()

    kind = pieces.schema["conv_id"].dataType.simpleString()
    return ordered.mapInArrow(run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_unknown bigint")


def assembled(pieces: DataFrame) -> DataFrame:
    """Whole formatted conversations, one value each, for conversations known to be small. Returns conv_id, formatted."""
    rows = pieces.filter("piece is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "position", "piece"))).alias("turns"))
    return rows.select("conv_id", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"))
